"""Main-text extraction from web pages with a recurrent block labeller.

A page is parsed into leaf blocks in page order, each with its tag path and text. A bidirectional LSTM in numpy reads a vector for each block
(the hashed tags, classes and ids of its path, its hashed words, its length, links and punctuation) and labels every block in the light
of the whole page. The labeller is trained when it is first needed, in one task of a few seconds, on pages made by ``training_page``: the number of
pages is the bound ``TRAINING_PAGES``, and no row of the data is used.
"""

from __future__ import annotations

import io
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAINING_PAGES = 1200
PATH_DIMS, WORD_DIMS, EXTRA_DIMS, HIDDEN = 512, 128, 8, 20
DIMS = PATH_DIMS + WORD_DIMS + EXTRA_DIMS

_INLINE = set("a abbr acronym annotation b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow ms msqrt msub msup mtext q rp rt ruby s samp script semantics small span strike strong style sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What no reader sees or what is a control; all else is left to the labeller.
_SILENT = set("annotation head script style template textarea select button svg iframe title".split())
#: What an opening tag closes, up to the nearest of the listed ancestors.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
_CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What can stand in a head; any other tag or text ends it.
_IN_HEAD = set("head html base basefont bgsound link meta title noscript noframes style script template".split())
#: What can stand in a select.
_IN_SELECT = set("option optgroup hr script template".split())
_NAME = re.compile(r"[a-z]+")
#: A whole tag. Quotes count after an equals sign only; nothing is given back, so a match takes one pass.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>\x00]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
#: An unquoted value that ends in a slash, which then closes nothing.
_VALUE_AT_END = re.compile(r"""=\s*[^\s"'=]+/$""")
#: Elements whose content is text up to their end tag.
_RAW = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in ("script", "style", "textarea", "title", "iframe", "xmp", "noframes", "noembed")}
_BUTTONS = {tag: re.compile(f"<(/?){tag}\\b", re.I) for tag in ("button", "select")}


class _Blocks:
    """Collects (path, text, characters in links) of each leaf block. Every step takes time by what it reads, not by how deep the page is."""

    def __init__(self, html: str = "") -> None:
        self.html = html
        self.at = 0
        self.unclosed: str | None = None  # the open button or select that no end tag follows
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.where: dict[str, list[int]] = {}  # the places of each open tag in the stack
        self.outer: list[int] = []  # the places of open tags that are not inline
        self.held = [0] * PATH_DIMS  # how often each slot of path names is open
        self.slots: dict[int, None] = {}  # the slots that are open
        self.blocks: list[tuple[tuple[int, ...], str, int]] = []
        self.parts: list[str] = []
        self.linked = self.silent = self.links = 0
        self.path: tuple[int, ...] | None = None

    def read(self) -> list[tuple[tuple[int, ...], str, int]]:
        html, end, torn = self.html, len(self.html), False
        while self.at < end:
            lt = html.find("<", self.at)
            if lt < 0:
                self.text(html[self.at :])
                break
            if lt > self.at:
                self.text(html[self.at : lt])
            self.at = lt
            following = html[lt + 1 : lt + 3]
            if html.startswith("<!--", lt):
                close = html.find(">", lt) if html.startswith(("<!-->", "<!--->"), lt) else html.find("-->", lt + 4)
                self.at = end if close < 0 else close + (1 if html[close] == ">" else 3)
            elif following[:1] in ("!", "?") or (following[:1] == "/" and not following[1:].isalpha() and following[1:]):
                close = html.find(">", lt)
                self.at = end if close < 0 else close + 1
            elif following[:1].isascii() and following[:1].isalpha() or (following[:1] == "/" and following[1:].isascii() and following[1:].isalpha()):
                tag = None if torn else _TAG.match(html, lt)
                if tag:
                    self.at = tag.end()
                    self.tag(tag[1], tag[2].lower(), tag[3])
                else:
                    # all later ends of tags are in quotes, or there is none: from here on the first > ends a tag
                    torn = True
                    close = html.find(">", lt)
                    if close < 0:
                        break  # an unfinished tag at the end
                    self.at = close + 1
                    inner = html[lt + 1 : close]
                    name = re.match(r"(/?)([^\s/>]*)", inner)
                    self.tag(name[1], name[2].lower(), inner[name.end() :])
            else:
                self.text("<")
                self.at = lt + 1
        self._flush()
        return self.blocks

    def tag(self, slash: str, tag: str, rest: str) -> None:
        if slash:
            self.handle_endtag(tag)
            return
        self.handle_starttag(tag, rest)
        if rest.endswith("/") and tag not in _VOID and not _VALUE_AT_END.search(rest):
            self.handle_endtag(tag)
        elif tag in _RAW:
            close = _RAW[tag].search(self.html, self.at)
            stop = close.start() if close else len(self.html)
            if tag not in _SILENT:
                self.text(self.html[self.at : stop])
            self.at = stop

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.path or (), text, self.linked))
            self.parts = []
        self.linked, self.path = 0, None

    def _pop(self, to: int) -> None:
        for tag, slots in reversed(self.stack[to:]):
            self.silent -= tag in _SILENT
            self.links -= tag == "a"
            self.where[tag].pop()
            if tag not in _INLINE:
                self.outer.pop()
            for k in slots:
                self.held[k] -= 1
                if not self.held[k]:
                    del self.slots[k]
            if tag == self.unclosed:
                self.unclosed = None
        del self.stack[to:]

    def _last(self, tags) -> int:
        """The place of the innermost open tag of these; -1 if none is open."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def _end_unclosed(self, tag: str) -> None:
        """Ends a head, and a button or select without end tag, at a tag that cannot stand in it."""
        if self.stack and self.stack[-1][0] == "head" and tag not in _IN_HEAD:
            self._pop(len(self.stack) - 1)
        ends = tag not in _IN_SELECT if self.unclosed == "select" else tag in _CLOSES_P or tag in _CLOSES or tag == "button"
        if self.unclosed and ends:
            self._pop(self.where[self.unclosed][-1])
        if tag in ("button", "select"):
            after = _BUTTONS[tag].search(self.html, self.at)
            if not (after and after[1]):
                self.unclosed = tag

    def handle_starttag(self, tag: str, rest: str) -> None:
        if tag == "br":
            self._end_unclosed(tag)
            if self.parts:
                self.parts.append(" ")
            return
        if tag not in _INLINE:
            self._flush()
        if tag == "body" and self.where.get("head"):  # a head that was never closed ends here
            self._pop(self.where["head"][0])
        self._end_unclosed(tag)
        if tag in _VOID:
            return
        if tag in _CLOSES_P and self.outer and self.stack[self.outer[-1]][0] == "p":
            self._pop(self.outer[-1])
        if tag in _CLOSES:
            shut, within = _CLOSES[tag]
            k = self._last(shut)
            if k >= 0 and k > self._last(within):
                self._pop(k)
        names = [f"<{tag}"]
        for found in _ATTRIBUTE.finditer(rest):
            key, value = found[1].lower(), found[2] or found[3] or found[4]
            if key in ("class", "id", "role") and value:
                names += [f".{x}" for x in _NAME.findall(unescape(value).lower())]
        slots = tuple(_slot(x, PATH_DIMS) for x in names)
        self.where.setdefault(tag, []).append(len(self.stack))
        if tag not in _INLINE:
            self.outer.append(len(self.stack))
        self.stack.append((tag, slots))
        for k in slots:
            self.held[k] += 1
            self.slots[k] = None
        self.silent += tag in _SILENT
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self._flush()
        if self.where.get(tag):
            self._pop(self.where[tag][-1])

    def text(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and not data.isspace():
            self._pop(len(self.stack) - 1)
        if self.silent > 0:
            return
        data = unescape(data)
        if self.path is None and not data.isspace():
            own = (_slot(f"!<{self.stack[-1][0]}", PATH_DIMS),) if self.stack else ()
            self.path = (*self.slots, *own)
        self.parts.append(data)
        if self.links > 0:
            self.linked += len(data)


def blocks_of(html: str | None) -> list[tuple[tuple[int, ...], str, int]]:
    """The leaf blocks of a page in page order: slots of path names, text with white space made single, characters inside links."""
    return _Blocks(html or "").read()


@lru_cache(maxsize=20_000)
def _slot(name: str, dims: int) -> int:
    return zlib.crc32(name.encode()) % dims


def vectors_of(blocks, first: int = 0, total: int | None = None) -> np.ndarray:
    """One row per block: hashed path, hashed words, and a few numbers. blocks may be a run from the place first of a page of total blocks."""
    total = total or len(blocks)
    out = np.zeros((len(blocks), DIMS), np.float32)
    for row, (path, text, linked) in enumerate(blocks):
        out[row, list(path)] = 1
        words = text.lower().split()
        for word in words:
            out[row, PATH_DIMS + zlib.crc32(word.encode("utf-8", "replace")) % WORD_DIMS] += 1
        own = out[row, PATH_DIMS : PATH_DIMS + WORD_DIMS]
        np.minimum(own / (max(1, len(words)) ** 0.5 * 4), 1.0, out=own)
        n = len(text)
        out[row, -EXTRA_DIMS:] = (
            np.log1p(n) / 6, np.log1p(len(words)) / 4, min(1.0, linked / n), min(1.0, 8 * sum(map(text.count, ".,;:!?")) / n),
            (first + row) / total, float(text[-1] in ".!?"), float("©" in text), 1.0,
        )
    return out


# The labeller: parameters in a dict, so that it can be sent to tasks.


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def weights(a: int, b: int) -> np.ndarray:
        return rng.normal(0, a**-0.5, (a, b)).astype(np.float32)

    p = {"o": weights(2 * HIDDEN, 1), "s": weights(DIMS, 1) * 0.1, "c": np.zeros(1, np.float32)}
    for d in "fb":
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1  # gates: in, keep, out, new
        p |= {f"x{d}": weights(DIMS, 4 * HIDDEN), f"h{d}": weights(HIDDEN, 4 * HIDDEN), f"b{d}": bias}
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(p: dict, x: np.ndarray, mask: np.ndarray, d: str, trace: list | None = None, state: list | None = None) -> np.ndarray:
    """The layer's output in one direction. state, if given, holds (h, c) before the run and is set to those after it."""
    size, steps, _ = x.shape
    inner = x @ p[f"x{d}"] + p[f"b{d}"]
    h, c = state or [np.zeros((size, HIDDEN), np.float32)] * 2
    out = np.zeros((size, steps, HIDDEN), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        gates = inner[:, t] + h @ p[f"h{d}"]
        s = _sigmoid(gates[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(gates[:, 3 * HIDDEN :])
        m = mask[:, t, None]
        before, last = c, h
        c = (f * c + i * g) * m
        squashed = np.tanh(c)
        h = o * squashed * m
        out[:, t] = h
        if trace is not None:
            trace.append((t, i, f, o, g, before, last, squashed, m))
    if state is not None:
        state[:] = h, c
    return out


def scores(p: dict, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The probability of each block (page, place) to be main text."""
    both = np.concatenate([_run(p, x, mask, "f"), _run(p, x, mask, "b")], axis=2)
    return _sigmoid((both @ p["o"] + x @ p["s"] + p["c"])[..., 0])


def _gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    traces: dict[str, list] = {"f": [], "b": []}
    outs = [_run(p, x, mask, d, traces[d]) for d in "fb"]
    both = np.concatenate(outs, axis=2)
    miss = (_sigmoid((both @ p["o"] + x @ p["s"] + p["c"])[..., 0]) - y) * mask / mask.sum()
    flat = x.reshape(-1, x.shape[2])
    g = {"o": both.reshape(-1, 2 * HIDDEN).T @ miss.reshape(-1, 1), "s": flat.T @ miss.reshape(-1, 1), "c": miss.sum(keepdims=True)[0]}
    for k, d in enumerate("fb"):
        back = miss[..., None] * p["o"][k * HIDDEN : (k + 1) * HIDDEN, 0]
        dgates = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        dh = dc = np.zeros((len(x), HIDDEN), np.float32)
        dw = np.zeros_like(p[f"h{d}"])
        for t, i, f, o, new, before, last, squashed, m in reversed(traces[d]):
            dh = (dh + back[:, t]) * m
            dc = (dc + dh * o * (1 - squashed**2)) * m
            da = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=1)
            dgates[:, t] = da
            dw += last.T @ da
            dh, dc = da @ p[f"h{d}"].T, dc * f
        inner = dgates.reshape(-1, 4 * HIDDEN)
        g |= {f"x{d}": flat.T @ inner, f"h{d}": dw, f"b{d}": inner.sum(0)}
    return g


def _padded(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, vectors))
    x, mask = np.zeros((len(vectors), steps, DIMS), np.float32), np.zeros((len(vectors), steps), np.float32)
    for k, v in enumerate(vectors):
        x[k, : len(v)], mask[k, : len(v)] = v, 1
    return x, mask


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, epochs: int = 24, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters fitted to so many made pages; the same for the same arguments."""
    rng, made = np.random.default_rng(seed), []
    for k in range(pages):
        html, main = training_page(random.Random(seed * 100_003 + k))
        blocks = blocks_of(html)
        if blocks:
            plain = [(path, text.replace(MARK, ""), linked) for path, text, linked in blocks]
            made.append((vectors_of(plain), np.array([MARK in text for _, text, _ in blocks], np.float32)))
    made.sort(key=lambda m: len(m[1]))
    p = _start(rng)
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    mean, step = {k: np.zeros_like(v) for k, v in p.items()}, 0
    groups = [made[k : k + 25] for k in range(0, len(made), 25)]
    for epoch in range(epochs):
        for k in rng.permutation(len(groups)):
            x, mask = _padded([v for v, _ in groups[k]])
            # paths are what templates differ in most: some names are left out, so that context has to do
            x = x * (rng.random((len(x), 1, DIMS)) > np.where(np.arange(DIMS) < PATH_DIMS, 0.12, 0.3)).astype(np.float32)
            y = np.zeros_like(mask)
            for r, (_, label) in enumerate(groups[k]):
                y[r, : len(label)] = label
            step += 1
            late = epoch >= epochs * 2 // 3
            rate = 0.01 * (0.2 if late else 1)
            for name, g in _gradients(p, x, mask, y).items():
                g = np.clip(g, -1, 1)
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.999 * m2[name] + 0.001 * g * g
                p[name] = (p[name] - rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                if late:  # the parameters are the mean of those of the late steps
                    mean[name] += p[name]
    return {name: total / (len(groups) * (epochs - epochs * 2 // 3)) for name, total in mean.items()}


_fitted: dict[int, dict[str, np.ndarray]] = {}


def fitted(spark: SparkSession, pages: int = TRAINING_PAGES) -> dict[str, np.ndarray]:
    """trained(pages), from a task of one row: there numpy has one thread, which small matrices are quickest with."""
    if pages not in _fitted:

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                held = io.BytesIO()
                np.savez(held, **trained(pages))
                yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()], pa.binary())], names=["model"])

        model = spark.range(1, numPartitions=1).mapInArrow(of, "model binary").first()["model"]
        with np.load(io.BytesIO(bytes(model))) as parts:
            _fitted[pages] = {name: parts[name] for name in parts.files}
    return _fitted[pages]


#: In made pages, the first character of every block of main text; it is taken out before the vectors are made.
MARK = "\u2060"

_SYLLABLES = "an ba chi der en fo gra he is jo kla li mon ne or pra que ra sti tion un ver wo xi ya zu é ö ñ ça".split()
_MENU, _HEADER = ("menu", "nav", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager"), ("header", "masthead", "site-header", "branding", "topbar", "page-header")
_FOOTER, _SIDE = ("footer", "site-footer", "copyright", "bottom", "legal", "colophon"), ("sidebar", "side", "widget", "related", "recommended", "more", "popular", "rail")
_NOTICE, _AD = ("cookie", "cookies", "notice", "alert", "banner", "consent", "announcement", "gdpr", "message", "warning", "popup", "modal"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "adsbox", "banner-ad")
_COMMENT, _SHARE = ("comments", "comment", "replies", "discussion", "reader-comments", "comment-list", "responses"), ("share", "social", "tags", "meta", "byline", "tools")
_FORM, _MAIN = ("newsletter", "subscribe", "signup", "search", "login", "contact"), ("content", "main", "post", "entry", "article", "story", "article-body", "post-content", "entry-content", "body", "text")


#: Words by their part on a page, in several languages: what a labeller can tell where tags and classes say nothing.
_SAID = {
    "main": tuple("the of and to in that was for with as on were had not from by which their this but they have been one all would there when who more has its into only other than after could der die und nicht war von mit sich des auf eine als auch nach wurde durch aber noch sind werden les des une dans que qui pour pas sur par plus avec ont mais cette leur los las del por una con para pero sus como entre desde hasta".split()),
    "menu": tuple("home about contact login products news blog shop services help faq search account cart sitemap archive start kontakt anmelden produkte accueil connexion produits boutique inicio contacto productos tienda next previous page top menu".split()),
    "legal": tuple("copyright rights reserved privacy terms imprint policy conditions inc ltd gmbh powered theme contact impressum datenschutz rechte vorbehalten mentions confidentialité droits réservés aviso legal derechos reservados privacidad".split()),
    "notice": tuple("cookies cookie accept we use consent settings agree browser experience website zustimmen verwenden akzeptieren utilisons accepter utilizamos aceptar dismiss enable javascript update".split()),
    "ad": tuple("sponsored advertisement buy now offer sale discount deal save free shipping click order price anzeige rabatt kaufen publicité offre publicidad oferta".split()),
    "form": tuple("subscribe newsletter email sign up name password submit send enter your address abonnieren senden inscrivez envoyer suscríbete enviar".split()),
    "comment": tuple("reply says posted ago comment comments thanks agree great i you my antworten schrieb répondre merci responder gracias lol share like".split()),
    "side": tuple("related popular recommended latest recent tags categories read more posts trending mehr ähnliche beliebt lire aussi récents leer más relacionados".split()),
}
_MADE = ("css-", "sc-", "_", "jss", "x", "styles__", "ember")


def training_page(rng: random.Random) -> tuple[str, list[str]]:
    """A made page, and the texts of its main blocks, each of which holds MARK."""
    main: list[str] = []

    style = rng.choice(("plain",) * 5 + ("shout", "table", "symbols", "numbers", "repeat"))
    odd = rng.random()
    naming = rng.choices(("words", "made", "none"), (0.62, 0.19, 0.19))[0]
    # where names say nothing, words must; on other pages they may
    strange = naming == "words" and rng.random() < 0.25  # the article has a name of its own
    telling = 0.6 if naming != "words" else rng.choice((0, 0, 0.4))

    def words(low: int, high: int, role: str = "main") -> str:
        made = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        if telling:
            made = [rng.choice(_SAID[role]) if rng.random() < telling else w for w in made]
        made[0] = made[0].capitalize()
        if style != "plain" and rng.random() < odd:
            if style == "shout":
                made = [w.upper() + "!!" for w in made]
            elif style == "table":
                made = [x for w in made for x in (w, "|")]
            elif style == "repeat":
                made = made[:1] * len(made)
            elif style == "symbols":
                made = [w + rng.choice(("###", "***", "%%%", "$$$", "&amp;&amp;&amp;")) for w in made]
            else:
                made = [w if rng.random() < 0.5 else str(rng.randrange(10**6)) for w in made]
        return " ".join(w + (rng.choice(",.;") if rng.random() < 0.12 else "") for w in made) + rng.choice((".", ".", "!", "?", ""))

    def box(names, inner: str, tags=("div", "section")) -> str:
        key = rng.choice(("class", "class", "id"))
        if naming == "none":
            return f"<{(t := rng.choice(tags))}>{inner}</{t}>"
        if naming == "made":
            own = " ".join(rng.choice(_MADE) + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=rng.randint(4, 7))) for _ in range(rng.randint(1, 2)))
            return f'<{(t := rng.choice(tags))} class="{own}">{inner}</{t}>'
        if strange and names is _MAIN:
            names = ["".join(rng.choices(_SYLLABLES[:26], k=rng.randint(2, 3)))]
        own = rng.choice(names) + (rng.choice((" ", "-", "_")) + rng.choice(("box", "wrap", "inner", "block", "area", "x")) if rng.random() < 0.3 else "")
        return f'<{(t := rng.choice(tags))} {key}="{own}">{inner}</{t}>'

    def links(low: int, high: int, role: str = "menu") -> str:
        item = [f'<a href="/{k}">{words(1, 3, role)}</a>' for k in range(rng.randint(low, high))]
        return rng.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in item) + "</ul>", " | ".join(item), "".join(f"<p>{x}</p>" for x in item)))

    def prose(low: int, high: int, role: str = "side") -> str:
        return "".join(f"<p>{words(3, 40, role)}</p>" for _ in range(rng.randint(low, high)))

    def said(tag: str, text: str) -> str:
        main.append(text)
        body = MARK + text
        shape = rng.random()
        if shape < 0.1:
            return f"<{tag}><b>{body}<br>"
        if shape < 0.2:
            return f"<{tag}>{body}"
        if shape < 0.35:
            return f'<{tag}>{body} <a href="#">{words(1, 2)}</a> <em>{words(1, 3)}</em></{tag}>'
        return f"<{tag}>{body}</{tag}>"

    def ad() -> str:
        return rng.choice((lambda: box(_AD, words(2, 20, "ad"), ("div", "aside", "section")), lambda: box(_AD, prose(1, 2, "ad") + links(1, 2, "ad"))))()

    def form() -> str:
        inner = f'<label>{words(1, 3, "form")}</label><input name="q"><p>{words(2, 12, "form")}</p><button>{words(1, 2, "form")}</button>'
        return rng.choice((f"<form>{inner}</form>", box(_FORM, f"<form>{inner}</form>"), box(_FORM, f"<h3>{words(1, 4, 'form')}</h3><p>{words(3, 15, 'form')}</p>")))

    def notice() -> str:
        return box(_NOTICE, rng.choice((words(4, 25, "notice"), prose(1, 2, "notice"))) + (f"<a href='#'>{words(1, 2, 'notice')}</a>" if rng.random() < 0.5 else ""), ("div", "section", "aside"))

    def fallback() -> str:
        """What a browser shows only where it cannot run or play something."""
        return rng.choice((f"<noscript>{words(2, 15, 'notice')}</noscript>", f"<noscript><p>{words(2, 15, 'notice')}</p></noscript>", f"<video>{words(2, 10, 'notice')}</video>", f"<audio><p>{words(2, 10, 'notice')}</p></audio>", f"<object>{words(2, 10, 'notice')}</object>", f"<canvas>{words(2, 10, 'notice')}</canvas>"))

    def comments() -> str:
        one = [rng.choice((box(("comment",), f"<b>{words(1, 2, 'comment')}</b><p>{words(2, 40, 'comment')}</p>", ("div", "li", "article")), f"<div><h4>{words(1, 2, 'comment')}</h4><p>{words(2, 30, 'comment')}</p></div>", f"<li>{words(2, 30, 'comment')}</li>")) for _ in range(rng.randint(1, 6))]
        return box(_COMMENT, f"<{(h := rng.choice(('h2', 'h3')))}>{words(1, 3, 'comment')}</{h}>" * (rng.random() < 0.7) + "".join(one), ("div", "section", "ol", "ul"))

    def side() -> str:
        inner = rng.choice((f"<h3>{words(1, 3, 'side')}</h3>" + links(2, 6, "side"), prose(1, 3), f"<h3>{words(1, 3, 'side')}</h3>" + prose(1, 2)))
        return rng.choice((f"<aside>{inner}</aside>", box(_SIDE, inner, ("div", "aside", "section"))))

    def article() -> str:
        parts = [said("h1", words(3, 12))] if rng.random() < 0.85 else []
        if rng.random() < 0.15:
            parts.append(box(_SHARE, links(1, 4)))
        for _ in range(rng.randint(1, 14) if rng.random() < 0.95 else rng.randint(30, 80)):
            kind = rng.random()
            if kind < 0.78:
                parts.append(said("p", words(1, 110) if rng.random() < 0.8 else words(1, 4)))
            elif kind < 0.84:
                parts.append(said(rng.choice(("h2", "h3")), words(1, 8)))
            elif kind < 0.88:
                parts.append("<ul>" + "".join(said("li", words(2, 15)) for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.91:
                parts.append("<blockquote>" + said("p", words(4, 40)) + "</blockquote>")
            elif kind < 0.925:
                parts.append(said("pre", words(4, 40)))
            elif kind < 0.93:
                parts.append("<figure><img src='x'>" + said("figcaption", words(2, 15)) + "</figure>")
            elif kind < 0.945:
                parts.append("<table><tr>" + "".join(said("td", words(1, 4)) for _ in range(4)) + "</tr></table>")
            else:
                parts.append(rng.choice((ad, form, notice, side, fallback) if naming == "words" else (form, fallback))())
        if rng.random() < 0.15:
            parts.append(box(_SHARE, links(1, 5)))
        inner = "".join(parts)
        return rng.choice((f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", box(_MAIN, inner), f"<article>{box(_MAIN, inner)}</article>", f"<div>{box(_MAIN, inner)}</div>"))

    top, low = [], []
    if rng.random() < 0.8:
        top.append(rng.choice((lambda: f"<nav>{links(2, 9)}</nav>", lambda: box(_MENU, links(2, 9), ("div", "ul", "nav"))))())
    if rng.random() < 0.5:
        inner = rng.choice((f"<h1>{words(1, 3, 'menu')}</h1>", f"<p>{words(1, 8, 'menu')}</p>", f'<a href="/">{words(1, 2, "menu")}</a>')) + (f"<p>{words(2, 9, 'menu')}</p>" if rng.random() < 0.4 else "") + (f"<nav>{links(2, 5)}</nav>" if rng.random() < 0.3 else "")
        top.insert(0, rng.choice((f"<header>{inner}</header>", box(_HEADER, inner))))
    top += [x() for x in (notice, ad, form, side, fallback) if rng.random() < 0.3]
    low += [x() for x in (comments, side, ad, form, notice) if rng.random() < 0.35]
    if rng.random() < 0.85:
        inner = rng.choice((lambda: "&copy; " + words(1, 4, "legal") + " &middot; " + words(3, 12, "legal"), lambda: f"<p>&copy; {words(2, 10, 'legal')}</p>" + links(1, 5, "legal"), lambda: prose(1, 3, "legal"), lambda: words(3, 12, "legal")))()
        low.append(rng.choice((f"<footer>{inner}</footer>", box(_FOOTER, inner, ("div", "footer")))))
    if rng.random() < 0.1:  # an article alone
        top, low = [], []
    head = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>"
    text = article()
    body = "".join(top) + text + "".join(low)
    if rng.random() < 0.1:  # laid out by a table
        split = rng.randint(0, len(low))
        cells = [f"<td>{''.join(top)}</td>", f"<td>{text}</td>", f"<td>{''.join(low[:split])}</td>"]
        body = "<table>" + rng.choice((f"<tr>{''.join(cells)}</tr>", f"<tr>{cells[0]}</tr><tr>{cells[1]}{cells[2]}</tr>")) + f"<tr><td>{''.join(low[split:])}</td></tr></table>"
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(("page", "wrapper", "container", "site", "layout"))}">{body}</div>'
    return head + body + ("</body></html>" if rng.random() < 0.9 else ""), main


def _label_long(p: dict, blocks: list, run: int) -> np.ndarray:
    """label() of one page by runs of blocks, the states handed on from run to run: the same result in bounded memory."""
    n = len(blocks)
    total = np.zeros(n, np.float32)
    edges = [(a, min(a + run, n)) for a in range(0, n, run)]
    for d, some, own in (("f", edges, p["o"][:HIDDEN]), ("b", edges[::-1], p["o"][HIDDEN:])):
        state = [np.zeros((1, HIDDEN), np.float32)] * 2
        for a, b in some:
            x = vectors_of(blocks[a:b], a, n)[None]
            total[a:b] += (_run(p, x, np.ones(x.shape[:2], np.float32), d, state=state) @ own)[0, :, 0]
            if d == "f":
                total[a:b] += (x @ p["s"] + p["c"])[0, :, 0]
    return total > 0


def label(params: dict, pages: list[list], long_page: int = 4096) -> list[np.ndarray]:
    """For each page's blocks whether they are main text; pages of like length are read together, those of over long_page blocks by runs."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    for k, blocks in enumerate(pages):
        if len(blocks) > long_page:
            out[k] = _label_long(params, blocks, long_page)
    order = sorted((k for k in range(len(pages)) if 0 < len(pages[k]) <= long_page), key=lambda k: len(pages[k]))
    while order:
        steps = len(pages[order[-1]])
        some = order[-max(1, 20_000 // steps) :]
        del order[-len(some) :]
        x, mask = _padded([vectors_of(pages[k]) for k in some])
        p = scores(params, x, mask)
        for row, k in enumerate(some):
            out[k] = p[row, : len(pages[k])] > 0.5
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", training_pages: int = TRAINING_PAGES) -> DataFrame:
    """(id_col, url_col, text, n_chars) for every row of pages: the blocks labelled as main text, joined by newlines in page order.

    Null and empty html and pages without main text give an empty text. Null ids and urls and repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    params = fitted(pages.sparkSession, training_pages)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [blocks_of(h.as_py()) for h in part.column(2)]
                texts = ["\n".join(b[1] for b, yes in zip(blocks, keep) if yes) for blocks, keep in zip(found, label(params, found))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(of, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
