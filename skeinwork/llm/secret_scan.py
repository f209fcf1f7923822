"""Secret scans: fixed patterns, and a battery of randomness tests on the tokens that no pattern covers.

Everything is built-in expressions. A pattern's matches are marked in the text, which is then split at the marks, so that
lengths give places. A further token gets an encoding from the letters it uses; under the hypothesis that its letters are drawn evenly
from that encoding's alphabet, five tests give p-values: chi-squared of the letter counts and of the counts of letter kinds, runs of
kinds, runs about the middle of the alphabet, serial correlation of neighbours. The sum of -ln p is a token's score, low for random ones.

False discoveries are controlled against written tokens: how their scores spread, by length and width of the alphabet, is fitted to
names made by rule (``WRITTEN`` of them, no row of the data is used), which gives every token the probability that a written
one scores as low. Within tokens of like length over all documents, Benjamini-Hochberg on these keeps the share of written tokens among
those reported, as spans of kind random, at the given rate. The work of every expression grows with the text's length (running
sums with its matches' power 1.5), so that one long token or many matches in a text do no harm.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Kinds in their order: name, pattern, the least length of a match or of its second group.
_KEYS, _VALUE = "password|passwd|secret|token|api_?key", r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", f"((?i:{_KEYS})){_VALUE}", 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]{24,}", 24),
)
#: Least length of a token, or of a part of it between signs, that is tested.
LEAST = 16
_RUN = "[A-Za-z0-9+/_-]"
#: A whole run of token letters, unless it ends in a key with a value; assignments are passed over. Group 3 is the token.
TOKENS = f"(?:{KINDS[0][1]})|(?<!{_RUN})(?:{_RUN}{{{LEAST},}}+(?<=(?i:{_KEYS})){_VALUE.replace('([', '(?:[')}|({_RUN}{{{LEAST},}}+={{0,2}}))"
_COVERED = r"[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}"
_MARK, _GROUP, _END = "\u0001", "\u0002", "\u0003"

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets of the encodings, narrowest first.
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
#: The letters that written words have most of; the others are kinds of their own in the count of kinds.
FREQUENT = "aeilnorst"
_FINE = (FREQUENT, "".join(c for c in _LOWER if c not in FREQUENT), FREQUENT.upper(), "".join(c for c in _UPPER if c not in FREQUENT.upper()), _DIGITS, "+/-_")
_COARSE = (_LOWER, _UPPER, _DIGITS, "+/-_")
_SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string>>"
_INTS = "array<int>"
#: Scores are counted in steps of a hundredth of their natural logarithm.
_STEPS = 100
#: Lengths from which a class of like length begins.
LENGTHS = (16, 18, 20, 23, 26, 30, 36, 44, 56, 72)
#: How many written tokens the scores' spread is fitted to.
WRITTEN = 24_000


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _before(values: Column, join) -> Column:
    """(before, all): for each value what join makes of 0 and the values before it, and of all. In pieces of about the root of the length, as arrays grow by copying."""

    def scan(xs: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        return F.aggregate(xs, F.struct(F.lit(0).alias("at"), F.array().cast(_INTS).alias("out")), step)

    def pieces(xs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int")
        some = _let(size, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / n).cast("int")), lambda k: F.slice(xs, k * n + 1, n)))

        def joined(w: Column) -> Column:
            tops = scan(F.transform(w, lambda x: x["at"]))
            return _let(tops, lambda t: F.struct(F.flatten(F.zip_with(w, t["out"], lambda x, b: F.transform(x["out"], lambda y: join(b, y)))).alias("before"), t["at"].alias("all")))

        return _let(F.transform(some, scan), joined)

    none = F.struct(F.array().cast(_INTS).alias("before"), F.lit(0).alias("all"))
    return _let(values, lambda xs: F.when(F.size(xs) > 0, pieces(xs)).otherwise(none))


def _places(pieces: Column) -> Column:
    """The running sums before each of the lengths in pieces."""
    return _before(pieces, lambda a, b: a + b)["before"]


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches whose group has the least length: (start, end, token) in code points; the token is the group."""
    marked = F.regexp_replace(text, pattern, f"{_MARK}$0{_GROUP}${group}{_END}")
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")

    def of(parts: Column) -> Column:
        def cut(p: Column) -> Column:
            hit, rest = F.length(F.substring_index(p, _GROUP, 1)), F.length(F.substring_index(p, _END, -1))
            return F.struct(hit.alias("hit"), F.substring_index(F.substring_index(p, _END, 1), _GROUP, -1).alias("token"), rest.alias("rest"))

        def spans(hits: Column) -> Column:
            at = _places(F.transform(hits, lambda h: h["hit"] + h["rest"]))
            first = F.length(parts[0])
            made = F.zip_with(hits, at, lambda h, a: F.struct((first + a).alias("start"), (first + a + h["hit"]).alias("end"), h["token"].alias("token")))
            return F.filter(made, lambda s: F.length(s["token"]) >= least)

        return _let(F.transform(F.slice(parts, 2, F.size(parts)), cut), spans)

    return _let(marked, lambda m: F.when(F.contains(m, F.lit(_MARK)), _let(F.split(m, _MARK, -1), of)).otherwise(none))


def _clean(text: Column) -> Column:
    """The text with the marks' characters replaced by one that no pattern takes; places stay."""
    text = F.coalesce(text, F.lit(""))
    marks = F.contains(text, F.lit(_MARK)) | F.contains(text, F.lit(_GROUP)) | F.contains(text, F.lit(_END))
    return F.when(marks, F.translate(text, _MARK + _GROUP + _END, "\u0004\u0004\u0004")).otherwise(text)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal law, by a five-term rational fit with an error under 1e-7."""

    def of(x: Column) -> Column:
        t = x["t"]
        # Horner's scheme, so that every value is named once
        series = F.lit(1.330274429)
        for c in (-1.821255978, 1.781477937, -0.356563782, 0.319381530):
            series = c + t * series
        return F.exp(-x["z"] * x["z"] / 2) * 0.3989422804014327 * series * t

    tail = lambda v: _let(F.struct(F.abs(v).alias("z"), (1 / (1 + 0.2316419 * F.abs(v))).alias("t")), of)
    return _let(z, lambda v: _let(tail(v), lambda p: F.when(v >= 0, p).otherwise(1 - p)))


def _facts(letters: str) -> Column:
    """What the tests need of an alphabet: the letters, their lower half, chances of kinds, mean and spread of changes of kind."""
    n = len(letters)
    coarse = [sum(c in kind for c in letters) / n for kind in _COARSE]
    change = 1 - sum(q * q for q in coarse)
    twice = sum(q * (1 - q) ** 2 for q in coarse) - change * change
    fine = [sum(c in kind for c in letters) / n for kind in _FINE]
    return F.struct(
        F.lit(letters).alias("letters"), F.lit(float(n)).alias("size"), F.lit(letters[: n // 2]).alias("low"), F.lit("." * (n // 2)).alias("dots"),
        F.array(*map(F.lit, fine)).alias("fine"), F.lit(float(sum(q > 0 for q in fine) - 1)).alias("free"), F.lit(change).alias("change"), F.lit(twice).alias("twice"),
    )


def _normal(chi: Column, free: Column) -> Column:
    """A chi-squared value as a normal one, by its cube root."""
    return (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))


def evidence(token: Column) -> Column:
    """The score of a token, the sum of -ln p over the tests; null if it has no encoding, under two letters or one kind of letter only."""
    body = F.rtrim(token, F.lit("="))

    def encoding(s: Column) -> Column:
        found = F.lit(None)
        for name, letters in reversed(ALPHABETS.items()):
            pattern = {"base64": "[A-Za-z0-9+/]+", "base64url": "[A-Za-z0-9_-]+"}.get(name, f"[{letters}]+")
            found = F.when(s.rlike(f"^{pattern}$"), _facts(letters)).otherwise(found)
        return found

    def tests(x: Column) -> Column:
        s, n, f = x["s"], x["n"], x["f"]
        size = f["size"]
        letters = F.split(f["letters"], "", -1)
        squares = F.aggregate(letters, F.lit(0.0), lambda acc, c: acc + F.pow((x["long"] - F.length(F.replace(s, c, F.lit("")))).cast("double"), F.lit(2.0)))
        counts = F.array(*[F.regexp_count(s, F.lit(f"[{kind.replace('-', chr(92) + '-')}]")).cast("double") for kind in _FINE])
        kinds = F.aggregate(F.zip_with(counts, f["fine"], lambda c, q: F.when(q > 0, F.pow(c - n * q, F.lit(2.0)) / (n * q)).otherwise(0.0)), F.lit(0.0), lambda acc, c: acc + c)
        coarse = F.translate(s, "".join(_COARSE), "".join(str(k) * len(kind) for k, kind in enumerate(_COARSE)))
        changes = F.regexp_count(coarse, F.lit("0+|1+|2+|3+")) - 1 - (n - 1) * f["change"]
        spread = F.sqrt((n - 1) * f["change"] * (1 - f["change"]) + 2 * (n - 2) * f["twice"])
        halves = F.regexp_count(F.call_function("translate", s, f["low"], f["dots"]), F.lit("[.]+|[^.]+"))
        middle = (size + 1) / 2

        def walk(acc: Column, c: Column) -> Column:
            return _let(F.instr(f["letters"], c) - middle, lambda at: F.struct(at.alias("last"), (acc["sum"] + acc["last"] * at).alias("sum")))

        moved = F.aggregate(F.split(s, "", -1), F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("sum")), walk)["sum"]
        upper = F.array(_normal(squares * size / n - n, size - 1), _normal(kinds, f["free"]))
        both = F.array(changes / spread, (halves - 1 - (n - 1) / 2) / F.sqrt((n - 1) / 4), moved / ((size * size - 1) / 12 * F.sqrt(n - 1)))
        p = F.concat(F.transform(upper, _upper_tail), F.transform(both, lambda z: 2 * _upper_tail(F.abs(z))))
        return F.aggregate(p, F.lit(0.0), lambda acc, q: acc - F.ln(F.least(F.greatest(q, F.lit(1e-30)), F.lit(1.0))))

    def of(s: Column) -> Column:
        rated = _let(F.struct(s.alias("s"), F.length(s).alias("long"), F.length(s).cast("double").alias("n"), encoding(s).alias("f")), tests)
        return F.when((F.length(s) >= 2) & s.rlike("^[A-Za-z0-9+/_-]+$") & ~s.rlike("^(?:[A-Z]+|[a-z]+|[0-9]+)$") & ~s.rlike("^(?=.*[+/]).*[_-]"), rated)

    return _let(body, of)


def _class(token: Column) -> Column:
    """Tokens of like length and width of alphabet: ten times the length's class, and one if letters of both cases or signs are used."""
    length = F.length(F.rtrim(token, F.lit("=")))
    at = F.lit(0)
    for k, low in enumerate(LENGTHS):
        at = F.when(length >= low, k).otherwise(at)
    wide = token.rlike("[+/_-]") | (token.rlike("[A-Z]") & token.rlike("[a-z]"))
    return at * 10 + wide.cast("int")


def _log(score: Column) -> Column:
    return F.when(score.isNotNull(), F.ln(F.greatest(score, F.lit(0.01))))


def _step(score: Column) -> Column:
    return _let(score, lambda x: F.floor(_STEPS * _log(x)).cast("int"))


def _rated(start: Column, token: Column) -> Column:
    return _let(token, lambda t: F.struct(start.alias("start"), (start + F.length(t)).alias("end"), _class(t).alias("size"), _step(evidence(t)).alias("step")))


def _tried(text: Column) -> Column:
    """Tokens outside base spans: (whole, parts), each rated as (start, end, class, step); parts are the runs between signs. No step: not tested."""

    def sought(t: Column) -> Column:
        return (F.length(F.rtrim(t, F.lit("="))) >= LEAST) & ~t.rlike(_COVERED)

    def parts(start: Column, token: Column) -> Column:
        def of(runs: Column) -> Column:
            at = _places(F.transform(runs, lambda r: F.length(r) + 1))
            cut = F.zip_with(runs, at, lambda r, a: F.struct((start + a).alias("start"), F.rtrim(r, F.lit("=")).alias("token")))
            return F.transform(F.filter(cut, lambda c: sought(c["token"])), lambda c: _rated(c["start"], c["token"]))

        none = F.array().cast("array<struct<start:int,end:int,size:int,step:int>>")
        return F.when(token.rlike("[+/_-]"), _let(F.split(token, "[+/_-]", -1), of)).otherwise(none)

    found = _matches(text, TOKENS, 3, LEAST)
    return F.transform(found, lambda t: F.struct(F.when(sought(t["token"]), _rated(t["start"], t["token"])).alias("whole"), parts(t["start"], t["token"]).alias("parts")))


def _base(text: Column) -> Column:
    def spans(k: int, kind: str, pattern: str, least: int) -> Column:
        found = _matches(text, pattern, 2 if kind == "assign" else 0, least)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind_no"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.sort_array(F.concat(*[spans(k, *kind) for k, kind in enumerate(KINDS)]))


def written(spark: SparkSession, rows: int = WRITTEN) -> DataFrame:
    """(token): names and paths put together by rule from words and small numbers, the same for the same number of rows. Longer numbers and dates score higher."""
    words = (
        "the and user name list order item file page part time date report annual section value index number count total first last open "
        "account service request response handler manager factory builder config setting option message content version control system "
        "data base table column query filter search result image video audio north south river garden market winter summer station letter "
        "zwischen verwaltung gesellschaft nouvelle histoire journal ciudad trabajo semana"
    ).split()
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    table = F.array(*map(F.lit, words))
    some = F.transform(F.sequence(F.lit(0), F.least(draw(1, 16), draw(2, 16))), lambda k: table[F.pmod(F.xxhash64("id", k, F.lit(9)), F.lit(len(words))).cast("int")])
    name = F.array_join("w", "-")
    camel = F.regexp_replace(F.initcap(F.regexp_replace(name, "-", " ")), " ", "")
    as_words = [F.regexp_replace(name, "-", sign) for sign in ("-", "_", "/", "", "")]
    shapes = [*as_words, F.upper(as_words[1]), F.upper(as_words[3]), camel, F.concat(F.lit("v"), camel)]
    ends = [F.lit(""), draw(3, 100).cast("string"), draw(4, 10**4).cast("string")]
    joined, end = F.element_at(F.array(*shapes), draw(5, len(shapes)) + 1), F.element_at(F.array(*ends), draw(6, len(ends)) + 1)
    made = spark.range(0, rows, 1, 4).select("id", some.alias("w")).select(F.concat(joined, end).alias("token"))
    return made.select(F.substring("token", 1, 2 * LENGTHS[-1]).alias("token")).filter(F.length("token") >= LEAST)


@lru_cache(maxsize=4)
def _spread(spark: SparkSession, rows: int) -> dict[int, tuple[float, float]]:
    """By class, mean and standard deviation of the logarithm of written tokens' scores; at most two rows a length class."""
    rated = written(spark, rows).select(_class(F.col("token")).alias("size"), _let(evidence(F.col("token")), _log).alias("x"))
    sums = rated.filter("x is not null").groupBy("size").agg(F.avg("x").alias("m"), F.stddev("x").alias("s"), F.count("*").alias("n"))
    held = {r["size"]: (r["m"], r["s"]) for r in sums.collect() if r["n"] >= 30}
    for k in range(len(LENGTHS)):  # a class with too few takes the spread of the next shorter one
        for wide in (0, 1):
            held.setdefault(10 * k + wide, held.get(10 * (k - 1) + wide, (math.log(10), 0.5)))
    return held


def cutoffs(tried: DataFrame, rate: float, rows: int = WRITTEN) -> dict[int, int]:
    """For each class the step up to which tokens are reported as random.

    tried has a column of arrays as _tried makes them. Its counts by class and step are a bounded table; at most two rows a length class come back.
    """
    spread = _spread(tried.sparkSession, rows)
    mean, dev = (F.create_map(*[F.lit(x) for size, v in spread.items() for x in (size, v[k])])[F.col("size")] for k in (0, 1))
    each = tried.select(F.explode("tried").alias("t")).select(F.explode(F.concat(F.array("t.whole"), "t.parts")).alias("t"))
    steps = each.filter("t.step is not null").groupBy(F.col("t.size").alias("size"), F.col("t.step").alias("step")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("size").orderBy("step")
    ranked = steps.select("size", "step", F.sum("n").over(up).alias("within"), F.sum("n").over(Window.partitionBy("size")).alias("m"))
    chance = _upper_tail((mean - (F.col("step") + 1) / _STEPS) / dev)
    last = ranked.filter(chance <= rate * F.col("within") / F.col("m")).groupBy("size").agg(F.max("step").alias("step"))
    return {r["size"]: r["step"] for r in last.collect()}


def _spans(base: Column, tried: Column, cutoff: dict[int, int]) -> Column:
    """Base spans and those of random tokens, in order. A part counts where the whole token does not."""
    if not cutoff:
        return base
    limits = F.create_map(*[F.lit(x) for kv in cutoff.items() for x in kv])
    found = lambda t: F.coalesce(t["step"] <= limits[t["size"]], F.lit(False))
    stays = F.flatten(F.transform(tried, lambda t: F.when(found(t["whole"]), F.array(t["whole"])).otherwise(F.filter(t["parts"], found))))
    more = F.transform(stays, lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("kind_no"), t["end"].alias("end"), F.lit("random").alias("kind")))
    return F.sort_array(F.concat(base, more))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _looked_at(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    text = docs.select(*keep, _clean(F.col(text_col)).alias("__text"))
    return text.withColumn("base", _base(F.col("__text"))).withColumn("tried", _tried(F.col("__text"))).drop("__text")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """(id_col, base array of spans, spans array of spans) for every row of docs; spans hold start, end (code points) and kind.

    Null and empty texts have none. Repeated rows and null ids stay; other columns are ignored; an empty table gives no rows.
    """
    seen = materialize(_looked_at(docs, text_col, F.col(id_col).alias("id")))
    return seen.select(F.col("id").alias(id_col), "base", _spans(F.col("base"), F.col("tried"), cutoffs(seen, rate)).alias("spans"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans) of scan()."""
    found = scan(docs, id_col, text_col, rate)

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind, _, _ in KINDS]
    return found.select(id_col, *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """text with the spans, sorted by start, replaced. Letters are four bytes each, so that a part is cut out without counting from the text's start."""
    blank = F.lit(b"\x00\x00\x00\x20")  # before each part, as a byte-order mark at its start would be dropped

    def letters(held: Column, a: Column, b: Column) -> Column:
        part = F.concat(blank, F.substring(held, a * 4 + 1, (b - a) * 4))
        return F.substring(F.decode(part, "UTF-32"), F.lit(2), F.length(part))

    def of(x: Column) -> Column:
        ends = _before(F.transform(x["spans"], lambda s: s["end"]), F.greatest)

        def pieces(e: Column) -> Column:
            cut = F.zip_with(x["spans"], e["before"], lambda s, at: F.when(s["start"] >= at, F.concat(letters(x["held"], at, s["start"]), F.lit(mask))).otherwise(""))
            return F.concat(F.array_join(cut, ""), letters(x["held"], e["all"], F.length(x["text"])))

        return _let(ends, pieces)

    return _let(F.struct(text.alias("text"), F.encode(text, "UTF-32").alias("held"), spans.alias("spans")), of)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05, mask: str = "[secret]") -> DataFrame:
    """docs with every span of its texts replaced by the mask; rows and columns, whatever their names, stay. Overlapping spans become one mask.

    Null texts stay null, empty ones empty. The few cutoffs are made from all texts first; the texts are then read again, so no text is shuffled.
    """
    limits = cutoffs(docs.select(_tried(_clean(F.col(text_col))).alias("tried")), rate)
    text = F.col(text_col)
    spans = _let(_clean(text), lambda t: _spans(_base(t), _tried(t), limits))
    changed = _let(spans, lambda s: F.when(F.size(s) > 0, _masked(text, s, mask)).otherwise(text))
    return docs.withColumn(text_col, F.when(text.isNotNull(), changed))
