"""Articles in layouts that no training page was written after: names that say nothing, no names, tables, code, another language, a blog."""

import random

import numpy as np
import pytest

from skeinwork.llm import html_blocks

P1="The council approved the new bridge on Tuesday after a long debate about costs and the risk of floods."
P2="Work will begin in the spring, and the first cars are expected to cross before the end of next year."
P3="Residents who live near the river have asked for a wider path, because children walk there to school."
LAYOUTS = {
    # name: (page, the blocks of its article)
    "generated": (f"""<html><body><div class="css-1x8k9q"><div class="css-77ab"><a href="/">Home</a><a href="/news">News</a><a href="/contact">Contact</a></div><div class="css-q1"><div class="css-zz81"><h1>New bridge for the town</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div></div><div class="css-aa9"><p>© 2024 Town Paper. All rights reserved.</p><a href="/privacy">Privacy policy</a></div></div></body></html>""", ["New bridge for the town",P1,P2,P3]),
    "table": (f"""<html><body><table width="100%"><tr><td><a href="a">Home</a><br><a href="b">Archive</a><br><a href="c">Contact</a></td><td><h1>New bridge for the town</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></td><td><b>Links</b><ul><li><a href="x">Popular posts</a></li><li><a href="y">Recent</a></li></ul></td></tr><tr><td colspan="3">Copyright 2003 by the town. All rights reserved.</td></tr></table></body></html>""", ["New bridge for the town",P1,P2,P3]),
    "classless": (f"""<html><body><div><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li><li><a href="/c">About</a></li></ul></div><div><h1>New bridge for the town</h1><p>{P1}</p><p>{P2}</p><h2>The path</h2><p>{P3}</p></div><div><p>© Town Paper</p></div></body></html>""", ["New bridge for the town",P1,P2,"The path",P3]),
    "code": (f"""<html><body><nav><a href="/">Docs</a><a href="/b">Blog</a></nav><article><h1>How to read a file</h1><p>{P1}</p><pre><code>with open(path) as f: print(f.read())</code></pre><figure><img src="x.png"><figcaption>The file as the editor shows it.</figcaption></figure><p>{P2}</p></article><footer>© 2024 Docs</footer></body></html>""", ["How to read a file",P1,"with open(path) as f: print(f.read())","The file as the editor shows it.",P2]),
    "german": (f"""<html><body><header><a href="/">Startseite</a></header><div id="inhalt"><h1>Neue Brücke für die Stadt</h1><p>Der Rat hat am Dienstag nach langer Debatte eine neue Brücke beschlossen, die auch für Radfahrer gebaut wird.</p><p>Die Arbeiten beginnen im Frühjahr und werden nach dem Plan noch vor dem Ende des Jahres beendet.</p></div><div class="kommentare"><h3>Kommentare</h3><p>Danke, sehr gut!</p></div><footer><a href="/i">Impressum</a> <a href="/d">Datenschutz</a></footer></body></html>""", ["Neue Brücke für die Stadt","Der Rat hat am Dienstag nach langer Debatte eine neue Brücke beschlossen, die auch für Radfahrer gebaut wird.","Die Arbeiten beginnen im Frühjahr und werden nach dem Plan noch vor dem Ende des Jahres beendet."]),
    "blog": (f"""<html><body><div id="masthead"><a href="/">My blog</a></div><div class="cookie-bar">We use cookies. <a href="#">Accept</a></div><div class="hentry"><h2>New bridge for the town</h2><p>{P1}</p><blockquote>{P3}</blockquote><ul><li>It will have two lanes for cars.</li><li>It will have a path for walkers.</li></ul><p>{P2}</p></div><div class="sharedaddy"><a href="t">Share on T</a></div><div id="comments"><h3>2 comments</h3><ol><li><b>Ann</b> says: Great news, thanks!</li><li><b>Bob</b> says: I agree.</li></ol></div><div class="widget"><h4>Recent posts</h4><a href="q">Older one</a></div></body></html>""", ["New bridge for the town",P1,P3,"It will have two lanes for cars.","It will have a path for walkers.",P2]),
}


@pytest.fixture(scope="module")
def model():
    return html_blocks.trained()


def _held_out(model):
    right = n = 0
    for k in range(150):
        blocks = html_blocks.blocks_of(html_blocks.training_page(random.Random(10**9 + k))[0])
        truth = np.array([html_blocks.MARK in b[1] for b in blocks])
        if blocks:
            plain = [(p, t.replace(html_blocks.MARK, ""), c) for p, t, c in blocks]
            right, n = right + (html_blocks.label(model, [plain])[0] == truth).sum(), n + len(blocks)
    return right / n


def test_articles_are_found(model):
    scores = {}
    for name, (html, want) in LAYOUTS.items():
        blocks = html_blocks.blocks_of(html)
        got = [b[1] for b, yes in zip(blocks, html_blocks.label(model, [blocks])[0]) if yes]
        scores[name] = 2 * sum(x in want for x in got) / (len(got) + len(want))
    assert min(scores.values()) >= 0.75 and sum(scores.values()) / len(scores) >= 0.9, scores


def test_words_and_tags_both_count(model):
    """Without its word weights, or without those of paths, the labeller is measurably worse."""
    whole = _held_out(model)
    assert whole >= 0.975
    for part in (slice(html_blocks.PATH_DIMS, html_blocks.PATH_DIMS + html_blocks.WORD_DIMS), slice(0, html_blocks.PATH_DIMS)):
        less = {k: v.copy() for k, v in model.items()}
        for k in ("xf", "xb", "s"):
            less[k][part] = 0
        assert _held_out(less) < whole - 0.01
