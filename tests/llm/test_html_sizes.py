"""Pages of extreme size and shape: bounded time and memory, defined blocks."""

import random
import time

import numpy as np

from skeinwork.llm import html_blocks


def _texts(html):
    return [b[1] for b in html_blocks.blocks_of(html)]


def test_deep_and_torn_pages_take_linear_time():
    began = time.time()
    assert len(_texts("<div>x" * 20_000)) == 20_000
    assert _texts("<p>y</p>" + "<a " * 50_000) == ["y"] and _texts("<a " * 50_000 + ">z") == ["z"]
    assert _texts('<a b="><a" ' * 50_000) == [] and len(_texts("<div>" * 20_000 + "<li>x</li>" * 20_000)) == 20_000
    assert _texts("<div>" * 20_000 + "</span>x" * 1000) == ["x" * 1000]
    assert len(_texts("<span>" * 20_000 + "<p>x" * 20_000)) == 20_000
    assert time.time() - began < 60


def test_odd_markup():
    assert _texts("x < y <p title='a>b'>z</p>") == ["x < y", "z"] and _texts("<!-- c --><!--> b<?php x ?>c") == ["bc"]
    assert _texts('<a b="x>t</a> y') == ["t y"] and _texts("<div/>x<br/>y<script>a<b</script>c") == ["x yc"]
    assert _texts("<P>A &lt;b&gt; <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> c</P>") == ["A <b> x=2 c"]
    assert [b[1:] for b in html_blocks.blocks_of("<a href=/x/>t</a> y")] == [("t y", 1)] and [b[2] for b in html_blocks.blocks_of("<a name='q'/>t")] == [0]
    assert _texts("<noscript>turn it on</noscript><video>no video</video>") == ["turn it on", "no video"]


def test_a_long_page_is_labelled_by_runs_as_it_is_whole():
    rng = random.Random(3)
    params = html_blocks._start(np.random.default_rng(1))
    blocks = [b for _ in range(12) for b in html_blocks.blocks_of(html_blocks.training_page(rng)[0])]
    x = html_blocks.vectors_of(blocks)[None]
    middle = np.median(html_blocks.scores(params, x, np.ones(x.shape[:2], np.float32)))
    params["c"] -= np.log(middle / (1 - middle)).astype(np.float32)  # half of the blocks on either side
    whole = html_blocks.label(params, [blocks, blocks[:5]])
    runs = html_blocks.label(params, [blocks, blocks[:5]], long_page=7)
    assert (whole[0] == runs[0]).mean() > 0.999 and (whole[1] == runs[1]).all() and 0 < whole[0].sum() < len(blocks)


def test_many_blocks():
    params = html_blocks._start(np.random.default_rng(1))
    blocks = html_blocks.blocks_of("<p>a b</p>" * 200_000)
    assert len(blocks) == 200_000 and len(html_blocks.label(params, [blocks])[0]) == 200_000
