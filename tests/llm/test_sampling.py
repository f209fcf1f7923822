"""Importance resampling and fill-in-middle against plain versions of the same."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skeinwork.llm import fim, resample
from skeinwork.llm.common import table

from .test_filters import _held


def _features(text, order):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return words, [" ".join(words[k : k + n]) for n in range(1, order + 1) for k in range(len(words) - n + 1)]


def _brute(docs, target, order, buckets, seed, percent, min_words):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    held = [(i, *_features(t, order)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in held for f in fs), Counter(bucket(f) for x in target for f in _features(x, order)[1])
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, words, fs in held:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= min_words])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling_sql(spark, small, duck):
    _held(resample.resample(table(spark, small, "documents"), table(spark, small, "benchmark")), duck, resample.ORACLE)


@pytest.mark.parametrize("order", [1, 3])
def test_resampling(spark, order, monkeypatch):
    rng, pool = random.Random(4), ["Tea", "tea", "é日", "x9", "a-b", "İ", "", "ſ", " ", "z" * 40]
    docs = [(k, rng.choice([" ", "\n", ", "]).join(rng.choice(pool) for _ in range(rng.randrange(60)))) for k in range(300)]
    docs += [(None, "tea " * 30), (300, None), (301, ""), (302, "...!"), (303, "tea x9 " * 400_000), (304, "tea x9 " * 12), (304, "tea x9 " * 12), (305, "q" * 1_200_000 + " tea" * 30)]
    target = ["tea x9 tea", None, "x9 é日 x9"]
    df = spark.createDataFrame([(i, t, "w") for i, t in docs], "doc_id long, text string, score string").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(df, bench, order=order, buckets=97, percent=25, min_words=5)
    want = _brute(docs, target, order, 97, 2024, 25, 5)
    assert sorted(map(tuple, got.collect()), key=str) == want
    monkeypatch.setattr(resample, "_NODES", 3)  # tries that are emptied all the time
    monkeypatch.setattr(resample, "_PIECE", 10)
    gain = [rng.randrange(-9, 9) for _ in range(97)]
    trie, brute = resample.Trie(97, gain), Counter()
    for _, text in docs[:300]:
        total = 0
        for words, whole in resample.pieces(text.encode(), order):
            total += trie.gain(words, order, whole)
            if trie.full():
                trie.clear()
        fs = [zlib.crc32(f.encode()) % 97 for f in _features(text, order)[1]]
        brute.update(fs)
        assert total == sum(gain[b] for b in fs)
    drawn = resample.sample(df, bench, order=order, buckets=97, percent=25, min_words=5)
    assert drawn.columns == df.columns and {r.doc_id for r in drawn.collect()} == {r[0] for r in want if r[4]} - {None}
    assert resample.resample(df.limit(0), bench).count() == 0 and resample.resample(df, bench.limit(0)).filter("rank is null").count() > 0


def test_resampling_favours_the_target(spark):
    """Documents in the words of the target come first."""
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice("abcdefgh" if k % 10 else "stuvwxyz") for _ in range(100))) for k in range(500)]
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("s t u v w x y z " * 20,)], "text string"))
    assert all(r.doc_id % 10 == 0 for r in got.filter("rank is not null").collect())


def test_fim_sql(spark, small, duck):
    _held(fim.digest(table(spark, small, "documents")), duck, fim.ORACLE)


def test_fim_odd_rows(spark):
    texts = [None, "", "one", "a<P>b", "tea\n\n日本 😀x", "x" * 300_000, ". " * 300_000, "né9"] + [f"some words of text {k}, é!" for k in range(120)]
    rows = [(k, t, "n") for k, t in enumerate(texts)] + [(None, "words here", "n"), (20, texts[20], "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    got = {r.doc_id: r for r in fim.digest(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for k, t in enumerate(texts):
        units = re.findall("[A-Za-z]+|[^A-Za-z]", t or "")
        h = [int(sha(f"1:{k}")[x : x + 8], 16) for x in (0, 8, 16, 24)]
        form = "plain" if not t or "<P>" in t or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        out = {"plain": t or "", "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        lengths = (None, None) if form == "plain" else (len(p), len(m))
        assert tuple(got[k])[1:] == (len(units), form, *lengths, sha(out), sha(t or ""))
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"} and got[None].restored_sha256 == sha("words here")
    made = fim.fill_in_middle(df)
    assert made.columns == [*df.columns, "fim_form", "fim_prefix_chars", "fim_middle_chars"] and made.count() == len(rows)
    assert all(sha(r.text or "") == got[r.doc_id].output_sha256 and r.form == "n" for r in made.collect()) and made.filter("doc_id = 0").first().text is None
    assert fim.digest(df.limit(0)).count() == 0
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert fim.digest(df.withColumn("doc_id", F.lit(2**60 + 1))).filter(F.col("doc_id") == 2**60 + 1).count() == len(rows)
