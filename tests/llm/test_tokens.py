"""Packing, encoding and token counts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from skeinwork.llm import bpe, packing, token_rollup, vocabulary
from skeinwork.llm.common import shared_dir, table

ODD = ["", "a", " ", "  \n\t ", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "日本語 😀😀", "a" * 3000, "ab" * 1500, "don't I'LL we've", "ſ K ½ ²", "\x00\x01", " " * 2000 + "x", "é́́"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary.DEFAULT_PATH)


def test_encoder_is_the_library(library, spark, small):
    e, rng = bpe.Encoder(), random.Random(3)
    texts = ODD + ["".join(rng.choice("abc é日😀\n'd1 <|>endoftx") for _ in range(rng.randrange(150))) for _ in range(200)]
    texts += [r.text or "" for r in table(spark, small, "documents").collect()]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert e.encode(t).tolist() == want and vocabulary.encode(t).tolist() == want
        assert e.decode(e.encode(t)) == library.decode(want, skip_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_all(texts)] == [e.encode(t).tolist() for t in texts]
    for p in (b"a", b"the", b"abcabcabc" * 30):
        assert e.merge([p] * 20)[3] == e.merge_one(p)


def test_round_trip(spark, library, small):
    docs = table(spark, small, "documents").select("doc_id", "text").union(spark.createDataFrame([(-k - 1, t) for k, t in enumerate([*ODD, None])], "doc_id long, text string"))
    got = {r.doc_id: r for r in bpe.round_trip(docs.withColumn("id", F.lit(1))).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    few = spark.createDataFrame([(1, "ab c"), (None, None), (1, "ab c")], "doc_id long, text string")
    assert [r.text for r in bpe.decode(bpe.encode(few)).orderBy(F.desc_nulls_last("doc_id")).collect()] == ["ab c", "ab c", ""]
    assert bpe.round_trip(few.limit(0)).count() == 0


def _check_packing(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for items in at.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_pack(spark, library, small):
    docs = table(spark, small, "documents").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "w " * 5000), (None, "abc"), (-2, "")], "doc_id long, text string"))
    rows = packing.pack(docs.withColumn("length", F.lit("x")), capacity=1024).collect()
    used = _check_packing(rows, 1024)
    mine = defaultdict(list)
    for r in rows:
        mine[r.doc_id].append(r)
    total = 0
    for r in docs.filter("doc_id is not null and doc_id <> -2").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        parts, start = sorted(mine[r.doc_id], key=lambda p: p.piece), 0
        for k, p in enumerate(parts):
            assert (p.piece, p.start) == (k, start) and p.ids_crc32 == zlib.crc32(ids[start : start + p.length].tobytes())
            assert p.length == 1024 or k == 0
            start += p.length
        assert start == len(ids)
    assert [r.length for r in mine[-2]] == [1, 1] and len(mine[None]) == 1
    assert used <= -(-(total + 4) // 1024) * 1.02 + 1
    assert packing.pack(docs.limit(0)).count() == 0


def _best(counts, capacity):
    """Fewest sequences, by search over the items."""
    items = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True)
    best = [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[k]:
                rest = list(rooms)
                rest.remove(r)
                go(k + 1, [*rest, r - items[k]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    rng = random.Random(1)
    for _ in range(60):
        counts = dict(Counter(rng.randint(2, 20) for _ in range(rng.randint(1, 9))))
        left = dict(counts)
        fixed = packing.reduce_by_dominance(left, 20)
        assert all(sum(items) <= 20 for items, _ in fixed)
        back = Counter(left)
        for items, times in fixed:
            for x in items:
                back[x] += times
        assert back == Counter(counts)
        assert sum(t for _, t in fixed) + (_best(left, 20) if left else 0) == _best(counts, 20)


def test_plan_places_every_item_once():
    rng = random.Random(2)
    for n in (1, 30, 3000):
        counts = Counter(rng.randint(1, 100) for _ in range(n))
        given, end = Counter(), {}
        for length, first, items, each, sequence, offset in packing.plan(dict(counts), 100):
            assert first == given[length]
            given[length] += items
            for k in range(items):
                end.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
        assert given == counts
        for parts in end.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 100


def test_rollup(spark, small):
    docs = table(spark, small, "documents")
    rollup = token_rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-test")
    assert rollup.totals().count() == 0 and rollup.ledger() is None
    counted = token_rollup.count_tokens(docs).withColumn("op", F.lit("insert"))
    assert rollup.commit(1, counted) and not rollup.commit(1, counted.limit(3))
    want = Counter()
    for r in docs.collect():
        want[r.source, r.lang, "byte_bpe_50k"] += len(vocabulary.encode(r.text))
    assert {(r.source, r.lang, r.version): r.n_tokens for r in rollup.totals().collect()} == dict(want)
    changes = [("revise", 0, "s", "en", "byte_bpe_50k", 7), ("delete", 1, None, None, "byte_bpe_50k", None), ("delete", -5, None, None, "byte_bpe_50k", None), ("insert", 10**6, None, "en", "v2", 3), ("insert", None, "n", "en", "v2", 4), ("insert", 10**6, None, "en", "v2", 2)]
    df = spark.createDataFrame(changes, "op string, doc_id long, source string, lang string, version string, n_tokens long")
    assert rollup.commit(2, df) and not rollup.commit(2, df)
    first = {r.doc_id: r for r in docs.filter("doc_id < 2").collect()}
    for k in (0, 1):
        want[first[k].source, first[k].lang, "byte_bpe_50k"] -= len(vocabulary.encode(first[k].text))
    want["s", "en", "byte_bpe_50k"] += 7
    want[None, "en", "v2"] += 3 + 2  # rows that repeat an id are as many documents
    want["n", "en", "v2"] += 4
    got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert {k: v[1] for k, v in got.items() if v[1]} == {k: v for k, v in want.items() if v}
    assert sum(v[0] for v in got.values()) == docs.count() - 1 + 3
    with pytest.raises(ValueError):
        rollup.commit(0, df)


def test_rollup_counts_every_row(spark):
    """Null ids and ids that repeat, with unlike sources: nothing is lost, and a later batch replaces all rows of an id."""
    kind = "op string, doc_id long, source string, lang string, version string, n_tokens long"
    rollup = token_rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-rows")
    rows = [("insert", None, "a", "en", "v", n) for n in (5, 5, 7)] + [("insert", None, "b", None, "v", 1), ("insert", 1, "a", "en", "v", 2), ("insert", 1, "b", "en", "v", 3), ("insert", 2, "a", "en", "v", 4), ("insert", 3, "a", "en", "v", None)]
    totals = lambda: sorted(((r.source, r.lang, r.n_docs, r.n_tokens) for r in rollup.totals().collect()), key=str)
    rollup.commit(1, spark.createDataFrame(rows, kind))
    assert totals() == [("a", "en", 6, 23), ("b", "en", 1, 3), ("b", None, 1, 1)]
    rollup.compact()
    rollup.commit(2, spark.createDataFrame([("revise", 1, "c", "en", "v", 9), ("delete", None, None, None, "v", None), ("delete", 2, "a", "en", "v", None), ("insert", 2, "a", "en", "v", 6)], kind))
    assert totals() == [("a", "en", 2, 6), ("c", "en", 1, 9)]
    rollup.compact()
    assert totals() == [("a", "en", 2, 6), ("c", "en", 1, 9)] and rollup.ledger().count() == 3


def test_broken_batch_leaves_no_trace(spark):
    rollup = token_rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-broken")
    row = spark.createDataFrame([("insert", 1, "a", "en", "v", 5)], "op string, doc_id long, source string, lang string, version string, n_tokens long")
    rollup.commit(1, row)
    row.withColumn("n_docs", F.lit(1).cast("long")).write.parquet(rollup._path("ledger", 2))  # a batch that never reached its commit
    assert rollup.ledger().count() == 1 and rollup.commit(2, row.withColumn("n_tokens", F.lit(9).cast("long")))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 1, 9)]


def test_very_long_texts(spark, library):
    """White-space runs beyond what the fast encoder takes, alone and between words."""
    words = " ".join(f"word{k}" for k in range(300_000))
    texts = [" " * 5_000_000, " " * 2_000_000 + "x", words + "\n" * 1_200_000 + words + "<|endoftext|>", "日" * 500_000, "!?" * 300_000]
    for t in texts:
        assert vocabulary.encode(t).tolist() == library.encode_batch_fast([t], add_special_tokens=False)[0].ids
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts[1:3])], "doc_id long, text string, lang string, source string")
    want = {k: len(vocabulary.encode(t)) for k, t in enumerate(texts[1:3])}
    rows = packing.pack(docs).collect()
    assert {k: sum(r.length for r in rows if r.doc_id == k) for k in want} == {k: n + 1 for k, n in want.items()}
    assert {r.doc_id: r.n_tokens for r in token_rollup.count_tokens(docs).collect()} == want


def test_rollup_query_against_counts(spark, small):
    from skeinwork.llm import queries

    want = defaultdict(lambda: [0, 0])
    for r in table(spark, small, "documents").collect():
        n = len(vocabulary.encode(r.text)) + 1
        if n >= 16:
            want[r.source, r.lang, "byte_bpe_50k"][0] += 1
            want[r.source, r.lang, "byte_bpe_50k"][1] += n
    got = {(r.source, r.lang, r.version): [r.n_docs, r.n_tokens] for r in queries.op10_token_rollup(spark, small).collect()}
    assert got == dict(want)


def test_compaction_changes_nothing(spark):
    kinds = "op string, doc_id long, source string, lang string, version string, n_tokens long"
    rollup = token_rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-compact")
    assert not rollup.compact()
    rollup.commit(1, spark.createDataFrame([("insert", k, "a", "en", "v", k) for k in range(10)], kinds))
    rollup.commit(2, spark.createDataFrame([("delete", 3, None, None, "v", None), ("revise", 4, "b", "en", "v", 7)], kinds))
    before = sorted(map(tuple, rollup.totals().collect()))
    assert rollup.compact() and not rollup.compact() and sorted(map(tuple, rollup.totals().collect())) == before == [("a", "en", "v", 8, 38), ("b", "en", "v", 1, 7)]
    assert not rollup.commit(2, spark.createDataFrame([("insert", 99, "a", "en", "v", 1)], kinds))
    rollup.commit(3, spark.createDataFrame([("insert", 3, "a", "en", "v", 5), ("delete", 4, None, None, "v", None)], kinds))
    assert sorted(map(tuple, rollup.totals().collect())) == [("a", "en", "v", 9, 43)] and rollup.ledger().count() == 9
