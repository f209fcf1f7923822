"""Top-k search on scores of extreme size, ties of every candidate, and many blocks."""

import random

from skeinwork.llm import topk


def test_huge_components_and_ties(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, -1.0]), (2, [-1e300, 0.0]), (3, [0.5, 0.5])]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i >= 0, k=2).collect()}
    assert got[0, 1] == (1, (1 << 63) - 1) and [got[2, j] for j in (1, 2)] == [(0, -(1 << 63)), (1, -(1 << 63))]
    rows = [(k, [float(k), 0.0]) for k in range(200)] + [(1000, [0.0, 7.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 1000, k=3, block_rows=16).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 0, 0), (2, 1, 0), (3, 2, 0)]
    big = [(k, [1e7 + k, 3.0]) for k in range(50)]  # sums beyond 2**53
    got = topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), lambda i: i == 0, k=2).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(j + 1, v, int(256e7) * (256 * (10**7 + v)) + 768 * 768) for j, v in enumerate((49, 48))]


def test_blocks_and_copies(spark):
    rng = random.Random(5)
    base = [[rng.choice((-1.0, 0.0, 0.5)) for _ in range(6)] for _ in range(40)]
    rows = [(k, rng.choice(base)) for k in range(400)]
    ints = {k: [int((256 * x) // 1) for x in v] for k, v in rows}
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 40 == 0, k=6, block_rows=8).collect()
    for q in range(0, 400, 40):
        want = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)[:6]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(j + 1, c, -s) for j, (s, c) in enumerate(want)]
