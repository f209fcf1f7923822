"""Near-duplicate vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import vector_dedup


def _brute(x, cosine):
    """(number of links, smallest reachable place) of each row of x."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= cosine
    n, low = link.sum(axis=1) - 1, np.arange(len(x))
    while True:
        nxt = np.array([low[row].min() for row in link])
        if (nxt == low).all():
            return n, low
        low = nxt


def _near(rng, x, cosine):
    """A neighbour of each row of x at the cosine."""
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(1, keepdims=True) / (x * x).sum(1, keepdims=True) * x
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return cosine * u + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1, keepdims=True)


def _frame(spark, x, kind="double"):
    rows = [(k, v) for k, v in enumerate(np.asarray(x).tolist())]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("digest", F.lit("own"))


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1200, 64)) + 0.4  # vectors that share a direction
    x = np.vstack([x, _near(rng, x, 0.9503), _near(rng, x[:300], 0.9497)])
    n, _ = _brute(x, 0.95)
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(_frame(spark, x)).collect()}
    got = np.array([got[k] for k in range(len(x))])
    assert (got <= n).all() and n.sum() >= 2400 and got.sum() >= 0.97 * n.sum()


@pytest.mark.parametrize("block_rows", [2048, 40])
def test_large_groups(spark, block_rows):
    """A group of unlike near copies of a third of all rows, a chain and a block of exact copies; in cells of one block and of many."""
    rng = np.random.default_rng(7)
    seed, angle = rng.standard_normal((1, 32)), np.deg2rad(15) * np.arange(12)
    group = np.vstack([_near(rng, seed, c) for c in rng.uniform(0.97, 0.999, 200)])
    chain = np.zeros((12, 32))
    chain[:, 0], chain[:, 1] = np.cos(angle), np.sin(angle)
    x = np.vstack([rng.standard_normal((250, 32)), group, chain, np.repeat(rng.standard_normal((1, 32)), 150, axis=0)])
    x = x[rng.permutation(len(x))]
    n, low = _brute(x, 0.95)
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(_frame(spark, x), block_rows=block_rows, recall=0.9999).collect()}
    assert [got[k].n_links for k in range(len(x))] == n.tolist()
    assert [got[k].component_id for k in range(len(x))] == low.tolist() and all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_rows(spark):
    a, b = [1.0, 2.0, 3.0], [3.0, -1.0, 0.0]
    rows = [(1, a), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 2.0]), (6, [1.0, float("nan"), 2.0]), (7, [1.0, float("inf"), 2.0]), (8, [2e200, 4e200, 6e200]), (9, b), (9, b), (None, a), (10, [-0.0, 1e-300, 0.0]), (11, [0.0, 1e-300, -0.0]), (12, a), (12, b)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, code string")
    out = vector_dedup.near_duplicates(df)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert len(got) == len(rows) and out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert [got.count(x) for x in ((1, 2, 1, True), (8, 2, 1, False), (10, 1, 10, True), (11, 1, 10, False), (9, 1, 9, True), (12, 2, 1, False), (12, 1, 9, False), (None, 0, None, False))] == [1, 1, 1, 1, 2, 1, 1, 1]
    assert all((k, 0, k, True) in got for k in range(2, 8))
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0 and vector_dedup.near_duplicates(df.filter("vec_id = 2")).count() == 1
    with pytest.raises(ValueError):
        vector_dedup.near_duplicates(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_rotation_is_learned():
    """The learned rotation loses less than a random one, stays a rotation and balances the bits."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 16)) @ np.diag(np.linspace(0.2, 2, 16))
    loss = lambda turn: ((np.where(x @ turn > 0, 1, -1) - x @ turn) ** 2).sum()
    learned, random = vector_dedup.rotation(x, rng), np.linalg.qr(rng.standard_normal((16, 16)))[0]
    assert np.allclose(learned @ learned.T, np.eye(16)) and loss(learned) < loss(random)
    assert (abs((x @ learned > 0).mean(axis=0) - 0.5) < 0.05).all()
