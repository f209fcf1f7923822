"""Exact top-k inner-product search by a three-phase uniform threshold.

Vectors are cut into ``shards`` runs of dimensions; each shard is a source of partial scores. Blocks of queries meet blocks of
candidates, and all that needs a vector happens where the block has it, so only ids and scores leave it. Phase 1: each shard lists
its best partial scores of every query; the listed candidates are resolved, and the kth best of them over all blocks is a score that
the kth result reaches at least. Phase 2: that cutoff, divided evenly among the shards, goes to all of them, and each gives every entry that
reaches its share: a candidate below it everywhere cannot reach the cutoff. Phase 3: the entries given are resolved exactly, and those
under the cutoff are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_SCORED = "query_id long, vec_id long, score long"
#: Queries of a block that are worked on at once.
_TILE = 256


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of every component as double; null ids and vectors that are null, empty or hold null or non-finite components are left out."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def _distinct(vectors: DataFrame, copies: int) -> DataFrame:
    """(id, v, ids): each different vector once, with its copies' smallest ids, one more than can be wanted."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = vectors.select("id", "v").distinct().withColumn("rank", rank).filter(F.col("rank") <= copies)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0])


def _meet(queries: DataFrame, candidates: DataFrame, q_blocks: int, c_blocks: int, extra: list[str]):
    """Both sides grouped by (query block, candidate block): every block of queries meets every block of candidates."""
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = queries.select(block(q_blocks).alias("q_block"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("c_block"), "id", "v", *extra)
    c = candidates.select(F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"), block(c_blocks).alias("c_block"), "id", "v")
    return q.groupBy("q_block", "c_block").cogroup(c.groupBy("q_block", "c_block"))


def _columns(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
    """The ids, and the vectors as a matrix."""
    held = table.column("v").combine_chunks()
    return table.column("id").to_numpy(), held.flatten().to_numpy().reshape(len(held), -1).astype(kind)


def _best(score: np.ndarray, ids: np.ndarray, row: np.ndarray, take: int) -> np.ndarray:
    """Places of the take best scores of each row, ties to the smaller id; row says whose each score is."""
    order = np.lexsort((ids, -score, row))
    row = row[order]
    first = np.searchsorted(row, row)
    return order[np.arange(len(row)) - first < take]


def top_k(
    vectors: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    shards: int = 2,
    scale: int = 256,
    block_rows: int = 16_384,
) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k highest integer inner products with other rows, ties to the smaller id.

    is_query is a condition on id_col. Rows with a null id, or whose vector is null, empty or holds null or non-finite
    components, take no part; vectors must otherwise be of one length. Rows that repeat an id and vector count once. A query with fewer than k candidates
    gets them all. Components and scores beyond 64 bits become the nearest 64-bit number. Other columns are ignored; an empty table gives no rows.
    Each side is sent once for every block of the other, so larger blocks mean less to shuffle; small tables get smaller blocks, for more tasks.
    """
    spark = vectors.sparkSession
    whole = materialize(whole_vectors(vectors, id_col, vector_col, scale).distinct())
    most = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    shape = whole.agg(F.max(F.size("v")).alias("dims"), F.min(F.size("v")).alias("low"), most.alias("most")).first()
    dims, most = shape["dims"] or 1, shape["most"] or 0
    if shape["low"] is not None and shape["low"] != dims:
        raise ValueError("vectors differ in length")
    # float64 holds sums below 2**53 exactly, and its product is much the fastest one
    kind = np.float64 if most * most * dims < 1 << 53 else np.int64 if most * most * dims < 1 << 62 else object
    distinct = materialize(_distinct(whole, k + 1))
    asked = whole.filter(is_query(F.col("id"))) if callable(is_query) else whole.filter(is_query)
    n, m = distinct.count(), asked.count()
    tasks = 2 * spark.sparkContext.defaultParallelism
    q_blocks, c_blocks = max(1, -(-m // block_rows)), max(1, -(-n // block_rows), min(tasks, -(-n // 2048)))
    edges = np.linspace(0, dims, min(shards, dims) + 1).astype(int).tolist()
    cuts = list(zip(edges, edges[1:]))
    take = k + 1  # a query's own vector is among the candidates

    def tiles(q: pa.Table, c: pa.Table):
        """(query rows, their ids, candidates' ids, partial scores by shard) of some queries at a time."""
        if q.num_rows and c.num_rows:
            (q_ids, q_v), (c_ids, c_v) = _columns(q, kind), _columns(c, kind)
            for a in range(0, len(q_ids), _TILE):
                some = slice(a, a + _TILE)
                yield some, q_ids[some], c_ids, [q_v[some, x:y] @ c_v[:, x:y].T for x, y in cuts]

    def held(score: np.ndarray) -> np.ndarray:
        """Scores as numbers of 64 bits."""
        return np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in score], np.int64) if kind is object else score

    def table(parts: list[tuple]) -> pa.Table:
        whole = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*parts)) or [()] * 3)]
        return pa.table({name: pa.array(np.asarray(x, np.int64)) for name, x in zip(("query_id", "vec_id", "score"), whole)})

    def listed(q: pa.Table, c: pa.Table) -> pa.Table:
        """Phase 1: the shards' lists of each query, resolved, and the best of them."""
        parts = []
        for _, q_ids, c_ids, partial in tiles(q, c):
            n_listed = min(take, len(c_ids))
            at = np.concatenate([np.argpartition(-p, n_listed - 1, axis=1)[:, :n_listed] for p in partial], axis=1)
            at.sort(axis=1)
            fresh = np.ones(at.shape, bool)
            fresh[:, 1:] = at[:, 1:] != at[:, :-1]  # a candidate that two shards list counts once
            row, place = np.nonzero(fresh)
            col = at[row, place]
            score = held(sum(p[row, col] for p in partial))
            best = _best(score, c_ids[col], row, take)
            parts.append((q_ids[row[best]], c_ids[col[best]], score[best]))
        return table(parts)

    def resolved(q: pa.Table, c: pa.Table) -> pa.Table:
        """Phases 2 and 3: entries that reach a shard's share, and of those the exact scores that reach the cutoff."""
        parts, cutoffs = [], q.column("cutoff").to_numpy()
        for some, q_ids, c_ids, partial in tiles(q, c):
            cutoff = cutoffs[some].astype(kind)
            if kind is object:  # the least number stands for all below it
                cutoff = np.where(cutoff == -(1 << 63), -(1 << 200), cutoff)
            even = cutoff // len(partial)
            given = partial[0] >= (cutoff - even * (len(partial) - 1))[:, None]
            for p in partial[1:]:
                given |= p >= even[:, None]
            row, col = np.nonzero(given)
            score = held(sum(p[row, col] for p in partial))
            reach = score >= cutoff[row]
            row, col, score = row[reach], col[reach], score[reach]
            best = _best(score, c_ids[col], row, take)
            parts.append((q_ids[row[best]], c_ids[col[best]], score[best]))
        return table(parts)

    low = -(1 << 53) if kind is np.float64 else -(1 << 63)
    cutoff = _highest(_meet(asked, distinct, q_blocks, c_blocks, []).applyInArrow(listed, _SCORED), take).filter(F.col("rank") == take)
    safe = asked.join(cutoff.select(F.col("query_id").alias("id"), F.col("score").alias("cutoff")), "id", "left")
    safe = materialize(safe.withColumn("cutoff", F.coalesce("cutoff", F.lit(low))))

    # Copies of a vector come back here; only so many of their smallest ids as can be wanted.
    best = _highest(_meet(safe, distinct, q_blocks, c_blocks, ["cutoff"]).applyInArrow(resolved, _SCORED), take)
    copies = distinct.select(F.col("id").alias("vec_id"), "ids")
    each = best.join(copies, "vec_id").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    return _highest(each, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _highest(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
