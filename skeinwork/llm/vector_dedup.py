"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample so that the signs of the rotated vectors lose as little as possible and are balanced; the signs are a vector's code.
The code is cut into chunks, one table a chunk; vectors with an equal chunk meet in that table, those whose whole codes are within a Hamming radius are candidates,
and candidates are reranked by the cosine of the original vectors. How many chunks are needed is measured while fitting, on neighbours planted at the threshold
around the sample. Pairs never become rows: a task gives each of its vectors the number of links found and one vector of the group it belongs to there.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import components, materialize

#: Rows of a bucket up to which its pairs are listed one by one; pairs that are looked at together.
_FEW, _PAIRS = 48, 200_000


class Codes(NamedTuple):
    """A fitted code: sign bits of (x - center) @ planes, the number of bits a chunk, and the greatest Hamming distance of candidates."""

    center: np.ndarray
    planes: np.ndarray
    chunk_bits: int
    radius: int

    def chunks(self, x: np.ndarray) -> np.ndarray:
        """The chunks of each row of x as numbers, one column a table."""
        bits = ((x - self.center) @ self.planes > 0).reshape(len(x), -1, self.chunk_bits)
        return bits @ (1 << np.arange(self.chunk_bits, dtype=np.int64))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, in doubles; no row may be zero."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(reduced: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """The rotation of the rows that iterative quantisation settles at from a random one: signs and rotation are fitted to each other in turn."""
    turn = np.linalg.qr(rng.standard_normal((reduced.shape[1],) * 2))[0]
    for _ in range(rounds):
        signs = np.where(reduced @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(reduced.T @ signs)
        turn = left @ right
    return turn


def _planted(x: np.ndarray, cosine: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x, and for each a neighbour at the cosine: half of them moved in any direction, half towards another row."""
    x = x[rng.integers(0, len(x), 4000)]
    away = rng.standard_normal(x.shape)
    away[::2] = x[rng.permutation(len(x))][::2]
    away -= (away * x).sum(axis=1, keepdims=True) * x
    size = np.sqrt((away * away).sum(axis=1, keepdims=True))
    return x, cosine * x + np.sqrt(1 - cosine * cosine) * np.divide(away, size, out=np.zeros_like(away), where=size > 1e-9)


def fit(sample: np.ndarray, n_rows: int, min_cosine: float, recall: float, seed: int = 20_240_607) -> Codes:
    """Codes for n_rows vectors like those of the sample (rows of length 1): chunks as long as leaves about one unlike vector a bucket, and as many as find the recall of planted neighbours."""
    rng = np.random.default_rng(seed)
    center = np.median(sample, axis=0)
    reduced = sample - center
    _, axes = np.linalg.eigh(reduced.T @ reduced)
    axes = axes[:, ::-1][:, :128]
    chunk_bits = min(62, max(8, int(n_rows).bit_length()))
    x, y = _planted(sample, min_cosine, rng)
    planes, same = np.zeros((sample.shape[1], 0)), np.zeros((len(x), 0), bool)
    while True:
        more = axes @ rotation(reduced @ axes, rng)
        planes = np.hstack([planes, more])
        same = np.hstack([same, ((x - center) @ more > 0) == ((y - center) @ more > 0)])
        tables = same.shape[1] // chunk_bits
        met = same[:, : tables * chunk_bits].reshape(len(x), tables, chunk_bits).all(axis=2)
        found = np.logical_or.accumulate(met, axis=1).mean(axis=0)
        if tables and found[-1] >= recall:
            used = (int(np.argmax(found >= recall)) + 1) * chunk_bits
            far = (~same[:, :used]).sum(axis=1).max()
            return Codes(center, planes[:, :used], chunk_bits, min(used, int(1.25 * far) + 2))


def _matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return held.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(held), -1)


def encoded(nodes: DataFrame, codes: Codes) -> DataFrame:
    """nodes (digest, v) with code array<long>, one chunk a table."""

    def of(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                code = codes.chunks(unit(_matrix(part.column(1), np.float64)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(code), pa.list_(pa.int64()))], names=["digest", "v", "code"])

    kind = nodes.schema["v"].dataType.simpleString()
    return nodes.select("digest", "v").mapInArrow(of, f"digest binary, v {kind}, code array<long>")


class _Cell:
    """The vectors of some buckets, or of two blocks of one large bucket: finds links and keeps what they come to."""

    def __init__(self, rows: pa.Table, codes: Codes, min_cosine: float):
        self.min_cosine, self.radius = min_cosine, codes.radius
        self.x, self.code = unit(_matrix(rows.column("v"), np.float64)), _matrix(rows.column("code"), np.int64)
        self.table = rows.column("t").to_numpy()
        self.weight = rows.column("weight").to_numpy()
        # several chunks side by side in one word, for counting unlike bits
        beside = max(1, 64 // codes.chunk_bits)
        wide = [self.code[:, k : k + beside].astype(np.uint64) for k in range(0, self.code.shape[1], beside)]
        self.words = np.stack([np.bitwise_or.reduce([c[:, j] << np.uint64(j * codes.chunk_bits) for j in range(c.shape[1])]) for c in wide], axis=1)
        self.count = np.zeros(len(self.x), np.int64)
        self.label = np.arange(len(self.x))

    def _linked(self, a: np.ndarray, b: np.ndarray) -> None:
        """Takes in the pairs whose cosine is known to be enough, those that have met in an earlier table left out."""
        first = np.argmax(self.code[a] == self.code[b], axis=1) == self.table[a]
        a, b = a[first], b[first]
        self.count += np.bincount(a, self.weight[b], len(self.count)).astype(np.int64) + np.bincount(b, self.weight[a], len(self.count)).astype(np.int64)
        while len(a):
            low = np.minimum(self.label[a], self.label[b])
            for side in (self.label[a], self.label[b]):
                np.minimum.at(self.label, side, low)
            while (nxt := self.label[self.label]).tolist() != self.label.tolist():
                self.label = nxt
            apart = self.label[a] != self.label[b]
            a, b = a[apart], b[apart]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Looks at listed pairs."""
        for k in range(0, len(a), _PAIRS):
            p, q = a[k : k + _PAIRS], b[k : k + _PAIRS]
            near = np.bitwise_count(self.words[p] ^ self.words[q]).sum(axis=1, dtype=np.int64) <= self.radius
            p, q = p[near], q[near]
            enough = np.einsum("ij,ij->i", self.x[p], self.x[q]) >= self.min_cosine
            self._linked(p[enough], q[enough])

    def blocks(self, a: np.ndarray, b: np.ndarray, same: bool, tile: int = 512) -> None:
        """Looks at every pair of a row of a and a row of b; if both are the same rows, at each pair once."""
        for i in range(0, len(a), tile):
            for j in range(i if same else 0, len(b), tile):
                p, q = a[i : i + tile], b[j : j + tile]
                far = np.zeros((len(p), len(q)), np.uint16)
                for word in self.words.T:
                    far += np.bitwise_count(word[p][:, None] ^ word[q][None, :])
                fits = far <= self.radius
                if fits.any():
                    fits &= self.x[p] @ self.x[q].T >= self.min_cosine
                    if same and i == j:
                        fits = np.triu(fits, 1)
                    r, c = np.nonzero(fits)
                    self._linked(p[r], q[c])

    def buckets(self, key: np.ndarray) -> None:
        """Looks at the pairs of rows with an equal key."""
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        sizes = np.diff(np.r_[starts, len(order)])
        for start, size in zip(starts[sizes > _FEW], sizes[sizes > _FEW]):
            rows = order[start : start + size]
            self.blocks(rows, rows, True)
        few = np.repeat(sizes <= _FEW, sizes)
        end = np.repeat(starts + sizes, sizes)
        for apart in range(1, int(sizes[sizes <= _FEW].max(initial=0))):
            at = np.flatnonzero(few & (np.arange(len(order)) + apart < end))
            self.pairs(order[at], order[at + apart])


def _cells(nodes: DataFrame, block_rows: int) -> DataFrame:
    """(t, chunk, weight, digest, v, code, and the cell: cell_t, cell_chunk, i, j, block): vectors by buckets that more than one of them is in.

    Small buckets share cells of about block_rows rows. A bucket of more rows is cut in blocks, each of which meets every other in a cell of two.
    """
    held = nodes.select("digest", F.posexplode("code").alias("t", "chunk"))
    often = held.groupBy("t", "chunk").agg(F.count("*").alias("c")).filter("c > 1")
    often = materialize(often)
    total = often.agg(F.sum("c")).first()[0] or 0
    rows = materialize(held.join(often, ["t", "chunk"])).join(nodes, "digest")
    n_blocks = F.ceil(F.col("c") / block_rows).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("digest"), n_blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    small = F.col("c") <= block_rows
    shard = F.pmod(F.xxhash64("t", "chunk"), F.lit(max(1, -(-total // block_rows))))
    return rows.select(
        "t", "chunk", "weight", "digest", "v", "code", "block",
        F.when(small, -1).otherwise(F.col("t")).alias("cell_t"), F.when(small, shard).otherwise(F.col("chunk")).alias("cell_chunk"),
        F.when(small, -1).otherwise(F.least("block", "other")).alias("i"), F.when(small, -1).otherwise(F.greatest("block", "other")).alias("j"),
    )


def links_by_cell(nodes: DataFrame, codes: Codes, min_cosine: float, block_rows: int) -> DataFrame:
    """(digest, n, root): for each vector and cell where it has links not found in an earlier table, their number by weight, and a vector of its group there."""

    def of(rows: pa.Table) -> pa.Table:
        cell = _Cell(rows, codes, min_cosine)
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        block = rows.column("block").to_numpy()
        if i < 0:
            both = np.stack([cell.table, rows.column("chunk").to_numpy()], axis=1)
            cell.buckets(np.unique(both, axis=0, return_inverse=True)[1].ravel())
        elif i == j:
            cell.blocks(np.arange(len(block)), np.arange(len(block)), True)
        else:
            cell.blocks(np.flatnonzero(block == i), np.flatnonzero(block == j), False)
        at = np.flatnonzero(cell.count)
        digest = rows.column("digest")
        return pa.table({"digest": digest.take(pa.array(at)), "n": pa.array(cell.count[at]), "root": digest.take(pa.array(cell.label[at]))})

    return _cells(nodes, block_rows).groupBy("cell_t", "cell_chunk", "i", "j").applyInArrow(of, "digest binary, n long, root binary")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    min_cosine: float = 0.95,
    recall: float = 0.995,
    sample_rows: int = 10_000,
    block_rows: int = 2048,
) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per row of vectors.

    Rows whose vectors have a cosine of min_cosine or more are linked if a table brings them together; no others are. n_links counts the other rows linked
    directly, component_id is the smallest id that links reach, kept is id = component_id. Vectors that are null, empty, zero or hold null or
    non-finite components have no links and are their own component. Rows with a null id take no part and have 0 links, a null component and kept false.
    Rows that repeat an id and vector count as one and come out alike; different vectors under one id are each linked on their own. Other columns are ignored; an
    empty table gives no rows. Sound vectors must be of one length.

    The rotations are fitted on the driver to sample_rows vectors at most, chosen by hash; every vector is indexed. recall is the share of planted neighbours at
    min_cosine that the tables must find; nearer ones are found more often. Equal vectors are one node with a weight. A bucket of more than block_rows vectors is worked on
    in pairs of blocks, each a task's share, so the number of links is exact however large a bucket is; that work grows with the square of a group of unlike near copies.
    """
    spark = vectors.sparkSession
    single = isinstance(vectors.schema[vector_col].dataType, ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    sound = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    same = F.transform("v", lambda x: x + F.lit(0.0).cast("float" if single else "double"))  # one zero
    half = lambda k: F.lpad(F.hex(F.xxhash64(F.lit(k), same)), 16, "0")
    rows = materialize(rows.withColumn("digest", F.when(sound, F.unhex(F.concat(half(1), half(2))))))

    named = rows.filter("digest is not null")
    nodes = materialize(named.groupBy("digest").agg(F.count_distinct("id").alias("weight"), F.min("id").alias("low"), F.any_value("v").alias("v")))
    shape = nodes.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("short"), F.max(F.size("v")).alias("long")).first()
    if shape["short"] != shape["long"]:
        raise ValueError("vectors differ in length")
    if shape["n"]:
        sample = nodes.select("digest", "v").orderBy("digest").limit(sample_rows).toArrow()
        codes = fit(unit(_matrix(sample.column("v"), np.float64)), shape["n"], min_cosine, recall)
        coded = materialize(encoded(nodes, codes).join(nodes.select("digest", "weight"), "digest"))
        found = materialize(links_by_cell(coded, codes, min_cosine, block_rows))
        linked = components(found.select(F.col("digest").alias("src"), F.col("root").alias("dst")))
        counts = found.groupBy("digest").agg(F.sum("n").alias("n"))
        classes = nodes.select("digest", "weight", "low").join(counts, "digest", "left").join(linked.withColumnRenamed("node", "digest"), "digest", "left")
        classes = materialize(classes.withColumn("component", F.coalesce("component", "digest")))
        lows = classes.groupBy("component").agg(F.min("low").alias("component_id"))
        classes = classes.join(lows, "component").select("digest", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    else:
        classes = spark.createDataFrame([], "digest binary, n_links long, component_id long")
    out = rows.select("id", "digest").join(classes, "digest", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


#: DuckDB SQL for near_duplicates() with its own parameters where every link is found: all pairs, and what they reach.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS src, vec_id AS dst FROM embeddings UNION SELECT r.src, l.dst FROM r JOIN l ON r.dst = l.src),
c AS (SELECT src, min(dst) AS component_id FROM r GROUP BY 1),
n AS (SELECT src, count(*) AS n_links FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c ON e.vec_id = c.src LEFT JOIN n ON e.vec_id = n.src
"""
