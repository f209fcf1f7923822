"""MinHash near-duplicate detection with an LSH forest.

Every distinct shingle set gets ``trees`` labels of ``depth`` minhash values. Each tree is one sorted order of the
sets. Sets that share at least ``min_depth`` leading values of a label form a region of that tree; a region with more than
``region_rows`` sets is cut again by the next value, as deep as the label goes. Candidates are, in every region a set passes
on the way down, the region's leader (the set whose full labels are shared most often) and the following ``neighbours`` sets of the
sorted order, which have the longest common prefix. Regions that hold more sets than neighbours reach, and whose sets are
not all connected by then, are joined exactly: two sets that are alike share one of their rarest shingles. Candidates are confirmed on whole
shingle sets, so a link is never wrong; only a pair that shares no region of any tree can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize, unused

SHINGLE_WORDS = 5
_MASK = (1 << 64) - 1


class _WordHashes(dict):
    """Word -> 64-bit hash; forgets everything when full, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def shingle_set(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text: none without words, one if words are fewer than width."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([_hashes[w] for w in words], np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        part = h[k : k + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & _MASK | 1)
        part ^= part >> np.uint64(29)
        out = (out ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20_240_607).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the minimum under each multiplicative hash."""
    low = np.full(len(multipliers), _MASK, np.uint64)
    for start in range(0, len(shingles), 4096):
        part = shingles[start : start + 4096]
        for k, m in enumerate(multipliers):
            low[k] = min(low[k], (part * m).min())
    return (low >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, id_col: str, text_col: str, trees: int, depth: int) -> DataFrame:
    """(id, n_shingles, digest, label): digest is equal for equal shingle sets, label holds all trees' values in turn."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = _multipliers(trees * depth)
        for batch in batches:
            ids, sizes, digests, labels = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(text.as_py())
                ids.append(i)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                labels.append(minhashes(s, mult).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(labels, pa.list_(pa.int32()))],
                names=["id", "n_shingles", "digest", "label"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(of, "id long, n_shingles long, digest binary, label array<int>")


def _sets(docs: DataFrame) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py()).view(np.int64) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return docs.mapInArrow(of, "id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union. The rows carry a's set to b, whose set is sent once."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    fits = F.size("sa") * 100 >= F.size("sb") * percent
    fits &= F.size("sb") * 100 >= F.size("sa") * percent
    fits &= both * 100 >= (F.size("sa") + F.size("sb") - both) * percent
    return pairs.join(left, "a").join(right, "b").filter(fits).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of unlike component that can have 100 * intersection >= percent * union, by a prefix filter with places.

    sets (id, component, shingles). Shingles are ordered by how many sets hold them, rarest first. Of a pair, the first common
    shingle lies so early in both sets that the rest still holds the intersection asked for. Of each shingle's sets, those of the largest component do not meet each other.
    """
    n = F.size("shingles").cast("long").alias("n")
    held = sets.select("id", "component", n, F.explode("shingles").alias("s"))
    often = held.groupBy("s").agg(F.count("*").alias("c")).filter("c > 1")
    # shingles of one set alone come first in the order and need no rows
    ranked = held.join(often, "s").groupBy("id", "component", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("common"))
    ranked = ranked.select("id", "component", "n", (F.col("n") - F.size("common")).alias("alone"), F.posexplode("common").alias("k", "x"))
    rows = ranked.select("id", "component", "n", (F.col("alone") + F.col("k")).alias("place"), F.col("x.s").alias("s"))
    rows = materialize(rows.filter((F.col("n") - F.col("place")) * 100 >= F.col("n") * percent))
    most = rows.groupBy("s", "component").agg(F.count("*").alias("c")).groupBy("s").agg(F.max_by("component", F.struct("c", "component")).alias("most"), F.count("*").alias("unlike"))
    rows = materialize(rows.join(most.filter("unlike > 1").drop("unlike"), "s").withColumn("main", F.col("component") == F.col("most")).drop("most"))
    small = rows.filter((F.col("n") - F.col("place")) * (100 + percent) >= F.col("n") * 2 * percent)

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        fits = (F.col("x.s") == F.col("y.s")) & (F.col("x.component") != F.col("y.component"))
        fits &= F.struct("x.n", "x.id") < F.struct("y.n", "y.id")
        fits &= F.col("x.n") * 100 >= F.col("y.n") * percent
        left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
        fits &= left * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
        return x.join(y, fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    return meet(small.filter("not main"), rows).union(meet(small.filter("main"), rows.filter("not main"))).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    trees: int = 16,
    depth: int = 6,
    min_depth: int = 4,
    region_rows: int = 8,
    block_rows: int = 256,
    neighbours: int = 6,
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), one row per row of docs.

    Rows whose shingle sets have 100 * intersection >= percent * union are linked; component_id is the smallest id that
    links reach, kept is id = component_id. Null and empty texts have no shingles and stay alone, each its own component.
    A null id keeps its row, with null component and kept false, and takes no part in links. Rows that repeat an id and a text give as many equal rows; different texts
    under one id share that id's links. Other columns are ignored; an empty table gives no rows. percent under 80 needs more trees for the same recall.
    """
    spark = docs.sparkSession
    sig = materialize(signatures(docs, id_col, text_col, trees, depth))

    # Equal sets are one node, named by their smallest id; copies never meet as pairs.
    nodes = sig.filter("n_shingles > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.any_value("label").alias("label"))

    def prefix(t: int, d: int):
        return F.xxhash64(F.lit(t), *[F.col("label")[t * depth + k] for k in range(d)])

    steps = range(min_depth, depth + 1)
    forest = nodes.select("id", F.explode(F.array(*[F.struct(*[prefix(t, d).alias(f"p{d}") for d in steps]) for t in range(trees)])).alias("x")).select("id", "x.*")
    forest = materialize(forest)
    top = f"p{min_depth}"
    shared = forest.groupBy(top).agg(F.count("*").alias("c")).filter("c > 1")
    live = materialize(forest.join(shared.withColumnRenamed("c", f"c{min_depth}"), top))
    for d in list(steps)[1:]:
        sizes = live.groupBy(f"p{d}").agg(F.count("*").alias(f"c{d}"))
        live = live.join(sizes, f"p{d}")
    live = materialize(live)

    last = f"c{depth}"
    support = live.groupBy("id").agg(F.sum(last).alias("support"))
    passed = [F.when(F.lit(True) if d == min_depth else F.col(f"c{d - 1}") > region_rows, F.col(f"p{d}")) for d in steps]
    walk = live.select("id", F.explode(F.array_compact(F.array(*passed))).alias("region")).join(support, "id")
    heads = walk.groupBy("region").agg(F.max(F.struct("support", (-F.col("id")).alias("low"))).alias("head"), F.count("*").alias("n"))
    heads = heads.filter("n > 1").select("region", F.col("head.support").alias("weight"), (-F.col("head.low")).alias("b"))
    led = materialize(walk.select(F.col("id").alias("a"), "region").join(heads, "region").filter("a <> b").groupBy("a", "b").agg(F.max("weight").alias("weight")))

    # The sorted order of a large deepest region is cut in blocks, which the leaders tie together.
    deepest, size = F.col(f"p{depth}"), F.col(last)
    for d in reversed(list(steps)[:-1]):
        small = F.col(f"c{d}") <= block_rows
        deepest, size = F.when(small, F.col(f"p{d}")).otherwise(deepest), F.when(small, F.col(f"c{d}")).otherwise(size)
    placed = live.select("id", *[f"p{d}" for d in steps], deepest.alias("region"), F.pmod(F.xxhash64("id"), F.ceil(size / block_rows)).alias("block"))
    order = Window.partitionBy("region", "block").orderBy(*[f"p{d}" for d in steps], "id")
    beside = placed.select("id", F.collect_list("id").over(order.rowsBetween(1, neighbours)).alias("after"))
    beside = beside.select("id", F.explode("after").alias("b")).select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()

    wanted = led.select(F.col("a").alias("id")).union(led.select("b")).union(beside.select("a")).union(beside.select("b")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    names = nodes.select("id", "digest").withColumnRenamed("id", "name")
    sets = materialize(_sets(texts.join(wanted.hint("shuffle_hash"), "id", "left_semi")))

    best = led.groupBy("a").agg(F.max_by("b", F.struct("weight", (-F.col("b")).alias("low"))).alias("b"))
    first = materialize(_confirmed(best, sets, percent))
    reached = components(first)
    rest = led.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(beside).distinct()
    near = reached.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    rest = rest.join(reached.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(near, "b", "left")
    rest = rest.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    second = _confirmed(rest, sets, percent)
    links = first.union(materialize(second))
    linked = components(links)

    # Regions too large for their sets to have met as neighbours, of more than one component.
    named = live.filter(F.col(f"c{min_depth}") > neighbours + 1).select("id", top).join(linked, F.col("id") == linked.node, "left")
    named = named.select("id", top, F.coalesce("component", "id").alias("component"))
    mixed = named.groupBy(top).agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select(top)
    unmet = materialize(named.join(mixed, top, "left_semi").select("id", "component").distinct())
    if not unmet.isEmpty():
        third = materialize(_confirmed(_prefix_pairs(sets.join(unmet, "id"), percent), sets, percent))
        linked = components(links.union(third))

    classes = names.join(linked, names["name"] == linked.node, "left").select("digest", F.coalesce("component", "name").alias("component_id"))
    alone = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = sig.select("id", "n_shingles", "digest").join(classes, "digest", "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), alone).alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of docs of which near_duplicates() keeps the id: one row of every group, with all its columns.

    Of rows that repeat an id one stays, of unlike texts that with the least hash, wherever the rows lie. Rows with a null id cannot be named and all stay.
    """
    kept = near_duplicates(docs, id_col, text_col, **limits).filter("kept").select(id_col).distinct()
    at = unused(docs, "hash")
    hashed = docs.withColumn(at, F.xxhash64(F.coalesce(text_col, F.lit(""))))
    first = hashed.select(id_col, at).join(kept, id_col, "left_semi").groupBy(id_col).agg(F.min(at).alias(at))
    rows = hashed.join(first.hint("shuffle_hash"), [id_col, at], "left_semi").dropDuplicates([id_col, at])
    return rows.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
