"""Helpers that the training-data operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import materialize, shared_dir, table  # noqa: F401


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null. Splitting at a plain space is much cheaper than at a pattern."""
    text = F.coalesce(text, F.lit(""))
    other = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in "\t\n\x0b\x0c\r"])
    spaced = F.when(other, F.regexp_replace(text, "[\\x09-\\x0D]", " ")).otherwise(text)
    return F.array_remove(F.split(spaced, " ", -1), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected links (src, dst): one row (node, component) per linked node.

    Each round every node chooses itself or the neighbour that comes first in a random order drawn for that round, and the
    graph is contracted by the choices, so long chains shrink by a constant factor too; the choices are then followed back.
    Self links and repeated rows are allowed; nodes without links are absent; no rows give no rows.
    """
    both = links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = materialize(both.filter("src <> dst").distinct())
    hops: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(hops)
        rank = lambda c, k=k: F.struct(F.xxhash64(F.lit(k), c).alias("r"), F.col(c).alias("id"))
        parent = edges.groupBy("src").agg(F.min(rank("dst")).alias("low")).select(F.col("src").alias("node"), F.least("low", rank("src"))["id"].alias("to"))
        parent = materialize(parent)
        hops.append(parent)
        moved = edges.join(parent, edges.src == parent.node).select(F.col("to").alias("src"), "dst")
        moved = moved.join(parent, moved.dst == parent.node).select("src", F.col("to").alias("dst"))
        edges = materialize(moved.filter("src <> dst").distinct())
    if not hops:
        return links.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    out = hops[0].select("node", F.col("to").alias("component"))
    for hop in hops[1:]:
        nxt = hop.select(F.col("node").alias("at"), "to")
        out = out.join(nxt, out.component == nxt["at"], "left").select("node", F.coalesce("to", "component").alias("component"))
    low = out.groupBy("component").agg(F.min("node").alias("low"))
    return out.join(low, "component").select("node", F.col("low").alias("component"))


def unused(df: DataFrame, name: str) -> str:
    """The name, made longer until df has no column of it in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
