"""Strongly connected components of call graphs, and sets of edges that stand for many."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialize


def _peeled(edges: DataFrame, rounds: int) -> DataFrame:
    """edges without those from nodes without callers and to nodes without callees, a few rounds deep."""
    for _ in range(rounds):
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    return materialize(edges)


def _colours(edges: DataFrame) -> DataFrame:
    """(node, low_before, low_after): the least node that reaches it and the least node it reaches, itself included.

    Every round a node takes the lesser colours of its neighbours, and the colour of its colour: what reaches that reaches the node as well, so
    colours run along a chain in steps that double. Ends when a round changes nothing.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    held = materialize(nodes.select("node", F.col("node").alias("low_before"), F.col("node").alias("low_after"), F.lit(True).alias("fresh")))
    while not held.filter("fresh").isEmpty():
        own = held.select("node", "low_before", "low_after")
        none = F.lit(None).cast(own.schema["node"].dataType)
        before, after = own.select(F.col("node").alias("src"), "low_before"), own.select(F.col("node").alias("dst"), "low_after")
        given = edges.join(before, "src").select(F.col("dst").alias("node"), "low_before", none.alias("low_after"))
        given = given.union(edges.join(after, "dst").select(F.col("src").alias("node"), none, "low_after"))
        given = given.union(own.select(F.col("low_before").alias("k"), "node").join(own.select(F.col("node").alias("k"), "low_before"), "k").select("node", "low_before", none))
        given = given.union(own.select(F.col("low_after").alias("k"), "node").join(own.select(F.col("node").alias("k"), "low_after"), "k").select("node", none, "low_after"))
        low = given.groupBy("node").agg(F.min("low_before").alias("b"), F.min("low_after").alias("a"))
        nxt = own.join(low, "node", "left").select("node", "low_before", "low_after", F.coalesce(F.least("low_before", "b"), "low_before").alias("b"), F.coalesce(F.least("low_after", "a"), "low_after").alias("a"))
        held = materialize(nxt.select("node", F.col("b").alias("low_before"), F.col("a").alias("low_after"), ((F.col("b") != F.col("low_before")) | (F.col("a") != F.col("low_after"))).alias("fresh")))
    return held.drop("fresh")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that lies on a cycle of two edges or more; component is the least node of those that reach each other.

    Forward and backward colouring: a node whose least node before and after it are the same reaches that one and is reached by it, so both are of
    one component. Those are set aside, edges between unlike colours lie on no cycle, and the rest is coloured again. In each round the least node
    of every colour is settled, so the rounds end. Null ends are no nodes; an edge from a node to itself makes no component.
    """
    live = _peeled(edges.select("src", "dst").filter("src <> dst").distinct(), 3)
    done = []
    while not live.isEmpty():
        colours = materialize(_colours(live))
        done.append(colours.filter("low_before = low_after").select("node", F.col("low_before").alias("component")))
        open_ = colours.filter("low_before <> low_after").select("node", F.struct("low_before", "low_after").alias("colour"))
        ends = live.join(open_.select(F.col("node").alias("src"), F.col("colour").alias("x")), "src").join(open_.select(F.col("node").alias("dst"), F.col("colour").alias("y")), "dst")
        live = _peeled(ends.filter("x = y").select("src", "dst"), 2)
    if not done:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    found = reduce(DataFrame.unionByName, done)
    return found.join(found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1"), "component").select("node", "component")


def representatives(family: list[list[int]], more: int) -> list[list[int]]:
    """Sets of the family, so few that they stand for all: whatever ``more`` elements or fewer some set of the family avoids, a chosen one avoids as well.

    Follows the elements of a chosen set one at a time: a set that avoids those taken so far is chosen if none of the chosen does. With sets of p elements
    at most p ** more are chosen, whatever the size of the family.
    """
    places: dict[int, int] = {}
    masks = [sum(1 << places.setdefault(e, len(places)) for e in set(s)) for s in family]
    chosen: list[int] = []
    seen = set()
    open_ = [(0, more)]
    while open_:
        avoid, left = open_.pop()
        hit = next((k for k in chosen if not masks[k] & avoid), None)
        if hit is None:
            hit = next((k for k, m in enumerate(masks) if not m & avoid), None)
            if hit is None:
                continue
            chosen.append(hit)
        if left:
            rest = masks[hit]
            while rest:
                e = rest & -rest
                rest ^= e
                if avoid | e not in seen:
                    seen.add(avoid | e)
                    open_.append((avoid | e, left - 1))
    return [family[k] for k in chosen]
