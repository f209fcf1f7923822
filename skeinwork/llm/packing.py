"""Packing documents into sequences of at most so many tokens: dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so the instance is a histogram of at most ``capacity`` rows however large the
corpus; only that goes to the driver. The plan it makes there says for runs of pieces of one length which sequences and offsets
they get. Pieces are numbered within their length in two levels (salt, then row in the salt), and the plan is joined to them.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vocabulary
from .common import materialize

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, tag long"


def cut(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, path: str) -> DataFrame:
    """The token pieces of every document: the ids and the end id, cut from the back so that only the first piece is short."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(vocabulary.encode(text.as_py(), path), end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    tag = xxhash.xxh3_64_intdigest(f"{task},{rows}") >> 1
                    rows += 1
                    out.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), tag))
            columns = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "tag"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(of, _PIECES)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sets of lengths, each with how often it is fixed, that some best packing holds; counts keeps what is left.

    For a length j the set {j, k}, k the longest that still fits, is fixed if k fills the sequence, if no two others fit
    beside j, or if no three fit and no two that fit are longer together than k. If nothing fits, j stays alone.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(items: tuple[int, ...], times: int) -> None:
        fixed.append((items, times))
        for x in items:
            counts[x] -= times
            if not counts[x]:
                del counts[x]
                lengths.pop(bisect_left(lengths, x))

    lengths = sorted(counts)
    for j in sorted(counts, reverse=True):
        while counts.get(j):
            room = capacity - j
            counts[j] -= 1  # the rest of the same length may be its partner
            at = bisect_right(lengths, room) - 1
            while at >= 0 and not counts[lengths[at]]:
                at -= 1
            k = lengths[at] if at >= 0 else 0
            small: list[int] = []
            for x in lengths:
                small += [x] * min(3 - len(small), counts[x])
                if len(small) == 3:
                    break
            fits2 = len(small) > 1 and small[0] + small[1] <= room
            fits3 = len(small) > 2 and sum(small) <= room
            best = 0
            if k and k != room and fits2 and not fits3:
                live = np.array([x for x in lengths if counts[x] and x <= room])
                other = live[np.maximum(np.searchsorted(live, room - live, side="right") - 1, 0)]
                single = (other == live) & np.array([counts[x] < 2 for x in live])
                sums = np.where((live + other <= room) & ~single, live + other, 0)
                if single.any():  # its other partner is the next shorter one
                    where = np.flatnonzero(single & (np.arange(len(live)) > 0))
                    sums[where] = live[where] + live[where - 1]
                best = int(sums.max(initial=0))
            counts[j] += 1
            if not k:
                take((j,), counts[j])
            elif k == room or not fits2 or (not fits3 and best <= k):
                times = counts[j] // 2 if k == j else min(counts[j], counts[k])
                # only an exact fill stays dominant however often it is taken; otherwise look again after the partner is used up
                take((j, k), times)
            else:
                break
    return fixed


def best_fit(counts: dict[int, int], capacity: int, first_sequence: int = 0) -> tuple[list[tuple], int]:
    """Best fit of the histogram, longest first, by runs: rows (length, items, per sequence, first sequence, offset), next number."""
    rows: list[tuple] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many)
    open_: list[int] = []

    def put(left: int, run: tuple[int, int]) -> None:
        if left > 0 and run[1]:
            if left not in room:
                insort(open_, left)
            room.setdefault(left, []).append(run)

    free = first_sequence
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(open_, length)
            if at < len(open_):
                left = open_[at]
                start, many = room[left].pop()
                if not room[left]:
                    del room[left]
                    open_.pop(at)
            else:
                left, start, many = capacity, free, -(-n // (capacity // length))
                free += many
            each = left // length
            full = min(many, n // each)
            if full:
                rows.append((length, full * each, each, start, capacity - left))
                put(left - each * length, (start, full))
                n -= full * each
            if n and full < many:
                rows.append((length, n, n, start + full, capacity - left))
                put(left - n * length, (start + full, 1))
                n, full = 0, full + 1
            put(left, (start + full, many - full))
    return rows, free


def plan(counts: dict[int, int], capacity: int) -> list[tuple]:
    """Rows (length, first, items, per sequence, first sequence, offset): items numbered from first on within their length."""
    left = dict(counts)
    rows, free = [], 0
    for items, times in reduce_by_dominance(left, capacity):
        offset = 0
        if len(set(items)) == 1:
            rows.append((items[0], times * len(items), len(items), free, 0))
        else:
            for x in items:
                rows.append((x, times, 1, free, offset))
                offset += x
        free += times
    more, _ = best_fit(left, capacity, free)
    given: dict[int, int] = {}
    out = []
    for length, n, each, sequence, offset in [*rows, *more]:
        out.append((length, given.get(length, 0), n, each, sequence, offset))
        given[length] = given.get(length, 0) + n
    return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    path: str = vocabulary.DEFAULT_PATH,
    salt_rows: int = 4096,
    max_salts: int = 1 << 16,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per token piece of every row of docs.

    Null and empty texts are the end id alone. A null id is kept as null. Repeated rows are packed each for itself. Other
    columns are ignored; an empty table gives no rows. Salts hold salt_rows pieces each, more once there would be over max_salts: the running
    sums over salts of one length are made in one task.
    """
    spark = docs.sparkSession
    pieces = materialize(cut(docs, id_col, text_col, capacity, end_id, path))
    salted = pieces.withColumn("salt", F.col("tag") % max(1, min(max_salts, -(-pieces.count() // salt_rows))))
    groups = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    rows = plan(counts, capacity) or [(0, 0, 0, 1, 0, 0)]
    steps = spark.createDataFrame(rows, "plan_length long, first long, items long, each long, sequence long, at long")

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "tag")
    ranked = salted.withColumn("row", F.row_number().over(within) - 1).join(groups, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("row"))
    # The plan's rows depend on the capacity alone (a few per length), so they are sent to every task.
    mine = (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("items"))
    placed = ranked.join(F.broadcast(steps), mine)
    nth = F.col("rank") - F.col("first")
    return placed.select(
        F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"),
    )
