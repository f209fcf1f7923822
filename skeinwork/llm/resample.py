"""Importance resampling towards a target distribution, by hashed word features.

Features are runs of 1 to ``order`` words. Every task walks a word trie of its own: a node stands for one run of words and holds how often it was
seen and the CRC state of its bytes, so that the run longer by a word is hashed from there. When a task ends, or its trie is full, the nodes'
counts go into one total per bucket; totals of all tasks are merged by bucket. Scoring walks tries again, with each bucket's gain attached to the nodes.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes that are no part of a word, as spaces, and A-Z as a-z.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Nodes of a trie before it is emptied, and pieces of a text that are read at once.
_NODES, _PIECE = 200_000, 1 << 20


class Node(dict):
    """A run of words: the nodes of the runs longer by a word, the CRC state of its bytes, how often it was counted, and its gain."""

    __slots__ = ("crc", "count", "gain", "trie")

    def __init__(self, trie: Trie, crc: int | None):
        self.trie, self.crc, self.count = trie, crc, 0
        self.gain = 0 if crc is None or trie.gains is None else trie.gains[crc % trie.buckets]

    def __missing__(self, word: bytes) -> Node:
        self.trie.size += 1
        crc = zlib.crc32(word) if self.crc is None else zlib.crc32(word, zlib.crc32(b" ", self.crc))
        node = self[word] = Node(self.trie, crc)
        return node


class Trie:
    """The word trie of one task, of bounded size: full() is asked between pieces of texts and clear() empties it."""

    def __init__(self, buckets: int, gains: list[int] | None = None):
        self.buckets, self.gains = buckets, gains
        self.clear()

    def clear(self) -> None:
        self.size, self.root = 0, Node(self, None)

    def full(self) -> bool:
        return self.size > _NODES

    def count(self, runs: Counter) -> None:
        """Adds counts of runs: of words, or of tuples of words."""
        for run, n in runs.items():
            node = self.root
            for word in (run,) if isinstance(run, bytes) else run:
                node = node[word]
            node.count += n

    def totals(self) -> np.ndarray:
        """The counts by bucket."""
        out, open_ = np.zeros(self.buckets, np.int64), [self.root]
        while open_:
            for node in open_.pop().values():
                out[node.crc % self.buckets] += node.count
                if node:
                    open_.append(node)
        return out

    def gain(self, words: list[bytes], order: int, whole: int) -> int:
        """The sum of gains over the runs of 1 to order words that start at one of the first whole words."""
        root = self.root
        if order == 1:
            return sum([root[w].gain for w in words[:whole]])
        total = 0
        for k in range(whole):
            node = root
            for word in words[k : k + order]:
                node = node[word]
                total += node.gain
        return total


def pieces(text: bytes, order: int) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text, some at a time: (words, whole), where whole of them start runs here and the others only end such runs."""
    held: list[bytes] = []
    for start, piece in _cut(text):
        held += piece.translate(_LETTERS).split()
        last = start + len(piece) >= len(text)
        whole = len(held) if last else max(0, len(held) - order + 1)
        yield held, whole
        held = held[whole:]


def _cut(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Pieces of a text that end where no word goes on; a word that is longer than a piece stays in one."""
    start = 0
    while start < len(text):
        end = min(len(text), start + _PIECE)
        while end < len(text) and _LETTERS[text[end]] != 32:
            end += 1
        yield start, text[start:end]
        start = end


def _bytes(texts: pa.Array) -> Iterator[bytes]:
    """Each text in UTF-8; nothing for null."""
    return (t.as_py() or b"" for t in texts.cast(pa.binary()))


def bucket_counts(rows: DataFrame, text_col: str = "text", order: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket, repeats counted; buckets without features are absent.

    Null and empty texts have none. Each task sends one row a bucket and full trie, however many words it saw.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(buckets)

        def sums() -> pa.RecordBatch:
            n = trie.totals()
            at = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for text in _bytes(batch.column(0)):
                for words, whole in pieces(text, order):
                    seen.update(words[:whole])
                    for k in range(2, order + 1):
                        seen.update(list(zip(*[words[j:] for j in range(k)]))[:whole])
                    if len(seen) > _NODES:
                        trie.count(seen)
                        seen.clear()
                        if trie.full():
                            yield sums()
                            trie.clear()
        trie.count(seen)
        yield sums()

    return rows.select(F.col(text_col).cast("string").alias("text")).mapInArrow(of, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """Each bucket's gain, floor(1000 * ln of how much more often target has it than source, both smoothed by one); source, target: bucket_counts().

    The two tables that the driver reads have one row a bucket at most.
    """
    s, t = (dict(map(tuple, x.select("bucket", "n").collect())) for x in (source, target))
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [math.floor(1000 * math.log((t.get(k, 0) + 1) * all_s / ((s.get(k, 0) + 1) * all_t))) for k in range(buckets)]


def noise(seed: int, doc_id: int | None) -> int:
    """floor(-1000 * ln(-ln u)), u in (0, 1) by the sha256 of seed:doc_id; a null id is hashed as nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", order: int = 1, seed: int = 2024) -> DataFrame:
    """(id, n_words, n_features, weight, score) for every row of docs, without a shuffle; gain is sent with the task, one number a bucket."""
    buckets = len(gain)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(buckets, gain)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for i, text in zip(ids, _bytes(batch.column(1))):
                n = weight = 0
                for words, whole in pieces(text, order):
                    n += whole
                    weight += trie.gain(words, order, whole)
                    if trie.full():
                        trie.clear()
                features = sum(max(0, n - k) for k in range(order))
                out.append((n, features, weight, weight + noise(seed, i)))
            columns = [pa.array(x, pa.int64()) for x in (zip(*out) if out else [()] * 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_words", "n_features", "weight", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(of, "id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, percent: int, min_words: int) -> DataFrame:
    """rows (id, n_words, score, ...) with rank: 1, 2, 3 ... by score, then id, over rows of min_words words or more, null beyond percent of them.

    Rows are dealt to tasks by ranges of that order. A task numbers its own rows, after the rows of the ranges before it, of which the
    driver reads one count a range; no task sees them all.
    """
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("id")]
    dealt = rows.withColumn("fit", F.col("n_words") >= min_words)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(dealt.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    counts = {r.part: r.n for r in dealt.filter("fit").groupBy("part").agg(F.count("*").alias("n")).collect()}
    drawn = percent * sum(counts.values()) // 100
    before = {part: sum(n for p, n in counts.items() if p < part) for part in counts}
    start = rows.sparkSession.createDataFrame(sorted(before.items()), "part int, before long")
    numbered = dealt.join(F.broadcast(start), "part", "left")  # one row a range
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return numbered.withColumn("rank", F.when(F.col("fit"), rank)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("fit", "part", "before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    order: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    percent: int = 10,
    min_words: int = 20,
) -> DataFrame:
    """(id_col, n_features, weight, score, rank), one row per row of docs; the rows with a rank are the sample, percent of those of min_words words or more.

    Words are runs of 0-9, a-z (A-Z are lower-cased) and characters beyond ASCII. weight is the sum of gains over a document's features, so copies
    add up; score adds Gumbel noise by the id. Null and empty texts have no features and weight 0. A null id is hashed as nothing and comes
    last among equal scores; rows that repeat an id and text have equal scores and ranks one after another. Very long texts are read a piece at a
    time. With an empty docs there are no rows; with an empty target every target count is 0. Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, text_col, order, buckets), bucket_counts(target, target_col, order, buckets), buckets)
    out = ranked(scores(docs, gain, id_col, text_col, order, seed), percent, min_words)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that resample() draws, with all their columns. Rows that repeat an id go together; rows with a null id cannot be named and are not drawn."""
    drawn = resample(docs, target, id_col, **options).filter("rank is not null").select(id_col).distinct()
    return docs.join(drawn, id_col, "left_semi").select(*docs.columns)


#: DuckDB SQL for resample() with its own parameters: the CRC by its table of 256 rests, over the bytes of each different word.
ORACLE = r"""
WITH rests AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS rest FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
w AS (SELECT doc_id, unnest(words) AS word FROM d),
names AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM w UNION SELECT word FROM b)),
hashed AS (SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(x), 2), lambda k: CAST('0x' || x[k:k + 1] AS BIGINT))), lambda c, v: xor(c >> 8, rest[CAST(xor(c, v) % 256 AS INTEGER) + 1])), 4294967295) % 10000 AS bucket FROM names, rests),
s AS (SELECT bucket, count(*) AS s FROM w JOIN hashed USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (word) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM w) AS s_all, (SELECT count(*) FROM b) AS t_all),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * CAST(s_all + 10000 AS DOUBLE) / ((s + 1) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
sums AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN sums USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM placed
"""
