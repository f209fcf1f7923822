"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

The tree's leaves are the merge ranks of the pairs of neighbouring symbols, each with its place, and every inner node is the
smaller of its children; the root is the leftmost pair of the lowest rank. A merge changes three leaves, and the paths from
them to the root are computed anew. Pieces of equal tree height are encoded side by side, one merge each per step, so that
numpy carries the work. Pieces recur, so a bounded memory of encoded pieces stands before the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary

_NONE = np.int64(1) << np.int64(62)
_CELLS = 1 << 20
#: Bounds of the memory of encoded pieces: how many, and their letters and ids in bytes.
_REMEMBERED, _REMEMBERED_BYTES = 600_000, 128 << 20
_AT_ONCE = 200_000
_LONG = 2_000_000


class Encoder:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path: str = vocabulary.DEFAULT_PATH):
        v = vocabulary.load(path)
        self.tokens = v["tokens"]
        self.special = v["special"]
        merges = np.array(v["merges"], np.int64).reshape(-1, 3)
        keys = merges[:, 0] << 32 | merges[:, 1]
        # a pair listed twice counts with its first rank
        self.keys, self.ranks = np.unique(keys, return_index=True)
        self.merged = merges[:, 2]
        self.table = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        self.bytes = np.array([v["ids"].get(bytes([b]), 0) for b in range(256)], np.int64)
        self.pattern = regex.compile(vocabulary.PATTERN)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids, as little-endian 32-bit integers, of each piece (of one byte at least); pieces must need trees of the same height."""
        n = np.array([len(p) for p in pieces])
        leaves = 1 << max(0, int(n.max()) - 1).bit_length()
        w = len(pieces)
        ids = np.zeros((w, leaves + 1), np.int64)
        for r, p in enumerate(pieces):
            ids[r, : len(p)] = self.bytes[np.frombuffer(p, np.uint8)]
        place = np.arange(leaves + 1)
        after = np.where(place + 1 < n[:, None], place + 1, -1)
        before = np.broadcast_to(place - 1, (w, leaves + 1)).copy()
        gone = place[None, :] >= n[:, None]
        tree = np.full((w, 2 * leaves), _NONE, np.int64)
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        tree[:, leaves:] = np.where((rank < _NONE) & (after[:, :-1] >= 0), rank * leaves + place[:-1], _NONE)
        k = leaves // 2
        while k:
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
            k //= 2
        root = 1 if leaves > 1 else leaves
        row = np.flatnonzero(tree[:, root] < _NONE)
        while len(row):
            top = tree[row, root]
            at, new = top % leaves, self.merged[top // leaves]
            right = after[row, at]
            beyond, prior = after[row, right], before[row, at]
            ids[row, at] = new
            gone[row, right] = True
            after[row, at] = beyond
            more, less = beyond >= 0, prior >= 0
            before[row[more], beyond[more]] = at[more]
            here = self._rank(new, ids[row, beyond])
            tree[row, leaves + at] = np.where(more & (here < _NONE), here * leaves + at, _NONE)
            # the last symbol begins no pair, so it may have no leaf
            inner = right < leaves
            tree[row[inner], leaves + right[inner]] = _NONE
            there = self._rank(ids[row, prior], new)
            tree[row[less], leaves + prior[less]] = np.where(there < _NONE, there * leaves + prior, _NONE)[less]
            rows = np.concatenate([row, row[inner], row[less]])
            nodes = np.concatenate([at, right[inner], prior[less]]) + leaves
            while nodes[0] > 1:
                nodes >>= 1
                tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
            row = row[tree[row, root] < _NONE]
        flat, ends = ids[~gone].astype("<u4").tobytes(), np.cumsum((~gone).sum(1) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge_one(self, piece: bytes) -> bytes:
        """The same tree for a single piece, in plain lists: quicker where few pieces share a height."""
        ids: list[int] = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n, table, merged = len(ids), self.table, self.merged
        leaves = 1 << max(0, n - 1).bit_length()
        none = 1 << 62
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        tree = [none] * (2 * leaves)

        def rank(a: int, b: int, at: int) -> int:
            r = table.get(a << 32 | b)
            return none if r is None else r * leaves + at

        for k in range(n - 1):
            tree[leaves + k] = rank(ids[k], ids[k + 1], k)
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(at: int, value: int) -> None:
            k = leaves + at
            tree[k] = value
            while k > 1:
                k >>= 1
                low, high = tree[2 * k], tree[2 * k + 1]
                low = low if low < high else high
                if tree[k] == low:
                    break
                tree[k] = low

        while n > 1 and (top := tree[1]) < none:
            at, new = top % leaves, int(merged[top // leaves])
            right = after[at]
            beyond, prior = after[right], before[at]
            ids[at], ids[right] = new, -1
            after[at] = beyond
            put(right, none)
            if beyond >= 0:
                before[beyond] = at
                put(at, rank(new, ids[beyond], at))
            else:
                put(at, none)
            if prior >= 0:
                put(prior, rank(ids[prior], new, prior))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _learn(self, pieces: set[str]) -> None:
        by_height: dict[int, list[bytes]] = {}
        for p in pieces:
            raw = p.encode()
            by_height.setdefault(max(0, len(raw) - 1).bit_length(), []).append(raw)
        for height, group in by_height.items():
            step = max(1, _CELLS >> (height + 1))
            for k in range(0, len(group), step):
                part = group[k : k + step]
                done = self.merge(part) if len(part) > 12 else [self.merge_one(p) for p in part]
                self.known.update(zip([p.decode() for p in part], done))

    def _ready(self, pieces: list[str]) -> dict[str, bytes]:
        """The memory, with all these pieces in it; it forgets everything when it would grow too large."""
        if new := {p for p in pieces if p not in self.known}:
            size = 5 * sum(map(len, new))
            if len(self.known) + len(new) > _REMEMBERED or self.held + size > _REMEMBERED_BYTES:
                self.known.clear()
                new, self.held = set(pieces), 0
                size = 5 * sum(map(len, new))
            self.held += size
            self._learn(new)
        return self.known

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of texts of moderate size as little-endian 32-bit integers; their new pieces are merged side by side."""
        lists = []
        for text in texts:
            if self.splits and self.splits.search(text):
                lists.append([p for part in self.splits.split(text) for p in ([part] if part in self.special else self.pattern.findall(part))])
            else:
                lists.append(self.pattern.findall(text))
        known = self._ready([p for x in lists for p in x if p not in self.special])
        fixed = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        return [b"".join([known[p] if p in known else fixed[p] for p in x]) for x in lists]

    def spans(self, text: str) -> Iterator[bytes]:
        """The ids of a long text a part at a time, so that memory stays bounded."""
        for part in self.splits.split(text) if self.splits else [text]:
            if part in self.special:
                yield np.array([self.special[part]], "<u4").tobytes()
                continue
            found = (m.group() for m in self.pattern.finditer(part))
            while some := list(islice(found, _AT_ONCE)):
                known = self._ready(some)
                yield b"".join([known[p] for p in some])

    def encoded(self, column: pa.Array) -> Iterator[Iterator[bytes]]:
        """For each text of an Arrow column (null: empty) its ids in parts; moderate texts are encoded in groups."""
        group: list[str] = []
        size = 0
        for text in [*column, None]:
            last = text is None
            text = None if last else text.as_py() or ""
            long_ = not last and len(text) > _LONG
            if group and (last or long_ or size + len(text) > _LONG):
                yield from (iter((ids,)) for ids in self.encode_all(group))
                group, size = [], 0
            if long_:
                yield self.spans(text)
            elif not last:
                group.append(text)
                size += len(text)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.spans(text or "")), "<u4")

    def decode(self, ids) -> str:
        """The text of ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
        return self.decoded(ids).decode("utf-8", "replace")

    def decoded(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


@lru_cache(maxsize=2)
def encoder(path: str = vocabulary.DEFAULT_PATH) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = vocabulary.DEFAULT_PATH) -> DataFrame:
    """(id_col, ids array<int>) for every row; null text: no ids. Null ids stay null, repeated rows are encoded each."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):  # a few texts at a time, so that batches of long texts stay small
                part = batch.slice(k, 64)
                ids = [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in e.encoded(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(of, "id long, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = vocabulary.DEFAULT_PATH) -> DataFrame:
    """(id_col, text) for every row of ids; null ids give null. Ids outside the vocabulary raise IndexError."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            texts = [None if x is None else e.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(of, "id long, text string")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = vocabulary.DEFAULT_PATH) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass and keeps digests only.

    Null text counts as empty; null ids stay null; repeated rows give repeated rows; other columns are ignored.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for spans in e.encoded(batch.column(1)):
                n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                for span in spans:
                    n += len(span) // 4
                    a.update(span)
                    out = e.decoded(np.frombuffer(span, "<u4"))
                    # a part ends where a piece ends, which is never inside a character
                    b.update(out.decode("utf-8", "replace").encode())
                counts.append(n)
                ids_sha.append(a.hexdigest())
                text_sha.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kinds = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(of, kinds)
    return out.withColumnRenamed("id", id_col)
