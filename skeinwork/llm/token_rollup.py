"""Token totals by source, language and tokenizer version, kept by signed deltas in idempotent batches.

A rollup lives in a folder that all executors share. Each batch writes a part of the ledger (what every changed document now counts,
null once deleted) and its deltas (new minus old, summed by group), then a commit marker. Readers see committed batches alone, so a batch that
broke off leaves no trace, and one that is sent again changes nothing. Totals are sums of the small delta tables. Compaction folds all
committed batches into one base, so that a commit reads what is counted now and not the whole history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vocabulary
from .common import union_all

GROUP = ["source", "lang", "version"]
_KEY = ["doc_id", "version"]


def count_tokens(docs: DataFrame, version: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text", path: str = vocabulary.DEFAULT_PATH) -> DataFrame:
    """(doc_id, source, lang, version, n_tokens) for every row of docs; null text: 0 tokens; null source and lang stay null."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(vocabulary.encode(text.as_py(), path)) for text in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, "doc_id long, source string, lang string, n_tokens long").select("doc_id", "source", "lang", F.lit(version).alias("version"), "n_tokens")


class Rollup:
    """A rollup in the folder root. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.root}/{kind}/{batch:010d}"

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _marked(self, kind: str) -> list[int]:
        path, fs = self._files()
        top = path(f"{self.root}/{kind}")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(top)) if fs.exists(top) else []

    def committed(self) -> list[int]:
        """The numbers of the committed batches, in order."""
        return self._marked("commits")

    def _read(self, kind: str) -> DataFrame | None:
        """The latest base, if there is one, and the committed batches after it, in one scan."""
        base = max(self._marked("bases"), default=-1)
        paths = [self._path(kind, b) for b in self.committed() if b > base]
        paths += [self._path(f"base-{kind}", base)] if base >= 0 else []
        return self.spark.read.parquet(*paths) if paths else None

    def compact(self) -> bool:
        """Folds the committed batches into a base; what readers see stays the same. False if there is nothing new to fold."""
        done = self.committed()
        if not done or done[-1] in self._marked("bases"):
            return False
        last = F.lit(done[-1]).cast("long").alias("batch")
        self.ledger().select(*_KEY, "source", "lang", "n_docs", "n_tokens", last).write.mode("overwrite").parquet(self._path("base-ledger", done[-1]))
        self._sums().write.mode("overwrite").parquet(self._path("base-deltas", done[-1]))
        path, fs = self._files()
        fs.mkdirs(path(self._path("bases", done[-1])))
        return True

    def ledger(self) -> DataFrame | None:
        """(doc_id, version, source, lang, n_docs, n_tokens): what counts after the last committed batch, one row per id, version, source and language; None before the first."""
        rows = self._read("ledger")
        if rows is None:
            return None
        last = F.max("batch").over(Window.partitionBy(*_KEY))
        return rows.withColumn("last", last).filter("batch = last and n_tokens is not null").select(*_KEY, "source", "lang", "n_docs", "n_tokens")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Applies changes (op insert, revise or delete; doc_id, source, lang, version, n_tokens) as batch number batch.

        False, and nothing is changed, if that batch is committed already. Numbers must grow. An insert of what is there and a
        revision of what is not both set the new count; deleting what is not there does nothing. Rows that repeat an id in one batch are as many
        documents, whose counts add up, and a later batch replaces all of them; null doc_ids are such documents too. If such rows have unlike ops, those of the
        last op in the order delete, insert, revise count.
        """
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes before the committed {done[-1]}")
        gone = F.col("op") == "delete"
        rank = F.when(gone, 0).when(F.col("op") == "insert", 1).otherwise(2)
        kept = [F.when(~gone, F.col(c)).alias(c) for c in ("source", "lang")]
        each = changes.withColumn("r", rank).groupBy(*_KEY, "r", *kept).agg(F.count("*").alias("n_docs"), F.sum(F.when(~gone, F.coalesce("n_tokens", F.lit(0)))).alias("n_tokens"))
        top = F.max("r").over(Window.partitionBy(*_KEY))
        new = each.withColumn("top", top).filter("r = top").select(*_KEY, "source", "lang", "n_docs", "n_tokens", F.lit(batch).cast("long").alias("batch"))
        new.write.mode("overwrite").parquet(self._path("ledger", batch))
        new = self.spark.read.parquet(self._path("ledger", batch))

        plus = new.filter("n_tokens is not null").select(*GROUP, "n_docs", "n_tokens")
        old = self.ledger()
        parts = [plus]
        if old is not None:
            keys = new.select(F.col("doc_id").alias("d"), F.col("version").alias("v")).distinct()
            replaced = old.join(keys, old.doc_id.eqNullSafe(keys.d) & old.version.eqNullSafe(keys.v), "left_semi")
            parts.append(replaced.select(*GROUP, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")))
        deltas = union_all(parts).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        deltas.write.mode("overwrite").parquet(self._path("deltas", batch))
        path, fs = self._files()
        fs.mkdirs(path(self._path("commits", batch)))
        return True

    def _sums(self) -> DataFrame | None:
        rows = self._read("deltas")
        return None if rows is None else rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) of all committed batches, without groups that hold no document."""
        sums = self._sums()
        if sums is None:
            return self.spark.createDataFrame([], "source string, lang string, version string, n_docs long, n_tokens long")
        return sums.filter("n_docs <> 0")
