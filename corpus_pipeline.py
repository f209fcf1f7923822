"""A training corpus from raw documents: quality rules, line dedup, near dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of docs, whatever else they are named.

Odd rows, by stage: a null or empty text has no words and goes with the quality rules, as do short texts; a document whose lines were all said before stays with an empty text, is in no
near-duplicate group, has no secrets and is packed as its end token alone. Null ids come before all others in line dedup, keep their rows in near-dedup and
are packed under a null id. Rows that repeat an id and text are one document to line dedup and near-dedup; of unlike texts under one id near-dedup keeps that with the least hash. Ties go to the smaller
id, then the earlier line. Very long texts and lines are worked on whole. A null source is a host of its own. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import line_dedup, near_dedup, packing, quality, secret_scan
from skeinwork.llm.common import materialize, table


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars after a text has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rules reject."""
    return quality.keep(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that are alike to an earlier line of the corpus out of the texts."""
    return _recount(line_dedup.drop_repeated_lines(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates; documents without text are no group."""
    return near_dedup.keep_first(docs, percent=80, trees=24)


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts."""
    return _recount(secret_scan.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 1024."""
    return packing.pack(docs, capacity=1024, end_id=2)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("secret scans", secret_scan_stage),
    ("best-fit packing", packing_stage),
]

#: Near-dedup and tokens are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
