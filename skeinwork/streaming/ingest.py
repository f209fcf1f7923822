"""Incremental ingestion: new source files of any kind are parsed as they appear and upserted into tables, batch by batch.

The file source notices each file once; a batch is parsed, and the parsed classes are written under the batch's number, so a batch that runs twice
overwrites itself. Tables are read as the latest row per key over all batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.config import yaml_values
from ..sources.files import properties
from ..sources.java import SCHEMA, parsed_classes
from ..sources.mapper_xml import mapper_rows


def _config_values(found: DataFrame) -> DataFrame:
    return yaml_values(found).unionByName(properties(found))


#: kind of source -> pattern of its files' names, and what a batch of them becomes. DDL stays text; its tables are expressions over it.
KINDS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "java": ("*.java", parsed_classes),
    "mapper": ("*{Mapper,Dao}.xml", mapper_rows),
    "config": ("*.{yml,yaml,properties}", _config_values),
    "ddl": ("*.sql", lambda found: found.select("file_path", "value")),
}


def file_stream(spark: SparkSession, path: str, kind: str = "java", files_per_batch: int = 50) -> DataFrame:
    """(file_path, value) of the files of a kind under path, as they appear."""
    rows = spark.readStream.schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", KINDS[kind][0]).option("maxFilesPerTrigger", files_per_batch).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file_path"), "value")


def java_stream(spark: SparkSession, path: str, files_per_batch: int = 50) -> DataFrame:
    return file_stream(spark, path, "java", files_per_batch)


def start(stream: DataFrame, target: str, checkpoint: str, once: bool = True, kind: str = "java") -> StreamingQuery:
    """Parses the stream's files into target; once stops when all files present are done."""

    def save(batch: DataFrame, number: int) -> None:
        KINDS[kind][1](batch).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def current_rows(spark: SparkSession, target: str) -> DataFrame:
    """The rows of every file as of the last batch it came in: a file that is read again replaces all its rows."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(target)
    last = rows.groupBy("file_path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["file_path", "batch"]).drop("batch")


def current_classes(spark: SparkSession, target: str) -> DataFrame:
    """The latest parsed row of each class."""
    rows = spark.read.schema(SCHEMA + ", batch long").option("basePath", target).parquet(target)
    others = [c for c in rows.columns if c not in ("package_name", "name")]
    last = rows.groupBy("package_name", "name").agg(F.max_by(F.struct(*others), "batch").alias("c"))
    return last.select("package_name", "name", "c.batch", *[f"c.{c}" for c in others if c != "batch"])
