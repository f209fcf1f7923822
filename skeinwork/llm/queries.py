"""The registered queries of the training-data operators: thin, each applies its operator to a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, fim, html_blocks, line_dedup, packing, quality, resample, secret_scan, token_rollup, topk, url_rules, vector_dedup
from .common import materialize, shared_dir, table
from .near_dedup import near_duplicates


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("host_rate", "text_hash")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over the whole table: every document is inserted, then all counts are revised to hold the end token, then documents of under 16 tokens are deleted.

    Each batch is sent twice, as a retried job would; the second time changes nothing. The ledger is compacted on the way.
    """
    rollup = token_rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    counts = materialize(token_rollup.count_tokens(table(spark, sf_dir, "documents")))
    more = counts.withColumn("n_tokens", F.col("n_tokens") + 1)
    batches = [counts.withColumn("op", F.lit("insert")), more.withColumn("op", F.lit("revise")), more.filter("n_tokens < 16").withColumn("op", F.lit("delete"))]
    for number, batch in enumerate(batches, 1):
        for _ in range(2):
            rollup.commit(number, batch)
        if number == 2:
            rollup.compact()
    return rollup.totals()


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), min_cosine=0.95)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_best_fit_packing,
        op3_bpe_round_trip,
        op4_url_rules,
        op5_html_blocks,
        op6_exact_top_k,
        op7_quality_rules,
        op8_line_dedup,
        op9_secret_scan,
        op10_token_rollup,
        op11_embedding_near_dedup,
        op12_importance_resampling,
        op13_fill_in_middle,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE: dict[str, str] = {"op4_url_rules": url_rules.ORACLE, "op6_exact_top_k": topk.ORACLE, "op7_quality_rules": quality.ORACLE, "op11_embedding_near_dedup": vector_dedup.ORACLE, "op12_importance_resampling": resample.ORACLE, "op13_fill_in_middle": fim.ORACLE}
