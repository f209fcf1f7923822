"""The native operators' plans run no Python."""

import re

from pyspark.sql import functions as F

from skeinwork.llm import line_dedup, quality, secret_scan, topk, url_rules
from skeinwork.llm.common import table


def test_native_stages(spark, small):
    docs = table(spark, small, "documents")
    frames = [
        quality.counts(docs, "doc_id", "text", "source"),
        quality.judge(docs),
        line_dedup._lines(docs, "doc_id", "text").select(*line_dedup._hashes(F.col("words")), *line_dedup._halves(F.col("words"))),
        line_dedup.summary(docs),
        secret_scan._looked_at(docs, "text", F.col("doc_id")),
        secret_scan.digest(docs),
        secret_scan.redact(docs),
    ]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan)


def test_texts_and_urls_stay_where_they_are(spark, small):
    """Quality rules join only the few hosts to the texts; URL rules move nothing."""
    kept = quality.keep(table(spark, small, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in kept and "BroadcastHashJoin" in kept
    judged = url_rules.judge(table(spark, small, "pages"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in judged and "Join" not in judged


def test_top_k_joins_carry_no_candidates_vectors(spark, small):
    plan = topk.top_k(table(spark, small, "embeddings"), lambda i: i % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") + plan.count("ShuffledHashJoin") <= 2
