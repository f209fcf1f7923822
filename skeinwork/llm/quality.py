"""Quality rules over documents, with verdicts on whole hosts.

Everything is built-in expressions. The text is read once: its counts are written as a narrow table, of which the rule
failures are summed by host. A host's failure rate is shrunk towards the rate of all hosts by a beta prior that is fitted to
the hosts' rates by moments, so a host of few documents needs more than bad luck to be condemned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, unused, words_of


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of three words that occur twice or more.

    The windows' hashes are sorted with their places, equal neighbours give the places of repeated windows, and consecutive
    places cover min(3, distance) words each. Windows count as equal if their 64-bit hashes are.
    """
    n = F.size(words)
    two = F.zip_with(words, F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(two, F.slice(words, 3, F.greatest(n, F.lit(1))), lambda h, c: F.xxhash64(h, c))
    windows = F.slice(three, 1, F.greatest(n - 2, F.lit(0)))

    def places(order: Column) -> Column:
        beside = F.zip_with(order, F.slice(order, 2, F.greatest(F.size(order), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])))
        return F.sort_array(F.array_distinct(F.flatten(F.array_compact(beside))))

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def of(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
        whole = _let(_let(order, places), covered)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(whole)

    return F.when(n < 4, F.lit(0)).otherwise(_let(windows, of))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _by_words(text: Column) -> Column:
    return _let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    ))


def _by_lines(text: Column) -> Column:
    return _let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\x09-\\x0D]")), lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
    ))


def _symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")


def counts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, th, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), one row per row of docs; th is the text's hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(host_col).cast("string").alias("host")]
    split = docs.select(*own, _by_words(text).alias("w"), _symbols(text).alias("n_symbols"), _by_lines(text).alias("x"))
    return split.select("id", "th", "host", "w.n_words", "w.word_chars", "n_symbols", "x.n_lines", "x.n_dup_lines", "w.n_repeat_words")


def _base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (n_repeat_words * 100 > n_words * 50)


def _failed(w: Column, n_symbols: Column, x: Column, max_symbol_percent: int, max_dup_line_percent: int) -> Column:
    """Whether a document fails a rule, by its counts of words (w), symbols and lines (x)."""
    symbols = n_symbols * 100 > w["word_chars"] * max_symbol_percent
    return _base_failed(w["n_words"], w["n_repeat_words"]) | symbols | (x["n_dup_lines"] * 100 > x["n_lines"] * max_dup_line_percent)


def _by_host(rows: DataFrame) -> DataFrame:
    return rows.groupBy("host").agg(F.count("*").alias("n"), F.count_if("failed").alias("bad"))


def _rates(hosts: DataFrame) -> DataFrame:
    """(host, host_rate) of hosts (host, n, bad): the share of failing documents, shrunk towards that of all hosts."""
    rate = F.col("bad") / F.col("n")
    # Moments over hosts: mean m and variance v of the rates give a + b = m (1 - m) / v - 1; at least one document's weight.
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    weight = F.coalesce(F.greatest(F.col("m") * (1 - F.col("m")) / F.nullif(F.col("v"), F.lit(0.0)) - 1, F.lit(1.0)), F.lit(1.0e6))
    # one row of two numbers, so the join needs no shuffle
    prior = F.broadcast(prior.select("m", weight.alias("weight")))
    return hosts.crossJoin(prior).select("host", ((F.col("bad") + F.col("m") * F.col("weight")) / (F.col("n") + F.col("weight"))).alias("host_rate"))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_symbol_percent: int = 5,
    max_dup_line_percent: int = 50,
    max_host_rate: float = 0.6,
) -> DataFrame:
    """One row per row of docs: text_hash, the counts, base_failed, host_rate and kept.

    A document fails the base rules with under 50 words or with more than half its words in repeated windows, and the
    further rules with too many symbols per word character or too many repeated lines. kept is false for a document that
    fails any rule and for all documents of a host whose shrunk rate of failing documents is over max_host_rate.
    Null text has no words. Null hosts are one host. Null ids and repeated rows stay as they are. Columns of docs other than
    the three named are ignored; an empty table gives no rows.
    """
    rows = materialize(counts(docs, id_col, text_col, host_col))
    words, lines = F.struct("n_words", "word_chars", "n_repeat_words"), F.struct("n_lines", "n_dup_lines")
    failed = _failed(words, F.col("n_symbols"), lines, max_symbol_percent, max_dup_line_percent)
    rows = rows.withColumns({"base_failed": _base_failed(F.col("n_words"), F.col("n_repeat_words")), "failed": failed})

    shrunk = _rates(_by_host(rows)).select(F.coalesce("host", F.lit("")).alias("at"), F.col("host").isNull().alias("none"), "host_rate")
    same = (F.coalesce(rows.host, F.lit("")) == shrunk["at"]) & (rows.host.isNull() == shrunk["none"])
    out = rows.join(shrunk, same)
    kept = ~F.col("failed") & (F.col("host_rate") <= max_host_rate)
    return out.select(F.col("id").alias(id_col), F.col("th").alias("text_hash"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", kept.alias("kept"))


def keep(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_symbol_percent: int = 5,
    max_dup_line_percent: int = 50,
    max_host_rate: float = 0.6,
) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns.

    The rows are written once with whether they fail, which is then counted by host from that column alone; only the hosts that are over
    the rate are joined to the rows, so that no text is shuffled where those hosts are few, and none is judged twice.
    """
    text, host = F.coalesce(F.col(text_col), F.lit("")), F.col(host_col).cast("string")
    limits = (max_symbol_percent, max_dup_line_percent)
    failed = _let(F.struct(_by_words(text).alias("w"), _symbols(text).alias("n"), _by_lines(text).alias("x")), lambda m: _failed(m["w"], m["n"], m["x"], *limits))
    mark, at = unused(docs, "failed"), unused(docs, "host")
    rows = materialize(docs.withColumn(mark, failed))
    # A written table, whose size the optimizer knows: it is broadcast if that is small.
    hosts = _by_host(rows.select(host.alias("host"), F.col(mark).alias("failed")))
    bad = materialize(_rates(hosts).filter(F.col("host_rate") > max_host_rate).select(F.col("host").alias(at)))
    return rows.filter(~F.col(mark)).join(bad, host.eqNullSafe(F.col(at)), "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         row_number() OVER () AS r
  FROM documents),
windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
f AS (
  SELECT d.doc_id, d.source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered c USING (r)),
g AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 5 * word_chars OR 100 * n_dup_lines > 50 * n_lines AS failed
  FROM f),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE failed) AS bad FROM g GROUP BY source),
prior AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM hosts),
weights AS (SELECT m, CASE WHEN v = 0 THEN 1.0e6 ELSE greatest(m * (1 - m) / v - 1, 1.0) END AS weight FROM prior),
shrunk AS (SELECT source, (bad + m * weight) / (n + weight) AS host_rate FROM hosts, weights)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND host_rate <= 0.6 AS kept
FROM g JOIN shrunk ON g.source IS NOT DISTINCT FROM shrunk.source
"""
