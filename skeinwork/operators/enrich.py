"""Descriptions from a pluggable provider: rows that need one are sent to it batch by batch inside the tasks, and a ledger keeps what came of it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import clean_reply, error_class
from .predicates import needs_enrichment
from .upsert import update_columns

LEDGER = "key string, hash string, reply string, message string, attempts int"
#: What a provider's error says if another try may help.
_AGAIN = ("429", "503", "rate limit", "unavailable", "timeout", "timed out")


def attempt(rows: DataFrame, provider: Callable[[list[str]], list[str]], keys: list[str], source_col: str = "source", retries: int = 3, pause: float = 0.5) -> DataFrame:
    """(key, hash, reply, message, attempts): one ledger row per row, with a reply or with the message of the error that it failed with.

    key is the row's keys as text, hash that of its source. Errors that may pass are tried again after a pause that doubles, others are not. A batch that fails as a whole is sent row by
    row, so that one bad prompt fails alone; a reply that is missing is an error of its row.
    """

    def send(prompts: list[str]) -> tuple[list, str | None, int]:
        for k in range(max(1, retries)):
            try:
                replies = list(provider(prompts))
                if len(replies) == len(prompts):
                    return replies, None, k + 1
                return [], f"{len(replies)} replies to {len(prompts)} prompts", k + 1
            except Exception as error:  # noqa: BLE001  a provider may fail in any way; the ledger keeps what it said
                said = f"{type(error).__name__}: {error}"
                if not any(x in said.lower() for x in _AGAIN) or k + 1 >= retries:
                    return [], said, k + 1
                time.sleep(pause * 2**k)
        return [], "no attempt", 0

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prompts = list(batch["prompt"])
            replies, said, n = send(prompts)
            if said is None:
                results = [(r, None if r else "empty reply", n) for r in replies]
            elif len(prompts) == 1:
                results = [(None, said, n)]
            else:
                results = [(r[0] if r else None, m if m else None if r[0] else "empty reply", n + more) for r, m, more in map(lambda p: send([p]), prompts)]
            yield batch[["key", "hash"]].assign(reply=[r for r, _, _ in results], message=[m for _, m, _ in results], attempts=[k for _, _, k in results])

    text = F.coalesce(F.col(source_col), F.lit(""))
    asked = rows.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key"), F.sha2(text, 256).alias("hash"), text.alias("prompt")).dropDuplicates(["key", "hash"])
    return asked.mapInPandas(of, LEDGER)


def open_rows(rows: DataFrame, ledger: DataFrame, keys: list[str], source_col: str = "source") -> DataFrame:
    """The rows whose source, as it is now, has neither a reply in the ledger nor an error that no further try can mend."""
    done = ledger.filter(F.col("reply").isNotNull() | (error_class(F.col("message")) == "fatal")).select(F.col("key").alias("__key"), F.col("hash").alias("__hash")).distinct()
    mine = rows.withColumns({"__k": F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), "__h": F.sha2(F.coalesce(F.col(source_col), F.lit("")), 256)})
    return mine.join(done, (F.col("__k") == F.col("__key")) & (F.col("__h") == F.col("__hash")), "left_anti").drop("__k", "__h")


def applied(rows: DataFrame, ledger: DataFrame, keys: list[str], description_col: str = "ai_description", source_col: str = "source") -> DataFrame:
    """rows with the ledger's replies to their sources as they are now, where they have no description."""
    mine = rows.select(*keys, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key"), F.sha2(F.coalesce(F.col(source_col), F.lit("")), 256).alias("hash")).dropDuplicates(keys)
    new = mine.join(ledger.filter("reply is not null"), ["key", "hash"]).withColumn("text", clean_reply(F.col("reply"))).filter("text <> ''")
    new = new.groupBy(*keys).agg(F.max("text").alias("__new"))
    cond = [F.col(f"__r_{c}").eqNullSafe(F.col(c)) for c in keys]
    new = new.select(*[F.col(c).alias(f"__r_{c}") for c in keys], "__new")
    joined = rows.join(new, cond, "left")
    had = F.nullif(F.trim(F.col(description_col)), F.lit(""))
    return joined.select(*[F.coalesce(F.when(had.isNotNull(), F.col(c)), F.col("__new"), F.col(c)).alias(c) if c == description_col else F.col(c) for c in rows.columns])


def resume(store, rows: DataFrame, provider: Callable[[list[str]], list[str]], keys: list[str], description_col: str = "ai_description", source_col: str = "source", per_commit: int = 1000, retries: int = 3, pause: float = 0.5) -> DataFrame:
    """rows with descriptions, made in commits of so many rows to the table enrichment of a store (see skeinwork.store), so that a run that breaks off repeats no row that was committed.

    A row is asked again only if its source has changed or its last error may pass. The ledger's errors feed error_report().
    """
    spark = rows.sparkSession
    held = store.read(names=["enrichment"]).get("enrichment")
    ledger = held if held is not None else spark.createDataFrame([], LEDGER)
    wanted = open_rows(needs_enrichment(rows, description_col, source_col, None), ledger, keys, source_col)
    count = wanted.count()
    parts = max(1, -(-count // per_commit))
    share = F.pmod(F.xxhash64(*keys), F.lit(parts))
    for k in range(parts if count else 0):
        fresh = attempt(wanted.filter(share == k), provider, keys, source_col, retries, pause)
        # the last answer to a key and source is the one kept
        both = ledger.withColumn("turn", F.lit(0)).unionByName(fresh.withColumn("turn", F.lit(1)))
        last = Window.partitionBy("key", "hash").orderBy(F.desc("turn"))
        store.commit({"enrichment": both.withColumn("r", F.row_number().over(last)).filter("r = 1").drop("r", "turn")})
        ledger = store.read(names=["enrichment"])["enrichment"]
    return applied(rows, ledger, keys, description_col, source_col)


def describe(rows: DataFrame, provider: Callable[[list[str]], list[str]], keys: list[str], description_col: str = "ai_description", source_col: str = "source", limit: int | None = None, retries: int = 3) -> DataFrame:
    """rows with the descriptions that provider gives for the sources of those without one, in one pass and without a ledger.

    provider takes a list of prompts and gives as many replies; it is sent to the tasks, so it must be picklable. Rows that fail stay as they were; attempt() tells why, resume() keeps it.
    """
    wanted = needs_enrichment(rows, description_col, source_col, limit).select(*keys, source_col)
    replies = attempt(wanted, provider, keys, source_col, retries).filter("reply is not null")
    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keys)
    new = replies.select(F.from_json("key", kinds).alias("k"), clean_reply(F.col("reply")).alias(description_col)).filter(f"{description_col} <> ''")
    return update_columns(rows, new.select("k.*", description_col), keys, [description_col])


def error_report(errors: DataFrame) -> DataFrame:
    """(class, n) of error messages (column message); rows without one are no errors."""
    return errors.filter("message is not null").groupBy(error_class(F.col("message")).alias("class")).agg(F.count("*").alias("n"))
