"""Line deduplication across documents by a deletion-neighbourhood join, in built-in expressions only.

A line is its words in order. Two lines are alike if they are equal, or if one word edit (a word changed, put in or left out)
turns one into the other and both have near_words words at least. Of alike lines the earliest stays. Equal lines meet by hash.
For the others, every line emits the hashed keys of all its variants with one word deleted: lines of one length that agree on a key
and its place differ in that word alone, and a variant that is a whole shorter line differs by an insertion. Pairs are then
verified on the words. A line can only have such a partner if it shares its first or its last half with another line, and the
edit is in the other half; so variants are only emitted for such lines and places. That loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unused, words_of

_LINE = ["h1", "h2"]


def _hashes(words: Column) -> list[Column]:
    return [F.xxhash64(F.size(words), words).alias("h1"), F.xxhash64(words, F.lit(1)).alias("h2")]


def _halves(words: Column) -> list[Column]:
    """Hashes of the first and last k words, for both k that a line may have in common with one of a word more or less."""
    n = F.size(words)
    out = []
    for name, k in (("1", F.floor(n / 2).cast("int")), ("2", F.floor((n - 1) / 2).cast("int"))):
        out.append(F.xxhash64(k, F.slice(words, F.lit(1), k)).alias("front" + name))
        out.append(F.xxhash64(k, F.slice(words, n - k + 1, k)).alias("back" + name))
    return out


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, line, words, chars) for every line; th tells texts of one id apart, chars is the line's length in code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("line", "value"))
    return rows.select("id", "th", "line", words_of(F.col("value")).alias("words"), F.length("value").alias("chars"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, near_words: int = 10, min_chars: int = 40) -> DataFrame:
    """(id, th, line): the lines (from 0) that are alike to an earlier line, by document id, text hash and line number.

    A line counts if it has min_words words, or min_chars code points, as a passage in a script without spaces may have in a word or two; shorter ones never count. A very long
    line is one row, and its variants one row a word. Null and empty texts have no lines that count; a null id comes before all others.
    Rows that repeat an id and a text are one document; texts that share an id are ordered by their hash. An empty table gives no rows.
    """
    if near_words < 2:
        raise ValueError("near_words must be 2 or more")
    lines = _lines(docs, id_col, text_col).filter((F.size("words") >= min_words) | ((F.size("words") > 0) & (F.col("chars") >= min_chars)))
    halves = ["front1", "back1", "front2", "back2"]
    lines = materialize(lines.select("id", "th", "line", F.size("words").alias("n"), *_hashes(F.col("words")), *_halves(F.col("words"))))
    first = lines.groupBy(*_LINE).agg(F.min(F.struct("id", "th", "line")).alias("at"), *[F.any_value(c).alias(c) for c in ("n", *halves)])
    first = materialize(first)

    # lines that share a half with another line
    sides = [F.struct(F.lit(c[:-1]).alias("side"), F.col(c).alias("half")) for c in halves]
    keyed = first.filter(F.col("n") >= near_words).select(*_LINE, F.explode(F.array_distinct(F.array(*sides))).alias("x")).select(*_LINE, "x.*")
    twice = keyed.groupBy("side", "half").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    near = keyed.join(twice, ["side", "half"], "left_semi").groupBy(*_LINE)
    near = near.agg(F.max(F.col("side") == "front").alias("front"), F.max(F.col("side") == "back").alias("back"))
    near = materialize(first.select(*_LINE, "n", "at").join(near, _LINE))
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    wanted = near.select(F.col("at.id").alias("id")).distinct()
    held = source.join(wanted.hint("shuffle_hash"), F.col("doc").eqNullSafe(F.col("id")), "left_semi")
    texts = _lines(held, "doc", "text").filter(F.size("words") >= near_words).withColumns(dict(zip(_LINE, _hashes(F.col("words")))))
    where = near.select(*_LINE, "at", "n", "front", "back")
    mine = (texts.h1 == where.h1) & (texts.h2 == where.h2) & F.col("at").eqNullSafe(F.struct("id", "th", "line"))
    texts = texts.join(where, mine).select(texts.h1, texts.h2, "n", "at", "front", "back", "words").dropDuplicates(_LINE)
    texts = materialize(texts)

    # The key of a line is the XOR of its words' hashes with their places; prefixes and suffixes give each variant's key.
    own = [*_LINE, "n", "at", "front", "back", "p"]
    words = texts.select(*own[:-1], F.posexplode("words").alias("p", "w"))
    words = words.select(*own, F.xxhash64("p", "w").alias("g"), F.xxhash64(F.col("p") - 1, "w").alias("s"))
    line = Window.partitionBy(*_LINE).orderBy("p")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    variants = words.select(
        *own, "g",
        F.bit_xor("g").over(Window.partitionBy(*_LINE)).alias("whole"),
        F.coalesce(F.bit_xor("g").over(before), F.lit(0)).alias("ahead"),
        F.bit_xor("s").over(Window.partitionBy(*_LINE)).bitwiseXOR(F.bit_xor("s").over(line.rowsBetween(Window.unboundedPreceding, 0))).alias("behind"),
    )
    # Where only the first half is shared, the edit is in the last one, and the other way round.
    there = F.col("front") & (F.col("p") >= F.floor((F.col("n") - 1) / 2)) | F.col("back") & (F.col("p") <= F.floor(F.col("n") / 2) + 1)
    changed, shorter = F.col("whole").bitwiseXOR(F.col("g")), F.col("ahead").bitwiseXOR(F.col("behind"))
    variants = variants.select("n", "at", "p", "whole", F.when(there, changed).alias("changed"), F.when(there, shorter).alias("shorter"))
    variants = materialize(variants.filter("p = 0 or changed is not null"))

    # One word changed: of all lines with equal variants at a place, the earliest.
    group = ["n", "p", "changed"]
    edited = variants.filter("changed is not null")
    earliest = edited.groupBy(*group).agg(F.min("at").alias("low"), F.count("*").alias("c")).filter("c > 1")
    changed = edited.join(earliest, group).filter("low < at").select("at", "low", (F.col("p") + 1).alias("p"), F.lit(1).alias("skip"))
    # One word more: a variant that is a shorter line. Either may be the earlier one.
    whole = variants.filter("p = 0").select("whole", (F.col("n") + 1).alias("n"), F.col("at").alias("base"))
    longer = edited.select("n", "p", F.col("shorter").alias("whole"), "at").join(whole, ["n", "whole"])
    longer = longer.filter("at <> base").select("at", "base", (F.col("p") + 1).alias("p"))

    body = texts.select("at", "words")
    left, right = body.select(F.col("at").alias("a"), F.col("words").alias("wa")), body.select(F.col("at").alias("b"), F.col("words").alias("wb"))
    pairs = changed.select(F.col("at").alias("a"), F.col("low").alias("b"), "p", "skip").union(longer.select("at", "base", "p", F.lit(0)))
    pairs = pairs.dropDuplicates(["a", "b"]).join(left, "a").join(right, "b")
    alike = (F.slice("wa", F.lit(1), F.col("p") - 1) == F.slice("wb", F.lit(1), F.col("p") - 1)) & (
        F.slice("wa", F.col("p") + 1, F.size("wa")) == F.slice("wb", F.col("p") + F.col("skip"), F.size("wb"))
    )
    late = pairs.filter(alike).select(F.greatest("a", "b").alias("at")).distinct().withColumn("late", F.lit(True))

    first = first.select(*_LINE, "at").join(late, "at", "left")
    found = lines.select("id", "th", "line", *_LINE).join(first, _LINE)
    return found.filter((F.col("at") < F.struct("id", "th", "line")) | F.col("late")).select("id", "th", "line").distinct()


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """(id_col, n_lines, n_dropped, dropped) for every row of docs; dropped lists line numbers from 0, comma-joined."""
    gone = repeated_lines(docs, id_col, text_col, **limits).groupBy("id", "th").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("of"), (F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("n_lines"))
    out = rows.join(gone, F.col("doc").eqNullSafe(F.col("id")) & (F.col("of") == F.col("th")), "left")
    lines = F.coalesce("gone", F.array().cast("array<int>"))
    return out.select(F.col("doc").alias(id_col), "n_lines", F.size(lines).cast("long").alias("n_dropped"), F.array_join(lines.cast("array<string>"), ",").alias("dropped"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """docs with the repeated lines taken out of its texts; all rows and columns stay. A null text stays null."""
    gone = repeated_lines(docs, id_col, text_col, **limits).groupBy("id", "th").agg(F.collect_list("line").alias("gone"))
    at, th, lost = (unused(docs, name) for name in ("at", "th", "gone"))
    gone = gone.select(F.col("id").alias(at), F.col("th").alias(th), F.col("gone").alias(lost))
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.join(gone.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(at)) & (F.xxhash64(text) == F.col(th)), "left")
    split = F.split(text, "\n", -1)

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
        return F.array_join(F.transform(left, lambda k: lines[k]), "\n")

    cut = F.transform(F.array(split), rest)[0]
    return out.withColumn(text_col, F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(cut)).select(*docs.columns)
