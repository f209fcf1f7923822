"""Facts about DDL text as Column expressions: tables, columns, indexes and constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sqlmeta import _extract, _let, strip, strip_comments

#: A name, plain or quoted, with or without what qualifies it.
_PART = r"(?:[\w$]+|\"[^\"]+\"|`[^`]+`|\[[^\]]+\])"
_NAME = rf"((?:{_PART}\s*\.\s*)*{_PART})"
# fixed value: the narrower form that strict=True promises
_STRICT_TABLE = r"(?is)CREATE\s+TABLE\s+()(\w+)\s*\((.*?)\);"
_TABLE = rf"(?is)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:GLOBAL|LOCAL|TEMP|TEMPORARY|UNLOGGED|EXTERNAL|FOREIGN)\s+)*TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}\s*(\(.*)$"
# A method (USING btree) may stand before the columns.
_INDEX = rf"(?is)^\s*CREATE\s+(UNIQUE\s+)?(?:(?:FULLTEXT|SPATIAL|CLUSTERED|NONCLUSTERED)\s+)?INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}\s+ON\s+(?:ONLY\s+)?{_NAME}\s*(?:USING\s+\w+\s*)?(\(.*)$"
_ALTER = rf"(?is)^\s*ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?{_NAME}\s+(.*)$"
_DROP = rf"(?is)^\s*DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?{_NAME}"
#: A constraint with or without a name, and what it is.
_RULE = rf"(?is)^(?:CONSTRAINT\s+({_PART})\s+)?((?:PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK|EXCLUDE)\b.*)$"
#: Items of a table's body that are neither columns nor constraints.
_OTHER = r"(?is)^(?:(?:UNIQUE\s+|FULLTEXT\s+|SPATIAL\s+)?(?:INDEX|KEY)\b(?!\s+(?:VARCHAR|CHAR|TEXT|INT|INTEGER|BIGINT|SMALLINT|NUMERIC|DECIMAL|DATE|TIMESTAMP|UUID|BOOLEAN|BYTEA|JSONB?)\b)|LIKE\b|PERIOD\s+FOR\b)"
_INLINE = rf"(?is)\bCONSTRAINT\s+({_PART})\s+(.+)$"
#: Strings, quoted names, comments, bodies between dollars, single signs and all between them.
_TOKEN = r"""'(?:[^'\\]++|''|\\[\s\S])*+'|"(?:[^"]++|"")*+"|`[^`]*+`|--[^\n]*+|/\*[\s\S]*?\*/|\$(\w*)\$[\s\S]*?\$\1\$|[;(),]|[^;(),'"`$/\-]++|[\s\S]"""
_FOLD = "struct<depth:int,now:string,items:array<string>,done:boolean>"


def _tokens(text: Column) -> Column:
    """The tokens of a script, each comment as a space."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.when(t.startswith("--") | t.startswith("/*"), " ").otherwise(t))


def _statements(text: Column) -> Column:
    """The statements of a script; a semicolon inside quotes, dollars or comments ends none."""

    def cut(toks: Column) -> Column:
        ends = F.filter(F.transform(toks, lambda t, k: F.when(t == ";", k)), lambda k: k.isNotNull())
        starts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda k: k + 1))
        spans = F.arrays_zip(starts.alias("a"), F.concat(ends, F.array(F.size(toks))).alias("b"))
        return F.transform(spans, lambda s: F.array_join(F.slice(toks, s["a"] + 1, F.greatest(s["b"] - s["a"], F.lit(0))), ""))

    return F.filter(_let(_tokens(text), cut), lambda x: F.trim(x) != "")


def _parts(text: Column, level: int) -> Column:
    """The trimmed parts between commas: of the first brackets (level 1), or of the whole text (level 0). Brackets inside and quotes are kept whole."""

    def add(acc: Column, t: Column) -> Column:
        ends = (t == ")") & (acc["depth"] == 1) if level else F.lit(False)
        push = ~acc["done"] & (((t == ",") & (acc["depth"] == level)) | ends)
        now = F.when(push, "").when(~acc["done"] & (acc["depth"] >= level), F.concat(acc["now"], t)).otherwise(acc["now"])
        depth = acc["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
        return F.struct(depth.alias("depth"), now.alias("now"), F.when(push, F.concat(acc["items"], F.array(acc["now"]))).otherwise(acc["items"]).alias("items"), (acc["done"] | ends).alias("done")).cast(_FOLD)

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("done")).cast(_FOLD)
    found = F.aggregate(_tokens(text), start, add, lambda acc: acc["items"] if level else F.concat(acc["items"], F.array(acc["now"])))
    return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def _plain(name: Column) -> Column:
    """A name without its quotes."""
    return F.regexp_replace(F.trim(name), r'^["`\[]|["`\]]$', "")


def _last(name: Column) -> Column:
    return _plain(_extract(name, rf"({_PART})\s*$"))


def _schema(name: Column) -> Column:
    return F.nullif(_plain(_extract(name, rf"({_PART})\s*\.\s*{_PART}\s*$")), F.lit(""))


def _listed(definition: Column) -> Column:
    """The names in the first brackets, without their order and length."""
    return F.transform(_parts(definition, 1), lambda x: _plain(_extract(x, rf"^({_PART})")))


def database_name(text: Column, path: Column) -> Column:
    named = _extract(text, r"(?i)--\s*Database[:=]\s*(\w+)")
    return F.when(named != "", named).otherwise(_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$"))


def environment(text: Column, path: Column) -> Column:
    said, name = _extract(text, r"(?i)--\s*Environment[:=]\s*(\w+)"), F.lower(path)
    guess = F.when(name.contains("prod"), "prod").when(name.contains("dev"), "dev").when(name.contains("test"), "test").otherwise("")
    return F.when(said != "", said).otherwise(guess)


def constraint_type(definition: Column) -> Column:
    d = F.upper(definition)
    out = F.lit("UNKNOWN")
    for word in ("DEFAULT", "CHECK", "UNIQUE", "FOREIGN KEY", "PRIMARY KEY"):
        out = F.when(d.contains(word), F.lit(word)).otherwise(out)
    return out


def statements(files: DataFrame, path_col: str = "file_path", text_col: str = "value") -> DataFrame:
    """(database_name, script, nth, text) of every statement of every script, comments left out; nth counts from 0 in the script."""
    rows = files.select(database_name(F.col(text_col), F.col(path_col)).alias("database_name"), F.col(path_col).alias("script"), F.posexplode(_statements(F.col(text_col))).alias("nth", "text"))
    return rows


def tables(files: DataFrame, path_col: str = "file_path", text_col: str = "value", strict: bool = False) -> DataFrame:
    """(database_name, schema, table_name, body, items, script, nth) of every CREATE TABLE: items are the parts of its body, whatever follows the closing bracket.

    Names may be quoted and qualified. A CREATE TABLE that is cut short has the items that are whole. strict skips IF NOT EXISTS, schema-qualified and quoted names.
    """
    if strict:
        text = F.col(text_col)
        hits = files.select(database_name(text, F.col(path_col)).alias("database_name"), F.col(path_col).alias("script"), F.posexplode(F.regexp_extract_all(strip_comments(text), F.lit(_STRICT_TABLE), F.lit(0))).alias("nth", "text"))
        body = _extract(F.col("text"), _STRICT_TABLE, 3)
        rows = hits.select("database_name", F.lit(None).cast("string").alias("schema"), _extract(F.col("text"), _STRICT_TABLE, 2).alias("table_name"), body.alias("body"), _parts(body, 0).alias("items"), "script", "nth")
        return rows
    hits = statements(files, path_col, text_col).withColumn("name", _extract(F.col("text"), _TABLE, 1)).filter("name <> ''").withColumn("items", _parts(_extract(F.col("text"), _TABLE, 2), 1))
    return hits.select("database_name", _schema(F.col("name")).alias("schema"), _last(F.col("name")).alias("table_name"), F.array_join("items", ", ").alias("body"), "items", "script", "nth")


def _facts(item: Column) -> list[Column]:
    """name, data_type, nullable, unique, primary_key and default of a column's definition."""
    rest = F.upper(F.regexp_replace(item, r"'(?:[^']|'')*+'", "''"))
    name = _extract(item, rf"^({_PART})")
    kind = _extract(F.substring(item, F.length(name) + 1, F.length(item)), rf"(?i)^\s+((?:DOUBLE\s+PRECISION|CHARACTER\s+VARYING|{_PART})(?:\s*\([^)]*\))?(?:\s*\[\s*\])*)")
    return [
        _plain(name).alias("name"), kind.alias("data_type"), (~rest.rlike(r"\bNOT\s+NULL\b|\bPRIMARY\s+KEY\b")).alias("nullable"), rest.rlike(r"\bUNIQUE\b").alias("unique"), rest.rlike(r"\bPRIMARY\s+KEY\b").alias("primary_key"),
        F.nullif(_extract(item, r"(?i)\bDEFAULT\s+('(?:[^']|'')*'(?:::\w+)?|[\w.]+(?:\([^()]*\))?|\([^()]*\))"), F.lit("")).alias("default"),
    ]


def columns(tables_: DataFrame, changes_: DataFrame | None = None) -> DataFrame:
    """(database_name, table_name, position, name, data_type, nullable, unique, primary_key, default) of every column.

    Keys of the table as a whole flag their columns, a UNIQUE only if it is of one column. With changes (see changes()) what ALTER and DROP do later in a script is folded in, in the
    script's order: columns are added, at the end, and dropped, keys set and dropped, tables dropped.
    """
    made = tables_.select("database_name", "table_name", "script", "nth", F.posexplode("items").alias("k", "item"))
    plain = made.filter(~F.col("item").rlike(_OTHER) & (_extract(F.col("item"), _RULE, 2) == "")).select("database_name", "table_name", "script", "nth", (F.col("k") + 1).alias("position"), *_facts(F.col("item")))
    keys = made.filter(_extract(F.col("item"), _RULE, 2) != "").select("table_name", "script", "nth", _plain(_extract(F.col("item"), _RULE, 1)).alias("rule"), _extract(F.col("item"), _RULE, 2).alias("definition"))
    place = F.struct("script", "nth")
    if changes_ is not None:
        at = F.struct(F.col("script").alias("script"), F.col("nth").alias("nth"))
        gone = changes_.filter("action = 'drop table'").groupBy("table_name").agg(F.max(at).alias("gone"))
        new = changes_.filter("action = 'add column'").select("database_name", "table_name", "script", "nth", (F.col("k") + 10_000).alias("position"), *_facts(F.col("definition")))
        dropped = changes_.filter("action = 'drop column'").groupBy("table_name", "name").agg(F.max(at).alias("dropped"))
        lost = changes_.filter("action = 'drop constraint'").groupBy("table_name", F.col("name").alias("rule")).agg(F.max(at).alias("lost"))
        plain = plain.unionByName(new).join(gone, "table_name", "left").join(dropped, ["table_name", "name"], "left")
        plain = plain.filter(F.coalesce(place > F.col("gone"), F.lit(True)) & F.coalesce(place > F.col("dropped"), F.lit(True))).drop("gone", "dropped")
        rank = F.row_number().over(Window.partitionBy("table_name").orderBy("script", "nth", "position"))
        plain = plain.withColumn("position", F.when(F.col("position") >= 10_000, rank).otherwise(F.col("position")))
        keys = keys.unionByName(changes_.filter("action = 'add constraint'").select("table_name", "script", "nth", F.col("name").alias("rule"), "definition"))
        keys = keys.join(gone, "table_name", "left").join(lost, ["table_name", "rule"], "left")
        keys = keys.filter(F.coalesce(place > F.col("gone"), F.lit(True)) & F.coalesce(place > F.col("lost"), F.lit(True)))
    flags = keys.select("table_name", F.upper("definition").alias("u"), _listed(F.col("definition")).alias("of"))
    primary = F.col("u").startswith("PRIMARY")
    flags = flags.filter(primary | (F.col("u").startswith("UNIQUE") & (F.size("of") == 1))).select("table_name", F.explode("of").alias("name"), primary.alias("p"))
    flags = flags.groupBy("table_name", "name").agg(F.bool_or("p").alias("p"), F.bool_or(~F.col("p")).alias("u"))
    out = plain.join(flags, ["table_name", "name"], "left")
    key, one = F.coalesce("p", F.lit(False)), F.coalesce("u", F.lit(False))
    return out.select("database_name", "table_name", F.col("position").cast("int").alias("position"), "name", "data_type", (F.col("nullable") & ~key).alias("nullable"), (F.col("unique") | one).alias("unique"), (F.col("primary_key") | key).alias("primary_key"), "default")


def indexes(files: DataFrame, text_col: str = "value", path_col: str = "file_path") -> DataFrame:
    """(table_name, name, type, columns): UNIQUE or B-tree."""
    path = path_col if path_col in files.columns else None
    rows = files if path else files.withColumn(path_col, F.lit(""))
    hits = statements(rows, path_col, text_col).filter(F.col("text").rlike(_INDEX))
    x = F.col("text")
    return hits.select(_last(_extract(x, _INDEX, 3)).alias("table_name"), _last(_extract(x, _INDEX, 2)).alias("name"), F.when(_extract(x, _INDEX, 1) != "", "UNIQUE").otherwise("B-tree").alias("type"), F.transform(_parts(_extract(x, _INDEX, 4), 1), _plain).alias("columns"))


def changes(files: DataFrame, path_col: str = "file_path", text_col: str = "value") -> DataFrame:
    """(database_name, table_name, script, nth, k, action, name, definition): what ALTER TABLE and DROP TABLE do, one row per action: add or drop column, add or drop constraint, drop table."""
    held = statements(files, path_col, text_col)
    drops = held.withColumn("of", _extract(F.col("text"), _DROP, 1)).filter("of <> ''")
    none = F.lit(None).cast("string")
    drops = drops.select("database_name", _last(F.col("of")).alias("table_name"), "script", "nth", F.lit(0).alias("k"), F.lit("drop table").alias("action"), none.alias("name"), none.alias("definition"))
    alters = held.withColumn("of", _extract(F.col("text"), _ALTER, 1)).filter("of <> ''").select("database_name", _last(F.col("of")).alias("table_name"), "script", "nth", F.posexplode(_parts(_extract(F.col("text"), _ALTER, 2), 0)).alias("k", "x"))
    x = F.col("x")
    rule, added = _extract(x, r"(?is)^ADD\s+(.*)$"), r"(?is)^ADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?(.*)$"
    named = rule.rlike(_RULE)
    lost = rf"(?is)^DROP\s+(CONSTRAINT|INDEX|KEY|COLUMN|PRIMARY)?\s*(?:IF\s+EXISTS\s+)?({_PART})"
    kind = F.upper(_extract(x, lost, 1))
    action = F.when(named, "add constraint").when(x.rlike(added) & ~_extract(x, added).rlike(_OTHER), "add column").when(kind.isin("CONSTRAINT", "INDEX", "KEY"), "drop constraint").when(kind.isin("COLUMN", "") & x.rlike(lost), "drop column")
    name = F.when(named, _plain(_extract(rule, _RULE, 1))).when(x.rlike(lost), _plain(_extract(x, lost, 2))).when(x.rlike(added), _plain(_extract(_extract(x, added), rf"^({_PART})")))
    definition = F.when(named, _extract(rule, _RULE, 2)).when(x.rlike(added), _extract(x, added))
    return drops.unionByName(alters.select("database_name", "table_name", "script", "nth", "k", action.alias("action"), name.alias("name"), definition.alias("definition")).filter("action is not null"))


def constraints(files: DataFrame, path_col: str = "file_path", text_col: str = "value", column_level: bool = False) -> DataFrame:
    """(table_name, name, type, definition, ref_table, source, columns, ref_columns) of the constraints in table bodies and of ALTER together; name is null where none is given.

    A column's own PRIMARY KEY, UNIQUE, CHECK and REFERENCES count if they are named, with column_level also without a name.
    """
    alters = changes(files, path_col, text_col).filter("action = 'add constraint'").select("table_name", "name", F.trim("definition").alias("definition"), F.lit("alter").alias("source"), F.lit(None).cast("string").alias("own"))
    items = tables(files, path_col, text_col).select("table_name", F.explode("items").alias("x"))
    x = F.col("x")
    whole = items.filter(_extract(x, _RULE, 2) != "").select("table_name", _plain(_extract(x, _RULE, 1)).alias("name"), _extract(x, _RULE, 2).alias("definition"), F.lit("inline").alias("source"), F.lit(None).cast("string").alias("own"))
    own = items.filter((_extract(x, _RULE, 2) == "") & ~x.rlike(_OTHER))
    column = _plain(_extract(x, rf"^({_PART})"))
    named = own.filter(x.rlike(_INLINE)).select("table_name", _plain(_extract(x, _INLINE, 1)).alias("name"), strip(_extract(x, _INLINE, 2)).alias("definition"), F.lit("inline").alias("source"), column.alias("own"))
    parts = [alters, whole, named]
    if column_level:
        bare = r"(?is)\b(PRIMARY\s+KEY|UNIQUE|CHECK\s*\(.*\)|REFERENCES\s+.*)"
        hits = own.filter(~x.rlike(_INLINE)).select("table_name", F.explode(F.regexp_extract_all(x, F.lit(bare), F.lit(1))).alias("definition"), column.alias("own"))
        parts.append(hits.select("table_name", F.lit("").alias("name"), F.trim("definition").alias("definition"), F.lit("column").alias("source"), "own"))
    both = reduce(DataFrame.unionByName, parts)
    d = F.col("definition")
    refers = rf"(?is)\bREFERENCES\s+{_NAME}\s*(.*)$"
    kind = F.when(d.rlike(r"(?i)^REFERENCES\b"), "FOREIGN KEY").otherwise(constraint_type(d))
    of = F.when(d.rlike(r"(?i)^(PRIMARY|FOREIGN|UNIQUE)") & d.contains("("), _listed(d)).when(F.col("own").isNotNull(), F.array("own")).otherwise(F.array().cast("array<string>"))
    return both.select("table_name", F.nullif("name", F.lit("")).alias("name"), kind.alias("type"), "definition", F.nullif(_last(_extract(d, refers)), F.lit("")).alias("ref_table"), "source", of.alias("columns"), F.when(d.rlike(refers), _listed(_extract(d, refers, 2))).otherwise(F.array().cast("array<string>")).alias("ref_columns"))
