"""Facts about SQL text as Column expressions: tables, joins, columns, parameters, complexity.

Patterns are regular expressions with ASCII word classes. ``strict=True`` keeps the narrower join and parameter patterns
that miss joins without an alias and read ``::type`` and clock times as parameters; the default reads joins with or
without an alias and does neither.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STOP = r"(?is)\s*\b(WHERE|ORDER\s+BY|GROUP\s+BY|HAVING|LIMIT|OFFSET|INNER\s+JOIN|LEFT\s+(OUTER\s+)?JOIN|RIGHT\s+(OUTER\s+)?JOIN|FULL\s+(OUTER\s+)?JOIN|OUTER\s+JOIN|CROSS\s+JOIN|JOIN|UNION)\b.*$"
TABLE = "struct<name:string,alias:string,schema:string>"
JOIN = "struct<kind:string,name:string,alias:string,schema:string,on:string>"


def strip_comments(sql: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", ""), r"--[^\n]*", "")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    """The text without white space of any kind around it."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean(sql: Column) -> Column:
    return collapse_whitespace(strip_comments(F.coalesce(sql, F.lit(""))))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _items(text: Column) -> Column:
    """The non-empty trimmed parts of a comma list."""
    return F.filter(F.transform(F.split(text, ",", -1), lambda x: strip(x)), lambda x: x != "")


def _extract(sql: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(sql, pattern, group)


def _named(text: Column, alias: Column) -> Column:
    """A table struct from schema.name; a name with two dots or more stays whole."""
    two = F.size(F.split(text, r"\.", -1)) == 2
    return F.struct(
        F.when(two, F.substring_index(text, ".", -1)).otherwise(text).alias("name"),
        F.when(alias != "", alias).alias("alias"),
        F.when(two, F.substring_index(text, ".", 1)).alias("schema"),
    )


def from_tables(sql: Column) -> Column:
    """Tables of the first FROM, comma-separated, up to the next clause or join."""
    body = F.regexp_replace(_extract(sql, r"(?is)\bFROM\s+(.*)$"), _STOP, "")

    def one(part: Column) -> Column:
        return _named(_extract(part, r"^([\w.]+)"), _extract(part, r"(?i)^[\w.]+\s+(?:AS\s+)?(\w+)"))

    return F.filter(F.transform(_items(body), one), lambda t: t["name"] != "")


def joins(sql: Column, strict: bool = False) -> Column:
    """Structs (kind, name, alias, schema, on) of JOIN clauses."""
    if strict:  # fixed value: the narrower form that strict=True promises
        pattern = r"(?is)(LEFT|RIGHT|INNER|OUTER|FULL)?\s*JOIN\s+([\w.]+)(?:\s+AS\s+|\s+)(\w+)?\s+ON\s+([^=]+=[^=]+)"
    else:
        pattern = r"(?is)(?:\b(LEFT|RIGHT|INNER|OUTER|FULL|CROSS)\s+)?(?:OUTER\s+)?\bJOIN\s+([\w.]+)(?:\s+(?:AS\s+)?(?!(?:ON|USING)\b)(\w+))?(?:\s+ON\s+([\w.]+\s*=\s*[\w.]+))?"

    def one(hit: Column) -> Column:
        kind, name, alias, on = (_extract(hit, pattern, k) for k in (1, 2, 3, 4))
        t = _named(name, alias)
        return F.struct(F.when(kind == "", "INNER").otherwise(F.upper(kind)).alias("kind"), t["name"].alias("name"), t["alias"].alias("alias"), t["schema"].alias("schema"), on.alias("on"))

    return F.transform(F.regexp_extract_all(sql, F.lit(pattern), F.lit(0)), one)


def tables(sql: Column, sql_type: Column, strict: bool = False, joined: Column | None = None) -> Column:
    """All tables a statement touches: FROM and JOIN for SELECT, the target for INSERT, UPDATE and DELETE. joined: joins(sql), if it is at hand."""

    def target(pattern: str) -> Column:
        return F.filter(F.array(_named(_extract(sql, pattern), F.lit(""))), lambda t: t["name"] != "")

    joined = F.transform(joins(sql, strict) if joined is None else joined, lambda j: F.struct(j["name"].alias("name"), j["alias"].alias("alias"), j["schema"].alias("schema")))

    def merged(t: Column) -> Column:
        return F.concat(t, F.filter(joined, lambda j: ~F.exists(t, lambda x: x["name"] == j["name"])))

    kind = F.upper(F.coalesce(sql_type, F.lit("SELECT")))
    return (
        F.when(kind == "INSERT", target(r"(?i)INSERT\s+INTO\s+([\w.]+)"))
        .when(kind == "UPDATE", target(r"(?i)UPDATE\s+([\w.]+)"))
        .when(kind == "DELETE", target(r"(?i)DELETE\s+FROM\s+([\w.]+)"))
        .otherwise(_let(from_tables(sql), merged))
    )


#: A query in brackets without brackets in it, and other brackets of the kind.
_INNER = r"(?is)\(\s*((?:SELECT|WITH)\b[^()]*)\)"
_BRACKETS = r"(?is)\((?!\s*(?:SELECT|WITH)\b)([^()]*)\)"
#: What can make a statement hold more than one scope.
_SCOPED = r"(?i)\(\s*SELECT\b|\b(?:UNION|INTERSECT|EXCEPT|MINUS)\b|^\s*WITH\b"
_SCOPED_CHANGE = r"(?is)\bSELECT\b|\bJOIN\b|\bUSING\b|\bSET\b.*\bFROM\b"
_SETS = r"(?i)\b(?:UNION(?:\s+ALL|\s+DISTINCT)?|INTERSECT|EXCEPT|MINUS)\b"


def scopes(sql: Column, levels: int = 10) -> Column:
    """The scopes of a statement, the outermost first: each part of a UNION and each query in brackets is one, with \u0001 where a query stood in it.

    Brackets are taken off from the innermost outwards, levels deep; those around no query become \u0002 and \u0003. Strings are emptied, since they may hold brackets and words of SQL.
    """
    kind = "struct<text:string,found:array<string>>"

    def peel(acc: Column, _: Column) -> Column:
        masked = F.regexp_replace(acc["text"], _BRACKETS, "\u0002$1\u0003")
        return F.struct(F.regexp_replace(masked, _INNER, "\u0001").alias("text"), F.concat(F.regexp_extract_all(masked, F.lit(_INNER), F.lit(1)), acc["found"]).alias("found")).cast(kind)

    start = F.struct(F.regexp_replace(sql, "'(?:[^']|'')*'", "''").alias("text"), F.array().cast("array<string>").alias("found")).cast(kind)
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, peel, lambda acc: F.flatten(F.transform(F.concat(F.array(acc["text"]), acc["found"]), lambda s: F.split(s, _SETS, -1))))


def _scope_tables(scope: Column) -> Column:
    """Tables that a scope reads: of its FROM, USING and JOINs; brackets right behind FROM or JOIN are opened, others left out."""
    text = F.regexp_replace(scope, "(?i)\\b(FROM|JOIN|USING)\\s*\u0002([^\u0002\u0003]*)\u0003", "$1 $2")
    for _ in range(3):
        text = F.regexp_replace(text, "\u0002[^\u0002\u0003]*\u0003", " ")
    text = F.regexp_replace(text, r"(?is)^\s*DELETE\s+FROM\b(.*?)\bUSING\b", "DELETE $1 FROM")
    joined = F.transform(joins(text), lambda j: F.struct(j["name"].alias("name"), j["alias"].alias("alias"), j["schema"].alias("schema")))
    return F.filter(F.concat(from_tables(text), joined), lambda t: ~t["name"].rlike(r"(?i)^(?:SELECT|LATERAL|UNNEST|VALUES|SET)$"))


def scoped_tables(held: Column, target: Column) -> Column:
    """All tables of a statement by its scopes (held: scopes(sql)), each name once, the target (an array of none or one) first; names that WITH gives are no tables."""
    given = "(?i)(?:\\bWITH\\s+(?:RECURSIVE\\s+)?|,\\s*)(\\w+)\\s*(?:\u0002[^\u0003]*\u0003\\s*)?AS\\s*(?:(?:NOT\\s+)?MATERIALIZED\\s*)?\u0001"
    ctes = F.transform(F.flatten(F.transform(held, lambda s: F.regexp_extract_all(s, F.lit(given), F.lit(1)))), lambda x: F.lower(x))

    def once(all_: Column) -> Column:
        names = F.transform(all_, lambda t: F.lower(F.concat_ws(".", t["schema"], t["name"])))
        return F.filter(all_, lambda t, k: F.array_position(names, F.lower(F.concat_ws(".", t["schema"], t["name"]))) == k + 1)

    read = F.flatten(F.transform(held, _scope_tables))
    read = F.filter(read, lambda t: ~(t["schema"].isNull() & F.array_contains(ctes, F.lower(t["name"]))))
    # a target's own name among those read is the target
    return _let(F.concat(target, F.filter(read, lambda t: ~F.exists(target, lambda x: F.lower(x["name"]) == F.lower(t["name"])))), once)


def _own_columns(scope: Column) -> Column:
    """The select list of a scope without the queries in it."""
    return F.filter(select_columns(F.translate(scope, "\u0002\u0003", "()")), lambda c: ~c["name"].contains("\u0001"))


def _scope_columns(scope: Column) -> Column:
    """Entries (name of a table, its columns) of a scope's select list."""
    return _let(_scope_tables(scope), lambda held: F.map_entries(_columns_by_table(held, _own_columns(scope))))


def _merged(entries: Column) -> Column:
    """A map of entries in which a table may come more than once."""
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.array_distinct(F.flatten(F.transform(F.filter(entries, lambda e: e["key"] == n), lambda e: e["value"]))))))


def select_columns(sql: Column) -> Column:
    """Structs (name, table) of the select list; a naive comma split, the alias dropped."""

    def one(part: Column) -> Column:
        body = strip(F.regexp_replace(part, r"(?i)^(.*?)(?:\s+AS\s+|\s+)\w+$", "$1"))
        dotted = F.instr(body, ".") > 0
        return F.struct(
            F.when(dotted, F.substring(body, F.instr(body, ".") + 1, F.length(body))).otherwise(body).alias("name"),
            F.when(dotted, F.substring_index(body, ".", 1)).alias("table"),
        )

    return F.transform(_items(_extract(sql, r"(?is)SELECT\s+(.*?)\s+FROM\b")), one)


def written_columns(sql: Column, sql_type: Column) -> Column:
    """Column names in INSERT (…) VALUES or left of = in UPDATE … SET … WHERE; an UPDATE without WHERE has none."""
    kind = F.upper(sql_type)
    insert = _items(_extract(sql, r"(?is)\((.*?)\)\s*VALUES"))
    insert = F.when(F.size(insert) > 0, insert).otherwise(_items(_extract(sql, r"(?is)^\s*INSERT\s+INTO\s+[\w.]+\s*\(([^()]*)\)\s*\(?\s*(?:SELECT|WITH)\b")))
    update = F.transform(_items(_extract(sql, r"(?is)SET\s+(.*?)\s+WHERE\b")), lambda x: strip(F.substring_index(x, "=", 1)))
    return F.when(kind == "INSERT", insert).when(kind == "UPDATE", update).otherwise(F.array().cast("array<string>"))


def clause(sql: Column, keyword: str) -> Column:
    """The body of a clause as an array of none or one."""
    body = _extract(sql, rf"(?is)\b{keyword}\s+(.*?)(?:\s+GROUP\s+BY\b|\s+ORDER\s+BY\b|\s+HAVING\b|\s+LIMIT\b|\s+OFFSET\b|$)")
    return F.filter(F.array(strip(body)), lambda x: x != "")


def clause_columns(sql: Column, keyword: str) -> Column:
    return F.flatten(F.transform(clause(sql, keyword), lambda x: _items(x)))


def subqueries(sql: Column) -> Column:
    return F.regexp_extract_all(sql, F.lit(r"(?is)\((\s*SELECT .*?)\)"), F.lit(1))


def parameters(sql: Column, strict: bool = False) -> Column:
    """#{name}, :name and the count of ? as one entry ?xN."""
    hashes = F.regexp_extract_all(sql, F.lit(r"#\{([^}]+)\}"), F.lit(1))
    named = F.regexp_extract_all(sql, F.lit(r":(\w+)" if strict else r"(?<![:\w]):([A-Za-z_]\w*)"), F.lit(1))
    marks = F.regexp_count(sql, F.lit(r"\?"))
    return F.concat(F.when(marks > 0, F.array(F.concat(F.lit("?x"), marks.cast("string")))).otherwise(F.array().cast("array<string>")), hashes, named)


def complexity(sql: Column, sql_type: Column | None = None, strict: bool = False) -> Column:
    """1 + tables + joins + subqueries + where + group columns + order columns + having."""
    kind = F.lit("SELECT") if sql_type is None else sql_type
    n = 1 + F.size(tables(sql, kind, strict)) + F.size(joins(sql, strict)) + F.size(subqueries(sql)) + F.size(clause(sql, "WHERE"))
    return n + F.size(clause_columns(sql, r"GROUP\s+BY")) + F.size(clause_columns(sql, r"ORDER\s+BY")) + F.size(clause(sql, "HAVING"))


def complexity_level(score: Column) -> Column:
    return F.when(score <= 3, "simple").when(score <= 7, "medium").when(score <= 12, "complex").otherwise("very_complex")


def _marks(n_joins: Column, n_subqueries: Column, where: Column, n_group: Column, n_order: Column) -> Column:
    conditions = F.size(F.flatten(F.transform(where, lambda w: F.split(w, r"(?i)\s+(?:AND|OR)\s+", -1))))
    marks = [(n_joins > 3, "multiple_joins"), (n_subqueries > 0, "subqueries"), (conditions > 5, "complex_where"), (n_group > 0, "grouping"), (n_order > 3, "complex_ordering")]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in marks]))


def characteristics(sql: Column, strict: bool = False) -> Column:
    sizes = F.size(joins(sql, strict)), F.size(subqueries(sql))
    return _marks(*sizes, clause(sql, "WHERE"), F.size(clause_columns(sql, r"GROUP\s+BY")), F.size(clause_columns(sql, r"ORDER\s+BY")))


def recommendations(found: Column) -> Column:
    """Advice for the characteristics of a statement."""
    advice = {"multiple_joins": "check indexes on join keys", "subqueries": "consider joins instead", "complex_where": "simplify the WHERE clause"}
    return F.array_compact(F.array(*[F.when(F.array_contains(found, k), F.lit(v)) for k, v in advice.items()]))


def _columns_by_table(held: Column, columns_: Column) -> Column:
    def entry(t: Column) -> Column:
        mine = F.filter(columns_, lambda c: c["table"].isNull() | (c["table"] == t["name"]) | (c["table"] == t["alias"]))
        return F.struct(t["name"], F.array_distinct(F.transform(mine, lambda c: c["name"])))

    names = F.transform(held, lambda t: t["name"])
    first = F.transform(held, lambda t, k: F.when(F.array_position(names, t["name"]) == k + 1, entry(t)))
    return F.map_from_entries(F.filter(first, lambda e: e.isNotNull()))


def table_columns(sql: Column, sql_type: Column) -> Column:
    """table -> column names, read or written; a column without a table counts for every table. Aliases resolve to their tables."""
    return _let(tables(sql, sql_type), lambda held: _let(columns(sql, sql_type, held), lambda c: _columns_by_table(held, c)))


def columns(sql: Column, sql_type: Column, held: Column) -> Column:
    """Structs (name, table): the select list of a SELECT, the written columns of an INSERT or UPDATE with their table; held: tables(sql, sql_type)."""
    kind = F.upper(F.coalesce(sql_type, F.lit("SELECT")))
    target = F.when(F.size(held) > 0, held[0]["name"])
    written = F.transform(written_columns(sql, kind), lambda c: F.struct(c.alias("name"), target.alias("table")))
    none = F.array().cast("array<struct<name:string,table:string>>")
    return F.when(kind == "SELECT", select_columns(sql)).when(kind.isin("INSERT", "UPDATE"), written).otherwise(none)


def analyse(df, sql_col: str = "sql_content", type_col: str = "sql_type"):
    """df with sql_clean, tables, written, joins, columns, table_columns, parameters, complexity_score, complexity_level, characteristics and recommendations.

    tables are those of all scopes, of queries in brackets, parts of a UNION, INSERT ... SELECT, UPDATE ... FROM and JOIN, DELETE ... USING; written is the one of them that a change writes. In table_columns every scope gives
    its select list to its own tables. The score counts the outermost tables alone.

    Joins, subqueries, groups, orders and HAVING are read of a SELECT (which a null type counts as), WHERE also of an UPDATE or DELETE, columns of a SELECT, INSERT or UPDATE.
    Other types have no facts but their text. Null or empty SQL has empty lists and a score of 1.
    """
    df = df.withColumn("sql_clean", clean(F.col(sql_col)))
    sql, kind = F.col("sql_clean"), F.upper(F.coalesce(F.col(type_col), F.lit("SELECT")))
    select, known = kind == "SELECT", kind.isin("SELECT", "INSERT", "UPDATE", "DELETE")

    def of(test: Column, value: Column, kind: str = "string") -> Column:
        return F.when(test, value).otherwise(F.array().cast(f"array<{kind}>"))

    # Each list is made once, in a step of its own; the score and the marks only count what is there.
    parts = {"__sub": subqueries(sql), "__group": clause_columns(sql, r"GROUP\s+BY"), "__order": clause_columns(sql, r"ORDER\s+BY"), "__having": clause(sql, "HAVING")}
    lists = {"joins": of(select, joins(sql), JOIN), "parameters": of(known, parameters(sql)), "__where": of(known & (kind != "INSERT"), clause(sql, "WHERE")), **{name: of(select, x) for name, x in parts.items()}}
    df = df.withColumns(lists).withColumn("__own", of(known, tables(sql, kind, joined=F.col("joins")), TABLE))
    many = known & sql.rlike(_SCOPED) | known & ~select & sql.rlike(_SCOPED_CHANGE)
    df = df.withColumn("__scopes", F.when(many, scopes(sql)))
    target = F.when(select, F.array().cast(f"array<{TABLE}>")).otherwise(F.col("__own"))
    df = df.withColumn("tables", F.when(F.col("__scopes").isNull(), F.col("__own")).otherwise(scoped_tables(F.col("__scopes"), target)))
    # what a scope's tables give to its own select list; of a change the written columns come first
    first = F.when(select & F.col("__scopes").isNotNull(), _scope_tables(F.col("__scopes")[0])).otherwise(F.col("__own"))
    df = df.withColumns({"__first": first, "columns": F.when(select & F.col("__scopes").isNotNull(), _own_columns(F.col("__scopes")[0])).otherwise(columns(sql, kind, F.col("__own")))})
    n = {c: F.size(c) for c in ("__own", "joins", "__sub", "__where", "__group", "__order", "__having")}
    marks = _marks(n["joins"], n["__sub"], F.col("__where"), n["__group"], n["__order"])
    df = df.withColumns({"table_columns": F.when(F.col("__scopes").isNull(), _columns_by_table(F.col("__own"), F.col("columns"))).otherwise(_let(F.concat(F.map_entries(_columns_by_table(F.col("__first"), F.col("columns"))), F.flatten(F.transform(F.when(select, F.slice("__scopes", 2, 10_000)).otherwise(F.col("__scopes")), _scope_columns))), _merged)), "written": F.when(known & ~select, F.get("__own", F.lit(0))["name"]), "complexity_score": sum(n.values(), F.lit(1)), "characteristics": marks})
    df = df.withColumns({"complexity_level": complexity_level(F.col("complexity_score")), "recommendations": recommendations(F.col("characteristics"))})
    return df.drop("__own", "__scopes", "__first", *[c for c in lists if c.startswith("__")])
