"""Joins that derive edges and look up facts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..tables import by_key, materialize


def methods_of_classes(classes: DataFrame, methods: DataFrame) -> DataFrame:
    return methods.join(classes.select("project", F.col("name").alias("class_name"), "sub_type"), ["project", "class_name"])


def link_methods_to_sql(methods: DataFrame, statements: DataFrame) -> DataFrame:
    """(project, class_name, method, mapper_name, sql_id): mapper and repository methods run the statement of their name and class."""
    mappers = methods.filter(F.col("class_name").rlike("(Repository|Mapper)$"))
    keys = statements.select("project", "mapper_name", F.col("id").alias("sql_id")).distinct()
    same = (mappers.project == keys.project) & (mappers.class_name == keys.mapper_name) & (mappers.name == keys.sql_id)
    return mappers.join(keys, same).select(mappers.project, "class_name", F.col("name").alias("method"), "mapper_name", "sql_id")


def fallback_sql(methods: DataFrame, linked: DataFrame, statements: DataFrame) -> DataFrame:
    """Statements by name for methods without a linked one, under the class's full or simple name; linked rows first."""
    key = ["project", "class_name", "method"]
    open_ = methods.select("project", "class_name", F.col("name").alias("method")).distinct().join(linked, key, "left_anti")
    found = statements.select(F.col("project").alias("p"), "mapper_name", F.col("id").alias("sql_id")).distinct()
    fits = (found.p == open_.project) & (found.sql_id == open_.method) & (N.simple_name(open_.class_name) == N.simple_name(found.mapper_name))
    extra = open_.join(found, fits).select(*key, "mapper_name", "sql_id", F.lit("fallback").alias("via"))
    return linked.select(*key, "mapper_name", "sql_id", F.lit("edge").alias("via")).unionByName(extra)


def missing(referenced: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The referenced keys that do not exist."""
    return referenced.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")


def schema_of_tables(tables: DataFrame) -> DataFrame:
    """(table_name, schema): one schema per name, the smallest."""
    return tables.groupBy(F.col("name").alias("table_name")).agg(F.min("schema").alias("schema"))


def with_schema(rows: DataFrame, tables: DataFrame, default: str = "unknown") -> DataFrame:
    """rows with the schema of their table_name; the join broadcasts the dictionary if its size allows."""
    return rows.join(schema_of_tables(tables), "table_name", "left").fillna({"schema": default})


def test_classes_of(classes: DataFrame, tests: DataFrame) -> DataFrame:
    """(class_name, test_class, method_count): the first existing of CTest, CTests and TestC; null where none exists."""
    c = F.col("name")
    names = F.array(F.concat(c, F.lit("Test")), F.concat(c, F.lit("Tests")), F.concat(F.lit("Test"), c))
    tried = classes.select(F.col("name").alias("class_name"), F.posexplode(names).alias("nth", "candidate"))
    found = tried.join(tests.select(F.col("name").alias("candidate"), "method_count"), "candidate")
    first = found.groupBy("class_name").agg(F.min(F.struct("nth", "candidate", "method_count")).alias("t"))
    return classes.select(F.col("name").alias("class_name")).distinct().join(first, "class_name", "left").select("class_name", F.col("t.candidate").alias("test_class"), F.col("t.method_count").alias("method_count"))


def class_by_name(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Classes named by simple or full name (column wanted): an equi join on the simple name, then a check of the package."""
    asked = wanted.select("wanted", N.simple_name(F.col("wanted")).alias("name"), N.package_of(F.col("wanted")).alias("in_package"))
    return asked.join(classes, "name").filter(F.col("in_package").isNull() | (F.col("package_name") == F.col("in_package"))).drop("in_package")


def package_of_callees(calls: DataFrame, classes: DataFrame) -> DataFrame:
    """calls with dst_package filled from the callee's class in the same project, and from its outer class for inner ones; of several packages the first by name."""
    known = classes.groupBy("project", F.col("name").alias("outer")).agg(F.min("package_name").alias("outer_package"))
    rows = calls.withColumn("outer", N.outer_class(F.col("dst_class"))).join(known, ["project", "outer"], "left")
    return rows.withColumn("dst_package", F.coalesce(F.nullif("dst_package", F.lit("")), "outer_package")).drop("outer", "outer_package")


def beans_of(classes: DataFrame) -> DataFrame:
    names = F.transform("annotations", lambda a: a["name"])
    scope = F.filter("annotations", lambda a: a["name"] == "Scope")
    rows = classes.select("project", N.bean_name(F.col("name")).alias("name"), N.bean_type(names).alias("type"), F.coalesce(F.when(F.size(scope) > 0, F.element_at(scope[0]["parameters"], "value")), F.lit("singleton")).alias("scope"), F.col("name").alias("class_name"), "package_name")
    return rows.filter(F.col("type").isNotNull())


def _annotated(col: Column, *names: str) -> Column:
    return F.exists(col, lambda a: a["name"].isin(*names))


def _implemented(classes: DataFrame) -> DataFrame:
    """(project, type, class_name, dist): every class under the simple name of each type it is, extends or implements, directly or through others; the nearest way counts."""
    at = classes.select("project", N.simple_name(F.col("name")).alias("type"), F.col("name").alias("class_name"), F.lit(0).alias("dist"))
    plain = lambda c: N.simple_name(F.regexp_replace(c, "<.*$", ""))
    supers = F.array_compact(F.concat(F.array("superclass"), F.coalesce("interfaces", F.array().cast("array<string>"))))
    step = materialize(classes.select("project", N.simple_name(F.col("name")).alias("type"), F.explode(supers).alias("up")).select("project", "type", plain(F.col("up")).alias("up")).filter("type <> up").distinct())
    found = at
    while True:
        nxt = at.join(by_key(step), ["project", "type"]).select("project", F.col("up").alias("type"), "class_name", (F.col("dist") + 1).alias("dist")).dropDuplicates(["project", "type", "class_name"])
        at = materialize(nxt.join(by_key(found.select("project", "type", "class_name")), ["project", "type", "class_name"], "left_anti"))
        if at.isEmpty():
            return found
        found = found.unionByName(at)


def bean_dependencies(beans: DataFrame, fields: DataFrame, methods: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(project, source_bean, target_bean, injection_type, member): one row per pair; setters count over constructors over fields.

    Fields need Autowired, Inject or Resource; constructors need nothing, their parameters' types are looked up; setters need Autowired, Inject or Resource.
    With classes a type also stands for the beans whose classes extend or implement it. Of several the one counts whose name a Qualifier, Named or Resource on the member gives, else
    the only one that is Primary, else the nearest class if there is one, else the one of the member's name; without any of these the place stays open. Lists, sets and maps of a type, Optional
    and ObjectProvider take what they hold: collections all beans of it. Fields with Value take no bean.
    """
    injected = ("Autowired", "Inject", "Resource")
    named = lambda c: F.get(F.transform(F.filter(c, lambda a: a["name"].isin("Qualifier", "Named", "Resource")), lambda a: F.coalesce(F.element_at(a["parameters"], "value"), F.element_at(a["parameters"], "name"))), F.lit(0))
    source = beans.select("project", "class_name", F.col("name").alias("source_bean"))
    by_field = fields.filter(_annotated(F.col("annotations"), *injected) & ~_annotated(F.col("annotations"), "Value")).select("project", "class_name", F.col("name").alias("member"), "type", F.lit(1).alias("phase"), F.lit("field").alias("injection_type"), F.col("name").alias("wish"), named(F.col("annotations")).alias("qualifier"))
    built = methods.select("project", "class_name", "name", "annotations", F.explode("parameters").alias("p"))
    by_constructor = built.filter(F.col("name") == N.simple_name(F.col("class_name"))).select("project", "class_name", F.col("p.name").alias("member"), F.col("p.type").alias("type"), F.lit(2).alias("phase"), F.lit("constructor").alias("injection_type"), F.col("p.name").alias("wish"), F.lit(None).cast("string").alias("qualifier"))
    by_setter = built.filter(F.col("name").startswith("set") & _annotated(F.col("annotations"), *injected)).select("project", "class_name", F.col("name").alias("member"), F.col("p.type").alias("type"), F.lit(3).alias("phase"), F.lit("setter").alias("injection_type"), F.col("p.name").alias("wish"), named(F.col("annotations")).alias("qualifier"))
    wanted = by_field.unionByName(by_constructor).unionByName(by_setter).join(by_key(source), ["project", "class_name"])
    holds = F.regexp_extract("type", r"^(?:\w+\.)*(List|Set|Collection|Map|Optional|ObjectProvider|Provider)\s*<(?:.*,)?\s*(?:\? extends )?([\w.]+)[^,]*>$", 1)
    inner = F.regexp_extract("type", r"^(?:\w+\.)*(List|Set|Collection|Map|Optional|ObjectProvider|Provider)\s*<(?:.*,)?\s*(?:\? extends )?([\w.]+)[^,]*>$", 2)
    wanted = wanted.withColumns({"all": holds.isin("List", "Set", "Collection", "Map"), "type": N.simple_name(F.when(holds != "", inner).otherwise(F.substring_index("type", "<", 1)))})
    target = beans.select("project", "class_name", F.col("name").alias("target_bean"))
    if classes is None:
        known = target.select("project", F.col("class_name").alias("type"), "target_bean", F.lit(0).alias("dist"), F.lit(False).alias("primary"))
    else:
        primary = classes.filter(_annotated(F.col("annotations"), "Primary")).select("project", F.col("name").alias("class_name"), F.lit(True).alias("p")).distinct()
        known = _implemented(classes).join(by_key(target), ["project", "class_name"]).join(by_key(primary), ["project", "class_name"], "left").select("project", "type", "target_bean", "dist", F.coalesce("p", F.lit(False)).alias("primary"))
    pairs = wanted.join(by_key(known), ["project", "type"]).filter("source_bean <> target_bean")
    pairs = pairs.groupBy("project", "source_bean", "target_bean", "phase", "injection_type", "member", "type", "wish", "qualifier", "all").agg(F.min("dist").alias("dist"), F.max("primary").alias("primary"))
    place = Window.partitionBy("project", "source_bean", "phase", "member", "type")
    asked = F.lower("target_bean") == F.lower("qualifier")
    rank = F.when(asked, 0).when(F.col("qualifier").isNotNull() & (F.max(asked.cast("int")).over(place) == 1), 9).when(F.col("primary"), 1).when(F.col("dist") == 0, 2).when(F.col("target_bean") == F.col("wish"), 3).otherwise(4)
    pairs = pairs.withColumn("rank", rank).withColumn("best", F.min("rank").over(place))
    pairs = pairs.withColumn("alike", F.count_if(F.col("rank") == F.col("best")).over(place))
    pairs = pairs.filter(F.col("all") & (F.col("rank") < 9) | (F.col("rank") == F.col("best")) & (F.col("alike") == 1))
    last = F.max_by(F.struct("injection_type", "member"), F.struct("phase", "member")).alias("x")
    return pairs.groupBy("project", "source_bean", "target_bean").agg(last).select("project", "source_bean", "target_bean", "x.*")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by an order that must be total for a stable choice."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


@dataclass
class Branch:
    """Rows that an optional match may find: keys says which column of the matched rows equals which of df; counts and lists name results and the columns they are of."""

    df: DataFrame
    keys: dict[str, str]
    counts: dict[str, str] = field(default_factory=dict)
    lists: dict[str, str] = field(default_factory=dict)


def optional_match(rows: DataFrame, branches: list[Branch]) -> DataFrame:
    """rows with what each branch finds for them: counts of different values, and lists of different values in order, joined by commas; 0 and empty where it finds nothing.

    Every branch is grouped by its own keys before it is joined, with partial aggregation, so rows never multiply and branches do not multiply each other.
    """
    for k, b in enumerate(branches):
        aggs = [F.count_distinct(F.col(c)).alias(out) for out, c in b.counts.items()]
        aggs += [F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ",").alias(out) for out, c in b.lists.items()]
        own = {key: f"__{k}_{key}" for key in b.keys}
        per = b.df.groupBy(*[F.col(c).alias(own[key]) for key, c in b.keys.items()]).agg(*aggs)
        same = reduce(lambda x, y: x & y, [F.col(key) == F.col(name) for key, name in own.items()])
        filled = {out: F.coalesce(out, F.lit(0)) for out in b.counts} | {out: F.coalesce(out, F.lit("")) for out in b.lists}
        rows = rows.join(per, same, "left").drop(*own.values()).withColumns(filled)
    return rows
