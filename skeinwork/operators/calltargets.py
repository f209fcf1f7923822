"""What the calls of parsed classes lead to: types of names, members by inheritance and results of calls, all found by joins.

A type is known by its id, package and path of names. Texts of types are looked up in the context of the class they stand in: its own and outer classes, its
imports, its package. Calls wait for what they are called on: those on names and on the class itself are ready at once, those on results of
calls a round after these, so a round settles one link of every chain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..tables import materialize

#: Types that are no class.
_PRIMITIVE = ("int", "long", "double", "float", "boolean", "char", "byte", "short", "void", "var", "constructor", "")
_KEY = ["tid", "n", "site"]


def _first(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """keys and the columns to keep of the row that comes first."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("x")).select(*keys, "x.*")


def _types(parsed: DataFrame) -> DataFrame:
    tid = F.concat_ws(":", F.coalesce("package_name", F.lit("")), "name")
    full = F.when(F.coalesce("package_name", F.lit("")) == "", F.col("name")).otherwise(F.concat_ws(".", "package_name", "name"))
    picked = parsed.select(tid.alias("tid"), full.alias("full"), "package_name", "name", "superclass", "interfaces", "imports", "fields", "methods", "locals", "sites", "file_path")
    # of types of one name the first by file counts
    return materialize(picked.withColumn("k", F.row_number().over(Window.partitionBy("tid").orderBy("file_path"))).filter("k = 1").drop("k", "file_path"))


def _resolved(types: DataFrame, texts: DataFrame) -> DataFrame:
    """(tid, text, r_tid, r_package, r_class) of texts of types (tid, text); r_tid is null for types that are not among these, and such a type is taken to be of its import's package or of the caller's."""
    base = F.regexp_extract("text", r"^([\w$]+(?:\.[\w$]+)*)", 1)
    asked = texts.distinct().withColumn("base", base).filter(~F.col("base").isin(*_PRIMITIVE))
    asked = asked.join(types.select("tid", "package_name", "name", "imports"), "tid")
    head, path = F.substring_index("base", ".", 1), F.split("name", r"\.")
    imported = F.filter("imports", lambda i: F.substring_index(i, ".", -1) == head)
    dotted = lambda a, b: F.when(a == "", b).otherwise(F.concat_ws(".", a, b))
    package = F.coalesce("package_name", F.lit(""))
    inner = F.transform(F.sequence(F.size(path), F.lit(1), F.lit(-1)), lambda k: dotted(package, F.concat_ws(".", F.slice(path, 1, k), "base")))
    rest = F.expr("substring(base, length(substring_index(base, '.', 1)) + 1)")
    by_import = F.transform(imported, lambda i: F.concat(i, rest))
    wide = F.transform(F.filter("imports", lambda i: i.endswith(".*")), lambda i: F.concat(F.regexp_replace(i, r"\*$", ""), F.col("base")))
    tried = asked.withColumn("from_import", N.package_of(F.get(imported, F.lit(0)))).withColumn("candidates", F.concat(inner, by_import, F.array(dotted(package, F.col("base"))), wide, F.array("base")))
    known = types.select(F.col("full").alias("candidate"), F.struct(F.col("tid").alias("r_tid"), F.col("package_name").alias("r_package"), F.col("name").alias("r_class")).alias("r"))
    hits = tried.select("tid", "text", F.posexplode("candidates").alias("nth", "candidate")).join(known, "candidate")
    hits = hits.groupBy("tid", "text").agg(F.min_by("r", F.struct("nth", F.col("r.r_tid"))).alias("r"))
    out = tried.join(hits, ["tid", "text"], "left")
    # a lower-case first part of several is a package; one capital letter is a parameter of a type
    own = F.when(F.col("base").rlike(r"^[a-z].*\."), N.package_of(F.col("base"))).otherwise(F.col("package_name"))
    name = F.when(F.col("base").rlike(r"^[a-z].*\."), N.simple_name(F.col("base"))).otherwise(F.col("base"))
    missing = F.when(~F.col("base").rlike(r"^[A-Z]\d?$"), name)
    return materialize(out.select("tid", "text", F.col("r.r_tid").alias("r_tid"), F.coalesce("r.r_package", F.coalesce("from_import", own)).alias("r_package"), F.coalesce("r.r_class", missing).alias("r_class")).filter("r_class is not null"))


def ancestors(supers: DataFrame, types: DataFrame) -> DataFrame:
    """(tid, up, dist): every type and what it extends or implements, directly or through others; supers (tid, up). Circles end."""
    at = types.select("tid", F.col("tid").alias("up"), F.lit(0).alias("dist"))
    found, step = at, supers.select(F.col("tid").alias("at"), F.col("up").alias("over")).filter("at <> over").distinct()
    while True:
        nxt = at.join(step, at.up == step["at"]).select("tid", F.col("over").alias("up"), (F.col("dist") + 1).alias("dist")).dropDuplicates(["tid", "up"])
        at = materialize(nxt.join(found.select("tid", "up"), ["tid", "up"], "left_anti"))
        if at.isEmpty():
            return materialize(found)
        found = found.unionByName(at)


def _found_method(on: DataFrame, over: DataFrame, methods: DataFrame) -> DataFrame:
    """on (tid, n, site, on_tid, member, n_args) with the method found: m_tid and its result's text; the number of arguments decides first, then the nearest class."""
    hits = on.join(over.select(F.col("tid").alias("on_tid"), F.col("up").alias("m_tid"), "dist"), "on_tid").join(methods, ["m_tid", "member"])
    fit = F.when((F.col("n_args") < 0) | (F.col("n_args") == F.col("n_params")), 0).when(F.col("open_ended") & (F.col("n_args") >= F.col("n_params") - 1), 1).otherwise(2)
    return _first(hits.withColumn("fit", fit), _KEY, ["fit", "dist", "m_tid", "text"], ["m_tid", "text"])


def resolve_calls(parsed: DataFrame, project: str) -> DataFrame:
    """(project, src_package, src_class, src_method, dst_package, dst_class, dst_method, call_order, line_number, dst_kind) of the calls in parsed classes (java.parsed_classes).

    A call without anything before it goes to the class, super-class or outer class that declares the method, else to its own class. What stands before a call may be a local
    name (also var with a call or new), a parameter, a field (inherited ones too), a class, this, super, new, or the result of another call; overloads are told
    apart by their number of arguments. A class that is not among the parsed ones is named by its import or else the caller's package. Calls on names of unknown type
    (parameters of lambdas, results of foreign methods) lead nowhere and are left out, as are logger calls, and stream calls that no known class declares. call_order numbers the calls of a method that are left.
    """
    types = _types(parsed)
    fields = types.select("tid", F.explode("fields").alias("f")).select("tid", F.col("f.name").alias("name"), F.col("f.type").alias("text"))
    methods = types.select("tid", F.explode("methods").alias("m")).select("tid", "m.*")
    locals_ = types.select("tid", F.explode("locals").alias("l")).select("tid", "l.*")
    given = methods.select("tid", "n", F.explode("parameters").alias("p")).select("tid", "n", F.col("p.name").alias("name"), F.col("p.type").alias("type"), F.lit(None).cast("int").alias("init_site"), F.lit(-1).alias("pos"), F.lit(2**31 - 1).alias("until"))
    declared = locals_.unionByName(given)
    sites = materialize(types.select("tid", F.explode("sites").alias("s")).select("tid", "s.*"))
    parents = types.select("tid", F.explode(F.array_compact(F.concat(F.array("superclass"), "interfaces"))).alias("text"))
    texts = [parents, fields.select("tid", "text"), methods.select("tid", F.col("return_type").alias("text")), declared.select("tid", F.col("type").alias("text")), sites.filter("kind = 'new'").select("tid", F.col("member").alias("text")), sites.filter("on_kind in ('name', 'outer')").select("tid", F.col("on_name").alias("text"))]
    known = _resolved(types, reduce(DataFrame.unionByName, texts).filter("text is not null"))
    over = ancestors(parents.join(known, ["tid", "text"]).filter("r_tid is not null").select("tid", F.col("r_tid").alias("up")), types)

    # outer classes and what they extend come after the class's own line
    path = F.split("name", r"\.")
    outer = types.select("tid", "package_name", path.alias("path")).filter(F.size("path") > 1).select("tid", "package_name", "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("k"))
    outer = outer.select("tid", F.concat_ws(":", F.coalesce("package_name", F.lit("")), F.array_join(F.slice("path", 1, F.col("k")), ".")).alias("out"), (F.lit(1000) * (F.size("path") - F.col("k"))).alias("far"))
    around = outer.join(over.select(F.col("tid").alias("out"), "up", "dist"), "out").select("tid", "up", (F.col("dist") + F.col("far")).alias("dist"))
    within = materialize(over.unionByName(around).groupBy("tid", "up").agg(F.min("dist").alias("dist")))
    declares = materialize(methods.select(F.col("tid").alias("m_tid"), F.col("name").alias("member"), F.size("parameters").alias("n_params"), F.coalesce(F.get("parameters", F.size("parameters") - 1)["type"].endswith("..."), F.lit(False)).alias("open_ended"), F.col("return_type").alias("text")))
    own = types.select("tid", F.col("package_name").alias("own_package"), F.col("name").alias("own_class"))

    def target(tid: Column, package: Column, name: Column) -> list[Column]:
        return [tid.alias("on_tid"), package.alias("on_package"), name.alias("on_class")]

    rest = ["tid", "n", "site", "pos", "line", "kind", "member", "n_args", "on_kind", "on_name"]
    waits = F.lit(None).cast("int").alias("wait")
    # on the class itself, an outer one, its super-class, a fixed type
    plain = sites.filter("on_kind in ('none', 'this')").join(own, "tid").select(*rest, *target(F.col("tid"), F.col("own_package"), F.col("own_class")), waits)
    first_parent = types.select("tid", F.coalesce("superclass", F.lit("Object")).alias("text")).join(known, ["tid", "text"], "left").select("tid", F.col("r_tid").alias("p_tid"), F.coalesce("r_package", F.lit("java.lang")).alias("p_package"), F.coalesce("r_class", F.lit("Object")).alias("p_class"))
    above = sites.filter("on_kind = 'super'").join(first_parent, "tid").select(*rest, *target(F.col("p_tid"), F.col("p_package"), F.col("p_class")), waits)
    stream = F.col("on_name") == "System.out"
    fixed = sites.filter("on_kind = 'type'").select(*rest, *target(F.lit(None).cast("string"), F.when(stream, "java.io").otherwise("java.lang"), F.when(stream, "PrintStream").otherwise(F.col("on_name"))), waits)
    # on a name: the last declaration before it whose block it stands in, then fields, then classes
    named = sites.filter("on_kind in ('name', 'outer')")
    near = declared.select("tid", "n", F.col("name").alias("on_name"), F.col("type").alias("l_type"), "init_site", F.col("pos").alias("l_pos"), "until")
    seen = named.filter("on_kind = 'name'").join(near, ["tid", "n", "on_name"]).filter("l_pos <= pos and pos <= until")
    seen = seen.groupBy(*_KEY).agg(F.max_by(F.struct("l_type", "init_site"), "l_pos").alias("l"))
    held = named.filter("on_kind = 'name'").select(*_KEY, "on_name").join(within, "tid").join(fields.select(F.col("tid").alias("up"), F.col("name").alias("on_name"), "text"), ["up", "on_name"])
    held = _first(held, _KEY, ["dist", "up"], ["up", "text"]).withColumnsRenamed({"up": "f_tid", "text": "f_text"})
    named = named.join(seen, _KEY, "left").join(held, _KEY, "left")
    context = F.when(F.col("l").isNotNull(), F.col("tid")).when(F.col("f_tid").isNotNull(), F.col("f_tid")).otherwise(F.col("tid"))
    text = F.when(F.col("l").isNotNull(), F.col("l.l_type")).when(F.col("f_tid").isNotNull(), F.col("f_text")).when(F.col("on_name").rlike(r"^[A-Z]|\."), F.col("on_name"))
    named = named.withColumns({"c_tid": context, "c_text": text, "wait": F.col("l.init_site")})
    named = named.join(known.select(F.col("tid").alias("c_tid"), F.col("text").alias("c_text"), "r_tid", "r_package", "r_class"), ["c_tid", "c_text"], "left")
    named = named.select(*rest, *target(F.col("r_tid"), F.col("r_package"), F.col("r_class")), F.when(F.col("r_class").isNull(), F.col("wait")).alias("wait"))
    later = sites.filter("on_kind = 'site'").select(*rest, *target(*[F.lit(None).cast("string")] * 3), F.col("on_site").alias("wait"))
    made = sites.filter("kind = 'new'").join(known.withColumnRenamed("text", "member"), ["tid", "member"]).select(*_KEY, "r_tid", "r_package", "r_class")
    all_ = materialize(reduce(DataFrame.unionByName, [plain, above, fixed, named, later]).filter("kind <> 'new'"))

    waiting, ready = all_.filter("wait is not null"), all_.filter("on_class is not null").drop("wait")
    calls, typed = [], materialize(made)
    for turn in range(1 << 20):
        woken = waiting.drop("on_tid", "on_package", "on_class").join(typed.select("tid", "n", F.col("site").alias("wait"), *target(F.col("r_tid"), F.col("r_package"), F.col("r_class"))), ["tid", "n", "wait"]).drop("wait")
        ready = ready.unionByName(woken) if not turn else woken
        ready = materialize(ready)
        if ready.isEmpty():
            break
        # unqualified calls look around in outer classes too
        asked = ready.filter("kind <> 'field' and on_tid is not null").select(*_KEY, "on_tid", "member", "n_args", (F.col("on_kind") == "none").alias("bare"))
        hit = _found_method(asked.filter("not bare"), over, declares).unionByName(_found_method(asked.filter("bare"), within, declares))
        parts = ready.filter("kind = 'field' and on_tid is not null").select(*_KEY, "on_tid", "member").join(over.select(F.col("tid").alias("on_tid"), F.col("up").alias("m_tid"), "dist"), "on_tid")
        parts = _first(parts.join(fields.select(F.col("tid").alias("m_tid"), F.col("name").alias("member"), "text"), ["m_tid", "member"]), _KEY, ["dist", "m_tid"], ["m_tid", "text"])
        hit = hit.unionByName(parts)
        result = known.select(F.col("tid").alias("m_tid"), "text", "r_tid", "r_package", "r_class")
        hit = hit.join(own.select(F.col("tid").alias("m_tid"), F.col("own_package").alias("m_package"), F.col("own_class").alias("m_class")), "m_tid").join(result, ["m_tid", "text"], "left")
        done = materialize(ready.join(hit.drop("text"), _KEY, "left"))
        calls.append(done)
        typed = done.filter("r_class is not null").select(*_KEY, "r_tid", "r_package", "r_class")
    logged = (F.col("on_kind") == "name") & F.col("on_name").isin(*N.LOGGERS) & F.col("member").isin(*N.LOG_METHODS)
    foreign = F.col("m_tid").isNull() & F.col("member").isin(*N.STREAM_METHODS)
    if not calls:
        calls = [all_.drop("wait").withColumns({c: F.lit(None).cast("string") for c in ("m_tid", "m_package", "m_class", "r_tid", "r_package", "r_class")})]
    kept = reduce(DataFrame.unionByName, calls).filter(F.col("kind").isin("call", "ref") & F.col("on_class").isNotNull() & ~logged & ~foreign)
    kept = kept.join(methods.select("tid", "n", F.col("name").alias("src_method")), ["tid", "n"]).join(own, "tid")
    order = F.row_number().over(Window.partitionBy("tid", "n").orderBy("pos"))
    return kept.select(
        F.lit(project).alias("project"), F.col("own_package").alias("src_package"), F.col("own_class").alias("src_class"), "src_method", F.coalesce("m_package", "on_package").alias("dst_package"), F.coalesce("m_class", "on_class").alias("dst_class"),
        F.col("member").alias("dst_method"), order.cast("int").alias("call_order"), F.col("line").alias("line_number"), F.lit("METHOD").alias("dst_kind"),
    )
