"""From a source tree to tables, and from tables to answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import ddl, sqlmeta
from .functions import names as N
from .operators import audit, calltargets, classspec, crud, impact, jpa, linkage, reach, stats, summary, traverse, upsert
from .schema import KEYS
from .sources import config, files, java, manifest, mapper_xml
from .store import Store
from .tables import materialize


def read_sources(spark: SparkSession, source: str, ddl_folder: str | None = None, rule: str | None = None, states: DataFrame | None = None, before: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The rows of every source file by kind: raw_java, raw_mapper, raw_config, raw_ddl. With states and before (see refresh()) only files that differ are parsed, the rows of the others are taken over."""

    def of(name: str, found: DataFrame, parse) -> DataFrame:
        if states is None:
            return parse(found)
        new = parse(manifest.fresh(found, states))
        return manifest.kept(before[name], states).unionByName(new) if name in before else new

    def values(found: DataFrame) -> DataFrame:
        return config.yaml_values(found).unionByName(files.properties(found))

    raw = {
        "raw_java": of("raw_java", files.java_files(spark, source), lambda found: java.parsed_classes(found, rule)),
        "raw_mapper": of("raw_mapper", files.mapper_files(spark, source), mapper_xml.mapper_rows),
        "raw_config": of("raw_config", files.config_files(spark, source), values),
    }
    if ddl_folder:
        raw["raw_ddl"] = of("raw_ddl", files.ddl_files(spark, ddl_folder), lambda found: found)
    return raw


def statements(tables: dict[str, DataFrame], mappers: DataFrame, project: str) -> DataFrame:
    """The analysed statements of mapper files and of mapper interfaces (tables has class and method); a file's counts over an interface's."""
    from_xml = mappers.filter("kind = 'statement'").select(F.lit(project).alias("project"), "mapper_name", "namespace", "id", "sql_type", "sql_content", "parameter_type", "result_type", "result_map", "logical_name", F.lit(2).alias("rank"))
    from_code = jpa.mapper_statements(tables["class"], tables["method"]).withColumn("rank", F.lit(1))
    both = from_xml.unionByName(from_code, allowMissingColumns=True)
    return materialize(sqlmeta.analyse(upsert.latest(both, KEYS["sql_statement"], ["rank"]).drop("rank")))


def derive(raw: dict[str, DataFrame], project: str) -> dict[str, DataFrame]:
    """The node and edge tables of the rows that read_sources() gives. Every statement is analysed once; the rest is lazy."""
    parsed = raw["raw_java"]
    tables = java.tables_of(parsed, project) | {"calls": calltargets.resolve_calls(parsed, project)}
    tables["bean"] = linkage.beans_of(tables["class"])
    tables["depends_on"] = linkage.bean_dependencies(tables["bean"], tables["field"], tables["method"], tables["class"])
    tables["endpoint"] = classspec.endpoints(tables["class"], tables["method"])
    tables["test_class"] = classspec.test_facts(tables["class"], tables["method"])
    tables["jpa_entity"] = jpa.entities(tables["class"])
    tables["jpa_column"] = jpa.entity_columns(tables["jpa_entity"], tables["field"])
    tables["jpa_relationship"] = jpa.relationships(tables["jpa_entity"], tables["field"])
    tables["jpa_query"] = jpa.repository_queries(jpa.repositories(tables["class"]), tables["method"])

    mappers = raw["raw_mapper"]
    tables["result_map"] = mappers.filter("kind = 'result_map'")
    tables["sql_statement"] = statements(tables, mappers, project)
    tables["sql_link"] = linkage.link_methods_to_sql(tables["method"], tables["sql_statement"])

    tables["config_file"] = config.summary(raw["raw_config"])
    if "raw_ddl" in raw:
        scripts = raw["raw_ddl"]
        body = ddl.tables(scripts)
        tables["db_table"] = body.select(F.lit(project).alias("project"), "database_name", "schema", F.col("table_name").alias("name"))
        tables["db_column"], tables["db_index"], tables["db_constraint"] = ddl.columns(body, ddl.changes(scripts)), ddl.indexes(scripts), ddl.constraints(scripts)
    return tables


def ingest(spark: SparkSession, source: str, project: str, ddl_folder: str | None = None, rule: str | None = None) -> dict[str, DataFrame]:
    """The node and edge tables of a source tree. Every file is parsed once, in tasks."""
    raw = read_sources(spark, source, ddl_folder, rule)
    return derive({name: materialize(df) for name, df in raw.items()}, project)


def refresh(spark: SparkSession, source: str, project: str, target: str, ddl_folder: str | None = None, rule: str | None = None) -> DataFrame:
    """Brings the tables saved under target up to date with the source tree, and gives (path, state) of its files: added, changed, renamed, same, removed.

    Only files that differ from the saved manifest are parsed. Rows of removed files go, and with them all that is derived of them; their paths stay in the table
    removed_file with the version they went in. Everything is one commit: a run that breaks off leaves the version before as it was, and is simply repeated.
    """
    held = Store(spark, target)
    base = held.versions()[-1] if held.versions() else 0
    before = held.read() if base else {}
    old = before.get("manifest", spark.createDataFrame([], manifest.SCHEMA))
    states = manifest.compare(manifest.files_now(spark, [source, *([ddl_folder] if ddl_folder else [])]), old)
    raw = {name: materialize(df) for name, df in read_sources(spark, source, ddl_folder, rule, states, before).items()}
    gone = states.filter("state = 'removed'").select("path", F.lit(base + 1).cast("long").alias("version"))
    if "removed_file" in before:
        back = states.filter("state <> 'removed'").select("path")
        gone = gone.unionByName(before["removed_file"].join(back, "path", "left_anti"))
    now = {"manifest": states.filter("state <> 'removed'").drop("state"), "removed_file": gone}
    held.commit(raw | derive(raw, project) | now, base=base)
    return states.select("path", "state")


def save(tables: dict[str, DataFrame], target: str) -> int:
    """Writes all tables as one new version of the store in target; gives its number. Readers see all of it or nothing."""
    spark = next(iter(tables.values())).sparkSession
    return Store(spark, target).commit(tables)


class Lineage:
    """Questions about ingested tables; each answer is a DataFrame.

    Methods are nodes named Class.method. Where classes of several packages or projects have one name, their nodes are named project:package.Class.method,
    so that none of them is taken for another.
    """

    def __init__(self, tables: dict[str, DataFrame]):
        self.t = tables

    @classmethod
    def load(cls, spark: SparkSession, target: str, names: list[str] | None = None, version: int | None = None) -> Lineage:
        """The tables of a saved version, of the last by default, and only those of it; later saves change nothing here."""
        return cls(Store(spark, target).read(version, names))

    @classmethod
    def open(cls, spark: SparkSession, target: str) -> Lineage:
        """All tables that save() wrote under target last."""
        return cls.load(spark, target)

    def sql(self, spark: SparkSession, text: str) -> DataFrame:
        """Ad-hoc SQL over the tables by name."""
        for name, df in self.t.items():
            df.createOrReplaceTempView(name)
        return spark.sql(text)

    def uses(self) -> DataFrame:
        """(project, mapper_name, sql_id, table_name, written): the tables of every statement, and whether it writes them."""
        s = self.t["sql_statement"]
        target = F.col("written") if "written" in s.columns else F.lit(None).cast("string")
        each = s.select("project", "mapper_name", F.col("id").alias("sql_id"), "sql_type", target.alias("target"), F.explode("tables").alias("x"))
        changed = (F.col("sql_type") != "SELECT") & F.coalesce(F.col("x.name") == F.col("target"), F.lit(True))
        return each.select("project", "mapper_name", "sql_id", F.col("x.name").alias("table_name"), changed.alias("written")).distinct()

    def _shared_names(self) -> DataFrame:
        """(shared): names that classes of more than one package or project have, those that are only called among them."""
        c, calls = self.t["class"], self.t["calls"]
        every = c.select("project", "package_name", F.col("name").alias("shared"))
        if "dst_package" in calls.columns:
            every = every.unionByName(calls.select("project", F.col("dst_package").alias("package_name"), F.col("dst_class").alias("shared")))
        return every.distinct().groupBy("shared").agg(F.count("*").alias("n")).filter("n > 1").select("shared")

    def _named(self, rows: DataFrame, package: Column, cls: str, method: str, out: str) -> DataFrame:
        """rows (project, cls, method, ...) with the node of a method in column out."""
        plain = F.concat_ws(".", cls, method)
        whole = F.concat(F.coalesce("project", F.lit("")), F.lit(":"), F.concat_ws(".", package, cls, method))
        return rows.join(self._shared_names(), F.col(cls) == F.col("shared"), "left").withColumn(out, F.when(F.col("shared").isNull(), plain).otherwise(whole)).drop("shared")

    def _linked(self) -> DataFrame:
        """sql_link with the package of each method; of methods in equally named classes of a project those whose class the statement's namespace names, all if it names none."""
        s = self.t["sql_statement"]
        space = F.col("namespace") if "namespace" in s.columns else F.lit(None).cast("string")
        spaces = s.select("project", "mapper_name", F.col("id").alias("sql_id"), space.alias("namespace"))
        m = self.t["method"].select("project", "package_name", "class_name", F.col("name").alias("method")).distinct()
        rows = self.t["sql_link"].select("project", "class_name", "method", "mapper_name", "sql_id").distinct().join(spaces, ["project", "mapper_name", "sql_id"]).join(m, ["project", "class_name", "method"], "left")
        fits = F.coalesce(F.col("namespace") == F.concat_ws(".", "package_name", "class_name"), F.lit(False))
        best = F.max(fits).over(Window.partitionBy("project", "class_name", "method", "mapper_name", "sql_id"))
        return rows.withColumn("fits", fits).withColumn("best", best).filter("fits = best").drop("fits", "best", "namespace")

    def runs(self) -> DataFrame:
        """Which method runs which statement: mapper methods by name, and methods that call them."""
        s = self.t["sql_statement"].select("project", "mapper_name", F.col("id").alias("sql_id"), "sql_type")
        return self._linked().join(s, ["project", "mapper_name", "sql_id"]).select("project", "package_name", "class_name", "method", "mapper_name", "sql_id", "sql_type")

    def _calls(self) -> DataFrame:
        """calls with their ends as nodes src and dst."""
        c = self.t["calls"]
        package = lambda x: F.col(x) if x in c.columns else F.lit(None).cast("string")
        named = self._named(c, package("src_package"), "src_class", "src_method", "src")
        return self._named(named, package("dst_package"), "dst_class", "dst_method", "dst")

    def edges(self) -> DataFrame:
        return self._calls().select("src", "dst").distinct()

    def nodes(self) -> DataFrame:
        m = self._named(self.t["method"], F.col("package_name"), "class_name", "name", "node")
        return m.select("node", "package_name", "class_name", F.col("name").alias("method")).distinct()

    def accesses(self, project: str | None = None) -> DataFrame:
        return crud.accesses(self.runs(), self.uses(), project)

    def crud_matrix(self, project: str | None = None) -> DataFrame:
        return crud.matrix(self.accesses(project), self.t.get("db_table"))

    def crud_crosstab(self, project: str | None = None, page: int = 0, size: int = 100) -> DataFrame:
        """Classes by tables, a page of so many tables in the order of their names; the long form of all is crud_matrix()."""
        held = self.accesses(project)
        names = held.select("table_name").distinct().orderBy("table_name").offset(page * size).limit(size)
        tables = [r["table_name"] for r in names.collect()]
        return crud.crosstab(held.filter(F.col("table_name").isin(tables)), tables)

    def table_summary(self, project: str | None = None) -> DataFrame:
        return crud.table_summary(self.accesses(project))

    def statistics(self) -> DataFrame:
        return stats.sql_statistics(self.t["sql_statement"])

    def _links(self) -> DataFrame:
        return self._named(self._linked(), F.col("package_name"), "class_name", "method", "node").select("project", "mapper_name", "sql_id", F.col("node").alias("method"))

    def table_impact(self, table: str, max_depth: int = 10, mode: str = "trail") -> DataFrame:
        return impact.table_impact(table, self.t["sql_statement"], self.uses(), self._links(), self.edges(), self.nodes(), max_depth, mode)

    def method_impact(self, class_name: str, method: str | None = None, max_depth: int = 10, mode: str = "trail") -> DataFrame:
        """Callers of a method, or of all public methods of a class."""
        m = self.t["method"].filter(F.col("class_name") == class_name)
        m = m.filter(F.col("name") == method) if method is not None else m.filter(F.col("visibility") == "public")
        return impact.method_impact(self._named(m, F.col("package_name"), "class_name", "name", "target").select("target"), self.edges(), self.nodes(), max_depth, mode)

    def call_chain(self, class_name: str | None = None, max_depth: int = 5) -> DataFrame:
        """(start, node, depth, sql_id, table_name) reachable from a class's methods, or from all."""
        n = self.nodes()
        starts = (n.filter(F.col("class_name") == class_name) if class_name else n).select(F.col("node").alias("start"))
        sql = self._links().join(self.uses(), ["project", "mapper_name", "sql_id"], "left").select(F.col("method").alias("node"), "sql_id", "table_name")
        return traverse.forward(self.edges(), starts, max_depth).join(sql, "node", "left")

    def _items(self) -> DataFrame:
        """(node, kind, item): the statements that methods run, their tables and their columns."""
        links = self._links().withColumnRenamed("method", "node")
        key = ["project", "mapper_name", "sql_id"]
        sql = links.select("node", F.lit("sql").alias("kind"), F.concat_ws(".", "mapper_name", "sql_id").alias("item"))
        used = links.join(self.uses(), key).select("node", F.lit("tables").alias("kind"), F.col("table_name").alias("item"))
        s = self.t["sql_statement"]
        read = s.select("project", "mapper_name", F.col("id").alias("sql_id"), F.explode("columns").alias("x"))
        return sql.unionByName(used).unionByName(links.join(read, key).select("node", F.lit("columns").alias("kind"), F.col("x.name").alias("item"))).distinct()

    def class_chains(self, max_depth: int | None = 5) -> DataFrame:
        """(package_name, class_name, n_methods, n_sql, n_tables, n_columns): what each class of the project reaches through calls; max_depth None follows them to their ends."""
        return reach.class_summary(self.nodes(), self.edges(), self._items(), ("sql", "tables", "columns"), ("package_name", "class_name"), max_depth)

    def chain_totals(self, max_depth: int | None = 5) -> DataFrame:
        """One row: the same for the whole project, with the tables and columns that no DDL defines."""
        known = {"sql": None} | {kind: self.t[name].select(F.col("name").alias("item")) if name in self.t else None for kind, name in (("tables", "db_table"), ("columns", "db_column"))}
        return reach.project_summary(self.nodes(), self.edges(), self._items(), known, ("package_name", "class_name"), max_depth)

    def missing_tables(self) -> DataFrame:
        """Tables that statements name and no DDL defines."""
        return linkage.missing(self.uses(), self.t["db_table"].select(F.col("name").alias("table_name")), ["table_name"])

    def cycles(self, max_depth: int = 10, limit: int | None = 10) -> DataFrame:
        return traverse.cycles(self.edges(), max_depth, limit)

    def sequence(self, class_name: str, method: str | None = None, max_depth: int = 5) -> DataFrame:
        n = self.nodes().filter(F.col("class_name") == class_name)
        tops = (n.filter(F.col("method") == method) if method else n).select(F.col("node").alias("top"))
        calls = self._calls().filter(~N.is_external(F.coalesce("dst_package", F.lit("x")))).select("src", "dst", "call_order")
        return traverse.sequence_events(calls, self._links().select("method", "sql_id"), self.uses(), tops, max_depth)

    def class_spec(self) -> DataFrame:
        return classspec.class_rows(self.t["class"], self.t["method"], self.t["field"], self.t["depends_on"], self.t["bean"])

    def class_list(self) -> DataFrame:
        return summary.class_list(self.t["class"], self.t["method"])

    def mapping_audit(self) -> DataFrame:
        return audit.column_mappings(self.t["jpa_column"], self.t["db_column"])

    def run_counts(self) -> DataFrame:
        return summary.run_counts(self.t)
