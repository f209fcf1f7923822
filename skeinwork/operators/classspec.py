"""Class specifications: what a class is, has and does, one row a class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import visibility_rank
from ..tables import by_key


def method_rows(methods: DataFrame, links: DataFrame, statements: DataFrame) -> DataFrame:
    """Methods with their statements as an array of structs, public ones first. Methods without statements have an empty array."""
    facts = statements.select("project", "mapper_name", F.col("id").alias("sql_id"), "sql_type", "complexity_score")
    sql = links.join(facts, ["project", "mapper_name", "sql_id"]).groupBy("project", "class_name", F.col("method").alias("name"))
    sql = sql.agg(F.sort_array(F.collect_set(F.struct("sql_id", "sql_type", "complexity_score"))).alias("statements"))
    rows = methods.join(sql, ["project", "class_name", "name"], "left")
    none = F.array().cast("array<struct<sql_id:string,sql_type:string,complexity_score:bigint>>")
    return rows.withColumns({"statements": F.coalesce(F.col("statements").cast("array<struct<sql_id:string,sql_type:string,complexity_score:bigint>>"), none), "rank": visibility_rank(F.col("visibility"))})


def class_rows(classes: DataFrame, methods: DataFrame, fields: DataFrame, depends: DataFrame, beans: DataFrame) -> DataFrame:
    """One row per class with its methods, fields and bean dependencies as sorted text lists; each side is aggregated before the joins."""
    key = ["project", "class_name"]
    m = methods.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(visibility_rank(F.col("visibility")).alias("r"), "name"))), lambda x: x["name"]), ",").alias("methods"), F.count("*").alias("n_methods"))
    f = fields.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "type", "name"))), ",").alias("fields"))
    own = beans.select("project", "class_name", F.col("name").alias("source_bean"))
    d = depends.join(by_key(own), ["project", "source_bean"]).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("target_bean")), ",").alias("depends_on"))
    rows = classes.withColumnRenamed("name", "class_name").select(*key, "package_name", "type", "sub_type", "superclass", F.array_join("interfaces", ",").alias("interfaces"))
    for side in (m, f, d):
        rows = rows.join(by_key(side), key, "left")
    return rows.fillna({"methods": "", "n_methods": 0, "fields": "", "depends_on": ""})


def inheritance(classes: DataFrame) -> DataFrame:
    """(class_name, kind, parent): what each class extends and implements."""
    up = classes.filter("superclass is not null").select(F.col("name").alias("class_name"), F.lit("EXTENDS").alias("kind"), F.col("superclass").alias("parent"))
    return up.unionByName(classes.select(F.col("name").alias("class_name"), F.lit("IMPLEMENTS").alias("kind"), F.explode("interfaces").alias("parent")))


def endpoints(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Endpoints of controllers: the mapping annotation of each method under the class's path."""
    from ..functions.names import http_method, join_path

    is_controller = F.exists("annotations", lambda a: a["name"].isin("Controller", "RestController"))
    base = F.filter("annotations", lambda a: a["name"] == "RequestMapping")
    c = classes.filter(is_controller).select("project", F.col("name").alias("class_name"), F.when(F.size(base) > 0, F.coalesce(F.element_at(base[0]["parameters"], "value"), F.element_at(base[0]["parameters"], "path"))).alias("base"))
    mapping = F.filter("annotations", lambda a: a["name"].rlike("^(Request|Get|Post|Put|Delete|Patch)Mapping$"))
    m = methods.filter(F.size(mapping) > 0).select("project", "class_name", "name", mapping[0].alias("a")).filter("name <> class_name").join(c, ["project", "class_name"])
    path = F.coalesce(F.element_at("a.parameters", "value"), F.element_at("a.parameters", "path"))
    return m.select("project", F.coalesce(path, F.lit("/")).alias("path"), join_path(F.col("base"), path).alias("full_path"), http_method(F.col("a.name"), F.element_at("a.parameters", "method")).alias("method"), F.col("class_name").alias("controller_class"), F.col("name").alias("handler_method"))


def test_facts(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(project, class_name, framework, test_type, n_tests, n_setup, n_mocks, n_assertions) of classes with test methods."""
    from ..functions.names import test_family

    each = methods.select("project", "class_name", F.explode("annotations").alias("a"), "source").withColumn("family", test_family(F.col("a.name")))
    agg = each.groupBy("project", "class_name").agg(
        F.count_if(F.col("a.name").isin("Test", "ParameterizedTest", "RepeatedTest")).alias("n_tests"),
        F.count_if(F.col("a.name").isin("BeforeEach", "AfterEach", "BeforeAll", "AfterAll", "Before", "After", "BeforeMethod", "AfterMethod")).alias("n_setup"),
        F.max(F.col("family") == "testng").alias("testng"),
    )
    text = methods.groupBy("project", "class_name").agg(F.sum(F.regexp_count("source", F.lit(r"\bassert\w*\s*\("))).alias("n_assertions"), F.sum(F.regexp_count("source", F.lit(r"\b(when|verify|given|mock|doReturn|doThrow)\s*\("))).alias("n_mocks"))
    names = F.transform("annotations", lambda a: a["name"])
    kind = F.when(F.arrays_overlap(names, F.array(F.lit("SpringBootTest"))), "integration").when(F.exists(names, lambda n: n.rlike("^(DataJpa|WebMvc|Jdbc|Json|DataJdbc|WebFlux|RestClient)Test$")), "slice").otherwise("unit")
    c = classes.select("project", F.col("name").alias("class_name"), kind.alias("test_type"))
    rows = agg.filter("n_tests > 0").join(by_key(text), ["project", "class_name"]).join(by_key(c), ["project", "class_name"])
    return rows.select("project", "class_name", F.when(F.col("testng"), "testng").otherwise("junit").alias("framework"), "test_type", "n_tests", "n_setup", "n_mocks", "n_assertions")


_SETUP = ("BeforeEach", "AfterEach", "BeforeAll", "AfterAll", "Before", "After", "BeforeMethod", "AfterMethod", "BeforeClass", "AfterClass")
_SOURCES = ("ValueSource", "CsvSource", "MethodSource", "EnumSource", "DataProvider")


def test_methods(methods: DataFrame) -> DataFrame:
    """(project, class_name, name, kind, display_name, timeout, expected, assertions, stubs, calls, created, data_sources) of methods with a test annotation.

    kind is setup or test; the lists hold, in order and with repetitions, the assertions and stubbing calls by name, calls as object.method, and the
    types of new objects in the source; data_sources are the annotations that bring test data.
    """
    from ..functions.names import test_family

    rows = methods.filter(F.exists("annotations", lambda a: test_family(a["name"]).isin("junit", "spring_test", "testng")))

    def found(pattern: str, group: int = 1):
        return F.regexp_extract_all(F.coalesce("source", F.lit("")), F.lit(pattern), F.lit(group))

    def said(annotation: str):
        hit = F.filter("annotations", lambda a: a["name"] == annotation)
        return F.when(F.size(hit) > 0, F.element_at(hit[0]["parameters"], "value"))

    names = F.transform("annotations", lambda a: a["name"])
    calls = F.transform(found(r"\b\w+\s*\.\s*\w+\s*\(", 0), lambda c: F.regexp_replace(c, r"[\s(]", ""))
    return rows.select(
        "project", "class_name", "name", F.when(F.exists(names, lambda n: n.isin(*_SETUP)), "setup").otherwise("test").alias("kind"), said("DisplayName").alias("display_name"), said("Timeout").alias("timeout"),
        said("ExpectedExceptions").alias("expected"), found(r"\b(assert\w*|fail)\s*\(").alias("assertions"), found(r"\b(when|given|then|willReturn|willThrow|verify|doReturn|doThrow|mock|spy)\s*\(").alias("stubs"),
        calls.alias("calls"), found(r"\bnew\s+([\w.]+)").alias("created"), F.filter(names, lambda n: n.isin(*_SOURCES)).alias("data_sources"),
    )


def test_mocks(fields: DataFrame) -> DataFrame:
    """(project, class_name, name, type, mock_type): fields that stand in for something; mock, spy or bean."""
    names = F.transform("annotations", lambda a: a["name"])
    any_of = lambda *wanted: F.exists(names, lambda n: n.isin(*wanted))
    kind = F.when(any_of("Mock"), "mock").when(any_of("Spy"), "spy").when(any_of("MockBean", "SpyBean", "InjectMocks", "Captor"), "bean")
    return fields.select("project", "class_name", "name", "type", kind.alias("mock_type")).filter("mock_type is not null")


def test_configurations(classes: DataFrame) -> DataFrame:
    """(project, class_name, kind, value): configurations, profiles and property sources of test classes."""
    kinds = F.create_map(*map(F.lit, ("TestConfiguration", "configuration", "ActiveProfiles", "profile", "TestPropertySource", "property")))
    each = classes.select("project", F.col("name").alias("class_name"), F.explode("annotations").alias("a")).withColumn("kind", kinds[F.col("a.name")])
    value = F.coalesce(F.element_at("a.parameters", "value"), F.element_at("a.parameters", "properties"), F.element_at("a.parameters", "locations"), F.lit(""))
    return each.filter("kind is not null").select("project", "class_name", "kind", value.alias("value"))
