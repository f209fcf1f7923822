"""Names, annotations and other code facts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sqlmeta import strip

# Vocabularies that decide how code elements are classed.
EXTERNAL_PREFIXES = ("java", "javax", "jakarta", "org.springframework", "org.apache", "org.hibernate", "org.slf4j", "org.junit", "org.mockito", "org.hamcrest", "lombok", "com.fasterxml.jackson", "ch.qos.logback", "junit")
NARROW_EXTERNAL_PREFIXES = ("java.", "javax.", "org.springframework.", "org.apache.", "lombok.")
ANNOTATION_CATEGORIES = {
    "component": ("Component", "Service", "Repository", "Controller", "RestController", "Configuration", "Bean"),
    "injection": ("Autowired", "Resource", "Value", "Qualifier", "Primary"),
    "web": ("RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestParam", "PathVariable", "RequestBody", "ResponseBody", "ResponseStatus"),
    "jpa": ("Entity", "Table", "MappedSuperclass", "Embeddable", "Embedded", "Id", "GeneratedValue", "SequenceGenerator", "TableGenerator", "Column", "Basic", "Transient", "Enumerated", "Temporal", "Lob", "OneToOne", "OneToMany", "ManyToOne", "ManyToMany", "JoinColumn", "JoinColumns", "JoinTable", "PrimaryKeyJoinColumn", "PrimaryKeyJoinColumns", "ElementCollection", "CollectionTable", "OrderBy", "OrderColumn", "MapKey", "MapKeyClass", "MapKeyColumn", "MapKeyJoinColumn", "MapKeyJoinColumns", "MapKeyTemporal", "MapKeyEnumerated", "Inheritance", "DiscriminatorColumn", "DiscriminatorValue", "SecondaryTable", "SecondaryTables", "AttributeOverride", "AttributeOverrides", "AssociationOverride", "AssociationOverrides", "NamedQuery", "NamedQueries", "NamedNativeQuery", "NamedNativeQueries", "SqlResultSetMapping", "SqlResultSetMappings", "ConstructorResult", "ColumnResult", "FieldResult", "EntityResult", "EntityResults", "Cacheable", "Version", "Access", "UniqueConstraint", "Index", "ForeignKey"),
    "test": ("Test", "SpringBootTest", "DataJpaTest", "WebMvcTest", "MockBean", "SpyBean", "TestPropertySource"),
    "security": ("PreAuthorize", "PostAuthorize", "Secured", "RolesAllowed", "EnableWebSecurity", "EnableGlobalMethodSecurity"),
    "validation": ("Valid", "NotNull", "NotBlank", "NotEmpty", "Size", "Min", "Max", "Pattern", "Email", "AssertTrue", "AssertFalse"),
    "mybatis": ("Mapper", "Select", "Insert", "Update", "Delete", "SelectProvider", "InsertProvider", "UpdateProvider", "DeleteProvider", "Results", "Result", "One", "Many", "MapKey", "Options", "SelectKey"),
}
TEST_FAMILIES = {
    "junit": ("Test", "BeforeEach", "AfterEach", "BeforeAll", "AfterAll", "DisplayName", "ParameterizedTest", "ValueSource", "CsvSource", "MethodSource", "Timeout", "Disabled", "Nested", "RepeatedTest", "Order", "TestMethodOrder", "TestInstance", "TestClassOrder"),
    "spring_test": ("SpringBootTest", "WebMvcTest", "DataJpaTest", "DataJdbcTest", "JdbcTest", "JsonTest", "RestClientTest", "WebFluxTest", "MockBean", "SpyBean", "TestConfiguration", "ActiveProfiles", "TestPropertySource", "DirtiesContext", "Transactional", "Rollback", "Commit", "Sql", "SqlGroup", "AutoConfigureTestDatabase", "AutoConfigureMockMvc", "AutoConfigureWebMvc", "AutoConfigureWebClient", "MockMvc", "TestEntityManager", "TestContainers", "DynamicPropertySource"),
    "testng": ("TestNG", "BeforeMethod", "AfterMethod", "BeforeClass", "AfterClass", "BeforeSuite", "AfterSuite", "BeforeGroups", "AfterGroups", "DataProvider", "Parameters", "Groups", "Priority", "DependsOnMethods", "DependsOnGroups", "ExpectedExceptions", "InvocationCount", "SuccessPercentage", "TimeOut"),
    "mockito": ("Mock", "Spy", "InjectMocks", "Captor", "MockedStatic"),
    "assertj": ("AssertJ",),
    "other_test": ("Ignore", "Category", "RunWith", "ExtendWith", "ContextConfiguration"),
}
STREAM_METHODS = ("collect", "map", "filter", "forEach", "stream", "reduce", "findFirst", "findAny", "anyMatch", "allMatch", "noneMatch", "count", "distinct", "sorted", "limit", "skip", "peek", "flatMap", "toArray")
LOGGERS, LOG_METHODS = ("log", "logger", "LOGGER"), ("info", "debug", "warn", "error", "trace")
REPOSITORY_INTERFACES = ("JpaRepository", "CrudRepository", "PagingAndSortingRepository", "JpaSpecificationExecutor", "QueryByExampleExecutor")
TYPE_PREFIXES = {
    "String": ("varchar", "char", "text", "clob"),
    "Integer": ("int", "integer", "number"),
    "Long": ("bigint", "number"),
    "Double": ("double", "float", "number"),
    "Boolean": ("boolean", "bit"),
    "Date": ("date", "timestamp", "datetime"),
    "LocalDateTime": ("timestamp", "datetime"),
    "BigDecimal": ("decimal", "numeric", "number"),
}


def is_external(package: Column, prefixes=EXTERNAL_PREFIXES) -> Column:
    """No package, or one that starts with a library's prefix (with no dot needed after it)."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | package.startswith(p)
    return package.isNull() | (package == "") | hit


def is_external_narrow(package: Column) -> Column:
    return F.coalesce(is_external(package, NARROW_EXTERNAL_PREFIXES) & (package != ""), F.lit(False))


def simple_name(full: Column) -> Column:
    return F.substring_index(full, ".", -1)


def package_of(full: Column) -> Column:
    return F.when(full.contains("."), F.regexp_extract(full, r"^(.*)\.[^.]*$", 1))


def outer_class(name: Column) -> Column:
    """Outer of Outer.Inner and Outer$Inner; the name itself if it is no inner class."""
    return F.substring_index(F.substring_index(name, "$", 1), ".", 1)


def is_inner(name: Column) -> Column:
    return name.contains("$") | name.contains(".")


def method_name_type(name: Column) -> Column:
    """The kind of SQL statement a mapper method's name suggests; the first keyword found decides."""
    low = F.lower(name)
    return (
        F.when(low.rlike("find|get|select|search|list"), "SELECT")
        .when(low.rlike("save|insert|create|add"), "INSERT")
        .when(low.rlike("update|modify|change"), "UPDATE")
        .when(low.rlike("delete|remove"), "DELETE")
        .otherwise("SELECT")
    )


def bean_name(class_name: Column) -> Column:
    return F.concat(F.lower(F.substring(class_name, 1, 1)), F.substring(class_name, F.lit(2), F.length(class_name)))


def _has(names: Column, *wanted: str) -> Column:
    return F.arrays_overlap(names, F.array(*map(F.lit, wanted)))


def bean_type(names: Column) -> Column:
    """The bean type by the annotations' names, service before repository, controller, configuration and component; null if no bean."""
    return (
        F.when(_has(names, "Service"), "service").when(_has(names, "Repository", "Mapper"), "repository")
        .when(_has(names, "Controller", "RestController"), "controller").when(_has(names, "Configuration"), "configuration").when(_has(names, "Component"), "component")
    )


def sub_type(package: Column, class_name: Column, names: Column) -> Column:
    """What kind of class it is by its annotations, else the last part of its package, else the end of its name; '' if neither tells."""
    low = F.transform(names, lambda n: F.lower(F.regexp_replace(n, "^@", "")))
    last, name = F.lower(simple_name(F.coalesce(package, F.lit("")))), F.lower(class_name)
    by_annotation = (("controller", "controller restcontroller controlleradvice"), ("service", "service component"), ("repository", "repository mapper"), ("entity", "entity table mappedsuperclass"), ("config", "configuration config enableautoconfiguration"))
    by_package = (("controller", "controller controllers"), ("service", "service services"), ("util", "util utils utility"), ("dto", "dto dtos model models"), ("config", "config configuration"), ("mapper", "mapper mappers"), ("repository", "repository repositories"), ("entity", "entity entities domain"), ("exception", "exception exceptions"), ("client", "client clients"))
    by_suffix = (("controller", "controller"), ("service", "service"), ("util", "utils?"), ("dto", "dto|request|response"), ("config", "config|configuration"), ("mapper", "mapper"), ("repository", "repository"), ("entity", "entity"), ("exception", "exception"), ("client", "client"))
    tests = [(_has(low, *w.split()), k) for k, w in by_annotation] + [(last.isin(w.split()), k) for k, w in by_package] + [(name.rlike(f"({w})$"), k) for k, w in by_suffix]
    out = F.lit("")
    for test, kind in reversed(tests):
        out = F.when(test, F.lit(kind)).otherwise(out)
    return out


def _category(name: Column, sets: dict[str, tuple[str, ...]], default: str) -> Column:
    out = F.lit(default)
    for kind, members in reversed(sets.items()):
        out = F.when(name.isin(*members), F.lit(kind)).otherwise(out)
    return out


def annotation_category(name: Column) -> Column:
    return _category(name, ANNOTATION_CATEGORIES, "other")


def test_family(name: Column) -> Column:
    return _category(name, TEST_FAMILIES, "unknown")


def visibility(modifiers: Column) -> Column:
    shown = F.filter(modifiers, lambda m: m.isin("public", "protected", "private"))
    return F.coalesce(F.when(F.size(shown) > 0, shown[0]), F.lit("package"))


def visibility_rank(v: Column) -> Column:
    return F.when(v == "public", 1).when(v == "protected", 2).when(v == "private", 3).otherwise(4)


def join_path(base: Column, path: Column) -> Column:
    """A controller's path and a method's: a slash between them if neither brings one; '/' if both are empty."""
    base, path = F.coalesce(base, F.lit("")), F.coalesce(path, F.lit(""))
    gap = F.when((base != "") & ~base.endswith("/") & ~path.startswith("/"), "/").otherwise("")
    return F.when(path != "", F.concat(base, gap, path)).when(base == "", "/").otherwise(base)


def http_method(annotation: Column, method_parameter: Column) -> Column:
    verb = F.upper(F.regexp_extract(annotation, "^(Get|Post|Put|Delete|Patch)Mapping$", 1))
    said = F.upper(F.regexp_extract(F.coalesce(method_parameter, F.lit("")), r"(\w+)\W*$", 1))
    return F.when(verb != "", verb).when(said != "", said).otherwise("GET")


def derived_operation(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.rlike("^(find|get)"), "SELECT").when(low.rlike("^(save|insert)"), "INSERT").when(low.rlike("^update"), "UPDATE")
        .when(low.rlike("^(delete|remove)"), "DELETE").when(low.rlike("^count"), "COUNT").when(low.rlike("^exists"), "EXISTS").otherwise("SELECT")
    )


def derived_query(name: Column) -> Column:
    """operation, entity_field, is_sorted and is_paged of a repository method's name."""
    low = F.lower(name)
    return F.struct(
        derived_operation(name).alias("operation"), F.regexp_extract(name, r"(?i)(?:find|get|count|exists|delete)By(\w+)", 1).alias("entity_field"),
        (low.contains("orderby") | low.contains("sort")).alias("is_sorted"), low.contains("page").alias("is_paged"),
    )


def query_type(annotations: Column) -> Column:
    """NATIVE, JPQL, NAMED or METHOD by a method's Query and NamedQuery annotations (structs name, parameters)."""

    def named(name: str) -> Column:
        return F.filter(annotations, lambda a: a["name"] == name)

    native = F.exists(named("Query"), lambda a: F.lower(F.coalesce(F.element_at(a["parameters"], "nativeQuery"), F.lit(""))) == "true")
    return F.when(F.size(named("NamedQuery")) > 0, "NAMED").when(native, "NATIVE").when(F.size(named("Query")) > 0, "JPQL").otherwise("METHOD")


def is_repository(class_name: Column, interfaces: Column, names: Column) -> Column:
    return F.exists(interfaces, lambda i: simple_name(F.regexp_replace(i, "<.*$", "")).isin(*REPOSITORY_INTERFACES)) | F.array_contains(names, "Repository") | class_name.endswith("Repository")


def entity_of_repository(class_name: Column) -> Column:
    return F.regexp_replace(class_name, "Repository$", "")


def types_match(java_type: Column, db_type: Column) -> Column:
    simple, low, out = simple_name(java_type), F.lower(db_type), F.lit(False)
    for name, prefixes in TYPE_PREFIXES.items():
        out = F.when(simple == name, low.rlike("^(" + "|".join(prefixes) + ")")).otherwise(out)
    return F.coalesce(out, F.lit(False))


def sql_return_type(result_map: Column, result_type: Column) -> Column:
    both = F.concat_ws(" | ", F.nullif(result_map, F.lit("")), F.nullif(result_type, F.lit("")))
    return F.when(both == "", "void").otherwise(both)


def lenient_tables(text: Column, columns: Column) -> Column:
    """Table names from a JSON list of objects, a comma list, or else the columns' tables."""
    parsed = F.transform(F.from_json(text, "array<struct<name:string>>"), lambda t: t["name"])
    listed = F.when(~text.rlike(r"^\s*[\[{]"), F.filter(F.transform(F.split(text, ","), lambda x: strip(x)), lambda x: x != ""))
    own = F.array_distinct(F.array_compact(F.transform(columns, lambda c: c["table"])))
    return F.coalesce(F.when(F.size(parsed) > 0, parsed), F.when(F.size(listed) > 0, listed), own, F.array().cast("array<string>"))


def description(annotations: Column) -> Column:
    """The description of the first Tag or Operation annotation; '' without one."""
    said = F.filter(annotations, lambda a: a["name"].isin("Tag", "Operation") & F.element_at(a["parameters"], "description").isNotNull())
    return F.coalesce(F.when(F.size(said) > 0, F.element_at(said[0]["parameters"], "description")), F.lit(""))


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")), F.lit("`"), F.lit("'"))


def mermaid_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")


def clean_reply(text: Column) -> Column:
    """A model's reply without its <think> part and the fence around it."""
    thought = strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    fenced = F.regexp_extract(thought, r"(?s)^```\w*\s*\n(.*?)\n?```\s*$", 1)
    return strip(F.when(fenced != "", fenced).otherwise(thought))


def error_class(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.rlike(r"\b(429|503)\b|rate limit|unavailable"), "retryable").when(low.rlike(r"\b(400|401|403)\b|api key"), "fatal").otherwise("unknown")


def duration_text(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd HH:mm:ss.SSS")


def stamp_text(stamp: Column) -> Column:
    return F.date_format(F.to_timestamp(stamp, "yyyyMMdd-HHmmss"), "yyyy-MM-dd HH:mm:ss")


def lombok_methods(classes: DataFrame, fields: DataFrame) -> DataFrame:
    """(project, class_name, name, return_type, origin) of the methods @Data gives: accessors of each field, equals, hashCode, toString."""
    data = classes.filter(F.exists("annotations", lambda a: a["name"] == "Data")).select("project", F.col("name").alias("class_name"))
    own = fields.join(data, ["project", "class_name"])
    cap = F.concat(F.upper(F.substring("name", 1, 1)), F.substring(F.col("name"), F.lit(2), F.length("name")))
    read = F.concat(F.when(F.col("type") == "boolean", "is").otherwise("get"), cap)
    made = F.array(F.struct(read.alias("name"), F.col("type").alias("return_type")), F.struct(F.concat(F.lit("set"), cap).alias("name"), F.lit("void").alias("return_type")))
    accessors = own.select("project", "class_name", F.explode(made).alias("m")).select("project", "class_name", "m.*")
    fixed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("return_type")) for n, t in (("equals", "boolean"), ("hashCode", "int"), ("toString", "String"))])
    common = data.select("project", "class_name", F.explode(fixed).alias("m")).select("project", "class_name", "m.*")
    return accessors.unionByName(common).withColumn("origin", F.lit("lombok"))
