"""Queries over source texts: each row of a test table becomes Java, XML, DDL, SQL or configuration text, which the library parses.

What the parsers must find follows from the row, so every query has its own SQL over the same table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import project
from ..functions import ddl, sqlmeta
from ..functions import names as N
from ..operators import audit, calltargets, classspec, crud, enrich, jpa, linkage, predicates, stats, summary, traverse, upsert
from ..sinks import report
from ..sources import config, files, java, mapper_xml, rules
from ..store import Store
from ..tables import materialize, new_folder, shared_dir, table
from .testgraph import CTES, TestGraph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with the SQL it is held against."""

    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _filled(template: str, **values: Column) -> Column:
    """The template with @name@ replaced by each value."""
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit(f"@{name}@"), value.cast("string"))
    return text


def _sources(spark: SparkSession, sf: str, **templates: str) -> DataFrame:
    """(file_path, value): for each part one file of each template; names of files are the templates' names with _ for the part's key."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = [F.struct(_filled(f"/src/{name.replace('_', '@k@')}", k=k).alias("file_path"), _filled(text, k=k, size=size).alias("value")) for name, text in templates.items()]
    # few keys make many texts: they are dealt to all cores before the texts are made
    parts = table(spark, sf, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return parts.select(F.explode(F.array(*rows)).alias("f")).select("f.*")


def _list(col: str, field: str | None = None) -> Column:
    """A list as text."""
    return F.array_join(F.transform(col, lambda x: x[field]) if field else F.col(col), ",")


# Java

SERVICE = """/* licence */
package com.shop@size@.service;

import com.shop@size@.mapper.Part@k@Mapper;
import java.util.List;

/**
 * Name: desk of part @k@
 * more
 */
@Service
@Scope("prototype")
public class Part@k@Service extends BaseService implements PartPort, AutoCloseable {
    @Autowired
    private Part@k@Mapper mapper;
    private static final int LIMIT = @size@;
    private final Part@k@Desk desk;

    public Part@k@Service(Part@k@Desk desk) { this.desk = desk; }

    /** Finds parts */
    @Transactional
    public List<String> find@k@(String name, int size) {
        log.info("looking");
        Audit audit = desk.open(name);
        audit.touch();
        names.stream().map(x -> x);
        return mapper.find@k@(name, size);
    }

    @Autowired
    public void setAudit(Part@k@Audit audit) { helper(); }

    protected static void helper() { System.out.println("x"); }

    static class Row { int n; }
}
"""
MAPPER = """package com.shop@size@.mapper;
@Mapper
public interface Part@k@Mapper {
    @Select("SELECT * FROM t@k@")
    List<String> find@k@(String name, int size);
    @DeleteProvider(type = Sql.class)
    int dropAll();
    void saveRow(Part row);
    int recount();
}
"""
DESK = """package com.shop@size@.desk;
@Component class Part@k@Desk { Audit open(String name) { return null; } }
@Repository class Part@k@Audit { public void touch() {} }
class Plain@k@ {}
"""


def _parsed(spark, sf, **more: str) -> DataFrame:
    found = _sources(spark, sf, **{"Part_Service.java": SERVICE, "Part_Mapper.java": MAPPER, "Part_Desk.java": DESK, **more})
    return java.parsed_classes(found, rules.compile_template("Name: {logical_name} * more"))


def _code(spark, sf, **more: str) -> dict[str, DataFrame]:
    return java.tables_of(_parsed(spark, sf, **more), "shop")


def _code_once(spark, sf) -> dict[str, DataFrame]:
    """_code() for queries that read several of its tables: every file is cut once."""
    return java.tables_of(materialize(_parsed(spark, sf)), "shop")


@query("""SELECT concat('Part', p_partkey, 'Service') AS name, concat('com.shop', p_size, '.service') AS package_name, 'class' AS type, 'service' AS sub_type, 'BaseService' AS superclass, 'PartPort,AutoCloseable' AS interfaces,
concat('com.shop', p_size, '.mapper.Part', p_partkey, 'Mapper,java.util.List') AS imports, 'Service,Scope' AS annotations, false AS is_inner, concat('desk of part ', p_partkey) AS logical_name FROM part
UNION ALL SELECT concat('Part', p_partkey, 'Service.Row'), concat('com.shop', p_size, '.service'), 'class', 'inner_class', NULL, '', concat('com.shop', p_size, '.mapper.Part', p_partkey, 'Mapper,java.util.List'), '', true, '' FROM part
UNION ALL SELECT concat('Part', p_partkey, 'Mapper'), concat('com.shop', p_size, '.mapper'), 'interface', 'repository', NULL, '', '', 'Mapper', false, '' FROM part
UNION ALL SELECT concat('Part', p_partkey, 'Desk'), concat('com.shop', p_size, '.desk'), 'class', 'service', NULL, '', '', 'Component', false, '' FROM part
UNION ALL SELECT concat('Part', p_partkey, 'Audit'), concat('com.shop', p_size, '.desk'), 'class', 'repository', NULL, '', '', 'Repository', false, '' FROM part
UNION ALL SELECT concat('Plain', p_partkey), concat('com.shop', p_size, '.desk'), 'class', '', NULL, '', '', '', false, '' FROM part""")
def java_classes(spark, sf):
    rows = _code(spark, sf)["class"]
    return rows.select("name", "package_name", "type", "sub_type", "superclass", _list("interfaces").alias("interfaces"), _list("imports").alias("imports"), _list("annotations", "name").alias("annotations"), "is_inner", "logical_name")


@query("""SELECT concat('Part', p_partkey, 'Service') AS class_name, unnest([concat('Part', p_partkey, 'Service'), concat('find', p_partkey), 'setAudit', 'helper']) AS name, unnest(['constructor', 'List<String>', 'void', 'void']) AS return_type,
unnest(['public', 'public', 'public', 'protected']) AS visibility, unnest([concat('1 Part', p_partkey, 'Desk desk'), '1 String name,2 int size', concat('1 Part', p_partkey, 'Audit audit'), '']) AS parameters, unnest(['', 'Transactional', 'Autowired', '']) AS annotations, unnest(['', 'Finds parts', '', '']) AS logical_name FROM part""")
def java_methods(spark, sf):
    rows = _code(spark, sf)["method"].filter(F.col("class_name").endswith("Service"))
    shown = F.array_join(F.transform("parameters", lambda p: F.concat_ws(" ", p["order"].cast("string"), p["type"], p["name"])), ",")
    return rows.select("class_name", "name", "return_type", "visibility", shown.alias("parameters"), _list("annotations", "name").alias("annotations"), "logical_name")


@query("""SELECT concat('Part', p_partkey, 'Service') AS class_name, unnest(['mapper', 'LIMIT', 'desk']) AS name, unnest([concat('Part', p_partkey, 'Mapper'), 'int', concat('Part', p_partkey, 'Desk')]) AS type, unnest(['private', 'private,static,final', 'private,final']) AS modifiers,
unnest([NULL, CAST(p_size AS VARCHAR), NULL]) AS initial_value FROM part UNION ALL SELECT concat('Part', p_partkey, 'Service.Row'), 'n', 'int', '', NULL FROM part""")
def java_fields(spark, sf):
    return _code(spark, sf)["field"].select("class_name", "name", "type", _list("modifiers").alias("modifiers"), "initial_value")


@query("""SELECT concat('Part', p_partkey, 'Service') AS src_class, unnest([concat('find', p_partkey), concat('find', p_partkey), concat('find', p_partkey), 'setAudit', 'helper']) AS src_method,
unnest([concat('com.shop', p_size, '.service'), concat('com.shop', p_size, '.service'), concat('com.shop', p_size, '.mapper'), concat('com.shop', p_size, '.service'), 'java.io']) AS dst_package,
unnest([concat('Part', p_partkey, 'Desk'), 'Audit', concat('Part', p_partkey, 'Mapper'), concat('Part', p_partkey, 'Service'), 'PrintStream']) AS dst_class, unnest(['open', 'touch', concat('find', p_partkey), 'helper', 'println']) AS dst_method, unnest([1, 2, 3, 1, 1]) AS call_order, unnest([25, 26, 28, 32, 34]) AS line_number FROM part""")
def java_calls(spark, sf):
    return calltargets.resolve_calls(materialize(_parsed(spark, sf)), "shop").select("src_class", "src_method", "dst_package", "dst_class", "dst_method", "call_order", "line_number")


@query("""SELECT concat('com.shop', p_size, s) AS name FROM (SELECT DISTINCT p_size FROM part), (SELECT unnest(['.service', '.mapper', '.desk']) AS s)""")
def java_packages(spark, sf):
    return files.packages(_sources(spark, sf, **{"Part_Service.java": SERVICE, "Part_Mapper.java": MAPPER, "Part_Desk.java": DESK}))


@query("""SELECT unnest([concat('part', p_partkey, 'Service'), concat('part', p_partkey, 'Service'), concat('part', p_partkey, 'Service')]) AS source_bean, unnest([concat('part', p_partkey, 'Mapper'), concat('part', p_partkey, 'Desk'), concat('part', p_partkey, 'Audit')]) AS target_bean,
unnest(['field', 'constructor', 'setter']) AS injection_type, unnest(['mapper', 'desk', 'setAudit']) AS member FROM part""")
def bean_injection(spark, sf):
    """Edges by field, constructor and setter, from parsed classes."""
    t = _code_once(spark, sf)
    return linkage.bean_dependencies(linkage.beans_of(t["class"]), t["field"], t["method"]).drop("project")


@query("""SELECT concat('part', p_partkey, x[1]) AS name, x[2] AS type, x[3] AS scope FROM part, (SELECT unnest([['Service', 'service', 'prototype'], ['Mapper', 'repository', 'singleton'], ['Desk', 'component', 'singleton'], ['Audit', 'repository', 'singleton']]) AS x)""")
def beans(spark, sf):
    return linkage.beans_of(_code(spark, sf)["class"]).select("name", "type", "scope")


@query("""SELECT concat('Part', p_partkey, 'Mapper') AS mapper_name, unnest([concat('find', p_partkey), 'dropAll', 'saveRow', 'recount']) AS id, unnest(['SELECT', 'DELETE', 'INSERT', 'SELECT']) AS sql_type, unnest([concat('SELECT * FROM t', p_partkey), '', '', '']) AS sql_content FROM part""")
def annotation_statements(spark, sf):
    t = _code(spark, sf)
    return jpa.mapper_statements(t["class"], t["method"]).drop("project")


@query("""SELECT concat('Part', p_partkey, 'Service') AS class_name, unnest(['EXTENDS', 'IMPLEMENTS', 'IMPLEMENTS']) AS kind, unnest(['BaseService', 'PartPort', 'AutoCloseable']) AS parent FROM part""")
def class_inheritance(spark, sf):
    return classspec.inheritance(_code(spark, sf)["class"])


@query("""SELECT concat('Part', p_partkey, 'Service') AS class_name, list_sort([concat('Part', p_partkey, 'Service'), concat('find', p_partkey), 'helper', 'setAudit']) AS methods, ['LIMIT', 'desk', 'mapper'] AS fields FROM part""")
def class_details(spark, sf):
    t = _code_once(spark, sf)
    return summary.class_details(t["class"].filter("type = 'class' and sub_type = 'service' and superclass is not null"), t["method"], t["field"])


@query("""SELECT concat('Part', p_partkey, 'Service') AS class_name, concat(concat('Part', p_partkey, 'Service'), ',', concat('find', p_partkey), ',setAudit,helper') AS methods, 4 AS n_methods,
array_to_string(list_sort([concat('Part', p_partkey, 'Mapper mapper'), 'int LIMIT', concat('Part', p_partkey, 'Desk desk')]), ',') AS fields, array_to_string(list_sort([concat('part', p_partkey, 'Mapper'), concat('part', p_partkey, 'Desk'), concat('part', p_partkey, 'Audit')]), ',') AS depends_on FROM part""")
def class_specification(spark, sf):
    t = _code_once(spark, sf)
    b = linkage.beans_of(t["class"])
    rows = classspec.class_rows(t["class"].filter("superclass is not null"), t["method"], t["field"], linkage.bean_dependencies(b, t["field"], t["method"]), b)
    return rows.select("class_name", "methods", "n_methods", "fields", "depends_on")


@query("""SELECT concat('Part', p_partkey, 'Service') AS src_class, unnest(['open', 'touch', concat('find', p_partkey), 'helper', 'println']) AS dst_method,
unnest([concat('com.shop', p_size, '.desk'), NULL, concat('com.shop', p_size, '.mapper'), concat('com.shop', p_size, '.service'), NULL]) AS dst_package FROM part""")
def callee_packages(spark, sf):
    """Packages of callees looked up by their class, as if the calls had none."""
    parsed = materialize(_parsed(spark, sf))
    calls = calltargets.resolve_calls(parsed, "shop").withColumn("dst_package", F.lit(""))
    return linkage.package_of_callees(calls, java.tables_of(parsed, "shop")["class"]).select("src_class", "dst_method", "dst_package")


LOMBOK = """package a; @Data public class Row@k@ { private String name; boolean open; static int n; }
class Other@k@ { int x; }
"""


@query("""SELECT concat('Row', p_partkey) AS class_name, unnest(['getName', 'setName', 'isOpen', 'setOpen', 'getN', 'setN', 'equals', 'hashCode', 'toString']) AS name, unnest(['String', 'void', 'boolean', 'void', 'int', 'void', 'boolean', 'int', 'String']) AS return_type FROM part""")
def lombok_accessors(spark, sf):
    t = java.tables_of(java.parsed_classes(_sources(spark, sf, **{"Row_.java": LOMBOK})), "p")
    return N.lombok_methods(t["class"], t["field"]).select("class_name", "name", "return_type")


CONTROLLER = """package web;
@RestController
@RequestMapping("/api/p@k@")
@Tag(name = "x", description = "Parts @k@")
public class Part@k@Controller {
    @GetMapping("/one")
    public String one() { return ""; }
    @RequestMapping(value = "two", method = RequestMethod.POST)
    public void two() {}
    @DeleteMapping
    public void gone() {}
    void plain() {}
}
@Controller
class Bare@k@Controller { @PutMapping(path = "/x@size@") void put() {} }
"""


@query("""SELECT concat('Part', p_partkey, 'Controller') AS controller_class, unnest(['one', 'two', 'gone']) AS handler_method, unnest(['/one', 'two', '/']) AS path, unnest([concat('/api/p', p_partkey, '/one'), concat('/api/p', p_partkey, '/two'), concat('/api/p', p_partkey)]) AS full_path, unnest(['GET', 'POST', 'DELETE']) AS method FROM part
UNION ALL SELECT concat('Bare', p_partkey, 'Controller'), 'put', concat('/x', p_size), concat('/x', p_size), 'PUT' FROM part""")
def endpoints(spark, sf):
    t = java.tables_of(java.parsed_classes(_sources(spark, sf, **{"C_.java": CONTROLLER})), "p")
    return classspec.endpoints(t["class"], t["method"]).drop("project")


@query("""SELECT concat('Part', p_partkey, 'Controller') AS name, concat('Parts ', p_partkey) AS description FROM part UNION ALL SELECT concat('Bare', p_partkey, 'Controller'), '' FROM part""")
def descriptions(spark, sf):
    t = java.tables_of(java.parsed_classes(_sources(spark, sf, **{"C_.java": CONTROLLER})), "p")
    return t["class"].select("name", N.description(F.col("annotations")).alias("description"))


ENTITY = """package model;
@Entity
@Table(name = "T@k@")
public class Part@k@ {
    @Id private Long id;
    @Column(name = "P_NAME", nullable = false, unique = true)
    private String name;
    private BigDecimal retailPrice;
    @Transient private String note;
    static int count;
    @OneToMany(mappedBy = "part", fetch = FetchType.EAGER)
    private List<Item> items;
    @ManyToOne @JoinColumn(name = "maker_id") private Maker maker;
    @ManyToMany private Set<Tag> tags;
}
@Repository
interface Part@k@Repository extends JpaRepository<Part@k@, Long> {
    @Query("select p from Part p") List<Part@k@> all();
    @Modifying @Query(value = "delete from T@k@", nativeQuery = true) int wipe();
    @NamedQuery(name = "n", query = "select 1") int named();
    List<Part@k@> findByNameOrderBySize(String name);
    Page<Part@k@> findPageBySize(int size);
    long countByMaker(String maker);
}
interface SmallRepository@k@ {}
"""


def _jpa(spark, sf):
    return java.tables_of(java.parsed_classes(_sources(spark, sf, **{"E_.java": ENTITY})), "p")


@query("SELECT concat('Part', p_partkey) AS entity, concat('T', p_partkey) AS table_name FROM part")
def jpa_entities(spark, sf):
    return jpa.entities(_jpa(spark, sf)["class"]).select("entity", "table_name")


@query("""SELECT concat('Part', p_partkey) AS entity, unnest(['id', 'name', 'retailPrice']) AS property, unnest(['id', 'P_NAME', 'retail_price']) AS column_name, unnest(['Long', 'String', 'BigDecimal']) AS java_type, unnest([false, false, true]) AS nullable, unnest([false, true, false]) AS "unique", unnest([true, false, false]) AS primary_key FROM part""")
def jpa_columns(spark, sf):
    t = _jpa(spark, sf)
    return jpa.entity_columns(jpa.entities(t["class"]), t["field"]).drop("project", "table_name")


@query("""SELECT concat('Part', p_partkey) AS entity, unnest(['items', 'maker', 'tags']) AS property, unnest(['OneToMany', 'ManyToOne', 'ManyToMany']) AS type, unnest(['Item', 'Maker', 'Tag']) AS target_entity, unnest(['part', NULL, NULL]) AS mapped_by, unnest([NULL, 'maker_id', NULL]) AS join_column,
unnest(['EAGER', 'LAZY', 'LAZY']) AS fetch, unnest(['good', 'good', 'needs_review']) AS quality FROM part""")
def jpa_relationships(spark, sf):
    t = _jpa(spark, sf)
    return jpa.relationships(jpa.entities(t["class"]), t["field"]).drop("project")


@query("""SELECT concat('Part', p_partkey, 'Repository.', x[1]) AS name, x[2] AS query_type, replace(x[3], '@', CAST(p_partkey AS VARCHAR)) AS query, x[4] = 'y' AS is_modifying, x[5] AS operation, x[6] AS entity_field, x[7] = 'y' AS is_sorted, x[8] = 'y' AS is_paged FROM part,
(SELECT unnest([['all', 'JPQL', 'select p from Part p', '', 'SELECT', '', '', ''], ['wipe', 'NATIVE', 'delete from T@', 'y', 'SELECT', '', '', ''], ['named', 'NAMED', 'select 1', '', 'SELECT', '', '', ''],
['findByNameOrderBySize', 'METHOD', '', '', 'SELECT', 'NameOrderBySize', 'y', ''], ['findPageBySize', 'METHOD', '', '', 'SELECT', '', '', 'y'], ['countByMaker', 'METHOD', '', '', 'COUNT', 'Maker', '', '']]) AS x)""")
def jpa_queries(spark, sf):
    t = _jpa(spark, sf)
    return jpa.repository_queries(jpa.repositories(t["class"]), t["method"]).drop("project", "repository")


@query("""SELECT concat('Part', p_partkey) AS entity, concat(CASE WHEN p_partkey % 3 = 0 THEN 'T' ELSE 't' END, p_partkey) AS table_name, CASE WHEN p_partkey % 3 = 0 THEN 'entity_only' ELSE 'both' END AS side FROM part
UNION ALL SELECT NULL, concat('u', p_partkey), 'table_only' FROM part WHERE p_partkey % 5 = 0""")
def entity_tables(spark, sf):
    p = table(spark, sf, "part")
    held = p.filter("p_partkey % 3 <> 0").select(F.concat(F.lit("t"), "p_partkey").alias("name")).union(p.filter("p_partkey % 5 = 0").select(F.concat(F.lit("u"), "p_partkey")))
    return audit.entity_tables(jpa.entities(_jpa(spark, sf)["class"]), held)


TESTS = """package com.shop;
@SpringBootTest
public class Part@k@ServiceTest {
    @MockBean private Part@k@Mapper mapper;
    @BeforeEach void prepare() { when(mapper.count()).thenReturn(1); }
    @Test void finds() { assertEquals(1, 1); assertTrue(true); verify(mapper); }
    @ParameterizedTest @ValueSource(ints = {1, 2}) void counts(int n) { assertThat(n); }
    void help() {}
}
class Row@k@Tests { @Test void one() {} @BeforeMethod void two() {} }
@DataJpaTest class TestDesk@k@ { @Test void one() { doThrow(x); } }
class Helper@k@ { void none() {} }
"""


@query("""SELECT concat('Part', p_partkey, 'ServiceTest') AS class_name, 'junit' AS framework, 'integration' AS test_type, 2 AS n_tests, 1 AS n_setup, 2 AS n_mocks, 3 AS n_assertions FROM part
UNION ALL SELECT concat('Row', p_partkey, 'Tests'), 'testng', 'unit', 1, 1, 0, 0 FROM part UNION ALL SELECT concat('TestDesk', p_partkey), 'junit', 'slice', 1, 0, 1, 0 FROM part""")
def test_class_facts(spark, sf):
    t = java.tables_of(materialize(java.parsed_classes(_sources(spark, sf, **{"T_.java": TESTS}))), "p")
    return classspec.test_facts(t["class"], t["method"]).drop("project")


@query("""SELECT concat('Part', p_partkey, 'ServiceTest') AS test_class, 4 AS n_methods FROM part UNION ALL SELECT concat('Row', p_partkey, 'Tests'), 2 FROM part UNION ALL SELECT concat('TestDesk', p_partkey), 1 FROM part UNION ALL SELECT concat('Helper', p_partkey), 1 FROM part""")
def test_scope(spark, sf):
    t = java.tables_of(java.parsed_classes(_sources(spark, sf, **{"T_.java": TESTS})), "p")
    return stats.test_scope(t["class"], t["method"])


UNIT = """package com.shop;
@ActiveProfiles("p@size@")
@TestPropertySource(properties = "a=b")
class Desk@k@Test {
    @Mock private Clock clock;
    @Spy Desk desk;
    @MockBean Mapper@k@ mapper;
    private Plain plain;
    @BeforeEach void open() { given(clock.now()).willReturn(1); }
    @Test @DisplayName("finds @k@") @Timeout("5") void finds() { Row row = new Row(1); assertEquals(row.id(), desk.find(1)); assertThat(row); verify(desk).find(1); }
    @ParameterizedTest @CsvSource("1,2") void counts(int a, int b) { assertThrows(Oops.class, new Call()); }
    void help() { assertTrue(true); }
}
"""


def _unit(spark, sf):
    return java.tables_of(java.parsed_classes(_sources(spark, sf, **{"Desk_Test.java": UNIT})), "p")


@query("""SELECT concat('Desk', p_partkey, 'Test') AS class_name, x[1] AS name, x[2] AS kind, CASE x[1] WHEN 'finds' THEN concat('finds ', p_partkey) END AS display_name, nullif(x[3], '') AS timeout, x[4] AS assertions, x[5] AS stubs, x[6] AS calls, x[7] AS created, x[8] AS data_sources FROM part,
(SELECT unnest([['open', 'setup', '', '', 'given,willReturn', 'clock.now', '', ''], ['finds', 'test', '5', 'assertEquals,assertThat', 'verify', 'row.id,desk.find', 'Row', ''], ['counts', 'test', '', 'assertThrows', '', '', 'Call', 'CsvSource']]) AS x)""")
def test_method_facts(spark, sf):
    rows = classspec.test_methods(_unit(spark, sf)["method"])
    return rows.select("class_name", "name", "kind", "display_name", "timeout", *[_list(c).alias(c) for c in ("assertions", "stubs", "calls", "created", "data_sources")])


@query("""SELECT concat('Desk', p_partkey, 'Test') AS class_name, unnest(['clock', 'desk', 'mapper']) AS name, unnest(['Clock', 'Desk', concat('Mapper', p_partkey)]) AS type, unnest(['mock', 'spy', 'bean']) AS mock_type FROM part""")
def test_mocks(spark, sf):
    return classspec.test_mocks(_unit(spark, sf)["field"]).drop("project")


@query("""SELECT concat('Desk', p_partkey, 'Test') AS class_name, unnest(['profile', 'property']) AS kind, unnest([concat('p', p_size), 'a=b']) AS value FROM part""")
def test_configurations(spark, sf):
    return classspec.test_configurations(_unit(spark, sf)["class"]).drop("project")


@query("""SELECT concat('Part', p_partkey, 'Service') AS class_name, concat('# Part', p_partkey, 'Service', chr(10), chr(10), 'service class in com.shop', p_size, '.service, extends BaseService', chr(10), chr(10), '## Interfaces', chr(10), '- PartPort', chr(10), '- AutoCloseable', chr(10), chr(10), '## Fields', chr(10), '- ',
array_to_string(list_sort([concat('Part', p_partkey, 'Mapper mapper'), 'int LIMIT', concat('Part', p_partkey, 'Desk desk')]), concat(chr(10), '- ')), chr(10), chr(10), '## Methods', chr(10), '- Part', p_partkey, 'Service', chr(10), '- find', p_partkey, chr(10), '- setAudit', chr(10), '- helper', chr(10), chr(10), '## Depends on', chr(10), '- ',
array_to_string(list_sort([concat('part', p_partkey, 'Mapper'), concat('part', p_partkey, 'Desk'), concat('part', p_partkey, 'Audit')]), concat(chr(10), '- '))) AS text FROM part""")
def class_texts(spark, sf):
    """Specifications of classes as Markdown."""
    t = _code_once(spark, sf)
    b = linkage.beans_of(t["class"])
    return report.class_text(classspec.class_rows(t["class"].filter("superclass is not null"), t["method"], t["field"], linkage.bean_dependencies(b, t["field"], t["method"]), b))


# Mapper XML

MAPPER_XML = """<?xml version="1.0"?>
<!DOCTYPE mapper PUBLIC "-//x//DTD Mapper 3.0//EN" "x.dtd">
<!-- Parts @k@ -->
<mapper namespace="com.shop.mapper.Part@k@Mapper">
  <resultMap id="row" type="Part"><id property="id" column="ID"/><result property="name" column="P_NAME"/><result property="x"/></resultMap>
  <resultMap id="none" type="Part"></resultMap>
  <sql id="cols">id, name</sql>
  <!-- all of them -->
  <select id="find@k@" resultMap="row" parameterType="int">SELECT <include refid="cols"/> FROM t@k@ p <where><if test="x">p.size = #{x}</if></where></select>
  <insert id="add">INSERT INTO t@k@ (id, name) VALUES (#{id}, ?)</insert>
  <update id="put">UPDATE t@k@ <set>name = #{n}, size = 1</set> WHERE id = #{i}</update>
  <delete id="drop">DELETE FROM t@k@ WHERE id = 1 AND size = 2</delete>
</mapper>
"""


def _xml(spark, sf):
    return mapper_xml.mapper_rows(_sources(spark, sf, **{"Part_Mapper.xml": MAPPER_XML, "Other_.xml": "<beans/>", "Bad_.xml": "<mapper"}))


@query("""SELECT concat('Part', p_partkey, 'Mapper') AS mapper_name, concat('Parts ', p_partkey) AS mapper_logical_name, replace(x[1], '@', CAST(p_partkey AS VARCHAR)) AS id, x[2] AS kind, nullif(x[3], '') AS sql_type, replace(x[4], '@', CAST(p_partkey AS VARCHAR)) AS sql_content, nullif(x[5], '') AS result_map, replace(x[6], '@', CAST(p_partkey AS VARCHAR)) AS logical_name FROM part,
(SELECT unnest([['find@', 'statement', 'SELECT', 'SELECT id, name FROM t@ p WHERE p.size = #{x}', 'row', 'all of them'], ['add', 'statement', 'INSERT', 'INSERT INTO t@ (id, name) VALUES (#{id}, ?)', '', 'all of them'], ['put', 'statement', 'UPDATE', 'UPDATE t@ SET name = #{n}, size = 1 WHERE id = #{i}', '', 'all of them'],
['drop', 'statement', 'DELETE', 'DELETE FROM t@ WHERE id = 1 AND size = 2', '', 'all of them'], ['cols', 'fragment', '', 'id, name', '', 'Parts @']]) AS x)""")
def mapper_statements(spark, sf):
    rows = _xml(spark, sf).filter("kind <> 'result_map'")
    return rows.select("mapper_name", "mapper_logical_name", "id", "kind", "sql_type", "sql_content", "result_map", "logical_name")


@query("""SELECT concat('Part', p_partkey, 'Mapper') AS mapper_name, unnest(['row', 'none']) AS result_map, unnest([3, 0]) AS n_properties, unnest([2, 0]) AS n_mapped, unnest([CAST(66.6667 AS DOUBLE), CAST(0 AS DOUBLE)]) AS completeness, unnest([concat('find', p_partkey), '']) AS used_by FROM part""")
def result_map_audit(spark, sf):
    rows = materialize(_xml(spark, sf))
    return audit.result_maps(rows.filter("kind = 'result_map'"), rows.filter("kind = 'statement'"))


@query("""SELECT concat('Part', p_partkey, 'Mapper') AS mapper_name, replace(x[1], '@', CAST(p_partkey AS VARCHAR)) AS id, x[2] AS columns, x[3] AS parameters, CAST(x[4] AS INTEGER) AS complexity_score, concat('t', p_partkey) AS table_name FROM part,
(SELECT unnest([['find@', 'id,name', 'x', '3'], ['add', 'id,name', '?x1,id', '2'], ['put', 'name,size', 'n,i', '3'], ['drop', '', '', '3']]) AS x)""")
def mapper_facts(spark, sf):
    """Facts about the statements that mapper files hold: from XML to columns."""
    rows = sqlmeta.analyse(_xml(spark, sf).filter("kind = 'statement'"))
    return rows.select("mapper_name", "id", _list("columns", "name").alias("columns"), _list("parameters").alias("parameters"), "complexity_score", F.col("tables")[0]["name"].alias("table_name"))


# SQL statements of every type

_STATEMENTS = [
    "SELECT o.id, c.name AS who, total FROM s.orders@k@ o LEFT JOIN customer c ON c.id = o.cust_id WHERE o.total > (SELECT avg(x) FROM hist) AND c.id IN (1, 2) GROUP BY o.id, c.name HAVING count(*) > 1 ORDER BY total",
    "INSERT INTO s.orders@k@ (id, name, total) VALUES (#{id}, :name, (SELECT max(y) FROM hist))",
    "UPDATE orders@k@ SET name = #{n}, total = 2 WHERE id = :id AND x = 1",
    "DELETE FROM orders@k@ WHERE id IN (SELECT id FROM hist) OR k = ?",
    "MERGE INTO orders@k@ USING x ON x.id = orders@k@.id",
]
_FACTS = [
    ("SELECT", "orders@,customer,hist", "LEFT", "id,name,total", "", 10, "subqueries,grouping", "orders@=id,total|customer=name,total|hist=avg(x)"),
    ("INSERT", "orders@,hist", "", "id,name,total", "id,name", 2, "", "orders@=id,name,total|hist=max(y)"),
    ("UPDATE", "orders@", "", "name,total", "n,id", 3, "", "orders@=name,total"),
    ("DELETE", "orders@,hist", "", "", "?x1", 3, "", "orders@=|hist=id"),
    ("MERGE", "", "", "", "", 1, "", ""),
]


def _cases(k: int) -> str:
    return "CASE p_size % 5 " + " ".join(f"WHEN {n} THEN replace('{f[k]}', '@', CAST(p_partkey AS VARCHAR))" for n, f in enumerate(_FACTS)) + " END"


def _statements(spark, sf):
    p = table(spark, sf, "part")
    text, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, sql in enumerate(_STATEMENTS):
        text = F.when(F.col("p_size") % 5 == n, _filled(sql, k=F.col("p_partkey"))).otherwise(text)
        kind = F.when(F.col("p_size") % 5 == n, _FACTS[n][0]).otherwise(kind)
    return p.select("p_partkey", text.alias("sql_content"), kind.alias("sql_type"))


@query(f"""SELECT p_partkey, {_cases(0)} AS sql_type, {_cases(1)} AS tables, {_cases(2)} AS joins, {_cases(3)} AS columns, {_cases(4)} AS parameters, CAST(CASE p_size % 5 WHEN 0 THEN 10 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 1 END AS INTEGER) AS complexity_score,
CASE p_size % 5 WHEN 0 THEN 'complex' ELSE 'simple' END AS complexity_level, {_cases(6)} AS characteristics, CASE p_size % 5 WHEN 0 THEN 'consider joins instead' ELSE '' END AS recommendations FROM part""")
def statement_facts(spark, sf):
    """SELECT, INSERT, UPDATE, DELETE and another type: what is read of each."""
    r = sqlmeta.analyse(_statements(spark, sf))
    lists = [_list("tables", "name").alias("tables"), _list("joins", "kind").alias("joins"), _list("columns", "name").alias("columns"), _list("parameters").alias("parameters")]
    return r.select("p_partkey", "sql_type", *lists, "complexity_score", "complexity_level", _list("characteristics").alias("characteristics"), _list("recommendations").alias("recommendations"))


@query(f"""SELECT p_partkey, split_part(x, '=', 1) AS table_name, split_part(x, '=', 2) AS columns FROM (SELECT p_partkey, unnest(string_split({_cases(7)}, '|')) AS x FROM part WHERE p_size % 5 < 4)""")
def table_column_lineage(spark, sf):
    """Which columns of which tables statements read or write."""
    rows = sqlmeta.analyse(_statements(spark, sf)).select("p_partkey", F.explode("table_columns").alias("table_name", "c"))
    return rows.select("p_partkey", "table_name", _list("c").alias("columns"))


@query("""SELECT p_partkey, p_size % 5 IN (0, 1, 2, 3) AND p_partkey % 2 = 0 AS touches, p_size % 5 = 0 AS in_part FROM part""")
def touches_table(spark, sf):
    """Statements that use a table by name, and by part of a name."""
    rows = sqlmeta.analyse(_statements(spark, sf).withColumn("sql_content", F.when(F.col("p_partkey") % 2 == 0, F.regexp_replace("sql_content", r"orders\d+", "Orders")).otherwise(F.col("sql_content"))))
    return rows.select("p_partkey", predicates.touches_table(F.col("tables"), "orders").alias("touches"), predicates.touches_table(F.col("tables"), "CUSTOM", compat=True).alias("in_part"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN concat('a', p_partkey, ',b') WHEN 1 THEN concat('a', p_partkey, ',c') ELSE 't1' END AS tables FROM part""")
def lenient_tables(spark, sf):
    p = table(spark, sf, "part")
    text = F.when(F.col("p_size") % 3 == 0, _filled('[{"name":"a@k@"},{"name":"b"}]', k=F.col("p_partkey"))).when(F.col("p_size") % 3 == 1, _filled(" a@k@ , c,", k=F.col("p_partkey"))).otherwise("[]")
    columns = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(t).alias("table")) for c, t in (("x", "t1"), ("y", "t1"), ("z", None))])
    return p.select("p_partkey", F.array_join(N.lenient_tables(text, columns), ",").alias("tables"))


# DDL

DDL = """-- Database: db@size@
-- Environment: test
/* CREATE TABLE gone (a INT); */
CREATE TABLE IF NOT EXISTS s1.t@k@ (
  id BIGINT PRIMARY KEY, -- the key
  p_name VARCHAR(55) NOT NULL UNIQUE,
  price DECIMAL(10, 2) DEFAULT 0.5,
  size_no INT CHECK (size_no IN (1, 2, 3)),
  CONSTRAINT fk_@k@ FOREIGN KEY (id) REFERENCES parent(id)
);
create table plain@k@ (a INT);
CREATE UNIQUE INDEX ix_@k@ ON s1.t@k@ USING btree (p_name, price);
CREATE INDEX iy_@k@ ON t@k@(price);
ALTER TABLE ONLY t@k@ ADD CONSTRAINT ck_@k@ CHECK (price > 0);
"""


def _scripts(spark, sf):
    return _sources(spark, sf, **{"prod_.sql": DDL})


@query("""SELECT concat('db', p_size) AS database_name, unnest(['s1', NULL]) AS schema, unnest([concat('t', p_partkey), concat('plain', p_partkey)]) AS table_name FROM part""")
def ddl_tables(spark, sf):
    return ddl.tables(_scripts(spark, sf)).select("database_name", "schema", "table_name")


@query("""SELECT concat('plain', p_partkey) AS table_name, 1 AS n FROM part""")
def ddl_tables_strict(spark, sf):
    """The narrower reading, without IF NOT EXISTS and schemas."""
    return ddl.tables(_scripts(spark, sf), strict=True).groupBy("table_name").agg(F.count("*").alias("n"))


@query("""SELECT concat('t', p_partkey) AS table_name, unnest([1, 2, 3, 4]) AS position, unnest(['id', 'p_name', 'price', 'size_no']) AS name, unnest(['BIGINT', 'VARCHAR(55)', 'DECIMAL(10, 2)', 'INT']) AS data_type, unnest([false, false, true, true]) AS nullable, unnest([false, true, false, false]) AS "unique",
unnest([true, false, false, false]) AS primary_key, unnest([NULL, NULL, '0.5', NULL]) AS "default" FROM part UNION ALL SELECT concat('plain', p_partkey), 1, 'a', 'INT', true, false, false, NULL FROM part""")
def ddl_columns(spark, sf):
    return ddl.columns(ddl.tables(_scripts(spark, sf))).drop("database_name")


@query("""SELECT concat('t', p_partkey) AS table_name, unnest([concat('ix_', p_partkey), concat('iy_', p_partkey)]) AS name, unnest(['UNIQUE', 'B-tree']) AS type, unnest(['p_name,price', 'price']) AS columns FROM part""")
def ddl_indexes(spark, sf):
    return ddl.indexes(_scripts(spark, sf)).select("table_name", "name", "type", _list("columns").alias("columns"))


@query("""SELECT concat('t', p_partkey) AS table_name, unnest([concat('fk_', p_partkey), concat('ck_', p_partkey)]) AS name, unnest(['FOREIGN KEY', 'CHECK']) AS type, unnest(['FOREIGN KEY (id) REFERENCES parent(id)', 'CHECK (price > 0)']) AS definition, unnest(['parent', NULL]) AS ref_table, unnest(['inline', 'alter']) AS source FROM part""")
def ddl_constraints(spark, sf):
    return ddl.constraints(_scripts(spark, sf)).drop("columns", "ref_columns")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat('db', p_size) ELSE concat('prod_', p_partkey) END AS database_name, CASE WHEN p_size % 2 = 0 THEN 'test' ELSE 'prod' END AS environment,
CASE p_size % 5 WHEN 0 THEN 'PRIMARY KEY' WHEN 1 THEN 'FOREIGN KEY' WHEN 2 THEN 'UNIQUE' WHEN 3 THEN 'DEFAULT' ELSE 'UNKNOWN' END AS type FROM part""")
def ddl_names(spark, sf):
    p = table(spark, sf, "part")
    text, path = F.when(F.col("p_size") % 2 == 0, _filled(DDL, k=F.col("p_partkey"), size=F.col("p_size"))).otherwise("CREATE TABLE a (b INT);"), _filled("/x/prod_@k@.sql", k=F.col("p_partkey"))
    body = F.element_at(F.array(*map(F.lit, ("primary key (id) unique", "FOREIGN KEY (a) REFERENCES b", "unique (a)", "default 3", "note"))), F.col("p_size") % 5 + 1)
    return p.select("p_partkey", ddl.database_name(text, path).alias("database_name"), ddl.environment(text, path).alias("environment"), ddl.constraint_type(body).alias("type"))


# Configuration

PROPERTIES = """# comment
server.port=80@size@
spring.datasource.url = "jdbc:x@k@"
empty=
spring.profiles.active=dev
no pair
"""
YAML = """spring:
  profiles:
    active: test
  datasource:
    url: jdbc:y@k@
    username: u@size@
server:
  port: 9090
list: [a, true]
---
other: 1
"""


@query("""SELECT concat('/src/application-p', p_partkey, '.properties') AS file_path, unnest(['server', 'spring', 'empty', 'spring']) AS section, unnest(['server.port', 'spring.datasource.url', 'empty', 'spring.profiles.active']) AS key, unnest([concat('80', p_size), concat('jdbc:x', p_partkey), '', 'dev']) AS value FROM part""")
def properties_values(spark, sf):
    return files.properties(_sources(spark, sf, **{"application-p_.properties": PROPERTIES}))


@query("""SELECT concat('/src/application-y', p_partkey, '.yml') AS file_path, x[1] AS section, x[2] AS key, replace(replace(x[3], '@k', CAST(p_partkey AS VARCHAR)), '@s', CAST(p_size AS VARCHAR)) AS value FROM part,
(SELECT unnest([['spring', 'spring.profiles.active', 'test'], ['spring', 'spring.datasource.url', 'jdbc:y@k'], ['spring', 'spring.datasource.username', 'u@s'], ['server', 'server.port', '9090'], ['list', 'list[0]', 'a'], ['list', 'list[1]', 'true']]) AS x)""")
def yaml_values(spark, sf):
    return config.yaml_values(_sources(spark, sf, **{"application-y_.yml": YAML, "bad_.yml": ":\n  - ]["}))


@query("""SELECT concat('/src/application-p', p_partkey, '.properties') AS file_path, 'properties' AS kind, concat('p', p_partkey) AS profile, 'dev' AS active_profiles, 'dev' AS environment, concat('jdbc:x', p_partkey) AS database_url, NULL AS database_user, CAST(concat('80', p_size) AS INTEGER) AS server_port, 'empty,server,spring' AS sections, 4 AS n_keys FROM part
UNION ALL SELECT concat('/src/application-y', p_partkey, '.yml'), 'yaml', concat('y', p_partkey), 'test', 'test', concat('jdbc:y', p_partkey), concat('u', p_size), 9090, 'list,server,spring', 6 FROM part""")
def config_summary(spark, sf):
    found = _sources(spark, sf, **{"application-p_.properties": PROPERTIES, "application-y_.yml": YAML})
    rows = config.summary(config.yaml_values(found).unionByName(files.properties(found)))
    return rows.select("file_path", "kind", "profile", "active_profiles", "environment", "database_url", "database_user", "server_port", _list("sections").alias("sections"), "n_keys")


@query("""SELECT unnest(['java', 'mapper_xml', 'xml', 'unknown']) AS kind, count(*) AS n FROM part""")
def file_kinds(spark, sf):
    found = _sources(spark, sf, **{"A_.java": "x", "A_.xml": "<mapper namespace='@k@'/>", "B_.xml": "<beans/>", "C_.txt": "<mapper"})
    return found.groupBy(files.file_kind(F.col("file_path"), F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


# Names and texts


@query("""SELECT event_type AS kind, count(*) AS n, CASE event_type WHEN 'click' THEN 'junit' WHEN 'view' THEN 'spring_test' WHEN 'purchase' THEN 'testng' WHEN 'signup' THEN 'mockito' ELSE 'unknown' END AS family,
CASE event_type WHEN 'click' THEN 'public' WHEN 'view' THEN 'private' ELSE 'package' END AS visibility, event_type IN ('click', 'view') AS narrow, CASE event_type WHEN 'click' THEN 'retryable' WHEN 'view' THEN 'fatal' ELSE 'unknown' END AS error,
CASE event_type WHEN 'click' THEN 'm | t' WHEN 'view' THEN 't' ELSE 'void' END AS returns FROM events GROUP BY event_type""")
def more_name_rules(spark, sf):
    kinds = ("click", "view", "purchase", "signup", "error")

    def pick(*values) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in zip(kinds, values) for x in pair]), F.col("event_type"))

    modifiers = F.when(F.col("event_type") == "click", F.array(F.lit("static"), F.lit("public"))).when(F.col("event_type") == "view", F.array(F.lit("private"))).otherwise(F.array(F.lit("final")))
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("kind"), N.test_family(pick("Test", "MockBean", "DataProvider", "Mock", "Foo")).alias("family"), N.visibility(modifiers).alias("visibility"),
        N.is_external_narrow(pick("java.util", "org.apache.x", "javafoo", "", "com.own")).alias("narrow"), N.error_class(pick("HTTP 429", "Invalid API key", "boom", "14001", "x")).alias("error"),
        N.sql_return_type(pick("m", "", "", "", ""), pick("t", "t", "", "", "")).alias("returns"),
    )
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query("""SELECT event_id, concat('a_', event_id, '_b_') AS id, concat('answer ', event_id) AS reply, concat('plain ', event_type) AS other, strftime(make_timestamp(2024, 1, 1, CAST(event_id % 24 AS BIGINT), 5, 6), '%Y-%m-%d %H:%M:%S') AS stamp FROM events""")
def reply_texts(spark, sf):
    e = table(spark, sf, "events")
    reply = F.concat(F.lit("<think>\nhm\n</think>\n```text\nanswer "), "event_id", F.lit("\n```"))
    stamp = F.concat(F.lit("20240101-"), F.lpad((F.col("event_id") % 24).cast("string"), 2, "0"), F.lit("0506"))
    return e.select("event_id", N.mermaid_id(F.concat(F.lit("a."), "event_id", F.lit("-b "))).alias("id"), N.clean_reply(reply).alias("reply"), N.clean_reply(F.concat(F.lit(" plain "), "event_type", F.lit("\n"))).alias("other"), N.stamp_text(stamp).alias("stamp"))


@query("""SELECT event_type, event_type = 'click' AS noise, event_type IN ('click', 'view') AS suppressed, event_type = 'view' AS in_project, event_type <> 'purchase' AS any_project, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY event_type""")
def call_filters(spark, sf):
    e = table(spark, sf, "events").filter("event_type in ('click', 'view', 'purchase')")

    def pick(a, b, c) -> Column:
        return F.when(F.col("event_type") == "click", a).when(F.col("event_type") == "view", b).otherwise(c)

    rows = e.select(
        "event_type", predicates.is_noise_call(F.lit("A"), pick("A", "A", "B"), pick("equals", "load", "hashCode")).alias("noise"), predicates.is_suppressed_call(pick("log", "x", "log"), pick("info", "forEach", "load")).alias("suppressed"),
        predicates.in_project(pick("q", "p", ""), "p").alias("in_project"), F.when(F.col("event_type") == "purchase", F.lit(False)).otherwise(predicates.in_project(pick("q", "p", ""), None)).alias("any_project"),
    )
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'kept' WHEN p_size % 4 = 1 THEN concat('about ', p_partkey) END AS ai_description FROM part""")
def described(spark, sf):
    """Descriptions from a provider for rows that have a source and no description."""
    p = table(spark, sf, "part")
    source = F.when(F.col("p_size") % 4 <= 1, F.col("p_partkey").cast("string")).when(F.col("p_size") % 4 == 2, "")
    rows = p.select("p_partkey", F.lit("C").alias("class_name"), F.lit("m").alias("name"), source.alias("source"), F.when(F.col("p_size") % 4 == 0, "kept").alias("ai_description"))
    return enrich.describe(rows, lambda prompts: [f"<think>x</think> about {x} " for x in prompts], ["p_partkey"]).select("p_partkey", "ai_description")


@query("""SELECT count(*) AS n FROM part WHERE p_size % 4 = 1""")
def needs_description(spark, sf):
    p = table(spark, sf, "part").select(F.when(F.col("p_size") % 4 <= 1, "s").alias("source"), F.when(F.col("p_size") % 4 == 0, "kept").alias("ai_description"))
    return predicates.needs_enrichment(p).agg(F.count("*").alias("n"))


@query("""SELECT CASE p_size % 3 WHEN 0 THEN 'retryable' WHEN 1 THEN 'fatal' ELSE 'unknown' END AS class, count(*) AS n FROM part GROUP BY 1""")
def error_report(spark, sf):
    p = table(spark, sf, "part")
    return enrich.error_report(p.select(F.element_at(F.array(F.lit("503 busy"), F.lit("401"), F.lit("odd")), F.col("p_size") % 3 + 1).alias("message")))


# Tables, reports, runs


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderpriority END AS o_orderpriority, o_orderstatus FROM orders""")
def update_columns(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    changes = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "new").alias("o_orderpriority")).filter("o_orderkey % 2 = 0 or o_orderpriority is not null")
    return upsert.update_columns(o, changes, ["o_orderkey"], ["o_orderpriority"])


@query("""SELECT 'nation' AS label, count(*) AS n FROM nation UNION ALL SELECT 'customer', 0 UNION ALL SELECT 'supplier', 0""")
def dropped_tables(spark, sf):
    held = {name: table(spark, sf, name) for name in ("nation", "customer", "supplier")}
    return summary.run_counts(upsert.drop_all(held, ("customer", "supplier")))


@query("""SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation""")
def sheets(spark, sf):
    """Sheets written as files and read back."""
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    folder = f"{shared_dir(spark)}/sheets-{uuid.uuid4().hex}"
    report.write_sheets({"nations": rows}, folder)
    return spark.read.schema(rows.schema).option("header", True).csv(f"{folder}/nations")


@query("""SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def json_sheets(spark, sf):
    """Sheets written as lines of JSON and read back."""
    per = linkage.Branch(table(spark, sf, "orders"), {"id": "o_custkey"}, counts={"orders": "o_orderkey"})
    rows = linkage.optional_match(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), [per])
    folder = new_folder(spark)
    report.write_sheets({"customers": rows}, folder, "json")
    return spark.read.schema(rows.schema).json(f"{folder}/customers")


@query(f"""{CTES}, e AS (SELECT DISTINCT split_part(src, '.', 1) AS a, split_part(dst, '.', 1) AS b FROM edges WHERE src LIKE 'C%'), l AS (SELECT a, b, concat('    ', a, '["', a, '"] -->|calls| ', b, '["', b, '"]') AS line FROM e)
SELECT concat('graph LR', chr(10), string_agg(line, chr(10) ORDER BY a, b)) AS text FROM l""")
def mermaid_chart(spark, sf):
    e = TestGraph(spark, sf).edges.filter("src like 'C%'").select(F.substring_index("src", ".", 1).alias("src"), F.substring_index("dst", ".", 1).alias("dst"), F.lit("calls").alias("label")).distinct()
    return report.mermaid_graph(e, "LR")


@query(f"""{CTES}, n AS (SELECT mapper_name AS name, count(*) AS n FROM statements GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS k FROM n)
SELECT concat('| name | n |', chr(10), '|---|---|', chr(10), string_agg(concat('| ', name, ' | ', n, ' |'), chr(10) ORDER BY k)) AS text FROM r WHERE k <= 10""")
def top_mappers(spark, sf):
    """The ten mappers with the most statements, as a table of a report."""
    rows = stats.mapper_distribution(TestGraph(spark, sf).statements).select(F.col("mapper_name").alias("name"), "n")
    return report.top_table(rows, "n", ["name"], 10)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS name, CAST(c_custkey * 1500 AS BIGINT) AS duration_ms, printf('%02d:%02d:%02d', c_custkey * 3 // 2 // 3600, c_custkey * 3 // 2 // 60 % 60, c_custkey * 3 // 2 % 60) AS duration FROM customer""")
def run_times(spark, sf):
    started = F.timestamp_seconds(F.lit(1_700_000_000))
    runs = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("name"), started.alias("started"), F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("c_custkey") * 1500).alias("ended"))
    return summary.run_statistics(runs).select("name", "duration_ms", "duration")


@query(f"""{CTES} SELECT mapper_name, count(*) AS n FROM statements WHERE complexity_score > 3 GROUP BY 1""")
def lineage_sql(spark, sf):
    """Tables saved, loaded by name and asked in SQL."""
    g, target = TestGraph(spark, sf), f"{shared_dir(spark)}/lineage-{uuid.uuid4().hex}"
    project.save({"sql_statement": g.statements, "uses": g.uses}, target)
    return project.Lineage.load(spark, target, ["sql_statement", "uses"]).sql(spark, "SELECT mapper_name, count(*) AS n FROM sql_statement WHERE complexity_score > 3 GROUP BY 1")


@query(f"""{CTES} SELECT project, mapper_name, id FROM statements s WHERE sql_type = 'MERGE'""")
def unused_statements(spark, sf):
    g = TestGraph(spark, sf)
    return summary.unused_statements(g.statements, g.runs.filter("sql_type <> 'MERGE'")).select("project", "mapper_name", "id")


@query(f"""{CTES} SELECT DISTINCT table_name FROM uses WHERE table_name NOT IN (SELECT name FROM tables WHERE schema IS NOT NULL)""")
def undefined_tables(spark, sf):
    """Tables that statements use and that are not among those with a schema."""
    g = TestGraph(spark, sf)
    return linkage.missing(g.uses.select("table_name"), g.tables.filter("schema is not null").select(F.col("name").alias("table_name")), ["table_name"])


# Source trees: files written to the shared folder, scanned and ingested


def _put(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def _written(rows: DataFrame) -> None:
    """Writes the texts of rows (path, text) to their paths, each from the task that has it; a task that runs again writes the same."""

    def of(batches):
        import pyarrow.fs

        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(at) as out:
                    out.write(text.encode())
            yield batch[["path"]]

    rows.select("path", "text").mapInPandas(of, "path string").write.format("noop").mode("overwrite").save()


def _folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one, as a URI."""
    top = shared_dir(spark)
    return f"{top if ':' in top.partition('/')[0] else 'file://' + top}/{kind}-{uuid.uuid4().hex}"


def _texts(spark: SparkSession, sf: str, folder: str, templates: dict[str, str], keys: str = "true") -> DataFrame:
    """(path, text): for each supplier that fits one file of each template; @k@ is the supplier's key in names and texts."""
    k = F.col("s_suppkey")
    rows = [F.struct(_filled(f"{folder}/{name}", k=k).alias("path"), _filled(text, k=k, size=k).alias("text")) for name, text in templates.items()]
    found = table(spark, sf, "supplier").filter(keys).select("s_suppkey").repartition(2 * spark.sparkContext.defaultParallelism, "s_suppkey")
    return found.select(F.explode(F.array(*rows)).alias("f")).select("f.*")


def _tree(spark: SparkSession, sf: str) -> str:
    """A source tree with five files for each supplier, and a few others."""
    folder = _folder(spark, "tree")
    _written(_texts(spark, sf, folder, {"src/n@k@/Part@k@Service.java": SERVICE, "src/n@k@/Part@k@Mapper.java": MAPPER, "src/n@k@/Part@k@Mapper.xml": MAPPER_XML, "src/n@k@/application-p@k@.properties": PROPERTIES, "ddl/prod_@k@.sql": DDL}))
    for name in ("ddl/below/x.sql", "src/other.yml", "src/plain.xml", "src/.hidden/x.java"):
        _put(spark, f"{folder}/{name}", "CREATE TABLE x (a INT);")
    return folder


@query("""SELECT 'java' AS kind, 2 * count(*) AS n FROM supplier UNION ALL SELECT 'mapper', count(*) FROM supplier UNION ALL SELECT 'ddl', count(*) FROM supplier UNION ALL SELECT 'config', count(*) FROM supplier UNION ALL SELECT 'all', 5 * count(*) + 3 FROM supplier""")
def scanned_files(spark, sf):
    """How many files each scan of a source tree finds."""
    folder = _tree(spark, sf)
    scans = {"java": files.java_files(spark, f"{folder}/src").filter("file_path not like '%/.hidden/%'"), "mapper": files.mapper_files(spark, f"{folder}/src"), "ddl": files.ddl_files(spark, f"{folder}/ddl"), "config": files.config_files(spark, f"{folder}/src")}
    return summary.run_counts(scans).withColumnRenamed("label", "kind").union(files.file_count(spark, folder).select(F.lit("all"), "total_files"))


def _ingested(spark, sf):
    folder = _tree(spark, sf)
    return project.ingest(spark, f"{folder}/src", "shop", ddl_folder=f"{folder}/ddl")


@query("""SELECT x[1] AS label, CAST(x[2] AS BIGINT) * (SELECT count(*) FROM supplier) AS n FROM (SELECT unnest([['class', '3'], ['method', '8'], ['field', '4'], ['calls', '5'], ['bean', '2'], ['depends_on', '1'], ['sql_statement', '7'], ['sql_link', '4'], ['result_map', '2'],
['db_table', '2'], ['db_column', '5'], ['db_index', '2'], ['db_constraint', '2'], ['config_file', '1'], ['jpa_entity', '0'], ['endpoint', '0'], ['test_class', '0']]) AS x)""")
def ingested_counts(spark, sf):
    """A whole tree, from files to tables."""
    t = _ingested(spark, sf)
    return summary.run_counts({name: t[name] for name in "class method field calls bean depends_on sql_statement sql_link result_map db_table db_column db_index db_constraint config_file jpa_entity endpoint test_class".split()})


@query("""SELECT concat('Part', s_suppkey, 'Mapper') AS mapper_name, replace(x[1], '@', CAST(s_suppkey AS VARCHAR)) AS id, x[2] AS sql_type, replace(x[3], '@', CAST(s_suppkey AS VARCHAR)) AS sql_content FROM supplier,
(SELECT unnest([['find@', 'SELECT', 'SELECT id, name FROM t@ p WHERE p.size = #{x}'], ['dropAll', 'DELETE', ''], ['saveRow', 'INSERT', ''], ['recount', 'SELECT', ''], ['add', 'INSERT', 'INSERT INTO t@ (id, name) VALUES (#{id}, ?)'],
['put', 'UPDATE', 'UPDATE t@ SET name = #{n}, size = 1 WHERE id = #{i}'], ['drop', 'DELETE', 'DELETE FROM t@ WHERE id = 1 AND size = 2']]) AS x)""")
def merged_statements(spark, sf):
    """Statements of mapper interfaces and of mapper files together; a file's statement counts over an annotation's."""
    raw = project.read_sources(spark, f"{_tree(spark, sf)}/src")
    rows = project.statements(java.tables_of(materialize(raw["raw_java"]), "shop"), raw["raw_mapper"], "shop")
    return rows.select("mapper_name", "id", "sql_type", "sql_content")


@query("""SELECT n_nationkey, n_name AS by_class_rule, n_name AS by_own_rule FROM nation""")
def loaded_rules(spark, sf):
    """Rules read from files, a project's own over the general ones, and applied to texts."""
    folder = f"{shared_dir(spark)}/rules-{uuid.uuid4().hex}"
    _put(spark, f"{folder}/base_rule.md", "# Rules\n## Class\nuse `Name: {logical_name};`\n## Method\nuse `Do {logical_name} now`\n")
    _put(spark, f"{folder}/shop_logical_name_rules.md", "## Method\nuse `Fn = {local_name} !`\n")
    found = {title: regex.replace("(?P<logical_name>", "(") for title, regex in rules.load(spark, folder, "shop").items()}
    text = F.concat(F.lit("x Name:  "), "n_name", F.lit("; y Fn =\n"), "n_name", F.lit("\t! Do it now"))
    return table(spark, sf, "nation").select("n_nationkey", F.regexp_extract(text, found["Class"], 1).alias("by_class_rule"), F.regexp_extract(text, found["Method"], 1).alias("by_own_rule"))


@query("""SELECT state, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(CASE s_suppkey % 5 WHEN 0 THEN ['changed', 'same'] WHEN 1 THEN ['removed', 'same'] WHEN 2 THEN ['removed', 'renamed', 'same'] WHEN 3 THEN ['added', 'same', 'same'] ELSE ['same', 'same'] END) AS state, 1 AS n FROM supplier) GROUP BY 1""")
def refreshed_tree(spark, sf):
    """What a second run over a source tree finds: of each supplier's two files some have changed, moved, gone or come."""
    folder, target = _folder(spark, "tree"), _folder(spark, "store")
    _written(_texts(spark, sf, folder, {"Part@k@Mapper.java": MAPPER, "Part@k@Mapper.xml": MAPPER_XML}))
    project.refresh(spark, folder, "shop", target)
    _written(_texts(spark, sf, folder, {"Part@k@Mapper.java": MAPPER.replace("recount", "countAgain")}, "s_suppkey % 5 = 0"))
    _written(_texts(spark, sf, folder, {"Moved@k@Mapper.java": MAPPER}, "s_suppkey % 5 = 2"))
    _written(_texts(spark, sf, folder, {"New@k@.java": "class New@k@ {}"}, "s_suppkey % 5 = 3"))
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for row in table(spark, sf, "supplier").filter("s_suppkey % 5 in (1, 2)").select("s_suppkey").toLocalIterator():
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/Part{row[0]}Mapper.java"), False)
    return project.refresh(spark, folder, "shop", target).groupBy("state").agg(F.count("*").alias("n"))


@query("""SELECT 1 AS version, 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 1, 'lineitem', count(*) FROM lineitem UNION ALL SELECT 2, 'orders', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, 'lineitem', count(*) FROM lineitem""")
def saved_versions(spark, sf):
    """Two versions of one state: the second replaces a table, and the first reads as before."""
    s = Store(spark, _folder(spark, "store"))
    orders = table(spark, sf, "orders")
    s.commit({"orders": orders, "lineitem": table(spark, sf, "lineitem")})
    s.commit({"orders": orders.filter("o_orderstatus = 'F'")})
    counted = [df.agg(F.lit(v).alias("version"), F.lit(n).alias("name"), F.count("*").alias("n")) for v in (1, 2) for n, df in s.read(v).items()]
    return reduce(DataFrame.unionByName, counted)


_PORTS = """package p@k@; interface Port@k@ {} interface Wide@k@ extends Port@k@ {}
@Service class One@k@ implements Port@k@ {} @Service @Primary class Two@k@ implements Wide@k@ {} class Plain@k@ implements Port@k@ {}
@Service class User@k@ { @Autowired private Port@k@ port; @Autowired @Qualifier("one@k@") Port@k@ picked; @Value("${x}") String x; }
@Service class All@k@ { All@k@(java.util.List<Port@k@> all) {} }"""


@query("""SELECT concat(x[1], p_partkey) AS source_bean, concat(x[2], p_partkey) AS target_bean, x[3] AS injection_type, x[4] AS member FROM part, (SELECT unnest([['user', 'two', 'field', 'port'], ['user', 'one', 'field', 'picked'], ['all', 'one', 'constructor', 'all'], ['all', 'two', 'constructor', 'all']]) AS x)""")
def injected_interfaces(spark, sf):
    """Beans that stand in for an interface: the primary one, one by its name, all of them in a list."""
    t = java.tables_of(materialize(java.parsed_classes(_sources(spark, sf, **{"Ports_.java": _PORTS}))), "p")
    return linkage.bean_dependencies(linkage.beans_of(t["class"]), t["field"], t["method"], t["class"]).drop("project")


_BASE = """package lib@k@; public class Base@k@ { protected Repo@k@ repo; protected void save(int n) {} void save(int n, int m) {} static Base@k@ of() { return null; } }
class Repo@k@ { Page@k@ page(int n) { return null; } int count() { return 0; } }
record Page@k@(Item@k@ first) { Item@k@ top() { return first; } } class Item@k@ { Item@k@ go() { return this; } }"""
_CALLER = """package app@k@; import lib@k@.*;
class Caller@k@ extends Base@k@ {
  void up() { super.save(1); save(1, 2); }
  void chain() { repo.page(1).top().go().go(); var p = repo.page(2); p.top(); repo.count(); Base@k@.of().save(3); new Caller@k@().up(); }
  void local(java.util.List<Item@k@> all) { all.forEach(x -> x.act()); for (Item@k@ i : all) i.go(); all.stream().map(Item@k@::go); inner().run(); }
  In inner() { return new In(); } class In { void run() { up(); } }
}"""


@query("""SELECT concat('Caller', p_partkey, x[1]) AS src_class, x[2] AS src_method, concat(x[3], p_partkey) AS dst_package, concat(split_part(x[4], '.', 1), p_partkey, CASE WHEN contains(x[4], '.') THEN '.In' ELSE '' END) AS dst_class, x[5] AS dst_method, CAST(x[6] AS INTEGER) AS call_order FROM part,
(SELECT unnest([['', 'up', 'lib', 'Base', 'save', '1'], ['', 'up', 'lib', 'Base', 'save', '2'], ['', 'chain', 'lib', 'Repo', 'page', '1'], ['', 'chain', 'lib', 'Page', 'top', '2'], ['', 'chain', 'lib', 'Item', 'go', '3'], ['', 'chain', 'lib', 'Item', 'go', '4'], ['', 'chain', 'lib', 'Repo', 'page', '5'],
['', 'chain', 'lib', 'Page', 'top', '6'], ['', 'chain', 'lib', 'Repo', 'count', '7'], ['', 'chain', 'lib', 'Base', 'of', '8'], ['', 'chain', 'lib', 'Base', 'save', '9'], ['', 'chain', 'app', 'Caller', 'up', '10'], ['', 'local', 'lib', 'Item', 'go', '1'], ['', 'local', 'lib', 'Item', 'go', '2'],
['', 'local', 'app', 'Caller', 'inner', '3'], ['', 'local', 'app', 'Caller.In', 'run', '4'], ['.In', 'run', 'app', 'Caller', 'up', '1']]) AS x)""")
def java_call_targets(spark, sf):
    """Calls on super, on results of calls, on names without a written type, in lambdas and through outer classes."""
    parsed = materialize(java.parsed_classes(_sources(spark, sf, **{"Base_.java": _BASE, "Caller_.java": _CALLER})))
    return calltargets.resolve_calls(parsed, "p").select("src_class", "src_method", "dst_package", "dst_class", "dst_method", "call_order")


_SCRIPT = """CREATE TABLE `t@k@` (`id no` BIGINT, note VARCHAR(9) DEFAULT 'a;(b', other INT, PRIMARY KEY (`id no`), UNIQUE (note), FOREIGN KEY (other) REFERENCES "p"."par@k@" ("id")) ENGINE=InnoDB; CREATE TABLE s@k@ (x INT, y INT);
CREATE FUNCTION f() RETURNS int AS $$ CREATE TABLE no (z INT); $$; ALTER TABLE s@k@ ADD COLUMN z TEXT NOT NULL, DROP COLUMN y, ADD PRIMARY KEY (x); CREATE TABLE gone@k@ (g INT); DROP TABLE gone@k@;
"""


@query("""SELECT concat(x[1], p_partkey) AS table_name, CAST(x[2] AS INTEGER) AS position, x[3] AS name, x[4] AS data_type, x[5] = 'y' AS nullable, x[6] = 'y' AS "unique", x[7] = 'y' AS primary_key, nullif(x[8], '') AS "default" FROM part,
(SELECT unnest([['t', '1', 'id no', 'BIGINT', 'n', 'n', 'y', ''], ['t', '2', 'note', 'VARCHAR(9)', 'y', 'y', 'n', concat(chr(39), 'a;(b', chr(39))], ['t', '3', 'other', 'INT', 'y', 'n', 'n', ''], ['s', '1', 'x', 'INT', 'n', 'n', 'y', ''], ['s', '2', 'z', 'TEXT', 'n', 'n', 'n', '']]) AS x)""")
def ddl_folded_columns(spark, sf):
    """Columns after a script's last statement: quoted names, options behind the brackets, keys of whole tables, ALTER and DROP."""
    scripts = _sources(spark, sf, **{"s_.sql": _SCRIPT})
    return ddl.columns(ddl.tables(scripts), ddl.changes(scripts)).drop("database_name")


@query("""SELECT concat(x[1], p_partkey) AS table_name, x[2] AS type, x[3] AS columns, CASE WHEN x[4] <> '' THEN concat(x[4], p_partkey) END AS ref_table, x[5] AS source FROM part, (SELECT unnest([['t', 'PRIMARY KEY', 'id no', '', 'inline'], ['t', 'UNIQUE', 'note', '', 'inline'], ['t', 'FOREIGN KEY', 'other', 'par', 'inline'], ['s', 'PRIMARY KEY', 'x', '', 'alter']]) AS x)""")
def ddl_unnamed_constraints(spark, sf):
    rows = ddl.constraints(_sources(spark, sf, **{"s_.sql": _SCRIPT})).filter("name is null")
    return rows.select("table_name", "type", _list("columns").alias("columns"), "ref_table", "source")


_SCOPES = [
    ("INSERT", "INSERT INTO t@k@ (a, b) SELECT x, y FROM u@k@ JOIN v@k@ ON u@k@.i = v@k@.i", "t@:C,u@:R,v@:R"),
    ("UPDATE", "UPDATE t@k@ SET a = q.b FROM u@k@ q WHERE q.i IN (SELECT i FROM v@k@)", "t@:U,u@:R,v@:R"),
    ("DELETE", "DELETE FROM t@k@ USING u@k@ WHERE t@k@.i = u@k@.i", "t@:D,u@:R"),
    ("SELECT", "WITH c AS (SELECT a FROM t@k@) SELECT a FROM c UNION SELECT b FROM u@k@ WHERE d > (SELECT max(d) FROM (SELECT d FROM v@k@) z)", "t@:R,u@:R,v@:R"),
]


@query("SELECT concat('m', p_partkey) AS class_name, replace(split_part(y, ':', 1), '@', CAST(p_partkey AS VARCHAR)) AS table_name, split_part(y, ':', 2) AS ops FROM (SELECT p_partkey, unnest(string_split(CASE p_partkey % 4 " + " ".join(f"WHEN {n} THEN '{c[2]}'" for n, c in enumerate(_SCOPES)) + " END, ',')) AS y FROM part)")
def scoped_crud(spark, sf):
    """Who writes and who only reads which table, for statements of more than one scope."""
    p = table(spark, sf, "part")
    kind, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (t, sql, _) in enumerate(_SCOPES):
        here = F.col("p_partkey") % 4 == n
        kind, text = F.when(here, t).otherwise(kind), F.when(here, _filled(sql, k=F.col("p_partkey"))).otherwise(text)
    name = F.concat(F.lit("m"), F.col("p_partkey").cast("string"))
    s = sqlmeta.analyse(p.select(F.lit("p").alias("project"), name.alias("mapper_name"), F.lit("q").alias("id"), kind.alias("sql_type"), text.alias("sql_content")))
    runs = s.select("project", F.lit("").alias("package_name"), F.col("mapper_name").alias("class_name"), F.lit("q").alias("method"), "mapper_name", F.col("id").alias("sql_id"), "sql_type")
    return crud.matrix(crud.accesses(runs, project.Lineage({"sql_statement": s}).uses())).select("class_name", "table_name", "ops")


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN NULL ELSE concat('on ', s_name) END AS ai_description FROM supplier""")
def resumed_enrichment(spark, sf):
    """Descriptions by way of a ledger in two runs: the first fails for a third of the rows for now and for another third for good."""

    def reply(prompts, busy):
        if any(p.startswith("0") for p in prompts):
            raise OSError("400 bad request")
        if busy and any(p.startswith("1") for p in prompts):
            raise OSError("503 unavailable")
        return [f"<think>{p}</think>on {p[1:]}" for p in prompts]

    rows = table(spark, sf, "supplier").select("s_suppkey", F.concat((F.col("s_suppkey") % 3).cast("string"), "s_name").alias("source"), F.lit(None).cast("string").alias("ai_description"))
    s = Store(spark, _folder(spark, "store"))
    enrich.resume(s, rows, partial(reply, busy=True), ["s_suppkey"], retries=1, pause=0)
    return enrich.resume(s, rows, partial(reply, busy=False), ["s_suppkey"], retries=1, pause=0).select("s_suppkey", "ai_description")


# Ordered sequences, level by level


def _sequence_sql(top: str, depth: int) -> str:
    """sequence_events for edges that all have the call order 1, without recursion: one set of CTEs a level."""
    parts = [f"o0 AS (SELECT node AS top, node, '' AS sort_path, 0 AS depth FROM nodes WHERE class_name = '{top}')", "s0 AS (SELECT top, node FROM o0)"]
    for d in range(1, depth + 1):
        parts.append(f"r{d} AS (SELECT top, concat(sort_path, 'a000001:', dst, '/') AS sort_path, 'call' AS kind, {d} AS depth, src AS source, dst AS target FROM o{d - 1} JOIN edges ON node = src)")
        parts.append(f"o{d} AS (SELECT top, target AS node, min(sort_path) AS sort_path, {d} AS depth FROM r{d} WHERE (top, target) NOT IN (SELECT (top, node) FROM s{d - 1}) GROUP BY top, target)")
        parts.append(f"s{d} AS (SELECT * FROM s{d - 1} UNION ALL SELECT top, node FROM o{d})")
    opened = " UNION ALL ".join(f"SELECT * FROM o{d}" for d in range(depth + 1))
    calls = " UNION ALL ".join(f"SELECT * FROM r{d}" for d in range(1, depth + 1))
    return f"""{CTES}, {", ".join(parts)}, opened AS ({opened}), calls AS ({calls}), m AS (SELECT DISTINCT concat(class_name, '.', method) AS node, sql_id FROM runs),
q AS (SELECT top, concat(sort_path, 'b', sql_id, '/') AS sort_path, 'sql' AS kind, depth + 1 AS depth, node AS source, sql_id AS target FROM opened JOIN m USING (node)),
t AS (SELECT top, concat(sort_path, 'c', table_name) AS sort_path, 'table' AS kind, depth + 1 AS depth, target AS source, table_name AS target FROM q JOIN (SELECT DISTINCT sql_id, table_name FROM uses) u ON u.sql_id = target)
SELECT * FROM calls UNION ALL SELECT * FROM q UNION ALL SELECT * FROM t"""


@query(_sequence_sql("C4Controller", 5))
def sequence_full(spark, sf):
    """What happens when a controller's methods run, to the operator's own depth of five."""
    g = TestGraph(spark, sf)
    tops = g.nodes.filter("class_name = 'C4Controller'").select(F.col("node").alias("top"))
    return traverse.sequence_events(g.edges.withColumn("call_order", F.lit(1)), g.links().select("method", "sql_id"), g.uses, tops, visits="shortest").drop("stack")


ORACLE["sequence_events"] = _sequence_sql("C3Controller", 3)
