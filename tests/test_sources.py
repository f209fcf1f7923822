"""Parsers and scans on self-written sources."""

from skeinwork.functions import names
from skeinwork.operators import calltargets, classspec, linkage
from skeinwork.sources import config, files, java, mapper_xml, rules
from skeinwork.streaming import ingest

JAVA = '''package shop.order;
import java.util.List;
import shop.repo.OrderRepository;
/**
 * Handles orders
 */
@RestController
@RequestMapping("/orders")
public class OrderController extends Base implements Closeable {
  @Autowired private OrderRepository repo;
  private int a = 1, b;
  public OrderController(OrderRepository repo) { this.repo = repo; }
  /** Finds one order */
  @GetMapping("/{id}")
  public List<Order> find(Long id) {
    log.info("x");
    Order o = repo.load(id);
    o.check(); helper(); names.stream().map(x -> x); System.out.println(o);
    return null;
  }
  @PostMapping
  protected void save(@Valid Order o) { repo.save(o); }
  private void helper() {}
  enum Kind { A, B; int v() { return 1; } }
  %% broken member;
  @Test void works() { assertEquals(1, 1); verify(repo).load(1); }
}
interface Port { void go(int n); }
'''
REPO = "package shop.repo;\n@Repository\npublic class OrderRepository { public Order load(Long id) { return null; } @Autowired public void setCtl(OrderController c) {} }\n"
XML = """<?xml version="1.0"?>
<!DOCTYPE mapper PUBLIC "-//x" "http://x">
<!-- Order mapper -->
<mapper namespace="shop.repo.OrderMapper">
  <resultMap id="m" type="Order"><id property="id" column="order_id"/><result property="name" column="name"/><result property="x"/></resultMap>
  <sql id="cols">id, name</sql>
  <!-- Finds by id -->
  <select id="findById" resultMap="m" parameterType="long">SELECT <include refid="cols"/> FROM orders o <where>o.id = #{id}</where></select>
  <insert id="add">INSERT INTO orders (id) VALUES (#{id})</insert>
</mapper>"""


def _files(spark, *pairs):
    return spark.createDataFrame(list(pairs), "file_path string, value string")


def test_java_classes(spark):
    parsed = java.parsed_classes(_files(spark, ("/p/OrderController.java", JAVA), ("/p/OrderRepository.java", REPO)))
    rows = {r.name: r for r in parsed.collect()}
    assert set(rows) == {"OrderController", "OrderController.Kind", "Port", "OrderRepository"}
    c = rows["OrderController"]
    assert (c.superclass, c.interfaces, c.logical_name, c.package_name) == ("Base", ["Closeable"], "Handles orders", "shop.order")
    assert [f.name for f in c.fields] == ["repo", "a", "b"] and c.fields[1].initial_value == "1"
    methods = {m.name: m for m in c.methods}
    assert methods["find"].return_type == "List<Order>" and methods["find"].logical_name == "Finds one order" and methods["OrderController"].return_type == "constructor"
    calls = calltargets.resolve_calls(parsed, "shop").orderBy("src_class", "src_method", "call_order").collect()
    assert [(k.dst_package, k.dst_class, k.dst_method, k.call_order) for k in calls if k.src_method == "find"] == [
        ("shop.repo", "OrderRepository", "load", 1), ("shop.order", "Order", "check", 2), ("shop.order", "OrderController", "helper", 3), ("java.io", "PrintStream", "println", 4),
    ]
    t = java.tables_of(parsed, "shop")
    assert {(r.full_path, r.method, r.handler_method) for r in classspec.endpoints(t["class"], t["method"]).collect()} == {("/orders/{id}", "GET", "find"), ("/orders", "POST", "save")}
    beans = linkage.beans_of(t["class"])
    edges = {(r.source_bean, r.target_bean, r.injection_type) for r in linkage.bean_dependencies(beans, t["field"], t["method"]).collect()}
    assert edges == {("orderController", "orderRepository", "constructor"), ("orderRepository", "orderController", "setter")}
    kinds = {r.name: r.sub_type for r in t["class"].collect()}
    assert kinds["OrderController"] == "controller" and kinds["OrderController.Kind"] == "inner_class" and kinds["OrderRepository"] == "repository"
    spec = {r.class_name: r for r in classspec.class_rows(t["class"], t["method"], t["field"], linkage.bean_dependencies(beans, t["field"], t["method"]), beans).collect()}
    assert spec["OrderController"].depends_on == "orderRepository" and spec["OrderController"].methods.startswith("OrderController,find")
    tests = classspec.test_facts(t["class"], t["method"]).collect()
    assert [(r.class_name, r.framework, r.test_type, r.n_tests, r.n_assertions, r.n_mocks) for r in tests] == [("OrderController", "junit", "unit", 1, 1, 1)]
    assert ("OrderController", "EXTENDS", "Base") in {tuple(r) for r in classspec.inheritance(t["class"]).collect()}


def test_java_odd_input(spark):
    odd = _files(spark, ("a", ""), ("b", "class"), ("c", "class X { void m( {"), ("d", "/* only a comment */"), ("e", None))
    assert {r.name for r in java.parsed_classes(odd).collect()} <= {"X"}


def test_lombok(spark):
    src = "package a; @Data class D { String name; boolean on; }"
    t = java.tables_of(java.parsed_classes(_files(spark, ("D.java", src))), "p")
    assert {r.name for r in names.lombok_methods(t["class"], t["field"]).collect()} == {"getName", "setName", "isOn", "setOn", "equals", "hashCode", "toString"}


def test_mapper_xml(spark):
    rows = {r.id: r for r in mapper_xml.mapper_rows(_files(spark, ("OrderMapper.xml", XML), ("bad.xml", "<mapper"), ("other.xml", "<beans/>"))).collect()}
    assert set(rows) == {"m", "cols", "findById", "add"}
    assert rows["findById"].sql_content == "SELECT id, name FROM orders o WHERE o.id = #{id}"
    assert (rows["findById"].logical_name, rows["findById"].mapper_logical_name, rows["add"].sql_type) == ("Finds by id", "Order mapper", "INSERT")
    assert [m.is_id for m in rows["m"].mappings] == [True, False, False]
    from skeinwork.operators import audit

    df = mapper_xml.mapper_rows(_files(spark, ("OrderMapper.xml", XML)))
    got = audit.result_maps(df.filter("kind = 'result_map'"), df.filter("kind = 'statement'")).collect()
    assert [(r.result_map, r.n_properties, r.n_mapped, r.used_by) for r in got] == [("m", 3, 2, "findById")]


def test_config(spark):
    y = "spring:\n  profiles:\n    active: dev\n  datasource:\n    url: jdbc:x\nserver:\n  port: 9090\nlist: [a, b]\n---\nother: 1\n"
    p = "# c\nspring.datasource.url = 'jdbc:y'\nlogging.level.root=DEBUG\n"
    f = _files(spark, ("/a/application.yml", y), ("/a/application-prod.properties", p), ("/a/bad.yml", ":\n  - ]["))
    v = config.yaml_values(f).unionByName(files.properties(f))
    rows = {r.file_path: r for r in config.summary(v).collect()}
    a, b = rows["/a/application.yml"], rows["/a/application-prod.properties"]
    assert (a.database_url, a.server_port, a.environment, a.sections) == ("jdbc:x", 9090, "dev", ["list", "server", "spring"])
    assert (b.database_url, b.log_level, b.environment, b.profile, b.server_port) == ("jdbc:y", "DEBUG", "prod", "prod", 8080)


def test_file_scans(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/A.java").write_text(JAVA)
    (tmp_path / "src/OrderMapper.xml").write_text(XML)
    (tmp_path / "src/x.xml").write_text("<a/>")
    (tmp_path / "application-dev.yml").write_text("a: 1")
    (tmp_path / "s.sql").write_text("CREATE TABLE t (a INT);")
    path = str(tmp_path)
    assert files.java_files(spark, path).count() == 1 and files.mapper_files(spark, path).count() == 1
    assert files.config_files(spark, path).count() == 1 and files.ddl_files(spark, path).count() == 1
    assert [r.name for r in files.packages(files.java_files(spark, path)).collect()] == ["shop.order"]
    assert files.file_count(spark, path).first()[0] == 5


def test_rules(spark, tmp_path):
    (tmp_path / "rule001.md").write_text("# R\n## Class\n- form '/**\\n * {logical_name}\\n */'\n## Other\nnone\n")
    (tmp_path / "shop_logical_name_rules.md").write_text("## Class\nuse `/* name: {logical_name}; */`\n")
    assert set(rules.load(spark, str(tmp_path))) == {"Class"}
    rule = rules.load(spark, str(tmp_path), "shop")["Class"]
    src = "/* name: Shiny thing; */ class A {}"
    assert java.parse("f", src, rule)[0]["logical_name"] == "Shiny thing"


def test_incremental_ingest(spark, tmp_path):
    src, out, chk = tmp_path / "src", tmp_path / "out", tmp_path / "chk"
    src.mkdir()
    (src / "A.java").write_text("package p; class A { int x; }")
    ingest.start(ingest.java_stream(spark, str(src)), str(out), str(chk)).awaitTermination(120)
    (src / "B.java").write_text("package p; class B {} ")
    (src / "A2.java").write_text("package p; class A { int x, y; }")
    ingest.start(ingest.java_stream(spark, str(src)), str(out), str(chk)).awaitTermination(120)
    rows = {r.name: r for r in ingest.current_classes(spark, str(out)).collect()}
    assert set(rows) == {"A", "B"} and [f.name for f in rows["A"].fields] == ["x", "y"]
