"""A small project from files to answers."""

import pytest

from skeinwork import cli
from skeinwork import project as P
from skeinwork.operators import enrich, jpa, summary

SERVICE = """package shop;
import shop.m.OrderMapper;
@Service public class OrderService {
  @Autowired private OrderMapper orderMapper;
  public Order one(Long id) { return orderMapper.findById(id); }
  public void put(Order o) { orderMapper.add(o); one(1L); }
}"""
CONTROLLER = """package shop;
@RestController @RequestMapping("/o") public class OrderController {
  private final OrderService service;
  public OrderController(OrderService service) { this.service = service; }
  @GetMapping("/{id}") public Order get(Long id) { return service.one(id); }
}"""
MAPPER = "package shop.m;\n@Mapper public interface OrderMapper { Order findById(Long id); void add(Order o); int removeOld(); }"
XML = '<mapper namespace="shop.m.OrderMapper"><select id="findById">SELECT * FROM orders o JOIN users u ON u.id = o.uid</select><insert id="add">INSERT INTO orders (id) VALUES (#{id})</insert></mapper>'
ENTITY = """package shop; @Entity @Table(name = "orders") public class Order {
  @Id private Long id; @Column(name = "cust_name", nullable = false) private String name; @Transient int x;
  @OneToMany(mappedBy = "order") private List<Line> lines; @ManyToOne private User user; }"""
REPO = """package shop; public interface OrderRepo extends JpaRepository<Order, Long> {
  Order findByName(String n); @Query("select o from Order o") List<Order> all(); @Modifying @Query(value = "delete from orders", nativeQuery = true) void wipe(); }"""
DDL = "CREATE TABLE orders (id BIGINT PRIMARY KEY, cust_name VARCHAR(9) NOT NULL);"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for name, text in (("OrderService.java", SERVICE), ("OrderController.java", CONTROLLER), ("OrderMapper.java", MAPPER), ("OrderMapper.xml", XML), ("Order.java", ENTITY), ("OrderRepo.java", REPO), ("application.yml", "server:\n  port: 81"), ("s.sql", DDL)):
        (root / name).write_text(text)
    made = P.ingest(spark, str(root), "shop", str(root))
    P.save(made, str(root / "out"))
    lineage = P.Lineage.load(spark, str(root / "out"), list(made))
    lineage.folder = str(root / "out")
    return lineage


def test_crud_and_impact(tables):
    got = {(r.class_name, r.method, r.table_name, r.ops, r.schema) for r in tables.crud_matrix().collect()}
    assert got == {("OrderMapper", "findById", "orders", "R", "unknown"), ("OrderMapper", "findById", "users", "R", "unknown"), ("OrderMapper", "add", "orders", "C", "unknown")}
    assert [(r.table_name,) for r in tables.missing_tables().collect()] == [("users",)]
    impact = {(r.caller, r.depth) for r in tables.table_impact("ORDERS").collect()}
    assert impact == {("OrderMapper.findById", 0), ("OrderMapper.add", 0), ("OrderService.one", 1), ("OrderService.put", 1), ("OrderService.put", 2), ("OrderController.get", 2)}
    assert {r.caller for r in tables.method_impact("OrderService").collect()} == {"OrderController.get", "OrderService.put"}
    assert {(r.node, r.depth, r.table_name) for r in tables.call_chain("OrderController").collect() if r.table_name} == {("OrderMapper.findById", 2, "orders"), ("OrderMapper.findById", 2, "users")}
    assert tables.cycles().count() == 0 and tables.crud_crosstab().count() == 1


def test_structure(tables, spark):
    edges = {(r.source_bean, r.target_bean, r.injection_type) for r in tables.t["depends_on"].collect()}
    assert ("orderController", "orderService", "constructor") in edges
    events = [(r.kind, r.target) for r in tables.sequence("OrderController", "get").orderBy("sort_path").collect()]
    assert events[:3] == [("call", "OrderService.one"), ("call", "OrderMapper.findById"), ("sql", "findById")]
    assert tables.sql(spark, "select count(*) n from sql_statement").first().n == 3
    kinds = {r.id: r.sql_type for r in tables.t["sql_statement"].collect()}
    assert kinds == {"findById": "SELECT", "add": "INSERT", "removeOld": "DELETE"}
    assert tables.t["config_file"].first().server_port == 81
    assert {r.label: r.n for r in tables.run_counts().collect()}["endpoint"] == 1
    assert tables.class_list().count() == 5 and tables.class_spec().count() == 5
    assert {r.name for r in summary.method_list(tables.t["method"], "OrderService").collect()} == {"one", "put"}
    assert summary.unused_statements(tables.t["sql_statement"], tables.t["sql_link"]).count() == 0


def test_jpa(tables):
    audit = {r.property: r.mapping_quality for r in tables.mapping_audit().collect()}
    assert audit == {"id": "good", "name": "good"}
    rel = {r.property: (r.target_entity, r.quality) for r in tables.t["jpa_relationship"].collect()}
    assert rel == {"lines": ("Line", "good"), "user": ("User", "needs_review")}
    q = {r.name: (r.query_type, r.is_modifying, r.operation) for r in tables.t["jpa_query"].collect()}
    assert q == {"OrderRepo.findByName": ("METHOD", False, "SELECT"), "OrderRepo.all": ("JPQL", False, "SELECT"), "OrderRepo.wipe": ("NATIVE", True, "SELECT")}
    assert [r.entity for r in jpa.repositories(tables.t["class"]).collect()] == ["Order"]


def test_enrich(spark):
    rows = spark.createDataFrame([("A", "m", None, "code"), ("A", "n", "old", "code"), ("B", "k", None, None)], "class_name string, name string, ai_description string, source string")
    out = enrich.describe(rows, lambda prompts: [f"<think>x</think>says {p}" for p in prompts], ["class_name", "name"])
    assert {(r.name, r.ai_description) for r in out.collect()} == {("m", "says code"), ("n", "old"), ("k", None)}

    def broken(prompts):
        raise OSError("503")

    assert {r.ai_description for r in enrich.describe(rows, broken, ["class_name", "name"]).collect()} == {None, "old"}
    errors = spark.createDataFrame([("HTTP 503",), ("bad api key",)], "message string")
    assert {r["class"] for r in enrich.error_report(errors).collect()} == {"retryable", "fatal"}


def test_commands(spark, tables, tmp_path):
    def rows(*argv):
        return cli.run(spark, [argv[0], tables.folder, *argv[1:]]).collect()

    assert rows("query", "--text", "select count(*) n from method")[0].n > 0
    assert {r.class_name for r in rows("crud-matrix")} == {"OrderMapper"} and rows("crud-visualization") and rows("crud-analysis") and rows("table-summary")
    assert rows("table-impact", "--table", "orders")[0].statements == 2 and rows("db-analysis") and rows("db-statistics")[0].total_sql == 3
    assert len(rows("list-classes")) == 5 and len(rows("list-methods", "--class-name", "OrderService")) == 2 and len(rows("class-spec", "--class-name", "Order")) == 1
    assert rows("impact-analysis", "--table", "orders", "--view", "summary")[0].methods == 5 and not rows("cycles")
    assert "OrderService" in rows("sequence", "--class-name", "OrderController", "--method", "get")[0].text
    assert rows("db-call-diagram", "--class-name", "OrderController")[0].text.startswith("graph TD") and rows("db-call-chain")
    assert cli.run(spark, ["list-classes", tables.folder, "--out", str(tmp_path / "o")]) is None and spark.read.json(str(tmp_path / "o")).count() == 5
    with pytest.raises(SystemExit):
        rows("impact-analysis")
