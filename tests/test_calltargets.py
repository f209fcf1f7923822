"""Targets of calls over files of many shapes, and files that are cut short."""

from pyspark.sql import functions as F

from skeinwork.operators import calltargets, linkage
from skeinwork.plans import codebase
from skeinwork.sources import java

FILES = {
    "Base.java": "package lib; public abstract class Base<T> { protected Repo repo; protected void save(int n) {} protected void save(int n, int m) {} void log() {} static Base<String> of() { return null; } }",
    "Repo.java": "package data; import lib.*; public interface Repo extends Crud<Row> { Page page(int n); Row one(); int count(); Row find(String a, Object... more); }",
    "Crud.java": "package data; interface Crud<T> { T get(long id); void save(T row); }",
    "Page.java": "package data; public record Page(Row first, int size) { java.util.List<Row> items() { return null; } Row head() { return first; } }",
    "Row.java": "package data;\npublic class Row {\n Owner owner; public static final Row NONE = new Row(); void go() {} Row self() { return this; } void touch(Visitor v) {} class Cell { void fill() { go(); } } }",
    "Owner.java": "package data; class Owner { Row row; String name() { return null; } }",
    "LibRepo.java": "package lib; public class Repo { void run() {} Inner inner() { return new Inner(); } public static class Inner { void deep() {} } }",
    "Service.java": """package app;
import data.Repo;
import data.Row;
import lib.Base;
import lib.Repo.Inner;
import static util.Check.notNull;
class Service extends Base<Row> {
  private Repo mapper; private data.Page page;
  Service(Repo mapper) { this.mapper = mapper; init(); }
  void init() { super.save(1); save(1, 2); log(); repo.run(); }
  void chains() { mapper.page(1).items(); mapper.page(2).head().go(); var q = mapper.one(); q.go(); q.owner.row.go(); new Helper(this).help(1).go(); Base.of().log(); }
  void lambdas(java.util.List<Row> rows) { rows.forEach(x -> x.act()); rows.forEach(r -> { r.go(); }); rows.stream().map(Row::self); run(this::init); Runnable z = () -> mapper.count(); }
  void scopes(Row row) { for (Row r : list()) r.go(); try (In in = open()) { in.read(); } if (row instanceof Row other && other.self() != null) { other.go(); } { Owner row2 = null; row2.name(); } row.self().self().go(); page.head(); }
  void inners() { Inner deep = repo.inner(); deep.deep(); Row.NONE.go(); Outer.Mid.Leaf.make(); "a".trim(); System.out.println(1); log.info("x"); mapper.get(1).go(); mapper.find("a", 1, 2).go(); mapper.find("b").go(); }
  java.util.List<Row> list() { return null; }
}""",
    "Helper.java": "package app; class Helper { Helper(Service s) {} Row2 help(int n) { return null; } data.Row help(int n, int m) { return null; } } class Row2 { void go() {} }",
    "Outer.java": "package app; class Outer { void up() {} static class Mid { static class Leaf extends Base2 { static void make() { up(); base(); } } } } class Base2 { void base() {} }",
    "Kind.java": "package app; enum Kind { A { void m() { own(); } }, B; void own() {} void m() { valueOf(\"A\"); } }",
    "Anon.java": "package app; class Anon { Runnable r = null; void m(Service s) { new Thread(new Runnable() { public void run() { s.init(); } }).start(); for (int i = 0; i < 3; i++) { s.init(); } s.missing().far(); unknown.x(); Unknown.y(); } }",
    "Loop.java": "package app; class LoopA extends LoopB { void a() { b(); c(); } } class LoopB extends LoopA { void b() {} }",
}


def _calls(spark, files):
    parsed = java.parsed_classes(spark.createDataFrame(list(files.items()), "file_path string, value string"))
    rows = calltargets.resolve_calls(parsed, "p").orderBy("src_class", "src_method", "call_order").collect()
    assert all(r.project == "p" for r in rows) and all(r.call_order >= 1 for r in rows)
    out = {}
    for r in rows:
        out.setdefault(f"{r.src_class}.{r.src_method}", []).append(f"{r.dst_package}:{r.dst_class}.{r.dst_method}")
    return out, rows


def test_targets(spark):
    got, rows = _calls(spark, FILES)
    assert got["Service.init"] == ["lib:Base.save", "lib:Base.save", "lib:Base.log", "lib:Repo.run"]
    assert got["Service.Service"] == ["app:Service.init"]
    assert got["Service.chains"] == ["data:Repo.page", "data:Page.items", "data:Repo.page", "data:Page.head", "data:Row.go", "data:Repo.one", "data:Row.go", "data:Row.go", "app:Helper.help", "app:Row2.go", "lib:Base.of", "lib:Base.log"]
    assert got["Service.lambdas"] == ["data:Row.self", "app:Service.run", "app:Service.init", "data:Repo.count"]
    assert got["Service.scopes"] == ["app:Service.list", "data:Row.go", "app:Service.open", "app:In.read", "data:Row.self", "data:Row.go", "app:Owner.name", "data:Row.self", "data:Row.self", "data:Row.go", "data:Page.head"]
    assert got["Service.inners"] == ["lib:Repo.inner", "lib:Repo.Inner.deep", "data:Row.go", "app:Outer.Mid.Leaf.make", "java.lang:String.trim", "java.io:PrintStream.println", "data:Crud.get", "data:Repo.find", "data:Row.go", "data:Repo.find", "data:Row.go"]
    assert got["Outer.Mid.Leaf.make"] == ["app:Outer.up", "app:Base2.base"] and got["Row.Cell.fill"] == ["data:Row.go"]
    assert sorted(got["Kind.m"]) == ["app:Kind.own", "app:Kind.valueOf"]
    assert got["Anon.m"] == ["app:Service.init", "app:Thread.start", "app:Service.init", "app:Service.missing", "app:Unknown.y"]
    assert got["LoopA.a"] == ["app:LoopB.b", "app:LoopA.c"]
    assert {r.line_number for r in rows if r.src_class == "Service" and r.src_method == "chains"} == {11}


def test_records_and_enums(spark):
    parsed = {r.name: r for r in java.parsed_classes(spark.createDataFrame(list(FILES.items()), "file_path string, value string")).collect() if r.package_name != "lib"}
    assert [(f.name, f.type, f.modifiers) for f in parsed["Page"].fields] == [("first", "Row", ["private", "final"]), ("size", "int", ["private", "final"])]
    assert [m.name for m in parsed["Kind"].methods] == ["m", "own", "m"] and parsed["Repo"].interfaces == ["Crud<Row>"]
    assert [(p.type, p.name) for p in parsed["Repo"].methods[3].parameters] == [("String", "a"), ("Object...", "more")]


def test_annotations(spark):
    text = '''package a; @Table(name = "t_x", indexes = {@Index(columnList = "a, b"), @Index("c")}) @org.x.Big class X<T extends Y<T>> extends Z<A, B> implements I<C, D>, J {
      @Query("""
        select "a" from b where c = ')'
        """) @Min(value = 1) private final Map<String, List<X>> find(@P("a,b") final Map<K, V> m, @Q int... rest) throws E { return null; }
      private static int[] a = {1, 2}, b; Map<K, V> c = new HashMap<K, V>(), d; @A @B(x = "1", x = "2") protected String e = "a,b;c"; non-sealed class In {} <U> U gen() { return null; } }'''
    rows = {r.name: r for r in java.parsed_classes(spark.createDataFrame([("X.java", text)], "file_path string, value string")).collect()}
    x = rows["X"]
    assert (x.superclass, x.interfaces) == ("Z<A, B>", ["I<C, D>", "J"]) and [a.name for a in x.annotations] == ["Table", "Big"]
    assert x.annotations[0].parameters["name"] == "t_x" and x.annotations[0].parameters["indexes"] == '{@Index(columnList="a, b"), @Index("c")}'
    m = x.methods[0]
    assert (m.name, m.return_type, m.modifiers, [(p.type, p.name, p.order) for p in m.parameters]) == ("find", "Map<String, List<X>>", ["private", "final"], [("Map<K, V>", "m", 1), ("int...", "rest", 2)])
    assert [a.name for a in m.annotations] == ["Query", "Min"] and m.annotations[1].parameters == {"value": "1"} and x.methods[1].return_type == "U"
    assert [(f.name, f.type, f.initial_value) for f in x.fields] == [("a", "int[]", "{1, 2}"), ("b", "int[]", None), ("c", "Map<K, V>", "new HashMap<K, V>()"), ("d", "Map<K, V>", None), ("e", "String", '"a,b;c"')]
    assert x.fields[4].annotations[1].parameters == {"x": "2"} and rows["X.In"].modifiers == []


def test_torn_files(spark):
    """Every beginning of every file is cut without a fault, and those of one go through Spark."""
    for path, text in FILES.items():
        for k in range(len(text)):
            java.parse(path, text[:k])
    text = FILES["Service.java"]
    torn = {f"{k:04}": text[:k] for k in range(0, len(text), 7)} | {"x1": "class A { private", "x2": "class A { @Foo", "x3": "class A { <T", "x4": "}}}) class B { int x; }", "x5": None}
    parsed = java.parsed_classes(spark.createDataFrame(list(torn.items()), "file_path string, value string"))
    assert {r.name for r in parsed.select("name").distinct().collect()} == {"Service", "A", "B"} and calltargets.resolve_calls(parsed, "p").filter("src_class <> 'Service'").count() == 0


def test_long_files_take_linear_time():
    import time

    began = time.time()
    for n in (20_000, 40_000):
        rows = java.parse("f", "class A { void m() {\n" + " a.b(1);\n c(d(e()));" * n + "} }")
        assert len(rows[0]["sites"]) == 4 * n and rows[0]["sites"][-1]["line"] == n + 2
    java.parse("f", "class A { void m() { x" + ".b()" * 20_000 + "; } }")
    java.parse("f", "class A { void m() { " + "f(" * 20_000)
    java.parse("f", "class A { int x = " + "{" * 20_000 + "/** a */ int y;" * 2000)
    assert time.time() - began < 60


def test_packages_of_callees(spark):
    files = {
        "Desk.java": "package app; import store.Tray; class Desk { Tray tray; Box.Lid lid; Far far; void go() { tray.put(); lid.lift(); far.run(); } }",
        "Tray.java": "package store; public class Tray { public void put() {} }",
        "Box.java": "package app; class Box { static class Lid { void lift() {} } }",
    }
    parsed = java.parsed_classes(spark.createDataFrame(list(files.items()), "file_path string, value string"))
    other = java.parsed_classes(spark.createDataFrame([("Tray.java", "package a; class Tray {} class Far {}")], "file_path string, value string"))
    calls = calltargets.resolve_calls(parsed, "p").withColumn("dst_package", F.lit(""))
    # another project's classes of the same names say nothing
    classes = java.tables_of(parsed, "p")["class"].unionByName(java.tables_of(other, "q")["class"])
    got = {(r.dst_class, r.dst_method): r.dst_package for r in linkage.package_of_callees(calls, classes).collect()}
    assert got == {("Tray", "put"): "store", ("Box.Lid", "lift"): "app", ("Far", "run"): None}


def test_query_looks_up_every_callee(spark, small):
    """The query gives every call of java_calls with the package that java_classes has for the callee's class."""
    found, calls, classes = (codebase.QUERIES[name](spark, small).collect() for name in ("callee_packages", "java_calls", "java_classes"))
    package = {r.name: r.package_name for r in classes}
    wanted = [(r.src_class, r.dst_method, package.get(r.dst_class)) for r in calls]
    assert sorted(map(str, wanted)) == sorted(str((r.src_class, r.dst_method, r.dst_package)) for r in found)
    assert {p for *_, p in wanted} > {None}
