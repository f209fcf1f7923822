"""Snapshots of many tables, refreshed source trees, injection through interfaces, and enrichment that resumes."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skeinwork import project as P
from skeinwork.operators import enrich, linkage
from skeinwork.sources import java
from skeinwork.store import Conflict, Store


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.versions() == [] and s.read() == {}
    assert s.commit({"a": spark.range(3), "b": spark.range(2)}) == 1
    old = s.read()
    assert s.commit({"a": spark.range(5)}) == 2 and s.commit({"c": spark.range(1)}, drop=("b",)) == 3
    assert [old[n].count() for n in "ab"] == [3, 2] and {n: t.count() for n, t in s.read().items()} == {"a": 5, "c": 1}
    assert {n: t.count() for n, t in s.read(2, ["b"]).items()} == {"b": 2} and s.versions() == [1, 2, 3]
    with pytest.raises(Conflict):
        s.commit({"a": spark.range(1)}, base=2)
    with pytest.raises(Conflict):
        s._point(3, {})
    assert s.vacuum(keep=1) == 1 and s.versions() == [3] and s.read()["a"].count() == 5


def test_a_broken_save_leaves_the_state(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.commit({"a": spark.range(3), "b": spark.range(3)})
    bad = spark.range(3).select(F.raise_error(F.lit("torn")).cast("long").alias("id"))
    with pytest.raises(Exception, match="torn"):
        s.commit({"a": spark.range(9), "b": bad})
    assert s.versions() == [1] and [s.read()[n].count() for n in "ab"] == [3, 3]
    assert s.vacuum() == 1 and s.commit({"a": spark.range(9)}) == 2 and s.read()["a"].count() == 9


A = "package p; @Service class A { @Autowired private B b; void go() { b.run(); } }"
B = "package p; @Service class B { void run() {} }"
XML = '<mapper namespace="p.AMapper"><select id="one">SELECT x FROM t1</select></mapper>'


def test_refresh(spark, tmp_path):
    """Add, change, touch, rename and remove: the tables are those of a fresh ingest, and only files that differ are parsed."""
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    put = lambda name, text: (src / name).write_text(text)
    states = lambda: {Path(r.path).name: r.state for r in P.refresh(spark, f"file://{src}", "shop", out, ddl_folder=f"file://{src}").collect()}
    for name, text in (("A.java", A), ("B.java", B), ("AMapper.xml", XML), ("application.properties", "server.port=1"), ("s.sql", "CREATE TABLE t1 (x INT);")):
        put(name, text)
    assert set(states().values()) == {"added"}

    def same_as_fresh():
        made, fresh = Store(spark, out).read(), P.ingest(spark, f"file://{src}", "shop", ddl_folder=f"file://{src}")
        for name in ("class", "method", "field", "bean", "depends_on", "db_column", "config_file"):
            assert sorted(map(str, made[name].collect())) == sorted(map(str, fresh[name].collect())), name
        for name in ("calls", "sql_statement"):
            assert sorted(map(str, made[name].drop("file_path").collect())) == sorted(map(str, fresh[name].drop("file_path").collect())), name
        return made

    same_as_fresh()
    assert set(states().values()) == {"same"}
    put("B.java", B.replace("run", "walk"))
    put("C.java", "package p; class C {}")
    put("AMapper.xml", XML.replace("t1", "t2"))
    os.utime(src / "A.java", (1, 1))
    assert states() == {"A.java": "same", "B.java": "changed", "C.java": "added", "AMapper.xml": "changed", "application.properties": "same", "s.sql": "same"}
    made = same_as_fresh()
    assert _rows(made["method"].select("name")) == [("go",), ("walk",)] and made["sql_statement"].first().tables[0].name == "t2"
    (src / "B.java").rename(src / "D.java")
    (src / "s.sql").unlink()
    assert states() == {"A.java": "same", "B.java": "removed", "D.java": "renamed", "C.java": "same", "AMapper.xml": "same", "application.properties": "same", "s.sql": "removed"}
    made = same_as_fresh()
    assert made["db_column"].count() == 0 and {Path(r.path).name: r.version for r in made["removed_file"].collect()} == {"B.java": 4, "s.sql": 4}
    put("s.sql", "CREATE TABLE t9 (y INT);")
    assert states()["s.sql"] == "added" and [Path(r.path).name for r in Store(spark, out).read()["removed_file"].collect()] == ["B.java"]


BEANS = """package p; interface Port {} interface Wide extends Port {}
@Service class One implements Port {} @Service @Primary class Two implements Wide {} @Component class Sub extends One {} class Plain implements Port {}
interface Solo {} @Repository class Only implements Solo {} interface Pair {} @Service class Left implements Pair {} @Service class Right implements Pair {}
@Service class User { @Autowired private Port port; @Autowired @Qualifier("one") Port picked; @Inject Solo solo; @Autowired Pair left; @Autowired Pair other; @Autowired List<Pair> all; @Value("${x}") String x; @Resource(name = "sub") Port named; One near; @Autowired Optional<Only> maybe; }
@Service class Made { Made(Solo solo, Pair right) {} } @Service class Set1 { @Inject public void setPort(@Qualifier("x") Wide port) {} }"""


def test_injection_through_interfaces(spark):
    t = java.tables_of(java.parsed_classes(spark.createDataFrame([("B.java", BEANS)], "file_path string, value string")), "p")
    rows = linkage.bean_dependencies(linkage.beans_of(t["class"]), t["field"], t["method"], t["class"]).collect()
    got = {(r.source_bean, r.target_bean, r.injection_type) for r in rows}
    field = {("user", b, "field") for b in ("two", "one", "sub", "only", "left", "right")}
    assert got == field | {("made", "only", "constructor"), ("made", "right", "constructor"), ("set1", "two", "setter")}
    members = {r.target_bean: r.member for r in rows if r.source_bean == "user"}
    assert members["two"] == "port" and members["one"] == "picked" and members["sub"] == "named" and members["right"] == "all"
    plain = linkage.bean_dependencies(linkage.beans_of(t["class"]), t["field"], t["method"]).collect()
    assert {(r.source_bean, r.target_bean) for r in plain} == {("user", "only")}


def test_enrichment_resumes(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def provider(prompts):
        import uuid

        for p in prompts:
            (calls / f"{p}-{uuid.uuid4().hex}").touch()
        if any(p == "bad" for p in prompts):
            raise ValueError("400 bad prompt")
        if any(p == "busy" for p in prompts) and len(list(calls.glob("busy-*"))) < 4:
            raise OSError("503 unavailable")
        return [f"about {p}" for p in prompts]

    rows = spark.createDataFrame([(k, s, None) for k, s in enumerate(["x", "y", "bad", "busy", "z", None])], "id int, source string, ai_description string").coalesce(1)
    s = Store(spark, str(tmp_path / "s"))
    out = {r.id: r.ai_description for r in enrich.resume(s, rows, provider, ["id"], retries=2, pause=0.01).collect()}
    assert [out[k] for k in (0, 1, 2, 4, 5)] == ["about x", "about y", None, "about z", None]
    ledger = s.read()["enrichment"]
    asked = lambda: {p: len(list(calls.glob(f"{p}-*"))) for p in ("x", "y", "bad", "busy", "z")}
    first = asked()
    assert {r["class"]: r.n for r in enrich.error_report(ledger).collect()}["fatal"] == 1
    changed = rows.withColumn("source", F.when(F.col("id") == 1, "y2").otherwise(F.col("source")))
    out = {r.id: r.ai_description for r in enrich.resume(s, changed, provider, ["id"], retries=2, pause=0.01).collect()}
    assert out == {0: "about x", 1: "about y2", 2: None, 3: "about busy", 4: "about z", 5: None}
    later = asked()
    assert all(later[p] == first[p] for p in ("x", "y", "bad", "z"))


def test_enrichment_survives_a_broken_run(spark, tmp_path):
    """A run that breaks between commits repeats no row that was committed."""
    rows = spark.createDataFrame([(k, f"s{k}", None) for k in range(40)], "id int, source string, ai_description string")
    store = Store(spark, str(tmp_path / "s"))
    commit, turns = store.commit, []

    def torn(tables):
        if len(turns) == 2:
            raise KeyboardInterrupt
        turns.append(1)
        return commit(tables)

    store.commit = torn
    with pytest.raises(KeyboardInterrupt):
        enrich.resume(store, rows, lambda prompts: [p.upper() for p in prompts], ["id"], per_commit=10)
    store.commit = commit
    done = {r.key for r in store.read()["enrichment"].collect()}
    assert 0 < len(done) < 40
    asked = []
    wanted = enrich.open_rows(rows, store.read()["enrichment"], ["id"]).collect()
    assert len(wanted) == 40 - len(done) and not asked
    assert enrich.resume(store, rows, lambda prompts: [p.upper() for p in prompts], ["id"]).filter("ai_description = upper(source)").count() == 40
