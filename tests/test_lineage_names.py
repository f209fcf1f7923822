"""Classes of one name in two packages and two projects stay apart in every answer."""

import pytest
from pyspark.sql import functions as F

from skeinwork import project as P

FILES = {
    "a/Store.java": "package a;\nimport a.m.StoreMapper;\n@Service public class Store { private StoreMapper m; public void put() { m.add(); } public void only() { put(); } }",
    "b/Store.java": "package b;\nimport b.m.StoreMapper;\n@Service public class Store { private StoreMapper m; public void put() { m.add(); } }",
    "a/Desk.java": "package a;\npublic class Desk { private Store store; public void sell() { store.put(); } }",
    "b/Till.java": "package b;\npublic class Till { private Store store; public void pay() { store.put(); } }",
    "a/m/StoreMapper.java": "package a.m;\n@Mapper public interface StoreMapper { void add(); }",
    "b/m/StoreMapper.java": "package b.m;\n@Mapper public interface StoreMapper { int count(); void add(); }",
    "b/m/StoreMapper.xml": '<mapper namespace="b.m.StoreMapper"><insert id="add">INSERT INTO goods (id) VALUES (1)</insert></mapper>',
    "x.sql": "CREATE TABLE stock (id INT);",
}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("names")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    folder = str(root / "out")
    P.save(P.ingest(spark, str(root), "shop", str(root)), folder)
    return P.Lineage.open(spark, folder)


def test_two_packages(shop):
    edges = {(r.src, r.dst) for r in shop.edges().collect()}
    assert edges == {
        ("shop:a.Store.put", "shop:a.m.StoreMapper.add"), ("shop:a.Store.only", "shop:a.Store.put"), ("shop:b.Store.put", "shop:b.m.StoreMapper.add"), ("Desk.sell", "shop:a.Store.put"), ("Till.pay", "shop:b.Store.put")
    }
    impact = {(r.caller, r.depth) for r in shop.table_impact("goods").collect()}
    assert impact == {("shop:b.m.StoreMapper.add", 0), ("shop:b.Store.put", 1), ("Till.pay", 2)}
    assert {(r.class_name, r.package_name) for r in shop.crud_matrix().collect()} == {("StoreMapper", "b.m")}
    assert {r.caller for r in shop.method_impact("Store", "put").collect()} == {"Desk.sell", "Till.pay", "shop:a.Store.only"}
    assert shop.nodes().groupBy("node").count().filter("count > 1").count() == 0


def test_all_classes_at_once(shop):
    for depth in (5, None):
        got = {(r.package_name, r.class_name): (r.n_methods, r.n_sql, r.n_tables, r.n_columns) for r in shop.class_chains(depth).collect()}
        assert got == {
            ("a", "Store"): (2, 0, 0, 0), ("a", "Desk"): (1, 0, 0, 0), ("a.m", "StoreMapper"): (1, 0, 0, 0), ("b", "Store"): (1, 1, 1, 1), ("b", "Till"): (1, 1, 1, 1), ("b.m", "StoreMapper"): (2, 2, 1, 1)
        }  # fmt: skip; a mapper method without SQL of its own is a statement of its name
    assert {r.class_name for r in shop.class_chains(1).filter("n_sql > 0").collect()} == {"Store", "StoreMapper"}
    assert shop.chain_totals().first().asDict() == {"classes": 6, "methods": 8, "n_sql": 2, "n_tables": 1, "n_columns": 1, "missing_tables": 1, "missing_columns": 0}


def test_two_projects(shop):
    other = {name: df.withColumn("project", F.lit("other")) if "project" in df.columns else df for name, df in shop.t.items()}
    both = P.Lineage({name: df.unionByName(other[name]) for name, df in shop.t.items()})
    assert {(r.src, r.dst) for r in both.edges().collect() if "Till" in r.src} == {(f"{p}:b.Till.pay", f"{p}:b.Store.put") for p in ("shop", "other")}
    assert {r.caller for r in both.table_impact("goods").filter("depth = 2").collect()} == {"shop:b.Till.pay", "other:b.Till.pay"}
