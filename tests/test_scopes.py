"""Tables and columns of statements with more than one scope."""

import pytest

from skeinwork.functions import sqlmeta

CASES = [
    ("SELECT", "SELECT a.x, (SELECT max(y) FROM h1) AS m FROM t1 a WHERE a.k IN (SELECT k FROM h2 WHERE z = (SELECT min(z) FROM s.h3 JOIN h4 q ON q.i = h3.i))", "t1,h1,h2,h3,h4", None, {"t1": "x", "h1": "max(y)", "h2": "k", "h3": "min(z)"}),
    ("SELECT", "SELECT x.a FROM (SELECT b.a FROM t1 b, t2) x JOIN t3 ON t3.i = x.a", "t3,t1,t2", None, {"t1": "a"}),
    ("SELECT", "SELECT a FROM t1 UNION ALL SELECT b FROM t2 WHERE c IN (1, 2) UNION SELECT d FROM t3", "t1,t2,t3", None, {"t1": "a", "t2": "b", "t3": "d"}),
    ("SELECT", "WITH c AS (SELECT a FROM t1), d (k) AS (SELECT b FROM c JOIN t2 ON t2.i = c.a) SELECT c.a FROM c, d, t4", "t4,t1,t2", None, {"t1": "a", "t2": "b"}),
    ("INSERT", "INSERT INTO t1 (a, b) SELECT x, y FROM t2 JOIN t3 ON t2.i = t3.i WHERE z > (SELECT avg(z) FROM t4)", "t1,t2,t3,t4", "t1", {"t1": "a,b", "t4": "avg(z)"}),
    ("INSERT", "INSERT INTO t1 (a) VALUES ((SELECT max(b) FROM t2))", "t1,t2", "t1", {"t2": "max(b)"}),
    ("UPDATE", "UPDATE t1 SET a = x.b FROM t2 x JOIN t3 ON t3.i = x.i WHERE t1.i = x.i", "t1,t2,t3", "t1", {}),
    ("UPDATE", "UPDATE t1 p JOIN t2 q ON p.i = q.i SET p.a = (SELECT max(c) FROM t3) WHERE p.k = 1", "t1,t2,t3", "t1", {"t3": "max(c)"}),
    ("DELETE", "DELETE FROM t1 USING t2, t3 WHERE t1.i = t2.i", "t1,t2,t3", "t1", {}),
    ("DELETE", "DELETE FROM t1 WHERE i IN (SELECT i FROM t1 WHERE k = 2)", "t1", "t1", {}),
    ("SELECT", "SELECT a FROM t1 WHERE b = '(SELECT c FROM no)' AND d = (SELECT e FROM t2)", "t1,t2", None, {"t2": "e"}),
    ("SELECT", "SELECT extract(year FROM d), (SELECT 1 FROM t2) FROM t1", "t1,t2", None, {}),
    ("SELECT", "SELECT a FROM (t1 JOIN t2 ON t1.i = t2.i) WHERE EXISTS (SELECT 1 FROM t3 WHERE ((((t3.i = t1.i)))))", "t1,t2,t3", None, {}),
    ("SELECT", "SELECT " + "(SELECT x FROM " * 0 + "a FROM t1 WHERE x IN (SELECT x FROM l1 WHERE x IN (SELECT x FROM l2 WHERE x IN (SELECT x FROM l3 WHERE x IN (SELECT x FROM l4 WHERE x = f(1)))))", "t1,l1,l2,l3,l4", None, {"l4": "x"}),
    ("SELECT", "SELECT a, b FROM t1 x, s.t2 y WHERE x.i = y.i", "t1,t2", None, {"t1": "a,b"}),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(k, c[0], c[1]) for k, c in enumerate(CASES)] + [(-1, None, None), (-2, "SELECT", ""), (-3, "MERGE", "MERGE INTO a USING (SELECT 1 FROM b) c ON 1 = 1"), (-4, "SELECT", "SELECT (SELECT (SELECT FROM ((")], "k int, sql_type string, sql_content string")
    return {r.k: r for r in sqlmeta.analyse(df).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_scopes(rows, k):
    _, _, tables, written, columns = CASES[k]
    r = rows[k]
    assert sorted(t.name for t in r.tables) == sorted(tables.split(",")) and r.written == written
    for table, names in columns.items():
        assert ",".join(r.table_columns[table]) == names


def test_odd_statements(rows):
    assert [rows[k].tables for k in (-1, -2, -3)] == [[], [], []] and rows[-1].written is None and isinstance(rows[-4].tables, list)
    assert rows[0].tables[0].alias == "a" and [t.schema for t in rows[0].tables if t.name == "h3"] == ["s"]
