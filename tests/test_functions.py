"""Golden values of the column expressions."""

from pyspark.sql import functions as F

from skeinwork.functions import ddl, names, sqlmeta

SQL = [
    ("SELECT o.id, c.name FROM shop.orders o LEFT JOIN customer c ON c.id = o.cust_id WHERE o.total > 10 ORDER BY o.id, c.name", "SELECT", [("orders", "o", "shop"), ("customer", "c", None)], 7),
    ("SELECT a FROM t1, t2 b WHERE a = #{x} GROUP BY a HAVING count(*) > 1 LIMIT 5", "SELECT", [("t1", None, None), ("t2", "b", None)], 6),
    ("SELECT id /* c */ FROM users -- tail\n WHERE id IN (SELECT uid FROM vip)", "SELECT", [("users", None, None), ("vip", None, None)], 4),
    ("INSERT INTO s.t (a, b) VALUES (#{a}, ?)", "INSERT", [("t", None, "s")], 2),
    ("UPDATE t SET a = 1, b = #{b} WHERE id = :id", "UPDATE", [("t", None, None)], 3),
    ("DELETE FROM a.b.c WHERE x = 1", "DELETE", [("a.b.c", None, None)], 3),
    ("", "SELECT", [], 1),
    (None, "SELECT", [], 1),
]


def test_sql_metadata(spark):
    df = spark.createDataFrame([(k, s, t) for k, (s, t, _, _) in enumerate(SQL)], "k int, sql_content string, sql_type string")
    rows = {r.k: r for r in sqlmeta.analyse(df).collect()}
    for k, (_, _, tables, score) in enumerate(SQL):
        assert [tuple(t) for t in rows[k].tables] == tables
        assert rows[k].complexity_score == score
    assert rows[1].parameters == ["x"] and rows[3].parameters == ["?x1", "a"] and rows[4].parameters == ["b", "id"]
    assert [(c.name, c.table) for c in rows[0].columns] == [("id", "o"), ("name", "c")]
    assert rows[0].complexity_level == "medium" and "subqueries" in rows[2].characteristics


def test_joins_with_and_without_alias(spark):
    df = spark.createDataFrame([("SELECT x FROM a JOIN b ON a.i = b.i INNER JOIN c AS d ON d.i = a.i",)], "s string")
    loose, strict = df.select(sqlmeta.joins(F.col("s")).alias("a"), sqlmeta.joins(F.col("s"), strict=True).alias("b")).first()
    assert [(j.kind, j.name, j.alias) for j in loose] == [("INNER", "b", None), ("INNER", "c", "d")]
    assert [(j.kind, j.name, j.alias) for j in strict] == [("INNER", "c", "d")]
    text = spark.createDataFrame([("SELECT a::text, '12:30' FROM t WHERE x = :x",)], "s string")
    loose, strict = text.select(sqlmeta.parameters(F.col("s")), sqlmeta.parameters(F.col("s"), strict=True)).first()
    assert loose == ["x"] and strict == ["text", "30", "x"]


def test_written_and_table_columns(spark):
    df = spark.createDataFrame([("INSERT INTO t (a, b) VALUES (1, 2)", "INSERT"), ("UPDATE t SET a = 1, b = 2 WHERE c = 3", "UPDATE"), ("UPDATE t SET a = 1", "UPDATE"), ("SELECT x.a, b FROM t x, u", "SELECT")], "s string, k string")
    rows = df.select(sqlmeta.written_columns(F.col("s"), F.col("k")).alias("w"), sqlmeta.table_columns(F.col("s"), F.col("k")).alias("m")).collect()
    assert [r.w for r in rows] == [["a", "b"], ["a", "b"], [], []]
    assert rows[3].m == {"t": ["a", "b"], "u": ["b"]}


DDL = """-- Database: shopdb
CREATE TABLE IF NOT EXISTS app.users ( id BIGINT PRIMARY KEY, -- key
  email VARCHAR(100) NOT NULL UNIQUE, price DECIMAL(10, 2) DEFAULT 0, note TEXT, CONSTRAINT fk_a FOREIGN KEY (a_id) REFERENCES accounts(id) );
CREATE TABLE plain (a INT);
CREATE UNIQUE INDEX ux_email ON users (email, note);
CREATE INDEX ix_a ON users(a_id);
ALTER TABLE users ADD CONSTRAINT ck_p CHECK (price > 0);
"""


def test_ddl(spark):
    files = spark.createDataFrame([("/x/prod_schema.sql", DDL)], "file_path string, value string")
    tables = ddl.tables(files)
    assert {(r.database_name, r.schema, r.table_name) for r in tables.collect()} == {("shopdb", "app", "users"), ("shopdb", None, "plain")}
    assert [r.table_name for r in ddl.tables(files, strict=True).collect()] == ["plain"]
    cols = {r.name: r for r in ddl.columns(tables).collect() if r.table_name == "users"}
    assert set(cols) == {"id", "email", "price", "note"}
    assert (cols["id"].data_type, cols["id"].nullable, cols["id"].primary_key) == ("BIGINT", False, True)
    assert (cols["email"].data_type, cols["email"].nullable, cols["email"].unique) == ("VARCHAR(100)", False, True)
    assert (cols["price"].data_type, cols["price"].default, cols["note"].nullable) == ("DECIMAL(10, 2)", "0", True)
    assert {(r.name, r.type, tuple(r.columns)) for r in ddl.indexes(files).collect()} == {("ux_email", "UNIQUE", ("email", "note")), ("ix_a", "B-tree", ("a_id",))}
    assert {(r.name, r.type, r.ref_table, r.source) for r in ddl.constraints(files).collect()} == {("ck_p", "CHECK", None, "alter"), ("fk_a", "FOREIGN KEY", "accounts", "inline")}
    assert files.select(ddl.environment(F.col("value"), F.col("file_path"))).first()[0] == "prod"


def _one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_names(spark):
    s = F.lit
    checks = [
        (names.is_external(s("javafoo.x")), True), (names.is_external(s("")), True), (names.is_external(s("com.own")), False), (names.is_external_narrow(s("java.util")), True),
        (names.outer_class(s("Outer.Inner")), "Outer"), (names.outer_class(s("Outer$Inner")), "Outer"), (names.bean_name(s("UserService")), "userService"),
        (names.method_name_type(s("getOrCreate")), "SELECT"), (names.method_name_type(s("addUser")), "INSERT"), (names.method_name_type(s("xyz")), "SELECT"),
        (names.join_path(s("/api"), s("x")), "/api/x"), (names.join_path(s(""), s(None).cast("string")), "/"), (names.join_path(s("/a/"), s("/b")), "/a//b"),
        (names.http_method(s("PostMapping"), s(None).cast("string")), "POST"), (names.http_method(s("RequestMapping"), s("{RequestMethod.PUT}")), "PUT"), (names.http_method(s("RequestMapping"), s(None).cast("string")), "GET"),
        (names.types_match(s("java.lang.String"), s("VARCHAR(9)")), True), (names.types_match(s("Long"), s("int")), False),
        (names.sql_return_type(s("m"), s("T")), "m | T"), (names.sql_return_type(s(None).cast("string"), s("")), "void"),
        (names.clean_reply(s("<think>x</think>\n```json\n{}\n```")), "{}"), (names.error_class(s("HTTP 429")), "retryable"), (names.error_class(s("bad API key")), "fatal"),
        (names.duration_text(s(3725)), "01:02:05"), (names.markdown_cell(s("a|b\n`c`")), "a\\|b<br>'c'"), (names.mermaid_id(s("a.b-c")), "a_b_c"), (names.test_family(s("Captor")), "mockito"),
        (names.annotation_category(s("MapKey")), "jpa"), (names.stamp_text(s("20250102-030405")), "2025-01-02 03:04:05"), (names.visibility(F.array(s("static"), s("private"))), "private"),
    ]
    for column, want in checks:
        assert _one(spark, column) == want, (column, want)
    assert _one(spark, names.lenient_tables(s('[{"name":"a"},{"name":"b"}]'), s(None).cast("array<struct<name:string,table:string>>"))) == ["a", "b"]
    assert _one(spark, names.lenient_tables(s("a, b"), s(None).cast("array<struct<name:string,table:string>>"))) == ["a", "b"]


def test_derived_query(spark):
    r = _one(spark, names.derived_query(F.lit("findByNameOrderByAge")))
    assert tuple(r) == ("SELECT", "NameOrderByAge", True, False)
