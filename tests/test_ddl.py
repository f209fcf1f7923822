"""DDL scripts in the forms that several databases write."""

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import ddl

SCRIPT = """
CREATE TABLE a (x INT) ENGINE=InnoDB DEFAULT CHARSET=utf8; CREATE TABLE b (y INT);
create table "My Schema"."Order; Lines" (
  "Line (No)" BIGINT NOT NULL, -- the ); key
  `note` VARCHAR(20) DEFAULT 'a;b, (c)' /* CREATE TABLE no (z INT); */,
  amount NUMERIC(10,2) DEFAULT (1 + 2) CHECK (amount IN (1, 2)),
  parent INT CONSTRAINT fk_p REFERENCES "My Schema".parents ("id"),
  made TIMESTAMP DEFAULT now(), code char(2) UNIQUE,
  PRIMARY KEY ("Line (No)", parent), UNIQUE (`note`), UNIQUE (amount, code), KEY ix (parent), CONSTRAINT [ck 1] CHECK (amount > 0),
  FOREIGN KEY (parent) REFERENCES parents (id) ON DELETE CASCADE
) PARTITION BY RANGE (made);
CREATE FUNCTION f() RETURNS int AS $body$ BEGIN; CREATE TABLE inside (q INT); END; $body$ LANGUAGE plpgsql;
CREATE TABLE gone (g INT); DROP TABLE IF EXISTS gone;
CREATE TABLE late (id INT, old TEXT, twice INT, keep INT);
ALTER TABLE late ADD COLUMN fresh VARCHAR(9) NOT NULL, DROP COLUMN old, ADD CONSTRAINT pk_l PRIMARY KEY (id);
ALTER TABLE ONLY late ADD CONSTRAINT uq UNIQUE (twice); ALTER TABLE late DROP CONSTRAINT uq; ALTER TABLE late ADD UNIQUE (keep);
DROP TABLE back; CREATE TABLE back (r INT);
INSERT INTO a VALUES ('CREATE TABLE text (t INT);');
CREATE UNIQUE INDEX CONCURRENTLY "ux 1" ON "My Schema"."Order; Lines" USING btree ("note", lower(code) DESC);
CREATE TABLE torn (k INT, m INT
"""


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("/s/prod.sql", SCRIPT), ("/s/empty.sql", ""), ("/s/none.sql", None)], "file_path string, value string")


def test_tables(files):
    got = {(r.schema, r.table_name) for r in ddl.tables(files).collect()}
    assert got == {(None, "a"), (None, "b"), ("My Schema", "Order; Lines"), (None, "gone"), (None, "late"), (None, "back"), (None, "torn")}


def test_columns(files):
    rows = ddl.columns(ddl.tables(files), ddl.changes(files)).collect()
    got = {t: [r for r in sorted(rows, key=lambda r: r.position) if r.table_name == t] for t in {r.table_name for r in rows}}
    assert [(r.name, r.data_type, r.nullable, r.unique, r.primary_key, r.default) for r in got["Order; Lines"]] == [
        ("Line (No)", "BIGINT", False, False, True, None), ("note", "VARCHAR(20)", True, True, False, "'a;b, (c)'"), ("amount", "NUMERIC(10,2)", True, False, False, "(1 + 2)"),
        ("parent", "INT", False, False, True, None), ("made", "TIMESTAMP", True, False, False, "now()"), ("code", "char(2)", True, True, False, None),
    ]
    assert [(r.name, r.nullable, r.unique, r.primary_key) for r in got["late"]] == [("id", False, False, True), ("twice", True, False, False), ("keep", True, True, False), ("fresh", False, False, False)]
    assert set(got) == {"a", "b", "Order; Lines", "late", "back", "torn"} and [r.name for r in got["a"]] == ["x"] and [r.name for r in got["torn"]] == ["k"]


def test_constraints_and_indexes(files):
    rows = {(r.table_name, r.name, r.type, r.source, ",".join(r.columns), r.ref_table, ",".join(r.ref_columns)) for r in ddl.constraints(files).collect()}
    t = "Order; Lines"
    assert rows == {
        (t, None, "PRIMARY KEY", "inline", "Line (No),parent", None, ""), (t, None, "UNIQUE", "inline", "note", None, ""), (t, None, "UNIQUE", "inline", "amount,code", None, ""), (t, "ck 1", "CHECK", "inline", "", None, ""),
        (t, None, "FOREIGN KEY", "inline", "parent", "parents", "id"), (t, "fk_p", "FOREIGN KEY", "inline", "parent", "parents", "id"),
        ("late", "pk_l", "PRIMARY KEY", "alter", "id", None, ""), ("late", "uq", "UNIQUE", "alter", "twice", None, ""), ("late", None, "UNIQUE", "alter", "keep", None, ""),
    }
    own = {(r.type, r.source, ",".join(r.columns)) for r in ddl.constraints(files, column_level=True).collect() if r.source == "column"}
    assert own == {("CHECK", "column", "amount"), ("UNIQUE", "column", "code")}
    assert [(r.table_name, r.name, r.type, r.columns) for r in ddl.indexes(files).collect()] == [(t, "ux 1", "UNIQUE", ["note", "lower(code) DESC"])]


def test_long_scripts(spark):
    """A dump with a statement of 20,000 strings and a table of 1,500 columns."""
    values = ", ".join(f"('it''s; {k}', {k})" for k in range(20_000))
    body = ", ".join(f"c{k} DECIMAL(10, 2) DEFAULT 'a,b'" for k in range(1500))
    df = spark.createDataFrame([("d.sql", f"INSERT INTO t VALUES {values};CREATE TABLE wide ({body}) WITH (x=1);")], "file_path string, value string")
    got = ddl.columns(ddl.tables(df))
    assert got.count() == 1500 and got.filter(F.col("default") == "'a,b'").count() == 1500
