"""Micro-batched ingestion of mappers, configuration and DDL: changed files replace their rows."""

import pytest

from skeinwork.functions import ddl
from skeinwork.streaming import ingest

MAPPER = '<mapper namespace="a.OneMapper">{}</mapper>'


def _run(spark, tmp_path, kind):
    stream = ingest.file_stream(spark, f"file://{tmp_path}/in", kind)
    ingest.start(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/at", kind=kind).awaitTermination()
    return ingest.current_rows(spark, f"file://{tmp_path}/out")


def test_mappers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/OneMapper.xml").write_text(MAPPER.format('<select id="a">SELECT 1</select><select id="b">SELECT 2</select>'))
    (tmp_path / "in/other.xml").write_text("<beans/>")
    assert {r.id for r in _run(spark, tmp_path, "mapper").collect()} == {"a", "b"}
    (tmp_path / "in/sub").mkdir()
    (tmp_path / "in/sub/TwoDao.xml").write_text(MAPPER.format('<delete id="c">DELETE FROM t</delete>'))
    assert {(r.id, r.sql_type) for r in _run(spark, tmp_path, "mapper").collect()} == {("a", "SELECT"), ("b", "SELECT"), ("c", "DELETE")}


@pytest.mark.parametrize("kind", ["config", "ddl"])
def test_config_and_ddl(spark, tmp_path, kind):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/application.yml").write_text("server:\n  port: 1\n")
    (tmp_path / "in/application-dev.properties").write_text("a.b=2\n")
    (tmp_path / "in/x.sql").write_text("CREATE TABLE s.t (id INT PRIMARY KEY);")
    rows = _run(spark, tmp_path, kind)
    if kind == "config":
        assert {(r.key, r.value) for r in rows.collect()} == {("server.port", "1"), ("a.b", "2")}
    else:
        assert [(r.schema, r.table_name) for r in ddl.tables(rows).collect()] == [("s", "t")]


def test_a_file_that_comes_again_replaces_its_rows(spark, tmp_path):
    for number, text in enumerate(('<select id="a">SELECT 1</select><select id="b">SELECT 2</select>', '<select id="b">SELECT 3</select>')):
        found = spark.createDataFrame([("/x/OneMapper.xml", MAPPER.format(text))], "file_path string, value string")
        ingest.KINDS["mapper"][1](found).selectExpr("*", f"cast({number} as bigint) as batch").write.parquet(f"file://{tmp_path}/out/batch={number}")
    assert [(r.id, r.sql_content) for r in ingest.current_rows(spark, f"file://{tmp_path}/out").collect()] == [("b", "SELECT 3")]
