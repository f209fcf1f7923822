"""Every query of the catalogue against its SQL."""

import pytest

from skeinwork.plans import catalogue, codebase

QUERIES, ORACLE = {**catalogue.QUERIES, **codebase.QUERIES}, {**catalogue.ORACLE, **codebase.ORACLE}

#: On the small tables every table that statements use is defined.
MAY_BE_EMPTY = ("missing_refs",)


def _plain(rows, columns):
    return sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns) for r in rows), key=lambda t: tuple(map(str, t)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    assert rows or name in MAY_BE_EMPTY
    q = duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert sorted(q.columns) == columns
    assert _plain(rows, columns) == _plain([dict(zip(q.columns, r)) for r in q.fetchall()], columns)


def test_full_depths(spark, small):
    run = lambda name: catalogue.QUERIES[name](spark, small)
    assert run("impact_risk_full").agg({"depth": "max"}).first()[0] == 10
    rows = {name: {r.class_name: r.n_rows for r in run(name).collect()} for name in ("call_chain_summary", "call_chain_summary_full")}
    assert rows["call_chain_summary_full"]["C4Controller"] > rows["call_chain_summary"]["C4Controller"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
