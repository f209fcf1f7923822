"""Commands over a source tree and its tables: ``python -m skeinwork.cli COMMAND …``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import project
from .operators import crud, impact, stats, summary, traverse
from .sinks import report


def _impact(lineage: project.Lineage, a: argparse.Namespace) -> DataFrame:
    if bool(a.table) == bool(a.class_name):
        raise SystemExit("give either --table or --class-name")
    rows = lineage.table_impact(a.table, a.max_depth, a.mode) if a.table else lineage.method_impact(a.class_name, a.method, a.max_depth, a.mode)
    return {"nodes": lambda x: x, "summary": impact.summary, "packages": impact.package_summary}[a.view](rows)


def _sequence(lineage: project.Lineage, a: argparse.Namespace) -> DataFrame:
    return report.sequence_text(traverse.activation_flow(lineage.sequence(a.class_name, a.method, a.max_depth)), a.style)


def _diagram(lineage: project.Lineage, a: argparse.Namespace) -> DataFrame:
    chain = lineage.call_chain(a.class_name, a.max_depth).select("node").distinct()
    edges = lineage.edges().join(chain.withColumnRenamed("node", "src"), "src", "left_semi").withColumn("label", F.lit(""))
    return report.mermaid_graph(edges)


#: command -> what it answers with, given the tables and the arguments.
COMMANDS = {
    "query": lambda x, a: x.sql(a.spark, a.text),
    "list-classes": lambda x, a: x.class_list(),
    "list-methods": lambda x, a: summary.method_list(x.t["method"], a.class_name),
    "sequence": _sequence,
    "crud-matrix": lambda x, a: x.crud_matrix(a.project),
    "table-summary": lambda x, a: x.table_summary(a.project),
    "crud-analysis": lambda x, a: crud.by_class(x.accesses(a.project)),
    "crud-visualization": lambda x, a: x.crud_crosstab(a.project),
    "table-impact": lambda x, a: stats.table_impact(x.accesses(a.project), x.t["sql_statement"], a.table),
    "db-analysis": lambda x, a: stats.access_report(x.accesses(a.project)),
    "db-call-chain": lambda x, a: x.call_chain(a.class_name, a.max_depth),
    "db-class-chains": lambda x, a: x.class_chains(a.max_depth),
    "db-chain-totals": lambda x, a: x.chain_totals(a.max_depth),
    "db-call-diagram": _diagram,
    "db-statistics": lambda x, a: x.statistics(),
    "class-spec": lambda x, a: x.class_spec() if a.class_name is None else x.class_spec().filter(F.col("class_name") == a.class_name),
    "impact-analysis": _impact,
    "cycles": lambda x, a: x.cycles(a.max_depth),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skeinwork")
    sub = top.add_subparsers(dest="command", required=True)
    analyze = sub.add_parser("analyze", help="parse a source tree into tables")
    analyze.add_argument("source")
    analyze.add_argument("target")
    analyze.add_argument("--project", default="default")
    analyze.add_argument("--ddl")
    analyze.add_argument("--incremental", action="store_true", help="parse only the files that differ from the last run")
    for name in COMMANDS:
        p = sub.add_parser(name)
        p.add_argument("target", help="the folder that analyze wrote")
        for option in ("--project", "--table", "--class-name", "--method", "--text"):
            p.add_argument(option)
        p.add_argument("--max-depth", type=int, default=10 if name in ("impact-analysis", "cycles") else 5)
        p.add_argument("--mode", choices=("trail", "shortest"), default="trail")
        p.add_argument("--view", choices=("nodes", "summary", "packages"), default="nodes")
        p.add_argument("--style", choices=("mermaid", "plantuml"), default="mermaid")
        p.add_argument("--out", help="write the answer as JSON lines there instead of showing it")
    return top


def run(spark: SparkSession, argv: list[str]) -> DataFrame | None:
    """The answer to a command line; analyze writes its tables and gives their counts."""
    a = parser().parse_args(argv)
    if a.command == "analyze":
        if a.incremental:
            return project.refresh(spark, a.source, a.project, a.target, a.ddl).groupBy("state").count()
        project.save(project.ingest(spark, a.source, a.project, a.ddl), a.target)
        return summary.run_counts(project.Lineage.open(spark, a.target).t)
    a.spark = spark
    out = COMMANDS[a.command](project.Lineage.open(spark, a.target), a)
    if a.out:
        out.write.mode("overwrite").json(a.out)
        return None
    return out


def main() -> None:
    import sys

    answer = run(SparkSession.builder.appName("skeinwork").getOrCreate(), sys.argv[1:])
    if answer is not None:
        answer.show(1000, truncate=False)


if __name__ == "__main__":
    main()
