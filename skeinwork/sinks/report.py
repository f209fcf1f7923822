"""Reports: text rendered by aggregation, and files written by Spark. Rows are aggregated before they are rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import markdown_cell, mermaid_id

#: Bits of the number of lines of a diagram that are joined at once.
_CHUNK_BITS = 13


def _text(lines: DataFrame, head: list[str]) -> DataFrame:
    """One row: head lines, then the column line in the order of column pos. For report-sized inputs."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return lines.agg(F.array_join(F.concat(F.array(*map(F.lit, head)), body), "\n").alias("text"))


def markdown_table(rows: DataFrame, order: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """One row with the Markdown table of already aggregated rows, by the order columns, nulls last; columns to drop only order."""
    shown = [c for c in rows.columns if c not in drop]
    cells = [markdown_cell(F.col(c).cast("string")) for c in shown]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    lines = rows.select(F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(f"k{k}") for k, c in enumerate(order)]).alias("pos"), line.alias("line"))
    return _text(lines, ["| " + " | ".join(shown) + " |", "|" + "---|" * len(shown)])


def top_table(rows: DataFrame, measure: str, order: list[str], n: int = 10) -> DataFrame:
    """One row with the Markdown table of the n rows with the highest measure, ties by the order columns."""
    first = rows.orderBy(F.desc_nulls_last(measure), *order).limit(n)
    return markdown_table(first.withColumn("__at", -F.col(measure)), ["__at", *order], drop=("__at",))


def mermaid_graph(edges: DataFrame, direction: str = "TD") -> DataFrame:
    """One row with a Mermaid flow chart of edges (src, dst, label)."""
    arrow = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit(" -->|"), "label", F.lit("| "))).otherwise(" --> ")
    node = lambda c: F.concat(mermaid_id(F.col(c)), F.lit('["'), F.replace(c, F.lit('"'), F.lit("'")), F.lit('"]'))
    line = F.concat(F.lit("    "), node("src"), arrow, node("dst"))
    return _text(edges.select(F.struct("src", "dst").alias("pos"), line.alias("line")), [f"graph {direction}"])


def class_text(rows: DataFrame) -> DataFrame:
    """(class_name, text): the specification of each row of classspec.class_rows() as Markdown."""

    def part(title: str, col: str):
        items = F.array_join(F.transform(F.filter(F.split(F.coalesce(col, F.lit("")), ","), lambda x: x != ""), lambda x: F.concat(F.lit("- "), markdown_cell(x))), "\n")
        return F.when(F.coalesce(col, F.lit("")) != "", F.concat(F.lit(f"\n\n## {title}\n"), items)).otherwise("")

    head = F.concat(F.lit("# "), "class_name", F.lit("\n\n"), F.concat_ws(" ", F.nullif("sub_type", F.lit("")), "type"), F.lit(" in "), F.coalesce("package_name", F.lit("the default package")))
    up = F.when(F.col("superclass").isNotNull(), F.concat(F.lit(", extends "), "superclass")).otherwise("")
    parts = [part(title, col) for title, col in (("Interfaces", "interfaces"), ("Fields", "fields"), ("Methods", "methods"), ("Depends on", "depends_on"))]
    return rows.select("class_name", F.concat(head, up, *parts).alias("text"))


def sequence_text(flow: DataFrame, style: str = "mermaid") -> DataFrame:
    """(top, text): a sequence diagram of activation_flow rows; style mermaid or plantuml.

    Lines are numbered in order by ranges and joined by chunks, so what a task holds at once is the chunks of one diagram, no path or line of it.
    """
    solid, dashed = ("->>", "-->>") if style == "mermaid" else ("->", "-->")
    pad = "    " if style == "mermaid" else ""
    party = lambda c: mermaid_id(F.regexp_replace(c, r"\.[^.]*$", ""))
    label = F.when(F.col("kind") == "return", "return").otherwise(F.regexp_extract("target", r"([^.]*)$", 1))
    line = F.concat(F.lit(pad), party("source"), F.when(F.col("kind") == "return", dashed).otherwise(solid), party("target"), F.lit(": "), label)
    order = ["top", "sort_path", "step", "line"]
    # ids ascend within a range and from range to range; a chunk never spans two ranges
    lines = flow.select("top", "sort_path", "step", line.alias("line")).repartitionByRange(*order).sortWithinPartitions(*order).select("top", "line", F.monotonically_increasing_id().alias("id"))
    joined = lambda col, key: F.transform(F.array_sort(F.collect_list(F.struct(key, col))), lambda x: x[col])
    chunks = lines.groupBy("top", F.shiftright("id", _CHUNK_BITS).alias("chunk")).agg(F.concat_ws("\n", joined("line", "id")).alias("body"))
    first, last = ("sequenceDiagram", []) if style == "mermaid" else ("@startuml", [F.lit("@enduml")])
    return chunks.groupBy("top").agg(F.concat_ws("\n", F.lit(first), joined("body", "chunk"), *last).alias("text"))


def write_sheets(sheets: dict[str, DataFrame], folder: str, form: str = "csv") -> None:
    """Each DataFrame as a folder of files of the given format (csv, json or parquet) under folder, as a workbook has sheets."""
    for name, df in sheets.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True) if form == "csv" else writer).format(form).save(f"{folder}/{name}")
