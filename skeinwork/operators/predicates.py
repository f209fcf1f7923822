"""Filters and case expressions over the node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for the arguments that are set; None sets no filter, so nothing is left to fold away."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def op_letter(sql_type: Column) -> Column:
    return F.when(sql_type == "INSERT", "C").when(sql_type == "SELECT", "R").when(sql_type == "UPDATE", "U").when(sql_type == "DELETE", "D").otherwise("O")


def op_name(sql_type: Column) -> Column:
    return F.when(sql_type == "SELECT", "READ").when(sql_type == "INSERT", "CREATE").when(sql_type == "UPDATE", "UPDATE").when(sql_type == "DELETE", "DELETE").otherwise("OTHER")


def complexity_bucket(score: Column) -> Column:
    return F.when(score <= 3, "simple").when(score <= 7, "medium").when(score <= 12, "complex").otherwise("very_complex")


def touches_table(tables: Column, name: str, compat: bool = False) -> Column:
    """Whether a statement uses the table, its case aside; compat takes any table whose name holds the text."""
    low = name.lower()
    return F.exists(tables, lambda t: F.lower(t["name"]).contains(low) if compat else F.lower(t["name"]) == low)


def is_noise_call(src_class: Column, dst_class: Column, dst_method: Column) -> Column:
    """Calls that a sequence leaves out: a class's own equals, hashCode and toString, and a controller's format."""
    own = (src_class == dst_class) & dst_method.isin("equals", "hashCode", "toString")
    return own | ((src_class == "UserController") & (dst_method == "format"))


def in_project(project: Column, wanted: str | None) -> Column:
    """Callees that stay: all without a wanted project, else those of it; a blank project or the text null never stays."""
    if wanted is None:
        return F.lit(True)
    return F.coalesce((project == wanted) & ~F.trim(project).isin("", "null"), F.lit(False))


def is_suppressed_call(qualifier: Column, member: Column) -> Column:
    return (qualifier.isin(*N.LOGGERS) & member.isin(*N.LOG_METHODS)) | member.isin(*N.STREAM_METHODS)


def needs_enrichment(df: DataFrame, description_col: str = "ai_description", source_col: str = "source", limit: int | None = None) -> DataFrame:
    """Rows with source text and no description yet; a limit takes the first by class and name."""
    open_ = df.filter((F.coalesce(F.col(description_col), F.lit("")) == "") & (F.coalesce(F.col(source_col), F.lit("")) != ""))
    return open_.orderBy("class_name", "name").limit(limit) if limit is not None else open_
