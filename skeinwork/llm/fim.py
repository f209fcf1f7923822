"""Fill-in-middle transformation of documents.

An Arrow-batched pandas UDF cuts a text into units with the regex library, keeps only the end offset of each unit in a compact array, and
draws two cut points from a hash of the document's id. Two look-ups of offsets then slice the text; no list of units is made.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import unused

#: The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
#: A run of ASCII letters, or any one other character.
UNIT = r"[A-Za-z]+|[^A-Za-z]"


class Cut(NamedTuple):
    """What a document becomes: number of units, form (plain, psm or spm), lengths in code points (None if plain), and the output text."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """The offset at which each unit ends, after a 0 for the start; eight bytes a unit."""
    ends = array("q", [0])
    ends.extend(m.end() for m in unit.finditer(text))
    return ends


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The first four 8-digit groups of the sha256 of seed:doc_id, as unsigned integers; a null id is hashed as nothing."""
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(said[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform(text: str, doc_id: int | None, unit: regex.Pattern, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> Cut:
    """One document cut at two of its unit ends. A text that is empty or holds a marker stays plain, as do 100 - fim_percent of 100 others."""
    ends = unit_ends(text, unit)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= fim_percent or any(m in text for m in MARKERS):
        return Cut(n, "plain", None, None, text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[low], ends[high]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return Cut(n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Cut(n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def restore(output: str, form: str) -> str:
    """The text that transform() was given, read from its output and form alone."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, _, rest = output.removeprefix(first).partition(second)
    tail, _, middle = rest.partition(MIDDLE)
    return head + middle + tail if form == "psm" else tail + middle + head


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _applied(docs: DataFrame, id_col: str, text_col: str, fields: str, shown, seed: int, fim_percent: int, spm_percent: int, pattern: str) -> DataFrame:
    """docs with a struct column made of each document's Cut by shown, and its name."""
    names = [x.split()[0] for x in fields.split(", ")]

    @pandas_udf(fields)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        unit = regex.compile(pattern)
        for ids, texts in batches:
            rows = [shown(transform(t or "", None if i is None else int(i), unit, seed, fim_percent, spm_percent)) for i, t in zip(ids, texts)]
            made = {name: [r[k] for r in rows] for k, name in enumerate(names)}
            yield pd.DataFrame({k: pd.array(v, "Int64") if k in ("n", "prefix_chars", "middle_chars") else pd.Series(v, dtype=object) for k, v in made.items()})

    # ids go as strings: a column of longs with a null would come as floats
    at = unused(docs, "cut")
    return docs.withColumn(at, cut(F.col(id_col).cast("long").cast("string"), F.col(text_col))), at


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, pattern: str = UNIT) -> DataFrame:
    """docs with the text replaced by its output, and the columns fim_form, fim_prefix_chars and fim_middle_chars (null if plain).

    Units are matched left to right over code points and must cover the text. A null or empty text stays as it is, plain; a null id is hashed as nothing;
    rows that repeat an id and text come out alike. A very long text needs eight bytes a unit besides itself and its output. Other columns stay; an
    empty table gives no rows. No rows move between tasks.
    """
    out, at = _applied(docs, id_col, text_col, "form string, prefix_chars long, middle_chars long, output string", lambda c: (c.form, c.prefix_chars, c.middle_chars, c.output), seed, fim_percent, spm_percent, pattern)
    same = F.col(at)["form"] == "plain"
    made = {text_col: F.when(same, F.col(text_col)).otherwise(F.col(at)["output"]), "fim_form": F.col(at)["form"], "fim_prefix_chars": F.col(at)["prefix_chars"], "fim_middle_chars": F.col(at)["middle_chars"]}
    return out.withColumns(made).drop(at)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, pattern: str = UNIT) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256), one row per row of docs; texts are cut, restored and hashed in one pass.

    Odd rows as in fill_in_middle(); other columns are ignored.
    """
    fields = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    picked = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias(text_col))
    out, at = _applied(picked, id_col, text_col, fields, lambda c: (*c[:4], _sha256(c.output), _sha256(restore(c.output, c.form))), seed, fim_percent, spm_percent, pattern)
    return out.select(id_col, F.col(at)["n"].alias("n"), *[F.col(at)[x.split()[0]].alias(x.split()[0]) for x in fields.split(", ")[1:]])


#: DuckDB SQL for digest() with its own parameters. Units come as a list; slices of it give prefix, middle and suffix.
ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || h[k:k + 7] AS BIGINT)) AS h FROM d),
c AS (SELECT doc_id, text, units, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
