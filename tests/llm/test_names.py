"""Tables whose columns have the operators' own names."""

from skeinwork.llm import line_dedup, near_dedup, quality, secret_scan

NAMES = ["at", "AT_", "th", "gone", "h1", "line", "n", "cutoff", "words", "base", "kept", "component_id", "tried"]


def test_extra_columns(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [(k, f"{line}\n" + " ".join(f"w{k}x{j}" for j in range(60)), "s") for k in range(3)]
    df = spark.createDataFrame([(*r, *range(len(NAMES))) for r in rows], "id long, text string, source string, " + ", ".join(f"{n} int" for n in NAMES))
    assert [(r.id, r.n_dropped) for r in line_dedup.summary(df, id_col="id").orderBy("id").collect()] == [(0, 0), (1, 1), (2, 1)]
    out = line_dedup.drop_repeated_lines(df, id_col="id")
    assert out.columns == df.columns and sorted(r.text.startswith("one two") for r in out.collect()) == [False, False, True]
    assert quality.keep(df, id_col="id").columns == df.columns and quality.keep(df, id_col="id").count() == 3
    assert near_dedup.keep_first(df, id_col="id").count() == 3
    assert secret_scan.redact(df, id_col="id").columns == df.columns and secret_scan.digest(df, id_col="id").count() == 3
