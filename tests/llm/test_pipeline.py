"""The corpus pipeline stage by stage and against brute force, and its registration."""

import zlib

import numpy as np
import tokenizers

import corpus_pipeline
from skeinwork.llm import quality, secret_scan, vocabulary
from skeinwork.llm.common import materialize, table

from .test_dedup import _late_lines, _near
from .test_filters import _base
from .test_tokens import _check_packing


def _masked(text, spans):
    """The text with a mask for each of its spans, overlapping ones as one."""
    out, at = "", 0
    for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s):
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return out + text[at:]


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    stages = dict(corpus_pipeline.STAGES)
    kept = materialize(stages["quality rules"](spark, docs, small))
    good = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == docs.columns

    lined = materialize(stages["line dedup"](spark, kept, small))
    late = _late_lines([(r.doc_id, r.text) for r in kept.collect()])
    want = {r.doc_id: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in late.get(r.doc_id, ())) for r in kept.collect()}
    assert {r.doc_id: r.text for r in lined.collect()} == want and all(r.n_chars == len(r.text) for r in lined.collect())

    single = materialize(stages["MinHash near-dedup"](spark, lined, small))
    near = _near([(r.doc_id, r.text) for r in lined.collect()], 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in near.items() if i == c) and single.columns == docs.columns

    more = [f"password = abc{k}DEF9 then {'0123456789abcdef' * 2} and AKIA{'ABCDEFGH' * 3}, token: {'q' * k}xyz{k}" for k in range(1, 9)]
    single = materialize(single.unionByName(spark.createDataFrame([(10**7 + k, t, "en", "s", len(t)) for k, t in enumerate(more)], "doc_id long, text string, lang string, source string, n_chars long")))
    safe = materialize(stages["secret scans"](spark, single, small))
    assert safe.count() == single.count() and not any(_base(r.text) for r in safe.collect())
    spans = {r.doc_id: r.spans for r in secret_scan.digest(single).collect()}
    assert {r.doc_id: r.text for r in safe.collect()} == {r.doc_id: _masked(r.text, spans[r.doc_id]) for r in single.collect()} and any(spans.values())
    assert all(r.n_chars == len(r.text) for r in safe.collect()) and safe.columns == docs.columns

    packed = stages["best-fit packing"](spark, safe, small)
    rows = packed.collect()
    used, total = _check_packing(rows, 1024), 0
    library = tokenizers.Tokenizer.from_file(vocabulary.DEFAULT_PATH)
    for r in safe.collect():
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        parts, start = sorted((p for p in rows if p.doc_id == r.doc_id), key=lambda p: p.piece), 0
        for p in parts:
            assert p.start == start and p.ids_crc32 == zlib.crc32(ids[start : start + p.length].tobytes())
            start += p.length
        assert start == len(ids)
        total += len(ids)
    assert -(-total // 1024) <= used <= 1.02 * total / 1024 + 1
    assert corpus_pipeline.run(spark, small).count() == sum(r.doc_id < 10**7 for r in rows)


def test_odd_documents(spark, tmp_path):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (1, "", "en", "s", 0, 1), (2, "x " * 100_000, "en", None, 5, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long")
    for docs in (df, df.limit(0)):
        path = f"{tmp_path}/{docs.count()}"
        docs.write.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, path).collect()
        corpus_pipeline.run(spark, path).collect()


def test_registration():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "secret scans", "best-fit packing"]
