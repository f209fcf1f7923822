"""Near-dedup and line dedup against brute force, on a test table and on odd rows."""

import random
import re
from itertools import combinations

import pytest

from skeinwork.llm import line_dedup, near_dedup
from skeinwork.llm.common import components, table


def _shingles(text):
    words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def _near(rows, percent=85):
    """(n_shingles, component) of each id, from all pairs that share a shingle."""
    sets = {i: _shingles(t) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    both = {}
    for ids in holders.values():
        for a, b in combinations(sorted(ids), 2):
            both[a, b] = both.get((a, b), 0) + 1
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, small, percent):
    docs = table(spark, small, "documents")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, percent=percent, trees=24).collect()}
    assert got == _near([(r.doc_id, r.text) for r in docs.collect()], percent)


def test_near_duplicates_in_one_large_group(spark):
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        words = list(base)
        words[(7 * i) % 120] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, f"other text number {i} with its own words {i * 7} and {i * 11} here") for i in range(40)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(160)} == {0} and all(got[1000 + i] == 1000 + i for i in range(40))


def test_near_duplicates_with_one_shared_template(spark):
    rng = random.Random(5)
    form = [f"t{k}" for k in range(174)]
    rows = []
    for i in range(1500):
        own = [f"o{i}-{k}" for k in range(22)]
        other = own[:-11] + [f"p{i}-{k}" for k in range(11)]
        rows += [(2 * i, " ".join(form + own)), (2 * i + 1, " ".join(form + other))]
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b, c = (_shingles(dict(rows)[k]) for k in (0, 1, 2))
    assert len(a & b) >= 0.85 * len(a | b) and len(a & c) < 0.85 * len(a | c)
    assert got == {i: i - i % 2 for i in range(3000)}


def test_near_duplicates_odd_rows(spark):
    long_ = " ".join(f"v{k}" for k in range(30_000))
    rows = [(5, "A b c"), (3, "a  B\nc"), (9, None), (8, ""), (7, " \t "), (None, "a b c"), (3, "a b c"), (20, long_), (21, long_ + " end")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, label string, digest string")
    out = near_dedup.near_duplicates(df).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "n_shingles", "component_id", "kept"}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert got[5] == (1, 3, False) and got[3] == (1, 3, True) and got[9] == (0, 9, True) and got[8] == (0, 8, True) and got[7] == (0, 7, True)
    assert got[21] == (29_997, 20, False) and got[None][1:] == (None, False)
    kept = near_dedup.keep_first(df)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 7), (False, 8), (False, 9), (False, 20), (True, 0)]
    assert kept.columns == df.columns
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (200, 200), (102, 101)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}


def _late_lines(rows, min_words=5, near_words=10, min_chars=40):
    """Lines alike to an earlier one, comparing every pair of long lines by their common ends."""
    seen, near, late = set(), [], {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate((text or "").split("\n")):
            w = [x for x in re.split(r"[ \t-\r]+", line) if x]
            if len(w) < min_words and (not w or len(line) < min_chars):
                continue
            hit = tuple(w) in seen
            if not hit and len(w) >= near_words:
                hit = any(_one_edit(w, v) for v in near)
            if hit:
                late.setdefault(i, []).append(k)
            if tuple(w) not in seen and len(w) >= near_words:
                near.append(w)
            seen.add(tuple(w))
    return late


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    front = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    back = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    return front + back >= max(len(a), len(b)) - 1


def test_line_dedup(spark, small):
    docs = table(spark, small, "documents")
    want = _late_lines([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: [int(x) for x in r.dropped.split(",")] for r in line_dedup.summary(docs).collect() if r.n_dropped}
    assert got == want and want


def test_line_dedup_edits(spark):
    base = [f"w{k}" for k in range(14)]
    edits = [base[:p] + ["new"] + base[p + 1 :] for p in (0, 6, 7, 13)] + [base[:p] + base[p + 1 :] for p in (0, 6, 13)] + [base[:p] + ["in"] + base[p:] for p in (0, 7, 14)]
    far = [base[:3] + ["q", "r"] + base[5:], base[:9] + base[11:], base[:8]]
    rows = [(0, " ".join(base))] + [(k + 1, "own line of this document\n" + " ".join(e)) for k, e in enumerate(edits + far)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.dropped for r in line_dedup.summary(df).collect()}
    want = _late_lines(rows)
    assert got == {i: ",".join(map(str, want.get(i, []))) for i, _ in rows}
    assert all(got[k + 1].endswith("1") for k in range(len(edits)))
    back = {r.doc_id: r.dropped for r in line_dedup.summary(spark.createDataFrame([(100 - i, t) for i, t in rows], "doc_id long, text string")).collect()}
    assert back == {i: ",".join(map(str, x)) for i, x in {**{100 - i: [] for i, _ in rows}, **_late_lines([(100 - i, t) for i, t in rows])}.items()}


def test_line_dedup_odd_rows(spark):
    same = "a b c d e f"
    spaceless = "日本語の長い一節" * 6
    wide = spark.createDataFrame([(1, f"{spaceless}\nshort one"), (2, f"short one\n{spaceless}"), (3, " " * 50), (4, " " * 50), (5, " ".join(f"u{k}" for k in range(100_000))), (6, " ".join(f"u{k}" for k in range(100_000)) + " more")], "doc_id long, text string")
    assert {r.doc_id: r.dropped for r in line_dedup.summary(wide).collect()} == {1: "", 2: "1", 3: "", 4: "", 5: "", 6: "0"}
    rows = [(2, same), (1, f"{same}\n\nx\n{same}"), (3, None), (4, ""), (None, f"q\n{same}"), (2, same), (5, " ".join(f"u{k}" for k in range(5000)))]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, line string")
    got = line_dedup.summary(df)
    assert sorted((r.doc_id or 0, r.n_lines, r.dropped) for r in got.collect()) == [(0, 2, ""), (1, 4, "0,3"), (2, 1, "0"), (2, 1, "0"), (3, 1, ""), (4, 1, ""), (5, 1, "")]
    out = line_dedup.drop_repeated_lines(df)
    assert out.columns == df.columns
    texts = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(t for t in texts if t[0] == 2) == [(2, ""), (2, "")] and (1, "\nx") in texts and (3, None) in texts and (None, f"q\n{same}") in texts
    assert line_dedup.summary(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.repeated_lines(df, near_words=1)


def test_recall_of_the_registered_setting(spark):
    """16 trees, as the query has: 3,000 pairs just over the threshold, and as many just under it that must stay apart."""
    rows, truth = [], 0
    for k in range(3000):
        words = [f"w{k}x{j}" for j in range(104)]  # 100 shingles, of which a changed word costs five
        other = list(words)
        for at in (7, 9) if k % 2 else (7, 27):
            other[at] = f"v{k}x{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        truth += k % 2  # 93 of 107 shingles are 0.869; 90 of 110 are 0.818
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    linked = {r.doc_id for r in got if not r.kept}
    assert all(d % 4 == 3 for d in linked) and len(linked) >= truth - 1


def test_rows_that_repeat_an_id_are_chosen_alike(spark):
    rows = [(1, f"text number {k} with words of its own {k}", k) for k in range(20)] + [(2, "other words here and there", 5)] * 2
    picked = set()
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(parts, "n")
        out = near_dedup.keep_first(df).collect()
        assert sorted(r.doc_id for r in out) == [1, 2]
        picked |= {r.text for r in out if r.doc_id == 1}
    assert len(picked) == 1
