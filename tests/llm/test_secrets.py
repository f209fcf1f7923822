"""The randomness tests against brute force, drawn keys and written names, and texts of extreme size."""

import math
import random

from pyspark.sql import functions as F

from skeinwork.llm import secret_scan as ss

TAIL = lambda z: math.erfc(z / 2**0.5) / 2


def _alphabet(token):
    for name, letters in ss.ALPHABETS.items():
        if set(token) <= set(letters) or (name == "base64url" and set(token) <= set(letters)):
            return letters


def _evidence(token):
    """The five tests written out with counts, pairs and loops."""
    s, letters = token.rstrip("="), _alphabet(token.rstrip("="))
    one_kind = any(all(a <= c <= b for c in s) for a, b in ("AZ", "az", "09"))
    if len(s) < 2 or letters is None or one_kind:
        return None
    n, size = len(s), len(letters)

    def chi(groups):
        chi, kinds = 0.0, 0
        for group in groups:
            want = n * sum(c in group for c in letters) / size
            if want:
                chi, kinds = chi + (sum(c in group for c in s) - want) ** 2 / want, kinds + 1
        free = kinds - 1
        return TAIL(((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))

    vowels = set("aeilnorst")
    kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    fine = lambda c: (kind(c), c.lower() in vowels)
    groups = {}
    for c in "".join(ss.ALPHABETS.values()):
        groups.setdefault(fine(c), set()).add(c)

    def both(z):
        return 2 * TAIL(abs(z))

    share = [sum(kind(c) == k for c in letters) / size for k in range(4)]
    change = 1 - sum(q * q for q in share)
    variance = (n - 1) * change * (1 - change) + 2 * (n - 2) * (sum(q * (1 - q) ** 2 for q in share) - change**2)
    changes = sum(kind(a) != kind(b) for a, b in zip(s, s[1:]))
    low = [letters.index(c) < size // 2 for c in s]
    crossings = sum(a != b for a, b in zip(low, low[1:]))
    at = [letters.index(c) + 1 - (size + 1) / 2 for c in s]
    serial = sum(a * b for a, b in zip(at, at[1:])) / ((size * size - 1) / 12 * math.sqrt(n - 1))
    p = [chi([{c} for c in letters]), chi(groups.values()), both((changes - (n - 1) * change) / math.sqrt(variance)), both((crossings - (n - 1) / 2) / math.sqrt((n - 1) / 4)), both(serial)]
    return -sum(math.log(min(1, max(1e-30, x))) for x in p)


def test_evidence_against_brute_force(spark):
    rng = random.Random(1)
    tokens = ["".join(rng.choice(a) for _ in range(n)) for a in ss.ALPHABETS.values() for n in (2, 16, 17, 33, 200)]
    tokens += ["abcdefgh", "ABC", "1234", "a", "", "=", "ab+c-d", "Ab==", "aaaaaaaaaaaaaaaa1", "section-of-the-annual-report-12", "aB" * 40, "é1", "a b1"]
    got = {r.token: r.s for r in spark.createDataFrame([(t,) for t in tokens], "token string").select("token", ss.evidence(F.col("token")).alias("s")).collect()}
    for t in tokens:
        want = _evidence(t)
        assert (got[t] is None) == (want is None), t
        assert want is None or abs(got[t] - want) < 1e-3 + 1e-3 * want, (t, got[t], want)


def _names(rng, n):
    words = "blue street window paper engine driver kernel socket thread memory cache branch merge commit river mountain kitchen doctor school teacher student music guitar piano".split()
    shapes = (lambda w: "-".join(w), lambda w: "_".join(w), lambda w: "/".join(w), lambda w: "".join(map(str.capitalize, w)), lambda w: "".join(w) + str(rng.randrange(1000)), lambda w: "-".join(w) + "-2024-05-17", lambda w: "_".join(w).upper() + "_7")
    out = []
    while len(out) < n:
        t = rng.choice(shapes)([rng.choice(words) for _ in range(rng.randint(2, 6))])
        if len(t) >= 16:
            out.append(t)
    return out


def test_drawn_keys_are_found_and_written_names_left(spark):
    rng = random.Random(2)
    keys = [(name, n, "".join(rng.choice(letters) for _ in range(n))) for name, letters in ss.ALPHABETS.items() for n in (16, 20, 24, 32, 40) for _ in range(40)]
    keys = [k for k in keys if k[0] != "hex" or k[1] < 24]  # longer ones are base spans
    names = _names(rng, 4000)
    rows = [(k, f"x {t[2]} y") for k, t in enumerate(keys)] + [(10_000 + k, f"x {t} y") for k, t in enumerate(names)]
    got = {r.doc_id: r.spans for r in ss.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {k for k, s in got.items() if "random" in s}
    false = [k for k in found if k >= 10_000]
    hits = {n: sum(k in found for k, t in enumerate(keys) if t[1] == n) / sum(t[1] == n for t in keys) for n in (16, 20, 24, 32, 40)}
    print("found by length", hits, "false", len(false), "of", len(found))
    assert len(false) <= 0.05 * len(found) and all(hits[n] >= 0.95 for n in (24, 32, 40)) and hits[20] >= 0.8 and hits[16] >= 0.8


def test_written_names_alone_give_nothing(spark):
    rows = [(k, f"see {t} there") for k, t in enumerate(_names(random.Random(3), 3000))]
    assert sum("random" in r.spans for r in ss.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()) <= 3


def test_keys_in_paths_and_without_digits(spark):
    rng = random.Random(4)
    keys = ["".join(rng.choice(ss.ALPHABETS["base62"]) for _ in range(30)) for _ in range(40)]
    letters = ["".join(rng.choice(ss.ALPHABETS["base62"][10:]) for _ in range(40)) for _ in range(40)]
    rows = [(k, f"/my-app/v1/{t}") for k, t in enumerate(keys)] + [(100 + k, f"sk_live_{t}") for k, t in enumerate(keys)] + [(200 + k, t) for k, t in enumerate(letters)]
    got = {r.doc_id: r.spans for r in ss.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[k].startswith("random:") for k in range(40)) >= 38 and sum(got[100 + k].startswith("random:") for k in range(40)) >= 38
    assert sum(got[200 + k] == "random:0:40" for k in range(40)) >= 25  # no digits at all is itself a little unlikely


def test_very_long_texts(spark):
    rng = random.Random(5)
    big = "".join(rng.choice(ss.ALPHABETS["base64"]) for _ in range(1_000_000))
    texts = [big, "password=qwerty1 " * 100_000, " ".join(big[24 * k : 24 * k + 24] for k in range(20_000)), "a/" * 200_000, "secret " + " " * 500_000, "token" * 100_000, "my_secret_" * 50_000 + "token=abcdefgh"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ss.digest(df).collect()}
    assert got[0].spans == "random:0:1000000" and got[1].n_assign == 100_000 and got[2].spans.count("random") > 15_000
    assert got[3].spans == got[4].spans == got[5].spans == "" and got[6].n_assign == 1 and got[6].spans.count(":") == 2
    masked = {r.doc_id: r.text for r in ss.redact(df).collect()}
    assert masked[0] == "[secret]" and masked[1] == "[secret] " * 100_000 and all(masked[k] == texts[k] for k in (3, 4, 5))


def test_redact_keeps_names_and_letters(spark):
    rows = [(1, "﻿é😀 password=abcdef1﻿, x😀", 5), (2, "deadbeefdeadbeefdeadbeefapikey=abcdef secret=zzzzzz", 6), (3, "", 7), (1, "none", None)]
    df = spark.createDataFrame([(*r, *"abcd") for r in rows], "doc_id long, text string, cutoff int, __base string, __tried string, size string, spans string")
    out = ss.redact(df)
    assert out.columns == df.columns
    assert [r.text for r in out.collect()] == ["﻿é😀 [secret]﻿, x😀", "[secret] [secret]", "", "none"] and [r.cutoff for r in out.collect()] == [5, 6, 7, None]
    assert ss.redact(df.limit(0)).count() == 0
