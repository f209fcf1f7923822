"""URL filters: rules on hosts and paths, and pattern rules that are looked up by their rarest literal token.

A pattern that must contain a whole URL token (a run of letters and digits with a boundary on both sides) is indexed by that of its tokens
which the fewest URLs hold; a pattern of alternatives is indexed by one token for each. The tokens of a URL fetch the rules indexed by them,
and only those run their regular expression. Patterns without such a token run on every URL. The rules are few and given, so the index is a
literal map in the plan: URLs are judged row by row, and only the count of the rules' own tokens is aggregated.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (host, path prefix, verdict); the longest that fits decides.
HOST_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: (name, regular expression); a URL that matches one is blocked if no host rule fits it.
PATTERN_RULES = (
    ("feed-copy", r"[?&]utm_source=feed(&|#|$)"),
    ("session", r"[?&;]jsessionid="),
    ("session-php", r"[?&;]phpsessid="),
    ("print-view", r"[?&/]print(=|/|$)"),
    ("login", r"/login(/|\?|#|$)"),
    ("signup", r"/signup(/|\?|#|$)"),
    ("cart", r"/cart(/|\?|#|$)"),
    ("archive", r"\.zip(\?|#|$)"),
    ("media", r"\.(jpe?g|png|gif|webp|mp4)(\?|#|$)"),
    ("tracker", r"[/.]adserver\."),
)
_TOKEN_BREAK = "[^a-z0-9]+"


#: A group of plain alternatives, and a plain letter that may be missing.
_CHOICE, _MAYBE = re.compile(r"\(([a-z0-9?]+(?:\|[a-z0-9?]+)+)\)"), re.compile(r"([a-z0-9])\?")
#: What a pattern is made of: an escape, a set, a group without groups in it, or one character; each with its repetition.
_ITEM = re.compile(r"(\\.|\[(?:\\.|[^\]\\])*\]|\((?:\\.|[^()\\])*\)|[^\\])([*+?]|\{[\d,]*\})?")


def alternatives(pattern: str) -> list[str]:
    """Patterns without choices among plain letters that together match what the pattern does."""
    for regex, options in ((_CHOICE, lambda m: m[1].split("|")), (_MAYBE, lambda m: ["", m[1]])):
        for found in regex.finditer(pattern):
            if pattern[: found.start()].endswith(("\\", "(")) or "[" in pattern[: found.start()].rsplit("]", 1)[-1]:
                continue
            return [p for option in options(found) for p in alternatives(pattern[: found.start()] + option + pattern[found.end() :])]
    return [pattern]


def _is_edge(item: str) -> bool:
    """Whether what an item matches is never a letter or digit, or is a place."""
    if item.startswith("(") and item.endswith(")"):
        return all(len(x) <= 2 and _is_edge(x) for x in item[1:-1].split("|"))
    if item.startswith("["):
        return not item.startswith("[^") and not any(c.isalnum() for c in item[1:-1])
    return item in ("^", "$", "\\b") if item in ("^", "$", ".") or item.startswith("\\") and item[1:].isalnum() else bool(item) and not item[-1].isalnum()


def literal_tokens(pattern: str) -> set[str]:
    """Lower-case tokens that any URL matching the pattern, which has no alternatives outside of groups, holds whole."""
    if "|" in re.sub(r"\\.|\[[^\]]*\]|\((?:\\.|[^()\\])*\)", "", pattern):
        return set()
    found, run, open_ = set(), "", True  # a token may have begun before the pattern
    for item, often in [*_ITEM.findall(pattern), ("", "")]:
        if len(item) == 1 and item.isalnum() and item.isascii() and not often:
            run += item.lower()
            continue
        # the last item only marks the end, where a token may go on
        edge = bool(item) and not often and _is_edge(item)
        if run and edge and not open_:
            found.add(run)
        run, open_ = "", not edge
    return found


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(url), _TOKEN_BREAK, -1), lambda t: t != ""))


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ? or #; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _indexed(urls: DataFrame, patterns) -> tuple[dict[str, list[tuple[str, str]]], list[tuple[str, str]]]:
    """Token -> rules (name, regular expression) that are indexed by it, and the rules without one. Only the rules' own tokens are counted and collected."""
    each = [(name, p, literal_tokens(p)) for name, whole in patterns for p in alternatives(whole)]
    asked = sorted(set().union(*[t for _, _, t in each])) if each else []
    seen = {}
    if asked:
        held = urls.select(F.explode(url_tokens(F.col("url"))).alias("token")).filter(F.col("token").isin(asked))
        seen = {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}
    index: dict[str, list[tuple[str, str]]] = {}
    for name, pattern, tokens in each:
        if tokens:
            index.setdefault(min(tokens, key=lambda t: (seen.get(t, 0), t)), []).append((name, pattern))
    return index, [(name, pattern) for name, pattern, tokens in each if not tokens]


def _matched(url: Column, index: dict[str, list[tuple[str, str]]], unindexed: list[tuple[str, str]]) -> Column:
    """The first name of the rules that match the URL; null if none does."""
    hits = [F.array(F.when(url.rlike(pattern), F.lit(name))) for name, pattern in unindexed]
    if index:
        rule = lambda name, pattern: F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("regex"))
        table = F.create_map(*[x for token, rules in index.items() for x in (F.lit(token), F.array(*[rule(*r) for r in rules]))])
        tokens = F.filter(url_tokens(url), lambda t: t.isin(list(index)))
        fetched = F.flatten(F.transform(tokens, lambda t: table[t]))
        hits.append(F.transform(F.filter(fetched, lambda r: F.rlike(url, r["regex"])), lambda r: r["name"]))
    return F.array_min(F.array_compact(F.concat(*hits))) if hits else F.lit(None).cast("string")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules=HOST_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """(id_col, host, path, rule, verdict, pattern) for every row of pages; rule is the host rule that decided, if any.

    Of host rules the longest (host and path together) that fits wins: the host is the rule's or a subdomain of it and the path starts with
    the rule's. Else the URL is blocked if a pattern matches it, pattern then being the first such rule by name, and allowed if not.
    Null and malformed URLs have an empty host and path. Null ids and repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule = verdict = F.lit(None).cast("string")
    for host, path, said in sorted(host_rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    rows = rows.withColumns({"rule": rule, "said": verdict})

    index, unindexed = _indexed(rows, patterns)
    # Rows that are decided already, or have no URL, run no pattern.
    out = rows.withColumn("pattern", F.when(F.col("rule").isNull() & F.col("url").isNotNull(), _matched(F.col("url"), index, unindexed)))
    said = F.coalesce("said", F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", said.alias("verdict"), "pattern")


ORACLE = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r AS (
  SELECT *, '.' || host AS h,
    CASE WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
         WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
         WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
         WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule
  FROM p),
m AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN regexp_matches(url, '\.zip(\?|#|$)') THEN 'archive'
    WHEN regexp_matches(url, '/cart(/|\?|#|$)') THEN 'cart'
    WHEN regexp_matches(url, '[?&]utm_source=feed(&|#|$)') THEN 'feed-copy'
    WHEN regexp_matches(url, '/login(/|\?|#|$)') THEN 'login'
    WHEN regexp_matches(url, '\.(jpe?g|png|gif|webp|mp4)(\?|#|$)') THEN 'media'
    WHEN regexp_matches(url, '[?&/]print(=|/|$)') THEN 'print-view'
    WHEN regexp_matches(url, '[?&;]jsessionid=') THEN 'session'
    WHEN regexp_matches(url, '[?&;]phpsessid=') THEN 'session-php'
    WHEN regexp_matches(url, '/signup(/|\?|#|$)') THEN 'signup'
    WHEN regexp_matches(url, '[/.]adserver\.') THEN 'tracker' END AS pattern
  FROM r)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM m
"""
