"""Java sources: a cutter in a table function, and expressions over what it cuts.

Python only walks a file's tokens and brackets once and cuts out spans: what leads a declaration, its type, its parameters, its body, the calls in it and the names it
declares. Modifiers, annotations, parameters and supertypes are read from the spans by expressions; what a call leads to is found by joins in ``operators.calltargets``.
A file that is cut short gives what is whole in it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<word>@?[^\W\d][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>->|::|\.\.\.|[^\s\w])""", re.S)
_MODIFIERS = tuple("public protected private static final abstract synchronized native strictfp transient volatile default sealed".split())
_KINDS = {"class", "interface", "enum", "record", "@interface"}
#: Words that an expression can follow: no call's name and no type of a declared name.
_KEYWORDS = set("if for while switch catch synchronized return new throw throws super this try else do assert case yield instanceof import package extends implements break continue goto default finally".split())
_OPEN = {"(": ")", "{": "}", "[": "]"}

_MEMBERS = [("n", pa.int32()), ("kind", pa.string()), ("lead", pa.string()), ("type", pa.string()), ("name", pa.string()), ("args", pa.string()), ("value", pa.string()), ("logical_name", pa.string()), ("source", pa.string())]
_LOCALS = [("n", pa.int32()), ("name", pa.string()), ("type", pa.string()), ("init_site", pa.int32()), ("pos", pa.int32()), ("until", pa.int32())]
_SITES = [("n", pa.int32()), ("site", pa.int32()), ("pos", pa.int32()), ("line", pa.int32()), ("kind", pa.string()), ("member", pa.string()), ("n_args", pa.int32()), ("on_kind", pa.string()), ("on_name", pa.string()), ("on_site", pa.int32())]
_ARROW = pa.schema([
    ("file_path", pa.string()), ("package_name", pa.string()), ("imports", pa.list_(pa.string())), ("name", pa.string()), ("type", pa.string()), ("lead", pa.string()), ("components", pa.string()), ("extends", pa.string()), ("implements", pa.string()),
    ("is_inner", pa.bool_()), ("logical_name", pa.string()), ("members", pa.list_(pa.struct(_MEMBERS))), ("locals", pa.list_(pa.struct(_LOCALS))), ("sites", pa.list_(pa.struct(_SITES))),
])
_LOCALS_SQL = "array<struct<n:int,name:string,type:string,init_site:int,pos:int,until:int>>"
_SITES_SQL = "array<struct<n:int,site:int,pos:int,line:int,kind:string,member:string,n_args:int,on_kind:string,on_name:string,on_site:int>>"
_CUT = (
    "file_path string, package_name string, imports array<string>, name string, type string, lead string, components string, extends string, implements string, is_inner boolean, logical_name string,"
    " members array<struct<n:int,kind:string,lead:string,type:string,name:string,args:string,value:string,logical_name:string,source:string>>,"
    f" locals {_LOCALS_SQL}, sites {_SITES_SQL}"
)
_A = "array<struct<name:string,parameters:map<string,string>>>"
SCHEMA = (
    f"file_path string, package_name string, name string, type string, superclass string, interfaces array<string>, imports array<string>, modifiers array<string>, annotations {_A}, is_inner boolean, logical_name string,"
    f" fields array<struct<name:string,type:string,modifiers:array<string>,initial_value:string,annotations:{_A},logical_name:string>>,"
    f" methods array<struct<name:string,return_type:string,modifiers:array<string>,parameters:array<struct<order:int,name:string,type:string>>,annotations:{_A},logical_name:string,source:string,n:int>>,"
    f" locals {_LOCALS_SQL}, sites {_SITES_SQL}"
)


def logical_name(text: str, start: int, rule: re.Pattern | None = None) -> str:
    """The name in the comment block above a declaration: what the rule's group logical_name finds, else its first line of text."""
    end = start
    while end and text[end - 1].isspace():
        end -= 1
    if not text.endswith("*/", 0, end) or (at := text.rfind("/*", 0, end)) < 0:
        return ""
    block = text[at:end]
    if rule and (m := rule.search(block)):
        return m["logical_name"].strip()
    lines = (line.strip().strip("/*").strip() for line in block.split("\n"))
    return next((line for line in lines if line and not line.startswith("@")), "")


class _Cutter:
    """Cuts one file. Tokens are numbered; every bracket knows its partner, behind the last token if it has none."""

    def __init__(self, path: str, text: str, rule: re.Pattern | None):
        self.path, self.text, self.rule = path, text, rule
        found = [(m.group(), m.start(), m.lastgroup) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"]
        self.words, self.starts, self.kinds = ([x[k] for x in found] for k in range(3))
        self.size = len(found)
        self.partner, open_ = {}, []
        for k, (w, _, kind) in enumerate(found):
            if kind == "sign" and w in _OPEN:
                open_.append(k)
            elif kind == "sign" and w in ")}]":
                # a bracket of another kind inside is taken as never closed
                while open_ and _OPEN[self.words[open_[-1]]] != w:
                    self.partner[open_.pop()] = k
                if open_:
                    self.partner[open_.pop()] = k
        for k in open_:
            self.partner[k] = self.size
        self.lines = [k for k, c in enumerate(text) if c == "\n"]
        self.rows: list[dict] = []
        self.package, self.imports = "", []

    def word(self, k: int) -> str:
        return self.words[k] if 0 <= k < self.size else ""

    def is_word(self, k: int) -> bool:
        return 0 <= k < self.size and self.kinds[k] == "word"

    def joined(self, a: int, b: int) -> str:
        out, last = [], ""
        for w in self.words[a:b]:
            if last and (last.isalnum() or last in "_,") and (w[0].isalnum() or w[0] in "_@?"):
                out.append(" ")
            out.append(w)
            last = w[-1]
        return "".join(out)

    def over_angles(self, k: int, end: int) -> int:
        """From a < to behind its >, if only parts of types stand between; else just behind the <."""
        depth, j = 0, k
        while j < end:
            w = self.words[j]
            depth += (w == "<") - (w == ">")
            if not depth:
                return j + 1
            if not (self.is_word(j) or w in "<>.,?&[]"):
                break
            j += 1
        return k + 1

    def prefix(self, k: int, end: int) -> int:
        """Behind the annotations and modifiers that start at k."""
        while k < end:
            w = self.words[k]
            if w[0] == "@" and w != "@interface" and len(w) > 1:
                k += 1
                while self.word(k) == "." and self.is_word(k + 1):
                    k += 2
                if self.word(k) == "(":
                    k = self.partner[k] + 1
            elif w in _MODIFIERS and self.kinds[k] == "word":
                k += 1
            elif w == "non" and self.word(k + 1) == "-":
                k += 3
            else:
                break
        return min(k, end)

    def file(self) -> list[dict]:
        self.declarations(0, self.size, None)
        return self.rows

    def declarations(self, k: int, end: int, row: dict | None) -> None:
        """The declarations from k to end, in a type's body or, without a row, in the file."""
        start, given = k, False  # given: an initial value has begun, whose blocks are part of it
        while k < end:
            w, sign = self.words[k], self.kinds[k] == "sign"
            if sign and w == ";":
                self.statement(start, k, None, row)
                start, given = k + 1, False
            elif sign and w == "{" and not given:
                close = min(self.partner[k], end)
                at = self.prefix(start, k)
                if self.word(at) in _KINDS and self.is_word(at + 1):
                    self.type_(start, at, k, close, row)
                else:
                    self.statement(start, k, (k + 1, close), row)
                k, start = close, close + 1
            elif sign and w in _OPEN:
                k = self.partner[k]
            elif sign and w in ")}]":  # closes nothing that was opened here
                start = k + 1
            given = given or (sign and w == "=")
            k += 1

    def type_(self, start: int, at: int, body: int, close: int, outer: dict | None) -> None:
        kind, name = self.words[at].lstrip("@"), self.words[at + 1]
        k, parts, now, components = at + 2, {"extends": "", "implements": "", "permits": ""}, None, ""
        if self.word(k) == "<":
            k = self.over_angles(k, body)
        if self.word(k) == "(":
            components = self.joined(k + 1, min(self.partner[k], body))
            k = min(self.partner[k] + 1, body)
        begun = k
        while k <= body:
            if k == body or self.words[k] in parts:
                if now:
                    parts[now] = self.joined(begun, k)
                now, begun = self.word(k), k + 1
            k = self.over_angles(k, body) if k < body and self.words[k] == "<" else k + 1
        row = {
            "file_path": self.path, "package_name": self.package, "imports": self.imports, "name": f"{outer['name']}.{name}" if outer else name, "type": kind, "lead": self.joined(start, at), "components": components, "extends": parts["extends"],
            "implements": parts["implements"], "is_inner": bool(outer), "logical_name": logical_name(self.text, self.starts[start], self.rule), "members": [], "locals": [], "sites": [],
        }
        self.rows.append(row)
        k = body + 1
        if kind == "enum":  # constants, up to the first semicolon; one may have a body
            while k < close and self.words[k] != ";":
                if self.words[k] == "{" and self.kinds[k] == "sign":
                    self.declarations(k + 1, min(self.partner[k], close), row)
                k = self.partner[k] + 1 if self.kinds[k] == "sign" and self.words[k] in _OPEN else k + 1
            k += 1
        self.declarations(min(k, close), close, row)

    def statement(self, start: int, end: int, body: tuple[int, int] | None, row: dict | None) -> None:
        """A member of the row from its tokens up to its body or semicolon; in the file, the package or an import."""
        if start >= end:
            return
        if row is None:
            if self.words[start] == "package":
                self.package = self.joined(start + 1, end)
            elif self.words[start] == "import":
                self.imports.append(self.joined(start + 1, end).removeprefix("static "))
            return
        at = self.prefix(start, end)
        if at == end:
            return  # a block that runs when the class or an object is made
        simple = row["name"].rsplit(".", 1)[-1]
        first = self.over_angles(at, end) if self.words[at] == "<" else at
        k = first
        while k < end and not (self.kinds[k] == "sign" and self.words[k] in "(=,"):
            k = self.over_angles(k, end) if self.words[k] == "<" else k + 1
        made = {"lead": self.joined(start, at), "value": None, "args": "", "logical_name": logical_name(self.text, self.starts[start], self.rule), "source": ""}
        n = len(row["members"])
        if self.word(k) == "(" and k < end or body and k == end and self.words[first] == simple:
            if k == first or not self.is_word(k - 1):
                return
            name = self.words[k - 1]
            kind = self.joined(first, k - 1) or ("constructor" if name == simple else "")
            if not kind:
                return
            close = min(self.partner[k], end) if k < end else end
            made |= {"n": n, "kind": "method", "type": kind, "name": name, "args": self.joined(k + 1, close) if k < end else row["components"]}
            if body:
                last = min(body[1], self.size - 1)
                made["source"] = self.text[self.starts[start] : self.starts[last] + len(self.words[last])]
                self.body(row, n, *body)
            row["members"].append(made)
            return
        if body:
            return
        name = k - 1
        while name > first and self.words[name] in "[]":
            name -= 1
        kind, k = self.joined(first, name) + "[]" * ((k - 1 - name) // 2), name
        if not kind or not self.is_word(name) or not self.is_word(first):
            return
        while k < end:  # one or more names, each with or without a value
            name = self.words[k]
            after = k + 1
            while after < end and self.words[after] not in ("=", ","):
                after += 1
            stop = after
            while stop < end and self.words[stop] != ",":
                if self.kinds[stop] == "sign" and self.words[stop] in _OPEN:
                    stop = self.partner[stop] + 1
                elif self.words[stop] == "<" and self.word(stop - 1)[:1].isupper():
                    stop = self.over_angles(stop, end)
                else:
                    stop += 1
            stop = min(stop, end)
            value = self.joined(after + 1, stop) if self.word(after) == "=" and after < stop else None
            row["members"].append(made | {"n": len(row["members"]), "kind": "field", "type": kind, "name": name, "value": value})
            k = stop + 1

    def scope_end(self, open_: int, end: int) -> int:
        """Where a name declared inside the bracket is no longer known: behind a bracket of parameters or of a head, its block or statement counts too."""
        close = min(self.partner[open_], end) if open_ >= 0 else end
        if open_ >= 0 and self.words[open_] == "(":
            after = close + 1
            if self.word(after) == "->":
                after += 1
            if self.word(after) == "{":
                return min(self.partner[after], end)
            if self.word(open_ - 1) in ("for", "try", "catch", "while", "if"):
                while after < end and self.words[after] != ";":
                    after = self.partner[after] + 1 if self.words[after] in _OPEN and self.kinds[after] == "sign" else after + 1
                return min(after, end)
        return close

    def body(self, row: dict, n: int, a: int, b: int) -> None:
        """The calls of a body in order, with what they are called on, and the names declared in it."""
        b = min(b, self.size)
        sites, locals_, closed, open_, commas, skip = [], [], {}, [-1], {}, set()
        inits: list[tuple[dict, int]] = []

        def site(pos: int, kind: str, member: str, paren: int | None, on: tuple) -> dict:
            made = {"n": n, "site": len(sites), "pos": pos, "line": bisect_right(self.lines, self.starts[pos]) + 1, "kind": kind, "member": member, "n_args": -1, "on_kind": on[0], "on_name": on[1], "on_site": on[2]}
            sites.append(made)
            if paren is not None:
                closed[self.partner[paren]] = made["site"]
                commas[paren] = made
                if self.partner[paren] > paren + 1:
                    made["n_args"] = 1
                else:
                    made["n_args"] = 0
            return made

        def primary(k: int) -> tuple:
            """What ends at token k: (kind, name, site)."""
            w = self.word(k)
            if k < a:
                return "unknown", None, None
            if self.kinds[k] == "sign":
                found = closed.get(k)
                return ("site", None, found) if w == ")" and found is not None else ("unknown", None, None)
            if self.kinds[k] == "text":
                return "type", "String", None
            chain, j = [w], k
            while self.word(j - 1) == "." and j - 2 >= a and self.is_word(j - 2):
                j -= 2
                chain.insert(0, self.words[j])
            if self.word(j - 1) == ".":
                on = primary(j - 2)
            elif ".".join(chain) == "System.out":
                return "type", "System.out", None
            else:
                on, chain = None, chain
                if chain[0] in ("this", "super"):
                    on, chain = (chain[0], None, None), chain[1:]
                else:
                    m = next((x for x, part in enumerate(chain) if part[:1].isupper()), None)
                    if m is not None and all(x[:1].islower() for x in chain[:m]) and (m == 0 or len(chain) > 1):
                        while m + 1 < len(chain) and chain[m + 1][:1].isupper() and not chain[m + 1].isupper():
                            m += 1
                        on, chain = ("name", ".".join(chain[: m + 1]), None), chain[m + 1 :]
                        if chain[:1] == ["this"]:
                            on, chain = ("outer", on[1], None), chain[1:]
                    else:
                        on, chain = ("name", chain[0], None), chain[1:]
            for part in chain:
                if part in ("class", "this", "super"):
                    return "unknown", None, None
                on = ("site", None, site(k, "field", part, None, on)["site"])
            return on

        def declared(k: int, kind: str | None, end_of: int | None = None) -> dict:
            made = {"n": n, "name": self.words[k], "type": kind, "init_site": None, "pos": k, "until": end_of if end_of is not None else self.scope_end(open_[-1], b)}
            locals_.append(made)
            return made

        k = a
        while k < b:
            w, kind, last = self.words[k], self.kinds[k], self.word(k - 1) if k > a else ""
            if kind == "sign":
                if w in _OPEN:
                    open_.append(k)
                elif w in ")}]" and len(open_) > 1:
                    open_.pop()
                elif w == "," and open_[-1] in commas and k not in skip:
                    commas[open_[-1]]["n_args"] += 1
                elif w == "->" and k > a:  # the names before it are of types unknown here
                    names = [k - 1] if self.is_word(k - 1) else []
                    if last == ")":
                        opened = next((j for j in range(k - 2, a - 1, -1) if self.words[j] == "("), a)
                        names = [j for j in range(opened + 1, k - 1) if self.is_word(j) and self.words[j + 1] in ",)" and (self.words[j - 1] in "(,")]
                    block = self.partner[k + 1] if self.word(k + 1) == "{" else self.scope_end(open_[-1], b)
                    for j in names:
                        declared(j, None, min(block, b))
                elif w == "::" and self.is_word(k + 1):
                    member = self.words[k + 1]
                    if member != "new":
                        on = primary(k - 1)
                        site(k + 1, "ref", member, None, on)
                    k += 1
                k += 1
                continue
            if kind != "word" or w[0] == "@":
                k += 1
                continue
            if w == "new" and self.is_word(k + 1):
                j = k + 2
                while self.word(j) == "." and self.is_word(j + 1):
                    j += 2
                stop = j
                if self.word(j) == "<":
                    stop = self.over_angles(j, b)
                    skip.update(x for x in range(j, stop) if self.words[x] == ",")
                if self.word(stop) == "(":
                    site(k, "new", self.joined(k + 1, j), stop, ("unknown", None, None))
                k = stop
                continue
            after = self.word(k + 1)
            if after == "(" and w not in _KEYWORDS:
                on: tuple | None = ("none", None, None)
                if last == ".":
                    on = primary(k - 2)
                elif last == ">":
                    j, depth = k - 1, 0
                    while j > a:
                        depth += (self.words[j] == ">") - (self.words[j] == "<")
                        if not depth:
                            break
                        j -= 1
                    on = primary(j - 2) if self.word(j - 1) == "." else None
                elif last and self.is_word(k - 1) and last not in _KEYWORDS:
                    on = None  # a method of a class inside the body
                if on is not None:
                    site(k, "call", w, k + 1, on)
                k += 1
                continue
            # a name behind a type
            if w not in _KEYWORDS and w not in _MODIFIERS:
                j = k - 1
                while j > a and self.words[j] == "]" and self.word(j - 1) == "[":
                    j -= 2
                arrays = (k - 1 - j) // 2
                angles = j
                if j > a and self.words[j] == ">":
                    depth = 0
                    while j > a:
                        depth += (self.words[j] == ">") - (self.words[j] == "<")
                        if not depth or not (self.is_word(j) or self.words[j] in "<>.,?&[]"):
                            break
                        j -= 1
                    skip.update(x for x in range(j, angles) if self.words[x] == ",")
                    j -= 1
                if j >= a and self.is_word(j) and self.words[j] not in _KEYWORDS and self.words[j] not in _MODIFIERS and self.words[j][0] != "@" and (angles == k - 1 - 2 * arrays) and after in ("=", ";", ":", ",", ")", "&", "|", "->", "?", ""):
                    first = j
                    while self.word(first - 1) == "." and self.is_word(first - 2):
                        first -= 2
                    made = declared(k, self.joined(first, j + 1) + "[]" * arrays)
                    if made["type"] == "var":
                        made["type"] = None
                        if after == "=":
                            stop = k + 2
                            while stop < b and self.words[stop] != ";":
                                stop = self.partner[stop] + 1 if self.kinds[stop] == "sign" and self.words[stop] in _OPEN else stop + 1
                            inits.append((made, stop - 1))
            k += 1
        for made, stop in inits:
            made["init_site"] = closed.get(stop)
        row["sites"] += sites
        row["locals"] += locals_


def parse(path: str, text: str | None, rule: str | None = None) -> list[dict]:
    """One dict per type of a file, with the spans of its members and the calls and names in its methods' bodies."""
    return _Cutter(path, text or "", re.compile(rule, re.S) if rule else None).file()


# Expressions over the spans. Text in quotes is never looked into; brackets may be nested a few levels deep.

_TEXT = r'"""(?s:.*?)"""|"(?:\\.|[^"\\])*+"|\'(?:\\.|[^\'\\])*+\''


def _nested(a: str, b: str, levels: int) -> str:
    inner = rf"\{a}(?:[^\{a}\{b}\"']|{_TEXT})*+\{b}"
    for _ in range(levels):
        inner = rf"\{a}(?:[^\{a}\{b}\"']|{_TEXT}|{inner})*+\{b}"
    return inner


_PARENS, _BRACES, _ANGLES = _nested("(", ")", 3), _nested("{", "}", 2), _nested("<", ">", 4)
_ANNOTATION = rf"@(?!interface\b)([\w.$]+) ?({_PARENS})?"
_ITEM = rf"(?:[^,(){{}}\"'<>]|{_TEXT}|{_PARENS}|{_BRACES}|{_ANGLES}|[<>])++"


def _items(text: Column) -> Column:
    """The parts between commas outside brackets and quotes."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(_ITEM), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")


def _annotations(lead: Column) -> Column:
    def entry(item: Column) -> Column:
        named = F.regexp_extract(item, r"^(\w+) ?=(?!=)(?s:.*)$", 1)
        value = F.trim(F.when(named != "", F.regexp_extract(item, r"^\w+ ?=(?s:(.*))$", 1)).otherwise(item))
        value = F.regexp_replace(value, r'^"([^"]*)"$', "$1")
        value = F.regexp_replace(value, r'^\{\s*"([^"]*)"\s*\}$', "$1")
        return F.struct(F.when(named != "", named).otherwise("value").alias("key"), value.alias("value"))

    def one(hit: Column) -> Column:
        args = F.regexp_replace(F.regexp_extract(hit, _ANNOTATION, 2), r"^\(|\)$", "")
        entries = F.transform(_items(args), entry)
        # of a parameter that is given twice the last counts
        last = F.filter(entries, lambda e, k: ~F.exists(F.slice(entries, k + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
        return F.struct(F.substring_index(F.regexp_extract(hit, _ANNOTATION, 1), ".", -1).alias("name"), F.map_from_entries(last).alias("parameters"))

    return F.transform(F.regexp_extract_all(lead, F.lit(_ANNOTATION), F.lit(0)), one)


def _modifiers(lead: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(lead, _ANNOTATION, " "), F.lit(rf"(?<![-\w])({'|'.join(_MODIFIERS)})(?!\w)"), F.lit(1))


def _parameters(args: Column) -> Column:
    declared = r"^(.+?) ?(\w+)((?:\[\])*)$"
    bare = F.filter(F.transform(_items(args), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, _ANNOTATION, ""), r"^ *final(?!\w)", ""))), lambda x: x.rlike(declared) & ~x.rlike(r"\bthis$"))
    return F.transform(bare, lambda x, k: F.struct((k + 1).cast("int").alias("order"), F.regexp_extract(x, declared, 2).alias("name"), F.trim(F.concat(F.regexp_extract(x, declared, 1), F.regexp_extract(x, declared, 3))).alias("type")))


def _types(text: Column) -> Column:
    return F.transform(_items(text), lambda x: F.trim(F.regexp_replace(x, _ANNOTATION, "")))


def _batches(rows: Iterator[dict], weight: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of rows of about so many letters of source."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 500 + sum(200 + len(m["source"]) for m in row["members"]) + 60 * (len(row["sites"]) + len(row["locals"]))
        if size > weight:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def parsed_classes(files: DataFrame, rule: str | None = None) -> DataFrame:
    """Every type declared in the files, inner ones too; rule is a regular expression with a group logical_name. A record's components are fields."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(row for batch in batches for path, text in zip(batch.column(0), batch.column(1)) for row in parse(path.as_py(), text.as_py(), rule))

    cut = files.select("file_path", "value").mapInArrow(of, _CUT)

    def field(m: Column) -> Column:
        return F.struct(m["name"].alias("name"), m["type"].alias("type"), _modifiers(m["lead"]).alias("modifiers"), m["value"].alias("initial_value"), _annotations(m["lead"]).alias("annotations"), m["logical_name"].alias("logical_name"))

    def component(p: Column) -> Column:
        none = F.array().cast(_A)
        return F.struct(p["name"].alias("name"), p["type"].alias("type"), F.array(F.lit("private"), F.lit("final")).alias("modifiers"), F.lit(None).cast("string").alias("initial_value"), none.alias("annotations"), F.lit("").alias("logical_name"))

    def method(m: Column) -> Column:
        return F.struct(m["name"].alias("name"), m["type"].alias("return_type"), _modifiers(m["lead"]).alias("modifiers"), _parameters(m["args"]).alias("parameters"), _annotations(m["lead"]).alias("annotations"), m["logical_name"].alias("logical_name"), m["source"].alias("source"), m["n"].alias("n"))

    supers = _types(F.col("extends"))
    parents = F.col("type") == "class"
    fields = F.concat(F.transform(_parameters(F.col("components")), component), F.transform(F.filter("members", lambda m: m["kind"] == "field"), field))
    return cut.select(
        "file_path", "package_name", "name", "type", F.when(parents, F.get(supers, F.lit(0))).alias("superclass"), F.when(parents, _types(F.col("implements"))).otherwise(F.concat(supers, _types(F.col("implements")))).alias("interfaces"), "imports",
        _modifiers(F.col("lead")).alias("modifiers"), _annotations(F.col("lead")).alias("annotations"), "is_inner", "logical_name", fields.alias("fields"), F.transform(F.filter("members", lambda m: m["kind"] == "method"), method).alias("methods"), "locals", "sites",
    )


def tables_of(parsed: DataFrame, project: str) -> dict[str, DataFrame]:
    """The class, method and field tables of parsed classes. Calls are calltargets.resolve_calls(parsed, project)."""
    from ..functions import names as N

    ann = F.transform("annotations", lambda a: a["name"])
    key = [F.lit(project).alias("project"), "package_name", F.col("name").alias("class_name")]
    classes = parsed.select(F.lit(project).alias("project"), "package_name", "name", "type", F.when(F.col("is_inner"), "inner_class").otherwise(N.sub_type(F.col("package_name"), F.col("name"), ann)).alias("sub_type"), "superclass", "interfaces", "imports", "file_path", "annotations", F.lit(False).alias("is_external"), "is_inner", "logical_name")
    methods = parsed.select(*key, F.explode("methods").alias("m")).select("project", "package_name", "class_name", "m.*").drop("n")
    fields = parsed.select(*key, F.explode("fields").alias("f")).select("project", "package_name", "class_name", "f.*")
    return {"class": classes, "method": methods.withColumn("visibility", N.visibility(F.col("modifiers"))), "field": fields}
