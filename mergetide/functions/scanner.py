"""What a source file declares: imports, decorated classes with their arguments, and constructor parameters.

A file is read once, token by token, so that strings, template literals, regular expressions and comments hide what is in
them and brackets nest to any depth.  Only what stands at the top of a file counts: declarations inside functions are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decorators that give a file its type, those whose constructor counts, and their list fields.
KINDS = {"Component": "component", "NgModule": "module", "Injectable": "service", "Directive": "directive", "Pipe": "pipe"}
INJECTED = ["Component", "Injectable", "Directive"]
LISTS = {"imports": "module_imports", "declarations": "declarations", "exports": "exports", "providers": "providers"}
PRIMITIVES = ["string", "number", "boolean", "any", "void", "null", "undefined"]

DECLARED = (
    "struct<kind:string,class_name:string,selector:string,provided_in:string,template:string,template_url:string,style_urls:array<string>,module_imports:array<string>,"
    "declarations:array<string>,exports:array<string>,providers:array<string>,component_providers:array<string>,injections:array<string>,imports:array<string>>"
)

#: space and comments, then a token, or the end of the text
TOKEN = re.compile(r"""(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))*+(?:(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<string>'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?)|(?P<sign>=>|.)|\Z)""", re.S)
#: what a template literal can be passed over by, up to its end or a substitution
PLAIN = re.compile(r"(?:[^\\`$]+|\\.|\$(?!\{))*+", re.S)
PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
#: what a body can be passed over by, up to a brace, a template literal or a slash
BODY = re.compile(r"""(?:[^'"`/{}]+|'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?|//[^\n]*|/\*.*?(?:\*/|\Z))+""", re.S)
OPERAND = re.compile(r"([A-Za-z_$][\w$]*|[\w)\]}'\"`])\s*\Z")
ESCAPE = re.compile(r"\\(u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|\r?\n|.)", re.S)
CONTROL = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
CLOSED_BY = {"(": ")", "[": "]", "{": "}"}
#: words after which a slash begins a pattern
BEFORE_PATTERN = ["return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "instanceof", "new", "throw", "yield", "await"]


class Token(NamedTuple):
    """``kind``: name, number, string, template (without substitutions), mixed (a template with some), pattern or sign."""

    kind: str
    text: str
    start: int
    end: int


def template_end(text: str, at: int) -> tuple[int, bool]:
    """Where the template literal that begins at ``at`` ends, and whether it has substitutions."""
    mixed, i = False, at + 1
    while (i := PLAIN.match(text, i).end()) < len(text) and text[i] != "\\":
        if text[i] == "`":
            return i + 1, mixed
        mixed, i = True, substitution_end(text, i + 2)
    return len(text), mixed


def substitution_end(text: str, at: int) -> int:
    depth = 0
    for token in tokens(text, at):
        depth += (token.text == "{") - (token.text == "}")
        if depth < 0:
            return token.end
    return len(text)


def body_end(text: str, at: int) -> int:
    """Where the block that begins at ``at`` ends; nothing inside it is told apart."""
    depth, i = 0, at
    while i < len(text):
        if text[i] in "{}":
            depth += 1 if text[i] == "{" else -1
            i += 1
            if not depth:
                return i
        elif text[i] == "`":
            i = template_end(text, i)[0]
        elif found := BODY.match(text, i):
            i = found.end()
        else:  # a slash
            before = OPERAND.search(text, max(at, i - 40), i)
            pattern = None if before and before.group(1) not in BEFORE_PATTERN else PATTERN.match(text, i)
            i = pattern.end() if pattern else i + 1
    return len(text)


def tokens(text: str, at: int = 0, bodies: bool = True) -> Iterator[Token]:
    """Tokens from ``at`` on.  Without ``bodies``, blocks of functions are a pair of braces: those behind parentheses (a class
    that extends a call aside), a result type or an arrow."""
    before, heading, result = None, False, False
    match, new = TOKEN.match, tuple.__new__  # the constructor of a named tuple takes twice the time
    while (kind := (found := match(text, at)).lastgroup) is not None:
        start, at = found.span(kind)
        said = found[kind]
        if said == "`":
            at, mixed = template_end(text, start)
            kind, said = "mixed" if mixed else "template", text[start:at]
        elif said == "/":
            operand = before is not None and (before.kind in ("number", "string", "template", "mixed") or (before.kind == "name" and before.text not in BEFORE_PATTERN) or before.text in (")", "]", "}"))
            if not operand and (pattern := PATTERN.match(text, start)):
                kind, said, at = "pattern", pattern.group(), pattern.end()
        token = new(Token, (kind, said, start, at))
        last = before.text if before else ""
        if said == "class" and kind == "name" and last != ".":
            heading = True
        elif kind == "sign":
            if said == "{" and last not in ("<", ":", "|", "&", ","):
                if not bodies and not heading and (last in (")", "=>") or result):
                    end = body_end(text, token.start)
                    yield token
                    token = Token("sign", "}", end - 1, end)
                    at = end
                heading = result = False
            elif said == ":" and last == ")":
                result = True
            elif said in ",;=)?":
                result = False
        before = token
        yield token


def literal(token: Token) -> str:
    """The value of a string or of a template without substitutions."""

    def plain(m: re.Match) -> str:
        x = m.group(1)
        if x[0] in "ux" and len(x) > 1:
            return chr(min(int(x[1:].strip("{}"), 16), 0x10FFFF))
        return "" if x.endswith("\n") else CONTROL.get(x, x)

    body = token.text[1:]
    value = ESCAPE.sub(plain, body[:-1] if body.endswith(token.text[0]) else body)
    return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # pairs of escapes are one character


def closing(ts: list[Token], i: int) -> int:
    """Index of the bracket that closes the one at ``i``; the end where nothing does."""
    depth = 0
    for j in range(i, len(ts)):
        if ts[j].kind == "sign":
            depth += (ts[j].text in "([{") - (ts[j].text in ")]}")
            if not depth:
                return j
    return len(ts)


def parts(ts: list[Token]) -> list[list[Token]]:
    """Split at commas outside brackets."""
    out, i = [[]], 0
    while i < len(ts):
        if ts[i].text == "," and ts[i].kind == "sign":
            out.append([])
            i += 1
        else:
            j = closing(ts, i) + 1 if ts[i].kind == "sign" and ts[i].text in CLOSED_BY else i + 1
            out[-1] += ts[i:j]
            i = j
    return [p for p in out if p]


def fields(ts: list[Token]) -> dict[str, list[Token]]:
    """Assignments ``name: value`` of the object literal that is a decorator's first argument."""
    first = next(iter(parts(ts)), [])
    if not first or first[0].text != "{" or closing(first, 0) != len(first) - 1:
        return {}
    named = [p for p in parts(first[1:-1]) if len(p) > 2 and p[0].kind in ("name", "string") and p[1].text == ":"]
    return {literal(p[0]) if p[0].kind == "string" else p[0].text: p[2:] for p in named}


def listed(ts: list[Token]) -> list[str] | None:
    """Names of an array literal: ``X``, ``X.y`` and ``X.y(...)`` give ``X``, other elements nothing; None for what is no array."""
    if not ts or ts[0].text != "[" or closing(ts, 0) != len(ts) - 1:
        return None
    out = []
    for p in parts(ts[1:-1]):
        member = len(p) >= 3 and p[1].text == "." and p[2].kind == "name"
        if p[0].kind == "name" and (len(p) == 1 or (member and (len(p) == 3 or (p[3].text == "(" and closing(p, 3) == len(p) - 1)))):
            out.append(p[0].text)
    return out


def parameter_types(text: str, ts: list[Token]) -> list[str]:
    """Types of a parameter list as written, primitives left out: decorators, modifiers and defaults may be anything."""
    out, i = [], 0
    while i < len(ts):
        while i < len(ts) and ts[i].text not in (":", "=", ","):  # decorators, modifiers, name or pattern
            i = closing(ts, i) + 1 if ts[i].text in CLOSED_BY else i + 1
        if i < len(ts) and ts[i].text == ":":
            first, angle = i + 1, 0
            i = first
            while i < len(ts) and (angle or ts[i].text not in ("=", ",")):
                angle += (ts[i].text == "<") - (ts[i].text == ">")
                i = closing(ts, i) + 1 if ts[i].text in CLOSED_BY else i + 1
            if i > first and (kind := text[ts[first].start : ts[min(i, len(ts)) - 1].end]) not in PRIMITIVES:
                out.append(kind)
        while i < len(ts) and ts[i].text != ",":  # the default
            i = closing(ts, i) + 1 if ts[i].text in CLOSED_BY else i + 1
        i += 1
    return out


def constructor_types(text: str, body: list[Token]) -> list[str]:
    """Of the first constructor of a class that has a body."""
    i = 0
    while i < len(body):
        if body[i].text == "constructor" and i + 1 < len(body) and body[i + 1].text == "(":
            end = closing(body, i + 1)
            if end + 1 < len(body) and body[end + 1].text == "{":
                return parameter_types(text, body[i + 2 : end])
        i = closing(body, i) + 1 if body[i].kind == "sign" and body[i].text in CLOSED_BY else i + 1
    return []


def decorate(out: dict, name: str, args: list[Token]) -> None:
    """What a decorator of a class tells."""
    out["kind"] = KINDS[name]
    for field, value in fields(args).items():
        said = literal(value[0]) if len(value) == 1 and value[0].kind == "string" else None
        if said is not None and field == {"Component": "selector", "Directive": "selector", "Pipe": "name"}.get(name):
            out["selector"] = said
        elif said is not None and (name, field) == ("Injectable", "providedIn"):
            out["provided_in"] = said
        elif said is not None and (name, field) == ("Component", "templateUrl"):
            out["template_url"] = said
        elif (name, field) == ("Component", "template") and len(value) == 1 and value[0].kind in ("string", "template"):
            out["template"] = literal(value[0])
        elif (name, field) == ("Component", "styleUrls") and value[0].text == "[":
            out["style_urls"] = [literal(p[0]) for p in parts(value[1:-1]) if len(p) == 1 and p[0].kind in ("string", "template")]
        elif (names := listed(value)) is not None:
            if (name, field) == ("Component", "providers"):
                out["component_providers"] = names
            elif name == "NgModule" and field in LISTS:
                out[LISTS[field]] = names


def declared(text: str) -> dict:
    """All of :data:`DECLARED` for one file; the last decorated class gives the name, else the first class."""
    out: dict = {"kind": None, "class_name": None, "selector": None, "provided_in": None, "template": None, "template_url": None, "component_providers": [], "style_urls": [], "injections": []}
    out |= {c: [] for c in LISTS.values()}
    ts = list(tokens(text, bodies=False))
    loaded: dict[str, list[str]] = {"import": [], "export": []}
    pending: list[tuple[str, list[Token]]] = []
    first_class, i = None, 0
    while i < len(ts):
        word, after = ts[i].text, ts[i + 1] if i + 1 < len(ts) else Token("sign", "", 0, 0)
        if word == "@" and after.kind == "name":
            called = i + 2 < len(ts) and ts[i + 2].text == "("
            end = closing(ts, i + 2) if called else i + 1
            pending.append((after.text, ts[i + 3 : end] if called else []))
            i = end + 1
        elif ts[i].kind == "name" and word == "class":
            name = after.text if after.kind == "name" and after.text not in ("extends", "implements") else None
            first_class = first_class or name
            angle, j = 0, i + 1
            while j < len(ts) and (angle or ts[j].text != "{"):  # what it extends
                angle += (ts[j].text == "<") - (ts[j].text == ">")
                j = closing(ts, j) + 1 if ts[j].text in CLOSED_BY else j + 1
            end = closing(ts, j) if j < len(ts) else j
            for kind, args in pending:
                if kind in KINDS:
                    out["class_name"] = name
                    decorate(out, kind, args)
                    if kind in INJECTED:
                        out["injections"] += constructor_types(text, ts[j + 1 : end])
            pending, i = [], end + 1
        elif ts[i].kind == "name" and word in loaded and not (i and ts[i - 1].text == "."):
            j = i + 1
            if word == "import" and after.kind == "string":
                loaded[word].append(literal(after))
                i += 2
                continue
            while j < len(ts) and (ts[j].kind == "name" or ts[j].text in ("{", "*", ",")) and ts[j].text not in ("from", "class", "import", "export"):
                j = closing(ts, j) + 1 if ts[j].text == "{" else j + 1
            if j + 1 < len(ts) and ts[j].text == "from" and ts[j + 1].kind == "string":
                loaded[word].append(literal(ts[j + 1]))
                i = j + 2
            else:
                i += 1  # a declaration: what is exported follows
        else:
            if ts[i].kind != "name" or word not in ("default", "abstract", "declare"):
                pending = []
            i = closing(ts, i) + 1 if ts[i].kind == "sign" and ts[i].text in CLOSED_BY else i + 1
    out["class_name"] = out["class_name"] if out["kind"] else first_class
    return out | {"imports": loaded["import"] + loaded["export"]}


def scanned(text: Column) -> Column:
    """:data:`DECLARED` of a column of source texts; null texts declare nothing."""

    @F.pandas_udf(DECLARED)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.split(":")[0] for f in DECLARED.removeprefix("struct<").removesuffix(">").split(",")]
        for texts in batches:
            yield pd.DataFrame([declared(t or "") for t in texts], columns=names)

    return scan(text)
