"""Lexical facts from source text: symbols, imports, calls.

A full semantic front end is not rebuilt here; fact tables are the contract, and
these functions fill them from text as well as words and braces allow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SYMBOL = re.compile(r"(?:^|(?<=[{};]))[ \t]*(pub(?:\([^)]*\))?[ \t]+)?(?:(?:async|unsafe|const|extern(?:[ \t]+\"[^\"]*\")?)[ \t]+)*(fn|struct|enum|trait|mod|const|static|type|impl)\b[ \t]*([^\n{;(]*)", re.M)
USE = re.compile(r"^[ \t]*(pub(?:\([^)]*\))?[ \t]+)?use[ \t]+([^;]+);", re.M)
CALL = re.compile(r"(?<![\w!])((?:\w+::)*\w+)\s*\(")
# Words before a parenthesis that are no calls.
KEYWORDS = frozenset("if while for match return fn loop in as let mut else move where impl Some Ok Err None self Self".split())


def flatten_use(tree: str) -> list[tuple[str, str]]:
    """(path, visible name) of every leaf of a use tree."""
    tree = " ".join(tree.split())
    open_at = tree.find("{")
    if open_at < 0:
        path, _, alias = tree.partition(" as ")
        path = path.strip()
        name = alias.strip() or path.rsplit("::", 1)[-1]
        if name == "self":
            path = path.removesuffix("::self")
            name = path.rsplit("::", 1)[-1]
        return [(path, name)]
    prefix, inner = tree[:open_at], tree[open_at + 1 : tree.rfind("}")]
    parts, depth, last = [], 0, 0
    for i, c in enumerate(inner):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(inner[last:i])
            last = i + 1
    parts.append(inner[last:])
    return [leaf for p in parts if p.strip() for leaf in flatten_use(prefix + p.strip())]


def block_end(text: str, start: int) -> int:
    """End of the braces that open after ``start``, or of the statement."""
    i = start
    while i < len(text) and text[i] not in "{;":
        i += 1
    if i == len(text) or text[i] == ";":
        return min(i + 1, len(text))
    depth = 0
    for j in range(i, len(text)):
        depth += (text[j] == "{") - (text[j] == "}")
        if depth == 0:
            return j + 1
    return len(text)


def facts(path: str, text: str) -> Iterator[tuple]:
    """(path, fact, name, detail, start, end), offsets in bytes."""
    at = lambda i: len(text[:i].encode())
    functions = []
    for m in SYMBOL.finditer(text):
        kind, name = m[2], re.split(r"[<:=\s]", m[3].strip(), maxsplit=1)[0] if m[2] != "impl" else m[3].strip()
        end = block_end(text, m.end(2))
        if kind == "fn":
            functions.append((m.start(), end, name))
        yield path, kind, name, (m[1] or "").strip(), at(m.start()), at(end)
    for m in USE.finditer(text):
        for leaf, name in flatten_use(m[2]):
            yield path, "use", name, leaf, at(m.start()), at(m.end())
    for start, end, name in functions:
        body = text.find("{", start, end)
        if body < 0:
            continue
        for m in CALL.finditer(text, body, end):
            if m[1].rsplit("::", 1)[-1] not in KEYWORDS and not any(s > start and s <= m.start() < e for s, e, _ in functions):
                yield path, "call", m[1], name, at(m.start()), at(m.end())


TYPE = re.compile(r"(?:\b\w+::)*\b([A-Za-z_]\w*)")
NO_TYPES = frozenset("mut dyn impl ref const static for where as u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 bool char str self".split())
FIELD = re.compile(r"(?:^|[{,(])\s*(?:pub(?:\([^)]*\))?\s+)?\w+\s*:\s*([^,{}]+)")
LET = re.compile(r"\blet\s+(?:mut\s+)?\w+\s*:\s*([^=;]+)")


def type_names(text: str) -> list[tuple[str, bool]]:
    """(name, within generics) of the types of a type expression, references, lifetimes and primitives left out."""
    text = re.sub(r"'\w+", "", text)
    return [(m[1], text.count("<", 0, m.start()) > text.count(">", 0, m.start())) for m in TYPE.finditer(text) if m[1] not in NO_TYPES and m[0] == text[m.start() : m.end()]]


def type_references(path: str, text: str) -> Iterator[tuple]:
    """(path, type, context, owner, line): where a source names a type.

    Contexts: parameter, return, field, impl, let, and generic for what stands in
    angle brackets in any of these.
    """
    line = lambda i: text.count("\n", 0, i) + 1
    for m in SYMBOL.finditer(text):
        kind, end = m[2], block_end(text, m.end(2))
        head = text[m.start(3) : text.find("{", m.start(3), end) if "{" in text[m.start(3) : end] else end]
        owner = re.split(r"[<(:=\s]", m[3].strip(), maxsplit=1)[0]
        found: list[tuple[str, str, int]] = []
        if kind == "fn":
            params, _, returns = head.partition("->")
            found += [("parameter", t[1], m.start(3)) for t in FIELD.finditer(params.partition("(")[1] + params.partition("(")[2].rpartition(")")[0])]
            found += [("return", returns.partition(" where ")[0].rstrip(";"), m.start(3))] if returns else []
            found += [("let", t[1], t.start()) for t in LET.finditer(text, m.end(), end)]
        elif kind == "struct":
            found += [("field", t[1], t.start(1)) for t in FIELD.finditer(text, text.find("{", m.start(3), end), end)] if "{" in text[m.start(3) : end] else []
        elif kind == "impl":
            owner = head.strip()
            found.append(("impl", re.sub(r"^<[^>]*>", "", head), m.start(3)))
        for context, t, at in found:
            for name, inner in type_names(t):
                yield path, name, "generic" if inner else context, owner, line(at)


def type_uses(files: DataFrame) -> DataFrame:
    """Type references of (path, content) rows, a narrow pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [f for p, t in zip(b["path"], b["content"]) if t for f in type_references(p, t)]
            yield pd.DataFrame(rows, columns=["path", "type", "context", "owner", "line"])

    return files.select("path", "content").mapInPandas(run, "path string, type string, context string, owner string, line long")


def lexical_facts(files: DataFrame) -> DataFrame:
    """Facts of (path, content) rows, a narrow pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [f for p, t in zip(b["path"], b["content"]) if t for f in facts(p, t)]
            yield pd.DataFrame(rows, columns=["path", "fact", "name", "detail", "start", "end"])

    return files.select("path", "content").mapInPandas(run, "path string, fact string, name string, detail string, start long, end long")
