"""Definitions and references from code and markdown text, as tag rows."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from waymark.config import DEFAULT
from waymark.operators.languages import BY_SUFFIX
from waymark.operators.scanner import code_tags
from waymark.schema import TAG

_HEADER = re.compile(r"^(#{1,6})\s+(.+?)(?:\s*#*)?$", re.M)
_FENCE = re.compile(r"^(`{3,}|~{3,}).*?^\1", re.M | re.S)
_Scope = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
    a = node.args
    kind = lambda n: None if n is None else ast.unparse(n)
    found = [(x.arg, kind(x.annotation)) for x in a.posonlyargs + a.args]
    found += [("*" + a.vararg.arg, kind(a.vararg.annotation))] if a.vararg else []
    found += [(x.arg, kind(x.annotation)) for x in a.kwonlyargs]
    found += [("**" + a.kwarg.arg, kind(a.kwarg.annotation))] if a.kwarg else []
    names = [ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
    return {"parameters": [{"name": n, "type": t} for n, t in found], "return_type": kind(node.returns), "decorators": names, "raw": None}


def _fields(node: ast.ClassDef) -> list[dict] | None:
    found = [{"name": s.target.id, "type_annotation": ast.unparse(s.annotation), "default_value": None} for s in node.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)]
    return found[: DEFAULT.max_fields] or None


def python_tags(code: str, enclosing: bool = False) -> list[dict]:
    """Tags of one module; none if it can't be parsed.

    By default a reference belongs to the definition around the one it stands
    in (Q1); with ``enclosing`` it belongs to the innermost one.
    """
    try:
        module = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[dict] = []

    def tag(line: int, name: str, kind: str, node_type: str, scope, **more) -> None:
        out.append({"line": line, "name": name, "kind": kind, "node_type": node_type, "parent_name": scope.name if scope else None, "parent_line": scope.lineno if scope else None, "signature": None, "fields": None} | more)

    # a stack, since expressions may be nested deeper than calls may be
    waiting = [(statement, ()) for statement in reversed(module.body)]
    while waiting:
        node, scopes = waiting.pop()
        around = scopes[-1] if scopes else None
        if isinstance(node, ast.ClassDef):
            tag(node.lineno, node.name, "def", "class", around, fields=_fields(node))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            tag(node.lineno, node.name, "def", "function", around, signature=_signature(node))
        elif isinstance(node, ast.Assign) and not scopes:
            for target in node.targets:
                if isinstance(target, ast.Name):
                    tag(node.lineno, target.id, "def", "constant", None)
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                owner = around if enclosing else (scopes[-2] if len(scopes) > 1 else None)
                tag(node.func.end_lineno or node.lineno, name, "ref", "call", owner)
        inner = (*scopes, node) if isinstance(node, _Scope) else scopes
        for child in reversed(list(ast.iter_child_nodes(node))):
            outside = isinstance(node, _Scope) and child in node.decorator_list
            waiting.append((child, scopes if outside else inner))
    return out


def _preview(code: str, start: int, most: int, fences: list[tuple[int, int]]) -> str | None:
    following = next((m.start() for m in _HEADER.finditer(code, start) if not any(a <= m.start() < b for a, b in fences)), len(code))
    body = _FENCE.sub(" ", code[start:following])
    for pattern, put in ((r"`([^`]*)`", r"\1"), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(\*\*|__|\*|_)(\S(?:.*?\S)?)\1", r"\2")):
        body = re.sub(pattern, put, body)
    body = " ".join(body.split())
    if len(body) <= most:
        return body or None
    head = int(most * 0.6)
    first, last = body[:head].rsplit(" ", 1)[0], body[-(most - head) :].partition(" ")[2]
    strip = " .,;:!?-"
    return f"{first.strip(strip)} [...] {last.strip(strip)}"


def markdown_tags(code: str, most: int = 80) -> list[dict]:
    """A tag for each header outside of fenced blocks, under the nearest header of a lower level."""
    fences = [m.span() for m in _FENCE.finditer(code)]
    out: list[dict] = []
    open_: list[tuple] = []
    for m in _HEADER.finditer(code):
        if any(a <= m.start() < b for a, b in fences):
            continue
        level, title, line = len(m[1]), m[2].strip(), code.count("\n", 0, m.start()) + 1
        while open_ and open_[-1][0] >= level:
            open_.pop()
        parent = open_[-1] if open_ else (0, None, None)
        open_.append((level, title, line))
        shown = _preview(code, m.end(), most, fences)
        out.append({"line": line, "name": title, "kind": "def", "node_type": f"h{level}", "parent_name": parent[1], "parent_line": parent[2], "signature": {"parameters": [], "return_type": None, "decorators": [], "raw": shown} if shown else None, "fields": None})
    return out


def text_tags(path: str, code: str, enclosing: bool = False) -> list[dict]:
    """Tags of one text, by the suffix of its path; none for other suffixes."""
    suffix = path[path.rfind(".") :].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix in (".md", ".markdown", ".mdown", ".mkd"):
        return markdown_tags(code)
    if suffix in (".py", ".pyi"):
        return python_tags(code, enclosing)
    return code_tags(code, BY_SUFFIX[suffix], enclosing) if suffix in BY_SUFFIX else []


def tags(files: DataFrame, enclosing: bool = False) -> DataFrame:
    """Tags of ``path, rel, text`` rows by suffix; files in other languages give none."""
    kind = to_arrow_schema(TAG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for batch in batches:
            for path, rel, code in zip(*(c.to_pylist() for c in batch.columns)):
                out += [{"rel_fname": rel, "fname": path} | t for t in text_tags(path, code, enclosing)]
                if len(out) >= 1_000:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema=kind)

    return files.where("text is not null").select("path", F.coalesce("rel", "path").alias("rel"), "text").mapInArrow(run, TAG)
