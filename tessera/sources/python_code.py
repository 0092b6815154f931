"""Python source files as tables: symbols, imports, bases, calls, fields and the facts that checks need.

One pass over each file, in Python workers, gives all facts; the rest of the engine joins tables. A file that doesn't parse
gives a row in ``parse_errors`` and no facts.
"""

from __future__ import annotations

import ast
import hashlib
import inspect
import io
import re
import tokenize
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import is_ignored

LOGGING = ("debug", "info", "warning", "error", "exception", "critical")
#: Files whose facts a worker holds at once.
FILES_AT_ONCE = 256
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)

FACTS = """path string, error string,
symbols array<struct<id: string, kind: string, name: string, qualified_name: string, file_path: string, byte_start: int, byte_end: int, line_start: int, line_end: int, signature: string, docstring: string, decorators: array<string>, parent_id: string, content_hash: string, language: string, ord: int, complexity: int, untyped_params: array<string>, loop_calls: array<string>, except_pattern: string, has_tablename: boolean, fields: array<struct<ord: int, name: string, type_text: string, has_default: boolean>>, bases: array<string>, calls: array<struct<ord: int, shape: string, base: string, attr: string, raw: string>>>>,
imports array<struct<ord: int, local: string, target: string, style: string>>"""


def symbol_id(path: str, qualified_name: str, kind: str) -> str:
    return hashlib.sha256(f"{path}:{qualified_name}:{kind}".encode()).hexdigest()[:16]


@dataclass
class _Container:
    """What directly holds a statement. ``outer``: the next one; clauses such as else and except hide it."""

    node: ast.AST | None
    outer: _Container | None = None

    def in_function(self) -> bool:
        return isinstance(self.node, (ast.FunctionDef, ast.AsyncFunctionDef)) or (self.outer is not None and self.outer.in_function())


class _Reader:
    def __init__(self, path: str, content: bytes):
        self.path, self.raw, self.tree = path, content, ast.parse(content)
        self.line_at = [0]
        for line in content.splitlines(keepends=True) if b"\r" in content.replace(b"\r\n", b"") else re.findall(rb"[^\n]*\n|[^\n]+", content):
            self.line_at.append(self.line_at[-1] + len(line))
        self.symbols: list[dict] = []
        self.ids: dict[ast.AST, str] = {}

    def at(self, line: int, col: int) -> int:
        return self.line_at[line - 1] + col

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def source(self, node: ast.AST) -> str:
        a, b = self.span(node)
        return self.raw[a:b].decode("utf-8", "replace")

    def walk(self, body: list[ast.stmt], held: _Container | None) -> None:
        for s in body:
            if isinstance(s, _DEFS):
                if not (held and held.in_function()):
                    self.add(s, held)
                self.walk(s.body, _Container(s, held))
            else:
                self.walk(getattr(s, "body", None) or [], _Container(s, held)) if isinstance(getattr(s, "body", None), list) else None
                for name in ("orelse", "finalbody"):
                    self.walk(getattr(s, name, None) or [], _Container(None))
                for part in [*getattr(s, "handlers", []), *getattr(s, "cases", [])]:
                    self.walk(part.body, _Container(None))

    def add(self, node, held: _Container | None) -> None:
        method = held is not None and isinstance(held.node, ast.ClassDef)
        kind = "class" if isinstance(node, ast.ClassDef) else "method" if method else "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function"
        names, c = [node.name], held
        while c is not None and isinstance(c.node, ast.ClassDef):
            names.insert(0, c.node.name)
            c = c.outer
        start, end = self.span(node)
        first, line = start, node.lineno
        if node.decorator_list:
            d = self.at(node.decorator_list[0].lineno, node.decorator_list[0].col_offset)
            first = self.raw.rindex(b"@", 0, d)
            line = self.raw.count(b"\n", 0, first) + 1
        qualified = ".".join(names)
        self.ids[node] = found = symbol_id(self.path, qualified, kind)
        self.symbols.append(
            {
                "id": found, "kind": kind, "name": node.name, "qualified_name": qualified, "file_path": self.path, "byte_start": first, "byte_end": end, "line_start": line, "line_end": node.end_lineno,
                "signature": self.signature(start, node), "docstring": self.docstring(node), "decorators": [self.source(x) for x in node.decorator_list], "parent_id": self.ids.get(held.node) if method else None,
                "content_hash": hashlib.sha256(self.raw[first:end]).hexdigest(), "language": "python", "ord": len(self.symbols), **self.checks(node),
            }
        )

    def signature(self, start: int, node) -> str:
        """From def or class to the colon that ends the header, which is the first outside brackets and lambdas."""
        depth, lambdas, text = 0, 0, self.raw[start : self.span(node)[1]]
        try:
            for t in tokenize.tokenize(io.BytesIO(text).readline):
                if t.type == tokenize.NAME and t.string == "lambda":
                    lambdas += 1
                if t.type != tokenize.OP:
                    continue
                depth += (t.string in "([{") - (t.string in ")]}")
                if t.string == ":" and not depth:
                    if lambdas:
                        lambdas -= 1
                        continue
                    lines = text.split(b"\n")
                    before = sum(len(x) + 1 for x in lines[: t.start[0] - 1])
                    return text[: before + len(lines[t.start[0] - 1].decode()[: t.start[1]].encode())].decode().rstrip()
                if t.string == ":" and depth and lambdas:
                    lambdas -= 1
        except (tokenize.TokenError, IndentationError):
            pass
        return text.decode("utf-8", "replace").split(":")[0].rstrip()

    def docstring(self, node) -> str | None:
        first = node.body[0]
        if not (isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)):
            return None
        m = re.fullmatch(r"(?s)[rRuUbB]*('''|\"\"\"|'|\")(.*)\1", self.source(first.value))
        return None if m is None else inspect.cleandoc(m[2]) if m[2] else ""

    def own_calls(self, node) -> Iterator[ast.Call]:
        """Calls of a body in source order, nested definitions aside."""

        def walk(n: ast.AST) -> Iterator[ast.Call]:
            if isinstance(n, _DEFS):
                return
            if isinstance(n, ast.Call):
                yield n
            for child in sorted(ast.iter_child_nodes(n), key=lambda c: (getattr(c, "lineno", 0), getattr(c, "col_offset", 0))):
                yield from walk(child)

        for s in node.body:
            yield from walk(s)

    def checks(self, node) -> dict:
        out = {"complexity": None, "untyped_params": [], "loop_calls": [], "except_pattern": None, "has_tablename": False, "fields": [], "bases": [], "calls": []}
        if isinstance(node, ast.ClassDef):
            out["bases"] = [self.source(b) for b in node.bases] + [f"{k.arg}={self.source(k.value)}" if k.arg else f"**{self.source(k.value)}" for k in node.keywords]
            annotated = [s for s in node.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)]
            out["fields"] = [{"ord": i, "name": s.target.id, "type_text": self.source(s.annotation), "has_default": s.value is not None} for i, s in enumerate(annotated)]
            out["has_tablename"] = any(isinstance(s, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__tablename__" for t in s.targets) for s in node.body)
            return out
        nodes = [n for s in node.body for n in ast.walk(s)]
        out["complexity"] = 1 + sum(isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)) for n in nodes) + sum(len(n.values) - 1 for n in nodes if isinstance(n, ast.BoolOp))
        a = node.args
        plain, defaults = [*a.posonlyargs, *a.args], {x.arg for x in [*a.posonlyargs, *a.args][len(a.posonlyargs) + len(a.args) - len(a.defaults) :]} | {x.arg for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d is not None}
        untyped = lambda x: self.source(x.annotation) in ("dict", "Dict", "Any") if x.annotation else x.arg in defaults or x.arg not in ("self", "cls")
        out["untyped_params"] = [x.arg for x in [*plain, *a.kwonlyargs] if untyped(x)]
        callee = lambda c: c.func.attr if isinstance(c.func, ast.Attribute) else c.func.id if isinstance(c.func, ast.Name) else None
        loops = [n for n in nodes if isinstance(n, (ast.For, ast.AsyncFor, ast.While))]
        out["loop_calls"] = sorted({x for n in loops for c in ast.walk(n) if isinstance(c, ast.Call) and (x := callee(c))})
        handlers = sorted((n for n in nodes if isinstance(n, ast.ExceptHandler)), key=lambda n: (n.lineno, n.col_offset))
        if handlers:
            out["except_pattern"] = f"except {self.source(handlers[0].type) if handlers[0].type else 'bare'}: {self.logging(handlers[0])}"
        for i, c in enumerate(self.own_calls(node)):
            f = c.func
            simple = isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name)
            out["calls"].append({"ord": i, "shape": "attribute" if isinstance(f, ast.Attribute) else "identifier" if isinstance(f, ast.Name) else "other", "base": f.value.id if simple else None, "attr": f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None, "raw": self.source(f)})
        return out

    def logging(self, handler: ast.ExceptHandler) -> str:
        calls = sorted((n for s in handler.body for n in ast.walk(s) if isinstance(n, ast.Call)), key=lambda n: (n.lineno, n.col_offset))
        for c in calls:
            if isinstance(c.func, ast.Attribute) and c.func.attr in LOGGING:
                return self.source(c.func)
            if isinstance(c.func, ast.Name) and c.func.id == "print":
                return "print"
        return "none"

    def imports(self) -> list[dict]:
        out = []
        nodes = sorted((n for n in ast.walk(self.tree) if isinstance(n, (ast.Import, ast.ImportFrom))), key=lambda n: (n.lineno, n.col_offset))
        for n in nodes:
            style = "relative" if isinstance(n, ast.ImportFrom) and n.level else "absolute"
            for a in n.names:
                if a.name == "*":
                    out.append({"ord": len(out), "local": None, "target": None, "style": style})
                else:
                    out.append({"ord": len(out), "local": a.asname or a.name.split(".")[0], "target": a.name.split(".")[-1], "style": style})
        return out


def read_file(path: str, content: bytes) -> dict:
    try:
        r = _Reader(path, bytes(content))
    except (SyntaxError, ValueError, RecursionError) as e:
        return {"path": path, "error": f"{type(e).__name__}: {e}", "symbols": [], "imports": []}
    r.walk(r.tree.body, None)
    return {"path": path, "error": None, "symbols": sorted(r.symbols, key=lambda s: s["byte_start"]), "imports": r.imports()}


#: What reads a file of a language into facts.
READERS = {"python": read_file}


def reader_of(language: str) -> Callable[[str, bytes], dict]:
    """The reader of a language; a ValueError for one without."""
    if language not in READERS:
        raise ValueError(f"no reader for {language!r}; there is {', '.join(sorted(READERS))}")
    return READERS[language]


def files_under(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """(path, content) of the Python files below ``root``; paths are relative to it."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.rstrip("/").split("://")[-1])
    rows = raw.select(F.regexp_replace("path", f"^.*?{base}/", "").alias("path"), "content")
    return rows.where(~is_ignored(F.col("path"), patterns or []))


def ignore_patterns(spark: SparkSession, path: str) -> list[str]:
    """Lines of an ignore file that aren't blank and don't begin with '#'."""
    return [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip() and not r["value"].startswith("#")]


def facts(files: DataFrame) -> DataFrame:
    """A row per file of ``files`` (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), FILES_AT_ONCE):
                part = pdf.iloc[a : a + FILES_AT_ONCE]
                yield pd.DataFrame([read_file(p, c) for p, c in zip(part["path"], part["content"], strict=True)], columns=["path", "error", "symbols", "imports"])

    return files.select("path", "content").mapInPandas(run, FACTS)


@dataclass
class Code:
    """The tables of one tree of sources."""

    symbols: DataFrame
    imports: DataFrame
    bases: DataFrame
    calls: DataFrame
    class_fields: DataFrame
    parse_errors: DataFrame
    paths: DataFrame


def tables(found: DataFrame) -> Code:
    """``found``: facts, preferably written or cached, since several tables read them. ``corpus_pos`` orders symbols by path, then bytes."""
    s = found.select(F.explode("symbols").alias("s")).select("s.*")
    symbols = s.withColumn("corpus_pos", F.struct("file_path", "byte_start"))
    imports = found.select("path", F.explode("imports").alias("i")).select("path", "i.*")
    bases = s.select(F.col("id").alias("class_id"), "file_path", F.posexplode("bases").alias("ord", "text"))
    calls = s.select(F.col("id").alias("caller"), "parent_id", "file_path", "byte_start", F.explode("calls").alias("c")).select("caller", "parent_id", "file_path", "byte_start", "c.*")
    fields = s.select("id", "qualified_name", F.explode("fields").alias("f")).select(F.col("id").alias("symbol_id"), "qualified_name", "f.*")
    return Code(symbols.drop("bases", "calls", "fields"), imports, bases, calls, fields, found.where("error is not null").select("path", "error"), found.select("path"))
