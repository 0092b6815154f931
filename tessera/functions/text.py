"""Text expressions: tokens, document texts, costs, classification, redaction. All built from column functions."""

from __future__ import annotations

import fnmatch
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of each intent, in the order in which intents are tried.
INTENTS = {
    "debug": ["error", "exception", "traceback", "crash", "fails", "broken", "bug"],
    "feature": ["add", "implement", "create", "new", "support for"],
    "refactor": ["refactor", "rename", "clean up", "restructure", "simplify"],
}

# What is redacted from served source, and what counts as a reference to a symbol in a query.
INJECTION_PATTERNS = [
    r"(?im)^\s*(system|assistant)\s*:\s",
    r"(?i)ignore (all |any )?(previous|prior|above) instructions",
    r"(?i)disregard (all |any )?(previous|prior|above) instructions",
]
REFERENCE = r"\b([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)+|[a-z]+_[a-z_]+|[a-zA-Z][a-zA-Z0-9_]*\.py)\b"
REDACTED = "[REDACTED]"


def tokens(text: Column) -> Column:
    """Identifier-aware tokens: split at non-alphanumerics, underscores and lower-to-upper boundaries; lower-cased; at least
    two characters. Duplicates stay. ASCII only, so accents split."""
    split = F.split(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+")
    return F.filter(F.transform(split, lambda t: F.lower(t)), lambda t: F.length(t) >= 2)


def document_text(name: Column, qualified_name: Column, signature: Column, docstring: Column, decorators: Column) -> Column:
    """What the lexical index reads of a symbol; an empty docstring counts as absent."""
    return F.concat_ws(" ", name, qualified_name, signature, F.nullif(docstring, F.lit("")), F.when(F.size(decorators) > 0, F.array_join(decorators, " ")))


def embedding_text(qualified_name: Column, signature: Column, docstring: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(F.nullif(docstring, F.lit("")), qualified_name), signature)


def significant_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1), lambda w: F.length(w) >= 3)


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a word in lower-cased text."""
    low = F.lower(text)
    return F.when(F.length(word) > 0, ((F.length(low) - F.length(F.replace(low, word, F.lit("")))) / F.length(word)).cast("long")).otherwise(0)


def token_estimate(text: Column, factor: float = 1.1) -> Column:
    """Tokens of a text, by pieces of words, digits and symbols, with a margin. A stand-in where no tokenizer is injected."""
    pieces = F.size(F.regexp_extract_all(text, F.lit(r"([A-Za-z]{1,8}|[0-9]{1,3}|[^\sA-Za-z0-9])"), 1))
    return F.when(text.isNull() | (F.length(text) == 0), 0).otherwise(F.ceil(pieces * F.lit(factor))).cast("long")


def counted_by(count: Callable[[str], int], factor: float = 1.1) -> Callable[[Column], Column]:
    """What ``token_estimate`` does, by a tokenizer that is handed in: ``count`` gives the tokens of a text."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: math.ceil(count(t) * factor) if t else 0)

    return run


def discovery_text(signature: Column, docstring: Column) -> Column:
    return F.concat_ws("\n", signature, F.nullif(F.split(docstring, "\n")[0], F.lit("")))


def env_names(text: Column) -> Column:
    """Variable names of an env file: the text before the first '=' of lines that aren't blank or comments."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    named = F.filter(lines, lambda x: (F.length(x) > 0) & ~x.startswith("#") & x.contains("="))
    return F.transform(named, lambda x: F.trim(F.substring_index(x, "=", 1)))


def migrated_columns(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"""Column\(\s*['"](\w+)"""), 1)


def redact(text: Column, patterns: list[str] | None = None) -> Column:
    out = text
    for p in INJECTION_PATTERNS if patterns is None else patterns:
        out = F.regexp_replace(out, p, REDACTED)
    return out


def intent(query: Column) -> Column:
    """debug, feature, refactor or general, by the first list with a substring of the query."""
    low, out = F.lower(query), F.lit("general")
    for name, words in reversed(INTENTS.items()):
        out = F.when(low.rlike("|".join(map(re.escape, words))), name).otherwise(out)
    return out


def symbol_reference(query: Column) -> Column:
    """The first dotted name, snake_case name or Python file in a query; null without one."""
    return F.nullif(F.regexp_extract(query, REFERENCE, 1), F.lit(""))


def starting_level(query: Column) -> Column:
    return F.when((intent(query) == "general") & symbol_reference(query).isNull(), "L0_L1").otherwise("L3_L4")


def glob_to_regex(pattern: str) -> str:
    """A whole-string regular expression that Java accepts; '*' crosses '/'."""
    return "^" + fnmatch.translate(pattern).replace("(?s:", "(?s)(?:").replace(r"\Z", "$").replace(r"\z", "$").replace("(?>", "(?:")


# Directories that are never read, at any depth.
IGNORED_DIRECTORIES = ("__pycache__", ".venv", "venv", "node_modules", "dist", "build", ".git")


def is_ignored(path: Column, patterns: list[str]) -> Column:
    parts, out = F.split(path, "/"), F.lit(False)
    out = out | F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED_DIRECTORIES)))
    for p in patterns:
        p = p.rstrip("/")
        each = glob_to_regex(p)
        out = out | F.exists(parts, lambda s, r=each: s.rlike(r)) | path.rlike(each) | path.rlike(glob_to_regex(f"{p}/*"))
    return out


def is_test_file(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return name.startswith("test_") | name.endswith("_test.py")


def module_of(path: Column) -> Column:
    return F.split(path, "/")[0]


ROUTE = r"(?U)^\w+\.(get|post|put|delete|patch|options|head)\("


def is_route(decorators: Column) -> Column:
    return F.coalesce(F.exists(decorators, lambda d: d.rlike(ROUTE)), F.lit(False))


def route_method(decorators: Column) -> Column:
    return F.nullif(F.regexp_extract(F.filter(decorators, lambda d: d.rlike(ROUTE))[0], ROUTE, 1), F.lit(""))


def route_status(decorators: Column) -> Column:
    found = F.regexp_extract(F.filter(decorators, lambda d: d.rlike(ROUTE))[0], r"status_code\s*=\s*(\d+)", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("int"), F.lit(200))


def response_model(decorators: Column, signature: Column) -> Column:
    named = F.regexp_extract(F.filter(decorators, lambda d: d.rlike(ROUTE))[0], r"response_model\s*=\s*(\w+)", 1)
    returned = F.regexp_extract(signature, r"->\s*([\w\[\], .]+?)\s*:?\s*$", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(returned, F.lit("")))


def docstring_style(docstring: Column) -> Column:
    google, numpy = r"(?m)^\s*(Args|Returns|Raises):", r"(?m)^\s*Parameters\s*\n\s*-{3,}"
    at = lambda p: F.regexp_instr(docstring, F.lit(f"({p})"))
    return F.when((at(google) > 0) & ((at(numpy) == 0) | (at(google) <= at(numpy))), "google").when(at(numpy) > 0, "numpy").when(F.length(docstring) > 0, "plain")


def hunk_overlaps(old_start: Column, old_count: Column, line_start: Column, line_end: Column) -> Column:
    """Changed lines touch the symbol; a pure insertion must fall before its last line."""
    inserted = (line_start <= old_start) & (old_start < line_end)
    return F.when(old_count == 0, inserted).otherwise((old_start <= line_end) & (old_start + old_count - 1 >= line_start))


def containment(a1: Column, e1: Column, a2: Column, e2: Column) -> Column:
    """Share of the lines a2..e2 that a1..e1 covers."""
    length = e2 - a2 + 1
    return F.when(length > 0, F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(a1, a2) + 1) / length).otherwise(0.0)


def packed_chunks(costs: Column, limit: int) -> Column:
    """Chunk number (from 0) of each line: a line that would overflow the chunk begins a new one; an oversized line stands alone."""
    start = F.struct(F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("out"))

    def step(s, c):
        full = (s["used"] > 0) & (s["used"] + c > limit)
        chunk = F.when(full, s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(full, c).otherwise(s["used"] + c).cast("long").alias("used"), F.concat(s["out"], F.array(chunk)).alias("out"))

    return F.aggregate(costs, start, step, lambda s: s["out"])
