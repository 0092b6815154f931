"""Calls of tools as rows of the retrieval log: what was asked and served, how long it took, what went wrong."""

from __future__ import annotations

import contextvars
import functools
import json
import time
import uuid
from collections import Counter
from collections.abc import Callable
from typing import Any

from pyspark.sql import Row, SparkSession

from tessera.sources import logs

#: Fixed names of arguments that hold what was asked, in the order in which they are looked for.
ASKED = ("query", "path_or_glob", "symbol_id")
_rerank_ms: contextvars.ContextVar[float | None] = contextvars.ContextVar("rerank_ms", default=None)


def note_rerank(ms: float) -> None:
    """Called by a re-ranker within a call, which then carries its time."""
    _rerank_ms.set(ms)


def _plain(x: Any) -> Any:
    return x.asDict(recursive=True) if isinstance(x, Row) else x


def entries(served: Any) -> list[dict]:
    """symbol_id, score and value of each row served; what isn't a row counts as a value."""
    items = [] if served is None else served if isinstance(served, list) else [served]
    known = lambda x: isinstance(x, dict) and ("id" in x or "symbol_id" in x)
    row = lambda x: {"symbol_id": x.get("symbol_id", x.get("id")), "score": x.get("score"), "value": None} if known(x) else {"symbol_id": None, "score": None, "value": str(x)}
    return [row(_plain(x)) for x in items]


def size_bytes(served: Any) -> int:
    """Bytes of what was served as JSON; a list counts its items."""
    if served is None:
        return 0
    if isinstance(served, list):
        return sum(map(size_bytes, served))
    return len(json.dumps(_plain(served), default=str).encode())


class CallLog:
    """Collects the calls of one process; ``flush`` appends them to the log. Tools return what they serve (rows, a dict, a text
    or None), so a call costs no second run of its query."""

    def __init__(self, clock: Callable[[], float] = time.time):
        self.clock, self.rows, self.turns = clock, [], Counter()

    def tool(self, name: str, fn: Callable) -> Callable:
        """``fn`` with a session as its first argument; every call leaves a row, also one that raises."""

        @functools.wraps(fn)
        def call(session: str, *args, **kwargs):
            turn, began, wrong, served = self.turns[session], time.perf_counter(), None, None
            self.turns[session] += 1
            mark = _rerank_ms.set(None)
            try:
                served = fn(*args, **kwargs)
                return served
            except Exception as e:
                wrong = type(e).__name__
                raise
            finally:
                ms, rerank = (time.perf_counter() - began) * 1000, _rerank_ms.get()
                _rerank_ms.reset(mark)
                asked = next((kwargs[k] for k in ASKED if kwargs.get(k)), None)
                items = entries(served)
                self.rows.append((uuid.uuid4().hex, self.clock(), session, turn, name, asked, None, items, items, ms, size_bytes(served), wrong, None, rerank))

        return call

    def flush(self, spark: SparkSession, path: str) -> int:
        """Appends what was collected, by session, and forgets it once that is written."""
        if rows := list(self.rows):
            logs.append(spark.createDataFrame(rows, logs.RETRIEVAL), path, "session_id")
            del self.rows[: len(rows)]
        return len(rows)
