"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

Documents are streamed through the automaton word by word, which tracks the longest suffix read that occurs in an item.
Where that length reaches the window (13 words) the words it covers are hit; items shorter than the window hit where they
occur whole. Texts lose A-Z case and are cut into words of digits, ASCII letters and non-ASCII characters.

The automaton is built on the driver from items of at most ``WORDS_PER_PASS`` words together and broadcast; more items
are dealt to several automata, which a task holds one after the other, each over all documents in a pass of its own.

Null and empty texts have no words: nothing is hit. Texts of any length are streamed whole, a word at a time. An item without words occurs nowhere; null item ids occur as the
empty string. Repeated items (equal ids) count once. Repeated rows of documents are judged alike. Other columns of either
table are not read. No items: nothing is hit.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name

WINDOW = 13
#: Words of the items of an automaton: 60 bytes each, and the vocabulary, on the driver and in each worker.
WORDS_PER_PASS = 500_000

#: Bytes that separate words become spaces, A-Z lose case; UTF-8 bytes of other characters stay.
_FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Of many word sequences, in flat arrays: some 60 bytes for each word of the items, beside the vocabulary.

    A state's first move is (word, to); further ones, which few states have, are in ``more``. ``mark[v]``: the first of the
    triples (length, item, next) of the items whose window, or whole short text, belongs to state v."""

    def __init__(self, sequences: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.word, self.to, self.link, self.length = array("i", [-1]), array("i", [-1]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.names: list[str] = []
        kept = []
        for item, words in sequences:
            if words:
                ids = array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
                last = 0
                for w in ids:
                    last = self._extend(last, w)
                kept.append(ids)
                self.names.append(item)
        self._mark(kept)

    def move(self, v: int, w: int) -> int:
        """The state that w leads to from v, or -1."""
        if self.word[v] == w:
            return self.to[v]
        return self.more[v].get(w, -1) if v in self.more else -1

    def _put(self, v: int, w: int, to: int) -> None:
        if self.word[v] in (-1, w):
            self.word[v], self.to[v] = w, to
        else:
            self.more.setdefault(v, {})[w] = to

    def _new(self, length: int, like: int, link: int) -> int:
        """A state with the moves of ``like``, or none if that is -1."""
        new = len(self.length)
        self.word.append(-1 if like < 0 else self.word[like])
        self.to.append(-1 if like < 0 else self.to[like])
        if like in self.more:
            self.more[new] = dict(self.more[like])
        self.length.append(length)
        self.link.append(link)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for the strings that reach q from p and its suffixes."""
        clone = self._new(self.length[p] + 1, q, self.link[q])
        self.link[q] = clone
        while p >= 0 and self.move(p, w) == q:
            self._put(p, w, clone)
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if (q := self.move(last, w)) >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.length[last] + 1, -1, 0), last
        while p >= 0 and self.move(p, w) < 0:
            self._put(p, w, new)
            p = self.link[p]
        if p >= 0:
            q = self.move(p, w)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _mark(self, kept: list[array]) -> None:
        """Each state then points to the nearest marked state on its chain of suffixes."""
        self.mark = array("i", [-1]) * len(self.length)
        self.need, self.item, self.following = array("i"), array("i"), array("i")
        for number, ids in enumerate(kept):
            state, length, need = 0, 0, min(self.window, len(ids))
            for w in ids:
                state, length = self.move(state, w), min(length + 1, need)
                while state and self.length[self.link[state]] >= length:
                    state = self.link[state]
                if length == need and (self.mark[state] < 0 or self.item[self.mark[state]] != number or self.need[self.mark[state]] != need):
                    self.need.append(need)
                    self.item.append(number)
                    self.following.append(self.mark[state])
                    self.mark[state] = len(self.need) - 1
        self.marked = array("i", [-1]) * len(self.length)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.marked[v] = v if self.mark[v] >= 0 else self.marked[self.link[v]]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (first word, one past the last; disjoint, ascending) and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        word, to, more, link, lengths, marked, window = self.word, self.to, self.more, self.link, self.length, self.marked, self.window
        state = length = 0
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                state = length = 0
                continue
            while True:
                step = to[state] if word[state] == w else more[state].get(w, -1) if state in more else -1
                if step >= 0 or not state:
                    break
                state = link[state]
                length = lengths[state]
            if step < 0:
                continue
            state, length = step, length + 1
            v, reach = marked[state], 0
            while v > 0:
                at = self.mark[v]
                while at >= 0:
                    if (need := self.need[at]) <= length:
                        items.add(self.item[at])
                        reach = max(reach, length if need == window else need)
                    at = self.following[at]
                v = marked[link[v]]
            if reach:
                a = i + 1 - reach
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        return spans, {self.names[k] for k in items}


def automata(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> Iterator[SuffixAutomaton]:
    """One for each ``WORDS_PER_PASS`` words of items, read in a stream."""
    group, n = [], 0
    for row in benchmark.select(benchmark[id_col].cast("string"), benchmark[text_col]).toLocalIterator():
        words = words_of(row[1].encode()) if row[1] is not None else []
        if n and n + len(words) > WORDS_PER_PASS:
            yield SuffixAutomaton(group, window)
            group, n = [], 0
        group.append((row[0] or "", words))
        n += len(words)
    yield SuffixAutomaton(group, window)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = {"n_words": "long", "begins": "array<int>", "ends": "array<int>", "items": "array<string>"}


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", carry: list[str], keep_text: bool = True, cut: bool = False, window: int = WINDOW) -> DataFrame:
    """``carry`` columns (and the text) of each document with n_words, the hit word spans (begins, ends) and the ids of the
    items; these are underscored where ``carry`` has such a name. ``cut``: the text comes back without the words of the spans."""
    spark = docs.sparkSession
    types = dict(docs.dtypes)
    named = [free_name([*carry, text_col], n) for n in FOUND]
    out = docs.select(*[F.col(f"`{c}`") for c in (*carry, text_col)])
    first, passes = True, automata(benchmark, item_col, item_text, window)
    automaton = next(passes)
    while automaton is not None:
        shared, automaton = spark.sparkContext.broadcast(automaton), next(passes, None)
        n_out, last = len(carry) + (keep_text or automaton is not None), automaton is None

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, n_carry=len(carry), n_out=n_out, last=last) -> Iterator[pa.RecordBatch]:
            sam = shared.value
            for b in batches:
                texts = b.column(n_carry).cast(pa.binary()).to_pylist()
                before = [[]] * len(texts) if first else [list(zip(x, y, strict=True)) for x, y in zip(b.column(n_carry + 2).to_pylist(), b.column(n_carry + 3).to_pylist(), strict=True)]
                known = [[]] * len(texts) if first else b.column(n_carry + 4).to_pylist()
                counts, begins, ends, items = [], [], [], []
                for t, old, ids in zip(texts, before, known, strict=True):
                    words = words_of(t)
                    spans, found = sam.scan(words)
                    spans = _merged(spans + old) if old else spans
                    counts.append(len(words))
                    begins.append([a for a, _ in spans])
                    ends.append([e for _, e in spans])
                    items.append(sorted(found.union(ids)))
                kept = [b.column(k) for k in range(n_out)]
                if cut and last and n_out > n_carry:
                    kept[n_carry] = pa.array([cut_text(t, x, y) if x else t for t, x, y in zip(texts, begins, ends, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=[*b.schema.names[:n_out], *named])

        schema = ", ".join(f"`{c}` {types[c]}" for c in [*carry, text_col][:n_out])
        found = ", ".join(f"`{n}` {kind}" for n, kind in zip(named, FOUND.values(), strict=True))
        out = out.mapInArrow(run, f"{schema}, {found}")
        first = False
    return out


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def cut_text(raw: bytes, begins: list[int], ends: list[int]) -> bytes:
    """The text without the words of the spans; what separates kept words stays."""
    out, k, at = [], 0, 0
    folded = raw.translate(_FOLD)
    place, n, kept_from = 0, len(raw), 0
    for a, b in zip(begins, ends, strict=True):
        # Walk on to word a, then to the end of word b - 1.
        start = None
        while at < b:
            while place < n and folded[place] == 0x20:
                place += 1
            if at == a:
                start = place
            stop = folded.find(b" ", place)
            place = n if stop < 0 else stop
            at += 1
        out.append(raw[kept_from:start])
        kept_from = place
        k += 1
    out.append(raw[kept_from:])
    return b"".join(out)
