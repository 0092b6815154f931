"""Suffix-array dedup: removes every byte covered by a 50-byte string that also starts in a document with a smaller id.

1. Every 50-byte window is owned by one of its 16-byte grams (winnowing), so equal windows are owned by equal grams at the
   same place in them. Per batch of documents, occurrences of a gram whose owned windows equal those of an earlier
   document of the batch are removed at once; the rest goes, packed, to the shard of its gram's hash.
2. A shard compares the owned windows of equal grams by hash. Where all are equal, all but the earliest document's are
   removed. Where several kinds meet, one occurrence of each kind is asked for its bytes.
3. The bytes asked for meet again by gram and are put in order by external induced sorting (``induced_sort``); the common
   prefixes that its queues carry tell which 50-byte strings are equal; each is removed in all documents but the earliest.

Winnowing deals suffixes to shards and merges equal contexts, so that copies are sorted once; what differs is sorted. Kinds
are told apart by 48 bits of the gram's hash and 64 of the context's, texts of one id by 64 bits of their own hash. Steps 1
and 2 hold a batch or a shard of packed hashes, whose number grows with the bytes of the input; step 3 keeps text, origins,
names and queues in files, so a gram of any number of bytes is sorted in bounded memory.

Texts are UTF-8 bytes; null is empty. Texts shorter than 50 bytes lose nothing. Matches never cross documents, nor do they
count within one. Rows with null ids neither lose bytes nor count as earlier. Rows with equal ids don't count as earlier
than each other, and repeated rows lose the same bytes. What is left may not be valid UTF-8 where a match begins or ends
inside a character; it is kept as bytes. Very long texts are read in pieces that
overlap. Extra columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LISTED, checkpointed
from tessera.llm.induced_sort import MEMORY, repeats
from tessera.llm.winnow_bytes import GRAM, WINDOW, owned_windows

#: Bytes of input for each shard of step 2; bytes asked for in each shard of step 3.
SHARD_BYTES, SORT_BYTES = 8 << 20, 3 << 20
SPANS = "kind int, doc long, tag long, a long, e long, fp long"


def _merged(doc: np.ndarray, tag: np.ndarray, a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching spans of each (doc, tag) as one."""
    if not len(doc):
        return doc, tag, a, e
    order = np.lexsort((a, tag, doc))
    doc, tag, a, e = doc[order], tag[order], a[order], e[order]
    group = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]) - 1
    shift = group * (int(e.max()) + 2)  # so that a running maximum never reaches into the next group
    reach = np.maximum.accumulate(e + shift)
    first = np.flatnonzero(np.r_[True, (a + shift)[1:] > reach[:-1]])
    return doc[first], tag[first], a[first], (reach - shift)[np.r_[first[1:] - 1, len(doc) - 1]]


def _pack(columns: list[np.ndarray]) -> bytes:
    """Arrays of one length, byte by byte of equal weight, compressed."""
    head = np.array([len(columns[0])], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns))


def _unpack(blob: bytes, count: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    return [np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 + 8 * n * k).reshape(8, n).T).reshape(-1).view(np.int64) for k in range(count)]


def _starts(*keys: np.ndarray) -> np.ndarray:
    return np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])] if len(keys[0]) else np.zeros(0, bool)


def _later(classes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sorted by class, then doc: is the document later than the first of its class?"""
    first = np.maximum.accumulate(np.where(classes, np.arange(len(doc)), 0))
    return doc > doc[first]


def _fingerprint_pass(shards: int, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for doc, raw, tag in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                fp, context, first, last = owned_windows(raw, window, gram)
                if len(fp):
                    # A quarter of the gram's hash is dropped, which packs smaller; all 64 bits of the context tell kinds apart.
                    parts.append((fp >> np.uint64(16), context, np.full(len(fp), doc), np.full(len(fp), tag), first, last - first))
            if not parts:
                continue
            fp, context, doc, tag, first, more = (np.concatenate(x).astype(np.int64) if i != 1 else np.concatenate(x).view(np.int64) for i, x in enumerate(zip(*parts, strict=True)))
            order = np.lexsort((doc, context, fp))
            fp, context, doc, tag, first, more = (x[order] for x in (fp, context, doc, tag, first, more))
            gone = _later(_starts(fp, context), doc)
            buckets, blobs = [], []
            if gone.any():
                spans = _merged(doc[gone], tag[gone], first[gone], first[gone] + more[gone] + window)
                buckets.append(int(doc[gone][0]) % shards)
                blobs.append(b"g" + _pack(list(spans)))
            fp, context, doc, tag, first, more = (x[~gone] for x in (fp, context, doc, tag, first, more))
            at = fp % shards
            order = np.argsort(at, kind="stable")  # hashes stay ascending within a shard
            cuts = np.searchsorted(at[order], np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                mine = order[cuts[k] : cuts[k + 1]]
                buckets.append(k)
                blobs.append(b"f" + _pack([np.diff(fp[mine], prepend=0), context[mine], doc[mine], tag[mine], first[mine], more[mine]]))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])

    return run


def _rows(kind: int, doc, tag, a, e, fp) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(doc), pa.array(tag), pa.array(a), pa.array(e), pa.array(fp)], names=["kind", "doc", "tag", "a", "e", "fp"])


def _match_pass(window: int):
    """Of each shard: spans to remove (kind 0) and spans whose bytes are asked for (kind 1)."""

    def settle(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns = [_unpack(x, 6) for x in blobs]
        fp, context, doc, tag, first, more = (np.concatenate(x) for x in zip(*((np.cumsum(c[0]), *c[1:]) for c in columns), strict=True))
        order = np.lexsort((doc, context, fp))
        fp, context, doc, tag, first, more = (x[order] for x in (fp, context, doc, tag, first, more))
        end = first + more + window
        classes, grams = _starts(fp, context), _starts(fp)
        gone = _later(classes, doc)
        spans = _merged(doc[gone], tag[gone], first[gone], end[gone])
        yield _rows(0, *spans, np.zeros(len(spans[0]), np.int64))
        group, begin = np.cumsum(grams) - 1, np.flatnonzero(grams)
        several = (np.add.reduceat(classes.astype(np.int64), begin) > 1) & (np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin))
        ask = several[group] & ~gone
        yield _rows(1, doc[ask], tag[ask], first[ask], end[ask], fp[ask])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            for shard, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if shard != at and held:
                    yield from settle(held)
                    held = []
                at = shard
                if blob[:1] == b"g":
                    spans = _unpack(blob[1:], 4)
                    yield _rows(0, *spans, np.zeros(len(spans[0]), np.int64))
                else:
                    held.append(blob[1:])
        if held:
            yield from settle(held)

    return run


def _cut_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the spans asked for, where there are any."""
    for b in batches:
        docs, tags, fps, starts, parts = [], [], [], [], []
        b = b.filter(b.column(3).is_valid())
        for doc, tag, raw, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
            for s in spans:
                docs.append(doc)
                tags.append(tag)
                fps.append(s["fp"])
                starts.append(s["a"])
                parts.append(raw[s["a"] : s["e"]])
        yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(docs, pa.int64()), pa.array(tags, pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())], names=["fp", "doc", "tag", "a", "part"])


class _Parts:
    """Byte strings end to end with separators in one temporary file, and where each comes from in another."""

    def __init__(self):
        self.text, self.origin, self.size, self.count = tempfile.TemporaryFile(), tempfile.TemporaryFile(), 0, 0

    def add(self, docs: list[int], tags: list[int], starts: list[int], parts: list[bytes]) -> None:
        if not parts:
            return
        sizes = np.array([len(p) + 1 for p in parts])
        text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
        text[np.cumsum(sizes) - 1] = 0
        begin = self.size + np.cumsum(sizes) - sizes
        self.text.write(text.tobytes())
        self.origin.write(np.stack([begin, np.array(docs), np.array(tags), np.array(starts) - begin], axis=1).astype(np.int64).tobytes())
        self.size, self.count = self.size + int(sizes.sum()), self.count + len(parts)

    def repeated(self, window: int, memory: int) -> Iterator[pa.RecordBatch]:
        """Spans of the strings of ``window`` bytes that occur in a document with a smaller id."""
        self.text.flush()
        self.origin.flush()
        text = np.memmap(self.text, np.uint16, "r", shape=(self.size,))
        origin = np.memmap(self.origin, np.int64, "r", shape=(self.count, 4))
        begin, held, size = np.ascontiguousarray(origin[:, 0]), [], 0
        for places, begins in repeats(text, window, memory):
            of = origin[np.searchsorted(begin, places, "right") - 1]
            least = np.repeat(np.minimum.reduceat(of[:, 1], begins), np.diff(np.r_[begins, len(places)]))
            later = of[:, 1] > least
            if later.any():
                a = places[later] + of[later, 3]
                held.append((of[later, 1], of[later, 2], a, a + window))
                size += len(a)
            if size >= 1 << 20:  # spans may overlap others, so they can go in pieces
                yield self._rows(held)
                held, size = [], 0
        yield self._rows(held)

    @staticmethod
    def _rows(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        spans = _merged(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else [np.zeros(0, np.int64)] * 4
        return _rows(0, *spans, np.zeros(len(spans[0]), np.int64))


def _sort_pass(window: int, shard_bytes: int, memory: int):
    """Rows come by gram; whole grams are gathered in files up to ``shard_bytes`` or more and sorted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, last = _Parts(), None
        for b in batches:
            fps = b.column(0).to_pylist()
            columns = [b.column(k).to_pylist() for k in range(1, 5)]
            cuts = [0, *(i for i in range(1, len(fps)) if fps[i] != fps[i - 1]), len(fps)]
            done, sizes = 0, [len(p) + 1 for p in columns[3]]
            ahead = 0
            for a, e in zip(cuts, cuts[1:], strict=False):
                if fps[a] != last and parts.size + ahead >= shard_bytes:
                    parts.add(*(x[done:a] for x in columns))
                    yield from parts.repeated(window, memory)
                    parts, done, ahead = _Parts(), a, 0
                last = fps[a] if e > a else last
                ahead += sum(sizes[a:e])
            parts.add(*(x[done:] for x in columns))
        if parts.size:
            yield from parts.repeated(window, memory)

    return run


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tag, text) of every row; two joins read it, with one exchange if the plans agree. ``tag`` tells the texts of
    one id apart by 64 bits; it is 0, which packs to nothing, for ids of one text. Ids of several texts are listed if they are
    few (a broadcast of at most ``LISTED`` ids); else every text has its tag."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))
    several = checkpointed(rows.where("doc is not null").groupBy("doc").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).where("lo <> hi").select("doc"))
    if (n := several.count()) > LISTED:
        return rows
    if not n:
        return rows.withColumn("tag", F.lit(0).cast("long"))
    told = rows.join(F.broadcast(several.withColumn("told", F.lit(True))), "doc", "left")
    return told.select("doc", F.when(F.col("told"), F.col("tag")).otherwise(0).alias("tag"), "text")


def repeated_spans(dealt: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, tag, spans): what to remove of each text of ``_dealt``; spans may overlap."""
    usable = dealt.where(F.col("doc").isNotNull() & (F.octet_length("text") >= window)).select("doc", "text", "tag")
    size = usable.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    packed = usable.mapInArrow(_fingerprint_pass(shards, window, gram), "shard int, blob binary")
    found = checkpointed(packed.repartition("shard").sortWithinPartitions("shard").mapInArrow(_match_pass(window), SPANS))
    asked = found.where("kind = 1").groupBy("doc", "tag").agg(F.collect_list(F.struct("a", "e", "fp")).alias("spans"))
    # An outer join, as in without_repeats: texts are then dealt once for both joins.
    parts = dealt.join(asked, ["doc", "tag"], "left").select("doc", "tag", "text", "spans").mapInArrow(_cut_pass, "fp long, doc long, tag long, a long, part binary")
    settled = parts.repartition("fp").sortWithinPartitions("fp").mapInArrow(_sort_pass(window, SORT_BYTES, MEMORY), SPANS)
    spans = found.where("kind = 0").unionByName(settled)
    return spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("a", "e")).alias("spans"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, keep_bytes: bool = True) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 of every row, and the remaining bytes as ``kept``."""
    dealt = _dealt(docs, id_col, text_col)
    joined = dealt.join(repeated_spans(dealt, window=window, gram=gram), ["doc", "tag"], "left").select("doc", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, spans in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw, runs, removed = raw or b"", 0, 0
                kept, at = [], 0
                for a, e in sorted((s["a"], s["e"]) for s in spans or ()):
                    if a > at or not runs:
                        kept.append(raw[at:a])
                        runs += 1
                        removed += e - a
                        at = e
                    elif e > at:
                        removed += e - at
                        at = e
                rest = b"".join([*kept, raw[at:]])
                out.append((len(raw), removed, runs, hashlib.sha256(rest).hexdigest(), rest if keep_bytes else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(cut, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
