"""Exact removal of repeated byte strings with a sparse suffix array.

A string of LENGTH bytes is a *window*. Texts are cut into tokens by content: the anchor of a window is the place of
its least 8-byte hash, which depends on the window's bytes alone, so equal windows have their anchors at equal places.
Suffixes that start at anchors are therefore enough to find every repeated window:

1. The CONTEXT bytes from an anchor lie in each of its windows. Anchors whose context occurs once in the corpus have no
   repeated window. A bounded bitmap of the repeated contexts goes to the executors; a false hit costs work only.
2. Neighbouring anchors that are left form runs, which their own bytes cut into *chunks* of some CHUNK anchors. Equal chunks
   go on as one row with a count, so a passage that very many documents share is one row from here on. All windows of
   a chunk that occurs twice are repeated.
3. The *span* of an anchor is the bytes that its windows cover; equal spans, with equal cuts, form one class, which counts as
   often as the chunks that hold it. Classes are sorted as suffixes: sampled splitters range-partition them by their leading
   bytes, each bucket is sorted by multikey quicksort, and neighbours that share CONTEXT bytes form a group, in which the
   windows are compared. Splitters compare contexts, so a group never crosses a bucket; a group that is too large for a
   bucket is cut into ever smaller cells of windows instead, and the cells are counted across all buckets.
4. Repeated windows become intervals of their chunks, and these of their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm._common import lean, sliced, table, written

LENGTH = 200
#: Windows that share an anchor at most, and the bytes from the anchor that all of them hold.
REACH = 93
GRAM = 8
#: Classes of one context that a bucket sorts; larger groups are cut into cells.
GROUP = 200
#: Classes of a bucket.
BUCKET = 16_384
#: Classes of a bucket that are compared at once.
BLOCK = 2_048
#: Bits of a bitmap at most (16 MB).
BITS = 1 << 27
#: Bytes that are anchored at once: longer texts in overlapping segments, shorter ones side by side.
SEGMENT = 1 << 18
#: A chunk ends after an anchor whose hash says so, one in CHUNK, from LEAST anchors on; and after MOST.
CHUNK, LEAST, MOST = 16, 8, 256

_LOW = np.uint64((1 << 24) - 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x9FB21C651E98DF25


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


class _Powers:
    """Powers of the base of the rolling hash, and of its inverse, as far as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(2 * n, np.uint64(base))
                p[0] = 1
                setattr(cls, name, np.cumprod(p, dtype=np.uint64))
        return cls.up, cls.down


def _least(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n = len(a) - w + 1
    m = np.concatenate([a, np.full(-len(a) % w, ~np.uint64(0))]).reshape(-1, w)
    before = np.minimum.accumulate(m, axis=1).ravel()
    after = np.minimum.accumulate(m[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


class Anchored:
    """Anchors of parts of texts, each of `length` bytes or more: of (number of the part), at (place in it), lo and hi (first and
    last window start), key (context hash), span (span hash)."""

    def __init__(self, parts: list[bytes], length: int, reach: int, spans: bool = True):
        text, sizes = b"".join(parts), np.array([len(p) for p in parts])
        grams = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), GRAM).copy().view("<u8").ravel()
        v = _mix(grams)
        n = len(text) - length + 1
        place = (_least((v[: n + reach - 1] & ~_LOW) | np.arange(n + reach - 1, dtype=np.uint64), reach) & _LOW).astype(np.int64)
        stops = np.cumsum(sizes)
        own = np.repeat(np.arange(len(parts)), sizes)[:n]
        whole = np.flatnonzero(np.arange(length, n + length) <= stops[own])  # windows that don't cross into the next part
        own, place = own[whole], place[whole]
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (own[1:] != own[:-1])]))
        self.of, at, lo, hi = own[first], place[first], whole[first], whole[np.append(first[1:], len(whole)) - 1]
        up, down = _Powers.of(len(v) + 1)
        self._down = down
        self._sums = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v * up[: len(v)], out=self._sums[1:])
        self.key = _mix(self._hash(at, at + length - reach + 1)).view(np.int64)
        if spans:
            cut = (at - lo).astype(np.uint64) * _M2 + (hi - lo).astype(np.uint64)
            self.span = _mix(_mix(self._hash(lo, hi + length)) + cut).view(np.int64)
        base = (stops - sizes)[self.of]
        self.at, self.lo, self.hi = at - base, lo - base, hi - base

    def _hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self._sums[stop - GRAM + 1] - self._sums[start]) * self._down[start]


def _packs(rows: Iterator[tuple], length: int) -> Iterator[list[tuple]]:
    """rows (..., text) -> lists of (..., start, segment): every window of a text lies in exactly one segment."""
    held, size = [], 0
    for *own, text in rows:
        for start in range(0, len(text) - length + 1, SEGMENT):
            part = text[start : start + SEGMENT + length - 1]
            held.append((*own, start, part))
            size += len(part)
            if size >= SEGMENT:
                yield held
                held, size = [], 0
    if held:
        yield held


def _cut_runs(known: np.ndarray, of: np.ndarray, span: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) anchor of each chunk: runs of known neighbours in one part, cut after anchors that their hash marks."""
    ends = np.ones(len(known), bool)
    ends[:-1] = (known[1:] != known[:-1] + 1) | (of[known[1:]] != of[known[:-1]])
    marked = ((span[known] >> 7) & (CHUNK - 1)) == 0
    begin = 0
    for i in np.flatnonzero(ends | marked).tolist():
        while i - begin >= MOST:
            yield int(known[begin]), int(known[begin + MOST - 1])
            begin += MOST
        if ends[i] or i - begin + 1 >= LEAST:
            yield int(known[begin]), int(known[i])
            begin = i + 1


def _batches(columns: list[tuple[str, pa.DataType]], rows: Iterator[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(columns, held)
            held = []
    if held:
        yield _batch(columns, held)


def _batch(columns: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), columns)], names=[n for n, _ in columns])


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (key.view(np.uint64) >> np.uint64(5)) & np.uint64(bits - 1)


def multikey_sort(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order, equal leading bytes of each suffix and the one before it, rounded down to 8) by multikey quicksort.

    The characters are big-endian words of 8 bytes: a range of suffixes that agree in their first words is split three
    ways at a pivot of the next word, and the middle part moves on to the word after it. Shorter suffixes are padded.
    """
    width = -(-max(map(len, suffixes), default=1) // 8) or 1
    words = np.frombuffer(b"".join(s.ljust(8 * width, b"\0") for s in suffixes), ">u8").reshape(-1, width).astype(np.uint64)
    order, shared = np.arange(len(words)), np.zeros(len(words), np.int64)
    todo = [(0, len(words), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == width:
            shared[lo + 1 : hi] = 8 * depth
            continue
        own = order[lo:hi]
        w = words[own, depth]
        pivot = np.partition(w, len(w) // 2)[len(w) // 2] if len(w) > 64 else None
        if pivot is None:  # a short range is sorted by its word at once; equal words go on
            by = np.argsort(w, kind="stable")
            order[lo:hi], w = own[by], w[by]
            cuts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1], [True]]))
            shared[lo + cuts[1:-1]] = 8 * depth
            todo += [(lo + a, lo + b, depth + 1) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
            continue
        parts = [own[w < pivot], own[w == pivot], own[w > pivot]]
        order[lo:hi] = np.concatenate(parts)
        a, b = lo + len(parts[0]), hi - len(parts[2])
        shared[[x for x in (a, b) if lo < x < hi]] = 8 * depth
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order, shared


def _bucket(rows: list[tuple[bytes, int, int, int, int]], length: int, reach: int) -> Iterator[tuple[int, int, int, int]]:
    """rows (span bytes, place of the anchor in it, key, span hash, count of the class): (key, span, first, last) of the repeated
    windows of each class that occurs once; first and last are offsets of window starts from the anchor."""
    order, shared = multikey_sort([x[a:] for x, a, *_ in rows])
    context = (length - reach + 1) // 8 * 8
    begins = np.flatnonzero(np.concatenate([[True], shared[1:] < context]))
    lo = 0
    for at in [*begins[1:].tolist(), len(rows)]:  # whole groups, some BLOCK rows at once
        if at - lo >= BLOCK or at == len(rows):
            yield from _compared([rows[i] for i in order[lo:at]], np.searchsorted(begins, np.arange(lo, at), side="right").astype(np.uint64), length, reach)
            lo = at


def _compared(rows: list[tuple[bytes, int, int, int, int]], group: np.ndarray, length: int, reach: int) -> Iterator[tuple[int, int, int, int]]:
    left = reach - 1
    wide = left + length
    flat = np.zeros((len(rows), wide), np.uint8)
    for i, (x, a, *_) in enumerate(rows):  # all spans side by side, their anchors at the same column
        flat[i, left - a : left - a + len(x)] = np.frombuffer(x, np.uint8)
    before = np.array([r[1] for r in rows])  # offsets that the class has windows at: -before .. last
    last = np.array([len(r[0]) - length - r[1] for r in rows])
    grams = _mix(np.lib.stride_tricks.sliding_window_view(flat, GRAM, axis=1).copy().view("<u8")[..., 0])
    up, down = _Powers.of(wide + 1)
    sums = np.zeros((len(rows), grams.shape[1] + 1), np.uint64)
    np.cumsum(grams * up[: grams.shape[1]], axis=1, out=sums[:, 1:])
    hits = np.zeros((len(rows), reach), bool)
    for c in range(reach):
        own = np.flatnonzero((c - left >= -before) & (c - left <= last))
        if len(own) < 2:
            continue
        h = _mix((sums[own, c + length - GRAM + 1] - sums[own, c]) * down[c]) ^ _mix(group[own])
        _, where, n = np.unique(h, return_inverse=True, return_counts=True)
        hits[own, c] = n[where] > 1
    for i, (_, _, key, span, n) in enumerate(rows):
        if n == 1:
            at = np.flatnonzero(hits[i])
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
                yield key, span, int(run[0]) - left, int(run[-1]) - left


def _bitmap(spark: SparkSession, keys: DataFrame) -> tuple:
    """(broadcast bitmap of the keys, its bits): 16 to 32 bits a key, and BITS at most whatever the corpus."""
    keys = keys.toDF("key")
    bits = 1 << max(16, min(BITS.bit_length() - 1, (16 * keys.count()).bit_length()))
    part = min(bits, 1 << 18)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for b in batches:
            s = _slot(b.column(0).to_numpy(), bits)
            np.bitwise_or.at(held, (s >> np.uint64(3)).astype(np.int64), np.uint8(1) << (s & np.uint64(7)).astype(np.uint8))
        for i, cell in enumerate(held.reshape(-1, part // 8)):
            if cell.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([cell.tobytes()], pa.binary())], names=["part", "cell"])

    # Keys are dealt by their part of the bitmap, so each part comes to the driver from one task.
    dealt = keys.withColumn("part", F.shiftrightunsigned("key", 5).bitwiseAND(F.lit(bits - 1)) / part).select("key", F.floor("part").alias("part")).repartition("part").select("key")
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in dealt.mapInArrow(gather, "part int, cell binary").toLocalIterator():
        at = r["part"] * part // 8
        bitmap[at : at + part // 8] |= np.frombuffer(r["cell"], np.uint8)
    return spark.sparkContext.broadcast(bitmap), bits


def _known(bitmap: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    s = _slot(keys, bits)
    return (bitmap[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def removal_intervals(spark: SparkSession, texts: DataFrame, length: int = LENGTH, group: int = GROUP, bucket: int = BUCKET) -> DataFrame:
    """texts (digest binary, text binary), one row per document: (digest, start long, stop long) of byte runs to remove.

    Runs of one digest may overlap. Texts with equal digests must be equal; each row counts as an occurrence.
    """
    reach = min(REACH, length - 2 * GRAM)
    if reach < 1:
        raise ValueError(f"length must be over {2 * GRAM}")

    @lean
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(((t.as_py(),) for b in batches for t in b.column(0)), length):
            yield pa.RecordBatch.from_arrays([pa.array(Anchored([p[-1] for p in pack], length, reach, spans=False).key, pa.int64())], names=["key"])

    counted = texts.select("text").mapInArrow(keys, "key long").groupBy("key").agg(F.count("*").alias("n"))
    repeated = written(spark, counted.filter("n > 1").select("key"), "contexts")
    shipped, bits = _bitmap(spark, repeated)
    columns = [("chunk", pa.binary()), ("digest", pa.binary()), ("start", pa.int64()), ("bytes", pa.binary())]

    @lean
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shipped.value

        def rows() -> Iterator[tuple]:
            for pack in _packs(((d.as_py(), t.as_py()) for b in batches for d, t in zip(b.column(0), b.column(1))), length):
                x = Anchored([p[-1] for p in pack], length, reach)
                known = np.flatnonzero(_known(bitmap, bits, x.key))
                for i, j in _cut_runs(known, x.of, x.span) if len(known) else ():
                    digest, start, part = pack[x.of[i]]
                    own = part[x.lo[i] : x.hi[j] + length]
                    yield hashlib.blake2b(own, digest_size=16).digest(), digest, start + int(x.lo[i]), own

        yield from _batches(columns, rows(), 1024)

    found = written(spark, texts.select("digest", "text").mapInArrow(chunks, "chunk binary, digest binary, start long, bytes binary"), "found")
    shipped.destroy()
    # Combined before the shuffle: a chunk that very many documents hold is one row per task.
    kinds = written(spark, found.groupBy("chunk").agg(F.count("*").alias("n"), F.first("bytes").alias("bytes")), "chunks")

    @lean
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(((n.as_py(), x.as_py()) for b in batches for n, x in zip(b.column(0), b.column(1))), length):
            x = Anchored([p[-1] for p in pack], length, reach)
            n = np.array([p[0] for p in pack], np.int64)[x.of]
            yield pa.RecordBatch.from_arrays([pa.array(x.key), pa.array(x.span), pa.array(n)], names=["key", "span", "n"])

    classes = written(spark, kinds.select("n", "bytes").mapInArrow(anchors, "key long, span long, n long").groupBy("key", "span").agg(F.sum("n").alias("n")), "classes")
    # Contexts with a class that occurs once, beside another class: their windows have to be compared.
    open_keys = written(spark, classes.groupBy("key").agg(F.count("*").alias("classes"), F.min("n").alias("least")).filter("classes > 1 and least = 1").select("key", "classes"), "open")
    undecided = written(spark, classes.join(open_keys, "key").select("key", "span", "n", "classes"), "undecided")
    # The bytes move only where another bitmap says that their class is undecided.
    wanted, wanted_bits = _bitmap(spark, undecided.select("span"))
    span_columns = [("key", pa.int64()), ("span", pa.int64()), ("place", pa.int32()), ("bytes", pa.binary())]

    @lean
    def span_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = wanted.value

        def rows() -> Iterator[tuple]:
            for pack in _packs(((x.as_py(),) for b in batches for x in b.column(0)), length):
                x = Anchored([p[-1] for p in pack], length, reach)
                for i in np.flatnonzero(_known(bitmap, wanted_bits, x.span)).tolist():
                    yield int(x.key[i]), int(x.span[i]), int(x.at[i] - x.lo[i]), pack[x.of[i]][-1][x.lo[i] : x.hi[i] + length]

        yield from _batches(span_columns, rows(), 4096)

    moved = kinds.select("bytes").mapInArrow(span_bytes, "key long, span long, place int, bytes binary")
    one = moved.groupBy("key", "span").agg(F.first("place").alias("place"), F.first("bytes").alias("bytes"))
    spans = written(spark, one.join(undecided, ["key", "span"]), "spans")
    wanted.destroy()
    hits = _sorted_hits(spark, spans.filter(F.col("classes") <= group), length, reach, bucket)
    large = spans.filter(F.col("classes") > group)
    if not large.isEmpty():
        hits = hits.unionByName(_refined_hits(spark, large, length))
    none = F.lit(None).cast("int")
    verdicts = written(spark, classes.filter("n > 1").select("key", "span", none.alias("first"), none.alias("last")).unionByName(hits), "verdicts")

    @lean
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(((c.as_py(), x.as_py()) for b in batches for c, x in zip(b.column(0), b.column(1))), length):
            x = Anchored([p[-1] for p in pack], length, reach)
            names = pa.array([p[0] for p in pack], pa.binary()).take(pa.array(x.of))
            yield pa.RecordBatch.from_arrays([pa.array(x.key), pa.array(x.span), names, *[pa.array(a.astype(np.int32)) for a in (x.at, x.lo, x.hi)]], names=["key", "span", "chunk", "at", "lo", "hi"])

    single = kinds.filter("n = 1").select("chunk", "bytes").mapInArrow(placed, "key long, span long, chunk binary, at int, lo int, hi int")
    start, stop = F.coalesce(F.col("at") + F.col("first"), "lo"), F.coalesce(F.col("at") + F.col("last"), "hi") + length
    marked = single.join(verdicts, ["key", "span"]).select("chunk", F.struct(start.alias("start"), stop.alias("stop")).alias("run"))
    parts = marked.groupBy("chunk").agg(F.collect_list("run").alias("runs"))  # the anchors of a chunk: a bounded list
    whole = kinds.filter("n > 1").select("chunk", F.array(F.struct(F.lit(0).alias("start"), F.length("bytes").alias("stop"))).alias("runs"))
    runs = written(spark, parts.unionByName(whole), "chunk_runs")
    each = found.select("chunk", "digest", F.col("start").alias("base")).join(runs, "chunk").select("digest", "base", F.explode("runs").alias("run"))
    return each.select("digest", (F.col("base") + F.col("run.start")).alias("start"), (F.col("base") + F.col("run.stop")).alias("stop")).distinct()


def _sorted_hits(spark: SparkSession, spans: DataFrame, length: int, reach: int, bucket: int) -> DataFrame:
    """Sampled splitters on the context, then a local sort of each bucket."""
    context = F.expr(f"substring(bytes, place + 1, {length - reach + 1})")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-spans.count() // bucket))

    @lean
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
        if rows:
            yield from _batches([("key", pa.int64()), ("span", pa.int64()), ("first", pa.int32()), ("last", pa.int32())], _bucket(rows, length, reach))

    dealt = spans.select("bytes", "place", "key", "span", "n").repartitionByRange(buckets, context)
    return dealt.mapInArrow(sort, "key long, span long, first int, last int")


def _refined_hits(spark: SparkSession, spans: DataFrame, length: int) -> DataFrame:
    """Classes of contexts too large for a bucket: their windows are dealt out in ever smaller cells.

    A cell holds the windows at the same offsets from the anchor. All windows of a cell hold its core; a cell whose core
    occurs once has no repeated window, one whose whole bytes occur twice has only such, and the others are cut further,
    down to single windows. Equal cells go on as one row, so a context that a third of all rows share stays small.
    """
    rows, hits = spans.select("key", "span", "n", (-F.col("place")).alias("first"), "bytes"), []
    columns = [("core", pa.binary()), ("whole", pa.binary()), ("key", pa.int64()), ("span", pa.int64()), ("n", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("bytes", pa.binary())]

    def split(width: int):
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def cells() -> Iterator[tuple]:
                for b in batches:
                    for key, span, n, first, x in (r.values() for r in b.to_pylist()):
                        end = first + len(x) - length + 1
                        for cell in range(first // width, (end - 1) // width + 1):
                            lo, hi = max(first, cell * width), min(end, cell * width + width) - 1
                            core = x[(cell + 1) * width - 1 - first : cell * width - first + length]
                            own = x[lo - first : hi - first + length]
                            yield _digest(core, cell), _digest(own, lo, hi), key, span, n, lo, hi, own

            yield from _batches(columns, cells(), 4096)

        return run

    for width in (24, 6, 1):
        cells = written(spark, rows.mapInArrow(split(width), "core binary, whole binary, key long, span long, n long, first int, last int, bytes binary"), "cells")
        one = F.struct("key", "span", "n", "first", "bytes")
        wholes = written(spark, cells.groupBy("core", "whole").agg(F.count("*").alias("times"), F.min(one).alias("one")), "wholes")
        again = written(spark, wholes.filter("times > 1").select("whole"), "again")
        hits.append(cells.filter("n = 1").join(again, "whole").select("key", "span", "first", "last"))
        if width > 1:
            still = written(spark, wholes.groupBy("core").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).filter("kinds > 1 and least = 1").select("core"), "still")
            rows = wholes.join(still, "core").select("one.key", "one.span", F.greatest("one.n", "times").alias("n"), "one.first", "one.bytes")
    return hits[0].unionByName(hits[1]).unionByName(hits[2])


def _digest(x: bytes, *more: int) -> bytes:
    return hashlib.blake2b(x, digest_size=16, person=b"%d:%d" % (more + more)[:2]).digest()


def _cut(text: bytes, runs: list[tuple[int, int]] | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs)."""
    kept, end, removed, spans = [], 0, 0, 0
    for start, stop in sorted(runs or []):
        if start > end or not spans:
            kept.append(text[end:start])
            spans += 1
        removed += max(0, stop - max(start, end))
        end = max(end, stop)
    return b"".join([*kept, text[end:]]), removed, spans


def remove_repeats(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP, bucket: int = BUCKET, keep: list[str] | None = None) -> DataFrame:
    """One row per row of df: id_col, n_bytes, n_removed, n_spans (long), kept_sha256 (hex) and kept_text.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same or another row;
    matches stay within a row. A null text counts as empty. Repeated rows count as occurrences of each other. kept_sha256
    is that of the bytes left; kept_text is their text, without what is left of a character that a run's end cut. keep names further columns to carry along; others are not read.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    own = df.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(k) for k in keep or []]).alias("more"))
    runs = removal_intervals(spark, own.select("digest", "text"), length, group, bucket)
    # A document has at most one run per anchor, so this list is bounded by its text.
    by_text = written(spark, runs.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs")), "runs")
    joined = own.join(by_text, "digest", "left").select("id", "text", "runs", "more")
    fields = joined.schema
    out = f"id {fields['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, more {fields['more'].dataType.simpleString()}"

    @lean
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(1).to_pylist()
            cut = [_cut(t, r and [(x["start"], x["stop"]) for x in r]) for t, r in zip(texts, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([c[1] for c in cut], pa.int64()), pa.array([c[2] for c in cut], pa.int64()), pa.array([hashlib.sha256(c[0]).hexdigest() for c in cut], pa.string()), pa.array([c[0].decode("utf-8", "ignore") for c in cut], pa.string()), b.column(3)],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "more"],
            )

    done = joined.mapInArrow(finish, out)
    return done.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *[F.col(f"more.`{k}`").alias(k) for k in keep or []])


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents")).drop("kept_text")


QUERIES = {"op5_suffix_array_dedup": op5_suffix_array_dedup}
ORACLES: dict[str, str] = {}
