"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

The plan needs the number of pieces of each length only, at most `capacity` numbers, so it is made on the driver whatever
the corpus:

1. Linear grouping: pieces over capacity / 8, sorted by length, are cut into groups of equal cardinality, and each group
   counts as its longest piece. That leaves a few sizes.
2. Configurations of these sizes are chosen one after another: the fullest one that holds the largest size left, found by
   a knapsack over the capacity, as often as the counts allow.
3. The actual pieces take the places of their groups, which leaves more room than planned.
4. Small pieces go, longest first, to the sequence with the least sufficient room.

The plan is a list of runs: the pieces of one length with ranks a..b go to sequences s, s + 1, ... at one offset. Ranks are
dealt in a distributed way, and each piece finds its run by binary search.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm._common import lean, shuffle_partitions, sliced, table, written

CAPACITY = 2048
SEPARATOR = 0
GROUPS = 512
#: Pieces up to capacity / SMALL are small.
SMALL = 8
#: Words whose ids a worker keeps.
CACHE = 600_000
#: Texts whose new words are encoded together.
TOGETHER = 256

# How the public file normalizes a text and cuts it into words, which the fast path does without it.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORDS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# The letters and digits among the code points that the fast path takes, all of which are in form NFC.
_LETTERS = "a-zªµºß-öø-įı-ɏ"
_DIGITS = "0-9²³¹¼-¾"
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-įı-ɏ]*")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
# The byte-level map shows the bytes of the printable characters as these, and the others in order from U+0100 on.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
_SHOWN = {b: 256 + i for i, b in enumerate(_HIDDEN)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of a tokenizer that encodes words independently, as packed little-endian unsigned 32-bit integers.

    Words are encoded by the tokenizer once and kept. A text outside the fast path's code points, or with one of the
    tokenizer's special strings, is encoded whole; so is every text if the file cuts words in another way.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            own = json.load(f)
        self._fast = own["normalizer"] == _NORMALIZER and own["pre_tokenizer"] == _WORDS and own["post_processor"] is None and own["model"]["type"] == "BPE"
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._ids: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: Iterable[str]) -> None:
        """Ids of single words from the tokenizer's model, which sees a word's UTF-8 bytes as the characters of the byte-level map."""
        model = self._tokenizer.model
        for w in words:
            shown = w if w.isascii() else w.encode().decode("latin-1").translate(_SHOWN)
            ids = [t.id for t in model.tokenize(shown)]
            self._ids[w] = struct.pack(f"<{len(ids)}I", *ids)

    def many(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), TOGETHER):
            part = texts[at : at + TOGETHER]
            split = [_PIECE.findall(t.lower()) if self._fast and _PLAIN.fullmatch(t) and not any(s in t for s in self._special) else None for t in part]
            words_now = set(chain.from_iterable(filter(None, split)))
            if len(self._ids) > CACHE:  # frequent words are among those of these texts, too
                self._ids = {w: ids for w in words_now if (ids := self._ids.get(w)) is not None}
            known = self._ids
            self._learn(words_now.difference(known))
            for text, words in zip(part, split):
                yield self._whole(text) if words is None else b"".join(map(known.__getitem__, words))

    def __call__(self, text: str) -> bytes:
        return next(self.many([text]))


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(vocabulary: str) -> WordEncoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = WordEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def pieces(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for b in sliced(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode.many([t or "" for t in b.column(1).to_pylist()])):
                ids += SEPARATOR.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _fullest(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """How often each size is in the fullest configuration that holds the first size left."""
    first = next(i for i, c in enumerate(counts) if c)
    room = capacity - sizes[first]
    left = [c - (i == first) for i, c in enumerate(counts)]
    reached = np.full(room + 1, -1, np.int32)  # the last size used to fill so much
    reached[0] = len(sizes)
    for i, (s, c) in enumerate(zip(sizes, left)):
        for _ in range(min(c, room // s) if c > 0 else 0):
            new = np.zeros(room + 1, bool)
            new[s:] = (reached[:-s] >= 0) if s else False
            new &= reached < 0
            if not new.any():
                break
            reached[new] = i
        if reached[room] >= 0:
            break
    fill = int(np.flatnonzero(reached >= 0)[-1])
    used = [0] * len(sizes)
    used[first] = 1
    while fill:
        used[reached[fill]] += 1
        fill -= sizes[reached[fill]]
    # A size that fills its own gaps may be used more often than it is left: drop what is too much.
    return [min(u, c) for u, c in zip(used, counts)]


Run = tuple[int, int, int, int, int]  # length, first rank, end rank, first sequence, offset


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> list[Run]:
    """Runs that place every piece of the histogram (length -> number) in sequences of at most capacity tokens."""
    out: list[Run] = []
    sequences = histogram.get(capacity, 0)
    if sequences:
        out.append((capacity, 0, sequences, 0, 0))
    large = [(n, histogram[n]) for n in sorted(histogram, reverse=True) if capacity // small < n < capacity and histogram[n]]
    total = sum(c for _, c in large)
    share = max(1, -(-total // groups))
    members: list[list[list[int]]] = []  # of each group: [length, first rank, end rank], longest first
    taken = share
    for length, count in large:
        rank = 0
        while rank < count:
            if taken == share:
                members.append([])
                taken = 0
            n = min(count - rank, share - taken)
            members[-1].append([length, rank, rank + n])
            taken, rank = taken + n, rank + n
    sizes = [m[0][0] for m in members]
    counts = [sum(b - a for _, a, b in m) for m in members]
    for m in members:
        m.reverse()  # taken from the end
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences
    while any(counts):
        used = _fullest(sizes, counts, capacity)
        times = min(c // u for c, u in zip(counts, used) if u)
        filled = [(sequences, sequences + times, 0)]
        sequences += times
        for g, u in enumerate(used):
            counts[g] -= u * times
            for _ in range(u):
                after = []
                for lo, hi, offset in filled:
                    while lo < hi:
                        run = members[g][-1]
                        n = min(hi - lo, run[2] - run[1])
                        out.append((run[0], run[1], run[1] + n, lo, offset))
                        after.append((lo, lo + n, offset + run[0]))
                        run[1] += n
                        lo += n
                        if run[1] == run[2]:
                            members[g].pop()
                filled = after
        for lo, hi, offset in filled:
            room.setdefault(capacity - offset, []).append((lo, hi))
    rooms = sorted(room)
    for length in sorted((n for n in histogram if 0 < n <= capacity // small and n < capacity), reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                n = -(-(count - rank) // (capacity // length))
                room.setdefault(capacity, []).append((sequences, sequences + n))
                sequences += n
                bisect.insort(rooms, capacity)
            left = rooms[at]
            lo, hi = room[left].pop()
            n = min(hi - lo, count - rank)
            if lo + n < hi:
                room[left].append((lo + n, hi))
            if not room[left]:
                del room[left], rooms[at]
            out.append((length, rank, rank + n, lo, capacity - left))
            rank += n
            if left > length:
                if left - length not in room:
                    room[left - length] = []
                    bisect.insort(rooms, left - length)
                room[left - length].append((lo, lo + n))
    return out


def packed(spark: SparkSession, df: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every row of df: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the separator alone. Only documents longer than capacity are cut. Repeated rows are packed
    each; a null id keeps its pieces; an empty table gives an empty one. Other columns are not read.
    """
    cut = written(spark, pieces(df, vocabulary or default_vocabulary(), capacity, id_col, text_col), "pieces")
    buckets = 4 * shuffle_partitions(spark)
    own = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = written(spark, own.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs = sorted(plan(histogram, capacity))
    keys = np.array([r[0] << 44 | r[1] for r in runs], np.int64)
    base, offset = np.array([r[3] - r[1] for r in runs], np.int64), np.array([r[4] for r in runs], np.int64)
    shipped = spark.sparkContext.broadcast((keys, base, offset))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    order = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = own.withColumn("rank", F.row_number().over(order) - 1).join(before.drop("n"), ["length", "bucket"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.coalesce("before", F.lit(0))).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, offset = shipped.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            run = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(base[run] + rank, pa.int64()), pa.array(offset[run], pa.int64())], names=[*b.schema.names[:5], "sequence_id", "offset"])

    kind = ranked.schema["id"].dataType.simpleString()
    done = ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return done.withColumnRenamed("id", id_col)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLES: dict[str, str] = {}
