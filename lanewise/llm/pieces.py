"""SentencePiece encoding and decoding over a lattice of pieces.

A text is cut into words (spaces and what follows them); no piece but runs of spaces crosses a word. The new words of a
batch become a relation of edges: every substring of bounded length is exploded, joined to the piece table on its hash, and
kept with its word. The fold over a word's edges follows the kind of the model, as the library does. A unigram model takes the
path with the greatest sum of scores (Viterbi). A byte-pair model, such as the public one, takes the edge of best rank among
those that join two neighbours, leftmost first, until none is left; a sum of scores would give other pieces. Characters
without a piece become byte pieces. Paths of words are kept by each worker up to a bound. Models of other kinds, and those that
change a text before they cut it, are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm._common import lean, sliced, table

#: Words whose paths a worker keeps.
CACHE = 100_000
#: Texts whose new words are folded together.
TOGETHER = 256
SPACE_MARK = "▁"
_WORD = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TOP_BITS = 20
_TOP_SHIFT = np.uint64(64 - _TOP_BITS)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Kinds of models, as their files number them; and by how much a character without a piece scores below the worst piece.
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message; numbers of fixed size are left as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size


def model_kind(model: bytes) -> int:
    """UNIGRAM or BPE; an error for a model that this module would encode otherwise than the library."""
    fields = [(n, v) for n, v in _fields(model) if n in (2, 3)]
    trainer, normalizer = (dict(_fields(b"".join(v for n, v in fields if n == k))) for k in (2, 3))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and byte-pair models are encoded")
    if not trainer.get(35, 0):
        raise ValueError("the model has no byte fallback")
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
        raise ValueError("the model changes texts before it cuts them")
    return kind


def _hashes(points: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    for k in range(size):
        h = (h ^ points[starts + k]) * _BASE
        h ^= h >> np.uint64(31)
    return h * _BASE + np.uint64(size)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class PieceTable:
    """The pieces of a model as a relation (hash, id, rank), and the bytes that each id decodes to."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        with open(model, "rb") as f:
            raw = f.read()
        self.kind = model_kind(raw)
        own = SentencePieceProcessor(model_proto=raw)
        n = own.vocab_size()
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        normal: list[tuple[str, int, float]] = []
        for i in range(n):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif own.is_control(i) or own.is_unknown(i):
                self.bytes.append(b"" if own.is_control(i) else " ⁇ ".encode())
            else:
                self.bytes.append(piece.replace(SPACE_MARK, " ").encode())
                normal.append((piece, i, own.get_score(i)))
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p, _, _ in normal):
            raise ValueError("a piece crosses the words of a text")
        self.single = {p: i for p, i, _ in normal if len(p) == 1}
        self.scores = {p: s for p, _, s in normal if len(p) == 1}
        self.unknown = min((s for _, _, s in normal), default=0.0) - UNKNOWN_PENALTY
        self.longest = max((len(p) for p, _, _ in normal), default=1)
        by_hash = sorted((int(_hashes(_points(p), np.zeros(1, np.int64), len(p))[0]), i, -s) for p, i, s in normal if len(p) > 1)
        self.keys = np.array([k for k, _, _ in by_hash], np.uint64)
        self.ids = np.array([i for _, i, _ in by_hash], np.int64)
        self.ranks = np.array([r for _, _, r in by_hash], np.float64)
        self._held = np.zeros(1 << _TOP_BITS, bool)  # which leading bits some key has: most substrings end here, before the search
        self._held[self.keys >> _TOP_SHIFT] = True
        self._relation = [(p, i, -s) for p, i, s in normal]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")

    def relation(self) -> list[tuple[str, int, float]]:
        """(piece, id, rank) of every piece of characters."""
        return self._relation

    def edges(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id, rank) of every piece of two or more characters inside a word; ends[i] is the end of the word of point i."""
        out = []
        for size in range(2, self.longest + 1):
            starts = np.flatnonzero(np.arange(len(points)) + size <= ends)
            if not len(starts):
                break
            h = _hashes(points, starts, size)
            maybe = np.flatnonzero(self._held[h >> _TOP_SHIFT])
            h, starts = h[maybe], starts[maybe]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            out.append((starts[hit], starts[hit] + size, self.ids[at[hit]], self.ranks[at[hit]]))
        if not out:
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.float64))
        return tuple(np.concatenate(c) for c in zip(*out))

    def paths(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as packed little-endian unsigned 32-bit integers."""
        text = "".join(words)
        points = _points(text)
        sizes = np.array([len(w) for w in words], np.int64)
        stops = np.cumsum(sizes)
        ends = np.repeat(stops, sizes)
        start, end, ids, ranks = self.edges(points, ends)
        n = len(points)
        if self.kind == UNIGRAM:
            boundary, piece = self._viterbi(text, stops, start, end, ids, -ranks)
            return self._spelled(text, stops, boundary, piece)
        # Characters that no edge crosses between are independent: each stretch of crossed ones is folded on its own.
        crossed = np.zeros(n + 1, np.int64)
        np.add.at(crossed, start + 1, 1)
        np.add.at(crossed, end, -1)
        group = np.cumsum(np.cumsum(crossed)[:n] == 0) if n else np.empty(0, np.int64)
        boundary = np.ones(n + 1, bool)
        piece = np.full(n, -1, np.int64)
        order = np.lexsort((start, ranks, group[start] if len(start) else start))
        start, end, ids, owner = start[order], end[order], ids[order], group[start[order]] if len(start) else start
        while len(start):
            before = np.concatenate([[0], np.cumsum(boundary)])
            inside = before[end] - before[start + 1]
            alive = boundary[start] & boundary[end] & (inside > 0)
            start, end, ids, owner, inside = start[alive], end[alive], ids[alive], owner[alive], inside[alive]
            ready = np.flatnonzero(inside == 1)
            if not len(ready):
                break
            best = ready[np.concatenate([[True], owner[ready][1:] != owner[ready][:-1]])]
            s, e = start[best], end[best]
            for k in range(1, self.longest):
                cut = s + k < e
                if not cut.any():
                    break
                boundary[(s + k)[cut]] = False
            piece[s] = ids[best]
        return self._spelled(text, stops, boundary, piece)

    def _viterbi(self, text: str, stops: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(boundaries, piece from each boundary or -1) of the path of the greatest sum of scores through each word."""
        n = len(text)
        boundary, piece = np.zeros(n + 1, bool), np.full(n, -1, np.int64)
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for a, b, i, s in zip(start.tolist(), end.tolist(), ids.tolist(), scores.tolist()):
            into[b].append((a, i, s))
        lo = 0
        for hi in stops.tolist():
            best, back = [0.0], [(lo, -1)]
            for at in range(lo + 1, hi + 1):
                c = text[at - 1]
                options = [(best[at - 1 - lo] + self.scores.get(c, self.unknown), at - 1, -1), *((best[a - lo] + s, a, i) for a, i, s in into[at])]
                top = max(options, key=lambda o: (o[0], -o[1]))  # of equal sums the one whose last piece is longest, as the library has it
                best.append(top[0])
                back.append(top[1:])
            at = hi
            boundary[hi] = True
            while at > lo:
                a, i = back[at - lo]
                boundary[a], piece[a] = True, i
                at = a
            lo = hi
        return boundary, piece

    def _spelled(self, text: str, stops: np.ndarray, boundary: np.ndarray, piece: np.ndarray) -> list[bytes]:
        """The ids of each word from its boundaries; a stretch without a piece is one character."""
        n = len(text)
        heads = np.flatnonzero(boundary[:n])
        values, counts = piece[heads], np.ones(len(heads), np.int64)
        merged = values >= 0
        extra: dict[int, list[int]] = {}
        for k in np.flatnonzero(~merged).tolist():
            c = text[heads[k]]
            if (i := self.single.get(c)) is not None:
                values[k] = i
            else:
                extra[k] = [self.byte_ids[b] for b in c.encode("utf-8", "replace")]
                counts[k] = len(extra[k])
        flat = np.repeat(values, counts).astype("<u4")
        place = np.cumsum(counts) - counts
        for k, more in extra.items():
            flat[place[k] : place[k] + len(more)] = more
        cuts = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(heads, np.concatenate([[0], stops]))]
        raw = flat.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids: bytes) -> str:
        own = b"".join([self.bytes[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return own.removeprefix(b" ").decode("utf-8", "replace")


class Encoder:
    """Texts to ids through the lattice; words are kept up to CACHE."""

    def __init__(self, model: str):
        self.table = PieceTable(model)
        self._known: dict[str, bytes] = {}

    def many(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), TOGETHER):
            split = [_WORD.findall((SPACE_MARK + t.replace(" ", SPACE_MARK)) if t else "") for t in texts[at : at + TOGETHER]]
            now = dict.fromkeys(w for words in split for w in words)
            if len(self._known) > CACHE:  # frequent words are among those of these texts, too
                self._known = {w: ids for w in now if (ids := self._known.get(w)) is not None}
            new = [w for w in now if w not in self._known]
            if new:
                self._known.update(zip(new, self.table.paths(new)))
            for words in split:
                yield b"".join(map(self._known.__getitem__, words))


_ENCODERS: dict[str, Encoder] = {}


def encoder(model: str) -> Encoder:
    if model not in _ENCODERS:
        _ENCODERS[model] = Encoder(model)
    return _ENCODERS[model]


def encoded(df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids) of every row; ids is a binary of little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Repeated rows stay; an empty table gives an empty one. Other columns are not read.
    """
    model = model or default_model()
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ids = list(encoder(model).many([t or "" for t in b.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, ids binary").withColumnRenamed("id", id_col)


def decoded(df: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of every row of ids, the inverse of encoded() up to null texts, which come back empty."""
    model = model or default_model()
    own = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            pieces = encoder(model).table
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces.decode(i or b"") for i in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_tokens, ids_crc32, and the hash of what the ids decode to beside that of the text."""
    model = default_model()
    own = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            codec = encoder(model)
            texts = b.column(1).to_pylist()
            ids = list(codec.many(texts))
            exact = [codec.table.decode(i) == t for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(exact)], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return own.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLES: dict[str, str] = {}
