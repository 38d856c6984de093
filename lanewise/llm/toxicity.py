"""Toxicity scores by a factorization machine over hashed terms.

Terms are words, their leading bytes (stems) and the stems that a text repeats, hashed into a fixed number of slots. The machine is

    bias + sum_i w_i x_i + sum_(i<j) <v_i, v_j> x_i x_j

so it learns what two terms mean together, such as an insult beside a mention of a group, which additive weights miss.
It is fitted on a bounded sample of labelled rows (SAMPLE) and scores every document; the pairwise sum is taken in
linear time. Labels, language, source and ids are no inputs of a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm._common import lean, sliced, table

SLOTS = 1 << 18
#: Labelled rows that the machine is fitted on, at most: those with the least hashes of their ids.
SAMPLE = 8_000
#: Slots that take part, at most, and the least absolute z score of their rate among toxic rows.
ACTIVE = 1024
LEAST_Z = 4.0
FACTORS = 8
PREFIX = 6
#: A stem is a term of its own from so many occurrences in a text on.
OFTEN = (1, 2, 3, 5)
TOXIC_AT = 0.7

_SPLIT = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def terms(text: bytes | None) -> np.ndarray:
    """Distinct slots of a text's terms: its words, its stems, and the stems that come often."""
    words = Counter((text or b"").decode("utf-8", "replace").lower().encode().translate(_SPLIT).split())
    stems: Counter[bytes] = Counter()
    for w, n in words.items():
        stems[w[:PREFIX]] += n
    hashes = [zlib.crc32(w) for w in words] + [zlib.crc32(s, least) for s, n in stems.items() for least in OFTEN if n >= least]
    return np.unique(np.array(hashes, np.uint32) % np.uint32(SLOTS))


@dataclass
class Machine:
    """index: the place of each slot among the active ones, or -1. x: the value of each active slot when present."""

    index: np.ndarray
    x: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, slots: np.ndarray) -> float:
        own = self.index[slots]
        own = own[own >= 0]
        x = self.x[own]
        v = self.factors[own] * x[:, None]
        z = self.bias + float(self.linear[own] @ x) + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 300, rate: float = 0.05, l2: float = 2e-4, seed: int = 7) -> Machine:
    """Full-batch Adam on the log loss. Without rows of both labels the score is the same for every text."""
    n, toxic = len(rows), int(labels.sum())
    index = np.full(SLOTS, -1, np.int32)
    if not n or toxic in (0, n):
        return Machine(index, np.zeros(1), -4.0 if not toxic else 4.0, np.zeros(1), np.zeros((1, FACTORS)))
    seen, among = np.zeros(SLOTS), np.zeros(SLOTS)
    for slots, y in zip(rows, labels):
        seen[slots] += 1
        among[slots] += y
    p = toxic / n
    z = np.abs(among - seen * p) / np.sqrt(np.maximum(seen, 1) * p * (1 - p))
    z[seen < 3] = 0
    active = np.argsort(-z, kind="stable")[:ACTIVE]
    active = active[z[active] >= LEAST_Z]
    if not len(active):
        active = np.argsort(-z, kind="stable")[:16]
    index[active] = np.arange(len(active))
    ratio = np.log((among[active] + 0.5) / (toxic + 1)) - np.log((seen[active] - among[active] + 0.5) / (n - toxic + 1))
    x = np.clip(np.abs(ratio), 0.1, 4.0) / 2
    data = np.zeros((n, len(active)), np.float32)
    for i, slots in enumerate(rows):
        own = index[slots]
        data[i, own[own >= 0]] = 1
    data *= x.astype(np.float32)
    rng = np.random.default_rng(seed)
    params = [np.array([np.log(p / (1 - p))]), np.zeros(len(active)), rng.normal(0, 0.02, (len(active), FACTORS))]
    first, second = ([np.zeros_like(a) for a in params] for _ in range(2))
    weight = np.where(labels == 1, np.sqrt((n - toxic) / toxic), 1.0)
    weight /= weight.sum()
    square = data**2
    for t in range(1, rounds + 1):
        bias, linear, factors = params
        inner = data @ factors.astype(np.float32)  # single precision: no copies of the data
        s = bias + data @ linear.astype(np.float32) + 0.5 * ((inner**2).sum(axis=1) - square @ (factors**2).sum(axis=1).astype(np.float32))
        error = (((1 / (1 + np.exp(-np.clip(s, -30, 30)))) - labels) * weight).astype(np.float32)
        grads = [np.array([error.sum()]), error @ data + l2 * linear, data.T @ (error[:, None] * inner) - factors * (error @ square)[:, None] + l2 * factors]
        for a, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Machine(index, x, float(params[0][0]), params[1], params[2])


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(spark: SparkSession, df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Machine:
    """Fit on at most `sample` labelled rows that aren't held out."""
    own = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("id"))
    some = own.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(some), "id")  # at most `sample` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([terms(t.as_py()).astype(np.int32).tobytes() for t in b.column(2)], pa.binary())], names=["id", "toxic", "slots"])

    rows = texts.select(F.col("id").cast("long").alias("id"), "toxic", "text").mapInArrow(run, "id long, toxic int, slots binary").orderBy(F.xxhash64("id"), "id", F.xxhash64("slots")).limit(sample).collect()
    return fit([np.frombuffer(r["slots"], np.int32) for r in rows], np.array([r["toxic"] for r in rows], np.float64))


def toxicity_scores(spark: SparkSession, df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """One row per row of df: id_col, score (0 to 1) and the columns of keep; other columns are not read.

    A null text counts as empty and has the score of a text without terms. Labels other than 0 and 1, or of null ids, are
    ignored; of several labels of an id the highest counts. Without labels of both kinds all scores are equal, and low unless every label is toxic.
    """
    machine = learn(spark, df, labels, id_col, text_col, sample)
    shipped = spark.sparkContext.broadcast(machine)
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(k) for k in keep or []]).alias("more"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(terms(t.as_py())) for t in b.column(1)], pa.float64()), b.column(2)], names=["id", "score", "more"])

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    scored = own.mapInArrow(run, f"id {kinds['id']}, score double, more {kinds['more']}")
    return scored.select(F.col("id").alias(id_col), "score", *[F.col(f"more.`{k}`").alias(k) for k in keep or []])


def op8_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity_fm": op8_toxicity_fm}
ORACLES: dict[str, str] = {}
