"""Exact top-k search by inner product over norm-sorted vectors.

Components become whole numbers, floor(SCALE * x), so scores are exact. A rotation from the second moments of all vectors
(the right singular vectors of the data) moves most of their length to the leading coordinates. Candidates are dealt into
blocks by descending length, and the blocks are met in rounds of falling length, each EACH times as many as before. A block of
queries meets a block of candidates only if the longest vector there can reach the k-th score of one of its queries, which
the small tables of the blocks' lengths decide before any vector travels. Where two blocks meet, the leading coordinates
give partial sums, then by Cauchy-Schwarz the lengths of what is left bound each score, and only pairs whose bound reaches
the query's current k-th score are computed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm._common import table, written

SCALE = 1024
K = 10
#: Bytes of a block of candidates, as doubles, and rows of a block of queries.
BLOCK_BYTES = 1 << 23
QUERIES_OF_BLOCK = 512
#: Growth of the rounds.
EACH = 8
#: Candidates that a chunk prunes together.
CHUNK = 512
#: Share of the squared length that the leading coordinates hold at least.
ENERGY = 0.6
EVERY = 100
_SLACK = 1e-7
_LONG = 2**63 - 1


def _whole(vectors: pa.Array, scale: int) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Rows that take part, by dimension: (row numbers, matrix of whole numbers as doubles)."""
    out: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for i, v in enumerate(vectors):
        if not v.is_valid or v.values.null_count:
            continue
        a = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
        if len(a) and np.isfinite(a).all():
            own = out.setdefault(len(a), ([], []))
            own[0].append(i)
            own[1].append(a)
    return {d: (np.array(rows), np.stack(vs)) for d, (rows, vs) in out.items()}


def _vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, dim, norm, v) of the rows that take part; v holds the whole numbers, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, (rows, m) in _whole(b.column(1), scale).items():
                norms = np.sqrt((m * m).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([dim] * len(rows), pa.int32()), pa.array(norms), pa.array([_packed(r) for r in m], pa.binary())], names=["id", "dim", "norm", "v"])

    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("id is not null")
    return own.mapInArrow(run, "id long, dim int, norm double, v binary")


def _packed(m: np.ndarray) -> bytes:
    """Whole numbers as floats of four bytes where these hold them, else of eight."""
    return m.astype(np.float32 if np.abs(m).max(initial=0) < 2**24 else np.float64).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * n else np.float64).astype(np.float64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.concatenate([_unpacked(r, dim) for r in column.to_pylist()]).reshape(-1, dim)


def rotations(vectors: DataFrame) -> dict[int, tuple[np.ndarray, int]]:
    """For each dimension (rotation, leading coordinates), from the second moments of all vectors: dim x dim numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column(0).to_numpy()
            for dim in np.unique(dims):
                m = _matrix(b.column(1).filter(pa.array(dims == dim)), int(dim))
                unit = m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1)
                sums[int(dim)] = sums.get(int(dim), 0) + unit.T @ unit
        for dim, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(list(s), pa.list_(pa.float64()))], names=["dim", "row", "moments"])

    parts = vectors.select("dim", "v").mapInArrow(run, "dim int, row int, moments array<double>")
    cells = parts.select("dim", "row", F.posexplode("moments").alias("at", "m")).groupBy("dim", "row", "at").agg(F.sum("m").alias("m"))
    out = {}
    sums: dict[int, np.ndarray] = {}
    for r in cells.toLocalIterator():  # as many numbers as the rotation itself has
        sums.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[r["row"], r["at"]] = r["m"]
    for dim, moments in sums.items():
        values, basis = np.linalg.eigh((moments + moments.T) / 2)
        share = np.cumsum(values[::-1]) / max(values.sum(), 1e-300)
        out[int(dim)] = (np.ascontiguousarray(basis[:, ::-1]), min(int(dim), int(np.searchsorted(share, ENERGY)) + 1))
    return out


def _blocks(rows: int | None):
    """Rows in order -> blocks of one dimension: ids and whole numbers, with the greatest length; `rows` each, or as BLOCK_BYTES allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: np.ndarray, dim: int, m: np.ndarray) -> pa.RecordBatch:
            longest = float(np.sqrt((m * m).sum(axis=1)).max())
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([longest]), pa.array([ids.tobytes()], pa.binary()), pa.array([_packed(m)], pa.binary())], names=["dim", "longest", "ids", "m"])

        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for b in batches:
            dims, ids = b.column(1).to_numpy(), b.column(0).to_numpy()
            for dim in np.unique(dims):
                size = rows or max(1, BLOCK_BYTES // (8 * int(dim)))
                own = held.setdefault(int(dim), ([], []))
                own[0].append(ids[dims == dim])
                own[1].append(_matrix(b.column(2).filter(pa.array(dims == dim)), int(dim)))
                if sum(map(len, own[0])) >= size:
                    i, m = np.concatenate(own[0]), np.concatenate(own[1])
                    for at in range(0, len(i) - size + 1, size):
                        yield block(i[at : at + size], int(dim), m[at : at + size])
                    full = len(i) // size * size
                    held[int(dim)] = ([i[full:]], [m[full:]])
        for dim, (i, m) in held.items():
            if sum(map(len, i)):
                yield block(np.concatenate(i), dim, np.concatenate(m))

    return run


_BLOCK_SCHEMA = "dim int, longest double, ids binary, m binary"


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: by doubles where these are exact, else by Python integers; held within a long."""
    if not q.size or not c.size or np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = lambda a: np.array([[int(x) for x in r] for r in a], object).reshape(a.shape)
    return np.clip(whole(q) @ whole(c).T, -_LONG, _LONG).astype(np.int64)


def _best(q: dict, c: dict, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of each query's k best of a block; least: a score that each query has k times already."""
    n = len(q["ids"])
    ids = np.full((n, k), np.iinfo(np.int64).max)
    scores = np.full((n, k), np.iinfo(np.int64).min)
    for at in range(0, len(c["ids"]), CHUNK):
        part = {name: a[at : at + CHUNK] for name, a in c.items()}
        need = np.maximum(least, np.where(ids[:, -1] < np.iinfo(np.int64).max, scores[:, -1], np.iinfo(np.int64).min)).astype(np.float64)
        slack = _SLACK * q["norms"] * part["norms"].max() + 1
        rows = np.flatnonzero(q["norms"] * part["norms"].max() + slack >= need)
        if not len(rows):
            continue
        bound = q["lead"][rows] @ part["lead"].T + q["rest"][rows, None] * part["rest"][None, :]
        hopeful = bound + slack[rows, None] >= need[rows, None]
        keep = np.flatnonzero(hopeful.any(axis=1))
        columns = np.flatnonzero(hopeful.any(axis=0))
        if not len(keep):
            continue
        rows, hopeful = rows[keep], hopeful[np.ix_(keep, columns)]
        own = part["ids"][columns]
        s = _exact(q["m"][rows], part["m"][columns])
        s = np.where(hopeful & (q["ids"][rows, None] != own[None, :]), s, np.iinfo(np.int64).min)
        all_ids = np.concatenate([ids[rows], np.where(s > np.iinfo(np.int64).min, own[None, :], np.iinfo(np.int64).max)], axis=1)
        all_scores = np.concatenate([scores[rows], s], axis=1)
        order = np.lexsort((all_ids, -all_scores.astype(np.float64) if np.abs(s[s > np.iinfo(np.int64).min]).max(initial=0) < 2**53 else ~all_scores), axis=1)[:, :k]
        ids[rows], scores[rows] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_scores, order, 1)
    found = (ids < np.iinfo(np.int64).max) & (scores >= least[:, None])
    row, col = np.nonzero(found)
    return row, ids[row, col], scores[row, col]


def _open(dim: int, ids: bytes, m: bytes, rotate: dict[int, tuple[np.ndarray, int]]) -> dict:
    own = np.frombuffer(ids, np.int64)
    whole = _unpacked(m, len(own) * dim).reshape(-1, dim)
    basis, lead = rotate[dim]
    turned, norms = whole @ basis[:, :lead], np.sqrt((whole * whole).sum(axis=1))
    return {"ids": own, "m": whole, "norms": norms, "lead": turned, "rest": np.sqrt(np.maximum(norms**2 - (turned * turned).sum(axis=1), 0))}


def top_k(spark: SparkSession, df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, block: int | None = None, query_block: int = QUERIES_OF_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of df with the highest inner products, for each row of queries.

    A query's candidates are the rows with another id and as many components. Ties go to the smaller id; rows of df that
    share an id are candidates each; repeated queries are answered once, and queries that share an id together. Rows with a null id or vector, without
    components, or with a null or non-finite component (scaled, too) take no part. Scores beyond a long are held at its
    ends. Empty tables give an empty one. Other columns are not read, whatever their names.
    """
    vectors = written(spark, _vectors(df, id_col, vector_col, scale), "vectors")
    rotate = rotations(vectors)
    shipped = spark.sparkContext.broadcast(rotate)  # dim x dim numbers for each dimension
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("dim") * F.lit(8)), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-size["n"] // (4 * block)) if block else size["bytes"] // (4 * BLOCK_BYTES) + 1)
    dealt = vectors.repartitionByRange(parts, F.col("dim"), F.col("norm").desc(), "id").sortWithinPartitions("dim", F.col("norm").desc(), "id")
    candidates = written(spark, dealt.select("id", "dim", "v").mapInArrow(_blocks(block), _BLOCK_SCHEMA).withColumn("part", F.monotonically_increasing_id()), "candidates")
    asked = _vectors(queries, id_col, vector_col, scale).filter(F.col("dim").isin(list(rotate))).dropDuplicates(["id", "v"])
    asked_parts = max(1, -(-asked.count() // (4 * query_block)))
    grouped = asked.repartitionByRange(asked_parts, "dim", "norm", "id").sortWithinPartitions("dim", "norm", "id")
    asked = written(spark, grouped.select("id", "dim", "v").mapInArrow(_blocks(query_block), _BLOCK_SCHEMA).withColumn("block", F.monotonically_increasing_id()), "queries")
    # One row per block: its place by falling length, and the round that it is met in.
    place = F.row_number().over(Window.partitionBy("dim").orderBy("part"))
    heads = written(spark, candidates.select("dim", "part", "longest").withColumn("round", F.ceil(F.log(float(EACH), place) - 1e-9).cast("int")), "heads")
    rounds = heads.agg(F.coalesce(F.max("round"), F.lit(-1))).first()[0] + 1
    best = spark.createDataFrame([], "query_id long, block long, vec_id long, score long")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for r in range(rounds):
        found = _meet(asked, _limits(spark, asked, best, k), candidates, heads.filter(F.col("round") == r), k, shipped)
        ranked = best.unionByName(found).withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
        best = written(spark, ranked.drop("rank"), "best")  # k rows per query
    return best.withColumn("rank", F.row_number().over(own)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _limits(spark: SparkSession, asked: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """(dim, block, reach, least) of the blocks of queries: least is the score that each query has k times already, in the order of the
    block's ids; a candidate shorter than reach beats none of these."""
    last = best.groupBy("query_id", "block").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k)
    limits = last.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "score"))).alias("limits"))  # one row per query of a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, block, ids, m, known in zip(*(c.to_pylist() for c in b.columns)):
                own, known = np.frombuffer(ids, np.int64), dict(known or [])
                least = np.array([known.get(i, -_LONG) for i in own.tolist()], np.int64)
                whole = _unpacked(m, len(own) * dim).reshape(-1, dim)
                norms = np.sqrt((whole * whole).sum(axis=1))
                # A query of length zero scores zero whatever it meets: without k scores, or a least one below zero, all may matter.
                need = np.where(least <= 0, 0.0, (least.astype(np.float64) * (1 - _SLACK) - 1) / np.maximum(norms, 1e-300))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([block], pa.int64()), pa.array([float(max(0.0, need.min()))]), pa.array([least.tobytes()], pa.binary())], names=["dim", "block", "reach", "least"])

    own = asked.select("dim", "block", "ids", "m").join(limits, "block", "left").select("dim", "block", "ids", "m", "limits")
    return written(spark, own.mapInArrow(run, "dim int, block long, reach double, least binary"), "limits")


def _meet(asked: DataFrame, limits: DataFrame, candidates: DataFrame, heads: DataFrame, k: int, rotate) -> DataFrame:
    """(query_id, block, vec_id, score): each query's k best of each block of candidates that it meets, where they reach its limit.

    The pairs that meet are chosen from one row per block on each side; then the blocks of queries, the smaller ones, travel to
    the blocks of candidates.
    """
    pairs = limits.join(heads.select("dim", "part", "longest"), "dim").filter("longest >= reach").select("dim", "block", "part", "least")
    q = asked.select("dim", "block", F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    c = candidates.select("dim", "part", F.col("ids").alias("c_ids"), F.col("m").alias("c_m"))
    joined = pairs.join(q, ["dim", "block"]).join(c, ["dim", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one pair of blocks at a time
                r = b.slice(i, 1).to_pylist()[0]
                mine, theirs = _open(r["dim"], r["q_ids"], r["q_m"], rotate.value), _open(r["dim"], r["c_ids"], r["c_m"], rotate.value)
                row, ids, scores = _best(mine, theirs, k, np.frombuffer(r["least"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(mine["ids"][row], pa.int64()), pa.array([r["block"]] * len(row), pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "block", "vec_id", "score"])

    return joined.mapInArrow(run, "query_id long, block long, vec_id long, score long")


def op1_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(spark, rows, rows.filter(F.col("vec_id") % EVERY == 0))


_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS a FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.a) + 1), lambda i: q.a[i] * c.a[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id AND len(c.a) = len(q.a)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}
"""

QUERIES = {"op1_top_k_search": op1_top_k_search}
ORACLES = {"op1_top_k_search": _SQL}
