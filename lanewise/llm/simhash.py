"""SimHash near-duplicates by vantage-point trees.

Equal fingerprints are one point. A vantage-point tree, built on a bounded sample of the points, cuts Hamming space
into shards; every point has one home shard, and a copy of it visits each shard that its ball of `max_bits` may reach
by the triangle bound. A shard with far more points than its target has a tree of its own, fitted on its own points, and so
on, so the shards stay small however many points there are. Inside a shard a local tree prunes the same way and XOR + popcount
decides. A shard that no vantage point cuts is dealt into chunks that meet pairwise, so no task holds an unbounded shard. Each task returns a spanning
forest of the links it finds, never all pairs; the components are then joined across shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm._common import lean, sliced, table, written
from lanewise.llm.graph import connected_components

if TYPE_CHECKING:
    import pandas as pd

#: Points that the routing tree is fitted on, at most; every point is indexed.
SAMPLE = 65_536
#: Points at home in a shard that the tree aims for, and of a chunk.
SHARD = 1024
CHUNK = 2048
VISITORS = 8192
#: Points at home from which a shard gets a tree of its own, points that this tree is fitted on, and trees above one another.
SPLIT, SPLIT_SAMPLE, LEVELS = 8192, 8192, 4
#: Points that a task routes through the tree of a shard.
ROUTED = 65_536
SHINGLE = 3
SEED = 42
_SLICE = 65_536


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the 3-word shingles, as a signed integer; zero for a text without words."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, and only space and 0x09-0x0D separate
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):  # a very long text is hashed in slices, so its memory stays bounded
        part = words[at : min(n, at + _SLICE) + SHINGLE - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, fp) of every row, and row if row_col is given; a null text counts as one without words."""
    rows = ["row"] if row_col else []

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64()), *b.columns[2:]], names=["id", "fp", *rows])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *[F.col(row_col).alias(r) for r in rows]).mapInArrow(run, "id long, fp long" + ", row long" * len(rows))


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def _vantage(points: np.ndarray, radius: int, tries: int = 8) -> tuple[np.uint64, int, float] | None:
    """Vantage point and cut with the least mass near the cut; None where no cut leaves points on both sides."""
    best = None
    for v in points[:: max(1, len(points) // tries)][:tries]:
        d = _distance(points, v)
        mu = int(np.median(d))
        mu = mu if (d > mu).any() else mu - 1
        if mu < 0 or not (d <= mu).any():
            continue
        near = float(((d > mu - radius) & (d <= mu + radius)).mean())
        if best is None or near < best[2]:
            best = (v, mu, near)
    return best


def build_tree(sample: np.ndarray, leaf: int, radius: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, cut, inner, outer) in a list; a leaf is (-1, -1, shard, -1). The root is node 0."""
    nodes: list[tuple[int, int, int, int]] = []
    shards = 0
    todo = [(np.unique(sample), -1, False)]
    while todo:
        points, parent, outer = todo.pop()
        me = len(nodes)
        if parent >= 0:
            v, mu, a, b = nodes[parent]
            nodes[parent] = (v, mu, a, me) if outer else (v, mu, me, b)
        cut = _vantage(points, radius) if len(points) > leaf else None
        if cut is None or cut[2] > 0.8:  # a ball too small to cut: its shard is chunked instead
            nodes.append((-1, -1, shards, -1))
            shards += 1
            continue
        nodes.append((int(cut[0]), cut[1], -1, -1))
        d = _distance(points, cut[0])
        todo += [(points[d > cut[1]], me, True), (points[d <= cut[1]], me, False)]
    return nodes


def route(nodes: list[tuple[int, int, int, int]], points: np.ndarray, radius: int, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point index, shard, at home) for every shard that a point lives in or visits; home tells visitors from those at home at the root.

    Of two linked points on both sides of a cut, only the inner one visits the outer side; the visit then follows
    every branch that its ball may reach.
    """
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    todo = [(0, np.arange(len(points)), np.ones(len(points), bool) if home is None else home)]
    while todo:
        at, idx, home = todo.pop()
        if not len(idx):
            continue
        v, mu, inner, outer = nodes[at]
        if mu < 0:
            out.append((idx, inner, home))
            continue
        d = _distance(points[idx], np.uint64(v))
        goes_in = np.where(home, d <= mu, d <= mu + radius)
        goes_out = d > mu - radius
        todo += [(inner, idx[goes_in], home[goes_in]), (outer, idx[goes_out], home[goes_out] & (d[goes_out] > mu))]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return np.concatenate([o[0] for o in out]), np.concatenate([np.full(len(o[0]), o[1]) for o in out]), np.concatenate([o[2] for o in out])


def linked(a: np.ndarray, b: np.ndarray, radius: int, small: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with a[i] and b[j] at most radius bits apart, by a local vantage-point tree over b."""
    todo = [(np.arange(len(a)), np.arange(len(b)))]
    while todo:
        i, j = todo.pop()
        if not len(i) or not len(j):
            continue
        cut = _vantage(b[j], radius, 2) if len(i) * len(j) > small else None
        if cut is not None:
            da, db = _distance(a[i], cut[0]), _distance(b[j], cut[0])
            inner, outer = (i[da <= cut[1] + radius], j[db <= cut[1]]), (i[da > cut[1] - radius], j[db > cut[1]])
            if len(inner[0]) * len(inner[1]) + len(outer[0]) * len(outer[1]) < 0.9 * len(i) * len(j):
                todo += [inner, outer]
                continue
        rows = max(1, small // len(j))
        for at in range(0, len(i), rows):
            x, y = np.nonzero(np.bitwise_count(a[i[at : at + rows]][:, None] ^ b[j][None, :]) <= radius)
            if len(x):
                yield i[at + x], j[y]


def _forest(task: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Edges (src, dst) from each linked point of a task to the least point it is linked to."""
    import pandas as pd

    left, right = (task[task["side"] == s]["fp"].to_numpy() for s in (0, 1))
    own = len(right) == 0
    b = left if own else right
    points, where = np.unique(np.concatenate([left, b]), return_inverse=True)
    least, ia, ib = np.arange(len(points)), where[: len(left)], where[len(left) :]
    for x, y in linked(left.view(np.uint64), b.view(np.uint64), radius):
        s, t = ia[x], ib[y]
        keep = s != t
        s, t = s[keep], t[keep]
        while len(s):  # union by pointer jumping, in arrays
            rs, rt = least[s], least[t]
            differ = rs != rt
            if not differ.any():
                break
            s, t, rs, rt = s[differ], t[differ], rs[differ], rt[differ]
            np.minimum.at(least, np.maximum(rs, rt), np.minimum(rs, rt))
            while (least[least] != least).any():
                least = least[least]
    moved = np.flatnonzero(least != np.arange(len(points)))
    return pd.DataFrame({"src": points[moved], "dst": points[least[moved]]})


def _split(spark: SparkSession, visits: DataFrame, large: DataFrame, radius: int, shard: int) -> DataFrame:
    """visits (fp, shard, home) with the shards of large (shard, n points at home) cut by trees of their own.

    The tree of a shard is fitted in one task on about SPLIT_SAMPLE of its points; its points are dealt to tasks of ROUTED.
    New names of shards are hashes: if two agreed, their points would only be compared without need.
    """
    import pandas as pd

    def fit(points: pd.DataFrame) -> pd.DataFrame:
        own = points["fp"].to_numpy()
        nodes = build_tree(own.view(np.uint64), max(8, int(shard * len(own) / points["n"].iloc[0])), radius)
        flat = np.array([(v if v < 1 << 63 else v - (1 << 64), mu, a, b) for v, mu, a, b in nodes], np.int64)
        return pd.DataFrame({"shard": [points["shard"].iloc[0]], "nodes": [flat.tobytes()]})

    def routed(points: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        nodes = [(v % (1 << 64), mu, a, b) for v, mu, a, b in np.frombuffer(tree["nodes"].iloc[0], np.int64).reshape(-1, 4).tolist()]
        fp = points["fp"].to_numpy()
        i, s, home = route(nodes, fp.view(np.uint64), radius, points["home"].to_numpy())
        return pd.DataFrame({"fp": fp[i], "shard": points["shard"].to_numpy()[i], "part": s, "home": home})

    mine = visits.join(large, "shard")
    some = mine.filter("home").filter(F.pmod(F.xxhash64("fp", F.lit("split")), F.lit(1 << 20)) * F.col("n") < float(SPLIT_SAMPLE << 20))
    trees = written(spark, some.groupBy("shard").applyInPandas(fit, "shard long, nodes binary"), "trees")
    salts = F.ceil(F.col("n") / ROUTED).cast("int")
    dealt = mine.join(trees.select("shard"), "shard", "left_semi").select("fp", "shard", "home", F.pmod(F.xxhash64("fp", F.lit("deal")), salts).cast("int").alias("salt"))
    copied = trees.join(large, "shard").select("shard", "nodes", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    cut = dealt.groupBy("shard", "salt").cogroup(copied.groupBy("shard", "salt")).applyInPandas(lambda p, t: routed(p, t) if len(p) and len(t) else pd.DataFrame({"fp": np.empty(0, np.int64), "shard": np.empty(0, np.int64), "part": np.empty(0, np.int64), "home": np.empty(0, bool)}), "fp long, shard long, part long, home boolean")
    rest = visits.join(trees.select("shard"), "shard", "left_anti")
    return written(spark, rest.select("fp", "shard", "home").unionByName(cut.select("fp", F.xxhash64("shard", "part").alias("shard"), "home")), "visits")


def links(spark: SparkSession, points: DataFrame, radius: int, shard: int = SHARD, chunk: int = CHUNK, visitors: int = VISITORS) -> DataFrame:
    """points (fp long, distinct): edges (src, dst) whose components are those of all links within radius bits."""
    n = points.count()
    share = min(1.0, SAMPLE / max(1, n))
    some = points.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * SAMPLE)
    sample = np.array([r["fp"] for r in some.toLocalIterator()], np.int64).view(np.uint64)
    nodes = build_tree(sample, max(8, int(shard * share)), radius)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            i, s, home = route(nodes, fp.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(fp[i], pa.int64()), pa.array(s, pa.int64()), pa.array(home)], names=["fp", "shard", "home"])

    visits = written(spark, points.select("fp").mapInArrow(routed, "fp long, shard long, home boolean"), "visits")
    kept = None  # shards that no tree cuts further
    for _ in range(LEVELS):
        count = visits.groupBy("shard").agg(F.count_if("home").alias("n"))
        large = count.filter(F.col("n") > SPLIT)
        large = written(spark, large if kept is None else large.join(kept, ["shard", "n"], "left_anti"), "large")
        if large.isEmpty():
            break
        visits = _split(spark, visits, large, radius, shard)
        # A shard that came out as it went in has another name and the same size.
        kept = large.select(F.xxhash64("shard", F.lit(0).cast("long")).alias("shard"), "n")
    sizes = written(spark, visits.groupBy("shard").agg(F.ceil(F.count_if("home") / chunk).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("home")) / visitors).cast("int").alias("guests")), "sizes")
    chunked = visits.join(sizes.filter("homes > 0"), "shard")
    own = F.pmod(F.xxhash64("fp"), F.col("homes")).cast("int")
    guest = F.pmod(F.xxhash64("fp"), F.greatest(F.lit(1), "guests")).cast("int")
    every, guests = F.sequence(F.lit(0), F.col("homes") - 1), F.when(F.col("guests") > 0, F.sequence(F.lit(0), F.col("guests") - 1)).otherwise(F.array().cast("array<int>"))
    at_home = F.concat(
        F.transform(every, lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own <= j, 0).otherwise(1).alias("side"))),
        F.transform(guests, lambda k: F.struct((-1 - k).alias("i"), own.alias("j"), F.lit(1).alias("side"))),
    )
    visiting = F.transform(every, lambda j: F.struct((-1 - guest).alias("i"), j.alias("j"), F.lit(0).alias("side")))
    tasks = chunked.select("fp", "shard", F.explode(F.when(F.col("home"), at_home).otherwise(visiting)).alias("t")).select("fp", "shard", "t.i", "t.j", "t.side")
    return tasks.groupBy("shard", "i", "j").applyInPandas(lambda task: _forest(task, radius), "src long, dst long")


def _members(spark: SparkSession, grouped: DataFrame, max_bits: int, shard: int, chunk: int, visitors: int) -> DataFrame:
    """grouped (fp distinct, least): (fp, least, component) after linking."""
    points = written(spark, grouped, "points")
    joined = written(spark, connected_components(spark, links(spark, points.select("fp"), max_bits, shard, chunk, visitors)), "joined")
    return written(spark, points.join(joined, points["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "member")


def near_duplicates(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, shard: int = SHARD, chunk: int = CHUNK, visitors: int = VISITORS) -> DataFrame:
    """One row per row of df: (id_col long, fingerprint string of 16 hex digits, component_id long).

    Rows link where their fingerprints differ in at most max_bits bits; component_id is the least id reachable. A null
    or empty text has fingerprint zero and links like any other. A null id keeps its row, names no component, and has a
    null component_id only where no row of its component has an id. Repeated rows stay; an empty table gives an empty
    one. Other columns of df are not read.
    """
    prints = written(spark, with_fingerprints(df, id_col, text_col), "prints")
    member = _members(spark, prints.groupBy("fp").agg(F.min("id").alias("least")), max_bits, shard, chunk, visitors)
    names = written(spark, member.groupBy("component").agg(F.min("least").alias("component_id")), "names")
    named = written(spark, member.select("fp", "component").join(names, "component").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(spark: SparkSession, df: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, shard: int = SHARD, chunk: int = CHUNK, visitors: int = VISITORS) -> DataFrame:
    """(id_col, row_col): one row of each component that has an id: the least (id, fingerprint, row_col).

    row_col is a long that tells rows of one id apart. Components are told apart by their links, not by their least id:
    rows of one id with different texts may stand for several.
    """
    prints = written(spark, with_fingerprints(df, id_col, text_col, row_col), "prints")
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "fp", "row"))).alias("least")
    member = _members(spark, prints.groupBy("fp").agg(least), max_bits, shard, chunk, visitors)
    best = member.groupBy("component").agg(F.min("least").alias("least")).filter("least is not null")
    return best.select(F.col("least.id").alias(id_col), F.col("least.row").alias(row_col))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash_near_dedup": op4_simhash_near_dedup}
ORACLES: dict[str, str] = {}
