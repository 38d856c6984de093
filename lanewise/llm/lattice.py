"""SentencePiece encoding as relations only: the lattice of pieces in Spark rows, without Python.

Distinct words are exploded into substrings of bounded length and joined to the piece table, whose size the model fixes. Edges
are grouped by word, in the partitions that hold the words already, and folded with the higher-order function aggregate. For a unigram model
its state is the best score and the last edge of the paths to each place (Viterbi). For a byte-pair model it is the set of
boundaries between characters, as the bits of a long, and each step joins the two neighbours of best rank, leftmost first. Words of more than BITS characters, which a long cannot hold, are folded by PieceTable.paths.
The paths go back to the words of each text: frequent words, of which there are fewer than FREQUENT by their definition,
by a broadcast join, all others by a shuffled one in which no word of up to BITS characters has many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm._common import written
from lanewise.llm.pieces import SPACE_MARK, UNIGRAM, default_model, encoder

#: Characters whose boundaries fit a long.
BITS = 60
#: A word is frequent if it is more than one in so many words of all texts.
FREQUENT = 65_536
_WORDS = f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+"


def _little_endian(i: Column) -> Column:
    """A whole number as the hex digits of four bytes, lowest first."""
    h = F.lpad(F.hex(i), 8, "0")
    return F.concat(*[F.substring(h, at, 2) for at in (7, 5, 3, 1)])


def _boundaries(edges: Column, n: Column) -> Column:
    """The bits of the boundaries that are left when no edge joins two neighbours; edges are in the order of rank and start."""

    def best(mask: Column) -> Column:
        ready = F.filter(edges, lambda e: (e["ends"].bitwiseAND(mask) == e["ends"]) & (F.bit_count(e["inside"].bitwiseAND(mask)) == 1))
        return F.coalesce(F.get(ready, F.lit(0))["inside"], F.lit(0).cast("long"))

    def step(s: Column, _: Column) -> Column:
        mask = s["mask"].bitwiseAND(F.bitwise_not(s["take"]))
        return F.when(s["take"] == 0, s).otherwise(F.struct(mask.alias("mask"), best(mask).alias("take")))

    every = F.call_function("shiftleft", F.lit(1).cast("long"), n + 1) - 1
    return F.aggregate(F.sequence(F.lit(1), n), F.struct(every.alias("mask"), best(every).alias("take")), step)["mask"]


def _viterbi(edges: Column, n: Column, unknown: float) -> Column:
    """The bits of the boundaries on the path of the greatest sum of scores; a character without an edge scores `unknown`."""
    kind = "array<struct<score:double,size:int>>"

    def step(done: Column, at: Column) -> Column:
        into = F.filter(edges, lambda e: e["start"] + e["size"] == at)
        ways = F.transform(into, lambda e: F.struct((F.get(done, e["start"])["score"] - F.coalesce(e["rank"], F.lit(-unknown))).alias("score"), e["size"].alias("size")))
        return F.array_append(done, F.array_max(ways))

    paths = F.aggregate(F.sequence(F.lit(1), n), F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("size"))).cast(kind), step)
    one = F.lit(1).cast("long")

    def back(s: Column, _: Column) -> Column:
        at = s["at"] - F.get(s["paths"], s["at"])["size"]
        return F.when(s["at"] == 0, s).otherwise(F.struct(s["paths"].alias("paths"), at.alias("at"), s["mask"].bitwiseOR(F.call_function("shiftleft", one, at)).alias("mask")))

    begin = F.struct(paths.alias("paths"), n.alias("at"), F.call_function("shiftleft", one, n).alias("mask"))
    return F.aggregate(F.sequence(F.lit(1), n), begin, back)["mask"]


def word_paths(spark: SparkSession, words: DataFrame, model: str) -> DataFrame:
    """words with a column ids of hex digits: the packed ids of column word, whose values are distinct."""
    pieces = encoder(model).table
    known = F.broadcast(spark.createDataFrame(pieces.relation(), "piece string, id int, rank double"))  # as many rows as the model has pieces
    one = F.lit(1).cast("long")
    short = words.filter(F.char_length("word") <= BITS).withColumn("n", F.char_length("word"))
    spans = short.select("word", "n", F.explode(F.expr("sequence(0, n - 1)")).alias("start")).select("*", F.explode(F.expr(f"sequence(1, least({pieces.longest}, n - start))")).alias("size"))
    cut = spans.withColumn("piece", F.expr("substring(word, start + 1, size)"))
    edges = cut.join(known, "piece", "left").filter((F.col("size") == 1) | F.col("id").isNotNull())
    bits = edges.select("word", "n", "rank", "start", "size", "id", F.expr("shiftleft(shiftleft(1L, size - 1) - 1, start + 1)").alias("inside"), F.expr("shiftleft(1L, start) | shiftleft(1L, start + size)").alias("ends"))
    grouped = bits.groupBy("word").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "start", "size", "id", "inside", "ends"))).alias("edges"))
    fold = _viterbi(F.col("edges"), F.col("n"), pieces.unknown) if pieces.kind == UNIGRAM else _boundaries(F.filter("edges", lambda e: e["size"] > 1), F.col("n"))
    folded = grouped.withColumn("mask", fold)
    byte_ids = F.array(*[F.lit(i) for i in pieces.byte_ids])

    def own(start: Column) -> Column:
        after = F.call_function("shiftright", F.col("mask"), start + 1)
        size = F.bit_count(after.bitwiseAND(-after) - one) + 1
        edge = F.get(F.filter("edges", lambda e: (e["start"] == start) & (e["size"] == size)), F.lit(0))["id"]
        raw = F.hex(F.encode(F.call_function("substring", F.col("word"), start + 1, F.lit(1)), "utf-8"))
        fallback = F.transform(F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1), lambda k: _little_endian(F.get(byte_ids, F.conv(F.call_function("substring", raw, 2 * k + 1, F.lit(2)), 16, 10).cast("int"))))
        return F.when(edge.isNotNull(), _little_endian(edge)).otherwise(F.array_join(fallback, ""))

    heads = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(one) == 1)
    out = folded.select("word", F.array_join(F.transform(heads, own), "").alias("ids"))

    def long_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encoder(model).table.paths([w])[0].hex().upper() for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.string())], names=["word", "ids"])

    return out.unionByName(words.filter(F.char_length("word") > BITS).select("word").mapInArrow(long_words, "word string, ids string"))


def encoded_relational(spark: SparkSession, df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids) of every row, as pieces.encoded(): ids is a binary of little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Repeated rows stay; an empty table gives an empty one. Other columns are not read.
    """
    model = model or default_model()
    marked = F.concat(F.lit(SPACE_MARK), F.replace(F.col(text_col), F.lit(" "), F.lit(SPACE_MARK)))
    words = F.when(F.col(text_col) != "", F.regexp_extract_all(marked, F.lit(_WORDS), F.lit(0)))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words.alias("words"))
    placed = rows.select("row", F.posexplode("words").alias("pos", "word"))
    counts = written(spark, placed.groupBy("word").agg(F.count("*").alias("times")), "words")
    paths = written(spark, word_paths(spark, counts.repartition("word"), model).join(counts, "word"), "paths")
    total = counts.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    often = (F.col("times") * FREQUENT > total) & (F.char_length("word") <= BITS)
    hot = F.broadcast(paths.filter(often).select("word", "ids"))  # fewer than FREQUENT words of at most BITS characters
    found = placed.join(hot, "word").unionByName(placed.join(hot, "word", "left_anti").join(paths.filter(~often).select("word", "ids"), "word"))
    joined = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("own"))
    packed = joined.select("row", F.unhex(F.array_join(F.transform("own", lambda o: o["ids"]), "")).alias("ids"))
    out = rows.select("row", "id").join(packed, "row", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("ids", F.lit(b"")).alias("ids"))
