"""Stages of a corpus pipeline: each takes the documents that its predecessor kept, as a stored table.

Documents have the columns doc_id, text, lang, source and n_chars; other columns are not kept. A stage deletes the scratch
tables of the stages before it, whose results are stored by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm._common import drop_scratch, table
from lanewise.llm.packing import packed
from lanewise.llm.secrets import redacted, secret_spans
from lanewise.llm.simhash import survivors
from lanewise.llm.suffix import remove_repeats
from lanewise.llm.toxicity import TOXIC_AT, toxicity_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_AT, as they are."""
    drop_scratch(spark)
    scored = toxicity_scores(spark, docs, table(spark, sf_dir, "labels"), keep=COLUMNS[1:])
    return scored.filter(F.col("score") < TOXIC_AT).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the least by id, fingerprint and a hash of its columns; rows without an id stay.

    An id on rows with different texts keeps one of them for each group that it is the least of.
    """
    drop_scratch(spark)
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]).alias("row"))
    own = rows.join(survivors(spark, rows, "row"), ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
    return own.select(*COLUMNS).unionByName(docs.select(*COLUMNS).filter("doc_id is null"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the long strings that occur elsewhere."""
    drop_scratch(spark)
    cut = remove_repeats(spark, docs, keep=["lang", "source"])
    return _with_text(cut.withColumnRenamed("kept_text", "text"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by the names of their rules."""
    drop_scratch(spark)
    spans = secret_spans(spark, docs, keep=["lang", "source"])
    return _with_text(spans.withColumn("text", redacted(F.col("text"), F.col("found"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training sequence."""
    drop_scratch(spark)
    return packed(spark, docs)
