"""Ranks over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.plans import portable

#: Parts that the values are cut into; no result depends on it.
PARTS = 64


def ranked(df: DataFrame, by: str, descending: bool = False, parts: int = PARTS) -> DataFrame:
    """df with a column rank: one more than the rows with a smaller value of column by (greater if descending); nulls have none.

    Equal values are counted first, so a value that very many rows share is one row. Sampled splitters cut the values into
    parts; each part numbers its own, and the sums of the parts before it, a row per part, are added.
    """
    counts = df.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("v")).agg(F.count("*").alias("n"))
    cuts = counts.agg(F.percentile_approx("v", [(k + 1) / parts for k in range(parts - 1)], 1000).alias("cuts"))
    placed = counts.join(F.broadcast(cuts)).select("v", "n", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("v"))), F.lit(0)).alias("part"))
    order = F.desc("v") if descending else F.asc("v")
    inside = placed.withColumn("inside", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = placed.groupBy("part").agg(F.sum("n").alias("m"))  # at most as many rows as parts
    other = sums.select(F.col("part").alias("other"), "m")
    ahead = (F.col("other") > F.col("part")) if descending else (F.col("other") < F.col("part"))
    before = sums.select("part").join(F.broadcast(other), ahead, "left").groupBy("part").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("before"))
    ranks = inside.join(F.broadcast(before), "part").select(F.col("v").alias(by), (F.col("inside") + F.col("before") + 1).alias("rank"))
    return df.join(ranks, by, "left")


_VALUE = "SELECT {who}, CAST(sum(value_usd) AS DOUBLE) AS value_usd FROM ledger WHERE {who} IS NOT NULL GROUP BY {who}"


def w05_global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(portable.run(spark, sf_dir, _VALUE.format(who="supplier_id")), "value_usd", descending=True).select("supplier_id", F.col("rank").alias("rk"))


def w08_share_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = portable.run(spark, sf_dir, _VALUE.format(who="buyer_id"))
    return ranked(df, "value_usd").join(F.broadcast(df.agg(F.count("*").alias("n")))).select("buyer_id", F.round((F.col("rank") - 1) / F.col("n"), 6).alias("below"))


QUERIES = {"w05_global_rank": w05_global_rank, "w08_share_below": w08_share_below}
ORACLES = {
    "w05_global_rank": portable.oracle_sql("SELECT supplier_id, rank() OVER (ORDER BY value_usd DESC) AS rk FROM (SELECT supplier_id, CAST(sum(value_usd) AS DOUBLE) AS value_usd FROM ledger GROUP BY 1) x"),
    "w08_share_below": portable.oracle_sql("SELECT buyer_id, round(CAST(rank() OVER (ORDER BY value_usd) - 1 AS DOUBLE) / count(*) OVER (), 6) AS below FROM (SELECT buyer_id, CAST(sum(value_usd) AS DOUBLE) AS value_usd FROM ledger WHERE buyer_id IS NOT NULL GROUP BY 1) x"),
}
