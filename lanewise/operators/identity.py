"""Organisations from raw names: exact keys, then the most similar stored name of the same country."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.functions.scalars import organisation, trigrams
from lanewise.storage import written


def candidates(shipments: DataFrame) -> DataFrame:
    """(name, country, role, raw): every party of shipments(buyer_raw, supplier_raw, origin, destination)."""
    each = F.array(F.struct(F.lit("BUYER").alias("role"), F.col("buyer_raw").alias("raw"), F.col("destination").alias("country")), F.struct(F.lit("SUPPLIER").alias("role"), F.col("supplier_raw").alias("raw"), F.col("origin").alias("country")))
    return shipments.select(F.explode(each).alias("p")).select(organisation(F.col("p.raw")).alias("name"), F.upper(F.trim("p.country")).alias("country"), "p.role", "p.raw").filter("name is not null").distinct()


def _probes(df: DataFrame, common: DataFrame, least: float, columns: list[str]) -> DataFrame:
    """(columns, t): the rarest trigrams of each name, which the last column holds, as many as leave less than its share `least` behind.

    Names with a Jaccard similarity of `least` share least * size trigrams of either, so not all of these can lie among the
    trigrams left out. There are at most 37^3 trigrams of letters, digits and blanks, so their counts are a bounded table.
    """
    each = df.select(*columns, F.explode(columns[-1]).alias("t")).join(F.broadcast(common), "t")
    sorted_ = each.groupBy(*columns).agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("own"))
    kept = F.size("own") - F.ceil(F.lit(least) * F.size("own") - 1e-9).cast("int") + 1
    return sorted_.select(*columns, F.explode(F.slice("own", F.lit(1), kept)).alias("o")).select(*columns, "o.t")


def resolve(found: DataFrame, stored: DataFrame, least: float = 0.8) -> DataFrame:
    """One row per (name, country) of found: org_id, type (BUYER, SUPPLIER or MIXED), match (EXACT, FUZZY, NEW) and variants.

    stored has (org_id, name, country, type). The id of a new organisation is a hash of its key, so a run can be repeated.
    The similarity join is on country and a rare trigram: two names that share enough trigrams share one of the rarest of
    each (`_probes`), so a common trigram pairs nobody; ties go to the smaller id.
    """
    spark = found.sparkSession  # names are cleaned once: both tables are read several times below
    stored = written(spark, stored.select("org_id", "name", "country", "type"), "organisations")
    keys = found.groupBy("name", "country").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.array_sort(F.collect_set("raw")).alias("variants"))
    exact = written(spark, keys.join(stored, ["name", "country"], "left"), "names")
    open_ = exact.filter("org_id is null").select("name", "country")
    mine = open_.withColumn("grams", trigrams(F.col("name"))).withColumn("size", F.size("grams"))
    theirs = stored.select(F.col("org_id").alias("other"), "country", trigrams(F.col("name")).alias("other_grams")).withColumn("other_size", F.size("other_grams"))
    common = mine.select("grams").unionByName(theirs.select(F.col("other_grams").alias("grams"))).select(F.explode("grams").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    left, right = _probes(mine, common, least, ["name", "country", "size", "grams"]), _probes(theirs, common, least, ["other", "country", "other_size", "other_grams"])
    near = (F.col("other_size") >= least * F.col("size")) & (F.col("size") >= least * F.col("other_size"))
    pairs = left.join(right, ["country", "t"]).filter(near).drop("t").distinct()
    shared = F.size(F.array_intersect("grams", "other_grams"))
    scored = pairs.withColumn("score", shared / (F.col("size") + F.col("other_size") - shared)).filter(F.col("score") >= least)
    best = scored.withColumn("rk", F.row_number().over(Window.partitionBy("name", "country").orderBy(F.desc("score"), "other"))).filter("rk = 1").select("name", "country", "other")
    joined = exact.join(best, ["name", "country"], "left").join(stored.select(F.col("org_id").alias("other"), F.col("type").alias("other_type")), "other", "left")
    kinds = F.array_distinct(F.concat("roles", F.when(F.coalesce("type", "other_type") == "MIXED", F.array(F.lit("BUYER"), F.lit("SUPPLIER"))).when(F.coalesce("type", "other_type").isNotNull(), F.array(F.coalesce("type", "other_type"))).otherwise(F.array().cast("array<string>"))))
    return joined.select(
        "name", "country", F.coalesce("org_id", "other", F.sha2(F.concat_ws("|", "name", "country"), 256)).alias("org_id"),
        F.when(F.size(kinds) > 1, "MIXED").otherwise(kinds[0]).alias("type"), F.when(F.col("org_id").isNotNull(), "EXACT").when(F.col("other").isNotNull(), "FUZZY").otherwise("NEW").alias("match"), "variants",
    )


def c16_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations of all customers and suppliers against the store that a load of the first year of orders left."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    found = c.select(organisation(F.col("c_name")).alias("name"), F.col("n_name").alias("country"), F.lit("BUYER").alias("role"), F.col("c_name").alias("raw")).unionByName(s.select(organisation(F.col("s_name")).alias("name"), F.col("n_name").alias("country"), F.lit("SUPPLIER").alias("role"), F.col("s_name").alias("raw")))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.year("o_orderdate").alias("year"))
    early = orders.join(orders.agg(F.min("year").alias("year")), "year").select(F.col("o_custkey").alias("c_custkey"))
    stored = c.join(early, "c_custkey", "left_semi").select(F.col("c_custkey").cast("string").alias("org_id"), organisation(F.col("c_name")).alias("name"), F.col("n_name").alias("country"), F.lit("SUPPLIER").alias("type"))
    return resolve(found, stored).groupBy("type", "match").agg(F.count("*").alias("n"))


QUERIES = {"c16_identity": c16_identity}
ORACLES = {
    "c16_identity": r"""WITH c AS (SELECT c_custkey, c_nationkey AS n, c_name, c_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = (SELECT min(year(o_orderdate)) FROM orders)) AS early FROM customer),
        w AS (SELECT *, unnest(list_filter(regexp_split_to_array(lower(c_name), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM c),
        g AS (SELECT DISTINCT c_custkey, n, early, substr('  ' || w || ' ', i, 3) AS t FROM (SELECT *, unnest(range(1, length(w) + 2)) AS i FROM w)),
        s AS (SELECT c_custkey, count(*) AS k FROM g GROUP BY 1),
        pairs AS (SELECT a.c_custkey AS mine, b.c_custkey AS other, count(*) AS shared FROM g a JOIN g b ON a.n = b.n AND a.t = b.t AND NOT a.early AND b.early GROUP BY 1, 2),
        near AS (SELECT DISTINCT mine FROM pairs JOIN s x ON x.c_custkey = mine JOIN s y ON y.c_custkey = other WHERE shared >= 0.8 * (x.k + y.k - shared))
        SELECT 'MIXED' AS type, 'EXACT' AS match, count(*) AS n FROM c WHERE early HAVING count(*) > 0
        UNION ALL SELECT 'MIXED', 'FUZZY', count(*) FROM near HAVING count(*) > 0
        UNION ALL SELECT 'BUYER', 'NEW', count(*) FROM c WHERE NOT early AND c_custkey NOT IN (SELECT mine FROM near) HAVING count(*) > 0
        UNION ALL SELECT 'SUPPLIER', 'NEW', count(*) FROM supplier HAVING count(*) > 0""",
}
