"""Quality rules with thresholds that follow the corpus.

Every rule measures a document as a whole number. A mergeable quantile sketch holds the measures of each language and
source: a histogram of log-linear buckets (6 significant bits, so a quantile is off by 1 part in 32 at most). Sketches
merge by adding counts, in any order and to any level, so small groups use the sketch of their language, or of the whole
corpus. A rule's threshold is a high quantile of the group's own sketch, with no constant beside it: most measures are zero
almost everywhere, so quartiles say nothing of them. The thresholds are joined back to the documents.

DataFrame and SQL functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm._common import SPACE, table, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Documents that a group needs for a sketch of its own.
MIN_GROUP = 100
RULES = ["symbols_pm", "dup_lines_pm", "repeat_pm", "word_length_pc"]
#: A rule accepts what is at most this percentile of the group: the greatest measure of the bucket it falls in, so that
#: equal documents of a group fare alike.
FENCE = 95


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, lang, source, n_words and the counts the rules are made of."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = df.select(
        F.col(id_col).alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), 1).alias("words"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]")).alias("lines"),
    )
    # A window is the 64-bit hash of its words; the sizes of an array and of its distinct values tell if any repeats.
    windows = words.withColumn("windows", F.expr("CASE WHEN size(words) > 3 THEN transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) ELSE array() END"))
    by_window = windows.withColumn("by_window", F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN sort_array(transform(windows, (w, i) -> struct(w, i))) ELSE array() END"))
    # Windows stand side by side after the sort, so each needs a look at its neighbours only.
    repeated = "filter(transform(by_window, (x, k) -> CASE WHEN get(by_window, k - 1).w = x.w OR get(by_window, k + 1).w = x.w THEN x.i END), i -> i IS NOT NULL)"
    return by_window.select(
        "id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"cast(size(array_distinct(flatten(transform({repeated}, i -> array(i, i + 1, i + 2))))) AS long)").alias("n_repeat_words"),
    )


def _rated(stats: DataFrame) -> DataFrame:
    per = lambda top, below, times: F.expr(f"CASE WHEN {below} > 0 THEN {times} * {top} div {below} ELSE 0L END")
    return stats.withColumns({
        "symbols_pm": per("n_symbols", "n_words", 1000), "dup_lines_pm": per("n_dup_lines", "n_lines", 1000),
        "repeat_pm": per("n_repeat_words", "n_words", 1000), "word_length_pc": per("word_chars", "n_words", 100),
        "base_failed": F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
    })


def sketches(rated: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): the sketch of every language and source."""
    each = rated.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in RULES])).alias("m")).select("lang", "source", "m.rule", "m.v")
    bucket = F.expr("CASE WHEN v < 64 THEN v ELSE shiftleft(shiftright(v, length(bin(v)) - 6), length(bin(v)) - 6) END")
    return each.groupBy("lang", "source", "rule", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, n, most) of a sketch merged to keys: its documents, and the highest measure it accepts."""
    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys, "rule")  # the buckets of one sketch: a few hundred rows at most
    ranked = merged.select(*keys, "rule", "bucket", F.sum("n").over(own.orderBy("bucket")).alias("upto"), F.sum("n").over(own).alias("total"))
    fence = ranked.groupBy(*keys, "rule").agg(F.max("total").alias("n"), F.min(F.when(F.expr(f"100 * upto >= {FENCE} * total"), F.col("bucket"))).alias("bucket"))
    return fence.withColumn("most", F.expr("CASE WHEN bucket < 64 THEN bucket ELSE bucket + shiftleft(1L, length(bin(bucket)) - 6) - 1 END")).drop("bucket")


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, one column per rule): the highest measure that each group accepts."""
    by_group, by_lang, by_all = (_fences(sketch, keys) for keys in (["lang", "source"], ["lang"], []))
    q = lambda df, name: df.select(*[c for c in ("lang", "source", "rule") if c in df.columns], F.struct("n", "most").alias(name))
    used = F.when(F.col("g.n") >= min_group, F.col("g")).when(F.col("l.n") >= min_group, F.col("l")).otherwise(F.col("a"))
    chosen = q(by_group, "g").join(q(by_lang, "l"), ["lang", "rule"]).join(q(by_all, "a"), ["rule"]).select("lang", "source", "rule", used.alias("u"))
    return chosen.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r, F.col("u.most"))).alias(f"most_{r}") for r in RULES])


def quality_verdicts(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_group: int = MIN_GROUP) -> DataFrame:
    """One row per row of df: id_col, the counts, the measures, their thresholds, base_failed and kept.

    df has the columns lang and source; null counts as an empty name there, and a null text as empty. Documents without
    words fail. Repeated rows stay and count each time; an empty table gives an empty one. Other columns are not read.
    """
    stats = written(spark, _rated(measures(df, id_col, text_col)), "measures")
    limits = written(spark, thresholds(written(spark, sketches(stats), "sketches"), min_group), "thresholds")
    joined = stats.join(limits, ["lang", "source"])
    fits = [F.col(r) <= F.col(f"most_{r}") for r in RULES]
    kept = ~F.col("base_failed")
    for f in fits:
        kept = kept & f
    return joined.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *RULES, *[f"most_{r}" for r in RULES])


def op2_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark, table(spark, sf_dir, "documents"))


_RULES_SQL = ", ".join(f"('{r}')" for r in RULES)
_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win), (VALUES (0), (1), (2)) AS s(k)
  WHERE c > 1 GROUP BY rid),
stats AS (
  SELECT d.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
rated AS (
  SELECT *, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbols_pm,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines_pm,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_pm,
         CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length_pc,
         n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM stats),
each AS (
  SELECT lang, source, rule, CASE rule WHEN 'symbols_pm' THEN symbols_pm WHEN 'dup_lines_pm' THEN dup_lines_pm WHEN 'repeat_pm' THEN repeat_pm ELSE word_length_pc END AS v
  FROM rated, (VALUES {_RULES_SQL}) AS r(rule)),
b AS (SELECT lang, source, rule, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bucket FROM each),
level AS (
  SELECT 1 AS l, lang, source, rule, bucket, count(*) AS n FROM b GROUP BY lang, source, rule, bucket
  UNION ALL SELECT 2, lang, NULL, rule, bucket, count(*) FROM b GROUP BY lang, rule, bucket
  UNION ALL SELECT 3, NULL, NULL, rule, bucket, count(*) FROM b GROUP BY rule, bucket),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY l, lang, source, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY l, lang, source, rule) AS total FROM level),
q AS (
  SELECT l, lang, source, rule, max(total) AS n, min(CASE WHEN 100 * upto >= {FENCE} * total THEN bucket + CASE WHEN bucket < 64 THEN 0 ELSE (1 << (length(bin(bucket)) - 6)) - 1 END END) AS most
  FROM cum GROUP BY l, lang, source, rule),
fence AS (
  SELECT g.lang, g.source, g.rule, CASE WHEN g.n >= {MIN_GROUP} THEN g.most WHEN x.n >= {MIN_GROUP} THEN x.most ELSE a.most END AS most
  FROM q g JOIN q x ON x.l = 2 AND x.lang = g.lang AND x.rule = g.rule JOIN q a ON a.l = 3 AND a.rule = g.rule WHERE g.l = 1),
most AS (
  SELECT lang, source, {", ".join(f"max(CASE WHEN rule = '{r}' THEN most END)::BIGINT AS most_{r}" for r in RULES)} FROM fence GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(f"{r} <= most_{r}" for r in RULES)} AS kept, {", ".join(RULES)}, {", ".join(f"most_{r}" for r in RULES)}
FROM rated JOIN most USING (lang, source)
"""

QUERIES = {"op2_adaptive_quality": op2_adaptive_quality}
ORACLES = {"op2_adaptive_quality": _SQL}
