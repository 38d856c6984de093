"""Secret scans behind a trigram inverted index.

Each rule is a regular expression. A Boolean trigram query is derived from it: any match holds all trigrams of at least
one of its conjunctions. The index has a posting (trigram, document) for the trigrams of the queries; postings are
intersected per conjunction, and only the candidates are verified with the rule's expression. A rule without mandatory
trigrams scans every document.

DataFrame and SQL functions only: Python reads the expressions on the driver, and no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as sre

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm._common import table, written


@dataclass(frozen=True)
class Rule:
    """kind: its name in spans. pattern: for Java and RE2 alike. value, least: the group whose length in code points is tested."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1


BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # Runs are maximal, so a least length inside the expression drops the same matches as a test afterwards.
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
]
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
]
RULES = BASE + MORE
#: Strings that a part of an expression may stand for before the part counts as anything.
ALTERNATIVES = 64


def _finite(part: tuple) -> list[str] | None:
    """All strings that a parsed part matches, or None if they are too many."""
    op, arg = str(part[0]), part[1]
    if op == "LITERAL":
        return [chr(arg)]
    if op == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
        return [chr(a) for _, a in arg]
    if op == "SUBPATTERN":
        return _language(arg[3])
    if op == "BRANCH":
        each = [_language(x) for x in arg[1]]
        return None if None in each else [s for e in each for s in e]
    if op == "MAX_REPEAT" and arg[1] != sre.MAXREPEAT and int(arg[1]) <= 2:
        once = _language(arg[2])
        return None if once is None else ["".join(t) for n in range(int(arg[0]), int(arg[1]) + 1) for t in product(once, repeat=n)]
    return None


def _language(parts) -> list[str] | None:
    out = [""]
    for p in parts:
        one = _finite(p)
        if one is None or len(out) * len(one) > ALTERNATIVES:
            return None
        out = [a + b for a in out for b in one]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Conjunctions of lower-case trigrams, one of which every match holds whole; empty if none is mandatory."""
    runs, run = [], [""]
    for p in [*sre.parse(pattern), None]:
        one = _finite(p) if p is not None else None
        if one is None or len(run) * len(one) > ALTERNATIVES:
            runs.append(run)
            run = one if one is not None else [""]
        else:
            run = [a + b for a in run for b in one]
    runs.append(run)
    best: list[frozenset[str]] = []
    for r in runs:
        grams = {frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in r}
        if frozenset() not in grams and (not best or min(map(len, grams)) > min(map(len, best))):
            best = sorted((g for g in grams if not any(h < g for h in grams)), key=sorted)
    return best


def _keyed(df: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit("again")).alias("k2"), F.struct(F.lit(0).alias("_"), *[F.col(k) for k in keep]).alias("more"))


def candidates(spark: SparkSession, keyed: DataFrame, rules: list[Rule]) -> DataFrame:
    """(k1, k2, rules): the indexed rules whose trigram query each text fulfils. Copies of a text share its key."""
    asked = [(r.kind, i, g) for r in rules for i, c in enumerate(trigram_query(r.pattern)) for g in sorted(c)]
    grams = sorted({g for *_, g in asked})
    if not grams:
        return spark.createDataFrame([], "k1 long, k2 long, rules array<string>")
    folded = keyed.select("k1", "k2", F.lower("text").alias("text"))
    found = F.filter(F.array(*[F.when(F.contains("text", F.lit(g)), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    postings = folded.select("k1", "k2", F.explode(found).alias("gram")).distinct()
    query = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("part"), F.lit(g).alias("gram")) for k, i, g in asked]))
    query = spark.range(1).select(query.alias("q")).select("q.*")
    whole = query.groupBy("kind", "part").agg(F.count("*").alias("needed"))
    hit = postings.join(F.broadcast(query), "gram").groupBy("k1", "k2", "kind", "part").agg(F.count("*").alias("had"))  # the queries: a fixed table
    return hit.join(F.broadcast(whole), ["kind", "part"]).filter("had = needed").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("kind")).alias("rules"))


def _matches(rule: Rule, order: int) -> Column:
    """array<struct<start, rank, kind, stop>> of a rule's matches in text, leftmost and not overlapping."""
    pattern, empty = F.lit(rule.pattern), "array<struct<start:int,rank:int,kind:string,stop:int>>"
    gaps = F.transform(F.split("text", rule.pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all("text", pattern, 0), F.length)
    values = F.transform(F.regexp_extract_all("text", pattern, rule.value), F.length)
    parts = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), values.alias("value"))  # one gap more than matches
    start = F.struct(F.lit(0).alias("at"), F.array().cast(empty).alias("out"))

    def step(state: Column, p: Column) -> Column:
        at = state["at"] + p["gap"]
        span = F.struct(at.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), (at + p["size"]).alias("stop"))
        fits = p["size"].isNotNull() & (p["value"] >= rule.least)
        return F.struct((at + F.coalesce(p["size"], F.lit(0))).alias("at"), F.when(fits, F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

    return F.when(F.rlike("text", pattern), F.aggregate(parts, start, step, lambda s: s["out"])).otherwise(F.array().cast(empty))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_spans(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per row of df: id_col, found (array of start, rank, kind, stop in code points, by start and then rank) and text.

    A null or empty text has no spans. Rows with equal texts have equal spans; repeated rows stay. keep names further
    columns to carry along; others are not read.
    """
    rules = RULES if rules is None else rules
    keyed = _keyed(df, id_col, text_col, keep or [])
    asked = written(spark, candidates(spark, keyed, rules), "candidates")
    joined = keyed.join(asked, ["k1", "k2"], "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>")
    each = []
    for order, rule in enumerate(rules):
        found = _matches(rule, order)
        each.append(F.when(F.array_contains("rules", rule.kind), found).otherwise(none) if trigram_query(rule.pattern) else found)
    return joined.select(F.col("id").alias(id_col), "text", F.sort_array(F.concat(*each)).alias("found"), *[F.col(f"more.`{k}`").alias(k) for k in keep or []])


def redacted(text: Column, found: Column) -> Column:
    """The text with every span replaced by the name of its rule in brackets; of overlapping spans the first names them."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        hidden = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.concat(F.lit("["), x["kind"], F.lit("]")))
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when(x["start"] >= s["at"], hidden).otherwise(s["out"]).alias("out"))

    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_spans(spark, table(spark, sf_dir, "documents"))
    n = [F.expr(f"cast(size(filter(found, s -> s.kind = '{r.kind}')) AS long)").alias(f"n_{r.kind}") for r in BASE]
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return spans.select("doc_id", *n, F.sha2(_line(base).cast("binary"), 256).alias("base_sha256"), _line(F.col("found")).alias("spans"))


def _oracle() -> str:
    quote = lambda s: s.replace("'", "''")
    one = """SELECT rid, {order} AS rank, '{kind}' AS kind, list_sum([0] || list_transform(gaps[1:k], lambda x: length(x))) + list_sum([0] || list_transform(ms[1:k - 1], lambda x: length(x))) AS start, length(ms[k]) AS size
      FROM (SELECT rid, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {value}) AS vs, unnest(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1)) AS k FROM d WHERE regexp_matches(t, '{p}'))
      WHERE length(vs[k]) >= {least}"""
    parts = " UNION ALL ".join(one.format(order=i, kind=r.kind, p=quote(r.pattern), value=r.value, least=r.least) for i, r in enumerate(RULES))
    word = "kind || ':' || start || ':' || (start + size)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in BASE)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({parts}),
    s AS (SELECT rid, {counts}, coalesce(string_agg({word}, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}), '') AS base, string_agg({word}, ',' ORDER BY start, rank) AS spans FROM m GROUP BY rid)
    SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN s USING (rid)"""


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLES = {"op9_secret_scan": _oracle()}
