"""URL filters whose decisions follow redirects.

Rules (host, path, action) judge a URL by the longest rule that fits. Pages are joined with the rules on the suffixes of
their host. URLs that lead to each other, by a canonical link or a redirect in the page, are aliases: connected components
over these links. A URL that no rule judges is blocked if a rule blocks one of its aliases; an explicit allow always wins.
Two URLs are one resource only if they differ in nothing but the fragment, the case of scheme and host, or an empty path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm._common import table, written
from lanewise.llm.graph import connected_components

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Elements whose content is no markup, and comments.
HIDDEN = "|".join([r"<!--.*?(?:-->|\z)", *[rf"<{e}\b.*?(?:</{e}\b|\z)" for e in ("script", "style", "template", "textarea", "title")]])
TAG = r"<(?:link|meta|base)\b[^>]*>"
REFRESH = r"""^[\s\d.]*[;,]?\s*url\s*=\s*["']?(.*?)["']?\s*$"""
#: Character references in attributes, each with what it stands for; the ampersand last.
REFERENCES = [("&quot;|&#34;|&#x22;", '"'), ("&apos;|&#39;|&#x27;", "'"), ("&lt;|&#60;|&#x3c;", "<"), ("&gt;|&#62;|&#x3e;", ">"), ("&amp;|&#38;|&#x26;", "&")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _origin(url: Column) -> Column:
    return F.concat(F.lower(F.regexp_extract(url, "(?s)^(.*?)://", 1)), F.lit("://"), host_of(url))


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)


def url_key(url: Column) -> Column:
    """Name of a resource: scheme, host, path (`/` if empty) and query."""
    path = path_of(url)
    return F.concat(_origin(url), F.when(path == "", "/").otherwise(path), _query(url))


def _without_dots(path: Column) -> Column:
    """A path whose segments `.` and `..` are resolved."""

    def step(done: Column, s: Column) -> Column:
        parent = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(s == "..", parent).when(s == ".", done).otherwise(F.array_append(done, s))

    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    slash = F.when(path.rlike(r"(^|/)\.\.?$"), "/").otherwise("")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), slash)).otherwise(path)


def resolved(base: Column, link: Column) -> Column:
    """A link as it stands in a page at base, as a whole URL, without its fragment; null if it leads to no host."""
    own = F.regexp_replace(link, "(?s)#.*$", "")
    path, query = F.regexp_extract(own, r"(?s)^([^?]*)", 1), _query(own)
    at = path_of(base)
    folder = F.when(at == "", "/").otherwise(F.regexp_replace(at, "[^/]*$", ""))
    whole = (
        F.when(own.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), own)
        .when(own.startswith("//"), F.concat(F.lower(F.regexp_extract(base, "(?s)^(.*?)://", 1)), F.lit(":"), own))
        .when(own == "", F.concat(_origin(base), at, _query(base)))
        .when(path == "", F.concat(_origin(base), at, query))
        .when(path.startswith("/"), F.concat(_origin(base), _without_dots(path), query))
        .otherwise(F.concat(_origin(base), _without_dots(F.concat(folder, path)), query))
    )
    return F.when(host_of(whole) != "", whole)


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, its character references decoded, without white space around it."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    for reference, stands_for in REFERENCES:
        value = F.regexp_replace(value, f"(?i){reference}", stands_for)
    return F.regexp_replace(F.regexp_replace(value, r"[\t\n\r]", ""), r"^\s+|\s+$", "")


def page_links(html: Column) -> tuple[Column, Column]:
    """(links of a page: all canonical links and refresh targets, the base that it names or an empty text). A tag ends at its first `>`."""
    may = F.coalesce(html.rlike(r"(?i)canonical|http-equiv"), F.lit(False))
    tags = F.regexp_extract_all(F.regexp_replace(html, f"(?is){HIDDEN}", " "), F.lit(f"(?is){TAG}"), F.lit(0))
    canonical = F.filter(tags, lambda t: t.rlike(r"(?i)^<link\b") & _attribute(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"))
    refresh = F.filter(tags, lambda t: t.rlike(r"(?i)^<meta\b") & _attribute(t, "http-equiv").rlike("(?i)^refresh$"))
    links = F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), F.transform(refresh, lambda t: F.regexp_extract(_attribute(t, "content"), f"(?is){REFRESH}", 1)))
    bases = F.filter(F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)^<base\b")), lambda t: _attribute(t, "href")), lambda b: b != "")
    none = F.array().cast("array<string>")
    return F.when(may, F.filter(links, lambda x: x != "")).otherwise(none), F.when(may, F.coalesce(F.get(bases, F.lit(0)), F.lit(""))).otherwise("")


def judged(df: DataFrame, rules: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, rule, action) of the longest rule that fits each url; ids without one are missing. Of equal rules allow wins."""
    labels = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0))).first()[0]  # no rule's host has more
    if not labels:
        return df.select(F.col(id_col).alias("id"), F.lit("").alias("rule"), F.lit("").alias("action")).limit(0)
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, labels + 1)]))
    each = df.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).filter("host <> ''").select("id", "path", F.explode(suffixes).alias("host"))
    named = rules.select(F.col("host"), F.col("path").alias("start"), "action", F.concat("host", "path").alias("rule"))
    fits = each.join(named, "host").filter(F.startswith("path", "start"))
    best = F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), (F.col("action") == "allow").cast("int")))
    return fits.groupBy("id").agg(best.alias("best")).select("id", "best.rule", "best.action")


def url_verdicts(spark: SparkSession, pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule (null if none fits) and verdict (allow or block).

    redirects (src, dst): further links between URLs, such as a crawler's log. A null url, or one without `://`, has an
    empty host and path, no rule and no alias, and is allowed. A null html has no links. Repeated rows stay; an empty
    table gives an empty one. Of rules of one host and path an allow wins. Other columns are not read, whatever their names.
    """
    links, base = page_links(F.col(html_col) if html_col else F.lit(None).cast("string"))
    own = written(spark, pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), links.alias("links"), base.alias("base"), host_of(F.col(url_col)).alias("host")), "pages")
    placed = own.filter("host <> ''")
    at = F.when(F.col("base") == "", F.col("url")).otherwise(F.coalesce(resolved(F.col("url"), F.col("base")), F.col("url")))
    found = placed.filter("size(links) > 0").select("url", at.alias("at"), F.explode("links").alias("link")).select(F.col("url").alias("src"), resolved(F.col("at"), F.col("link")).alias("dst")).filter("dst IS NOT NULL")
    if redirects is not None:
        found = found.unionByName(redirects.select("src", "dst").filter((host_of(F.col("src")) != "") & (host_of(F.col("dst")) != "")))
    # The name of a resource is hashed to 128 bits, so a node is short whatever the URL.
    node = lambda c: F.md5(url_key(F.col(c)).cast("binary"))
    keyed = written(spark, found.select("src", "dst", node("src").alias("a"), node("dst").alias("b")), "links")
    joined = connected_components(spark, keyed.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    # Each URL is judged once, however many rows have it.
    urls = placed.select("url").unionByName(keyed.select(F.col("dst").alias("url"))).unionByName(keyed.select(F.col("src").alias("url"))).distinct()
    verdict = judged(urls, rules, "url", "url").withColumnRenamed("id", "url")
    known = urls.join(written(spark, verdict, "verdicts"), "url", "left").withColumn("node", node("url"))
    placed_in = written(spark, known.join(written(spark, joined, "joined"), "node", "left").select("url", "rule", "action", F.coalesce("component", "node").alias("component")), "placed")
    blocked = written(spark, placed_in.filter("action = 'block'").select("component").distinct().withColumn("hit", F.lit(True)), "blocked")
    final = placed_in.join(blocked, "component", "left").select("url", "rule", F.coalesce("action", F.when(F.col("hit"), F.lit("block")), F.lit("allow")).alias("verdict"))
    out = placed.join(written(spark, final, "final"), "url").select("id", "host", path_of(F.col("url")).alias("path"), "rule", "verdict")
    # Rows without a host meet nothing, however many they are.
    rest = own.filter("host = ''").select("id", "host", F.lit("").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    return out.unionByName(rest).withColumnRenamed("id", id_col)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark, table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, action string"))


def _oracle() -> str:
    quote = lambda s: s.replace("'", "''")
    part = lambda u, i: f"regexp_extract({u}, '{_URL}', {i})"
    host = lambda u: f"translate({part(u, 1)}, '{_UPPER}', '{_LOWER}')"
    origin = lambda u: f"lower(regexp_extract({u}, '(?s)^(.*?)://', 1)) || '://' || {host(u)}"
    query = lambda u: rf"regexp_extract({u}, '(?s)^[^?#]*(\?[^#]*)', 1)"
    key = lambda u: f"{origin(u)} || CASE WHEN {part(u, 2)} = '' THEN '/' ELSE {part(u, 2)} END || {query(u)}"

    def value(tag: str, name: str) -> str:
        pattern = quote(rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
        v = f"regexp_extract({tag}, '{pattern}', 1) || regexp_extract({tag}, '{pattern}', 2) || regexp_extract({tag}, '{pattern}', 3)"
        for reference, stands_for in REFERENCES:
            v = f"regexp_replace({v}, '(?i){reference}', '{quote(stands_for)}', 'g')"
        return rf"regexp_replace(regexp_replace({v}, '[\t\n\r]', '', 'g'), '^\s+|\s+$', '', 'g')"

    # A path as the list of its segments; each `..` takes the last of those kept, but never the first, which is empty.
    dots = lambda p: rf"""CASE WHEN regexp_matches({p}, '(^|/)\.\.?(/|$)') THEN array_to_string(list_reduce(list_transform(string_split({p}, '/'), lambda s: [s]),
        lambda d, s: CASE s[1] WHEN '..' THEN CASE WHEN len(d) > 1 THEN d[1:len(d) - 1] ELSE d END WHEN '.' THEN d ELSE d || s END), '/') || CASE WHEN regexp_matches({p}, '(^|/)\.\.?$') THEN '/' ELSE '' END ELSE {p} END"""  # noqa: E731

    def resolve(source: str, base: str, link: str, more: str) -> str:
        """A subquery: the columns more, and dst."""
        return rf"""(SELECT {more}, CASE WHEN regexp_matches(own, '(?i)^[a-z][a-z0-9+.-]*:') THEN own WHEN starts_with(own, '//') THEN lower(regexp_extract(b, '(?s)^(.*?)://', 1)) || ':' || own
            WHEN own = '' THEN {origin("b")} || {part("b", 2)} || {query("b")} WHEN p = '' THEN {origin("b")} || {part("b", 2)} || q ELSE {origin("b")} || {dots("j")} || q END AS dst
          FROM (SELECT *, {query("own")} AS q, regexp_extract(own, '(?s)^([^?]*)', 1) AS p,
                       CASE WHEN starts_with(own, '/') THEN '' WHEN {part("b", 2)} = '' THEN '/' ELSE regexp_replace({part("b", 2)}, '[^/]*$', '') END || regexp_extract(own, '(?s)^([^?]*)', 1) AS j
                FROM (SELECT *, {base} AS b, regexp_replace({link}, '(?s)#.*$', '') AS own FROM {source}) x) y)"""

    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
    return rf"""
WITH RECURSIVE p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
tags AS (SELECT rid, url, unnest(regexp_extract_all(regexp_replace(html, '(?is){HIDDEN}', ' ', 'g'), '(?is){TAG}')) AS tag, generate_subscripts(regexp_extract_all(regexp_replace(html, '(?is){HIDDEN}', ' ', 'g'), '(?is){TAG}'), 1) AS k
         FROM p WHERE regexp_matches(html, '(?i)canonical|http-equiv') AND {host("url")} <> ''),
bases AS (SELECT rid, arg_min(href, k) AS base FROM (SELECT rid, k, {value("tag", "href")} AS href FROM tags WHERE regexp_matches(tag, '(?i)^<base\b')) WHERE href <> '' GROUP BY rid),
links AS (
  SELECT rid, url, {value("tag", "href")} AS link FROM tags WHERE regexp_matches(tag, '(?i)^<link\b') AND regexp_matches({value("tag", "rel")}, '(?i)(^|\s)canonical(\s|$)')
  UNION ALL SELECT rid, url, regexp_extract({value("tag", "content")}, '(?is){quote(REFRESH)}', 1) FROM tags WHERE regexp_matches(tag, '(?i)^<meta\b') AND regexp_matches({value("tag", "http-equiv")}, '(?i)^refresh$')),
based AS (SELECT rid, dst AS base FROM {resolve("(SELECT rid, url, base FROM bases JOIN p USING (rid)) a", "url", "base", "rid")} r),
whole AS (SELECT src, dst FROM {resolve("(SELECT l.url AS src, l.link, CASE WHEN " + host("base") + " <> '' THEN base ELSE l.url END AS base_url FROM links l LEFT JOIN based USING (rid) WHERE l.link <> '') a", "base_url", "link", "src")} r WHERE {host("dst")} <> ''),
edge AS (SELECT {key("src")} AS a, {key("dst")} AS b FROM whole),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
urls AS (SELECT DISTINCT url FROM (SELECT url FROM p UNION SELECT dst FROM whole)),
rules AS (SELECT * FROM (VALUES {rules}) AS r(h, s, action)),
u AS (SELECT url, {host("url")} AS host, {part("url", 2)} AS path, {key("url")} AS node FROM urls),
best AS (SELECT url, arg_max(h || s, length(h || s)) AS rule, arg_max(action, length(h || s)) AS action FROM u, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY url),
reach AS (
  SELECT DISTINCT node, node AS other FROM u
  UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
blocked AS (SELECT DISTINCT reach.node FROM reach JOIN u ON u.node = reach.other JOIN best USING (url) WHERE action = 'block')
SELECT page_id, u.host, u.path, best.rule, CASE WHEN u.host = '' THEN 'allow' ELSE coalesce(best.action, CASE WHEN blocked.node IS NOT NULL THEN 'block' ELSE 'allow' END) END AS verdict
FROM p JOIN u USING (url) LEFT JOIN best USING (url) LEFT JOIN blocked USING (node)
"""


QUERIES = {"op10_url_filter": op10_url_filter}
ORACLES = {"op10_url_filter": _oracle()}
