"""URL filters by dated lists (DataFrame operations only).

Dated entries (kind, key, action, day, category) become validity intervals; an as-of join evaluates every capture
against the entries that were active when it was fetched. Kinds: ``domain`` matches a host and all hosts under
it, ``url`` matches host and path without scheme, query, fragment and trailing slash.

Defined results: entries of one key are ordered by time, at equal times ``remove`` comes last and wins; an
interval holds its first instant and not its last; a capture without a URL, host or fetch time is never blocked;
repeated captures are judged each; of several active entries the one for the URL wins, then the longest domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

URL_RANK = 1_000_000
HOST_RE, PATH_RE = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#@]+)", r"^[^?#]*?://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The lower-case host, null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), HOST_RE, 1), F.lit(""))


def url_key(url: Column) -> Column:
    return F.concat(host_of(url), F.regexp_replace(F.regexp_extract(url, PATH_RE, 1), "/+$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, key, since, until, category): until is null while an entry still holds."""
    order = Window.partitionBy("kind", "key").orderBy("since", "action", "category")
    return (
        entries.select("kind", "key", "action", "since", "category")
        .withColumn("until", F.lead("since").over(order))
        .filter((F.col("action") == "add") & (F.col("until").isNull() | (F.col("since") < F.col("until"))))
        .select("kind", "key", "since", "until", "category")
    )


def _rules(valid: DataFrame, rank: Column) -> Column:
    return F.collect_list(F.struct(rank.alias("rank"), "since", "key", "category", "until"))


RESULTS = ("host", "blocked", "n_active", "rule", "category", "active_since")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with host, blocked, n_active, rule, category and active_since.

    Entries are gathered by distinct host first (a host matches few: its own name and those above it), so a capture
    joins once by host and once by URL, and no capture is multiplied. Columns of ``captures`` that have a result's name are left out. Rows of hot hosts may be split by the
    engine, as both joins keep the captures' side.
    """
    valid = intervals(entries)
    rows = captures.withColumn("__uf_host", host_of(F.col(url))).withColumn("__uf_key", url_key(F.col(url)))
    labels = F.split("__uf_host", r"\.")
    hosts = captures.select(host_of(F.col(url)).alias("__uf_host")).filter(F.col("__uf_host").isNotNull()).distinct()
    names = hosts.select("__uf_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("key"))
    domain = names.join(valid.filter(F.col("kind") == "domain"), "key").groupBy("__uf_host").agg(_rules(valid, F.length("key")).alias("__uf_domain"))
    exact = valid.filter(F.col("kind") == "url").groupBy(F.col("key").alias("__uf_key")).agg(_rules(valid, F.lit(URL_RANK)).alias("__uf_exact"))
    rows = rows.join(domain, "__uf_host", "left").join(exact, "__uf_key", "left")
    both = F.concat(F.coalesce("__uf_exact", F.array()), F.coalesce("__uf_domain", F.array()))
    active = F.filter(both, lambda r: (r["since"] <= F.col(at)) & (r["until"].isNull() | (F.col(at) < r["until"])))
    rows = rows.withColumn("__uf_active", active)
    best = F.array_max("__uf_active")
    return rows.select(
        *(F.col(f"`{c}`") for c in captures.columns if c.lower() not in RESULTS), F.col("__uf_host").alias("host"), (F.size("__uf_active") > 0).alias("blocked"), F.size("__uf_active").cast("long").alias("n_active"),
        best["key"].alias("rule"), best["category"].alias("category"), best["since"].alias("active_since"),
    )


EPOCH, DAY = 1_704_067_200, 86_400


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is a capture, fetched at a second given by its id. The list is made from all pages.

    Every host is listed, lifted after 45 days and listed again 75 days later; so is, from another day on, every
    domain above a host of four labels or more; every URL with a query is listed for 20 days.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", EPOCH + F.col("page_id") * 7 % 365 * DAY + F.col("page_id") % DAY)
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host")).filter("host is not null").groupBy("host").agg(F.min("page_id").alias("first"))
    above = hosts.filter(F.size(F.split("host", r"\.")) > 3).groupBy(F.regexp_replace("host", r"^[^.]*\.", "").alias("key")).agg(F.min("first").alias("first"))
    kinds = F.element_at(F.array(F.lit("adult"), F.lit("phishing"), F.lit("spam")), (F.col("first") % 3 + 1).cast("int"))
    dated = lambda d, key, step: d.select(F.lit("domain").alias("kind"), F.col(key).alias("key"), kinds.alias("category"), F.explode(F.array(*(F.struct(F.lit(a).alias("action"), (EPOCH + (F.col("first") * step % 300 + n) * DAY).alias("since")) for a, n in (("add", 0), ("remove", 45), ("add", 120))))).alias("e")).select("kind", "key", "e.action", "e.since", "category")
    links = pages.filter(F.col("url").contains("?")).groupBy(url_key(F.col("url")).alias("key")).agg(F.min("page_id").alias("first")).filter("key is not null")
    links = links.select(F.lit("url").alias("kind"), "key", F.lit("tracking").alias("category"), F.explode(F.array(*(F.struct(F.lit(a).alias("action"), (EPOCH + (F.col("first") * 53 % 345 + n) * DAY).alias("since")) for a, n in (("add", 0), ("remove", 20))))).alias("e")).select("kind", "key", "e.action", "e.since", "category")
    return judge(captures, dated(hosts, "host", 37).unionByName(dated(above, "key", 91)).unionByName(links))


OP7_SQL = rf"""
WITH p AS (SELECT page_id, url, nullif(regexp_extract(lower(url), '{HOST_RE}', 1), '') AS host FROM pages),
c AS (
  SELECT *, host || regexp_replace(regexp_extract(url, '{PATH_RE}', 1), '/+$', '') AS ukey,
         {EPOCH} + page_id * 7 % 365 * {DAY} + page_id % {DAY} AS fetched_at, row_number() OVER () AS rid FROM p),
h AS (SELECT host AS key, min(page_id) AS first FROM p WHERE host IS NOT NULL GROUP BY host),
a AS (SELECT regexp_replace(key, '^[^.]*\.', '') AS key, min(first) AS first FROM h WHERE len(string_split(key, '.')) > 3 GROUP BY 1),
u AS (SELECT ukey AS key, min(page_id) AS first FROM c WHERE contains(url, '?') AND ukey IS NOT NULL GROUP BY 1),
e AS (
  SELECT 'domain' AS kind, key, action, {EPOCH} + (first * 37 % 300 + n) * {DAY} AS since, ['adult', 'phishing', 'spam'][first % 3 + 1] AS category
  FROM h, (VALUES ('add', 0), ('remove', 45), ('add', 120)) t(action, n)
  UNION ALL
  SELECT 'domain', key, action, {EPOCH} + (first * 91 % 300 + n) * {DAY}, ['adult', 'phishing', 'spam'][first % 3 + 1]
  FROM a, (VALUES ('add', 0), ('remove', 45), ('add', 120)) t(action, n)
  UNION ALL
  SELECT 'url', key, action, {EPOCH} + (first * 53 % 345 + n) * {DAY}, 'tracking' FROM u, (VALUES ('add', 0), ('remove', 20)) t(action, n)),
i AS (SELECT *, lead(since) OVER (PARTITION BY kind, key ORDER BY since, action, category) AS until FROM e),
v AS (SELECT * FROM i WHERE action = 'add' AND (until IS NULL OR since < until)),
m AS (
  SELECT c.rid, v.key, v.category, v.since, length(v.key) AS rank
  FROM c JOIN v ON v.kind = 'domain' AND (c.host = v.key OR ends_with(c.host, '.' || v.key)) AND v.since <= c.fetched_at AND (v.until IS NULL OR c.fetched_at < v.until)
  UNION ALL
  SELECT c.rid, v.key, v.category, v.since, {URL_RANK}
  FROM c JOIN v ON v.kind = 'url' AND c.ukey = v.key AND v.since <= c.fetched_at AND (v.until IS NULL OR c.fetched_at < v.until)),
n AS (SELECT rid, count(*) AS n_active FROM m GROUP BY rid),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY rid ORDER BY rank DESC, since DESC, key DESC, category DESC) = 1)
SELECT c.page_id, c.url, c.fetched_at, c.host, n.n_active IS NOT NULL AS blocked, coalesce(n.n_active, 0)::BIGINT AS n_active,
       b.key AS rule, b.category, b.since AS active_since
FROM c LEFT JOIN n ON c.rid = n.rid LEFT JOIN b ON c.rid = b.rid
"""
