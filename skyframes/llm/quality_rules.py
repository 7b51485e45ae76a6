"""Host-level quality rules (DataFrame operations only).

Each document is measured once; failures of the rules are summed by host, the hosts' failure rates are shrunk
with a beta prior fitted to all hosts, and the verdict on a host is joined back to its documents.

Defined results: null text counts as empty (no words, so it fails); null hosts form one host of their own;
repeated rows are judged each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, materialize, table

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PCT, MAX_SYMBOL_PCT, MAX_DUP_LINE_PCT = 10, 20, 10, 30
#: A host is rejected when its shrunk failure rate exceeds this; the prior's strength stays within the bounds.
MAX_HOST_RATE, MIN_STRENGTH, MAX_STRENGTH = 0.5, 2.0, 1000.0
P = "__qr_"


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of each text in columns that start with ``__qr_``.

    Five-word windows are compared by 64-bit hashes within one text. The windows' positions are sorted only in
    texts that hold a repeated window, so the work is n log n in the words of a text at most.
    """
    c = lambda name: F.col(P + name)
    d = docs.withColumn(P + "text", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn(P + "words", F.array_remove(F.split(c("text"), SPACES + "+"), ""))
    d = d.withColumn(P + "lines", F.filter(F.split(c("text"), "\n"), lambda x: x.rlike(SPACES.replace("[", "[^"))))
    d = d.withColumns({
        P + "n_words": F.size(c("words")).cast("long"),
        P + "word_chars": F.length(F.array_join(c("words"), "")).cast("long"),
        P + "n_symbols": F.regexp_count(c("text"), F.lit(r"[#*$%&|<>]")).cast("long"),
        P + "n_lines": F.size(c("lines")).cast("long"),
        P + "n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
    }).drop(P + "text", P + "lines")
    at = lambda i: [F.get(c("words"), i + k) for k in range(WINDOW)]
    d = d.withColumn(P + "hashes", F.when(c("n_words") > WINDOW, F.transform(F.sequence(F.lit(0), (c("n_words") - WINDOW).cast("int")), lambda i: F.xxhash64(*at(i))))).drop(P + "words")
    d = d.withColumn(P + "sorted", F.when(F.size(F.array_distinct(c("hashes"))) < F.size(c("hashes")), F.sort_array(F.transform(c("hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop(P + "hashes")
    d = d.withColumn(P + "starts", F.sort_array(F.transform(F.filter(c("sorted"), lambda x, k: ((k > 0) & (F.get(c("sorted"), k - 1)["h"] == x["h"])) | F.coalesce(F.get(c("sorted"), k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))).drop(P + "sorted")
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(c("starts"), start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    return d.withColumn(P + "n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(P + "starts")


def base_failed() -> Column:
    c = lambda name: F.col(P + name)
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PCT * c("n_words"))


def any_failed() -> Column:
    """A document counts against its host when it fails the base or is rich in symbols or repeated lines."""
    c = lambda name: F.col(P + name)
    return base_failed() | (100 * c("n_symbols") > MAX_SYMBOL_PCT * c("word_chars")) | (100 * c("n_dup_lines") > MAX_DUP_LINE_PCT * c("n_lines"))


def prior_strength(hosts: int, docs: float, failed: float, squares: float, ratio: float) -> tuple[float, float]:
    """Mean and strength of the beta prior by the method of moments.

    ``squares`` is the sum of n^2 and ``ratio`` that of k^2 / n over hosts with k failures in n documents.
    Without spread beyond the binomial's, the strength is the greatest allowed.
    """
    if not docs:
        return 0.0, MAX_STRENGTH
    mean = failed / docs
    within = mean * (1 - mean)
    room = within * (docs - squares / docs - hosts + 1)
    rho = (ratio - failed * failed / docs - within * (hosts - 1)) / room if room > 0 else 0.0
    return mean, min(MAX_STRENGTH, max(MIN_STRENGTH, 1 / rho - 1)) if rho > 0 else MAX_STRENGTH


def host_verdicts(measured: DataFrame, host: str) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, verdict. Only one row of five sums comes to the driver."""
    hosts = measured.groupBy(F.col(host).alias(P + "host")).agg(F.count(F.lit(1)).alias(P + "host_docs"), F.count_if(any_failed()).alias(P + "host_failed"))
    hosts = materialize(hosts, "hosts")  # used for the prior and for the verdicts: the texts are measured once
    n, k = F.col(P + "host_docs").cast("double"), F.col(P + "host_failed").cast("double")
    sums = hosts.agg(F.count(F.lit(1)), F.sum(n), F.sum(k), F.sum(n * n), F.sum(k * k / n)).first()
    mean, strength = prior_strength(*(x or 0 for x in sums))
    rate = (k + F.lit(mean * strength)) / (n + F.lit(strength))
    return hosts.withColumn(P + "host_rate", rate).withColumn(P + "host_rejected", F.col(P + "host_rate") > MAX_HOST_RATE)


def judge(docs: DataFrame, text: str = "text", host: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Measures and verdict of every row: the operator's result, without texts."""
    slim = measure(docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias(P + "source"), F.col(text).alias(P + "raw")), P + "raw").drop(P + "raw")
    slim = materialize(slim, "quality")
    verdicts = host_verdicts(slim, P + "source")
    joined = slim.join(verdicts, F.col(P + "source").eqNullSafe(F.col(P + "host")), "left")
    c = lambda name: F.col(P + name)
    return joined.select(
        "doc_id", *(c(x).alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed().alias("base_failed"), (~base_failed() & ~c("host_rejected")).alias("kept"),
        c("host_docs").alias("host_docs"), c("host_failed").alias("host_failed"), F.round(c("host_rate"), 6).alias("host_rate"),
    )


def keep(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    Texts stay where they are: a pass sums the hosts, a second one filters. The list of rejected hosts is written
    first, so that its size is known when the second pass is planned: it is broadcast below
    spark.sql.autoBroadcastJoinThreshold, and beyond that rows are shuffled by host.
    """
    rejected = materialize(host_verdicts(measure(docs, text), host).filter(F.col(P + "host_rejected")).select(P + "host"), "rejected")
    # a row number keeps the filter above the measures: pushed below them, it would compute them again for each word
    measured = measure(docs, text).withColumn(P + "row", F.monotonically_increasing_id())
    kept = measured.filter(~base_failed() & (F.col(P + "row") >= 0)).join(rejected, F.col(host).eqNullSafe(F.col(P + "host")), "left_anti")
    return kept.select(*(F.col(f"`{x}`") for x in docs.columns))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT rid, i, words[i : i + 4] AS g FROM w, range(1, len(words) - 3) r(i) WHERE len(words) > 5),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, sum(least(5, i - coalesce(prev, -99))) AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM dup) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.rid = rep.rid),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed FROM m),
h AS (
  SELECT source AS host, count(*) AS n,
         count(*) FILTER (base_failed OR 100 * n_symbols > {MAX_SYMBOL_PCT} * word_chars OR 100 * n_dup_lines > {MAX_DUP_LINE_PCT} * n_lines) AS k
  FROM f GROUP BY source),
s AS (SELECT count(*) AS hosts, sum(n)::DOUBLE AS docs, sum(k)::DOUBLE AS failed, sum(n::DOUBLE * n) AS squares, sum(k::DOUBLE * k / n) AS ratio FROM h),
q AS (SELECT *, failed / docs AS mean, failed / docs * (1 - failed / docs) AS within FROM s),
r AS (SELECT mean, CASE WHEN within * (docs - squares / docs - hosts + 1) > 0 THEN (ratio - failed * failed / docs - within * (hosts - 1)) / (within * (docs - squares / docs - hosts + 1)) ELSE 0 END AS rho FROM q),
b AS (SELECT mean, CASE WHEN rho > 0 THEN least({MAX_STRENGTH}, greatest({MIN_STRENGTH}, 1 / rho - 1)) ELSE {MAX_STRENGTH} END AS strength FROM r),
v AS (SELECT host, n, k, (k + mean * strength) / (n + strength) AS rate FROM h, b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= {MAX_HOST_RATE} AS kept,
       n AS host_docs, k AS host_failed, round(rate, 6) AS host_rate
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.host
"""
