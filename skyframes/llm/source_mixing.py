"""Mixing sources to target weights (DataFrame operations only).

Token counts are summed by cell (source, language, topic). Iterative proportional fitting rakes the cells' weights
to three target marginals; documents are then sampled by calibrated probabilities min(1, rate * weight / tokens),
where the rate makes the expected tokens of the sample a given fraction of all.

Defined results: a null source or language is a value of its own; null text has no words and the topic ``empty``;
a document's draw depends on its id alone, so repeated rows share a fate (null ids draw 0.5); a cell without
tokens keeps its documents; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, materialize, table

DIMS = ("source", "lang", "topic")
#: Targets are the corpus's own shares to this power, normalised; the sample holds this fraction of all tokens.
TEMPER, FRACTION, SWEEPS, RATE_STEPS = 0.7, 0.5, 6, 8
NULL = "\x00null"
P = "__mx_"

TOPICS = (("tabular", r"\|"), ("marked", r"[#*$%&]{3}"), ("shouting", r"!!"), ("numeric", r"[0-9]{4}"))


def topic_of(text: Column) -> Column:
    """A content class read off the text: the first of these marks that it holds, else prose."""
    found = F.when(F.coalesce(text, F.lit("")) == "", F.lit("empty"))
    for name, pattern in TOPICS:
        found = found.when(text.rlike(pattern), F.lit(name))
    return found.otherwise(F.lit("prose"))


def cell_of(docs: DataFrame, text: str = "text") -> dict[str, Column]:
    return {P + "source": F.coalesce("source", F.lit(NULL)), P + "lang": F.coalesce("lang", F.lit(NULL)), P + "topic": topic_of(F.col(text))}


def draw(doc_id: Column) -> Column:
    """A uniform number in [0, 1) from the id."""
    mixed = (F.pmod(doc_id, F.lit(2**31)) * 1103515245 + 12345) % 2**31
    mixed = F.pmod(mixed.bitwiseXOR(F.shiftright(mixed, 15)) * 1103515245 + 12345, F.lit(2**31))
    return F.coalesce(mixed / F.lit(float(2**31)), F.lit(0.5))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``weight``: tokens times one factor per dimension value.

    Each step joins the cells with the factors, which have a row per dimension value, sums by one dimension and
    writes that dimension's new factors; nothing is gathered anywhere.
    """
    dims = list(targets)
    factors = {d: targets[d].select(d, F.lit(1.0).alias(f"f_{d}")) for d in dims}
    product = reduce(lambda a, b: a * b, (F.col(f"f_{d}") for d in dims), F.col("tokens").cast("double"))
    weigh = lambda: reduce(lambda c, d: c.join(factors[d], d), dims, cells).withColumn("weight", product)
    for _ in range(sweeps):
        for d in dims:
            now = weigh().groupBy(d).agg(F.sum("weight").alias("now"), F.first(f"f_{d}").alias("old"))
            step = now.join(targets[d], d).select(d, F.when(F.col("now") > 0, F.col("old") * F.col("target") / F.col("now")).otherwise(0.0).alias(f"f_{d}"))
            factors[d] = materialize(step, "factors")
    return weigh().drop(*(f"f_{d}" for d in dims))


def tempered(cells: DataFrame, dim: str, total: float, power: float = TEMPER) -> DataFrame:
    """(dim, target tokens): shares to ``power``, normalised to ``total``."""
    shares = cells.groupBy(dim).agg(F.sum("tokens").alias("n")).withColumn("share", F.pow(F.col("n") / F.lit(total), F.lit(power)))
    norm = shares.agg(F.sum("share")).first()[0]
    return shares.select(dim, (F.col("share") / F.lit(norm) * F.lit(total)).alias("target"))


def calibrate(cells: DataFrame, fraction: float = FRACTION, steps: int = RATE_STEPS) -> DataFrame:
    """``cells`` with ``prob``. The rate is a fixed point: cells at probability 1 give their tokens, the others share the rest."""
    tokens, ratio = F.col("tokens").cast("double"), F.col("weight") / F.col("tokens")
    total = cells.agg(F.sum(tokens)).first()[0] or 0.0
    rate = fraction
    for _ in range(steps):
        full = F.lit(rate) * ratio >= 1
        held, rest = cells.agg(F.sum(F.when(full, tokens).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not rest:
            break
        rate = (fraction * total - held) / rest
    return cells.withColumn("prob", F.coalesce(F.least(F.lit(1.0), F.lit(rate) * ratio), F.lit(1.0)))


def cell_probabilities(measured: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """(dimensions, weight, tokens, prob) from rows of dimensions and n_tokens."""
    cells = materialize(measured.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    some = cells.filter(F.col("tokens") > 0)
    total = some.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumns({"weight": F.lit(0.0), "prob": F.lit(1.0)})
    weighed = materialize(rake(some, {d: materialize(tempered(some, d, total), "targets") for d in DIMS}), "weights")
    empty = cells.filter(F.col("tokens") == 0).withColumns({"weight": F.lit(0.0), "prob": F.lit(1.0)})
    return calibrate(weighed, fraction).unionByName(empty)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACES + "+"), "")).cast("long")
    return docs.select(F.col("doc_id"), *(c.alias(n.removeprefix(P)) for n, c in cell_of(docs, text).items()), words.alias("n_tokens"))


def mix(docs: DataFrame, text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """One row per document with its cell, weight ratio, probability and draw: the operator's result."""
    measured = materialize(measure(docs, text), "mixing")
    cells = cell_probabilities(measured, fraction)
    return measured.join(cells, list(DIMS), "left").withColumn("sampled", draw(F.col("doc_id")) < F.col("prob"))


def sample(docs: DataFrame, text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """The sampled rows of ``docs``, with their own columns."""
    cells = cell_probabilities(measure(docs, text), fraction).select(*(F.col(d).alias(P + d) for d in DIMS), F.col("prob").alias(P + "prob"))
    drawn = docs.withColumns(cell_of(docs, text)).join(cells, [P + d for d in DIMS], "left").filter(draw(F.col("doc_id")) < F.col(P + "prob"))
    return drawn.select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents"))
    shown = {d: F.when(F.col(d) != NULL, F.col(d)) for d in DIMS}
    return rows.select("doc_id", *(shown[d].alias(d) for d in DIMS), "n_tokens", F.round(F.col("weight") / F.greatest("tokens", F.lit(1)), 6).alias("ratio"), F.round("prob", 6).alias("prob"), "sampled")


def _op8_sql() -> str:
    """The same steps as a chain of common table expressions."""
    topic = "CASE WHEN coalesce(text, '') = '' THEN 'empty' " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS) + " ELSE 'prose' END"
    ctes = [
        rf"d AS MATERIALIZED (SELECT doc_id, coalesce(source, '~') AS source, coalesce(lang, '~') AS lang, {topic} AS topic, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents)",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL)",
        "k AS MATERIALIZED (SELECT * FROM c WHERE tokens > 0)",
        "t AS MATERIALIZED (SELECT sum(tokens)::DOUBLE AS total FROM k)",
    ]
    now = {}
    for x in DIMS:
        ctes += [f"t_{x} AS MATERIALIZED (SELECT {x}, s / sum(s) OVER () * (SELECT total FROM t) AS target FROM (SELECT {x}, pow(sum(tokens) / (SELECT total FROM t), {TEMPER}) AS s FROM k GROUP BY {x}))", f"f_{x}_0 AS MATERIALIZED (SELECT {x}, 1.0::DOUBLE AS f FROM t_{x})"]
        now[x] = f"f_{x}_0"
    joins = lambda: " ".join(f"JOIN {now[x]} AS {x[0]}f ON {x[0]}f.{x} = k.{x}" for x in DIMS)
    for i in range(1, SWEEPS + 1):
        for x in DIMS:
            ctes.append(f"f_{x}_{i} AS MATERIALIZED (SELECT k.{x}, any_value({x[0]}f.f) * any_value(t_{x}.target) / sum(k.tokens * sf.f * lf.f * tf.f) AS f FROM k {joins()} JOIN t_{x} ON t_{x}.{x} = k.{x} GROUP BY k.{x})")
            now[x] = f"f_{x}_{i}"
    ctes += [f"w AS MATERIALIZED (SELECT k.*, k.tokens * sf.f * lf.f * tf.f AS weight FROM k {joins()})", f"r0 AS MATERIALIZED (SELECT {FRACTION}::DOUBLE AS rate)"]
    for i in range(1, RATE_STEPS + 1):
        full = f"(SELECT rate FROM r{i - 1}) * weight / tokens >= 1"
        ctes.append(f"r{i} AS MATERIALIZED (SELECT coalesce(({FRACTION} * sum(tokens) - sum(CASE WHEN {full} THEN tokens ELSE 0 END)) / nullif(sum(CASE WHEN {full} THEN 0 ELSE weight END), 0), (SELECT rate FROM r{i - 1})) AS rate FROM w)")
    ctes += [
        f"p AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, coalesce(w.weight, 0) AS weight, coalesce(least(1.0, (SELECT rate FROM r{RATE_STEPS}) * w.weight / w.tokens), 1.0) AS prob FROM c LEFT JOIN w USING (source, lang, topic))",
        "u AS (SELECT *, ((doc_id % 2147483648 + 2147483648) % 2147483648 * 1103515245 + 12345) % 2147483648 AS x FROM d)",
    ]
    return "WITH " + ",\n".join(ctes) + """
SELECT doc_id, nullif(source, '~') AS source, nullif(lang, '~') AS lang, topic, n_tokens, round(weight / greatest(tokens, 1), 6) AS ratio, round(prob, 6) AS prob,
       coalesce((xor(x, x >> 15) * 1103515245 + 12345) % 2147483648 / 2147483648.0::DOUBLE, 0.5) < prob AS sampled
FROM u JOIN p USING (source, lang, topic)"""


OP8_SQL = _op8_sql()
