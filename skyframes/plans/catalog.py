"""All queries of the engine and their SQL twins, over the shared test tables.

An embedding is an 8 x 8 frame in column-major order: vec_id is its index, label its sequence. Angles are 7 degrees a
frame, times one second a frame, weights 1 + index % 5, qualities index % 10; the mask is a disk of radius 4.5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..functions.expressions import r6
from ..operators import coadd, combine, filters, frames, measure, references, resample, selection
from . import local, models, pipelines

SIZE, MASK_RADIUS = 8, 4.5
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- the tables as frames ----------------------------------------------------------------------------------------


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    f = F.col("vec_id")
    return e.select(
        F.col("label").alias("seq"), f.alias("frame_idx"), F.col("embedding").alias("pixels"), (f * 7.0).alias("angle"), (f + 60000.0 * 86400).cast("double").alias("t"), (60000.0 + f / 86400.0).alias("mjd"),
        (1.0 + f % 5).alias("weight"), (f % 10).cast("double").alias("quality"), ex.frame_name(f).alias("basename"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.explode_frames(stack(spark, sf_dir), SIZE)


def geo(spark: SparkSession) -> DataFrame:
    return frames.geometry(spark, SIZE, SIZE)


def mask(spark: SparkSession) -> DataFrame:
    return frames.disk_mask(geo(spark), MASK_RADIUS)


def shown(df: DataFrame, *keys: str, **values) -> DataFrame:
    """Integers as long, doubles rounded."""
    return df.select(*(F.col(k).cast("long").alias(k) for k in keys), *(r6(v if not isinstance(v, str) else F.col(v)).alias(n) for n, v in values.items()))


PX = "px AS (SELECT label AS seq, vec_id AS frame_idx, (i - 1) % 8 AS row, (i - 1) // 8 AS col, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) t(i))"
GEO = "geo AS (SELECT row, col, sqrt((row - 3.5) * (row - 3.5) + (col - 3.5) * (col - 3.5)) AS r, (degrees(atan2(col - 3.5, row - 3.5)) + 360) % 360 AS theta FROM (SELECT i % 8 AS row, i // 8 AS col FROM range(64) t(i)))"
FR = "fr AS (SELECT label AS seq, vec_id AS frame_idx, vec_id * 7.0::DOUBLE AS angle, 1.0::DOUBLE + vec_id % 5 AS weight, vec_id % 10 AS quality, 'im_' || lpad(vec_id::VARCHAR, 6, '0') || '.fits' AS basename, radians((vec_id * 7.0::DOUBLE) % 360) AS derot FROM embeddings)"
MK = "mpx AS (SELECT px.seq, px.frame_idx, px.row, px.col, CASE WHEN geo.r < 4.5 THEN px.value END AS value FROM px JOIN geo USING (row, col))"
CEN = "cen AS (SELECT seq, frame_idx, row, col, value - avg(value) OVER (PARTITION BY seq, frame_idx) AS v FROM px)"
SMALL_ANGLES = "((r.angle - t.angle + 180) % 360 + 360) % 360 - 180"


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---- scans, selection, lookups -----------------------------------------------------------------------------------


@query(_w(PX) + "SELECT seq, frame_idx, row, col, round(value, 6) + 0.0 AS value FROM px")
def frames_to_pixels(spark, d):
    return shown(pixels(spark, d), "seq", "frame_idx", "row", "col", value="value")


@query(_w(PX) + "SELECT seq, row, col, count(*) AS n, round(sum(value), 6) + 0.0 AS total, round(first(value ORDER BY frame_idx), 6) + 0.0 AS head, round(last(value ORDER BY frame_idx), 6) + 0.0 AS tail FROM px GROUP BY ALL")
def pixel_series(spark, d):
    s = frames.to_series(pixels(spark, d)).withColumn("n", F.size("values"))
    return shown(s, "seq", "row", "col", "n", total=F.aggregate("values", F.lit(0.0), lambda a, x: a + x), head=F.get("values", F.lit(0)), tail=F.get("values", F.col("n") - 1))


TRIM = "a AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY frame_idx) AS k, count(*) OVER (PARTITION BY seq) AS n FROM fr), b AS (SELECT * FROM a WHERE k > 3 AND k <= n - 2)"


@query(_w(FR, TRIM) + "SELECT seq, (row_number() OVER (PARTITION BY seq ORDER BY frame_idx) - 1)::BIGINT AS frame_idx, basename FROM b WHERE quality >= 4")
def frame_trim_quality(spark, d):
    f = stack(spark, d)
    table = f.select("basename", "quality", F.lit(0).alias("line"))
    return selection.surviving_names(selection.trim(f.drop("quality"), 3, 2), table, 4.0).select(F.col("seq").cast("long"), F.col("frame_idx").cast("long"), "basename")


@query("SELECT d.doc_id, l.quality::DOUBLE AS quality, d.n_chars FROM documents d JOIN labels l USING (doc_id) WHERE l.quality >= 1")
def quality_join(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("basename"), "n_chars")
    table = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").cast("string").alias("basename"), F.col("quality").cast("double").alias("quality"), F.lit(0).alias("line"))
    found = selection.lookup(docs, table, "quality", required=False).filter("quality >= 1")
    return found.select(F.col("basename").cast("long").alias("doc_id"), "quality", "n_chars")


@query(_w(FR) + "SELECT seq, frame_idx, round(weight / sum(weight) OVER (PARTITION BY seq), 9) AS weight FROM fr")
def weights_normalized(spark, d):
    return selection.normalized_weights(stack(spark, d)).select(F.col("seq").cast("long"), "frame_idx", F.round("weight", 9).alias("weight"))


@query("WITH s AS (SELECT o_custkey AS k, max_by(o_totalprice, o_orderkey) AS scale FROM orders GROUP BY 1) SELECT c_custkey, round(s.scale, 6) AS scale FROM customer LEFT JOIN s ON s.k = c_custkey")
def scale_lookup_last(spark, d):
    names = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("basename"))
    table = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").cast("string").alias("basename"), F.col("o_totalprice").alias("scale"), F.col("o_orderkey").alias("line"))
    return selection.lookup(names, table, "scale", required=False, last_wins=True).select(F.col("basename").cast("long").alias("c_custkey"), F.round("scale", 6).alias("scale"))


@query(_w(FR) + "SELECT (m.i)::BIGINT AS mode_idx, f.frame_idx FROM range(3) m(i), fr f WHERE NOT (f.frame_idx % 7 = m.i)")
def grid_completeness(spark, d):
    f = stack(spark, d).select("frame_idx")
    found = f.withColumn("mode_idx", F.col("frame_idx") % 7).filter("mode_idx < 3")
    return selection.missing_cells(found, spark.range(3).withColumnRenamed("id", "mode_idx"), f).select("mode_idx", "frame_idx")


@query("SELECT event_id, round(epoch_us(ts) / 86400e6::DOUBLE + 40587, 8) AS mjd, round(try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE), 6) AS card FROM events")
def header_projection(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("header", F.create_map(F.lit("CARD"), F.regexp_extract("props", "([0-9]+)", 1)))
    return e.select("event_id", F.round(ex.mjd(F.col("ts")), 8).alias("mjd"), F.round(ex.numeric_card(F.col("header"), "CARD"), 6).alias("card"))


@query(_w(FR) + "SELECT frame_idx, round(derot, 6) + 0.0 AS derot, round(((angle % 360) - 180 + 540) % 360 - 180, 6) + 0.0 AS arc FROM fr")
def derotation_angles(spark, d):
    s = stack(spark, d)
    return shown(s, "frame_idx", derot=ex.derotation(F.col("angle")), arc=ex.angle_diff(F.lit(180.0), ex.angle_mod(F.col("angle"))))


# ---- masks and regions -------------------------------------------------------------------------------------------


@query(_w(PX, GEO) + "SELECT seq, frame_idx, row, col, round(CASE WHEN geo.r < 4.5 THEN value ELSE 0 END, 6) + 0.0 AS value FROM px JOIN geo USING (row, col)")
def nan_zero_mask_multiply(spark, d):
    p = pixels(spark, d).withColumn("value", frames.zero_nan(F.col("value")))
    return shown(frames.apply_mask(p, mask(spark)), "seq", "frame_idx", "row", "col", value="value")


@query(_w(PX, GEO) + "SELECT frame_idx, row, col, round(value, 6) + 0.0 AS value, (CASE WHEN r < 2 THEN 0 ELSE 1 END)::BIGINT AS region_id FROM px JOIN geo USING (row, col) WHERE r >= 1 AND r < 3.2")
def annulus_select(spark, d):
    g = geo(spark)
    return shown(frames.select_region(pixels(spark, d), g, frames.regions(spark, [1.0, 2.0], [2.0, 3.2])), "frame_idx", "row", "col", "region_id", value="value")


@query(_w(PX, GEO) + "SELECT frame_idx, row, col, round(value, 6) + 0.0 AS value, (CASE WHEN theta < 120 THEN 0 WHEN theta < 240 THEN 1 ELSE 2 END)::BIGINT AS region_id FROM px JOIN geo USING (row, col) WHERE r >= 1 AND r < 4.5")
def wedge_select(spark, d):
    wanted = frames.regions(spark, [1.0], [5.0], n_wedges=3)
    return shown(frames.select_region(pixels(spark, d), geo(spark), wanted, mask(spark)), "frame_idx", "row", "col", "region_id", value="value")


@query(_w(PX, GEO) + "SELECT seq, frame_idx, floor(r / 1.5)::BIGINT AS region_id, count(value) AS n_valid, count(*) AS n_total, round(avg(value), 6) + 0.0 AS mean, round(median(value), 6) + 0.0 AS median, round(min(value), 6) + 0.0 AS low, round(max(value), 6) + 0.0 AS high FROM px JOIN geo USING (row, col) WHERE r < 4.5 GROUP BY ALL")
def region_stats(spark, d):
    wanted = frames.regions(spark, [0.0, 1.5, 3.0], [1.5, 3.0, 4.5])
    s = frames.region_statistics(frames.select_region(pixels(spark, d), geo(spark), wanted))
    return shown(s, "seq", "frame_idx", "region_id", "n_valid", "n_total", mean="mean", median="median", low="low", high="high")


@query(_w(GEO) + "SELECT row, col, (CASE WHEN r < 2 THEN 0 WHEN r < 4 THEN 1 ELSE 2 END)::BIGINT AS region_id FROM geo WHERE r < 5")
def ownership(spark, d):
    return shown(frames.check_ownership(frames.region_pixels(geo(spark), frames.regions(spark, [0.0, 2.0, 4.0], [2.0, 4.0, 5.0]))), "row", "col", "region_id")


# ---- combining ---------------------------------------------------------------------------------------------------

GATED = "count(value) AS n_good, count(*) AS n_total"


def _combined(spark, d, method, masked=False, weighted=False, **options):
    p = pixels(spark, d)
    if masked:
        p = frames.apply_mask(p, mask(spark), None)
    if weighted:
        p = p.join(stack(spark, d).select("seq", "frame_idx", "weight"), ["seq", "frame_idx"])
    return shown(combine.combine(p, method, weight="weight" if weighted else None, **options), "seq", "row", "col", "n_good", "n_total", value="value")


@query(_w(PX) + f"SELECT seq, row, col, round(avg(value), 6) + 0.0 AS value, {GATED} FROM px GROUP BY ALL")
def combine_mean(spark, d):
    return _combined(spark, d, "mean")


@query(_w(PX) + f"SELECT seq, row, col, round(median(value), 6) + 0.0 AS value, {GATED} FROM px GROUP BY ALL")
def combine_median(spark, d):
    return _combined(spark, d, "median")


@query(_w(PX, GEO, FR, MK) + f"SELECT seq, row, col, round(sum(weight * value) / sum(CASE WHEN value IS NOT NULL THEN weight END), 6) + 0.0 AS value, {GATED} FROM mpx JOIN fr USING (seq, frame_idx) GROUP BY ALL")
def combine_weighted(spark, d):
    return _combined(spark, d, "weighted", masked=True, weighted=True)


@query(_w(PX, "s AS (SELECT seq, row, col, median(value) AS m, stddev_pop(value) AS s FROM px GROUP BY ALL)") + "SELECT seq, row, col, round(avg(CASE WHEN abs(value - m) <= 2 * s + 1e-12 THEN value END), 6) + 0.0 AS value, count(value) AS n_good, count(*) AS n_total FROM px JOIN s USING (seq, row, col) GROUP BY ALL")
def combine_sigma_mean(spark, d):
    return _combined(spark, d, "sigma_mean", sigma=2.0)


VALID = "v AS (SELECT px.seq, px.row, px.col, CASE WHEN (px.frame_idx + px.row + px.col) % 3 > 0 THEN px.value END AS value FROM px)"


@query(_w(PX, VALID) + f"SELECT seq, row, col, round(CASE WHEN count(value) / count(*) >= 0.66 THEN median(value) END, 6) + 0.0 AS value, {GATED} FROM v GROUP BY ALL")
def combine_min_good(spark, d):
    p = pixels(spark, d).withColumn("valid", (F.col("frame_idx") + F.col("row") + F.col("col")) % 3 > 0)
    p = p.withColumn("value", combine.effective(valid="valid"))
    return shown(combine.combine(p, "median", min_good=0.66), "seq", "row", "col", "n_good", "n_total", value="value")


@query(_w(PX, GEO) + "SELECT seq, row, col, round(avg(CASE WHEN coalesce(CASE WHEN frame_idx % 4 > 0 THEN frame_idx % 4 > 1 END, geo.r < 4.5) THEN value END), 6) + 0.0 AS value, count(CASE WHEN coalesce(CASE WHEN frame_idx % 4 > 0 THEN frame_idx % 4 > 1 END, geo.r < 4.5) THEN value END) AS n_good FROM px JOIN geo USING (row, col) GROUP BY ALL")
def combine_mask_precedence(spark, d):
    p = pixels(spark, d).withColumn("valid", F.when(F.col("frame_idx") % 4 > 0, F.col("frame_idx") % 4 > 1)).join(F.broadcast(mask(spark)), ["row", "col"])
    p = p.withColumn("value", combine.effective(valid="valid", good="good"))
    return shown(combine.combine(p, "mean"), "seq", "row", "col", "n_good", value="value")


@query(_w(PX, GEO, MK, "s AS (SELECT *, value - avg(value) OVER (PARTITION BY seq, row, col) AS v FROM mpx), f AS (SELECT *, v - median(v) OVER (PARTITION BY seq, frame_idx) AS x FROM s)") + "SELECT seq, row, col, round(avg(x), 6) + 0.0 AS value, count(x) AS n_good, count(*) AS n_total FROM f GROUP BY ALL")
def entry_masked_combine(spark, d):
    p = combine.subtract_image(frames.apply_mask(pixels(spark, d), mask(spark), None), "mean")
    return shown(combine.combine(combine.subtract_level(p, "median"), "mean"), "seq", "row", "col", "n_good", "n_total", value="value")


for _name, _method, _stat in (("mean_image_sub", "mean", "avg"), ("median_image_sub", "median", "median")):

    @query(_w(PX) + f"SELECT seq, frame_idx, row, col, round(value - {_stat}(value) OVER (PARTITION BY seq, row, col), 6) + 0.0 AS value FROM px")
    def _image(spark, d, method=_method):
        return shown(combine.subtract_image(pixels(spark, d), method), "seq", "frame_idx", "row", "col", value="value")

    _QUERIES[_name], _SQL[_name] = _QUERIES.pop("_image"), _SQL.pop("_image")

for _name, _method, _stat in (("image_mean_sub", "mean", "avg"), ("image_median_sub", "median", "median")):

    @query(_w(PX) + f"SELECT seq, frame_idx, row, col, round(value - {_stat}(value) OVER (PARTITION BY seq, frame_idx), 6) + 0.0 AS value FROM px")
    def _level(spark, d, method=_method):
        return shown(combine.subtract_level(pixels(spark, d), method), "seq", "frame_idx", "row", "col", value="value")

    _QUERIES[_name], _SQL[_name] = _QUERIES.pop("_level"), _SQL.pop("_level")


@query(_w(PX, "m AS (SELECT *, sqrt(avg(value * value) OVER (PARTITION BY seq, row, col)) AS rms FROM px)") + "SELECT seq, frame_idx, row, col, round(CASE WHEN rms > 0 THEN value / rms ELSE value END, 6) + 0.0 AS value FROM m")
def pixel_rms_norm(spark, d):
    return shown(combine.normalize_rms(pixels(spark, d)), "seq", "frame_idx", "row", "col", value="value")


@query(_w(PX, GEO, MK) + "SELECT seq, frame_idx, row, col, round(value - median(value) OVER (PARTITION BY seq, row, col), 6) + 0.0 AS value FROM mpx")
def post_median_sub(spark, d):
    return shown(combine.median_residual(frames.apply_mask(pixels(spark, d), mask(spark), None)), "seq", "frame_idx", "row", "col", value="value")


@query(_w(PX) + "SELECT seq, frame_idx, round(sqrt(count(value) * var_pop(value)), 6) + 0.0 AS norm FROM px GROUP BY ALL")
def reference_norms(spark, d):
    return shown(combine.frame_norms(pixels(spark, d)), "seq", "frame_idx", norm="norm")


# ---- co-adding ---------------------------------------------------------------------------------------------------

EVENTS = "e AS (SELECT user_id AS seq, event_id AS frame_idx, epoch_us(ts) / 1e6::DOUBLE AS t, (event_id * 7.0::DOUBLE) % 360 AS angle, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)"


def observations(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("seq"), F.col("event_id").alias("frame_idx"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.pmod(F.col("event_id") * 7.0, F.lit(360.0)).alias("angle"), "value")


def _greedy_sql(count: int, time: float, angle: float) -> str:
    theta = "(g.last + ((e.angle - g.last + 180) % 360 + 360) % 360 - 180)"
    tests = []
    if count:
        tests.append(f"g.n >= {count}")
    if time:
        tests.append(f"e.t - g.t0 - {time} > 1e-6 * greatest(1, {time})")
    if angle:
        tests.append(f"greatest(g.hi, {theta}) - least(g.lo, {theta}) - {angle} > 1e-6 * greatest(1, {angle})")
    new = f"({' OR '.join(tests)})"
    return f"""WITH RECURSIVE {EVENTS},
g AS (SELECT seq, rn, frame_idx, t AS t0, 0::BIGINT AS grp, 1 AS n, angle AS last, angle AS lo, angle AS hi FROM e WHERE rn = 1
  UNION ALL
  SELECT e.seq, e.rn, e.frame_idx, CASE WHEN {new} THEN e.t ELSE g.t0 END, CASE WHEN {new} THEN g.grp + 1 ELSE g.grp END, CASE WHEN {new} THEN 1 ELSE g.n + 1 END,
         CASE WHEN {new} THEN e.angle ELSE {theta} END, CASE WHEN {new} THEN e.angle ELSE least(g.lo, {theta}) END, CASE WHEN {new} THEN e.angle ELSE greatest(g.hi, {theta}) END
  FROM g JOIN e ON e.seq = g.seq AND e.rn = g.rn + 1)
SELECT seq, frame_idx, grp FROM g"""


@query("WITH e AS (SELECT user_id AS seq, event_id AS frame_idx, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) SELECT seq, (k // 5)::BIGINT AS grp, round(avg(value), 6) + 0.0 AS mean, round(median(value), 6) + 0.0 AS median, count(*) AS n FROM e GROUP BY ALL")
def coadd_count(spark, d):
    e = selection.reindex(observations(spark, d))
    g = coadd.by_count(e, 5).groupBy("seq", "grp").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.count(F.lit(1)).alias("n"))
    return shown(g, "seq", "grp", "n", mean="mean", median="median")


@query(_greedy_sql(0, 86400.0, 0))
def coadd_time(spark, d):
    return coadd.greedy(observations(spark, d), max_time=86400.0).select("seq", "frame_idx", "grp")


@query(_greedy_sql(0, 0, 120.0))
def coadd_angle(spark, d):
    return coadd.greedy(observations(spark, d), max_angle=120.0).select("seq", "frame_idx", "grp")


@query(_greedy_sql(6, 172800.0, 300.0))
def coadd_limits(spark, d):
    return coadd.greedy(observations(spark, d), 6, 172800.0, 300.0).select("seq", "frame_idx", "grp")


@query(f"WITH {EVENTS}, k AS (SELECT *, (rn - 1) // 8 AS grp FROM e) SELECT seq, grp::BIGINT AS grp, round(avg(value), 6) + 0.0 AS card, round(min_by(value, frame_idx), 6) + 0.0 AS start_card, round(max_by(value, frame_idx), 6) + 0.0 AS end_card, round(max_by(value, frame_idx) - min_by(value, frame_idx), 6) + 0.0 AS delta_card, count(*) AS n FROM k GROUP BY ALL")
def coadd_header(spark, d):
    e = observations(spark, d)
    e = e.withColumn("grp", F.floor((F.row_number().over(Window.partitionBy("seq").orderBy("frame_idx")) - 1) / 8))
    h = coadd.header_means(e, ["seq", "grp"], F.col("value"), "card")
    return shown(h, "seq", "grp", "n", card="card", start_card="start_card", end_card="end_card", delta_card="delta_card")


@query(_w(PX, "k AS (SELECT *, dense_rank() OVER (PARTITION BY seq ORDER BY frame_idx) - 1 AS i FROM px)") + "SELECT seq, (i // 4)::BIGINT AS grp, row, col, round(median(value), 6) + 0.0 AS value FROM k GROUP BY ALL")
def coadd_frames(spark, d):
    groups = stack(spark, d).select("seq", "frame_idx").withColumn("grp", F.floor((F.row_number().over(Window.partitionBy("seq").orderBy("frame_idx")) - 1) / 4))
    return shown(coadd.coadd_pixels(pixels(spark, d), groups, "median"), "seq", "grp", "row", "col", value="value")


UNWRAP = f"WITH {EVENTS}, s AS (SELECT *, coalesce(((angle - lag(angle) OVER w + 180) % 360 + 360) % 360 - 180, 0) AS step, first(angle) OVER w AS a0 FROM e WINDOW w AS (PARTITION BY seq ORDER BY frame_idx)), u AS (SELECT *, a0 + sum(step) OVER (PARTITION BY seq ORDER BY frame_idx) AS theta, sum(abs(step)) OVER (PARTITION BY seq ORDER BY frame_idx) AS path FROM s)"


@query(UNWRAP + " SELECT seq, frame_idx, round(theta, 6) + 0.0 AS theta, round(path, 6) + 0.0 AS path FROM u")
def unwrap_angle(spark, d):
    return shown(coadd.unwrap(observations(spark, d)), "seq", "frame_idx", theta="theta", path="path")


@query(UNWRAP + " SELECT seq, round((avg(theta) % 360 + 360) % 360, 6) + 0.0 AS mean_angle, round(max(path), 6) + 0.0 AS path FROM u GROUP BY seq")
def circular_mean(spark, d):
    u = coadd.unwrap(observations(spark, d)).groupBy("seq").agg(F.avg("theta").alias("m"), F.max("path").alias("path"))
    return shown(u, "seq", mean_angle=ex.angle_mod(F.col("m")), path="path")


# ---- filters -----------------------------------------------------------------------------------------------------


@query(_w(PX, GEO) + "SELECT seq, frame_idx, floor(r)::BIGINT AS bin, round(avg(value), 6) + 0.0 AS mean, round(median(value), 6) + 0.0 AS median, round(stddev_pop(value), 6) + 0.0 AS std, count(value) AS n FROM px JOIN geo USING (row, col) GROUP BY ALL")
def radial_profile(spark, d):
    return shown(filters.radial_profile(pixels(spark, d), geo(spark)), "seq", "frame_idx", "bin", "n", mean="mean", median="median", std="std")


@query(_w(PX, GEO) + "SELECT seq, frame_idx, row, col, round(value - median(value) OVER (PARTITION BY seq, frame_idx, floor(r)), 6) + 0.0 AS value FROM px JOIN geo USING (row, col)")
def radial_profile_sub(spark, d):
    return shown(filters.subtract_profile(pixels(spark, d), geo(spark)), "seq", "frame_idx", "row", "col", value="value")


@query(_w(PX, GEO, "s AS (SELECT *, stddev_pop(value) OVER (PARTITION BY seq, frame_idx, floor(r)) AS std FROM px JOIN geo USING (row, col))") + "SELECT seq, frame_idx, row, col, round(CASE WHEN std > 0 THEN value / std END, 6) + 0.0 AS snr FROM s WHERE r >= 1 AND r < 4.5")
def radial_std_snr(spark, d):
    return shown(filters.radial_snr(pixels(spark, d), geo(spark), rmin=1.0, rmax=4.5), "seq", "frame_idx", "row", "col", snr="snr")


def _near(reach: str) -> str:
    return f"FROM px a JOIN px b ON a.seq = b.seq AND a.frame_idx = b.frame_idx AND {reach} GROUP BY a.seq, a.frame_idx, a.row, a.col, a.value"


@query(_w(PX) + "SELECT a.seq, a.frame_idx, a.row, a.col, round(CASE WHEN count(*) = 9 THEN a.value - median(b.value) ELSE 0 END, 6) + 0.0 AS value " + _near("b.row - a.row BETWEEN -1 AND 1 AND b.col - a.col BETWEEN -1 AND 1"))
def median_usm(spark, d):
    return shown(filters.median_unsharp(pixels(spark, d), 3), "seq", "frame_idx", "row", "col", value="value")


def _gauss_sql(fwhm: float, half: int, value: str = "px") -> str:
    s = 2 * (fwhm / filters.FWHM_SIGMA) ** 2
    w = f"exp(-((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)) / {s!r})"
    return f"sum({w} * b.value) / sum({w})"


@query(_w(PX) + f"SELECT a.seq, a.frame_idx, a.row, a.col, round(a.value - {_gauss_sql(2.0, 2)}, 6) + 0.0 AS value " + _near("abs(b.row - a.row) <= 2 AND abs(b.col - a.col) <= 2"))
def gauss_usm(spark, d):
    return shown(filters.gauss_unsharp(pixels(spark, d), 2.0), "seq", "frame_idx", "row", "col", value="value")


HIGH = f"hp AS (SELECT a.seq, a.frame_idx, a.row, a.col, a.value - {_gauss_sql(3.0, 3)} AS value FROM mpx a JOIN mpx b ON a.seq = b.seq AND a.frame_idx = b.frame_idx AND abs(b.row - a.row) <= 3 AND abs(b.col - a.col) <= 3 AND b.value IS NOT NULL GROUP BY a.seq, a.frame_idx, a.row, a.col, a.value)"


@query(_w(PX, GEO, MK, HIGH) + f"SELECT a.seq, a.frame_idx, a.row, a.col, round(CASE WHEN a.value IS NOT NULL THEN {_gauss_sql(1.0, 2)} END, 6) + 0.0 AS value FROM hp a JOIN hp b ON a.seq = b.seq AND a.frame_idx = b.frame_idx AND abs(b.row - a.row) <= 2 AND abs(b.col - a.col) <= 2 AND b.value IS NOT NULL GROUP BY a.seq, a.frame_idx, a.row, a.col, a.value")
def masked_gauss_filter(spark, d):
    p = frames.apply_mask(pixels(spark, d), mask(spark), None)
    return shown(filters.masked_gauss(p, 3.0, 1.0), "seq", "frame_idx", "row", "col", value="value")


@query(_w(PX, GEO, "pr AS (SELECT a.row, a.col, b.row AS r2, b.col AS c2 FROM geo a JOIN geo b ON abs(a.r - b.r) <= 1 + 1e-9 AND abs(((b.theta - a.theta + 180) % 360 + 360) % 360 - 180) <= least(45, degrees(2 / a.r)) + 1e-9)") + "SELECT a.seq, a.frame_idx, a.row, a.col, round(a.value - median(b.value), 6) + 0.0 AS value FROM px a JOIN pr ON pr.row = a.row AND pr.col = a.col JOIN px b ON b.seq = a.seq AND b.frame_idx = a.frame_idx AND b.row = pr.r2 AND b.col = pr.c2 GROUP BY a.seq, a.frame_idx, a.row, a.col, a.value")
def az_usm(spark, d):
    return shown(filters.azimuthal_unsharp(pixels(spark, d), geo(spark), 1.0, 2.0), "seq", "frame_idx", "row", "col", value="value")


# ---- measuring ---------------------------------------------------------------------------------------------------

SIGNALS = [(1.5, 30.0, 1.2), (2.5, 200.0, 1.2), (3.0, 310.0, 1.2)]
SIG = "sig AS (SELECT i AS signal, sep, pa, 3.5 - sep * sin(radians(pa)) AS x, 3.5 + sep * cos(radians(pa)) AS y FROM (VALUES " + ", ".join(f"({i}, {s}::DOUBLE, {p}::DOUBLE)" for i, (s, p, _) in enumerate(SIGNALS)) + ") t(i, sep, pa))"
CELLS = "cells AS (SELECT signal, row, col FROM geo, sig WHERE (row - x) * (row - x) + (col - y) * (col - y) <= 1.44)"


def signals(spark: SparkSession) -> DataFrame:
    return measure.place_signals(spark.createDataFrame([(i, *s) for i, s in enumerate(SIGNALS)], "signal int, separation double, position_angle double, exclusion double"), SIZE)


@query(_w(SIG) + "SELECT signal::BIGINT AS signal, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(sqrt((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5)), 6) + 0.0 AS sep, round(pa, 6) + 0.0 AS pa FROM sig")
def signal_coords(spark, d):
    sep, pa = ex.trial_polar(F.col("x") - 3.5, F.col("y") - 3.5)
    return shown(signals(spark), "signal", x="x", y="y", sep=sep, pa=pa)


@query(_w(PX, GEO, SIG, CELLS) + "SELECT frame_idx, signal::BIGINT AS signal, round(max(value), 6) + 0.0 AS value FROM px JOIN cells USING (row, col) GROUP BY ALL")
def aperture_max(spark, d):
    cells = measure.aperture_cells(geo(spark), signals(spark), 1.2)
    return shown(measure.aperture_maximum(pixels(spark, d), cells, ["frame_idx"], "value"), "frame_idx", "signal", value="value")


@query(_w(PX, GEO, MK, SIG, CELLS) + "SELECT frame_idx, signal::BIGINT AS signal, round(CASE WHEN count(value) = count(*) THEN avg(value * value) END, 6) + 0.0 AS merit FROM mpx JOIN cells USING (row, col) GROUP BY ALL")
def aperture_l2(spark, d):
    cells = measure.aperture_cells(geo(spark), signals(spark), 1.2)
    return shown(measure.aperture_mean_square(frames.apply_mask(pixels(spark, d), mask(spark), None), cells, ["frame_idx"]), "frame_idx", "signal", merit="merit")


@query(_w(PX, GEO, SIG, CELLS, "pl AS (SELECT seq, row, col, avg(value) AS value FROM px GROUP BY ALL), dev AS (SELECT seq, floor(r) AS bin, stddev_pop(value) AS std FROM pl JOIN geo USING (row, col) WHERE (row, col) NOT IN (SELECT (row, col) FROM cells) GROUP BY ALL)") + "SELECT pl.seq AS plane, signal::BIGINT AS signal, round(max(CASE WHEN std > 0 THEN value / std END), 6) + 0.0 AS snr, round(any_value(sep), 6) + 0.0 AS separation FROM pl JOIN geo USING (row, col) JOIN cells USING (row, col) JOIN sig USING (signal) LEFT JOIN dev ON dev.seq = pl.seq AND dev.bin = floor(geo.r) GROUP BY pl.seq, signal")
def snr_table(spark, d):
    plane = combine.combine(pixels(spark, d)).select(F.col("seq").alias("plane"), F.col("seq").cast("double").alias("mode"), "row", "col", "value")
    t = pipelines.analyze(spark, plane, SIZE, pipelines.Analysis(SIGNALS, aperture=1.2))
    return shown(t, "plane", "signal", snr="snr", separation="separation")


STAMP = [(a, b, 1.0 / (1 + a * a + b * b)) for a in (-1, 0, 1) for b in (-1, 0, 1)]


@query(_w(PX, GEO, MK, "im AS (SELECT seq, row, col, avg(value) AS value FROM mpx GROUP BY ALL), st AS (SELECT a, b, 1.0::DOUBLE / (1 + a * a + b * b) AS h FROM (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b))") + "SELECT p.seq, p.row, p.col, round(CASE WHEN count(*) / 9 >= 0.5 THEN sum(h * q.value) / sum(h * h) END, 6) + 0.0 AS amplitude, count(*) AS n_support FROM im p JOIN im q ON p.seq = q.seq AND abs(q.row - p.row) <= 1 AND abs(q.col - p.col) <= 1 AND q.value IS NOT NULL JOIN st ON st.a = q.row - p.row AND st.b = q.col - p.col GROUP BY p.seq, p.row, p.col")
def psf_filter_amplitude(spark, d):
    im = combine.combine(frames.apply_mask(pixels(spark, d), mask(spark), None)).select("seq", "row", "col", "value")
    stamp = spark.createDataFrame(STAMP, "d_row int, d_col int, h double")
    return shown(measure.psf_amplitude(im, stamp, ["seq"], 0.5), "seq", "row", "col", "n_support", amplitude="amplitude")


JACK = "k AS (SELECT seq, frame_idx, avg(value) AS a, max(value) AS b FROM px GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY frame_idx) - 1 AS n, count(*) OVER (PARTITION BY seq) AS c FROM k), bl AS (SELECT *, ((n + 1) * 5 - 1) // c AS block FROM i), z AS (SELECT x.seq, y.block, avg(x.a) AS a, avg(x.b) AS b FROM bl x JOIN (SELECT DISTINCT seq, block FROM bl) y ON x.seq = y.seq AND x.block <> y.block GROUP BY ALL)"


def _estimates(spark, d):
    k = pixels(spark, d).groupBy("seq", "frame_idx").agg(F.avg("value").alias("a"), F.max("value").alias("b"))
    k = k.withColumn("n", F.row_number().over(Window.partitionBy("seq").orderBy("frame_idx")) - 1).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("seq")))
    return measure.jackknife(k, measure.contiguous_block(F.col("n"), F.col("c"), 5), 5, ["a", "b"], ["seq"])


@query(_w(PX, JACK) + "SELECT seq, block::BIGINT AS block, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b FROM z")
def jackknife_blocks(spark, d):
    return shown(_estimates(spark, d), "seq", "block", a="a", b="b")


@query(_w(PX, JACK) + "SELECT seq, count(*) AS n_blocks, round(avg(a), 6) + 0.0 AS mean_a, round(avg(b), 6) + 0.0 AS mean_b, round((count(*) - 1) * covar_pop(a, b), 6) + 0.0 AS covariance, round(sqrt((count(*) - 1) * var_pop(a)), 6) + 0.0 AS error_a, round(sqrt((count(*) - 1) * var_pop(b)), 6) + 0.0 AS error_b FROM z GROUP BY seq")
def jackknife_cov(spark, d):
    c = measure.jackknife_covariance(_estimates(spark, d), "a", "b", ["seq"])
    return shown(c, "seq", "n_blocks", mean_a="mean_a", mean_b="mean_b", covariance="covariance", error_a="error_a", error_b="error_b")


# ---- references --------------------------------------------------------------------------------------------------

GRAM = "n AS (SELECT seq, frame_idx, sqrt(sum(v * v)) AS norm FROM cen GROUP BY ALL), ar AS (SELECT seq, frame_idx, list(v ORDER BY col, row) AS a FROM cen GROUP BY ALL)"


def ready(spark, d):
    return references.centred(stack(spark, d))


@query(_w(PX, CEN, GRAM) + "SELECT x.seq, x.frame_idx AS i, y.frame_idx AS j, round(list_dot_product(x.a, y.a), 6) + 0.0 AS value FROM ar x JOIN ar y ON x.seq = y.seq AND x.frame_idx <= y.frame_idx")
def gram_reference(spark, d):
    return shown(references.gram(ready(spark, d)), "seq", "i", "j", value="value")


@query(_w(PX, CEN) + "SELECT a.seq, a.row + 8 * a.col AS i, b.row + 8 * b.col AS j, round(sum(a.v * b.v), 6) + 0.0 AS value FROM cen a JOIN cen b ON a.seq = b.seq AND a.frame_idx = b.frame_idx AND a.row + 8 * a.col <= b.row + 8 * b.col GROUP BY ALL")
def gram_pixel(spark, d):
    return shown(references.pixel_gram(ready(spark, d)), "seq", "i", "j", value="value")


RANKED = "SELECT seq, target, reference, rank::BIGINT AS rank, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY seq, target ORDER BY {order}, reference) AS rank FROM pairs) WHERE rank <= {k}"


def _pairs_sql(score: str, where: str) -> str:
    return _w(PX, FR, CEN, GRAM, f"pairs AS (SELECT t.seq, t.frame_idx AS target, r.frame_idx AS reference, {score} AS score FROM fr t JOIN fr r ON t.seq = r.seq JOIN ar ta ON ta.seq = t.seq AND ta.frame_idx = t.frame_idx JOIN ar ra ON ra.seq = r.seq AND ra.frame_idx = r.frame_idx JOIN n tn ON tn.seq = t.seq AND tn.frame_idx = t.frame_idx JOIN n rn ON rn.seq = r.seq AND rn.frame_idx = r.frame_idx WHERE {where})")


CORR = "list_dot_product(ta.a, ra.a) / (tn.norm * rn.norm)"
ARC = f"abs({SMALL_ANGLES})"


def _ranked(spark, d, window, method, k):
    p = references.frame_pairs(ready(spark, d), ["frame_idx", "angle", "mjd", "v", "norm"], window)
    return shown(references.rank_references(p, method, k), "seq", "target", "reference", "rank", score="score")


@query(_pairs_sql(CORR, "true") + RANKED.format(order="score DESC", k=5))
def ref_select_corr(spark, d):
    return shown(references.best_correlated(ready(spark, d), 5), "seq", "target", "reference", "rank", score="score")


@query(_pairs_sql("round(abs(t.frame_idx - r.frame_idx) / 86400.0::DOUBLE, 10)", "abs(t.frame_idx - r.frame_idx) > 40") + RANKED.format(order="score", k=4))
def ref_select_time(spark, d):
    p = references.frame_pairs(stack(spark, d).withColumn("mjd", F.col("frame_idx") / F.lit(86400.0)), ["frame_idx", "mjd"], references.outside_window("imno", 40))
    p = references.rank_references(p.withColumn("t_mjd", F.round(F.abs(F.col("t_mjd") - F.col("r_mjd")), 10)).withColumn("r_mjd", F.lit(0.0)), "time", 4)
    return shown(p, "seq", "target", "reference", "rank", score="score")


@query(_pairs_sql(ARC, f"{ARC} > 20") + RANKED.format(order="score", k=4))
def ref_select_angle(spark, d):
    return _ranked(spark, d, references.outside_window("angle", 20.0), "angle", 4)


@query(_pairs_sql("abs(t.frame_idx - r.frame_idx)::DOUBLE", "abs(t.frame_idx - r.frame_idx) > 30 AND abs(t.frame_idx - r.frame_idx) <= 200") + RANKED.format(order="score", k=6))
def ref_exclude_imno(spark, d):
    return _ranked(spark, d, references.outside_window("imno", 30, 200), "imno", 6)


@query(_pairs_sql("r.frame_idx::DOUBLE", f"{ARC} > degrees(atan(1.0::DOUBLE / 2)) AND {ARC} <= degrees(atan(3.0::DOUBLE / 2))") + RANKED.format(order="score", k=3))
def ref_exclude_pixel(spark, d):
    return _ranked(spark, d, references.outside_window("pixel", 1.0, 3.0, 2.0), "all", 3)


NEAR = f"""q AS (SELECT t.seq, t.frame_idx AS target, r.frame_idx AS neighbour, r.frame_idx < t.frame_idx AS earlier FROM fr t JOIN fr r ON t.seq = r.seq AND t.frame_idx <> r.frame_idx WHERE radians({ARC}) * 3 >= 1.5),
k AS (SELECT *, row_number() OVER (PARTITION BY seq, target, earlier ORDER BY abs(target - neighbour)) AS k, count(*) FILTER (earlier) OVER (PARTITION BY seq, target) AS nb, count(*) FILTER (NOT earlier) OVER (PARTITION BY seq, target) AS na FROM q),
z AS (SELECT *, least(nb, 2 + greatest(0, 2 - na)) AS tb FROM k WHERE nb + na >= 4),
y AS (SELECT * FROM z WHERE CASE WHEN earlier THEN k <= tb ELSE k <= least(na, 4 - tb) END)"""


@query(_w(FR, NEAR) + "SELECT seq, target, neighbour, (row_number() OVER (PARTITION BY seq, target ORDER BY earlier DESC, k) - 1)::BIGINT AS slot FROM y")
def temporal_neighbours(spark, d):
    return shown(references.neighbours(stack(spark, d), 2, 3.0, 1.5), "seq", "target", "neighbour", "slot")


@query(_w(FR, f"p AS (SELECT t.seq, t.frame_idx AS target, least(9.0, radians({ARC}) * 3) AS d FROM fr t JOIN fr r ON t.seq = r.seq AND t.frame_idx <> r.frame_idx), o AS (SELECT *, row_number() OVER (PARTITION BY seq, target ORDER BY d DESC) AS k FROM p)") + "SELECT seq, round(max(d), 6) + 0.0 AS displacement FROM o WHERE k = 4 GROUP BY seq")
def fallback_displacement(spark, d):
    return shown(references.feasible_radius(stack(spark, d), 2, 3.0, 9.0), "seq", displacement="displacement")


# ---- resampling --------------------------------------------------------------------------------------------------

KEY = "CASE WHEN abs({x}) <= 1 THEN (1.5 * abs({x}) - 2.5) * abs({x}) * abs({x}) + 1 WHEN abs({x}) < 2 THEN ((-0.5 * abs({x}) + 2.5) * abs({x}) - 4) * abs({x}) + 2 ELSE 0 END"
FOOT = "SELECT {k}, a + i AS in_row, b + j AS in_col, (" + KEY.format(x="(i - u)") + ") * (" + KEY.format(x="(j - v)") + ") AS w FROM {src}, (VALUES (-1), (0), (1), (2)) s(i), (VALUES (-1), (0), (1), (2)) t(j)"
ROT = "att AS (SELECT seq, frame_idx, row, col, (row - 3.5) * cos(derot) + (col - 3.5) * sin(derot) + 3.5 AS x, -(row - 3.5) * sin(derot) + (col - 3.5) * cos(derot) + 3.5 AS y FROM fr, geo WHERE derot <> 0), fl AS (SELECT *, floor(x)::INT AS a, floor(y)::INT AS b, x - floor(x) AS u, y - floor(y) AS v FROM att), taps AS (" + FOOT.format(k="seq, frame_idx, row, col", src="fl") + ")"
ROTATED = ROT + ", ro AS (SELECT t.seq, t.frame_idx, t.row, t.col, sum(w * p.value) AS value FROM taps t JOIN {px} p ON p.seq = t.seq AND p.frame_idx = t.frame_idx AND p.row = t.in_row AND p.col = t.in_col AND p.value IS NOT NULL GROUP BY ALL HAVING count(*) = 16 UNION ALL SELECT p.seq, p.frame_idx, p.row, p.col, p.value FROM {px} p JOIN fr USING (seq, frame_idx) WHERE derot = 0)"


def angles(spark, d):
    return stack(spark, d).select("seq", "frame_idx", ex.derotation(F.col("angle")).alias("derot"))


@query(_w(PX, GEO, FR, ROTATED.format(px="px")) + "SELECT seq, frame_idx, row, col, round(value, 6) + 0.0 AS value FROM ro")
def cubic_rotate(spark, d):
    return shown(resample.derotate(pixels(spark, d), angles(spark, d), geo(spark), SIZE), "seq", "frame_idx", "row", "col", value="value")


@query(_w(PX, GEO, "fl AS (SELECT row, col, floor(row - 0.3::DOUBLE)::INT AS a, floor(col + 0.7::DOUBLE)::INT AS b, row - 0.3::DOUBLE - floor(row - 0.3::DOUBLE) AS u, col + 0.7::DOUBLE - floor(col + 0.7::DOUBLE) AS v FROM geo), taps AS (" + FOOT.format(k="row, col", src="fl") + ")") + "SELECT p.seq, p.frame_idx, t.row, t.col, round(sum(w * p.value), 6) + 0.0 AS value FROM taps t JOIN px p ON p.row = t.in_row AND p.col = t.in_col GROUP BY ALL HAVING count(*) = 16")
def cubic_shift(spark, d):
    return shown(resample.shift(pixels(spark, d), geo(spark), 0.3, -0.7), "seq", "frame_idx", "row", "col", value="value")


@query(_w(PX, GEO, FR, MK, ROTATED.format(px="mpx"), "n AS (SELECT seq, count(*) AS n FROM fr GROUP BY seq)") + "SELECT ro.seq, row, col, round(CASE WHEN count(value) / any_value(n.n) >= 0.2 THEN avg(value) END, 6) + 0.0 AS value, count(value) AS n_good, any_value(n.n) AS n_total FROM ro JOIN n ON n.seq = ro.seq GROUP BY ALL")
def derotate_combine(spark, d):
    p = frames.apply_mask(pixels(spark, d), mask(spark), None)
    rows = p.withColumn("mode_idx", F.lit(0))
    done = pipelines.finalize(rows, angles(spark, d), geo(spark), SIZE, pipelines.Finish(min_good=0.2))
    return shown(done, "seq", "row", "col", "n_good", "n_total", value="value")


SOURCES = [(1.5, 30.0, 0.5), (3.0, 200.0, 0.25)]
SIGMA2 = 2 * (2.0 / 2.3548200450309493) ** 2
SRC = "src AS (SELECT * FROM (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in SOURCES) + ") t(sep, pa, con))"


@query(_w(PX, FR, SRC, f"ad AS (SELECT px.seq, px.frame_idx, px.row, px.col, px.value, sum(con * exp(-((row - 3.5 - sep * sin(derot - radians(pa))) * (row - 3.5 - sep * sin(derot - radians(pa))) + (col - 3.5 - sep * cos(derot - radians(pa))) * (col - 3.5 - sep * cos(derot - radians(pa)))) / {SIGMA2!r})) AS a FROM px JOIN fr USING (seq, frame_idx), src GROUP BY ALL)") + "SELECT seq, frame_idx, row, col, round(value + a, 6) + 0.0 AS value FROM ad")
def inject_fake(spark, d):
    sources = spark.createDataFrame(SOURCES, "separation double, position_angle double, contrast double")
    return shown(resample.inject(pixels(spark, d), angles(spark, d), sources, geo(spark), SIZE, 2.0), "seq", "frame_idx", "row", "col", value="value")


@query(_w(GEO, FR, "att AS (SELECT seq, frame_idx, row, col, floor((row - 3.5) * cos(derot) + (col - 3.5) * sin(derot) + 4)::INT AS a, floor(-(row - 3.5) * sin(derot) + (col - 3.5) * cos(derot) + 4)::INT AS b FROM fr, geo)") + "SELECT seq, frame_idx, count(*) FILTER (coalesce(g.r < 3, false)) AS n_good, count(*) AS n FROM att LEFT JOIN geo g ON g.row = att.a AND g.col = att.b GROUP BY ALL")
def mask_rotate(spark, d):
    m = resample.rotate_mask(frames.disk_mask(geo(spark), 3.0), angles(spark, d), geo(spark), SIZE)
    return shown(m.groupBy("seq", "frame_idx").agg(F.count_if("good").alias("n_good"), F.count(F.lit(1)).alias("n")), "seq", "frame_idx", "n_good", "n")


@query(_w(PX) + "SELECT seq, frame_idx, row - 2 AS row, col - 2 AS col, round(value, 6) + 0.0 AS value FROM px WHERE row BETWEEN 2 AND 5 AND col BETWEEN 2 AND 5")
def pad_cut(spark, d):
    return shown(resample.pad_or_cut(pixels(spark, d), SIZE, 4), "seq", "frame_idx", "row", "col", value="value")


@query(_w(GEO, FR, ROT, "ok AS (SELECT seq, frame_idx, row, col FROM taps WHERE in_row BETWEEN 0 AND 7 AND in_col BETWEEN 0 AND 7 AND row BETWEEN 3 AND 4 AND col BETWEEN 5 AND 6 GROUP BY ALL HAVING count(*) = 16), fs AS (SELECT DISTINCT seq, in_row, in_col, frame_idx FROM taps JOIN ok USING (seq, frame_idx, row, col))") + "SELECT seq, in_row AS row, in_col AS col, count(*) AS n_frames, min(frame_idx) AS head, max(frame_idx) AS tail FROM fs GROUP BY ALL")
def sparse_dependency_frames(spark, d):
    taps = resample.rotation_taps(angles(spark, d).filter("derot <> 0"), geo(spark), SIZE).filter(resample.inside(SIZE))
    s = resample.dependency_frames(taps, F.col("row").between(3, 4) & F.col("col").between(5, 6))
    return shown(s.select("seq", F.col("in_row").alias("row"), F.col("in_col").alias("col"), F.size("frames").alias("n_frames"), F.array_min("frames").alias("head"), F.array_max("frames").alias("tail")), "seq", "row", "col", "n_frames", "head", "tail")


@query(_w(GEO, FR, ROT) + "SELECT t.seq, t.row, t.col, bit_or(CASE WHEN g.row IS NULL THEN 1 WHEN g.r >= 4.5 THEN 2 ELSE 0 END)::BIGINT AS reasons FROM taps t LEFT JOIN geo g ON g.row = t.in_row AND g.col = t.in_col GROUP BY ALL")
def invalid_reason_or(spark, d):
    taps = resample.rotation_taps(angles(spark, d).filter("derot <> 0"), geo(spark), SIZE)
    return shown(resample.footprint_reasons(taps, mask(spark), SIZE), "seq", "row", "col", "reasons")


# ---- local geometry and models -----------------------------------------------------------------------------------

WEDGE = "wedge AS (SELECT row, col FROM geo WHERE r >= 1.5 AND r <= 4.5 AND abs(((theta + 180) % 360 + 360) % 360 - 180) <= 60 + 1e-9)"


@query(_w(GEO, WEDGE) + "SELECT row, col FROM wedge")
def or_wedge_offsets(spark, d):
    half = measure.half_angle(4.0, 3.0, 60.0)
    return shown(measure.predictor_wedge(geo(spark), 2.0, 4.0, half), "row", "col")


@query(_w(GEO, WEDGE, "t AS (SELECT row AS t_row, col AS t_col FROM geo WHERE r >= 2 AND r < 3), p AS (SELECT t_row, t_col, row, col, row - t_row AS dr, col - t_col AS dc FROM t, wedge)") + "SELECT t_row, t_col, row, col, (CASE WHEN sqrt((CASE WHEN dr > 1 THEN dr - 1 WHEN dr < -2 THEN -dr - 2 ELSE 0 END) ** 2 + (CASE WHEN dc > 1 THEN dc - 1 WHEN dc < -2 THEN -dc - 2 ELSE 0 END) ** 2) > 1.5 THEN 1 ELSE 0 END)::BIGINT AS kernel_support FROM p WHERE sqrt(dr * dr + dc * dc) > 1.5")
def predictor_exclusion(spark, d):
    g = geo(spark)
    wedge, targets = measure.predictor_wedge(g, 2.0, 4.0, 60.0), g.filter("r >= 2 and r < 3")
    near = measure.exclude_center(wedge, targets, 1.5)
    strict = measure.exclude_center(wedge, targets, 1.5, "kernel_support").withColumn("kernel_support", F.lit(1))
    return shown(near.join(strict, ["t_row", "t_col", "row", "col"], "left").fillna(0, ["kernel_support"]), "t_row", "t_col", "row", "col", "kernel_support")


@query()
def kl_residual_energy(spark, d):
    """Residual energy by frame and number of modes after principal-component subtraction in two annuli."""
    inside = frames.select_region(pixels(spark, d), geo(spark), frames.regions(spark, [0.0, 2.0], [2.0, 4.5]))
    r = models.kl_subtract(inside, [1, 5, 10])
    return shown(r.groupBy("seq", "n_modes", "frame_idx").agg(F.sum(F.col("value") * F.col("value")).alias("energy"), F.count(F.lit(1)).alias("n")), "seq", "n_modes", "frame_idx", "n", energy="energy")


@query()
def pixel_fit_energy(spark, d):
    """Residual energy by pixel and number of modes after regression on the local neighbourhood."""
    near = models.local_predictors(geo(spark), 1.5, 3.0, 2.0, 2.0, 6.0, 90.0, 1.5)
    r = models.pixel_models(pixels(spark, d), near, [1, 3, 6])
    return shown(r.groupBy("seq", "t_row", "t_col", "n_modes", "rank").agg(F.sum(F.col("value") * F.col("value")).alias("energy")), "seq", "t_row", "t_col", "n_modes", "rank", energy="energy")


@query()
def kl_final_images(spark, d):
    """The whole principal-component reduction: annuli, exclusion by frame number, derotation, combination."""
    s = stack(spark, d).select("seq", "frame_idx", "pixels", "angle")
    done = pipelines.principal_reduction(spark, s, SIZE, [1.0], [4.5], [1, 4], exclude="imno", least=20, finish=pipelines.Finish(min_good=0.2))
    return shown(done, "seq", "mode_idx", "row", "col", "n_good", "n_total", value="value")


@query(_w(PX, GEO, SIG, CELLS, "im AS (SELECT row, col, avg(value) AS value FROM px GROUP BY ALL), g AS (SELECT i, 0.05::DOUBLE * i AS c FROM range(9) t(i))") + "SELECT i::BIGINT AS trial, signal::BIGINT AS signal, round(c, 6) + 0.0 AS contrast, round(avg((value - c * exp(-((im.row - x) * (im.row - x) + (im.col - y) * (im.col - y)) / 2)) * (value - c * exp(-((im.row - x) * (im.row - x) + (im.col - y) * (im.col - y)) / 2))), 6) + 0.0 AS merit FROM im JOIN cells USING (row, col) JOIN sig USING (signal), g GROUP BY ALL")
def contrast_grid(spark, d):
    """A dense scan as one job: every trial contrast of every signal, by its aperture's mean square."""
    im = combine.combine(pixels(spark, d), keys=["row", "col"])
    cells = measure.aperture_cells(geo(spark), signals(spark), 1.2)
    trials = spark.range(9).select(F.col("id").alias("trial"), (F.col("id") * 0.05).alias("contrast"))
    at = im.join(F.broadcast(cells), ["row", "col"]).join(F.broadcast(signals(spark)), "signal").join(F.broadcast(trials))
    d2 = F.pow(F.col("row") - F.col("x"), 2) + F.pow(F.col("col") - F.col("y"), 2)
    left = F.col("value") - F.col("contrast") * F.exp(-d2 / 2)
    return shown(at.groupBy("trial", "signal", "contrast").agg(F.avg(left * left).alias("merit")), "trial", "signal", contrast="contrast", merit="merit")


# ---- local work on regressions (rows only; compared with whole refits and plain numpy in the tests) ----------------

LOCAL = local.Region(1.0, 4.5, 2.0, 2.0, 8.0, 180.0, 1.5, modes=2)


@query()
def local_trials(spark, d):
    """Merits of a grid of contrasts at one place, each by refitting only the pixels that its aperture depends on."""
    s = stack(spark, d).select("seq", "frame_idx", "pixels", "angle")
    t = local.evaluate_trials(spark, s, SIZE, LOCAL, [(2.0, 40.0, c / 4) for c in range(5)], (2.0, 40.0), 0.8, 2.0)
    return shown(t, "seq", "trial", merit="merit")


@query()
def neighbour_fit_energy(spark, d):
    """Pixel regression with neighbour frames' disk pixels among the predictors."""
    s = stack(spark, d)
    near = models.local_predictors(geo(spark), 1.5, 2.5, 1.5, 1.5, 5.0, 90.0, 1.5)
    r = local.neighbour_models(pixels(spark, d), s, near, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)], 1, 2.0, 1.5, [2])
    return shown(r.groupBy("seq", "t_row", "t_col", "rank").agg(F.sum(F.col("value") * F.col("value")).alias("energy"), F.count(F.lit(1)).alias("n")), "seq", "t_row", "t_col", "rank", "n", energy="energy")


@query()
def sky_fit_energy(spark, d):
    """Regression of sky-fixed pixels."""
    region = local.Region(0.0, 2.0, 2.0, 2.0, 8.0, 180.0, 0.5, modes=2)
    r = local.sky_models(pixels(spark, d), angles(spark, d), geo(spark), SIZE, region)
    return shown(r.groupBy("seq", "t_row", "t_col").agg(F.sum(F.col("value") * F.col("value")).alias("energy"), F.count("value").alias("n")), "seq", "t_row", "t_col", "n", energy="energy")


@query()
def psf_response_filter(spark, d):
    """Each pixel's frozen-fit response to a source, and the amplitude that it finds in the mean image."""
    x = range(-2, 3)
    template = local.np.array([[local.np.exp(-(a * a + b * b) / 2.0) for b in x] for a in x])
    p = pixels(spark, d)
    found = local.response_filter(combine.combine(p), local.psf_responses(p, geo(spark), SIZE, LOCAL, template), 0.3)
    return shown(found, "seq", "row", "col", "n_support", amplitude="amplitude")


@query()
def masked_projection_energy(spark, d):
    """Principal components with a disk about each pixel kept out of its own projection."""
    inside = frames.select_region(pixels(spark, d), geo(spark), frames.regions(spark, [0.0], [4.5]))
    r = models.kl_subtract(inside, [4], exclude_radius=1.5)
    return shown(r.groupBy("seq", "frame_idx").agg(F.sum(F.col("value") * F.col("value")).alias("energy")), "seq", "frame_idx", energy="energy")
