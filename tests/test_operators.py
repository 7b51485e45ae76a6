"""Operators on small hand-made stacks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframes.kernels import images
from skyframes.operators import coadd, combine, filters, frames, measure, references, resample, selection
from skyframes.plans import models, pipelines
from skyframes.streaming import ingest


def stack(spark, arrays, angles=None):
    rows = [(0, i, a.T.ravel().tolist(), float(angles[i] if angles else 0)) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "seq int, frame_idx long, pixels array<double>, angle double")


def cube(df, size, key="frame_idx"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], np.full((size, size), np.nan))[r["row"], r["col"]] = np.nan if r["value"] is None else r["value"]
    return out


def values(spark, *rows):
    return spark.createDataFrame([(0, i, 0, j, v) for j, r in enumerate(rows) for i, v in enumerate(r)], "seq int, frame_idx int, row int, col int, value double")


def one(df):
    return [r["value"] for r in sorted(df.collect(), key=lambda r: r["col"])]


def test_combination(spark):
    p = values(spark, (1.0, 3.0, 8.0), (2.0, 4.0, 6.0))
    w = p.withColumn("w", F.when(F.col("frame_idx") < 2, 0.25).otherwise(0.5))
    assert one(combine.combine(p)) == [4, 4] and one(combine.combine(p, "sigma_mean", sigma=0)) == [4, 4]
    assert one(combine.combine(w, weight="w")) == [5, 4.5] and one(combine.combine(w, "median", weight="w")) == [3, 4]
    masked = values(spark, (1.0, None, 5.0, None), (None, None, None, None))
    assert one(combine.combine(masked, "median", min_good=0.5)) == [3, None] and one(combine.combine(masked, "median", min_good=0.51)) == [None, None]
    assert one(combine.combine(values(spark, (0.0, 0.0, 0.0, 0.0, 100.0)), "sigma_mean", sigma=1.5)) == [0]
    with pytest.raises(ValueError):
        combine.combine(p, "best")
    with pytest.raises(ValueError):
        combine.combine(p, "weighted")


def test_golden_workflow(spark):
    """Six constant frames, co-added by two, less their mean image, median-combined."""
    s = stack(spark, [np.full((2, 2), v) for v in (1.0, 1.0, 3.0, 3.0, 8.0, 8.0)])
    g = coadd.by_count(s, 2)
    px = coadd.coadd_pixels(frames.explode_frames(s, 2), g).withColumnRenamed("grp", "frame_idx")
    left = combine.subtract_image(px)
    assert sorted({round(r["value"]) for r in left.collect()}) == [-3, -1, 4]
    assert {r["value"] for r in combine.combine(left, "median").collect()} == {-1.0}


def test_greedy_groups(spark):
    rows = [(0, i, float(t), float(a)) for i, (t, a) in enumerate([(0, 350), (10, 355), (20, 2), (31, 8), (32, 9), (100, 9)])]
    df = spark.createDataFrame(rows, "seq int, frame_idx int, t double, angle double")
    got = lambda **k: [r["grp"] for r in sorted(coadd.greedy(df, **k).collect(), key=lambda r: r["frame_idx"])]
    assert got(max_time=20.0) == [0, 0, 0, 1, 1, 2] and got(max_angle=12.0) == [0, 0, 0, 1, 1, 1] and got(max_count=4) == [0, 0, 0, 0, 1, 1]
    assert got() == [0, 1, 2, 3, 4, 5]
    u = sorted(coadd.unwrap(df).collect(), key=lambda r: r["frame_idx"])
    assert [r["theta"] for r in u] == [350, 355, 362, 368, 369, 369] and u[-1]["path"] == 19


def test_selection(spark):
    f = spark.createDataFrame([(0, i, f"f{i}") for i in range(5)], "seq int, frame_idx int, basename string")
    assert [r["basename"] for r in selection.trim(f, 1, 1).orderBy("frame_idx").collect()] == ["f1", "f2", "f3"]
    t = spark.createDataFrame([(f"f{i}", float(i), i) for i in range(4)], "basename string, quality double, line int")
    with pytest.raises(Exception, match="no entry"):
        selection.quality_select(f, t, 2.0).collect()
    twice = t.union(t)
    with pytest.raises(Exception, match="duplicate"):
        selection.lookup(f.filter("frame_idx < 4"), twice, "quality").collect()
    assert selection.quality_select(f.filter("frame_idx < 4"), t, 2.0).count() == 2
    with pytest.raises(Exception, match="leaves no frame"):
        selection.trim(f, 3, 2).collect()
    with pytest.raises(Exception, match="usable"):
        selection.normalized_weights(f.withColumn("weight", F.lit(0.0))).collect()


def test_checks_fail_jobs(spark):
    with pytest.raises(Exception, match="not finite"):
        frames.require_finite(values(spark, (1.0, math.nan))).collect()
    r = frames.region_pixels(frames.geometry(spark, 8, 8), frames.regions(spark, [0.0, 1.0], [2.0, 3.0]))
    with pytest.raises(Exception, match="overlap"):
        frames.check_ownership(r).collect()
    with pytest.raises(ValueError):
        frames.regions(spark, [2.0], [1.0])


def test_resampling_matches_the_kernels(spark):
    rng = np.random.default_rng(5)
    arrays = [rng.normal(size=(8, 8)) for _ in range(3)]
    px, geo = frames.explode_frames(stack(spark, arrays), 8), frames.geometry(spark, 8, 8)
    turned = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.4), (0, 2, 4.0)], "seq int, frame_idx long, derot double")
    got = cube(resample.derotate(px, turned, geo, 8), 8)
    for i, a in enumerate((0.0, 0.4, 4.0)):
        want = images.rotate(arrays[i], a)
        assert np.allclose(got[i], want, atol=1e-9, equal_nan=True)
    moved = cube(resample.shift(px, geo, 0.3, -0.7), 8)
    assert np.allclose(moved[1], images.shift(arrays[1], 0.3, -0.7), atol=1e-9, equal_nan=True)


def test_rotated_mask_and_frames_round_trip(spark):
    geo = frames.geometry(spark, 7, 7)
    m = geo.select("row", "col", ((F.col("row") == 2) & (F.col("col") == 3)).alias("good"))
    turned = spark.createDataFrame([(0, 0, 0.0), (0, 1, math.pi / 2)], "seq int, frame_idx long, derot double")
    assert {r["frame_idx"]: r["n"] for r in resample.rotate_mask(m, turned, geo, 7).groupBy("frame_idx").agg(F.count_if("good").alias("n")).collect()} == {0: 1, 1: 1}
    a = np.arange(49.0).reshape(7, 7)
    back = frames.to_frames(frames.explode_frames(stack(spark, [a]), 7)).first()["pixels"]
    assert back == a.T.ravel().tolist()


def test_filters_match_the_kernels(spark):
    a = np.random.default_rng(6).normal(size=(9, 9))
    px = frames.explode_frames(stack(spark, [a]), 9)
    assert np.allclose(cube(filters.median_unsharp(px, 3), 9)[0], images.median_unsharp(a, 3))
    g = cube(filters.smooth(px, filters.gauss_offsets(2.0)).withColumn("value", F.col("smooth")), 9)[0]
    assert np.allclose(g, images.masked_gauss(a, 2.0, 4.0))
    flat = np.full((11, 11), 5.0)
    flat[2, 3] = 105
    left = cube(filters.subtract_profile(frames.explode_frames(stack(spark, [flat]), 11), frames.geometry(spark, 11, 11)), 11)[0]
    assert left[5, 5] == 0 and left[2, 3] > 90


def test_injected_source_lands_where_it_should(spark):
    geo = frames.geometry(spark, 9, 9)
    turned = spark.createDataFrame([(0, 0, 0.0)], "seq int, frame_idx long, derot double")
    src = spark.createDataFrame([(2.0, 0.0, 1.0)], "separation double, position_angle double, contrast double")
    out = cube(resample.inject(frames.explode_frames(stack(spark, [np.zeros((9, 9))]), 9), turned, src, geo, 9, 2.0), 9)[0]
    assert np.unravel_index(out.argmax(), out.shape) == (4, 6)


def test_models_match_numpy(spark):
    rng = np.random.default_rng(7)
    arrays = [rng.normal(size=(6, 6)) for _ in range(10)]
    px, geo = frames.explode_frames(stack(spark, arrays), 6), frames.geometry(spark, 6, 6)
    inside = frames.select_region(px, geo, frames.regions(spark, [0.0], [9.0]))
    r = models.kl_subtract(inside, [3], "none").collect()
    x = np.array([a.ravel() for a in arrays])
    vt = np.linalg.svd(x, full_matrices=False)[2][:3]
    want = x - x @ vt.T @ vt
    assert max(abs(q["value"] - want[q["frame_idx"], q["row"] * 6 + q["col"]]) for q in r) < 1e-9
    near = models.local_predictors(geo, 0.0, 1.0, 2.0, 2.0, 6.0, 180.0, 1.0)
    fit = models.pixel_models(px, near, [1, 99]).collect()
    assert {q["value"] is None for q in fit if q["n_modes"] == 99} == {True} and all(q["value"] is not None for q in fit if q["n_modes"] == 1)


def test_references_and_neighbours(spark):
    s = stack(spark, [np.random.default_rng(i).normal(size=(4, 4)) for i in range(6)], [0, 10, 20, 30, 40, 50])
    ready = references.centred(s.withColumn("mjd", F.col("frame_idx").cast("double")))
    pairs = references.frame_pairs(ready, ["frame_idx", "angle", "mjd", "v", "norm"], references.outside_window("angle", 10.0))
    got = {(r["target"], r["reference"]) for r in references.rank_references(pairs, "angle", 1).collect()}
    assert got == {(0, 2), (1, 3), (2, 0), (3, 1), (4, 2), (5, 3)}
    n = references.neighbours(s, 1, 1.0, math.radians(9)).collect()
    assert {(r["target"], r["neighbour"]) for r in n if r["target"] == 0} == {(0, 1), (0, 2)} and {(r["target"], r["neighbour"]) for r in n if r["target"] == 3} == {(3, 2), (3, 4)}
    with pytest.raises(ValueError):
        references.outside_window("pixel", 1.0, radius=0.0)


def test_whole_reduction_finds_an_injected_source(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(15, 15)) * 5
    angles = [i * 25.0 for i in range(12)]
    s = stack(spark, [base * (1 + 0.1 * rng.normal()) + 0.01 * rng.normal(size=(15, 15)) for _ in angles], angles)
    geo = frames.geometry(spark, 15, 15)
    turned = s.select("seq", "frame_idx", F.radians(F.pmod("angle", F.lit(360.0))).alias("derot"))
    src = spark.createDataFrame([(4.0, 40.0, 3.0)], "separation double, position_angle double, contrast double")
    with_source = frames.to_frames(resample.inject(frames.explode_frames(s, 15), turned, src, geo, 15, 2.0)).join(s.select("seq", "frame_idx", "angle"), ["seq", "frame_idx"])
    final = pipelines.principal_reduction(spark, with_source, 15, [1.0], [7.0], [1])
    plane = final.select(F.lit(0).alias("plane"), F.lit(1.0).alias("mode"), "row", "col", "value")
    t = {r["signal"]: r["snr"] for r in pipelines.analyze(spark, plane, 15, pipelines.Analysis([(4.0, 40.0, 2.0), (4.0, 220.0, 2.0)], 1.0, 7.0, 1.5)).collect()}
    assert t[0] > 5 and t[0] > 2 * t[1]


def test_jackknife(spark):
    v = spark.createDataFrame([(0, i, float(i)) for i in range(10)], "seq int, n int, a double").withColumn("b", F.col("a") * 2)
    e = measure.jackknife(v, measure.contiguous_block(F.col("n"), F.lit(10), 5), 5, ["a", "b"], ["seq"])
    x = np.arange(10.0)
    want = [np.delete(x, [2 * b, 2 * b + 1]).mean() for b in range(5)]
    assert np.allclose([r["a"] for r in e.orderBy("block").collect()], want)
    c = measure.jackknife_covariance(e, "a", "b", ["seq"]).first()
    assert abs(c["error_a"] - math.sqrt(4 * np.var(want))) < 1e-12 and abs(c["covariance"] - 8 * np.var(want)) < 1e-12


def test_stream_equals_batch(spark, tmp_path):
    s = stack(spark, [np.full((2, 2), float(i)) for i in range(4)])
    s.repartition(2).write.parquet(str(tmp_path / "in"))
    q = ingest.start(ingest.running_combination(ingest.frame_stream(spark, str(tmp_path / "in"), "seq int, frame_idx long, pixels array<double>, angle double"), 2), "running", str(tmp_path / "check"))
    q.awaitTermination(60)
    assert {(r["value"], r["n_good"]) for r in spark.table("running").collect()} == {(1.5, 4)}


def test_unavailable_steps_are_refused():
    with pytest.raises(NotImplementedError):
        pipelines.Preprocess(normalize="sigma_clip")
    with pytest.raises(ValueError):
        pipelines.Preprocess(subtract="imageMode")


def test_best_correlated_is_the_ranking_of_all_pairs(spark):
    import random

    rng = random.Random(3)
    same = [rng.gauss(0, 1) for _ in range(6)]
    rows = [("a", k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(300)] + [("a", k, same) for k in range(300, 340)] + [("a", k, [x + 1e-12 * rng.random() for x in same]) for k in range(340, 380)]
    rows += [("b", 0, [0.0] * 6), ("b", 1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), ("b", 2, [6.0, 2.0, 3.0, 4.0, 5.0, 7.0]), ("b", 3, [1.0, None, 3.0, 4.0, 5.0, 6.0]), ("b", 4, [1.0, float("nan"), 3.0, 4.0, 5.0, 6.0]), ("b", 5, None), ("b", 6, [1.0, 2.0]), ("b", 6, [2.0, 1.0])]
    rows += [("c", 0, [1.0, 2.0]), (None, 1, [1.0, 2.0]), ("d", None, [1.0, 2.0]), ("d", 4, [2.0, 1.0]), ("e", 0, [1e-160, -1e-160]), ("e", 1, [3e-160, 1e-160]), ("e", 2, [1e200, 3e200]), ("e", 3, [1.0, 3.0])]
    ready = references.centred(spark.createDataFrame(rows, "seq string, frame_idx long, pixels array<double>"))
    plain = lambda df: sorted([(r["seq"], r["target"], r["reference"], r["rank"], repr(r["score"])) for r in df.collect()], key=repr)
    want = plain(references.rank_references(references.frame_pairs(ready, ["frame_idx", "v", "norm"]), "corr", 5))
    for piece in (4096, 50):
        assert plain(references.best_correlated(ready, 5, piece)) == want


def test_correlated_references_are_found_without_pairs_as_rows(spark):
    from skyframes.plans import catalog

    plan = catalog.queries()["ref_select_corr"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "t_frame_idx" not in plan


@pytest.mark.parametrize(("low", "least", "high", "most"), [("imno", 2.0, "none", 0.0), ("angle", 15.0, "imno", 30.0), ("pixel", 1.0, "angle", 170.0), ("none", 0.0, "imno", 1.0), ("imno", 28.0, "none", 0.0)])
def test_windowed_references_are_those_of_the_pairs(spark, low, least, high, most):
    rng = np.random.default_rng(9)
    arrays = [rng.normal(size=(6, 6)) * (100.0 if i == 7 else 1.0) for i in range(56)]
    s = stack(spark, arrays, [7.0 * i for i in range(56)])
    px, geo, wanted = frames.explode_frames(s, 6), frames.geometry(spark, 6, 6), frames.regions(spark, [0.5, 2.0], [2.0, 9.0])
    known = s.withColumn("angle", F.when(F.col("frame_idx") != 11, F.col("angle"))).filter("frame_idx <> 20").withColumn("mjd", F.col("frame_idx").cast("double"))
    inside = frames.select_region(px, geo, wanted)
    allowed = pipelines.region_references(inside, known, wanted, "image_mean", low, least, high, most)
    plain = lambda df: {(r["n_modes"], r["frame_idx"], r["row"], r["col"]): r["value"] for r in df.collect()}
    want = plain(models.kl_subtract(inside, [1, 4], "image_mean", allowed))
    residual = pipelines.principal_residuals(spark, px, known, 6, wanted, [1, 4], exclude=low, least=least, exclude_max=high, most=most)
    assert "t_frame_idx" not in residual._jdf.queryExecution().optimizedPlan().toString()
    got = plain(residual)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in want)


def test_planes_are_turned_without_rows_of_taps(spark):
    rng = np.random.default_rng(10)
    rows = [(0, m, f, r, c, None if (f, r, c) in ((2, 4, 4), (0, 0, 0)) else float(rng.normal()) if (f, r, c) != (3, 2, 2) else math.nan) for m in (0, 1) for f in range(6) for r in range(9) for c in range(9) if r or f != 4]
    rows += [(0, 0, 1, 4, 4, 1.0), (0, 0, 0, 3, 3, 1.0), (None, 0, 1, 4, 4, 1.0), (0, 0, 9, 4, 4, 1.0)]
    residual = spark.createDataFrame(rows, "seq int, mode_idx int, frame_idx long, row int, col int, value double")
    angles = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.4), (0, 2, math.pi / 2), (0, 3, 4.0), (0, 4, -1.0), (0, 5, None), (0, 6, 1.0)], "seq int, frame_idx long, derot double")
    geo = frames.geometry(spark, 9, 9)
    keyed = lambda df: df.withColumn("seq", F.struct("seq", "mode_idx"))
    turns = keyed(angles.crossJoin(spark.range(2).select(F.col("id").cast("int").alias("mode_idx"))))
    want = resample.derotate(keyed(residual), turns, geo, 9)
    assert want.count()
    got = resample.derotate_frames(residual, angles, 9)
    plain = lambda df, *keys: sorted(((*(r[k] for k in keys), None if r["value"] is None else repr(round(r["value"], 9) + 0.0)) for r in df.collect()), key=repr)
    assert plain(got.filter("row >= 0"), "seq", "mode_idx", "frame_idx", "row", "col") == plain(want.select("seq.seq", "seq.mode_idx", "frame_idx", "row", "col", "value"), "seq", "mode_idx", "frame_idx", "row", "col")
    assert got.filter("row < 0").count() == 12
    weights = spark.createDataFrame([(0, f, 1.0 + f) for f in range(5) if f != 1], "seq int, frame_idx long, weight double")
    done = pipelines.finalize(residual, angles, geo, 9, pipelines.Finish(), weights)
    assert {r["n_total"] for r in done.collect()} == {6}
    by_hand = combine.combine(want.join(weights.withColumnsRenamed({"seq": "__s", "frame_idx": "__f"}), (F.col("seq.seq") == F.col("__s")) & (F.col("frame_idx") == F.col("__f"))), "mean", weight="weight")
    assert plain(done, "mode_idx", "row", "col", "n_good") == plain(by_hand.select("seq.mode_idx", "row", "col", "n_good", "value"), "mode_idx", "row", "col", "n_good")
    assert "in_row" not in done._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("low", "high"), [([1.0], [4.5]), ([1.0, 3.0], [3.0, 4.5])])
def test_regions_are_fitted_by_their_own_pixels_and_turned_in_whole_images(spark, low, high):
    """A narrow annulus: each footprint of 16 pixels holds some outside it, which are zero and no part of the fit."""
    rng = np.random.default_rng(11)
    arrays = [10 + rng.normal(size=(8, 8)) for _ in range(24)]
    s = stack(spark, arrays, [7.0 * i for i in range(24)])
    got = pipelines.principal_reduction(spark, s, 8, low, high, [1, 4], exclude="imno", least=2, finish=pipelines.Finish(min_good=0.2))
    r = np.hypot(*np.meshgrid(np.arange(8) - 3.5, np.arange(8) - 3.5, indexing="ij"))
    planes = np.zeros((2, 24, 8, 8))
    for a, b in zip(low, high, strict=True):
        at = (r >= a) & (r < b)
        x = np.array([v[at] - v[at].mean() for v in arrays])
        for i in range(24):
            vt = np.linalg.svd(x[np.abs(np.arange(24) - i) > 2], full_matrices=False)[2]
            for m, n in enumerate((1, 4)):
                planes[m, i][at] = x[i] - x[i] @ vt[:n].T @ vt[:n]
    turned = np.array([[images.rotate(f, math.radians(7.0 * i)) for i, f in enumerate(p)] for p in planes])
    good = np.isfinite(turned).sum(axis=1)
    want = {(m, row, col): (good[m, row, col], np.nanmean(turned[m, :, row, col]) if good[m, row, col] >= 0.2 * 24 else None) for m, row, col in zip(*np.nonzero(good), strict=True)}
    rows = {(q["mode_idx"], q["row"], q["col"]): q for q in got.collect()}
    assert rows.keys() == want.keys() and {q["n_total"] for q in rows.values()} == {24}
    assert sum(good.ravel()) > 0.3 * 2 * 24 * 64
    for k, (n, v) in want.items():
        assert rows[k]["n_good"] == n and (rows[k]["value"] is None) == (v is None) and (v is None or abs(rows[k]["value"] - v) < 1e-9)
