"""Local trials against whole refits; neighbour, sky-frame and response fits against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframes.kernels import images, linear
from skyframes.operators import frames, resample
from skyframes.plans import local, models, pipelines

SIZE = 13


def stack(spark, arrays, angles):
    return spark.createDataFrame([(0, i, a.T.ravel().tolist(), float(angles[i])) for i, a in enumerate(arrays)], "seq int, frame_idx long, pixels array<double>, angle double")


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(9)
    angles = [i * 17.0 for i in range(9)]
    return stack(spark, [rng.normal(size=(SIZE, SIZE)) for _ in angles], angles)


REGION = local.Region(1.5, 6.0, 2.0, 2.0, 6.0, 90.0, 1.0, modes=2)


def test_local_equals_whole(spark, scene):
    geo = frames.geometry(spark, SIZE, SIZE)
    turned = scene.select("seq", "frame_idx", F.radians("angle").alias("derot"))
    src = spark.createDataFrame([(3.0, 50.0, -0.7)], "separation double, position_angle double, contrast double")
    changed = frames.to_frames(resample.inject(frames.explode_frames(scene, SIZE), turned, src, geo, SIZE, 2.0)).join(scene.select("seq", "frame_idx", "angle"), ["seq", "frame_idx"])
    wedge = {"delta_in": 2.0, "delta_out": 2.0, "arc": 6.0, "max_half_angle": 90.0, "radius": 1.0}
    whole = {(r["row"], r["col"]): r["value"] for r in pipelines.pixel_reduction(spark, changed, SIZE, 1.5, 6.0, [2], wedge).collect()}
    c, a = (SIZE - 1) / 2, math.radians(50)
    x, y = c - 3 * math.sin(a), c + 3 * math.cos(a)
    cells = [(r, k) for r in range(SIZE) for k in range(SIZE) if (r - x) ** 2 + (k - y) ** 2 <= 1.0]
    want = np.mean([whole[k] ** 2 for k in cells])
    got = {r["trial"]: r["merit"] for r in local.evaluate_trials(spark, scene, SIZE, REGION, [(3.0, 50.0, 0.7), (3.0, 50.0, 0.0)], (3.0, 50.0), 1.0, 2.0).collect()}
    assert abs(got[0] - want) < 1e-9 and got[1] != got[0]


def test_contrast_is_recovered(spark):
    rng = np.random.default_rng(10)
    angles = [i * 20.0 for i in range(8)]
    quiet = stack(spark, [0.01 * rng.normal(size=(SIZE, SIZE)) for _ in angles], angles)
    geo = frames.geometry(spark, SIZE, SIZE)
    turned = quiet.select("seq", "frame_idx", F.radians("angle").alias("derot"))
    src = spark.createDataFrame([(3.5, 70.0, 0.6)], "separation double, position_angle double, contrast double")
    seen = frames.to_frames(resample.inject(frames.explode_frames(quiet, SIZE), turned, src, geo, SIZE, 2.0)).join(quiet.select("seq", "frame_idx", "angle"), ["seq", "frame_idx"])
    found = local.fit_contrast(spark, seen, SIZE, REGION, (3.5, 70.0), (0.0, 1.2), 1.0, 2.0, samples=5, tolerance=0.05, most=9)
    assert abs(found.best[0] - 0.6) < 0.1


def test_neighbour_predictors(spark, scene):
    px, geo = frames.explode_frames(scene, SIZE), frames.geometry(spark, SIZE, SIZE)
    near = geo.filter("row = 6 and col = 9").select(F.col("row").alias("t_row"), F.col("col").alias("t_col"), F.lit(6).alias("row"), F.lit(4).alias("col"))
    got = local.neighbour_models(px, scene, near, [(0, 0)], 1, 1.0, math.radians(10), [1]).orderBy("frame_no").collect()
    x = np.array([np.array(r["pixels"]).reshape(SIZE, SIZE).T for r in scene.orderBy("frame_idx").collect()])
    y = x[:, 6, 9]
    n = [(1, 2), *((i - 1, i + 1) for i in range(1, 8)), (7, 6)]  # (earlier, later), refilled at the ends in order of distance
    p = np.stack([x[:, 6, 4], [y[a] for a, _ in n], [y[b] for _, b in n]], axis=1)
    want = linear.pixel_regression(y, p, [1])[0][0]
    assert np.allclose([r["value"] for r in got], want)


def test_sky_fit(spark, scene):
    px, geo = frames.explode_frames(scene, SIZE), frames.geometry(spark, SIZE, SIZE)
    turned = scene.select("seq", "frame_idx", F.radians("angle").alias("derot"))
    region = local.Region(0.0, 2.0, 2.0, 2.0, 9.0, 180.0, 0.5, modes=1)
    got = local.sky_models(px, turned, geo, SIZE, region).filter("t_row = 6 and t_col = 6").orderBy("frame_no").collect()
    sky = np.array([images.rotate(np.array(r["pixels"]).reshape(SIZE, SIZE).T, math.radians(r["angle"])) for r in scene.orderBy("frame_idx").collect()])
    cells = [(r["row"], r["col"]) for r in region.predictors(geo).filter("t_row = 6 and t_col = 6").orderBy("row", "col").collect()]
    want = linear.pixel_regression(sky[:, 6, 6], np.stack([sky[:, r, c] for r, c in cells], axis=1), [1])[0][0]
    assert np.allclose([r["value"] for r in got], want)


def test_response_finds_a_source_that_the_fit_has_seen(spark, scene):
    px, geo = frames.explode_frames(scene, SIZE), frames.geometry(spark, SIZE, SIZE)
    d = np.arange(-2, 3)
    template = np.exp(-(d[:, None] ** 2 + d[None, :] ** 2) / 2.0)
    responses = local.psf_responses(px, geo, SIZE, REGION, template)
    one = {(r["d_row"], r["d_col"]): r["h"] for r in responses.filter("t_row = 6 and t_col = 9").collect()}
    image = spark.createDataFrame([(0, 6 + a, 9 + b, 2.5 * h) for (a, b), h in one.items()], "seq int, row int, col int, value double")
    found = {(r["row"], r["col"]): r["amplitude"] for r in local.response_filter(image, responses).collect()}
    assert abs(found[6, 9] - 2.5) < 1e-9
    assert local.response_filter(image, responses, 1.0).filter("amplitude is null").count() > 0


def test_masked_projection(spark, scene):
    inside = frames.select_region(frames.explode_frames(scene, SIZE), frames.geometry(spark, SIZE, SIZE), frames.regions(spark, [0.0], [20.0]))
    got = models.kl_subtract(inside, [2], "none", exclude_radius=1.0).filter("frame_idx = 3").collect()
    x = np.array([np.array(r["pixels"]).reshape(SIZE, SIZE).T.ravel() for r in scene.orderBy("frame_idx").collect()])
    p = np.linalg.svd(x, full_matrices=False)[2][:2]
    p = p.T @ p
    for i in range(SIZE * SIZE):
        for j in range(SIZE * SIZE):
            if math.hypot(i // SIZE - j // SIZE, i % SIZE - j % SIZE) <= 1:
                p[i, j] = 0
    want = x[3] - p @ x[3]
    assert max(abs(r["value"] - want[r["row"] * SIZE + r["col"]]) for r in got) < 1e-9
    with pytest.raises(ValueError):
        models.kl_subtract(inside, [1, 2], exclude_radius=1.0)
