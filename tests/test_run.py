"""Whole runs from options and files."""

import math
import os

import numpy as np
import pytest

from skyframes import config
from skyframes.plans import run
from skyframes.sources import fits, tables


@pytest.fixture(scope="module")
def sequence(tmp_path_factory):
    d = tmp_path_factory.mktemp("seq")
    rng = np.random.default_rng(3)
    base = rng.normal(size=(15, 15)) * 5
    x = np.arange(15) - 7.0
    template = np.exp(-(x[:, None] ** 2 + x[None, :] ** 2) / 1.5)
    fits.write_image(str(d / "psf.fits"), template)
    for i in range(10):
        fits.write_image(str(d / f"im_{i:02d}.fits"), base * (1 + 0.05 * rng.normal()) + 0.01 * rng.normal(size=(15, 15)), {"ANG": 25.0 * i, "DATE-OBS": f"2024-01-01T00:{i:02d}:00"})
    (d / "quality.txt").write_text("".join(f"im_{i:02d}.fits {i}\n" for i in range(10)))
    return d


def options(kind, d, **more):
    base = {"input.directory": d, "input.prefix": "im_", "input.angleKeyword": "ANG"}
    return config.load(kind, None, [x for k, v in {**base, **more}.items() for x in (f"--{k}", str(v))])


def test_principal_run_recovers_an_injected_source(spark, sequence, tmp_path):
    o = options("principal", sequence, **{"geom.minRadius": "1", "geom.maxRadius": "7", "klip.Nmodes": "1,2", "fake.sep": "4", "fake.PA": "40", "fake.contrast": "3", "fake.fileName": sequence / "psf.fits", "output.directory": tmp_path / "out", "output.outputPSFSub": "true", "output.psfSubPrefix": "res"})
    run.reduce(spark, "principal", o)
    assert os.path.exists(tmp_path / "out" / "finim_0000.fits") and os.path.exists(tmp_path / "out" / "res_001_00009.fits")
    a = config.load("analysis", None, ["--file", str(tmp_path / "out" / "finim_0000.fits"), "--planet.sep", "4,4", "--planet.PA", "40,220", "--planet.R", "2,2", "--snr.minRad", "1", "--snr.maxRad", "7", "--snr.apertureR", "1.5"])
    t = {(r["plane"], r["signal"]): r["snr"] for r in run.analyze(spark, a).collect()}
    assert len(t) == 4 and t[0, 0] > 5 and t[0, 0] > 2 * t[0, 1]
    again = options("principal", sequence, **{"mode": "postprocess", "postprocess.directory": tmp_path / "out", "postprocess.prefix": "res"})
    first = fits.read_image(str(tmp_path / "out" / "finim_0000.fits"))[1]
    second = {(r["mode_idx"], r["row"], r["col"]): r["value"] for r in run.reduce(spark, "principal", again).collect()}
    assert all(abs(first[k] - v) < 1e-9 for k, v in second.items() if v is not None)


def test_selection_coadding_and_early_stops(spark, sequence, tmp_path):
    o = options("principal", sequence, **{"input.qualityFile": sequence / "quality.txt", "input.qualityThreshold": "6", "input.thresholdOnly": "true"})
    assert [r["basename"] for r in run.reduce(spark, "principal", o).collect()] == [f"im_{i:02d}.fits" for i in range(6, 10)]
    o = options("principal", sequence, **{"preProcess.only": "true", "preProcess.meanSubMethod": "medianImage", "coadd.method": "mean", "coadd.maxImno": "3", "preProcess.outputPrefix": tmp_path / "pre_"})
    px = run.reduce(spark, "principal", o)
    assert px.select("frame_idx").distinct().count() == 4 and len([x for x in os.listdir(tmp_path) if x.startswith("pre_")]) == 4


def test_pixel_run(spark, sequence):
    o = options("pixel", sequence, **{"geom.minRadius": "2,4", "geom.maxRadius": "4,5", "p4.modeFractions": "0.3", "p4.orDeltaRadiusInner": "1.5", "p4.orDeltaRadiusOuter": "1.5", "p4.orArcHalfWidth": "4", "p4.psfRadius": "1.0", "combine.minGoodFract": "0.2", "combine.method": "median"})
    r = run.reduce(spark, "pixel", o).collect()
    c = 7.0
    assert r and all(x["value"] is None or math.isfinite(x["value"]) for x in r) and max(math.hypot(x["row"] - c, x["col"] - c) for x in r) < 6.5


@pytest.mark.parametrize(("kind", "name", "value"), [("pixel", "p4.numberImages", "2"), ("pixel", "p4.psfFile", "psf.fits"), ("principal", "klip.writeDiagnostics", "true"), ("principal", "showTiming", "true"), ("principal", "fake.RDISepScale", "1")])
def test_unsupported_options_are_errors(spark, sequence, kind, name, value):
    with pytest.raises(NotImplementedError, match=name):
        run.reduce(spark, kind, options(kind, sequence, **{name: value}))


def test_every_option_is_read_or_refused():
    """An option that neither the runs read nor refuse would be ignored."""
    import inspect

    text = inspect.getsource(run)
    found = [k for kind in config.SCHEMAS for k in config.SCHEMAS[kind] if f'"{k}"' not in text and not (k.partition(".")[0] in ("input", "rdi") and f'"{k.partition(".")[2]}"' in text) and not k.startswith(run.UNSUPPORTED)]
    assert not found


def test_products_are_analysed_by_their_own_cards(spark, sequence, tmp_path):
    more = {"geom.minRadius": "1,4", "geom.maxRadius": "4,7", "klip.Nmodes": "1,2", "fake.sep": "4", "fake.PA": "40", "fake.contrast": "3", "fake.fileName": sequence / "psf.fits", "output.directory": tmp_path / "out", "output.outputPSFSub": "true", "output.psfSubPrefix": "res"}
    (tmp_path / "w.txt").write_text("".join(f"im_{i:02d}.fits {i + 1}\n" for i in range(10)))
    run.reduce(spark, "principal", options("principal", sequence, **more, **{"combine.method": "weighted", "combine.weightFile": tmp_path / "w.txt"}))
    product = str(tmp_path / "out" / "finim_0000.fits")
    own = run.analyze(spark, config.load("analysis", None, ["--file", product, "--fake.R", "2"])).collect()
    told = run.analyze(spark, config.load("analysis", None, ["--file", product, "--planet.sep", "4", "--planet.PA", "40", "--planet.R", "2", "--snr.minRad", "1", "--snr.maxRad", "7"])).collect()
    key = lambda r: (r["plane"], r["mode"], r["signal"], r["snr"])
    assert sorted(map(key, own)) == sorted(map(key, told)) and {r["mode"] for r in own} == {1.0, 2.0}
    assert os.path.exists(tmp_path / "out" / "weights.dat") and len((tmp_path / "out" / "weights.dat").read_text().split("\n")) == 11
    run.reduce(spark, "principal", options("principal", sequence, **{"mode": "postprocess", "postprocess.directory": tmp_path / "out", "postprocess.prefix": "res", "output.directory": tmp_path / "again"}))
    again = fits.read_image(str(tmp_path / "again" / "finim_0000.fits"))[0]
    assert again["NMODES"] == "1,2" and again["REGMAXR"] == "4,7" and again["FAKESEP"] == "4"


def test_options_of_the_model_change_the_result(spark, sequence):
    def value(kind, **more):
        return {(r["mode_idx"], r["row"], r["col"]): r["value"] for r in run.reduce(spark, kind, options(kind, sequence, **more)).collect()}

    ring = {"geom.minRadius": "1,4", "geom.maxRadius": "4,7", "klip.Nmodes": "2"}
    plain = value("principal", **ring)
    assert value("principal", **ring, **{"klip.pixelTSNormMethod": "rms"}) != plain
    near = value("principal", **ring, **{"adi.excludeMethodMax": "imno", "adi.maxDPx": "3"})
    assert near != plain and near == value("principal", **ring, **{"adi.excludeMethodMax": "imno", "adi.maxDPx": "3", "adi.excludeMethod": "pixel", "adi.minDPx": "-1"})
    annulus = {"geom.minRadius": "2", "geom.maxRadius": "3.5", "p4.modeFractions": "0.3", "p4.orDeltaRadiusInner": "1.5", "p4.orDeltaRadiusOuter": "1.5", "p4.orArcHalfWidth": "4", "p4.psfRadius": "1.0"}
    assert value("pixel", **annulus) != value("pixel", **annulus, **{"p4.regressionFrame": "rotated"})
    with pytest.raises(ValueError, match="same number of modes"):
        run.reduce(spark, "pixel", options("pixel", sequence, **{**annulus, "p4.modeFractions": "0.3,0.31"}))


def test_a_list_of_equal_templates_is_one_template(spark, sequence, tmp_path):
    (tmp_path / "list.txt").write_text(f"{sequence / 'psf.fits'}\n" * 10)
    more = {"preProcess.only": "true", "fake.sep": "3", "fake.PA": "10", "fake.contrast": "2"}
    get = lambda **k: {(r["frame_idx"], r["row"], r["col"]): r["value"] for r in run.reduce(spark, "principal", options("principal", sequence, **more, **k)).collect()}
    one, many = get(**{"fake.fileName": sequence / "psf.fits"}), get(**{"fake.fileName": tmp_path / "list.txt", "fake.method": "list"})
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-9 for k in one)


def test_a_fit_finds_the_contrast(spark, sequence, tmp_path):
    template = fits.read_image(str(sequence / "psf.fits"))[1][0]
    from skyframes.kernels import images

    for i in range(10):
        cards, cube = fits.read_image(str(sequence / f"im_{i:02d}.fits"))
        derot = math.radians(25.0 * i)
        x = derot - math.radians(40.0)
        fits.write_image(str(tmp_path / f"im_{i:02d}.fits"), cube[0] + 2.0 * np.nan_to_num(images.shift(template, 3.0 * math.sin(x), 3.0 * math.cos(x))), {"ANG": 25.0 * i, "DATE-OBS": f"2024-01-01T00:{i:02d}:00"})
    fit = {"geom.minRadius": "0.5", "geom.maxRadius": "6.5", "p4.modeFractions": "0.3", "p4.orDeltaRadiusInner": "2", "p4.orDeltaRadiusOuter": "2", "p4.orArcHalfWidth": "5", "p4.psfRadius": "1.5", "fake.sep": "3", "fake.PA": "40", "fake.contrast": "0", "fake.fileName": sequence / "psf.fits"}
    fit |= {"p4Optimize.enabled": "true", "p4Optimize.contrastUpper": "4", "p4Optimize.validationSamples": "5", "p4Optimize.maxEvaluations": "6", "p4Optimize.parameterTolerance": "0.05", "p4Optimize.outputPrefix": tmp_path / "fit_"}
    t = run.reduce(spark, "pixel", options("pixel", tmp_path, **fit)).collect()
    best = min(t, key=lambda r: r["merit"])
    assert abs(best["contrast"] - 2.0) < 0.6 and os.path.exists(tmp_path / "fit_merit.csv")
    tables.write_jackknife([1.0, 2.0], 0.5, f"{tmp_path}/j_")
    assert (tmp_path / "j_jackknife.csv").read_text() == "block,contrast\n0,1.0\n1,2.0\nerror,0.5\n"
