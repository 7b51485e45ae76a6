"""FITS round trips, saved collections, options."""

import os

import numpy as np
import pytest

from skyframes import config
from skyframes.sources import fits, tables


def test_image_round_trip(tmp_path):
    cube = np.random.default_rng(1).normal(size=(3, 5, 5))
    cube[1, 2, 3] = np.nan
    p = str(tmp_path / "a.fits")
    fits.write_image(p, cube, {"ANGLE": 12.5, "NAME": "it's", "FLAG": True, "N": 3, "LONG KEY WORD": 1.5, "HISTORY": "one\ntwo"})
    cards, back = fits.read_image(p)
    assert np.array_equal(back, cube, equal_nan=True)
    assert cards["ANGLE"] == "12.5" and cards["NAME"] == "it's" and cards["FLAG"] == "T" and cards["LONG KEY WORD"] == "1.5" and cards["HISTORY"] == "one\ntwo"
    assert os.path.getsize(p) % 2880 == 0


def test_window_and_orientation(tmp_path):
    image = np.arange(6.0).reshape(2, 3)
    p = str(tmp_path / "b.fits")
    fits.write_image(p, image)
    assert fits.read_image(p)[1].shape == (1, 2, 2)
    assert (fits.read_image(p)[1][0] == image[:, :2]).all()


def test_integers_are_scaled(tmp_path):
    head = b"".join(x.ljust(80) for x in (b"SIMPLE  =                    T", b"BITPIX  =                   16", b"NAXIS   =                    2", b"NAXIS1  =                    2", b"NAXIS2  =                    2", b"BZERO   =                32768", b"END"))
    p = tmp_path / "c.fits"
    p.write_bytes(head.ljust(2880) + np.array([-32768, 0, 1, 2], ">i2").tobytes().ljust(2880, b"\0"))
    assert fits.read_image(str(p))[1].ravel().tolist() == [0, 32769, 32768, 32770]


def test_listing(tmp_path):
    for n in ("b1.fits", "b0.fits", "x.txt"):
        (tmp_path / n).write_text("")
    (tmp_path / "list.txt").write_text("b1.fits\nb0.fits\n")
    assert [os.path.basename(x) for x in fits.list_files(str(tmp_path), "b")] == ["b0.fits", "b1.fits"]
    assert [os.path.basename(x) for x in fits.list_files(str(tmp_path), names=str(tmp_path / "list.txt"), front=1)] == ["b0.fits"]
    with pytest.raises(ValueError):
        fits.list_files(str(tmp_path), "b", front=2)


def test_spark_source_and_sink(spark, tmp_path):
    for i in range(3):
        fits.write_image(str(tmp_path / f"im_{i}.fits"), np.full((4, 4), float(i)), {"ANGLE": i * 1.5, "OTHER": 1})
    df = fits.read(spark, str(tmp_path), prefix="im_", keywords="ANGLE", delete_front=1)
    rows = sorted(df.collect(), key=lambda r: r["frame_idx"])
    assert [r["basename"] for r in rows] == ["im_1.fits", "im_2.fits"] and rows[0]["header"] == {"ANGLE": "1.5"} and rows[1]["pixels"] == [2.0] * 16
    df.write.format("fits").mode("append").option("prefix", "out_").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["out_000000.fits", "out_000001.fits"]


def test_residual_collection(spark, tmp_path):
    rows = [(m, f, r, c, float(m + f + r + c)) for m in range(2) for f in range(2) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(rows, "mode_idx int, frame_idx int, row int, col int, value double")
    tables.write_residuals(df, str(tmp_path), "res", 3, {0: 0.5, 1: 0.5})
    back = tables.read_residuals(spark, str(tmp_path), "res").collect()
    assert len(back) == 4 and {(r["mode_idx"], r["frame_idx"]) for r in back} == {(m, f) for m in range(2) for f in range(2)}
    assert tables.read_columns(spark, str(tmp_path / "weights.dat"), "weight").count() == 2
    with pytest.raises(ValueError, match="lacks"):
        tables.residual_index(["res_000_00000.fits", "res_001_00001.fits"], "res")
    with pytest.raises(ValueError, match="malformed"):
        tables.residual_index(["res_0x_1.fits"], "res")


def test_final_names_and_provenance(tmp_path):
    p = tables.next_path(str(tmp_path))
    assert p.endswith("finim_0000.fits")
    open(p, "w").close()
    assert tables.next_path(str(tmp_path)).endswith("finim_0001.fits")
    assert tables.provenance({"klip.Nmodes": [1, 5]}) == {"KLIP NMODES": "1,5"}


def test_options(tmp_path):
    p = tmp_path / "c.ini"
    p.write_text("mode=basic\n[geom]\nminRadius=1,2\nmaxRadius=2,3\n[klip]\nNmodes=1,5\n[preProcess]\nmask=false\n")
    o = config.load("principal", str(p), ["--klip.includeRefNum", "7", "--combine.method=median"])
    assert o["geom.minRadius"] == [1, 2] and o["klip.includeRefNum"] == 7 and o["combine.method"] == "median" and o["preProcess.mask"] is False
    for bad in (["--no.such", "1"], ["stray"], ["--combine.method", "best"], ["--klip.Nmodes", "0"], ["--geom.maxRadius", "1"], ["--input.deleteFront", "x"]):
        with pytest.raises(ValueError):
            config.load("principal", str(p), bad)
    with pytest.raises(ValueError):
        config.load("pixel", None, ["--p4.modeFractions", "0.5,0.1"])
    with pytest.raises(ValueError):
        config.load("analysis", None, ["--planet.sep", "1", "--planet.PA", "1", "--fake.sep", "1", "--fake.PA", "2"])
