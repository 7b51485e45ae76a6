"""FITS images and cubes: header cards, arrays, a Spark data source, a writer. numpy only.

Read as ``spark.read.format("fits")`` after ``register(spark)``. A file is an input partition; rows are (frame_idx, plane, path,
basename, header, n_rows, n_cols, pixels), pixels column-major with NaN as null. Options: ``path`` (a directory, a glob or a
file), ``prefix``, ``extension``, ``list`` (a text file of names in order), ``size`` (a centred square window is read), ``keywords``
(cards to keep, comma-separated), ``delete_front`` and ``delete_back`` (applied to the listing, before anything is read).
"""

from __future__ import annotations

import glob
import math
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "frame_idx int, plane int, path string, basename string, header map<string,string>, n_rows int, n_cols int, pixels array<double>"
BLOCK, CARD = 2880, 80
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def _value(text: str) -> str:
    text = text.strip()
    if text.startswith("'"):
        out, i = [], 1
        while i < len(text):
            if text[i] == "'":
                if text[i + 1 : i + 2] != "'":
                    break
                i += 1
            out.append(text[i])
            i += 1
        return "".join(out).rstrip()
    return text.split("/")[0].strip()


def parse_header(data: bytes) -> tuple[dict[str, str], int]:
    """(cards, bytes up to the data). HIERARCH keywords keep their words; HISTORY and COMMENT lines are joined."""
    cards: dict[str, str] = {}
    at = 0
    while True:
        if at + CARD > len(data):
            raise ValueError("header has no END card")
        card = data[at : at + CARD].decode("ascii", "replace")
        at += CARD
        key = card[:8].strip()
        if key == "END":
            return cards, -(-at // BLOCK) * BLOCK
        if key in ("HISTORY", "COMMENT"):
            cards[key] = f"{cards[key]}\n{card[8:].rstrip()}" if key in cards else card[8:].rstrip()
        elif key == "HIERARCH" and "=" in card:
            name, _, value = card[8:].partition("=")
            cards[name.strip()] = _value(value)
        elif card[8:10] == "= ":
            cards[key] = _value(card[10:])


def read_image(path: str, size: int = 0) -> tuple[dict[str, str], np.ndarray]:
    """(cards, array of planes, rows, cols) where rows are FITS axis 1; ``size`` > 0 cuts a centred square.

    A square is cut to the shorter side in any case; a cut that can't be centred keeps the lower half-pixel.
    """
    with open(path, "rb") as f:
        data = f.read()
    cards, start = parse_header(data)
    axes = [int(cards[f"NAXIS{i + 1}"]) for i in range(int(cards["NAXIS"]))]
    if len(axes) not in (2, 3):
        raise ValueError(f"{path} holds no image")
    kind = TYPES[int(cards["BITPIX"])]
    n = math.prod(axes)
    values = np.frombuffer(data, kind, n, start).astype(np.float64)
    if "BLANK" in cards and int(cards["BITPIX"]) > 0:
        values[np.frombuffer(data, kind, n, start) == int(cards["BLANK"])] = np.nan
    values = values * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))
    cube = values.reshape((axes[2] if len(axes) == 3 else 1, axes[1], axes[0])).transpose(0, 2, 1)
    side = min(cube.shape[1:]) if not size else min(size, *cube.shape[1:])
    a, b = (cube.shape[1] - side) // 2, (cube.shape[2] - side) // 2
    return cards, cube[:, a : a + side, b : b + side]


def _card(key: str, value) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, int):
        text = f"{value:>20d}"
    elif isinstance(value, float):
        text = f"{value!r:>20}"
    else:
        text = "'" + str(value).replace("'", "''").ljust(8) + "'"
    plain = len(key) <= 8 and " " not in key
    line = f"{key.upper():<8}= {text}" if plain else f"HIERARCH {key} = {text}"
    if len(line) > CARD:
        raise ValueError(f"card {key} is too long")
    return line.ljust(CARD).encode("ascii")


def write_image(path: str, cube: np.ndarray, header: dict | None = None) -> None:
    """Planes, rows, cols as 64-bit floats; written beside its place and moved into it."""
    if cube.ndim == 2:
        cube = cube[None]
    axes = [cube.shape[1], cube.shape[2]] + ([cube.shape[0]] if cube.shape[0] > 1 else [])
    fixed = {"SIMPLE": True, "BITPIX": -64, "NAXIS": len(axes)} | {f"NAXIS{i + 1}": int(n) for i, n in enumerate(axes)}
    cards = [_card(k, v) for k, v in fixed.items()]
    for k, v in (header or {}).items():
        if k in ("HISTORY", "COMMENT"):
            cards += [f"{k:<8}{line[:72]}".ljust(CARD).encode("ascii", "replace") for line in str(v).split("\n")]
        elif k not in fixed and k not in ("BSCALE", "BZERO", "BLANK", "EXTEND"):
            cards.append(_card(k, v))
    head = b"".join([*cards, b"END".ljust(CARD)])
    body = cube.transpose(0, 2, 1).astype(">f8").tobytes()
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(head.ljust(-(-len(head) // BLOCK) * BLOCK))
        f.write(body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0"))
    os.replace(part, path)


def list_files(directory: str = "", prefix: str = "", extension: str = ".fits", names: str = "", front: int = 0, back: int = 0) -> list[str]:
    """Files in order: as the list has them (relative to the directory), or sorted by name."""
    if names:
        with open(names) as f:
            out = [os.path.join(directory, x.split()[0]) for x in f if x.strip()]
    elif os.path.isdir(directory):
        out = sorted(x for x in glob.glob(os.path.join(glob.escape(directory), "*")) if os.path.basename(x).startswith(prefix) and x.endswith(extension))
    else:
        out = sorted(glob.glob(directory))
    if front < 0 or back < 0 or front + back >= len(out):
        raise ValueError(f"no file is left of {len(out)}")
    return out[front : len(out) - back]


class _File(InputPartition):
    def __init__(self, index: int, path: str):
        self.index, self.path = index, path


class FitsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[_File]:
        o = self.options
        files = list_files(o.get("path", ""), o.get("prefix", ""), o.get("extension", ".fits"), o.get("list", ""), int(o.get("delete_front", 0)), int(o.get("delete_back", 0)))
        return [_File(i, p) for i, p in enumerate(files)]

    def read(self, partition: _File) -> Iterator[tuple]:
        cards, cube = read_image(partition.path, int(self.options.get("size", 0)))
        if wanted := [k.strip() for k in self.options.get("keywords", "").split(",") if k.strip()]:
            cards = {k: v for k, v in cards.items() if k in wanted}
        for i, plane in enumerate(cube):
            values = [None if x != x else x for x in plane.T.ravel().tolist()]  # column-major: rows run fastest
            yield (partition.index, i, partition.path, os.path.basename(partition.path), cards, plane.shape[0], plane.shape[1], values)


class FitsWriter(DataSourceWriter):
    """One file per row: ``{path}/{prefix}{frame_idx:06}.fits``."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        os.makedirs(options["path"], exist_ok=True)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        for r in rows:
            plane = np.array([np.nan if x is None else x for x in r["pixels"]], float).reshape(r["n_cols"], r["n_rows"]).T
            suffix = f"_{r['plane']:05d}" if self.options.get("planes") else ""
            write_image(os.path.join(self.options["path"], f"{self.options.get('prefix', 'frame_')}{r['frame_idx']:06d}{suffix}.fits"), plane, dict(r["header"] or {}))
        return WriterCommitMessage()


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FitsReader:
        return FitsReader(self.options)

    def writer(self, schema, overwrite: bool) -> FitsWriter:
        return FitsWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsSource)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("fits").options(**{k: str(v) for k, v in options.items()}).load(path)
