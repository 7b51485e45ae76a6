"""Text tables, saved residual collections, and product sinks."""

from __future__ import annotations

import json
import os
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fits


def read_columns(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(basename, value, line) of a white-space separated text file; comment lines start with #."""
    rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parts = F.split(F.trim("value"), r"\s+")
    rows = rows.filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return rows.select(F.get(parts, F.lit(0)).alias("basename"), F.get(parts, F.lit(1)).try_cast("double").alias(value), "line")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(line, path) of a list file."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("line"), F.trim("value").alias("path"))


def residual_name(prefix: str, mode: int, frame: int, extension: str = ".fits") -> str:
    return f"{prefix}_{mode:03d}_{frame:05d}{extension}"


def residual_index(names: list[str], prefix: str, extension: str = ".fits") -> dict[tuple[int, int], str]:
    """File of each (mode, frame). Malformed names, repeated cells and gaps in the grid are errors."""
    pattern = re.compile(re.escape(prefix) + r"_(\d+)_(\d+)" + re.escape(extension))
    out: dict[tuple[int, int], str] = {}
    for name in names:
        base = os.path.basename(name)
        if not (base.startswith(prefix) and base.endswith(extension)):
            continue
        m = pattern.fullmatch(base)
        if not m:
            raise ValueError(f"malformed name {base}")
        key = int(m[1]), int(m[2])
        if key in out:
            raise ValueError(f"{base} repeats mode and frame {key}")
        out[key] = name
    if not out:
        raise ValueError("no saved residual was found")
    modes, frames = max(k[0] for k in out) + 1, max(k[1] for k in out) + 1
    if missing := [(m, f) for m in range(modes) for f in range(frames) if (m, f) not in out]:
        raise ValueError(f"the collection lacks {missing[:5]}")
    return out


def read_residuals(spark: SparkSession, directory: str, prefix: str, extension: str = ".fits") -> DataFrame:
    """(mode_idx, frame_idx, header, n_rows, n_cols, pixels), checked against the names' indices and the headers' cards."""
    index = residual_index([os.path.join(directory, x) for x in sorted(os.listdir(directory))], prefix, extension)
    rows = fits.read(spark, os.path.join(directory, f"{prefix}_*{extension}"))
    m = lambda i: F.regexp_extract("basename", re.escape(prefix).replace("\\_", "_") + r"_(\d+)_(\d+)", i).cast("int")
    out = rows.withColumns({"mode_idx": m(1), "frame_idx": m(2)})
    wrong = F.coalesce(F.col("header")["REDUCTION"].try_cast("int") != F.col("mode_idx"), F.lit(False)) | F.coalesce(F.col("header")["IMAGE"].try_cast("int") != F.col("frame_idx"), F.lit(False))
    out = out.withColumn("mode_idx", F.when(wrong, F.raise_error(F.concat(F.lit("header and name differ: "), "basename")).cast("int")).otherwise(F.col("mode_idx")))
    assert len(index)
    return out.select("mode_idx", "frame_idx", "header", "n_rows", "n_cols", "pixels")


def list_cards(name: str, values: list) -> dict[str, str]:
    """A list as cards: joined by commas, in parts that fit."""
    text = ",".join(f"{v:g}" if isinstance(v, float) else str(v) for v in values)
    return {name if not i else f"{name} {i // 60}": text[i : i + 60] for i in range(0, len(text), 60)}


def read_list(header: dict[str, str], name: str) -> list[float]:
    """The numbers of a list's cards; none if there is no card."""
    parts, i = [], 0
    while (part := header.get(name if not i else f"{name} {i}")) is not None:
        parts.append(str(part))
        i += 1
    return [float(x) for x in "".join(parts).split(",") if x.strip()]


def write_residuals(residual: DataFrame, directory: str, prefix: str, size: int, weights: dict[int, float] | None = None, cards: dict[str, str] | None = None) -> None:
    """One file per (mode_idx, frame_idx) from long residuals, each written where its pixels are; and weights.dat."""
    os.makedirs(directory, exist_ok=True)

    def save(key, p):
        image = np.full((size, size), np.nan)
        image[p["row"].to_numpy(), p["col"].to_numpy()] = p["value"].to_numpy(float)
        name = residual_name(prefix, int(key[0]), int(key[1]))
        fits.write_image(os.path.join(directory, name), image, {"REDUCTION": int(key[0]), "IMAGE": int(key[1]), **(cards or {})})
        import pandas as pd

        return pd.DataFrame({"name": [name]})

    residual.groupBy("mode_idx", "frame_idx").applyInPandas(save, "name string").count()
    if weights:
        with open(os.path.join(directory, "weights.dat"), "w") as f:
            f.writelines(f"{residual_name(prefix, 0, i)} {w!r}\n" for i, w in sorted(weights.items()))


def next_path(directory: str, name: str = "finim_", exact: bool = False) -> str:
    """The next unused ``NAME0000.fits``, or the exact name."""
    os.makedirs(directory or ".", exist_ok=True)
    if exact:
        return os.path.join(directory, name)
    i = 0
    while os.path.exists(p := os.path.join(directory, f"{name}{i:04d}.fits")):
        i += 1
    return p


def write_final(final: DataFrame, path: str, size: int, header: dict | None = None) -> str:
    """Final images (mode_idx, row, col, value) as planes of one file: bounded by image size times modes."""
    rows = final.select("mode_idx", "row", "col", "value").toPandas()
    cube = np.full((int(rows["mode_idx"].max()) + 1, size, size), np.nan)
    cube[rows["mode_idx"], rows["row"], rows["col"]] = rows["value"]
    fits.write_image(path, cube, header)
    return path


def provenance(options: dict) -> dict[str, str | int | float | bool]:
    """Header cards of the options in use: sections and keys as words, lists joined by commas, long values cut into parts."""
    out: dict[str, str | int | float | bool] = {}
    for key, value in sorted(options.items()):
        name = key.replace(".", " ").replace("_", " ").upper()
        text = ",".join(map(str, value)) if isinstance(value, (list, tuple)) else value
        if isinstance(text, str):
            room = max(8, 62 - len(name))
            for i in range(0, max(1, len(text)), room):
                out[name if not i else f"{name} {i // room}"] = text[i : i + room]
        elif text is not None:
            out[name] = text
    return out


def write_search(search, prefix: str) -> None:
    """A merit table and a summary of an optimiser's run; the best setting only when it has converged."""
    with open(f"{prefix}merit.csv", "w") as f:
        f.write("trial,merit," + ",".join(f"x{i}" for i in range(len(search.best))) + "\n")
        f.writelines(f"{i},{m!r}," + ",".join(map(repr, x)) + "\n" for i, (x, m) in enumerate(search.samples))
    with open(f"{prefix}summary.json", "w") as f:
        json.dump({"best": search.best, "merit": search.merit, "converged": search.converged, "agrees": search.agrees, "evaluations": len(search.samples)}, f, indent=1)
    if search.converged:
        with open(f"{prefix}best.json", "w") as f:
            json.dump({"best": search.best}, f)


def write_jackknife(fits: list[float], error: float, prefix: str) -> None:
    """The fits without each block and their standard error."""
    with open(f"{prefix}jackknife.csv", "w") as f:
        f.write("block,contrast\n")
        f.writelines(f"{i},{x!r}\n" for i, x in enumerate(fits))
        f.write(f"error,{error!r}\n")
