"""Shared helpers: scratch tables, shared-store files, words, ragged arrays."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points outside this class.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` as the session has it. Only a local master may go without; it gets a
    temporary folder of its own.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="skyframes-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_SCRATCH: list[str] = []


def _remove(owner: int) -> None:
    if os.getpid() != owner:  # a forked child leaves its parent's files alone
        return
    for uri in _SCRATCH:
        with contextlib.suppress(Exception):
            store, path = open_store(uri)
            store.delete_dir(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is there is removed when the driver's process ends."""
    if not _SCRATCH:
        atexit.register(_remove, os.getpid())
    _SCRATCH.append(f"{shared_root(spark)}/skyframes-{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Arrow batches hold few rows: the rows here are whole texts, and a batch is held twice by a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FILTER_BITS = 23


def mark_members(rows: DataFrame, key: str, members: DataFrame, member_key: str, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag`` that is true for every key of ``members`` and for few others.

    Keys are 64-bit hashes. The members' bits are packed in at most 2^17 words, which bounds the broadcast; with very many
    members the flag only excludes less. It lets a join shuffle the rows that may match instead of all.
    """
    slot = lambda c: f"pmod({c}, {1 << FILTER_BITS}L)"
    bit = lambda c: f"shiftleft(1L, cast({slot(c)} & 63 as int))"
    words = members.groupBy(F.expr(f"shiftright({slot(member_key)}, 6)").alias("__word")).agg(F.expr(f"bit_or({bit(member_key)})").alias("__bits"))
    joined = rows.join(F.broadcast(words), F.expr(f"shiftright({slot(key)}, 6)") == F.col("__word"), "left")
    return joined.withColumn(flag, F.expr(f"coalesce((__bits & {bit(key)}) != 0, false)")).drop("__word", "__bits")


def open_store(uri: str):
    """The pyarrow file system and path of ``uri`` (a plain path, file://, hdfs://, s3:// ...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks: Iterator[bytes]) -> None:
    """Write a file under a name of its own, then move it into place, so that retried tasks are harmless."""
    store, path = open_store(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(part, path)


def make_dir(uri: str) -> str:
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)
    return uri


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal ``keys``, from batches that are sorted by them; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i, row in enumerate(rows):
            if row != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, row
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
