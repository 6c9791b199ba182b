"""Shared helpers of the training-data operators: table access, the shared folder, Arrow text slices."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Bytes of text that a Python worker handles at once; one longer text is handled alone.
SLICE_BYTES = 1 << 20

#: Rows of a file in the shared folder, of tables of a few numbers.
ROWS = 200_000

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and give the session a checkpoint folder if the cluster names none."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    shared_dir(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lineweave-"))
    return spark.sparkContext.getCheckpointDir()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and go on from there: losing an executor loses nothing that lies before.

    With `rows`, about how many rows df has, a file gets ROWS of them: many small files cost more than what is in them, as
    every new file may start a process that sets its permissions.
    """
    return (df if rows is None else df.coalesce(max(8, -(-rows // ROWS)))).checkpoint(eager=True)


def give_back() -> None:
    """Return freed memory to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def with_values(rows: DataFrame, values: DataFrame, key: str, weight: str, share: int = 1000) -> DataFrame:
    """rows left join values on `key`; values has one row for each key, and in `weight` how many rows have it.

    Keys of more than one in `share` rows, of which there are `share` at most, are broadcast and their rows stay where they
    are; the others are joined by a shuffle, where no key is hot then.
    """
    total = values.agg(F.sum(weight)).first()[0] or 0
    hot = values.where(F.col(weight) * share > total)
    names = [c for c in values.columns if c != key]
    first = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    rest = first.where("_hot IS NULL").drop(*names, "_hot").join(values, key, "left")
    return first.where("_hot").drop("_hot").unionByName(rest)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string"))


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array as one uint8 array and n+1 offsets into it; nulls are empty. No copy."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], kind, n + 1 + array.offset)[array.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    if array.null_count:  # a null slot may span bytes
        valid = np.asarray(array.is_valid())
        if (np.diff(offsets)[~valid] != 0).any():
            return bytes_of(array.fill_null(""))
    return data, offsets


def slices(array: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows with about `most` bytes together."""
    data, offsets = bytes_of(array)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n, lo + 8192)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def texts_of(array: pa.Array) -> Iterator[bytes]:
    """Each text as bytes; null as empty."""
    data, offsets = bytes_of(array)
    raw = memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield bytes(raw[a:b])


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until no column of df is called so (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
