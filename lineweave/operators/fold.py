"""One ordered pass over each document's lines, for what depends on all that came before."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of the documents that a worker folds before it sends their results on; a larger document is folded alone.
SLICE_BYTES, SLICE_ROWS = 8 << 20, 50_000

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def per_document(blocks: DataFrame, columns: list[str], fold: Callable[[list[tuple]], list[tuple]], schema: str, by: tuple[str, ...] = ("doc_id",), where: str | None = None) -> DataFrame:
    """fold(rows of one document, ordered by `columns`) -> rows of `schema`; the result has the columns `by` before them.

    A document's lines are gathered as one array by a single exchange. Arrow batches of documents are folded in slices of
    about SLICE_BYTES and SLICE_ROWS, and in a slice one document after another, so Python holds the rows of one document
    and the results of a slice. A fold that gives no rows leaves the document out, and so does `where`, a condition (SQL)
    on the array `__rows` that is tested before any of it goes to Python.
    """
    importable(blocks.sparkSession)
    gathered = blocks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("__rows"))
    kinds = [f"`{c}` {dict(blocks.dtypes)[c]}" for c in by]
    out = f"{', '.join(kinds)}, {schema}"
    arrow = blocks.sparkSession.createDataFrame([], out).toArrow().schema

    def made(rows: pa.ListArray, keys: list[pa.Array]) -> pa.RecordBatch:
        """The folded documents of a slice."""
        at, found = [], []
        for k in range(len(rows)):  # one document's rows as Python objects at a time
            new = fold([tuple(r.values()) for r in rows[k].as_py()])
            found += new
            at += [k] * len(new)
        taken = [x.take(pa.array(at, pa.int32())) for x in keys]
        own = list(zip(*found, strict=True)) if found else [()] * (len(arrow) - len(by))
        fields = list(arrow)[len(by) :]
        return pa.RecordBatch.from_arrays([*taken, *(pa.array(x, f.type) for x, f in zip(own, fields, strict=True))], schema=pa.schema([*(pa.field(c, x.type) for c, x in zip(by, keys, strict=True)), *fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, lo = b.column("__rows"), 0
            each = b.get_total_buffer_size() // max(1, b.num_rows)
            while lo < b.num_rows or not b.num_rows:
                # about SLICE_BYTES at once, but for one document that is larger
                n = 1
                while lo + n < b.num_rows and n * each < SLICE_BYTES and rows.offsets[lo + n + 1].as_py() - rows.offsets[lo].as_py() <= SLICE_ROWS:
                    n += 1
                yield made(rows.slice(lo, n), [b.column(c).slice(lo, n) for c in by])
                lo += n
                if not b.num_rows:
                    break

    return (gathered if where is None else gathered.where(where)).mapInArrow(run, out)
