"""Operator 3, approximate nearest neighbours: an inverted multi-index over two vector halves.

Unit vectors are cut in two halves, each quantised by its own centroids; a cell is a pair of centroids. A query walks the
pairs by summed distance with a heap until their cells hold enough vectors, and only these are ranked by exact cosine.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, prepare, table

#: Vectors that the centroids are fitted on at most; vectors of a cell, if all were alike; centroids of a half at most.
SAMPLE, CELL, MOST_CENTROIDS = 20000, 64, 512
#: Vectors whose true neighbours set how far queries walk, the share of these that must be met, and vectors of a bucket at most.
PROBES, RECALL, BUCKET = 256, 0.97, 1024
#: Queries that meet a bucket's vectors in one task at most, and queries whose walks are one task.
ASKED, WALKS = 4096, 64
#: Places kept of each query while parts are merged: 5 and the query's own, twice for ids that are there twice.
PLACES = 12


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled by a power of two first, so that squares neither vanish nor overflow."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the row of b beside it; equal rows give equal results wherever they stand."""
    a = np.ldexp(a, -np.frexp(np.abs(a).max(axis=1))[1][:, None])
    b = np.ldexp(b, -np.frexp(np.abs(b).max(axis=1))[1][:, None])
    dots = np.array([float(x @ y) for x, y in zip(a, b, strict=True)])
    return dots / (np.sqrt(np.array([float(x @ x) for x in a])) * np.sqrt(np.array([float(y @ y) for y in b])))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances without the length of x, which is the same for all centroids."""
    return (centroids * centroids).sum(axis=1) - 2 * x @ centroids.T


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k centroids; the first ones are spread over distinct rows, empty ones move to the farthest rows."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    c = distinct[np.random.default_rng(3).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        d = distances(x, c)
        near = d.argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if empty := np.flatnonzero(n == 0).tolist():
            c[empty] = x[np.argsort(-(d.min(axis=1) + (x * x).sum(axis=1)), kind="stable")[: len(empty)]]
    return c


@dataclass
class MultiIndex:
    """first, second: centroids of the halves; counts: vectors of each cell; start, parts: the buckets of each cell."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray | None = None
    start: np.ndarray | None = None
    parts: np.ndarray | None = None

    def cells(self, u: np.ndarray) -> np.ndarray:
        h = self.first.shape[1]
        return distances(u[:, :h], self.first).argmin(axis=1) * len(self.second) + distances(u[:, h:], self.second).argmin(axis=1)

    def deal(self, counts: np.ndarray, most: int = BUCKET) -> int:
        """Set the buckets: neighbouring cells share one up to `most` vectors, a larger cell has several. Their number."""
        self.counts, self.parts = counts, np.maximum(1, -(-counts // most)).astype(np.int32)
        self.start, bucket, held = np.zeros(len(counts), np.int32), 0, 0
        for k in np.flatnonzero(counts).tolist():
            n = int(counts[k])
            if held and held + n > most:
                bucket, held = bucket + 1, 0
            self.start[k] = bucket
            if n > most:
                bucket, held = bucket + int(self.parts[k]), 0
            else:
                held += n
        return bucket + 1

    def walk(self, u: np.ndarray, enough: int) -> Iterator[int]:
        """Cells that hold vectors, nearest first, until they hold `enough` together (or all are taken)."""
        h, k2 = self.first.shape[1], len(self.second)
        d1, d2 = distances(u[None, :h], self.first)[0], distances(u[None, h:], self.second)[0]
        o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
        s1, s2 = d1[o1].tolist(), d2[o2].tolist()
        got, counts = 0, self.counts
        heap, reached = [(s1[0] + s2[0], 0, 0)], [-1] * len(o1)
        while heap and got < enough:
            _, i, j = heapq.heappop(heap)
            reached[i] = j
            cell = o1[i] * k2 + o2[j]
            if n := int(counts[cell]):
                yield cell
                got += n
            # a pair is pushed once both pairs before it are out
            if j + 1 < len(o2) and (i == 0 or reached[i - 1] > j):
                heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
            if i + 1 < len(o1) and reached[i + 1] == j - 1:
                heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))

    def depths(self, u: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """For each row of u and of cells: the vectors in cells no farther than that cell, what a walk takes to meet it."""
        h, out = self.first.shape[1], np.zeros(cells.shape)
        for k, x in enumerate(u):
            d = (distances(x[None, :h], self.first).T + distances(x[None, h:], self.second)).ravel()
            order = np.argsort(d, kind="stable")
            out[k] = np.cumsum(self.counts[order])[np.searchsorted(d[order], d[cells[k]], side="right") - 1]
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix of doubles."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _ranked(queries: np.ndarray, walked: list[np.ndarray], entries: np.ndarray, cells: np.ndarray, ids: list[list[int]]) -> Iterator[tuple[int, float, int]]:
    """(query row, cosine, id): for each query at least the PLACES best ids of the cells that it walked, by exact cosine."""
    order = np.argsort(cells, kind="stable")
    own, starts, sizes = np.unique(cells[order], return_index=True, return_counts=True)
    qu, eu = unit(queries), unit(entries)[order]
    # cells of the bucket, with the queries that walked each
    size = np.array([len(w) for w in walked])
    asker, at = np.repeat(np.arange(len(queries)), size), np.searchsorted(own, np.concatenate(walked))
    by = np.argsort(at, kind="stable")
    asker, ends = asker[by], np.r_[0, np.cumsum(np.bincount(at, minlength=len(own)))]
    for lo in range(0, len(queries), 1024):
        s = np.full((min(1024, len(queries) - lo), len(entries)), -np.inf)
        for k, (first, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            rows = asker[ends[k] : ends[k + 1]]
            rows = rows[np.searchsorted(rows, lo) : np.searchsorted(rows, lo + 1024)]
            if len(rows):
                s[rows - lo, first : first + n] = qu[rows] @ eu[first : first + n].T
        few = min(PLACES, len(entries))
        best = np.argpartition(-s, few - 1, axis=1)[:, :few]
        bar = np.take_along_axis(s, best, axis=1).min(axis=1) - 1e-12  # rounding must not part equals
        for k in range(len(s)):
            met = order[np.flatnonzero((s[k] >= bar[k]) & (s[k] > -np.inf))]
            exact = cosine(np.broadcast_to(queries[lo + k], (len(met), queries.shape[1])), entries[met])
            flat = sorted((-x, i) for x, e in zip(exact.tolist(), met.tolist(), strict=True) for i in ids[e])
            for x, i in flat[:PLACES]:
                yield lo + k, -x, i


def _enough(entries: DataFrame, index: MultiIndex, probes: np.ndarray, nearest: int, recall: float) -> int:
    """Candidates that a walk must take to meet the share `recall` of the probes' true neighbours, found among all entries."""
    u = unit(probes)
    few = nearest + 1  # a probe is its own nearest

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, cell = np.full((len(u), few), -2.0), np.zeros((len(u), few), np.int32)
        for b in batches:
            if b.num_rows:
                s = np.c_[score, u @ unit(_matrix(b.column("v"))).T]
                c = np.c_[cell, np.broadcast_to(np.asarray(b.column("cell")), (len(u), b.num_rows))]
                top = np.argsort(-s, axis=1, kind="stable")[:, :few]
                score, cell = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
        if score.max() > -2:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(u)), few)), pa.array(score.ravel()), pa.array(cell.ravel())], ["probe", "score", "cell"])

    found = entries.select("v", "cell").mapInArrow(best, "probe long, score double, cell int").where("score > -2")
    top = found.withColumn("place", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "cell"))).where(F.col("place") <= few)
    met = top.select("probe", "cell").collect()  # PROBES times `few` rows at most
    depths = np.sort(np.concatenate([index.depths(u[r["probe"]][None], np.array([[r["cell"]]])).ravel() for r in met])) if met else np.zeros(1)
    return int(depths[min(len(depths) - 1, int(np.ceil(recall * len(depths))))]) + 1


def neighbours(vectors: DataFrame, every: int = 50, nearest: int = 5, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """vectors(vec_id long, embedding array, ...) -> query_id, rank, vec_id, score: the nearest of each vec_id divisible by `every`.

    Vectors null, zero, or with null or non-finite components, null ids, and vectors whose length is not the commonest
    (ties: the shorter; no cosine is defined between lengths) take no part. Equal vectors are one entry with its smallest
    ids, found map side first, so copies never meet in one task; repeated rows count once; an id with several vectors is
    searched by, and ranks at, the best of them. Cells of any size are indexed whole, in buckets; a query is compared with
    the vectors of the cells that it walked and no others. How far walks go is measured: PROBES vectors are compared with
    all, and walks take as many candidates as meet the share `recall` of their true neighbours. A bucket meets ASKED
    queries at once at most; of more, each part meets a copy of it. Empty input or no query: an empty result.
    """
    return walked(vectors, every, nearest, recall, bucket)[0]


def walked(vectors: DataFrame, every: int = 50, nearest: int = 5, recall: float = RECALL, bucket: int = BUCKET) -> tuple[DataFrame, int, int]:
    """neighbours(), the candidates that a walk takes, and the distinct vectors there are."""
    spark = vectors.sparkSession
    prepare(spark)
    out = "query_id long, rank int, vec_id long, score double"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where("vec_id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists(v, x -> x <> 0)")
    lengths = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], out), 0, 0
    v = v.where(F.size("v") == lengths["d"]).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), F.col("v"))})
    rows = v.groupBy("h1", "h2", "vec_id").agg(F.first("v").alias("v"))
    least = rows.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("place") <= nearest + 1)
    distinct = cut(least.groupBy("h1", "h2").agg(F.min_by("v", "vec_id").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = distinct.count()
    share = F.pmod("h2", F.lit(1 << 20)) < int(min(1.0, 1.2 * SAMPLE / n) * (1 << 20))
    few = distinct.where(share).orderBy("h1", "h2").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sampled = _matrix(few if len(few) else distinct.limit(1).select("v").toArrow()["v"].combine_chunks())
    u, half = unit(sampled), (lengths["d"] + 1) // 2
    k = int(min(MOST_CENTROIDS, max(2, round((n / CELL) ** 0.5))))
    index = MultiIndex(kmeans(u[:, :half], k), kmeans(u[:, half:], k))
    books = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = books.value.cells(unit(_matrix(b.column("v")))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.astype(np.int32))], [*b.schema.names, "cell"])

    entries = cut(distinct.mapInArrow(assign, "h1 long, h2 long, v array<double>, ids array<long>, cell int"))
    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for r in entries.groupBy("cell").count().collect():  # a row for each cell at most, MOST_CENTROIDS squared
        counts[r["cell"]] = r["count"]
    whole = MultiIndex(index.first, index.second)
    whole.deal(counts, bucket)
    candidates = _enough(entries, whole, sampled[:: max(1, len(sampled) // PROBES)][:PROBES], nearest, recall)
    plan = spark.sparkContext.broadcast(whole)

    asked = rows.where(F.col("vec_id") % every == 0)
    vectors_asked = cut(asked.groupBy("h1", "h2").agg(F.first("v").alias("v")))
    n_asked = vectors_asked.count()
    groups = max(1, -(-n_asked // ASKED))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, h = np.asarray(b.column("cell")), np.asarray(b.column("h1"))
            at = plan.value.start[cell] + (h % np.maximum(plan.value.parts[cell], 1)).astype(np.int32)
            for g in range(groups):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), g, np.int32)), *(b.column(c) for c in ("cell", "v", "ids"))], ["bucket", "part", "cell", "v", "ids"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = plan.value
        for b in batches:
            part = np.asarray(b.column("h2")) % groups
            for r, x in enumerate(unit(_matrix(b.column("v"))) if b.num_rows else ()):
                cells = np.fromiter(m.walk(x, candidates), np.int32)
                spread = m.parts[cells]
                at = np.repeat(m.start[cells], spread) + np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
                cells = np.repeat(cells, spread)
                order = np.lexsort((cells, at))
                at, cells = at[order], cells[order]
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(at)].astype(np.int32)), pa.array(cells))
                same = pa.array(np.full(len(first), r, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), pa.array(np.full(len(first), part[r], np.int32)), lists, *(b.column(c).take(same) for c in ("h1", "h2", "v"))], ["bucket", "part", "cells", "h1", "h2", "v"])

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float, int]] = []
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            h1, h2 = right["h1"].to_pylist(), right["h2"].to_pylist()
            cells, ends = right["cells"].chunk(0), np.asarray(right["cells"].chunk(0).offsets)
            steps = np.split(np.asarray(cells.values)[ends[0] : ends[-1]], ends[1:-1] - ends[0])
            found = [(h1[k], h2[k], s, i) for k, s, i in _ranked(_matrix(right["v"].chunk(0)), steps, _matrix(left["v"].chunk(0)), np.asarray(left["cell"].chunk(0)), left["ids"].to_pylist())]
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.table({name: pa.array(c, t) for (name, t), c in zip((("h1", pa.int64()), ("h2", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64())), columns, strict=True)})

    left = entries.mapInArrow(dealt, "bucket int, part int, cell int, v array<double>, ids array<long>").groupBy("bucket", "part")
    right = vectors_asked.repartition(max(1, -(-n_asked // WALKS)), "h1").mapInArrow(probes, "bucket int, part int, cells array<int>, h1 long, h2 long, v array<double>").groupBy("bucket", "part")
    found = left.cogroup(right).applyInArrow(rank, "h1 long, h2 long, score double, vec_id long")
    first = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= PLACES)
    pairs = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(found, ["h1", "h2"]).where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), candidates, n


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of each vector whose id is divisible by 50."""
    return neighbours(table(spark, sf_dir, "embeddings"))
