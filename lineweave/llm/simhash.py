"""Operator 9, SimHash near-duplicates: fingerprints, a segment-popcount grid join, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, cut, prepare, table, texts_of, with_values
from .graph import components

#: Words of a shingle, seed of its XXH64, and the bits in which linked fingerprints may differ.
WORDS, SEED, BITS = 4, 42, 4
LOW = 0x5555555555555555  # the low bit of each 2-bit segment


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of a text's word shingles (repeats count), as an unsigned int; 0 without words."""
    parts = text.translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate([len(w) + 1 for w in parts]))
    n, digest, sums = len(parts) - words + 1, xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    starts = [0, *ends[: n - 1]]
    for k in range(0, n, 32768):
        h = np.fromiter((digest(joined[s : e - 1], SEED) for s, e in zip(starts[k : k + 32768], ends[k + words - 1 : k + words - 1 + 32768], strict=False)), np.uint64)
        sums += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(t) for t in texts_of(b.column("text"))), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(t) for t in texts_of(b.column("text"))), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found.view(np.int64))], [*b.schema.names, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every row; a null or empty text has fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def groups_for(n: int, bits: int = BITS) -> int:
    """Groups of segments for n distinct fingerprints: the fewest for which a random one meets under about 64 others.

    Fingerprints within `bits` agree in the popcounts of all but `bits` of the groups at most (a bit that differs changes
    one popcount by one, and Manhattan distance is no more than Hamming distance), so whatever the number, no link is lost.
    """
    return next((g for g in range(bits + 1, bits + 6) if comb(g, bits) * n / 2 ** (1.415 * 32 * (g - bits) / g) <= 64), bits + 6)


def masks(groups: int, bits: int = BITS) -> list[int]:
    """Masks over the packed popcounts: for each choice of groups - bits groups, its 2-bit segments."""
    own = [sum(3 << 2 * s for s in range(32) if s * groups // 32 == g) for g in range(groups)]
    return [sum(own[g] for g in some) for some in combinations(range(groups), groups - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The 32 popcounts (0 to 2) of 2-bit segments, packed in as many 2-bit fields."""
    half, low = fp >> np.uint64(1), np.uint64(LOW)
    return ((fp & half & low) << np.uint64(1)) | ((fp ^ half) & low)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed popcounts: fields that differ in their low bit are 1 apart, in their high bit only 2."""
    x, low = a ^ b, np.uint64(LOW)
    return np.bitwise_count(x & low) + 2 * np.bitwise_count((x >> np.uint64(1)) & ~x & low)


def near(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which pairs differ in at most `bits` bits; the Manhattan bound goes first."""
    close = manhattan(popcounts(a), popcounts(b)) <= bits
    close[close] = np.bitwise_count((a ^ b)[close]) <= bits
    return close


def spanning(v: np.ndarray, fp: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Edges that join all of a cell's linked vertices, one less than the members of each group of them.

    Each vertex taken is compared with those not yet reached, so a dense cell costs about its size, and only a cell of
    unlike members its square, which groups_for keeps small.
    """
    left, out, todo = np.arange(len(v)), [], []
    while len(left) or todo:
        if not todo:
            todo, left = [int(left[0])], left[1:]
        at = todo.pop()
        hit = near(np.broadcast_to(fp[at], len(left)), fp[left], bits)
        for k in left[hit].tolist():
            out.append((int(v[at]), int(v[k])))
            todo.append(k)
        left = left[~hit]
    return out


def _links(cuts: list[int], bits: int = BITS):
    """Rows (choice, key, fp) sorted by cell -> edges(a, b) of fingerprints; a cell that goes on in the next batch is carried over.

    An edge whose ends also share the cell of an earlier choice is left out, as that cell joins them already.
    """
    fields = [np.uint64(m) for m in cuts]

    def cells(choice: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[new, len(key)])
        cell, wide = np.repeat(new, size), np.repeat(size, size)
        a, b = [], []
        for d in range(1, min(8, len(key))):  # small cells all at once: rows d apart in one cell
            at = np.flatnonzero((cell[:-d] == cell[d:]) & (wide[:-d] <= 8))
            at = at[near(fp[at], fp[at + d], bits)]
            a.append(at)
            b.append(at + d)
        for k in np.flatnonzero(size > 8):
            s = slice(new[k], new[k] + size[k])
            if edges := spanning(np.arange(s.start, s.stop), fp[s], bits):
                x = np.array(edges, np.int64)
                a.append(x[:, 0])
                b.append(x[:, 1])
        one, two = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        unlike, first = popcounts(fp[one]) ^ popcounts(fp[two]), np.full(len(one), len(fields))
        for k in range(len(fields) - 1, -1, -1):
            first[(unlike & fields[k]) == 0] = k
        kept = first == choice[one]
        return pa.RecordBatch.from_arrays([pa.array(fp[x[kept]].view(np.int64)) for x in (one, two)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            now = [np.asarray(batch.column(c)) for c in ("choice", "key", "fp")]
            now[2] = now[2].view(np.uint64)
            if carry is not None:
                now = [np.concatenate(x) for x in zip(carry, now, strict=True)]
            if not len(now[0]):
                continue
            last = int(np.argmax((now[0] == now[0][-1]) & (now[1] == now[1][-1])))
            carry = [x[last:] for x in now]
            if last:
                yield cells(*(x[:last] for x in now))
        if carry is not None:
            yield cells(*carry)

    return run


def links(vertices: DataFrame, n: int) -> DataFrame:
    """vertices(fp long, distinct, n of them) -> edges(a, b) whose components are those of all links of 4 bits or fewer.

    The embedding of a fingerprint is its 32 popcounts; a grid cell is the popcounts of one choice of groups. Cells are
    dealt by (choice, key) and sorted; within one, the Manhattan bound and then the exact distance are tested.
    """
    fp, half, low = F.col("fp"), F.shiftrightunsigned("fp", 1), F.lit(LOW)
    packed = F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseXOR(half).bitwiseAND(low))
    cuts = masks(groups_for(n))
    keys = F.array(*[packed.bitwiseAND(F.lit(_signed(m))) for m in cuts])
    dealt = vertices.select("fp", F.posexplode(keys).alias("choice", "key"))
    return dealt.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(_links(cuts), "a long, b long")


def _components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of docs: the smallest fingerprint and the smallest doc_id of its component."""
    fps = cut(fingerprints(docs))
    vertices = cut(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("v"), F.count("*").alias("n")), fps.count())
    n = vertices.count()
    found = components(links(vertices.select("fp"), n), n)
    rooted = cut(vertices.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "v", "n", F.coalesce("component", "fp").alias("root")), n)
    least = cut(rooted.groupBy("root").agg(F.min("v").alias("component_id"), F.count("*").alias("members")), n)
    named = with_values(rooted, least, "root", "members").select("fp", "n", "root", "component_id")
    return with_values(fps, named, "fp", "n").select("doc_id", "fp", *[F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("root", "component_id")])


def simhash_components(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fp long, component_id long), a row for every row of docs.

    Equal fingerprints are one vertex before any join, so groups of copies never meet in one task. component_id is the
    smallest doc_id of a component. Rows with null doc_id are fingerprinted but linked to nothing: component_id is null.
    Rows that repeat a doc_id are linked by their fingerprints alone, and may be in different components.
    Fingerprint 0 (null, empty, blank texts) is linked like any other. Empty input: empty result. Other columns: ignored.
    """
    prepare(docs.sparkSession)
    return _components(docs).select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id for every document."""
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id, then the greatest text; columns as they are.

    Rows with null doc_id stay. Rows that are equal in both are told apart by their other columns, so a task that is run
    again keeps the same one. Only rows whose doc_id is repeated are fingerprinted again, to find their components.
    """
    prepare(docs.sparkSession)
    found = _components(docs).where("doc_id IS NOT NULL").withColumn("least", F.col("doc_id") == F.col("component_id"))
    ids = cut(found.groupBy(F.col("doc_id").alias("keep__id")).agg(F.count("*").alias("n"), F.max("least").alias("least")).where("least"))
    once, often = ids.where("n = 1").select("keep__id"), ids.where("n > 1").select("keep__id")
    key = docs["doc_id"].cast("long")
    kept = docs.join(once, key == once["keep__id"], "left_semi").unionByName(docs.where(key.isNull()))
    if often.isEmpty():
        return kept
    names = docs.columns
    # fingerprints of the repeated ids that are kept, each once, with its component
    own = cut(found.where("least").join(often, F.col("doc_id") == F.col("keep__id"), "left_semi").select(F.col("doc_id").alias("id"), "fp", "root").distinct())
    rows = docs.join(often, key == often["keep__id"], "left_semi")
    rows = rows.select(key.alias("id"), rows["text"].cast("string").alias("text"), F.struct(*[rows[c].alias(f"c{k}") for k, c in enumerate(names)]).alias("row"))
    marked = rows.mapInArrow(_marked, f"id long, text string, row {rows.schema['row'].dataType.simpleString()}, fp long").join(own, ["id", "fp"])
    best = marked.groupBy("id", "root").agg(F.max_by("row", F.struct("text", F.to_json("row"))).alias("row"))
    return kept.unionByName(best.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)]))
