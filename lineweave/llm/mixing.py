"""Operator 4, mixing sources to target weights: a Pfair schedule of source blocks.

Block j (from 0) of a source with weight w is released at slot floor(j / w) and due by slot ceil((j + 1) / w); the
earliest due of the released goes first. Weights are kept as whole numbers in exactly their ratio, so a source is less
than one block from its target weight at every slot, however many there are. The driver folds the schedule, one step for
each block that exists (not for each slot); the rows are placed with DataFrame and SQL functions only.
"""

from __future__ import annotations

from fractions import Fraction
from heapq import heappop, heappush
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, free_name, prepare, table

#: Blocks of a source in one row of the plan, characters of a block, and the blocks whose plan is broadcast at most.
PERIOD, BLOCK_CHARS, BROADCAST_BLOCKS = 4096, 65536, 1 << 22
#: Without given weights, a source weighs its characters to this power.
TEMPERATURE = 0.5


def quotas(weights: dict[str, float], period: int = 1) -> dict[str, int]:
    """Whole numbers in exactly the ratio of the weights, the smallest whose sum is a multiple of `period`."""
    if any(not 0 < w < float("inf") for w in weights.values()):
        raise ValueError("weights must be positive numbers")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(x.denominator for x in exact.values()))
    own = {s: int(x * scale) for s, x in exact.items()}
    common = gcd(*own.values())
    total = sum(own.values()) // common
    return {s: n // common * (lcm(total, period) // total) for s, n in own.items()}


def slots_of(own: dict[str, int], blocks: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks, by earliest deadline first (ties: smaller name), a source having own / sum(own) of all.

    Only blocks that exist are scheduled, so slots of sources that have ended stay empty.
    """
    names, whole = sorted(own), sum(own.values())
    took: list[list[int]] = [[] for _ in names]
    # (release, source) of the next blocks that are not released, (deadline, source) of those that are
    later, ready = [(0, i) for i in range(len(names)) if blocks[names[i]] > 0], []
    t = 0
    while later or ready:
        if not ready:
            t = max(t, later[0][0])
        while later and later[0][0] <= t:
            i = heappop(later)[1]
            heappush(ready, (-(-(len(took[i]) + 1) * whole // own[names[i]]), i))
        due, i = heappop(ready)
        assert t < due, "a block is late"
        took[i].append(t)
        if len(took[i]) < blocks[names[i]]:
            heappush(later, (len(took[i]) * whole // own[names[i]], i))
        t += 1
    return dict(zip(names, took, strict=True))


def schedule(spark: SparkSession, own: dict[str, int], blocks: dict[str, int] | None = None, period: int = PERIOD) -> DataFrame:
    """(key, chunk, slots): the slots of blocks chunk * period and on of each source; without `blocks`, of its `own` first ones."""
    found = slots_of(own, own if blocks is None else blocks)
    rows = [(s, k // period, x[k : k + period]) for s, x in found.items() for k in range(0, len(x), period)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("key", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("slots", T.ArrayType(T.LongType()))]), verifySchema=False)


def _key(source: Column) -> Column:
    """A source's name with `v` before it; `n` for null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), source.cast("string")))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, period: int = PERIOD) -> DataFrame:
    """docs(doc_id, text, source, ...) with block, slot and start: read in the order of (slot, start), sources have their weights.

    A source's documents are laid end to end in the order of md5(doc_id) (ties: doc_id, then text; null ids first); start
    is the characters before a document, block = floor(start / block_chars), slot the block's place in the schedule. At
    each slot a source has had less than one block from its share, until its documents end; from there its slots stay empty
    and the rest keep their ratios. Every row stays. Null source: a source of its own. Null text: no characters. Sources
    without a weight in `weights`: ValueError. Without weights: characters to the power TEMPERATURE.

    A source's rows are dealt by (source, leading digits of the md5), so a large source is many groups of some thousand
    rows; the running sums of the groups' totals give each group its start. Any number of sources is mixed: the driver
    holds a number for each block. `period` is the blocks in a row of the plan and does not change what is planned.
    """
    spark = docs.sparkSession
    prepare(spark)
    names = docs.columns
    inner = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(names)], docs["doc_id"].alias("id"), docs["text"].cast("string").alias("words"), _key(docs["source"]).alias("key"))
    size = F.coalesce(F.length("words"), F.lit(0)).cast("long")
    n = docs.count()
    digits = next(d for d in range(2, 8) if 16**d * 1024 >= n or d == 7)
    order = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    light = inner.select("key", size.alias("size"), order.substr(1, digits).alias("part"))
    groups = cut(light.groupBy("key", "part").agg(F.sum("size").alias("size")), n)
    totals = {r["key"]: r["size"] for r in groups.groupBy("key").agg(F.sum("size").alias("size")).collect()}
    if weights is None:
        targets = {s: max(float(x), 1.0) ** TEMPERATURE for s, x in totals.items()}
    else:
        given = {"n" if s is None else f"v{s}": float(w) for s, w in weights.items()}
        if missing := sorted(totals.keys() - given.keys()):
            raise ValueError(f"no weight for {missing[:5]}")
        targets = {s: given[s] for s in totals}
    before = groups.select("key", "part", F.coalesce(F.sum("size").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    w = Window.partitionBy("key", "part").orderBy("order", F.col("id").asc_nulls_first(), F.col("words").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = inner.withColumn("order", order).withColumn("part", F.col("order").substr(1, digits)).withColumn("inside", F.coalesce(F.sum(size).over(w), F.lit(0)))
    placed = placed.join(before, ["key", "part"]).withColumn("start", F.col("base") + F.col("inside")).withColumn("block", F.expr(f"start div {block_chars}L"))
    blocks = {s: x // block_chars + 1 for s, x in totals.items()}
    if targets:
        plan = schedule(spark, quotas(targets), blocks, period)
        # 8 bytes for each block of text; a larger plan is joined like any other table
        plan = F.broadcast(plan) if sum(blocks.values()) <= BROADCAST_BLOCKS else plan
    else:
        plan = spark.createDataFrame([], "key string, chunk long, slots array<bigint>")
    placed = placed.withColumn("chunk", F.expr(f"block div {period}L"))
    done = placed.join(plan, ["key", "chunk"]).withColumn("slot", F.expr(f"slots[cast(block % {period}L AS int)]"))
    plain = docs.limit(0)
    return done.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], *[F.col(c).alias(free_name(plain, c)) for c in ("block", "slot", "start")])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block, slot, start for every document, sources weighing the root of their characters."""
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source", "block", "slot", "start")


def in_mixed_order(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """All rows and columns of docs, sorted by their slots; empty documents, which share their start, by doc_id."""
    slot, start = free_name(docs, "slot"), free_name(docs, "start")
    return mixed(docs, weights).orderBy(slot, start, F.length("text"), "doc_id").select(*docs.columns)
