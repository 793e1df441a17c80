"""Mixing sources to target weights by Pfair scheduling.

The rows of each source, in hash order, are cut into blocks of BLOCK rows. In the ideal mix all sources flow at
once, each at its exact target as a share of the targets of those that still have blocks. Block j of a source is
released at the slot in which the ideal mix begins it and due by the end of that in which the ideal mix ends it;
the earliest deadline goes first among the released blocks. The blocks that lie within any run of slots are at
most as many as the slots, so every deadline is met, and after any number of slots, over the whole mix, each
source has less than one block more or less than in the ideal mix. Nothing is rounded: targets are taken as
fractions, and each source is scheduled for itself.

Every row is kept exactly once. Targets are target[source]; by default the number of rows to the power of
TEMPERATURE, which lifts small sources. The plan is made on the driver from the sizes of the sources and has 8
bytes for each block, in rows of PERIOD slots; it is broadcast up to PLAN_ROWS rows and shuffled beyond them.
The driver's memory and time thus grow with the number of blocks and of sources.

The place of a row within its source is a rank over (salt, hash): each salt's rows are ranked apart and the
counts of the salts before it are added, so a source that holds most of the rows is many tasks.

Defined cases: a null source is a source of its own; sources without a target get the mean of the targets,
those with a target of 0 or less come after all others; rows that repeat an id get places of their own; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.llm.common import NULL_ID, join_small, keyed, unkeyed, written

BLOCK, PERIOD, TEMPERATURE, SALT_ROWS, PLAN_ROWS = 16, 1024, 0.7, 20_000, 8_192
NULL_SOURCE = "\u0000null"


def _windows(own: int, blocks: int, ends: list[tuple[int, int]], before: int = 0):
    """(release, due) of each block of a source of integer weight own. ends: (blocks, weight) of all sources by the time they
    run out."""
    gone, flow = before, sum(a for _, a in ends)
    k, release = 0, before
    for j in range(1, blocks + 1):
        while k < len(ends) and j * ends[k][1] > ends[k][0] * own:
            gone, flow, k = gone + ends[k][0], flow - ends[k][1], k + 1
        yield release, gone - (-j * flow // own)
        release = gone + j * flow // own


def exact_schedule(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, array]:
    """The slots of the blocks of each source, by exact targets."""
    out, base = {s: array("q") for s in blocks}, 0
    for positive in (True, False):
        some = {s: Fraction(weights[s]) if positive else Fraction(1) for s, n in blocks.items() if n > 0 and (weights[s] > 0) == positive}
        scale = math.lcm(*[w.denominator for w in some.values()])
        parts = {s: int(w * scale) for s, w in some.items()}
        ends = sorted(((blocks[s], a) for s, a in parts.items()), key=lambda x: Fraction(*x))
        names = sorted(parts)
        windows = [_windows(parts[s], blocks[s], ends, base) for s in names]
        later = [(*next(w), i) for i, w in enumerate(windows)]
        heapq.heapify(later)
        ready: list[tuple[int, int]] = []
        stop = base + sum(blocks[s] for s in names)
        for slot in range(base, stop):
            while later and later[0][0] <= slot:
                _, due, i = heapq.heappop(later)
                heapq.heappush(ready, (due, i))
            _, i = heapq.heappop(ready)
            out[names[i]].append(slot)
            if (after := next(windows[i], None)) is not None:
                heapq.heappush(later, (*after, i))
        base = stop
    return out


def mix(docs: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """id, source, block, place (within the block), and slot (of the block) for each row: the mix is the order of (slot, place)."""
    spark = docs.sparkSession
    rows = docs.select(keyed(id_col).alias("_id"), F.coalesce(F.col(source_col).cast("string"), F.lit(NULL_SOURCE)).alias("_source"))
    # rows without an id are told apart by a number that is written with them
    number = F.when(F.col("_id") == NULL_ID, F.monotonically_increasing_id()).otherwise(0)
    rows = written(rows.withColumns({"_group": F.col("_source"), "_number": number}), "mix-rows")
    total = rows.count()
    salts = max(16, -(-total // SALT_ROWS))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", F.lit(11), "_number"), F.lit(salts)))
    cells = written(rows.groupBy("_group", "_salt").agg(F.count("*").alias("n")), "mix-cells")
    sizes = {r["_group"]: r["n"] for r in cells.groupBy("_group").agg(F.sum("n").alias("n")).collect()}
    given = targets or {s: n**TEMPERATURE for s, n in sizes.items()}
    mean = sum(given.values()) / max(1, len(given))
    weights = {s: float(given.get(None if s == NULL_SOURCE else s, given.get(s, mean))) for s in sizes}
    plan = exact_schedule({s: -(-n // block) for s, n in sizes.items()}, weights)

    # ranks: within a cell, then over the cells of a source
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_group").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cells.select("_group", "_salt", before.alias("_before"))
    w = Window.partitionBy("_group", "_salt").orderBy(F.xxhash64("_id", F.lit(11), "_number"), "_id", "_source")
    ranked = rows.withColumn("_rank", F.row_number().over(w) - 1).join(offsets, ["_group", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).withColumns({"_block": F.floor(F.col("_rank") / block).cast("long"), "_place": (F.col("_rank") % block).cast("int")})
    # rows of `period` slots, found by source and number
    ranked = ranked.withColumn("_part", F.floor(F.col("_block") / period).cast("long"))
    table = written(_plan_table(spark, plan, period), "mix-plan")
    out = join_small(ranked, table, ["_group", "_part"], "inner", PLAN_ROWS)
    slot = F.element_at("slots", (F.col("_block") % period).cast("int") + 1)
    return out.select(unkeyed("_id").alias(id_col), F.nullif("_source", F.lit(NULL_SOURCE)).alias(source_col), F.col("_group").alias("mix_group"), F.col("_block").alias("block"), F.col("_place").alias("place"), slot.cast("long").alias("slot"))


def _plan_table(spark: SparkSession, plan: dict[str, array], period: int) -> DataFrame:
    rows = [(s, k // period, slots[k : k + period].tolist()) for s, slots in plan.items() for k in range(0, len(slots), period)]
    return spark.createDataFrame(rows, "_group string, _part long, slots array<long>")

