"""Mixing sources to target weights by Pfair scheduling. DataFrame functions alone touch the documents.

The documents of a source form blocks. One block is placed in each slot. With weight w, the i-th block of a source (from 1)
is released at slot floor((i - 1) / w) and due by slot ceil(i / w); of the blocks released, the one due first goes next. As
the weights add up to 1, every block meets its window, so after any number of slots t each source has had w * t blocks with
a deviation of less than one. Weights are ratios of whole numbers, exactly as given, and so are the windows: nothing is
rounded. When a source has no block left, a new phase begins: the weights of the others are scaled up, and their windows
start afresh.

The schedule is made for blocks, not rows: their size follows from the rows, so that a mixture of any size has
``MOST_BLOCKS`` blocks at most beside one for each source, and the table of slots that meets the rows is bounded.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unitloom.llm.common import table

#: Rows of a block, at least.
BLOCK = 16
#: Blocks of a mixture, about, beside the last one of each source.
MOST_BLOCKS = 262_144
#: Rows that share one bucket of the order within a source, about.
BUCKET_ROWS = 4096


def whole(weights: list) -> list[int]:
    """Whole numbers in the proportion of ``weights`` (whole numbers, fractions, decimals or floats), without any loss: a float
    is taken as the decimal it is written as."""
    exact = [Fraction(str(w)) if isinstance(w, float) else Fraction(w) for w in weights]
    scale = math.lcm(*(x.denominator for x in exact))
    out = [int(x * scale) for x in exact]
    shared = math.gcd(*out)
    return [x // shared for x in out]


@dataclass
class Phase:
    """Slots ``begin`` to ``end``: sources ``sources`` have weights ``parts`` of their sum; each had ``before`` blocks earlier."""

    begin: int
    sources: list[int]
    parts: list[int]
    before: list[int]
    end: int = 0


def plan(blocks: list[int], weights: list) -> tuple[list[Phase], list[int]]:
    """Phases for sources with so many blocks each, and the source of every slot: earliest deadline first among the
    released blocks, ties to the earlier source."""
    parts, placed = whole(weights), [0] * len(blocks)
    phases: list[Phase] = []
    slots: list[int] = []
    while active := [i for i, n in enumerate(blocks) if placed[i] < n]:
        total = sum(parts[i] for i in active)
        begin, before = len(slots), list(placed)
        waiting = [(0, i) for i in active]  # release (from the phase's begin) of each source's next block
        heapq.heapify(waiting)
        ready: list[tuple[int, int]] = []  # deadline, source
        while True:
            now = len(slots) - begin
            while waiting and waiting[0][0] <= now:
                _, i = heapq.heappop(waiting)
                k = placed[i] - before[i] + 1
                heapq.heappush(ready, (-(-k * total // parts[i]), i))
            if blocks[ready[0][1]] == placed[ready[0][1]]:  # the source next in turn has ended
                break
            due, i = heapq.heappop(ready)
            assert due > now
            slots.append(i)
            placed[i] += 1
            heapq.heappush(waiting, ((placed[i] - before[i]) * total // parts[i], i))
        phases.append(Phase(begin, active, [parts[i] for i in active], [before[i] for i in active], len(slots)))
    return phases, slots


def mix(docs: DataFrame, weights: dict | None = None, source_col: str = "source", id_col: str = "doc_id", block: int | None = None) -> DataFrame:
    """Every row of ``docs``, packed in ``row``, with ``phase``, ``block`` (of its source, from 0), ``release`` and
    ``deadline`` (slots), ``slot`` and ``place`` (within the block). Reading by slot and place gives the mixture.

    ``weights`` maps a source to its weight; by default it is the square root of the source's rows, to six decimals. A
    source without a weight, or one of 0, is an error; a null source is a source of its own, named None. ``block`` is the
    rows of a block; by default ``BLOCK``, or as many as keep the blocks to ``MOST_BLOCKS``. Within a source rows are
    ordered by a hash of the whole row, then the id; equal rows may stand in either order. Null ids are allowed; the last
    block of a source may be short; an empty table gives no rows. Nothing is dropped: once a source ends, the rest go on
    in a later phase. What the driver holds follows the number of sources and ``MOST_BLOCKS``, not that of rows.
    """
    spark = docs.sparkSession
    packed = docs.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"))
    hashed = packed.select("row", "source", "id", F.xxhash64("row").alias("h"))
    counted = docs.groupBy(F.col(source_col).cast("string").alias("source")).count().orderBy("source").collect()  # one row a source, as the weights have
    if weights is not None and any(not weights.get(r["source"], 0) > 0 for r in counted):
        raise ValueError("every source needs a weight above 0")
    rows = sum(r["count"] for r in counted)
    block = block or max(BLOCK, -(-rows // MOST_BLOCKS))
    wanted = [weights[r["source"]] if weights else max(1, math.isqrt(r["count"] * 10**12)) for r in counted]
    phases, slots = plan([-(-r["count"] // block) for r in counted], wanted) if counted else ([], [])
    # A source may hold most rows: ranks are taken within buckets of the hash and shifted by the rows in earlier buckets.
    buckets = max(1, rows // BUCKET_ROWS)
    in_bucket = hashed.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 34) * F.lit(buckets)) / F.lit(1 << 30)).cast("int"))
    # Plain keys, the same for the window and the join, so that whole rows are shuffled once.
    in_bucket = in_bucket.withColumns({"unnamed": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))})
    keys = ["unnamed", "name", "bucket"]
    sizes = in_bucket.groupBy(*keys).count()
    before = F.sum("count").over(Window.partitionBy("unnamed", "name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "id"))
    ranked = in_bucket.withColumn("rank", rank).join(offsets, keys)
    n = F.col("before") + F.col("rank") - 1
    blocks = ranked.select("row", "source", F.floor(n / block).cast("long").alias("block"), (n % block).cast("int").alias("place"))
    turns, done = [], [0] * len(counted)
    for p, phase in enumerate(phases):
        total, at = sum(phase.parts), {i: (part, first) for i, part, first in zip(phase.sources, phase.parts, phase.before, strict=True)}
        for slot in range(phase.begin, phase.end):
            i = slots[slot]
            part, first = at[i]
            k = done[i] - first
            turns.append((p, counted[i]["source"], done[i], slot, phase.begin + k * total // part, phase.begin - (-(k + 1) * total // part)))
            done[i] += 1
    schedule = spark.createDataFrame(turns, "phase int, source3 string, block3 long, slot long, release long, deadline long")
    # At most MOST_BLOCKS rows beside one for each source.
    joined = blocks.join(F.broadcast(schedule), F.col("source").eqNullSafe(F.col("source3")) & (F.col("block") == F.col("block3")))
    return joined.select("row", "phase", "block", "release", "deadline", "slot", "place")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rows of documents in their mixture; a deadline may lie past the end of its phase."""
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "row.source", "row.text", "phase", "block", "release", "deadline", "slot", "place")


QUERIES = {"op3_mixing": op3_mixing}
SQL: dict[str, str] = {}
