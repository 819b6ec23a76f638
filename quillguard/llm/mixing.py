"""Sources interleaved to target weights by Pfair scheduling.

Rows of a source are cut into blocks of ``block_rows`` in order of doc_id.  A fluid of all
sources would serve each at its weight over the weights of the sources that have rows left.
With f(t) a source's share of the fluid after t slots, in blocks, its block k may run from
slot floor(f^-1(k)) on and must end by slot ceil(f^-1(k + 1)); in each slot the released block
with the earliest deadline runs.  Weights are exact fractions, never rounded, and so are
releases and deadlines: the fluid's time is piecewise linear, with one piece between two ends
of sources.  Every source is then less than one block away from its share in every prefix of
the mixture, also after others have ended.

The driver takes one step a block, sees no row, and hands places on in cells of ``CELL``
blocks, of which it never holds more than ``HELD`` besides one open cell a source.  By default
a block has ``BLOCK_ROWS`` rows, more where that would make over ``MOST_BLOCKS`` of them, so
the driver's work is bounded for any table; the guarantee is in blocks either way.

Defined results: a null source is a source of its own; repeated rows are placed each; sources
missing from the given weights, or of weight 0, come after all others, by size; other columns
pass through, but those of ``ADDED`` names are replaced.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ordered

BLOCK_ROWS, MOST_BLOCKS = 16, 1 << 21
#: Blocks of a source whose places make one row of the schedule, and places that the driver
#: gathers before it writes them.
CELL, HELD = 4096, 1 << 18


ADDED = ("_phase", "_block", "_slot", "_position")


def exact_shares(weights: dict) -> dict:
    """The smallest whole numbers in the ratio of the weights; their sum is D."""
    names = sorted(weights, key=lambda s: (s is not None, s or ""))
    given = {s: Fraction(weights[s]) for s in names}
    whole = math.lcm(*(w.denominator for w in given.values()))
    shares = {s: int(w * whole) for s, w in given.items()}
    common = math.gcd(*shares.values())
    return {s: n // common for s, n in shares.items()}


rounded = exact_shares


class Fluid:
    """The slots at which the fluid of sources with ``blocks`` and whole weights ``shares`` has
    served given parts of them.  A source's own clock runs at blocks / share."""

    def __init__(self, blocks: dict, shares: dict):
        self.shares = shares
        by_end = sorted(blocks, key=lambda s: Fraction(blocks[s], shares[s]))
        self.clock = [blocks[s] / shares[s] for s in by_end]  # to look up, then compared exactly
        self.exact = [(blocks[s], shares[s]) for s in by_end]
        # Before the i-th end: blocks of sources that ended, and the shares of the others.
        self.ended, self.active = [0], [sum(shares.values())]
        for s in by_end:
            self.ended.append(self.ended[-1] + blocks[s])
            self.active.append(self.active[-1] - shares[s])
        #: The whole slots after which 1, 2, ... sources have ended.
        self.ends = [self.ended[i] + self.active[i] * n // share for i, (n, share) in enumerate(self.exact)]

    def at(self, s, k: int) -> tuple[int, int]:
        """(whole slots, remainder in units of 1 / share) when ``s`` has been served k blocks."""
        share = self.shares[s]
        i = bisect_right(self.clock, k / share)
        while i < len(self.exact) and self.exact[i][0] * share <= k * self.exact[i][1]:
            i += 1
        while i and self.exact[i - 1][0] * share > k * self.exact[i - 1][1]:
            i -= 1
        whole, rest = divmod(self.active[i] * k, share)
        return self.ended[i] + whole, rest


def turns(blocks: dict, shares: dict) -> Iterator[tuple]:
    """(source, its block) of each slot: earliest deadline first among released blocks."""
    fluid = Fluid(blocks, shares)
    waiting = [(0, n, s, 0) for n, s in enumerate(shares)]
    heapq.heapify(waiting)
    ready: list = []
    for slot in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= slot:
            _, n, s, k = heapq.heappop(waiting)
            whole, rest = fluid.at(s, k + 1)
            # The next block's release is this one's deadline before rounding.
            heapq.heappush(ready, (whole + (rest > 0), n, s, k, whole))
        deadline, n, s, k, released = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a block missed its deadline")
        yield s, k
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (released, n, s, k + 1))


def pattern(shares: dict) -> list:
    """The source of each slot of one period."""
    return [s for s, _ in turns(shares, shares)]


def schedule(rows: dict, weights: dict, block_rows: int, put: Callable) -> None:
    """Places the blocks of sources with ``rows`` (none empty): ``put`` (source, cell, slots,
    positions of first rows, phases) is given them in cells.  A phase ends with a source."""
    first_slot = first_row = first_phase = 0
    known = {s: w for s in rows if (w := weights.get(s) or 0) > 0}
    for group in (known, {s: rows[s] for s in rows if s not in known}):
        if not group:
            continue
        blocks = {s: -(-rows[s] // block_rows) for s in group}
        shares = exact_shares(group)
        blocks = {s: blocks[s] for s in shares}
        ends = Fluid(blocks, shares).ends
        open_ = {s: (array("q"), array("q"), array("q")) for s in shares}
        phase = 0
        for slot, (s, k) in enumerate(turns(blocks, shares)):
            while ends[phase] <= slot:
                phase += 1
            cell = open_[s]
            cell[0].append(first_slot + slot)
            cell[1].append(first_row)
            cell[2].append(first_phase + phase)
            first_row += min(block_rows, rows[s] - k * block_rows)
            if len(cell[0]) == CELL or k + 1 == blocks[s]:
                put(s, k // CELL, *cell)
                open_[s] = (array("q"), array("q"), array("q"))
        first_slot += slot + 1
        first_phase += len(blocks)


def mix_sources(df: DataFrame, weights: dict | None = None, source: str = "source", doc_id: str = "doc_id", block_rows: int | None = None) -> DataFrame:
    """``df`` with ``_phase``, ``_block`` (of its source), ``_slot`` and ``_position`` (order of
    the mixture, gapless).  ``weights`` maps sources to target weights; by default a source's
    weight is the square root of its rows, which lifts small sources over a hot one."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "mixing")
    clash = {c: f"_in{i}" for i, c in enumerate(df.columns) if c not in ADDED}
    inner = df.select(*(F.col(f"`{c}`").alias(n) for c, n in clash.items()))
    s, d = clash[source], clash[doc_id]
    # Only keys are sorted; other columns wait under a row number and are joined once.
    apart = len(clash) > 2
    if apart:
        inner = scratch.table(inner.withColumn("_row", F.monotonically_increasing_id()), "rows")
    placed = ordered(scratch, inner.select(s, d, "_row") if apart else inner, s, d)
    # One row per part and source: bounded by parts + sources, not by documents.
    held = placed.groupBy(F.col(s).alias("s"), "_part").agg(F.count("*").alias("n"), F.min("_idx").alias("low")).collect()
    rows: dict = {}
    offsets = []
    for r in sorted(held, key=lambda r: r["_part"]):
        offsets.append((r["s"], r["_part"], rows.get(r["s"], 0) - r["low"]))
        rows[r["s"]] = rows.get(r["s"], 0) + r["n"]
    if weights is None:
        weights = {k: Fraction(n**0.5) for k, n in rows.items()}
    if block_rows is None:
        block_rows = max(BLOCK_ROWS, -(-sum(rows.values()) // MOST_BLOCKS))
    number = {k: n for n, k in enumerate(rows)}
    fields = pa.schema([("_n", pa.int32()), ("_cell", pa.int64()), ("_base", pa.int64()), ("_at", pa.list_(pa.int32())), ("_from", pa.int64()), ("_places", pa.list_(pa.int64())), ("_phases", pa.list_(pa.int32()))])
    cells, tables, waiting = [], [], [0]

    def write():
        made = pa.Table.from_pylist(cells, schema=fields)
        tables.append(scratch.table(spark.createDataFrame(made), f"cells{len(tables)}"))
        cells.clear()
        waiting[0] = 0

    def put(k, cell, slots, places, phases):
        cells.append({"_n": number[k], "_cell": cell, "_base": slots[0], "_at": [x - slots[0] for x in slots], "_from": places[0], "_places": [x - places[0] for x in places], "_phases": phases.tolist()})
        waiting[0] += len(slots)
        if waiting[0] >= HELD:
            write()

    schedule(rows, weights, block_rows, put)
    write()
    places = tables[0]
    for more in tables[1:]:
        places = places.unionByName(more)
    offset = spark.createDataFrame([(*o, number[o[0]]) for o in offsets], "s string, _part int, _shift long, _n int")
    ranked = placed.join(F.broadcast(offset), placed[s].eqNullSafe(offset["s"]) & (placed["_part"] == offset["_part"]))
    ranked = ranked.select(s, d, *(["_row"] if apart else []), "_n", (F.col("_idx") + F.col("_shift")).alias("_rank"))
    ranked = ranked.withColumn("_block", F.floor(F.col("_rank") / block_rows)).withColumn("_cell", F.floor(F.col("_block") / CELL))
    out = ranked.join(places, ["_n", "_cell"])
    k = (F.col("_block") % CELL + 1).cast("int")
    added = [F.element_at("_phases", k).alias("_phase"), F.col("_block"), (F.col("_base") + F.element_at("_at", k)).alias("_slot"), (F.col("_from") + F.element_at("_places", k) + F.col("_rank") % block_rows).alias("_position")]
    if apart:
        out = inner.join(out.select("_row", *added), "_row")
        added = ADDED
    return out.select(*(F.col(n).alias(c) for c, n in clash.items()), *added)


def op5_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix_sources(docs.select("doc_id", "source"))
    return out.select("doc_id", "source", F.col("_phase").alias("phase"), F.col("_block").cast("long").alias("block"), F.col("_slot").cast("long").alias("slot"), F.col("_position").cast("long").alias("position"))
