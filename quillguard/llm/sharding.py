"""Contiguous shards of least possible largest size.

Groups (equal texts) are atomic and ordered by their smallest doc_id.  The smallest feasible
capacity is found by binary search; a capacity is feasible if cutting greedily (as late as it
allows) needs no more than the given number of shards.

The ordered sizes stay distributed.  The driver only sees exact boundaries of the running
total, at first one pair per coarse cell, and how many boundaries lie hidden between known
neighbours.  Cutting at known boundaries only gives a capacity that is feasible for certain;
cutting anywhere inside a gap with hidden boundaries gives one below which nothing is
feasible.  While the two differ, the gaps that a cut can fall into are refined, so a few
aggregations of one numeric table decide exactly, with at most ``CELLS`` rows each.

Greedy cuts fill the first shards and can leave the last ones empty.  So the cuts are then
spread under the capacity found, among the boundaries known by then: each goes where it comes
nearest to an equal share of what is left, as far as what follows still fits, and every shard
gets a group while there are groups left.

Defined results: a null text counts as empty (size 1, CRC 0, one group with empty texts);
repeated rows have the same text and stay in one shard; null doc_ids come first in the order;
other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, least_of_group, ordered

CELLS = 4096


class _Known:
    """Exact boundaries found so far and where unknown ones may hide.

    ``hidden[q]`` bounds the number of unknown boundaries between the known boundary before
    ``q`` and ``q`` itself.
    """

    def __init__(self, total: int, shards: int):
        self.total, self.shards = total, shards
        self.at, self.hidden = [0, total], {total: 1}

    def sure(self, x: int) -> int:
        return self.at[bisect_right(self.at, x) - 1]

    def hopeful(self, x: int) -> int:
        i = bisect_right(self.at, x) - 1
        return x if i + 1 < len(self.at) and self.hidden.get(self.at[i + 1]) else self.at[i]

    def path(self, capacity: int, nearest) -> list[int]:
        """The greedy cuts of each shard; they stop at the total if the capacity suffices."""
        cuts, at = [], 0
        for _ in range(self.shards):
            at = nearest(min(at + capacity, self.total))
            cuts.append(at)
        return cuts

    def smallest(self, nearest, low: int, high: int) -> int:
        while low < high:
            mid = (low + high) // 2
            if self.path(mid, nearest)[-1] == self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def spread(self, capacity: int) -> list[int]:
        """Cuts at known boundaries, no part over ``capacity``, as near to equal parts as comes."""
        ends = self.at[1:]
        # The earliest place of each cut from which the rest still fits, last cut first.
        least = [self.total]
        for _ in range(self.shards - 1):
            least.append(ends[bisect_left(ends, least[-1] - capacity)] if least[-1] > capacity else 0)
        cuts, at, taken = [], 0, 0
        for left in range(self.shards, 0, -1):
            if taken == len(ends):
                cuts.append(at)
                continue
            low = max(taken, bisect_left(ends, least[left - 1]))
            high = min(bisect_right(ends, at + capacity) - 1, max(len(ends) - left, taken))
            want = at + (self.total - at) / left
            near = min(max(bisect_left(ends, want), low), high)
            if near > low and want - ends[near - 1] <= ends[near] - want:
                near -= 1
            cuts.append(ends[near])
            at, taken = ends[near], near + 1
        return cuts

    def open_ranges(self, low: int, high: int) -> tuple[list[tuple[int, int]], int]:
        """Ranges with hidden boundaries that a cut can reach with a capacity between
        ``low`` and ``high``, and a bound on the boundaries in them."""
        gaps: set[int] = set()
        for a, b in zip(self.path(low, self.sure), self.path(high, self.hopeful)):
            for k in range(bisect_right(self.at, a), min(bisect_right(self.at, b) + 1, len(self.at))):
                if self.hidden.get(self.at[k]) and self.at[k - 1] < b:
                    gaps.add(k)
        ranges: list[tuple[int, int]] = []
        for k in sorted(gaps):
            if ranges and ranges[-1][1] == self.at[k - 1]:
                ranges[-1] = (ranges[-1][0], self.at[k])
            else:
                ranges.append((self.at[k - 1], self.at[k]))
        while len(ranges) > 64:  # few and wide ranges keep the filter small
            n = min(range(1, len(ranges)), key=lambda i: ranges[i][0] - ranges[i - 1][1])
            ranges[n - 1 : n + 1] = [(ranges[n - 1][0], ranges[n][1])]
        return ranges, sum(self.hidden[self.at[k]] for k in gaps)

    def learn(self, ranges: list[tuple[int, int]], cells: list[tuple[int, int, int]]) -> None:
        self.at = sorted({*self.at, *(x for first, last, _ in cells for x in (first, last))})
        for lo, hi in ranges:
            for k in range(bisect_right(self.at, lo), bisect_right(self.at, hi)):
                self.hidden[self.at[k]] = 0
        for first, last, count in cells:
            if count > 2:
                for k in range(bisect_right(self.at, first), bisect_right(self.at, last)):
                    self.hidden[self.at[k]] = count - 2


def minimax_cuts(boundaries: DataFrame, end: str, total: int, shards: int) -> tuple[int, list[int]]:
    """(capacity, cuts): the least capacity for which greedy cutting at the values of
    ``end`` (running totals of atomic groups, the last being ``total``) gives at most
    ``shards`` parts, and cuts spread under it; cuts past the last row repeat the total."""
    if not total:
        return 0, []
    known = _Known(total, shards)
    ranges, cells = [(0, total)], CELLS
    least, before = -(-total // shards), None
    while True:
        each = max(2, cells // len(ranges))
        within = [(F.col(end) > lo) & (F.col(end) < hi) for lo, hi in ranges]
        rows = boundaries.where(reduce(or_, within))
        if before is not None and before <= 4 * CELLS:  # few enough to know them all
            found = [(r[0], r[0], 1) for r in rows.select(end).distinct().collect()]
        else:
            cell = F.coalesce(*(F.when(w, F.lit(n * (each + 1)) + F.floor((F.col(end) - lo) / max(1, -(-(hi - lo) // each)))) for n, (w, (lo, hi)) in enumerate(zip(within, ranges))))
            found = [(r[1], r[2], r[3]) for r in rows.groupBy(cell.alias("cell")).agg(F.min(end), F.max(end), F.countDistinct(end)).collect()]
        known.learn(ranges, found)
        high = known.smallest(known.sure, least, total)
        low = known.smallest(known.hopeful, least, high)
        ranges, left = known.open_ranges(low, high)
        if not ranges:
            return high, known.spread(high)
        cells = cells * 2 if before is not None and left >= before else CELLS
        before = left


def shard_by_bytes(df: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot."""
    scratch = Scratch(df.sparkSession, "shards")
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.sha2(body, 256).alias("group"))
    rows = scratch.table(rows, "rows")
    # The order of rows: by group, groups by smallest id; ids spread a large group over parts.
    named = least_of_group(rows, ["group"], "doc_id", "first").drop("first_rows")
    placed = ordered(scratch, named, "first", "group", "doc_id")
    parts = placed.groupBy("_part").agg(F.count("*").alias("n"), F.sum("size").alias("s")).orderBy("_part").collect()
    n = s = 0
    offsets = []
    for part, rows_in, size_in in parts:
        offsets.append((part, n, s))
        n, s = n + rows_in, s + size_in
    at = df.sparkSession.createDataFrame(offsets, "_part int, _n long, _s long")
    within = Window.partitionBy("_part").orderBy("_idx")
    running = placed.join(F.broadcast(at), "_part")  # one row per part
    running = running.select("doc_id", "size", "text_crc32", "group", (F.col("_n") + F.col("_idx")).alias("index"), (F.col("_s") + F.sum("size").over(within)).alias("end"))
    running = scratch.table(running, "running")
    groups = scratch.table(running.groupBy("group").agg(F.max("end").alias("end"), (F.max("index") + 1).alias("rows")).drop("group"), "groups")
    _, cuts = minimax_cuts(groups, "end", s, shards)
    cuts = sorted(set(cuts))
    counted = {r["end"]: r["rows"] for r in groups.where(F.col("end").isin(cuts)).collect()} if cuts else {}
    shard, base = F.lit(0), F.lit(0)
    for k, cut in enumerate(cuts[:-1]):
        shard = F.when(F.col("end") > cut, F.lit(k + 1)).otherwise(shard)
        base = F.when(F.col("end") > cut, F.lit(counted[cut])).otherwise(base)
    return running.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("index") - base).cast("long").alias("slot"))


def op4_minimax_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_by_bytes(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
