"""Running values over arrays and cuts of long texts, without an array or text copied at each step.

Spark has no scan over an array, and a fold that appends to an array copies it each time.  Here
an array is cut into runs of ``RUN``; the runs' totals are scanned in the same way, and inside
a run each element adds up at most ``RUN`` others, so the work grows with the array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN, LEVELS = 32, 2
#: Characters that a cut walks over at most to find its start.
BLOCK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _totals(values: Column, first: Column, add: Callable[[Column, Column], Column], levels: int) -> Column:
    def within(run: Column, start: Column) -> Column:
        return F.transform(run, lambda x, i: F.aggregate(F.slice(run, F.lit(1), i), start, add))

    if not levels:
        return within(values, first)

    def scanned(runs: Column) -> Column:
        sums = F.transform(runs, lambda run: F.aggregate(F.slice(run, F.lit(2), F.lit(RUN)), run[0], add))
        return F.flatten(F.zip_with(runs, let(sums, lambda s: _totals(s, first, add, levels - 1)), within))

    n = F.size(values)
    runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), lambda k: F.slice(values, k * RUN + 1, F.lit(RUN)))
    return F.when(n <= RUN, within(values, first)).otherwise(let(runs, scanned))


def running(values: Column, first: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each element ``first`` and all elements before it added up."""
    return let(values, lambda v: _totals(v, first, add, LEVELS))


def running_sum(values: Column) -> Column:
    return running(values, F.lit(0), lambda a, x: a + x)


def running_max(values: Column) -> Column:
    return running(values, F.lit(-1), lambda a, x: F.greatest(a, x))


def pieces(text: Column, places: Column, make: Callable[[Column, Column], Column]) -> Column:
    """``make(place, part)`` for each of ``places`` (structs with ``start`` and ``end``), where
    ``part`` is the text between them.  A long text is cut into blocks first, as each cut walks
    from where its text begins."""

    def of(blocks: Column) -> Column:
        def one(p: Column) -> Column:
            first, last = F.floor(p["start"] / BLOCK).cast("int"), F.floor(p["end"] / BLOCK).cast("int")
            held = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
            return make(p, F.substring(held, p["start"] - first * BLOCK + 1, p["end"] - p["start"]))

        return F.transform(places, one)

    # Two steps of cutting, so that no text is walked from its beginning for every block.
    wide = BLOCK * 64
    n = F.length(text)
    count = lambda size, of: F.sequence(F.lit(0), F.floor(F.greatest(of - 1, F.lit(0)) / size).cast("int"))
    cut = lambda part, size: F.transform(count(size, F.length(part)), lambda k: F.substring(part, (k * size + 1).cast("int"), F.lit(size)))
    blocks = F.flatten(F.transform(cut(text, wide), lambda part: cut(part, BLOCK)))
    short = F.transform(places, lambda p: make(p, F.substring(text, p["start"] + 1, p["end"] - p["start"])))
    return F.when(n <= BLOCK, short).otherwise(let(blocks, of))
