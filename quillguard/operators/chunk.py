"""Sentence-aware chunks with one sentence of overlap.

Boundaries are the start, every place after ``.``, ``;`` or a line feed, and the end.  A
chunk takes sentences while it fits the size; one over-long sentence stays whole; the next
chunk starts with this one's last sentence.  One fold over the boundaries does it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import let, pieces, running_sum

CHUNKS = "array<struct<chunk:string,offset:int>>"
_RANGES = "array<struct<s:int,e:int>>"


def boundaries(text: Column) -> Column:
    """Ends of sentences as offsets, the text's length last."""
    sentences = F.filter(F.split(text, r"(?<=[.;\n])", -1), lambda p: p != "")
    return let(F.transform(sentences, lambda p: F.length(p)), lambda n: F.zip_with(running_sum(n), n, lambda at, k: at + k))


def _ranges(bounds: Column, size: int) -> Column:
    """Fold state: chunk start, start of its last sentence, its end, its sentences, output."""
    state = lambda cs, pv, lb, k, out: F.struct(cs.alias("cs"), pv.alias("pv"), lb.alias("lb"), k.alias("k"), out.alias("out"))

    def closed(a: Column) -> Column:
        out = F.array_append(a["out"], F.struct(a["cs"].alias("s"), a["lb"].alias("e")))
        more = a["k"] > 1
        return state(F.when(more, a["pv"]).otherwise(a["lb"]), F.when(more, a["pv"]).otherwise(a["lb"]), a["lb"], F.when(more, F.lit(1)).otherwise(F.lit(0)), out)

    bound = lambda value, body: F.transform(F.array(value), body)[0]

    def step(acc: Column, x: Column) -> Column:
        again = lambda a: F.when((a["k"] > 0) & (x - a["cs"] > size), closed(a)).otherwise(a)
        taken = lambda a: state(a["cs"], F.when(a["k"] == 0, a["cs"]).otherwise(a["lb"]), x, a["k"] + 1, a["out"])
        return bound(bound(again(acc), again), taken)

    def finish(acc: Column) -> Column:
        last = lambda a: F.when(a["k"] > 0, closed(a)).otherwise(a)
        return bound(bound(acc, last), last)["out"]

    start = state(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.array().cast(_RANGES))
    return F.aggregate(bounds, start, step, finish)


def chunks(text: Column, size: int = 1500) -> Column:
    """Array of (chunk, offset)."""
    ranges = F.transform(_ranges(boundaries(text), size), lambda r: F.struct(r["s"].alias("start"), r["e"].alias("end")))
    made = pieces(text, ranges, lambda r, part: F.struct(part.alias("chunk"), r["start"].alias("offset")))
    whole = F.array(F.struct(text.alias("chunk"), F.lit(0).alias("offset")))
    return F.when(F.length(text) <= size, whole).otherwise(made).cast(CHUNKS)
