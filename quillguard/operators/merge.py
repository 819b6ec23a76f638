"""Overlap rules and the merge of spans into a disjoint, ordered array.

Candidates come by ascending start, longer first, and accepted spans are disjoint, so a
candidate can only meet the one accepted last.  Where a candidate begins at or after the ends of
all before it a new cluster begins, and each cluster is merged by a fold of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running_max
from ..functions.patterns import STRUCTURED
from ..schemas import SPANS


#: Spans of a text for which a plain pass is cheaper than one made for any number.
FEW = 64


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def classify_overlap(a: Column, b: Column) -> Column:
    exact = (a["start"] == b["start"]) & (a["end"] == b["end"])
    nested = ((a["start"] <= b["start"]) & (a["end"] >= b["end"])) | ((b["start"] <= a["start"]) & (b["end"] >= a["end"]))
    return F.when(~overlaps(a, b), "none").when(exact, "exact").when(nested, "nested").otherwise("partial")


def candidate_wins(accepted: Column, candidate: Column) -> Column:
    """Whether a candidate replaces the accepted span it overlaps."""
    firm = lambda s: (s["source"] == "regex") & s["entity_type"].isin(*STRUCTURED)
    exact = (accepted["start"] == candidate["start"]) & (accepted["end"] == candidate["end"])
    by_kind = F.when(firm(accepted), False).when(firm(candidate), True).otherwise(candidate["score"] > accepted["score"])
    longer = candidate["end"] - candidate["start"] > accepted["end"] - accepted["start"]
    return F.when(exact, by_kind).otherwise(longer)


def merge(model: Column, regex: Column) -> Column:
    """Disjoint spans by start; model spans come before pattern spans among equals."""
    keyed = F.transform(F.concat(model, regex), lambda s, i: F.struct(s["start"].alias("a"), (s["start"] - s["end"]).alias("b"), i.alias("i"), s.alias("s")))

    def step(acc: Column, z: Column) -> Column:
        last, c = F.element_at(acc, -1), z["s"]
        return F.when((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["end"] <= c["start"]), F.array_append(acc, c)).when(
            candidate_wins(last, c), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), c)
        ).otherwise(acc)

    fold = lambda part: F.aggregate(part, F.array().cast(SPANS), step)

    def clusters(z: Column) -> Column:
        before = running_max(F.transform(z, lambda c: c["s"]["end"]))
        opens = F.filter(F.zip_with(F.transform(z, lambda c, i: F.struct(i.alias("i"), c["a"].alias("a"))), before, lambda c, end: F.when(c["a"] >= end, c["i"])), lambda i: i.isNotNull())
        cut = lambda of: F.transform(of, lambda i, k: F.slice(z, i + 1, F.coalesce(F.get(of, k + 1), F.size(z)) - i))
        return F.flatten(F.transform(let(opens, cut), fold))

    return let(F.array_sort(keyed), lambda z: F.when(F.size(z) <= FEW, fold(z)).otherwise(clusters(z)))


def merge_if_found(model: Column, regex: Column) -> Column:
    """Model spans as they are where patterns found nothing, else the merge."""
    return F.when(F.size(regex) == 0, model).otherwise(merge(model, regex))


def overlap_pairs(spans: DataFrame, key: str = "id") -> DataFrame:
    """Overlapping pairs of exploded spans of one document, with the kind of overlap.

    An equi-join on the document with a range condition, never a bare range join."""
    a, b = spans.alias("a"), spans.alias("b")
    both = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.ord") < F.col("b.ord")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")))
    side = lambda n: {c: F.col(f"{n}.{c}") for c in ("start", "end")}
    return both.select(F.col(f"a.{key}").alias(key), F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"), classify_overlap(side("a"), side("b")).alias("overlap"))
