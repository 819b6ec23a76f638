"""Entity-level scores, latency percentiles, logit parity and gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir
from .bio import decode_tags, keep_types


def entity_counts(df: DataFrame, truth: str, predicted: str, key: str = "id") -> DataFrame:
    """Per type: tp, fp, fn from two columns of word tags.

    Entities of both sides are marked and exploded together, so the labels are computed once
    and one partial aggregation takes the place of a full outer join."""
    marked = lambda c, t, p: F.transform(decode_tags(F.col(c)), lambda e: F.struct(e["type"].alias("type"), e["first"].alias("first"), e["last"].alias("last"), F.lit(t).alias("t"), F.lit(p).alias("p")))
    both = df.select(key, F.explode_outer(F.concat(marked(truth, 1, 0), marked(predicted, 0, 1))).alias("e")).where("e IS NOT NULL")
    found = both.groupBy(key, "e.type", "e.first", "e.last").agg(F.max("e.t").alias("t"), F.max("e.p").alias("p"))
    return found.groupBy("type").agg(F.count_if(F.col("t") + F.col("p") == 2).alias("tp"), F.count_if(F.col("t") == 0).alias("fp"), F.count_if(F.col("p") == 0).alias("fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _scores(name: Column, tp: Column, fp: Column, fn: Column) -> Column:
    return F.struct(name.alias("type"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def report(counts: DataFrame) -> DataFrame:
    """Per type, then micro, macro and weighted: precision, recall, f1, support.

    One row per type comes in, so the few rows are gathered once and averaged in place."""
    rows = counts.agg(F.collect_list(F.struct("type", "tp", "fp", "fn")).alias("c"))
    rows = rows.withColumn("per", F.transform("c", lambda c: _scores(c["type"], c["tp"], c["fp"], c["fn"])))
    total = lambda of, value: F.aggregate(of, F.lit(0.0), lambda a, x: a + value(x))
    whole = lambda n: total("c", lambda c: c[n].cast("double")).cast("long")
    support, n = total("per", lambda p: p["support"].cast("double")), F.size("per")
    names = ("precision", "recall", "f1")
    micro = _scores(F.lit("micro avg"), whole("tp"), whole("fp"), whole("fn"))
    macro = F.struct(F.lit("macro avg").alias("type"), *((total("per", lambda p, m=m: p[m]) / n).alias(m) for m in names), support.cast("long").alias("support"))
    weighted = F.struct(F.lit("weighted avg").alias("type"), *(_ratio(total("per", lambda p, m=m: p[m] * p["support"]), support).alias(m) for m in names), support.cast("long").alias("support"))
    return rows.select(F.explode_outer(F.concat("per", F.array(micro, macro, weighted))).alias("r")).select("r.*")


def macro_scores(counts: DataFrame) -> DataFrame:
    return report(counts).where("type = 'macro avg'").select(F.col("f1").alias("macro_f1"), F.col("precision").alias("macro_precision"), F.col("recall").alias("macro_recall"))


def percentiles(df: DataFrame, value: str, shares: tuple[float, ...]) -> list[float | None]:
    """Exact percentiles with linear interpolation of the values that are not null.

    Equal values are counted first, so a common value is one row; distinct values are dealt
    into ranges and counted by range, and only the ranges that hold a wanted rank are scanned
    for it.  No task sees all values; the driver sees a row per range and two a percentile."""
    spark = df.sparkSession
    counted = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    path = scratch_dir(spark, "percentiles")
    counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.schema("v double, n long, part int").parquet(path)
    before, starts = 0, []
    for part, n, _ in placed.groupBy("part").agg(F.sum("n"), F.min("v").alias("low")).orderBy("low").collect():
        starts.append((part, before, before + n))
        before += n
    if not before:
        return [None] * len(shares)
    wanted = [share * (before - 1) for share in shares]
    ranks = sorted({r for w in wanted for r in (math.floor(w), math.ceil(w))})
    asked = [(part, rank - low) for part, low, high in starts for rank in ranks if low <= rank < high]
    asked_df = F.broadcast(spark.createDataFrame(asked, "part int, rank long"))
    within = placed.where(F.col("part").isin(*{p for p, _ in asked})).withColumn("until", F.sum("n").over(Window.partitionBy("part").orderBy("v")))
    found = within.join(asked_df, "part").where("until > rank AND until - n <= rank").select("part", "rank", "v").collect()
    by = {(r["part"], r["rank"]): r["v"] for r in found}
    at = {rank: by[p, rank - low] for p, low, high in starts for rank in ranks if low <= rank < high}
    return [at[math.floor(w)] + (at[math.ceil(w)] - at[math.floor(w)]) * (w - math.floor(w)) for w in wanted]


def latency(df: DataFrame, value: str) -> DataFrame:
    """Exact percentiles with linear interpolation, mean and maximum, two decimals."""
    q = percentiles(df, value, (0.5, 0.95, 0.99))
    found = df.agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
    return found.select(*(F.round(F.lit(x).cast("double"), 2).alias(f"p{p}_ms") for x, p in zip(q, (50, 95, 99))), F.round("mean", 2).alias("mean_ms"), F.round("max", 2).alias("max_ms"))


def evaluate(df: DataFrame, truth: str, predicted: str, types: tuple[str, ...], key: str = "id") -> DataFrame:
    """One evaluation run: predicted tags of other types than ``types`` become O, then the
    report by type with micro, macro and weighted averages, and the number of samples.

    Samples without any entity count too; a run of the model over warm-up samples belongs to
    its provider."""
    kept = df.select(key, truth, keep_types(F.col(predicted), types).alias(predicted))
    samples = df.agg(F.count("*").alias("n_samples"))
    return report(entity_counts(kept, truth, predicted, key)).join(F.broadcast(samples))  # one row


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """(le, n): values at or under each bound, as a cumulative histogram has them, the last row
    without a bound; one pass with partial counts."""
    at_most = [F.count_if(F.col(value) <= b) for b in bounds] + [F.count(value)]
    rows = df.agg(*(c.alias(f"n{i}") for i, c in enumerate(at_most)))
    return rows.select(F.explode(F.array(*(F.struct(F.lit(b).cast("double").alias("le"), F.col(f"n{i}").alias("n")) for i, b in enumerate((*bounds, None))))).alias("h")).select("h.*")


def logit_parity(df: DataFrame, a: str, b: str) -> DataFrame:
    """Largest and mean over samples of each sample's largest absolute difference."""
    delta = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return df.select(delta.alias("d")).agg(F.max("d").alias("max_delta"), F.avg("d").alias("mean_delta"))


def gates(max_delta: Column, size_mb: Column, slow_ms: Column, fast_ms: Column) -> list[Column]:
    return [(max_delta < 1e-4).alias("parity_ok"), (size_mb <= 300).alias("size_ok"), F.when(fast_ms > 0, slow_ms / fast_ms).alias("speed_up")]


def argmax_labels(logits: Column, labels: Column) -> Column:
    """(predicted, label) pairs of positions whose label is not -100."""
    pairs = F.zip_with(logits, labels, lambda x, y: F.struct((F.array_position(x, F.array_max(x)) - 1).cast("int").alias("predicted"), y.alias("label")))
    return F.filter(pairs, lambda p: p["label"] != -100)
