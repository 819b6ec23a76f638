"""Numbered tokens in place of spans, the mapping back, and restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.arrays import let, pieces
from ..functions.spans import detect_all
from ..schemas import SPANS
from .merge import FEW, merge_if_found

_ENTRIES = "array<struct<token:string,original:string>>"


def without_disabled(entities: Column, disabled: Column | list[str] | None) -> Column:
    """Drops spans of disabled types; it belongs after the merge, so a disabled span still
    beats what it overlaps."""
    if disabled is None or isinstance(disabled, list) and not disabled:
        return entities
    kinds = F.array(*map(F.lit, disabled)) if isinstance(disabled, list) else F.coalesce(disabled, F.array().cast("array<string>"))
    return F.filter(entities, lambda e: ~F.coalesce(F.array_contains(kinds, e["entity_type"]), F.lit(False)))


def numbered(entities: Column) -> Column:
    """Tokens [TYPE_N]; within a type N counts from the end of the text."""
    token = lambda e, n: e.withField("token", F.concat(F.lit("["), e["entity_type"], F.lit("_"), n.cast("string"), F.lit("]")))

    def any_order(es: Column) -> Column:
        return F.transform(es, lambda e: token(e, F.size(F.filter(es, lambda x: (x["entity_type"] == e["entity_type"]) & (x["start"] >= e["start"])))))

    def by_type(es: Column) -> Column:
        """One pass a type; merged spans come in order of distinct starts."""
        kinds = F.array_distinct(F.transform(es, lambda e: e["entity_type"]))
        keyed = F.transform(es, lambda e, i: F.struct(i.alias("i"), e.alias("e")))
        of = lambda kind: let(F.filter(keyed, lambda z: z["e"]["entity_type"] == kind), lambda zs: F.transform(zs, lambda z, k: F.struct(z["i"].alias("i"), token(z["e"], F.size(zs) - k).alias("e"))))
        return F.transform(F.array_sort(F.flatten(F.transform(kinds, of))), lambda z: z["e"])

    def chosen(es: Column) -> Column:
        starts = F.transform(es, lambda e: e["start"])
        ordered = let(starts, lambda s: (F.array_sort(s) == s) & (F.size(F.array_distinct(s)) == F.size(s)))
        return F.when((F.size(es) > FEW) & ordered, by_type(es)).otherwise(any_order(es))

    return let(entities, chosen)


def masked(text: Column, entities: Column) -> Column:
    """The text with each span replaced by its token: gaps and tokens joined once."""

    def joined(es: Column) -> Column:
        gap = lambda e, i: F.struct(F.coalesce(F.get(es, i - 1)["end"], F.lit(0)).alias("start"), e["start"].alias("end"), e["token"].alias("token"))
        last = F.struct(F.coalesce(F.try_element_at(es, F.lit(-1))["end"], F.lit(0)).alias("start"), F.length(text).alias("end"), F.lit("").alias("token"))
        return F.array_join(pieces(text, F.concat(F.transform(es, gap), F.array(last)), lambda p, part: F.concat(part, p["token"])), "")

    return F.when(F.size(entities) == 0, text).otherwise(let(entities, joined))


def entries(entities: Column) -> Column:
    """(token, original) in the order in which tokens are given: from the end of the text."""
    return F.reverse(F.transform(entities, lambda e: F.struct(e["token"].alias("token"), e["text"].alias("original")))).cast(_ENTRIES)


def mapping(entities: Column) -> Column:
    return F.map_from_entries(entries(entities))


def restore(masked_text: Column, pairs: Column) -> Column:
    """Every occurrence of each token replaced, in the order of the pairs."""
    return F.aggregate(pairs, masked_text, lambda acc, e: F.replace(acc, e["token"], e["original"]))


def session_id() -> Column:
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def detect_entities(df: DataFrame, text: str = "text", model: str | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``df`` with ``entities``: pattern spans merged with the model spans in column
    ``model`` (array of spans), if any.  One narrow projection, no shuffle."""
    regex = detect_all(F.col(text), config.detectors) if config.enable_patterns else F.array().cast(SPANS)
    given = F.coalesce(F.col(model), F.array().cast(SPANS)) if model else F.array().cast(SPANS)
    out = df.withColumn("_regex", regex).withColumn("_model", given)
    return out.withColumn("entities", merge_if_found(F.col("_model"), F.col("_regex"))).drop("_regex", "_model")


def redact(df: DataFrame, text: str = "text", disabled: Column | list[str] | None = None, model: str | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``df`` with ``entities`` (token set), ``masked_text`` and ``mapping``."""
    out = detect_entities(df, text, model, config)
    out = out.withColumn("entities", without_disabled(F.col("entities"), disabled))
    out = out.withColumn("entities", numbered(F.col("entities")))
    whole = F.coalesce(F.col(text), F.lit(""))
    return out.withColumn("masked_text", masked(whole, F.col("entities"))).withColumn("mapping", mapping(F.col("entities")))
