"""Spans of an entity model: a table of hits, or a callable run over chunks in batches.

No weights ship with this engine.  A provider is any function from a list of texts to a list
of hit lists; it is loaded once per Python worker, and a missing one fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from inspect import signature

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..schemas import SPANS, span
from .chunk import chunks
from .merge import merge

#: Model labels and the clinical model's labels.
MODEL_LABELS = {"PER": "PERSON", "LOC": "LOCATION", "ORG": "ORGANIZATION", "MISC": "MISC"}
CLINICAL_ADAPTER = {"PATIENT": "PER", "HCW": "PER", "HOSPITAL": "ORG", "VENDOR": "ORG", "DATE": "MISC", "ID": "MISC", "PHONE": "MISC"}


def mapped(label: Column, table) -> Column:
    """A lookup that passes unknown labels through."""
    if not table:
        return label
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*flat), label), label)


def mapped_hits(hits: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Hits at or over the confidence threshold, with ``entity_type``."""
    kind = mapped(mapped(F.col("entity_group"), config.label_adapter), MODEL_LABELS)
    return hits.where(F.col("score") >= config.model_threshold).withColumn("entity_type", kind)


def hits_to_spans(hits: DataFrame, config: EngineConfig, key: str, order: str) -> DataFrame:
    """(key, word, entity_group, score, start, end) rows -> one array of spans per key."""
    kept = mapped_hits(hits, config)
    one = span(F.col("word"), F.col("entity_type"), F.col("start"), F.col("end"), F.col("score"), F.lit("bert"))
    found = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("s")))).alias("found"))
    return found.select(key, F.transform("found", lambda z: z["s"]).alias("spans"))


def needs_adapter(labels: Column) -> Column:
    """Whether no label but O has a B- or I- prefix (and there is one)."""
    named = F.filter(labels, lambda v: v != "O")
    return (F.size(named) > 0) & ~F.exists(named, lambda v: v.startswith("B-") | v.startswith("I-"))


_HITS = "id long, n long, offset int, word string, entity_group string, score double, start int, end int"


def detect_with_model(df: DataFrame, load: Callable[..., Callable[[list[str]], list[list[dict]]]], key: str = "id", text: str = "text", config: EngineConfig = EngineConfig()) -> DataFrame:
    """(key, spans): chunks of each text through the provider, offsets moved back, hits of
    overlapping chunks merged.  ``load`` gives the provider; it takes nothing or the configuration."""
    given = (config,) if signature(load).parameters else ()
    parts = df.select(F.col(key).cast("long").alias("id"), F.posexplode(chunks(F.coalesce(text, F.lit("")), config.chunk_size)).alias("n", "c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = load(*given)
        if provider is None:
            raise RuntimeError("no entity model is loaded")
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for row, hits in zip(rows, provider([r["chunk"] for r in rows])):
                out += [{"id": row["id"], "n": (row["n"] << 32) + k, "offset": row["offset"], **h} for k, h in enumerate(hits)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("id", pa.int64()), ("n", pa.int64()), ("offset", pa.int32()), ("word", pa.string()), ("entity_group", pa.string()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    hits = parts.select("id", "n", "c.chunk", "c.offset").mapInArrow(run, _HITS)
    hits = hits.withColumn("start", F.col("start") + F.col("offset")).withColumn("end", F.col("end") + F.col("offset"))
    spans = hits_to_spans(hits, config, "id", "n")
    several = F.size("spans") > 1
    return spans.select(F.col("id").alias(key), F.when(several, merge(F.col("spans"), F.array().cast(SPANS))).otherwise(F.col("spans")).alias("spans"))
