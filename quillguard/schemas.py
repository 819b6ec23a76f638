"""Explicit types of spans and results, and views that hide sensitive text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<text:string,entity_type:string,start:int,end:int,score:double,token:string,source:string>"
SPANS = f"array<{SPAN}>"
LABELLED = "tokens array<string>, ner_tags array<int>, ner_tag_labels array<string>"
MASK = "***"


def span(text: Column, kind: Column, start: Column, end: Column, score: Column, source: Column, token: Column | None = None) -> Column:
    token = F.lit("") if token is None else token
    return F.struct(text.alias("text"), kind.alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), score.cast("double").alias("score"), token.alias("token"), source.alias("source"))


def safe_entities(entities: Column) -> Column:
    """Spans with their text hidden."""
    return F.transform(entities, lambda e: e.withField("text", F.lit(MASK)))


def safe_mapping(mapping: Column) -> Column:
    return F.transform_values(mapping, lambda k, v: F.lit(MASK))


def describe(e: Column) -> Column:
    """One span for logs: type, offsets, score; never its text."""
    return F.format_string("[%s:%s (%d:%d) score=%.2f]", e["entity_type"], F.lit(MASK), e["start"], e["end"], e["score"])
