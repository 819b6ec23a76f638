"""Multi-party perspective rotation of conversations, DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as
``assistant`` and all others as named users; the loss mask covers what the perspective's
speaker says, closing marker included.  Roles in ``CONTEXT`` are rendered as themselves and
are nobody's perspective.

A conversation may hold any share of all rows: turns are ranked, and the lengths of chunks
summed, over sorted parts (never one window or list over a whole conversation; texts and masks
pass through no window) and the output has one row per conversation,
perspective and run of ``CHUNK_TURNS`` turns.  Chunk texts in order of ``chunk`` concatenate
to the whole dialogue; ``start_offset`` says where a chunk starts in it.

Defined results: a null text is empty; a null role is the speaker ``unknown``; turns are
ordered by turn (null first), then speaker and text, so repeated rows and ties are rendered
each, in a fixed order; rows with a null conv_id form one conversation; a conversation
without participants gives no row.  ``<|`` in texts and names becomes ``< |``, so no text
can forge a marker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ordered

CONTEXT = ("system",)
CHUNK_TURNS = 128


def rotate_perspectives(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """conv_id, perspective, chunk, n_turns, start_offset, text, mask (array of [start, end)
    code point offsets into ``text``)."""
    scratch = Scratch(df.sparkSession, "perspectives")
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    turns = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), safe(F.coalesce(role, F.lit("unknown"))).alias("speaker"), safe(F.coalesce(text, F.lit(""))).alias("said"))
    placed = ordered(scratch, turns, "conv", "turn", "speaker", "said")
    held = placed.groupBy("conv", "_part").agg(F.min("_idx").alias("low"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.select(F.col("conv").alias("c"), F.col("_part").alias("p"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    ranked = placed.join(shift, placed["conv"].eqNullSafe(shift["c"]) & (placed["_part"] == shift["p"]))
    ranked = ranked.withColumn("rank", F.col("_idx") + F.col("shift")).select("conv", "speaker", "said", "rank", F.floor(F.col("rank") / chunk_turns).alias("chunk"))

    people = placed.where(~F.col("speaker").isin(*CONTEXT)).select(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = ranked.join(people, ranked["conv"].eqNullSafe(people["c"])).drop("c")
    own = F.col("speaker") == F.col("perspective")
    who = F.when(own, F.lit("assistant")).when(F.col("speaker").isin(*CONTEXT), F.col("speaker")).otherwise(F.concat(F.lit("user name="), "speaker"))
    head = F.concat(F.lit("<|im_start|>"), who, F.lit("\n"))
    body = F.concat(F.col("said"), F.lit("<|im_end|>"))
    seen = seen.select("conv", "perspective", "chunk", F.struct("rank", head.alias("head"), body.alias("body"), own.alias("own")).alias("t"))

    # Offsets from lengths alone; they come to the chunks as one more row of each group.
    said = ranked.groupBy("conv", "chunk", "speaker").agg(F.count("*").alias("n"), F.sum(F.length("said")).alias("w"))
    sizes = said.join(people, said["conv"].eqNullSafe(people["c"])).groupBy("conv", "perspective", "chunk")
    sizes = sizes.agg(F.sum(F.col("n") * (F.length(head) + F.length(F.lit("<|im_end|>\n"))) + F.col("w")).alias("size"))
    sized = ordered(scratch, sizes, "conv", "perspective", "chunk")
    whole = sized.groupBy("conv", "perspective", "_part").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("conv", "perspective").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = whole.select(F.col("conv").alias("c"), F.col("perspective").alias("q"), F.col("_part").alias("p"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("_part", "conv", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    sized = sized.join(shift, sized["conv"].eqNullSafe(shift["c"]) & (sized["perspective"] == shift["q"]) & (sized["_part"] == shift["p"]))
    offsets = sized.select("conv", "perspective", "chunk", (F.col("inside") + F.col("shift")).alias("offset"))
    seen = seen.withColumn("offset", F.lit(None).cast("long")).unionByName(offsets, allowMissingColumns=True)
    chunks = seen.groupBy("conv", "perspective", "chunk").agg(F.sort_array(F.collect_list("t")).alias("ts"), F.max("offset").alias("offset"))
    line = lambda t: F.concat(t["head"], t["body"], F.lit("\n"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("mask"))

    def step(acc, t):
        opens = acc["at"] + F.length(t["head"])
        closes = opens + F.length(t["body"])
        span = F.array(F.struct(opens.cast("long").alias("start"), closes.cast("long").alias("end")))
        return F.struct((closes + 1).cast("long").alias("at"), F.when(t["own"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    chunks = chunks.select("conv", "perspective", "chunk", "offset", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.transform("ts", line), "").alias("text"), F.aggregate("ts", start, step).alias("m"))
    return chunks.select(F.col("conv").alias("conv_id"), "perspective", "chunk", "n_turns", F.col("offset").alias("start_offset"), "text", F.col("m.mask").alias("mask"))


def op6_perspective_rotation(spark, sf_dir: str) -> DataFrame:
    out = rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return out.withColumn("mask", spans)


SQL = f"""
WITH t AS (SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, said) - 1 AS rank FROM t),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (SELECT r.conv_id, p.perspective, r.rank, r.rank // {CHUNK_TURNS} AS chunk, r.speaker = p.perspective AS own,
  '<|im_start|>' || CASE WHEN r.speaker = p.perspective THEN 'assistant' WHEN r.speaker = 'system' THEN 'system' ELSE 'user name=' || r.speaker END || chr(10) AS head,
  r.said || '<|im_end|>' AS body FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS opens FROM s WINDOW w AS (PARTITION BY conv_id, perspective, chunk ORDER BY rank)),
c AS (SELECT conv_id, perspective, chunk, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY rank) AS text,
  coalesce(string_agg(CAST(opens AS BIGINT) || '-' || CAST(opens + length(body) AS BIGINT), ',' ORDER BY rank) FILTER (own), '') AS mask FROM o GROUP BY ALL)
SELECT conv_id, perspective, chunk, n_turns, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset, text, mask
FROM c
"""
