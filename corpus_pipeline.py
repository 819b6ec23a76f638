"""A training corpus from ``documents``: reject, deduplicate, cut, mix, encode.

Each stage reads what the stage before has kept, written as Parquet in between.  All stages
but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.llm import bpe, classifier, mixing, neardup, substring
from quillguard.llm.common import Scratch, ordered


def _apart(stage):
    """The stage with columns that it does not know renamed, so that no name clashes."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        known = {"doc_id", "text", "source", "n_chars"}
        inner = docs.toDF(*(c if c in known else f"_x_{i}" for i, c in enumerate(docs.columns)))
        return stage(spark, inner, sf_dir).toDF(*docs.columns)

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


@_apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under the cut go."""
    model = classifier.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = classifier.score(docs, model, tuple(docs.columns))
    return scored.where(F.col("_score") >= classifier.SHOWN_CUT).select(*(F.col(f"`{c}`") for c in docs.columns))


@_apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8)."""
    scratch, names = Scratch(spark, "kept"), docs.columns
    several = substring.repeats(docs, "doc_id")
    # Where a doc_id repeats, rows are numbered in its order, so that each text stands for itself.
    rows = ordered(scratch, docs, "doc_id", "text") if several else docs
    key = F.when(F.col("doc_id").isNotNull(), F.shiftleft(F.col("_part").cast("long"), 33) + F.col("_idx")) if several else F.col("doc_id")
    rows = rows.withColumn("_key", key)
    found = neardup.near_duplicates(rows.select(F.col("_key").alias("doc_id"), "text"))
    kept = scratch.table(found.where("kept").select(F.col("doc_id").alias("_kept")), "kept")
    out = rows.join(kept.distinct(), F.col("_key").eqNullSafe(F.col("_kept")), "left_semi").select(*(F.col(f"`{c}`") for c in names))
    if several:  # rows equal in doc_id and text, without a word: one of them stays
        out = out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(out.where("doc_id IS NULL"))
    return out


@_apart
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document has are cut out."""
    out = substring.substring_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


@_apart
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the order of the mixture: files and rows within them follow it."""
    out = mixing.mix_sources(docs)
    return out.repartitionByRange("_position").sortWithinPartitions("_position").select(*(F.col(f"`{c}`") for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids (little-endian uint32) and digests of the ids and of
    the text decoded from them."""
    encoded = bpe.bpe_encode(docs, bpe.word_bpe_path(), keep=("doc_id", "source"), decoded=True)
    digest = F.sha2(F.col("_decoded").cast("binary"), 256)
    return encoded.select("doc_id", "source", (F.octet_length("_ids") / 4).cast("long").alias("n_tokens"), F.col("_ids").alias("token_ids"), F.sha2("_ids", 256).alias("ids_sha256"), digest.alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("mixing sources", mixture),
    ("BPE encoding", tokens),
]

#: The classifier's fit and the merge loop of BPE have no SQL; tests use plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
