"""Labelled samples, reports and bundles as files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bio
from ..schemas import LABELLED


def read_samples(spark: SparkSession, path: str, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Labelled samples, one JSON object per line; a limit needs a column to order by."""
    found = spark.read.schema(LABELLED + (f", {order} long" if order else "")).json(path)
    if limit is None:
        return found
    if order is None:
        raise ValueError("a limit without an order would take any rows")
    return found.orderBy(order).limit(limit)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Samples with their tags in the model's label space."""
    tags = bio.keep_types(F.col("ner_tag_labels"), bio.MODEL_TYPES)
    return read_samples(spark, path).select("tokens", bio.tag_ids(tags, bio.MODEL_LABELS).alias("ner_tags"))


def write_samples(df: DataFrame, path: str) -> None:
    df.select("tokens", "ner_tags", "ner_tag_labels").write.mode("overwrite").json(path)


def report_name(model: Column, at: Column) -> Column:
    """File name of a report: model with / as _, then the UTC time."""
    return F.concat(F.replace(model, F.lit("/"), F.lit("_")), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".json"))


def write_report(df: DataFrame, path: str) -> None:
    """One row of results as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file in any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One object as a file: two spaces of indent, a line feed at the end."""
    _put(spark, path, json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def save_results(run: DataFrame, folder: str) -> str:
    """One run (a row with ``model`` and ``at``) as one JSON file under its name; gives the path."""
    row = run.select(report_name(F.col("model"), F.col("at")).alias("name"), F.to_json(F.struct("*")).alias("body")).first()
    path = f"{folder.rstrip('/')}/{row['name']}"
    write_json(run.sparkSession, path, json.loads(row["body"]))
    return path


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    """A byte-for-byte copy inside the cluster's file systems; the driver holds a buffer of it."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    a, b = hadoop.Path(source), hadoop.Path(target)
    hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def bundle(spark: SparkSession, folder: str, name: str, version: str, model: str, others: dict[str, str], documents: dict[str, dict]) -> str:
    """A folder ``name-vversion`` with the model file, other files under given names, JSON
    documents (label map, schema, metadata) and the model's checksum line; gives its path."""
    home = f"{folder.rstrip('/')}/{name}-v{version}"
    copy_file(spark, model, f"{home}/model.onnx")
    for target, source in others.items():
        copy_file(spark, source, f"{home}/{target}")
    for target, value in documents.items():
        write_json(spark, f"{home}/{target}", value)
    _put(spark, f"{home}/checksum.sha256", checksums(spark, f"{home}/model.onnx").first()["line"] + "\n")
    return home


def summary(runs: DataFrame) -> DataFrame:
    """The text report of each run: model, samples, scores, latencies."""
    named = [("Macro F1", "macro_f1", "%.4f"), ("Macro Precision", "macro_precision", "%.4f"), ("Macro Recall", "macro_recall", "%.4f")]
    named += [(f"Latency {c}", f"{c}_ms", "%.1f ms") for c in ("p50", "p95", "p99", "mean", "max")]
    shape = "\n".join(["Model: %s", "Samples: %d", *(f"{title}: {form}" for title, _, form in named)])
    return runs.select("model", F.format_string(shape, "model", "n_samples", *(c for _, c, _ in named)).alias("report"))


def comparison(runs: DataFrame) -> DataFrame:
    """One line of text per run, aligned."""
    line = F.format_string("%-42s %6.4f %6.4f %6.4f %7.1f %7.1f", "model", "macro_f1", "macro_precision", "macro_recall", "p50_ms", "p95_ms")
    return runs.select("model", line.alias("line")).orderBy("model")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 lines of binary files, as a bundle's checksum file has them."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(path).select(F.concat(F.sha2("content", 256), F.lit("  "), name).alias("line"))


def token_map(vault: DataFrame, key: str) -> DataFrame:
    """(key, token, original) rows -> one map per key; the last of equal tokens counts."""
    last = vault.groupBy(key, "token").agg(F.max_by("original", "seq").alias("original"))
    return last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("mapping"))


def lookup(mapping: Column, token: Column) -> Column:
    return F.try_element_at(mapping, token)
