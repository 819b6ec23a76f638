"""Queries of the labelled corpus, its files, labels of every sample, bundles and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bio, grammar, metrics, ner
from ..sources import files
from ..sources.scratch import scratch_dir
from . import sql
from .detection import fixture, query
from .evaluation import _EVERY, _aligned

_CORPUS = grammar.corpus_sql("(SELECT count(*) FROM customer)")


def _corpus(spark, sf_dir):
    """As many samples as there are customers."""
    return grammar.labelled_corpus(spark, spark.read.parquet(f"{sf_dir}/customer.parquet").count())


@query("label_corpus", f"SELECT id, family, array_to_string(tokens, ' ') AS tokens, array_to_string(tags, ' ') AS tags FROM ({_CORPUS})")
def label_corpus(spark, sf_dir):
    return _corpus(spark, sf_dir).select("id", "family", F.array_join("tokens", " ").alias("tokens"), F.array_join("ner_tag_labels", " ").alias("tags"))


@query("label_corpus_counts", f"SELECT family, substr(tag, 3) AS entity_type, count(*) AS n FROM (SELECT family, unnest(tags) AS tag FROM ({_CORPUS})) WHERE tag LIKE 'B-%' GROUP BY ALL")
def label_corpus_counts(spark, sf_dir):
    tags = _corpus(spark, sf_dir).select("family", F.explode_outer("ner_tag_labels").alias("tag")).where(F.col("tag").startswith("B-"))
    return tags.groupBy("family", F.substring("tag", 3, 99).alias("entity_type")).agg(F.count("*").alias("n"))


def _sample_file(spark, sf_dir):
    path = scratch_dir(spark, "samples")
    files.write_samples(_corpus(spark, sf_dir), path)
    return path


def _ids_sql(labels, types=None) -> str:
    kept = f"list_transform(tags, lambda t: CASE WHEN list_contains({sql.listed(types)}, substr(t, 3)) THEN t ELSE 'O' END)" if types else "tags"
    return f"array_to_string(list_transform({kept}, lambda t: CAST(coalesce(list_position({sql.listed(labels)}, t), 1) - 1 AS VARCHAR)), ' ')"


@query("samples_file", f"SELECT array_to_string(tokens, ' ') AS tokens, {_ids_sql(bio.LABELS)} AS ids, array_to_string(tags, ' ') AS tags FROM ({_CORPUS})")
def samples_file(spark, sf_dir):
    """Samples written as JSON lines and read back."""
    found = files.read_samples(spark, _sample_file(spark, sf_dir))
    return found.select(F.array_join("tokens", " ").alias("tokens"), F.array_join(F.col("ner_tags").cast("array<string>"), " ").alias("ids"), F.array_join("ner_tag_labels", " ").alias("tags"))


@query("training_file", f"SELECT array_to_string(tokens, ' ') AS tokens, {_ids_sql(bio.MODEL_LABELS, bio.MODEL_TYPES)} AS ids FROM ({_CORPUS})")
def training_file(spark, sf_dir):
    """The same files in the model's label space."""
    found = files.read_training(spark, _sample_file(spark, sf_dir))
    return found.select(F.array_join("tokens", " ").alias("tokens"), F.array_join(F.col("ner_tags").cast("array<string>"), " ").alias("ids"))


def _tags_sql(types) -> str:
    return f"string_agg(CASE WHEN list_contains({sql.listed(types)}, substr(tag, 3)) THEN tag ELSE 'O' END, ' ' ORDER BY pos)"


@query(
    "labels_every_sample",
    f"""{_EVERY}, u AS (SELECT id, pos, tag FROM b WHERE id IN (SELECT id FROM found) UNION ALL SELECT id, pos, tag FROM h WHERE id NOT IN (SELECT id FROM found)),
l AS (SELECT u.id, u.pos, length(o.token) AS n, coalesce(list_position({sql.listed(bio.MODEL_LABELS)}, u.tag), 1) - 1 AS y FROM u JOIN offs o USING (id, pos)),
s AS (SELECT id, string_agg(CAST(y AS VARCHAR) || CASE WHEN n >= 4 THEN ' ' || CAST(CASE WHEN y % 2 = 1 THEN y + 1 ELSE y END AS VARCHAR) ELSE '' END, ' ' ORDER BY pos) AS labels FROM l GROUP BY id),
t AS (SELECT id, string_agg(tag, ' ' ORDER BY pos) AS truth FROM a GROUP BY id),
q AS (SELECT id, string_agg(tag, ' ' ORDER BY pos) AS predicted, {_tags_sql(bio.MODEL_TYPES)} AS model_tags, {_tags_sql(bio.HYBRID_TYPES)} AS hybrid_tags,
  string_agg(CAST(coalesce(list_position({sql.listed(bio.LABELS)}, tag), 1) - 1 AS VARCHAR), ' ' ORDER BY pos) AS ids FROM u GROUP BY id)
SELECT id, truth, predicted, model_tags, hybrid_tags, ids, '-100 ' || labels || ' -100' AS subwords FROM t JOIN q USING (id) JOIN s USING (id)""",
)
def labels_every_sample(spark, sf_dir):
    """Word tags of every sample, negatives included, with their filters, ids and subwords."""
    found = _aligned(spark, sf_dir, "text").withColumnsRenamed({"truth": "t", "predicted": "p"})
    words = F.flatten(F.transform(F.split("text", " ", -1), lambda t, i: F.when(F.length(t) >= 4, F.array(i, i)).otherwise(F.array(i))))
    none = F.array(F.lit(None).cast("int"))
    model, hybrid = (bio.keep_types(F.col("p"), types) for types in (bio.MODEL_TYPES, bio.HYBRID_TYPES))
    subwords = bio.subword_labels(F.concat(none, words, none), bio.tag_ids(F.col("p"), bio.MODEL_LABELS))
    joined = lambda c, name: F.array_join(c.cast("array<string>"), " ").alias(name)
    return found.select("id", joined(F.col("t"), "truth"), joined(F.col("p"), "predicted"), joined(model, "model_tags"), joined(hybrid, "hybrid_tags"), joined(bio.tag_ids(F.col("p")), "ids"), joined(subwords, "subwords"))


#: Label lists of a model each: with prefixes, without, mixed, O alone, none.
_LABEL_LISTS = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'O,B-PER,I-PER' WHEN 2 THEN 'O,PATIENT,DATE' WHEN 3 THEN 'PER,I-LOC' ELSE 'B,I,PER-B' END AS labels FROM customer"


@query("adapter_needed", f"SELECT id, len(list_filter(string_split(labels, ','), lambda v: v <> 'O')) > 0 AND NOT regexp_matches(',' || labels, ',[BI]-') AS needed FROM ({_LABEL_LISTS})")
def adapter_needed(spark, sf_dir):
    return fixture(spark, sf_dir, _LABEL_LISTS).select("id", ner.needs_adapter(F.split("labels", ",")).alias("needed"))


@query(
    "token_lookup",
    """WITH v AS (SELECT user_id, '[T_' || (event_id % 5) || ']' AS token, CAST(event_id AS VARCHAR) AS original, event_id AS seq FROM events),
m AS (SELECT user_id, token, arg_max(original, seq) AS original FROM v GROUP BY ALL)
SELECT u.user_id, q.token, m.original FROM (SELECT DISTINCT user_id FROM v) u CROSS JOIN (SELECT '[T_' || range || ']' AS token FROM range(7)) q LEFT JOIN m USING (user_id, token)""",
)
def token_lookup(spark, sf_dir):
    """Tokens looked up in each user's map, where a later insert overwrites; two are unknown."""
    token = lambda n: F.concat(F.lit("[T_"), n.cast("string"), F.lit("]"))
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", token(F.col("event_id") % 5).alias("token"), F.col("event_id").cast("string").alias("original"), F.col("event_id").alias("seq"))
    asked = files.token_map(log, "user_id").select("user_id", "mapping", F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), token)).alias("token"))
    return asked.select("user_id", "token", files.lookup(F.col("mapping"), F.col("token")).alias("original"))


_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


@query("latency_histogram", " UNION ALL ".join(f"SELECT CAST({b} AS DOUBLE) AS le, count_if(value <= {b}) AS n FROM events" for b in _BOUNDS) + " UNION ALL SELECT NULL, count(value) FROM events")
def latency_histogram(spark, sf_dir):
    return metrics.histogram(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", _BOUNDS)


#: Runs whose figures have few decimals, so that both engines print them alike.
_RUNS = """SELECT 'org/model ' || c_custkey AS model, c_custkey AS n_samples, (c_custkey % 1000) / 1000.0E0 AS macro_f1, (c_custkey % 500) / 1000.0E0 AS macro_precision, (c_custkey % 250) / 250.0E0 AS macro_recall,
  c_custkey + 0.5E0 AS p50_ms, c_custkey * 2 + 0.5E0 AS p95_ms, c_custkey * 3 + 0.0E0 AS p99_ms, c_custkey + 0.0E0 AS mean_ms, c_custkey * 4 + 0.5E0 AS max_ms FROM customer"""


@query("run_comparison", f"SELECT model, printf('%-42s %6.4f %6.4f %6.4f %7.1f %7.1f', model, macro_f1, macro_precision, macro_recall, p50_ms, p95_ms) AS line FROM ({_RUNS})")
def run_comparison(spark, sf_dir):
    return files.comparison(fixture(spark, sf_dir, _RUNS))


@query(
    "run_summary",
    f"""SELECT model, 'Model: ' || model || chr(10) || 'Samples: ' || n_samples || chr(10) || printf('Macro F1: %.4f', macro_f1) || chr(10) || printf('Macro Precision: %.4f', macro_precision) || chr(10) || printf('Macro Recall: %.4f', macro_recall)
  || {" || ".join(f"chr(10) || printf('Latency {c}: %.1f ms', {c}_ms)" for c in ("p50", "p95", "p99", "mean", "max"))} AS report FROM ({_RUNS})""",
)
def run_summary(spark, sf_dir):
    return files.summary(fixture(spark, sf_dir, _RUNS))


@query("bundle_files", "SELECT 'checksum.sha256' AS name, sha256('weights') || '  model.onnx' || chr(10) AS content UNION ALL SELECT 'label_map.json', '{' || chr(10) || '  \"0\": \"O\"' || chr(10) || '}' || chr(10) UNION ALL SELECT 'model.onnx', 'weights' UNION ALL SELECT 'tokenizer.json', '{}'")
def bundle_files(spark, sf_dir):
    """Every file of a small bundle with its content."""
    folder = scratch_dir(spark, "bundle")
    files._put(spark, f"{folder}/in/weights", "weights")
    files._put(spark, f"{folder}/in/words", "{}")
    home = files.bundle(spark, folder, "entities", "1.0.0", f"{folder}/in/weights", {"tokenizer.json": f"{folder}/in/words"}, {"label_map.json": {"0": "O"}})
    found = spark.read.format("binaryFile").load(home)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").cast("string").alias("content"))
