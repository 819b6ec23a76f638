"""Queries of detection, scoring, overlap, merge, redaction and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import patterns as P
from ..functions.context import context_score
from ..functions.spans import candidates, detect, detect_all, valid_ssn
from ..operators import chunk, merge, ner, redact
from ..schemas import describe, safe_mapping
from . import fixtures, sql

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "embeddings")


def fixture(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A fixture's SQL over the tables in ``sf_dir``."""
    import re

    named = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    return spark.sql(re.sub(r"\bFROM (\w+)", lambda m: f"FROM {{{m[1]}}}" if m[1] in named else m[0], text.replace("{", "{{").replace("}", "}}")), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in named})


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, fixtures.SAMPLES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


DOCUMENTS = "SELECT doc_id AS id, text FROM documents"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return register


def _exploded(df: DataFrame, column: str = "entities") -> DataFrame:
    # The outer form: for the inner one Spark infers a filter that evaluates the array twice.
    return df.select("id", F.posexplode_outer(column).alias("ord", "e")).where("e IS NOT NULL").select("id", "ord", "e.*")


def _flat(df: DataFrame) -> DataFrame:
    return df.select("id", "entity_type", "start", F.col("end").alias("stop"), F.col("text").alias("span"), F.round("score", 4).alias("score"))


_FLAT = "SELECT id, entity_type, start, stop, span, round(score, 4) AS score FROM"


def _detector(kind: str, source, text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(_exploded(source(spark, sf_dir).select("id", detect(F.col("text"), kind).alias("entities"))))

    return run, f"{_FLAT} ({sql.detected(text, kind)})"


_NAMES = {"SSN_PLAIN": "ssn_dashless", "CREDIT_CARD": "card"}
for _kind in P.ORDER:
    _run, _oracle = _detector(_kind, samples, fixtures.SAMPLES)
    query("detect_" + _NAMES.get(_kind, _kind.lower()), _oracle)(_run)
for _kind in ("EMAIL", "PHONE", "IPV4", "CREDIT_CARD"):
    _run, _oracle = _detector(_kind, documents, DOCUMENTS)
    query(f"detect_{_NAMES.get(_kind, _kind.lower())}_documents", _oracle)(_run)


def _scores(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = F.transform(candidates(F.col("text"), kind), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("stop"), F.round(context_score(F.col("text"), m["start"], m["end"], kind), 4).alias("score")))
        return samples(spark, sf_dir).select("id", F.explode(found).alias("m")).select("id", "m.start", "m.stop", "m.score")

    return run


for _kind, _name in (("SSN_PLAIN", "ssn"), ("DOB", "dob"), ("CREDIT_CARD", "cc")):
    query(f"score_{_name}_context", f"SELECT id, start, CAST(stop AS INTEGER) AS stop, score FROM ({sql.scored(fixtures.SAMPLES, _kind)})")(_scores(_kind))


@query("ssn_validity", f"SELECT c_custkey AS id, (c_custkey * 7919) % 905 NOT IN (0, 666) AND (c_custkey * 7919) % 905 < 900 AND (c_custkey * 31) % 100 <> 0 AND (c_custkey * 37) % 10000 <> 0 AS valid FROM customer")
def ssn_validity(spark, sf_dir):
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), valid_ssn((k * 7919) % 905, (k * 31) % 100, (k * 37) % 10000).alias("valid"))


_REGEX_CAND = "SELECT id, entity_type, start, stop, span, score, 'regex' AS source, det * 1000 + i AS ord FROM ({})"


_DETECTED = sql.merged(_REGEX_CAND.format(sql.all_detected(DOCUMENTS)))


@query("detect_all_documents", f"WITH RECURSIVE {_DETECTED} {_FLAT} merged")
def detect_all_documents(spark, sf_dir):
    return _flat(_exploded(redact.detect_entities(documents(spark, sf_dir))))


#: The SQL still counts over the samples; the queries count over documents.
_COUNTS = f"WITH RECURSIVE {sql.merged(_REGEX_CAND.format(sql.all_detected(fixtures.SAMPLES)))} "


@query("entity_counts", _COUNTS + "SELECT entity_type, count(*) AS n FROM merged GROUP BY entity_type")
def entity_counts(spark, sf_dir):
    return _exploded(redact.detect_entities(documents(spark, sf_dir))).groupBy("entity_type").agg(F.count("*").alias("n"))


@query("entity_counts_rollup", _COUNTS + "SELECT coalesce(entity_type, 'TOTAL') AS entity_type, count(*) AS n FROM merged GROUP BY ROLLUP (entity_type)")
def entity_counts_rollup(spark, sf_dir):
    found = _exploded(redact.detect_entities(documents(spark, sf_dir)))
    return found.rollup("entity_type").agg(F.count("*").alias("n")).select(F.coalesce("entity_type", F.lit("TOTAL")).alias("entity_type"), "n")


def _hits(spark, sf_dir, adapter=None) -> DataFrame:
    """Samples with the model's hits as spans."""
    hits = fixture(spark, sf_dir, fixtures.HITS).withColumnRenamed("stop", "end").withColumn("word", F.format_string("w%d", F.col("n")))
    return samples(spark, sf_dir).join(ner.hits_to_spans(hits, EngineConfig(label_adapter=adapter), "id", "n"), "id", "left")


_HIT_TYPE = "CASE entity_group WHEN 'PER' THEN 'PERSON' WHEN 'LOC' THEN 'LOCATION' WHEN 'ORG' THEN 'ORGANIZATION' ELSE entity_group END"
_HIT = f"SELECT id, {_HIT_TYPE} AS entity_type, start, stop, 'w' || n AS span, score, 'bert' AS source, n AS ord FROM ({fixtures.HITS}) WHERE score >= 0.9"


@query("ner_filter_map", f"SELECT id, n, {_HIT_TYPE} AS entity_type, start, stop, round(score, 4) AS score FROM ({fixtures.HITS}) WHERE score >= 0.9")
def ner_filter_map(spark, sf_dir):
    hits = fixture(spark, sf_dir, fixtures.HITS)
    kept = ner.mapped_hits(hits, EngineConfig())
    return kept.select("id", "n", "entity_type", "start", "stop", F.round("score", 4).alias("score"))


@query("ner_label_adapter", f"SELECT id, n, CASE entity_group WHEN 'PATIENT' THEN 'PERSON' ELSE {_HIT_TYPE} END AS entity_type FROM ({fixtures.HITS}) WHERE score >= 0.9")
def ner_label_adapter(spark, sf_dir):
    hits = fixture(spark, sf_dir, fixtures.HITS)
    return ner.mapped_hits(hits, EngineConfig(label_adapter=ner.CLINICAL_ADAPTER)).select("id", "n", "entity_type")


_BOTH = f"({_HIT}) UNION ALL ({_REGEX_CAND.format(sql.all_detected(fixtures.SAMPLES)).replace('det * 1000 + i AS ord', '10000 + det * 1000 + i AS ord')})"


@query("merge_spans", f"WITH RECURSIVE {sql.merged(_BOTH)} SELECT id, entity_type, start, stop, span, round(score, 4) AS score, source FROM merged")
def merge_spans(spark, sf_dir):
    df = _hits(spark, sf_dir).withColumn("regex", detect_all(F.col("text")))
    out = df.select("id", merge.merge(F.coalesce("spans", F.array().cast(ner.SPANS)), F.col("regex")).alias("entities"))
    return _exploded(out).select("id", "entity_type", "start", F.col("end").alias("stop"), F.col("text").alias("span"), F.round("score", 4).alias("score"), "source")


@query(
    "hybrid_detect",
    f"WITH RECURSIVE {sql.merged(_BOTH)}, found AS (SELECT DISTINCT id FROM cand WHERE source = 'regex') "
    f"SELECT id, entity_type, start, stop, source FROM merged WHERE id IN (SELECT id FROM found) UNION ALL SELECT id, entity_type, start, stop, source FROM cand WHERE id NOT IN (SELECT id FROM found)",
)
def hybrid_detect(spark, sf_dir):
    out = redact.detect_entities(_hits(spark, sf_dir), model="spans")
    return _exploded(out).select("id", "entity_type", "start", F.col("end").alias("stop"), "source")


@query("stride_dedup", f"WITH RECURSIVE {sql.merged(_HIT)} SELECT id, entity_type, start, stop, span, round(score, 4) AS score FROM merged")
def stride_dedup(spark, sf_dir):
    out = _hits(spark, sf_dir).where("spans IS NOT NULL").select("id", merge.merge(F.col("spans"), F.array().cast(ner.SPANS)).alias("entities"))
    return _flat(_exploded(out))


_PAIR = "a.start < b.stop AND b.start < a.stop"


@query(
    "span_overlap_pairs",
    f"WITH s AS (SELECT id, start, stop, CAST(row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS INTEGER) AS o FROM ({_BOTH})) "
    f"SELECT a.id, a.o AS ord_a, b.o AS ord_b, CASE WHEN a.start = b.start AND a.stop = b.stop THEN 'exact' WHEN (a.start <= b.start AND a.stop >= b.stop) OR (b.start <= a.start AND b.stop >= a.stop) THEN 'nested' ELSE 'partial' END AS overlap "
    f"FROM s a JOIN s b ON a.id = b.id AND a.o < b.o AND {_PAIR}",
)
def span_overlap_pairs(spark, sf_dir):
    df = _hits(spark, sf_dir).withColumn("regex", detect_all(F.col("text")))
    both = df.select("id", F.concat(F.coalesce("spans", F.array().cast(ner.SPANS)), "regex").alias("entities"))
    return merge.overlap_pairs(_exploded(both))


@query(
    "dashless_anti_overlap",
    f"WITH d AS ({sql.detected(fixtures.SAMPLES, 'SSN_DASHED')}), p AS ({sql.detected(fixtures.SAMPLES, 'SSN_PLAIN')}) SELECT id, start, stop FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.id = p.id AND d.start <= p.start AND p.start < d.stop)",
)
def dashless_anti_overlap(spark, sf_dir):
    df = samples(spark, sf_dir).select("id", detect(F.col("text"), "SSN_DASHED").alias("dashed"), detect(F.col("text"), "SSN_PLAIN").alias("plain"))
    kept = F.filter("plain", lambda s: ~F.exists("dashed", lambda d: (d["start"] <= s["start"]) & (s["start"] < d["end"])))
    return df.select("id", F.explode(kept).alias("s")).select("id", "s.start", F.col("s.end").alias("stop"))


def _masked_sql(source: str, disabled: str = "") -> str:
    """CTEs ending in ``tok`` (id, text, start, stop, span, token) and ``out`` (id, masked)."""
    return f"""WITH RECURSIVE src AS ({source}), {sql.merged(_REGEX_CAND.format(sql.all_detected(source)))},
kept AS (SELECT * FROM merged {disabled}),
tok AS (SELECT *, '[' || entity_type || '_' || row_number() OVER (PARTITION BY id, entity_type ORDER BY start DESC) || ']' AS token FROM kept),
gap AS (SELECT t.*, s.text, coalesce(lag(stop) OVER (PARTITION BY t.id ORDER BY start), 0) AS prev FROM tok t JOIN src s ON s.id = t.id),
out AS (SELECT s.id, s.text, coalesce(g.n, 0) AS n_entities, coalesce(g.m, '') || substr(s.text, CAST(coalesce(g.last, 0) + 1 AS BIGINT)) AS masked_text FROM src s LEFT JOIN (
  SELECT id, count(*) AS n, max(stop) AS last, string_agg(substr(text, CAST(prev + 1 AS BIGINT), CAST(start - prev AS BIGINT)) || token, '' ORDER BY start) AS m FROM gap GROUP BY id) g ON g.id = s.id)"""


@query("redact_documents", _masked_sql(DOCUMENTS) + " SELECT id AS doc_id, CAST(n_entities AS INTEGER) AS n_entities, masked_text FROM out")
def redact_documents(spark, sf_dir):
    out = redact.redact(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.size("entities").alias("n_entities"), "masked_text")


@query("redact_samples", _masked_sql(fixtures.SAMPLES) + " SELECT id, CAST(n_entities AS INTEGER) AS n_entities, masked_text FROM out")
def redact_samples(spark, sf_dir):
    out = redact.redact(samples(spark, sf_dir))
    return out.select("id", F.size("entities").alias("n_entities"), "masked_text")


@query("redact_disabled", _masked_sql(fixtures.SAMPLES, "WHERE entity_type NOT IN ('SSN', 'IPV6')") + " SELECT id, CAST(n_entities AS INTEGER) AS n_entities, masked_text FROM out")
def redact_disabled(spark, sf_dir):
    out = redact.redact(samples(spark, sf_dir), disabled=["SSN", "IPV6"])
    return out.select("id", F.size("entities").alias("n_entities"), "masked_text")


@query("mapping_rows", _masked_sql(fixtures.SAMPLES) + " SELECT id, token, span AS original FROM tok")
def mapping_rows(spark, sf_dir):
    return redact.redact(samples(spark, sf_dir)).select("id", F.explode_outer("mapping").alias("token", "original")).where("token IS NOT NULL")


@query("token_numbering", _masked_sql(fixtures.SAMPLES) + " SELECT id, start, token FROM tok")
def token_numbering(spark, sf_dir):
    return _exploded(redact.redact(samples(spark, sf_dir))).select("id", "start", "token")


@query("restore_roundtrip", f"SELECT id, text AS restored, true AS equal FROM ({fixtures.SAMPLES})")
def restore_roundtrip(spark, sf_dir):
    out = redact.redact(samples(spark, sf_dir))
    out = out.withColumn("restored", redact.restore(F.col("masked_text"), redact.entries(F.col("entities"))))
    return out.select("id", "restored", (F.col("restored") == F.col("text")).alias("equal"))


@query(
    "safe_view",
    _masked_sql(fixtures.SAMPLES)
    + " SELECT id, string_agg('[' || entity_type || ':*** (' || start || ':' || stop || ') score=' || printf('%.2f', score) || ']', ' ' ORDER BY start) AS entities, string_agg(token || '=***', ' ' ORDER BY token) AS mapping FROM tok GROUP BY id",
)
def safe_view(spark, sf_dir):
    out = redact.redact(samples(spark, sf_dir)).where(F.size("entities") > 0)
    shown = F.array_sort(F.transform(F.map_entries(safe_mapping(F.col("mapping"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.select("id", F.array_join(F.transform("entities", describe), " ").alias("entities"), F.array_join(shown, " ").alias("mapping"))


_CHUNKS = f"""WITH RECURSIVE src AS ({DOCUMENTS}),
pieces AS (SELECT id, text, list_concat(list_filter(list_transform(range(1, length(text)), lambda k: CASE WHEN substr(text, k, 1) IN ('.', ';', chr(10)) THEN k END), lambda v: v IS NOT NULL), [length(text)]) AS b FROM src WHERE length(text) > 1500),
bound AS (SELECT id, text, list_prepend(0, b) AS b FROM pieces),
c(id, s, e) AS (
  SELECT id, 1, greatest(2, len(list_filter(b, lambda v: v - b[1] <= 1500))) FROM bound
  UNION ALL
  SELECT n.id, n.s, greatest(n.s + 1, len(list_filter(b, lambda v: v - b[n.s] <= 1500))) FROM (
    SELECT id, CASE WHEN e - 1 > s THEN e - 1 ELSE e END AS s FROM c) n JOIN bound USING (id) WHERE n.s < len(b)),
chunks AS (SELECT id, CAST(b[s] AS INTEGER) AS pos, substr(text, CAST(b[s] + 1 AS BIGINT), CAST(b[e] - b[s] AS BIGINT)) AS chunk FROM c JOIN bound USING (id)
  UNION ALL SELECT id, 0 AS pos, text AS chunk FROM src WHERE length(text) <= 1500)"""


@query("chunk_documents", _CHUNKS + " SELECT id AS doc_id, pos, chunk FROM chunks")
def chunk_documents(spark, sf_dir):
    found = documents(spark, sf_dir).select("id", F.explode(chunk.chunks(F.col("text"))).alias("c"))
    return found.select(F.col("id").alias("doc_id"), F.col("c.offset").alias("pos"), "c.chunk")


@query("chunk_counts", _CHUNKS + " SELECT id AS doc_id, CAST(count(*) AS INTEGER) AS n_chunks FROM chunks GROUP BY id")
def chunk_counts(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("id").alias("doc_id"), F.size(chunk.chunks(F.col("text"))).alias("n_chunks"))
