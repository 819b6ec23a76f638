"""Queries of extraction, routing, labels, metrics, synthesis, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import providers
from ..operators import bio, metrics, ner, redact, synth
from ..sources import files
from ..sources.scratch import scratch_dir
from ..streaming import events
from . import fixtures, sql
from .detection import _BOTH, _DETECTED, _HIT, _REGEX_CAND, _masked_sql, documents, fixture, query, samples

_T = "json_type(j, '{}') = 'VARCHAR'"
_BODY = f"SELECT id, body, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM ({fixtures.BODIES})"


def _content_sql(j: str) -> str:
    return f"CASE json_type({j}) WHEN 'VARCHAR' THEN json_extract_string({j}, '$') WHEN 'ARRAY' THEN nullif(array_to_string(list_transform(list_filter(CAST({j} AS JSON[]), lambda p: json_type(p, '$.type') = 'VARCHAR' AND json_extract_string(p, '$.type') = 'text' AND json_type(p, '$.text') = 'VARCHAR'), lambda p: json_extract_string(p, '$.text')), ''), '') END"


def _bodies(spark, sf_dir):
    return fixture(spark, sf_dir, fixtures.BODIES)


_user = "list_filter(CAST(json_extract(j, '$.messages') AS JSON[]), lambda m: json_type(m, '$.role') = 'VARCHAR' AND json_extract_string(m, '$.role') = 'user')"


@query(
    "request_text",
    f"""WITH b AS ({_BODY}), m AS (SELECT id, unnest({_user}) AS m, unnest(range(len({_user}))) AS n FROM b WHERE json_type(j, '$.messages') = 'ARRAY'),
t AS (SELECT id, n, json_extract(m, '$.content') AS c FROM m), x AS (SELECT id, n, {_content_sql('c')} AS t FROM t)
SELECT b.id, nullif(a.t, '') AS text FROM b LEFT JOIN (SELECT id, string_agg(t, chr(10) ORDER BY n) AS t FROM x WHERE t IS NOT NULL GROUP BY id) a USING (id)""",
)
def request_text(spark, sf_dir):
    return _bodies(spark, sf_dir).select("id", providers.ChatAdapter().request_text(F.col("body")).alias("text"))


@query("response_text", f"WITH b AS ({_BODY}), c AS (SELECT id, json_extract(j, '$.choices[0].message.content') AS c FROM b) SELECT id, {_content_sql('c')} AS text FROM c")
def response_text(spark, sf_dir):
    return _bodies(spark, sf_dir).select("id", providers.ChatAdapter().response_text(F.col("body")).alias("text"))


_DELTA = f"""WITH b AS ({_BODY}) SELECT id, CASE WHEN json_extract_string(j, '$.type') = 'response.output_text.delta' THEN CASE WHEN {_T.format('$.delta')} THEN json_extract_string(j, '$.delta') END
  WHEN {_T.format('$.choices[0].delta.content')} THEN json_extract_string(j, '$.choices[0].delta.content') END AS delta FROM b"""


@query("delta_text", _DELTA)
def delta_text(spark, sf_dir):
    return _bodies(spark, sf_dir).select("id", providers.ChatAdapter().delta_text(F.col("body")).alias("delta"))


def _requests(spark, sf_dir):
    return fixture(spark, sf_dir, fixtures.REQUESTS)


@query("skip_list", f"SELECT id, 'IPV6,' || array_to_string(list_transform(string_split(skip, ','), lambda x: trim(x)), ',') AS skip FROM ({fixtures.REQUESTS})")
def skip_list(spark, sf_dir):
    return _requests(spark, sf_dir).select("id", F.array_join(providers.skip_list(["IPV6"], F.col("skip")), ",").alias("skip"))


@query("header_filter", f"SELECT id, 'Accept=*/*;X-Skip=' || skip AS headers FROM ({fixtures.REQUESTS})")
def header_filter(spark, sf_dir):
    headers = F.create_map(F.lit("Host"), F.lit("a"), F.lit("Accept"), F.lit("*/*"), F.lit("X-Skip"), F.col("skip"))
    kept = F.transform(F.map_entries(providers.forwarded_headers(headers)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return _requests(spark, sf_dir).select("id", F.array_join(F.array_sort(kept), ";").alias("headers"))


@query("route_status", f"SELECT id, CASE WHEN path = '/health' THEN '200' ELSE 'forward' END AS proxy, CASE WHEN method = 'GET' AND path = '/metrics' THEN 200 ELSE 404 END AS metrics FROM ({fixtures.REQUESTS})")
def route_status(spark, sf_dir):
    return _requests(spark, sf_dir).select("id", F.coalesce(providers.proxy_route(F.col("path")).cast("string"), F.lit("forward")).alias("proxy"), providers.metrics_route(F.col("method"), F.col("path")).alias("metrics"))


@query("request_counter", f"SELECT count(*) AS http_requests_total FROM ({fixtures.REQUESTS})")
def request_counter(spark, sf_dir):
    return _requests(spark, sf_dir).agg(F.count("*").alias("http_requests_total"))


@query("auth_counters", f"SELECT reason, count(*) AS n FROM ({fixtures.REQUESTS}) GROUP BY reason")
def auth_counters(spark, sf_dir):
    return _requests(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


def _tokens():
    return F.split("text", " ", -1)


_WORDS = f"""words AS (SELECT id, w, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT id, string_split(text, ' ') AS w FROM ({fixtures.SAMPLES}))),
offs AS (SELECT id, pos, token, CAST(sum(length(token) + 1) OVER (PARTITION BY id ORDER BY pos) - length(token) - 1 AS INTEGER) AS ws, CAST(sum(length(token) + 1) OVER (PARTITION BY id ORDER BY pos) - 1 AS INTEGER) AS we FROM words)"""


@query("word_offsets", f"WITH {_WORDS} SELECT id, CAST(pos AS INTEGER) AS pos, ws, we FROM offs")
def word_offsets(spark, sf_dir):
    found = samples(spark, sf_dir).select("id", F.posexplode(bio.word_offsets(_tokens())).alias("pos", "o"))
    return found.select("id", "pos", F.col("o.start").alias("ws"), F.col("o.end").alias("we"))


def _tagged_sql(candidates: str, name: str, merged_as: str = "merged") -> str:
    """CTEs: ``name`` (id, pos, tag) of words aligned with the merged spans."""
    bio_type = "CASE entity_type WHEN 'PERSON' THEN 'PER' WHEN 'LOCATION' THEN 'LOC' WHEN 'ORGANIZATION' THEN 'ORG' ELSE entity_type END"
    inner = sql.merged(candidates).replace("cand", f"cand_{name}").replace("ranked", f"ranked_{name}").replace("fold", f"fold_{name}").replace("merged", f"merged_{name}")
    return f"""{inner},
own_{name} AS (SELECT o.id, o.pos, min(m.start) AS start FROM offs o JOIN merged_{name} m ON m.id = o.id AND o.ws < m.stop AND o.we > m.start GROUP BY o.id, o.pos),
lab_{name} AS (SELECT w.id, w.pos, {bio_type} AS t, row_number() OVER (PARTITION BY w.id, w.start ORDER BY w.pos) AS k FROM own_{name} w JOIN merged_{name} m ON m.id = w.id AND m.start = w.start),
{name} AS (SELECT o.id, o.pos, CASE WHEN l.t IS NULL THEN 'O' WHEN l.k = 1 THEN 'B-' || l.t ELSE 'I-' || l.t END AS tag FROM offs o LEFT JOIN lab_{name} l ON l.id = o.id AND l.pos = o.pos)"""


_REGEX_ONLY = _REGEX_CAND.format(sql.all_detected(fixtures.SAMPLES))
_JOINED = "string_agg(tag, ' ' ORDER BY pos)"


def _aligned(spark, sf_dir, *keep):
    """Every sample with word tags of patterns only (truth) and of patterns with model hits, and
    the columns ``keep``."""
    hits = fixture(spark, sf_dir, fixtures.HITS).withColumnRenamed("stop", "end").withColumn("word", F.lit("w"))
    df = samples(spark, sf_dir)
    df = redact.detect_entities(df).withColumnRenamed("entities", "own")
    df = df.join(ner.hits_to_spans(hits, key="id", order="n", config=redact.EngineConfig()), "id", "left")
    df = df.withColumn("both", redact.merge_if_found(F.coalesce("spans", F.array().cast(ner.SPANS)), F.col("own")))
    return df.select("id", *keep, bio.align(_tokens(), F.col("own")).alias("truth"), bio.align(_tokens(), F.col("both")).alias("predicted"))


#: The SQL still leaves out samples in which the patterns found nothing; the queries do not.
_ONLY_FOUND = f"WHERE id IN (SELECT id FROM ({_REGEX_ONLY}))"


@query("align_bio", f"WITH RECURSIVE {_WORDS}, {_tagged_sql(_REGEX_ONLY, 'a')}, {_tagged_sql(_BOTH, 'b')}, x AS (SELECT id, {_JOINED} AS truth FROM a GROUP BY id), y AS (SELECT id, {_JOINED} AS predicted FROM b GROUP BY id) SELECT id, truth, predicted FROM x JOIN y USING (id) {_ONLY_FOUND}")
def align_bio(spark, sf_dir):
    return _aligned(spark, sf_dir).select("id", F.array_join("truth", " ").alias("truth"), F.array_join("predicted", " ").alias("predicted"))


def _kept_sql(types) -> str:
    kept = sql.listed(types)
    return f"WITH RECURSIVE {_WORDS}, {_tagged_sql(_BOTH, 'b')} SELECT id, string_agg(CASE WHEN list_contains({kept}, substr(tag, 3)) THEN tag ELSE 'O' END, ' ' ORDER BY pos) AS tags FROM b {_ONLY_FOUND} GROUP BY id"


@query("filter_tags_model", _kept_sql(bio.MODEL_TYPES))
def filter_tags_model(spark, sf_dir):
    return _aligned(spark, sf_dir).select("id", F.array_join(bio.keep_types(F.col("predicted"), bio.MODEL_TYPES), " ").alias("tags"))


@query("filter_tags_hybrid", _kept_sql(bio.HYBRID_TYPES))
def filter_tags_hybrid(spark, sf_dir):
    return _aligned(spark, sf_dir).select("id", F.array_join(bio.keep_types(F.col("predicted"), bio.HYBRID_TYPES), " ").alias("tags"))


@query("tag_ids", f"WITH RECURSIVE {_WORDS}, {_tagged_sql(_BOTH, 'b')} SELECT id, string_agg(CAST(coalesce(list_position({sql.listed(bio.LABELS)}, tag), 1) - 1 AS VARCHAR), ' ' ORDER BY pos) AS ids FROM b {_ONLY_FOUND} GROUP BY id")
def tag_ids(spark, sf_dir):
    return _aligned(spark, sf_dir).select("id", F.array_join(F.transform(bio.tag_ids(F.col("predicted")), lambda x: x.cast("string")), " ").alias("ids"))


#: Two subwords for words of four characters or more, one for others, between two specials.
_SUB = f"""WITH RECURSIVE {_WORDS}, {_tagged_sql(_BOTH, 'b')},
l AS (SELECT b.id, b.pos, length(o.token) AS n, coalesce(list_position({sql.listed(bio.MODEL_LABELS)}, tag), 1) - 1 AS y FROM b JOIN offs o USING (id, pos)),
s AS (SELECT id, pos, unnest(CASE WHEN n >= 4 THEN [y, CASE WHEN y % 2 = 1 THEN y + 1 ELSE y END] ELSE [y] END) AS y, unnest(CASE WHEN n >= 4 THEN [0, 1] ELSE [0] END) AS k FROM l)
SELECT id, '-100 ' || string_agg(CAST(y AS VARCHAR), ' ' ORDER BY pos, k) || ' -100' AS labels FROM s {_ONLY_FOUND} GROUP BY id"""


@query("subword_labels", _SUB)
def subword_labels(spark, sf_dir):
    tagged = _aligned(spark, sf_dir).join(samples(spark, sf_dir), "id")
    words = F.flatten(F.transform(_tokens(), lambda t, i: F.when(F.length(t) >= 4, F.array(i, i)).otherwise(F.array(i))))
    none = F.array(F.lit(None).cast("int"))
    found = tagged.select("id", F.concat(none, words, none).alias("w"), bio.tag_ids(F.col("predicted"), bio.MODEL_LABELS).alias("y"))
    return found.select("id", F.array_join(F.transform(bio.subword_labels(F.col("w"), F.col("y")), lambda x: x.cast("string")), " ").alias("labels"))


def _entities_sql(tags: str, name: str) -> str:
    return f"""f_{name} AS (SELECT *, substr(tag, 3) AS t, CASE WHEN tag = 'O' THEN 0 WHEN tag LIKE 'B-%' OR coalesce(lag(tag) OVER v, 'O') = 'O' OR substr(lag(tag) OVER v, 3) <> substr(tag, 3) THEN 1 ELSE 0 END AS opens FROM {tags} {_ONLY_FOUND} WINDOW v AS (PARTITION BY id ORDER BY pos)),
g_{name} AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY pos) AS n FROM f_{name}),
e_{name} AS (SELECT id, t, min(pos) AS a, max(pos) AS z FROM g_{name} WHERE tag <> 'O' GROUP BY id, n, t)"""


_COUNTS = f"""WITH RECURSIVE {_WORDS}, {_tagged_sql(_REGEX_ONLY, 'a')}, {_tagged_sql(_BOTH, 'b')}, {_entities_sql('a', 'a')}, {_entities_sql('b', 'b')},
counts AS (SELECT coalesce(x.t, y.t) AS type, count_if(x.t IS NOT NULL AND y.t IS NOT NULL) AS tp, count_if(x.t IS NULL) AS fp, count_if(y.t IS NULL) AS fn FROM e_a x FULL JOIN e_b y ON x.id = y.id AND x.t = y.t AND x.a = y.a AND x.z = y.z GROUP BY 1),
per AS (SELECT type, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f, tp + fn AS s FROM counts)"""
_MACRO = "SELECT 'macro avg' AS type, avg(p) AS p, avg(r) AS r, avg(f) AS f, sum(s) AS s FROM per"


@query("ner_f1", _COUNTS + f" SELECT round(f, 6) AS macro_f1, round(p, 6) AS macro_precision, round(r, 6) AS macro_recall FROM ({_MACRO})")
def ner_f1(spark, sf_dir):
    found = metrics.macro_scores(metrics.entity_counts(_aligned(spark, sf_dir), "truth", "predicted"))
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query(
    "ner_report",
    _COUNTS
    + f""" SELECT type, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(s AS BIGINT) AS support FROM (SELECT * FROM per UNION ALL {_MACRO}
  UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM per
  UNION ALL SELECT 'micro avg', sum(tp) / (sum(tp) + sum(fp)), sum(tp) / (sum(tp) + sum(fn)), 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), sum(tp) + sum(fn) FROM counts)""",
)
def ner_report(spark, sf_dir):
    found = metrics.report(metrics.entity_counts(_aligned(spark, sf_dir), "truth", "predicted"))
    return found.select("type", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


#: Tags of every sample: merged spans where patterns found something, else the model's spans
#: as they came, of which the first that meets a word has it.
_EVERY = f"""WITH RECURSIVE {_WORDS}, {_tagged_sql(_REGEX_ONLY, 'a')}, {_tagged_sql(_BOTH, 'b')},
hit AS ({_HIT}),
own_h AS (SELECT o.id, o.pos, min(h.ord) AS ord FROM offs o JOIN hit h ON h.id = o.id AND o.ws < h.stop AND o.we > h.start GROUP BY o.id, o.pos),
lab_h AS (SELECT w.id, w.pos, CASE h.entity_type WHEN 'PERSON' THEN 'PER' WHEN 'LOCATION' THEN 'LOC' WHEN 'ORGANIZATION' THEN 'ORG' ELSE h.entity_type END AS t,
  row_number() OVER (PARTITION BY w.id, w.ord ORDER BY w.pos) AS k FROM own_h w JOIN hit h ON h.id = w.id AND h.ord = w.ord),
h AS (SELECT o.id, o.pos, CASE WHEN l.t IS NULL THEN 'O' WHEN l.k = 1 THEN 'B-' || l.t ELSE 'I-' || l.t END AS tag FROM offs o LEFT JOIN lab_h l ON l.id = o.id AND l.pos = o.pos),
found AS (SELECT DISTINCT id FROM ({_REGEX_ONLY})),
p AS (SELECT id, pos, CASE WHEN list_contains({sql.listed(bio.HYBRID_TYPES)}, substr(tag, 3)) THEN tag ELSE 'O' END AS tag
  FROM (SELECT * FROM b WHERE id IN (SELECT id FROM found) UNION ALL SELECT * FROM h WHERE id NOT IN (SELECT id FROM found)))"""


def _every_entity(tags: str, name: str) -> str:
    return f"""f_{name} AS (SELECT *, substr(tag, 3) AS t, CASE WHEN tag = 'O' THEN 0 WHEN tag LIKE 'B-%' OR coalesce(lag(tag) OVER v, 'O') = 'O' OR substr(lag(tag) OVER v, 3) <> substr(tag, 3) THEN 1 ELSE 0 END AS opens FROM {tags} WINDOW v AS (PARTITION BY id ORDER BY pos)),
g_{name} AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY pos) AS n FROM f_{name}),
e_{name} AS (SELECT id, t, min(pos) AS a, max(pos) AS z FROM g_{name} WHERE tag <> 'O' GROUP BY id, n, t)"""


@query(
    "evaluation_run",
    f"""{_EVERY}, {_every_entity('a', 'x')}, {_every_entity('p', 'y')},
counts AS (SELECT coalesce(x.t, y.t) AS type, count_if(x.t IS NOT NULL AND y.t IS NOT NULL) AS tp, count_if(x.t IS NULL) AS fp, count_if(y.t IS NULL) AS fn FROM e_x x FULL JOIN e_y y ON x.id = y.id AND x.t = y.t AND x.a = y.a AND x.z = y.z GROUP BY 1),
per AS (SELECT type, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f, tp + fn AS s FROM counts),
rows AS (SELECT * FROM per UNION ALL {_MACRO}
  UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM per
  UNION ALL SELECT 'micro avg', sum(tp) / (sum(tp) + sum(fp)), sum(tp) / (sum(tp) + sum(fn)), 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), sum(tp) + sum(fn) FROM counts)
SELECT type, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(s AS BIGINT) AS support, (SELECT count(*) FROM ({fixtures.SAMPLES})) AS n_samples FROM rows""",
)
def evaluation_run(spark, sf_dir):
    found = metrics.evaluate(_aligned(spark, sf_dir), "truth", "predicted", bio.HYBRID_TYPES)
    return found.select("type", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support", "n_samples")


@query("latency_percentiles", "SELECT round(quantile_cont(value, 0.5), 2) AS p50_ms, round(quantile_cont(value, 0.95), 2) AS p95_ms, round(quantile_cont(value, 0.99), 2) AS p99_ms, round(avg(value), 2) AS mean_ms, round(max(value), 2) AS max_ms FROM events")
def latency_percentiles(spark, sf_dir):
    return metrics.latency(spark.read.parquet(f"{sf_dir}/events.parquet"), "value")


def _logits(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").alias("a"), F.reverse("embedding").alias("b"))


_PARITY = "SELECT round(max(d), 6) AS max_delta, round(avg(d), 6) AS mean_delta FROM (SELECT list_max(list_transform(range(1, len(embedding) + 1), lambda i: abs(CAST(embedding[i] AS DOUBLE) - CAST(embedding[len(embedding) + 1 - i] AS DOUBLE)))) AS d FROM embeddings)"


@query("logit_parity", _PARITY)
def logit_parity(spark, sf_dir):
    found = metrics.logit_parity(_logits(spark, sf_dir), "a", "b")
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query("gate_checks", f"SELECT max_delta < 0.0001 AS parity_ok, 120.5 <= 300 AS size_ok, 1.6 AS speed_up FROM ({_PARITY})")
def gate_checks(spark, sf_dir):
    found = metrics.logit_parity(_logits(spark, sf_dir), "a", "b")
    return found.select(*metrics.gates(F.col("max_delta"), F.lit(120.5), F.lit(32.0), F.lit(20.0)))


#: Exports of a model made from the events of one user each.
_EXPORTS = "SELECT user_id, CAST(count(*) * 20 AS DOUBLE) AS size_mb, max(value) AS slow_ms, min(CASE WHEN event_id % 11 = 0 THEN 0 ELSE value END) AS fast_ms FROM events GROUP BY user_id"


@query("gates_by_export", f"SELECT user_id, 0.00005 < 0.0001 AS parity_ok, size_mb <= 300 AS size_ok, CASE WHEN fast_ms > 0 THEN round(slow_ms / fast_ms, 4) END AS speed_up FROM ({_EXPORTS})")
def gates_by_export(spark, sf_dir):
    """Gates over one row a user, on both sides of each bound, a divisor of 0 among them."""
    parity, size, speed = metrics.gates(F.lit(0.00005), F.col("size_mb"), F.col("slow_ms"), F.col("fast_ms"))
    return fixture(spark, sf_dir, _EXPORTS).select("user_id", parity, size, F.round(speed, 4).alias("speed_up"))


@query("argmax_labels", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS predicted, label FROM embeddings WHERE label % 5 <> 0")
def argmax_labels(spark, sf_dir):
    df = _logits(spark, sf_dir)
    y = F.array(F.when(F.col("label") % 5 == 0, F.lit(-100)).otherwise(F.col("label")))
    return df.select("vec_id", F.explode(metrics.argmax_labels(F.array("a"), y)).alias("p")).select("vec_id", "p.predicted", "p.label")


_N = 500


@query("synth_samples", synth.texts_sql(_N, f"SELECT range AS id FROM range({_N})"))
def synth_samples(spark, sf_dir):
    return synth.generate(spark, _N).select("id", "family", "text")


@query("synth_mix", " UNION ALL ".join(f"SELECT '{k}' AS family, CAST({n} AS BIGINT) AS n" for k, n in synth.family_counts(_N).items()))
def synth_mix(spark, sf_dir):
    return synth.generate(spark, _N).groupBy("family").agg(F.count("*").alias("n"))


@query("label_tokens")
def label_tokens(spark, sf_dir):
    return synth.generate(spark, _N).select("id", F.array_join("tokens", " ").alias("tokens"), F.array_join("ner_tag_labels", " ").alias("tags"))


@query("synth_misaligned", "SELECT CAST(0 AS BIGINT) AS id WHERE false")
def synth_misaligned(spark, sf_dir):
    return synth.misaligned(synth.generate(spark, _N)).select("id")


@query("misaligned_samples", f"SELECT id FROM (SELECT range AS id FROM range({_N})) WHERE id % 7 = 3")
def misaligned_samples(spark, sf_dir):
    """The alignment check on samples of which every seventh has lost its last tag."""
    made = synth.generate(spark, _N)
    cut = F.when(F.col("id") % 7 == 3, F.slice("ner_tags", F.lit(1), F.size("ner_tags") - 1)).otherwise(F.col("ner_tags"))
    return synth.misaligned(made.withColumn("ner_tags", cut)).select("id")


@query("laplace_noise")
def laplace_noise(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", synth.laplace(1.0, 42).alias("noise"))


@query("file_checksum")
def file_checksum(spark, sf_dir):
    return files.checksums(spark, f"{sf_dir}/region.parquet")


@query(
    "conversation_token_numbering",
    _masked_sql(fixtures.SAMPLES) + ", f AS (SELECT id % 50 AS conv, entity_type, span, min(id * 10000 + start) AS first_at FROM tok GROUP BY ALL) "
    "SELECT conv, entity_type, span AS original, '[' || entity_type || '_' || row_number() OVER (PARTITION BY conv, entity_type ORDER BY first_at) || ']' AS token FROM f",
)
def conversation_token_numbering(spark, sf_dir):
    from pyspark.sql import Window

    found = redact.detect_entities(samples(spark, sf_dir)).select("id", F.explode_outer("entities").alias("e")).where("e IS NOT NULL")
    first = found.groupBy((F.col("id") % 50).alias("conv"), F.col("e.entity_type").alias("entity_type"), F.col("e.text").alias("original")).agg(F.min(F.struct("id", "e.start")).alias("at"))
    n = F.row_number().over(Window.partitionBy("conv", "entity_type").orderBy("at"))
    return first.select("conv", "entity_type", "original", F.concat(F.lit("["), "entity_type", F.lit("_"), n.cast("string"), F.lit("]")).alias("token"))


def _stream(df, name):
    """The rows of ``df`` as a file stream."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


@query("stream_delta_text", _DELTA)
def stream_delta_text(spark, sf_dir):
    stream = _stream(_bodies(spark, sf_dir), "bodies")
    return events.run_available(events.delta_text(stream).select("id", "delta"), "delta-text")


@query("stream_request_count", f"SELECT path, count(*) AS n FROM ({fixtures.REQUESTS}) GROUP BY path")
def stream_request_count(spark, sf_dir):
    return events.run_available(events.request_counts(_stream(_requests(spark, sf_dir), "requests")), "request-count", "complete")


@query("stream_unmask", f"SELECT id AS stream_id, text FROM ({fixtures.SAMPLES})")
def stream_unmask(spark, sf_dir):
    done = redact.redact(samples(spark, sf_dir)).select(F.col("id").alias("stream_id"), "masked_text", "mapping")
    size = 7
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("masked_text") - 1) / size)), lambda i: F.substring(F.col("masked_text"), (i * size + 1).cast("int"), F.lit(size)))
    deltas = done.select("stream_id", F.size(pieces).alias("n"), F.posexplode(pieces).alias("seq", "delta")).select("stream_id", "seq", "delta", (F.col("seq") == F.col("n") - 1).alias("done"))
    out = events.run_available(events.unmask(_stream(deltas, "deltas"), done.select("stream_id", "mapping")), "unmask")
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return out.groupBy("stream_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


@query("stream_rate_limit")
def stream_rate_limit(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").cast("double").alias("ts"))
    return events.run_available(events.rate_limit(_stream(log, "log"), rate=1 / 3600, burst=5.0), "rate-limit")


@query("documents_by_type", f"WITH RECURSIVE {_DETECTED} SELECT entity_type, count(*) AS n, round(avg(score), 4) AS mean_score FROM merged GROUP BY entity_type")
def documents_by_type(spark, sf_dir):
    """Entities of whole documents by type, with the mean score; a report over the corpus."""
    found = redact.detect_entities(documents(spark, sf_dir)).select(F.explode_outer("entities").alias("e")).where("e IS NOT NULL")
    return found.groupBy("e.entity_type").agg(F.count("*").alias("n"), F.round(F.avg("e.score"), 4).alias("mean_score"))
