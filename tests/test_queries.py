"""Registered queries against their SQL, labels, files and settings."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from quillguard import config
from quillguard.operators import bio, grammar, metrics, ner, synth
from quillguard.plans import catalogue
from quillguard.sources import files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split()
FEW = ["redact_documents", "merge_spans", "hybrid_detect", "chunk_counts", "request_text", "response_text", "delta_text", "align_bio", "ner_report", "latency_percentiles", "safe_view", "stream_unmask", "stream_request_count", "conversation_token_numbering", "synth_samples", "evaluation_run", "documents_by_type", "gates_by_export", "misaligned_samples"]
FEW += ["label_corpus", "samples_file", "training_file", "labels_every_sample", "adapter_needed", "token_lookup", "latency_histogram", "run_comparison", "run_summary", "bundle_files"]


@pytest.mark.parametrize("name", FEW)
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.sql(catalogue.ORACLE_SQL[name]).project(", ".join(cols)).fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want))


def test_subword_labels(spark):
    df = spark.createDataFrame([([None, 0, 0, 1, 2, 2, None], [1, 0, 6])], "w array<int>, y array<int>")
    assert df.select(bio.subword_labels(F.col("w"), F.col("y"))).first()[0] == [-100, 1, 2, 0, 6, 6, -100]


def test_samples_round_trip(spark, tmp_path):
    made = synth.generate(spark, 40)
    assert made.count() == 40 and synth.misaligned(made).count() == 0
    files.write_samples(made, f"file://{tmp_path}/s")
    assert files.read_samples(spark, f"file://{tmp_path}/s").count() == 40
    assert files.read_training(spark, f"file://{tmp_path}/s").where(F.array_max("ner_tags") > 8).count() == 0


def test_model_provider_over_chunks(spark):
    text = "x. " * 600 + "Ada met Bob."

    def load():
        return lambda texts: [[{"word": "Ada", "entity_group": "PER", "score": 0.95, "start": t.index("Ada"), "end": t.index("Ada") + 3}] if "Ada" in t else [] for t in texts]

    got = ner.detect_with_model(spark.createDataFrame([(1, text)], "id long, text string"), load).first()["spans"]
    assert [(s["start"], s["end"], s["entity_type"]) for s in got] == [(1800, 1803, "PERSON")]


def test_provider_gets_the_configuration(spark):
    def load(config):
        return lambda texts: [[{"word": config.device, "entity_group": "PER", "score": 1.0, "start": 0, "end": 1}] for _ in texts]

    found = ner.detect_with_model(spark.createDataFrame([(1, "x")], "id long, text string"), load, config=config.EngineConfig(device="gpu")).first()["spans"]
    assert [s["text"] for s in found] == ["gpu"]


def test_a_run_is_saved_under_its_name(spark, tmp_path):
    run = spark.sql("SELECT 'org/m' AS model, timestamp'2026-01-02 03:04:05' AS at, named_struct('macro_f1', 0.5) AS metrics")
    path = files.save_results(run, f"file://{tmp_path}")
    assert path.endswith("/org_m_20260102_030405.json")
    body = (tmp_path / "org_m_20260102_030405.json").read_text()
    assert json.loads(body)["metrics"] == {"macro_f1": 0.5} and body.startswith('{\n  "model"') and body.endswith("}\n")


def test_histogram_of_nulls_and_nothing(spark):
    rows = lambda df: [tuple(r) for r in metrics.histogram(df, "v", (1.0, 2.0)).collect()]
    df = spark.createDataFrame([(1.0,), (2.5,), (None,)], "v double")
    assert rows(df) == [(1.0, 1), (2.0, 1), (None, 2)]
    assert rows(df.where("false")) == [(1.0, 0), (2.0, 0), (None, 0)]


def test_grammar_shares(spark):
    made = grammar.labelled_corpus(spark, 1000)
    by = {r[0]: r[1] for r in made.groupBy("family").count().collect()}
    assert by == {"enterprise": 400, "clinical": 250, "financial": 150, "identity": 100, "negative": 100}
    assert made.where("family = 'enterprise' AND text RLIKE '[0-9]{9}'").count() == 160
    shapes = made.select(F.regexp_replace("text", "[0-9]+", "0").alias("t"), "family")
    assert shapes.where("family = 'negative' AND array_contains(split(t, ' '), 'SSN')").count() == 0
    assert synth.misaligned(made).count() == 0 and grammar.labelled_corpus(spark, 0).count() == 0


def test_settings(tmp_path):
    assert config.load_service_config(str(tmp_path / "none.toml")) == config.ServiceConfig()
    (tmp_path / "a.toml").write_text('upstream_url = "http://u"\ndisabled_entities = ["SSN"]\n')
    assert config.load_service_config(str(tmp_path / "a.toml")).disabled_entities == ("SSN",)
    with pytest.raises(RuntimeError):
        config.model_environment(env={})
