"""The pipeline's stages keep their contracts, on real and on odd rows."""

import hashlib
import random
import struct

import duckdb
import numpy as np
import pytest
import test_operators as plain
from tokenizers import Tokenizer

import corpus_pipeline
from quillguard.llm import bpe, classifier, queries
from quillguard.llm.common import Scratch

TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch, before = Scratch(spark, "t"), docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = scratch.table(stage(spark, before, sf), f"s{k}")
        if k < 4:
            assert after.columns == docs.columns, name
            assert after.schema == docs.schema or after.dtypes == docs.dtypes, name
        assert 0 < after.count() <= before.count()
        if name in ("substring dedup", "mixing sources", "BPE encoding"):
            assert after.count() == before.count()
        before = after
    assert set(before.columns) == {"doc_id", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256"}


def test_stages_on_odd_rows_and_none(spark, sf):
    made = [(1, "a b c d e f g h i j k l m n o p", "en", "s", 1, "x"), (1, "a b c d e f g h i j k l m n o p", "en", "s", 1, "x"), (2, None, None, None, None, None), (None, "", "en", "s", 1, "x"), (3, "w " * 30, "en", None, 1, "x")]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, _kept string")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).collect()
        assert stage(spark, docs.where("false"), sf).count() == 0, name
    near = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert sorted(str(r["doc_id"]) for r in near.collect()) == ["1", "2", "3", "None"]
    assert corpus_pipeline.mixture(spark, docs, sf).count() == 5


def test_near_duplicates_keep_other_texts_of_a_doc_id(spark, sf):
    a, b, c, d = (" ".join(f"{k}{n}" for n in range(30)) for k in "abcd")
    made = [(0, a), (1, a), (1, b), (2, c), (2, d), (2, c), (3, None), (3, None), (None, a)]
    near = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(made, "doc_id long, text string"), sf)
    assert sorted(map(str, (tuple(r) for r in near.collect()))) == sorted(map(str, [(0, a), (1, b), (2, c), (2, d), (3, None), (None, a)]))


def test_pipeline_against_plain_versions(spark, tmp_path):
    """All five stages in plain Python over documents made here; the fit alone is taken over."""
    rnd = random.Random(11)
    shared = plain.prose(500, 40)
    made = []
    for i in range(60):
        text = plain.prose(600 + i // 3, 80).split()
        if i % 3:
            text[rnd.randrange(80)] = f"own{i}"
        if i % 4 == 0:
            text[20:20] = shared.split()
        if i % 5 == 0:
            text = ["#", "$"] * 3 + text[:6]
        made.append((i, " ".join(text), "en", "abc"[i % 3], 0))
    made += [(60, None, "en", "a", 0), (61, "", "en", None, 0)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"
    model = classifier.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(i, t) for i, t, *_ in made if model.score(np.array([classifier.features(t)]))[0] >= classifier.SHOWN_CUT]
    assert 30 < len(rows) < 60
    comp = plain.components(rows, 5, 80, 100)
    scored, rows = len(rows), [(i, t) for i, t in rows if comp[i] == i]
    assert len(rows) < scored - 5
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = plain.words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    library = Tokenizer.from_file(bpe.word_bpe_path())
    want, cut = {}, 0
    for i, t in rows:
        w, gone = plain.words(t), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        cut += bool(gone)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else t or ""
        ids = library.encode(kept, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
    assert cut > 3
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [tuple(r) for r in got.select(*cols).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want.project(", ".join(cols)).fetchall()))
