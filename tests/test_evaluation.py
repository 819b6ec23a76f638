"""Labels and scores of every sample, those without a pattern hit among them; counts over documents."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillguard.operators import bio, redact
from quillguard.plans import catalogue, fixtures
from quillguard.plans.detection import fixture, samples


@pytest.fixture(scope="module")
def unfound(spark, sf):
    """Words and model hits, unmerged and in order, of samples without a pattern hit."""
    found = redact.detect_entities(samples(spark, sf)).where(F.size("entities") == 0).collect()
    hits = {}
    for h in sorted(fixture(spark, sf, fixtures.HITS).where("score >= 0.9").collect(), key=lambda h: h["n"]):
        hits.setdefault(h["id"], []).append((h["start"], h["stop"], h["entity_group"]))
    return {r["id"]: (r["text"].split(" "), hits.get(r["id"], [])) for r in found}


def tagged(words, hits):
    tags = ["O"] * len(words)
    for start, stop, label in hits:
        at, first = 0, True
        for k, w in enumerate(words):
            if at < stop and at + len(w) > start and tags[k] == "O":
                tags[k], first = ("B-" if first else "I-") + label, False
            at += len(w) + 1
    return tags


def entities(tags):
    out, last = [], None
    for k, t in enumerate(tags):
        kind = None if t == "O" else t[2:]
        if kind and t[0] == "I" and kind == last:
            out[-1] = (kind, out[-1][1], k)
        elif kind:
            out.append((kind, k, k))
        last = kind
    return set(out)


def test_labels_of_samples_without_a_pattern_hit(spark, sf, unfound):
    want = {i: tagged(*x) for i, x in unfound.items()}
    assert any(set(t) != {"O"} for t in want.values())
    rows = {name: {r["id"]: r for r in catalogue.QUERIES[name](spark, sf).collect()} for name in ("align_bio", "filter_tags_model", "filter_tags_hybrid", "tag_ids", "subword_labels")}
    n = samples(spark, sf).count()
    assert all(len(found) == n for found in rows.values())
    for i, tags in want.items():
        kept = [t if t[2:] in bio.MODEL_TYPES else "O" for t in tags]
        assert rows["align_bio"][i]["predicted"] == " ".join(tags)
        assert set(rows["align_bio"][i]["truth"].split(" ")) == {"O"}
        assert rows["filter_tags_model"][i]["tags"] == rows["filter_tags_hybrid"][i]["tags"] == " ".join(kept)
        assert rows["tag_ids"][i]["ids"] == " ".join(str(bio.LABELS.index(t) if t in bio.LABELS else 0) for t in tags)
        ys = []
        for w, t in zip(unfound[i][0], kept):
            y = bio.MODEL_LABELS.index(t)
            ys += [y, y + y % 2] if len(w) >= 4 else [y]
        assert rows["subword_labels"][i]["labels"] == " ".join(map(str, [-100, *ys, -100]))


def test_scores_count_false_positives_of_every_sample(spark, sf, unfound):
    tp, fp, fn = Counter(), Counter(), Counter()
    pairs = [(r["truth"].split(" "), r["predicted"].split(" ")) for r in catalogue.QUERIES["align_bio"](spark, sf).collect() if r["id"] not in unfound]
    for truth, predicted in pairs + [(["O"], tagged(*x)) for x in unfound.values()]:
        a, b = entities(truth), entities(predicted)
        tp.update(e[0] for e in a & b)
        fp.update(e[0] for e in b - a)
        fn.update(e[0] for e in a - b)
    report = {r["type"]: r for r in catalogue.QUERIES["ner_report"](spark, sf).collect()}
    n = sum(tp.values())
    assert report["micro avg"]["precision"] == pytest.approx(n / (n + sum(fp.values())), abs=1e-6)
    assert report["micro avg"]["support"] == n + sum(fn.values())
    types = set(tp) | set(fp) | set(fn)
    macro = sum(tp[t] / (tp[t] + fp[t]) if tp[t] + fp[t] else 0 for t in types) / len(types)
    assert catalogue.QUERIES["ner_f1"](spark, sf).first()["macro_precision"] == pytest.approx(macro, abs=1e-6)


def test_entity_counts_are_over_documents(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = dict(con.sql(f"SELECT entity_type, count(*) FROM ({catalogue.ORACLE_SQL['detect_all_documents']}) GROUP BY 1").fetchall())
    assert dict(map(tuple, catalogue.QUERIES["entity_counts"](spark, sf).collect())) == want
    assert dict(map(tuple, catalogue.QUERIES["entity_counts_rollup"](spark, sf).collect())) == want | {"TOTAL": sum(want.values())}
