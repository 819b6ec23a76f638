"""Running values, cuts of long texts, exact percentiles, and redaction of a long text."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillguard.functions import arrays
from quillguard.operators import metrics, redact
from quillguard.schemas import SPANS


@pytest.mark.parametrize("n", [0, 1, 32, 33, 1024, 1025, 40_000])
def test_running_values(spark, n):
    values = [random.Random(n).randrange(100) for _ in range(n)]
    row = spark.createDataFrame([(values,)], "v array<int>").select(arrays.running_sum(F.col("v")).alias("s"), arrays.running_max(F.col("v")).alias("m")).first()
    assert row["s"] == np.cumsum([0, *values])[:-1].tolist()
    assert row["m"] == np.maximum.accumulate([-1, *values])[:-1].tolist()


@pytest.mark.parametrize("n", [0, 10, 4096, 4097, 300_000])
def test_pieces_of_a_text(spark, n):
    rnd = random.Random(n)
    text = "".join(rnd.choice("ab \U0001f600é") for _ in range(n))
    cuts = sorted({0, n, *(rnd.randrange(n + 1) for _ in range(50))})
    places = list(zip(cuts, cuts[1:])) + [(0, n), (n, n)]
    df = spark.createDataFrame([(text, places)], "t string, p array<struct<start:int,end:int>>")
    got = df.select(arrays.pieces(F.col("t"), F.col("p"), lambda p, part: part).alias("x")).first()["x"]
    assert got == [text[a:b] for a, b in places]


@pytest.mark.parametrize("values", [[], [None], [2.5], [1.0, 9.0], [3.0] * 500 + [float(k) for k in range(301)] + [None, -4.5]])
def test_percentiles(spark, values):
    shares = (0.0, 0.5, 0.95, 0.99, 1.0)
    got = metrics.percentiles(spark.createDataFrame([(v,) for v in values], "v double").repartition(3), "v", shares)
    held = [v for v in values if v is not None]
    assert got == ([None] * 5 if not held else pytest.approx([np.quantile(held, s) for s in shares]))


def test_redaction_of_a_long_text(spark):
    text = " ".join(f"né {k} u{k}@example.org \U0001f600." if k % 3 else f"plain {k}." for k in range(3000))
    out = redact.redact(spark.createDataFrame([(text,)], "text string")).first()
    found = [f"u{k}@example.org" for k in range(3000) if k % 3]
    assert [e["text"] for e in out["entities"]] == found
    assert [text[e["start"] : e["end"]] for e in out["entities"]] == found
    want = text
    for n, mail in enumerate(found):
        want = want.replace(f" {mail} ", f" [EMAIL_{len(found) - n}] ", 1)
    assert out["masked_text"] == want


def test_numbers_of_spans_in_any_order(spark):
    span = lambda kind, start: ("t", kind, start, start + 1, 0.9, "", "bert")
    spans = [span("PERSON", 9), span("MISC", 4), span("PERSON", 4), span("PERSON", 9), span("PERSON", 1)]
    got = spark.createDataFrame([(spans,)], f"e {SPANS}").select(redact.numbered(F.col("e")).alias("e")).first()["e"]
    assert [e["token"] for e in got] == ["[PERSON_2]", "[MISC_1]", "[PERSON_3]", "[PERSON_2]", "[PERSON_4]"]


def test_evaluation_counts_every_sample(spark):
    made = [(1, ["B-PER", "O"], ["B-PER", "B-SSN"]), (2, ["O"], ["O"]), (3, ["B-SSN"], ["O"])]
    df = spark.createDataFrame(made, "id int, t array<string>, p array<string>")
    got = {r["type"]: r for r in metrics.evaluate(df, "t", "p", ("PER",)).collect()}
    assert got["PER"]["f1"] == 1 and got["SSN"]["recall"] == 0 and got["micro avg"]["precision"] == 1
    assert {r["n_samples"] for r in got.values()} == {3}
