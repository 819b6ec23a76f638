"""Quality scores by Bradley-Terry ranking of labelled documents.

A document's score is linear in features of its whole text.  The model is learnt from pairs
of a good and a bad document by logistic loss on the difference of their features (Newton
steps, ridge penalty); it never sees a document alone.  The cut lies at a quantile of the
training scores, the share of bad labels, and the score shown is the logistic function of the
distance to it, moved so that the cut shows as 0.3.

The fit uses a bounded sample: at most ``FIT_ROWS`` labelled rows (smallest hashes of doc_id)
whose crc32(doc_id as text) mod 5 is not 0, and at most ``FIT_PAIRS`` pairs.  Scoring covers
all rows in one pass and needs nothing but the text.

Defined results: null and empty texts have zero features and a score like all others; rows
are scored each on its own, null doc_ids included (not held out); a doc_id with several labels
counts once with its lowest; other columns are not read.  Without two classes
among the labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal
from .quality import Features

FIT_ROWS = 20_000
FIT_PAIRS = 200_000
SHOWN_CUT = 0.3
_COUNTED = [b"#*$%&", b"|<>", b"!?", b".,;:", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"@/\\_=+~^", b"\"'()[]{}", b"-"]
_DROPS = [bytes(b for b in range(256) if b not in kind) for kind in _COUNTED]
N_FEATURES = len(_COUNTED) + 13


def features(text: str | None) -> list[float]:
    """Shares and logs of counts over the whole text, all bounded."""
    f = Features(text)
    n, chars = max(f.n_words, 1), max(f.word_chars, 1)
    out = [min(len(f.data.translate(None, drop)) / n, 4.0) for drop in _DROPS]
    distinct = f.n_distinct
    lines = max(f.n_lines, 1)
    repeat = f.n_repeat_words / n
    mean = f.word_chars / n
    out += [
        np.log1p(f.n_words) / 10, 1.0 if f.n_words < 10 else 0.0, 1.0 if f.n_words < 25 else 0.0,
        distinct / n, repeat, 1.0 if repeat > 0.2 else 0.0,
        f.n_dup_lines / lines, min(mean / 10, 3.0), abs(mean - 5) / 10 if mean < 30 else 2.5,
        min(f.n_lines / n, 1.0), (len(f.data) - len(f.data.translate(None, bytes(range(128, 256))))) / (len(f.data) or 1),
        min(f.longest / 100, 3.0), min(f.n_shouts / n, 2.0),
    ]
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=[batch.schema.names[0], "x"])


@dataclass(frozen=True)
class Ranking:
    """score = sigmoid(weights . (x - mean) / scale - cut), moved to show the cut as 0.3."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.cut + np.log(SHOWN_CUT / (1 - SHOWN_CUT))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = FIT_PAIRS, ridge: float = 1e-3) -> Ranking:
    """Bradley-Terry weights from pairs drawn evenly over both classes."""
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    a, b = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    w = np.zeros(x.shape[1] if x.ndim == 2 else N_FEATURES)
    if not len(a) or not len(b):
        return Ranking(mean, scale, w, float(np.log(SHOWN_CUT / (1 - SHOWN_CUT))))
    rng = np.random.default_rng(7)
    n = min(pairs, len(a) * len(b))
    d = z[a[rng.permutation(n) % len(a)]] - z[b[rng.permutation(n) % len(b)]]
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -60, 60)))  # chance that the pair is ranked wrong
        gradient = d.T @ p / n - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    # Bad documents make this share of the sample; the cut is midway to the next score.
    k = len(b)
    by = np.sort(raw)
    cut = (by[k - 1] + by[min(k, len(by) - 1)]) / 2
    return Ranking(mean, scale, w, float(cut))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Ranking:
    marks = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    marks = marks.groupBy(F.col(doc_id).cast("long").alias("_id")).agg(F.min(label).alias("_label"))
    marks = marks.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # At most FIT_ROWS rows of 12 bytes are broadcast.
    chosen = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(marks.select("_id")), "_id", "left_semi")
    found = chosen.mapInArrow(frugal(_featured), "_id long, x array<double>").join(F.broadcast(marks), "_id").select("_id", "x", "_label").orderBy("_id", "x").limit(rows).collect()
    x = np.array([r["x"] for r in found], dtype=float).reshape(len(found), N_FEATURES)
    return fit(x, np.array([r["_label"] for r in found], dtype=int))


def score(df: DataFrame, model: Ranking, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``df`` and ``_score``, which takes the place of such a column."""
    keep = tuple(c for c in keep if c != "_score")

    n = len(keep)
    at = keep.index(text) if text in keep else n  # the text travels once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column(at).to_pylist()]
            s = model.score(np.array(x, dtype=float).reshape(len(x), N_FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(s, pa.float64())], names=[*batch.schema.names[:n], "_score"])

    read = keep if at < n else (*keep, text)
    source = df.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(read)))
    schema = ", ".join([*(f"_k{i} {source.schema[f'_k{i}'].dataType.simpleString()}" for i in range(n)), "_score double"])
    return source.mapInArrow(frugal(run), schema).select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "_score")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, ("doc_id",))
    doc = F.col("doc_id").cast("long")
    return out.select(doc.alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= SHOWN_CUT).cast("int").alias("predicted"))
