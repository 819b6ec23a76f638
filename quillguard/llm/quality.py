"""Quality rules as a short-circuit cascade ordered by rejection per cost.

A rule is a predicate over lazily computed text features; a feature is computed at most once
for a text and only when a rule (or the caller's report) asks for it.  On a bounded sample
every rule runs alone, which gives its CPU cost and its rejection rate; the cascade then runs
rules in the order of rejections per second, and a text leaves at its first failed rule.
The verdict is the conjunction of the rules, so it does not depend on the order; only the
work does.

Defined results: a null or empty text has no words, no symbols and fails ``few_words``;
repeated rows are judged alike, each on its own; rows with a null id are judged too; other
columns are not read.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal
from .hashing import pieces, window_hashes, word_hashes

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOLS)
#: Every ASCII byte, lead byte of UTF-8 included: what remains when spaces and
#: continuation bytes go counts the code points in words.
_NOT_COUNTED = _SPACES + bytes(range(0x80, 0xC0))

#: Rows whose rules are timed; the order of the cascade, and nothing else, depends on it.
SAMPLE_ROWS = 400


class Features:
    """Features of one whole text, each computed on first use."""

    def __init__(self, text: str | None):
        self.data = (text or "").encode("utf-8", "surrogatepass")

    def __getattr__(self, name: str):
        value = getattr(type(self), f"_{name}")(self)
        setattr(self, name, value)
        return value

    def _hashes(self) -> np.ndarray:
        return word_hashes(self.data)

    def _n_words(self) -> int:
        return len(self.hashes)

    def _n_distinct(self) -> int:
        return len(np.unique(self.hashes))

    def _longest(self) -> int:
        """Bytes of the longest word."""
        return max((len(w) for piece in pieces(self.data) for w in piece.split()), default=0)

    def _word_chars(self) -> int:
        return len(self.data.translate(None, _NOT_COUNTED))

    def _n_symbols(self) -> int:
        return len(self.data.translate(None, _NOT_SYMBOL))

    def _n_shouts(self) -> int:
        return self.data.count(b"!!")

    def _lines(self) -> tuple[int, int]:
        """Lines with a word, and those of them that equal an earlier one.

        Lines are told apart by 128 bits of BLAKE2, so long texts need no copy of them."""
        n, seen = 0, set()
        for line in re.finditer(rb"[^\n]+", self.data):
            a, b = line.span()
            if self.data[a:b].strip(_SPACES):
                n += 1
                seen.add(self.data[a:b] if b - a <= 16 else blake2b(self.data[a:b], digest_size=16).digest())
        return n, n - len(seen)

    def _n_lines(self) -> int:
        return self.lines[0]

    def _n_dup_lines(self) -> int:
        return self.lines[1]

    def _n_repeat_words(self) -> int:
        """Words in windows of five found twice or more, first included; windows are told apart
        by 64-bit hashes."""
        windows = window_hashes(self.hashes, 5)
        order = np.argsort(windows, kind="stable")
        windows = windows[order]
        same = windows[1:] == windows[:-1]
        if not same.any():
            return 0
        twice = np.r_[same, False]
        twice[1:] |= same
        at = np.sort(order[twice])
        return int(np.minimum(np.diff(at, append=at[-1] + 5), 5).sum())


@dataclass(frozen=True)
class Rule:
    """``fails(features)`` is true for a text that the rule rejects."""

    name: str
    fails: Callable[[Features], bool]


#: The base of the contract.
FEW_WORDS = Rule("few_words", lambda f: f.n_words < 10)
REPEATED_WORDS = Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 20 * f.n_words)
#: The method's own rules, all in integers so that any engine gives the same verdict.
SYMBOLS = Rule("symbols", lambda f: 10 * f.n_symbols > 3 * f.n_words)
SHOUTS = Rule("shouts", lambda f: 10 * f.n_shouts > 3 * f.n_words)
DUP_LINES = Rule("dup_lines", lambda f: 10 * f.n_dup_lines > 5 * f.n_lines)
LONG_WORDS = Rule("long_words", lambda f: f.word_chars > 25 * f.n_words)
RULES = (FEW_WORDS, REPEATED_WORDS, SYMBOLS, SHOUTS, DUP_LINES, LONG_WORDS)
BASE = ("few_words", "repeated_words")
REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) of each rule, run alone on a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            out = []
            for rule in rules:
                at = time.thread_time()
                failed = sum(rule.fails(Features(t)) for t in texts)
                out.append((rule.name, time.thread_time() - at, failed, len(texts)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["rule", "cost", "failed", "seen"])

    measured = df.select(text).limit(rows).mapInArrow(frugal(run), "rule string, cost double, failed long, seen long")
    found = measured.groupBy("rule").agg(F.sum("cost"), F.sum("failed"), F.sum("seen")).collect()
    return [(r, c / max(n, 1), f / max(n, 1)) for r, c, f, n in found]


def plan(measured: list[tuple[str, float, float]], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by descending rejection per cost; unmeasured ones keep their place at the end."""
    gain = {name: share / max(cost, 1e-9) for name, cost, share in measured}
    return tuple(sorted(rules, key=lambda r: -gain.get(r.name, -1.0)))


def cascade(df: DataFrame, order: tuple[Rule, ...], keep: tuple[str, ...] = (), text: str = "text", report: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of ``df``, the features in ``report`` (long), ``rejected_by`` (the
    rule at which the text left, null if kept), ``rules_run`` and ``kept``."""
    names = (*report, "rejected_by", "rules_run", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for t in batch.column(batch.num_columns - 1).to_pylist():
                f = Features(t)
                by, ran = None, 0
                for rule in order:
                    ran += 1
                    if rule.fails(f):
                        by = rule.name
                        break
                for c, v in zip(out, (*(getattr(f, r) for r in report), by, ran, by is None)):
                    c.append(v)
            kinds = [*[pa.int64()] * len(report), pa.string(), pa.int32(), pa.bool_()]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(c, k) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=[*(f"_k{i}" for i in range(len(keep))), *names])

    source = df.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text).alias("_text"))
    kept_types = [f"_k{i} {source.schema[f'_k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    schema = ", ".join([*kept_types, *(f"{r} long" for r in report), "rejected_by string, rules_run int, kept boolean"])
    out = source.mapInArrow(frugal(run), schema)
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *names)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    order = plan(measure(docs))
    out = cascade(docs, order, keep=("doc_id",), report=REPORT)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select(F.col("doc_id").cast("long"), *REPORT, failed.alias("base_failed"), "kept")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, i + unnest(range(5)) AS j FROM r) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l.l) - len(list_distinct(l.l)) AS n_dup_lines,
  len(l.l) AS n_lines, coalesce(p.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '!!')) AS n_shouts
  FROM w JOIN l USING (doc_id) LEFT JOIN p USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words
    OR 10 * n_shouts > 3 * n_words OR 10 * n_dup_lines > 5 * n_lines OR word_chars > 25 * n_words) AS kept
FROM s
"""
