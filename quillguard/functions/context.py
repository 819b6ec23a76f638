"""Scores of ambiguous numbers from the words around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DetectorConfig
from . import patterns as P

#: Triggers, weight; bigrams, weight; negatives, weight (fixed values).
RULES = {
    "SSN_PLAIN": (P.SSN_TRIGGERS, 0.35, P.SSN_BIGRAMS, 0.20, P.SSN_NEGATIVES, 0.35),
    "DOB": (P.DOB_TRIGGERS, 0.40, P.DOB_BIGRAMS, 0.10, P.DOB_NEGATIVES, 0.35),
    "CREDIT_CARD": (P.CARD_TRIGGERS, 0.45, [], 0.0, P.CARD_NEGATIVES, 0.35),
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def context_words(text: Column, start: Column, end: Column, window: int = 10) -> Column:
    """The last words before a match and the first after it, lower case, stripped."""

    def words(part: Column) -> Column:
        return F.filter(F.split(F.lower(part), P.SPACES), lambda w: w != "")

    before = _let(words(F.substring(text, F.lit(1), start)), lambda w: F.slice(w, F.greatest(F.size(w) - F.lit(window - 1), F.lit(1)), F.lit(window)))
    after = F.slice(words(F.substring(text, end + 1, F.length(text))), 1, window)
    return F.transform(F.concat(before, after), lambda w: F.btrim(w, F.lit(P.STRIP)))


def bigrams(words: Column) -> Column:
    return F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))


def context_score(text: Column, start: Column, end: Column, kind: str, config: DetectorConfig = DetectorConfig()) -> Column:
    triggers, up, pairs, more, negatives, down = RULES[kind]
    base = {"SSN_PLAIN": config.ssn_base, "DOB": config.dob_base, "CREDIT_CARD": config.card_base}[kind]
    listed = lambda ws: F.array(*map(F.lit, ws))
    gain = lambda hit, by: F.when(F.coalesce(hit, F.lit(False)), F.lit(by)).otherwise(F.lit(0.0))

    def score(words: Column) -> Column:
        total = F.lit(base) + gain(F.arrays_overlap(words, listed(triggers)), up)
        if pairs:
            total = total + gain(F.exists(bigrams(words), lambda b: b.isin(pairs)), more)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total - gain(F.arrays_overlap(words, listed(negatives)), down)))

    return _let(context_words(text, start, end, config.window), score)
