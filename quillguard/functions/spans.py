"""Detectors: a text column to an array of spans with code point offsets, JVM-side.

Neither ``regexp_extract_all`` nor ``split`` gives offsets, but the lengths of the pieces
between matches do: their running sum is where each match begins.  Each of the two is evaluated
once per text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DetectorConfig
from ..schemas import SPANS, span
from . import patterns as P
from .arrays import let, running_sum
from .context import context_score

_FOUND = "array<struct<start:int,end:int,text:string>>"
_DIGIT = r"\p{Nd}"

#: What a text must hold before a costly pattern is tried.
_HINTS = {
    "SSN_DASHED": lambda t: t.rlike(r"\p{Nd}-\p{Nd}"),
    "SSN_PLAIN": lambda t: t.rlike(r"\p{Nd}{9}"),
    "PHONE": lambda t: t.contains("+") | t.contains("("),
    "EMAIL": lambda t: t.contains("@"),
    "MRN": lambda t: F.upper(t).contains("MRN-"),
    "DOB": lambda t: t.rlike(r"\p{Nd}[-/]\p{Nd}"),
    "CREDIT_CARD": lambda t: t.rlike(r"\p{Nd}{4}"),
    "IPV4": lambda t: t.rlike(r"\p{Nd}\.\p{Nd}"),
    "IPV6": lambda t: t.contains("::") | t.rlike("[0-9a-fA-F]:[0-9a-fA-F]{1,4}:"),
    "PASSPORT": lambda t: t.rlike(r"[A-Z]\p{Nd}{8}"),
}


def find_all(text: Column, pattern: str) -> Column:
    """All leftmost matches of a pattern that cannot match the empty string."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))

    def placed(pairs: Column) -> Column:
        # The last piece has no match after it.
        before = running_sum(F.transform(pairs, lambda z: F.length(z["g"]) + F.coalesce(F.length(z["m"]), F.lit(0))))
        found = F.zip_with(pairs, before, lambda z, at: F.struct((at + F.length(z["g"])).alias("start"), (at + F.length(z["g"]) + F.length(z["m"])).alias("end"), z["m"].alias("text")))
        return F.filter(found, lambda m: m["text"].isNotNull())

    return let(pairs, placed)


def valid_ssn(area: Column, group: Column, serial: Column) -> Column:
    return (area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0)


def _valid_digits(digits: Column) -> Column:
    part = lambda a, n: F.substring(digits, a, n).cast("int")
    return valid_ssn(part(1, 3), part(4, 2), part(6, 4))


def candidates(text: Column, kind: str) -> Column:
    """Matches of one detector before context scoring."""
    found = F.when(_HINTS[kind](text), find_all(text, P.JAVA[kind])).otherwise(F.array().cast(_FOUND))
    if kind.startswith("SSN"):
        found = F.filter(found, lambda m: _valid_digits(F.replace(m["text"], F.lit("-"), F.lit(""))))
    return found


def detect(text: Column, kind: str, config: DetectorConfig = DetectorConfig()) -> Column:
    """Spans of one detector."""
    c = config
    fixed = {"SSN_DASHED": c.ssn_dashed, "PHONE": c.phone, "EMAIL": c.email, "MRN": c.mrn, "IPV4": c.ipv4, "IPV6": c.ipv6, "PASSPORT": c.passport}
    made = lambda m, score: span(m["text"], F.lit(P.ENTITY[kind]), m["start"], m["end"], score, F.lit("regex"))
    found = candidates(text, kind)
    if kind in fixed:
        return F.transform(found, lambda m: made(m, F.lit(fixed[kind])))
    threshold = {"SSN_PLAIN": c.ssn_threshold, "DOB": c.dob_threshold, "CREDIT_CARD": c.card_threshold}[kind]

    def scored(m: Column) -> Column:
        score = F.round(context_score(text, m["start"], m["end"], kind, c), 4)
        if kind == "CREDIT_CARD":  # separated groups need no context
            score = F.when(F.length(m["text"]) > 16, F.lit(c.card_dashed)).otherwise(score)
        return made(m, score)

    return F.filter(F.transform(found, scored), lambda s: s["score"] >= threshold)


def detect_all(text: Column, config: DetectorConfig = DetectorConfig()) -> Column:
    """Spans of all detectors in their order, in one projection."""
    text = F.coalesce(text, F.lit(""))
    found = [detect(text, k, config) for k in P.ORDER]
    # A plain number that starts inside a dashed one is not taken again.
    plain = F.transform(F.array(F.struct(found[0].alias("dashed"), found[1].alias("plain"))), lambda z: F.filter(z["plain"], lambda s: ~F.exists(z["dashed"], lambda d: (d["start"] <= s["start"]) & (s["start"] < d["end"]))))
    both = F.concat(found[0], F.flatten(plain))
    return F.concat(both, *found[2:]).cast(SPANS)
