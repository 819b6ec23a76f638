"""Detection, context, merge, redaction and chunking against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from quillguard.functions import patterns as P
from quillguard.functions.spans import detect, detect_all
from quillguard.operators import chunk, merge, redact
from quillguard.schemas import SPANS

NASTY = [
    "SSN on file: 123-45-6789.", "SSN: 666-45-6789", "SSN: 123-00-6789", "Field SSN_123-45-6789 in", "SSN:123-45-6789", "my SSN is 123456789, see W-2.", "Call at 941555012 to confirm", "123456789",
    "Patient SS# 789012345 needs identity verification.", "DOB: 03/15/1990 on record", "born 2190-01-31", "Date: 13/40/1990", "born filed 03/15/1990", "Card: 1234-5678 9012-3456", "Visa 1234567890123456 on file",
    "Tracking ID 1234567890123456", "at 192.168.1.1 now", "IP: 256.1.1.1", "Passport: C12345678", "Code: a12345678", "via 2001:db8::1 x", "bind ::1 y", "lone :: sign", "std::string", "mapped ::ffff:192.0.2.128", "MAC aa:bb:cc:dd:ee:ff",
    "+44 20 7123 4567", "(555) 867-5309 now", "+1 - 45 = -44", "mail a.b+c@x.example.org, d@e.io", "caféjoe@x.com", "mrn-1234567 MRN-7654321", "\U0001f600 mail é@x.com j@x.com \U0001f600 j@y.com", "١٢٣-٤٥-٦٧٨٩", "", None,
]


def python_pattern(kind):
    p = P.JAVA[kind].replace(r"\p{L}\p{N}_", r"\w").replace(r"\p{Nd}", r"\d").replace(r"[\s\x1c-\x1f\x85\p{Z}]", r"\s").replace(r"\x1c-\x1f\x85\p{Z}", "")
    return re.compile(p)


@pytest.mark.parametrize("kind", ["PHONE", "EMAIL", "MRN", "IPV4", "IPV6", "PASSPORT"])
def test_offsets_equal_python(spark, kind):
    df = spark.createDataFrame(list(enumerate(NASTY)), "id int, text string")
    got = {r["id"]: [(s["start"], s["end"], s["text"]) for s in r["s"] or []] for r in df.select("id", detect(F.col("text"), kind).alias("s")).collect()}
    for i, t in enumerate(NASTY):
        assert got[i] == [(m.start(), m.end(), m.group()) for m in python_pattern(kind).finditer(t or "")], (kind, t)


CASES = {
    "SSN on file: 123-45-6789.": [("SSN", 13, 24)], "SSN: 666-45-6789": [], "SSN: 900-12-3456": [], "Field SSN_123-45-6789 in the form.": [], "Applicant's SSN is 123456789, verified via W-2.": [("SSN", 19, 28)],
    "Call the vendor at 941555012 to confirm delivery.": [], "123456789": [], "Date of birth: 07/04/1985 confirmed.": [("DOB", 15, 25)], "Meeting scheduled for 01/15/2026 in the room.": [],
    "The birth report filed 03/15/1990 was updated.": [], "Tracking 1234-5678-9012-3456 recorded.": [("CREDIT_CARD", 9, 28)], "Visa 1234567890123456 on file.": [("CREDIT_CARD", 5, 21)],
    "Mapped: ::ffff:192.0.2.128": [("IPV6", 8, 26)], "lone :: sign": [("IPV6", 5, 7)], "std::string": [], "born 2190-01-31": [("DOB", 5, 15)],
}


def test_cases_by_hand(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "text string")
    for r in redact.detect_entities(df).collect():
        assert [(e["entity_type"], e["start"], e["end"]) for e in r["entities"]] == CASES[r["text"]], r["text"]


def test_scores_collapse_to_the_known_values(spark):
    df = spark.createDataFrame([("social security 123456789",), ("ssn 123456789",), ("date of birth 01/02/1990",), ("born 01/02/1990",)], "text string")
    scores = [r["e"][0]["score"] for r in df.select(detect_all(F.col("text")).alias("e")).collect()]
    assert scores == [0.95, 0.75, 1.0, 0.9]


def span(kind, start, end, score, source):
    return ("t", kind, start, end, score, "", source)


@pytest.mark.parametrize("model,regex,want", [
    ([span("PERSON", 0, 4, 0.95, "bert")], [span("SSN", 20, 31, 0.99, "regex")], ["PERSON", "SSN"]),
    ([span("MISC", 10, 19, 0.9, "bert")], [span("SSN", 10, 19, 0.75, "regex")], ["SSN"]),
    ([span("ORGANIZATION", 5, 14, 0.95, "bert"), span("MISC", 5, 14, 0.8, "bert")], [], ["ORGANIZATION"]),
    ([span("PERSON", 0, 13, 0.92, "bert"), span("LOCATION", 0, 10, 0.95, "bert")], [], ["PERSON"]),
    ([span("PERSON", 0, 10, 0.9, "bert")], [span("SSN", 8, 30, 0.9, "regex")], ["SSN"]),
    ([], [], []),
])
def test_merge(spark, model, regex, want):
    df = spark.createDataFrame([(model, regex)], f"m {SPANS}, r {SPANS}")
    got = df.select(merge.merge(F.col("m"), F.col("r")).alias("e")).first()["e"]
    assert [e["entity_type"] for e in got] == want


def test_redaction_numbers_from_the_end_and_restores(spark):
    text = "SSN 123-45-6789 and SSN 234-56-7890, mail a@b.io"
    df = spark.createDataFrame([(text,), ("No PII.",), (None,)], "text string")
    out = redact.redact(df).withColumn("back", redact.restore(F.col("masked_text"), redact.entries(F.col("entities")))).collect()
    assert out[0]["masked_text"] == "SSN [SSN_2] and SSN [SSN_1], mail [EMAIL_1]"
    assert out[0]["mapping"]["[SSN_1]"] == "234-56-7890" and out[0]["back"] == text
    assert out[1]["masked_text"] == "No PII." and out[1]["mapping"] == {} and out[2]["masked_text"] == ""
    off = redact.redact(df, disabled=["SSN"]).first()
    assert off["masked_text"] == text.replace("a@b.io", "[EMAIL_1]")


def plain_chunks(text, size):
    if len(text) <= size:
        return [(text, 0)]
    bounds = [0] + [i + 1 for i, c in enumerate(text) if c in ".;\n" and i + 1 < len(text)] + [len(text)]
    out, at = [], 0
    while at < len(bounds) - 1:
        to = at + 1
        while to + 1 < len(bounds) and bounds[to + 1] - bounds[at] <= size:
            to += 1
        out.append((text[bounds[at] : bounds[to]], bounds[at]))
        at = to - 1 if to - 1 > at else to
    return out


def test_chunks(spark):
    texts = ["Hello. My name.", "A" * 1500, "A sentence with words. " * 100, ("Word " * 50 + ". ") * 20, "x" * 4000, "ab;" * 700 + "y" * 2000 + "\nz.", "é\U0001f600. " * 900]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", chunk.chunks(F.col("text")).alias("c")).collect():
        assert [(c["chunk"], c["offset"]) for c in r["c"]] == plain_chunks(r["text"], 1500)
