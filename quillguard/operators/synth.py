"""Labelled samples made from integer arithmetic on the row id.

The families and their shares (40, 25, 15, 10 percent and the rest) stand for business,
clinical, payment, identity and negative texts; the sentences are ours.  A part of a
template is either text or the name of a value with its type.  The same SQL runs on Spark
and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bio import label_tokens, tag_ids

_pick = lambda names, m: "CASE " + f"(id * {m}) % {len(names)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"
_pad = lambda m, width, low, span: f"lpad(cast((id * {m}) % {span} + {low} as string), {width}, '0')"
_AREA = "lpad(cast(CASE WHEN (id * 7919) % 898 + 1 >= 666 THEN (id * 7919) % 898 + 2 ELSE (id * 7919) % 898 + 1 END as string), 3, '0')"
_GROUP, _SERIAL = _pad(31, 2, 1, 99), _pad(6151, 4, 1, 9999)
_GROUPS = [_pad(m, 4, 1000, 9000) for m in (131, 137, 139, 149)]
VALUES = {
    "person": ("PER", _pick(["Ada Marsh", "Ben Okoro", "Cleo Varga", "Dinh Pham", "Eva Lund", "Farid Aziz", "Gia Romano"], 3)),
    "firm": ("ORG", _pick(["Northwind Foundry", "Harbor Mutual", "Kestrel Labs", "Quarry Street Clinic", "Blue Fen Foods"], 5)),
    "place": ("LOC", _pick(["Leeds", "Porto", "Tampere", "Austin"], 7)),
    "illness": ("MISC", _pick(["asthma", "anaemia", "migraine", "eczema"], 11)),
    "ssn": ("SSN", f"{_AREA} || '-' || {_GROUP} || '-' || {_SERIAL}"),
    "ssn9": ("SSN", f"{_AREA} || {_GROUP} || {_SERIAL}"),
    "mrn": ("MRN", f"'MRN-' || {_pad(104729, 7, 0, 10000000)}"),
    "phone": ("PHONE", f"'(' || {_pad(17, 3, 200, 800)} || ') ' || {_pad(19, 3, 200, 800)} || '-' || {_pad(23, 4, 1000, 9000)}"),
    "card": ("CREDIT_CARD", " || '-' || ".join(_GROUPS)),
    "card16": ("CREDIT_CARD", " || ".join(_GROUPS)),
    "ipv4": ("IPV4", " || '.' || ".join(f"cast((id * {m}) % 254 + 1 as string)" for m in (3, 5, 7, 11))),
    "passport": ("PASSPORT", f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(id % 26 as int) + 1, 1) || {_pad(7907, 8, 0, 100000000)}"),
    "born": ("DOB", f"{_pad(5, 2, 1, 12)} || '/' || {_pad(13, 2, 1, 28)} || '/' || {_pad(29, 4, 1930, 70)}"),
    "mail": ("EMAIL", "'w' || cast(id as string) || '@post.example.org'"),
    "number9": (None, _pad(7907, 9, 100000000, 800000000)),
}
#: Values are in braces.
FAMILIES = {
    "enterprise": ["{person} of {firm} gave SSN {ssn} and phone {phone} .", "Payroll at {firm} holds the social security number {ssn9} for {person} .", "Write to {person} at {mail} about the {place} office .", "Background check of {person} : {ssn9} , cleared by {firm} ."],
    "clinical": ["{person} , {mrn} , born {born} , is treated for {illness} at {firm} .", "Chart {mrn} : {illness} ; call {phone} .", "DOB {born} confirmed for {person} in {place} ."],
    "financial": ["{firm} charged card {card} of {person} .", "The credit card {card16} of {person} was declined .", "Visa {card} and SSN {ssn} were sent by {mail} ."],
    "identity": ["Passport {passport} of {person} was seen in {place} .", "Login from {ipv4} by {mail} .", "Host {ipv4} belongs to {firm} ."],
    "negative": ["Tracking number {number9} left {place} .", "Invoice {number9} from {firm} is due .", "Serial {number9} was replaced ."],
}
SHARES = {"enterprise": 0.40, "clinical": 0.25, "financial": 0.15, "identity": 0.10}


def family_counts(n: int) -> dict[str, int]:
    counts = {name: int(n * share) for name, share in SHARES.items()}
    return counts | {"negative": n - sum(counts.values())}


def _parts(template: str) -> list[tuple[str, str]]:
    out = []
    for piece in template.split("{"):
        name, closed, rest = piece.partition("}")
        out += [("value", name), ("text", rest)] if closed else [("text", piece)]
    return [p for p in out if p[1]]


def _text(template: str) -> str:
    return " || ".join(VALUES[p][1].join("()") if kind == "value" else "'" + p.replace("'", "''") + "'" for kind, p in _parts(template))


def texts_sql(n: int, ids: str) -> str:
    """id, family, text over ``ids``, a query of one column id from 0."""
    low, branches, family = 0, [], []
    for name, count in family_counts(n).items():
        k = len(FAMILIES[name])
        family.append(f"WHEN id < {low + count} THEN '{name}'")
        branches += [f"WHEN id < {low + count} AND id % {k} = {i} THEN {_text(t)}" for i, t in enumerate(FAMILIES[name])]
        low += count
    return f"SELECT id, CASE {' '.join(family)} END AS family, CASE {' '.join(branches)} END AS text FROM ({ids}) ids"


def generate(spark: SparkSession, n: int) -> DataFrame:
    """id, family, text, tokens, ner_tag_labels, ner_tags of ``n`` samples."""
    made = spark.sql(texts_sql(n, f"SELECT id FROM range({n})"))
    given, low = F.array().cast("array<struct<surface:string,type:string>>"), 0
    cases = None
    for name, count in family_counts(n).items():
        k = len(FAMILIES[name])
        for i, t in enumerate(FAMILIES[name]):
            named = [VALUES[p] for kind, p in _parts(t) if kind == "value" and VALUES[p][0]]
            pairs = F.array(*(F.struct(F.expr(value).alias("surface"), F.lit(kind).alias("type")) for kind, value in named)) if named else given
            when = (F.col("id") < low + count) & (F.col("id") % k == i)
            cases = F.when(when, pairs) if cases is None else cases.when(when, pairs)
        low += count
    labelled = made.withColumn("_e", cases).withColumn("_l", label_tokens(F.col("text"), F.col("_e")))
    tags = F.transform("_l", lambda z: z["tag"])
    return labelled.select("id", "family", "text", F.transform("_l", lambda z: z["token"]).alias("tokens"), tags.alias("ner_tag_labels"), tag_ids(tags).alias("ner_tags"))


def misaligned(samples: DataFrame) -> DataFrame:
    """Samples whose tokens and tags differ in number; none should."""
    return samples.where(F.size("tokens") != F.size("ner_tags"))


def laplace(scale: float, seed: int):
    """A column of Laplace noise."""
    u = F.rand(seed) - 0.5
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))


def split(df: DataFrame, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    a, b = df.randomSplit([share, 1 - share], seed)
    return a, b
