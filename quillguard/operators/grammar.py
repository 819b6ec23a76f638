"""The whole grammar of labelled samples: five families, sized from a table.

A template is text with values in braces.  Enterprise and financial texts have a second list
of templates, whose numbers are without dashes and need words of context; four of ten samples
come from it.  All draws are integer arithmetic on the row id, so any engine makes the same
samples and a lost task makes them again.  The sentences and lists are ours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bio import label_tokens, tag_ids
from .synth import SHARES, VALUES, _pick

#: Values beyond those of the small grammar; illnesses and remedies are no entities here, and
#: numbers of negatives have the structure of valid ones.
GRAMMAR_VALUES = VALUES | {
    "firm": ("ORG", _pick(["Northwind Foundry", "Harbor Mutual", "Kestrel Labs", "Quarry Street Clinic", "Blue Fen Foods"], 3)),
    "number9": (None, VALUES["ssn9"][1]),
    "people": ("MISC", _pick(["Norwegian", "Peruvian", "Kenyan", "Polish", "Irish", "Turkish", "Thai", "Chilean"], 13)),
    "illness": (None, _pick(["asthma", "anaemia", "migraine", "eczema", "gout", "sinusitis", "type 1 diabetes", "celiac disease"], 11)),
    "remedy": (None, _pick(["Ibuprofen 400mg", "Cetirizine 10mg", "Ferrous sulfate 65mg", "Salbutamol spray", "Colchicine 1mg", "insulin glargine", "Naproxen 250mg", "Hydrocortisone cream"], 17)),
}

#: Family -> lists of templates; the second list, if any, holds numbers without dashes.
GRAMMAR: dict[str, list[list[str]]] = {
    "enterprise": [
        [
            "The file of {person} at {firm} lists SSN {ssn}, phone {phone} and mail {mail}.",
            "{person} of {firm} will visit {place} ; ring {phone} or write to {mail}.",
            "{firm} hired {person} with SSN {ssn}, reachable under {phone}.",
            "A badge of {firm} was lost by {person} (SSN {ssn}), who rang from {phone}.",
            "Mail the draft to {mail} for {person} at the {place} branch of {firm}.",
            "Our {people} colleague {person} at {firm} gave SSN {ssn} and {phone}.",
            "{person}, {people} by passport, joins {firm} in {place} ; see {mail} or {phone}.",
            "Vetting of the {people} applicant {person} by {firm}: SSN {ssn}, call {phone}.",
        ],
        [
            "Payroll at {firm} holds the social security number {ssn9} of {person}.",
            "Correct the SSN of {person} to {ssn9} in the records of {firm}.",
            "For tax, {person} gave the taxpayer identification number {ssn9} to {firm}.",
            "The {people} taxpayer {person} is known to {firm} by SSN {ssn9} alone.",
        ],
    ],
    "clinical": [
        [
            "{person}, {mrn}, born {born}, is seen for {illness} and takes {remedy}.",
            "Chart {mrn}: {person} was found to have {illness} ; {remedy} was begun.",
            "{person} ({mrn}, DOB {born}) went home after {illness} on {remedy}.",
            "Blood values of {person} under {mrn} point to {illness}, so {remedy} is raised.",
            "A {people} visitor, {person}, {mrn}, DOB {born}, came with {illness} and got {remedy}.",
            "{person}, a {people} guest with {mrn}, has {illness} and is given {remedy}.",
        ]
    ],
    "financial": [
        [
            "{firm} owes {person} a refund to {card} ; confirm under {phone}.",
            "Bill {card} for the yearly plan of {person} with {firm}.",
            "{person} paid {firm} with {card} on Monday.",
        ],
        [
            "The visa card {card16} of {person} is kept by {firm}.",
            "Credit card {card16} was issued to {person}, paid by {firm}.",
            "The debit card {card16} of {person} at {firm} is blocked ; phone {phone}.",
        ],
    ],
    "identity": [
        [
            "{person} travels for {firm} on passport {passport}.",
            "Passport {passport} was shown by {person} of {firm}.",
            "{person} of {firm} signed in from {ipv4} as {mail}.",
            "Odd traffic from {ipv4} by {person} ; tell {firm} under {mail}.",
            "{firm} ties passport {passport} and host {ipv4} to {person}.",
        ]
    ],
    "negative": [
        [
            "Phone {number9} and ask {person} about the goods of {firm}.",
            "Parcel {number9} of {person} left {firm} with its tracking sheet.",
            "Account {number9} stands on the invoice of {firm} for {person}.",
            "Serial {number9} is a device of {person} at {firm}.",
        ]
    ],
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(template: str) -> list[tuple[str, str | None, str]]:
    """(before, value name or None, after) of each word of a template."""
    out = []
    for word in template.split(" "):
        before, _, rest = word.partition("{")
        name, _, after = rest.partition("}")
        out.append((before, name or None, after))
    return out


def _branches() -> list[tuple[str, int, int, int, int, str]]:
    """(family, second list, has two lists, index, templates in list, template)."""
    return [(family, second, len(lists) > 1, i, len(of), t) for family, lists in GRAMMAR.items() for second, of in enumerate(lists) for i, t in enumerate(of)]


_DASHLESS = "(id * 7 + 3) % 10 < 4"


def _when(family: str, second: int, two: bool, i: int, k: int) -> str:
    drawn = f" AND {'' if second else 'NOT '}({_DASHLESS})" if two else ""
    return f"family = '{family}'{drawn} AND {'id' if k == 1 else 'cast(floor(id / 10) as bigint)'} % {k} = {i}"


def _family(n: Column) -> Column:
    """Truncated shares of ``n`` in id order; the rest are negatives."""
    low, out = F.lit(0), None
    for name, share in SHARES.items():
        low = low + F.floor(n * F.lit(share))
        out = F.when(F.col("id") < low, name) if out is None else out.when(F.col("id") < low, name)
    return out.otherwise("negative")


def labelled_corpus(spark: SparkSession, n: int) -> DataFrame:
    """id, family, text, tokens, ner_tag_labels, ner_tags of ``n`` samples, without a shuffle."""
    made = spark.range(n).withColumn("family", _family(F.lit(n).cast("double")))
    # Each value once, as a column that the templates name: the plan stays small.
    made = made.select("id", "family", *(F.expr(value).alias(f"_{name}") for name, (_, value) in GRAMMAR_VALUES.items()))
    texts, pairs = [], []
    for family, second, two, i, k, template in _branches():
        parts, named = [], []
        for at, (before, name, after) in enumerate(_words(template)):
            parts.append(_quoted(" " * (at > 0) + before))
            if name:
                parts += [f"_{name}", _quoted(after)]
                if kind := GRAMMAR_VALUES[name][0]:
                    named.append(f"named_struct('surface', _{name}, 'type', '{kind}')")
        when = _when(family, second, two, i, k)
        texts.append(f"WHEN {when} THEN concat({', '.join(parts)})")
        pairs.append(f"WHEN {when} THEN array({', '.join(named)})")
    made = made.withColumn("text", F.expr(f"CASE {' '.join(texts)} END")).withColumn("_e", F.expr(f"CASE {' '.join(pairs)} END"))
    made = made.withColumn("_l", label_tokens(F.col("text"), F.col("_e")))
    tags = F.transform("_l", lambda z: z["tag"])
    return made.select("id", "family", "text", F.transform("_l", lambda z: z["token"]).alias("tokens"), tags.alias("ner_tag_labels"), tag_ids(tags).alias("ner_tags"))


def corpus_sql(n: str) -> str:
    """id, family, tokens, tags (lists) in DuckDB, word by word from the templates and not by
    a search for values in the text; ``n`` is a scalar subquery."""
    low, cases = [], []
    for name, share in SHARES.items():
        low.append(f"CAST(floor({n} * CAST({share} AS DOUBLE)) AS BIGINT)")
        cases.append(f"WHEN id < {' + '.join(low)} THEN '{name}'")
    tokens, tags = [], []
    for family, second, two, i, k, template in _branches():
        t, g = [], []
        for before, name, after in _words(template):
            if not name:
                t.append(f"[{_quoted(before)}]")
                g.append("['O']")
                continue
            kind, value = GRAMMAR_VALUES[name]
            t.append(f"string_split({_quoted(before)} || ({value}) || {_quoted(after)}, ' ')")
            length = f"len(string_split(({value}), ' '))"
            g.append(f"list_concat(['B-{kind}'], list_transform(range(1, {length}), lambda q: 'I-{kind}'))" if kind else f"list_transform(range({length}), lambda q: 'O')")
        when = _when(family, second, two, i, k)
        tokens.append(f"WHEN {when} THEN flatten([{', '.join(t)}])")
        tags.append(f"WHEN {when} THEN flatten([{', '.join(g)}])")
    return f"SELECT id, family, CASE {' '.join(tokens)} END AS tokens, CASE {' '.join(tags)} END AS tags FROM (SELECT id, CASE {' '.join(cases)} ELSE 'negative' END AS family FROM (SELECT range AS id FROM range({n})))"
