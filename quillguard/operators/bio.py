"""Word labels: offsets, alignment of spans, labelling, label spaces, subwords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import running_sum
from ..functions.spans import find_all
from .ner import mapped

#: Label vocabularies in id order, and entity types in word labels.
LABELS = ["O"] + [f"{p}-{t}" for t in "PER ORG LOC SSN PHONE EMAIL MRN DOB MISC CREDIT_CARD IPV4 PASSPORT".split() for p in "BI"]
MODEL_LABELS = ["O"] + [f"{p}-{t}" for t in "PER ORG LOC MISC".split() for p in "BI"]
MODEL_TYPES = ("PER", "ORG", "LOC", "MISC")
HYBRID_TYPES = (*MODEL_TYPES, "SSN", "PHONE", "EMAIL", "MRN", "DOB", "CREDIT_CARD", "IPV4", "IPV6", "PASSPORT")
BIO_TYPE = {"PERSON": "PER", "LOCATION": "LOC", "ORGANIZATION": "ORG"}



def word_offsets(tokens: Column) -> Column:
    """[start, end) of each token in the tokens joined by one space."""
    before = running_sum(F.transform(tokens, lambda t: F.length(t) + 1))
    return F.zip_with(tokens, before, lambda t, at: F.struct(at.alias("start"), (at + F.length(t)).alias("end")))


def align(tokens: Column, entities: Column) -> Column:
    """Word tags from spans (label in ``entity_type``): the first untagged word that a span
    overlaps opens it, later untagged ones continue it, tagged words stay."""
    bind = lambda value, body: F.transform(F.array(value), body)[0]

    def aligned(offsets: Column) -> Column:
        def step(tags: Column, e: Column) -> Column:
            free = lambda t, o: (t == "O") & (o["start"] < e["end"]) & (o["end"] > e["start"])
            hits = F.zip_with(tags, offsets, free)
            first = lambda h: F.array_position(h, F.lit(True)) - 1
            label = mapped(e["entity_type"], BIO_TYPE)
            put = lambda h: F.transform(tags, lambda t, i: F.when(~h[i], t).when(i == first(h), F.concat(F.lit("B-"), label)).otherwise(F.concat(F.lit("I-"), label)))
            return bind(hits, put)

        return F.aggregate(entities, F.transform(offsets, lambda o: F.lit("O")), step)

    return bind(word_offsets(tokens), aligned)


def label_tokens(text: Column, entities: Column) -> Column:
    """Array of (token, tag): occurrences of given (surface, type) pairs, longest first and
    without double labels; a token has the type of its first labelled character and
    continues the token before if that has the same type."""
    ranked = F.array_sort(F.transform(F.filter(entities, lambda e: e["surface"] != ""), lambda e, i: F.struct((-F.length(e["surface"])).alias("l"), i.alias("i"), e["surface"].alias("surface"), e["type"].alias("type"))))
    spans = "array<struct<start:int,end:int,type:string>>"

    def occurrences(e: Column) -> Column:
        literal = F.concat(F.lit("\\Q"), e["surface"], F.lit("\\E"))
        found = F.zip_with(F.split(text, literal, -1), F.regexp_extract_all(text, literal, F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out"))

        def step(acc: Column, z: Column) -> Column:
            a = acc["at"] + F.length(z["g"])
            one = F.struct(a.alias("start"), (a + F.length(e["surface"])).alias("end"), e["type"].alias("type"))
            return F.when(z["m"].isNull(), acc).otherwise(F.struct((a + F.length(e["surface"])).alias("at"), F.array_append(acc["out"], one).alias("out")))

        return F.aggregate(found, start, step, lambda acc: acc["out"])

    def add(acc: Column, e: Column) -> Column:
        free = lambda o: ~F.exists(acc, lambda a: (a["start"] < o["end"]) & (o["start"] < a["end"]))
        return F.concat(acc, F.filter(occurrences(e), free))

    labelled = F.array_sort(F.aggregate(ranked, F.array().cast(spans), add))
    words = find_all(text, r"[^\s\x1c-\x1f\x85\p{Z}]+")
    first = lambda w: F.filter(labelled, lambda a: (a["start"] < w["end"]) & (w["start"] < a["end"]))
    typed = F.transform(words, lambda w: F.struct(w["text"].alias("token"), F.try_element_at(first(w), F.lit(1))["type"].alias("type")))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<struct<token:string,tag:string>>").alias("out"))

    def tag(acc: Column, w: Column) -> Column:
        name = F.when(w["type"].isNull(), F.lit("O")).when(w["type"] == acc["last"], F.concat(F.lit("I-"), w["type"])).otherwise(F.concat(F.lit("B-"), w["type"]))
        return F.struct(w["type"].alias("last"), F.array_append(acc["out"], F.struct(w["token"].alias("token"), name.alias("tag"))).alias("out"))

    return F.aggregate(typed, start, tag, lambda acc: acc["out"])


def keep_types(tags: Column, types: tuple[str, ...]) -> Column:
    """Tags of other types become O."""
    return F.transform(tags, lambda t: F.when(F.try_element_at(F.split(t, "-", 2), F.lit(2)).isin(*types), t).otherwise("O"))


def tag_ids(tags: Column, labels: list[str] = LABELS) -> Column:
    """Ids of tags; unknown tags are 0."""
    known = F.create_map(*(F.lit(x) for n, label in enumerate(labels) for x in (label, n)))
    return F.transform(tags, lambda t: F.coalesce(F.try_element_at(known, t), F.lit(0)))


def subword_labels(word_ids: Column, label_ids: Column, labels: list[str] = MODEL_LABELS) -> Column:
    """Labels of subwords: -100 without a word, the word's label for its first subword, and
    for later ones the label with B- turned to I-."""
    inside = {n: labels.index("I-" + label[2:]) for n, label in enumerate(labels) if label.startswith("B-")}
    turned = F.create_map(*(F.lit(x) for pair in inside.items() for x in pair))

    def one(w: Column, i: Column) -> Column:
        label = F.try_element_at(label_ids, w + 1)
        again = (i > 0) & F.coalesce(F.get(word_ids, i - 1) == w, F.lit(False))
        return F.when(w.isNull(), F.lit(-100)).when(again, F.coalesce(F.try_element_at(turned, label), label)).otherwise(label)

    return F.transform(word_ids, one)


def decode_tags(tags: Column) -> Column:
    """Entities of a tag sequence as (type, first, last): B-, or a type other than the one
    before, opens an entity."""
    found = "array<struct<type:string,first:int,last:int>>"
    split = F.transform(tags, lambda t, i: F.struct(i.alias("i"), F.substring(t, 1, 1).alias("p"), F.try_element_at(F.split(t, "-", 2), F.lit(2)).alias("type")))

    def step(acc: Column, t: Column) -> Column:
        open_, last = acc["open"], F.try_element_at(acc["out"], F.lit(-1))
        grows = (t["p"] == "I") & F.coalesce(open_ == t["type"], F.lit(False))
        longer = F.array_append(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.struct(last["type"].alias("type"), last["first"].alias("first"), t["i"].alias("last")))
        new = F.array_append(acc["out"], F.struct(t["type"].alias("type"), t["i"].alias("first"), t["i"].alias("last")))
        out = F.when(t["type"].isNull(), acc["out"]).when(grows, longer).otherwise(new)
        return F.struct(t["type"].alias("open"), out.alias("out"))

    return F.aggregate(split, F.struct(F.lit(None).cast("string").alias("open"), F.array().cast(found).alias("out")), step, lambda acc: acc["out"])
