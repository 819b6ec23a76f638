"""Each operator against a plain version, and its defined results on odd rows."""

import hashlib
import json
import random
import re
import struct
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quillguard.llm import bpe, chat, classifier, common, embeddings, hashing, mixing, neardup, quality, sharding, substring, warc

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Odd rows: null id and text, empty, blank, repeated, tied, very long; copies and near
    copies; odd white space and letters."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed")
    shared = prose(2, 40)
    return [
        (1, base), (2, base), (3, near), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "ONE two"), (None, base), (None, None),
        (9, prose(3, 30) + " " + shared + " " + prose(4, 30)), (10, prose(5, 30) + "\n" + shared + "\n" + prose(6, 30)),
        (11, prose(7, 60_000)), (12, "w " * 50), (13, "café naïve ΣΣ \U0001f600 x\x1cy <|endoftext|> it's 12"), (14, "a\x0bb\x0cc\rd"), (15, "x" * 100_000),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = "kept boolean, n_words int, component_id string, size string, shard int, _score double, _kept string, label string, digest string"
    made = [(i, t, "s" if (i or 0) % 3 else None, None, None, None, None, None, None, None, None, None) for i, t in rows]
    return spark.createDataFrame(made, f"doc_id long, text string, source string, {extra}")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def words(t):
    return (t or "").encode().split()


# 1


def test_quality_features_by_hand():
    f = quality.Features("a b c d e\na b c d e\nz # |")
    assert (f.n_words, f.word_chars, f.n_symbols, f.n_lines, f.n_dup_lines) == (13, 13, 2, 3, 1)
    assert f.n_repeat_words == 10
    assert quality.Features(None).n_words == quality.Features("").n_repeat_words == 0


def test_quality_plan_orders_by_rejection_per_cost():
    order = quality.plan([("few_words", 1.0, 0.1), ("symbols", 0.1, 0.1), ("shouts", 1.0, 0.0)])
    assert [r.name for r in order][:2] == ["symbols", "few_words"]


def test_quality_verdict_does_not_depend_on_order(docs, none):
    a = quality.cascade(docs, quality.RULES, ("doc_id", "kept"), report=quality.REPORT)
    b = quality.cascade(docs, quality.RULES[::-1], ("doc_id", "kept"), report=quality.REPORT)
    key = lambda df: sorted((str(r[0]), *r[2:7], r[-1]) for r in df.collect())
    assert key(a) == key(b) and len(key(a)) == docs.count()
    first = {r[0]: r["rules_run"] for r in b.collect()}
    assert first[12] < len(quality.RULES)
    assert quality.cascade(none, quality.RULES).count() == 0 and quality.measure(none) == []


# 2


def components(rows, width, num, den):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {i: set() for i in ids}
    for i, t in rows:
        if i is not None:
            w = [x.lower() for x in words(t)]
            sets[i] |= {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    comp = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


@pytest.mark.parametrize("width,similarity", [(3, (85, 100)), (5, (80, 100))])
def test_near_duplicates_against_all_pairs(docs, rows, width, similarity):
    found = neardup.near_duplicates(docs, width=width, similarity=similarity).collect()
    want = components(rows, width, *similarity)
    assert len(found) == len(rows)
    for r in found:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])


@pytest.fixture
def dealt(monkeypatch):
    """Rows of each table of deals that a call writes."""
    seen, table = [], common.Scratch.table

    def counted(self, df, name):
        out = table(self, df, name)
        if name == "deals":
            seen.append(out.count())
        return out

    monkeypatch.setattr(common.Scratch, "table", counted)
    return seen


def test_near_duplicates_across_blocks(spark, dealt):
    """Small blocks make cross tiles; chains of near copies must stay whole."""
    rnd, made = random.Random(5), []
    for g in range(6):
        text = prose(100 + g, 60).split()
        for _ in range(9):
            text = list(text)
            text[rnd.randrange(60)] = f"new{rnd.randrange(10**6)}"
            made.append((len(made), " ".join(text)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    want = components(made, 3, 85, 100)
    assert len(set(want.values())) < len(made)
    for bounds in ({"block_classes": 3}, {"block_shingles": 100}, {"block_classes": 1}):
        found = neardup.near_duplicates(df, width=3, similarity=(85, 100), **bounds).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert len(dealt) > 3  # cross tiles were dealt


@pytest.mark.parametrize("size", [320, 640])
def test_a_large_group_of_near_copies_is_dealt_once(spark, dealt, size):
    """Copies of one text with some words changed; two of them alone may be too far apart."""
    rnd, base = random.Random(3), prose(200, 150).split()
    made = [(size, " ".join(base))]
    for k in range(size):
        text = list(base)
        for _ in range(rnd.choice([1, 2, 3])):
            text[rnd.randrange(150)] = f"n{rnd.randrange(10**6)}"
        made.append((k, " ".join(text)))
    out = neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), width=3, similarity=(85, 100), block_classes=64)
    assert {r["component_id"] for r in out.collect()} == {0}
    assert sum(dealt) < 2 * size


def test_near_duplicates_of_rows_that_share_a_doc_id(spark):
    """Each text is compared for itself; a doc_id's texts reach the same documents."""
    x = prose(300, 100).split()
    a, b = x[:92] + prose(301, 8).split(), x[:60] + prose(302, 40).split()
    made = [(1, " ".join(x)), (2, " ".join(a)), (2, " ".join(b))]
    assert {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), width=3, similarity=(85, 100)).collect()} == {(1, 1), (2, 2)}
    y, z = prose(303, 80), prose(304, 80)
    made = [(7, y), (5, y), (5, z), (5, None), (9, z), (9, z), (4, "lone"), (4, prose(305, 20)), (3, ""), (None, y)]
    found = neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), width=3, similarity=(85, 100)).collect()
    want = {7: 5, 5: 5, 9: 5, 4: 4, 3: 3, None: None}
    assert len(found) == len(made) and all(r["component_id"] == want[r["doc_id"]] for r in found)
    assert sorted(r["n_shingles"] for r in found if r["doc_id"] == 5) == [0, 78, 78]


def test_near_duplicates_of_nothing(none):
    assert neardup.near_duplicates(none).count() == 0


def test_connected_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)]
    found = common.connected_components(common.Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}}


def test_edges_that_are_stars_take_no_round(spark, monkeypatch):
    written, table = [], common.Scratch.table
    monkeypatch.setattr(common.Scratch, "table", lambda self, df, name: written.append(name) or table(self, df, name))
    edges = [(100, 100 + k) for k in range(1, 30)] + [(7, 9), (9, 7), (3, 3)]
    found = common.connected_components(common.Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == [(7, 7), (9, 7), *((100 + k, 100) for k in range(30))]
    assert written == ["edges0"]


def test_a_tile_gives_stars():
    """Links that form a chain come out as edges to the smallest component."""
    text = [f"w{k}" for k in range(300)]
    chain = [" ".join([*text[4 * k :], *(f"x{j}" for j in range(4 * k))]) for k in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12), pa.int64()), pa.array(chain)], names=["doc_id", "text"])
    n, sketch = (next(neardup._sketches(3)(iter([batch]))).column(c) for c in ("n", "sketch"))
    sets = next(neardup._sets(3)(iter([batch]))).column("shingles")
    own = pa.array([50, 3, 3, 20, 20, 60, 61, 62, 63, 64, 65, 66], pa.int64())
    tile = pa.table({"node": batch.column(0), "side": pa.array([0] * 12), "component": own, "n": n, "sketch": sketch, "shingles": sets})
    found = neardup._compare(85, 100)(tile)
    assert sorted(zip(found["a"].to_pylist(), found["b"].to_pylist())) == [(c, 3) for c in sorted({*own.to_pylist()} - {3})]


@pytest.mark.parametrize("piece", [5, 64])
def test_hashes_do_not_depend_on_the_pieces(monkeypatch, piece):
    texts = ["", " ", "a", "ab cd  ef\n" * 30, "é中😀 x" * 20, "longword" * 40 + " b", " c" * 33 + "\t"]
    want = [(hashing.word_hashes(t, True).tolist(), hashing.sequence_hash(hashing.word_hashes(t)), hashing.shingle_set(t, 3).tolist()) for t in texts]
    monkeypatch.setattr(hashing, "PIECE", piece)
    monkeypatch.setattr(hashing, "_POWERS", [])
    assert want == [(hashing.word_hashes(t, True).tolist(), hashing.sequence_hash(hashing.word_hashes(t)), hashing.shingle_set(t, 3).tolist()) for t in texts]
    for t in texts:
        cut_up = list(hashing.pieces(t.encode(), piece))
        assert b"".join(cut_up) == t.encode() and [w for p in cut_up for w in p.split()] == words(t)


LONG = """
import resource
from quillguard.llm import hashing, quality
text = "".join(f"word{k % 50021} " for k in range(10_500_000))[:100_000_000]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{call}
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""


@pytest.mark.parametrize("call", ["hashing.shingle_set(text, 5)", "quality.Features(text).n_repeat_words"])
def test_memory_of_a_text_of_100_megabytes(call):
    grown = subprocess.run([sys.executable, "-c", LONG.replace("{call}", call)], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(grown.stdout) < 6 * 100_000


# 3


def cut(rows, width):
    first, out = {}, []
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            if i is not None:
                g = tuple(w[k : k + width])
                first[g] = min(first.get(g, i), i)
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_against_all_windows(docs, rows):
    documents, changed = substring._with_changes(docs, "doc_id", "text", 13)
    kept = {r["doc_id"]: r for r in changed.collect()}
    got = []
    for r in documents.collect():
        c = kept.get(r["doc_id"])
        n, h = (r["n_words"], hashlib.sha256(b"").hexdigest()) if r["copy"] else (c["n_removed"], c["changed_digest"]) if c else (0, r["digest"])
        got.append((r["doc_id"], r["n_words"], n, h))
    assert sorted(got, key=str) == cut(rows, 13)


def test_substring_dedup_of_random_overlaps(spark):
    rnd = random.Random(9)
    pool = [prose(50 + k, 30).split() for k in range(6)]
    made = []
    for i in range(40):
        text = []
        for _ in range(4):
            p = rnd.choice(pool)
            a = rnd.randrange(0, 15)
            text += p[a : a + rnd.randrange(5, 25)] + ([f"u{i}"] if rnd.random() < 0.5 else [])
        made.append((i, " ".join(text)))
    made += [(40, "k " * 60), (41, "k " * 45), (42, ("a b " * 40))]
    df = spark.createDataFrame(made, "doc_id long, text string")
    out = {r["doc_id"]: r for r in substring.substring_dedup(df).collect()}
    for i, n, gone, digest in cut(made, 13):
        assert out[i]["_n_removed"] == gone
        assert hashlib.sha256(b" ".join(words(out[i]["text"]))).hexdigest() == digest


def test_substring_dedup_of_rows_that_repeat_a_doc_id(spark):
    shared, other = prose(80, 13), prose(81, 20)
    own = [prose(90 + k, 20) for k in range(6)]
    made = [(1, f"{own[0]} {shared} {own[1]}"), (2, f"{other} {own[2]}")]
    made += [(3, f"{own[3]} {shared} {own[4]}")] * 3  # identical rows with one shared window
    made += [(4, f"{shared} {own[5]}"), (4, f"{own[4][::-1]} {other} tail"), (4, made[0][1]), (5, f"{own[5]} end")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    want = [(i, gone, digest) for i, _, gone, digest in cut(made, 13)]
    assert [w[1] for w in want if w[0] == 3] == [13] * 3
    out = substring.substring_dedup(df).collect()
    assert sorted(((r["doc_id"], r["_n_removed"], hashlib.sha256(b" ".join(words(r["text"]))).hexdigest()) for r in out), key=str) == sorted(want, key=str)


def test_spans_whose_words_differ_from_their_source_do_not_count():
    import pyarrow as pa

    text = prose(86, 40)
    good = substring._span_digests(text, [(3, 2)], 13)[0]
    assert good == hashlib.sha256(b" ".join(words(text)[3:17])).digest()
    spans = [{"at": 3, "n": 2, "digest": good}, {"at": 20, "n": 4, "digest": hashlib.sha256(b"other").digest()}]
    kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([text]), pa.array([spans], kind)], names=["doc_id", "rep", "text", "spans"])
    row = next(substring._apply(13)([batch])).to_pylist()[0]
    assert row["n_removed"] == 14 and row["kept_text"].encode().split() == words(text)[:3] + words(text)[17:]


def test_sources_are_asked_in_several_rows(spark, monkeypatch):
    monkeypatch.setattr(substring, "ASKED", 2)
    source = prose(87, 200).split()
    made = [(0, " ".join(source))] + [(k, " ".join([f"u{k}", *source[7 * k : 7 * k + 13 + k], f"v{k}"])) for k in range(1, 12)]
    out = {r["doc_id"]: r for r in substring.substring_dedup(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    for i, n, gone, digest in cut(made, 13):
        assert out[i]["_n_removed"] == gone and hashlib.sha256(b" ".join(words(out[i]["text"]))).hexdigest() == digest


def test_spans_name_their_source(spark):
    shared = prose(88, 30)
    made = [(3, f"a b c {shared} d"), (8, f"e {shared} f g"), (9, f"h {shared}")]
    _, spans = substring.repeated_spans(spark.createDataFrame(made, "doc_id long, text string"))
    for r in spans.collect():
        (s,) = r["spans"]
        assert (s["at"], s["n"], s["source"]) == (1, 18, 3)
        assert bytes(s["digest"]) == hashlib.sha256(" ".join(shared.split()).encode()).digest()


@pytest.mark.parametrize("group", [1, 300, 1 << 17])
def test_short_texts_are_hashed_together(monkeypatch, group):
    import pyarrow as pa

    texts = ["", prose(1, 12), prose(2, 13), " ", prose(3, 40) + "\n" + prose(2, 30), prose(2, 30) + " " + prose(2, 30), "x " * 40, "é中😀 " * 15, prose(4, 200), ""]
    monkeypatch.setattr(hashing, "GROUP", group)
    data = [t.encode() for t in texts]
    parts = list(hashing.groups(data))
    assert [k for p in parts for k in range(p.start, p.stop)] == list(range(len(texts))) and len(parts) == {1: 10, 1 << 17: 1}.get(group, len(parts))
    for p in parts:
        h, at = hashing.word_hashes_of(data[p])
        assert [h[a:b].tolist() for a, b in zip(at, at[1:])] == [hashing.word_hashes(t).tolist() for t in texts[p]]
        assert hashing.sequence_hashes(h, at, 5).tolist() == [hashing.sequence_hash(hashing.word_hashes(t), 5) for t in texts[p]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts), pa.array([0] * 10)], names=["doc_id", "text", "rep"])
    anchors = next(substring._first_pass(13, 5)(iter([batch])))["anchors"]
    for t, found in zip(texts, anchors.to_pylist()):
        runs = hashing.window_hashes(hashing.word_hashes(t), 5, substring._ANCHOR_SEED)
        assert sorted(a % 2**64 for a in found) == sorted({int(runs[k : k + 9].min()) for k in range(len(runs) - 8)})
    asked = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array([0] * 10), pa.array(texts), anchors], names=["num", "lead", "text", "anchors"])
    got = list(substring._edges(13, 5)(iter([asked])))
    assert len(got) <= len(parts)
    want = []
    for num, t in enumerate(texts):
        edge = hashing.window_hashes(hashing.word_hashes(t), 13, substring._EDGE_SEED).view(np.int64).tolist()
        want += [((num << 30) + k, e) for k, e in enumerate(edge) if e not in edge[:k]]
    assert [(r["place"], r["edge"]) for b in got for r in b.to_pylist()] == want


def test_op3_gives_one_row_for_each_row(spark, tmp_path):
    made = [(1, prose(80, 13) + " a"), (2, "b " + prose(80, 13)), (2, "b " + prose(80, 13)), (2, prose(82, 20)), (3, prose(82, 30)), (3, prose(83, 30))]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    out = substring.op3_substring_dedup(spark, f"file://{tmp_path}").collect()
    assert sorted((tuple(r) for r in out), key=str) == cut(made, 13)


def test_substring_dedup_keeps_columns_and_empty_tables(docs, none):
    out = substring.substring_dedup(docs)
    assert out.columns == [*docs.columns, "_n_removed"] and out.count() == docs.count()
    assert substring.substring_dedup(none).count() == 0


# 4


@pytest.mark.parametrize("seed", range(4))
def test_minimax_against_a_scan(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(sharding, "CELLS", rnd.choice([8, 64]))
    sizes = [rnd.choice([1, 7, 1000, rnd.randint(1, 10**5)]) for _ in range([3, 40, 700, 3000][seed])]
    ends = np.cumsum(sizes).tolist()

    def needs(c):
        n, at = 1, 0
        for s in sizes:
            n, at = (n + 1, s) if at + s > c else (n, at + s)
        return n

    low, high = max(sizes), ends[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needs(mid) <= 8 else (mid + 1, high)
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame([(e,) for e in ends], "end long"), "end", ends[-1], 8)
    assert capacity == low and set(cuts) <= set(ends) and cuts[-1] == ends[-1]


@pytest.mark.parametrize("seed", range(200))
def test_cuts_are_spread_under_the_capacity(seed):
    rnd = random.Random(seed)
    shards, n = rnd.randrange(1, 10), rnd.randrange(1, 30)
    sizes = [rnd.choice([1, 5, 100, rnd.randint(1, 1000)]) for _ in range(n)]
    ends = np.cumsum(sizes).tolist()
    known = sharding._Known(ends[-1], shards)
    known.at, known.hidden = [0, *ends], {}
    capacity = known.smallest(known.sure, 1, ends[-1])
    cuts = known.spread(capacity)
    assert len(cuts) == shards and cuts[-1] == ends[-1] and set(cuts) <= set(ends)
    parts = np.diff([0, *cuts])
    assert parts.max() == capacity and (parts[: min(shards, n)] > 0).all()


def test_no_shard_is_empty_beside_a_large_group(spark):
    made = [(k, "same text of many copies") for k in range(400)] + [(1000 + k, f"t{k}") for k in range(400)]
    got = sharding.shard_by_bytes(spark.createDataFrame(made, "doc_id long, text string"), 8).groupBy("shard").count().collect()
    assert {r["shard"] for r in got} == set(range(8))
    assert min(r["count"] for r in got) > 30


def test_shards_of_odd_rows(docs, none, rows):
    found = sharding.shard_by_bytes(docs, 8).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(8))
    shard = {}
    for r in found:  # equal texts stay together
        shard.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(v) == 1 for v in shard.values())
    assert sharding.shard_by_bytes(none, 8).count() == 0


# 5


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 333, "b": 333, "c": 334}])
def test_pattern_stays_within_one_block(weights):
    shares = mixing.rounded(weights)
    slots, period = mixing.pattern(shares), sum(shares.values())
    for s, share in shares.items():
        done = 0
        for t, got in enumerate(slots, 1):
            done += got == s
            assert abs(done * period - share * t) < period


def test_mixture_places_every_row_once(spark):
    made = [(i, "abc"[0 if i % 10 < 7 else 1 + i % 2], i) for i in range(500)] + [(500, None, 1), (500, None, 1)]
    df = spark.createDataFrame(made, "doc_id long, source string, _position long")
    out = mixing.mix_sources(df, {"a": 1, "b": 1, "c": 2}, block_rows=4)
    got = out.select("doc_id", "source", "_slot", "_block", "_phase").collect()
    assert len(got) == len(made)
    assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in made)
    # Within the first phase each source is less than one block from its target.
    slots = sorted({(r["_slot"], r["source"]) for r in got if r["_phase"] == 0})
    assert [s for s, _ in slots] == list(range(len(slots)))
    for t in range(1, len(slots) + 1):
        for s, share in (("a", 0.25), ("b", 0.25), ("c", 0.5)):
            assert abs(sum(x == s for _, x in slots[:t]) - share * t) <= 1 + 1e-9


@pytest.mark.parametrize("weights, sizes", [(None, [20000, 14000, 10000, 8000, 5000, 3000]), ({"a": 1, "b": 0.00005}, [40000, 8]), ({"a": 3, "b": 2}, [20000, 20000])])
def test_prefixes_stay_within_one_block_of_the_unrounded_weights(spark, weights, sizes):
    names = "abcdef"[: len(sizes)]
    made = [(i, c) for c, n in zip(names, sizes) for i in range(n)]
    out = mixing.mix_sources(spark.createDataFrame(made, "doc_id long, source string"), weights, block_rows=4)
    got = out.where("_phase = 0").select("_slot", "source").distinct().orderBy("_slot").collect()
    assert [r["_slot"] for r in got] == list(range(len(got))) and len(got) > 3000
    target = np.array([weights[c] if weights else n**0.5 for c, n in zip(names, sizes)])
    done = np.cumsum([[r["source"] == c for c in names] for r in got], axis=0)
    off = done - np.outer(np.arange(1, len(got) + 1), target / target.sum())
    assert np.abs(off).max() < 1 + 1e-9
    assert out.count() == len(made) and out.select("_position").distinct().count() == len(made)


def simulated(rows, weights, block_rows, slots):
    """A plain scheduler: Fractions, every source looked at in every slot."""
    from fractions import Fraction

    left = {s: -(-n // block_rows) for s, n in rows.items()}
    weight = {s: Fraction(weights[s]) for s in rows}
    fluid, ran, out, shares = dict.fromkeys(rows, Fraction(0)), dict.fromkeys(rows, 0), [], []
    for _ in range(slots):
        # The fluid's next slot, over the ends of sources within it.
        time = Fraction(1)
        while time and (live := [s for s in rows if fluid[s] < left[s]]):
            total = sum(weight[s] for s in live)
            step = min([time, *((left[s] - fluid[s]) * total / weight[s] for s in live)])
            for s in live:
                fluid[s] += step * weight[s] / total
            time -= step
        shares.append(dict(fluid))
    for t in range(slots):
        before = shares[t - 1] if t else dict.fromkeys(rows, 0)
        # Released within this slot: the fluid has begun on the block before the slot ends.
        ready = [s for s in rows if ran[s] < left[s] and ran[s] < shares[t][s]]
        deadline = lambda s: next((u for u in range(t, slots) if shares[u][s] >= ran[s] + 1), slots)
        s = min(ready, key=lambda s: (deadline(s), list(rows).index(s)))
        out.append(s)
        ran[s] += 1
        assert all(abs(ran[x] - shares[t][x]) < 1 for x in rows)
    return out


@pytest.mark.parametrize("rows, weights", [({"a": 40, "b": 30, "c": 9}, {"a": 1, "b": 2, "c": 0.5}), ({"a": 33, "b": 1, "c": 12, "d": 12}, {"a": 1 / 3, "b": 7, "c": 1 / 7, "d": 0.1})])
def test_schedule_against_a_plain_scheduler(rows, weights):
    got = {}
    mixing.schedule(rows, weights, 1, lambda s, cell, slots, places, phases: got.update({(cell, at): s for at in slots}))
    order = [s for (_, at), s in sorted(got.items(), key=lambda x: x[0][1])]
    assert order == simulated(rows, weights, 1, sum(rows.values()))


def fluid_deviation(rows, weights, block_rows):
    """The schedule's slots by source, and the largest distance from the fluid at any slot."""
    slots = {s: [] for s in rows}
    mixing.schedule(rows, weights, block_rows, lambda s, cell, at, places, phases: slots[s].extend(at))
    n = {s: -(-r // block_rows) for s, r in rows.items()}
    ends = sorted((n[s] / weights[s], s) for s in rows)
    clock, served, total, blocks = [0.0], [0.0], sum(weights.values()), 0
    for v, s in ends:
        served.append(served[-1] + total * (v - clock[-1]))
        clock.append(v)
        total -= weights[s]
    worst = 0.0
    for s, at in slots.items():
        at = np.array(at)
        assert len(at) == n[s] and (np.diff(at) > 0).all()
        share = lambda t: np.minimum(np.interp(t, served, clock) * weights[s], n[s])
        k = np.arange(len(at))
        worst = max(worst, (share(at) - k).max(), (k + 1 - share(at + 1)).max())
    return sorted(x for at in slots.values() for x in at), worst


def test_a_million_slots_stay_within_one_block_of_exact_weights():
    taken, worst = fluid_deviation({"a": 500_000, "b": 400_000, "c": 100_000, "d": 37}, {"a": 1 / 3, "b": 2 / 3, "c": 0.0001, "d": 0.01}, 1)
    assert taken == list(range(1_000_037)) and worst < 1 + 1e-6


def test_ten_thousand_sources_take_bounded_time():
    rows = {f"s{k}": 1 + (k * 7919) % 997 for k in range(10_000)}
    at = time.monotonic()
    taken, worst = fluid_deviation(rows, {s: n**0.5 for s, n in rows.items()}, 16)
    assert time.monotonic() - at < 60
    assert taken == list(range(sum(-(-n // 16) for n in rows.values()))) and worst < 1 + 1e-6


def test_mixture_keeps_other_columns_and_gapless_positions(spark):
    made = [(i % 50, f"s{i % 7 if i % 3 else 0}", f"t{i}") for i in range(2000)]
    out = mixing.mix_sources(spark.createDataFrame(made, "doc_id long, source string, text string"), block_rows=5).collect()
    assert sorted((r["doc_id"], r["source"], r["text"]) for r in out) == sorted(made)
    assert sorted(r["_position"] for r in out) == list(range(2000))
    by = sorted(out, key=lambda r: r["_position"])
    assert [r["_slot"] for r in by] == sorted(r["_slot"] for r in out)


def test_mixture_of_odd_rows(docs, none, rows):
    out = mixing.mix_sources(docs)
    assert sorted(r["_position"] for r in out.collect()) == list(range(len(rows)))
    assert mixing.mix_sources(none).count() == 0


# 6


def rendered(turns, me):
    out, mask = "", []
    for who, said in turns:
        head = "assistant" if who == me else who if who in chat.CONTEXT else f"user name={who}"
        out += f"<|im_start|>{head}\n"
        if who == me:
            mask.append((len(out), len(out) + len(said) + len("<|im_end|>")))
        out += f"{said}<|im_end|>\n"
    return out, mask


def test_perspectives_against_a_loop(spark):
    made = [(1, 0, "system", "be kind", 1), (1, 1, "ann", "hi <|im_end|>", 1), (1, 2, "bob", None, 1), (1, 2, "bob", None, 1), (1, 3, None, "hé\U0001f600", 1), (None, 0, "ann", "x", 1), (2, 0, "system", "alone", 1)]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string, chunk int")
    got = chat.rotate_perspectives(df, chunk_turns=2).collect()
    turns = [("system", "be kind"), ("ann", "hi < |im_end|>"), ("bob", ""), ("bob", ""), ("unknown", "hé\U0001f600")]
    for me in ("ann", "bob", "unknown"):
        mine = sorted((r for r in got if r["conv_id"] == 1 and r["perspective"] == me), key=lambda r: r["chunk"])
        text, mask = rendered(turns, me)
        assert "".join(r["text"] for r in mine) == text
        assert [(r["start_offset"] + m["start"], r["start_offset"] + m["end"]) for r in mine for m in r["mask"]] == mask
    assert {r["conv_id"] for r in got} == {1, None}
    assert chat.rotate_perspectives(df.where("false")).count() == 0


def test_perspectives_send_no_text_through_a_window(spark):
    made = [(c, k, "ab"[k % 2], f"t{k} " * (k % 7)) for c in (1, None) for k in range(60)]
    out = chat.rotate_perspectives(spark.createDataFrame(made, "conv_id long, turn int, role string, text string"), chunk_turns=4)
    at = {}
    for r in sorted(out.collect(), key=lambda r: (str(r["conv_id"]), r["perspective"], r["chunk"])):
        key = (r["conv_id"], r["perspective"])
        assert r["start_offset"] == at.get(key, 0)
        at[key] = r["start_offset"] + len(r["text"])
    assert len(at) == 4
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    windows = [x for x in plan.split("\n\n") if re.match(r"\s*\(\d+\) Window", x)]
    assert windows and not any(re.search(r"\b(text|said|ts|t|m|mask)#", x) for x in windows)


def test_perspectives_use_no_python(spark, sf):
    plan = chat.op6_perspective_rotation(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 7


def test_ranking_learns_and_held_out_accuracy(spark, sf):
    out = classifier.op7_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    held = out.where("held_out").select("predicted", "quality").collect()
    assert len(held) > 30 and sum(r[0] == r[1] for r in held) / len(held) > 0.95


def test_scores_of_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (12, 0, 0), (9, 1, 0), (None, 1, 0), (15, 0, None), (15, 1, None)], "doc_id long, quality int, toxic int")
    model = classifier.learn(docs, labels)
    got = classifier.score(docs, model, ("doc_id", "_score"))
    assert got.count() == docs.count()
    scores = [r[0] for r in classifier.score(docs, model, ("doc_id",)).select("_score").collect()]
    assert all(0 <= s <= 1 for s in scores)
    flat = classifier.learn(docs, labels.where("false"))
    assert {r["_score"] for r in classifier.score(docs, flat, ()).collect()} == {0.5}
    assert classifier.score(none, model, ("doc_id",)).count() == 0


# 8


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(3)
    made = []
    for c in range(12):
        centre = rng.normal(size=24)
        for _ in range(8):
            made.append((len(made), (centre + rng.normal(size=24) * rng.choice([0.05, 0.12, 0.2])).astype(np.float32).tolist(), c % 2, "x"))
    made += [(len(made) + k, made[0][1], 0, "x") for k in range(3)]
    n = len(made)
    odd = [(n, None, 0, "x"), (n + 1, [], 0, "x"), (n + 2, [0.0] * 24, 0, "x"), (n + 3, [float("nan")] * 24, 0, "x"), (n + 4, [None] * 24, 0, "x"), (n + 5, made[0][1], None, "x"), (None, made[0][1], 0, "x"), (n + 6, [1.0], 0, "x")]
    df = spark.createDataFrame(made + odd, "vec_id long, embedding array<float>, label int, block string")
    got = {r["vec_id"]: r for r in embeddings.near_duplicate_vectors(df).collect()}
    x = np.array([m[1] for m in made], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([m[2] for m in made])
    link = (x @ x.T >= 0.98 - 1e-12) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    comp = np.arange(n)
    for _ in range(n):
        comp = np.array([min(comp[i], *comp[link[i]]) if link[i].any() else comp[i] for i in range(n)])
    assert 10 < link.sum() < n * n / 2
    for i in range(n):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[i].sum(), comp[i], comp[i] == i)
    for i in range(n, n + 7):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["n_links"] == 0 and got[None]["kept"]
    assert embeddings.near_duplicate_vectors(df.where("false")).count() == 0


def test_blocks_that_lie_apart_are_not_dealt(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    seen, table = {}, common.Scratch.table

    def counted(self, df, name):
        out = table(self, df, name)
        seen[name] = out.count() if name == "tiles" else 0
        return out

    monkeypatch.setattr(common.Scratch, "table", counted)
    rng = np.random.default_rng(5)
    made, x = [], []
    for c in range(30):
        centre = rng.normal(size=16)
        for _ in range(32):
            x.append((centre + rng.normal(size=16) * 0.1).astype(np.float32))
            made.append((len(made), x[-1].tolist(), 0))
    x = np.array(x, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.98).sum(axis=1) - 1
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(made, "vec_id long, embedding array<float>, label int")).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(links.tolist())) and links.sum() > 1000
    assert seen["tiles"] < 121 * 120 / 2 / 3


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", 400)
    made = [(k, [1.0, k * 0.01], None if k == 7 else 1) for k in range(60)] + [(60, [1.0, 0.0, 0.0], 1), (61, [2.0, 0.0, 0.0], 1)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicate_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>, label int")).collect()}
    x = np.array([m[1] for m in made[:60]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.98
    link[7] = link[:, 7] = False
    want = link.sum(axis=1) - 1
    assert all(got[k]["n_links"] == (want[k] if k != 7 else 0) for k in range(60))
    assert got[60]["n_links"] == got[61]["n_links"] == 1


def test_quantisation_bound_holds():
    rng = np.random.default_rng(0)
    u, q, s, big, err = embeddings.quantised(rng.normal(size=(200, 64)) * rng.uniform(0.01, 100, size=(200, 1)))
    about = (q.astype(np.int64) @ q.astype(np.int64).T) * (s[:, None] * s)
    bound = big[:, None] * err + err[:, None] * big + err[:, None] * err
    assert (np.abs(u @ u.T - about) <= bound + 1e-12).all()


# 9


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.word_bpe_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(docs, rows, library, none):
    got = bpe.bpe_encode(docs, bpe.word_bpe_path(), ("doc_id", "kept"), decoded=True).collect()
    want = {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.setdefault(i, []).append((struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)))
    assert len(got) == len(rows)
    for r in got:
        assert (bytes(r["_ids"]), r["_decoded"]) in want[r["doc_id"]]
    assert bpe.bpe_encode(none, bpe.word_bpe_path()).count() == 0


def test_bpe_equals_the_library_on_random_strings(library):
    codec = bpe.Codec(open(bpe.word_bpe_path(), encoding="utf-8").read())
    rnd = random.Random(4)
    letters = [*"abcxyzABC  \n\t'!?.,-0123456789éßΣİ中文Ж\U0001f600́​  \x1c\x85½٠", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|"]
    for _ in range(1500):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 40)))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == want, text
        assert codec.decode(codec.encode(text)) == library.decode(want, skip_special_tokens=False)


LOWER = {"type": "Lowercase"}
NORMALISERS = {
    "none": None,
    "one step": LOWER,
    "composed": {"type": "Sequence", "normalizers": [{"type": "NFC"}]},
    "letters": {"type": "Sequence", "normalizers": [{"type": "Replace", "pattern": {"String": "a"}, "content": "zb"}, LOWER]},
    "before": {"type": "Sequence", "normalizers": [{"type": "Prepend", "prepend": "Q"}, LOWER]},
}


@pytest.mark.parametrize("kind", NORMALISERS)
def test_bpe_follows_the_normaliser_of_the_file(kind):
    from tokenizers import Tokenizer

    spec = json.loads(open(bpe.word_bpe_path(), encoding="utf-8").read())
    spec["normalizer"] = NORMALISERS[kind]
    file = json.dumps(spec)
    codec, other = bpe.Codec(file), Tokenizer.from_str(file)
    for text in ("Anna's CAB ran\tFAST, 12 times", "Été À LA carte", "a", "  A  "):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_ascii_path_only_for_known_steps():
    spec = json.loads(open(bpe.word_bpe_path(), encoding="utf-8").read())
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    assert bpe._ascii_normaliser(spec["normalizer"], pattern) is str.lower
    assert bpe._ascii_normaliser(spec["normalizer"], pattern + "| ?[a-z]+") is None
    assert bpe._ascii_normaliser(None, pattern) is str
    assert bpe._ascii_normaliser({"type": "Strip"}, pattern) is None


def test_cuts_of_short_words_take_no_array(monkeypatch):
    codec, rnd = bpe.Codec(open(bpe.word_bpe_path(), encoding="utf-8").read()), random.Random(6)
    words = ["".join(rnd.choice("abqxz#!中ßЖé") for _ in range(rnd.randrange(1, 90))).encode() for _ in range(300)]
    plain = [[i for i in range(1, len(w)) if not codec.adjacent[w[i - 1], w[i]]] for w in words]
    assert [codec.cuts(w) for w in words] == plain
    monkeypatch.setattr(bpe, "np", None)
    assert [codec.cuts(w) for w in words if len(w) < 60] == [c for w, c in zip(words, plain) if len(w) < 60]
    assert codec.encode("a word中q and<|endoftext|>")


def test_forced_boundaries_cut_where_no_token_reaches():
    codec = bpe.Codec(open(bpe.word_bpe_path(), encoding="utf-8").read())
    back = {c: b for b, c in enumerate(codec.letters)}
    word = "中文qxЖzz".encode()
    cuts = codec.cuts(word)
    assert cuts
    held = [bytes(back[c] for c in t.removesuffix("</w>")) for t in codec.tokens if t not in codec.added]
    for c in cuts:
        assert not any(word[c - 1 : c + 1] in t for t in held)


# 10


def test_archives_round_trip(spark, tmp_path):
    made = [(1, "http://a/", "same"), (2, None, "same"), (9, "http://b/\r\nX: y", "same"), (3, "u", None), (4, "u", ""), (5, "u", "päge" * 5000), (5, "u", "päge" * 5000), (None, "u", "same"), (None, "u", "lone")]
    df = spark.createDataFrame([(*m, "z") for m in made], "page_id long, url string, html string, payload string")
    manifest = common.Scratch(spark, "t").table(warc.write_archives(df, f"file://{tmp_path}/a"), "m")
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(made)
    by = {(r["record_id"], r["payload_digest"]): r for r in got}
    same = warc.sha1_base32(b"same")
    assert by["<urn:page:9>", same]["record_type"] == "response" and bytes(by["<urn:page:9>", same]["payload"]) == b"same"
    assert by["<urn:page:1>", same]["refers_to_id"] == by["<urn:page:null>", same]["refers_to_id"] == "<urn:page:9>"
    assert by["<urn:page:3>", warc.sha1_base32(b"")]["refers_to_id"] == "<urn:page:4>"
    assert sum(r["record_type"] == "response" and r["record_id"] == "<urn:page:5>" for r in got) == 2
    assert by["<urn:page:5>", warc.sha1_base32(("päge" * 5000).encode())]["payload_bytes"] == 25000
    empty = warc.write_archives(df.where("false"), f"file://{tmp_path}/b")
    assert warc.read_archives(empty).count() == 0


@pytest.mark.parametrize("harm", [lambda r: r.replace(b"WARC/1.1", b"JUNK/1.1"), lambda r: r[:-2], lambda r: r + b"x", lambda r: r.replace(b"hello", b"jello"), lambda r: r.replace(b"WARC-Type: response\r\n", b"")])
def test_reader_refuses_bad_records(harm):
    good = warc.record(1, "u", b"hello", None)
    assert warc.parse(good)[0]["X-Payload-Length"] == "5"
    with pytest.raises(warc.BadRecord):
        warc.parse(harm(good))


def test_archive_layout():
    import io

    import zstandard

    shared = warc.dictionary([prose(k, 200).encode() for k in range(300)])
    assert shared
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(shared))
    records = [warc.record(k, "u", prose(k, 50).encode(), None) for k in range(5)]
    data = warc.leading_frame(shared) + b"".join(map(packer.compress, records))
    assert data[:4] == struct.pack("<I", 0x184D2A5D)
    assert list(warc.frames(io.BytesIO(data))) == records
    for short in (data[:-3], data[4:], data[:20]):
        with pytest.raises((warc.BadRecord, zstandard.ZstdError)):
            list(warc.frames(io.BytesIO(short)))
