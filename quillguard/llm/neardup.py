"""Near-duplicate documents by HyperMinHash sketches, banding and exact verification.

1. A document's set of word shingles gets a sketch of ``BANDS * ROWS`` registers
   (:mod:`.hyperminhash`).  Documents with the same set form a class, named by its smallest
   id; only one of them goes on, so thousands of copies cost one.
2. Bands of registers are keys; classes that share a key are candidates.  At the contract's
   similarity of 0.85 two sets miss all 40 bands of 5 registers with probability 6e-11, at
   0.8 with 1e-7.
3. A key's hub is its member that shares the most keys with others, as the text that many
   were copied from does.  A class is labelled with the hub of its commonest key; classes in
   order of labels are cut into blocks of bounded rows and bytes, and each block gets the hubs
   of its labels too.  Inside a block's task the pairs with an equal band, a possible size
   ratio and a collision-corrected estimate not clearly too low are compared on their full
   sets; pairs joined already are skipped, and a task emits what its links join as stars
   around the smallest ids.
   A group of near copies larger than a block is thus joined over its hubs, and costs as many
   rows as it has members.
4. Only keys whose members still lie in several blocks and several components are left: for
   these, pairs of blocks meet in one task each, with the classes that hold such a key and
   lie outside of its commonest component on one side at least.
5. Components come from the stars of all tasks by star contraction in Spark.

Defined results: null text, empty text or text without words has an empty set and is linked
with nothing; each row's text is compared for itself, and rows that share a doc_id are one
node of the components, which their texts' links all reach; a row with a null doc_id takes
no part, gets a null component and is kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components, frugal, least_of_group, ordered
from .hashing import _splitmix, mix, shingle_set
from .hyperminhash import EMPTY, band_keys, jaccard_estimate, registers

BANDS, ROWS = 40, 5
#: A block's bounds: classes, and shingles in all (8 bytes each).
BLOCK_CLASSES, BLOCK_SHINGLES = 2048, 1_500_000
#: An estimate this many standard errors under the threshold rules a pair out; the chance
#: of losing a link that shares a band is below 1e-6.
SIGMAS = 5.0


def repeats(df: DataFrame, doc_id: str = "doc_id") -> bool:
    """Whether any doc_id is found in several rows."""
    ids = df.select(F.col(doc_id).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").groupBy("doc_id").count()
    return not ids.where("count > 1").isEmpty()


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            size, one, two, sketch = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width)
                size.append(len(s))
                # Order-free sums of two mixes of the elements name the set in 128 bits.
                with np.errstate(over="ignore"):
                    one.append(mix(s).sum(dtype=np.uint64).astype(np.int64) if len(s) else 0)
                    two.append(mix(s * np.uint64(_splitmix(1) | 1)).sum(dtype=np.uint64).astype(np.int64) if len(s) else 0)
                sketch.append(registers(s, BANDS * ROWS).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sketch, pa.binary())],
                names=["doc_id", "n", "one", "two", "sketch"],
            )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sketch) -> one row per filled band."""
    for batch in batches:
        found = [band_keys(np.frombuffer(s, np.uint16), ROWS)[1] for s in batch.column(1).to_pylist()]
        nodes = np.repeat(batch.column(0).to_numpy(), [len(k) for k in found])
        keys = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.int64())], names=["node", "key"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width).tobytes() for t in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sets, pa.binary())], names=[*batch.schema.names[:-1], "shingles"])

    return run


def _blocks(placed: DataFrame, classes: int, shingles: int) -> DataFrame:
    """(node, n, label) with ``_part`` and ``_idx`` -> node, block, label: in order, blocks of
    at most ``classes`` rows and little over ``shingles`` shingles, whatever the parts are."""
    rows = total = 0
    starts = []
    for part, n, held in placed.groupBy("_part").agg(F.count("*"), F.sum("n")).orderBy("_part").collect():  # one row per part
        starts.append((part, rows, total))
        rows, total = rows + n, total + held
    at = placed.sparkSession.createDataFrame(starts, "_part int, _rows long, _held long")
    before = F.sum("n").over(Window.partitionBy("_part").orderBy("_idx")) - F.col("n")
    found = placed.withColumn("_before", before).join(F.broadcast(at), "_part")
    block = F.floor((F.col("_rows") + F.col("_idx")) / classes) + F.floor((F.col("_held") + F.col("_before")) / shingles)
    return found.select("node", block.alias("block"), "label")


def _unsettled(scratch: Scratch, members: DataFrame, blocks: DataFrame, joined: DataFrame) -> DataFrame | None:
    """(i, j, side, node, component): the classes that blocks i and j must still compare; None
    if there are none.

    A key is unsettled if its members lie in several blocks and components.  Its commonest
    component needs no look at itself, so all members go to the blocks of those outside of
    it, and these to the blocks of all members.  Keys with the same blocks are one kind, so a
    class with many keys of a group goes to a block once."""
    at = members.select("key", "node").join(blocks.select("node", "block"), "node").join(joined, "node", "left")
    at = at.select("key", "node", "block", F.coalesce("component", "node").alias("component"))
    within = scratch.table(at.groupBy("key", "block", "component").agg(F.count("*").alias("n")), "within")
    whole = within.groupBy("key", "component").agg(F.sum("n").alias("n"))
    whole = whole.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("components")).where("components > 1")
    spread = within.groupBy("key").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high")
    keys = scratch.table(whole.join(spread, "key").select("key", F.col("top.component").alias("main")), "keys")
    if keys.isEmpty():
        return None
    within = within.join(keys, "key").select("key", "block", (F.col("component") != F.col("main")).alias("minor"))
    kind = lambda of: F.struct(F.bit_xor(F.xxhash64(of)), F.bit_xor(F.xxhash64(of, F.lit(1))))
    out = []
    # Members to the blocks of minor ones; minor ones to all blocks.
    for others, who in ((within.where("minor"), F.lit(True)), (within, F.col("component") != F.col("main"))):
        others = others.select("key", F.col("block").alias("other")).distinct()
        kinds = scratch.table(others.groupBy("key").agg(kind("other").alias("kind")), "kinds")
        held = others.join(kinds, "key").select("kind", "other").distinct()
        sent = at.join(keys, "key").where(who).join(kinds, "key").select("kind", "node", "block", "component").distinct()
        out.append(sent.join(held, "kind").where("block <> other").select("node", "block", "component", "other"))
    both = out[0].unionByName(out[1]).distinct()
    return both.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "component")


def _compare(num: int, den: int):
    """One tile: what links with den * |A and B| >= num * |A or B| join, an edge from each
    component to the smallest of those that it is joined with."""
    share = num / den
    least = share - SIGMAS * (share * (1 - share) / (BANDS * ROWS)) ** 0.5

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        order = np.lexsort((node, table.column("side").to_numpy()))
        table = table.take(pa.array(order))
        node, side, size = node[order], table.column("side").to_numpy(), table.column("n").to_numpy()
        regs = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(len(node), BANDS * ROWS)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        tiles_differ = bool(side.max() > side.min())
        keys = np.zeros((len(node), BANDS), np.uint64)
        for i in range(len(node)):
            b, k = band_keys(regs[i], ROWS)
            keys[i, b] = k
        # Candidates come from sorting each band's keys.  Links join at once, and what earlier
        # steps joined starts so, hence a pair that is joined already is never estimated: a
        # group of near copies costs its members, not its pairs.
        names, before = np.unique(table.column("component").to_numpy(), return_inverse=True)
        joined = before.copy()
        tried = np.zeros((len(node), len(node)), bool)  # the square of a block's members and hubs

        def link(a: int, others: np.ndarray) -> None:
            est = jaccard_estimate(regs[others], np.broadcast_to(regs[a], (len(others), BANDS * ROWS)), size[others], np.full(len(others), size[a]))
            for k in np.argsort(-est, kind="stable"):
                b = others[k]
                if est[k] < least:
                    break
                if joined[a] == joined[b]:
                    continue
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if den * both >= num * (int(size[a]) + int(size[b]) - both):
                    joined[joined == joined[b]] = joined[a]

        for band in range(BANDS):
            by = np.argsort(keys[:, band], kind="stable")
            k = keys[by, band]
            cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
            for g in np.flatnonzero(np.diff(cut) > 1):
                own = by[cut[g] : cut[g + 1]]
                if k[cut[g]] == 0:
                    continue
                for x in range(len(own) - 1):
                    a, rest, step = own[x], own[x + 1 :], 16
                    rest = rest[joined[rest] != joined[a]]
                    if tiles_differ:
                        rest = rest[side[rest] != side[a]]
                    rest = rest[den * np.minimum(size[rest], size[a]) >= num * np.maximum(size[rest], size[a])]
                    rest = rest[~tried[a, rest]]  # a pair is taken at its first common band only
                    while len(rest):  # in growing slices, as each link can settle the others
                        tried[a, rest[:step]] = tried[rest[:step], a] = True
                        link(a, rest[:step])
                        rest, step = rest[step:], 2 * step
                        rest = rest[joined[rest] != joined[a]]
        after, first = np.zeros(len(names), np.int64), np.full(len(names), len(names))
        after[before] = joined
        np.minimum.at(first, after, np.arange(len(names)))
        moved = np.flatnonzero(first[after] < np.arange(len(names)))
        return pa.table({"a": pa.array(names[moved], pa.int64()), "b": pa.array(names[first[after[moved]]], pa.int64())})

    return run


def _components(scratch: Scratch, docs: DataFrame, sketched: DataFrame, width: int, similarity: tuple[int, int], block_classes: int, block_shingles: int) -> DataFrame:
    """(doc_id, component) of the documents with words; ``doc_id`` is not null and unique."""
    num, den = similarity
    written = scratch.table
    named = least_of_group(sketched.select("doc_id", "one", "two", "n"), ["one", "two", "n"], "doc_id", "node")
    named = written(named.select("doc_id", "node", "n"), "classes")
    firsts = named.where("doc_id = node").select("node", "n")

    own = sketched.select(F.col("doc_id").alias("node"), "sketch").join(firsts.select("node"), "node", "left_semi")
    own = own.mapInArrow(frugal(_keys), "node long, key long")
    members = written(least_of_group(own, ["key"], "node", "low", shared=True).select("key", "node", F.col("low_rows").alias("c")), "members")
    # The greatest (keys shared in all, -node) of a key's members is its hub.
    weight = members.groupBy("node").agg(F.sum("c").alias("weight"))
    ranked = members.join(weight, "node").select("key", "c", "node", F.struct((-F.col("weight")).alias("w"), "node").alias("rank"))
    hubs = written(least_of_group(ranked, ["key"], "rank", "hub", spread="node").select("node", "c", F.col("hub.node").alias("hub")), "hubs")
    # The label: the hub of the commonest key, the smallest of several.
    label = hubs.groupBy("node").agg(F.min(F.struct((-F.col("c")).alias("c"), "hub")).alias("best")).select(F.col("best.hub").alias("label"), "node")
    placed = ordered(scratch, label.join(firsts, "node").select("label", "node", "n"), "label", "node")
    blocks = written(_blocks(placed, block_classes, block_shingles), "blocks")

    full = docs.join(blocks.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    full = full.mapInArrow(frugal(_sets(width)), "doc_id long, shingles binary")
    sketches = sketched.select("doc_id", "n", "sketch").join(firsts.select("node"), F.col("doc_id") == F.col("node"), "left_semi")
    full = written(full.join(sketches, "doc_id").select(F.col("doc_id").alias("node"), "n", "sketch", "shingles"), "sets")

    def links(deals: DataFrame, name: str) -> DataFrame:
        dealt = written(deals, "deals").join(full, "node").select("i", "j", "side", "node", "component", "n", "sketch", "shingles")
        return written(dealt.groupBy("i", "j").applyInArrow(_compare(num, den), "a long, b long"), name)

    # A class goes to its own block's task, and a hub to those of the blocks labelled with it.
    own_block = blocks.select("node", "block").unionByName(blocks.select(F.col("label").alias("node"), "block")).distinct()
    first = links(own_block.select("node", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"), F.col("node").alias("component")), "links")
    joined = written(connected_components(scratch, first), "joined")
    scratch.drop("hubs", "links")

    across = _unsettled(scratch, members, blocks, joined)
    if across is not None:
        second = links(across, "links")
        joined = written(connected_components(scratch, joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second)), "joined")
    scratch.drop("sets", "members", "ordered", "within")
    out = named.select("doc_id", "node").join(joined, "node", "left")
    return out.select("doc_id", F.coalesce("component", "node").alias("component"))


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: tuple[int, int] = (80, 100),
    block_classes: int = BLOCK_CLASSES, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Per row of ``df``: doc_id, n_shingles, component_id, kept.

    Documents whose ``width``-word shingle sets have ``den * |A and B| >= num * |A or B|``
    for ``similarity = (num, den)`` are linked; a component is named by its smallest id.
    """
    scratch = Scratch(df.sparkSession, "near-duplicates")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    several = repeats(docs)
    if several:  # each text by itself, numbered in the order of doc_id
        rows = ordered(scratch, docs, "doc_id", "text")
        rows = rows.withColumn("row", F.shiftleft(F.col("_part").cast("long"), 33) + F.col("_idx"))
        docs = rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text")
        names = rows.where("doc_id IS NOT NULL").select("row", F.col("doc_id").alias("name"))
    sketched = scratch.table(docs.mapInArrow(frugal(_sketches(width)), "doc_id long, n long, one long, two long, sketch binary"), "sketches")
    found = _components(scratch, docs, sketched.where("n > 0 AND doc_id IS NOT NULL"), width, similarity, block_classes, block_shingles)
    out = sketched.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    if several:
        out = scratch.table(out, "found").join(names, F.col("doc_id") == F.col("row"), "left").drop("row")
        first = out.groupBy("component").agg(F.min("name").alias("first")).where("component IS NOT NULL")
        reached = scratch.table(out.select("name", "component").join(first, "component").select("name", "first"), "reached")
        joined = connected_components(scratch, reached, "name", "first").withColumnRenamed("component", "reaches")
        out = out.join(joined, F.col("name") == F.col("node"), "left").select(F.col("name").alias("doc_id"), "n_shingles", F.col("reaches").alias("component"))
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, width=3, similarity=(85, 100))


#: All pairs by an inverted index; fit for the small sizes only.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
o AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY c, x) AS pos FROM (SELECT doc_id, n, x, count(*) OVER (PARTITION BY x) AS c FROM e)),
f AS (SELECT doc_id, n, x FROM o WHERE pos <= n - ceil(0.85 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
l AS (SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 85 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id WHERE r.root < u.b)
SELECT s.doc_id, len(s.s) AS n_shingles, m.root AS component_id, s.doc_id = m.root AS kept
FROM s JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m USING (doc_id)
"""
