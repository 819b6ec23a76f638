"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors of one label are compared with each other.  Vectors with the same bytes form a class
with a count.  Classes lie in order of label, nearest pivot and distance to it, in blocks of
at most ``BLOCK`` classes and ``BLOCK_BYTES`` bytes.  The pivots are ``PIVOTS`` vectors with the
smallest hashes; any pivots give right results.  Each block knows its least and greatest
distance to every pivot, and as distances on the sphere obey the triangle inequality, two
blocks whose ranges for some pivot lie further apart than linked vectors can, hold no link:
such tiles are not dealt.  How many that spares depends on the data; vectors spread evenly
spare none, and then the work grows with the square of a label's classes.

A class's unit vector u is stored as s * q + e with int8 q; tiles multiply the int8 parts, and

    |u . v - su sv qu . qv|  <=  |su qu| |ev| + |eu| |sv qv| + |eu| |ev|

bounds what quantisation can hide.  Only pairs whose bound reaches the threshold are computed
in double precision; a pair is never decided on the int8 product alone.  A tile returns each
class's number of linked vectors and a spanning forest of its links, so the output grows with
the vectors and not with the pairs.

Defined results: a null label, a null, empty or zero vector, or one with null or non-finite
components links with nothing, itself included; repeated rows are separate vectors that
link; rows that share a vec_id are one node of the components; a row with a null vec_id takes
no part (no links, null component, kept); other columns are not read.  Vectors of different
length under one label are not comparable and do not link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components, frugal, ordered

BLOCK, BLOCK_BYTES = 4096, 32 << 20
PIVOTS = 64
_STRIPE = 512
#: Bytes of vectors gathered at a time for products in full precision.
_GATHER_BYTES = 16 << 20
#: Slack for rounding in the unit vectors and in the bound itself.
_SLACK = 1e-9


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) -> vectors as bytes of doubles, null if not comparable."""
    for batch in batches:
        out: list[bytes | None] = []
        lists = batch.column(2)
        for i in range(batch.num_rows):
            item, packed = lists[i], None
            if item.is_valid and not item.values.null_count:
                v = np.asarray(item.values.to_numpy(zero_copy_only=False), np.float64) + 0.0
                if len(v) and np.isfinite(v).all() and v.any():
                    packed = v.tobytes()
            out.append(packed)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "bytes"])


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, int8 parts, scales, norms of the int8 parts, norms of the errors)."""
    u = _units(x)
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None]).astype(np.int8)
    back = q * s[:, None]
    return u, q, s, np.linalg.norm(back, axis=1), np.linalg.norm(u - back, axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of unit vectors to the pivots."""
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def _nearest(pivots: dict[int, np.ndarray]):
    """(label, bytes, node, count) -> the same, the nearest pivot of that length, and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, far = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            data = batch.column(1).to_pylist()
            lengths = np.array([len(d) for d in data])
            for length in np.unique(lengths):
                if int(length) in pivots:
                    at = np.flatnonzero(lengths == length)
                    d = _distances(_units(np.frombuffer(b"".join(data[i] for i in at), np.float64).reshape(len(at), -1)), pivots[int(length)])
                    near[at], far[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(far)], names=["label", "bytes", "node", "count", "near", "far"])

    return run


def _ranges(pivots: dict[int, np.ndarray]):
    """(label, block, bytes) -> per label, block and length the least and greatest distance to
    each pivot of that length, as found in one slice of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(2).to_pylist()
            groups: dict[tuple, list[int]] = {}
            for i, (label, block, d) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), data)):
                groups.setdefault((label, block, len(d)), []).append(i)
            low, high = [], []
            for (_, _, length), at in groups.items():
                if length in pivots:
                    d = _distances(_units(np.frombuffer(b"".join(data[i] for i in at), np.float64).reshape(len(at), -1)), pivots[length])
                    low.append(d.min(axis=0).tolist())
                    high.append(d.max(axis=0).tolist())
                else:
                    low.append([])
                    high.append([])
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            cols = [[k[0] for k in groups], [k[1] for k in groups], [k[2] for k in groups], low, high]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["label", "block", "length", "low", "high"])

    return run


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _chained(pivots: np.ndarray) -> np.ndarray:
    """The pivots, each followed by the nearest of those left, so that a block that spans two
    cells holds neighbours."""
    order, left = [0], list(range(1, len(pivots)))
    while left:
        order.append(left.pop(int(np.argmax(pivots[left] @ pivots[order[-1]]))))
    return pivots[order]


def _tile(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        side = table.column("side").to_numpy()
        data = table.column("bytes").to_pylist()
        order = np.array(sorted(range(len(node)), key=lambda i: (side[i], len(data[i]), node[i], data[i])))
        node, side, data = node[order], side[order], [data[i] for i in order]
        count = table.column("count").to_numpy()[order]
        cls = table.column("cls").to_numpy()[order]
        across = side.max() > side.min()
        linked = np.zeros(len(node), np.int64)
        joined = np.arange(len(node))
        edges: list[tuple[int, int]] = []

        def join(a: np.ndarray, b: np.ndarray) -> None:
            """Joins the links (a, b), in order of a: one step a class and merge, not one a link."""
            cut = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            for lo, hi in zip(cut, np.r_[cut[1:], len(a)]):
                m = a[lo]
                for label, k in zip(*np.unique(joined[b[lo:hi]], return_index=True)):
                    if label != joined[m]:
                        edges.append((int(node[m]), int(node[b[lo + k]])))
                        joined[joined == label] = joined[m]

        lengths = np.array([len(d) for d in data])
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            x = np.frombuffer(b"".join(data[i] for i in at), np.float64).reshape(len(at), -1)
            u, q, s, big, err = quantised(x)
            # Products of int8 vectors up to 1,040 long are exact in float32, else in float64.
            qf = q.astype(np.float32 if x.shape[1] <= 1040 else np.float64)
            left = np.flatnonzero(side[at] == 0)
            right = np.flatnonzero(side[at] == 1) if across else left
            for k in range(0, len(left), _STRIPE):
                rows = left[k : k + _STRIPE]
                cols = right if across else right[k:]
                about = (qf[rows] @ qf[cols].T).astype(np.float64) * (s[rows][:, None] * s[cols][None, :])
                about += big[rows][:, None] * err[cols] + err[rows][:, None] * (big[cols] + err[cols])
                i, j = np.nonzero(about >= threshold - _SLACK)
                i, j = rows[i], cols[j]
                if not across:
                    i, j = i[i < j], j[i < j]
                step = max(1, _GATHER_BYTES // u[0].nbytes)
                for c in range(0, len(i), step):
                    a, b = i[c : c + step], j[c : c + step]
                    hit = np.einsum("ij,ij->i", u[a], u[b]) >= threshold
                    if hit.any():
                        a, b = at[a[hit]], at[b[hit]]
                        linked += np.bincount(a, count[b], len(node)).astype(np.int64) + np.bincount(b, count[a], len(node)).astype(np.int64)
                        join(a, b)
        some = np.flatnonzero(linked)
        return pa.table({
            "cls": pa.array([*cls[some].tolist(), *[None] * len(edges)], pa.int64()),
            "n": pa.array([*linked[some].tolist(), *[None] * len(edges)], pa.int64()),
            "a": pa.array([*[None] * len(some), *[e[0] for e in edges]], pa.int64()),
            "b": pa.array([*[None] * len(some), *[e[1] for e in edges]], pa.int64()),
        })

    return run


def _apart(threshold: float) -> Column:
    """Whether no vector of a block can be linked with one of the other: vectors of one length
    each, and of different lengths or further apart than links reach for some pivot."""
    reach = (2 - 2 * threshold) ** 0.5 + 1e-6 if threshold < 1 else 1e-6
    gap = F.zip_with("ranges", "o_ranges", lambda a, b: F.greatest(a["low"] - b["high"], b["low"] - a["high"]))
    alike = (F.col("length") == F.col("longest")) & (F.col("o_length") == F.col("o_longest"))
    return alike & ((F.col("length") != F.col("o_length")) | F.coalesce(F.exists(gap, lambda g: g > reach), F.lit(False)))


def near_duplicate_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    scratch = Scratch(df.sparkSession, "vectors")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    kind = rows.schema["label"].dataType.simpleString()
    packed = scratch.table(rows.mapInArrow(frugal(_packed), f"vec_id long, label {kind}, bytes binary"), "packed")
    usable = packed.where("vec_id IS NOT NULL AND label IS NOT NULL AND bytes IS NOT NULL")
    classes = usable.groupBy("label", "bytes").agg(F.min("vec_id").alias("node"), F.count("*").alias("count"))
    classes = scratch.table(classes.select("label", "bytes", "node", "count"), "classes")
    chosen = classes.select("bytes").distinct().orderBy(F.xxhash64("bytes"), "bytes").limit(PIVOTS).collect()
    lengths = sorted({len(r["bytes"]) for r in chosen})
    pivots = {n: _chained(_units(np.stack([np.frombuffer(r["bytes"], np.float64) for r in chosen if len(r["bytes"]) == n]))) for n in lengths}
    classes = classes.mapInArrow(frugal(_nearest(pivots)), f"label {kind}, bytes binary, node long, count long, near int, far double")
    placed = ordered(scratch, classes, "label", "near", "far", "bytes")
    # Rank within the label over all parts; one row per label and part stands between.
    held = placed.groupBy("label", "_part").agg(F.count("*").alias("n"), F.min("_idx").alias("low"), F.max(F.octet_length("bytes")).alias("widest"))
    before = Window.partitionBy("label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    fit = F.floor(F.lit(BLOCK_BYTES) / F.max("widest").over(Window.partitionBy("label")))
    shift = held.select("label", "_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"), F.greatest(F.lit(1), F.least(F.lit(BLOCK), fit)).alias("rows"))
    placed = placed.join(shift, ["label", "_part"])
    placed = placed.select("label", "bytes", "node", "count", F.floor((F.col("_idx") + F.col("shift")) / F.col("rows")).alias("block"), (F.col("_part").cast("long") * (1 << 36) + F.col("_idx")).alias("cls"))
    placed = scratch.table(placed, "placed")
    ranges = placed.select("label", "block", "bytes").mapInArrow(frugal(_ranges(pivots)), f"label {kind}, block long, length long, low array<double>, high array<double>")
    ranges = ranges.select("label", "block", "length", F.posexplode_outer(F.arrays_zip("low", "high")).alias("pivot", "d"))
    ranges = ranges.groupBy("label", "block", "pivot").agg(F.min("length").alias("length"), F.max("length").alias("longest"), F.min("d.low").alias("low"), F.max("d.high").alias("high"))
    ranges = ranges.groupBy("label", "block").agg(F.min("length").alias("length"), F.max("longest").alias("longest"), F.array_sort(F.collect_list(F.struct("pivot", "low", "high"))).alias("ranges"))
    ranges = scratch.table(ranges, "ranges")
    other = ranges.select("label", *(F.col(c).alias(f"o_{c}") for c in ("block", "length", "longest", "ranges")))
    tiles = ranges.join(other, "label").where("block <= o_block").where(~_apart(threshold))
    tiles = scratch.table(tiles.select("label", F.col("block").alias("i"), F.col("o_block").alias("j")), "tiles")
    left = tiles.select("label", "i", "j", F.lit(0).alias("side"), F.col("i").alias("block"))
    right = tiles.where("i <> j").select("label", "i", "j", F.lit(1).alias("side"), F.col("j").alias("block"))
    dealt = left.unionByName(right).join(placed, ["label", "block"]).select("label", "i", "j", "side", "node", "count", "cls", "bytes")
    out = scratch.table(dealt.groupBy("label", "i", "j").applyInArrow(_tile(threshold), "cls long, n long, a long, b long"), "out")

    links = out.where("cls IS NOT NULL").groupBy("cls").agg(F.sum("n").alias("n"))
    comp = connected_components(scratch, out.where("a IS NOT NULL").select("a", "b"))
    named = placed.join(links, "cls", "left").select("label", "bytes", F.col("node").alias("class"), (F.coalesce("n", F.lit(0)) + F.col("count") - 1).alias("n_links"))
    named = named.join(comp, F.col("class") == F.col("node"), "left").select("label", "bytes", "n_links", F.coalesce("component", "class").alias("component"))
    own = usable.join(named, ["label", "bytes"]).select("vec_id", "n_links", "component")
    # Rows that share a vec_id are one node: they take the smallest component of any.
    node = own.groupBy("vec_id").agg(F.min("component").alias("component"))
    alone = packed.where("vec_id IS NULL OR label IS NULL OR bytes IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    own = own.drop("component").join(node, "vec_id").unionByName(alone)
    return own.select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))


def op8_int8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
