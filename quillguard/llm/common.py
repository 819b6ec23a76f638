"""Shared plumbing: scratch tables, stable row order, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local master (single-machine tests) may leave it unset; a temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="quillguard-"))
        spark.sparkContext.setCheckpointDir(_OWN[0])
    return _OWN[0]


#: Rows that a Python worker holds as Python objects at a time.
SLICE_ROWS = 1000


def _give_back() -> None:
    """Returns freed memory to the system; workers live on and share the executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def frugal(run: Callable) -> Callable:
    """``run`` (batches to batches) fed in slices, with memory given back after each."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), SLICE_ROWS):
                yield batch.slice(at, SLICE_ROWS)
                _give_back()

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(sliced(batches))
        _give_back()

    return inner


class Scratch:
    """Named tables in the shared folder, written once and read back.

    That cuts the lineage, so a lost executor costs a reread of files rather than a
    recomputation with other row order.  The shuffle files of a finished write go at once,
    and :meth:`drop` removes a table that no later step reads.
    """

    _CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.written = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{self.written}"
        self.paths[name] = path
        self.written += 1
        before = self.spark.conf.get(self._CLEAN, "false")
        self.spark.conf.set(self._CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(self._CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ordered(scratch: Scratch, df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt into ranges of ``by`` and sorted, with ``_part`` and ``_idx`` (position in
    the part).  A hot key spreads over parts as long as ``by`` ends in a distinguishing
    column.  Written to the shared folder, so both numbers stay what they are."""
    cols = [F.col(c).asc_nulls_first() for c in by]
    at = F.monotonically_increasing_id()
    out = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", at)
    out = out.withColumn("_part", F.shiftright("_at", 33).cast("int")).withColumn("_idx", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")
    return scratch.table(out, "ordered")


#: Parts into which the rows of one group are dealt where a group may hold very many.
SALTS = 64


def least_of_group(df: DataFrame, keys: list[str], value: str, name: str, spread: str | None = None, shared: bool = False) -> DataFrame:
    """``df`` with the smallest ``value`` of each row's group as ``name`` and the rows of the
    group as ``{name}_rows``.

    The group's rows meet in ``SALTS`` parts, dealt by ``spread`` (``value`` if not given):
    each part is reduced first, and the answer goes back to the parts, so a group that holds
    a third of all rows is never in one task.  Keys must not be null.  With ``shared`` rows
    that are alone in their group are left out."""
    part, n = f"_{name}_part", f"{name}_rows"
    rows = df.withColumn(part, F.pmod(F.xxhash64(spread or value), F.lit(SALTS)).cast("int")).repartition(*keys, part)
    parts = rows.groupBy(*keys, part).agg(F.min(value).alias(name), F.count("*").alias(n))
    whole = parts.groupBy(*keys).agg(F.min(name).alias(name), F.sum(n).alias(n)).where(F.col(n) > 1)
    known = parts.select(*keys, part).join(whole, keys)
    if shared:
        return rows.join(known, [*keys, part]).drop(part)
    out = rows.join(known, [*keys, part], "left").drop(part)
    return out.withColumn(name, F.coalesce(name, value)).withColumn(n, F.coalesce(n, F.lit(1).cast("long")))


def _settled(e: DataFrame) -> bool:
    """Whether the edges (u, v), u > v, are stars: each u has one v, and no v is a u."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low"))
    ends = ends.unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
    return not ends.where("up > 1 OR up = 1 AND low = 1").agg(F.count("*")).first()[0]


def connected_components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges``.

    Alternating large-star and small-star steps; in each, :func:`least_of_group` gives every
    edge the smallest neighbour, so a hub with very many neighbours is in no single task.
    Each round is written to the shared folder; it ends when the edges are stars around the
    smallest nodes (log**2 rounds in theory, a handful in practice, none if they are so from
    the start).  Nodes without an edge are not returned.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, k = scratch.table(e, "edges0"), 0
    while not _settled(e):
        if k == rounds:
            raise RuntimeError("connected components did not settle")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least_of_group(both, ["u"], "v", "m").withColumn("m", F.least("u", "m"))
        large = low.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low2 = least_of_group(large, ["u"], "v", "m")
        linked = low2.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = low2.select("u", F.col("m").alias("v"))
        e = scratch.table(linked.unionByName(down).where("u <> v").distinct(), f"edges{k + 1}")
        scratch.drop(f"edges{k}")
        k += 1
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
