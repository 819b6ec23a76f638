"""Removal of repeated word passages through a compacted de Bruijn graph.

Words are ``[^\\x20\\x09-\\x0D]+``; an edge is a window of ``width`` words, its nodes are the
windows of ``width - 1`` words at its two ends.

1. Documents with the same word sequence are one; only the one with the smallest id goes on.
2. Each window is represented by the smallest hash of its ``ANCHOR``-word runs (its
   minimiser).  A window found in two documents has the same minimiser in both, so only
   windows whose minimiser occurs in two documents can repeat; this spares the shuffle of
   all other windows and loses none.
3. Documents with such windows are numbered in order of doc_id, so that a place in the corpus,
   (number, word), is one whole number.  The windows are grouped by (first node, window), two
   64-bit hashes, to the edges found in several documents, with their first place.
4. Nonbranching paths compact: an edge continues its predecessor if the node between has
   one edge in and one out.  Edges that also follow each other in their first source form
   a segment in one sorted pass; segments are chained to unitigs by pointer doubling joins.
5. Occurrences are mapped to (unitig, offset).  Runs at consecutive places of one unitig and
   of one source are the long repeated spans; an occurrence in a later document than the
   edge's first place belongs to a span.
6. Source coordinates verify the spans: the document that a span's coordinates name gives the
   SHA-256 of its words there, and the span counts only if the later document's own words
   give the same.  Hashes of windows thus only propose.  The document's own windows are then
   matched against the verified spans' windows, so inner repeats of a window go as well.

Defined results: null, empty and short texts keep all their words; a row with a null doc_id is
neither a source nor a copy; rows that repeat a doc_id do not make each other copies, and each
is cut by its own text; other columns are not read.  Where a doc_id repeats, ``rep``, a hash of
the text, tells its texts apart, and equal rows are one document; elsewhere it is 0.  A text
may have 2**30 words and the corpus 2**33 documents; more is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, frugal, least_of_group, ordered
from .hashing import groups, pieces, sequence_hashes, window_hashes, word_hashes, word_hashes_of, word_spans
from .neardup import repeats

WIDTH, ANCHOR = 13, 5
#: Spans whose words a source document tells in one row; one with more is read several times.
ASKED = 1 << 15
#: Bits of a place that count words; the bits above number the document.
_PLACE = 30
_NODE_SEED, _EDGE_SEED, _ANCHOR_SEED, _TEXT_SEED = 11, 12, 13, 14


def _bytes(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")


def _texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, empty for null."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _joined_digest(text: str | bytes | None) -> str:
    """SHA-256 of a text's words joined by one space."""
    digest, between = hashlib.sha256(), b""
    for piece in pieces(_bytes(text)):
        words = b" ".join(piece.split())
        if words:
            digest.update(between + words)
            between = b" "
    return digest.hexdigest()


def _minimisers(words: np.ndarray, width: int, anchor: int) -> np.ndarray:
    out = window_hashes(words, anchor, _ANCHOR_SEED)
    n, runs = len(words) - width + 1, width - anchor + 1
    if n <= 0:
        return out[:0]
    # The least of ``done`` runs, for twice as many each time; the last step overlaps.
    done = 1
    while done < runs:
        step = min(done, runs - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def _windows(h: np.ndarray, at: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of the windows that lie within one text, given the words of all texts: first word, text,
    minimiser, and whether that is another than the text's window before has."""
    m = _minimisers(h, width, anchor)
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    pos, owner_of = np.arange(len(m)), owner[: len(m)]
    if len(at) > 2 and len(m):
        pos = np.flatnonzero(owner_of == owner[width - 1 :])
        m, owner_of = m[pos], owner_of[pos]
    return pos, owner_of, m, _changes(m, owner_of)


def _changes(value: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which (value, owner) differ from those before them."""
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return new


def _first_pass(width: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(1))
            none = np.zeros(0, np.int64)
            n, one, two, sizes, anchors = [none], [none], [none], [none], [none]
            for part in groups(texts):
                h, at = word_hashes_of(texts[part])
                count = np.diff(at)
                full = count >= width
                n.append(count)
                one.append(np.where(full, sequence_hashes(h, at, _TEXT_SEED), 0))
                two.append(np.where(full, sequence_hashes(h, at, _TEXT_SEED + 1), 0))
                _, owner, m, new = _windows(h, at, width, anchor)
                m, owner = m[new], owner[new]
                order = np.lexsort((m, owner))
                m, owner = m[order], owner[order]
                new = _changes(m, owner)
                anchors.append(m[new].view(np.int64))
                sizes.append(np.bincount(owner[new], minlength=len(count)))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(np.concatenate(c), pa.int64()) for c in (n, one, two)), pa.array(map(_joined_digest, texts), pa.string()), pa.ListArray.from_arrays(ends, np.concatenate(anchors))],
                names=["doc_id", "rep", "n_words", "one", "two", "digest", "anchors"],
            )

    return run


def _first_of_text(edge: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which windows, in order of place, are the first of their text with their hash."""
    first = np.ones(len(edge), bool)
    found = np.sort(edge)
    twice = np.flatnonzero(np.isin(edge, found[1:][found[1:] == found[:-1]]))
    order = twice[np.lexsort((edge[twice], owner[twice]))]  # stable: places stay in order
    first[order] = _changes(edge[order], owner[order])
    return first


def _edges(width: int, anchor: int):
    """(num, lead, text, anchors) -> one row per distinct candidate window of each document:
    its place, the number of the first text with the same doc_id, tail, edge and head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["place", "lead", "tail", "edge", "head"]
        for batch in batches:
            texts, wanted = _texts(batch.column(2)), batch.column(3)
            num, lead = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for part in groups(texts):
                h, at = word_hashes_of(texts[part])
                if (np.diff(at) >> _PLACE).any() or (num[part] >> 33).any():
                    raise ValueError("a text of more than 2**30 words, or more than 2**33 documents")
                pos, owner, m, new = _windows(h, at, width, anchor)
                # A minimiser that one text has wanted is wanted in each text that has it.
                repeated = wanted.slice(part.start, part.stop - part.start).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                which = np.cumsum(new, dtype=np.int32)
                which -= 1
                chosen = np.isin(m[new], repeated)[which]
                pos, owner = pos[chosen], owner[chosen]
                if not len(pos):
                    continue
                edge = window_hashes(h, width, _EDGE_SEED)[pos]
                first = _first_of_text(edge, owner)
                pos, owner, edge = pos[first], owner[first], edge[first]
                node = window_hashes(h, width - 1, _NODE_SEED)
                place = (num[part][owner] << _PLACE) + pos - at[owner]
                cols = [place, lead[part][owner], node[pos].view(np.int64), edge.view(np.int64), node[pos + 1].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return run


def _span_digests(text: str | None, spans: list[tuple[int, int]], width: int) -> list[bytes]:
    """SHA-256 of the words that the windows of each span (first window, windows) cover."""
    data = _bytes(text)
    starts, ends = word_spans(np.frombuffer(data, np.uint8))
    covered = (data[starts[at] : ends[at + n + width - 2]] for at, n in spans)
    return [hashlib.sha256(b" ".join(c.split())).digest() for c in covered]


def _source_digests(width: int):
    """(num, text, asked spans) -> (place, n, digest) of the words at each asked place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, count, digest = [], [], []
            for num, text, asked in zip(*(batch.column(c).to_pylist() for c in range(3))):
                place += [(num << _PLACE) + a["at"] for a in asked]
                count += [a["n"] for a in asked]
                digest += _span_digests(text, [(a["at"], a["n"]) for a in asked], width)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(count, pa.int32()), pa.array(digest, pa.binary())], names=["source", "n", "digest"])

    return run


def removed_mask(text: str | None, spans: list[tuple[int, int]], width: int) -> np.ndarray:
    """Which words go, given spans (first window, windows) of windows to remove."""
    h = word_hashes(text)
    edge = window_hashes(h, width, _EDGE_SEED)
    chosen = np.zeros(len(edge), bool)
    for at, count in spans:
        chosen[at : at + count] = True
    hit = np.isin(edge, edge[chosen])
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, np.flatnonzero(hit), 1)
    np.add.at(step, np.flatnonzero(hit) + width, -1)
    return np.cumsum(step)[: len(h)] > 0


def _apply(width: int):
    """(doc_id, rep, text, spans) -> removed word count, digest and text of what is kept.

    Spans whose words differ from those at their source's coordinates do not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digest, kept_text = [], [], []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                claimed = [(s["at"], s["n"]) for s in spans]
                own = _span_digests(text, claimed, width)
                gone = removed_mask(text, [c for c, s, d in zip(claimed, spans, own) if s["digest"] == d], width)
                parts, at = [], 0
                for piece in pieces(_bytes(text)):
                    words = piece.split()
                    parts += filter(None, [b" ".join(w for w, g in zip(words, gone[at : at + len(words)].tolist()) if not g)])
                    at += len(words)
                kept = b" ".join(parts)
                removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())],
                names=["doc_id", "rep", "n_removed", "digest", "kept_text"],
            )

    return run


def _compacted(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(tail, edge, head, place) of repeated edges -> (tail, edge, place, unitig, at): each
    edge's unitig, named by the place where its first segment begins, and place in it."""
    into = edges.groupBy("head").agg(F.count("*").alias("n_in"), F.min("place").alias("before"))
    out = edges.groupBy("tail").agg(F.count("*").alias("n_out"))
    joined = edges.join(out, "tail").join(into.withColumnRenamed("head", "tail"), "tail", "left")
    follows = (F.col("n_out") == 1) & (F.col("n_in") == 1)
    # Places of two documents are never consecutive: a text has fewer windows than words.
    starts = ~F.coalesce(follows & (F.col("before") == F.col("place") - 1), F.lit(False))
    by = Window.partitionBy(F.shiftright("place", _PLACE)).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    # The last start before an edge is the greatest one; its predecessor is that of its segment.
    seg = F.max(F.when(starts, F.col("place"))).over(by)
    before = F.last(F.when(starts, F.coalesce(F.when(follows, F.col("before")), F.lit(-1).cast("long"))), ignorenulls=True).over(by)
    marked = scratch.table(joined.select("tail", "edge", "place", seg.alias("seg"), before.alias("before")), "marked")
    # Chain segments: the one that ends at my predecessor's place comes before me.
    segs = marked.groupBy("seg").agg(F.max("place").alias("last"), F.max("before").alias("before"))
    ends = segs.select(F.col("last").alias("e_last"), F.col("seg").alias("up"), (F.col("last") - F.col("seg") + 1).alias("jump"))
    linked = segs.join(ends, F.col("before") == F.col("e_last"), "left")
    chain = scratch.table(linked.select(F.col("seg").alias("me"), "up", F.coalesce("jump", F.lit(0).cast("long")).alias("jump"), F.lit(None).cast("long").alias("root")), "chain0")
    # Pointer doubling: after k rounds ``up`` is the 2**k-th segment before, or null once
    # ``root`` is known.  A round that settles nothing leaves only cycles.
    k, open_before = 0, -1
    while (still := chain.where("up IS NOT NULL").count()) not in (0, open_before):
        prior = chain.select(F.col("me").alias("up"), F.col("up").alias("up2"), F.col("jump").alias("jump2"), F.col("root").alias("root2"))
        at_root = F.when(F.col("up").isNotNull() & F.col("up2").isNull(), F.coalesce("root2", "up"))
        stepped = chain.join(prior, "up", "left")
        stepped = stepped.select("me", F.col("up2").alias("up"), (F.col("jump") + F.coalesce("jump2", F.lit(0))).alias("jump"), F.coalesce("root", at_root).alias("root"))
        k, open_before = k + 1, still
        chain = scratch.table(stepped, f"chain{k}")
        scratch.drop(f"chain{k - 1}")
    cyclic = F.col("up").isNotNull()
    unitig = F.when(cyclic, F.col("me")).otherwise(F.coalesce("root", "me"))
    chain = chain.select(F.col("me").alias("seg"), unitig.alias("unitig"), F.when(cyclic, F.lit(0)).otherwise(F.col("jump")).alias("jump"))
    placed = marked.join(chain, "seg")
    return scratch.table(placed.select("tail", "edge", "place", "unitig", (F.col("jump") + F.col("place") - F.col("seg")).alias("at")), "unitigs")


def _rep(several: bool, text: str) -> Column:
    """What tells the texts of one doc_id apart, if any doc_id repeats."""
    return F.xxhash64(F.coalesce(text, F.lit(""))) if several else F.lit(0).cast("long")


def _numbered(scratch: Scratch, wanted: DataFrame, several: bool) -> DataFrame:
    """``wanted`` with ``num``, gapless in order of (doc_id, rep), and ``lead``, the number of
    the first text with the same doc_id."""
    placed = ordered(scratch, wanted, "doc_id", "rep")
    start, parts = 0, []
    for part, n in placed.groupBy("_part").count().orderBy("_part").collect():  # one row per part
        parts.append((part, start))
        start += n
    at = wanted.sparkSession.createDataFrame(parts, "_part int, _start long")
    out = placed.join(F.broadcast(at), "_part").withColumn("num", F.col("_start") + F.col("_idx")).drop("_part", "_idx", "_start")
    if several:
        return least_of_group(out, ["doc_id"], "num", "lead").drop("lead_rows")
    return out.withColumn("lead", F.col("num"))


def repeated_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, anchor: int = ANCHOR, several: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): every row's doc_id, rep, n_words, digest of its words and whether it
    is a later copy of a whole word sequence; and the texts with removable spans: doc_id, rep,
    text and spans (first window ``at``, windows ``n``, unitig, offset in it, source place
    and digest of the source's words there)."""
    scratch = Scratch(df.sparkSession, "substring")
    several = repeats(df, doc_id) if several is None else several
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), _rep(several, text).alias("rep"))
    read = scratch.table(docs.mapInArrow(frugal(_first_pass(width, anchor)), "doc_id long, rep long, n_words long, one long, two long, digest string, anchors array<long>"), "read")
    whole = (F.col("n_words") >= width) & F.col("doc_id").isNotNull()
    keyed = read.where(whole).select("doc_id", "rep", "one", "two", "n_words")
    # Later copies of a whole word sequence, and all else.
    later = least_of_group(keyed, ["one", "two", "n_words"], "doc_id", "first").where("doc_id > first").select("doc_id", "rep").distinct()
    later = scratch.table(later, "copies").withColumn("copy", F.lit(True))
    named = read.drop("one", "two").join(later, ["doc_id", "rep"], "left")
    copy = F.coalesce("copy", F.lit(False))
    named = scratch.table(named.select("doc_id", "rep", "n_words", "digest", copy.alias("copy"), F.when(whole & ~copy, F.col("anchors")).alias("anchors")), "named")
    scratch.drop("read", "copies")

    anchors = named.select("doc_id", "rep", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    wanted = anchors.join(shared, "anchor").groupBy("doc_id", "rep").agg(F.collect_set("anchor").alias("anchors"))
    wanted = scratch.table(_numbered(scratch, wanted, several), "wanted")
    documents = scratch.table(named.drop("anchors"), "documents")
    scratch.drop("named", "ordered")

    texts = docs.dropDuplicates(["doc_id", "rep"]) if several else docs
    candidates = scratch.table(texts.join(wanted, ["doc_id", "rep"]).select("num", "lead", "text", "anchors", "doc_id", "rep"), "candidates")
    scratch.drop("wanted")
    found = scratch.table(candidates.select("num", "lead", "text", "anchors").mapInArrow(frugal(_edges(width, anchor)), "place long, lead long, tail long, edge long, head long"), "found")
    number = lambda c: F.shiftright(c, _PLACE)
    # A text's place in the order of doc_ids: its own number where no doc_id repeats.
    lead = F.col("lead") if several else number("place")
    edges = found.groupBy("tail", "edge").agg(F.min("head").alias("head"), F.min("place").alias("place"), F.max(lead).alias("last")).where(number("place") < F.col("last"))
    edges = scratch.table(edges.drop("last"), "repeated")
    placed = _compacted(scratch, edges).withColumnRenamed("place", "source")
    scratch.drop("repeated", "marked")

    after = found.drop("head").join(placed, ["tail", "edge"]).where(lead > number("source"))
    after = scratch.table(after.select("place", "unitig", "at", "source"), "after")
    scratch.drop("found", "unitigs")
    # A span: consecutive windows of the document at consecutive places of one unitig and of
    # one source, so that the source's coordinates name all of its words.
    by = Window.partitionBy(number("place")).orderBy("place")
    same = (F.col("place") == F.lag("place").over(by) + 1) & (F.col("unitig") == F.lag("unitig").over(by)) & (F.col("at") == F.lag("at").over(by) + 1) & (F.col("source") == F.lag("source").over(by) + 1)
    runs = after.withColumn("start", F.when(F.coalesce(same, F.lit(False)), None).otherwise(F.col("place")))
    runs = runs.withColumn("start", F.max("start").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("start").agg(F.count("*").cast("int").alias("n"), F.min("unitig").alias("unitig"), F.min("at").alias("offset"), F.min("source").alias("source"))
    runs = scratch.table(runs, "runs")
    scratch.drop("after")
    # The sources' words at the spans' coordinates, asked for once each.
    asked = least_of_group(runs.select("source", "n", number("source").alias("num")).distinct(), ["num"], "source", "low")
    word = lambda c: F.col(c).bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")
    turn = F.pmod(F.xxhash64("source", "n"), F.ceil(F.col("low_rows") / ASKED))
    asked = asked.groupBy("num", turn.alias("turn")).agg(F.collect_list(F.struct(word("source").alias("at"), "n")).alias("asked"))
    told = candidates.select("num", "text").join(asked.drop("turn"), "num").mapInArrow(frugal(_source_digests(width)), "source long, n int, digest binary")
    spans = runs.join(told, ["source", "n"])
    spans = spans.groupBy(number("start").alias("num")).agg(F.collect_list(F.struct(word("start").alias("at"), "n", "unitig", "offset", "source", "digest")).alias("spans"))
    spans = scratch.table(candidates.select("num", "doc_id", "rep", "text").join(spans, "num").drop("num"), "spans")
    scratch.drop("runs", "candidates")
    return documents, spans


def _with_changes(df: DataFrame, doc_id: str, text: str, width: int, several: bool | None = None) -> tuple[DataFrame, DataFrame]:
    documents, spans = repeated_spans(df, doc_id, text, width, several=several)
    changed = spans.select("doc_id", "rep", "text", F.transform("spans", lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), s["digest"].alias("digest"))).alias("spans"))
    changed = changed.mapInArrow(frugal(_apply(width)), "doc_id long, rep long, n_removed long, changed_digest string, kept_text string")
    return documents, changed


def substring_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``df`` with repeated passages cut out of ``text``: kept words joined by one space in
    changed rows, the text as it was in the others; the columns of ``df`` and ``_n_removed``,
    which takes the place of a column of that name."""
    several = repeats(df, doc_id)
    documents, changed = _with_changes(df, doc_id, text, width, several)
    cut = changed.select(F.col("doc_id").alias("_doc"), F.col("rep").alias("_rep"), F.col("n_removed").alias("_cut"), F.col("kept_text").alias("_kept"))
    gone = documents.where("copy").select(F.col("doc_id").alias("_doc"), F.col("rep").alias("_rep"), F.col("n_words").alias("_cut"), F.lit("").alias("_kept"))
    cut = cut.unionByName(gone).dropDuplicates(["_doc", "_rep"])
    names = [c for c in df.columns if c != "_n_removed"]
    inner = df.select(*(F.col(f"`{c}`").alias(f"_x{i}") for i, c in enumerate(names)), _rep(several, text).alias("_of"))
    out = inner.join(cut, (F.col(f"_x{names.index(doc_id)}").cast("long") == F.col("_doc")) & (F.col("_of") == F.col("_rep")), "left")
    shown = [F.coalesce("_kept", f"_x{i}").alias(c) if c == text else F.col(f"_x{i}").alias(c) for i, c in enumerate(names)]
    return out.select(*shown, F.coalesce("_cut", F.lit(0)).alias("_n_removed"))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    documents, changed = _with_changes(docs, "doc_id", "text", WIDTH)
    out = documents.join(changed.select("doc_id", "rep", "n_removed", "changed_digest"), ["doc_id", "rep"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    n = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("changed_digest", "digest"))
    return out.select("doc_id", "n_words", n.cast("long").alias("n_removed"), kept.alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM g) WHERE f < doc_id),
c AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS j FROM r),
a AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d LEFT JOIN a USING (doc_id) WHERE len(w) > 0),
t AS (SELECT k.doc_id, string_agg(k.x, ' ' ORDER BY k.j) AS t FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.j = k.j WHERE c.j IS NULL GROUP BY k.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(a.gone), 0) AS n_removed, sha256(coalesce(t.t, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN t USING (doc_id)
"""
