"""WARC archives in Zstandard frames: writer, reader, validation.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary,
itself compressed; then follows one frame per record.  The reader loads that dictionary,
decodes frame by frame in bounded memory, and checks each record: version line, required
headers, Content-Length against the block, the closing blank lines, block digest and, for
responses, payload digest.  A record that fails any check fails the job.

Files are written into a folder that all executors share, under names that no other attempt
of a task uses; only files in the returned manifest count, so a lost executor or a repeated
task leaves no half-written archive in use.

Among records with equal payloads of at least ``min_revisit`` bytes the one with the largest
id is the response and the others revisit it; smaller payloads are always stored.  Equal
payloads meet in salted parts, so a payload that a third of all pages share is in no single
task.

The dictionary is trained on the first 16 KiB of ``DICTIONARY_SAMPLE`` payloads: it changes
the size of frames and nothing that is read back.

Defined results: a null payload is empty; rows that repeat the largest id with the same
payload are all responses; a null id is never chosen over a number and reads back as null; a
null URL leaves the header out; line breaks in URLs are percent-encoded; other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, least_of_group

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES = 64 << 20
DATE = "2026-01-01T00:00:00Z"
#: Payloads the dictionary is trained on, and its size.
DICTIONARY_SAMPLE, DICTIONARY_BYTES = 400, 1 << 15
_REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or nothing if the samples are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def leading_frame(data: bytes) -> bytes:
    import zstandard

    held = zstandard.ZstdCompressor(level=6).compress(data) if data else b""
    return struct.pack("<II", SKIPPABLE, len(held)) + held


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed WARC record; a revisit keeps the HTTP head and not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class BadRecord(ValueError):
    pass


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record, or BadRecord."""
    at = data.find(b"\r\n\r\n")
    lines = data[:at].decode("utf-8", "surrogatepass").split("\r\n") if at >= 0 else [""]
    if not lines[0].startswith("WARC/1."):
        raise BadRecord("no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name in headers:
            raise BadRecord(f"bad header line {line[:60]!r}")
        headers[name] = value.strip()
    for name in _REQUIRED:
        if name not in headers:
            raise BadRecord(f"no {name}")
    if not headers["Content-Length"].isdigit():
        raise BadRecord("bad Content-Length")
    block, rest = data[at + 4 : at + 4 + int(headers["Content-Length"])], data[at + 4 + int(headers["Content-Length"]) :]
    if len(block) != int(headers["Content-Length"]) or rest != b"\r\n\r\n":
        raise BadRecord("Content-Length does not match the record")
    if headers.get("WARC-Block-Digest", "sha1:" + sha1_base32(block)) != "sha1:" + sha1_base32(block):
        raise BadRecord("block digest does not match")
    if headers["WARC-Type"] == "response":
        payload = block[block.find(b"\r\n\r\n") + 4 :]
        if "WARC-Payload-Digest" in headers and headers["WARC-Payload-Digest"] != "sha1:" + sha1_base32(payload):
            raise BadRecord("payload digest does not match")
        if "X-Payload-Length" in headers and headers["X-Payload-Length"] != str(len(payload)):
            raise BadRecord("payload length does not match")
    elif headers["WARC-Type"] == "revisit" and "WARC-Refers-To" not in headers:
        raise BadRecord("a revisit without WARC-Refers-To")
    return headers, block


def frames(stream) -> Iterator[bytes]:
    """Records of an archive open for reading, each from its own frame."""
    import zstandard

    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        raise BadRecord("no leading skippable frame")
    held = stream.read(struct.unpack("<I", head[4:])[0])
    if len(held) != struct.unpack("<I", head[4:])[0]:
        raise BadRecord("the dictionary is cut short")
    if held[:4] == b"\x28\xb5\x2f\xfd":
        held = zstandard.ZstdDecompressor().decompress(held)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)) if held else zstandard.ZstdDecompressor()
    data = b""
    while data or (data := stream.read(1 << 15)):
        one, out = reader.decompressobj(), []
        out.append(one.decompress(data))
        while not one.eof:
            if not (data := stream.read(1 << 15)):
                raise BadRecord("the last frame is cut short")
            out.append(one.decompress(data))
        data = one.unused_data
        yield b"".join(out)


def _at(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(df: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 0) -> DataFrame:
    """Writes one record per row of ``df``; gives the manifest (file, records, bytes)."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    pages = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    pages = pages.withColumn("digest", F.when(F.octet_length("payload") >= min_revisit, F.sha2("payload", 256)))
    pages = pages.withColumn("minus", -F.col("page_id")).withColumn("spread", F.xxhash64("page_id", "url"))
    pages = pages.withColumn("group", F.coalesce("digest", F.lit("")))  # payloads that are always stored
    pages = least_of_group(pages, ["group"], "minus", "newest", "spread").withColumn("newest", F.when(F.col("digest").isNotNull(), -F.col("newest")))
    refers = F.when((F.col("newest") != F.col("page_id")) | (F.col("newest").isNotNull() & F.col("page_id").isNull()), F.col("newest"))
    samples = [bytes(r[0]) for r in df.select(F.substring(body, 1, 1 << 14)).limit(DICTIONARY_SAMPLE).collect()]
    shared = dictionary(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held = zstandard.ZstdCompressionDict(shared) if shared else None
        if held is not None:
            held.precompute_compress(level=3)
        packer = zstandard.ZstdCompressor(level=3, dict_data=held) if held is not None else zstandard.ZstdCompressor(level=3)
        system, root = _at(folder)
        system.create_dir(root, recursive=True)
        done, out, name, count, size = [], None, "", 0, 0
        for batch in batches:
            for page, link, data, older in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out, count, size = system.open_output_stream(f"{root}/{name}"), 0, 0
                    out.write(leading_frame(shared))
                frame = packer.compress(record(page, link, data, older))
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["file", "records", "bytes"])

    return pages.select("page_id", "url", "payload", refers.alias("refers_to")).mapInArrow(run, "file string, records long, bytes long")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the files in ``manifest``: record_type, record_id, target_uri,
    refers_to_id, payload_digest, payload_bytes and, if asked for, the stored payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        names = ["record_type", "record_id", "target_uri", "refers_to_id", "payload_digest", "payload_bytes", "payload"]
        for batch in batches:
            for file, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, path = _at(file)
                rows, seen, held = [], 0, 0
                with system.open_input_stream(path) as stream:
                    for data in frames(stream):
                        h, block = parse(data)
                        seen += 1
                        kept = block[block.find(b"\r\n\r\n") + 4 :] if payloads and h["WARC-Type"] == "response" else None
                        held += len(kept or b"")
                        rows.append((h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Target-URI"), h.get("WARC-Refers-To"), h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), kept))
                        if len(rows) >= 2000 or held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if seen != expected:
                    raise BadRecord(f"{file} holds {seen} records, its manifest says {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    fields = "record_type string, record_id string, target_uri string, refers_to_id string, payload_digest string, payload_bytes long, payload binary"
    return manifest.select("file", "records").mapInArrow(run, fields)


def op10_warc_zstd(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    scratch = Scratch(spark, "warc")
    manifest = scratch.table(write_archives(pages, f"{scratch.root}/archives"), "manifest")
    files = manifest.repartition(max(1, spark.sparkContext.defaultParallelism), "file")
    out = read_archives(files, payloads=False)
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1)
    page = F.when(F.col("record_id") != "<urn:page:null>", number("record_id").cast("long"))
    refers = F.when(F.col("refers_to_id").isNotNull(), number("refers_to_id").cast("long"))
    return out.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS newest FROM p),
v AS (SELECT *, list_transform(range(8), lambda g: CAST('0x' || substr(s, CAST(1 + 5 * g AS BIGINT), 5) AS BIGINT)) AS v FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v[i // 4 + 1] >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM v
"""
