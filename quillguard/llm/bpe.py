"""BPE encoding by forced-boundary splitting, and decoding.

The tokenizer file gives vocabulary, merges, normaliser and the pattern of words.  Two bytes
that are nowhere adjacent inside a vocabulary token can never end up in one token, so the
place between them is a certain cut: a word falls into fragments there, each fragment is
encoded on its own (the last one with the end-of-word mark) and the ids are concatenated.
Fragments recur far more often than texts do; each Python worker keeps a bounded memory of
them.

The result equals the tokenizers library's encode(text, add_special_tokens=False) and
decode(ids, skip_special_tokens=False): strings of added tokens inside a text become their
ids, and without a decoder in the file decoding joins the token strings by spaces.

Defined results: a null text counts as empty (no ids, empty string); repeated rows are encoded
each; other columns are not read.  Supported are files of the kind "BPE with word ends" (a
Split pattern and a ByteLevel step without prefix space); others are refused.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

#: Remembered fragments and words of a Python worker, in each of two generations.
MEMORY = 60_000
#: Bytes of a word from which its cuts are looked for by numpy; below, its calls cost more.
LONG = 64
#: White space as the library's pattern engine has it.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Alternatives of a pattern of words that match no white space.
_SPACELESS = re.compile(r"'[a-z]+|\[\\p\{[LN]\}\]\+?|\[\^\\s(\\p\{[LN]\})*\]\+?")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else 256 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class _Recent(dict):
    """A map that keeps the most recent ``MEMORY`` to twice as many keys."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _ascii_normaliser(spec: dict | None, pattern: str) -> Callable[[str], str] | None:
    """A function that leaves an ASCII text with the words it has after the file's normaliser,
    or nothing if these steps are not known to be so simple.

    Composition leaves ASCII as it is.  Runs of white space turned to one space make no
    difference where no word can hold white space: each alternative of the pattern is a
    contraction, letters, numbers, or a class that excludes white space."""
    steps = (spec or {}).get("normalizers", [spec] if spec else [])
    joins_spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    spaceless = all(_SPACELESS.fullmatch(a) for a in pattern.split("|"))
    lowers = False
    for step in steps:
        if step["type"] == "Lowercase":
            lowers = True
        elif step["type"] not in ("NFC", "NFKC", "NFD", "NFKD") and not (step == joins_spaces and spaceless):
            return None
    return str.lower if lowers else str


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Codec:
    """Encoder and decoder of one tokenizer file, given as its text."""

    def __init__(self, file: str):
        import regex
        from tokenizers import Tokenizer, models

        spec = json.loads(file)
        model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout") or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("only plain BPE files without decoder and post-processor are supported")
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"] or steps[0]["behavior"] != "Removed" or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
            raise ValueError("only a Split pattern that keeps its matches, then ByteLevel, is supported")
        self.tokens = [""] * (max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in model["vocab"].items():
            self.tokens[i] = token
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.tokens[i] = content
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match literally")
        normaliser = Tokenizer.from_str(file).normalizer
        self.normalise = normaliser.normalize_str if normaliser else str
        pattern = steps[0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace("\\s", _WHITE)).findall
        self.ascii = _ascii_normaliser(spec.get("normalizer"), pattern) or self.normalise
        self.specials = regex.compile("|".join(sorted(map(regex.escape, self.added), key=len, reverse=True))) if self.added else None
        self.letters = byte_letters()
        self.spelling = dict(enumerate(self.letters))
        mark = model.get("end_of_word_suffix") or ""
        back = {c: b for b, c in enumerate(self.letters)}
        self.adjacent = np.zeros((256, 256), bool)
        for token in model["vocab"]:
            inner = token[: -len(mark)] if mark and token.endswith(mark) else token
            known = [back[c] for c in inner if c in back]
            self.adjacent[known[:-1], known[1:]] = True
        # Byte before, then byte after: whether they are adjacent in some token.
        self.follows = [row.tobytes() for row in self.adjacent]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # The library's merge loop without its word cache; with the mark and without it.
        self.last = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, end_of_word_suffix=mark or None)
        self.inner = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0)
        self.fragments = _Recent(self._fragment)
        self.known = _Recent(self._word)

    def cuts(self, data: bytes) -> list[int]:
        """Byte offsets between which no vocabulary token reaches."""
        if len(data) < LONG:
            follows = self.follows
            return [i for i, (a, z) in enumerate(zip(data, data[1:]), 1) if not follows[a][z]]
        b = np.frombuffer(data, np.uint8)
        return (np.flatnonzero(~self.adjacent[b[:-1], b[1:]]) + 1).tolist()

    def _fragment(self, key: tuple[bytes, bool]) -> bytes:
        data, last = key
        spelt = data.decode("latin-1").translate(self.spelling)
        return _packed([t.id for t in (self.last if last else self.inner).tokenize(spelt)])

    def _word(self, word: str) -> bytes:
        data = word.encode("utf-8", "surrogatepass")
        cuts = self.cuts(data)
        if not cuts:
            return self._fragment((data, True))
        fragments, at, out = self.fragments, 0, []
        for cut in cuts:
            out.append(fragments[data[at:cut], False])
            at = cut
        return b"".join([*out, fragments[data[at:], True]])

    def _plain(self, text: str) -> bytes:
        known = self.known
        plain = self.ascii(text) if text.isascii() else self.normalise(text)
        return b"".join([known[w] for w in self.words(plain)])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.specials is None or "<|" not in text and not self.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._plain(text[at : m.start()]), _packed([self.added[m.group()]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _codec(name: str, cache: dict = {}) -> Codec:  # noqa: B006
    if name not in cache:
        with open(SparkFiles.get(name), encoding="utf-8") as f:
            cache[name] = Codec(f.read())
    return cache[name]


def _shipped(df: DataFrame, tokenizer: str) -> str:
    """The tokenizer file is sent to every executor once; gives the name it has there.

    Spark refuses a second file of that name with other contents, so within an application a
    name stands for one file, and workers may remember its codec by name."""
    df.sparkSession.sparkContext.addFile(tokenizer)
    return tokenizer.rstrip("/").rsplit("/", 1)[-1]


def bpe_encode(df: DataFrame, tokenizer: str, keep: tuple[str, ...] = (), text: str = "text", decoded: bool = False) -> DataFrame:
    """The columns ``keep`` of ``df``, ``_ids`` (binary, little-endian uint32) and, if
    asked for, ``_decoded``, decoded from those ids."""
    name = _shipped(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, 512):  # bounds what a batch of results holds
                part = batch.slice(at, 512)
                ids = [codec.encode(t) for t in texts.slice(at, 512).to_pylist()]
                cols = [*part.columns[:-1], pa.array(ids, pa.binary())]
                if decoded:
                    cols.append(pa.array([codec.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "_ids", *["_decoded"] * decoded])

    source = df.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").alias("_text"))
    fields = [f"_k{i} {source.schema[f'_k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    out = source.mapInArrow(frugal(run), ", ".join([*fields, "_ids binary", *["_decoded string"] * decoded]))
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "_ids", *["_decoded"] * decoded)


def bpe_digest(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes and hashes in place,
    so neither ids nor decoded texts travel."""
    name = _shipped(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = codec.encode(t.as_py())
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_decode(df: DataFrame, tokenizer: str, keep: tuple[str, ...] = (), ids: str = "_ids") -> DataFrame:
    """The columns ``keep`` of ``df`` and ``_decoded`` of its binary ids (null: empty)."""
    name = _shipped(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for batch in batches:
            texts = [codec.decode(i or b"") for i in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "_decoded"])

    source = df.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)), F.col(ids).alias("_ids"))
    fields = [f"_k{i} {source.schema[f'_k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    return source.mapInArrow(frugal(run), ", ".join([*fields, "_decoded string"])).select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "_decoded")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_forced_boundary_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe_path())
