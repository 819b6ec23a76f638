"""Vectorised word and window hashes over UTF-8 bytes (numpy, no per-word Python).

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR; that is the
pattern ``[^\\x20\\x09-\\x0D]+`` on the decoded text, because UTF-8 continuation and lead
bytes never fall into that range.  All hashes are fixed functions of the bytes, so every
executor and every retry of a task gets the same values.  Long texts are hashed in pieces of
``PIECE`` bytes, so besides the text's bytes only its word hashes grow with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


_BYTE = np.array([_splitmix(1000 + b) for b in range(256)], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes, and windows, that are hashed at a time.
PIECE = 1 << 20
#: Bytes of short texts that are hashed together.
GROUP = 1 << 17
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers (at most ``PIECE``) of the base and of its inverse modulo 2**64,
    grown on demand."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for base in (_BASE, inverse):
            out = np.full(min(1 << max(n - 1, 1).bit_length(), PIECE), base, np.uint64)
            out[0] = 1
            made.append(np.cumprod(out, dtype=np.uint64))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


_WHITE = re.compile(rb"[ \t\n\x0b\x0c\r]")


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``data`` cut before white space into parts of ``size`` bytes or little more; no word is
    cut, so one longer than that makes its part longer."""
    at = 0
    while at < len(data):
        until = at + size
        if until < len(data):
            found = _WHITE.search(data, until)
            until = found.start() if found else len(data)
        yield data[at:until] if at or until < len(data) else data
        at = until


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets [start, end) of the words of one text given as uint8."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _word_sums(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets [start, end) of the words of at most ``PIECE`` bytes, their sums and lengths."""
    starts, ends = word_spans(part)
    power, inverse = _powers(len(part))
    running = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTE[part] * power[: len(part)], out=running[1:])
    return starts, ends, (running[ends] - running[starts]) * inverse[starts], (ends - starts).astype(np.uint64)


def _word_hash(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return mix(sums ^ (lengths * np.uint64(0xD6E8FEB86659FD93)))


def word_hashes(text: str | bytes | None, lower: bool = False) -> np.ndarray:
    """One 64-bit hash per word of a whole text, given as UTF-8 or not (none for null)."""
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass"), np.uint8)
    out, open_, width = [], 0, 0  # sum and length of a word that the last piece has cut
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE]
        if lower:
            part = _LOWER[part]
        starts, ends, sums, lengths = _word_sums(part)
        if width:
            if len(starts) and starts[0] == 0:
                sums[0] = np.uint64((open_ + int(sums[0]) * pow(_BASE, width, 1 << 64)) & _MASK)
                lengths[0] += np.uint64(width)
            else:
                sums, lengths = np.r_[np.uint64(open_), sums], np.r_[np.uint64(width), lengths]
            open_ = width = 0
        if at + PIECE < len(data) and len(ends) and ends[-1] == len(part):
            open_, width = int(sums[-1]), int(lengths[-1])
            sums, lengths = sums[:-1], lengths[:-1]
        out.append(_word_hash(sums, lengths))
    return np.concatenate(out) if len(out) > 1 else out[0]


def groups(texts: list[bytes]) -> Iterator[slice]:
    """Consecutive texts of at most ``GROUP`` bytes together; a longer text is alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size + len(text) + 1 > GROUP and i > start:
            yield slice(start, i)
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield slice(start, len(texts))


def word_hashes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`word_hashes` of the texts of a group, one after the other, and where each text's
    begin, with the end of the last."""
    if len(texts) == 1:
        h = word_hashes(texts[0])
        return h, np.array([0, len(h)])
    data = np.frombuffer(b" ".join(texts), np.uint8)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if len(data) > PIECE:
        found = [word_hashes(t) for t in texts]
        return np.concatenate(found), np.cumsum([0, *map(len, found)])
    starts, _, sums, lengths = _word_sums(data)
    return _word_hash(sums, lengths), np.searchsorted(starts, at)


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` consecutive words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, _splitmix(seed * 7919 + width), np.uint64)
    for at in range(0, n, PIECE):
        acc = out[at : at + PIECE]
        for k in range(width):
            acc += words[at + k : at + k + len(acc)] * np.uint64(_splitmix(seed * 104729 + k) | 1)
        acc[:] = mix(acc)
    return out


def sequence_hash(words: np.ndarray, seed: int = 0) -> int:
    """A signed 64-bit hash of a whole sequence of word hashes."""
    total = np.array([_splitmix(seed + len(words))], np.uint64)
    for at in range(0, len(words), PIECE):
        part = words[at : at + PIECE]
        place = mix(np.arange(at, at + len(part), dtype=np.uint64) * np.uint64(2) + np.uint64(_splitmix(seed) | 1))
        total += (part * (place | np.uint64(1))).sum(dtype=np.uint64)
    return int(mix(total).view(np.int64)[0])


def sequence_hashes(words: np.ndarray, at: np.ndarray, seed: int = 0) -> np.ndarray:
    """:func:`sequence_hash` of each text, given the words of all and where each text's begin."""
    if len(at) == 2:
        return np.array([sequence_hash(words, seed)])
    n = np.diff(at)
    place = mix(np.arange(max(n), dtype=np.uint64) * np.uint64(2) + np.uint64(_splitmix(seed) | 1)) | np.uint64(1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * place[np.arange(len(words)) - np.repeat(at[:-1], n)], out=sums[1:])
    begun = mix(n.astype(np.uint64) + np.uint64((seed + 0x9E3779B97F4A7C15) & _MASK))
    return mix(begun + sums[at[1:]] - sums[at[:-1]]).view(np.int64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's ``width``-word shingles, ASCII case folded.

    A text with fewer words than ``width`` has its whole word sequence as its one shingle;
    a text without words has none.
    """
    words = word_hashes(text, lower=True)
    if not len(words):
        return words
    found = window_hashes(words, min(width, len(words)))
    del words
    found.sort()
    return found[np.r_[True, found[1:] != found[:-1]]]
