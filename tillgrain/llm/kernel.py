"""Vectorised text kernel: words and hashes straight from Arrow string buffers.

Every per-text operator of this subpackage needs the same first step: find the words of each whole
text and give each a 64-bit hash. Doing that word by word in Python costs about a microsecond a word;
here it is a handful of numpy passes over the UTF-8 bytes of a slice of texts.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D (multi-byte UTF-8 sequences hold no
such byte, so this equals ``[^\\x20\\x09-\\x0D]+`` on code points). Its hash is a polynomial over the
64-bit ring whose byte values are random 64-bit numbers, finished by a mixer. A hash is only ever used
to find candidates or to stand for equality of sets; where a result hangs on one text holding another's
words, the operator compares the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once. Temporary arrays take some 40 bytes for each; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C13 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> _U(32))


class Texts:
    """A slice of texts as one byte buffer. ``bounds[i]:bounds[i + 1]`` are the bytes of text i; a null text is empty."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int, null: np.ndarray):
        self.data, self.bounds, self.first, self.null = data, bounds, first, null

    def __len__(self) -> int:
        return len(self.bounds) - 1


def slices(column: pa.Array) -> Iterator[Texts]:
    """Cut a string column into slices of about SLICE_BYTES, whole texts each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    null = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, "right")) - 1
        end = min(max(end, at + 1), len(column))
        yield Texts(data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at], at, null[at:end])
        at = end


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a slice, in order: byte starts and ends, the index of the first word of each text, hashes."""

    def __init__(self, texts: Texts, lower: bool, seed: int = 1, hashed: bool = True):
        raw, bounds = texts.data, texts.bounds
        filled = ~_SPACE[raw]
        begins = filled.copy()
        begins[1:] &= ~filled[:-1]
        heads = bounds[:-1][bounds[:-1] < bounds[1:]]
        begins[heads] = filled[heads]  # a text's first byte begins a word even if the text before ends in one
        ends = filled.copy()
        ends[:-1] &= ~filled[1:]
        tails = heads[1:] - 1
        if len(tails):
            ends[tails] = filled[tails]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, bounds)
        if hashed:
            chars = _LOWER[raw] if lower else raw
            powers, inverse = _powers(len(raw))
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_byte_values(seed)[chars] * powers[:-1], out=total[1:])
            self.hashes = mix((total[self.ends] - total[self.starts]) * inverse[self.starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


_KEPT: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "powers" not in _KEPT or len(_KEPT["powers"]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, by in (("powers", _BASE), ("inverse", _INVERSE)):
            steps = np.full(size, by, np.uint64)
            steps[0] = 1
            _KEPT[name] = np.multiply.accumulate(steps)
    return _KEPT["powers"][: n + 1], _KEPT["inverse"][: n + 1]


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles of a slice with repeats, and the bounds of each text's. A text with fewer words has
    its whole sequence as one; a text without words has none."""
    h, counts = words.hashes, words.counts()
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    bounds = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - words.first[:-1], sizes)
    short = np.repeat(counts < n, sizes)
    out = np.zeros(len(at), np.uint64)
    last = len(h) - 1
    for k in range(n):
        term = h[np.minimum(at + k, last)] if last >= 0 else h
        term = mix(term + _U(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
        if short.any():
            term = np.where(short & (np.repeat(counts, sizes) <= k), _U(0), term)
        out += term
    return mix(out), bounds


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and their bounds."""
    out = hashes.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][bounds[:-1] < len(out)]] = True
    running = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=running[1:])
    return out[keep], running[bounds]


def word_list(text: str | None, lower: bool) -> list[str]:
    """The words of one text, as strings: for exact checks of candidates."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    if lower:
        data = data.lower()  # bytes.lower changes A-Z only
    return [w.decode("utf-8", "surrogatepass") for w in data.translate(_TO_SPACE).split(b" ") if w]


_TO_SPACE = bytes(0x20 if i in (0x20, 9, 10, 11, 12, 13) else i for i in range(256))
