"""Words of many texts at once: numpy over the bytes of an Arrow column, with no Python loop over words or documents.

A word is a run of bytes other than space and 0x09-0x0D, lower-cased in A-Z; words never cross documents. A word's
64-bit hash is a polynomial of its bytes, from running sums over PIECE bytes at a time, and mixed; equal words have equal
hashes, also where a piece ends within one. So a long text takes little more memory than its words' positions and hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_INSIDE = ~np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2 ** 64
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base ("up") or of its inverse ("down")."""
    if kind not in _powers or len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def mapped(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] for bytes and a table of 256 bytes, without an index of eight bytes for each."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Part:
    """Some documents' bytes: data, lower-cased unless raw; ends: where each document ends in it."""

    first: int
    data: np.ndarray
    ends: np.ndarray


def parts(column: pa.Array, most: int = 1 << 20) -> Iterator[Part]:
    """Cuts a binary column (null: empty) into parts of about most bytes, whole documents each."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    sizes = np.diff(at)
    if column.null_count:  # a null may cover bytes
        column = column.fill_null(b"")
        yield from parts(column, most)
        return
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield Part(lo, data[at[lo] : at[hi]], np.cumsum(sizes[lo:hi]))
        lo = hi


@dataclass
class Words:
    """starts, ends: byte positions in data; doc: a word's document; hashes: its mixed hash; counts: words of each document."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray


def words(data: np.ndarray, ends: np.ndarray) -> Words:
    """data: lower-cased bytes."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), np.zeros(len(ends), np.int64))
    inside = mapped(data, _INSIDE)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = np.concatenate(([0], ends[:-1]))
    heads = heads[heads < n]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    stops = np.flatnonzero(last) + 1
    sums = np.zeros(len(starts), np.uint64)
    for lo in range(0, n, PIECE):
        hi = min(n, lo + PIECE)
        running = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _power("up", hi - lo), out=running[1:])
        own = slice(np.searchsorted(stops, lo, side="right"), np.searchsorted(starts, hi))
        first, last = np.maximum(starts[own] - lo, 0), np.minimum(stops[own] - lo, hi - lo)
        here = (running[last] - running[first]) * _power("down", hi - lo)[first]
        if len(here) and starts[own.start] < lo:  # the rest of a word
            here[:1] *= np.uint64(pow(_BASE, lo - int(starts[own.start]), 1 << 64))
        sums[own] += here
    doc = np.searchsorted(ends, starts, side="right")
    return Words(starts, stops, doc, mixed(sums), np.bincount(doc, minlength=len(ends)))


def grams(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """hash, index of the first word: runs of size words of one document, in order. Shorter documents have none."""
    n = len(w.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = w.hashes[:n].copy()
    for k in range(1, size):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + w.hashes[k : n + k]
    at = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :])
    return mixed(h[at]), at
