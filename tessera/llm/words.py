"""Words of whole texts as numpy arrays.

A batch of texts is one byte buffer with document offsets, as Arrow holds it. Word edges come from
a table of separator bytes; a 64-bit word hash mixes in the word's blocks of eight bytes one after
another, and a window's hash mixes those of its words, so that neither is a linear function of its
input. All ASCII separators are single bytes in UTF-8, so bytes suffice.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_LONG = 1 << 12  # longer words are hashed one by one
_KEY, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # the leading bytes of a block


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's last step)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (one more than documents); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def give_back() -> None:
    """Return freed memory to the machine; a worker that waits for its next task else keeps what its largest one took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``limit`` bytes of text, one row at least."""
    col = batch.column(batch.schema.get_field_index(text))
    _, offs = buffer_of(col)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    give_back()


def word_edges(buf: np.ndarray, offs: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and per document the number of its first word."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~separator[buf]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    first[offs[:-1][offs[:-1] < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    # a word's last byte stands before a separator or a document's end
    last[:-1] = ~inside[1:]
    ends = offs[1:]
    last[ends[ends > 0] - 1] = True
    s = np.flatnonzero(first & inside)
    e = np.flatnonzero(last & inside) + 1
    return s, e, np.searchsorted(s, offs)


def blocks_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``buf`` on as one number; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: blocks of eight bytes, mixed in one after another."""
    blocks = blocks_at(buf)
    left = (e - s).astype(np.int64)
    out = left.astype(np.uint64) * _STEP
    long = left > _LONG
    live = np.flatnonzero(~long) if long.any() else np.arange(len(s))
    at, left = s[live], left[live]
    while len(live):
        out[live] = mix64((out[live] ^ (blocks[at] & _LOW[np.minimum(left, 8)])) * _KEY + _STEP)
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(long):
        out[k] = int.from_bytes(hashlib.blake2b(buf[s[k] : e[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the ``n`` bytes of ``a`` from ``a_at`` on are those of ``b`` from ``b_at`` on, for each pair of places."""
    x, y = blocks_at(a), blocks_at(b)
    same = np.ones(len(n), bool)
    live, a_at, b_at, left = np.arange(len(n)), a_at, b_at, n
    while len(live):
        equal = (x[a_at] ^ y[b_at]) & _LOW[np.minimum(left, 8)] == 0
        same[live[~equal]] = False
        more = np.flatnonzero(equal & (left > 8))
        live, a_at, b_at, left = live[more], a_at[more] + 8, b_at[more] + 8, left[more] - 8
    return same


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix64(x * _KEY + mix64(y + _STEP))


def window_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words inside one document, and the number of its first word."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # windows of 1, 2, 4, ... words; those that make up k are joined from left to right
    out, width, done = None, h, 0
    size = 1
    while size <= k:
        if k & size:
            part = width[done : done + n - k + 1]
            out = part if out is None else _pair(out, part)
            done += size
        if 2 * size <= k:
            width = _pair(width[: len(width) - size], width[size:])
        size *= 2
    ok = np.ones(n - k + 1, bool)
    for b in np.unique(first[1:-1]):  # windows that would reach over a document's start
        ok[max(0, b - k + 1) : b] = False
    at = np.flatnonzero(ok)
    return mix64(out[at]), at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start .. start + length - 1 of each pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
