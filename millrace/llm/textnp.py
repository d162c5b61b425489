"""Vectorised text kernels over Arrow string buffers, shared by the operators.

Every function works on the UTF-8 bytes of a block of whole documents:
``buf`` (uint8) and ``off`` (int64, one more entry than documents).  Null
texts become empty ones.  Nothing here knows about Spark; the operators call
these helpers inside ``mapInArrow`` tasks on blocks of bounded size.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are handled at once (a longer document is a block of its own).
BLOCK_BYTES = 1 << 18

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Masks of the first 0 to 8 bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_powers: dict[str, np.ndarray] = {}


def byte_table(inside: bytes) -> np.ndarray:
    """A 256-entry boolean table that is true for the given bytes."""
    table = np.zeros(256, bool)
    table[np.frombuffer(inside, np.uint8)] = True
    return table


#: Bytes of words that are split at ASCII white space.
NOT_SPACE = ~byte_table(b" \t\n\x0b\x0c\r")
#: Bytes of words of letters and digits: ASCII alphanumerics and everything beyond ASCII.
ALNUM = byte_table(bytes(i for i in range(256) if i >= 128 or chr(i).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(buf, off)`` of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.string()), False
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    size = int(off[-1] - off[0])
    buf = np.frombuffer(data, np.uint8, size, int(off[0])) if size else np.zeros(0, np.uint8)
    return buf, off - off[0]


def blocks(off: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``most`` bytes, or one document each."""
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_spans(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words, and ``first``: words before each document."""
    m = inside[buf]
    starts, ends = m.copy(), m.copy()
    starts[1:] &= ~m[:-1]
    ends[:-1] &= ~m[1:]
    cut = off[(off > 0) & (off < len(buf))]
    starts[cut] = m[cut]
    ends[cut - 1] = m[cut - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off)


def _power(which: str, base: int, n: int) -> np.ndarray:
    kept = _powers.get(which)
    if kept is None or len(kept) < n:
        size = max(n, 4 * BLOCK_BYTES)
        kept = np.full(size, base & _MASK, np.uint64)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        if size <= 16 * BLOCK_BYTES:
            _powers[which] = kept
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(buf: np.ndarray) -> np.ndarray:
    """Prefix sums ``h`` of a polynomial hash; see :func:`neighbour_hashes`.

    Texts can be made whose spans collide under it, so it only orders; what is
    equal is told by :func:`hash_spans`, digests or bytes.
    """
    h = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power("up", _BASE, len(buf)), out=h[1:])
    return h


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal wherever equal bytes stand."""
    return mix((h[ends] - h[starts]) * _power("down", _INV, len(h))[starts] + (ends - starts).astype(np.uint64))


def neighbour_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all byte spans of one width, as :func:`span_hashes` gives them."""
    if len(h) <= width:
        return np.zeros(0, np.uint64)
    out = h[width:] - h[:-width]
    out *= _power("down", _INV, len(h))[: len(out)]
    out += np.uint64(width)
    return mix(out)


def new_key() -> int:
    """A key for :func:`hash_spans` that no text can have been made for."""
    return secrets.randbits(63)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a round, each mixed into a state that begins with the key.

    For any one key, known beforehand, spans can be made that collide; where
    equal hashes stand for equal bytes, each run draws its own key, so that two given spans
    collide with a chance of 2 ** -64.  Spans of over 512 bytes are hashed one by one.
    """
    size = ends - starts
    out = mix((size.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE) ^ np.uint64(key)) if key else (size.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
    wide = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(buf) + 1,), "<u8", wide, strides=(1,))
    live = np.flatnonzero(size <= 512)
    done = 0
    while len(live):
        left = size[live] - done
        live, left = live[left > 0], left[left > 0]
        chunk = eights[starts[live] + done] & _FIRST[np.minimum(left, 8)]
        out[live] = mix(mix(out[live] ^ chunk) + np.uint64(_BASE))
        done += 8
    for i in np.flatnonzero(size > 512).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]], seed=key)
    return out


def equal_spans(one: np.ndarray, starts: np.ndarray, ends: np.ndarray, two: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Where the bytes of paired spans of two buffers are the same."""
    size = ends - starts
    out = size == stops - begins
    eights = [np.ndarray((len(b) + 1,), "<u8", np.concatenate([b, np.zeros(8, np.uint8)]), strides=(1,)) for b in (one, two)]
    live, done = np.flatnonzero(out & (size <= 512)), 0
    while len(live):
        live = live[size[live] > done]
        mask = _FIRST[np.minimum(size[live] - done, 8)]
        same = (eights[0][starts[live] + done] & mask) == (eights[1][begins[live] + done] & mask)
        out[live[~same]] = False
        live, done = live[same], done + 8
    for i in np.flatnonzero(out & (size > 512)).tolist():
        out[i] = bool(np.array_equal(one[starts[i] : ends[i]], two[begins[i] : stops[i]]))
    return out


def digests(buf: np.ndarray, off: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each whole text."""
    return [xxhash.xxh3_128_digest(buf[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += words[k : k + n]
        out *= np.uint64(_BASE)
        out ^= out >> np.uint64(32)
    return mix(out)


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct word shingles: sorted hashes and their offsets by document.

    Words are lower-cased and split at white space.  A document with fewer
    words than ``width`` has one shingle, the whole sequence; one without
    words has none.
    """
    low = LOWER[buf]
    s, e, first = word_spans(low, off, NOT_SPACE)
    words = hash_spans(low, s, e, key)
    n = np.diff(first)
    every = window_hashes(words, width)
    count = np.where(n >= width, n - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    begin = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    values = every[begin] if len(every) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        own = np.array([int(mix(np.array([_fold(words[first[i] : first[i + 1]])], np.uint64))[0]) for i in short], np.uint64)
        values, doc = np.concatenate([values, own]), np.concatenate([doc, short])
    if len(short):
        order = np.argsort(doc, kind="stable")
        values, doc = values[order], doc[order]
    edges = np.searchsorted(doc, np.arange(len(n) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def _fold(words: np.ndarray) -> int:
    out = len(words) * 0x51ED2701
    for w in words.tolist():
        out = (out + w) * _BASE & _MASK
        out ^= out >> 32
    return out
