"""Merging the Burrows-Wheeler transforms of shards by refining their interleave.

Symbols are bytes plus one; 0 is the end of a string.  UTF-8 has no byte 255,
so a symbol fits one byte.  Strings end in marks of their own, ordered as the
strings are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """The sorted suffixes of some strings, and their transform two symbols deep.

    ``place`` holds the text positions of the suffixes in order; ``pair`` the
    two symbols before each, the farther one as the high byte; strings are
    taken as circles.
    """

    place: np.ndarray
    pair: np.ndarray
    strings: int
    last: np.ndarray


def _refine(place: np.ndarray, block: np.ndarray, new: np.ndarray, step: int) -> None:
    """Blocks of suffixes with some common symbols become blocks with ``step`` more, in place.

    ``block`` has for each text position the start of its suffix's block.  Only
    blocks of two suffixes or more are touched: there, the suffixes are put in
    the order of those ``step`` symbols further on.
    """
    alone = new & np.append(new[1:], True)
    at = np.flatnonzero(~alone)
    if not len(at):
        return
    x = place[at]
    key = np.cumsum(new[at], dtype=np.int64)
    key <<= np.int64(32)
    key |= block[x + step]
    order = np.argsort(key, kind="stable")  # runs by block, so nearly sorted
    x, key = x[order], key[order]
    place[at] = x
    fresh = np.append(True, key[1:] != key[:-1])
    new[at[fresh]] = True
    block[x] = np.maximum.accumulate(np.where(fresh, at, 0))


def make_shard(strings: list[np.ndarray]) -> Shard:
    """Sorts the suffixes of strings of bytes: by their first eight symbols, then doubling within what is equal."""
    size = np.array([len(s) + 1 for s in strings], np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    n = int(ends[-1])
    text = np.zeros(n + 8, np.uint8)
    inside = np.ones(n, bool)
    inside[ends - 1] = False
    text[:n][inside] = np.concatenate(strings).astype(np.uint8) + np.uint8(1)
    left = np.repeat(ends, size) - np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key |= np.where(left > k, text[k : n + k], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
    place = np.argsort(key)
    key, ended = key[place], left[place] <= 8
    short = np.flatnonzero(ended)  # equal ones stand in the order of their strings; others are told apart below
    place[short] = place[short][np.lexsort((place[short], key[short]))]
    new = np.append(True, key[1:] != key[:-1]) | ended
    new[1:] |= ended[:-1]
    block = np.empty(n, np.int32)
    block[place] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    deep = 8
    while not new.all():
        _refine(place, block, new, deep)
        deep *= 2
    before = np.arange(n) - 1
    before[begins] = ends - 1
    pair = (text[before[before]].astype(np.uint16) << np.uint16(8)) | text[before]
    return Shard(place, pair[place], len(strings), np.where(size > 1, text[ends - 2], 0))


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Text positions of all suffixes, in blocks that share their first ``depth`` symbols, and the blocks' starts.

    The first rounds put two symbols before all suffixes at once: a stable
    distribution of the shards' interleave by the merged transform's pairs,
    as a step of a radix sort.  Further rounds refine only the blocks of two
    suffixes or more, by the blocks of the suffixes behind, and double the
    depth.  A block that starts in a round bounds the common prefix with the
    suffix before it; those left at the end are the intervals of common
    prefixes of ``depth`` symbols.  Texts are not compared again.
    """
    n = sum(len(s.pair) for s in shards)
    which = np.concatenate([np.full(len(s.pair), k, np.uint8) for k, s in enumerate(shards)])
    ends = np.repeat(np.arange(len(shards), dtype=np.uint8), [s.strings for s in shards])  # suffixes that are an end mark only
    # suffixes of one symbol and the end mark stand in the order of that symbol and of their strings
    last = np.concatenate([s.last for s in shards])
    by = np.argsort(last, kind="stable")
    ones = ends[by[last[by] > 0]]
    group = np.zeros(n, np.int32)
    new = np.append(True, np.zeros(n - 1, bool))
    deep = 0
    while deep < min(8, depth - 1):
        pair = np.empty(n, np.uint16)
        for k, s in enumerate(shards):
            pair[which == k] = s.pair
        order = np.argsort(pair, kind="stable")
        pair, which, group = pair[order], which[order], group[order]
        marks = np.flatnonzero(pair < 256)
        single = np.flatnonzero((pair >= 256) & (pair & 255 == 0))
        which[marks], which[single] = ends, ones
        new = np.append(True, (pair[1:] != pair[:-1]) | (group[1:] != group[:-1]))
        for at in (marks, single):
            new[at] = True
            new[np.minimum(at + 1, n - 1)] = True
        group = np.cumsum(new, dtype=np.int32)
        deep += 2
    place, base = np.empty(n, np.int64), 0
    for k, s in enumerate(shards):
        place[which == k] = s.place + base
        base += len(s.place)
    block = np.empty(n, np.int32)
    block[place] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    while deep < depth and not new.all():
        step = max(1, min(deep, depth - deep))
        _refine(place, block, new, step)
        deep += step
    return place, new


def repeated_starts(strings: list[np.ndarray], weights: np.ndarray, length: int, shards: int = 4) -> list[np.ndarray]:
    """For each string, the offsets at which a substring of ``length`` (two or more) starts that occurs twice or more.

    A string of weight w stands for w occurrences.
    """
    cut = np.linspace(0, len(strings), min(shards, len(strings)) + 1).astype(int)
    parts = [make_shard(strings[a:b]) for a, b in zip(cut[:-1], cut[1:]) if b > a]
    place, new = merge(parts, length)
    size = np.array([len(s) + 1 for s in strings], np.int64)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(strings)), size)[place]
    full = place + length < ends[owner]
    starts = np.flatnonzero(new)
    total = np.add.reduceat(np.where(full, weights[owner], 0), starts)
    hit = np.sort(place[full & np.repeat(total >= 2, np.diff(np.append(starts, len(place))))])
    edges = np.searchsorted(hit, np.append(ends - size, ends[-1]))
    return [hit[a:b] - (e - s) for a, b, e, s in zip(edges[:-1], edges[1:], ends, size)]
