"""SentencePiece encoding by suffix-array matching, and decoding, in vectorised batches.

A batch's text is cut where no merge can cross: between two characters that
no piece holds next to each other.  The distinct segments are concatenated and
indexed by a suffix array; every piece is binary-searched for its range of
occurrences, which gives the edges (start, length, piece); these are sorted by
position and relaxed.  For a unigram model relaxing is the best path; for a
BPE model it is the model's merges, best score first and leftmost among equals.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches
from .textnp import blocks, string_bytes

#: The sign that stands for a space in pieces.
SPACE = "▁"
# Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

#: Characters of distinct segments that are indexed at once.
INDEX_CHARS = 1 << 18
#: Bytes of text that are split into segments at once.
SPLIT_BYTES = 1 << 20
#: Segments that a worker remembers between batches.
REMEMBERED = 300_000
#: Merges of longer segments go through a heap, one by one.
LONG = 64


@dataclass
class Model:
    kind: int
    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    unknown: int
    byte_fallback: bool
    dummy_prefix: bool
    bytes_ids: np.ndarray

    def __post_init__(self):
        usable = [i for i, t in enumerate(self.types) if t in (NORMAL, USER_DEFINED)]
        self.ids = np.array(sorted(usable, key=lambda i: self.pieces[i]), np.int64)
        texts = [self.pieces[i] for i in self.ids]
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.longest = int(self.lengths.max(initial=1))
        self.table = np.zeros((len(texts), self.longest), np.uint32)
        for k, t in enumerate(texts):
            self.table[k, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        order = sorted(set(self.scores[self.ids].tolist()), reverse=True)
        place = {s: k for k, s in enumerate(order)}
        self.ranks = np.array([place[s] for s in self.scores[self.ids].tolist()], np.int32)
        # space signs only lead in pieces, so that a word and those before it are a segment;
        # an ASCII character that stands in no longer piece is one by itself, unless stretches
        # of unknown characters are one token
        self.space_leads = all(SPACE not in t.lstrip(SPACE) for t in texts) and (self.byte_fallback or SPACE in texts)
        inner = {c for t in texts if len(t) > 1 for c in t}
        alone = "".join(re.escape(chr(i)) for i in range(128) if chr(i) not in inner) if self.byte_fallback else ""
        self.cut = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        raw = [b"" if self.types[i] in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if self.types[i] == BYTE else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        raw[self.unknown] = " ⁇ ".encode()
        self.raw_off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)


@cache
def load(path: str) -> Model:
    """Reads a model file; its normaliser must be the identity that keeps all spaces."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec, trainer = proto.normalizer_spec, proto.trainer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or trainer.treat_whitespace_as_suffix:
        raise ValueError("only models with the identity normaliser are supported")
    if trainer.model_type not in (UNIGRAM, BPE) or any(p.type == USER_DEFINED for p in proto.pieces):
        raise ValueError("only unigram and BPE models without user-defined pieces are supported")
    pieces = [p.piece for p in proto.pieces]
    types = np.array([p.type for p in proto.pieces])
    bytes_ids = np.zeros(256, np.int64)
    for i in np.flatnonzero(types == BYTE).tolist():
        bytes_ids[int(pieces[i][3:5], 16)] = i
    return Model(trainer.model_type, pieces, np.array([p.score for p in proto.pieces], np.float64), types, int(np.flatnonzero(types == UNKNOWN)[0]), trainer.byte_fallback, spec.add_dummy_prefix, bytes_ids)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` characters.

    The first sort takes as many characters as fit 62 bits; further ones double.
    """
    n = len(text)
    symbols = np.zeros(int(text.max(initial=0)) + 1, np.int64)
    symbols[text] = 1
    rank = np.cumsum(symbols)
    bits = int(rank[-1]).bit_length()
    width = min(max(1, 62 // bits), depth)
    rank = np.concatenate([rank[text], np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= np.int64(bits)
        key |= rank[k : n + k]
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[1], 1 + np.cumsum(ranked[1:] != ranked[:-1])])
        key = rank << np.int64(32)
        key[: max(0, n - width)] |= rank[width:]
        width *= 2


def occurrences(text: np.ndarray, order: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The range of suffixes that start with each piece, by binary search of all pieces at once."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(model.longest, text.dtype)])
    bounds = []
    for upper in (False, True):
        low, high = np.zeros(len(model.lengths), np.int64), np.full(len(model.lengths), n, np.int64)
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            at = order[mid]
            after = np.full(len(live), upper)  # whether the bound lies behind mid; equal so far
            open_ = np.arange(len(live))
            for k in range(model.longest):
                open_ = open_[model.lengths[live[open_]] > k]
                if not len(open_):
                    break
                have, want = padded[at[open_] + k], model.table[live[open_], k]
                differ = have != want
                after[open_[differ]] = have[differ] < want[differ]
                open_ = open_[~differ]
            low[live[after]] = mid[after] + 1
            high[live[~after]] = mid[~after]
            live = live[low[live] < high[live]]
        bounds.append(low)
    return bounds[0], bounds[1]


class Lattice:
    """The edges, sorted by position: ``piece[start, length]`` is a place in ``model.ids``, or -1.

    ``ends[i]`` is where the segment of position ``i`` ends; no edge crosses it.
    """

    def __init__(self, text: np.ndarray, ends: np.ndarray, model: Model):
        order = suffix_order(text, model.longest)
        low, high = occurrences(text, order, model)
        count = high - low
        piece = np.repeat(np.arange(len(count), dtype=np.int32), count)
        start = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        size = model.lengths[piece]
        keep = start + size <= ends[start]
        self.piece = np.full((len(text), model.longest + 1), -1, np.int32)
        self.piece[start[keep], size[keep]] = piece[keep]  # a bucket for each position and length

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of each edge, by position and length."""
        start, size = np.nonzero(self.piece >= 0)
        return start, size, self.piece[start, size]


def _relax_merges(n: int, begins: np.ndarray, ends: np.ndarray, lattice: Lattice, model: Model) -> np.ndarray:
    """True where a token starts, after all merges of all segments."""
    none = np.iinfo(np.int32).max
    token = np.ones(n, bool)
    size = ends - begins
    for i in np.flatnonzero(size > LONG).tolist():
        _merge_long(int(begins[i]), int(ends[i]), token, lattice, model)
    small = np.flatnonzero((size > 1) & (size <= LONG))
    if not len(small):
        return token
    owner = np.repeat(np.arange(len(small)), size[small])
    start = np.repeat(begins[small] - (np.cumsum(size[small]) - size[small]), size[small]) + np.arange(size[small].sum())
    last = ends[small]
    while True:
        # symbols in order: each pair of neighbours of one segment may merge
        same = owner[1:] == owner[:-1]
        stop = np.where(np.append(same[1:], False), np.append(start[2:], 0), last[owner[1:]]) if len(owner) > 1 else np.zeros(0, np.int64)
        width = stop - start[:-1]
        fits = same & (width <= model.longest)
        found = np.full(len(same), -1, np.int32)
        found[fits] = lattice.piece[start[:-1][fits], width[fits]]
        rank = np.where(found >= 0, model.ranks[found], none)
        live = rank < none
        if not live.any():
            return token
        first = np.flatnonzero(np.append(True, ~same))  # each segment's first symbol
        best = np.minimum.reduceat(np.append(rank, none), first)
        hit = live & (rank == np.repeat(best, np.diff(np.append(first, len(owner))))[:-1])
        at = np.flatnonzero(hit)
        at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]  # the leftmost of each segment
        token[start[at + 1]] = False
        busy = np.zeros(len(last), bool)
        busy[owner[at]] = True
        keep = busy[owner]
        keep[at + 1] = False
        owner, start = owner[keep], start[keep]


def _merge_long(begin: int, end: int, token: np.ndarray, lattice: Lattice, model: Model) -> None:
    """The same merges for one long segment, in the order of a heap."""
    n = end - begin
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        b = after[a]
        if b < n and (size := after[b] - a) <= model.longest and (p := lattice.piece[begin + a, size]) >= 0:
            heapq.heappush(heap, (int(model.ranks[p]), a, b, after[b]))

    for a in range(n - 1):
        offer(a)
    alive = [True] * n
    while heap:
        _, a, b, stop = heapq.heappop(heap)
        if not alive[a] or after[a] != b or b >= n or not alive[b] or after[b] != stop:
            continue
        alive[b] = False
        token[begin + b] = False
        after[a] = stop
        if stop < n:
            before[stop] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])


def _relax_path(n: int, begins: np.ndarray, ends: np.ndarray, edge: tuple[np.ndarray, np.ndarray, np.ndarray], model: Model) -> np.ndarray:
    """True where a token of the best path starts: edges are relaxed at one depth of all segments after another."""
    least = model.scores[model.ids].min(initial=0.0) - 10.0
    start, size, piece = edge
    # a position stands for its segment's place before it; a segment's end has a slot of its own
    slot = np.arange(n) + np.searchsorted(ends, np.arange(n), "right")
    best, back = np.full(n + len(ends), -np.inf), np.full(n + len(ends), -1, np.int64)
    best[slot[begins]] = 0.0
    depth = np.arange(n) - np.repeat(begins, ends - begins)
    single = np.zeros(n, bool)
    single[start[size == 1]] = True
    missing = np.flatnonzero(~single)
    source = np.concatenate([start, missing])
    target = slot[source] + np.concatenate([size, np.ones(len(missing), np.int64)])
    gain = np.concatenate([model.scores[model.ids[piece]], np.full(len(missing), least)])
    by = np.argsort(depth[source], kind="stable")
    source, target, gain = source[by], target[by], gain[by]
    cut = np.searchsorted(depth[source], np.arange(int(depth.max(initial=0)) + 2))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        value = best[slot[source[a:b]]] + gain[a:b]
        order = np.lexsort((-value, target[a:b]))
        to = target[a:b][order]
        lead = np.append(True, to[1:] != to[:-1])
        to, value, origin = to[lead], value[order][lead], slot[source[a:b]][order][lead]
        better = value > best[to]
        best[to[better]], back[to[better]] = value[better], origin[better]
    token = np.zeros(n + len(ends), bool)
    at = slot[ends - 1] + 1
    while len(at):
        at = back[at]
        at = at[at >= 0]
        token[at] = True
        at = at[back[at] >= 0]
    return token[slot]


def encode_segments(segments: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all segments (escaped text), and their offsets."""
    text = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(size)
    begins, n = ends - size, len(text)
    lattice = Lattice(text, np.repeat(ends, size), model)
    full = begins[size > 0], ends[size > 0]
    token = _relax_merges(n, *full, lattice, model) if model.kind == BPE else _relax_path(n, *full, lattice.edges(), model)
    at = np.flatnonzero(token)
    first = np.searchsorted(at, np.append(begins, n))
    width = np.diff(np.append(at, n))
    found = np.where(width <= model.longest, lattice.piece[at, np.minimum(width, model.longest)], -1)
    ids = np.where(found >= 0, model.ids[found], -1)
    odd = np.unique(np.searchsorted(first, np.flatnonzero(ids < 0), "right") - 1).tolist()
    if odd:
        parts, done = [], 0
        size = np.diff(first)
        for i in odd:
            own = _with_unknown(ids[first[i] : first[i + 1]], segments[i], at[first[i] : first[i + 1]] - begins[i], model)
            parts += [ids[done : first[i]], own]
            done, size[i] = first[i + 1], len(own)
        ids, first = np.concatenate([*parts, ids[done:]]), np.concatenate([[0], np.cumsum(size)])
    return ids, first


def _with_unknown(ids: np.ndarray, segment: str, at: np.ndarray, model: Model) -> np.ndarray:
    """Characters without a piece become bytes, or one unknown token for a stretch of them."""
    out: list[int] = []
    for k, i in enumerate(ids.tolist()):
        if i >= 0:
            out.append(i)
        elif model.byte_fallback:
            out += model.bytes_ids[list(segment[at[k]].encode("utf-8", "replace"))].tolist()
        elif not k or ids[k - 1] >= 0:
            out.append(model.unknown)
    return np.array(out, np.int64)


def split(text: str, model: Model) -> list[str]:
    """Segments of an escaped text between which nothing merges."""
    return model.cut.findall(text) if model.space_leads else [text] if text else []


class Encoder:
    """Encodes texts; remembers the segments of former batches up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        ids, sizes, a = [self.ids], [self.size], 0
        while a < len(fresh):
            b, held = a, 0
            while b < len(fresh) and (b == a or held + len(fresh[b]) <= INDEX_CHARS):
                held += len(fresh[b])
                b += 1
            own, first = encode_segments(fresh[a:b], self.model)
            ids.append(own.astype(np.int32))
            sizes.append(np.diff(first))
            a = b
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        self.ids, self.size = np.concatenate(ids), np.concatenate(sizes)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and their offsets."""
        model, segments, counts = self.model, [], [0]
        lead = SPACE if model.dummy_prefix else ""
        for t in texts:
            segments += split(lead + t.replace(" ", SPACE), model) if t else []
            counts.append(len(segments))
        if len(self.known) > REMEMBERED:
            self._forget()
        place = np.fromiter(map(self.known.get, segments, repeat(-1)), np.int64, len(segments))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            unknown = [segments[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(unknown)))
            place[missing] = np.fromiter(map(self.known.__getitem__, unknown), np.int64, len(unknown))
        size = self.size[place]
        begin = (np.cumsum(self.size) - self.size)[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.array(counts)]


def decode_bytes(ids: np.ndarray, off: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of token sequences and their offsets, without the leading space that encoding puts."""
    size = np.diff(model.raw_off)[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(model.raw_off[ids] - ends[:-1], size) + np.arange(ends[-1])
    data, doc = model.raw[at], ends[off]
    if model.dummy_prefix:
        lead = doc[:-1][(doc[:-1] < doc[1:])]
        lead = lead[data[lead] == 32]
        keep = np.ones(len(data), bool)
        keep[lead] = False
        data, doc = data[keep], doc - np.searchsorted(lead, doc)
    return data, doc


def encode(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each whole text, as the SentencePiece library gives them.

    A null or empty text has no tokens.  Repeated rows each keep theirs, an
    empty table gives none, other columns are ignored.  Returns doc_id, n_tokens, ids, round_trip (whether decoding the
    ids gives the text again, byte for byte).
    """
    frame = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    held: list[Encoder] = []  # a task's own, which ends with it: workers outlive tasks

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Encoder(load(model_path)))
        encoder, texts = held[0], batch.column("text")
        buf, off = string_bytes(texts)
        ids, sizes, same = [], [], []
        for a, b in blocks(off, SPLIT_BYTES):
            own, ends = encoder([x or "" for x in texts.slice(a, b - a).to_pylist()])
            data, doc = decode_bytes(own, ends, encoder.model)
            equal = np.diff(doc) == np.diff(off[a : b + 1])
            if equal.all():
                wrong = np.flatnonzero(data != buf[off[a] : off[b]])
                equal[np.searchsorted(doc, wrong, "right") - 1] = False
            else:
                for j in np.flatnonzero(equal).tolist():
                    equal[j] = np.array_equal(data[doc[j] : doc[j + 1]], buf[off[a + j] : off[a + j + 1]])
            ids.append(own)
            sizes.append(np.diff(ends))
            same.append(equal)
        size = np.concatenate(sizes)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), lists, pa.array(np.concatenate(same))], ["doc_id", "n_tokens", "ids", "round_trip"])

    return map_batches(frame, step, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of each row's ids in ``text_col``; null ids give a null text.

    Bytes that are not UTF-8 become the replacement character.
    """
    names = [c for c in encoded.columns if c != text_col]
    frame = encoded.select(*[F.col(c) for c in names], F.col(ids_col).cast("array<int>").alias(text_col))
    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1]] + [f"`{text_col}` string"])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, column = load(model_path), batch.column(batch.num_columns - 1)
        out: list[str | None] = []
        for row in column.to_pylist():
            ids = np.array([x for x in row or () if x is not None and 0 <= x < len(model.pieces)], np.int64)
            data, _ = decode_bytes(ids, np.array([0, len(ids)]), model)
            out.append(None if row is None else data.tobytes().decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], batch.schema.names)

    return map_batches(frame, step, kind)
