"""Language identification by the nearest of several centroids for each language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_batches
from .textnp import LOWER, blocks, byte_table, string_bytes

#: Entries of a vector: hashed byte n-grams.
DIMENSIONS = 1 << 13
_ORDERS = (1, 2, 3)
_ASCII_LETTERS = byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: Bytes of text whose vectors are held at once.
_BLOCK = 1 << 20
_DOCS = 128
#: Pieces of each length that show how far texts lie from centroids.
_CUTS = 512
#: Runs of anything but letters count as one space, so that layout, digits and signs say nothing.
_FOLD = LOWER.copy()
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def vectors(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of bytes within each text, a row each."""
    n = len(off) - 1
    low = _FOLD[buf].astype(np.uint32)
    blank = low == 32
    keep = np.ones(len(low), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    doc = np.repeat(np.arange(n), np.diff(off))[keep]
    low = low[keep]
    out = np.zeros(n * DIMENSIONS, np.float32)
    for k in _ORDERS:
        if len(low) < k:
            break
        code = np.full(len(low) - k + 1, k, np.uint32)
        for j in range(k):
            code = code * np.uint32(0x01000193) + low[j : len(low) - k + 1 + j] * np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA6B)
        code >>= np.uint32(32 - DIMENSIONS.bit_length() + 1)
        at = doc[: len(code)] * DIMENSIONS + code
        out += np.bincount(at if k == 1 else at[doc[: len(code)] == doc[k - 1 :]], minlength=len(out)).astype(np.float32)
    return out.reshape(n, DIMENSIONS)


@dataclass
class Centroids:
    """A fitted model: weights of n-grams, unit centroids, and the least cosine by length.

    ``reach[k]`` holds for texts of about ``2 ** k`` bytes of letters: the
    fewer there are, the farther a text lies from any centroid.
    """

    weights: np.ndarray
    centers: np.ndarray
    labels: list[str]
    reach: np.ndarray

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.weights
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, cosine, and whether that is too far."""
        near = self.weigh(counts) @ self.centers.T
        best = near.argmax(axis=1)
        value = near[np.arange(len(near)), best]
        return best, value, value < self.reach[_size(counts)]


_SIZES = 12


def _size(counts: np.ndarray) -> np.ndarray:
    """Binary logarithm of the n-grams counted, at most ``_SIZES - 1``."""
    return np.minimum(np.log2(counts.sum(axis=1) / len(_ORDERS) + 1).astype(int), _SIZES - 1)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with farthest-point starts."""
    picks = [0]
    for _ in range(min(k, len(x)) - 1):
        picks.append(int(np.argmin((x @ x[picks].T).max(axis=1))))
    centers = x[picks]
    for _ in range(rounds):
        near = np.argmax(x @ centers.T, axis=1)
        sums = np.stack([x[near == j].sum(axis=0) if (near == j).any() else centers[j] for j in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centers


def _count(texts: list[str]) -> np.ndarray:
    parts = [vectors(*string_bytes(pa.array(texts[a : a + _DOCS], pa.string()))) for a in range(0, len(texts), _DOCS)]
    return np.concatenate(parts) if parts else np.zeros((0, DIMENSIONS), np.float32)


def _evenly(lists: list[list[str]], number: int) -> list[str]:
    """``number`` of the texts, in turn from each list that has any left; one at least of each list that is not empty."""
    out: list[str] = []
    for turn in range(max(map(len, lists), default=0)):
        left = [own[turn] for own in lists if len(own) > turn]
        out += left if turn == 0 else left[: max(0, number - len(out))]
        if len(out) >= number:
            break
    return out


def fit(samples: dict[str, list[str]], clusters: int = 4, share: float = 0.4) -> Centroids:
    """Centroids of labelled texts, and how far from them a text may lie.

    Pieces of the texts of all lengths, drawn in turn from all languages, show
    how cosine falls with length; a text is too far away if its cosine is below ``share`` of that of the
    farthest 1 % of them.  Pieces of under 16 letters say too little to reject.
    """
    none = Centroids(np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), [], np.full(_SIZES, -1.0))
    langs = [k for k in sorted(samples) if samples[k]]
    if not langs:
        return none
    tables = [_count(samples[k]) for k in langs]
    seen = sum((t > 0).sum(axis=0) for t in tables)
    model = Centroids((np.log((1 + sum(map(len, tables))) / (1 + seen)) + 1).astype(np.float32), none.centers, [], none.reach)
    centers = []
    for lang, table in zip(langs, tables):
        got = _cluster(model.weigh(table), clusters)
        centers.append(got)
        model.labels += [lang] * len(got)
    model.centers = np.concatenate(centers).astype(np.float32)
    rng, values, sizes = np.random.default_rng(7), [], []
    mixed = [[samples[k][i] for i in rng.permutation(len(samples[k])).tolist()] for k in langs]
    for length in [4 << k for k in range(_SIZES)]:
        cuts = [t[(a := int(rng.integers(0, len(t) - length + 1))) : a + length] for t in _evenly([[t for t in own if len(t) >= length] for own in mixed], _CUTS)]
        if cuts:
            counts = _count(cuts)
            values.append(model.nearest(counts)[1])
            sizes.append(_size(counts))
    if values:
        value, size = np.concatenate(values), np.concatenate(sizes)
        model.reach = np.array([share * np.quantile(value[size == k], 0.01) if k >= 4 and (size == k).sum() >= 20 else -1.0 for k in range(_SIZES)])
        for k in range(1, _SIZES):  # longer texts than those seen have the reach of the longest
            if not (size >= k).any():
                model.reach[k] = model.reach[k - 1]
    return model


def sample(documents: DataFrame, usable: Column, per_language: int, id_col: str, text_col: str, lang_col: str, least_chars: int = 50, most_chars: int = 50_000, most_languages: int = 1000) -> dict[str, list[str]]:
    """At most ``per_language`` texts of each label, those with the smallest hashes of id and text.

    Texts of ``least_chars`` to ``most_chars`` come first.  A label that has
    too few of them is filled up with shorter ones and with passages of
    ``most_chars`` of longer ones, which start where the hash says, so that no
    label with a text is lost and the sample is bounded in bytes too.  Rows
    that share an id spread by their texts; rows with the same id and text
    count once, however many there are.  More than ``most_languages`` labels
    are an error.
    """
    text, size = F.col(text_col).cast("string"), F.char_length(F.col(text_col).cast("string"))
    u = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), text, F.lit("language")), 11) / F.lit(float(1 << 53))
    start = F.greatest(F.lit(0), F.floor(u * (size - most_chars + 1))).cast("int") + 1
    rows = documents.where(usable & F.col(lang_col).isNotNull() & (size > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), F.when(size > most_chars, F.substring(text, start, F.lit(most_chars))).otherwise(text).alias("text"), u.alias("u"), (~size.between(least_chars, most_chars)).cast("int").alias("outside")
    )
    counts = {(r.lang, r.outside): r.n for r in rows.groupBy("lang", "outside").agg(F.approx_count_distinct("u", 0.02).alias("n")).limit(2 * most_languages + 1).collect()}
    if len({lang for lang, _ in counts}) > most_languages:
        raise ValueError(f"more than {most_languages} labels")
    if not counts:
        return {}
    # thinned to about twice the bound where the rows are read, before anything is moved
    wanted = {(lang, k): n for (lang, k), n in counts.items() if not k or counts.get((lang, 0), 0) < per_language}
    number = F.create_map(*[x for (lang, k), n in wanted.items() for x in (F.struct(F.lit(lang).alias("lang"), F.lit(k).alias("outside")), F.lit(n))])
    thin = rows.where(F.col("u") * number[F.struct("lang", "outside")] < 2.0 * per_language + 100).dropDuplicates(["lang", "outside", "u"])
    order = Window.partitionBy("lang").orderBy("outside", "u", "text")
    got = thin.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("lang", "text")
    out: dict[str, list[str]] = {}
    for r in got.toLocalIterator():
        out.setdefault(r.lang, []).append(r.text)
    return {k: sorted(v) for k, v in out.items()}


def _letters(part: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether each text has a letter, of any script."""
    out = np.zeros(len(own) - 1, bool)
    out[np.searchsorted(own, np.flatnonzero(_ASCII_LETTERS[part]), "right") - 1] = True
    wide = np.zeros(len(own) - 1, bool)
    wide[np.searchsorted(own, np.flatnonzero(part >= 128), "right") - 1] = True
    for j in np.flatnonzero(wide & ~out).tolist():
        out[j] = any(c.isalpha() for c in bytes(part[own[j] : own[j + 1]]).decode("utf-8", "replace"))
    return out


def predict(column: pa.Array, model: Centroids) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Label, score and rejection of each text."""
    n = len(column)
    labels, score, rejected = ["und"] * n, np.zeros(n), np.ones(n, bool)
    if not len(model.labels):
        return labels, score, rejected
    buf, off = string_bytes(column)
    for first, last in blocks(off, _BLOCK):
        for a in range(first, last, _DOCS):
            b = min(last, a + _DOCS)
            part, own = buf[off[a] : off[b]], off[a : b + 1] - off[a]
            best, value, far = model.nearest(vectors(part, own))
            for j in np.flatnonzero(_letters(part, own)).tolist():
                labels[a + j] = model.labels[best[j]]
                score[a + j] = min(1.0, max(0.0, float(value[j])))
                rejected[a + j] = far[j]
    return labels, score, rejected


def held_out(id_col: str = "doc_id") -> Column:
    """True for ids never learnt from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_documents(documents: DataFrame, per_language: int = 400, clusters: int = 4, share: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Centroids:
    """Fitted on at most ``per_language`` labelled rows of each language, none of them held out."""
    return fit(sample(documents, ~held_out(id_col), per_language, id_col, text_col, lang_col), clusters, share)


def identify(documents: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of each document, by cosine to the nearest centroid of TF-IDF n-gram vectors.

    ``lang_pred`` is ``und`` with score 0 where the text is null, empty or has
    no letter, and everywhere where nothing was learnt.  ``rejected`` marks
    texts that are farther from the nearest centroid than it reaches, and all
    ``und``.  Of centroids at the same cosine the first counts, by label.  A
    very long text is one vector, like any other.  Repeated rows each keep
    theirs; an empty table gives an empty one; other columns are ignored,
    whatever their names.  Returns doc_id, held_out, lang_pred, score, rejected.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    frame = documents.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        labels, score, rejected = predict(batch.column("text"), shared.value)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(labels, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return map_batches(frame, step, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(documents: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, as they are.

    Null and empty texts and those without letters are rejected, and all where
    nothing was learnt.  Repeated rows stay or go together, very long texts
    are judged whole, an empty table stays empty.  Columns are neither added
    nor read but for the text, so no name can clash.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, _, rejected = predict(batch.column(text_col), shared.value)
        return batch.filter(pa.array(~rejected))

    return map_batches(documents, step, documents.schema)
