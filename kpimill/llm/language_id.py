"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text's vector holds its hashed byte n-grams, with damped counts weighted by inverse document frequency and scaled to
length one.  Every language has several centroids, found by spherical k-means over its training texts; a text takes the
language of the centroid with the largest cosine, and is rejected when even that is too far away: a limit lies
between how far training texts of like length are from centroids of their language that were learned without them, and
how far they are from those of the other languages, which stand in for languages never seen.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpimill.llm.common import batched, record_batch, smallest_hashes

BINS = 4096
CENTROIDS = 3
TRAIN_ROWS = 2000  #: most training texts for all languages together; whole texts, the smallest id hashes of each language
FOLDS = 4  #: parts of the training texts, each held out once when the limits of rejection are set
PIECES = (16, 32, 64, 128, 256)  #: bytes of the heads of training texts that stand in for short texts
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")  # letters, and numbers such as ½
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[*range(48), *range(48, 65), *range(91, 97), *range(123, 128)]] = 32  # what isn't a letter parts words


def has_letter(text: str) -> bool:
    """Whether the text matches ``\\p{L}``."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def gram_counts(texts: list[bytes | None]) -> np.ndarray:
    """A row of hashed counts of 2- and 3-byte n-grams for each text."""
    raw = b" ".join([b""] + [t or b"" for t in texts] + [b""])
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    x = _LOWER[np.frombuffer(raw, np.uint8)]
    x[1:][(x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E)] += 32  # capitals with accents
    out = np.zeros((len(texts), BINS), np.float32)
    lo = 0
    while lo < len(texts):  # so many texts at once that keys and counts stay small
        hi = lo + 1
        base = int(ends[lo - 1]) if lo else 0
        while hi < len(texts) and hi - lo < 128 and ends[hi] - base < 1 << 20:
            hi += 1
        for at in range(base, int(ends[hi - 1]), 1 << 20):
            end = min(at + (1 << 20), int(ends[hi - 1]))
            doc = np.searchsorted(ends[lo:hi], np.arange(at, end), side="right").astype(np.uint32) * np.uint32(BINS)
            a, b = x[at:end], x[at + 1 : end + 1]
            for width in (2, 3):
                key, c = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B), None
                if width == 3:
                    c = np.concatenate((x[at + 2 : end + 2], np.full(max(0, end + 2 - len(x)), 32, np.uint32)))
                    key = a * np.uint32(0xC2B2AE35) + b * np.uint32(0x27D4EB2F) + c * np.uint32(0x165667B1) + np.uint32(77)
                blank = ((a == 32) & (b == 32)) | ((b == 32) & (c == 32) if c is not None else False)
                key = ((key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
                key[blank] = 0  # no feature
                out[lo:hi] += np.bincount(doc + key, minlength=(hi - lo) * BINS).reshape(hi - lo, BINS)
        lo = hi
    out[:, 0] = 0
    return out


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # cosine below which no language is believed, by the binary logarithm of a text's bytes

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.sqrt(counts) * self.idf
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(n > 0, n, 1)


def _octave(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(size, 1))).astype(int)


def _quantile(size: np.ndarray, cos: np.ndarray, q: float) -> np.ndarray:
    """The ``q`` quantile of the cosines of each octave of sizes.

    An octave with too few texts to show that quantile takes in those of nearest size.
    """
    at, need = np.log2(np.maximum(size, 1)), min(len(size), math.ceil(1 / min(q, 1 - q)))
    out = []
    for k in range(int(_octave(size).max()) + 1):
        off = np.maximum(np.maximum(k - at, at - k - 1), 0)
        out.append(np.quantile(cos[off <= np.sort(off)[need - 1]], q))
    return np.array(out)


def _kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    c = [v[0]]
    for _ in range(1, min(k, len(v))):  # each further start is the row furthest from those so far
        c.append(v[np.argmin(np.max(v @ np.array(c).T, axis=1))])
    c = np.array(c)
    for _ in range(rounds):
        near = np.argmax(v @ c.T, axis=1)
        c = np.array([v[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(train: DataFrame, rows: int = TRAIN_ROWS, reject: float = 0.005, strange: float = 0.99) -> Model:
    """From (doc_id, text, lang); rows without a letter or a language teach nothing.

    At most ``rows`` whole texts in all, equally many of each language, by the smallest hashes of id and text.  Two
    cosines tell where to reject, for each octave of sizes: the ``reject`` quantile of those that training texts, and
    heads of them, have to their own language's centroids when these are learned from the other folds; and the
    ``strange`` quantile of those that they have to the other languages' centroids.  A text is rejected below two
    thirds of the way from the second up to the first, and below the first alone where they cross.
    """
    train = train.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).where(F.col("text").rlike(r"\p{L}"))
    languages = train.select("lang").distinct().count()
    if not languages:
        return Model([], np.zeros((0, BINS), np.float32), np.ones(BINS, np.float32), np.zeros(1))
    each = max(1, rows // languages)
    top = smallest_hashes(train, "lang", each)

    def counted(batches):
        for rb in batches:
            for at, texts in batched(rb.column(1), 1 << 20):
                c = gram_counts(texts)
                size, head = pa.array([len(t) for t in texts], pa.int64()), pa.array([t[: max(PIECES)] for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(at, len(texts)), size, head, pa.array([x.tobytes() for x in c], pa.binary())], names=["lang", "size", "head", "counts"])

    got = sorted(top.select("lang", "text").mapInArrow(counted, "lang string, size long, head binary, counts binary").collect(), key=lambda r: (r.lang, bytes(r.counts), bytes(r.head)))
    counts = np.array([np.frombuffer(r.counts, np.float32) for r in got])
    lang = np.array([r.lang for r in got], object)
    size = np.array([r.size for r in got])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    m = Model([], np.zeros((0, BINS), np.float32), idf, np.zeros(1))
    v = m.vectors(counts)
    cents, held = [], []
    for x in sorted(set(lang)):
        own = np.flatnonzero(lang == x)
        c = _kmeans(v[own], CENTROIDS)
        m.languages += [x] * len(c)
        cents.append(c)
        part = np.random.default_rng(0).permutation(len(own)) % FOLDS  # rows are in order of their counts
        for f in range(FOLDS):
            out, rest = own[part == f], own[part != f]
            if len(out) and len(rest):
                held.append((x, out, _kmeans(v[rest], CENTROIDS)))
    m.centroids = np.concatenate(cents).astype(np.float32)
    sizes, own_cos, other_cos = [], [], []

    def measure(vectors: np.ndarray, size: np.ndarray, own: np.ndarray, other: np.ndarray) -> None:
        sizes.append(size)
        own_cos.append(np.max(vectors @ own.T, axis=1))
        other_cos.append(np.max(vectors @ other.T, axis=1) if len(other) else np.zeros(len(vectors)))

    for x, out, c in held:
        other = m.centroids[[k for k, y in enumerate(m.languages) if y != x]]
        measure(v[out], size[out], c, other)
        for n in PIECES:
            heads = [t for t in (bytes(got[i].head)[:n] for i in out if size[i] > n) if has_letter(t.decode("utf-8", "ignore"))]
            if heads:
                measure(m.vectors(gram_counts(heads)), np.full(len(heads), n), c, other)
    if held:
        known, foreign = (_quantile(np.concatenate(sizes), np.concatenate(cos), q) for cos, q in ((own_cos, reject), (other_cos, strange)))
        m.least = np.where(foreign < known, (foreign + 2 * known) / 3, known)
    return m


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def _predict(m: Model):
    def run(batches):
        for rb in batches:
            for at, texts in batched(rb.column(1), 1 << 20):
                cos = m.vectors(gram_counts(texts)) @ m.centroids.T if m.languages else np.zeros((len(texts), 0))
                least = m.least[np.minimum(_octave(np.array([len(t or b"") for t in texts])), len(m.least) - 1)]
                pred, score, rejected = [], [], []
                for row, low, t in zip(cos, least, texts):
                    if t is None or not len(row) or not has_letter(t.decode("utf-8", "replace")):
                        got = (UNKNOWN, 0.0, True)
                    else:
                        k = int(np.argmax(row))
                        got = (m.languages[k], float(min(max(row[k], 0.0), 1.0)), bool(row[k] < low))
                    for x, y in zip((pred, score, rejected), got):
                        x.append(y)
                yield record_batch(_OUT, doc_id=rb.column(0).slice(at, len(texts)), lang_pred=pred, score=score, rejected=rejected)

    return run


def identify_languages(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), one row for each row of ``docs``, learned from ``train`` (doc_id, text, lang).

    ``score`` is the cosine to the nearest centroid.  Null texts and texts without a letter are ``und``, with score 0,
    and rejected; so are all texts where ``train`` teaches no language.  Rows are judged each by its text alone, whole
    texts of any length; other columns are ignored, and an empty table gives an empty result.
    """
    m = fit(train) if model is None else model
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_predict(m), "doc_id long, lang_pred string, score double, rejected boolean")


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, unchanged."""
    names = docs.columns

    def run(batches):
        for rb in batches:
            keep = []
            for at, texts in batched(rb.column(names.index(text_col)), 1 << 20):
                one = pa.RecordBatch.from_arrays([pa.array([None] * len(texts), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])
                for r in _predict(model)([one]):
                    keep += [not x for x in r.column("rejected").to_pylist()]
            yield rb.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
