"""Quality classification by compression.

Two zstandard dictionaries hold stretches of all good and of all bad texts of a labelled sample.  A text that compresses
better with the good one than with the bad one looks like good text: the difference of the compressed sizes, divided by
the text's bytes, becomes a probability by logistic calibration on labelled texts that the dictionaries don't hold.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpimill.llm.common import batched, record_batch

BLOCK = 4096  #: bytes compressed together: long texts must not become their own dictionary
DICTIONARY = 1 << 20  #: most bytes of a dictionary
LEVEL = 6
SAMPLE = 1500  #: most labelled texts of each class, those with the smallest hashes of their ids
STRETCH = 256  #: bytes of a stretch of a text in a dictionary; a text with a larger share gives several, spread over it
FOLDS = 4  #: parts of the sample, each compressed with dictionaries of the others to calibrate


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False)


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float] = (0.0, 0.0)  # of a constant and of the difference

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """(bytes with the bad dictionary - bytes with the good one) / bytes of the text; 0 for an empty one."""
        good, bad = _compressor(self.good), _compressor(self.bad)
        out = np.zeros(len(texts))
        for k, t in enumerate(texts):
            d = 0
            for at in range(0, len(t), BLOCK):
                x = t[at : at + BLOCK]
                d += len(bad.compress(x)) - len(good.compress(x))
            out[k] = d / max(len(t), 1)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * self.differences(texts), -40, 40)))


def stretches(text: bytes, share: int) -> list[bytes]:
    """``share`` bytes of a text: all of it, or equal stretches spread over it from its first to its last byte."""
    if share >= len(text):
        return [text]
    n = max(1, share // STRETCH)
    size = share // n
    return [text[at : at + size] for at in (np.linspace(0, len(text) - size, n).astype(int).tolist() if n > 1 else [(len(text) - size) // 2])]


def dictionary(texts: list[bytes], most: int = DICTIONARY) -> bytes:
    """At most ``most`` bytes, as many of each text; what short texts leave of their share goes to the longer ones."""
    texts = sorted((t for t in texts if t), key=lambda t: (len(t), t))
    parts, left = [], most
    for k, t in enumerate(texts):
        got = stretches(t, left // (len(texts) - k))
        left -= sum(map(len, got))
        parts.append(b"".join(got))
    return b"".join(parts[k] for k in np.random.default_rng(0).permutation(len(parts)))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weights of logistic regression on one variable, by Newton's method; the variable counts in its own deviations."""
    scale = float(x.std()) or 1.0
    z, w = np.stack((np.ones(len(x)), x / scale), axis=1), np.zeros(2)
    ridge = np.diag([1e-6, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, bytes]]:
    """(quality, text) of at most ``sample`` labelled ids of each class, drawn from ``labels`` alone by hashes of the ids.

    The counts of the classes tell below which hash four times as many ids as needed lie, so few reach the driver; the
    ids drawn, 2 * ``sample`` at most, are broadcast to ``docs``, and no other text is moved.  Of rows that share an id
    the text with the smallest hash counts.
    """
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null").distinct()
    known = known.withColumn("h", F.xxhash64("doc_id"))
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    drawn = []
    for q, n in sorted(counts.items()):
        p = min(1.0, (4 * sample + 100) / n)
        cut = (1 << 63) - 1 if p == 1.0 else int(-(1 << 63) + p * (1 << 64))
        below = known.where((F.col("quality") == q) & (F.col("h") <= cut)).collect()
        drawn += [(r.doc_id, q) for r in sorted(below, key=lambda r: (r.h, r.doc_id))[:sample]]
    assert len(drawn) <= 2 * sample
    if not drawn:
        return []
    ids = F.broadcast(docs.sparkSession.createDataFrame(drawn, "doc_id long, quality int"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(ids, "doc_id")
    one = texts.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return sorted((r.quality, r.text.encode()) for r in one.select("quality", "t.text").collect())


def fit_sample(rows: list[tuple[int, bytes]]) -> Model:
    """A model of (quality, text); without texts of both classes every score is the share of good ones, smoothed."""
    n1 = sum(q for q, _ in rows)
    if not 0 < n1 < len(rows):
        p = (n1 + 1) / (len(rows) + 2)
        return Model(b"", b"", (math.log(p / (1 - p)), 0.0))

    def with_dictionaries(own: list[tuple[int, bytes]]) -> Model:
        return Model(*(dictionary([t for q, t in own if q == c]) for c in (1, 0)))

    part = [zlib.crc32(t) % FOLDS for _, t in rows]  # equal texts share a part
    x, y = [], []
    for f in range(FOLDS):
        own, rest = [r for r, k in zip(rows, part) if k != f], [r for r, k in zip(rows, part) if k == f]
        if rest and 0 < sum(q for q, _ in own) < len(own):
            x.append(with_dictionaries(own).differences([t for _, t in rest]))
            y += [q for q, _ in rest]
    m = with_dictionaries(rows)
    if len(set(y)) < 2:  # too few for parts
        x, y = [m.differences([t for _, t in rows])], [q for q, _ in rows]
    m.weights = calibrate(np.concatenate(x), np.array(y, float))
    return m


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """From texts of ``docs`` and ``labels`` (doc_id, quality 0 or 1).

    The bound of what is learned from is ``sample`` whole texts of each class to calibrate on, of which a dictionary
    holds ``DICTIONARY`` bytes, an equal share of each (:func:`dictionary`).
    """
    return fit_sample(labelled_sample(docs, labels, sample, id_col, text_col))


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _score(m: Model):
    def run(batches):
        for rb in batches:
            for at, texts in batched(rb.column(1)):
                yield record_batch(_OUT, doc_id=rb.column(0).slice(at, len(texts)), score=m.scores([t or b"" for t in texts]))

    return run


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, score), one row for each row of ``docs``: the probability that its text would be labelled 1.

    Learned from ``labels`` (doc_id, quality), whose texts are those of ``docs``; labels other than 0 and 1 and those
    without a text in ``docs`` teach nothing.  Null and empty texts get the calibration's constant.  Rows are judged each
    by their text alone, whole texts of any length; other columns are ignored, and an empty table gives an empty result.
    """
    m = fit(docs, labels, id_col=id_col, text_col=text_col) if model is None else model
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_score(m), "doc_id long, score double")
