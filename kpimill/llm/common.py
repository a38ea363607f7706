"""Staging of intermediate tables and Arrow/numpy helpers that several operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOTS: "weakref.WeakKeyDictionary" = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """A folder of this session below ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves if the master is local, as in tests; on a cluster its files would lie
    on the executors' own disks, so there it is an error.
    """
    sc = spark.sparkContext
    root = _ROOTS.get(sc)
    if root is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="kpimill-")
            sc.setCheckpointDir(base)
        root = f"{base.rstrip('/')}/kpimill-{uuid.uuid4().hex}"
        _ROOTS[sc] = root
        atexit.register(_remove, weakref.ref(sc), root)
    return root


def _remove(sc_ref, path: str) -> None:
    try:
        sc = sc_ref()
        if sc is not None and sc._jsc is not None:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; leftovers are only scratch files
        pass


class Staged:
    """A table written to the shared folder: reading it again neither recomputes nor depends on lost executors."""

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.spark, self.schema = spark, df.schema
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(self.path)

    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Only for tables that no pending result reads."""
        _remove(weakref.ref(self.spark.sparkContext), self.path)


def stage(df: DataFrame, name: str) -> DataFrame:
    return Staged(df, name).df()


HOT = 1000  #: rows of a key beyond which it counts as hot
HOT_KEYS = 10_000  #: hot keys, the commonest, whose rows stay where they are; no other key can have more than a 10,000th of the rows


def hot_keys(df: DataFrame, key: str, count: str | None = None) -> DataFrame | None:
    """The commonest ``HOT_KEYS`` keys of those with more than ``HOT`` rows, or None.  ``count``: column of known counts."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg((F.sum(count) if count else F.count("*")).alias("__rows"))
    hot = Staged(sizes.where(F.col("__rows") > HOT).orderBy(F.desc("__rows"), key).limit(HOT_KEYS).select(key), "hot").df()
    return None if hot.isEmpty() else hot


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has at most one row for each key; rows of ``hot`` keys are not shuffled.

    The rows of ``right`` for the hot keys, ``HOT_KEYS`` at most, are broadcast; all others meet by the key, and those
    without a key, which match nothing, don't move either.  ``hot`` defaults to the hot keys of ``left``, which then
    should be a table and no long plan.
    """
    hot = hot_keys(left, key) if hot is None else hot
    some = left.where(F.col(key).isNotNull())
    if hot is None:
        out = some.join(right, key, how)
    else:
        few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
        out = some.join(F.broadcast(hot), key, "left_anti").join(right, key, how).unionByName(some.join(F.broadcast(hot), key, "left_semi").join(few, key, how))
    if how == "left":
        out = out.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished stages now instead of at the next full collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def smallest_hashes(df: DataFrame, group: str, each: int, h: str = "h", text: str = "text") -> DataFrame:
    """At most ``each`` rows of each value of ``group``, by the smallest (``h``, ``text``), where ``h`` is a 64-bit hash.

    The counts of the groups (few, like languages or labels) tell below which hash four times as many rows as needed
    lie; only those are shuffled, however large the table is.
    """
    counts = df.groupBy(group).count().collect()
    if not counts:
        return df
    share = {r[group]: min(1.0, (4 * each + 100) / r["count"]) for r in counts}
    cut = F.create_map(*[F.lit(x) for g, p in share.items() for x in (g, (1 << 63) - 1 if p == 1.0 else int(-(1 << 63) + p * (1 << 64)))])
    few = df.where(F.col(h) <= cut[F.col(group)])
    return few.withColumn("__at", F.row_number().over(Window.partitionBy(group).orderBy(h, text))).where(F.col("__at") <= each).drop("__at")


_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if _POW["n"] < n:
        m = max(n, 1 << 16)
        a, b = np.full(m, _BASE, _U), np.full(m, _INV, _U)
        a[0] = b[0] = 1
        _POW.update(n=m, a=np.multiply.accumulate(a), b=np.multiply.accumulate(b))
    return _POW["a"], _POW["b"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gets the hash of any stretch of bytes."""
    a, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * a[: len(data)], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, b = powers(len(h))
    return mix((h[end] - h[start]) * b[start] + (end - start).astype(_U))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PIECE = 1 << 20


def word_hashes(text: bytes, fold: bool = True) -> np.ndarray:
    """One 64-bit hash for each word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased if ``fold``."""
    data, out, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data) and not _SPACE[data[end]]:  # a piece ends at white space
            near = np.flatnonzero(_SPACE[data[end : end + _PIECE]])
            end = end + int(near[0]) if len(near) else min(len(data), end + _PIECE)
        d = data[at:end]
        space = _SPACE[d]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        if len(edge):
            out.append(span_hash(prefix_hash(_FOLD[d] if fold else d), edge[::2], edge[1::2]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, _U)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; of fewer words, the sequence as a whole."""
    w = word_hashes(text) if text else np.zeros(0, _U)
    if not len(w):
        return w
    n = min(width, len(w))
    h = np.full(len(w) - n + 1, _U(n), _U)
    for k in range(n):
        h = h * _U(0xD6E8FEB86659FD93) + w[k : len(w) - n + 1 + k]
    return np.unique(mix(h))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary()).to_pylist()


def binary_rows(column: pa.Array, width: int, dtype=np.uint8) -> np.ndarray:
    """Fixed-width binaries as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def batched(column: pa.Array, most: int = 4 << 20):
    """(first row, texts as bytes) of stretches of at most ``most`` bytes, one row at least."""
    texts = as_bytes(column)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") <= most):
            size += len(texts[end] or b"")
            end += 1
        yield at, texts[at:end]
        at = end


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
