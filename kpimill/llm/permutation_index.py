"""Approximate nearest neighbours by a permutation index.

Pivots are a few of the vectors, their number growing with the root of the table.  A vector is represented by its nearest
pivots in order, and posted in the inverted files of these pivots with its place in each.  A query reads the files of its
own nearest pivots, ranks what it finds there by the footrule distance between the orders (a pivot that an order doesn't
hold counts as standing at its end), and only the best of the whole table are measured exactly.

The index is dealt by document: each shard is a random part of the table, holds its vectors once and the inverted files
of these in memory, so that neither vectors nor postings are copied.  Queries come to the shards in blocks of bounded
size.  As shards are random, a shard's share of the best of the whole table by footrule is known up to its standard
deviation; each shard measures that many and four standard deviations more, and passes on only its nearest.

Equal vectors are one entry with its smallest ids, and queries with equal vectors are one query, so a vector that fills a
third of the table is measured once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpimill.llm.common import Staged, join_hot, record_batch

ORDER = 128  #: pivots of a vector's order, and so files that hold it
PROBED = 128  #: files that a query reads
LEAST_PIVOTS, MOST_PIVOTS = 256, 4096
QUERY_BLOCK = 32_768  #: queries that go to the shards together, some 25 MB
SHARD = 32_768  #: most entries of a shard


def pivot_count(entries: int) -> int:
    """Pivots of a table: four times the root of its entries, within bounds."""
    return min(entries, MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(4 * math.sqrt(entries))))


def measured_count(entries: int) -> int:
    """Entries of the whole table that a query measures: ten times the root of all, a tenth in tables of under 10,000."""
    return math.ceil(min(entries / 10, 10 * math.sqrt(entries)))


def _usable(batches):
    """(id, float64 bytes) of the vectors that take part; -0.0 is 0.0."""
    schema = pa.schema([("vec_id", pa.int64()), ("size", pa.int32()), ("vec", pa.binary())])
    for rb in batches:
        ids, size, vec = [], [], []
        for i, v in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
            if i is None or not v or any(x is None for x in v):
                continue
            x = np.array(v, np.float64) + 0.0
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                size.append(len(x))
                vec.append(x.tobytes())
        yield record_batch(schema, vec_id=ids, size=size, vec=vec)


def _matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1)


def orders(x: np.ndarray, pivots: np.ndarray, keep: int) -> np.ndarray:
    """Each vector's nearest pivots, nearest first, ties to the earlier pivot."""
    d = (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :keep].astype(np.uint16)


def footrule_credits(places: np.ndarray, start: np.ndarray, rows: np.ndarray, at: np.ndarray, order: np.ndarray, keep: int, n: int) -> np.ndarray:
    """What the footrule distance of a query's order to each of ``n`` entries falls short of the largest one, halved.

    ``rows`` and ``at`` are the inverted files (entries and their places), that of pivot ``p`` from ``start[p]`` on.  A
    pivot at places i and j of two orders of length m brings the distance down by (m - i) + (m - j) - |i - j|, which is
    twice m - max(i, j).
    """
    lo, hi = start[order], start[order + 1]
    size = hi - lo
    take = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    return np.bincount(rows[take], weights=keep - np.maximum(np.repeat(places, size), at[take]), minlength=n)


def _index(pivots: np.ndarray, keep: int, names: tuple[str, str]):
    """Each vector with its order."""
    schema = pa.schema([(names[0], pa.int64()), (names[1], pa.binary()), ("ord", pa.binary())])

    def run(batches):
        for rb in batches:
            for at in range(0, len(rb), 2048):
                part = rb.slice(at, 2048)
                o = orders(_matrix(part.column(1)), pivots, keep)
                yield record_batch(schema, **{names[0]: part.column(0), names[1]: part.column(1)}, ord=[x.tobytes() for x in o])

    return run


_MET = pa.schema([("query", pa.int64()), ("cid", pa.int64()), ("score", pa.float64())])


def _search(qid: np.ndarray, q: np.ndarray, qo: np.ndarray, pivots: int, k: int, probed: int, share: float):
    """Over entries (cid, vec, ord): each query's ``k`` nearest of each shard, of those that the footrule picks."""

    def shard(cid: np.ndarray, x: np.ndarray, xo: np.ndarray) -> pa.RecordBatch:
        n, keep = xo.shape
        flat = xo.ravel().astype(np.int64)
        files = np.argsort(flat, kind="stable")
        rows, at = (files // keep).astype(np.int32), (files % keep).astype(np.int32)
        start = np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=pivots))))
        few = share * n
        m = min(n, math.ceil(few + 4 * math.sqrt(few * max(1 - share, 0))) + 1)
        places = np.arange(min(probed, keep))
        out = []
        for j in range(len(q)):
            credit = footrule_credits(places, start, rows, at, qo[j, : len(places)].astype(np.int64), keep, n)
            best = np.argpartition(credit, n - m)[n - m :] if m < n else np.arange(n)
            best = best[credit[best] > 0]  # an entry without a file in common isn't found
            d = np.sqrt(((x[best] - q[j]) ** 2).sum(axis=1))
            top = np.lexsort((cid[best], d))[:k]
            out.append((np.full(len(top), qid[j]), cid[best[top]], d[top]))
        return record_batch(_MET, **{c: np.concatenate(v) for c, v in zip(("query", "cid", "score"), zip(*out))})

    def run(batches):
        held, n = [], 0
        for rb in batches:
            for lo in range(0, len(rb), SHARD):
                held.append(rb.slice(lo, SHARD))
                n += len(held[-1])
                if n >= SHARD:
                    t = pa.Table.from_batches(held).combine_chunks()
                    yield shard(t.column("cid").to_numpy(), _matrix(t.column("vec")), _matrix(t.column("ord"), np.uint16))
                    held, n = [], 0
        if n:
            t = pa.Table.from_batches(held).combine_chunks()
            yield shard(t.column("cid").to_numpy(), _matrix(t.column("vec")), _matrix(t.column("ord"), np.uint16))

    return run


def nearest_neighbours(
    vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
    pivots: int | None = None, order: int = ORDER, probed: int = PROBED, measured: int | None = None, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest vectors found for each row whose id is divisible by ``every``.

    ``score`` is the Euclidean distance of the original vectors in double precision; a query's own row is no candidate;
    ties go to the smaller id.  Pivots are ``pivots`` different vectors (default: :func:`pivot_count`), those with the
    smallest hashes; ``measured`` entries (default: :func:`measured_count`, ``k`` + 1 at least) are measured for a query.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id
    and vectors of another length than the commonest (ties: the shortest).  Rows that repeat an id count each, but none
    is a candidate of the query of the same id.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = Staged(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e")).mapInArrow(_usable, "vec_id long, size int, vec binary"), "vectors")
    sizes = rows.df().groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = rows.df().where(F.col("size") == sizes["size"]).select("vec_id", "vec")
    first = Window.partitionBy("vec").orderBy("vec_id")
    # enough of the smallest ids of each vector to answer any query, the query's own among them
    copies = usable.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    entries = Staged(copies.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.col("ids")[0]), "entries")
    n = entries.df().count()
    picked = entries.df().select("vec").orderBy(F.xxhash64("vec"), "vec").limit(pivots or pivot_count(n)).collect()
    p = np.array([np.frombuffer(r.vec, np.float64) for r in picked])
    order = min(order, len(p))
    index = Staged(entries.df().select("cid", "vec").mapInArrow(_index(p, order, ("cid", "vec")), "cid long, vec binary, ord binary"), "index").df()
    asked = usable.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec").distinct()
    asked = Staged(asked.withColumn("query", F.xxhash64("vec")), "asked").df()  # equal vectors are one query
    different = asked.groupBy("query").agg(F.min("vec").alias("vec"))
    queries = Staged(different.mapInArrow(_index(p, order, ("query", "vec")), "query long, vec binary, ord binary"), "queries").df()
    blocks = max(1, -(-queries.count() // query_block))
    share = min(1.0, max(measured or measured_count(n), k + 1) / n)
    met = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect()
        if not block:
            continue
        q, qo = np.frombuffer(b"".join(bytes(r.vec) for r in block), np.float64).reshape(len(block), -1), np.frombuffer(b"".join(bytes(r.ord) for r in block), np.uint16).reshape(len(block), -1)
        found = Staged(index.mapInArrow(_search(np.array([r["query"] for r in block]), q, qo, len(p), k + 1, probed, share), "query long, cid long, score double"), "met").df()
        met = found if met is None else met.unionByName(found)
    if met is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = met.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy("score", "cid"))).where(F.col("at") <= k + 1)
    near = best.join(entries.df().select("cid", "ids"), "cid").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "ids"))).alias("near"))
    all_ids = F.flatten(F.transform("near", lambda e: F.transform(e["ids"], lambda i: F.struct(e["score"].alias("score"), i.alias("vec_id")))))
    found = join_hot(asked.select("query_id", "query"), near, "query").withColumn("hits", F.slice(F.sort_array(F.array_distinct(F.filter(all_ids, lambda h: h["vec_id"] != F.col("query_id")))), 1, k))
    out = found.select("query_id", F.posexplode("hits").alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
