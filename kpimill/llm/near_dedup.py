"""MinHash near-duplicates with sequential Bayesian verification.

Texts with equal shingle sets collapse into one class first, so that thousands of copies cost one signature.  Banded
buckets give candidates; comparing runs batch by batch over the signatures and stops as soon as the posterior
probability of reaching the threshold falls under the chosen miss probability; what survives is verified on the full
shingle sets.

A bucket is never turned into all its pairs.  Its members form a tree first, in which no node has more than a few hundred
neighbours, and each is compared with its parent, which links almost every copy of a group in as many comparisons as the
group has members.  Only buckets that still hold several components are looked at again, in blocks of bounded size: what
is not of the bucket's largest component is compared with everything, and the largest component not with itself.  Pairs
found there are never rows: a cell of two blocks gets each text once, and its pairs are verified within its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpimill.llm.common import HOT, Staged, as_bytes, batched, binary_rows, hot_keys, join_hot, record_batch, shingle_set
from kpimill.llm.components import connected_components

ROWS, BANDS = 6, 40  #: a pair at 0.8 misses every band with a probability of 5e-6
SIGNATURE = 480  #: compared minima, one byte each; the first ROWS * BANDS also make the bands
BATCH = 48  #: minima compared between two looks at the posterior
GROUP = 128  #: members of a bucket that share a parent, and such groups whose parents share one, on average
BLOCK = 256  #: members of a bucket that one task compares with as many others
CELL = 4 << 20  #: shingles that each side of a cell holds while its pairs are verified; a larger text is alone
_U = np.uint64
_SEEDS = np.random.default_rng(20240229)
_XOR = _SEEDS.integers(0, 1 << 32, SIGNATURE, dtype=_U).astype(np.uint32)
_MUL = _SEEDS.integers(0, 1 << 32, SIGNATURE, dtype=_U).astype(np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of ``SIGNATURE`` hash functions over a non-empty set."""
    x = (shingles >> _U(32)).astype(np.uint32)
    best = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048]
        h = (part[None, :] ^ _XOR[:, None]) * _MUL[:, None]
        np.minimum(best, (h ^ (h >> np.uint32(15))).min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A bucket key for each band."""
    h = np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for row in sig[: ROWS * BANDS].reshape(BANDS, ROWS).T.astype(_U):
        h = (h ^ row) * _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(29)
    return h.view(np.int64)


@lru_cache
def least_matches(threshold: float, miss: float) -> tuple[tuple[int, int], ...]:
    """(minima seen, fewest matches to go on): below, P(similarity >= threshold | matches) < ``miss``.

    The prior of the similarity is uniform; one-byte minima also match by chance in one of 256 cases.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p, high = s + (1 - s) / 256, s >= threshold
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        for m in range(n + 1):
            like = m * np.log(p) + (n - m) * np.log1p(-p + 1e-12)
            like = np.exp(like - like.max())
            if like[high].sum() >= miss * like.sum():
                break
        out.append((n, m))
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Indices of the row pairs that no batch prunes."""
    left, seen, total = np.arange(len(a)), 0, np.zeros(len(a), np.int32)
    for n, least in least_matches(threshold, miss):
        total = total + (a[left, seen:n] == b[left, seen:n]).sum(axis=1, dtype=np.int32)
        keep = total >= least
        left, total, seen = left[keep], total[keep], n
        if not len(left):
            break
    return left


_DOC = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.binary()), ("sig", pa.binary())])


def _signatures(width: int):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at, texts in batched(rb.column(1)):
                n, digest, bands, sig = [], [], [], []
                for t in texts:
                    s = shingle_set(t, width)
                    n.append(len(s))
                    if len(s):
                        m = signature(s)
                        digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        bands.append(band_keys(m).tobytes())
                        sig.append((m & np.uint32(255)).astype(np.uint8).tobytes())
                    else:
                        for x in (digest, bands, sig):
                            x.append(None)
                yield record_batch(_DOC, doc_id=rb.column(0).slice(at, len(texts)), n_shingles=n, digest=digest, bands=bands, sig=sig)

    return run


_KEYS = pa.schema([("key", pa.int64()), ("node", pa.int64())])


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        keys = binary_rows(rb.column(1), 8 * BANDS).view(np.int64)
        node = rb.column(0).to_numpy()
        yield record_batch(_KEYS, key=keys.ravel(), node=np.repeat(node, BANDS))


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _prune(threshold: float, miss: float):
    def run(batches):
        for rb in batches:
            a, b = (binary_rows(rb.column(k), SIGNATURE) for k in (2, 3))
            keep = survivors(a, b, threshold, miss)
            yield record_batch(_PAIR, a=rb.column(0).to_numpy()[keep], b=rb.column(1).to_numpy()[keep])

    return run


def _verify(width: int, percent: int):
    def run(batches):
        for rb in batches:
            out = []
            last, sa = None, None
            cols = [rb.column(0).to_pylist(), rb.column(1).to_pylist(), as_bytes(rb.column(2)), as_bytes(rb.column(3))]
            for a, b, ta, tb in zip(*cols):
                if a != last:
                    last, sa = a, shingle_set(ta, width)
                sb = shingle_set(tb, width)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                if len(sa) and 100 * both >= percent * (len(sa) + len(sb) - both):
                    out.append((a, b))
            yield record_batch(_PAIR, a=[x for x, _ in out], b=[x for _, x in out])

    return run


_CELL = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("part", pa.int64()), ("node", pa.int64()), ("component", pa.int64()), ("peers", pa.binary())])


def _sides(node: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each row the number of its node's stretch, of nodes with at most ``CELL`` shingles together or of one."""
    ids, at, of = np.unique(node, return_index=True, return_inverse=True)
    out, full = np.zeros(len(ids), np.int64), 0
    for k, n in enumerate(size[at].tolist()):
        full += n
        out[k] = out[k - 1] if k else 0
        if k and full > CELL:
            out[k], full = out[k] + 1, n
    return out[of]


def _across(threshold: float, miss: float, percent: int):
    """Cells of the pairs of different components that survive: a row for each node, with those it is to be verified against.

    Rows come sorted by task (key, i, j): node, component, n_shingles, block, bands, sig.
    """

    def cells(task: pa.Table) -> Iterator[pa.RecordBatch]:
        key = task.column("key").to_numpy()
        node, comp, size, block = (task.column(c).to_numpy() for c in ("node", "component", "n_shingles", "block"))
        i, j = task.column("i").to_numpy(), task.column("j").to_numpy()
        bands = binary_rows(task.column("bands"), 8 * BANDS).view(np.int64)
        sig = binary_rows(task.column("sig"), SIGNATURE)
        edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        rows = {f.name: [] for f in _CELL}
        for s, e in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))):
            if i[s] == j[s]:
                x, y = np.triu_indices(e - s, 1)
            else:
                left, right = np.flatnonzero(block[s:e] == i[s]), np.flatnonzero(block[s:e] == j[s])
                x, y = np.repeat(left, len(right)), np.tile(right, len(left))
            x, y = x + s, y + s
            ok = (comp[x] != comp[y]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
            x, y = x[ok], y[ok]
            found = []
            for at in range(0, len(x), 8192):
                p, q = x[at : at + 8192], y[at : at + 8192]
                keep = survivors(sig[p], sig[q], threshold, miss)
                p, q = p[keep], q[keep]
                same = bands[p] == bands[q]
                first = bands[p, same.argmax(axis=1)] == key[s]  # a pair counts in the first bucket that it shares
                found.append(np.stack((p[first], q[first])))
            p, q = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            if not len(p):
                continue
            one, two = _sides(node[p], size[p]), _sides(node[q], size[q])
            part = one * (two.max() + 1) + two
            for k in np.unique(part):
                a, b = p[part == k], q[part == k]
                ids, at = np.unique(np.concatenate((node[a], node[b])), return_index=True)
                a, b = np.unique(np.stack((node[a], node[b])), axis=1)  # sorted by a
                peers = np.split(b, np.searchsorted(a, ids[1:]))
                rows["node"].append(ids)
                rows["component"].append(comp[np.concatenate((p[part == k], q[part == k]))[at]])
                rows["peers"] += [v.tobytes() for v in peers]
                for c, v in (("key", key[s]), ("i", i[s]), ("j", j[s]), ("part", k)):
                    rows[c].append(np.full(len(ids), v))
        if rows["node"]:
            yield record_batch(_CELL, **{c: v if c == "peers" else np.concatenate(v) for c, v in rows.items()})

    def run(batches):
        rest = None
        for rb in batches:
            t = pa.Table.from_batches([rb])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not len(t):
                continue
            key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
            whole = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            rest = t.slice(cut)
            if cut:
                yield from cells(t.slice(0, cut).combine_chunks())
        if rest is not None and len(rest):
            yield from cells(rest.combine_chunks())

    return run


def _verify_cells(width: int, percent: int):
    """Rows come sorted by cell (key, i, j, part): node, component, peers, text.  Links that join components not yet joined in the cell."""

    def links(nodes: dict) -> list[tuple[int, int]]:
        parent = {c: c for c, _, _ in nodes.values()}

        def find(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        def similar(one, two):
            both = len(np.intersect1d(one, two, assume_unique=True))
            return 100 * both >= percent * (len(one) + len(two) - both)

        out = []
        for a, (ca, sa, peers) in nodes.items():
            for b in np.frombuffer(peers, np.int64).tolist():
                cb, sb, _ = nodes[b]
                x, y = find(ca), find(cb)
                if x != y and any(similar(one, two) for one in sa for two in sb):
                    parent[x] = y
                    out.append((min(a, b), max(a, b)))
        return out

    def run(batches):
        now, nodes = None, {}
        for rb in batches:
            out = []
            cells = zip(*(rb.column(k).to_pylist() for k in range(4)))
            rows = zip(rb.column(4).to_pylist(), rb.column(5).to_pylist(), as_bytes(rb.column(6)), as_bytes(rb.column(7)))
            for cell, (node, component, peers, text) in zip(cells, rows):
                if cell != now:
                    out += links(nodes)
                    now, nodes = cell, {}
                s = shingle_set(text, width)
                sets = nodes.setdefault(node, (component, [], peers))[1]
                if len(s):
                    sets.append(s)
            yield record_batch(_PAIR, a=[x for x, _ in out], b=[x for _, x in out])
        out = links(nodes)
        yield record_batch(_PAIR, a=[x for x, _ in out], b=[x for _, x in out])

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Texts are lower-cased in A-Z and split into words ``[^\\x20\\x09-\\x0D]+``; a document's set holds its distinct
    ``width``-word shingles, or its whole sequence if it has fewer words.  Two documents are linked when
    ``100 * |A and B| >= percent * |A or B|``; ``component_id`` is the smallest id that a document reaches, itself
    included, and ``kept`` marks the documents that have that id.  ``miss`` is the probability at which a candidate may
    be given up before its exact check.

    Null and empty texts have an empty set, link with nothing and are kept.  A row without an id takes no part: its
    component is null and it is kept.  Rows that share an id are judged each by its own text.  Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, digest binary, bands binary, sig binary"
    table = Staged(docs.mapInArrow(_signatures(width), schema), "signatures")
    first = Window.partitionBy("digest").orderBy("doc_id")
    usable = "digest is not null and doc_id is not null"
    classes = Staged(table.df().where(usable).withColumn("at", F.row_number().over(first)).where("at = 1").select(F.col("doc_id").alias("node"), "n_shingles", "digest", "bands", "sig"), "classes")
    keys = classes.df().select("node", "bands").mapInArrow(_bucket_rows, "key long, node long")
    counts = Staged(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets").df()
    large = hot_keys(counts.where(F.col("n") > HOT), "key", "n")
    members = Staged(keys.join(counts, "key") if large is None else join_hot(keys, counts, "key", hot=large), "members")
    # one text for each node: classes that share an id are told apart by nothing but their text, so all are compared
    nodes = classes.df().select("node", "n_shingles", "digest", "sig", "bands").join(members.df().select("node").distinct(), "node", "left_semi")
    texts = Staged(docs.join(members.df().select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").distinct(), "texts")
    threshold = percent / 100

    def linked(pairs: DataFrame) -> DataFrame:
        one, two = (texts.df().select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(width, percent), "a long, b long")

    sigs = {c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"s{c}")) for c in "ab"}
    # a bucket of n members is dealt by hash to n / GROUP groups; the smallest member of a group is the parent of the others,
    # and that of group (g - 1) / GROUP the parent of that of group g
    dealt = members.df().withColumn("g", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / GROUP)))
    groups = Staged(dealt.groupBy("key", "g").agg(F.min("node").alias("a"), F.collect_list("node").alias("nodes")), "groups")
    within = groups.df().select("a", F.explode(F.array_remove("nodes", F.col("a"))).alias("b"))
    above = groups.df().where("g > 0").select("key", F.floor((F.col("g") - 1) / GROUP).alias("g"), F.col("a").alias("b")).join(groups.df().select("key", "g", "a"), ["key", "g"])
    tree = within.unionByName(above.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tree = tree.join(sigs["b"], "b").join(sigs["a"], "a").select("a", "b", "sa", "sb")
    edges = Staged(linked(tree.mapInArrow(_prune(threshold, miss), "a long, b long")), "edges")
    comp = Staged(connected_components(edges.df()), "components")

    now = Staged(members.df().join(comp.df(), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "now")
    sizes = now.df().groupBy("key", "component").agg(F.count("*").alias("k"))
    open_keys = sizes.groupBy("key").agg(F.count("*").alias("components"), F.sum("k").alias("n"), F.max("k").alias("most"), F.max_by("component", F.struct("k", "component")).alias("largest"))
    # the largest component's blocks come after those of the rest
    open_keys = open_keys.where("components > 1").select("key", "largest", "n", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("rest"), F.ceil(F.col("most") / BLOCK).cast("int").alias("more"))
    open_keys = Staged(open_keys, "open").df()
    large = hot_keys(open_keys.where(F.col("n") > HOT), "key", "n")
    task = now.df().join(open_keys, "key") if large is None else join_hot(now.df(), open_keys, "key", hot=large)
    main, h = F.col("component") == F.col("largest"), F.xxhash64("node")
    task = task.withColumn("block", F.when(main, F.col("rest") + F.pmod(h, F.col("more"))).otherwise(F.pmod(h, F.col("rest"))).cast("int"))
    task = task.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest") - 1 + F.when(main, 0).otherwise(F.col("more")))))
    task = task.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component")
    task = task.join(nodes.select("node", "n_shingles", "bands", "sig"), "node")
    task = task.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "block", "node", "component", "n_shingles", "bands", "sig")
    cell = ["key", "i", "j", "part"]
    more = Staged(task.mapInArrow(_across(threshold, miss, percent), "key long, i int, j int, part long, node long, component long, peers binary"), "cells")
    both = more.df().join(texts.df().withColumnRenamed("doc_id", "node"), "node")
    both = both.repartition(*cell).sortWithinPartitions(*cell).select(*cell, "node", "component", "peers", "text")
    late = Staged(both.mapInArrow(_verify_cells(width, percent), "a long, b long"), "edges")
    comp = Staged(connected_components(edges.df().union(late.df())), "components")

    by_class = classes.df().select("digest", "node").join(comp.df(), "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = join_hot(table.df().select("doc_id", "n_shingles", "digest"), by_class, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    for x in (members, texts, groups, now, more, edges, late):
        x.drop()
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
