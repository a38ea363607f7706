"""Exact removal of repeated byte windows by a depth-limited most-significant-digit radix sort.

Two texts repeat ``depth`` bytes exactly when two suffixes agree on their first ``depth`` bytes, so suffixes are ordered
no deeper than that, and only their equal groups matter.  The sort runs in passes from coarse digits to the full depth;
a suffix whose group has one member retires from all later passes.

1. A window's leading digit is the ``GRAM``-byte string with the smallest hash in it.  Equal windows have equal digits
   at equal places, and neighbouring windows share theirs, so a text has one record for each run of windows with the
   same digit (about one for 20 bytes) instead of one for each suffix.
2. Within a digit, runs are ordered by their next digit, the whole stretch of bytes that the run covers.  Equal runs are
   repeats of the first; what differs in this digit goes on.
3. The windows of the runs left over are ordered by all their ``depth`` bytes.

Digits are compared by hashes, of 96 bits together in pass 2 and in pass 3; equal groups are not compared byte by byte.
Records travel packed, dealt by hash, after each task has kept the first of those that are equal in it, so that a passage
that a third of all texts share counts once a task.  A digit with which several runs of a task begin is dealt with the
next digit taken in, so that a phrase common to very many different texts is spread over all buckets; the digit's own
bucket only gets a mark from each such task, that its runs go on to pass 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpimill.llm.common import Staged, as_bytes, batched, free_shuffles, mix, prefix_hash, record_batch, span_hash

DEPTH, GRAM = 100, 60
_U = np.uint64
_SEGMENT = 1 << 19  #: bytes looked at together; a run that crosses a segment's end counts as two
_G, _H, _W = _U((1 << 48) - 1), _U((1 << 40) - 1), _U((1 << 56) - 1)
_FLUSH = 1 << 19  #: records that a task packs together


def _windows(data: np.ndarray, doc_of: np.ndarray, ends: np.ndarray, depth: int):
    """Runs of window starts in a segment: (first start, count, digit hash, stretch hash)."""
    gram = min(GRAM, depth)
    w = depth - gram + 1
    h = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    key = span_hash(h, at, at + gram)
    pos_bits = _U(22)
    key = (key & ~_U((1 << 22) - 1)) | at.astype(_U)
    # sliding minimum over w keys, by block prefixes and suffixes
    n = len(key)
    blocks = -(-n // w)
    k2 = np.full(blocks * w, ~_U(0), _U)
    k2[:n] = key
    k2 = k2.reshape(blocks, w)
    pre = np.minimum.accumulate(k2, axis=1).ravel()
    suf = np.minimum.accumulate(k2[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - w + 1)
    best = (np.minimum(suf[starts], pre[starts + w - 1]) & _U((1 << 22) - 1)).astype(np.int64)
    ok = starts + depth <= ends[doc_of[starts]]
    starts, best = starts[ok], best[ok]
    if not len(starts):
        return None
    new = np.flatnonzero(np.concatenate(([True], (np.diff(best) != 0) | (np.diff(starts) != 1))))
    count = np.diff(np.concatenate((new, [len(starts)])))
    lo = starts[new]
    a = best[new]
    return lo, count, span_hash(h, a, a + gram) & _G, span_hash(h, lo, lo + count - 1 + depth) & _G


def _segments(ids: np.ndarray, texts: list[bytes], depth: int):
    """(bytes, document of each byte, documents' ends, documents' ids, where each begins in its document)."""
    group, size = [], 0
    for i, t in zip(ids, texts):
        for at in range(0, max(len(t) - depth + 1, 0), _SEGMENT):
            part = t[at : at + _SEGMENT + depth - 1]
            if size + len(part) > 2 * _SEGMENT and group:
                yield group
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
    if group:
        yield group


def _joined(group):
    data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    ends = np.cumsum([len(p) for _, _, p in group])
    of = np.repeat(np.arange(len(group)), [len(p) for _, _, p in group])
    start = ends - [len(p) for _, _, p in group]
    return data, of, ends, start, np.array([i for i, _, _ in group], np.int64), np.array([a for _, a, _ in group], np.int64)


def _pack(bucket, first, second, doc, lo, count) -> Iterator[tuple[int, bytes]]:
    """Sorted by (first, second, doc, lo), one compressed payload for each bucket."""
    order = np.lexsort((lo, doc, second, first, bucket))
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    z = zstandard.ZstdCompressor(level=1)
    for o in np.split(order, cut):
        if len(o):
            f = np.diff(first[o], prepend=_U(0))
            planes = [x.astype(t).view(np.uint8).reshape(len(o), -1).T.tobytes() for x, t in ((f, _U), (second[o], _U), (doc[o], np.int64), (lo[o], np.int64), (count[o], np.int32))]
            yield int(bucket[o[0]]), len(o).to_bytes(8, "little") + z.compress(b"".join(planes))


def _unpack(table: pa.Table):
    """The records of a bucket, and the stretches already known as repeats that came with them."""
    packed = pc.is_valid(table.column("payload"))
    rest = table.filter(pc.invert(packed))
    parts = []
    for p in table.filter(packed).column("payload").to_pylist():
        n, raw, at, cols = int.from_bytes(p[:8], "little"), zstandard.ZstdDecompressor().decompress(p[8:]), 0, []
        for t in (_U, _U, np.int64, np.int64, np.int32):
            w = np.dtype(t).itemsize
            cols.append(np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T.copy().view(t).ravel())
            at += n * w
        cols[0] = np.cumsum(cols[0], dtype=_U)
        parts.append(cols)
    records = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, t) for t in (_U, _U, np.int64, np.int64, np.int32)]
    return records, [rest.column(c).to_numpy() for c in ("doc_id", "lo", "hi")]


def _with(known, *columns):
    return [np.concatenate(x) for x in zip(known, columns)]


def _first_of_equal(first, second, doc, lo):
    """Order by (first, second, doc, lo); in that order: whether a record starts a group, and whether it repeats another place."""
    o = np.lexsort((lo, doc, second, first))
    f, s, d, p = first[o], second[o], doc[o], lo[o]
    head = np.concatenate(([True], (np.diff(f) != 0) | (np.diff(s) != 0)))[: len(o)]
    at = np.flatnonzero(head)[np.cumsum(head) - 1]
    return o, head, (d != d[at]) | (p != p[at])


_OUT = pa.schema([("bucket", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
_OUT_SQL = "bucket int, payload binary, doc_id long, lo long, hi long"


def _runs(doc, lo, hi):
    """Overlapping or touching stretches of the same document as one."""
    if not len(doc):
        return doc, lo, hi
    o = np.lexsort((lo, doc))
    doc, lo, hi = doc[o], lo[o], hi[o]
    base = np.concatenate(([0], np.cumsum(np.diff(doc) != 0))).astype(np.int64)
    far = int(hi.max()) + 2
    reach = np.maximum.accumulate(hi + base * far)
    new = np.concatenate(([True], (lo[1:] + base[1:] * far) > reach[:-1]))
    at = np.flatnonzero(new)
    return doc[at], lo[at], np.concatenate((reach[at[1:] - 1], reach[-1:])) - base[at] * far


class _Combiner:
    """Collects records of a task; a flush keeps the first of equal ones and says which stretches repeat it.

    With ``spread``, what begins with a digit that several of the rest begin with is dealt by both digits, its count
    negative, and the digit's bucket gets a record without a count.
    """

    def __init__(self, buckets: int, depth: int, spread: bool = False):
        self.buckets, self.depth, self.spread, self.parts, self.n = buckets, depth, spread, [], 0

    def add(self, *cols):
        self.parts.append(cols)
        self.n += len(cols[0])
        if self.n >= _FLUSH:
            yield from self.flush()

    def flush(self):
        if not self.n:
            return
        first, second, doc, lo, count = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.n = [], 0
        o, head, repeat = _first_of_equal(first, second, doc, lo)
        r = o[repeat]
        d, a, b = _runs(doc[r], lo[r], lo[r] + count[r] - 1 + self.depth)
        for at in range(0, len(d), 1 << 16):
            s = slice(at, at + (1 << 16))
            yield record_batch(_OUT, bucket=d[s] % self.buckets, payload=[None] * len(d[s]), doc_id=d[s], lo=a[s], hi=b[s])
        o = o[head]
        first, second, doc, lo, count = first[o], second[o], doc[o], lo[o], count[o]
        bucket = first % _U(self.buckets)
        if self.spread:
            same = np.concatenate(([False], np.diff(first) == 0))
            several = same | np.concatenate((same[1:], [False]))
            bucket = np.where(several, mix(first ^ (second << _U(16))) % _U(self.buckets), bucket)
            count = np.where(several, -count, count)
            marks = np.unique(first[several])
            none = np.zeros(len(marks), np.int64)
            first, second, doc, lo, count = np.concatenate((first, marks)), np.concatenate((second, none.astype(_U))), np.concatenate((doc, none)), np.concatenate((lo, none)), np.concatenate((count, none))
            bucket = np.concatenate((bucket, marks % _U(self.buckets)))
        for bucket, payload in _pack(bucket.astype(np.int64), first, second, doc, lo, count):
            yield record_batch(_OUT, bucket=[bucket], payload=[payload], doc_id=[None], lo=[None], hi=[None])


def _pass_digits(buckets: int, depth: int):
    def run(batches):
        c = _Combiner(buckets, depth, True)
        for rb in batches:
            ids = rb.column(0).to_numpy()
            for at, texts in batched(rb.column(1)):
                for group in _segments(ids[at : at + len(texts)], texts, depth):
                    data, of, ends, start, doc, base = _joined(group)
                    if (got := _windows(data, of, ends, depth)) is not None:
                        lo, count, digit, stretch = got
                        d = of[lo]
                        yield from c.add(digit, stretch, doc[d], lo - start[d] + base[d], count.astype(np.int32))
        yield from c.flush()

    return run


_RUN = pa.schema([("doc_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("digit", pa.int64()), ("n", pa.int32())])
_RUN_SQL = "doc_id long, lo long, hi long, digit long, n int"


def _pass_stretches(depth: int):
    """Per bucket: repeats of whole runs, and the runs whose digit also begins other stretches (digit and n set)."""

    def run(table: pa.Table) -> pa.Table:
        (first, second, doc, lo, count), known = _unpack(table)
        marks = np.unique(first[count == 0])
        first, second, doc, lo, count = (x[count != 0] for x in (first, second, doc, lo, count))
        spread, count = count < 0, np.abs(count)
        o, head, repeat = _first_of_equal(first, second, doc, lo)
        r = o[repeat]
        d, a, b = _runs(*_with(known, doc[r], lo[r], lo[r] + count[r] - 1 + depth))
        keep = o[head]
        f = first[keep]
        same = np.concatenate(([False], np.diff(f) == 0))[: len(f)]
        several = same | np.concatenate((same[1:], [False]))[: len(f)] | spread[keep] | np.isin(f, marks)
        k = keep[several]
        return pa.table(
            {
                "doc_id": np.concatenate((d, doc[k])), "lo": np.concatenate((a, lo[k])), "hi": np.concatenate((b, lo[k] + count[k] - 1 + depth)),
                "digit": pa.array(np.concatenate((np.zeros(len(d), np.int64), first[k].astype(np.int64))), mask=np.concatenate((np.ones(len(d), bool), np.zeros(len(k), bool)))),
                "n": np.concatenate((np.zeros(len(d), np.int32), count[k])),
            },
            schema=_RUN,
        )

    return run


def _pass_windows(buckets: int, depth: int):
    """Texts with the runs left over: a record for each window."""

    def run(batches):
        c = _Combiner(buckets, depth)
        for rb in batches:
            ids = rb.column(0).to_pylist()
            for i, text, runs in zip(ids, as_bytes(rb.column(1)), rb.column(2).to_pylist()):
                for at in range(0, max(len(text) - depth + 1, 0), _SEGMENT):
                    h = prefix_hash(np.frombuffer(text[at : at + _SEGMENT + depth - 1], np.uint8))
                    for r in runs:
                        lo = np.arange(max(r["lo"], at), min(r["lo"] + r["n"], at + _SEGMENT, len(text) - depth + 1))
                        if len(lo):
                            full = span_hash(h, lo - at, lo - at + depth) & _W
                            yield from c.add(full, np.full(len(lo), r["digit"], _U) & _H, np.full(len(lo), i, np.int64), lo, np.ones(len(lo), np.int32))
        yield from c.flush()

    return run


def _repeats(depth: int):
    def run(table: pa.Table) -> pa.Table:
        (first, second, doc, lo, _), known = _unpack(table)
        o, _, repeat = _first_of_equal(first, second, doc, lo)
        r = o[repeat]
        d, a, b = _runs(*_with(known, doc[r], lo[r], lo[r] + depth))
        return pa.table({"doc_id": d, "lo": a, "hi": b})

    return run


_DONE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        elif lo < hi:
            out.append([lo, hi])
    return out


def _cut(with_text: bool):
    schema = _DONE if with_text else pa.schema(list(_DONE)[:-1])

    def run(batches):
        for rb in batches:
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for text, spans in zip(as_bytes(rb.column(1)), rb.column(2).to_pylist()):
                text, at, parts, n = text or b"", 0, [], 0
                for lo, hi in _merged((x["lo"], min(x["hi"], len(text))) for x in spans or ()):
                    parts.append(text[at:lo])
                    at, n = hi, n + 1
                parts.append(text[at:])
                kept = b"".join(parts)
                for k, v in (("n_bytes", len(text)), ("n_removed", len(text) - len(kept)), ("n_spans", n), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept)):
                    out[k].append(v)
            yield record_batch(schema, doc_id=rb.column(0), **out)

    return run


def remove_repeats(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, bucket_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one row for each row of ``docs``.

    Each byte covered by a ``depth``-byte string that also starts earlier (in a smaller id, or earlier in the same
    text) goes; strings are judged on the input, overlaps count, matches never cross texts.  ``n_spans`` counts the
    maximal removed stretches; ``kept`` has the remaining bytes, which need not be valid UTF-8.

    Null and empty texts have no bytes.  Rows without an id neither lose bytes nor count as earlier.  Rows that share an
    id count as one document: a repeat at the same place of the same id isn't one, and what goes from one of them goes
    from all.  Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= depth))
    size = named.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(32, -(-size // bucket_bytes))
    digits = named.mapInArrow(_pass_digits(buckets, depth), _OUT_SQL)
    runs = Staged(digits.groupBy("bucket").applyInArrow(_pass_stretches(depth), _RUN_SQL), "runs")
    del digits
    free_shuffles(spark)
    todo = runs.df().where("digit is not null").groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n", "digit")).alias("runs"))
    windows = named.join(todo, "doc_id").select("doc_id", "text", "runs").mapInArrow(_pass_windows(buckets, depth), _OUT_SQL)
    equal = Staged(windows.groupBy("bucket").applyInArrow(_repeats(depth), "doc_id long, lo long, hi long"), "equal")
    del todo, windows
    free_shuffles(spark)
    gone = runs.df().where("digit is null").select("doc_id", "lo", "hi").unionByName(equal.df())
    spans = Staged(gone.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    del gone
    for x in (runs, equal):
        x.drop()
    free_shuffles(spark)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return docs.join(spans.df(), "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_cut(with_text), schema)
