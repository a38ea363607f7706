"""Best-fit packing of documents into token sequences, by hierarchical residual packing.

Each task packs its own pieces best-fit decreasing.  Bins that are nearly full are final; the underfull ones move up a
level as items, where a smaller number of tasks packs them together again, and so on until few enough are left for one
task, or a level no longer joins them.  An item carries its members, of which a sequence holds at most ``capacity``,
so no later join has to find them, and every task handles a bounded number of items.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpimill.llm.common import Staged, record_batch
from kpimill.llm.tokens import default_path, encoder

END = 2
ITEMS = 20_000  #: underfull bins that one task packs together
SLACK = 4  #: free tokens of a bin that counts as nearly full
FAN_IN = 8  #: tasks of a level that meet in one task of the next
_MEMBER = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
_BINS = pa.schema([("full", pa.bool_()), ("used", pa.int32()), ("members", pa.binary())])
_BINS_SQL = "full boolean, used int, members binary"


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices of the items of each bin: longest first, each into the fullest bin that still takes it."""
    rooms: dict[int, list[int]] = defaultdict(list)  # free space -> bins
    free = 0  # bit r: some bin has r tokens free
    bins: list[list[int]] = []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                free &= ~(1 << room)
            bins[b].append(k)
        else:
            room, b = capacity, len(bins)
            bins.append([k])
        if room > n:
            rooms[room - n].append(b)
            free |= 1 << (room - n)
    return bins


def _bins(lengths: np.ndarray, members: list[bytes], capacity: int, slack: int, last: bool):
    for at in range(0, len(lengths), ITEMS):
        part = lengths[at : at + ITEMS]
        packed = best_fit(part, capacity)
        for lo in range(0, len(packed), 4096):
            block = packed[lo : lo + 4096]
            used = [int(part[b].sum()) for b in block]
            yield record_batch(_BINS, full=[last or u + slack >= capacity for u in used], used=used, members=[b"".join(members[at + k] for k in b) for b in block])


def pieces_of(ids: list[int], capacity: int, doc_id) -> np.ndarray:
    """One record for each piece: only texts longer than ``capacity`` are cut, and the first piece takes the remainder."""
    n = len(ids)
    first = n if n <= capacity else n % capacity or capacity
    starts = [0, *range(first, n, capacity)]
    raw = np.asarray(ids, "<u4").tobytes()
    out = np.zeros(len(starts), _MEMBER)
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
        out[k] = (doc_id or 0, doc_id is None, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]))
    return out


def _tokenise(path: str, capacity: int, slack: int, end: int):
    def run(batches):
        encode = encoder(path)
        lengths, members = [], []
        for rb in batches:
            for i, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                rows = pieces_of([*encode(text or ""), end], capacity, i)
                lengths.extend(rows["length"].tolist())
                members.extend(rows[k : k + 1].tobytes() for k in range(len(rows)))
            if len(lengths) >= ITEMS:
                yield from _bins(np.array(lengths, np.int32), members, capacity, slack, False)
                lengths, members = [], []
        if lengths:
            yield from _bins(np.array(lengths, np.int32), members, capacity, slack, False)

    return run


def _merge(capacity: int, slack: int, last: bool):
    def run(batches):
        lengths, members = [], []
        for rb in batches:
            lengths.append(rb.column("used").to_numpy())
            members.extend(rb.column("members").to_pylist())
        if members:
            yield from _bins(np.concatenate(lengths), members, capacity, slack, last)

    return run


_PLACED = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset")] + [("piece", pa.int32())])


def _places(batches):
    ctx = TaskContext.get()
    serial = ctx.partitionId() << 40
    for rb in batches:
        raw = rb.column(0).to_pylist()
        for at in range(0, len(raw), 4096):
            rows = [np.frombuffer(x, _MEMBER) for x in raw[at : at + 4096]]
            m = np.concatenate(rows)
            sequence = serial + np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            serial += len(rows)
            ends = np.cumsum(m["length"], dtype=np.int64)
            new = np.concatenate(([0], np.flatnonzero(np.diff(sequence)) + 1))
            base = np.repeat((ends - m["length"])[new], np.diff(np.concatenate((new, [len(m)]))))
            yield record_batch(
                _PLACED, doc_id=pa.array(m["doc_id"], mask=m["null"].astype(bool)), piece=m["piece"], start=m["start"], length=m["length"].astype(np.int64),
                ids_crc32=m["crc"].astype(np.int64), sequence_id=sequence, offset=ends - m["length"] - base,
            )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end: int = END, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece of each row of ``docs``.

    A document is the ids of its text and then ``end``.  Documents longer than ``capacity`` are cut into pieces of
    ``capacity`` tokens, the remainder first; no other is cut.  Pieces are placed whole and gapless into sequences of at
    most ``capacity`` tokens; a bin with at most ``slack`` free tokens is final at once.

    Null and empty texts are the id ``end`` alone.  Rows that repeat, share an id or have none are documents of their
    own.  Other columns are ignored, whatever their names; an empty table gives an empty result.  ``piece``, ``start``
    and ``ids_crc32`` depend on the text alone; which sequence a piece gets also depends on how the rows lie in
    partitions.
    """
    if not 0 < capacity or slack < 0:
        raise ValueError("capacity must be positive and slack not negative")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    level = Staged(docs.mapInArrow(_tokenise(tokenizer or default_path(), capacity, slack, end), _BINS_SQL), "bins")
    done = [level.df().where("full")]
    items, tasks = level.df().where("not full").count(), None
    while items:
        tasks = -(-items // ITEMS) if tasks is None else max(1, -(-items // ITEMS), tasks // FAN_IN)
        last = tasks == 1
        under = level.df().where("not full").repartition(tasks)
        level = Staged(under.mapInArrow(_merge(capacity, slack, last), _BINS_SQL), "bins")
        left = level.df().where("not full").count()
        if not last and left > 0.98 * items:  # what is left doesn't go together: more rounds would not help
            done.append(level.df())
            break
        done.append(level.df().where("full"))
        items = left
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    names = "doc_id long, start long, length long, ids_crc32 long, sequence_id long, offset long, piece int"
    return out.select("members").mapInArrow(_places, names).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
