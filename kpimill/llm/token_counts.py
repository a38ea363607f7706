"""Token counts of flat token files by a scan for separators.

A flat token file is nothing but token ids of fixed width, with the end-of-document id after each document: no index, no
lengths.  Files are read in blocks; each block finds its separators with one vectorised comparison, and documents that
cross blocks are stitched by a prefix scan over one row for each block: how many separators came before, and where the
last one stood.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpimill.llm.common import Staged, record_batch
from kpimill.llm.tokens import default_path, encoder

END = 50256
BLOCK = 4 << 20  #: bytes


def _names(folder: str):
    system, path = fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes one flat token file for each partition of ``docs`` into the shared ``folder``; (file, doc_no, doc_id).

    Null and empty texts are documents without tokens.  Special tokens spelt in a text are ordinary text, so ``end`` only
    occurs as a separator.  A file appears under its name when it is whole, so a task that runs again replaces it by the
    same file.
    """
    path = tokenizer or default_path()
    schema = pa.schema([("file", pa.string()), ("doc_no", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _names(folder)
        encode = encoder(path, True)
        name = f"part-{TaskContext.get().partitionId():06d}.bin"
        part, no = f"{top}/.{name}-{uuid.uuid4().hex}", 0
        with system.open_output_stream(part) as out:
            for rb in batches:
                for at in range(0, len(rb), 512):
                    ids: list[int] = []
                    for t in rb.column(1).slice(at, 512).to_pylist():
                        ids += encode(t or "")
                        ids.append(end)
                    out.write(np.array(ids, dtype).tobytes())
                yield record_batch(schema, file=[name] * len(rb), doc_no=range(no, no + len(rb)), doc_id=rb.column(0))
                no += len(rb)
        system.move(part, f"{top}/{name}")

    system, top = _names(folder)
    system.create_dir(top, recursive=True)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return Staged(docs.mapInArrow(run, "file string, doc_no long, doc_id long"), "documents").df()


def scan_token_files(spark: SparkSession, folder: str, end: int = END, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(file, doc_no, first_token, n_tokens): the documents of each ``.bin`` file of ``folder``, separators not counted.

    What follows a file's last separator is a document too, unless it is nothing; an empty file has none.  A file whose
    length is no multiple of the width raises an error.
    """
    system, top = _names(folder)
    width = np.dtype(dtype).itemsize
    found = [(x.base_name, x.size) for x in system.get_file_info(fs.FileSelector(top)) if x.is_file and x.base_name.endswith(".bin") and not x.base_name.startswith(".")]
    if bad := [n for n, s in found if s % width]:
        raise ValueError(f"not a whole number of {width}-byte ids: {bad[:3]}")
    step = block - block % width or width
    files = spark.createDataFrame(found, "file string, size long").where("size > 0")
    blocks = files.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))))
    n = max(1, sum(-(-s // step) for _, s in found))
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("n_ends", pa.int64()), ("last", pa.int64()), ("ends", pa.binary()), ("final", pa.bool_())])

    def look(batches):
        system, top = _names(folder)
        for rb in batches:
            for r in rb.to_pylist():
                with system.open_input_file(f"{top}/{r['file']}") as f:
                    f.seek(r["at"])
                    ids = np.frombuffer(f.read(min(step, r["size"] - r["at"])), dtype)
                ends = np.flatnonzero(ids == end).astype(np.int64) + r["at"] // width
                yield record_batch(
                    schema, file=[r["file"]], at=[r["at"] // width], n=[len(ids)], n_ends=[len(ends)], last=[int(ends[-1]) if len(ends) else None],
                    ends=[ends.tobytes()], final=[r["at"] + step >= r["size"]],
                )

    seen = Staged(blocks.repartition(min(n, 4096)).mapInArrow(look, "file string, at long, n long, n_ends long, last long, ends binary, final boolean"), "blocks").df()
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # only counts go through the window by file; the separators of a block wait where they are
    scanned = seen.select("file", "at", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("no"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("after"))
    joined = seen.select("file", "at", "n", "ends", "final").join(scanned, ["file", "at"])
    out_schema = pa.schema([("file", pa.string()), ("doc_no", pa.int64()), ("first_token", pa.int64()), ("n_tokens", pa.int64())])

    def stitch(batches):
        for rb in batches:
            for r in rb.to_pylist():
                ends = np.frombuffer(r["ends"], np.int64)
                if r["final"]:  # what is left over ends with the file
                    tail = int(ends[-1]) if len(ends) else r["after"]
                    ends = np.append(ends, r["at"] + r["n"]) if tail < r["at"] + r["n"] - 1 else ends
                first = np.concatenate(([r["after"]], ends))[: len(ends)] + 1
                yield record_batch(out_schema, file=[r["file"]] * len(ends), doc_no=np.arange(r["no"], r["no"] + len(ends)), first_token=first, n_tokens=ends - first)

    return joined.select("file", "at", "n", "no", "after", "ends", "final").mapInArrow(stitch, "file string, doc_no long, first_token long, n_tokens long")


def document_token_counts(docs: DataFrame, folder: str, **options) -> DataFrame:
    """(doc_id, file, doc_no, first_token, n_tokens) of the rows of ``docs``, counted in the token files written of them.

    Rows that repeat, share an id or have none are documents of their own; other columns are ignored, and an empty table
    gives an empty result.
    """
    wrote = write_token_files(docs, folder, **options)
    return scan_token_files(docs.sparkSession, folder).join(wrote, ["file", "doc_no"]).select("doc_id", "file", "doc_no", "first_token", "n_tokens")
