"""Files in: documents, archives, dictionaries, results."""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpimill import schema as S
from kpimill.functions.text import extension
from kpimill.operators.findings import unnest
from kpimill.plugins import PageParser, split_form_feeds


class FileTypeError(ValueError):
    """A file is neither a document nor an archive of documents."""


def scan_documents(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """(path, length, content) of the files below ``folder`` whose extension is ``suffix`` in any case."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return df.select("path", "length", "content")


def gate(files: DataFrame, allowed: tuple[str, ...] = ("pdf", "zip")) -> DataFrame:
    """``files`` with ``kind``, the extension in lower case; null where it isn't allowed."""
    e = extension(F.col("path"))
    return files.withColumn("kind", F.when(e.isin(*allowed), e))


def archive_verdicts(members: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """(archive, n_members, accepted) from (archive, member): one member of another type rejects the whole archive.

    Members that end with a slash are folders and don't count.
    """
    m = members.where(~F.col("member").endswith("/"))
    return m.groupBy("archive").agg(F.count("*").alias("n_members"), F.bool_and(F.lower("member").endswith(suffix)).alias("accepted"))


def open_archives(archives: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """(archive, member, content, error) of (path, content); a rejected archive has no rows.  Check :func:`archive_verdicts`.

    An archive that can't be read is one row with the error.
    """
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for path, content in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.namelist() if not n.endswith("/")]
                        rows = [(path, n, z.read(n), None) for n in names] if all(n.lower().endswith(suffix) for n in names) else []
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError) as e:
                    rows = [(path, None, None, f"{type(e).__name__}: {e}")]
                for row in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    return archives.select("path", "content").mapInArrow(run, "archive string, member string, content binary, error string")


def list_archives(archives: DataFrame) -> DataFrame:
    """(archive, member, error); an archive that can't be read is one row with the error."""
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("error", pa.string())])

    def run(batches):
        for rb in batches:
            for path, content in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names, error = z.namelist(), None
                except (zipfile.BadZipFile, OSError) as e:
                    names, error = [None], f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in ([path] * len(names), names, [error] * len(names))], schema=schema)

    return archives.select("path", "content").mapInArrow(run, "archive string, member string, error string")


def parse_pages(files: DataFrame, parser: PageParser = split_form_feeds) -> DataFrame:
    """(doc_id, page_no, text) of (path, content), pages from 1; a file that can't be parsed gives none, see :func:`parse_errors`."""
    schema = pa.schema([("doc_id", pa.string()), ("page_no", pa.int32()), ("text", pa.string())])

    def run(batches):
        for rb in batches:
            for path, content in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                try:
                    pages = parser(content)
                except Exception:  # whatever a parser makes of a broken file
                    pages = []
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(pages), pa.string()), pa.array(range(1, len(pages) + 1), pa.int32()), pa.array(pages, pa.string())], schema=schema)

    return files.select("path", "content").mapInArrow(run, S.PAGES)


def parse_errors(files: DataFrame, parser: PageParser = split_form_feeds) -> DataFrame:
    """(path, error) of the files that the parser fails on."""
    schema = pa.schema([("path", pa.string()), ("error", pa.string())])

    def run(batches):
        for rb in batches:
            rows = []
            for path, content in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                try:
                    parser(content)
                except Exception as e:
                    rows.append((path, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, error string")


def metric_defs(spark: SparkSession, path: str) -> DataFrame:
    """The metric dictionary, in the order of its file."""
    rows = json.loads(Path(path).read_text(encoding="utf-8"))
    data = [(k, r[S.METRIC], list(r.get(S.SYNONYMS) or []), r.get("Beskrivning"), r.get("Formel"), r.get(S.GROUP), r.get("Instruktioner")) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, S.METRIC_DEFS)


def funds(spark: SparkSession, path: str) -> DataFrame:
    """The fund registry."""
    rows = json.loads(Path(path).read_text(encoding="utf-8"))
    return spark.createDataFrame([(r.get(S.SHORT_NAME), r[S.OFFICIAL_NAME], r.get(S.FUND_NO)) for r in rows], S.FUNDS)


def results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a result file."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))
    return unnest(text, keep=())


def prompt(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")
