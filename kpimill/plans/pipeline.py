"""The whole way from pages to findings."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpimill import schema as S
from kpimill.functions import chunks as C
from kpimill.functions.text import looks_like_json_object, printed_number, strip_fence, year_vote
from kpimill.operators import findings as FO
from kpimill.operators import lines as LO
from kpimill.operators import pages as PO
from kpimill.operators import votes as VO
from kpimill.operators.staging import kept
from kpimill.plugins import Extractor, Retry

CHUNK, OVERLAP = 10_000, 1_000


def strict_json(c):
    """Whether a text is one valid JSON value; Spark's own parser also takes what follows it."""

    @F.pandas_udf("boolean")
    def ok(s):  # noqa: ANN001
        def one(t):
            try:
                json.loads(t)
                return True
            except (TypeError, ValueError):
                return False

        return s.map(one)

    return ok(c)


def rule_extractor(chunk: str, year: int | None, metrics: list[str]) -> str:
    """The default extractor: ``heading | number`` lines, for the longest metric name that the heading begins with."""
    out: dict = {}
    fund = "okänd"
    page = None
    for line in chunk.split("\n"):
        if m := re.match(r"\[Sida ([^\]]+)\]", line):
            page = m[1]
            continue
        names = [m for m in metrics if line.lower().startswith(m.lower())]
        if not names:
            continue
        m = re.search(r"(\(?-?\d[\d  ]*(?:,\d+)?\)?)", line[len(max(names, key=len)) :])
        if not m:
            continue
        raw = m[1].replace(" ", "").replace(" ", "").replace(",", ".")
        value = -float(raw.strip("()-")) if raw[0] in "(-" else float(raw.strip("()"))
        if "tkr" in line.lower():
            value *= 1000
        finding = {S.VALUE: str(value), S.SOURCE: f"{S.PAGE} {page}" if page else "", S.CERTAINTY: 0.5, S.COMMENT: None}
        out.setdefault(fund, {}).setdefault(str(year or ""), {}).setdefault(max(names, key=len), finding)
    return json.dumps(out, ensure_ascii=False)


def offset_votes(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, vote): how many pages before this one have no number, by the number printed on it."""
    return pages.select("doc_id", "page_no", (F.col("page_no") - printed_number(F.coalesce("text", F.lit("")))).alias("vote"))


def documents(pages: DataFrame, terms: DataFrame | list[str], page_votes: DataFrame | None = None) -> DataFrame:
    """(doc_id, report_year, text): pages with their printed numbers, table lines repaired.

    Where ``pages`` has a column ``ocr_text``, the better of the two texts counts.  ``page_votes`` (doc_id, page_no, vote)
    are votes on the number of pages before the first numbered one, :func:`offset_votes` unless given.
    """
    if "ocr_text" in pages.columns:
        pages = pages.withColumn("text", PO.choose_text(F.col("text"), F.col("ocr_text"))).drop("ocr_text")
    votes = pages.select("doc_id", "page_no", year_vote(F.coalesce("text", F.lit(""))).alias("vote"))
    years = VO.report_year(votes)
    offsets = VO.page_offset(offset_votes(pages) if page_votes is None else page_votes)
    text = LO.join_lines(LO.repair_lines(LO.split_lines(PO.assemble(pages, offsets)), terms))
    return text.join(years, "doc_id", "left").select("doc_id", "report_year", "text")


def chunked(docs: DataFrame, size: int = CHUNK, overlap: int | float = OVERLAP) -> DataFrame:
    """(doc_id, report_year, chunk_no, chunk): windows of words that keep their line breaks, cut at safe breaks."""
    tokens = F.regexp_extract_all("text", F.lit(r"(?U)\S+\s*"), F.lit(0))
    parts = F.transform(C.windows(tokens, size, overlap), lambda w: F.array_join(w, ""))
    return docs.select("doc_id", "report_year", F.posexplode(C.safe_breaks(parts)).alias("chunk_no", "chunk"))


def extracted(chunks: DataFrame, metrics: list[str], extractor: Extractor = rule_extractor, retry: Retry | None = None) -> DataFrame:
    """(doc_id, chunk_no, answer, error): the extractor's answers; what still fails after ``retry`` becomes an error text."""
    retry = retry or Retry()
    schema = pa.schema([("doc_id", pa.string()), ("chunk_no", pa.int32()), ("answer", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows = []
            for r in rb.to_pylist():
                try:
                    rows.append((str(r["doc_id"]), r["chunk_no"], retry(lambda: extractor(r["chunk"], r["report_year"], metrics)), None))  # noqa: B023
                except Exception as e:
                    rows.append((str(r["doc_id"]), r["chunk_no"], None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return chunks.mapInArrow(run, "doc_id string, chunk_no int, answer string, error string")


def answers_to_findings(answers: DataFrame) -> DataFrame:
    """Findings of the answers that are JSON objects and hold at least one value.

    ``value`` is null for what is no number; ``value_text`` has numbers as Spark writes doubles, so that equal ones are
    equal, and all else as the answer has it.
    """
    a = answers.where("answer is not null").withColumn("json", strip_fence(F.col("answer")))
    a = a.where(looks_like_json_object(F.col("json"))).where(strict_json(F.col("json")))
    f = FO.unnest(a, keep=("doc_id", "chunk_no"))
    f = f.withColumn("value_text", F.coalesce(F.col("value").cast("string"), "value_raw")).drop("value_raw")
    some = FO.with_values(f, value="value_text").select("doc_id", "chunk_no")
    f = f.join(some, ["doc_id", "chunk_no"], "left_semi")
    return f.withColumn("seq", F.struct("doc_id", "chunk_no", "fund_pos", "year_pos", "metric_pos"))


def analyse(pages: DataFrame, metric_defs: DataFrame, extractor: Extractor = rule_extractor, size: int = CHUNK, overlap: int | float = OVERLAP, compat: bool = False, page_votes: DataFrame | None = None, retry: Retry | None = None) -> DataFrame:
    """(fund, year, metric, value, value_text, source, certainty, comment) of all documents; ``value`` is null for what is no number."""
    metrics = [r.metric for r in metric_defs.orderBy("ord").select("metric").collect()]
    # an extractor may be slow and cost money: its answers are kept, and so is what is read several times after them
    answers = kept(extracted(chunked(documents(pages, LO.terms(metric_defs), page_votes), size, overlap), metrics, extractor, retry))
    f = kept(answers_to_findings(answers))
    f = f.withColumn("value", F.col("value_text"))  # values that are no numbers merge and conflict like all others
    # chunks of a document, then names and conflicts within it, then all documents
    per_doc = FO.merge_first(f, ("doc_id", "fund", "year", "metric"))
    order = f.groupBy("doc_id", "fund", "year", "metric").agg(F.min("seq").alias("seq"))
    per_doc = FO.consolidate(kept(per_doc.join(order, ["doc_id", "fund", "year", "metric"])), compat)
    out = FO.merge_first(per_doc.withColumn("seq", F.struct("doc_id")))
    return out.withColumn("value_text", F.col("value")).withColumn("value", F.col("value").try_cast("double"))
