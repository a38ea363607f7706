"""Sensitive terms of documents, and their redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpimill.functions import text as fn
from kpimill.plugins import NameRecogniser

WINDOW = 512


def entity_windows(pages: DataFrame, size: int = WINDOW) -> DataFrame:
    """(all columns but text, start, part): consecutive stretches of ``size`` characters; none of an empty text."""
    n = F.length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    rest = [c for c in pages.columns if c != "text"]
    return pages.select(*rest, "text", F.explode(starts).alias("start")).select(*rest, "start", F.substring(F.col("text"), F.col("start") + 1, F.lit(size)).alias("part"))


def pattern_terms(text: Column, handles: bool = False) -> Column:
    """The terms that patterns find, as an array; e-mails are looked for after repairing broken ones."""
    whole = fn.repair_split_emails(text)
    found = [F.regexp_extract_all(text, F.lit(fn.PERSONAL_NUMBER), F.lit(0)), F.regexp_extract_all(whole, F.lit(fn.EMAIL), F.lit(0)), F.regexp_extract_all(whole, F.lit(fn.BIRTH_DATE), F.lit(0))]
    if handles:
        found.append(F.regexp_extract_all(whole, F.lit(fn.HANDLE), F.lit(0)))
    return F.array_distinct(F.flatten(F.array(*found)))


def clean_terms(terms: Column) -> Column:
    """Stop words and tags out, hyphens and mirrored repeats normalised, each term once."""
    return F.array_distinct(F.transform(F.filter(terms, fn.is_entity), fn.clean_entity))


def sensitive_terms(docs: DataFrame, names: NameRecogniser | None = None, extra: Sequence[str] = (), mask_handles: bool = False) -> DataFrame:
    """(doc_id, term), each once: what patterns, a name recogniser and a fixed list find in (doc_id, text).

    Handles are always taken out by the cleaning, as the tags that they look like; ``mask_handles`` adds them after it.
    """
    arrays = docs.select("doc_id", "text", clean_terms(F.array_union(pattern_terms(F.col("text")), F.array(*map(F.lit, extra)).cast("array<string>"))).alias("t"))
    if mask_handles:
        arrays = arrays.withColumn("t", F.array_union("t", F.regexp_extract_all("text", F.lit(fn.HANDLE), F.lit(0))))
    out = arrays.select("doc_id", F.explode("t").alias("term"))
    if names is not None:
        found = entity_windows(docs.select("doc_id", "text")).select("doc_id", F.explode(names.column(F.col("part"))).alias("term"))
        found = found.where(fn.is_entity(F.col("term"))).select("doc_id", fn.clean_entity(F.col("term")).alias("term"))
        out = out.unionByName(found)
    return out.distinct()


def redact_documents(docs: DataFrame, terms: DataFrame, mask: str = "█") -> DataFrame:
    """``docs`` with every hit of each of its terms masked, and ``n_terms``."""
    by_doc = terms.groupBy("doc_id").agg(F.collect_set("term").alias("__terms"))
    d = docs.join(by_doc, "doc_id", "left").withColumn("__terms", F.coalesce("__terms", F.array().cast("array<string>")))
    return d.withColumn("text", fn.redact(F.col("text"), F.col("__terms"), mask)).withColumn("n_terms", F.size("__terms").cast("long")).drop("__terms")


def redact_by_patterns(docs: DataFrame, mask: str = "█") -> DataFrame:
    """Redaction by patterns alone: terms never leave their row, so nothing is shuffled."""
    d = docs.withColumn("__terms", clean_terms(pattern_terms(F.col("text"))))
    return d.withColumn("text", fn.redact(F.col("text"), F.col("__terms"), mask)).withColumn("n_terms", F.size("__terms").cast("long")).drop("__terms")


def redaction_boxes(hits: DataFrame, height: float = 10.0) -> DataFrame:
    """(doc_id, page_no, x0, y0, x1, y1) of fixed height around the middle of each hit's box."""
    middle = (F.col("y0") + F.col("y1")) / 2
    return hits.select("doc_id", "page_no", "x0", (middle - height / 2).alias("y0"), "x1", (middle + height / 2).alias("y1"))
