"""Pages into documents: labels, assembly, and the choice between native and recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpimill.functions.text import page_label, strip
from kpimill.schema import PAGE

OCR_FACTOR = 1.5


def assemble(pages: DataFrame, offsets: DataFrame) -> DataFrame:
    """(doc_id, text): pages in order, each below a line with its printed number."""
    p = pages.join(offsets, "doc_id", "left").withColumn("label", page_label(F.col("page_no"), F.coalesce("page_offset", F.lit(0))))
    part = F.concat(F.lit(f"[{PAGE} "), "label", F.lit("]\n"), F.coalesce("text", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("page_no", part.alias("part"))))
    return p.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["part"]), "\n\n").alias("text"))


def choose_text(native: Column, recognised: Column, factor: float = OCR_FACTOR) -> Column:
    """Recognised text only where it is more than ``factor`` times as long, both without outer white space."""
    return F.when(F.length(strip(F.coalesce(recognised, F.lit("")))) > factor * F.length(strip(F.coalesce(native, F.lit("")))), recognised).otherwise(native)


def has_text(pages: DataFrame) -> DataFrame:
    """(doc_id, has_text): whether any page holds more than white space."""
    return pages.groupBy("doc_id").agg(F.max(F.length(strip(F.coalesce("text", F.lit("")))) > 0).alias("has_text"))
