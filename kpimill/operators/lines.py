"""Repair of table lines that a page break or a line break tore from their heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpimill.functions.text import strip


def terms(metric_defs: DataFrame) -> DataFrame:
    """(term): names of metrics and all their synonyms."""
    return metric_defs.select(F.col("metric").alias("term")).unionByName(metric_defs.select(F.explode("synonyms").alias("term")))


def heading_keys(lines: DataFrame, term_table: DataFrame, line: Column) -> tuple[DataFrame, Column]:
    """The beginnings of lines that start with a term, in any case, and the column of ``lines`` to find them by.

    A line is known by as many characters as the longest term has.  Each different beginning meets the terms by
    equi-joins on its prefixes, one for each length that terms have: a column of these lengths is all that is collected.
    """
    t = term_table.where("term is not null").select(F.lower("term").alias("__prefix")).distinct()
    sizes = sorted(r[0] for r in t.select(F.length("__prefix").alias("n")).distinct().collect())
    key = F.substring(F.lower(line), 1, max(sizes, default=0))
    keys = lines.select(key.alias("__key")).where("__key is not null").distinct()
    prefixes = F.transform(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: F.substring(F.col("__key"), F.lit(1), n))
    found = keys.select("__key", F.explode(F.array_distinct(prefixes)).alias("__prefix")).join(t, "__prefix", "left_semi").select("__key").distinct()
    return found, key


def headers(lines: DataFrame, term_table: DataFrame) -> DataFrame:
    """Lines that begin with a term of (term), in any case; Spark picks the side to broadcast by its size."""
    found, key = heading_keys(lines, term_table, F.col("line"))
    return lines.join(found, key == F.col("__key"), "left_semi")


def repair_lines(lines: DataFrame, term_table: DataFrame | list[str], numeric: str = r"(?U)^[\d\s]+$") -> DataFrame:
    """(doc_id, line_no, line, n_joined): a heading takes the digit-only lines that follow it, blank ones between dropped.

    Headings begin with one of the terms, which may be of digits themselves.  Lines come out stripped; ``line_no`` is
    that of the first line of each.  A run of absorbable lines is an island whose head is the line before it, so one
    window over a document numbers the islands and one grouping joins them.
    """
    if isinstance(term_table, list):
        term_table = lines.sparkSession.createDataFrame([(t,) for t in term_table], "term string")
    if term_table.isEmpty():
        raise ValueError("line repair needs the terms that begin a heading")
    x = lines.select("doc_id", "line_no", strip(F.col("line")).alias("text"))
    found, key = heading_keys(x, term_table, F.col("text"))
    x = x.withColumn("__at", key).join(found.select(F.col("__key").alias("__at"), F.lit(True).alias("term")), "__at", "left").drop("__at")
    blank, number, term = F.col("text") == "", F.col("text").rlike(numeric), F.coalesce("term", F.lit(False))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    x = x.select("doc_id", "line_no", "text", ((blank | number) & ~term).alias("soft"), blank.alias("blank"), term.alias("term"))
    x = x.withColumn("island", F.count(F.when(~F.col("soft"), 1)).over(w))
    head = F.first(F.when(~F.col("soft"), F.col("term")), True).over(Window.partitionBy("doc_id", "island"))
    x = x.withColumn("joins", F.coalesce(head, F.lit(False)))
    alone = x.where("not joins").select("doc_id", "line_no", F.col("text").alias("line"), F.lit(0).cast("long").alias("n_joined"))
    parts = F.array_sort(F.collect_list(F.when(~F.col("blank"), F.struct("line_no", "text"))))
    joined = x.where("joins").groupBy("doc_id", "island").agg(F.min("line_no").alias("line_no"), parts.alias("p"))
    line = F.array_join(F.transform("p", lambda r: r["text"]), " | ")
    return alone.unionByName(joined.select("doc_id", "line_no", line.alias("line"), (F.size("p") - 1).cast("long").alias("n_joined")))


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line)."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def join_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, text)."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))
