"""Votes of pages on a number of their document: running leader, early stop, mode with first-seen ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_PAGES, AGREEMENT = 5, 0.8
MAX_OFFSET, FIRST_YEAR = 99, 2000


def parsed_vote(raw: Column) -> Column:
    """A whole number in text, or null."""
    return F.trim(raw).try_cast("int")


def valid_offset(vote: Column) -> Column:
    return F.when(F.abs(vote) <= MAX_OFFSET, vote)


def valid_year(vote: Column) -> Column:
    return F.when(vote >= FIRST_YEAR, vote)


def stop_pages(votes: DataFrame, ratio: float = AGREEMENT, pages: int = MIN_PAGES) -> DataFrame:
    """(doc_id, stop): the first page from ``pages`` on with a valid vote and a leader that has ``ratio`` of the votes."""
    v = votes.where("vote is not null")
    so_far = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("doc_id", "vote").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("c", F.count("*").over(same)).withColumn("n", F.count("*").over(so_far)).withColumn("m", F.max("c").over(so_far))
    return v.where((F.col("page_no") >= pages) & (F.col("m") / F.col("n") >= ratio)).groupBy("doc_id").agg(F.min("page_no").alias("stop"))


def mode(votes: DataFrame, none: int = -1) -> DataFrame:
    """(doc_id, vote, n_votes, ratio): the commonest vote, the first seen on a tie; ``none`` without a valid vote."""
    by_vote = votes.groupBy("doc_id", "vote").agg(F.count("vote").alias("n"), F.min("page_no").alias("first"))
    best = F.max_by("vote", F.when(F.col("vote").isNotNull(), F.struct(F.col("n"), -F.col("first"))))
    out = by_vote.groupBy("doc_id").agg(best.alias("vote"), F.sum("n").alias("n_votes"), F.max("n").alias("m"))
    return out.select("doc_id", F.coalesce("vote", F.lit(none)).alias("vote"), "n_votes", F.when(F.col("n_votes") > 0, F.col("m") / F.col("n_votes")).otherwise(0.0).alias("ratio"))


def early_stopped(votes: DataFrame, ratio: float = AGREEMENT, pages: int = MIN_PAGES, none: int = -1) -> DataFrame:
    """:func:`mode` of the pages up to the stop, with ``stop`` (null where all pages voted)."""
    stop = stop_pages(votes, ratio, pages)
    v = votes.join(stop, "doc_id", "left")
    return mode(v.where("stop is null or page_no <= stop"), none).join(stop, "doc_id", "left")


def page_offset(votes: DataFrame) -> DataFrame:
    """(doc_id, page_offset): the clamped number of unnumbered pages."""
    out = early_stopped(votes.withColumn("vote", valid_offset(F.col("vote"))))
    return out.select("doc_id", F.greatest("vote", F.lit(0)).alias("page_offset"))


def report_year(votes: DataFrame) -> DataFrame:
    """(doc_id, report_year): null where no page names one."""
    out = early_stopped(votes.withColumn("vote", valid_year(F.col("vote"))))
    return out.select("doc_id", F.when(F.col("vote") >= 0, F.col("vote")).alias("report_year"))
