"""Report tables: every metric of the dictionary for every fund and year, long or pivoted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpimill.schema import OTHER_GROUP


def short_names(rows: DataFrame, funds: DataFrame, fund: str = "fund") -> DataFrame:
    """``rows`` with ``short_name``: the registry's, or the name itself."""
    r = funds.select(F.col("official_name").alias("__o"), F.col("short_name").alias("__s"))
    return rows.join(r, F.col(fund) == F.col("__o"), "left").withColumn("short_name", F.coalesce("__s", fund)).drop("__o", "__s")


def grouped_metrics(metric_defs: DataFrame) -> DataFrame:
    """(metric, metric_ord, grp, grp_ord): groups in order of their first metric, a default one where none is given."""
    m = metric_defs.select("metric", F.col("ord").alias("metric_ord"), F.coalesce("grp", F.lit(OTHER_GROUP)).alias("grp"))
    return m.join(m.groupBy("grp").agg(F.min("metric_ord").alias("grp_ord")), "grp").select("metric", "metric_ord", "grp", "grp_ord")


def dense(facts: DataFrame, metric_defs: DataFrame, funds: DataFrame) -> DataFrame:
    """(year, fund, short_name, grp_ord, grp, metric_ord, metric, value, source): a row for each metric of the dictionary.

    ``facts``: (fund, year, metric, value, source), one row for each cell.  The dictionary is fanned out over the (fund,
    year) pairs as an array column, which is as small as the dictionary; other metrics are left out.
    """
    m = grouped_metrics(metric_defs)
    as_array = m.agg(F.collect_list(F.struct("grp_ord", "grp", "metric_ord", "metric")).alias("defs"))
    pairs = facts.select("year", "fund").distinct()
    grid = pairs.join(as_array).select("year", "fund", F.inline("defs"))  # one row on the right-hand side
    out = grid.join(facts.select("year", "fund", "metric", "value", "source"), ["year", "fund", "metric"], "left")
    return short_names(out, funds).select("year", "fund", "short_name", "grp_ord", "grp", "metric_ord", "metric", "value", F.coalesce("source", F.lit("")).alias("source"))


def pivot(report: DataFrame, funds: list[str], with_sources: bool = False) -> DataFrame:
    """(year, grp, metric, a column for each fund[, and one for its source]); ``funds`` in the order of the columns."""
    aggs = [F.first("value", True).alias("value")] + ([F.first("source", True).alias("source")] if with_sources else [])
    return report.groupBy("year", "grp_ord", "grp", "metric_ord", "metric").pivot("fund", funds).agg(*aggs)


def sheet_keys(facts: DataFrame, by: str = "fund") -> DataFrame:
    """(sheet, n_rows) of a workbook with one sheet for each fund or year."""
    from kpimill.functions.text import sheet_name

    if by not in ("fund", "year"):
        raise ValueError('by must be "fund" or "year"')
    return facts.groupBy(F.col(by)).agg(F.count("*").alias("n_rows")).select(sheet_name(F.col(by)).alias("sheet"), "n_rows")
