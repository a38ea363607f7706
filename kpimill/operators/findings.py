"""Findings: unnesting, ordered merges, unification of names, conflicts and their consolidation.

A finding is a row (doc_id, chunk_no, fund, year, metric, value, source, certainty, comment) with an ordering column
``seq`` (any orderable type; a struct of the positions will do).  Every merge is a grouping with ordered aggregates, so
partial aggregation applies and no global order is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpimill.functions.text import plain_number, source_parts, source_text
from kpimill.operators.staging import kept
from kpimill.schema import CERTAINTY, COMMENT, FIELDS, SOURCE, TREE, VALUE


def unnest(trees: DataFrame, json: str = "json", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of (fund, year, metric) from tree texts, with the places that order them.

    ``value_raw`` is the value as written, ``value`` the number that it is, if it is one (``12 244,5 kr`` too).
    """
    t = trees.select(*keep, F.from_json(json, TREE).alias("tree"))
    t = t.select(*keep, F.posexplode("tree").alias("fund_pos", "fund", "years"))
    t = t.select(*keep, "fund_pos", "fund", F.posexplode("years").alias("year_pos", "year", "metrics"))
    t = t.select(*keep, "fund_pos", "fund", "year_pos", "year", F.posexplode("metrics").alias("metric_pos", "metric", "f"))
    f = F.col("f")
    return t.select(*keep, "fund_pos", "year_pos", "metric_pos", "fund", "year", "metric", f[VALUE].alias("value_raw"), F.coalesce(f[VALUE].try_cast("double"), plain_number(f[VALUE])).alias("value"), f[SOURCE].alias("source"), f[CERTAINTY].alias("certainty"), f[COMMENT].alias("comment"))


def nest(findings: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One tree text for each combination of ``keys``; each (fund, year, metric) must occur once in it."""
    f = F.struct(F.col("value").cast("string").alias(VALUE), F.col("source").alias(SOURCE), F.col("certainty").alias(CERTAINTY), F.col("comment").alias(COMMENT))
    entries = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    m = findings.groupBy(*keys, "fund", "year").agg(entries("metric", f.alias("f")).alias("m"))
    m = m.groupBy(*keys, "fund").agg(entries("year", "m").alias("m"))
    m = m.groupBy(*keys).agg(entries("fund", "m").alias("m")) if keys else m.agg(entries("fund", "m").alias("m"))
    return m.select(*keys, F.to_json("m", {"ignoreNullFields": "false"}).alias("json"))


def with_values(findings: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_no"), value: str = "value") -> DataFrame:
    """(keys, n_values) of the chunks that hold at least one value."""
    return findings.groupBy(*keys).agg(F.count(value).alias("n_values")).where("n_values > 0")


def merge_first(findings: DataFrame, keys: tuple[str, ...] = ("fund", "year", "metric"), by_row: bool = False) -> DataFrame:
    """The first value that isn't null wins, for each field on its own, or (``by_row``) from the first row with a value."""
    seq = F.col("seq")
    if by_row:
        best = F.min_by(F.struct(*FIELDS), F.struct(F.col("value").isNull(), seq)).alias("b")
        return findings.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in FIELDS])
    return findings.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), seq)).alias(c) for c in FIELDS])


def merge_last(findings: DataFrame, keys: tuple[str, ...] = ("fund", "year", "metric")) -> DataFrame:
    """The last row wins, nulls included."""
    best = F.max_by(F.struct(*FIELDS), F.col("seq")).alias("b")
    return findings.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in FIELDS])


def merge_shallow(findings: DataFrame, keys: tuple[str, ...] = ("doc_id", "fund", "year"), part: str = "chunk_no") -> DataFrame:
    """For each of ``keys`` the rows of the last part that has it replace those of earlier parts."""
    last = findings.groupBy(*keys).agg(F.max(part).alias("__last"))
    return findings.join(last, list(keys)).where(F.col(part) == F.col("__last")).drop("__last")


def unify_funds(findings: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(by, unified, n_funds): the longest name of a document, the first one of these on a tie."""
    first = findings.groupBy(*by, "fund").agg(F.min("seq").alias("seq"))
    # the longest, then the first: the smallest of (-length, seq)
    return first.groupBy(*by).agg(F.min_by("fund", F.struct(-F.length("fund"), F.col("seq"))).alias("unified"), F.count("*").alias("n_funds"))


def _finding() -> Column:
    return F.struct(*FIELDS)


def cells(findings: DataFrame, keys: tuple[str, ...] = ("doc_id", "year", "metric")) -> DataFrame:
    """Findings with a value, with their place in the cell's list.

    A cell holds its first finding alone until one differs from it; from there on every finding joins the list, also one
    that the list has already.  ``listed`` marks the members of lists, ``conflict`` those that came after the first.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    f = findings.where("value is not null").withColumn("__f", _finding())
    f = f.withColumn("__first", F.first("__f").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    f = f.withColumn("conflict", F.max(~F.col("__f").eqNullSafe(F.col("__first"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.row_number().over(w) == 1
    has = F.max("conflict").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return f.withColumn("listed", has & (F.col("conflict") | first)).withColumn("in_conflict", has).withColumn("is_first", first).drop("__f", "__first")


def conflict_log(findings: DataFrame, keys: tuple[str, ...] = ("doc_id", "year", "metric")) -> DataFrame:
    """(keys, n_listed, n_conflicts, first_value) of the cells with differing findings."""
    c = cells(findings, keys).where("in_conflict")
    return c.groupBy(*keys).agg(
        F.count(F.when(F.col("listed"), 1)).alias("n_listed"), F.count(F.when(F.col("conflict"), 1)).alias("n_conflicts"), F.max(F.when(F.col("is_first"), F.col("value"))).alias("first_value")
    )


def consolidate_conflicts(findings: DataFrame, keys: tuple[str, ...] = ("doc_id", "year", "metric")) -> DataFrame:
    """(keys, value, source, certainty, comment, n_consolidated) of the cells with differing findings.

    The value that appears last for the first time wins, with the sources of all findings of that value; certainty and
    comment are those of the last finding, whatever its value.  ``n_consolidated`` counts the sources beyond the first
    of each value.
    """
    return _consolidated(cells(findings, keys).where("listed"), keys)


def _consolidated(listed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    by_value = listed.groupBy(*keys, "value").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by(F.struct("certainty", "comment"), "seq").alias("last"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(source_parts(F.col("source")))))).alias("parts"),
    )
    extra = F.greatest(F.size("parts") - 1, F.lit(0))
    out = by_value.groupBy(*keys).agg(F.max_by(F.struct("value", "parts"), "first_seq").alias("w"), F.max_by("last", "last_seq").alias("last"), F.sum(extra).alias("n_consolidated"))
    return out.select(*keys, F.col("w.value").alias("value"), source_text(F.col("w.parts")).alias("source"), F.col("last.certainty").alias("certainty"), F.col("last.comment").alias("comment"), "n_consolidated")


def pool_prefix_sources(cells_: DataFrame, keys: tuple[str, ...] = ("doc_id", "fund", "year"), compat: bool = False) -> DataFrame:
    """Each metric takes over the sources of metrics whose names begin with its name and whose values are equal.

    One row for each (keys, metric).  Null values pass unchanged.  Equal values meet in an equi-join, so the prefix is
    only tested within (keys, value).  ``compat`` also drops certainty and comment of zero values and keeps empty
    sources.
    """
    a = cells_.select(*keys, "metric", "value", "source", "certainty", "comment")
    b = cells_.where("value is not null").select(*keys, "value", F.col("metric").alias("__other"), source_parts(F.col("source"), drop_empty=not compat).alias("__parts"))
    hit = F.col("__other").startswith(F.col("metric"))
    pooled = a.where("value is not null").join(b, [*keys, "value"]).where(hit).groupBy(*keys, "metric").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__parts")))).alias("__all"))
    out = a.join(pooled, [*keys, "metric"], "left")
    zero = F.lit(compat) & (F.col("value").cast("string").try_cast("double") == 0)
    return out.select(
        *keys, "metric", "value", F.when(F.col("__all").isNotNull(), source_text(F.col("__all"))).otherwise(F.col("source")).alias("source"),
        F.when(~F.coalesce(zero, F.lit(False)), F.col("certainty")).alias("certainty"), F.when(~F.coalesce(zero, F.lit(False)), F.col("comment")).alias("comment"),
        F.when(F.col("__all").isNotNull(), F.size("__all") - 1).otherwise(0).cast("long").alias("n_consolidated"),
    )


def consolidate(findings: DataFrame, compat: bool = False) -> DataFrame:
    """Fund names unified per document, conflicts consolidated, sources pooled in documents that had a conflict.

    (doc_id, fund, year, metric, value, source, certainty, comment).  The findings are read for the names and for the
    cells, which are kept: one window over them tells single findings from lists.
    """
    keys = ("doc_id", "fund", "year", "metric")
    names = unify_funds(findings).select("doc_id", F.col("unified").alias("__unified"))
    f = findings.join(names, "doc_id").withColumn("fund", F.col("__unified")).drop("__unified")
    c = kept(cells(f, keys).select(*keys, *FIELDS, "seq", "listed", "in_conflict", "is_first"))
    single = c.where("is_first and not in_conflict").select(*keys, *FIELDS)
    lists = _consolidated(c.where("listed"), keys).select(*keys, *FIELDS)
    with_conflict = c.where("in_conflict").select("doc_id").distinct().withColumn("__had", F.lit(True))
    marked = single.join(with_conflict, "doc_id", "left")
    pooled = pool_prefix_sources(marked.where("__had").drop("__had"), compat=compat).select(*keys, *FIELDS)
    return marked.where("__had is null").select(*keys, *FIELDS).unionByName(pooled).unionByName(lists)
