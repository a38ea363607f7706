"""Inputs of the catalogue's queries, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: the total order of line items; (l_orderkey, l_linenumber) alone isn't unique
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings; ``seq`` is a struct of their places, so no row number over the whole table is needed."""
    li = table(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand", "p_size")
    b = li.join(s, "l_suppkey").join(n, "n_nationkey").join(p, "l_partkey")
    doc, chunk = F.col("n_regionkey"), F.col("l_orderkey") % 8
    return b.select(
        doc.alias("doc_id"), chunk.alias("chunk_no"), F.col("n_name").alias("fund"), F.year("l_shipdate").cast("string").alias("year"),
        F.when(F.col("p_size") <= 25, F.col("p_type")).otherwise(F.concat_ws(" ", "p_type", "p_brand")).alias("metric"),
        F.when(F.col("l_discount") >= 0.02, F.col("l_quantity")).alias("value"), F.concat(F.lit("Sida "), F.col("l_linenumber").cast("string")).alias("source"),
        F.col("l_tax").alias("certainty"), F.col("l_returnflag").alias("comment"), F.struct(doc.alias("doc_id"), chunk.alias("chunk_no"), *LINE_ORDER).alias("seq"),
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    vote = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "purchase", 2).otherwise(1)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.row_number().over(w).alias("page_no"), vote.alias("vote"))


def year_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    y = lambda c: F.year(c).cast("string")
    text = F.when(F.col("l_linenumber") == 7, "no date here").otherwise(
        F.concat(F.lit("Year "), y("l_shipdate"), F.lit(", "), y("o_orderdate"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(", "), y("o_orderdate"))).otherwise(""))
    )
    return x.select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).alias("page_no"), text.alias("text"))


def private_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, whole, each with a line of personal data added, every second address broken in two."""
    i = F.col("doc_id").cast("string")
    broken = F.when(F.col("doc_id") % 2 == 0, "\n").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\nmail user"), i, F.lit("@mail"), broken, F.lit(".example.com end 800101-1234 DOB: 1980/01/01")).alias("text"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    whole = lambda c: F.floor(c).cast("string")
    r = table(spark, sf_dir, "lineitem").join(p, "l_partkey").withColumn("rn", F.row_number().over(w))
    line = lambda k, text: F.struct((F.col("rn") * 4 + k).alias("line_no"), text.alias("line"))
    rows = F.array(
        line(0, F.when(F.col("l_linenumber") <= 3, F.col("p_type")).otherwise(F.concat(F.lit("Note "), "p_type"))), line(1, whole("l_quantity")),
        line(2, F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(whole("l_extendedprice"))), line(3, F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("text "), "l_returnflag"))),
    )
    return r.select(F.col("l_suppkey").alias("doc_id"), F.inline(rows)).where("line is not null")


def metric_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary made of part types; the last word of a type is its group, STEEL has none."""
    t = table(spark, sf_dir, "part").select(F.col("p_type").alias("metric")).distinct()
    last = F.element_at(F.split("metric", " "), -1)
    return t.select(F.dense_rank().over(Window.orderBy("metric")).alias("ord"), "metric", F.when(last != "STEEL", last).alias("grp"), F.array().cast("array<string>").alias("synonyms"))


def funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of the nations with even keys."""
    return table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("F"), F.col("n_nationkey").cast("string")).alias("short_name"), F.col("n_name").alias("official_name"), F.col("n_nationkey").alias("fund_no"))
