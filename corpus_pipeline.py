"""The corpus pipeline: language ID, near-duplicates, personal data, mixing, packing.

Each stage works on all rows that its predecessor wrote, and all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpimill.llm.common import shared_root
from kpimill.llm.queries import PSEUDONYM_KEY


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go.  The model learns from the stage's own labelled rows.

    Null and empty texts, and texts without a letter, are rejected; texts of any length are judged whole and repeated
    rows alike.  All columns pass unchanged, whatever their names; an empty table gives an empty one.
    """
    from kpimill.llm.language_id import fit, keep_identified

    return keep_identified(docs, fit(docs.select("doc_id", "text", "lang")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: that of the smallest id.

    A document is an id and a text: rows that share an id go only where their texts are equal or near.  Of equal documents
    one row stays.  Rows without an id come after all others.  Null and empty texts are near nothing, but repeated rows
    of one id go.  All columns pass unchanged, whatever their names; an empty table gives an empty one.
    """
    from pyspark.sql import Window

    from kpimill.llm.near_dedup import near_duplicates

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").alias("id"), "text")
    found = near_duplicates(rows.select("key", "text"), width=5, percent=80, id_col="key").select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = rows.groupBy("key").agg(F.min("id").alias("id"))
    least = found.join(ids, "key").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "key")).alias("m"))
    one = rows.select("row", "key").join(least.select(F.col("m.key").alias("key")), "key", "left_semi")
    one = one.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row.text", "row.source", "row.lang"))))
    return one.where("at = 1").select("row.*")


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms; ``n_chars`` is that of the new text (null for a null one).

    No row goes, whatever its text; all other columns pass unchanged, and an empty table gives an empty one.
    """
    from kpimill.llm.pii import pseudonymise_documents

    out = pseudonymise_documents(docs, key=PSEUDONYM_KEY, count_col=None)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Texts without words, null ones too, are taken once; rows without a source are a source of their own.  All columns
    pass unchanged, whatever their names; an empty table gives an empty one.
    """
    from kpimill.llm.mixing import mix_documents

    return mix_documents(docs, weights=(5, 2, 1), share=1.5, most=2)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences.

    Null and empty texts are a piece of one token; repeated rows are documents of their own; other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    from kpimill.llm.packing import pack_documents

    return pack_documents(docs, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pseudonyms", pseudonyms),
    ("mixing", mixing),
    ("packing", packing),
]

#: tokens, minima and learned centroids are beyond SQL; tests/llm compares the stages with plain Python instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
