"""One query for each operator of this subpackage, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: only for these queries: a deployment passes a secret of its own
PSEUDONYM_KEY = "kpimill-demonstration-key"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kpimill.llm.pii import pseudonymise_documents

    out = pseudonymise_documents(_table(spark, sf_dir, "documents"), key=PSEUDONYM_KEY)
    return out.select("doc_id", "text", "lang", "source", "n_pseudonyms")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kpimill.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kpimill.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), depth=100)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kpimill.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), capacity=1024)


def op5_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kpimill.llm.mixing import mix_sources

    mixed = mix_sources(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op4_weak_supervision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kpimill.llm.quality_rules import quality_verdicts

    out = quality_verdicts(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", "kept")


def op9_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from kpimill.llm.language_id import fold, identify_languages

    docs = _table(spark, sf_dir, "documents")
    out = identify_languages(docs, docs.where(fold("doc_id", 5) != 0))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", F.round("score", 9).alias("score"), "rejected")


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from kpimill.llm.compression_classifier import score_quality
    from kpimill.llm.language_id import fold

    docs = _table(spark, sf_dir, "documents")
    out = score_quality(docs, _table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int")
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", predicted.alias("predicted"))


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kpimill.llm.permutation_index import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from kpimill.llm.common import shared_root
    from kpimill.llm.token_counts import document_token_counts

    return document_token_counts(_table(spark, sf_dir, "documents"), f"{shared_root(spark)}/tokens-{uuid.uuid4().hex[:12]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: links by a join on shingles and their closure
NEAR_DEDUP_SQL = r"""
WITH RECURSIVE w AS (
 SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id WHERE reach.r < l.b),
least_r AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least_r c ON c.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """Keyed pseudonyms, fitted models, token ids and approximate searches are beyond SQL; tests/llm has brute force for them."""
    return {"op2_minhash_near_dedup": NEAR_DEDUP_SQL}
