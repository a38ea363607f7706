"""The engine's queries by name, each (spark, sf_dir) -> DataFrame; their SQL is in :mod:`kpimill.plans.oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpimill.functions import chunks as C
from kpimill.functions import text as T
from kpimill.operators import findings as FO
from kpimill.operators import lines as LO
from kpimill.operators import masking as MO
from kpimill.operators import pages as PO
from kpimill.operators import report as RO
from kpimill.operators import votes as VO
from kpimill.plans import inputs as I
from kpimill.plugins import ListedNames, Tokenizer
from kpimill.sources.files import archive_verdicts, gate
from kpimill.sources.sinks import csv_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return FO.merge_first(I.findings(spark, d))


@query
def merge_first_nonnull(spark, d):
    return _merged(spark, d)


@query
def merge_first_by_row(spark, d):
    return FO.merge_first(I.findings(spark, d), by_row=True)


@query
def merge_last_wins(spark, d):
    return FO.merge_last(I.findings(spark, d))


@query
def merge_shallow(spark, d):
    return FO.merge_shallow(I.findings(spark, d)).groupBy("doc_id", "fund", "year").agg(F.max("chunk_no").alias("chunk_no"), F.count("*").alias("n"), F.count("value").alias("n_values"))


@query
def findings_unnest(spark, d):
    """Trees of whole chunks, with many funds, years and metrics each."""
    cells = FO.merge_first(I.findings(spark, d), ("doc_id", "chunk_no", "fund", "year", "metric"), by_row=True)
    return FO.unnest(FO.nest(cells, ("doc_id", "chunk_no")), keep=("doc_id", "chunk_no")).select("doc_id", "chunk_no", "fund", "year", "metric", "value", "source", "certainty", "comment")


@query
def chunk_nonnull_filter(spark, d):
    return FO.with_values(I.findings(spark, d), ("doc_id", "chunk_no", "fund", "year", "metric"))


@query
def fund_unify(spark, d):
    return FO.unify_funds(I.findings(spark, d))


@query
def conflict_log(spark, d):
    return FO.conflict_log(I.findings(spark, d))


@query
def conflict_consolidate(spark, d):
    return FO.consolidate_conflicts(I.findings(spark, d))


@query
def prefix_source_pool(spark, d):
    cells = FO.merge_first(I.findings(spark, d), ("doc_id", "fund", "year", "metric"), by_row=True)
    return FO.pool_prefix_sources(cells).select("doc_id", "fund", "year", "metric", "value", "source", "n_consolidated")


@query
def report_dense(spark, d):
    return RO.dense(_merged(spark, d), I.metric_defs(spark, d), I.funds(spark, d))


@query
def report_pivot(spark, d):
    """The pivot with a column for every fund of the findings, in order of their names."""
    merged = _merged(spark, d)
    names = sorted(r.fund for r in merged.select("fund").distinct().collect())
    long = RO.dense(merged, I.metric_defs(spark, d), I.funds(spark, d))
    return RO.pivot(long, names).select("year", "grp", "metric", *[F.col(f"`{n}`").alias(f"v_{n.lower().replace(' ', '_')}") for n in names])


@query
def metric_groups(spark, d):
    return RO.grouped_metrics(I.metric_defs(spark, d))


@query
def fund_short_names(spark, d):
    return RO.short_names(I.table(spark, d, "nation").select(F.col("n_name").alias("fund")), I.funds(spark, d))


@query
def report_sheets(spark, d):
    return RO.sheet_keys(_merged(spark, d), "fund")


@query
def csv_report_rows(spark, d):
    return csv_rows(_merged(spark, d), with_sources=True)


@query
def vote_mode(spark, d):
    return VO.mode(I.votes(spark, d)).select("doc_id", "vote", "n_votes", F.round("ratio", 9).alias("ratio"))


@query
def vote_early_stop(spark, d):
    return VO.early_stopped(I.votes(spark, d)).select("doc_id", "vote", "n_votes", F.round("ratio", 9).alias("ratio"), "stop")


@query
def page_offset(spark, d):
    v = I.votes(spark, d).withColumn("vote", F.when(F.col("page_no") % 7 == 0, 150).otherwise(F.col("vote") - 2))
    return VO.page_offset(v)


@query
def year_vote(spark, d):
    return I.year_pages(spark, d).select("doc_id", "page_no", T.year_vote(F.col("text")).alias("vote"))


@query
def report_year(spark, d):
    return VO.report_year(I.year_pages(spark, d).select("doc_id", "page_no", T.year_vote(F.col("text")).alias("vote")))


@query
def vote_parse(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), (F.col("event_id") % 130).cast("string"), F.lit(" "))).otherwise(F.col("event_type"))
    return I.table(spark, d, "events").select("event_id", VO.valid_offset(VO.parsed_vote(raw)).alias("page_vote"), VO.valid_year(VO.parsed_vote(F.concat(F.lit("1"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))) + 500).alias("year_vote"))


@query
def pii_emails(spark, d):
    return I.table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(T.EMAIL), F.lit(0)))).alias("email"))


@query
def pii_terms(spark, d):
    return MO.sensitive_terms(I.private_texts(spark, d))


@query
def pii_handles(spark, d):
    return MO.sensitive_terms(I.private_texts(spark, d), mask_handles=True).where("term like '@%'")


@query
def pii_redact(spark, d):
    return MO.redact_by_patterns(I.private_texts(spark, d), mask="#").select("doc_id", "text", "n_terms")


@query
def redact_by_terms(spark, d):
    docs = I.table(spark, d, "documents").select("doc_id", "text")
    terms = MO.sensitive_terms(docs)
    return MO.redact_documents(docs, terms, mask="#").select("doc_id", F.length("text").cast("long").alias("n_chars"), "n_terms")


@query
def email_repair(spark, d):
    return I.private_texts(spark, d).select("doc_id", T.repair_split_emails(F.col("text")).alias("text"))


@query
def mirror_dedup(spark, d):
    p = F.col("p_name")
    return I.table(spark, d, "part").select("p_partkey", T.mirror_collapse(F.concat(p, F.lit(" "), F.upper(p))).alias("twice"), T.mirror_collapse(F.concat(p, F.lit(" "), "p_brand")).alias("other"))


@query
def hyphen_norm(spark, d):
    return I.table(spark, d, "part").select("p_partkey", T.hyphen_normalise(F.concat("p_name", F.lit(" -  "), "p_brand")).alias("name"))


@query
def entity_clean(spark, d):
    e = I.table(spark, d, "part").select("p_partkey", F.explode(F.array(F.concat(F.lit("#"), "p_brand"), F.lit("Statens"), F.lit("kassa"), F.lit("Kassan"), F.concat("p_brand", F.lit(" - x")))).alias("e"))
    return e.where(T.is_entity(F.col("e"))).select("p_partkey", T.clean_entity(F.col("e")).alias("entity"))


@query
def name_terms(spark, d):
    docs = I.table(spark, d, "orders").join(I.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id"), F.concat_ws(" for ", "o_orderpriority", "c_mktsegment").alias("text"))
    return MO.sensitive_terms(docs, names=ListedNames(("BUILDING", "MACHINERY")))


@query
def ner_windows(spark, d):
    return MO.entity_windows(I.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "start", F.length("part").alias("n"), F.md5(F.col("part").cast("binary")).alias("digest"))


@query
def redaction_boxes(spark, d):
    hits = I.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.col("l_quantity").alias("x0"), F.col("l_extendedprice").alias("y0"), (F.col("l_quantity") + 5).alias("x1"), (F.col("l_extendedprice") + 8).alias("y1"))
    b = MO.redaction_boxes(hits)
    return b.select("doc_id", "page_no", "x0", F.round("y0", 4).alias("y0"), "x1", F.round("y1", 4).alias("y1"))


@query
def chunk_overlap(spark, d):
    w = C.windows(C.words(F.col("text")), 100, 10)
    return I.table(spark, d, "documents").select("doc_id", F.posexplode(w).alias("chunk_no", "c")).select("doc_id", "chunk_no", F.size("c").alias("n"), F.md5(F.array_join("c", " ").cast("binary")).alias("digest"))


@query
def chunk_greedy(spark, d):
    w = C.greedy(C.words(F.col("text")), 120)
    return I.table(spark, d, "documents").select("doc_id", F.posexplode(w).alias("chunk_no", "c")).select("doc_id", "chunk_no", F.size("c").alias("n"), F.md5(F.array_join("c", " ").cast("binary")).alias("digest"))


@query
def chunk_greedy_cost(spark, d):
    """Groups of words that end with the word that brings them to 600 characters."""
    w = C.greedy(C.words(F.col("text")), 600, lambda x: F.length(x).cast("long"))
    return I.table(spark, d, "documents").select("doc_id", F.posexplode(w).alias("chunk_no", "c")).select("doc_id", "chunk_no", F.size("c").alias("n"), F.md5(F.array_join("c", " ").cast("binary")).alias("digest"))


@query
def chunk_safe_break(spark, d):
    part = F.array_join(F.array(F.lit("head:\n"), F.col("c_name"), F.lit(":\nrow "), F.col("c_mktsegment")), "")
    chunks = C.safe_breaks(F.array(part, F.concat(part, F.lit("\nNot 1 "), part), part))
    return I.table(spark, d, "customer").select("c_custkey", F.posexplode(chunks).alias("chunk_no", "chunk"))


@query
def chunk_safe_break_documents(spark, d):
    """Windows of the whole documents, their sentences ended as headings since the texts have no break mark of their own."""
    tokens = F.regexp_extract_all(F.replace(F.col("text"), F.lit(". "), F.lit(":\n")), F.lit(r"(?U)\S+\s*"), F.lit(0))
    parts = F.transform(C.windows(tokens, 100, 10), lambda w: F.array_join(w, ""))
    return I.table(spark, d, "documents").select("doc_id", F.posexplode(C.safe_breaks(parts)).alias("chunk_no", "c")).select("doc_id", "chunk_no", F.length("c").cast("long").alias("n_chars"), F.md5(F.col("c").cast("binary")).alias("digest"))


@query
def token_count(spark, d):
    return I.table(spark, d, "documents").select("doc_id", Tokenizer().count(F.col("text")).alias("n_tokens"))


@query
def page_label(spark, d):
    return I.table(spark, d, "orders").select("o_orderkey", T.page_label((F.col("o_orderkey") % 60 + 1).cast("int"), F.lit(5)).alias("label"), T.roman((F.col("o_orderkey") % 3999).cast("int")).alias("roman"))


@query
def page_assembly(spark, d):
    pages = I.year_pages(spark, d)
    offsets = pages.select("doc_id").distinct().withColumn("page_offset", (F.col("doc_id") % 3).cast("int"))
    return PO.assemble(pages, offsets)


@query
def has_text(spark, d):
    return PO.has_text(I.report_lines(spark, d).select("doc_id", (F.col("line_no") % 9).alias("page_no"), F.when(F.col("doc_id") % 2 == 0, F.col("line")).otherwise(" ").alias("text")))


@query
def term_list(spark, d):
    defs = I.metric_defs(spark, d).withColumn("synonyms", F.array(F.lower("metric"), F.concat(F.lit("x "), "metric")))
    return LO.terms(defs)


@query
def header_lines(spark, d):
    return LO.headers(I.report_lines(spark, d), I.metric_defs(spark, d).select(F.col("metric").alias("term")))


@query
def line_repair(spark, d):
    return LO.repair_lines(I.report_lines(spark, d), I.metric_defs(spark, d).select(F.col("metric").alias("term")))


@query
def ocr_choose(spark, d):
    b = I.table(spark, d, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("other"))
    n = I.table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("k"))
    return n.join(b, "k").select("doc_id", F.md5(PO.choose_text(F.col("text"), F.col("other")).cast("binary")).alias("digest"))


@query
def source_normalize(spark, d):
    s = F.concat(F.lit("Sida "), F.col("l_linenumber").cast("string"), F.lit(", ,Sida "), (F.col("l_partkey") % 12).cast("string"))
    return I.table(spark, d, "lineitem").select(s.alias("s")).distinct().select(F.col("s").alias("raw"), T.source_text(T.source_parts(F.col("s"))).alias("fixed"), F.size(T.source_parts(F.col("s"), False)).alias("n"))


@query
def sheet_name(spark, d):
    return I.table(spark, d, "part").select("p_partkey", T.sheet_name(F.concat("p_type", F.lit("/"), "p_brand", F.lit(":"), "p_name")).alias("sheet"))


@query
def valid_numeric(spark, d):
    t = F.when(F.col("l_linenumber") == 1, F.concat(F.floor("l_extendedprice").cast("string"), F.lit(" kr"))).when(F.col("l_linenumber") == 2, F.lit("12 244,5")).when(F.col("l_linenumber") == 3, F.lit("tolv")).otherwise(F.col("l_returnflag"))
    return I.table(spark, d, "lineitem").groupBy(t.alias("t")).count().select("t", T.is_valid_numeric(F.col("t")).alias("ok"))


@query
def fence_strip(spark, d):
    t = F.concat(F.lit("```json\n"), F.col("text"), F.when(F.col("turn") % 2 == 0, "\n```").otherwise(""))
    return I.table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.strip_fence(t).cast("binary")).alias("digest"))


@query
def json_shape_filter(spark, d):
    return I.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat("props", F.lit("x"))).alias("t")).where(T.looks_like_json_object(F.col("t"))).select("event_id")


@query
def file_gate(spark, d):
    ends = F.element_at(F.array(F.lit(".PDF"), F.lit(".zip"), F.lit(".txt"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return gate(I.table(spark, d, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), ends).alias("path")).distinct())


@query
def archive_gate(spark, d):
    name = F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.when(F.col("l_quantity") > 49, ".txt").when(F.col("l_quantity") > 45, "/").otherwise(".Pdf"))
    return archive_verdicts(I.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("archive"), name.alias("member")))


@query
def consolidated_findings(spark, d):
    return FO.consolidate(I.findings(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Findings merged by the first value, on the dense grid of the report."""
    return report_dense(spark, d)
