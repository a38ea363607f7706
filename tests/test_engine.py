"""Goldens worked out by hand, and parts that no table exercises."""

import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kpimill import plugins as P
from kpimill.functions import chunks as C
from kpimill.functions import text as T
from kpimill.operators import findings as FO
from kpimill.operators import lines as LO
from kpimill.operators import masking as MO
from kpimill.operators import pages as PO
from kpimill.operators import votes as VO
from kpimill.plans import pipeline as PL
from kpimill.sources import files as SF
from kpimill.sources import sinks as SI

FINDING = "doc_id int, chunk_no int, fund string, year string, metric string, value double, source string, certainty double, comment string, seq int"


def one(spark, schema, row, *exprs):
    return spark.createDataFrame([row], schema).select(*exprs).first()


def findings(spark, *rows):
    return spark.createDataFrame([(1, 1, f, "2023", m, v, s, c, None, k) for k, (f, m, v, s, c) in enumerate(rows)], FINDING)


def test_roman_and_labels(spark):
    df = spark.createDataFrame([(n,) for n in (1, 4, 9, 14, 40, 90, 400, 1994, 0)], "n int")
    assert [r[0] for r in df.select(T.roman(F.col("n"))).collect()] == ["I", "IV", "IX", "XIV", "XL", "XC", "CD", "MCMXCIV", ""]
    assert one(spark, "p int, o int", (3, 2), T.page_label(F.col("p"), F.col("o")))[0] == "1"
    assert one(spark, "p int, o int", (2, 2), T.page_label(F.col("p"), F.col("o")))[0] == "II"


def test_first_value_wins_field_by_field(spark):
    f = findings(spark, ("A", "K", None, "", None), ("A", "K", 5.0, "sid. 3", 0.4))
    r = FO.merge_first(f).first()
    assert (r.value, r.source, r.certainty) == (5.0, "", 0.4)
    assert FO.merge_first(f, by_row=True).first().source == "sid. 3"


def test_last_row_wins_with_nulls(spark):
    f = findings(spark, ("A", "K", 5.0, "x", 0.4), ("A", "K", None, None, None))
    assert FO.merge_last(f).first().value is None


def test_names_unify_and_conflicts_are_logged(spark):
    f = findings(spark, ("AB", "K", 5.0, "1", 0.1), ("ABC", "K", 6.0, "2", 0.1))
    assert FO.unify_funds(f).first().unified == "ABC"
    assert (FO.conflict_log(f).first().n_listed, FO.conflict_log(f).first().n_conflicts) == (2, 1)


def test_consolidation_takes_the_last_distinct_value_and_the_last_certainty(spark):
    f = findings(spark, ("A", "K", 5.0, "Sida 1", 0.1), ("A", "K", 6.0, "Sida 10, 8", 0.2), ("A", "K", 5.0, "Sida 3", 0.3))
    r = FO.consolidate_conflicts(f).first()
    assert (r.value, r.certainty, r.source, r.n_consolidated) == (6.0, 0.3, "Sida 10, 8", 2)


def test_pooling_by_prefix(spark):
    f = findings(spark, ("A", "Skulder", 5.0, "Sida 1", 0.1), ("A", "Skulder x", 5.0, "Sida 2", 0.2), ("A", "Skulder y", 7.0, "Sida 9", 0.2))
    r = {x.metric: x for x in FO.pool_prefix_sources(f).collect()}
    assert r["Skulder"].source == "Sida 1, 2" and r["Skulder"].n_consolidated == 1 and r["Skulder y"].source == "Sida 9"
    zero = findings(spark, ("A", "K", 0.0, "", 0.9))
    assert FO.pool_prefix_sources(zero).first().certainty == 0.9
    assert FO.pool_prefix_sources(zero, compat=True).first().certainty is None
    assert FO.pool_prefix_sources(zero, compat=True).first().source == "Sida "


def test_trees_survive_nesting(spark):
    f = findings(spark, ("A", "K", 5.5, "Sida 1", 0.1), ("B", "L", None, None, None))
    back = FO.unnest(FO.nest(f)).orderBy("fund").collect()
    assert [(r.fund, r.metric, r.value, r.source) for r in back] == [("A", "K", 5.5, "Sida 1"), ("B", "L", None, None)]


def test_votes(spark):
    v = spark.createDataFrame([(1, k + 1, y) for k, y in enumerate((2022, 2022, 2023, 2022, 2022, 2021))], "doc_id int, page_no int, vote int")
    r = VO.early_stopped(v).first()
    assert (r.vote, r.stop, r.n_votes) == (2022, 5, 5)
    tie = spark.createDataFrame([(1, 1, 7), (1, 2, 5)], "doc_id int, page_no int, vote int")
    assert VO.mode(tie).first().vote == 7
    none = spark.createDataFrame([(1, 1, None)], "doc_id int, page_no int, vote int")
    assert (VO.mode(none).first().vote, VO.report_year(none).first().report_year, VO.page_offset(none).first().page_offset) == (-1, None, 0)


@pytest.mark.parametrize("text,year", [("2021 2022, 2022 2023", 2022), ("2023", 2023), ("2020 2021", -2), ("none", -1)])
def test_year_of_a_page(spark, text, year):
    assert one(spark, "t string", (text,), T.year_vote(F.col("t")))[0] == year


@pytest.mark.parametrize("n,chunks", [(0, 0), (1, 1), (10, 1), (11, 2), (19, 2), (20, 3)])
def test_window_counts(spark, n, chunks):
    assert one(spark, "t string", (" ".join("x" * n),), F.size(C.windows(C.words(F.col("t")), 10, 1)))[0] == chunks


@pytest.mark.parametrize("overlap,error", [(10, ValueError), (1.5, ValueError), ("a", TypeError), (True, TypeError)])
def test_overlap_is_checked(overlap, error):
    with pytest.raises(error):
        C.overlap_size(10, overlap)


def test_greedy_groups_close_on_reaching_the_size(spark):
    got = one(spark, "t string", ("aa b ccc d",), C.greedy(C.words(F.col("t")), 3, lambda w: F.length(w).cast("long")))[0]
    assert got == [["aa", "b"], ["ccc"], ["d"]]


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 60), st.integers(2, 12), st.integers(0, 11))
def test_windows_cover_everything(spark, n, size, overlap):
    if overlap >= size:
        return
    words = [f"w{k}" for k in range(n)]
    got = one(spark, "t string", (" ".join(words),), C.windows(C.words(F.col("t")), size, overlap))[0]
    assert sum(([*w] if not k else w[overlap:] for k, w in enumerate(got)), []) == words
    assert all(len(w) <= size for w in got)


def test_line_repair(spark):
    def run(*lines):
        df = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc_id int, line_no int, line string")
        return [r.line for r in LO.repair_lines(df, ["Skulder"]).orderBy("line_no").collect()]

    assert run("Skulder", "", "12 244", "10", "text") == ["Skulder | 12 244 | 10", "text"]
    assert run("Skulder", "-5") == ["Skulder", "-5"]
    assert run("text", "", "10") == ["text", "", "10"]
    with pytest.raises(ValueError):
        LO.repair_lines(spark.createDataFrame([], "doc_id int, line_no int, line string"), [])


@pytest.mark.parametrize("text,out", [("Anna Anna", "Anna"), ("Anna anna", "Anna"), ("Anna Bo", "Anna Bo"), ("a a", "a a")])
def test_mirrored(spark, text, out):
    assert one(spark, "t string", (text,), T.mirror_collapse(F.col("t")))[0] == out


def test_small_text_rules(spark):
    c = F.col("t")
    assert one(spark, "t string", ("Ann - Mari",), T.hyphen_normalise(c))[0] == "Ann-Mari"
    assert one(spark, "t string", ("800101-1234 19800101-1234",), F.regexp_extract_all(c, F.lit(T.PERSONAL_NUMBER), F.lit(0)))[0] == ["800101-1234"]
    assert one(spark, "t string", ("```json\n{}\n```",), T.strip_fence(c))[0] == "{}"
    assert one(spark, "t string", ("x" * 30 + "/:",), T.sheet_name(c))[0] == "x" * 30 + "-"
    assert one(spark, "t string", ("Sida 8, Sida 10",), T.source_text(T.source_parts(c)))[0] == "Sida 10, 8"
    assert not one(spark, "t string", ('{"a":1} {"b":2}',), PL.strict_json(c))[0]
    assert one(spark, "n string, o string", ("ab", "abc"), PO.choose_text(F.col("n"), F.col("o")))[0] == "ab"
    assert one(spark, "n string, o string", ("ab", "abcd"), PO.choose_text(F.col("n"), F.col("o")))[0] == "abcd"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab.+(", min_size=1, max_size=4), max_size=4), st.text("abAB.+( ", max_size=30))
def test_redaction_leaves_no_term(spark, terms, text):
    got = one(spark, "x string, t array<string>", (text, terms), T.redact(F.col("x"), F.col("t"), "#"))[0]
    assert not any(t.lower() in got.lower() for t in terms)


def test_terms_with_names_and_boxes(spark):
    docs = spark.createDataFrame([(1, "Anna Ek skrev till a@b.se")], "doc_id int, text string")
    got = {r.term for r in MO.sensitive_terms(docs, names=P.ListedNames(("Anna Ek", "Bo")), extra=("Cia",)).collect()}
    assert got == {"Anna Ek", "a@b.se", "Cia"}
    box = MO.redaction_boxes(spark.createDataFrame([(1, 1, 0.0, 4.0, 9.0, 6.0)], "doc_id int, page_no int, x0 double, y0 double, x1 double, y1 double")).first()
    assert (box.y0, box.y1) == (0.0, 10.0)


def test_plugins():
    waits = []
    calls = iter([TimeoutError(), ConnectionError(), "ok"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert P.Retry(sleep=waits.append)(call) == "ok" and waits == [1.5, 3.0]
    with pytest.raises(RuntimeError):
        P.Retry(attempts=1, sleep=waits.append)(lambda: (_ for _ in ()).throw(TimeoutError()))
    assert (P.encoding_name("gpt-4o-mini"), P.encoding_name("gpt-4"), P.encoding_name("else")) == ("o200k_base", "cl100k_base", "o200k_base")
    assert (P.temperature("gpt-5.1"), P.temperature("gpt-4o")) == (1.0, 0.3)


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PDF").write_bytes("page one 2023\fpage two".encode())
    (tmp_path / "n.txt").write_text("no")
    with zipfile.ZipFile(tmp_path / "ok.zip", "w") as z:
        z.writestr("d/y.pdf", "one")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("y.pdf", "one")
        z.writestr("z.txt", "two")
    pages = SF.parse_pages(SF.scan_documents(spark, str(tmp_path))).orderBy("page_no").collect()
    assert [(r.page_no, r.text) for r in pages] == [(1, "page one 2023"), (2, "page two")]
    z = SF.scan_documents(spark, str(tmp_path), "zip")
    verdicts = {r.archive.rsplit("/", 1)[1]: r.accepted for r in SF.archive_verdicts(SF.list_archives(z)).collect()}
    assert verdicts == {"ok.zip": True, "bad.zip": False}
    assert [r.member for r in SF.open_archives(z).collect()] == ["d/y.pdf"]


def test_dictionaries_results_and_sinks(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"Nyckeltal": "K", "Alternativa benämningar": ["k2"], "Grupp": "G"}, {"Nyckeltal": "L"}]), encoding="utf-8")
    (tmp_path / "f.json").write_text(json.dumps([{"Officiellt namn": "Fond A", "Kort namn": "A", "KassaNummer": 1}]), encoding="utf-8")
    defs, funds = SF.metric_defs(spark, str(tmp_path / "m.json")), SF.funds(spark, str(tmp_path / "f.json"))
    assert sorted(r.term for r in LO.terms(defs).collect()) == ["K", "L", "k2"]
    facts = findings(spark, ("Fond A", "K", 5.0, "Sida 1", 0.5), ("Fond A", "Z", 1.5, None, None))
    assert SI.write_json(facts.limit(0), str(tmp_path / "none.json")) is None
    SI.write_json(facts, str(tmp_path / "r.json"))
    assert {(r.metric, r.value) for r in SF.results(spark, str(tmp_path / "r.json")).collect()} == {("K", 5.0), ("Z", 1.5)}
    SI.write_csv(facts, str(tmp_path / "r.csv"), with_sources=True)
    raw = (tmp_path / "r.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfFund;Year;Key;Value;Source\n") and b"Fond A;2023;K;5;Sida 1" in raw
    from kpimill.operators.report import dense

    SI.write_report(dense(facts, defs, funds), str(tmp_path / "r.xlsx"), with_sources=True)
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "<v>5</v>" in sheet and ">A<" in sheet and ">Z<" not in sheet and "Övrigt" in sheet
    SI.write_sheets(facts, str(tmp_path / "s.xlsx"), by="year")
    with pytest.raises(ValueError):
        SI.write_sheets(facts, "x", by="month")
    SI.csv_folder(facts, str(tmp_path / "folder"))
    with pytest.raises(ValueError):
        SI._rows(facts, 1)


def test_whole_way(spark):
    pages = spark.createDataFrame([("d", 1, "Year 2023 2023\nSkulder\n12 244\nend"), ("d", 2, "Skulder (tkr)\n5")], "doc_id string, page_no int, text string")
    defs = spark.createDataFrame([(0, "Skulder", [], None, None, None, None)], "ord int, metric string, synonyms array<string>, description string, formula string, grp string, instructions string")
    r = PL.analyse(pages, defs, size=50, overlap=5).collect()
    assert [(x.year, x.metric, x.value) for x in r] == [("2023", "Skulder", 12244.0)]
    bad = PL.extracted(spark.createDataFrame([("d", 2023, 0, "x")], "doc_id string, report_year int, chunk_no int, chunk string"), ["K"], lambda *a: 1 / 0).first()
    assert bad.answer is None and bad.error.startswith("ZeroDivisionError")
    answers = spark.createDataFrame([("d", 0, '{"a":1} {"b":2}'), ("d", 1, '```json\n{"F":{"2023":{"K":{"värde":"3"}}}}\n```'), ("d", 2, '{"F":{"2023":{"K":{"värde":null}}}}')], "doc_id string, chunk_no int, answer string")
    assert [(x.chunk_no, x.value) for x in PL.answers_to_findings(answers).collect()] == [(1, 3.0)]


def test_values_that_are_no_numbers_survive(spark):
    answer = '{"F":{"2023":{"K":{"värde":"12,5 tkr"},"L":{"värde":"12 244,5 kr"},"M":{"värde":"(3)"}}}}'
    answers = spark.createDataFrame([("d", 0, answer), ("e", 0, '{"F":{"2023":{"K":{"värde":"okänt"}}}}')], "doc_id string, chunk_no int, answer string")
    got = {(r.doc_id, r.metric): (r.value, r.value_text) for r in PL.answers_to_findings(answers).collect()}
    assert got == {("d", "K"): (None, "12,5 tkr"), ("d", "L"): (12244.5, "12244.5"), ("d", "M"): (None, "(3)"), ("e", "K"): (None, "okänt")}
    pages = spark.createDataFrame([("d", 1, "K 1")], "doc_id string, page_no int, text string")
    defs = spark.createDataFrame([(0, "K", [], None, None, None, None)], "ord int, metric string, synonyms array<string>, description string, formula string, grp string, instructions string")
    for compat in (False, True):
        r = PL.analyse(pages, defs, extractor=lambda *a: answer, compat=compat).collect()
        assert {(x.metric, x.value, x.value_text) for x in r} == {("K", None, "12,5 tkr"), ("L", 12244.5, "12244.5"), ("M", None, "(3)")}


def test_printed_numbers_move_the_labels(spark):
    from kpimill.functions.text import printed_number

    texts = {"x\nSida 3": 3, "x\n\n - 12 -  \n": 12, "4 (20)\nmore\n5": 4, "x\n5": None, "Sida 2 av 9\nx": 2, "": None, "sid. 7": 7, "on Sida 3 of it": None}
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", printed_number(F.col("t")).alias("n")).collect()}
    assert got == texts
    rows = [("d", k, "cover" if k < 3 else f"text\nSida {k - 2}") for k in range(1, 9)] + [("e", 1, "a"), ("e", 2, "b")]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string")
    text = {r.doc_id: r.text for r in PL.documents(pages, ["K"]).collect()}
    assert "[Sida II]" in text["d"] and "[Sida 1]\ntext\nSida 1" in text["d"] and text["e"].startswith("[Sida 1]")
    votes = spark.createDataFrame([("e", 1, 1), ("e", 2, 1)], "doc_id string, page_no int, vote int")
    assert {r.doc_id: r.text for r in PL.documents(pages, ["K"], votes).collect()}["e"].startswith("[Sida I]")
    seen = pages.withColumn("ocr_text", F.when(F.col("doc_id") == "e", "recognised text"))
    assert "recognised text" in {r.doc_id: r.text for r in PL.documents(seen, ["K"]).collect()}["e"]


def test_headings_of_digits_and_of_a_table(spark):
    from kpimill.operators import lines as LO

    lines = spark.createDataFrame([("d", k, t) for k, t in enumerate(["Total 5", "12", "", "13", "2023", "7", "other", "8", None])], "doc_id string, line_no int, line string")
    terms = spark.createDataFrame([("TOTAL",), ("2023",), ("tot",), (None,)], "term string")
    assert [(r.line_no, r.line) for r in LO.repair_lines(lines, terms).where("line is not null").orderBy("line_no").collect()] == [(0, "Total 5 | 12 | 13"), (4, "2023 | 7"), (6, "other"), (7, "8")]
    assert sorted(r.line_no for r in LO.headers(lines, terms).collect()) == [0, 4] and LO.headers(lines, terms.limit(0)).count() == 0


def test_failures_are_rows(spark, tmp_path):
    from kpimill.plugins import Retry
    from kpimill.sources import files as SF

    bad = spark.createDataFrame([("a.zip", bytearray(b"no archive"))], "path string, content binary")
    assert [r.error.split(":")[0] for r in SF.open_archives(bad).collect()] == [r.error.split(":")[0] for r in SF.list_archives(bad).collect()] == ["BadZipFile"]

    def parser(content):
        raise ValueError("broken")

    assert SF.parse_pages(bad, parser).count() == 0 and SF.parse_errors(bad, parser).first().error == "ValueError: broken"
    (tmp_path / "p.md").write_text("Läs", encoding="utf-8")
    assert SF.prompt(str(tmp_path / "p.md")) == "Läs"
    calls = tmp_path / "calls"

    def twice(chunk, year, metrics):
        with open(calls, "a") as f:
            f.write("x")
        if calls.stat().st_size < 2:
            raise TimeoutError
        return "{}"

    chunk = spark.createDataFrame([("d", 2023, 0, "x")], "doc_id string, report_year int, chunk_no int, chunk string")
    assert PL.extracted(chunk, ["K"], twice, Retry(delay=0.0)).first()[2:] == ("{}", None)
    assert PL.extracted(chunk, ["K"], lambda *a: (_ for _ in ()).throw(TimeoutError()), Retry(2, 0.0)).first().error.startswith("RuntimeError")


def test_greedy_groups_of_many_words(spark):
    words = [("w" * (k % 9 + 1)) for k in range(5000)]
    got = one(spark, "t string", (" ".join(words),), C.greedy(C.words(F.col("t")), 50, lambda w: F.length(w).cast("long")))[0]
    want, used = [[]], 0
    for w in words:
        want[-1].append(w)
        used += len(w)
        if used >= 50:
            want.append([])
            used = 0
    assert got == [g for g in want if g]
    assert one(spark, "t string", ("",), C.greedy(C.words(F.col("t")), 50, lambda w: F.length(w).cast("long")))[0] == []


def test_stream(spark, tmp_path):
    from kpimill.streaming.ingest import redact_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"doc_id": "d", "page_no": 1, "text": "mail a@b.se now"}))
    q = redact_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().text == "mail █ now"
