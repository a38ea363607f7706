"""The stages of the pipeline, each against plain Python on its own input."""

import collections

import numpy as np

import corpus_pipeline as cp


def test_stages(spark):
    from test_operators import components, words

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "pseudonyms", "mixing", "packing"]
    ids = lambda df: collections.Counter(r.doc_id for r in df.select("doc_id").collect())
    one = cp.language_id(spark, docs, d).cache()
    assert one.columns == docs.columns and len(ids(one)) >= 0.98 * docs.count()
    two = cp.near_dedup(spark, one, d).cache()
    want = components([(r.doc_id, r.text) for r in one.collect()], 5)
    assert ids(two) == collections.Counter(i for i, c in want.items() if i == c) and two.columns == docs.columns
    three = cp.pseudonyms(spark, two, d).cache()
    assert ids(three) == ids(two) and three.columns == docs.columns and all(r.n_chars == len(r.text) for r in three.collect())
    four = cp.mixing(spark, three, d).cache()
    assert set(ids(four).values()) <= {1, 2} and four.columns == docs.columns
    total = sum(len(words(r.text)) for r in three.collect())
    assert abs(sum(len(words(r.text)) for r in four.collect()) - 1.5 * total) < 0.02 * total
    five = cp.packing(spark, four, d).toPandas()
    assert collections.Counter(five[five.piece == 0].doc_id) == ids(four)
    for _, s in five.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024


def test_rows_that_share_an_id_go_only_with_near_texts(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    rows = [(1, text("a")), (1, text("b")), (1, text("b")), (2, text("c")), (2, text("a") + " z"), (3, text("b")), (3, text("d")), (4, text("d")), (None, text("a")), (None, text("e")), (None, text("e"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r.doc_id, r.text) for r in cp.near_dedup(spark, docs, "").collect())
    assert got == collections.Counter([(1, text("a")), (1, text("b")), (2, text("c")), (3, text("d")), (None, text("e"))])


def test_stages_with_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, and no rows at all."""
    from pyspark.sql import functions as F
    from test_operators import EDGE, DOCS, clashing

    docs = clashing(spark.createDataFrame(EDGE, DOCS).unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100).limit(60)))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, "")
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and {(r.at, r.row, r.node) for r in rows} == {("x",) * 3}
        n = collections.Counter((r.doc_id, r.text) for r in rows) if name != "packing" else None
        if name == "language_id":
            assert (4, "one") in n and not {(1, None), (2, ""), (3, " \t\n")} & n.keys() and n[5, EDGE[4][1]] == 2
        if name == "near_dedup":
            assert n[5, EDGE[4][1]] == 1 and (6, EDGE[5][1]) not in n and (None, EDGE[7][1]) not in n and n[1, None] == n[2, ""] == 1
        if name == "pseudonyms":
            assert len(rows) == docs.count() and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        if name == "mixing":
            assert n[1, None] == n[2, ""] == n[3, " \t\n"] == 1
        if name == "packing":
            assert sum(r.piece == 0 for r in rows) == docs.count()
        assert stage(spark, docs.limit(0), "").count() == 0


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is cp.run
