"""Every query of the catalogue against its SQL in DuckDB."""

import os

import duckdb
import pytest

from kpimill.plans.catalogue import QUERIES
from kpimill.plans.oracles import SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    return repr(round(float(v), 6)) if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(_plain, r)) for r in df.select(cols).collect())
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(tuple(_plain(r[k]) for k in order) for r in cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pivot_of_all_funds_loses_none(spark):
    got = QUERIES["report_pivot"](spark, SF)
    cells = QUERIES["report_dense"](spark, SF).where("value is not null").select("year", "fund", "metric", "value")
    funds = {r.fund for r in cells.select("fund").distinct().collect()}
    assert len(funds) > 5 and {f"v_{f.lower().replace(' ', '_')}" for f in funds} <= set(got.columns)
    values = [c for c in got.columns if c.startswith("v_")]
    assert sum(v is not None for r in got.select(values).collect() for v in r) == cells.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_safe_breaks_of_documents_against_plain_python(spark):
    import hashlib
    import re

    from kpimill.functions.chunks import BREAKS, REACH

    def head(c):
        return next((c[c.find(m) + len(m) :] for m in BREAKS if 0 <= c.find(m) <= REACH), c)

    def tail(c):
        return next((c[: c.rfind(m) + len(m)] for m in BREAKS if c.rfind(m) >= 0 and len(c) - c.rfind(m) <= REACH), c)

    want, cut, whole = [], 0, 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = re.findall(r"\S+\s*", r.text.replace(". ", ":\n"))
        n = 0 if not w else 1 if len(w) <= 100 else 1 - (100 - len(w)) // 90
        for k in range(n):
            t = c = "".join(w[90 * k : 90 * k + 100])
            t = head(t) if k else t
            t = tail(t) if k < n - 1 else t
            cut, whole = cut + (t != c), whole + (t == c and n > 1)
            want.append((r.doc_id, k, len(t), hashlib.md5(t.encode()).hexdigest()))
    got = [tuple(r) for r in QUERIES["chunk_safe_break_documents"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and cut > 0 and whole > 0
