"""The operators of kpimill.llm against brute force on small tables, and their edge cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 4000
EDGE = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one", "en", None, 3), (5, "the same words here and there again", "en", "a", 35),
    (6, "The SAME words\there and there  again", "en", "b", 36), (5, "the same words here and there again", "en", "a", 35), (None, "the same words here and there again", None, "b", 35), (7, LONG, "en", "b", len(LONG)),
    (8, "été " * 60, "fr", "c", 240), (9, "!!! ### 123    x", "de", "c", 10),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """Extra columns with the names that operators use themselves."""
    for c in ("node", "key", "size", "component", "hash", "block", "copies", "payload", "spans", "n", "h", "at", "__p", "made", "_copies", "_n", "_copy", "row", "lam", "target", "left", "k", "query", "ids", "part", "g", "a", "b"):
        df = df.withColumn(c, F.lit("x"))
    return df


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


# --- near-duplicates ---


def shingles(t, width):
    w = [x.translate({k: k + 32 for k in range(65, 91)}) for x in words(t)]
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def components(rows, width):
    sets = collections.defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingles(t, width))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and any(a and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("which,width", [("edge", 4), ("real", 4), ("real", 5)])
def test_near_duplicates(request, which, width):
    from kpimill.llm.near_dedup import near_duplicates

    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = near_duplicates(clashing(df), width).collect()
    want = components(rows, width)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)
    sizes = collections.Counter((i, len(shingles(t, width))) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == sizes


def test_near_duplicates_links_outside_the_first_star(spark):
    """A chain in which only neighbours are similar enough."""
    from kpimill.llm.near_dedup import near_duplicates

    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(30):
        w = [f"x{k}" if k < 4 * i else base[k] for k in range(120)]
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    assert got == components(rows, 1) and len(set(got.values())) < 30


def test_no_documents(spark):
    from kpimill.llm.language_id import identify_languages
    from kpimill.llm.mixing import mix_documents, mix_sources
    from kpimill.llm.near_dedup import near_duplicates
    from kpimill.llm.packing import pack_documents
    from kpimill.llm.pii import pseudonymise_documents
    from kpimill.llm.quality_rules import quality_verdicts
    from kpimill.llm.suffix_dedup import remove_repeats

    e = empty(spark)
    for f in (near_duplicates, remove_repeats, pack_documents, mix_sources, mix_documents, quality_verdicts, lambda d: identify_languages(d, d), lambda d: pseudonymise_documents(d, "k")):
        assert f(e).count() == 0


def test_bayes_bounds_keep_what_may_be_similar():
    from kpimill.llm.near_dedup import SIGNATURE, least_matches, survivors

    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (3000, SIGNATURE)).astype(np.uint8)
    near = np.where(rng.random(a.shape) < 0.8, a, a + 1).astype(np.uint8)
    far = np.where(rng.random(a.shape) < 0.5, a, a + 1).astype(np.uint8)
    assert len(survivors(a, near, 0.8, 1e-4)) >= 2995 and len(survivors(a, far, 0.8, 1e-4)) == 0
    assert [n for n, _ in least_matches(0.8, 1e-4)][-1] == SIGNATURE


def test_near_duplicates_of_a_large_group(spark):
    """So many near copies, with strays among them, that trees, hot keys and blocks of a bucket all come into play."""
    from kpimill.llm.near_dedup import near_duplicates

    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(1500):
        w = list(base)
        for k in rng.choice(100, 3, replace=False):
            w[k] = f"x{rng.integers(10**9)}"
        rows.append((i, " ".join(w)))
    for i in range(1500, 1530):  # share half of the words, or nothing
        rows.append((i, " ".join([*base[:70], *[f"y{i}_{k}" for k in range(30)]]) if i % 2 else f"alone {i}"))
    rows += [(i, None) for i in range(1600, 2800)] + [(2800 + i, rows[5][1]) for i in range(1300)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 1).collect()}
    short = [r for r in rows if r[0] < 1530]
    want = components(short, 1) | {i: i for i in range(1600, 2800)} | {2800 + i: 0 for i in range(1300)}
    assert want[5] == 0 and got == want


def test_near_misses_of_a_large_group_are_no_rows(spark, monkeypatch):
    """Strays that come close to the threshold with every member of a large group: their pairs are verified within tasks."""
    from kpimill.llm import near_dedup
    from kpimill.llm.common import Staged

    made = collections.Counter()

    class Counted(Staged):
        def __init__(self, df, name):
            super().__init__(df, name)
            made[name] = max(made[name], self.df().count())

    monkeypatch.setattr(near_dedup, "Staged", Counted)
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(750):
        w = list(base)
        for k in rng.choice(200, 2 if i % 5 else 20 + i % 8, replace=False):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    assert got == components(rows, 1) and 50 < len(set(got.values())) < 150
    assert max(made.values()) <= near_dedup.BANDS * len(rows)


@pytest.mark.parametrize("most", [1, 700, 10**6])
def test_cells_of_any_size_find_the_same_components(monkeypatch, most):
    import pyarrow as pa

    from kpimill.llm import near_dedup as nd
    from kpimill.llm.common import shingle_set

    monkeypatch.setattr(nd, "CELL", most)
    rng = np.random.default_rng(9)
    texts = []
    for i in range(60):
        w = [f"w{k}" for k in range(100)]
        for k in rng.choice(100, int(rng.integers(3, 16)), replace=False):
            w[k] = f"x{i}_{k}"
        texts.append(" ".join(w))
    sets = [shingle_set(t.encode(), 1) for t in texts]
    sig = [(nd.signature(s) & np.uint32(255)).astype(np.uint8).tobytes() for s in sets]
    ids, n = list(range(60)), [len(s) for s in sets]
    block = [int(i >= 25) for i in ids]
    both = {"key": [7] * 60, "i": [0] * 60, "j": [1] * 60, "block": block, "node": ids, "component": ids, "n_shingles": n, "bands": [np.full(nd.BANDS, 7).tobytes()] * 60, "sig": sig}
    types = {"i": pa.int32(), "j": pa.int32(), "block": pa.int32(), "bands": pa.binary(), "sig": pa.binary()}
    batch = pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.int64())) for c, v in both.items()], names=list(both))
    cells = pa.Table.from_batches(nd._across(0.8, 1e-4, 80)(iter([batch.slice(0, 20), batch.slice(20)])))
    assert len(set(cells.column("part").to_pylist())) == 1 if most == 10**6 else len(cells) > 60
    cells = cells.append_column("text", pa.array([texts[k] for k in cells.column("node").to_pylist()])).sort_by("part").combine_chunks()
    got = [x for rb in nd._verify_cells(1, 80)(iter(cells.to_batches(max_chunksize=11))) for x in zip(*(c.to_pylist() for c in rb.columns))]
    exact = {(a, b) for a in range(25) for b in range(25, 60) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}

    def joined(links):
        label = list(ids)
        for a, b in links:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(k for k in ids if label[k] == x) for x in label}

    assert set(got) <= exact and joined(got) == joined(exact) and 1 < len(joined(exact)) < 60


def test_components_of_chains_and_stars(spark):
    from kpimill.llm.components import connected_components

    edges = [(k + 1, k) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}
    star = spark.range(1, 3000).selectExpr("5000 as a", "id as b")  # a node and a label of so many rows are hot keys
    assert connected_components(star).groupBy("component").count().collect() == [(1, 3000)]


def test_joins_with_hot_keys(spark):
    from kpimill.llm.common import join_hot

    left = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 2 * 7).when(F.col("id") % 2 == 0, F.col("id")).alias("key"), "id")
    right = spark.range(0, 4000).select(F.col("id").alias("key"), (F.col("id") + 1).alias("v"))
    for how in ("inner", "left"):
        assert sorted(map(str, join_hot(left, right, "key", how).select("key", "id", "v").collect())) == sorted(map(str, left.join(right, "key", how).select("key", "id", "v").collect()))


# --- repeated windows ---


def cut(rows, depth):
    seen, out = {}, {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows if i is not None):
        gone = bytearray(len(t))
        for p in range(len(t) - depth + 1):
            if seen.setdefault(t[p : p + depth], (i, p)) != (i, p):
                gone[p : p + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("depth", [100, 12])
def test_remove_repeats(spark, real, depth):
    from kpimill.llm.suffix_dedup import remove_repeats

    rows = [(r.doc_id, r.text[:3000]) for r in real.orderBy("doc_id").limit(60).collect()] + [(1000, "ab" * 300), (1001, "xyz" * 5), (1002, None), (1003, ""), (1004, "ä" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(clashing(df), depth).collect()}
    assert got == cut(rows, depth)


def test_remove_repeats_of_very_long_texts(spark):
    """Texts over several segments, a passage across a segment's end, and a phrase that very many texts share."""
    from kpimill.llm.suffix_dedup import remove_repeats

    rng = np.random.default_rng(3)
    some = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    shared, phrase = some(3000), some(95)
    rows = [(1, some(523_000) + shared + some(60_000)), (2, some(400_000) + shared + some(700) + shared[:150]), (3, shared[50:2000]), (4, "ab" * 300_000)]
    rows += [(100 + k, some(150) + phrase + some(150)) for k in range(1500)] + [(5000 + k, some(150) + phrase + shared[:40 + k % 80]) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, bucket_bytes=1 << 16).collect()}
    assert got == cut(rows, 100)


def test_a_common_phrase_fills_no_bucket():
    import pyarrow as pa

    from kpimill.llm.suffix_dedup import _pass_digits, _unpack

    rng = np.random.default_rng(4)
    some = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    phrase, size = some(95), collections.Counter()
    for task in range(4):
        texts = [some(200) + phrase + some(200) for _ in range(5000)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(5000 * task, 5000 * task + 5000), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])
        for out in _pass_digits(256, 100)([batch]):
            for row in range(len(out)):
                size[out.column(0)[row].as_py()] += len(_unpack(pa.Table.from_batches([out.slice(row, 1)]))[0][0])
    assert len(size) == 256 and max(size.values()) <= 2 * np.median(list(size.values()))


def test_remove_repeats_edges(edge):
    from kpimill.llm.suffix_dedup import remove_repeats

    got = remove_repeats(edge, with_text=True).collect()
    assert len(got) == len(EDGE)
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and r.n_bytes - r.n_removed == len(r.kept)
    assert {r.doc_id: r.n_removed for r in got}[7] > 100_000


# --- packing ---


def test_packing(spark, edge, real):
    from tokenizers import Tokenizer

    from kpimill.llm.packing import pack_documents
    from kpimill.llm.tokens import default_path

    tk = Tokenizer.from_file(default_path())
    df = real.select("doc_id", "text").unionByName(edge.select((F.col("doc_id") + 10_000).alias("doc_id"), "text").where("doc_id is not null").distinct())
    df = df.union(spark.createDataFrame([(20_000, "a <|endoftext|>  b\n\n c")], "doc_id long, text string"))
    got = pack_documents(clashing(df)).toPandas()
    pieces = {k: g.sort_values("piece") for k, g in got.groupby("doc_id")}
    for r in df.collect():
        ids = np.array(tk.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        p = pieces[r.doc_id]
        assert list(p.piece) == list(range(len(p))) and list(p.start) == [0, *np.cumsum(p.length)[:-1]] and p.length.sum() == len(ids)
        assert len(p) == 1 or (len(ids) > 1024 and set(p.length[1:]) == {1024})
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(p.start, p.length)] == list(p.ids_crc32)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
    assert got.sequence_id.nunique() <= 1.05 * -(-got.length.sum() // 1024)
    assert pack_documents(edge).select("doc_id").where("piece = 0").count() == len(EDGE)


def test_token_ids_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    from kpimill.llm.tokens import default_path, encoder

    tk, encode = Tokenizer.from_file(default_path()), encoder(default_path())
    rng = np.random.default_rng(5)
    ranges = [(32, 127), (9, 33), (160, 768), (0x370, 0x600), (0x4E00, 0x4F00), (0x1F300, 0x1F700), (0x2000, 0x2070), (0, 0xD800)]
    texts = ["".join(chr(rng.integers(*ranges[rng.integers(len(ranges))])) for _ in range(rng.integers(0, 60))) for _ in range(4000)]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + ["<|endoftext|>", "a  b", "\u3000\u3000x", "it's  we'll\n\n "]
    for t in texts:
        assert encode(t) == tk.encode(t, add_special_tokens=False).ids


def test_best_fit():
    from kpimill.llm.packing import best_fit

    rng = np.random.default_rng(1)
    n = rng.integers(1, 1025, 3000)
    bins = best_fit(n, 1024)
    assert sorted(k for b in bins for k in b) == list(range(3000)) and max(n[b].sum() for b in bins) <= 1024
    assert len(bins) <= 1.05 * np.ceil(n.sum() / 1024)
    with pytest.raises(ValueError):
        from kpimill.llm.packing import pack_documents

        pack_documents(None, capacity=0)


# --- mixing ---


def level(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free = {}, list(names)
    while free:
        left = share * sum(sizes.values()) - sum(target.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        target |= {s: most * sizes[s] for s in over}
        free = [s for s in free if s not in over]
    return target


@pytest.mark.parametrize("which", ["edge", "real"])
def test_mixing(request, which):
    from kpimill.llm.mixing import mix_documents, mix_sources

    df = request.getfixturevalue(which)
    mixed = mix_sources(clashing(df))
    got = mixed.toPandas()
    rows = df.collect()
    assert collections.Counter(zip(got.doc_id.fillna(-1), got["size"])) == collections.Counter((-1 if r.doc_id is None else r.doc_id, len(words(r.text))) for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    want = level(dict(sizes))
    for s, g in got.groupby(got.source.fillna("-")):
        s = None if s == "-" else s
        assert np.allclose(g.target, want[s]) and set(g.source_size) == {sizes[s]} and (g.taken <= 2 * g["size"]).all()
        assert abs(g.taken.sum() - want[s]) <= max(1 + 0.02 * want[s], g["size"].max() if len(g) < 5 else 0)
        if len(g) > 20:
            assert abs(g.taken.sum() - want[s]) <= 20
            # the tilt: below the bound the rates are one exponential of the size
            free = g[(g.rate < 2) & (g["size"] > 0)]
            assert np.ptp(np.log(free.rate) / free["size"]) < 1e-9 and abs((g.rate * g["size"]).sum() - want[s]) < 1e-6 * want[s]
            assert (abs(g.groupby("size").copies.sum() - g.groupby("size").rate.sum())[lambda x: x.index > 0] <= 1 + 20).all()
    again = mix_sources(df.repartition(3)).toPandas()
    key = ["doc_id", "source", "size", "copies"]
    assert got[key].fillna("-").astype(str).sort_values(key).values.tolist() == again[key].fillna("-").astype(str).sort_values(key).values.tolist()
    taken = collections.Counter({(r.doc_id, r.text, r.row): n for r, n in collections.Counter(mix_documents(clashing(df)).select("doc_id", "text", "row").collect()).items()})
    assert sum(taken.values()) == got.copies.sum() and {r for _, _, r in taken} <= {"x"}
    by_id = collections.Counter()
    for (i, t, _), n in taken.items():
        by_id[-1 if i is None else i] += n
    assert by_id == collections.Counter(dict(got.assign(doc_id=got.doc_id.fillna(-1)).groupby("doc_id").copies.sum()[lambda x: x > 0].items()))


def test_mixing_of_repeated_rows(spark):
    """Rows that share an id and a text are taken each by itself, so the mix still meets its target."""
    from kpimill.llm.mixing import mix_documents, mix_sources

    rows = [(1, "a b c d", "s")] * 300 + [(k, "w " * (k % 7 + 1), "t") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, sizes = mix_sources(df).toPandas(), {"s": 1200, "t": sum(k % 7 + 1 for k in range(900))}
    for s, want in level(sizes).items():
        assert abs(got[got.source == s].taken.sum() - want) <= 4
    assert mix_documents(df).count() == got.copies.sum()


def test_newton_against_plain_bisection(spark):
    from kpimill.llm.mixing import multipliers

    rng = np.random.default_rng(2)
    hist = [(f"+{k}", int(s), int(n)) for k in range(12) for s, n in zip(rng.choice(5000, 60, replace=False), rng.integers(1, 500, 60))]
    total, docs = collections.Counter(), collections.Counter()
    for key, s, n in hist:
        total[key] += s * n
        docs[key] += n
    sources = [(key, t, docs[key], t * (0.05 + 0.17 * k)) for k, (key, t) in enumerate(total.items())]
    got = multipliers(spark.createDataFrame(hist, "key string, size long, n long"), spark.createDataFrame(sources, "key string, source_size long, docs long, target double"), 2).collect()
    assert len(got) == 12 and all(r.done for r in got)
    for r in got:
        own = np.array([(s, n) for key, s, n in hist if key == r.key], float)
        mean = total[r.key] / docs[r.key]
        at = lambda lam: (own[:, 0] * own[:, 1] * np.minimum(2, np.exp(np.minimum(lam * own[:, 0] / mean, 50)))).sum()  # noqa: E731, B023
        lo, hi = -50 * mean, 50 * mean
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if at(mid) < r.target else (lo, mid)
        assert abs(at(r.lam) - r.target) <= 1e-8 * r.target and abs(at(lo) - r.target) <= 1e-6 * r.target


# --- personal data ---


def test_pseudonyms(spark, edge):
    from kpimill.llm.pii import pseudonymise_documents

    rows = [
        "mail ab.42@mail8.example.com and ab.42@mail8.example.com.", "card 4111 1111 1111 1111 and 4111-1111-1111-1111, not 4111111111111112", "+1 (136) 555-7479%%% 212-555-1234",
        "97.51.17.173 not 999.1.1.1 or 1.2.3.4.5", "1984-02-29, 31.12.1999, not 1984-02-30", "811218-9876 123-45-6789 not 000-12-3456", "GB82 WEST 1234 5698 7654 32", 'token = "24be64439e3e49cf46b2"',
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_pseudonyms) for r in pseudonymise_documents(df, "k").collect()}
    assert [got[k][1] for k in range(8)] == [2, 2, 2, 1, 2, 2, 1, 1]
    for k, t in enumerate(rows):
        assert len(got[k][0]) == len(t) or k == 3
    first, second = re.findall(r"\S+@\S+?\.com", got[0][0])
    assert first == second
    cards = re.findall(r"(?:\d{4}[ -]){3}\d{4}", got[1][0])
    assert re.sub(r"\D", "", cards[0]) == re.sub(r"\D", "", cards[1]) and "4111111111111112" in got[1][0]
    d = re.sub(r"\D", "", cards[0])
    assert sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    assert "1984-02-30" in got[4][0] and "000-12-3456" in got[5][0] and "999.1.1.1 or 1.2.3.4.5" in got[3][0]
    other = {r.doc_id: r.text for r in pseudonymise_documents(df, "another").collect()}
    assert all(other[k] != got[k][0] for k in range(8))
    same = pseudonymise_documents(clashing(edge), "k")
    assert collections.Counter((r.doc_id, r.text, r.n_pseudonyms) for r in same.collect()) == collections.Counter((i, t, 0) for i, t, *_ in EDGE)


def test_pseudonyms_of_values_with_neighbours(spark):
    from kpimill.llm.pii import pseudonymise_documents

    token = "Ab3." * 200 + "end9"
    ibans = ["ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "SE4550000000058398257466", "AT61 1904 3002 3457 3201", "ZZ82 1234 5678"]
    rows = [f"pay {ibans[0]} EUR", f"to {ibans[1]} BIC GEBA 4111 1111 1111 1111", f"{ibans[2]} SEK", f"{ibans[3]} 2024 NOW or {ibans[0]} by", f"{ibans[4]} 99 ABC", f"password={token} after", "token: abcd.efgh.ijkl. Then", "secret=abcdefg."]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_pseudonyms) for r in pseudonymise_documents(df, "k").collect()}
    assert [got[k][1] for k in range(8)] == [1, 2, 1, 2, 1, 1, 1, 0]
    assert all(len(got[k][0]) == len(t) for k, t in enumerate(rows)) and not any(i in got[k][0] for k in range(5) for i in ibans)
    assert got[0][0].endswith(" EUR") and " BIC GEBA " in got[1][0] and "4111 1111" not in got[1][0] and got[2][0].endswith(" SEK") and " 2024 NOW or " in got[3][0] and got[4][0].endswith(" 99 ABC")
    mod97 = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    assert mod97(got[0][0][4:-4].replace(" ", "")) == mod97(got[2][0][:-4]) == mod97(got[4][0][:-7].replace(" ", "")) == 1
    hidden = got[5][0].removeprefix("password=").removesuffix(" after").split(".")
    assert len(hidden) == 201 and sum(a == b for a, b in zip(hidden, token.split("."))) < 5
    assert re.fullmatch(r"token: [a-z]{4}\.[a-z]{4}\.[a-z]{4}\. Then", got[6][0]) and not set(re.findall("[a-z]{4}", got[6][0])) & {"abcd", "efgh", "ijkl"}


def test_pseudonyms_of_other_groupings(spark):
    from kpimill.llm.pii import pseudonymise_documents

    rows = ["amex 3782 822463 10005 and 3782-822463-10005 not 3782 822463 10006", "call 555.123.4567. Not 555.123.4567.8"]
    got = {r.doc_id: (r.text, r.n_pseudonyms) for r in pseudonymise_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "k").collect()}
    assert [got[k][1] for k in range(2)] == [2, 1] and all(len(got[k][0]) == len(t) for k, t in enumerate(rows))
    assert re.fullmatch(r"amex \d{4} \d{6} \d{5} and \d{4}-\d{6}-\d{5} not 3782 822463 10006", got[0][0]) and "10005" not in got[0][0]
    assert re.fullmatch(r"call \d{3}\.\d{3}\.\d{4}\. Not 555\.123\.4567\.8", got[1][0]) and "call 555.123.4567" not in got[1][0]


def test_feistel_permutes(spark):
    from kpimill.llm.pii import Key, feistel_number, feistel_text

    k = Key("k")
    assert spark.range(147 * 487).select(feistel_number(F.col("id"), 147, 487, k, "d").alias("v")).agg(F.countDistinct("v"), F.min("v"), F.max("v")).first()[:] == (71589, 0, 71588)
    df = spark.range(10_000).select(feistel_text(F.lpad(F.col("id").cast("string"), 4, "0"), k, "x").alias("v"))
    assert df.distinct().count() == 10_000


def test_feistel_against_plain_python(spark):
    import hmac

    import xxhash

    from kpimill.llm.pii import Key, feistel_number, feistel_text

    secret = hmac.new(b"k", b"x", hashlib.sha256).hexdigest()
    sha = lambda *x: hashlib.sha256("|".join(["round-key-" + secret, *map(str, x)]).encode()).hexdigest()
    signed = lambda v: v - (1 << 64) if v >> 63 else v

    def text(s):
        for r in range(1, 9):
            left, right = s[: len(s) // 2], s[len(s) // 2 :]
            d = sha(r, len(s), left if r % 2 else right)

            def moved(part):
                out = ""
                for at, c in enumerate(part, 1):
                    by = signed(xxhash.xxh64_intdigest(at.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(d.encode(), seed=42))) % 1040  # noqa: B023
                    first, n = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26) if c.isupper() else (0, 0)
                    out += chr(first + (ord(c) - first + by) % n) if n else c
                return out

            s = left + moved(right) if r % 2 else moved(left) + right
        return s

    def number(x, a, b):
        q, m = divmod(x, b)
        for r in range(1, 9):
            k = signed(xxhash.xxh64_intdigest(sha(r, q if r % 2 else m).encode(), seed=42))
            q, m = (q, (m + k % b) % b) if r % 2 else ((q + k % a) % a, m)
        return q * b + m

    values = ["Ab3-zZ9", "x", "", "4111111111111111", "a.b+c@D", "0" * 300]
    got = spark.createDataFrame(list(enumerate(values)), "i long, s string").select("s", feistel_text(F.col("s"), Key("k"), "x").alias("v")).collect()
    assert {r.s: r.v for r in got} == {s: text(s) for s in values}
    got = spark.range(0, 71589, 700).select("id", feistel_number(F.col("id"), 147, 487, Key("k"), "x").alias("v")).collect()
    assert {r.id: r.v for r in got} == {r.id: number(r.id, 147, 487) for r in got}


def test_pseudonyms_can_be_undone_with_the_key(spark):
    from kpimill.llm.pii import pseudonymise_documents

    rows = [
        "mail ab.42@mail8.example.com", "cards 4111 1111 1111 1111, 4111-1111-1111-1111 and 5500005555555559", "+1 (136) 555-7479 or 212-555-1234 or 555.123.4567 or +49 30 123 4567", "97.51.17.173 and 10.0.0.1",
        "1984-02-29, 31.12.1999, 2004/07/01", "811218-9876 and 123-45-6789", "GB82 WEST 1234 5698 7654 32, ES91 2100 0418 4502 0005 1332 EUR", 'token = "24be64439e3e49cf46b2" and password=Zx9.' + "q7W-" * 100 + "end", "nothing", None, "",
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    made = pseudonymise_documents(df, "k")
    back = {r.doc_id: r.text for r in pseudonymise_documents(made, "k", inverse=True).collect()}
    wrong = {r.doc_id: r.text for r in pseudonymise_documents(made, "j", inverse=True).collect()}
    assert [back[k] for k in range(len(rows))] == rows and all(wrong[k] != rows[k] for k in range(8))


def test_pseudonyms_keep_other_columns_and_hide_the_key(spark, edge):
    from kpimill.llm.pii import Key, pseudonymise_documents

    out = pseudonymise_documents(clashing(edge), "a secret of ours")
    assert out.columns == [*clashing(edge).columns, "n_pseudonyms"] and {(r["__p"], r.made) for r in out.collect()} == {("x", "x")}
    plan = out._jdf.queryExecution().toString() + out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Project" in plan and "a secret of ours" not in plan and Key("a secret of ours").of("card") not in plan and "round-key" not in plan


# --- quality ---


def test_counts_and_verdicts(spark, edge, real):
    from kpimill.llm.quality_rules import quality_verdicts

    df = edge.unionByName(real.withColumn("doc_id", F.col("doc_id") + 100))
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_verdicts(clashing(df)).collect())
    want = collections.Counter()
    for r in df.collect():
        t, w = r.text or "", words(r.text)
        seen, cover = collections.Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if seen[tuple(w[k : k + 3])] > 1:
                cover |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if words(x)]
        want[(r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 2 * len(cover) > len(w))] += 1
    assert got == want


def test_expectation_maximisation_against_arrays(spark):
    """The same model with numpy over documents instead of combinations of votes; verdicts by its posterior."""
    from kpimill.llm.quality_rules import RULES, quality_verdicts

    got = quality_verdicts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    v = got[[r.name for r in RULES]].to_numpy(int)
    prior, bad = 0.8, np.tile([[0.4], [0.01]], (1, len(RULES)))  # P(bad vote | a vote) of bad and of good documents

    def posterior():
        log = np.where(v == 1, np.log(1 - bad[1]) - np.log(1 - bad[0]), np.where(v == -1, np.log(bad[1]) - np.log(bad[0]), 0)).sum(axis=1)
        return 1 / (1 + np.exp(-np.log(prior / (1 - prior)) - log))

    for _ in range(40):
        p, last = posterior(), prior
        prior = (p.sum() + 1) / (len(p) + 2)
        for c, w in ((0, 1 - p), (1, p)):
            bad[c] = ((w[:, None] * (v == -1)).sum(axis=0) + 0.5) / ((w[:, None] * (v != 0)).sum(axis=0) + 1)
        bad[1] = np.minimum(bad[1], 0.002)
        if abs(prior - last) < 1e-6:
            break
    p = posterior()
    assert np.abs(p - got.p_good).max() < 1e-9 and ((p >= 0.5) & ~got.base_failed).tolist() == got.kept.tolist()
    failed = (got.n_words < 50) | (2 * got.n_repeat_words > got.n_words)
    assert failed.tolist() == got.base_failed.tolist() and 0 < got.kept.sum() < len(got)


def test_verdicts_follow_labels(spark):
    from kpimill.llm.quality_rules import quality_verdicts

    d = "/root/testdata/sf0.01"
    got = quality_verdicts(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] and n.get((0, True), 0) <= 0.2 * n[0, False]


def test_classifier_on_held_out_rows(spark):
    from kpimill.llm.queries import op8_compression_quality

    d = "/root/testdata/sf0.01"
    got = op8_compression_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.values, got[got.quality == 0].score.values
    assert (good[:, None] > bad[None]).mean() > 0.85 and (got.predicted == got.quality).mean() > 0.9


def test_classifier_edges(spark, edge):
    from kpimill.llm.compression_classifier import score_quality

    labels = edge.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit("x").alias("h"))
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 7), (None, 1), (4, 0), (99, 1), (5, 1), (7, 0)], "doc_id long, quality int")
    for t in (labels, labels.limit(0), labels.where("quality = 1"), odd):
        got = score_quality(clashing(edge), t).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert score_quality(empty(spark), labels).count() == score_quality(empty(spark), labels.limit(0)).count() == 0


def test_dictionaries_hold_some_of_every_sampled_text():
    from kpimill.llm.compression_classifier import STRETCH, dictionary, stretches

    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 40, 700, *rng.integers(1000, 9000, 300))]
    got = dictionary(texts, 300_000)
    assert 290_000 < len(got) <= 300_000
    for t in filter(None, texts):
        assert any(t[k : k + 16] in got for k in range(0, max(1, len(t) - 16)))
        parts = stretches(t, 990)
        assert sum(map(len, parts)) <= 990 and (t in got if len(t) < 900 else t.startswith(parts[0]) and t.endswith(parts[-1]) and len(parts) == 990 // STRETCH and parts[1] in got)


def test_classifier_against_plain_code(spark):
    """The score is the logistic function of the difference that zstandard itself gives."""
    import math

    import zstandard

    from kpimill.llm.compression_classifier import BLOCK, LEVEL, fit, score_quality

    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    long = docs.limit(1).select(F.lit(10_000).cast("long").alias("doc_id"), F.repeat(F.col("text"), 400).alias("text"))
    m = fit(docs, labels)
    both = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for x in (m.good, m.bad)]
    rows = docs.select("doc_id", "text").union(long)
    texts = {r.doc_id: (r.text or "").encode() for r in rows.collect()}
    got = {r.doc_id: r.score for r in score_quality(rows, labels, model=m).collect()}
    assert got.keys() == texts.keys() and m.weights[1] > 0 and len(set(got.values())) > 50
    for i, t in texts.items():
        good, bad = (sum(len(c.compress(t[k : k + BLOCK])) for k in range(0, len(t), BLOCK)) for c in both)
        assert abs(got[i] - 1 / (1 + math.exp(-m.weights[0] - m.weights[1] * (bad - good) / max(1, len(t))))) < 1e-9


def test_classifier_sample_is_bounded_and_moves_no_other_text(spark):
    from kpimill.llm.compression_classifier import labelled_sample

    docs = spark.range(400).select((F.col("id") % 200).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    got = labelled_sample(docs, labels, 20)
    assert collections.Counter(q for q, _ in got).keys() <= {0, 1} and 0 < len(got) <= 40 and len({t for _, t in got}) == len(got)
    assert got == labelled_sample(docs.repartition(5), labels.repartition(3), 20)


# --- language ---


def test_languages_on_held_out_rows(spark):
    from kpimill.llm.queries import op9_nearest_centroid_language

    d = "/root/testdata/sf0.01"
    got = op9_nearest_centroid_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.rejected.mean() < 0.02


def test_language_edges(edge, real):
    from kpimill.llm.language_id import fit, gram_counts, identify_languages, keep_identified

    got = identify_languages(clashing(edge), real).collect()
    assert len(got) == len(EDGE)
    for r in got:
        text = [t for i, t, *_ in EDGE if i == r.doc_id][0]
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or ""))) and 0 <= r.score <= 1
    assert {r.lang_pred for r in identify_languages(edge, real.limit(0)).collect()} == {"und"}
    kept = keep_identified(real, fit(real))
    assert kept.columns == real.columns and kept.count() >= 0.98 * real.count()
    one, many = gram_counts([b"ab cd"]), gram_counts([b"xx", b"ab cd", None, b""])
    assert (one[0] == many[1]).all() and not many[2].any()


def test_long_foreign_and_random_texts_are_rejected(spark):
    from kpimill.llm.language_id import fit, fold, identify_languages

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs.where(fold("doc_id", 5) != 0))
    r = np.random.default_rng(1)
    noise = lambda n: " ".join("".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), r.integers(2, 11))) for _ in range(n))
    foreign = [
        "De gemeente heeft dit jaar besloten dat de wegen in het noorden van het land worden hersteld voordat de winter begint. Veel mensen wachten al lang op dit besluit en hopen dat het werk snel klaar is. ",
        "Kommunen har i år bestemt at veiene nord i landet skal settes i stand før vinteren kommer. Mange mennesker har ventet lenge på dette og håper at arbeidet snart blir ferdig. ",
        "Pemerintah kota tahun ini memutuskan bahwa jalan di bagian utara akan diperbaiki sebelum musim hujan tiba. Banyak orang sudah lama menunggu keputusan ini dan berharap pekerjaan segera selesai. ",
    ]
    texts = [t * 12 for t in foreign] + [noise(n) for n in (300, 300, 3000, 3000)]
    got = identify_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), docs, model=model).collect()
    assert len(got) == len(texts) and all(x.rejected for x in got)
    held = identify_languages(docs.where(fold("doc_id", 5) == 0), docs, model=model).toPandas()
    assert held.rejected.mean() <= 0.01


def test_numbers_are_no_letters(spark, real):
    from kpimill.llm.language_id import identify_languages

    texts = ["½ ² Ⅷ", "x", "_ 12", "①", "ª", "漢"]
    got = {r.doc_id: r.lang_pred for r in identify_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), real).collect()}
    assert [got[k] == "und" for k in range(6)] == [True, False, True, True, False, False]


@pytest.mark.parametrize("unseen", ["de", "en", "es", "fr"])
def test_an_unseen_language_is_rejected(spark, unseen):
    from kpimill.llm.language_id import fit, fold, identify_languages

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs.where((fold("doc_id", 5) != 0) & (F.col("lang") != unseen)))
    got = identify_languages(docs, docs, model=model).join(docs.select("doc_id", "lang", (fold("doc_id", 5) == 0).alias("held")), "doc_id").where("lang_pred <> 'und'").toPandas()
    assert got[got.lang == unseen].rejected.mean() >= 0.9 and got[(got.lang != unseen) & got.held].rejected.mean() <= 0.02


def test_languages_against_plain_tf_idf(spark, real):
    """Vectors and cosines by dictionaries of n-grams instead of binned arrays."""
    from kpimill.llm.language_id import BINS, fit, gram_counts, identify_languages

    m = fit(real)
    texts = {r.doc_id: r.text for r in real.select("doc_id", "text").limit(40).collect()} | {900: "Größe und ÉTÉ  1x", 901: "a" * 3, 902: "lorem ipsum " * 100_000}
    got = {r.doc_id: r for r in identify_languages(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), real, model=m).collect()}
    mask = (1 << 32) - 1
    for i, t in texts.items():
        x = [b + 32 if 65 <= b < 91 else b if b >= 128 or 97 <= b < 123 else 32 for b in b" " + t.encode() + b" "]
        for k in range(1, len(x)):
            if x[k - 1] == 0xC3 and 0x80 <= x[k] <= 0x9E:
                x[k] += 32
        grams = collections.Counter()
        for k in range(len(x) - 1):
            a, b, c = x[k], x[k + 1], x[k + 2] if k + 2 < len(x) else 32
            if not (a == 32 and b == 32):
                grams[(a * 0x9E3779B1 + b * 0x85EBCA6B) & mask] += 1
            if not (a == 32 and b == 32) and not (b == 32 and c == 32):
                grams[(a * 0xC2B2AE35 + b * 0x27D4EB2F + c * 0x165667B1 + 77) & mask] += 1
        counts = np.zeros(BINS)
        for g, n in grams.items():
            counts[(((g ^ (g >> 15)) * 0x2C1B3C6D) & mask) >> 20] += n
        counts[0] = 0
        if i in (900, 901):
            assert np.abs(counts - gram_counts([t.encode()])[0]).sum() <= 2  # the ends of a text have blanks of the array's own
        v = np.sqrt(counts) * m.idf
        cos = m.centroids @ (v / max(np.linalg.norm(v), 1e-12))
        if got[i].lang_pred != "und":
            assert got[i].lang_pred == m.languages[int(np.argmax(cos))] or np.sort(cos)[-1] - np.sort(cos)[-2] < 0.02
            assert abs(got[i].score - cos.max()) < 0.02


# --- neighbours ---


def brute(rows, every, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in sorted({i for i in ids if i % every == 0}):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        o = [j for j in np.lexsort((ids, d)) if np.isfinite(d[j])][:k]
        out[q] = [(ids[j], d[j]) for j in o]
    return out


def test_neighbours(spark):
    from kpimill.llm.permutation_index import nearest_neighbours

    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    want = brute(rows, 20, 10)
    got = collections.defaultdict(list)
    for r in nearest_neighbours(clashing(e), every=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values()) and hits >= 0.9 * 10 * len(want)


def test_neighbours_edges(spark):
    from kpimill.llm.permutation_index import nearest_neighbours

    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, []), (9, [1.0]), (20, [1.0, 0.5]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, round(r.score, 6)) for r in nearest_neighbours(df, every=20).collect()}
    assert got == {(0, 1): (1, 0.0), (0, 2): (2, 0.0), (0, 3): (20, 0.5), (0, 4): (3, 1.414214), (20, 1): (0, 0.5), (20, 2): (1, 0.5), (20, 3): (2, 0.5), (20, 4): (3, 1.118034)}
    assert nearest_neighbours(df.limit(0)).count() == 0


# --- token files ---


def test_separator_scan(spark, edge, real, tmp_path):
    from kpimill.llm.token_counts import document_token_counts, scan_token_files
    from kpimill.llm.tokens import default_path, encoder

    enc = encoder(default_path(), True)
    df = real.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    assert document_token_counts(empty(spark), f"file://{tmp_path}/empty").count() == 0
    got = collections.Counter((r.doc_id, r.n_tokens) for r in document_token_counts(clashing(df), f"file://{tmp_path}/a").collect())
    assert got == collections.Counter((r.doc_id, len(enc(r.text or ""))) for r in df.collect())
    (tmp_path / "b").mkdir()
    ids = [5, 6, 9, 9, 7] * 3 + [8] * 50 + [9, 4]
    np.array(ids, "<u2").tofile(tmp_path / "b" / "x.bin")
    (tmp_path / "b" / "none.bin").write_bytes(b"")
    want, first = [], 0
    for k, v in enumerate([*ids, 9]):
        if v == 9:
            want.append((len(want), first, k - first))
            first = k + 1
    for block in (2, 7, 20, 1 << 20):
        rows = scan_token_files(spark, f"file://{tmp_path}/b", end=9, block=block).orderBy("doc_no").collect()
        assert [(r.doc_no, r.first_token, r.n_tokens) for r in rows] == want
    (tmp_path / "b" / "odd.bin").write_bytes(b"abc")
    with pytest.raises(ValueError):
        scan_token_files(spark, f"file://{tmp_path}/b")
