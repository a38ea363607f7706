"""DuckDB SQL for the queries of the catalogue."""

from __future__ import annotations

_F1 = """
b AS (
 SELECT n.n_regionkey AS doc_id, l.l_orderkey % 8 AS chunk_no, n.n_name AS fund, CAST(year(l.l_shipdate) AS VARCHAR) AS year,
  CASE WHEN p.p_size <= 25 THEN p.p_type ELSE concat(p.p_type, ' ', p.p_brand) END AS metric,
  CASE WHEN l.l_discount < 0.02 THEN NULL ELSE l.l_quantity END AS value, concat('Sida ', CAST(l.l_linenumber AS VARCHAR)) AS source,
  l.l_tax AS certainty, l.l_returnflag AS comment, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice
 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey),
f AS (SELECT doc_id, chunk_no, fund, year, metric, value, source, certainty, comment,
 row_number() OVER (ORDER BY doc_id, chunk_no, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq FROM b)"""
_MERGED = """
merged AS (SELECT fund, year, metric, arg_min(value, seq) FILTER (WHERE value IS NOT NULL) AS value, arg_min(source, seq) FILTER (WHERE source IS NOT NULL) AS source,
 arg_min(certainty, seq) FILTER (WHERE certainty IS NOT NULL) AS certainty, arg_min(comment, seq) FILTER (WHERE comment IS NOT NULL) AS comment FROM f GROUP BY fund, year, metric)"""
_DEFS = """
defs AS (SELECT CAST(dense_rank() OVER (ORDER BY p_type) AS INT) AS metric_ord, p_type AS metric, coalesce(CASE WHEN split_part(p_type, ' ', -1) <> 'STEEL' THEN split_part(p_type, ' ', -1) END, '🧩 Övrigt') AS grp FROM (SELECT DISTINCT p_type FROM part)),
groups AS (SELECT *, min(metric_ord) OVER (PARTITION BY grp) AS grp_ord FROM defs),
reg AS (SELECT concat('F', CAST(n_nationkey AS VARCHAR)) AS short_name, n_name AS official_name FROM nation WHERE n_nationkey % 2 = 0)"""
_DENSE = """
pairs AS (SELECT DISTINCT year, fund FROM merged),
dense AS (SELECT p.year, p.fund, coalesce(r.short_name, p.fund) AS short_name, g.grp_ord, g.grp, g.metric_ord, g.metric, m.value, coalesce(m.source, '') AS source
 FROM pairs p CROSS JOIN groups g LEFT JOIN merged m ON m.year = p.year AND m.fund = p.fund AND m.metric = g.metric LEFT JOIN reg r ON r.official_name = p.fund)"""
_CELLS = """
nn AS (SELECT * FROM f WHERE value IS NOT NULL),
firsts AS (SELECT *, first_value((value, source, certainty, comment)) OVER w AS f0, row_number() OVER w = 1 AS is_first FROM nn WINDOW w AS (PARTITION BY {keys} ORDER BY seq)),
marked AS (SELECT *, max(CASE WHEN (value, source, certainty, comment) IS DISTINCT FROM f0 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS conflict FROM firsts),
cells AS (SELECT *, max(conflict) OVER (PARTITION BY {keys}) AS in_conflict FROM marked),
listed AS (SELECT * FROM cells WHERE in_conflict = 1 AND (conflict = 1 OR is_first))"""
_CONS = """
toks AS (SELECT {keys}, value, seq, certainty, comment, trim(unnest(string_split(replace(source, 'Sida', ''), ','))) AS tok FROM listed),
byval AS (SELECT {keys}, value, min(seq) AS first_seq, max(seq) AS last_seq, list_sort(list_distinct(list(tok) FILTER (WHERE tok <> ''))) AS parts FROM toks GROUP BY ALL),
cons AS (SELECT {keys}, arg_max(value, first_seq) AS value, concat('Sida ', array_to_string(arg_max(parts, first_seq), ', ')) AS source, max(last_seq) AS last_seq, CAST(sum(greatest(len(parts) - 1, 0)) AS BIGINT) AS n_consolidated FROM byval GROUP BY {keys}),
consolidated AS (SELECT {ckeys}, c.value, c.source, l.certainty, l.comment, c.n_consolidated FROM cons c JOIN listed l ON l.seq = c.last_seq)"""
_F2 = """
v AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page_no,
 CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN 2 ELSE 1 END AS vote FROM events)"""
_F3 = """
y AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS page_no,
 CASE WHEN l_linenumber = 7 THEN 'no date here' ELSE concat('Year ', CAST(year(l_shipdate) AS VARCHAR), ', ', CAST(year(o_orderdate) AS VARCHAR),
  CASE WHEN l_linenumber % 2 = 0 THEN concat(', ', CAST(year(o_orderdate) AS VARCHAR)) ELSE '' END) END AS text
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_YV = """
ys AS (SELECT doc_id, page_no, unnest(regexp_extract_all(text, '(19|20)[0-9]{2}')) AS yy FROM y),
yc AS (SELECT doc_id, page_no, yy, count(*) AS n FROM ys GROUP BY ALL),
yt AS (SELECT doc_id, page_no, max(n) AS m FROM yc GROUP BY ALL),
yb AS (SELECT yc.doc_id, yc.page_no, count(*) AS k, max(CAST(yy AS INT)) AS yy FROM yc JOIN yt USING (doc_id, page_no) WHERE n = m GROUP BY ALL),
yv AS (SELECT y.doc_id, y.page_no, CASE WHEN k IS NULL THEN -1 WHEN k > 1 THEN -2 ELSE yy END AS vote FROM y LEFT JOIN yb USING (doc_id, page_no))"""
_STOP = """
val AS (SELECT * FROM {src} WHERE vote IS NOT NULL),
run AS (SELECT *, count(*) OVER (PARTITION BY doc_id, vote ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS c, count(*) OVER (PARTITION BY doc_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS n FROM val),
lead AS (SELECT *, max(c) OVER (PARTITION BY doc_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS m FROM run),
stops AS (SELECT doc_id, min(page_no) AS stop FROM lead WHERE page_no >= 5 AND m / n >= 0.8 GROUP BY doc_id),
cut AS (SELECT s.* FROM {src} s LEFT JOIN stops USING (doc_id) WHERE stop IS NULL OR page_no <= stop)"""
_MODE = """
cnt AS (SELECT doc_id, vote, count(vote) AS n, min(page_no) AS first FROM {src} GROUP BY doc_id, vote),
best AS (SELECT doc_id, vote FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM cnt WHERE vote IS NOT NULL) WHERE k = 1),
tot AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_votes, max(n) AS m FROM cnt GROUP BY doc_id),
mode AS (SELECT t.doc_id, coalesce(b.vote, -1) AS vote, t.n_votes, round(CASE WHEN n_votes > 0 THEN m / n_votes ELSE 0.0 END, 9) AS ratio FROM tot t LEFT JOIN best b USING (doc_id))"""
_F4 = """
t AS (SELECT doc_id, concat(text, chr(10), 'mail user', CAST(doc_id AS VARCHAR), '@mail', CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END, '.example.com end 800101-1234 DOB: 1980/01/01') AS text FROM documents)"""
_F5 = """
r AS (SELECT l_suppkey AS doc_id, p_type, l_returnflag, CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) AS q, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS e, l_linenumber,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS rn FROM lineitem JOIN part ON l_partkey = p_partkey),
lines AS (SELECT doc_id, rn * 4 AS line_no, CASE WHEN l_linenumber <= 3 THEN p_type ELSE concat('Note ', p_type) END AS line FROM r
 UNION ALL SELECT doc_id, rn * 4 + 1, q FROM r UNION ALL SELECT doc_id, rn * 4 + 2, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE e END FROM r
 UNION ALL SELECT doc_id, rn * 4 + 3, concat('text ', l_returnflag) FROM r WHERE l_linenumber % 3 = 0)"""
_EMAIL = "[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+"
_REPAIRED = r"regexp_replace(text, '(?i)(@[^\s@]*)[\r\n]+([^\s@]+\.[a-z]{2,10})', '\1\2', 'g')"
_TERMS = rf"list_distinct(list_concat(regexp_extract_all(text, '\b\d{{6}}[-+]\d{{4}}\b'), regexp_extract_all({_REPAIRED}, '{_EMAIL}'), regexp_extract_all({_REPAIRED}, '\bDOB:\s*(?:19|20)\d{{2}}/\d{{2}}/\d{{2}}\b')))"
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
_ROMAN = "concat(repeat('M', CAST(floor({n} / 1000) AS INT)), ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][CAST(floor({n} / 100) AS INT) % 10 + 1], ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][CAST(floor({n} / 10) AS INT) % 10 + 1], ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][CAST({n} AS INT) % 10 + 1])"
_K = "doc_id, year, metric"


def _with(*parts: str, then: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + " " + then


def _keys(part: str, keys: str) -> str:
    return part.replace("{ckeys}", ", ".join(f"c.{k.strip()}" for k in keys.split(","))).replace("{keys}", keys)


def _src(part: str, src: str) -> str:
    return part.replace("{src}", src)


_SINGLE = _with(
    _F1, """names AS (SELECT doc_id, arg_min(fund, (-length(fund), seq)) AS unified FROM f GROUP BY doc_id)""",
    "g AS (SELECT f.* REPLACE (n.unified AS fund) FROM f JOIN names n USING (doc_id))", _keys(_CELLS, "doc_id, fund, year, metric").replace("FROM f WHERE", "FROM g WHERE"),
    _keys(_CONS, "doc_id, fund, year, metric"),
    "had AS (SELECT DISTINCT doc_id FROM consolidated)", "single AS (SELECT c.*, h.doc_id IS NOT NULL AS had FROM cells c LEFT JOIN had h USING (doc_id) WHERE is_first AND in_conflict = 0)",
    """pool AS (SELECT a.doc_id, a.fund, a.year, a.metric, concat('Sida ', string_agg(DISTINCT trim(replace(o.source, 'Sida', '')), ', ' ORDER BY trim(replace(o.source, 'Sida', '')))) AS source
 FROM single a JOIN single o ON a.doc_id = o.doc_id AND a.fund = o.fund AND a.year = o.year AND a.value = o.value AND starts_with(o.metric, a.metric) WHERE a.had GROUP BY ALL)""",
    then="""SELECT s.doc_id, s.fund, s.year, s.metric, s.value, coalesce(p.source, s.source) AS source, s.certainty, s.comment FROM single s LEFT JOIN pool p ON p.doc_id = s.doc_id AND p.fund = s.fund AND p.year = s.year AND p.metric = s.metric
 UNION ALL SELECT doc_id, fund, year, metric, value, source, certainty, comment FROM consolidated""",
)

#: break marks in order of preference, and the chunk t cut at its head and tail
_MARKS = ("concat(chr(10), chr(10))", "concat(chr(10), 'Sida ')", "concat(chr(10), 'Not ')", "concat(':', chr(10))", "concat(chr(10), chr(10), '[A-Z]')", r"'\. [A-ZÅÄÖ]'")
_HEAD = "CASE " + " ".join(f"WHEN strpos(t, {m}) BETWEEN 1 AND 201 THEN substr(t, strpos(t, {m}) + length({m}))" for m in _MARKS) + " ELSE t END"
_TAIL = "CASE " + " ".join(f"WHEN strpos(reverse(t), reverse({m})) > 0 AND strpos(reverse(t), reverse({m})) - 1 + length({m}) <= 200 THEN substr(t, 1, length(t) - strpos(reverse(t), reverse({m})) + 1)" for m in _MARKS) + " ELSE t END"

SQL: dict[str, str] = {
    "merge_first_nonnull": _with(_F1, _MERGED, then="SELECT * FROM merged"),
    "merge_first_by_row": _with(_F1, then="SELECT fund, year, metric, value, source, certainty, comment FROM (SELECT *, row_number() OVER (PARTITION BY fund, year, metric ORDER BY value IS NULL, seq) AS k FROM f) WHERE k = 1"),
    "merge_last_wins": _with(_F1, then="SELECT fund, year, metric, value, source, certainty, comment FROM (SELECT *, row_number() OVER (PARTITION BY fund, year, metric ORDER BY seq DESC) AS k FROM f) WHERE k = 1"),
    "merge_shallow": _with(_F1, "l AS (SELECT doc_id, fund, year, max(chunk_no) AS chunk_no FROM f GROUP BY ALL)", then="SELECT f.doc_id, f.fund, f.year, f.chunk_no, count(*) AS n, count(value) AS n_values FROM f JOIN l ON l.doc_id = f.doc_id AND l.fund = f.fund AND l.year = f.year AND l.chunk_no = f.chunk_no GROUP BY ALL"),
    "findings_unnest": _with(_F1, then="SELECT doc_id, chunk_no, fund, year, metric, value, source, certainty, comment FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_no, fund, year, metric ORDER BY value IS NULL, seq) AS k FROM f) WHERE k = 1"),
    "chunk_nonnull_filter": _with(_F1, then="SELECT doc_id, chunk_no, fund, year, metric, count(value) AS n_values FROM f GROUP BY ALL HAVING count(value) > 0"),
    "fund_unify": _with(_F1, then="SELECT doc_id, arg_min(fund, (-length(fund), seq)) AS unified, count(DISTINCT fund) AS n_funds FROM f GROUP BY doc_id"),
    "conflict_log": _with(_F1, _keys(_CELLS, _K), then=f"SELECT {_K}, count(*) AS n_listed, CAST(sum(conflict) AS BIGINT) AS n_conflicts, max(CASE WHEN is_first THEN value END) AS first_value FROM listed GROUP BY {_K}"),
    "conflict_consolidate": _with(_F1, _keys(_CELLS, _K), _keys(_CONS, _K), then="SELECT * FROM consolidated"),
    "consolidated_findings": _SINGLE,
    "prefix_source_pool": _with(
        _F1, "c AS (SELECT doc_id, fund, year, metric, value, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, fund, year, metric ORDER BY value IS NULL, seq) AS k FROM f) WHERE k = 1)",
        """pool AS (SELECT a.doc_id, a.fund, a.year, a.metric, concat('Sida ', string_agg(DISTINCT trim(replace(o.source, 'Sida', '')), ', ' ORDER BY trim(replace(o.source, 'Sida', '')))) AS source, count(DISTINCT trim(replace(o.source, 'Sida', ''))) - 1 AS n
 FROM c a JOIN c o ON a.doc_id = o.doc_id AND a.fund = o.fund AND a.year = o.year AND a.value = o.value AND starts_with(o.metric, a.metric) GROUP BY ALL)""",
        then="SELECT c.doc_id, c.fund, c.year, c.metric, c.value, coalesce(p.source, c.source) AS source, coalesce(p.n, 0) AS n_consolidated FROM c LEFT JOIN pool p ON p.doc_id = c.doc_id AND p.fund = c.fund AND p.year = c.year AND p.metric = c.metric",
    ),
    "report_dense": _with(_F1, _MERGED, _DEFS, _DENSE, then="SELECT * FROM dense"),
    "report_pivot": _with(_F1, _MERGED, _DEFS, _DENSE, "named AS (SELECT year, grp, metric, concat('v_', replace(lower(fund), ' ', '_')) AS fund, value FROM dense)", then="SELECT * FROM (PIVOT named ON fund USING max(value) GROUP BY year, grp, metric)"),
    "metric_groups": _with(_DEFS, then="SELECT metric, metric_ord, grp, grp_ord FROM groups"),
    "fund_short_names": _with(_DEFS, then="SELECT n_name AS fund, coalesce(short_name, n_name) AS short_name FROM nation LEFT JOIN reg ON official_name = n_name"),
    "report_sheets": _with(_F1, _MERGED, then="SELECT translate(substr(fund, 1, 31), '/\\:', '---') AS sheet, count(*) AS n_rows FROM merged GROUP BY fund"),
    "csv_report_rows": _with(_F1, _MERGED, then='SELECT fund AS "Fund", year AS "Year", metric AS "Key", value AS "Value", source AS "Source" FROM merged'),
    "vote_mode": _with(_F2, _src(_MODE, "v"), then="SELECT * FROM mode"),
    "vote_early_stop": _with(_F2, _src(_STOP, "v"), _src(_MODE, "cut"), then="SELECT mode.*, CAST(stop AS INT) AS stop FROM mode LEFT JOIN stops USING (doc_id)"),
    "page_offset": _with(_F2, "w AS (SELECT doc_id, page_no, CASE WHEN page_no % 7 = 0 THEN NULL ELSE vote - 2 END AS vote FROM v)", _src(_STOP, "w"), _src(_MODE, "cut"), then="SELECT doc_id, greatest(vote, 0) AS page_offset FROM mode"),
    "year_vote": _with(_F3, _YV, then="SELECT * FROM yv"),
    "report_year": _with(_F3, _YV, "w AS (SELECT doc_id, page_no, CASE WHEN vote >= 2000 THEN vote END AS vote FROM yv)", _src(_STOP, "w"), _src(_MODE, "cut"), then="SELECT doc_id, CASE WHEN vote >= 0 THEN vote END AS report_year FROM mode"),
    "vote_parse": "SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 130 <= 99 THEN CAST(event_id % 130 AS INT) END AS page_vote, CAST(CASE WHEN 1500 + event_id % 1000 >= 2000 THEN 1500 + event_id % 1000 END AS INT) AS year_vote FROM events",
    "pii_emails": f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{_EMAIL}'))) AS email FROM documents",
    "pii_terms": _with(_F4, then=f"SELECT doc_id, unnest({_TERMS}) AS term FROM t"),
    "pii_handles": _with(_F4, then="SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '@[A-Za-z0-9_]{1,15}'))) AS term FROM t"),
    "pii_redact": _with(
        _F4, f"m AS (SELECT doc_id, text, {_TERMS} AS terms FROM t)", "o AS (SELECT *, list_transform(list_sort(list_transform(terms, lambda x: {'n': -length(x), 'x': x})), lambda y: y.x) AS longest_first FROM m)",
        then="SELECT doc_id, list_reduce(longest_first, lambda a, x: regexp_replace(a, concat('(?i)', regexp_escape(x)), '#', 'g'), text) AS text, len(terms) AS n_terms FROM o",
    ),
    "redact_by_terms": f"SELECT doc_id, CAST(length(text) - coalesce(list_sum(list_transform(m, lambda x: length(x) - 1)), 0) AS BIGINT) AS n_chars, len(list_distinct(m)) AS n_terms FROM (SELECT doc_id, text, regexp_extract_all(text, '{_EMAIL}') AS m FROM documents)",
    "email_repair": _with(_F4, then=f"SELECT doc_id, {_REPAIRED} AS text FROM t"),
    "mirror_dedup": "SELECT p_partkey, CASE WHEN length(p_name) >= 2 THEN p_name ELSE concat(p_name, ' ', upper(p_name)) END AS twice, concat(p_name, ' ', p_brand) AS other FROM part",
    "hyphen_norm": r"SELECT p_partkey, regexp_replace(concat(p_name, ' -  ', p_brand), '\s*-\s*', '-', 'g') AS name FROM part",
    "entity_clean": r"SELECT p_partkey, 'Kassan' AS entity FROM part UNION ALL SELECT p_partkey, regexp_replace(concat(p_brand, ' - x'), '\s*-\s*', '-', 'g') FROM part",
    "name_terms": "SELECT o_orderkey AS doc_id, c_mktsegment AS term FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "ner_windows": "SELECT doc_id, CAST(s AS INT) AS start, CAST(length(part) AS INT) AS n, md5(part) AS digest FROM (SELECT doc_id, s, substr(text, CAST(s + 1 AS BIGINT), 512) AS part FROM (SELECT doc_id, text, unnest(range(0, length(text), 512)) AS s FROM documents))",
    "redaction_boxes": "SELECT l_orderkey AS doc_id, l_linenumber AS page_no, l_quantity AS x0, round(l_extendedprice - 1, 4) AS y0, l_quantity + 5 AS x1, round(l_extendedprice + 9, 4) AS y1 FROM lineitem",
    "chunk_overlap": f"SELECT doc_id, CAST(k AS INT) AS chunk_no, CAST(len(c) AS INT) AS n, md5(array_to_string(c, ' ')) AS digest FROM (SELECT doc_id, k, w[CAST(k * 90 + 1 AS BIGINT) : CAST(k * 90 + 100 AS BIGINT)] AS c FROM (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 100 THEN 1 ELSE 1 + CAST(ceil((len(w) - 100) / 90.0) AS BIGINT) END)) AS k FROM (SELECT doc_id, {_WORDS} AS w FROM documents)))",
    "chunk_greedy": f"SELECT doc_id, CAST(k AS INT) AS chunk_no, CAST(len(c) AS INT) AS n, md5(array_to_string(c, ' ')) AS digest FROM (SELECT doc_id, k, w[CAST(k * 120 + 1 AS BIGINT) : CAST(k * 120 + 120 AS BIGINT)] AS c FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 120.0) AS BIGINT))) AS k FROM (SELECT doc_id, {_WORDS} AS w FROM documents)))",
    "chunk_greedy_cost": _with(
        f"w AS (SELECT doc_id, {_WORDS} AS w FROM documents)",
        "g AS (SELECT doc_id, list_reduce(w, lambda a, x: struct_pack(used := CASE WHEN a.used + length(x) >= 600 THEN 0 ELSE a.used + length(x) END, ends := CASE WHEN a.used + length(x) >= 600 THEN list_append(a.ends, a.n + 1) ELSE a.ends END, n := a.n + 1), struct_pack(used := 0::BIGINT, ends := []::BIGINT[], n := 0::BIGINT)) AS a, w FROM w WHERE len(w) > 0)",
        "e AS (SELECT doc_id, w, CASE WHEN coalesce(a.ends[-1], 0) < len(w) THEN list_append(a.ends, len(w)) ELSE a.ends END AS ends FROM g)",
        "c AS (SELECT doc_id, k, w[CASE WHEN k > 1 THEN ends[k - 1] ELSE 0 END + 1 : ends[k]] AS c FROM (SELECT *, unnest(range(1, len(ends) + 1)) AS k FROM e))",
        then="SELECT doc_id, CAST(k - 1 AS INT) AS chunk_no, CAST(len(c) AS INT) AS n, md5(array_to_string(c, ' ')) AS digest FROM c",
    ),
    "chunk_safe_break": "WITH p AS (SELECT c_custkey, c_name AS a, c_mktsegment AS b FROM customer) SELECT c_custkey, 0 AS chunk_no, concat('head:', chr(10), a, ':', chr(10)) AS chunk FROM p UNION ALL SELECT c_custkey, 1, concat('1 head:', chr(10), a, ':', chr(10)) FROM p UNION ALL SELECT c_custkey, 2, concat(a, ':', chr(10), 'row ', b) FROM p",
    "chunk_safe_break_documents": _with(
        r"w AS (SELECT doc_id, regexp_extract_all(replace(text, '. ', concat(':', chr(10))), '\S+\s*') AS w FROM documents)",
        "n AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 100 THEN 1 ELSE 1 + CAST(ceil((len(w) - 100) / 90.0) AS BIGINT) END AS n FROM w)",
        "c AS (SELECT doc_id, n, k, array_to_string(w[CAST(k * 90 + 1 AS BIGINT) : CAST(k * 90 + 100 AS BIGINT)], '') AS t FROM (SELECT *, unnest(range(0, n)) AS k FROM n))",
        f"h AS (SELECT doc_id, n, k, CASE WHEN k > 0 THEN {_HEAD} ELSE t END AS t FROM c)", f"s AS (SELECT doc_id, k, CASE WHEN k < n - 1 THEN {_TAIL} ELSE t END AS t FROM h)",
        then="SELECT doc_id, CAST(k AS INT) AS chunk_no, length(t) AS n_chars, md5(t) AS digest FROM s",
    ),
    "token_count": f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_tokens FROM documents",
    "page_label": "SELECT o_orderkey, CASE WHEN o_orderkey % 60 + 1 - 5 > 0 THEN CAST(o_orderkey % 60 - 4 AS VARCHAR) ELSE " + _ROMAN.format(n="(o_orderkey % 60 + 1)") + " END AS label, CASE WHEN o_orderkey % 3999 > 0 THEN " + _ROMAN.format(n="(o_orderkey % 3999)") + " ELSE '' END AS roman FROM orders",
    "page_assembly": _with(_F3, "l AS (SELECT doc_id, page_no, CASE WHEN page_no - doc_id % 3 > 0 THEN CAST(page_no - doc_id % 3 AS VARCHAR) ELSE ['I', 'II', 'III'][CAST(page_no AS INT)] END AS label, text FROM y)", then="SELECT doc_id, string_agg(concat('[Sida ', label, ']', chr(10), text), concat(chr(10), chr(10)) ORDER BY page_no) AS text FROM l GROUP BY doc_id"),
    "has_text": _with(_F5, then="SELECT doc_id, doc_id % 2 = 0 AS has_text FROM lines GROUP BY doc_id"),
    "term_list": "SELECT p_type AS term FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT lower(p_type) FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT concat('x ', p_type) FROM (SELECT DISTINCT p_type FROM part)",
    "header_lines": _with(_F5, then="SELECT doc_id, line_no, line FROM lines l WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT p_type FROM part) p WHERE starts_with(lower(l.line), lower(p.p_type)))"),
    "line_repair": _with(
        _F5, "k AS (SELECT *, line = '' OR regexp_full_match(line, '[0-9 ]+') AS soft FROM lines)",
        "i AS (SELECT *, count(*) FILTER (WHERE NOT soft) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM k)",
        "h AS (SELECT *, coalesce(max(CASE WHEN NOT soft THEN EXISTS (SELECT 1 FROM part p WHERE p.p_type = i.line) END) OVER (PARTITION BY doc_id, island), false) AS joins FROM i)",
        then="SELECT doc_id, line_no, line, 0 AS n_joined FROM h WHERE NOT joins UNION ALL SELECT doc_id, min(line_no), string_agg(line, ' | ' ORDER BY line_no) FILTER (WHERE line <> ''), count(*) FILTER (WHERE line <> '') - 1 FROM h WHERE joins GROUP BY doc_id, island",
    ),
    "ocr_choose": "SELECT doc_id, md5(CASE WHEN length(trim(b.text, E' \\t\\n\\r')) > 1.5 * length(trim(d.text, E' \\t\\n\\r')) THEN b.text ELSE d.text END) AS digest FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40",
    "source_normalize": "WITH s AS (SELECT DISTINCT l_linenumber AS a, l_partkey % 12 AS b FROM lineitem) SELECT concat('Sida ', CAST(a AS VARCHAR), ', ,Sida ', CAST(b AS VARCHAR)) AS raw, concat('Sida ', array_to_string(list_sort(list_distinct([CAST(a AS VARCHAR), CAST(b AS VARCHAR)])), ', ')) AS fixed, 3 AS n FROM s",
    "sheet_name": "SELECT p_partkey, replace(replace(substr(concat(p_type, '/', p_brand, ':', p_name), 1, 31), '/', '-'), ':', '-') AS sheet FROM part",
    "valid_numeric": "WITH x AS (SELECT DISTINCT CASE l_linenumber WHEN 1 THEN concat(CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR), ' kr') WHEN 2 THEN '12 244,5' WHEN 3 THEN 'tolv' ELSE l_returnflag END AS t FROM lineitem) SELECT t, try_cast(replace(replace(replace(t, ' ', ''), 'kr', ''), ',', '.') AS DOUBLE) IS NOT NULL AS ok FROM x",
    "fence_strip": r"SELECT conv_id, turn, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM conversations",
    "json_shape_filter": "SELECT event_id FROM events WHERE event_id % 2 = 0 AND starts_with(props, '{') AND ends_with(props, '}')",
    "file_gate": "WITH f AS (SELECT DISTINCT concat(replace(p_name, ' ', '.'), ['.PDF', '.zip', '.txt', ''][CAST(p_partkey % 4 + 1 AS INT)]) AS path FROM part) SELECT path, CASE WHEN lower(path) LIKE '%.pdf' THEN 'pdf' WHEN lower(path) LIKE '%.zip' THEN 'zip' END AS kind FROM f",
    "archive_gate": "SELECT l_orderkey AS archive, count(*) AS n_members, bool_and(l_quantity <= 49) AS accepted FROM lineitem WHERE l_quantity <= 45 OR l_quantity > 49 GROUP BY l_orderkey",
}
