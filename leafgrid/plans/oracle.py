"""DuckDB twins of the queries.

Cells, shapes, names and verdicts are derived from the base tables by formula, not from
the HTML, so an error in the HTML path cannot cancel out.
"""

from leafgrid import constants as K
from leafgrid.plans.registry import CHART_COLUMNS, SEARCH_TERMS, THRESHOLDS
from leafgrid.sources.fixtures import CHUNK_PAGES, EXTENSIONS, LOST, START


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{K.WS}+|{K.WS}+$', '', 'g')"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_STARTS = " OR ".join(f"starts_with(md, {_q(p)})" for p in K.FOOTNOTE_PREFIXES)
_HINTS = " OR ".join(f"contains(md, {_q(h)})" for h in K.AXIS_HINTS)
_MIME = _values(K.MIME_TYPES.items())
_EXTS = "[" + ", ".join(_q(e) for e in EXTENSIONS) + "]"
_PROSE = " ".join(["설명문"] * 13)
_LONG = " 긴 제목" * 9
_SHOWN = "(prefix = 'f' OR (parsed_ok AND prefix IN ('t', 'c')))"

BASE = f"""
WITH ln AS (
  SELECT l_orderkey ok, l_linenumber no, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) qty, COUNT(*) n
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
rk AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY ok ORDER BY no) rn, COUNT(*) OVER (PARTITION BY ok) cnt FROM ln),
tab AS (
  SELECT ok, COUNT(*) cnt, STRING_AGG(h, '' ORDER BY no) bh, STRING_AGG(m, '' ORDER BY no) bm
  FROM (SELECT ok, no,
     '<tr>' || CASE WHEN rn = 1 THEN '<td rowspan="' || cnt || '">주문</td>' ELSE '' END ||
     '<td>' || no || '</td><td>' || qty || '</td><td>' || n || '</td></tr>' h,
     '| 주문 | ' || no || ' | ' || qty || ' | ' || n || ' |' m FROM rk) x
  GROUP BY ok),
ord AS (
  SELECT o_custkey doc_id, o_orderkey ok, o_orderpriority pr, CAST(o_orderkey % 10 AS INT) k,
    CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) - 1 i FROM orders),
j AS (
  SELECT o.*, COALESCE(t.bh, '') bh, COALESCE(t.bm, '') bm, COALESCE(t.cnt, 0) cnt,
    CAST(FLOOR(i / 2) AS INT) + 1 page, CAST(o.ok // 10 % 3 AS INT) v FROM ord o LEFT JOIN tab t ON o.ok = t.ok),
el0 AS (
  SELECT doc_id, i * 3 seq, page,
    CASE WHEN ok % 3 = 0 THEN 'caption' WHEN ok % 3 = 1 THEN 'heading1' ELSE 'paragraph' END category,
    CASE WHEN ok % 3 = 0 THEN '<표 ' || ok || '> ' || pr || ' 주문'
         WHEN ok % 3 = 1 THEN '# ' || pr || CASE WHEN ok % 4 = 0 THEN '{_LONG}' ELSE '' END
         ELSE '본문 ' || pr END markdown, '' html FROM j
  UNION ALL
  SELECT doc_id, i * 3 + 1, page,
    CASE WHEN k IN (5, 6) THEN 'chart' WHEN k = 8 THEN 'figure' ELSE 'table' END,
    CASE WHEN k = 7 THEN '| 단위: 조원<br>a<br>b<br>c |' || bm WHEN k = 8 THEN ''
         WHEN k = 9 THEN '| {_PROSE} |'
         ELSE '| 구분 | 항목 | 합계 | 건수 |' || bm END,
    CASE WHEN k = 6 THEN '<figure><p>no data</p></figure>'
         WHEN k = 8 THEN '<figure><figcaption><p class="figure-type">diagram, ' || pr || '</p><p class="figure-description">흐름 흐름 흐름 | ' || ok || '</p></figcaption></figure>'
         WHEN bh = '' THEN '<table></table>'
         WHEN v = 1 THEN '<TABLE class="t"><!-- x > y --><TR><TH scope="col">구분</TH><TH>항목</TH><TH>합계</TH><TH>건수</TH></TR><tbody><tr style="display: none"><td>숨김</td></tr>' || bh || '</tbody></TABLE>'
         WHEN v = 2 THEN '<table><thead><tr><th>kind</th><th>line</th><th>sum</th><th>count</th></tr></thead><tbody>' || replace(bh, '주문', '&#111;rder') || '</tbody></table>'
         ELSE '<table><thead><tr><th rowspan="2">구분</th><th rowspan="2">항목</th><th colspan="2">수량</th></tr><tr><th>합계</th><th>건수</th></tr></thead><tbody>' || bh || '</tbody></table>' END FROM j
  UNION ALL
  SELECT doc_id, i * 3 + 2, page, CASE WHEN ok % 4 = 0 THEN 'table' ELSE 'paragraph' END,
    CASE WHEN ok % 4 = 0 THEN '| 주: | 합계 기준 |' ELSE '문단 ' || pr END,
    CASE WHEN ok % 4 = 0 THEN '<table><tr><td>주:</td><td>합계 기준</td></tr></table>' ELSE '' END FROM j),
el AS (
  SELECT CAST(doc_id AS BIGINT) doc_id, CAST(seq AS INT) seq, page, category, markdown, html FROM el0),
trimmed AS (SELECT *, {_strip("markdown")} md FROM el),
lab AS (
  SELECT *, CASE WHEN category = 'chart' THEN 'chart' WHEN category = 'figure' THEN 'figure'
    WHEN category <> 'table' THEN 'other' WHEN {_STARTS} THEN 'footnote'
    WHEN (length(md) - length(replace(md, '<br>', ''))) / 4 >= {K.CHART_BR_COUNT} AND ({_HINTS}) THEN 'chart_misid'
    WHEN length(md) > {K.PROSE_LENGTH} AND
      (length(md) - length(regexp_replace(md, '{K.DIGIT}', '', 'g'))) / length(md) < {K.MIN_DIGIT_SHARE} THEN 'other'
    ELSE 'real_table' END label FROM trimmed),
raw AS (
  SELECT doc_id, seq, page, category, CASE WHEN md <> '' THEN md ELSE {_strip("html")} END raw FROM trimmed),
cand AS (
  SELECT doc_id, seq, page, raw,
    COALESCE(NULLIF({_strip(f"regexp_replace(raw, '{K.CAPTION_PREFIX}', '')")}, ''), raw) caption
  FROM raw WHERE raw <> '' AND (category = 'caption' OR (category = 'heading1' AND length(raw) < {K.HEADING_LENGTH}))),
vis AS (
  SELECT CAST(doc_id AS BIGINT) doc_id, i * 3 + 1 AS seq, i, page, ok, pr, k, v, CASE v WHEN 0 THEN 2 ELSE 1 END n_head, cnt,
    CASE WHEN k <= 4 THEN 'real_table' WHEN k <= 6 THEN 'chart' WHEN k = 7 THEN 'chart_misid'
         WHEN k = 8 THEN 'figure' ELSE 'other' END label,
    CASE WHEN k <= 4 THEN 't' WHEN k <= 7 THEN 'c' WHEN k = 8 THEN 'f' END prefix,
    k NOT IN (6, 8) AND cnt > 0 parsed_ok FROM j),
near AS (
  SELECT v.doc_id, v.seq, arg_max(c.caption, c.seq) caption FROM vis v JOIN cand c
    ON c.doc_id = v.doc_id AND c.page = v.page AND c.seq BETWEEN v.seq - {K.CAPTION_LOOKBACK} AND v.seq - 1
  GROUP BY v.doc_id, v.seq),
numbered AS (
  SELECT v.*, n.caption, CAST(ROW_NUMBER() OVER (PARTITION BY v.doc_id, v.prefix ORDER BY v.seq) AS INT) - 1 idx
  FROM vis v LEFT JOIN near n USING (doc_id, seq) WHERE v.prefix IS NOT NULL),
slugged AS (
  SELECT *, COALESCE(NULLIF(substring(trim(replace(regexp_replace(trim(regexp_replace(
      {_strip("nfc_normalize(COALESCE(caption, CASE prefix WHEN 't' THEN 'table' WHEN 'c' THEN 'chart' ELSE 'figure' END || '-p' || page))")},
      '{K.SLUG_BANNED}', '', 'g'), ''), ' +', ' ', 'g'), ' ', '-'), '-'), 1, {K.SLUG_LENGTH}), ''), '{K.UNTITLED}') slug
  FROM numbered),
assets AS (
  SELECT *, CASE prefix WHEN 't' THEN 'table' WHEN 'c' THEN 'chart' ELSE 'figure' END kind,
    printf('%s%02d_p%d_%s.%s', prefix, idx, page, slug, CASE WHEN parsed_ok THEN 'csv' ELSE 'html' END) "name",
    CASE WHEN parsed_ok THEN CAST(cnt AS INT) END n_rows, CASE WHEN parsed_ok THEN 4 END n_cols,
    CASE WHEN k = 8 THEN 'diagram, ' || pr END figure_type,
    CASE WHEN k = 8 THEN '흐름 흐름 흐름 | ' || ok END description FROM slugged),
boundary AS (
  SELECT doc_id, seq, page, idx AS "index",
    CASE WHEN NOT parsed_ok AND prefix = 't' THEN '{K.TABLE_FAILED}{K.PARSE_ERROR}'
         WHEN NOT parsed_ok THEN '{K.CHART_FAILED}{K.PARSE_ERROR}: {K.PARSE_MESSAGE}'
         ELSE '{K.CHART_LIKE}' END reason,
    CASE WHEN NOT parsed_ok THEN "name" END fallback_path
  FROM assets WHERE prefix IN ('t', 'c') AND (NOT parsed_ok OR label = 'chart_misid')),
notes AS (SELECT doc_id, seq, page, md markdown FROM lab WHERE label = 'footnote'),
data AS (SELECT * FROM vis WHERE parsed_ok AND prefix IN ('t', 'c')),
heads AS (
  SELECT * FROM (VALUES {_values([(0, 0, 0, "구분"), (0, 0, 1, "항목"), (0, 0, 2, "수량"), (0, 0, 3, "수량"),
                                  (0, 1, 0, "구분"), (0, 1, 1, "항목"), (0, 1, 2, "합계"), (0, 1, 3, "건수"),
                                  (1, 0, 0, "구분"), (1, 0, 1, "항목"), (1, 0, 2, "합계"), (1, 0, 3, "건수"),
                                  (2, 0, 0, "kind"), (2, 0, 1, "line"), (2, 0, 2, "sum"), (2, 0, 3, "count")])}) t(v, "row", col, "text")),
bodies AS (
  SELECT d.doc_id, d.seq, d.page, d.label, d.ok, d.v, d.n_head, CAST(r.rn - 1 + d.n_head AS INT) "row", c.col,
    CASE c.col WHEN 0 THEN CASE d.v WHEN 2 THEN 'order' ELSE '주문' END WHEN 1 THEN CAST(r.no AS VARCHAR)
      WHEN 2 THEN CAST(r.qty AS VARCHAR) ELSE CAST(r.n AS VARCHAR) END "text", r.no, r.qty, r.n
  FROM data d JOIN rk r ON r.ok = d.ok CROSS JOIN (VALUES (0), (1), (2), (3)) c(col)),
cells AS (
  SELECT d.doc_id, d.seq, h."row", h.col, true is_header, h."text" FROM data d JOIN heads h ON h.v = d.v
  UNION ALL SELECT doc_id, seq, "row", col, false, "text" FROM bodies),
docs AS (
  SELECT CAST(o_custkey AS BIGINT) doc_id, CAST((COUNT(*) - 1) // 2 + 1 AS INT) n_pages,
    'report-' || o_custkey || CASE WHEN o_custkey % 5 = 0 THEN '.hwp' ELSE '.pdf' END "name",
    o_custkey % 5 <> 0 is_pdf, CASE WHEN o_custkey % 3 <> 2 THEN 'parse-' || (o_custkey % 3) END model
  FROM orders GROUP BY o_custkey),
meta AS (SELECT *, sha256("name") sha, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE n_pages END usage_pages FROM docs),
flags AS (
  SELECT doc_id, page, prefix = 't' AND parsed_ok t, prefix = 'c' AND parsed_ok c, prefix = 'f' f, false n
  FROM vis WHERE prefix IS NOT NULL
  UNION ALL SELECT doc_id, page, false, false, false, true FROM notes),
counts AS (
  SELECT m.doc_id, COUNT(*) FILTER (t) tables, COUNT(*) FILTER (c) charts, COUNT(*) FILTER (f) figures,
    COUNT(*) FILTER (n) footnotes FROM meta m LEFT JOIN flags USING (doc_id) GROUP BY m.doc_id),
chunked AS (
  SELECT doc_id, CAST((page - 1) // {CHUNK_PAGES} AS INT) chunk_no, seq, page, category, markdown, html FROM el),
chunks AS (
  SELECT doc_id, chunk_no, CASE WHEN chunk_no % 3 <> 2 THEN 'parse-' || chunk_no END model,
    CAST(MAX(page) - chunk_no * {CHUNK_PAGES} AS INT) pages, CAST(COUNT(*) AS INT) n_elements,
    STRING_AGG(html, chr(10) ORDER BY seq) html, STRING_AGG(markdown, chr(10) ORDER BY seq) markdown
  FROM chunked GROUP BY doc_id, chunk_no),
asked AS (
  SELECT doc_id, is_pdf, n_pages, CASE doc_id % 8 WHEN 0 THEN [1, 1] WHEN 1 THEN [1, 2] WHEN 2 THEN [2, 3]
    WHEN 3 THEN [0, 1] WHEN 4 THEN [3, 2] WHEN 5 THEN [1, 99] WHEN 6 THEN [NULL, NULL] END r FROM docs),
ranges AS (
  SELECT doc_id, CASE WHEN r IS NULL OR NOT is_pdf THEN 'all'
      WHEN r[1] >= 1 AND r[2] <= n_pages AND r[1] <= r[2] THEN 'range' ELSE 'invalid' END status,
    CASE WHEN status = 'range' THEN r[1] END "start", CASE WHEN status = 'range' THEN r[2] END "end",
    CASE WHEN status = 'range' THEN r[1] - 1 ELSE 0 END "offset" FROM asked),
picked AS (
  SELECT e.doc_id, e.seq, e.page, e.page - r."offset" slice_page FROM el e JOIN ranges r USING (doc_id)
  WHERE status = 'all' OR (status = 'range' AND e.page BETWEEN r."start" AND r."end")),
files AS (
  SELECT '/corpus/' || source || '/' || stem || ext path, source, stem, ext, lower(ext) ext_l,
    n_chars * 3000 size_bytes, doc_id
  FROM (SELECT *, source || '-' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '-Re' || chr(769) || 'sume' || chr(769) ELSE '' END stem,
    {_EXTS}[doc_id % 15 + 1] ext FROM documents)),
mimes AS (SELECT * FROM (VALUES {_MIME}) t(ext, mime)),
req AS (
  SELECT doc_id, substring(sha256("text"), 1, 16) sha16,
    CASE WHEN doc_id % 4 < 3 THEN 'enhanced' ELSE 'standard' END "mode", CAST(n_chars // 3000 + 1 AS INT) n_pages
  FROM documents),
entries AS (
  SELECT substring(sha256("text"), 1, 16) sha16,
    CASE WHEN doc_id % 6 <> 0 THEN CASE WHEN doc_id % 4 = 3 THEN 'standard' ELSE 'enhanced' END END "mode",
    'response-' || doc_id response, {START} + doc_id * 3600 ts FROM documents WHERE doc_id % 3 = 0),
fresh AS (
  SELECT substring(sha256("text"), 1, 16) sha16, CASE WHEN doc_id % 4 = 0 THEN 'enhanced' ELSE 'standard' END "mode",
    'response-' || doc_id response, {START} + doc_id * 3600 ts FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0),
usable AS (
  SELECT r.doc_id, e."mode" IS NOT NULL exact, e.response,
    ROW_NUMBER() OVER (PARTITION BY r.doc_id ORDER BY (e."mode" IS NOT NULL) DESC, e.ts DESC) rn
  FROM req r JOIN entries e ON e.sha16 = r.sha16
    AND (e."mode" = r."mode" OR (e."mode" IS NULL AND r."mode" = 'enhanced'))),
lookup AS (
  SELECT r.doc_id, r.sha16, r."mode", u.doc_id IS NOT NULL hit,
    CASE WHEN u.exact THEN 'exact' WHEN NOT u.exact THEN 'legacy' END matched, u.response, r.n_pages
  FROM req r LEFT JOIN usable u ON u.doc_id = r.doc_id AND u.rn = 1),
wanted AS (SELECT * FROM (VALUES {_values([(t,) for t in SEARCH_TERMS])}) t(term)),
found AS (
  SELECT w.term, f.path, ROW_NUMBER() OVER (PARTITION BY w.term ORDER BY f.doc_id DESC) "rank",
    COUNT(*) OVER (PARTITION BY w.term) n
  FROM wanted w JOIN files f ON contains(lower(nfc_normalize(f.stem)), lower(nfc_normalize(w.term)))
    AND f.ext_l IN (SELECT ext FROM mimes)),
gold AS (
  SELECT CAST(doc_id AS BIGINT) doc_id, i * 3 + 1 seq, j.ok, k, v, r.qty, j.ok % 5 g,
    CASE j.ok % 5 WHEN 0 THEN CAST(r.qty AS DOUBLE) * 1.04e0 WHEN 1 THEN CAST(r.qty AS DOUBLE) * 1.1e0
      WHEN 2 THEN 0e0 ELSE CAST(r.qty AS DOUBLE) END expected
  FROM j JOIN rk r ON r.ok = j.ok AND r.rn = 1),
gold_hits AS (
  SELECT doc_id, seq, CASE WHEN g = 3 THEN '없음' ELSE '주문' END row_label, '{CHART_COLUMNS[0]}' col_name, expected,
    CASE WHEN v = 0 AND g <> 3 AND k NOT IN (6, 8, 9) THEN CAST(qty AS DOUBLE) END actual,
    COALESCE(CASE WHEN expected = 0 THEN abs(actual) < {K.ZERO_TOLERANCE}
      ELSE abs(actual - expected) / abs(expected) <= 0.05 END, false) hit FROM gold),
joined AS (
  SELECT ok, STRING_AGG(CASE ok // 10 % 3 WHEN 2 THEN 'order ' ELSE '주문 ' END || no || ' ' || qty || ' ' || n, ' ' ORDER BY no) s
  FROM ln GROUP BY ok),
strings AS (
  SELECT CAST(doc_id AS BIGINT) doc_id, i * 3 + 1 seq,
    CASE WHEN k IN (6, 8, 9) THEN 0 ELSE contains(s, '주문')::INT + contains(s, r.no::VARCHAR)::INT
      + contains(s, r.qty::VARCHAR)::INT
      + CASE WHEN j.ok % 5 = 1 THEN contains(s, '없음')::INT ELSE contains(s, r.n::VARCHAR)::INT END
      + contains(s, '없는 값')::INT END hits
  FROM j JOIN joined USING (ok) JOIN rk r ON r.ok = j.ok AND r.rn = r.cnt),
volumes AS (
  SELECT e.doc_id, COUNT(*) elements, COUNT(*) FILTER (e.category = 'table') raw_tables,
    COUNT(*) FILTER (e.category = 'chart') raw_charts, COUNT(*) FILTER (v.parsed_ok AND v.prefix IN ('t', 'c')) assets,
    COUNT(*) FILTER (v.parsed_ok AND v.prefix = 'c') charts,
    COUNT(*) FILTER (v.parsed_ok AND v.label = 'chart') strict_charts
  FROM el e LEFT JOIN vis v USING (doc_id, seq) GROUP BY e.doc_id),
metrics AS (
  UNPIVOT (SELECT doc_id, {", ".join(THRESHOLDS)} FROM volumes) ON {", ".join(THRESHOLDS)} INTO NAME metric VALUE "value"),
verdicts AS (
  SELECT doc_id, metric, "value", CAST(t.threshold AS BIGINT) threshold, "value" >= t.threshold passed
  FROM metrics JOIN (VALUES {_values(THRESHOLDS.items())}) t(metric, threshold) USING (metric)),
checks AS (
  SELECT doc_id, 'complex_table' scenario, hits >= 4 passed FROM strings
  UNION ALL SELECT doc_id, 'chart_to_data', hit FROM gold_hits
  UNION ALL SELECT doc_id, 'volumes', passed FROM verdicts),
rollup_rows AS (
  SELECT d.doc_id, s.scenario, COUNT(c.scenario) n_checks, COUNT(*) FILTER (c.passed) n_passed,
    COUNT(c.scenario) > 0 AND COUNT(c.scenario) = COUNT(*) FILTER (c.passed) passed
  FROM docs d CROSS JOIN (VALUES ('complex_table'), ('chart_to_data'), ('volumes'), ('unchecked')) s(scenario)
  LEFT JOIN checks c ON c.doc_id = d.doc_id AND c.scenario = s.scenario GROUP BY d.doc_id, s.scenario),
real AS (
  SELECT *, LAG(STRUCT_PACK(page, v, ends := i % 2 = 1 AND (doc_id + i) % 3 <> 0)) OVER (PARTITION BY doc_id ORDER BY seq) before,
    i % 2 = 0 AND (doc_id + i) % 4 <> 0 starts
  FROM vis WHERE label = 'real_table' AND parsed_ok),
linked AS (SELECT *, COALESCE(before.page = page - 1 AND before.v = v AND before.ends AND starts, false) continues FROM real),
chains AS (
  SELECT *, MAX(CASE WHEN NOT continues THEN seq END) OVER (PARTITION BY doc_id ORDER BY seq) stitched_id FROM linked),
parts AS (
  SELECT *, COALESCE(SUM(cnt) OVER (PARTITION BY doc_id, stitched_id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) row_offset FROM chains),
said AS (
  SELECT 'figures' origin, doc_id, seq, description "text" FROM assets WHERE prefix = 'f'
  UNION ALL SELECT 'documents', doc_id, 0, "text" FROM documents
  UNION ALL SELECT 'stuck', doc_id, 0, '시작 말 ' || repeat(lang || ' ' || source || ' ' || doc_id || ' ', doc_id % 12) FROM documents),
tails AS (
  SELECT origin, doc_id, seq, w[len(w) - (len(w) + 1) // 2 + 1:] t FROM (
    SELECT origin, doc_id, seq, list_filter(regexp_split_to_array({_strip('"text"')}, '{K.WS}+'), lambda x: x <> '') w FROM said) WHERE len(w) >= 20),
periods AS (
  SELECT origin, doc_id, seq, CAST(list_min(list_filter(range(1, len(t) // 3 + 1),
    lambda p: CASE WHEN t[p + 1] = t[1] THEN t[p + 1:] = t[1:len(t) - p] ELSE false END)) AS INT) period FROM tails),
words AS (
  SELECT origin, doc_id, seq, w, COUNT(*) n FROM (
    SELECT origin, doc_id, seq, unnest(regexp_split_to_array({_strip('"text"')}, '{K.WS}+')) w FROM said) WHERE w <> ''
  GROUP BY ALL),
totals AS (
  SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY pr) - 1 rn FROM (
    SELECT CAST(o_custkey AS BIGINT) doc_id, o_orderpriority pr, year(o_orderdate) * 12 + (quarter(o_orderdate) - 1) * 3 ym,
      CAST(SUM(CAST(trunc(o_totalprice) AS BIGINT)) AS DOUBLE) num FROM orders GROUP BY ALL)),
written AS (
  SELECT ok l_orderkey, no l_linenumber, qty, (ok + no) % 8 g, (qty * 1000)::VARCHAR q,
    substring(q, 1, length(q) - 3) || ',000' comma, FROM ln)
"""

_MASKED = "'HTTP 401: key up_***REDACTED*** (not up_' || substring(sha256(\"text\"), 1, 5) || '): '"
_LIST = "COALESCE(STRING_AGG({item}, ',' ORDER BY {order}) FILTER ({when}), '')"


def _listing(source: str, item: str, order: str, name: str, where: str = "true") -> str:
    return f"(SELECT doc_id, '[' || STRING_AGG({item}, ',' ORDER BY {order}) || ']' {name} FROM {source} WHERE {where} GROUP BY doc_id)"


_ITEMS = """
SELECT doc_id, 'footnotes' list, seq, json_object('page', page, 'markdown', markdown)::VARCHAR item FROM notes
UNION ALL
SELECT doc_id, 'boundary_cases', seq, CASE WHEN fallback_path IS NULL THEN json_object('page', page, 'index', "index", 'reason', reason)
  ELSE json_object('page', page, 'index', "index", 'reason', reason, 'fallback_path', fallback_path) END::VARCHAR FROM boundary
UNION ALL
SELECT doc_id, 'files', seq, json_object('type', kind, 'path', "name", 'page', page, 'caption', caption, 'rows', n_rows, 'cols', n_cols)::VARCHAR
FROM assets WHERE parsed_ok AND prefix <> 'f'
UNION ALL
SELECT doc_id, 'figures', seq, json_object('index', idx, 'page', page, 'figure_type', figure_type, 'description', description, 'caption', caption)::VARCHAR
FROM assets WHERE prefix = 'f'
"""

_META = f"""
SELECT m.doc_id,
  '{{"source":' || json_object('name', "name", 'sha256', sha, 'pages', usage_pages)
  || ',"model":' || to_json(COALESCE(model, '{K.DEFAULT_MODEL}'))
  || ',"counts":' || json_object('tables', tables, 'charts', charts, 'figures', counts.figures, 'footnotes', counts.footnotes)
  || ',"footnotes":' || COALESCE(fn.items, '[]') || ',"boundary_cases":' || COALESCE(bc.items, '[]')
  || ',"files":' || COALESCE(fl.items, '[]') || ',"figures":' || COALESCE(fg.items, '[]') || '}}' meta
FROM meta m JOIN counts USING (doc_id)
LEFT JOIN {_listing("notes", "json_object('page', page, 'markdown', markdown)::VARCHAR", "seq", "items")} fn USING (doc_id)
LEFT JOIN {_listing("boundary", '''CASE WHEN fallback_path IS NULL THEN json_object('page', page, 'index', "index", 'reason', reason)
  ELSE json_object('page', page, 'index', "index", 'reason', reason, 'fallback_path', fallback_path) END::VARCHAR''', "seq", "items")} bc USING (doc_id)
LEFT JOIN {_listing("assets", '''json_object('type', kind, 'path', "name", 'page', page, 'caption', caption, 'rows', n_rows, 'cols', n_cols)::VARCHAR''',
                    "prefix = 'c', seq", "items", "parsed_ok AND prefix <> 'f'")} fl USING (doc_id)
LEFT JOIN {_listing("assets", "json_object('index', idx, 'page', page, 'figure_type', figure_type, 'description', description, 'caption', caption)::VARCHAR",
                    "seq", "items", "prefix = 'f'")} fg USING (doc_id)
"""

LOST_AT = LOST[0] * 12 + (LOST[1] - 1) * 3
_CHANGES = """
SELECT v.doc_id, v.seq, v."row", CAST(v.col AS INT) col, v.kind, make_date(v.ym // 12, v.ym % 12 + 1, 1) "period", v.num,
  p.num previous, v.num - p.num "change", ROUND((v.num - p.num) / abs(p.num), 6) rate,
  y.num year_ago, v.num - y.num year_change, ROUND((v.num - y.num) / abs(y.num), 6) year_rate
FROM ({values}) v
LEFT JOIN ({values}) p ON p.doc_id = v.doc_id AND p.seq = v.seq AND p.pr = v.pr AND p.ym = v.ym - CASE v.kind WHEN 'year' THEN 12 ELSE 3 END
LEFT JOIN ({values}) y ON y.doc_id = v.doc_id AND y.seq = v.seq AND y.pr = v.pr AND y.ym = v.ym - 12"""

_LATEST = """
SELECT sha16, "mode", arg_max(response, ts) response, MAX(ts) ts
FROM (SELECT * FROM entries UNION ALL SELECT * FROM fresh) GROUP BY sha16, "mode" """

_MISSING = """
SELECT *, missing > 0 OR unplanned > 0 failed FROM (
  SELECT d.doc_id, COUNT(c.chunk_no) planned, COUNT(*) FILTER (g <> 3) received, COUNT(*) FILTER (g = 3) missing,
    COUNT(*) FILTER (g = 4) repeated, CAST((d.doc_id % 17 = 1)::INT AS BIGINT) unplanned
  FROM docs d JOIN (SELECT *, (doc_id + chunk_no) % 7 g FROM chunks) c USING (doc_id) GROUP BY d.doc_id)
WHERE missing + repeated + unplanned > 0"""

_SELECTS = {
    "catalog_documents": f"""
SELECT path, size_bytes, stem, ext_l ext, ext_l = '.pdf' is_pdf, COALESCE(mime, '{K.DEFAULT_MIME}') mime,
  CASE WHEN size_bytes > {K.MAX_FILE_BYTES} THEN 'too_large' WHEN mime IS NULL THEN 'unsupported_ext' END reason
FROM files LEFT JOIN mimes ON mimes.ext = ext_l""",
    "fingerprint_documents": """
SELECT doc_id, sha256("text") sha256, substring(sha256("text"), 1, 16) sha16, substring(sha256("text"), 1, 8) sha8
FROM documents""",
    "search_documents": f"""
SELECT w.term, CASE WHEN c.n IS NULL THEN 'none' WHEN c.n = 1 THEN 'unique' ELSE 'ambiguous' END status,
  COALESCE(c.n, 0) n_matches, GREATEST(COALESCE(c.n, 0) - {K.SEARCH_LISTED}, 0) overflow, CAST(f."rank" AS INT) "rank", f.path
FROM wanted w LEFT JOIN (SELECT DISTINCT term, n FROM found) c ON c.term = w.term
LEFT JOIN found f ON f.term = w.term AND f."rank" <= {K.SEARCH_LISTED}""",
    "recent_documents": f"""
SELECT folder, CAST("rank" AS INT) "rank", path FROM (
  SELECT '/corpus/' || source folder, path, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id DESC) "rank"
  FROM files WHERE ext_l IN (SELECT ext FROM mimes)) WHERE "rank" <= {K.RECENT_LISTED}""",
    "read_responses": """
SELECT doc_id, chunk_no, CASE WHEN NOT corrupt THEN model END model, CASE WHEN NOT corrupt THEN pages END pages,
  CASE WHEN NOT corrupt THEN n_elements END n_elements,
  CASE WHEN NOT corrupt THEN CAST(length(markdown) AS INT) END markdown_length, corrupt
FROM (SELECT *, (doc_id + chunk_no) % 11 = 5 corrupt FROM chunks)""",
    "cache_lookup": 'SELECT doc_id, sha16, "mode", hit, matched, response FROM lookup',
    "cache_misses": 'SELECT doc_id, sha16, "mode" FROM lookup WHERE NOT hit',
    "cache_upsert": _LATEST,
    "latest_entries": _LATEST,
    "stored_cache_lookup": 'SELECT doc_id, sha16, "mode", hit, matched, response FROM lookup',
    "search_many": f"""
SELECT * FROM (
WITH many AS (
  SELECT '-' || c_custkey term FROM customer UNION SELECT unnest(['', 'C', 'résumé', 'RE' || chr(769) || 'S', 'nothing like it', '-1', 'SRC1-'])),
found_many AS (
  SELECT w.term, f.path, ROW_NUMBER() OVER (PARTITION BY w.term ORDER BY f.doc_id DESC) "rank", COUNT(*) OVER (PARTITION BY w.term) n
  FROM (SELECT term, lower(nfc_normalize(term)) needle FROM many) w
  JOIN (SELECT *, lower(nfc_normalize(stem)) low FROM files WHERE ext_l IN (SELECT ext FROM mimes)) f ON contains(f.low, w.needle))
SELECT w.term, CASE WHEN c.n IS NULL THEN 'none' WHEN c.n = 1 THEN 'unique' ELSE 'ambiguous' END status,
  COALESCE(c.n, 0) n_matches, GREATEST(COALESCE(c.n, 0) - {K.SEARCH_LISTED}, 0) overflow, CAST(f."rank" AS INT) "rank", f.path
FROM many w LEFT JOIN (SELECT DISTINCT term, n FROM found_many) c ON c.term = w.term
LEFT JOIN found_many f ON f.term = w.term AND f."rank" <= {K.SEARCH_LISTED})""",
    "response_fields": """
SELECT c.doc_id, c.chunk_no, CASE WHEN NOT corrupt THEN model END model, CASE WHEN NOT corrupt THEN 1 END api_version,
  CASE WHEN NOT corrupt AND c.doc_id % 2 = 0 THEN c.chunk_no + 0.5e0 END top, CASE WHEN NOT corrupt THEN first END first_markdown, corrupt
FROM (SELECT *, (doc_id + chunk_no) % 11 = 5 corrupt FROM chunks) c
JOIN (SELECT doc_id, chunk_no, arg_min(markdown, seq) first FROM chunked GROUP BY doc_id, chunk_no) f USING (doc_id, chunk_no)""",
    "unnamed_fields": """
SELECT doc_id, chunk_no, field, CASE field WHEN 'api_version' THEN '1'
  ELSE '{"box":[{"x":0.25,"y":' || chunk_no || '.5}],"dpi":' || doc_id % 7 || '}' END "value"
FROM chunks, (VALUES ('api_version'), ('ocr.state')) f(field)
WHERE (doc_id + chunk_no) % 11 <> 5 AND (field = 'api_version' OR doc_id % 2 = 0)""",
    "find_substrings": """
SELECT w.wanted, COUNT(*) n_tables, MAX(t.doc_id) last_doc
FROM (SELECT DISTINCT l_linenumber || ' ' || CAST(l_quantity AS BIGINT) || ' ' wanted FROM lineitem) w
JOIN (SELECT d.doc_id, d.seq, s FROM (SELECT * FROM data UNION ALL SELECT * FROM vis WHERE label = 'other' AND false) d JOIN joined USING (ok)) t ON contains(t.s, w.wanted)
GROUP BY w.wanted""",
    "page_range_filter": "SELECT * FROM picked",
    "page_ranges": "SELECT * FROM ranges",
    "chunk_plan": f"""
SELECT doc_id, CAST(c AS INT) chunk_no, CAST(c * {CHUNK_PAGES} + 1 AS INT) "start",
  CASE WHEN is_pdf THEN CAST(LEAST(c * {CHUNK_PAGES} + {CHUNK_PAGES}, n_pages) AS INT) ELSE n_pages END "end",
  CAST(c * {CHUNK_PAGES} AS INT) "offset"
FROM (SELECT *, unnest(range(CASE WHEN is_pdf THEN (n_pages - 1) // {CHUNK_PAGES} + 1 ELSE 1 END)) c FROM docs)""",
    "merge_chunks": "SELECT doc_id, seq, page, category, markdown, html FROM el",
    "merge_contents": """
SELECT doc_id,
  COALESCE(STRING_AGG(html || chr(10) || chr(10), '' ORDER BY chunk_no) FILTER (html <> ''), '') html,
  COALESCE(STRING_AGG(markdown || chr(10) || chr(10), '' ORDER BY chunk_no) FILTER (markdown <> ''), '') markdown,
  '' "text" FROM chunks GROUP BY doc_id""",
    "content_parts": """
SELECT doc_id, chunk_no, NULLIF(html, '') || chr(10) || chr(10) html, NULLIF(markdown, '') || chr(10) || chr(10) markdown,
  CAST(NULL AS VARCHAR) "text" FROM chunks""",
    "merge_headers": """
SELECT doc_id, arg_max(model, chunk_no) FILTER (model IS NOT NULL) model, CAST(SUM(pages) AS BIGINT) pages
FROM chunks GROUP BY doc_id""",
    "restore_page_offset": "SELECT doc_id, seq, page FROM picked",
    "streamed_missing_chunks": _MISSING,
    "missing_chunks": _MISSING,
    "elements": f"""
SELECT doc_id, chunk_no, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id, chunk_no ORDER BY seq) - 1 AS INT) seq,
  page - chunk_no * {CHUNK_PAGES} page, category, markdown, html FROM chunked""",
    "classify_elements": "SELECT doc_id, seq, page, category, label FROM lab",
    "element_text": "SELECT doc_id, seq, raw AS content FROM raw",
    "clean_captions": "SELECT doc_id, seq, raw, caption FROM cand",
    "attach_captions": "SELECT doc_id, seq, caption FROM numbered",
    "slug_assets": "SELECT doc_id, seq, caption, slug FROM slugged WHERE prefix <> 'f'",
    "number_assets": 'SELECT doc_id, seq, prefix, idx AS "index" FROM numbered',
    "name_assets": 'SELECT doc_id, seq, prefix, idx AS "index", "name" FROM assets WHERE prefix <> \'f\'',
    "footnotes": "SELECT * FROM notes",
    "figures": 'SELECT doc_id, seq, idx AS "index", page, figure_type, description, caption FROM assets WHERE prefix = \'f\'',
    "label_distribution": """
SELECT label, COUNT(*) n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) share
FROM lab WHERE category = 'table' GROUP BY label""",
    "table_cells": "SELECT * FROM cells",
    "spanned_cells": """
SELECT CAST(j.doc_id AS BIGINT) doc_id, i * 3 + 1 seq, h."row", h.col, true is_header, h."text"
FROM j, (VALUES (0, 0, '쌍'), (0, 1, '쌍'), (0, 2, '값'), (0, 3, '값'), (1, 0, '쌍'), (1, 1, '쌍'), (1, 2, '항목'), (1, 3, '합계')) h("row", col, "text")
WHERE cnt > 0
UNION ALL
SELECT CAST(j.doc_id AS BIGINT), i * 3 + 1, CAST(r.rn + 1 AS INT), c.col, false,
  CASE WHEN c.col < 2 THEN f.no WHEN c.col = 2 THEN r.no ELSE r.qty END::VARCHAR
FROM j JOIN rk r ON r.ok = j.ok JOIN rk f ON f.ok = r.ok AND f.rn = r.rn - (r.rn - 1) % 2, (VALUES (0), (1), (2), (3)) c(col)
UNION ALL
SELECT CAST(j.doc_id AS BIGINT), i * 3 + 1, CAST(rn + 1 AS INT), col, head, "text" FROM j JOIN (
  SELECT ok, rn, false head, '끝' "text" FROM (SELECT ok, MAX(rn) + 1 rn FROM rk GROUP BY ok)) x ON x.ok = j.ok,
  (SELECT unnest(range(1000))::INT col) WHERE j.ok % 1000 = 0
UNION ALL
SELECT CAST(j.doc_id AS BIGINT), i * 3 + 1, CAST(y AS INT), col, y < 2, '' FROM j, LATERAL (SELECT unnest(range(cnt + 2)) y),
  (SELECT unnest(range(4, 1000))::INT col) WHERE j.ok % 1000 = 0 AND cnt > 0""",
    "wide_tables": """
SELECT doc_id, seq, "row", is_header, 4 n_cols, MAX("text") FILTER (col = 0) c0, MAX("text") FILTER (col = 1) c1, MAX("text") FILTER (col = 2) c2,
  MAX("text") FILTER (col = 3) c3, CAST(NULL AS VARCHAR) c4
FROM cells JOIN (SELECT doc_id, MIN(seq) seq FROM data WHERE prefix = 't' GROUP BY doc_id) f USING (doc_id, seq) GROUP BY ALL""",
    "table_headers": f"""
SELECT d.doc_id, d.seq, h.col, h."name", d.n_head n_levels
FROM data d JOIN (VALUES (0, 0, '구분'), (0, 1, '항목'), (0, 2, '{CHART_COLUMNS[0]}'), (0, 3, '{CHART_COLUMNS[1]}'),
  (1, 0, '구분'), (1, 1, '항목'), (1, 2, '합계'), (1, 3, '건수'), (2, 0, 'kind'), (2, 1, 'line'), (2, 2, 'sum'), (2, 3, 'count'))
  h(v, col, "name") ON h.v = d.v""",
    "typed_cells": 'SELECT *, TRY_CAST("text" AS DOUBLE) num FROM cells',
    "table_shapes": "SELECT doc_id, seq, CAST(cnt AS INT) n_rows, 4 n_cols FROM data",
    "parse_failures": "SELECT * FROM boundary",
    "page_parse_failures": f"""
SELECT page_id doc_id, 0 seq, 1 page, 0 "index", '{K.TABLE_FAILED}{K.PARSE_ERROR}' reason, 't00_p1_table-p1.html' fallback_path
FROM pages WHERE html IS NULL OR NOT regexp_matches(html, '(?i)<t[dh]\\b')""",
    "write_assets": 'SELECT c.*, a."name" FROM cells c JOIN assets a USING (doc_id, seq)',
    "asset_csv": f"""
SELECT a.doc_id, a.seq, a."name", 0 "row", h.line FROM data d JOIN assets a USING (doc_id, seq)
JOIN (VALUES (0, '구분,항목,{CHART_COLUMNS[0]},{CHART_COLUMNS[1]}'), (1, '구분,항목,합계,건수'), (2, 'kind,line,sum,count')) h(v, line) ON h.v = d.v
UNION ALL
SELECT a.doc_id, a.seq, a."name", CAST(b."row" - b.n_head + 1 AS INT), CASE b.v WHEN 2 THEN 'order' ELSE '주문' END || ',' || no || ',' || qty || ',' || n
FROM bodies b JOIN assets a USING (doc_id, seq) WHERE b.col = 0""",
    "write_failures": """
SELECT doc_id, seq, "name", CASE k WHEN 6 THEN '<figure><p>no data</p></figure>' ELSE '<table></table>' END html
FROM assets WHERE NOT parsed_ok AND prefix IN ('t', 'c')""",
    "stitch_tables": """
SELECT p.doc_id, p.stitched_id, CAST(CASE WHEN c.is_header THEN c."row" ELSE c."row" + p.row_offset END AS BIGINT) "row",
  c.col, c.is_header, c."text"
FROM cells c JOIN parts p USING (doc_id, seq) WHERE NOT (p.continues AND c.is_header)""",
    "asset_list": """
SELECT doc_id, (prefix = 'c')::INT section, idx AS "index", seq, kind, page, caption, "name", n_rows, n_cols
FROM assets WHERE parsed_ok AND prefix <> 'f'""",
    "document_counts": "SELECT * FROM counts",
    "page_map": """
SELECT f.doc_id, f.page, COUNT(*) FILTER (t) tables, COUNT(*) FILTER (c) charts, COUNT(*) FILTER (f) figures
FROM flags f JOIN meta m USING (doc_id) WHERE m.usage_pages > 0 AND (t OR c OR f) GROUP BY f.doc_id, f.page""",
    "visual_pages": "SELECT DISTINCT doc_id, page FROM flags WHERE t OR c OR f",
    "index_rows": f"""
SELECT doc_id, kind || 's' section, seq, CASE WHEN prefix <> 'f' THEN "name" END "name", page,
  COALESCE(caption, '{K.NO_TITLE}') title, CASE WHEN prefix <> 'f' THEN n_rows || '×' || n_cols END size, figure_type,
  CASE WHEN length(d) > {K.DESCRIPTION_LENGTH} THEN substring(d, 1, {K.DESCRIPTION_LENGTH}) || '{K.ELLIPSIS}' ELSE d END description
FROM (SELECT *, replace(description, '|', '\\|') d FROM assets) WHERE {_SHOWN}""",
    "document_meta": _META,
    "meta_items": _ITEMS,
    "top_assets": f"""
SELECT doc_id, prefix, CAST(rn AS INT) "rank", CASE WHEN prefix = 'f' THEN figure_type ELSE "name" END entry,
  substring(COALESCE(caption, '{K.NO_TITLE}'), 1, {K.TOP_CAPTION_LENGTH}) title, GREATEST(n - lim, 0) overflow
FROM (SELECT *, ROW_NUMBER() OVER w rn, COUNT(*) OVER (PARTITION BY doc_id, prefix) n,
    CASE prefix WHEN 't' THEN 3 WHEN 'c' THEN 2 ELSE 1 END lim
  FROM assets WHERE {_SHOWN} WINDOW w AS (PARTITION BY doc_id, prefix ORDER BY seq)) WHERE rn <= lim""",
    "boundary_report": """
SELECT doc_id, seq, '페이지 ' || page || ', #' || "index" || ': ' || reason
  || CASE WHEN fallback_path IS NULL THEN '' ELSE ' → `' || fallback_path || '`' END line FROM boundary""",
    "boundary_reasons": "SELECT reason, COUNT(*) n FROM boundary GROUP BY reason",
    "page_contents": """
SELECT a.doc_id, a.page, CASE WHEN prefix = 'f' THEN 'figure' ELSE 'data' END answer, seq,
  CASE WHEN prefix = 'f' THEN figure_type ELSE "name" END entry
FROM assets a WHERE (parsed_ok AND prefix <> 'f') OR (prefix = 'f' AND NOT EXISTS (
  SELECT 1 FROM data d WHERE d.doc_id = a.doc_id AND d.page = a.page))
UNION ALL
SELECT doc_id, page, 'empty', NULL, 'sources/p' || page || '.png'
FROM (SELECT doc_id, CAST(unnest(range(1, n_pages + 1)) AS INT) page FROM docs) p
WHERE NOT EXISTS (SELECT 1 FROM flags f WHERE f.doc_id = p.doc_id AND f.page = p.page AND (t OR c OR f))""",
    "golden_cells": "SELECT * FROM gold_hits",
    "golden_substrings": "SELECT doc_id, seq, CAST(hits AS INT) hits, hits >= 4 passed FROM strings",
    "largest_table_on_page": """
SELECT p.doc_id, p.page, b.seq, b.n_rows, b.n_cols, COALESCE(b.n_rows >= 5, false) passed
FROM (SELECT doc_id, CAST(unnest(range(1, n_pages + 1)) AS INT) page FROM docs) p
LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, page ORDER BY n_rows DESC, seq) rn FROM assets
  WHERE label = 'real_table' AND parsed_ok) b ON b.doc_id = p.doc_id AND b.page = p.page AND b.rn = 1""",
    "match_table_by_columns": """
SELECT doc_id, page, COUNT(*) n_charts, MIN(seq) FILTER (v = 0) matched_seq FROM data WHERE prefix = 'c' GROUP BY doc_id, page""",
    "hangul_retained": """
SELECT doc_id, seq, bool_or(regexp_matches("text", '[가-힣]')) retained FROM cells GROUP BY doc_id, seq""",
    "text_integrity": f"""
SELECT origin, doc_id, CAST(SUM(length(t) - length(regexp_replace(t, '{K.HANGUL}', '', 'g'))) AS BIGINT) hangul,
  CAST(SUM(length(t) - length(replace(t, chr(65533), ''))) AS BIGINT) broken, CAST(SUM(length(t)) AS BIGINT) n_chars,
  hangul >= 200 AND broken = 0 passed
FROM (SELECT 'documents' origin, doc_id, "text" t FROM documents UNION ALL SELECT 'elements', doc_id, markdown FROM el)
GROUP BY origin, doc_id""",
    "volume_thresholds": "SELECT * FROM verdicts",
    "silent_drop_check": """
SELECT v.doc_id, raw_charts, charts, COALESCE(b.n, 0) recorded, raw_charts - charts dropped,
  raw_charts - charts <= COALESCE(b.n, 0) passed, raw_charts - strict_charts <= COALESCE(b.n, 0) strict_passed
FROM volumes v LEFT JOIN (SELECT doc_id, COUNT(*) n FROM boundary
  WHERE contains(reason, 'chart parse failed') AND doc_id % 7 <> 0 GROUP BY doc_id) b USING (doc_id)""",
    "eval_rollup": "SELECT * FROM rollup_rows",
    "eval_totals": """
SELECT CASE WHEN GROUPING(scenario) = 0 THEN 'scenario' WHEN GROUPING(doc_id) = 0 THEN 'document' ELSE 'all' END "of",
  scenario, doc_id, COUNT(*) n, COUNT(*) FILTER (passed) n_pass, COUNT(*) FILTER (NOT passed) n_fail, n_fail = 0 passed
FROM rollup_rows GROUP BY GROUPING SETS ((scenario), (doc_id), ())""",
    "mask_secrets": f"""
SELECT doc_id, m AS "text", substring(m, 1, {K.MESSAGE_LENGTH}) excerpt FROM (
  SELECT doc_id, {_MASKED} || regexp_replace("text", 'up_[A-Za-z0-9]{{10,}}', 'up_***REDACTED***', 'g') || ' up_***REDACTED***' m
  FROM documents)""",
    "description_loops": """
SELECT s.origin, s.doc_id, s.seq, CAST(COALESCE(SUM(n), 0) AS INT) n_words, CAST(COALESCE(MAX(n), 0) AS INT) top_count,
  ROUND(COALESCE(MAX(n) / SUM(n), 0), 6) top_share,
  ANY_VALUE(period) "period", COALESCE(SUM(n) >= 20 AND MAX(n) / SUM(n) >= 0.05, false) OR ANY_VALUE(period) IS NOT NULL looping
FROM said s LEFT JOIN words w ON w.origin = s.origin AND w.doc_id = s.doc_id AND w.seq = s.seq
LEFT JOIN periods p ON p.origin = s.origin AND p.doc_id = s.doc_id AND p.seq = s.seq GROUP BY s.origin, s.doc_id, s.seq""",
    "compare_series": """
SELECT doc_id, seq, CAST(rn - 1 AS INT) "row", CAST(no AS VARCHAR) "label", CAST(qty AS DOUBLE) left_value,
  CAST(n AS DOUBLE) right_value, CAST(qty - n AS DOUBLE) difference, ROUND(qty / n, 6) ratio
FROM data JOIN rk USING (ok) WHERE v = 0""",
    "period_change": _CHANGES.format(
        values=f"""
    SELECT doc_id, 0 seq, pr, CAST(rn AS INT) "row", ym // 12 - 1991 col, 'year' kind, ym // 12 * 12 ym, SUM(num) num FROM totals WHERE ym < 1999 * 12 GROUP BY ALL
    UNION ALL
    SELECT doc_id, 1, pr, CAST(rn AS INT), (ym - 1992 * 12) // 3 + 1 - (ym > {LOST_AT})::INT, 'quarter', ym, num FROM totals WHERE ym < 1999 * 12 AND ym <> {LOST_AT}"""
    ),
    "period_rows": _CHANGES.format(
        values="""
    SELECT doc_id, 2 seq, pr, CAST(ym // 12 - 1992 AS INT) "row", rn + 1 col, 'year' kind, ym // 12 * 12 ym, SUM(num) num FROM totals WHERE ym < 1999 * 12 GROUP BY ALL"""
    ),
    "normalize_numbers": """
SELECT l_orderkey, l_linenumber,
  CASE g WHEN 0 THEN '▲' || comma WHEN 1 THEN '▽ ' || comma WHEN 2 THEN '(' || comma || ')' WHEN 3 THEN qty || '.5%'
    WHEN 4 THEN comma || ' 1)' WHEN 5 THEN '(' || qty || '조원)' WHEN 6 THEN 'n/a ' || comma ELSE comma END "text",
  CASE WHEN g IN (0, 1, 2) THEN -1000e0 * qty WHEN g = 3 THEN qty + 0.5e0 WHEN g = 5 THEN CAST(-qty AS DOUBLE)
    WHEN g = 6 THEN NULL ELSE 1000e0 * qty END num,
  CASE g WHEN 3 THEN '%' WHEN 5 THEN '조원' END unit FROM written""",
    "unit_rows": """
SELECT doc_id, seq, n_head "row", col, CASE WHEN page % 2 = 1 THEN '건' ELSE '%' END unit
FROM data, (VALUES (0), (1), (2), (3)) c(col) WHERE seq % 2 = 1 AND (page % 2 = 1 OR col > 1)""",
    "unit_cells": """
SELECT doc_id, seq, CAST("row" + (seq % 2 = 1)::INT AS INT) "row", col, CAST("text" AS DOUBLE) num,
  CASE WHEN seq % 2 = 1 THEN CASE WHEN page % 2 = 1 THEN '건' WHEN col > 1 THEN '%' END END unit
FROM bodies WHERE col > 0""",
    "parse_cost": """
SELECT doc_id, "mode", hit, n_pages,
  CASE WHEN hit THEN 0e0 ELSE ROUND(n_pages * CASE "mode" WHEN 'enhanced' THEN 0.03e0 ELSE 0.01e0 END, 4) END AS "cost"
FROM lookup""",
}

ORACLE = {name: BASE + select for name, select in _SELECTS.items()}
