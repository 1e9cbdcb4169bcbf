"""DuckDB twins of the queries that SQL can express."""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][turn % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS lim FROM s
), v AS (
  SELECT *, row_number() OVER o AS pos,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY lim / weight, source NULLS LAST)
), g AS (
  SELECT source, source_size, least(lim, weight * (SELECT arg_min(level, pos) FROM v WHERE level * weight <= lim)) AS target FROM v
), f AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM f
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size > 0
            THEN epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before))
            ELSE 0 END AS BIGINT) AS taken
FROM b
"""

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS hits FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * hits >= 80 * (x.n + y.n - hits)
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""

TOP_K = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_LEAF = "sha256(concat(" + ", ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("id", "source", "lang", "chars", "{text}")) + "))"

MERKLE = rf"""
WITH RECURSIVE d AS (
  SELECT *, doc_id::VARCHAR id, n_chars::VARCHAR chars, coalesce('+' || lang, '') tree,
         translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low FROM documents
), c AS (
  SELECT *, {_LEAF.format(text='"text"')} leaf, {_LEAF.format(text="low")} tampered,
         list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(list_transform(range(1, len(id) + 1), lambda k: ascii(id[k])),
           lambda b: [b::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) crc
  FROM d
), p AS (
  SELECT *, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN tampered ELSE leaf END mine,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 i FROM c
), t(tree, lvl, i, h) AS (
  SELECT tree, 0, i, leaf FROM p
  UNION ALL
  SELECT tree, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) n FROM t) WHERE n > 1 GROUP BY tree, lvl, i // 8
), high AS (
  SELECT tree, max(lvl) top, arg_max(h, lvl) subroot FROM t GROUP BY tree
), tops AS (
  SELECT *, row_number() OVER (ORDER BY tree) - 1 i FROM high
), u(lvl, i, h) AS (
  SELECT 0, i, subroot FROM tops
  UNION ALL
  SELECT lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () n FROM u) WHERE n > 1 GROUP BY lvl, i // 8
), steps AS (
  SELECT p.tree, p.i, t.lvl step, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < p.i // (8 ** t.lvl)::BIGINT), '') l,
         coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > p.i // (8 ** t.lvl)::BIGINT), '') r
  FROM p JOIN high USING (tree) JOIN t ON t.tree = p.tree AND t.lvl < high.top AND t.i // 8 = p.i // (8 ** (t.lvl + 1))::BIGINT
  GROUP BY ALL
  UNION ALL
  SELECT p.tree, p.i, o.top + u.lvl, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < o.i // (8 ** u.lvl)::BIGINT), ''),
         coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > o.i // (8 ** u.lvl)::BIGINT), '')
  FROM p JOIN tops o USING (tree) JOIN u ON u.lvl < (SELECT max(lvl) FROM u) AND u.i // 8 = o.i // (8 ** (u.lvl + 1))::BIGINT
  GROUP BY ALL
), f(tree, i, step, h) AS (
  SELECT tree, i, 0, mine FROM p
  UNION ALL
  SELECT f.tree, f.i, f.step + 1, sha256(s.l || f.h || s.r) FROM f JOIN steps s ON s.tree = f.tree AND s.i = f.i AND s.step = f.step
), done AS (
  SELECT tree, i, arg_max(h, step) folded_root FROM f GROUP BY tree, i
), proof AS (
  SELECT tree, i, sha256(string_agg(l || r, '' ORDER BY step)) proof_sha256 FROM steps GROUP BY tree, i
)
SELECT p.doc_id, p.leaf, high.subroot, g.root, coalesce(proof_sha256, sha256('')) proof_sha256, folded_root, folded_root = g.root verified
FROM p JOIN high USING (tree) JOIN done USING (tree, i) LEFT JOIN proof USING (tree, i), (SELECT arg_max(h, lvl) root FROM u) g
"""

EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce("text", '')) n, regexp_replace(coalesce("text", ''), '[\x20\x09-\x0D]', '', 'g') s FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w keep_id, count(*) OVER (PARTITION BY s) group_size,
       row_number() OVER w = 1 kept, sha256(s) text_sha256
FROM d WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)
"""

_SQUARED = "list_sum(list_transform(list_zip(v, r.c[k]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_NEAREST = f"list_min(list_transform(range(1, len(r.c) + 1), lambda k: {{'d': {_SQUARED}, 'k': k}}))"

CENTROIDS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), r(round, c) AS (
  SELECT 0, list(v ORDER BY h) FROM (SELECT v, sha256('3:' || vec_id) h FROM v ORDER BY h LIMIT 8)
  UNION ALL
  SELECT any_value(round) + 1, list(coalesce(s, old) ORDER BY k) FROM (
    SELECT g.round, g.k, g.old, m.s FROM (
      SELECT round, unnest(range(1, len(c) + 1)) k, unnest(c) old FROM r WHERE round < 10) g
    LEFT JOIN (
      SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY pos) s FROM (
        SELECT near.k k, pos, CAST(sum(v[pos]) AS BIGINT) s, count(*) n FROM (
          SELECT v, {_NEAREST} near FROM v, r WHERE r.round < 10), range(1, 65) x(pos)
        GROUP BY near.k, pos) GROUP BY k) m ON m.k = g.k)
  HAVING count(*) > 0
), a AS (
  SELECT vec_id, {_NEAREST} near, r.c FROM v, r WHERE r.round = 10
)
SELECT vec_id, CAST(near.k - 1 AS INTEGER) "cluster", CAST(near.d AS BIGINT) distance, CAST(sum(near.d) OVER (PARTITION BY near.k) AS BIGINT) cluster_inertia,
       CAST(sum(near.d) OVER () AS BIGINT) inertia, sha256(array_to_string(c[near.k], ',')) centroid_sha256
FROM a
"""

ORACLE = {"op7_exact_top_k": TOP_K, "op6_mixing": MIXING, "op9_ngram_jaccard_join": JACCARD,
          "op11_merkle_manifest": MERKLE, "op12_exact_dedup": EXACT, "op13_centroid_clustering": CENTROIDS}
