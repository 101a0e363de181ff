"""SQL twins (DuckDB) of the text queries whose whole result SQL can express: plain definitions, each over every row."""

from __future__ import annotations

JACCARD_JOIN = r"""WITH RECURSIVE
    w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
    t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
    link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    near AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    lab(node, label) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM near GROUP BY a
        UNION SELECT near.b, min(lab.label) FROM lab JOIN near ON lab.node = near.a JOIN recurring.lab AS r ON r.node = near.b WHERE lab.label < r.label GROUP BY near.b),
    n AS (SELECT a, count(*) AS n FROM near GROUP BY a)
    SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(label, s.doc_id) AS component_id, coalesce(n, 0) AS n_links
    FROM s LEFT JOIN lab ON s.doc_id = lab.node LEFT JOIN n ON s.doc_id = n.a"""

LINE_DEDUP = r"""WITH
    raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
    l AS (SELECT doc_id, line, raw, row_number() OVER (ORDER BY doc_id, line) AS pos, list_sort(list_distinct(regexp_extract_all(raw, '[^\x20\x09-\x0D]+'))) AS s FROM raw),
    sets AS (SELECT s, len(s) AS n, min(pos) AS first FROM l WHERE len(s) > 0 GROUP BY s),
    t AS (SELECT first, n, unnest(s) AS t FROM sets),
    f AS (SELECT t, count(*) AS f FROM t GROUP BY t),
    p AS (SELECT first, n, t FROM (SELECT first, n, t.t, row_number() OVER (PARTITION BY first ORDER BY f, t.t) AS r FROM t JOIN f ON t.t = f.t) x WHERE r <= n - CAST(ceil(n * 80 / 100.0) AS BIGINT) + 1),
    pairs AS (SELECT DISTINCT a.first AS a, b.first AS b FROM p a JOIN p b ON a.t = b.t AND a.first <> b.first AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
    near AS (SELECT pairs.a, min(pairs.b) AS earliest FROM pairs JOIN sets x ON pairs.a = x.first JOIN sets y ON pairs.b = y.first
        WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s))) GROUP BY pairs.a),
    judged AS (SELECT l.doc_id, l.line, l.raw, coalesce(l.pos > least(sets.first, coalesce(near.earliest, sets.first)), false) AS removed FROM l LEFT JOIN sets ON l.s = sets.s LEFT JOIN near ON sets.first = near.a)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed, sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (WHERE NOT removed), '')) AS text_sha256
    FROM judged GROUP BY doc_id"""

HARD_NEGATIVES = r"""WITH
    r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
