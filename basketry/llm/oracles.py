"""DuckDB SQL of the queries, written from their contracts."""

from __future__ import annotations

SQL = {}

SQL["op5_mix_sources"] = """
WITH s AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM documents GROUP BY 1
), r AS (
  SELECT source, CASE WHEN chars = 0 THEN 1.0 ELSE
           sqrt(chars) / (SELECT sum(CASE WHEN chars > 0 THEN sqrt(chars) ELSE 0 END) FROM s)
           * (SELECT sum(chars) FROM s) / chars END AS rate
  FROM s
), parts AS (
  SELECT source, greatest(1, CAST(ceil(rate / 200.0) AS INT)) AS parts,
         rate / greatest(1, CAST(ceil(rate / 200.0) AS INT)) AS mean
  FROM r
), cdf AS (
  SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1)))
                    OVER (PARTITION BY source ORDER BY k) AS c
  FROM parts, range(0, 400) t(k)
  WHERE k <= ceil(mean + 10 * sqrt(mean) + 30)
), draws AS (
  SELECT DISTINCT d.doc_id, d.source, p.part,
         ('0x' || substr(md5(concat_ws(':', 17, coalesce(CAST(d.doc_id AS VARCHAR), 'null'),
                                       p.part)), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents d JOIN parts q ON d.source IS NOT DISTINCT FROM q.source,
       range(1, 1000) p(part)
  WHERE p.part <= q.parts
), counts AS (
  SELECT w.doc_id, w.source, count(*) FILTER (w.u >= c.c) AS n
  FROM draws w JOIN cdf c ON w.source IS NOT DISTINCT FROM c.source
  GROUP BY 1, 2
)
SELECT d.*, CAST(c.n AS INT) AS n_copies, CAST(t.copy AS INT) AS copy,
       substr(md5(concat_ws(':', 17, 'order', coalesce(CAST(d.doc_id AS VARCHAR), 'null'),
                            t.copy)), 1, 16) AS shuffle_key
FROM documents d
JOIN counts c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.source IS NOT DISTINCT FROM c.source,
     range(1, 100000) t(copy)
WHERE t.copy <= c.n
"""

SQL["op10_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), tri AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM w, range(1, 1000000) t(i) WHERE i <= len(w) - 2
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri) WHERE n > 1)
  GROUP BY r
), m AS (
  SELECT w.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.r = rep.r
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         (1000 * n_symbols) // greatest(n_words, 1) AS symbols,
         (1000 * n_dup_lines) // greatest(n_lines, 1) AS dup_lines,
         (1000 * n_repeat_words) // greatest(n_words, 1) AS repeats,
         (100 * word_chars) // greatest(n_words, 1) AS word_length
  FROM m
), x AS (
  SELECT lang, source, measure, v,
         (v >> greatest(0, length(bin(v)) - 6)) << greatest(0, length(bin(v)) - 6) AS b
  FROM (UNPIVOT (SELECT r, lang, source, symbols, dup_lines, repeats, word_length
                 FROM f WHERE NOT base_failed)
        ON symbols, dup_lines, repeats, word_length INTO NAME measure VALUE v)
), q0 AS (
  SELECT lang, source, measure, count(*) AS n,
         min(b) FILTER (4 * rk >= n1) AS q1, min(b) FILTER (4 * rk >= 3 * n1) AS q3
  FROM (SELECT *, count(*) OVER (PARTITION BY lang, source, measure ORDER BY b) AS rk,
               count(*) OVER (PARTITION BY lang, source, measure) AS n1 FROM x)
  GROUP BY 1, 2, 3
), q1 AS (
  SELECT lang, measure, count(*) AS n,
         min(b) FILTER (4 * rk >= n1) AS q1, min(b) FILTER (4 * rk >= 3 * n1) AS q3
  FROM (SELECT *, count(*) OVER (PARTITION BY lang, measure ORDER BY b) AS rk,
               count(*) OVER (PARTITION BY lang, measure) AS n1 FROM x)
  GROUP BY 1, 2
), q2 AS (
  SELECT measure, min(b) FILTER (4 * rk >= n1) AS q1, min(b) FILTER (4 * rk >= 3 * n1) AS q3
  FROM (SELECT *, count(*) OVER (PARTITION BY measure ORDER BY b) AS rk,
               count(*) OVER (PARTITION BY measure) AS n1 FROM x)
  GROUP BY 1
), fence AS (
  SELECT q0.lang, q0.source, q0.measure,
         CASE WHEN q0.n >= 50 THEN q0.q1 WHEN q1.n >= 50 THEN q1.q1 ELSE q2.q1 END AS lo,
         CASE WHEN q0.n >= 50 THEN q0.q3 WHEN q1.n >= 50 THEN q1.q3 ELSE q2.q3 END AS hi
  FROM q0 JOIN q1 ON q0.lang IS NOT DISTINCT FROM q1.lang AND q0.measure = q1.measure
  JOIN q2 ON q0.measure = q2.measure
), bad AS (
  SELECT DISTINCT f.r FROM f JOIN fence t
    ON f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source
  WHERE (t.measure = 'symbols' AND f.symbols > t.hi + 3 * (t.hi - t.lo) + 100)
     OR (t.measure = 'dup_lines' AND f.dup_lines > t.hi + 3 * (t.hi - t.lo) + 300)
     OR (t.measure = 'repeats' AND f.repeats > t.hi + 3 * (t.hi - t.lo) + 200)
     OR (t.measure = 'word_length' AND (f.word_length > t.hi + 3 * (t.hi - t.lo) + 100
                                     OR f.word_length < t.lo - 3 * (t.hi - t.lo) - 100))
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.r IS NULL AS kept
FROM f LEFT JOIN bad ON f.r = bad.r
"""


def _order(k: int) -> str:
    """The interpolated model of order k: gram -> probability in both classes."""
    below = ("(SELECT '' AS b, 1 / 256.0 AS ba, 1 / 256.0 AS br)" if k == 1 else
             f"(SELECT g AS b, qa AS ba, qr AS br FROM p{k - 1})")
    return f"""
, g{k} AS (
  SELECT substr(w, {6 - k}, {k}) AS g, sum(a) AS a, sum(r) AS r FROM win GROUP BY 1
), c{k} AS (
  SELECT substr(g, 1, {k - 1}) AS c, sum(a) AS ca, sum(r) AS cr FROM g{k} GROUP BY 1
), p{k} AS (
  SELECT g, (a + 2 * ba) / (ca + 2.0) AS qa, (r + 2 * br) / (cr + 2.0) AS qr
  FROM g{k} JOIN c{k} ON substr(g, 1, {k - 1}) = c JOIN {below} ON substr(g, 2, {k - 1}) = b
)"""


SQL["op3_url_filter"] = r"""
WITH d AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(name, h, p, what) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), u AS (
  SELECT host, path, host || path AS k, count(*) AS n FROM d GROUP BY 1, 2
), fit AS (
  SELECT host, path, arg_max(name, length(name)) AS rule, arg_max(what, length(name)) AS what
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY 1, 2
), j AS (
  SELECT u.*, fit.rule, fit.what, ('0x' || substr(md5(k), 1, 8))::BIGINT % 5 = 0 AS held
  FROM u LEFT JOIN fit USING (host, path)
), win AS (
  SELECT w, sum(CASE WHEN what = 'allow' AND NOT held THEN n ELSE 0 END) AS a,
         sum(CASE WHEN what = 'block' AND NOT held THEN n ELSE 0 END) AS r
  FROM (SELECT *, unnest(list_transform(range(1, length(k) + 2),
                                        lambda i: substr('^^^^' || k || '$', i, 5))) AS w FROM j)
  GROUP BY 1
)""" + "".join(_order(k) for k in range(1, 6)) + r"""
, marks AS (
  SELECT k, sum(ln(qa) - ln(qr)) / count(*) AS mark
  FROM (SELECT k, unnest(list_transform(range(1, length(k) + 2),
                                        lambda i: substr('^^^^' || k || '$', i, 5))) AS g
        FROM (SELECT DISTINCT k FROM j)) JOIN p5 USING (g)
  GROUP BY 1
), stats AS (
  SELECT avg(mark) FILTER (what = 'allow') AS ma, avg(mark) FILTER (what = 'block') AS mr,
         coalesce(stddev_pop(mark) FILTER (what = 'allow'), 0) + 1e-6 AS sa,
         coalesce(stddev_pop(mark) FILTER (what = 'block'), 0) + 1e-6 AS sr
  FROM j JOIN marks USING (k) WHERE held AND what IS NOT NULL
)
SELECT d.page_id, d.host, d.path, j.rule,
       coalesce(j.what, CASE WHEN marks.mark < (SELECT (ma * sr + mr * sa) / (sa + sr) FROM stats)
                             THEN 'block' ELSE 'allow' END) AS verdict
FROM d JOIN j USING (host, path) JOIN marks USING (k)
"""

SQL["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3),
                       lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), sets AS (
  SELECT dense_rank() OVER (ORDER BY list_sort(s)) AS c, * FROM s
), one AS (
  SELECT c, any_value(s) AS s, any_value(len(s)) AS n FROM sets GROUP BY c
), grams AS (
  SELECT c, n, unnest(s) AS g FROM one
), links AS (
  SELECT a.c AS a, b.c AS b FROM grams a JOIN grams b USING (g)
  WHERE a.c <> b.c GROUP BY a.c, b.c, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT c AS a, c AS b FROM one
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), comp AS (
  SELECT reach.a AS c, min(doc_id) AS component_id
  FROM reach JOIN sets ON sets.c = reach.b GROUP BY 1
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
       CASE WHEN len(s) = 0 THEN doc_id ELSE component_id END AS component_id
FROM sets JOIN comp USING (c)
"""

SQL["op2_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))
        >= 0.98
), reach AS (
  SELECT r AS a, r AS b FROM v
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), comp AS (
  SELECT reach.a AS r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY 1
), n AS (
  SELECT a AS r, count(*) AS n FROM links GROUP BY 1
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id,
       vec_id = component_id AS kept
FROM v JOIN comp USING (r) LEFT JOIN n USING (r)
"""

SQL["op11_ranked_search"] = r"""
WITH d AS (
  SELECT * FROM (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents) WHERE len(w) > 0
), s AS (
  SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d
), q AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
), tf AS (
  SELECT r, doc_id, term, n, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf GROUP BY term
), scores AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf)
           // (1000 * tf + 20 * (50 + (50 * tf.n * s.n) // s.l)))) AS BIGINT) AS score
  FROM tf JOIN q USING (term) JOIN w USING (term), s
  GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

SQL["op13_prefix_trie"] = """
WITH own AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT conv_id, list({id: id, chars: chars} ORDER BY turn NULLS FIRST, id) AS t,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
               string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
             lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
               lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h
  FROM own GROUP BY conv_id
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.t[1:a.h], []), a.t[a.h + 1:]) AS p
  FROM whole a LEFT JOIN whole b ON b.conv_id = a.conv_id - a.conv_id % 100
), node AS (
  SELECT p[1:d] AS path, d, min(conv_id) AS conv_id, count(*) AS n,
         list(conv_id ORDER BY conv_id) FILTER (WHERE d = len(p)) AS ends
  FROM rebuilt, unnest(range(len(p) + 1)) u(d) GROUP BY 1, 2
), child AS (
  SELECT path[1:d - 1] AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1
), below AS (
  SELECT v.path[1:u.d] AS path, count(*) FILTER (WHERE c.n IS NULL) AS leaves,
         sum(CASE WHEN v.d > 0 THEN (v.n - 1) * v.path[v.d].chars ELSE 0 END) AS saved
  FROM (node v LEFT JOIN child c ON c.path = v.path), unnest(range(v.d + 1)) u(d) GROUP BY 1
)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(c.n, 0) AS n_children,
       b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(array_to_string(v.ends, ','), '')) AS ends_sha256
FROM node v JOIN below b ON b.path = v.path LEFT JOIN child c ON c.path = v.path
LEFT JOIN node p ON v.d > 0 AND p.path = v.path[1:v.d - 1]
"""
