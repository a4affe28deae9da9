"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
win AS (
  SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w)),
again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM win) WHERE k > 1),
rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
m AS (
  SELECT w.doc_id, w.t, len(words) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR n_symbols > 0.35 * greatest(n_words, 1)
    OR NOT (word_chars / greatest(n_words, 1) BETWEEN 1.5 AND 20)
    OR (n_dup_lines >= 3 AND n_dup_lines > 0.4 * n_lines)
    OR len(list_filter(regexp_extract_all(t, '\p{L}+'), lambda x: regexp_full_match(x, '\p{Lu}{2,}'))) > 0.5 * greatest(n_words, 1)
    OR len(regexp_extract_all(t, '!')) > 0.5 * greatest(n_words, 1)
    OR len(regexp_extract_all(t, '\p{L}')) < 0.5 * greatest(word_chars, 1)
    OR len(regexp_extract_all(t, '(?:\.{3}|…)[ \t]*(?:\n|\z)')) > 0.5 * greatest(n_lines, 1)
    OR (n_lines >= 5 AND len(regexp_extract_all(t, '(?m)^[ \t]*[-*•][ \t]')) > 0.9 * n_lines)) AS kept
FROM b
"""

BM25_TOP_K = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS words
  FROM documents),
n AS (SELECT count(*) AS docs, sum(len(words)) / count(*) AS mean FROM d),
p AS (SELECT r, doc_id, len(words) AS dl, w AS term, count(*) AS tf
      FROM (SELECT r, doc_id, words, unnest(words) AS w FROM d) GROUP BY ALL),
df AS (SELECT term, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, n GROUP BY term, docs),
q AS (
  SELECT doc_id AS query_id, term, idf * sum(tf) AS weight
  FROM p JOIN df USING (term) WHERE doc_id % 50 = 0 GROUP BY doc_id, term, idf),
s AS (
  SELECT query_id, r, p.doc_id,
         round(sum(q.weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM q JOIN p USING (term), n GROUP BY query_id, r, p.doc_id),
t AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM s)
SELECT * FROM t WHERE rank <= 10
"""


def _centroid_rounds(rounds: int) -> str:
    """Nearest centroids and their new components, a pair of CTEs per round."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT r, vec_id, x, min(struct_pack(distance := list_sum(list_transform(list_zip(x, mid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := c)) AS near
  FROM v, c{r} GROUP BY r, vec_id, x)""")
        if r < rounds:
            parts.append(f"""
s{r} AS MATERIALIZED (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS mid
  FROM (SELECT near.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY near.c, i) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(s{r}.mid, c{r}.mid)::BIGINT[] AS mid FROM c{r} LEFT JOIN s{r} USING (c))""")
    return ",".join(parts)


CENTROIDS = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x AS mid FROM v QUALIFY c < 8),{_centroid_rounds(10)},
f AS (SELECT vec_id, near.c AS c, near.distance::BIGINT AS d FROM a10)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(mid, ',')) AS centroid_sha256
FROM f JOIN c10 USING (c)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[i : i + 3], ' ') AS g
  FROM (SELECT r, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM g GROUP BY r),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS k FROM g AS x JOIN g AS y ON x.g = y.g AND x.r <> y.r GROUP BY x.r, y.r)
  JOIN n AS p ON p.r = a JOIN n AS q ON q.r = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT reach.a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d LEFT JOIN n USING (r) JOIN least USING (r)
"""

RANKED_SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS total FROM d),
q AS (
  SELECT i, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS i, item_id,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
p AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term),
m AS (
  SELECT i, item_id, r, doc_id,
         sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total)))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY i, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM m WHERE score > 0) WHERE rank <= 20
"""
