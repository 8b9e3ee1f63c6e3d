"""DuckDB SQL for the operators that SQL can express."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS t
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT doc_id, item_id, m, i FROM o JOIN p USING (m, t)),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.t = b.t AND a.doc_id <> b.doc_id JOIN c ca ON ca.doc_id = a.doc_id JOIN c cb ON cb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, ca.n, cb.n HAVING count(*) >= 0.8 * (ca.n + cb.n - count(*)) - 1e-12),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
k AS (SELECT x AS doc_id, min(y) AS class_id FROM r GROUP BY x),
m AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, doc_id = class_id AS is_first FROM k LEFT JOIN m USING (doc_id)
"""


def _rounds(count: int) -> str:
    """Assignments a0, a1, ... to centroids c0, c1, ...; the last assignment is to c{count}."""
    out = []
    for k in range(count + 1):
        out.append(f"""a{k} AS MATERIALIZED (SELECT rn, any_value(vec_id) AS vec_id, any_value(v.v) AS v, min({{'d': list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(v.v, c.v)]), 'c': c.c}}) AS m FROM v, c{k} c GROUP BY rn)""")
        if k < count:
            out.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.c, coalesce(any_value(n.v), any_value(c.v)) AS v FROM c{k} c LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
      FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{k}) GROUP BY c, i) GROUP BY c) n USING (c) GROUP BY c.c)""")
    return ",\n".join(out)


CENTROIDS = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rn, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS v FROM embeddings
      WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, vec_id, v FROM v ORDER BY h LIMIT 8)),
{_rounds(10)},
s AS (SELECT m.c AS c, sum(m.d) AS s FROM a10 GROUP BY m.c)
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(s.s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(s) FROM s) AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a10 JOIN s ON s.c = a10.m.c JOIN c10 c ON c.c = a10.m.c
"""

PHRASES = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, m, w[i:i + m - 1] AS w, count(*) AS f FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= 100),
inside AS (SELECT lang, w[i:i + j - 1] AS w, max(f) AS f FROM (SELECT lang, w, f, j, unnest(range(1, len(w) - j + 2)) AS i FROM f, (SELECT unnest(range(2, 5)) AS j) WHERE len(w) > j) GROUP BY ALL),
c AS (SELECT f.lang, f.w, f.m, f.f AS a FROM f LEFT JOIN inside i USING (lang, w) WHERE f.m > 1 AND (i.f IS NULL OR 100 * i.f < 100 * f.f)),
s AS (SELECT c.lang, c.w, c.a, n.n, k, x.f AS l, y.f AS r, (1000 * CAST(c.a AS HUGEINT) * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
      FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN n USING (lang) JOIN f x ON x.lang = c.lang AND x.w = c.w[1:k] JOIN f y ON y.lang = c.lang AND y.w = c.w[k + 1:c.m]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
o AS (SELECT *, array_to_string(w, ' ') AS phrase FROM b)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o
QUALIFY rank <= 2000
"""
