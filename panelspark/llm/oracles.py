"""DuckDB SQL of the corpus queries that SQL can express, written apart from the operators."""

from __future__ import annotations

FILTER_AUDIT = """
WITH body AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
firsts AS (SELECT body, min(doc_id) AS first_id FROM body GROUP BY body),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
          FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(words) < 200)::INT AS fa,
         (100 * len(list_distinct(words)) < 50 * len(words))::INT AS fb,
         (100 * len(regexp_extract_all(b.body, '[A-Z]')) > 2 * length(b.body))::INT AS fc,
         regexp_matches(b.body, '[#$%&*|]')::INT AS fd,
         coalesce(b.doc_id > f.first_id, false)::INT AS fe
  FROM body b JOIN firsts f ON b.body = f.body LEFT JOIN marks m ON b.doc_id = m.doc_id),
cells AS (SELECT part, fa + 2 * fb + 4 * fc + 8 * fd + 16 * fe AS failing, count(*) AS n, sum(good::INT) AS good, sum(toxic::INT) AS toxic
          FROM flags GROUP BY ALL),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, step, l.letter AS filter, l.bit AS own,
         coalesce((SELECT sum(x.bit) FROM letters x WHERE strpos(left(filter_order, step - 1), x.letter) > 0), 0) AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step) s, letters l WHERE substr(filter_order, step, 1) = l.letter),
counted AS (
  SELECT c.part, filter_order, step, any_value(filter) AS filter,
         sum(CASE WHEN failing & (earlier + own) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN failing & earlier = 0 AND failing & own > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN failing & earlier > 0 AND failing & own > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failing = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN failing & earlier = 0 AND failing & own > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN failing & earlier = 0 AND failing & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells c, steps s GROUP BY c.part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""


def orchard_clusters(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """Rounds of exhaustive assignment and exact means; no neighbour list."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE len(embedding) = {size} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x) AND abs(x) <= 524288]) = {size}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY name) - 1 AS c, q AS v
  FROM (SELECT sha256('2:' || vec_id) AS name, q FROM kept ORDER BY name LIMIT {k}))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT row_id, any_value(vec_id) AS vec_id, any_value(q) AS q, min(d) AS d, arg_min(c, d * {k} + c) AS c
  FROM (SELECT row_id, vec_id, q, c, list_sum([(q[i] - v[i]) * (q[i] - v[i]) FOR i IN range(1, {size + 1})])::BIGINT AS d
        FROM kept, c{i}) GROUP BY row_id)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
    FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n
          FROM (SELECT c, unnest(q) AS x, unnest(range({size})) AS i FROM a{i}) GROUP BY c, i)
    GROUP BY c) m ON o.c = m.c)""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} o ON a.c = o.c
"""


ORACLE_SQL = {"op12_filter_audit": FILTER_AUDIT, "op13_orchard_clusters": orchard_clusters()}
