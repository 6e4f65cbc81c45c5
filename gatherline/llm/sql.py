"""SQL (DuckDB) of the contract queries that SQL can express."""

from __future__ import annotations

from itertools import permutations

WORD_GAP = r"[ \t\n\v\f\r]+"


def clusters(k: int = 40, rounds: int = 5) -> str:
    nearest = """
  near{r} AS MATERIALIZED (
    SELECT v.vec_id, v.x, arg_min(c.i, struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, i := c.i)) AS cluster,
           min(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT) AS distance
    FROM v, c{r} c GROUP BY v.vec_id, v.x),"""
    moved = """
  cells{r} AS (SELECT cluster, unnest(x) AS a, generate_subscripts(x, 1) AS d FROM near{r}),
  means{r} AS (SELECT cluster, d, sum(a) AS s, count(*) AS n FROM cells{r} GROUP BY ALL),
  moved{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) / n)::DOUBLE::BIGINT ORDER BY d) AS x FROM means{r} GROUP BY cluster),
  c{n} AS MATERIALIZED (SELECT c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN moved{r} m ON m.cluster = c.i),"""
    body = "".join(nearest.format(r=r) + moved.format(r=r, n=r + 1) for r in range(rounds)) + nearest.format(r=rounds)
    return f"""WITH v AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * 256)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
  c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS i, x FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k}),{body}
  sums AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM near{rounds} GROUP BY cluster)
SELECT vec_id, n.cluster::INT AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM near{rounds}) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM near{rounds} n JOIN sums USING (cluster) JOIN c{rounds} c ON c.i = n.cluster"""


MIX = rf"""WITH d AS (
    SELECT doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '{WORD_GAP}'), lambda w: w <> '')), 0)::BIGINT AS size FROM documents),
  entry AS MATERIALIZED (SELECT source, doc_id, size, count(*) AS n FROM d GROUP BY ALL),
  by_source AS (SELECT source, sum(size * n)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM entry GROUP BY source),
  weighed AS (SELECT *, 1 + sid % 3 AS w, row_number() OVER (ORDER BY 3 * words / (1 + sid % 3)::DOUBLE, sid) AS k FROM by_source),
  shared AS (
    SELECT *, (sum(words) OVER () - coalesce(sum(3 * words) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest,
           sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS share FROM weighed),
  level AS (SELECT arg_min(rest, k) AS rest, arg_min(share, k) AS share, min(k) AS k FROM shared WHERE rest * w / share <= 3 * words),
  goal AS MATERIALIZED (
    SELECT sid, source, words, CASE WHEN s.k < l.k THEN (3 * words)::DOUBLE ELSE l.rest * w / l.share END AS target FROM shared s, level l),
  queue AS MATERIALIZED (
    SELECT sid, doc_id, size, n, target, words, pass,
           pass * words + (sum(size * n) OVER (PARTITION BY sid, pass ORDER BY md5(pass || ':' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)) - size * n AS place
    FROM (SELECT e.doc_id, e.size, e.n, g.*, unnest(range(0, greatest(1, CASE WHEN g.words > 0 THEN ceil(g.target / g.words) ELSE 1 END)::BIGINT)) AS pass
          FROM entry e JOIN goal g ON e.source IS NOT DISTINCT FROM g.source)),
  packet AS (
    SELECT sid, target, place, size * n AS m, unnest(range(0, (size * n + 511) // 512)) AS i FROM queue WHERE size > 0),
  timed AS (SELECT sid, place + least((i + 1) * 512, m) AS "end", least((i + 1) * 512, m) - i * 512 AS words, (place + least((i + 1) * 512, m))::BIGINT / target AS finish FROM packet),
  summed AS (SELECT *, sum(words) OVER (ORDER BY finish, sid, "end" ROWS UNBOUNDED PRECEDING) AS so_far FROM timed),
  reach AS MATERIALIZED (
    SELECT sid, sum(least(words, (SELECT sum(words) FROM goal) - (so_far - words))) AS reach FROM summed WHERE so_far - words < (SELECT sum(words) FROM goal) GROUP BY sid),
  taken AS (
    SELECT q.doc_id, q.size, q.n, q.target, q.words, sum(greatest(0, least(q.n * q.size, coalesce(r.reach, 0) - q.place)))  AS got,
           list(greatest(0, least(q.n * q.size, coalesce(r.reach, 0) - q.place))) AS gots
    FROM queue q LEFT JOIN reach r USING (sid) GROUP BY q.sid, q.doc_id, q.size, q.n, q.target, q.words)
SELECT doc_id, size, words AS source_size, target,
       list_sum(list_transform(gots, lambda g: greatest(0, least(size, g - j * size))))::BIGINT AS taken
FROM (SELECT *, unnest(range(0, n)) AS j FROM taken)"""


def audit() -> str:
    orders = [p for p in permutations(range(5))]
    steps = ", ".join(
        f"('{''.join('ABCDE'[i] for i in p)}', {s + 1}, {sum(1 << i for i in p[:s])}, {1 << p[s]})" for p in orders for s in range(5)
    )
    return rf"""WITH t AS (
    SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(coalesce(text, ''), '{WORD_GAP}'), lambda w: w <> '') AS words FROM documents),
  f AS (
    SELECT part, doc_id,
      (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * list_unique(words) < 50 * len(words) THEN 2 ELSE 0 END)
      + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END)
      + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
      + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS fails FROM t),
  l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
  masks AS MATERIALIZED (
    SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
    FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
  steps AS (SELECT * FROM (VALUES {steps}) AS s(filter_order, step, before, own)),
  rows AS (
    SELECT part, filter_order, step, own,
      coalesce(sum(n) FILTER (fails & (before | own) = 0), 0)::BIGINT AS kept,
      coalesce(sum(n) FILTER (fails & before = 0 AND fails & own > 0), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (fails & before > 0 AND fails & own > 0), 0)::BIGINT AS redundant,
      coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (fails & before = 0 AND fails & own > 0), 0)::BIGINT AS good_lost,
      coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & own > 0), 0)::BIGINT AS toxic_lost
    FROM masks, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM rows"""
