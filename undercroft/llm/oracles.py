"""SQL of operators whose whole result SQL can state: plain definitions, all pairs and all products."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS shingle
  FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)
), edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
lowest AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN lowest ON lowest.a = d.doc_id
"""


def centroids_sql(k: int = 40, rounds: int = 5, width: int = 64, seed: int = 2) -> str:
    """The rounds of the clustering one after the other, every vector against every centroid."""
    assign = """
a{r} AS MATERIALIZED (
  SELECT vec_id, e, cluster, distance FROM (
    SELECT v.vec_id, v.e, c.cluster, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance,
           row_number() OVER (PARTITION BY v.vec_id ORDER BY distance, c.cluster) AS nearest
    FROM v, c{r} c) x WHERE nearest = 1
)"""
    move = """
m{s} AS (
  SELECT cluster, list(CAST(floor_div ORDER BY i AS BIGINT)) AS e FROM (
    SELECT cluster, i, CASE WHEN t % n < 0 THEN t // n - 1 ELSE t // n END AS floor_div FROM (
      SELECT cluster, i, CAST(sum(e[i]) AS BIGINT) AS t, count(*) AS n
      FROM (SELECT cluster, e, unnest(range(1, {w} + 1)) AS i FROM a{r}) u GROUP BY cluster, i) g) h GROUP BY cluster
),
c{s} AS MATERIALIZED (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{s} m ON m.cluster = c.cluster)"""
    move = move.replace("list(CAST(floor_div ORDER BY i AS BIGINT))", "list(CAST(floor_div AS BIGINT) ORDER BY i)")
    parts = [f"""
v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, e
  FROM (SELECT e, sha256('{seed}:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}) f
)"""]
    for r in range(rounds):
        parts += [assign.format(r=r), move.format(r=r, s=r + 1, w=width)]
    parts.append(assign.format(r=rounds))
    return f"""WITH {','.join(parts)}
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


#: A feature's CRC byte by byte, with the table of the 256 remainders made from its polynomial.
IMPORTANCE_RESAMPLING = rf"""
WITH t AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, s:
    CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) AS remainder
), texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark
), w AS MATERIALIZED (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), f AS MATERIALIZED (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
         list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature FROM w
), b AS MATERIALIZED (
  SELECT feature, xor(list_reduce(list_transform(range(1, strlen(feature) + 1), lambda i: CAST('0x' || substr(h, CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)),
    lambda c, byte: xor(c >> 8, remainder[xor(c % 256, byte) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature, hex(feature) AS h FROM f) x, t
), c AS (
  SELECT bucket, CAST(count_if(side = 'd') AS DOUBLE) AS s, CAST(count_if(side = 't') AS DOUBLE) AS t FROM f JOIN b USING (feature) GROUP BY bucket
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM c
), weights AS (
  SELECT id, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN b USING (feature) JOIN g USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT w.id AS doc_id, len(w) AS n_words, greatest(len(w), 0) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features,
         coalesce(weight, 0) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('42:' || w.id), 1, 8)) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN weights ON weights.id = w.id WHERE side = 'd'
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count_if(n_words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM r
"""
