"""DuckDB SQL for the queries that SQL can express, worked out by brute force."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _words(table: str, key: str, pattern: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{pattern}') AS w FROM {table}"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = f"""
WITH d AS ({_words("documents", "doc_id", _ALNUM)}),
b AS ({_words("benchmark", "CAST(item_id AS VARCHAR) AS item_id", _ALNUM)}),
starts AS (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS s FROM starts),
sizes AS (SELECT DISTINCT m FROM windows),
runs AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes WHERE len(w) >= m),
hits AS (SELECT r.doc_id, r.p, r.m, x.item_id FROM runs r JOIN windows x ON x.m = r.m AND x.s = array_to_string(r.w[r.p:r.p + r.m - 1], ' ')),
marked AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS place FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(marked.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(named.ids, '')) AS items_sha256, coalesce(marked.n, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""

NEIGHBOURS = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

JACCARD = f"""
WITH RECURSIVE d AS ({_words("documents", "doc_id", r"[^\x20\x09-\x0D]+")}),
runs AS (SELECT doc_id, w, least(5, len(w)) AS m, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM d WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[p:p + m - 1], ' ')) AS s FROM runs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(least_of.least, d.doc_id)) AS BIGINT) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON least_of.a = d.doc_id
"""

LINES = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS place FROM parts),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), {_AZ}) AS k FROM lines),
first AS (SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT keyed.*, first.k IS NOT NULL AND keyed.doc_id <> first.keeper AS gone FROM keyed LEFT JOIN first USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
newest AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS newest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM newest
"""


def sharding(key: str, table: str, shards: list[str], slots: int) -> str:
    """Turn by turn: each shard walks its own order of slots to the first free one."""
    names = ", ".join(f"'{s}'" for s in shards)
    number = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
    return f"""
WITH RECURSIVE names AS (SELECT unnest([{names}]) AS name, unnest(range(0, {len(shards)})) AS id),
prefer AS (SELECT n.id, list(({number.format("'offset:' || n.name")} + j * ({number.format("'skip:' || n.name")} % {slots - 1} + 1)) % {slots} ORDER BY j) AS slots
           FROM names n, range(0, {slots}) AS r(j) GROUP BY n.id),
turns(turn, taken) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT turn + 1, list_append(taken, list_filter(p.slots, lambda s: NOT list_contains(taken, s))[1])
  FROM turns JOIN prefer p ON p.id = turn % {len(shards)} WHERE turn < {slots}),
filled AS (SELECT taken FROM turns WHERE turn = {slots}),
placed AS (SELECT unnest(taken) AS slot, unnest(range(0, {slots})) % {len(shards)} AS id FROM filled)
SELECT t.{key}, placed.slot, names.name AS shard
FROM {table} t JOIN placed ON placed.slot = {number.format(f"coalesce(CAST(t.{key} AS VARCHAR), '')")} % {slots} JOIN names USING (id)
"""


def centroids(k: int, rounds: int, dim: int, scale: int, seed: int) -> str:
    """Every vector against every centroid, round after round."""
    steps = [
        f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INTEGER) AS cluster, x FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})"""
    ]
    for r in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS HUGEINT)))"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, arg_min(cluster, (far, cluster)) AS cluster, min(far) AS far, first(x) AS x FROM (SELECT v.vec_id, c.cluster, v.x, {far} AS far FROM v, c{r} c) GROUP BY vec_id)")
        if r < rounds:
            parts = f"SELECT cluster, unnest(x) AS s, unnest(range(0, {dim})) AS i FROM a{r}"
            floors = "CAST((sum(s) - ((sum(s) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
            means = f"SELECT cluster, list(m ORDER BY i) AS x FROM (SELECT cluster, i, {floors} AS m FROM ({parts}) GROUP BY cluster, i) GROUP BY cluster"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN ({means}) m USING (cluster))")
    return (
        ",\n".join(steps)
        + f"""
SELECT a.vec_id, a.cluster, CAST(a.far AS BIGINT) AS distance, CAST(sum(a.far) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.far) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""
    )


def suffixes(length: int) -> str:
    """Every string of `length` bytes of every text, counted."""
    n = length
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
parts AS (SELECT doc_id, unnest(range(0, n - {n - 1}, {n})) AS b, h, n FROM d WHERE n >= {n}),
cut AS MATERIALIZED (SELECT doc_id, b, least({n}, n - {n - 1} - b) AS most, substr(h, 2 * b + 1, {4 * n}) AS h FROM parts),
m AS (SELECT doc_id, unnest(list_transform(range(0, most), lambda p: md5_number(substr(h, 2 * p + 1, {2 * n})))) AS k, b + unnest(range(0, most)) AS p FROM cut),
again AS (SELECT k FROM m GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {n}, -1) AS new FROM m SEMI JOIN again USING (k)),
runs AS (SELECT doc_id, min(p) AS a, max(p) + {n} AS b FROM (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM hit) GROUP BY doc_id, g),
cuts AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
kept AS (SELECT doc_id, count(*) AS spans, sum(b - a) AS gone, max(b) AS last, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS h FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept.h || substr(d.h, CAST(2 * last + 1 AS BIGINT)), d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
