"""SQL (DuckDB) for the rows of the operators that SQL can express, by plain joins over all shingles and matches."""

from __future__ import annotations

from sparkloom.llm.decontam import SIMILARITY
from sparkloom.llm.secrets import ACCESS, ASSIGN, ASSIGN_LEAST, HEX, SHARED_OWNERS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _matches(kind: int, pattern: str, group: int, least: int) -> str:
    """Matches of a pattern with their places: sums of what lies before, in order."""
    p = pattern.replace("'", "''")
    return f"""SELECT rid, {kind} AS k, v, e - w AS s, e FROM (SELECT rid, i, v, w, sum(g + w) OVER (PARTITION BY rid ORDER BY i) AS e FROM (
    SELECT rid, unnest(range(1, len(m) + 1)) AS i, unnest(v) AS v, unnest(list_transform(m, lambda x: length(x))) AS w, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS g
    FROM (SELECT rid, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v, regexp_split_to_array(t, '{p}') AS g FROM d))) WHERE length(v) >= {least}"""


_NAME = "['assign', 'access', 'hex', 'opaque'][k + 1]"
SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner FROM documents),
base AS ({_matches(0, ASSIGN, 1, ASSIGN_LEAST)} UNION ALL {_matches(1, ACCESS, 0, 16)} UNION ALL {_matches(2, HEX, 0, 32)}),
opaque AS (SELECT * FROM ({_matches(3, "[A-Za-z0-9+/_-]{24,}", 0, 24)}) o WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = o.rid AND o.s < b.e AND o.e > b.s)),
found AS (SELECT * FROM base UNION ALL SELECT * FROM opaque), freq AS (SELECT v, count(DISTINCT owner) AS owners FROM found JOIN d USING (rid) GROUP BY v),
judged AS (SELECT f.*, owners < {SHARED_OWNERS} AS live FROM found f JOIN freq USING (v)),
per AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg({_NAME} || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
  string_agg({_NAME} || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3 OR live) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_shared FROM judged GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared
FROM d LEFT JOIN per USING (rid)"""

COMPONENTS = f"""WITH RECURSIVE wd AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
st AS MATERIALIZED (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM wd),
sh AS (SELECT rid, unnest(s) AS h FROM st WHERE doc_id IS NOT NULL), many AS (SELECT h FROM sh GROUP BY h HAVING count(*) > 1), sm AS MATERIALIZED (SELECT rid, h FROM sh SEMI JOIN many USING (h)), pr AS (SELECT a.rid AS a, b.rid AS b, count(*) AS n FROM sm a JOIN sm b USING (h) GROUP BY 1, 2),
sz AS MATERIALIZED (SELECT rid, doc_id, len(s) AS k FROM st), lk AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM pr JOIN sz x ON x.rid = a JOIN sz y ON y.rid = b WHERE a < b AND 100 * n >= 85 * (x.k + y.k - n)), edge AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
reach AS (SELECT doc_id AS a, doc_id AS b FROM st WHERE doc_id IS NOT NULL UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, coalesce(doc_id = c, true) AS kept FROM st LEFT JOIN comp ON a = doc_id"""


def _shingled(table: str, key: str) -> str:
    return f"""SELECT rid, {key}, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) AS s
    FROM (SELECT row_number() OVER () AS rid, {key}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table})"""


#: Every start from the first to the last place at which the item's shingles are in reach, not only the best ones.
DECONTAMINATION = f"""WITH ds AS ({_shingled("documents", "doc_id")}), its AS (SELECT * FROM ({_shingled("benchmark", "item_id")}) WHERE len(s) > 0),
ish AS (SELECT item_id, len(s) AS n, unnest(s) AS h FROM its), ic AS (SELECT item_id, n, h, count(*) AS ni FROM ish GROUP BY ALL), dsh AS (SELECT rid, len(s) AS size, unnest(s) AS h, unnest(range(0, len(s))) AS p FROM ds),
hit AS (SELECT rid, size, p, d.h, item_id, n, ni FROM dsh d JOIN ic ON d.h = ic.h), near AS (SELECT rid, item_id, n, size, min(p) AS lo, max(p) AS hi FROM hit GROUP BY ALL HAVING count(*) >= {SIMILARITY} * n - 1e-9),
win AS (SELECT *, unnest(range(lo - n + 1, hi + 1)) AS start FROM near), cnt AS (SELECT w.rid, w.item_id, w.n, w.size, start, h, least(count(*), any_value(ni)) AS c FROM win w JOIN hit ON hit.rid = w.rid AND hit.item_id = w.item_id AND p >= start AND p < start + w.n GROUP BY ALL),
sim AS (SELECT rid, item_id, max(x::DOUBLE / (n + m - x)) AS sim FROM (SELECT rid, item_id, n, least(size, start + n) - greatest(start, 0) AS m, sum(c) AS x FROM (SELECT DISTINCT rid, item_id, n, size, start, h, c FROM cnt) GROUP BY rid, item_id, n, size, start) GROUP BY ALL),
good AS (SELECT rid, count(*) AS k, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items, max(sim) AS sim FROM sim WHERE sim >= {SIMILARITY} GROUP BY rid)
SELECT doc_id, k IS NOT NULL AS contaminated, coalesce(k, 0) AS n_items, coalesce(items, '') AS items, coalesce(sim, 0) AS similarity FROM ds LEFT JOIN good USING (rid)"""

def _kmeans(k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64) -> str:
    """All distances in every round, as whole numbers."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})""",
        f"""c0 AS MATERIALIZED (SELECT CAST(r - 1 AS INT) AS c, x FROM (SELECT x, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) AS r FROM v) WHERE r <= {k})""",
    ]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT rid, c, d FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS r FROM (
    SELECT rid, c, CAST(list_sum(list_transform(list_zip(v.x, c{t}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{t})) WHERE r = 1)""")
        if t < rounds:
            steps.append(f"""m{t} AS (SELECT c, list(q ORDER BY p) AS x FROM (SELECT c, p, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS q FROM (
    SELECT c, p, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS y, unnest(range({dimensions})) AS p FROM a{t} JOIN v USING (rid)) GROUP BY c, p)) GROUP BY c),
c{t + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, o.x) AS x FROM c{t} o LEFT JOIN m{t} m USING (c))""")
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)}, f AS (SELECT c, CAST(sum(d) AS BIGINT) AS own FROM {last} GROUP BY c)
SELECT vec_id, c AS cluster, d AS distance, own AS cluster_inertia, CAST((SELECT sum(d) FROM {last}) AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM {last} JOIN v USING (rid) JOIN f USING (c) JOIN c{rounds} USING (c)"""


_HASHED = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
FILL_IN_MIDDLE = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, {_HASHED} FROM t),
c AS (SELECT doc_id, text, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

ORACLES = {
    "op4_decontamination": DECONTAMINATION, "op5_secrets": SECRETS, "op10_minhash_components": COMPONENTS, "op11_ball_kmeans": _kmeans(), "op12_fill_in_middle": FILL_IN_MIDDLE,
}
