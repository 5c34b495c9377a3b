"""DuckDB SQL for the queries, over views of the same tables."""

from __future__ import annotations

_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label, label IN (3, 7) AS flagged FROM embeddings)"
_NV = _V + ", nv AS (SELECT id, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) AS u FROM v)"
_LOG = """l AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS session_id, 'doc_' || user_id AS query_doc_id, 'doc_' || (event_id % 50) AS result_doc_id,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'high' WHEN event_type = 'click' THEN 'medium' WHEN event_type = 'error' THEN 'low' ELSE event_type END AS confidence,
  event_id % 4 AS stages_used, event_type <> 'error' AS correct, ts FROM events)"""
_STATS = """s AS (SELECT query_doc_id, count(*) FILTER (confidence = 'high') AS n_high, count(*) FILTER (confidence NOT IN ('high', 'low')) AS n_medium,
  count(*) FILTER (confidence = 'low') AS n_low, count(*) AS n_total, max(ts) AS last_updated FROM l GROUP BY 1)"""
_PAIRS = "p AS (SELECT query_doc_id AS doc_a, result_doc_id AS doc_b, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM l WHERE NOT correct GROUP BY 1, 2)"
_PARTNERS = """b AS (SELECT doc_a AS query_doc_id, doc_b AS partner, 0 AS side, n FROM p UNION ALL SELECT doc_b, doc_a, 1, n FROM p),
  pa AS (SELECT *, row_number() OVER (PARTITION BY query_doc_id ORDER BY side, n DESC, partner) AS pos FROM b)"""
_PRIOR = _LOG + ", " + _STATS + """, c AS (SELECT 'doc_' || c_custkey AS query_doc_id FROM customer),
  pr AS (SELECT query_doc_id, coalesce(n_high, 0) AS n_high, coalesce(n_medium, 0) AS n_medium, coalesce(n_low, 0) AS n_low, coalesce(n_total, 0) AS n_total FROM c LEFT JOIN s USING (query_doc_id))"""


def _ranked(scores: str, k: int, columns: str = "query_id, rank, id, round(score, 6) AS score") -> str:
    """scores: a table s of query_id, id, score, as a list of common table expressions."""
    return f"""WITH {scores}, r AS (SELECT *, row_number() OVER w - 1 AS rank, lead(score) OVER w AS after FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id)),
m AS (SELECT *, CASE WHEN rank = 0 THEN coalesce(score - after, 0) ELSE 0 END AS margin FROM r)
SELECT {columns} FROM m WHERE rank < {k}"""


def _scores(corpus: str = "v", cosine: bool = False, asked: str = "id % 50 = 0") -> str:
    head = _NV if cosine else _V
    q, c = ("nv", "u") if cosine else ("v", "vec")
    corpus = ("nv" if cosine else "v") if corpus == "v" else corpus
    return f"{head}, s AS (SELECT q.id AS query_id, c.id, list_dot_product(q.{c}, c.{c}) AS score FROM {q} q, {corpus} c WHERE q.{asked})"


_VERSIONS = """ve AS (SELECT id, vec, id AS position FROM v UNION ALL SELECT id, list_transform(vec, lambda x: -x), id + 1000000000 FROM v WHERE id % 5 = 0),
  la AS (SELECT id, arg_max(vec, position) AS vec, max(position) AS position FROM ve GROUP BY id)"""


def _versioned(where: str) -> str:
    return f"{_V}, {_VERSIONS}, s AS (SELECT q.id AS query_id, c.id, list_dot_product(q.vec, c.vec) AS score FROM v q, la c WHERE q.id % 50 = 0 AND {where})"


_LONG = "lo AS (SELECT id, (p - 1) // 8 AS layer, CAST((p - 1) % 8 AS INT) AS dim, vec[p] AS x FROM (SELECT id, vec, unnest(range(1, 65)) AS p FROM v))"


def _fourier(long: str, n: int, unit_layers: bool) -> str:
    x = "x / greatest(sqrt(sum(x * x) OVER (PARTITION BY id, layer)), 1e-12)" if unit_layers else "x"
    return f"""(SELECT id, freq, dim, a / greatest(sqrt(sum(a * a) OVER (PARTITION BY id, freq)), 1e-12) AS x FROM (
  SELECT id, freq, dim, sqrt(sum(x * cos(2 * pi() * freq * layer / {n})) ** 2 + sum(x * sin(2 * pi() * freq * layer / {n})) ** 2) AS a
  FROM (SELECT id, layer, dim, {x} AS x FROM {long}), (SELECT unnest([0, 1]) AS freq) GROUP BY 1, 2, 3))"""


_POOL = "po AS (SELECT id, dim, avg(x) AS x FROM lo GROUP BY 1, 2)"
_BASIS = """b0 AS (SELECT CAST(c AS INT) AS comp, CAST(d AS INT) AS dim, cos(pi() * (2 * d + 1) * c / 16) AS b FROM range(4) t(c), range(8) u(d)),
  ba AS (SELECT comp, dim, b / sqrt(sum(b * b) OVER (PARTITION BY comp)) AS b FROM b0)"""
_LAYERS = "la AS (SELECT id, CAST(k AS INT) AS layer, vec[8 * k + 1 : 8 * k + 8] AS x FROM v, range(8) t(k))"
_BIG = lambda x: f"list_max(list_transform({x}, lambda e: abs(e)))"
_CODE = lambda x, s: f"list_transform({x}, lambda e: CAST(greatest(-127, least(127, round_even(e / {s}, 0))) AS INT))"
_DELTA = f"""de AS (SELECT id, layer, x, CASE WHEN before IS NOT NULL THEN list_transform(range(1, 9), lambda i: x[i] - before[i]) END AS d
  FROM (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY layer) AS before FROM la)),
  ds AS (SELECT *, greatest({_BIG('d')}, 1e-8) / 127 AS scale FROM de), dc AS (SELECT *, {_CODE('d', 'scale')} AS codes FROM ds)"""
_STREAMS = """st AS (SELECT l_suppkey AS stream, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS cell FROM lineitem),
  bl AS (SELECT stream, cell // 256 AS block, count(*) AS n_tokens FROM st GROUP BY 1, 2)"""
_MAN = """ma AS (SELECT 'docs/' || lang || '/' || doc_id || '.md' AS path, source AS project, sha256(text) AS hash, n_chars // 2000 + 1 AS n_chunks, doc_id FROM documents),
  old AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE hash END AS hash, n_chunks FROM ma WHERE doc_id % 3 <> 0)"""
_STOP = "['the','a','an','is','are','was','were','in','of','to','and','or','that','this','it','with','for','on','at','by','from','be','has','have','had']"
_WORDS = lambda x: f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)))"
_JACCARD = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END"
_SLUG = lambda p: f"trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace({p}, '^.*/', ''), '\\.[^.]*$', ''), '[_\\s]+', '-', 'g')), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-')"
_NEAR = f"""{_NV}, s AS (SELECT q.id AS query_id, c.id, list_dot_product(q.u, c.u) AS score FROM nv q, nv c WHERE q.id <> c.id),
  r AS (SELECT *, row_number() OVER w AS n, score - lead(score) OVER w AS lead FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id)),
  h AS (SELECT r.*, a.label AS src, b.label AS dst FROM r JOIN v a ON a.id = r.query_id JOIN v b ON b.id = r.id WHERE n = 1)"""


def _stages(limit: str, first: str = "SELECT id FROM nv WHERE id % 50 = 0", more: str = "", last: str = "") -> str:
    """Stages 1 to 3; limit: SQL of a query's tau, by query_id."""
    return f"""WITH {_NV}, c AS (SELECT id, u FROM nv), f AS (SELECT id FROM v WHERE flagged ORDER BY id LIMIT 5){more},
a AS (SELECT q.id AS query_id, v.vec, {limit} AS tau FROM ({first}) q JOIN v USING (id)),
s1 AS (SELECT query_id, tau, a.vec, c.id, list_dot_product(nq.u, c.u) AS score FROM a JOIN nv nq ON nq.id = query_id, c WHERE c.id <> query_id),
r1 AS (SELECT *, row_number() OVER w AS n, score - lead(score) OVER w AS margin FROM s1 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id)),
t1 AS (SELECT * FROM r1 WHERE n = 1),
o AS (SELECT query_id, tau, list_transform(range(1, 65), lambda i: t1.vec[i] * 0.7 + v.vec[i] * 0.3) AS m FROM t1 JOIN v ON v.id = t1.id WHERE margin < tau),
o2 AS (SELECT query_id, tau, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS u FROM o),
s2 AS (SELECT query_id, tau, o2.u AS qu, c.id, list_dot_product(o2.u, c.u) AS score FROM o2, c WHERE c.id <> query_id),
r2 AS (SELECT *, row_number() OVER w AS n, score - lead(score) OVER w AS margin FROM s2 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id)),
t2 AS (SELECT r2.*, v.flagged FROM r2 JOIN v ON v.id = r2.id WHERE n = 1),
un AS (SELECT query_id, f.id AS uid, row_number() OVER (PARTITION BY query_id ORDER BY f.id) AS k FROM t2, f WHERE flagged AND f.id <> t2.id AND f.id <> query_id),
pen AS (SELECT query_id, c.id, sum(0.5 * greatest(0, list_dot_product(nu.u, c.u) - 0.25)) AS p FROM un JOIN nv nu ON nu.id = uid, c WHERE k <= 3 GROUP BY 1, 2),
s3 AS (SELECT pen.query_id, tau, c.id, list_dot_product(t2.qu, c.u) - p AS score FROM pen JOIN t2 ON t2.query_id = pen.query_id JOIN c ON c.id = pen.id WHERE c.id <> pen.query_id),
r3 AS (SELECT *, row_number() OVER w AS n, score - lead(score) OVER w AS margin FROM s3 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id)),
al AS (SELECT query_id, id, score, margin, CASE WHEN margin >= 5 * tau THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, 1 AS stages_used, FALSE AS constraint_used FROM t1 WHERE margin >= tau
UNION ALL SELECT query_id, id, score, margin, CASE WHEN margin >= tau THEN 'MEDIUM' ELSE 'LOW' END, 2, FALSE FROM t2 WHERE NOT flagged
UNION ALL SELECT query_id, id, score, margin, CASE WHEN margin >= tau THEN 'MEDIUM' ELSE 'LOW' END, 3, TRUE FROM r3 WHERE n = 1{last})
SELECT query_id, id, round(score, 6) AS score, round(margin, 6) AS margin, confidence, stages_used, constraint_used FROM al"""


_PRIOR_MORE = """, lg AS (SELECT (event_id % 100) * 50 AS q, event_id % 400 + 1 AS r, event_type = 'error' AS wrong, event_id % 3 = 0 OR event_id % 100 < 10 AS low FROM events),
sg AS (SELECT q, count(*) AS n_total, count(*) FILTER (low) AS n_low FROM lg GROUP BY q),
pg AS (SELECT q AS doc_a, r AS doc_b, count(*) AS n FROM lg WHERE wrong GROUP BY 1, 2),
bg AS (SELECT doc_a AS q, doc_b AS partner, 0 AS side, n FROM pg UNION ALL SELECT doc_b, doc_a, 1, n FROM pg),
kg AS (SELECT q, partner FROM bg QUALIFY row_number() OVER (PARTITION BY q ORDER BY side, n DESC, partner) <= 3),
ch AS (SELECT nv.id, nv.u FROM nv JOIN sg ON sg.q = nv.id WHERE nv.id % 50 = 0 AND n_total >= 2 AND 2 * n_low > n_total AND EXISTS (SELECT 1 FROM kg JOIN c ON c.id = partner WHERE kg.q = nv.id AND partner <> nv.id)),
p0 AS (SELECT ch.id AS query_id, c.id, sum(0.5 * greatest(0, list_dot_product(k.u, c.u) - 0.25)) AS p FROM ch JOIN kg ON kg.q = ch.id AND partner <> ch.id JOIN c k ON k.id = partner, c WHERE c.id <> ch.id GROUP BY 1, 2),
s0 AS (SELECT query_id, c.id, list_dot_product(ch.u, c.u) - p AS score FROM p0 JOIN ch ON ch.id = query_id JOIN c ON c.id = p0.id),
r0 AS (SELECT *, row_number() OVER w AS n, score - lead(score) OVER w AS margin FROM s0 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id))"""

ORACLES: dict[str, str] = {
    "mips_topk": _ranked(_scores(), 5),
    "cosine_topk_margin": _ranked(_scores(cosine=True), 5, "query_id, rank, id, round(score, 6) AS score, round(margin, 6) AS margin"),
    "mips_filtered": _ranked(_scores(corpus="(SELECT * FROM v WHERE label = 1)"), 5) + " AND score >= 0.1",
    "latest_version_search": _ranked(_versioned("TRUE"), 5),
    "tombstone_search": _ranked(_versioned("c.id % 7 <> 0"), 5),
    "index_rebuild": f"WITH {_V}, {_VERSIONS} SELECT id, row_number() OVER (ORDER BY position) - 1 AS position, round(list_sum(vec), 6) AS vec_sum FROM la WHERE id % 7 <> 0",
    "get_vector": f"WITH {_NV} SELECT id, CAST(p - 1 AS INT) AS pos, round(u[p], 6) AS x FROM (SELECT id, u, unnest(range(1, 65)) AS p FROM nv)",
    "constrained_retrieve": _ranked(
        f"{_NV}, f AS (SELECT u AS fu FROM nv JOIN v USING (id) WHERE flagged ORDER BY id LIMIT 3), pe AS (SELECT id, sum(0.5 * greatest(0, list_dot_product(fu, u) - 0.1)) AS p FROM nv, f GROUP BY id), "
        "s AS (SELECT q.id AS query_id, c.id, list_dot_product(q.u, c.u) - p AS score FROM nv q, nv c JOIN pe ON pe.id = c.id WHERE q.id % 50 = 0)", 5, "query_id, rank, id, round(score, 6) AS score, round(margin, 6) AS margin"),
    "geodesic_stage1": _ranked(_scores(cosine=True), 1, "query_id, id, round(score, 6) AS score, CASE WHEN margin >= 2.5 THEN 'HIGH' WHEN margin >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence"),
    "geodesic_stages": _stages("0.01"),
    "geodesic_prior": _stages(
        "0.01 * (1 + coalesce((SELECT n_low / n_total::DOUBLE FROM sg WHERE sg.q = query_id), 0))".replace("query_id", "v.id"),
        "SELECT id FROM nv WHERE id % 50 = 0 AND id NOT IN (SELECT id FROM ch)", _PRIOR_MORE,
        "\nUNION ALL SELECT query_id, id, score, margin, CASE WHEN margin >= 0.01 THEN 'MEDIUM' ELSE 'LOW' END, 0, TRUE FROM r0 WHERE n = 1"),
    "metadata_disambiguate": _ranked(_scores(cosine=True), 5, "query_id, rank, id").replace("WITH ", "WITH hits AS (WITH ", 1) + f"""),
d AS (SELECT doc_id, lang, coalesce(nullif(n_chars::DOUBLE, 0), 512.0) AS len, {_WORDS('substring(text, 1, 80)')} AS w FROM documents),
x AS (SELECT query_id, rank, id, {_JACCARD('q.w', 'c.w')} AS word_part, CASE WHEN q.lang <> '' AND q.lang = c.lang THEN 0.3 ELSE 0 END + 1 - least(abs(q.len - c.len) / 8192, 1) + 1 AS rest
  FROM hits JOIN d q ON q.doc_id = query_id JOIN d c ON c.doc_id = id)
SELECT query_id, rank, id, round(rest + word_part, 6) AS meta_score, round(word_part, 6) AS word_part FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rest + word_part, 12) DESC, rank) = 1""",
    "density_revalidate": f"""WITH {_NV}, s AS (SELECT q.id AS query_id, c.id, list_dot_product(q.u, c.u) AS score FROM nv q, nv c),
n AS (SELECT * FROM s WHERE query_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20),
e AS (SELECT query_id AS id, count(*) FILTER (id <> query_id AND score > 0.25) AS density FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 50) GROUP BY 1)
SELECT query_id, id, round(score, 6) AS similarity, density, density > 3 AS confused FROM n JOIN e USING (id) WHERE id <> query_id AND score >= 0.25""",
    "fourier_fp": f"WITH {_V}, {_LONG} SELECT id, freq, dim, round(x, 6) AS x FROM {_fourier('lo', 8, False)}",
    "fourier_fp_v2": f"WITH {_V}, {_LONG} SELECT id, freq, dim, round(x, 6) AS x FROM {_fourier('lo', 8, True)}",
    "fourier_absolute": f"""WITH {_V}, {_LONG}, a AS (SELECT id, freq, dim, a / (sqrt(sum(a * a) OVER (PARTITION BY id, freq)) + 1e-8) AS x FROM (SELECT id, freq, dim, sqrt(sum(x * cos(2 * pi() * freq * layer / 8)) ** 2 + sum(x * sin(2 * pi() * freq * layer / 8)) ** 2) AS a FROM lo, (SELECT unnest([0, 1]) AS freq) GROUP BY 1, 2, 3)),
b AS (SELECT * FROM a UNION ALL SELECT DISTINCT id, 9, dim, 0.0 FROM lo) SELECT id, freq, dim, round(x / (sqrt(sum(x * x) OVER (PARTITION BY id)) + 1e-8), 6) AS x FROM b""",
    "fourier_sections": f"""WITH {_V}, {_LONG}, l1 AS (SELECT * FROM lo WHERE layer < 4), l2 AS (SELECT id, layer - 4 AS layer, dim, x FROM lo WHERE layer >= 4)
SELECT id, 0 AS section, freq, dim, round(x, 6) AS x FROM {_fourier('l1', 4, True)} UNION ALL SELECT id, 1, freq, dim, round(x, 6) FROM {_fourier('l2', 4, True)}""",
    "mean_pool": f"WITH {_V}, {_LONG}, {_POOL} SELECT id, dim, round(x, 6) AS x FROM po",
    "label_centroid": f"WITH {_V} SELECT label, CAST(p - 1 AS INT) AS dim, round(avg(vec[p]), 6) AS x FROM (SELECT label, vec, unnest(range(1, 65)) AS p FROM v) GROUP BY 1, 2",
    "basis_project": f"""WITH {_V}, {_LONG}, {_POOL}, {_BASIS}, pj AS (SELECT id, comp, sum(x * b) AS x FROM po JOIN ba USING (dim) GROUP BY 1, 2)
SELECT id, comp, round(x / l2, 6) AS x, round(l2, 6) AS l2 FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY id)) + 1e-8 AS l2 FROM pj)""",
    "fcdb_project": f"""WITH {_V}, {_LONG}, {_POOL}, {_BASIS}, de AS (SELECT id, dim, x - avg(x) OVER (PARTITION BY dim) AS x FROM po), sz AS (SELECT id, sum(x * x) AS q FROM de GROUP BY 1),
pj AS (SELECT id, comp, sum(x * b) AS x FROM de JOIN ba USING (dim) GROUP BY 1, 2), h AS (SELECT *, sum(x * x) OVER (PARTITION BY id) AS held FROM pj)
SELECT id, comp, round(x / sqrt(held), 6) AS x, round(held / q, 6) AS scs FROM h JOIN sz USING (id)""",
    "gram_matrix": f"WITH {_V} SELECT CAST(i - 1 AS INT) AS i, CAST(j - 1 AS INT) AS j, round(sum(vec[i] * vec[j]), 6) AS g FROM v, range(1, 65) t(i), range(1, 65) u(j) WHERE i <= j GROUP BY 1, 2",
    "quant_int8": f"WITH {_V}, s AS (SELECT id, vec, greatest({_BIG('vec')}, 1e-8) / 127 AS scale FROM v), c AS (SELECT id, scale, {_CODE('vec', 'scale')} AS codes FROM s) SELECT id, CAST(p - 1 AS INT) AS pos, codes[p] AS code, round(scale, 8) AS scale FROM (SELECT *, unnest(range(1, 65)) AS p FROM c)",
    "dequant_error": f"WITH {_V}, s AS (SELECT id, vec, greatest({_BIG('vec')}, 1e-8) / 127 AS scale FROM v), c AS (SELECT id, vec, scale, {_CODE('vec', 'scale')} AS codes FROM s) SELECT id, round(list_sum(list_transform(range(1, 65), lambda i: (vec[i] - codes[i] * scale) ** 2)), 9) AS error, round(2.0 * len(vec) / (len(vec) + 2), 6) AS ratio FROM c",
    "quant_q8_0": f"WITH {_V}, g AS (SELECT id, CAST(k AS INT) AS grp, vec[32 * k + 1 : 32 * k + 32] AS x FROM v, range(2) t(k)), s AS (SELECT *, greatest({_BIG('x')} / 127, 1e-10) AS scale FROM g) SELECT id, grp, round(scale, 8) AS scale, CAST(list_sum({_CODE('x', 'scale')}) AS BIGINT) AS code_sum FROM s",
    "layer_delta_encode": f"WITH {_V}, {_LAYERS}, {_DELTA} SELECT id, layer, round(scale, 8) AS scale, CAST(list_sum(codes) AS BIGINT) AS code_sum FROM dc",
    "layer_delta_decode": f"WITH {_V}, {_LAYERS}, {_DELTA} SELECT id, layer, dim, round(sum(d) OVER (PARTITION BY id, dim ORDER BY layer), 6) AS x FROM (SELECT id, layer, CAST(i - 1 AS INT) AS dim, coalesce(codes[i] * scale, x[i]) AS d FROM dc, range(1, 9) t(i))",
    "block_segment": f"WITH {_STREAMS} SELECT stream, block, block * 256 AS token_start, block * 256 + n_tokens AS token_end, n_tokens FROM bl",
    "block_assemble": f"WITH {_STREAMS} SELECT stream, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, count(*) AS n_blocks, max(block * 256 + n_tokens) AS token_end FROM bl GROUP BY 1",
    "block_extend": f"""WITH {_STREAMS}, e AS (SELECT stream, coalesce(had, 0) + coalesce(n, 0) AS last FROM (SELECT stream, max(block * 256 + n_tokens) AS had FROM bl GROUP BY 1) FULL JOIN (SELECT s_suppkey AS stream, s_suppkey % 300 AS n FROM supplier) USING (stream))
SELECT CAST(stream AS BIGINT) AS stream, block, block * 256 AS token_start, least(last, (block + 1) * 256) AS token_end, least(last, (block + 1) * 256) - block * 256 AS n_tokens FROM (SELECT stream, last, unnest(range(0, (last - 1) // 256 + 1)) AS block FROM e WHERE last > 0)""",
    "doc_stats": f"WITH {_LOG}, {_STATS} SELECT query_doc_id, n_high, n_medium, n_low, round((n_high + n_medium) / n_total::DOUBLE, 6) AS reliability, strftime(last_updated, '%Y-%m-%d %H:%M:%S') AS last_updated FROM s",
    "doc_prior": f"WITH {_PRIOR} SELECT query_doc_id, n_high, n_medium, n_low, round(CASE WHEN n_total = 0 THEN 1.0 ELSE (n_high + n_medium) / n_total::DOUBLE END, 6) AS reliability, 2 * n_low > n_total AS chronic FROM pr",
    "dominant_confidence": f"WITH {_PRIOR} SELECT query_doc_id, CASE WHEN n_total = 0 THEN 'unknown' WHEN n_high >= n_medium AND n_high >= n_low THEN 'high' WHEN n_medium >= n_low THEN 'medium' ELSE 'low' END AS dominant FROM pr",
    "confusion_registry": f"WITH {_LOG}, {_PAIRS} SELECT doc_a, doc_b, n, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM p",
    "confusion_partners": f"WITH {_LOG}, {_PAIRS}, {_PARTNERS} SELECT query_doc_id, pos, partner, side, n FROM pa WHERE pos <= 3",
    "reliability_map": f"WITH {_LOG}, {_STATS} SELECT query_doc_id, round((n_high + n_medium) / n_total::DOUBLE, 6) AS reliability FROM s",
    "session_history": f"WITH {_LOG} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS pos, event_id, query_doc_id, confidence FROM l",
    "n_sessions": f"WITH {_LOG} SELECT count(DISTINCT session_id) AS n_sessions FROM l",
    "weighted_reliability": f"WITH {_LOG}, a AS (SELECT query_doc_id, correct, power(0.85, row_number() OVER (PARTITION BY query_doc_id ORDER BY ts DESC, event_id DESC) - 1) AS w FROM l) SELECT query_doc_id, round(sum(CASE WHEN correct THEN w ELSE 0 END) / sum(w), 6) AS weighted_reliability FROM a GROUP BY 1",
    "session_summary": f"""WITH {_LOG} SELECT session_id, count(*) AS n_total, count(*) FILTER (confidence = 'high') AS n_high, count(*) FILTER (confidence = 'medium') AS n_medium, count(*) FILTER (confidence = 'low') AS n_low,
count(*) FILTER (stages_used = 0) AS n_preempted, count(*) FILTER (correct) AS n_correct, round(count(*) FILTER (correct) / count(*)::DOUBLE, 6) AS recall FROM l GROUP BY 1""",
    "new_confusion_pairs": f"WITH {_LOG} SELECT query_doc_id AS doc_a, result_doc_id AS doc_b, min(session_id) AS session_id FROM l WHERE NOT correct GROUP BY 1, 2",
    "store_stats": "SELECT CAST(sum(n) AS BIGINT) AS n_entries, CAST(sum(t) AS BIGINT) AS n_tokens, string_agg(f || '=' || n, ',' ORDER BY f) AS by_family FROM (SELECT o_orderpriority AS f, count(*) AS n, sum(o_custkey) AS t FROM orders GROUP BY 1)",
    "list_entries": "SELECT o_orderkey AS cache_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    "manifest_needs_reindex": f"WITH {_MAN} SELECT ma.path, ma.hash FROM ma LEFT JOIN old USING (path) WHERE ma.hash IS DISTINCT FROM old.hash",
    "manifest_register": f"WITH {_MAN} SELECT path, hash, n_chunks FROM ma",
    "manifest_summary": f"WITH {_MAN} SELECT count(*) AS n_sources, CAST(sum(n_chunks) AS BIGINT) AS n_chunks, string_agg(DISTINCT project, ',' ORDER BY project) AS projects FROM ma",
    "list_indexed": f"""WITH {_MAN} SELECT project, count(*) AS n_sources, CAST(sum(n_chunks) AS BIGINT) AS n_chunks, '{{"project":"' || project || '","n_sources":' || count(*) || ',"n_chunks":' || CAST(sum(n_chunks) AS BIGINT) || '}}' AS report FROM ma GROUP BY project""",
    "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "slug": f"SELECT p_partkey, {_SLUG(chr(39) + 'notes/' + chr(39) + ' || replace(p_name, ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + '_' + chr(39) + ') || ' + chr(39) + ' v2.md' + chr(39))} AS slug FROM part",
    "eng_filename": f"SELECT p_partkey, {_SLUG('p_name')} || CASE WHEN p_size % 3 > 1 THEN '_' || lpad(CAST(p_size + 1 AS VARCHAR), 3, '0') ELSE '' END || '_2026-04-02.eng' AS name FROM part",
    "model_family": "SELECT p_partkey, ['llama', 'phi', 'gemma', 'qwen', 'mistral', 'unknown'][p_partkey % 6 + 1] AS family FROM part",
    "keyword_overlap": f"WITH k AS (SELECT doc_id, {_WORDS('text')} AS a, {_WORDS(chr(39) + 'the nation that was with the best of a this is on' + chr(39))} AS b FROM documents) SELECT doc_id, CAST(len(a) AS INT) AS n_words, round({_JACCARD('a', 'b')}, 6) AS overlap FROM k",
    "text_truncate": "SELECT doc_id, max(CASE WHEN strlen(left(text, i)) <= 256 THEN strlen(left(text, i)) END) AS n_bytes FROM documents, range(257) t(i) GROUP BY 1",
    "conversation_markdown": "SELECT CAST(conv_id AS VARCHAR) AS source, sha256(string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10) ORDER BY turn)) AS hash FROM conversations GROUP BY 1",
    "last_session": f"WITH {_LOG} SELECT session_id, event_id, query_doc_id FROM l ORDER BY ts DESC, event_id DESC LIMIT 1",
    "relevant_sessions": f"""WITH {_V}, ce AS (SELECT label AS id, p, round(avg(vec[p]), 6) AS x FROM v, range(1, 65) t(p) GROUP BY 1, 2), s AS (SELECT q.id AS query_id, ce.id, round(sum(q.vec[p] * x), 4) AS score FROM v q, ce WHERE q.id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s) WHERE rank < 3""",
    "recall_at_1": f"WITH {_NEAR} SELECT round(avg(CASE WHEN src = dst THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(lead), 6) AS mean_margin, round(median(lead), 6) AS median_margin, round(min(lead), 6) AS min_margin, count(*) FILTER (src <> dst) AS n_failures FROM h",
    "confusion_matrix": f"WITH {_NEAR} SELECT src, dst, count(*) AS n FROM h GROUP BY 1, 2",
    "margin_power_law": "WITH b AS (SELECT n, avg(m) AS m FROM (SELECT count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY o_custkey) GROUP BY n) SELECT round(exp(regr_intercept(ln(m), ln(n))), 2) AS a, round(regr_slope(ln(m), ln(n)), 6) AS alpha FROM b",
    "trial_summary": "SELECT event_type, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS std, round(min(value), 4) AS least, round(max(value), 4) AS most, avg(value) > 0.05 AS passed FROM events GROUP BY 1",
    "model_specs": """SELECT id AS model_id, family, CAST(n - greatest(1, n // 4) AS INT) AS n_read, 2 * h * d AS dims FROM (VALUES
('meta-llama/Llama-3.1-8B-Instruct', 'llama', 32, 8, 128), ('meta-llama/Llama-3.1-8B', 'llama', 32, 8, 128), ('microsoft/Phi-3-mini-128k-instruct', 'phi', 32, 32, 96), ('google/gemma-2-2b-it', 'gemma', 26, 4, 256),
('Qwen/Qwen2.5-7B-Instruct', 'qwen', 28, 4, 128), ('mistralai/Mistral-7B-Instruct-v0.3', 'mistral', 32, 8, 128), ('google/gemma-4-26b-a4b-it', 'gemma', 30, 8, 256)) t(id, family, n, h, d)""",
    "eng_roundtrip": "SELECT 'c' || vec_id AS cache_id, 'vector ' || vec_id AS task_description, vec_id AS context_len, vec_id % 2 = 0 AS confusion_flag, 64 AS n_perdoc, 16 AS n_fourier, TRUE AS near FROM embeddings",
}
ORACLES |= {
    "stream_doc_stats": ORACLES["doc_stats"],
    "stream_confusions": ORACLES["confusion_registry"],
    "stream_windowed": f"WITH {_LOG} SELECT strftime(ts, '%Y-%m-%d') AS day, confidence, count(*) AS n, count(*) FILTER (NOT correct) AS n_wrong FROM l GROUP BY 1, 2",
    "stream_sessions": f"""WITH {_LOG}, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY query_doc_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(new) OVER (PARTITION BY query_doc_id ORDER BY ts, event_id) AS no FROM g)
SELECT query_doc_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n, count(*) FILTER (correct) AS n_correct FROM k GROUP BY query_doc_id, no""",
    "stream_sliding": f"WITH {_LOG} SELECT strftime(date_trunc('day', ts) - to_days(CAST(k AS INT)), '%Y-%m-%d') AS day, confidence, count(*) AS n, count(*) FILTER (NOT correct) AS n_wrong FROM l, range(2) t(k) GROUP BY 1, 2",
    "stream_new_sources": f"WITH {_LOG} SELECT DISTINCT query_doc_id AS path, result_doc_id AS hash FROM l",
    "geodesic_full": ORACLES["geodesic_prior"].rsplit("\nSELECT query_id, id, round(score, 6)", 1)[0] + f""",
lo AS (SELECT query_id FROM al WHERE confidence = 'LOW'),
k5 AS (SELECT query_id, c.id, list_dot_product(q.u, c.u) AS score FROM lo JOIN nv q ON q.id = query_id, c WHERE c.id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q.u, c.u) DESC, c.id) <= 5),
kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM k5),
dm AS (SELECT doc_id, lang, coalesce(nullif(n_chars::DOUBLE, 0), 512.0) AS len, {_WORDS('substring(text, 1, 80)')} AS w FROM documents),
sc AS (SELECT query_id, rank, id, {_JACCARD('q.w', 'd.w')} + CASE WHEN q.lang <> '' AND q.lang = d.lang THEN 0.3 ELSE 0 END + 1 - least(abs(q.len - d.len) / 8192, 1) + 1 AS meta
  FROM kr JOIN dm q ON q.doc_id = query_id JOIN dm d ON d.doc_id = id),
wo AS (SELECT query_id, id AS won FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(meta, 12) DESC, rank) = 1)
SELECT query_id, coalesce(won, id) AS id, round(score, 6) AS score, round(margin, 6) AS margin, confidence, stages_used, constraint_used, won IS NOT NULL AS stage4_used FROM al LEFT JOIN wo USING (query_id)""",
    "frequency_ablation": f"""WITH {_V}, {_LONG}, fr AS (SELECT id, freq, dim, a / greatest(sqrt(sum(a * a) OVER (PARTITION BY id, freq)), 1e-12) AS x FROM (
  SELECT id, freq, dim, sqrt(sum(x * cos(2 * pi() * freq * layer / 8)) ** 2 + sum(x * sin(2 * pi() * freq * layer / 8)) ** 2) AS a FROM lo, (SELECT unnest([0, 1, 2, 3]) AS freq) GROUP BY 1, 2, 3)),
fa AS (SELECT id, freq, list(x ORDER BY dim) AS a FROM fr GROUP BY 1, 2),
dp AS (SELECT p.id AS query_id, c.id, p.freq, list_dot_product(p.a, c.a) AS s FROM fa p JOIN fa c USING (freq) WHERE p.id <> c.id),
co AS (SELECT * FROM (VALUES ('f0', [0]), ('f1', [1]), ('f2', [2]), ('f0+f1', [0, 1]), ('f1+f2', [1, 2]), ('f1+f3', [1, 3]), ('f1+f2+f3', [1, 2, 3])) t(combo, fs)),
s AS (SELECT combo, query_id, id, sum(s) / max(len(fs)) AS score FROM dp JOIN co ON list_contains(fs, freq) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER w AS n, score - lead(score) OVER w AS lead FROM s WINDOW w AS (PARTITION BY combo, query_id ORDER BY score DESC, id)),
h AS (SELECT r.*, a.label = b.label AS ok FROM r JOIN v a ON a.id = r.query_id JOIN v b ON b.id = r.id WHERE n = 1)
SELECT combo, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(lead), 6) AS mean_margin, round(min(lead), 6) AS min_margin, count(*) FILTER (NOT ok) AS n_failures FROM h GROUP BY 1""",
}
