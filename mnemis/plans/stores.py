"""Registered queries over stores, containers, knowledge, sessions and evaluation, with the SQL of most."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemis.functions import quant
from mnemis.functions import text as tx
from mnemis.functions import vector as vx
from mnemis.operators import entries, evaluate, history, knowledge, linalg, search, sessions, store
from mnemis.operators import fingerprint as fp
from mnemis.plans import oracles as o
from mnemis.plans.queries import _asked, _at, _folder, _layers, _log, _long, _r, _t, _vectors, markdown_of, query
from mnemis.sources import state_blob

SQL: dict[str, str] = {}

# Containers


def _kv(spark, sf):
    """Layers of vectors as cells of one head and one cell each."""
    return _layers(spark, sf).select(F.col("id").alias("doc"), F.lit("K").alias("kind"), "layer", F.lit(0).alias("head"), F.lit(0).alias("cell"), "vec")


def _kept(spark, sf, method):
    """Cells written by a method, read and decoded."""
    folder = _folder(spark)
    entries.coded(_kv(spark, sf), method).write.parquet(f"{folder}/cells")
    return entries.decoded(spark.read.parquet(f"{folder}/cells")).select(F.col("doc").alias("id"), "layer", F.posexplode("vec").alias("dim", "x")).select("id", "layer", "dim", _r("x"))


@query
def fp16_cast(spark, sf):
    return _vectors(spark, sf).select("id", F.posexplode(quant.halves(F.col("vec"))).alias("pos", "x")).select("id", "pos", F.round("x", 9).alias("x"))


@query
def q8_decode(spark, sf):
    v = _vectors(spark, sf)
    gap = F.zip_with(vx.doubles(F.col("vec")), quant.round_trip(F.col("vec"), "q8_0"), lambda a, b: (a - b) ** 2)
    return v.select("id", F.round(vx.total(gap), 9).alias("error"))


@query
def serialize_int8(spark, sf):
    return _kept(spark, sf, "int8")


@query
def serialize_layer_delta(spark, sf):
    return _kept(spark, sf, "layer_delta")


@query
def serialize_fp16(spark, sf):
    return _kept(spark, sf, "fp16")


_HALF = lambda x: f"(round_even({x} / pow(2, greatest(floor(log2(greatest(abs({x}), 1e-30))), -14) - 10), 0) * pow(2, greatest(floor(log2(greatest(abs({x}), 1e-30))), -14) - 10))"
SQL |= {
    "fp16_cast": f"WITH {o._V} SELECT id, CAST(p - 1 AS INT) AS pos, round({_HALF('vec[p]')}, 9) AS x FROM v, range(1, 65) t(p)",
    "q8_decode": f"WITH {o._V}, g AS (SELECT id, k, vec[32 * k + 1 : 32 * k + 32] AS x FROM v, range(2) t(k)), s AS (SELECT *, greatest({o._BIG('x')} / 127, 1e-10) AS scale FROM g), c AS (SELECT *, {o._CODE('x', 'scale')} AS codes FROM s) SELECT id, round(sum(list_sum(list_transform(range(1, 33), lambda i: (x[i] - codes[i] * scale) ** 2))), 9) AS error FROM c GROUP BY id",
    "serialize_int8": f"WITH {o._V}, {o._LAYERS}, s AS (SELECT *, greatest({o._BIG('x')}, 1e-8) / 127 AS scale FROM la), c AS (SELECT *, {o._CODE('x', 'scale')} AS codes FROM s) SELECT id, layer, CAST(p - 1 AS INT) AS dim, round(codes[p] * {_HALF('scale')}, 6) AS x FROM c, range(1, 9) t(p)",
    "serialize_layer_delta": f"WITH {o._V}, {o._LAYERS}, {o._DELTA} SELECT id, layer, dim, round(sum(d) OVER (PARTITION BY id, dim ORDER BY layer), 6) AS x FROM (SELECT id, layer, CAST(i - 1 AS INT) AS dim, CASE WHEN codes IS NULL THEN {_HALF('x[i]')} ELSE codes[i] * {_HALF('scale')} END AS d FROM dc, range(1, 9) t(i))",
    "serialize_fp16": f"WITH {o._V}, {o._LAYERS} SELECT id, layer, CAST(p - 1 AS INT) AS dim, round({_HALF('x[p]')}, 6) AS x FROM la, range(1, 9) t(p)",
}

# Store


def _orders(spark, sf):
    return _t(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("cache_id"), F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("agent"), F.col("o_custkey").alias("n_tokens"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.lit("all").alias("day")
    )


def _order_store(spark, sf):
    """All orders; those divisible by 7 are deleted, those divisible by 14 come again with one token more."""
    s, rows = entries.Store(spark, _folder(spark)), _orders(spark, sf)
    s.put(rows, 1)
    s.delete(rows.filter("cache_id % 7 = 0"), 2)
    s.put(rows.filter("cache_id % 14 = 0").withColumn("n_tokens", F.col("n_tokens") + 1), 3)
    return s


def _stats(df):
    return df.select("n_entries", "n_tokens", F.array_join(F.transform(F.map_entries("by_family"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("by_family"))


@query
def store_delete(spark, sf):
    return _stats(_order_store(spark, sf).stats())


@query
def store_vacuum(spark, sf):
    return _order_store(spark, sf).vacuum(f"{_folder(spark)}/new").health()


@query
def store_get(spark, sf):
    ids = _orders(spark, sf).filter("cache_id % 100 < 15").select("cache_id")
    return _order_store(spark, sf).get(ids, payload=False).select("cache_id", "family", "agent", "n_tokens")


@query
def store_exists(spark, sf):
    ids = _orders(spark, sf).selectExpr("cast(cache_id * 3 as bigint) as c").select(F.col("c").cast("string").alias("cache_id"))
    return _order_store(spark, sf).exists(ids)


@query
def store_list(spark, sf):
    return _order_store(spark, sf).list(20, "1-URGENT", "F").select("cache_id", _at("created_at"))


@query
def store_retrieve(spark, sf):
    """Vectors put and some deleted; the nearest entries of one family, with what the store knows of them."""
    s, v = entries.Store(spark, _folder(spark)), _vectors(spark, sf)
    s.put(v.select(F.col("id").cast("string").alias("cache_id"), F.concat(F.lit("f"), F.col("label") % 3).alias("family"), F.col("id").alias("n_tokens"), "vec", F.lit("d").alias("day")), 1)
    s.delete(v.filter("id % 7 = 0").select(F.col("id").cast("string").alias("cache_id")), 2)
    hits = s.retrieve(_asked(v), 5, where=F.col("family") == "f1", least=0.1)
    return hits.select("query_id", "rank", "cache_id", _r("score"), "family", "n_tokens")


_PUT = """st AS (SELECT CAST(o_orderkey AS VARCHAR) AS cache_id, o_orderkey AS k, o_orderpriority AS family, o_orderstatus AS agent, o_custkey + CASE WHEN o_orderkey % 14 = 0 THEN 1 ELSE 0 END AS n_tokens, o_orderdate AS created_at
  FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 14 = 0)"""
SQL |= {
    "store_delete": f"WITH {_PUT} SELECT CAST(sum(n) AS BIGINT) AS n_entries, CAST(sum(t) AS BIGINT) AS n_tokens, string_agg(f || '=' || n, ',' ORDER BY f) AS by_family FROM (SELECT family AS f, count(*) AS n, sum(n_tokens) AS t FROM st GROUP BY 1)",
    "store_vacuum": f"WITH {_PUT} SELECT count(*) AS n_rows, count(*) AS n_ids, CAST(0 AS BIGINT) AS n_deletions, count(*) AS n_entries FROM st",
    "store_get": f"WITH {_PUT} SELECT cache_id, family, agent, n_tokens FROM st WHERE k % 100 < 15",
    "store_exists": f"WITH {_PUT} SELECT CAST(q.o_orderkey * 3 AS VARCHAR) AS cache_id, st.k IS NOT NULL AS there FROM orders q LEFT JOIN st ON st.k = q.o_orderkey * 3",
    "store_list": f"WITH {_PUT} SELECT cache_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM st WHERE family = '1-URGENT' AND agent = 'F' ORDER BY st.created_at DESC, cache_id LIMIT 20",
    "store_retrieve": f"WITH {o._V}, s AS (SELECT q.id AS query_id, c.id, 'f1' AS family, list_dot_product(q.vec, c.vec) AS score FROM v q, v c WHERE q.id % 50 = 0 AND c.id % 7 <> 0 AND c.label % 3 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(id AS VARCHAR)) - 1 AS rank FROM s) SELECT query_id, rank, CAST(id AS VARCHAR) AS cache_id, round(score, 6) AS score, family, id AS n_tokens FROM r WHERE rank < 5 AND score >= 0.1",
}

# Manifest and index


def _sources(spark, sf):
    """Conversations as markdown files of two projects."""
    md = markdown_of(_t(spark, sf, "conversations"))
    return md.select(F.concat(F.lit("chats/conv_"), "source", F.lit(".md")).alias("path"), F.concat(F.lit("p"), F.col("source").cast("int") % 2).alias("project"), "content", F.octet_length("content").cast("long").alias("file_size"))


_MANIFEST = "path string, hash string, project string, file_size long, n_chunks long"


def _knowledge(spark, sf):
    now = _sources(spark, sf)
    old = now.filter("crc32(path) % 3 > 0").select("path", F.when(F.expr("crc32(path) % 5 = 0"), "old").otherwise(F.sha2("content", 256)).alias("hash"), "project", "file_size", F.lit(1).cast("long").alias("n_chunks"))
    return knowledge.index_sources(now, old, "2026-04-02")


@query
def knowledge_index(spark, sf):
    """Certificates of the chunks of new and changed files."""
    return _knowledge(spark, sf)[0].select("cache_id", "file_name", "project", "chunk_index", "chunk_total", "char_start", "char_end", F.sha2("text", 256).alias("hash"), F.size("vec").alias("dims"))


@query
def knowledge_manifest(spark, sf):
    """The manifest after indexing, saved and loaded, without one project's first file."""
    folder = _folder(spark)
    store.save_manifest(_knowledge(spark, sf)[1], folder + "/m")
    back = store.load_manifest(spark, folder + "/m", _MANIFEST)
    gone = store.of_project(back, "p1").agg(F.min("path").alias("path"))
    return store.unregister(back, gone).select("path", "hash", "project", "file_size")


@query
def knowledge_search(spark, sf):
    """Chunks of one project nearest to what users said first."""
    chunks = knowledge.index_sources(_sources(spark, sf), spark.createDataFrame([], _MANIFEST), "2026-04-02")[0]
    index = chunks.select(F.col("cache_id").alias("id"), "project", "vec")
    asked = _t(spark, sf, "conversations").filter("turn = 0").select(F.col("conv_id").alias("query_id"), "text")
    return knowledge.search_text(index, asked, 3, project="p0").select("query_id", "rank", "id", _r("score"))


@query
def markdown_listing(spark, sf):
    d = _t(spark, sf, "documents")
    folder = F.element_at(F.array(*map(F.lit, ("docs/a", "x/node_modules/b", "docs/.git", "notes"))), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.when(F.col("doc_id") % 9 == 0, "LICENSE.md").when(F.col("doc_id") % 5 == 0, "a.txt").otherwise(F.concat("doc_id", F.lit(".md")))
    return knowledge.markdown_files(d.select(F.concat_ws("/", folder, name).alias("path"), (F.col("n_chars") * (F.col("doc_id") % 6)).alias("length"))).select("path", "length")


@query
def certificate_sidecars(spark, sf):
    """Certificates, some broken, some with a sidecar, as an index of their fourier vectors."""
    v = _vectors(spark, sf)
    path = F.concat(F.lit("k/"), "id", F.lit(".eng"))
    certs = v.select(path.alias("path"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("c"), "id")).alias("cache_id"), F.concat(F.lit("about "), "id").alias("task_description"), F.slice("vec", 1, 16).alias("vec_fourier"), F.when(F.col("id") % 2 == 0, F.slice("vec", 17, 16)).alias("vec_fourier_v2"), F.when(F.col("id") % 13 == 0, "short file").alias("corrupt"))
    some = v.filter("id % 3 = 0").select(path.alias("path"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("more about "), "id")).otherwise("").alias("task_description"), F.lit("a.md").alias("source_path"), F.lit("p").alias("project"), F.lit("hash").alias("fp_source"), F.lit(1).alias("chunk_index"), F.lit(2).alias("chunk_total"), F.array(F.lit("# a")).alias("headers"))
    index = knowledge.build_index(knowledge.with_sidecars(certs, some))
    return index.select("id", "task_description", "project", "chunk_total", F.size("headers").alias("n_headers"), F.round(vx.total(F.col("vec")), 6).alias("vec_sum"))


@query
def index_save_load(spark, sf):
    folder, v = _folder(spark), _vectors(spark, sf)
    knowledge.save_index(v.select("id", vx.unit(F.col("vec")).alias("vec")), f"{folder}/index")
    back = knowledge.load_index(spark, f"{folder}/index")
    return search.top_k(_asked(v), back, 5, cosine=True).select("query_id", "rank", "id", _r("score"), _r("margin"))


@query
def index_lookup(spark, sf):
    v = _vectors(spark, sf)
    ids = v.select((F.col("id") * 5).alias("id"))
    return knowledge.vectors_of(v, ids).select("id", F.col("vec").isNotNull().alias("there"), F.round(vx.total(vx.doubles(F.col("vec"))), 6).alias("vec_sum"))


@query
def project_search(spark, sf):
    v = _vectors(spark, sf).withColumn("project", F.concat(F.lit("p"), "label"))
    return search.top_k(_asked(v), store.of_project(v, "p2"), 5).select("query_id", "rank", "id", _r("score"))


_MD = """cm AS (SELECT CAST(conv_id AS VARCHAR) AS source, string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY 1),
  so AS (SELECT 'chats/conv_' || source || '.md' AS path, 'p' || (CAST(source AS INT) % 2) AS project, sha256(content) AS hash, CAST(strlen(content) AS BIGINT) AS file_size FROM cm)"""
SQL |= {
    "knowledge_manifest": f"WITH {_MD} SELECT path, hash, project, file_size FROM so WHERE path <> (SELECT min(path) FROM so WHERE project = 'p1')",
    "markdown_listing": "SELECT path, length FROM (SELECT ['docs/a', 'x/node_modules/b', 'docs/.git', 'notes'][doc_id % 4 + 1] || '/' || CASE WHEN doc_id % 9 = 0 THEN 'LICENSE.md' WHEN doc_id % 5 = 0 THEN 'a.txt' ELSE doc_id || '.md' END AS path, n_chars * (doc_id % 6) AS length, doc_id FROM documents) WHERE doc_id % 4 IN (0, 3) AND doc_id % 9 <> 0 AND doc_id % 5 <> 0 AND length > 0",
    "certificate_sidecars": f"WITH {o._V}, x AS (SELECT id, CASE WHEN id % 2 = 0 THEN vec[17:32] ELSE vec[1:16] END AS f FROM v WHERE id % 11 > 0 AND id % 13 <> 0) SELECT 'c' || id AS id, CASE WHEN id % 6 = 0 THEN 'more about ' || id ELSE 'about ' || id END AS task_description, CASE WHEN id % 3 = 0 THEN 'p' ELSE '' END AS project, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS chunk_total, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS n_headers, round(list_sum(list_transform(f, lambda e: e / greatest(sqrt(list_dot_product(f, f)), 1e-12))), 6) AS vec_sum FROM x",
    "index_save_load": o.ORACLES["cosine_topk_margin"],
    "index_lookup": f"WITH {o._V} SELECT q.id * 5 AS id, c.id IS NOT NULL AS there, round(list_sum(c.vec), 6) AS vec_sum FROM v q LEFT JOIN v c ON c.id = q.id * 5",
    "project_search": o._ranked(o._scores(corpus="(SELECT * FROM v WHERE label = 2)"), 5),
}

# History and sessions


@query
def history_append(spark, sf):
    """The log written in two parts, and its view."""
    log, rows = sessions.Log(spark, _folder(spark) + "/log"), _log(spark, sf)
    for part in (0, 1):
        log.append(rows.filter(F.col("event_id") % 2 == part))
    return history.doc_stats(log.rows()).select("query_doc_id", "n_high", "n_medium", "n_low", _r("reliability"), _at("last_updated"))


@query
def session_report(spark, sf):
    return sessions.report(_log(spark, sf)).select("session_id", "n_total", "n_correct", "recall", "n_new_pairs", "line")


SQL |= {
    "history_append": o.ORACLES["doc_stats"],
    "session_report": f"""WITH {o._LOG}, s AS (SELECT session_id, count(*) AS n_total, count(*) FILTER (confidence = 'high') AS h, count(*) FILTER (confidence = 'medium') AS m, count(*) FILTER (confidence = 'low') AS lo, count(*) FILTER (correct) AS n_correct, round(count(*) FILTER (correct) / count(*)::DOUBLE, 6) AS recall FROM l GROUP BY 1),
n AS (SELECT session_id, count(*) AS c FROM (SELECT min(session_id) AS session_id FROM l WHERE NOT correct GROUP BY query_doc_id, result_doc_id) GROUP BY 1)
SELECT session_id, n_total, n_correct, recall, coalesce(c, 0) AS n_new_pairs, printf('%s: %d retrievals, %d high, %d medium, %d low, recall %.3f, %d new pairs', session_id, n_total, h, m, lo, recall, coalesce(c, 0)) AS line FROM s LEFT JOIN n USING (session_id)""",
}

# Evaluation


@query
def retrieval_trials(spark, sf):
    v = _vectors(spark, sf)
    asked = _asked(v).withColumn("a", F.col("query_id") + 1).withColumn("b", F.col("query_id") + 2)
    return evaluate.trials(asked, v).select("query_id", _r("margin"), "correct")


@query
def trial_gate(spark, sf):
    e = _t(spark, sf, "events").groupBy("event_type").agg((F.avg("value") / 100).alias("mean_margin"), (F.min("value") > 0).alias("all_correct"), F.avg("value").alias("overhead_ms"), (F.max("value") / F.avg("value")).alias("speed_up"))
    return evaluate.gate(e).select("event_type", "all_correct", "passed")


@query
def recall_by_size(spark, sf):
    return evaluate.recall_series(_vectors(spark, sf), [100, 200, 400])


@query
def recall_by_label(spark, sf):
    from mnemis.plans.queries import _nearest_other

    return _nearest_other(spark, sf).groupBy(F.col("src").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("src") == F.col("dst")).cast("double")), 6).alias("recall"))


@query
def alignment_set(spark, sf):
    v = _vectors(spark, sf)
    both = evaluate.aligned(v, v.filter("id % 3 > 0").withColumn("vec", F.reverse("vec")))
    return both.select("id", F.round(vx.dot(F.col("a"), F.col("b")), 6).alias("dot"))


SQL |= {
    "retrieval_trials": f"WITH {o._NV}, t AS (SELECT q.id AS query_id, list_dot_product(q.u, a.u) - list_dot_product(q.u, b.u) AS margin FROM nv q JOIN nv a ON a.id = q.id + 1 JOIN nv b ON b.id = q.id + 2 WHERE q.id % 50 = 0) SELECT query_id, round(margin, 6) AS margin, margin > 0 AS correct FROM t",
    "trial_gate": "SELECT event_type, min(value) > 0 AS all_correct, avg(value) / 100 > 0.05 AND min(value) > 0 AND avg(value) < 200 AND max(value) / avg(value) > 10 AS passed FROM events GROUP BY 1",
    "recall_by_size": f"WITH {o._NV}, n AS (SELECT unnest([100, 200, 400]) AS n), s AS (SELECT n, q.id AS query_id, c.id, list_dot_product(q.u, c.u) AS score FROM n, nv q, nv c WHERE q.id < n AND c.id < n AND q.id <> c.id), r AS (SELECT *, row_number() OVER w AS k, score - lead(score) OVER w AS lead FROM s WINDOW w AS (PARTITION BY n, query_id ORDER BY score DESC, id)) SELECT CAST(n AS INT) AS n, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(lead), 6) AS mean_margin FROM r JOIN v a ON a.id = r.query_id JOIN v b ON b.id = r.id WHERE k = 1 GROUP BY 1",
    "recall_by_label": f"WITH {o._NEAR} SELECT src AS label, count(*) AS n, round(avg(CASE WHEN src = dst THEN 1.0 ELSE 0.0 END), 6) AS recall FROM h GROUP BY 1",
    "alignment_set": f"WITH {o._V} SELECT id, round(list_dot_product(vec, list_reverse(vec)), 6) AS dot FROM v WHERE id % 3 > 0",
}

# Functions, layers, blocks, blobs


@query
def token_hash(spark, sf):
    words = F.transform(F.split("text", " "), lambda w: F.length(w))
    return _t(spark, sf, "documents").select("doc_id", tx.token_hash(words).alias("hash"))


@query
def short_model_id(spark, sf):
    path = F.concat(F.lit("models/"), F.element_at(F.array(*map(F.lit, ("Llama-3B-", "llama-8b-", "Other-"))), (F.col("p_partkey") % 3 + 1).cast("int")), "p_name")
    return _t(spark, sf, "part").select("p_partkey", tx.short_model_id(path).alias("model_id"))


@query
def metadata_lookup(spark, sf):
    """A count that models name under one of several prefixes."""
    p = _t(spark, sf, "part").withColumn("m", F.create_map(F.concat(F.element_at(F.array(*map(F.lit, ("llama", "gemma", "other"))), (F.col("p_partkey") % 3 + 1).cast("int")), F.lit(".head_count")), F.col("p_size").cast("string")))
    return p.select("p_partkey", tx.first_of(F.col("m"), ["gemma.head_count", "llama.head_count"], "32").alias("heads"))


@query
def layer_slice(spark, sf):
    """Sums of the cells of a span of layers, and of those listed for a model."""
    long = _long(spark, sf)
    a = fp.select_layers(long, 8, (2, 20)).groupBy("id").agg(_r(F.sum("x"), "span"))
    return a.join(fp.select_layers(long, 8, listed=[1, 3, 9]).groupBy("id").agg(_r(F.sum("x"), "listed")), "id")


@query
def extract_mean(spark, sf):
    return linalg.extract(_layers(spark, sf), "mean").select("id", "comp", _r("x"), _r("l2"))


@query
def block_payload(spark, sf):
    """Vectors of a label as the cells of a stream, cut into blocks and put together again."""
    cells = store.numbered(_vectors(spark, sf).select(F.col("label").alias("stream"), "id", "vec"), "stream", "id").select("stream", "cell", "vec")
    back = store.assembled(store.payload_blocks(cells))
    return back.select("stream", "cell", F.round(vx.total(vx.doubles(F.col("vec"))), 6).alias("x"))


@query
def blob_headers(spark, sf):
    """What blobs of vectors say of themselves, their matrices unread."""
    import numpy as np
    import pandas as pd

    def blobs(batches):
        for pdf in batches:
            x = [np.asarray(v, np.float64).reshape(2, 2, 4, 4) for v in pdf["vec"]]
            yield pd.DataFrame({"path": pdf["id"].astype(str), "content": [state_blob.encode([(y, y)], turned=i % 2 == 0) for i, y in zip(pdf["id"], x)]}, columns=["path", "content"])

    files = _vectors(spark, sf).select("id", "vec").mapInPandas(blobs, "path string, content binary")
    return state_blob.headers_of(files).select("path", "arch", "streams", "cells", "turned", "layers", F.size("keys").alias("n_keys"), F.col("keys")[0]["row"].alias("row"))


SQL |= {
    "token_hash": "SELECT doc_id, 'sha256:' || sha256(unhex(array_to_string(list_transform(string_split(text, ' '), lambda w: printf('%02x%02x%02x00', length(w) & 255, (length(w) >> 8) & 255, (length(w) >> 16) & 255)), ''))) AS hash FROM documents",
    "short_model_id": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Llama-3.2-3B' WHEN 1 THEN 'Llama-3.1-8B' ELSE left('Other-' || p_name, 15) END AS model_id FROM part",
    "metadata_lookup": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN '32' ELSE CAST(p_size AS VARCHAR) END AS heads FROM part",
    "layer_slice": f"WITH {o._V}, {o._LONG} SELECT id, round(sum(x) FILTER (layer >= 2), 6) AS span, round(sum(x) FILTER (layer IN (1, 3)), 6) AS listed FROM lo GROUP BY 1",
    "extract_mean": f"WITH {o._V}, {o._LONG}, {o._POOL} SELECT id, dim AS comp, round(x, 6) AS x, round(sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS l2 FROM po",
    "block_payload": f"WITH {o._V} SELECT label AS stream, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS cell, round(list_sum(vec), 6) AS x FROM v",
    "blob_headers": "SELECT CAST(vec_id AS VARCHAR) AS path, 'llama' AS arch, CAST(1 AS BIGINT) AS streams, CAST(4 AS BIGINT) AS cells, vec_id % 2 = 0 AS turned, CAST(2 AS BIGINT) AS layers, 2 AS n_keys, CAST(16 AS BIGINT) AS row FROM embeddings",
}
o.ORACLES.update(SQL)
