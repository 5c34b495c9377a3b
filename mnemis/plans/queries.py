"""The registered queries: each applies one operator to whole tables. `oracles` has the SQL of most."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemis.functions import embed, quant
from mnemis.functions import text as tx
from mnemis.functions import vector as vx
from mnemis.functions.chunker import chunk_rows
from mnemis.operators import fingerprint as fp
from mnemis.operators import history, linalg, retrieve, search, store
from mnemis.session import cut, importable
from mnemis.sources import models
from mnemis.streaming import history as live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Vectors are read as 8 layers of 8 dimensions; thresholds fit vectors whose neighbours have cosines near 0.4.
LAYERS, DIMS, TAU, RADIUS = 8, 8, 0.01, 0.25
EVERY = 50


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label", F.col("label").isin(3, 7).alias("flagged"))


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "vec", "label")


def log_of(events: DataFrame) -> DataFrame:
    """Events as a retrieval log."""
    tag = F.col("event_type")
    confidence = F.when(tag.isin("purchase", "signup"), "high").when(tag == "click", "medium").when(tag == "error", "low").otherwise(tag)
    return events.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("session_id"), F.concat(F.lit("doc_"), "user_id").alias("query_doc_id"), F.concat(F.lit("doc_"), F.col("event_id") % 50).alias("result_doc_id"),
        confidence.alias("confidence"), (F.col("value") / 1000).alias("margin"), (F.col("event_id") % 4).alias("stages_used"), (tag != "error").alias("correct"), F.col("ts").cast("timestamp").alias("ts"),
    )


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return log_of(_t(spark, sf, "events"))


def _r(c, name: str | None = None):
    return F.round(c, 6).alias(name or c)


def _at(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# Search


@query
def mips_topk(spark, sf):
    v = _vectors(spark, sf)
    return search.top_k(_asked(v), v, 5).select("query_id", "rank", "id", _r("score"))


@query
def cosine_topk_margin(spark, sf):
    v = _vectors(spark, sf)
    return search.top_k(_asked(v), v, 5, cosine=True).select("query_id", "rank", "id", _r("score"), _r("margin"))


@query
def mips_filtered(spark, sf):
    v = _vectors(spark, sf)
    return search.top_k(_asked(v), v.filter("label = 1"), 5).filter("score >= 0.1").select("query_id", "rank", "id", _r("score"))


def _versions(spark, sf):
    """Each vector at position id; those with id % 5 = 0 once more, as their negation, after all others."""
    v = _vectors(spark, sf).withColumn("position", F.col("id"))
    again = v.filter("id % 5 = 0").withColumn("vec", F.transform("vec", lambda x: -x)).withColumn("position", F.col("id") + 1_000_000_000)
    return v.unionByName(again)


@query
def latest_version_search(spark, sf):
    v = _vectors(spark, sf)
    return search.top_k(_asked(v), search.latest(_versions(spark, sf)), 5).select("query_id", "rank", "id", _r("score"))


@query
def tombstone_search(spark, sf):
    v = _vectors(spark, sf)
    gone = v.filter("id % 7 = 0")
    return search.top_k(_asked(v), search.active(_versions(spark, sf), gone), 5).select("query_id", "rank", "id", _r("score"))


@query
def index_rebuild(spark, sf):
    out = search.rebuilt(_versions(spark, sf), _vectors(spark, sf).filter("id % 7 = 0"))
    return out.select("id", F.col("position").cast("long").alias("position"), F.round(vx.total(vx.doubles(F.col("vec"))), 6).alias("vec_sum"))


@query
def get_vector(spark, sf):
    unit = _vectors(spark, sf).select("id", F.posexplode(vx.unit(F.col("vec"))).alias("pos", "x"))
    return unit.select("id", "pos", _r("x"))


@query
def constrained_retrieve(spark, sf):
    v = _vectors(spark, sf)
    few = retrieve.first_flagged(v, 3)
    asked = _asked(v).join(F.broadcast(few), F.lit(True)).withColumn("unlike", F.col("first")["vec"])
    return retrieve.constrained(asked, v, 5, threshold=0.1).select("query_id", "rank", "id", _r("score"), _r("margin"))


@query
def geodesic_stage1(spark, sf):
    v = _vectors(spark, sf)
    hits = search.top_k(_asked(v), v, 2, cosine=True).filter("rank = 0")
    return hits.select("query_id", "id", _r("score"), search.tier(F.col("margin"), F.lit(0.5)).alias("confidence"))


@query
def geodesic_stages(spark, sf):
    """Stages 1 to 3 over all vectors but each query's own, so that later stages are reached."""
    v = _vectors(spark, sf)
    return retrieve.stages(_asked(v), v, TAU, threshold=RADIUS, others=True).select("query_id", "id", _r("score"), _r("margin"), "confidence", "stages_used", "constraint_used")


def _prior_results(spark, sf):
    v = _vectors(spark, sf)
    log = _log(spark, sf).withColumn("query_doc_id", F.expr("(event_id % 100) * 50")).withColumn("result_doc_id", F.expr("event_id % 400 + 1")).withColumn("confidence", F.when(F.expr("event_id % 3 = 0 or event_id % 100 < 10"), "low").otherwise("high"))
    stats = history.doc_stats(log).select(F.col("query_doc_id").alias("query_id"), "n_total", "n_low")
    partners = history.partners(history.confusions(log)).withColumnRenamed("query_doc_id", "query_id")
    return retrieve.with_prior(_asked(v), v, stats, partners, TAU, threshold=RADIUS, others=True)


@query
def geodesic_prior(spark, sf):
    return _prior_results(spark, sf).select("query_id", "id", _r("score"), _r("margin"), "confidence", "stages_used", "constraint_used")


@query
def geodesic_full(spark, sf):
    """Stages 0 to 4: priors from events, metadata from documents."""
    v = _vectors(spark, sf)
    meta = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"), F.col("n_chars").cast("double").alias("len"), F.lit(1.0).alias("norm"), F.col("text").alias("description"))
    out = retrieve.with_metadata(_prior_results(spark, sf), _asked(v), v, meta, others=True)
    return out.select("query_id", "id", _r("score"), _r("margin"), "confidence", "stages_used", "constraint_used", "stage4_used")


@query
def frequency_ablation(spark, sf):
    """Recall at 1 and margins for fingerprints of each combination of frequencies."""
    v = _vectors(spark, sf)
    whole = cut(fp.fourier_arrays(v, [0, 1, 2, 3], DIMS, LAYERS, keep=("label",)).select("id", "label", F.flatten("x").alias("vec")))
    combos = {"+".join(f"f{f}" for f in c): [f * DIMS + d for f in c for d in range(DIMS)] for c in ([0], [1], [2], [0, 1], [1, 2], [1, 3], [1, 2, 3])}
    two = search.top_k(whole.select(F.col("id").alias("query_id"), "vec"), whole, 2, cosine=True, others=True, n=whole.count(), views=combos).filter("rank = 0")
    two = two.join(whole.select("id", F.col("label").alias("dst")), "id").join(whole.select(F.col("id").alias("query_id"), F.col("label").alias("src")), "query_id")
    right = (F.col("src") == F.col("dst")).cast("double")
    return two.groupBy(F.col("view").alias("combo")).agg(F.round(F.avg(right), 6).alias("recall"), F.round(F.avg("margin"), 6).alias("mean_margin"), F.round(F.min("margin"), 6).alias("min_margin"), F.count_if(right == 0).alias("n_failures"))


@query
def metadata_disambiguate(spark, sf):
    v = _vectors(spark, sf)
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("domain"), F.col("n_chars").cast("double").alias("len"))
    hits = search.top_k(_asked(v), v, 5, cosine=True).select("query_id", "rank", "id")
    meta = lambda p: docs.select(F.col("id").alias(p + "id"), *(F.col(c).alias(p + c) for c in ("text", "domain", "len")))
    both = hits.join(meta("c_"), hits["id"] == F.col("c_id")).join(meta("q_"), hits["query_id"] == F.col("q_id"))
    cols = lambda p: {"domain": F.col(p + "domain"), "len": F.col(p + "len"), "norm": F.lit(1.0), "description": F.col(p + "text")}
    return retrieve.disambiguate(both.withColumns(retrieve.meta_score(cols("q_"), cols("c_")))).select("query_id", "rank", "id", _r("meta_score"), _r("word_part"))


@query
def density_revalidate(spark, sf):
    v = _vectors(spark, sf)
    return retrieve.density(_asked(v), v.select("id", "vec"), RADIUS).select("query_id", "id", _r("similarity"), F.col("density").cast("long").alias("density"), "confused")


@query
def hash_embed_search(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), embed.embed(F.col("text")).alias("vec"))
    asked = docs.filter(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "vec")
    return search.top_k(asked, docs, 3, cosine=True).select("query_id", "rank", "id", _r("score"))


# Fingerprints


def _long(spark, sf):
    return fp.cells(_vectors(spark, sf), DIMS)


@query
def fourier_fp(spark, sf):
    return fp.fourier_rows(_vectors(spark, sf), [0, 1], DIMS, LAYERS).select("id", "freq", "dim", _r("x"))


@query
def fourier_fp_v2(spark, sf):
    return fp.fourier_rows(_vectors(spark, sf), [0, 1], DIMS, LAYERS, unit_layers=True).select("id", "freq", "dim", _r("x"))


@query
def fourier_absolute(spark, sf):
    return fp.fourier_whole(_long(spark, sf), [0, 1, 9], LAYERS).select("id", "freq", "dim", _r("x"))


@query
def fourier_sections(spark, sf):
    long = _long(spark, sf)
    a = fp.fourier(long.filter("layer < 4"), [0, 1], 4, unit_layers=True).withColumn("section", F.lit(0))
    b = fp.fourier(long.filter("layer >= 4").withColumn("layer", F.col("layer") - 4), [0, 1], 4, unit_layers=True).withColumn("section", F.lit(1))
    return a.unionByName(b).select("id", "section", "freq", "dim", _r("x"))


@query
def mean_pool(spark, sf):
    return fp.mean_pool(_long(spark, sf)).select("id", "dim", _r("x"))


@query
def label_centroid(spark, sf):
    long = _vectors(spark, sf).select("label", F.posexplode("vec").alias("dim", "x"))
    return long.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


def _basis(spark, rank: int = 4):
    """Rows of the normalised cosine basis."""
    b = np.array([[np.cos(np.pi * (2 * d + 1) * c / (2 * DIMS)) for d in range(DIMS)] for c in range(rank)])
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return spark.createDataFrame([(c, d, float(b[c, d])) for c in range(rank) for d in range(DIMS)], "comp int, dim int, b double")


@query
def basis_project(spark, sf):
    x = fp.project(fp.mean_pool(_long(spark, sf)), _basis(spark))
    length = F.sqrt(F.sum(F.col("x") ** 2).over(Window.partitionBy("id"))) + 1e-8
    return x.select("id", "comp", F.round(F.col("x") / length, 6).alias("x"), F.round(length, 6).alias("l2"))


@query
def fcdb_project(spark, sf):
    """The pooled vector's difference to the corpus mean, on a basis; scs: the share of it that the basis holds."""
    pooled = fp.mean_pool(_long(spark, sf))
    center = pooled.groupBy("dim").agg(F.avg("x").alias("c"))
    delta = pooled.join(F.broadcast(center), "dim").withColumn("x", F.col("x") - F.col("c"))
    size = delta.groupBy("id").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("l2"))
    on = fp.project(delta.select("id", "dim", "x"), _basis(spark)).join(size, "id")
    w = Window.partitionBy("id")
    held = F.sum(F.col("x") ** 2).over(w)
    return on.select("id", "comp", F.round(F.col("x") / F.sqrt(held), 6).alias("x"), F.round(held / F.col("l2") ** 2, 6).alias("scs"))


@query
def gram_matrix(spark, sf):
    return fp.gram(_vectors(spark, sf)).select("i", "j", _r("g"))


def _layers(spark, sf):
    v = _vectors(spark, sf).select("id", F.posexplode(vx.groups(F.col("vec"), DIMS)).alias("layer", "vec"))
    return v


@query
def svd_state(spark, sf):
    return linalg.svd_state(_layers(spark, sf), 4, 1).select("id", "comp", _r("x"), _r("evr"))


@query
def xkv_state(spark, sf):
    return linalg.grouped_state(_layers(spark, sf), 4).select("id", "part", "comp", _r("x"))


@query
def corpus_basis(spark, sf):
    b = linalg.corpus_basis(_vectors(spark, sf), LAYERS * DIMS, 4)
    return spark.createDataFrame([(c, d, round(float(x), 6)) for c, r in enumerate(b) for d, x in enumerate(r)], "comp int, dim int, x double")


@query
def eigenform_score(spark, sf):
    """Mean cosine among fingerprints of a vector and two with noise of 0.001, seeded by place."""
    long = _long(spark, sf)
    trial = long.select("id", "layer", "dim", "x", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("trial"))
    u = lambda salt: (F.pmod(F.xxhash64("id", "layer", "dim", "trial", F.lit(salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))
    noisy = trial.withColumn("x", F.col("x") + F.when(F.col("trial") > 0, 0.001 * normal).otherwise(0.0)).withColumn("id", F.col("id") * 4 + F.col("trial"))
    f = fp.fourier(noisy.drop("trial"), [0, 1], LAYERS).select(F.expr("id div 4").alias("doc"), (F.col("id") % 4).alias("trial"), "freq", "dim", "x")
    a, b = f.alias("a"), f.alias("b")
    dots = a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.freq") == F.col("b.freq")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.trial") < F.col("b.trial")))
    cos = dots.groupBy(F.col("a.doc").alias("id"), F.col("a.trial").alias("s"), F.col("b.trial").alias("t")).agg((F.sum(F.col("a.x") * F.col("b.x")) / 2).alias("c"))
    return cos.groupBy("id").agg(F.round(F.avg("c"), 6).alias("score"))


# Quantisers


@query
def quant_int8(spark, sf):
    s = quant.scale_int8(F.col("vec"))
    q = _vectors(spark, sf).select("id", s.alias("scale"), F.posexplode(quant.codes(F.col("vec"), s)).alias("pos", "code"))
    return q.select("id", "pos", "code", F.round("scale", 8).alias("scale"))


@query
def dequant_error(spark, sf):
    s = quant.scale_int8(F.col("vec"))
    v = _vectors(spark, sf).withColumn("scale", s).withColumn("codes", quant.codes(F.col("vec"), F.col("scale")))
    gap = F.zip_with(vx.doubles(F.col("vec")), "codes", lambda x, c: (x - c * F.col("scale")) ** 2)
    return v.select("id", F.round(vx.total(gap), 9).alias("error"), F.round(2.0 * F.size("vec") / (F.size("vec") + 2), 6).alias("ratio"))


@query
def quant_q8_0(spark, sf):
    g = _vectors(spark, sf).select("id", F.posexplode(quant.q8_groups(F.col("vec"))).alias("grp", "q"))
    return g.select("id", "grp", F.round("q.scale", 8).alias("scale"), F.aggregate("q.codes", F.lit(0), lambda a, x: a + x).cast("long").alias("code_sum"))


@query
def layer_delta_encode(spark, sf):
    out = quant.layer_delta(_layers(spark, sf))
    return out.select("id", "layer", F.round("scale", 8).alias("scale"), F.aggregate("codes", F.lit(0), lambda a, x: a + x).cast("long").alias("code_sum"))


@query
def layer_delta_decode(spark, sf):
    return quant.undo_layer_delta(quant.layer_delta(_layers(spark, sf))).select("id", "layer", "dim", _r("x"))


@query
def polarquant(spark, sf):
    """Mean squared error of each vector. The deviations after rotation are one bounded aggregate."""
    v = _vectors(spark, sf).select("id", vx.doubles(F.col("vec")).alias("vec"))
    turn = quant.rotation(LAYERS * DIMS)
    basis = spark.createDataFrame([(i, j, float(turn[i, j])) for i in range(64) for j in range(64)], "dim int, comp int, b double")
    long = v.select("id", F.posexplode("vec").alias("dim", "x"))
    std = dict(fp.project(long, basis).groupBy("comp").agg(F.stddev_samp("x")).collect())
    back = quant.polar(v, 64, [std[i] for i in range(64)]).withColumnRenamed("vec", "back")
    gap = F.zip_with("vec", "back", lambda a, b: (a - b) ** 2)
    return v.join(back, "id").select("id", F.round(vx.total(gap), 6).alias("error"))


# Blocks


def _streams(spark, sf):
    line = _t(spark, sf, "lineitem").withColumn("stream", F.col("l_suppkey"))
    return store.numbered(line.select("stream", "l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber").alias("o")), "stream", "o").select("stream", "cell")


@query
def block_segment(spark, sf):
    return store.segments(_streams(spark, sf))


@query
def block_assemble(spark, sf):
    b = store.segments(_streams(spark, sf))
    return b.groupBy("stream").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_blocks"), F.max("token_end").alias("token_end"))


@query
def block_extend(spark, sf):
    more = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("stream"), (F.col("s_suppkey") % 300).cast("long").alias("n"))
    return store.extended(store.segments(_streams(spark, sf)), more).select("stream", "block", "token_start", "token_end", "n_tokens")


# History


@query
def doc_stats(spark, sf):
    return history.doc_stats(_log(spark, sf)).select("query_doc_id", "n_high", "n_medium", "n_low", _r("reliability"), _at("last_updated"))


@query
def doc_prior(spark, sf):
    docs = _t(spark, sf, "customer").select(F.concat(F.lit("doc_"), "c_custkey").alias("query_doc_id"))
    return history.priors(docs, _log(spark, sf)).select("query_doc_id", "n_high", "n_medium", "n_low", _r("reliability"), "chronic")


@query
def dominant_confidence(spark, sf):
    docs = _t(spark, sf, "customer").select(F.concat(F.lit("doc_"), "c_custkey").alias("query_doc_id"))
    return history.dominant(history.priors(docs, _log(spark, sf))).select("query_doc_id", "dominant")


@query
def confusion_registry(spark, sf):
    return history.confusions(_log(spark, sf)).select("doc_a", "doc_b", "n", _at("first_seen"), _at("last_seen"))


@query
def confusion_partners(spark, sf):
    return history.partners(history.confusions(_log(spark, sf))).select("query_doc_id", "pos", "partner", "side", "n")


@query
def reliability_map(spark, sf):
    return history.doc_stats(_log(spark, sf)).orderBy("reliability", "query_doc_id").select("query_doc_id", _r("reliability"))


@query
def session_history(spark, sf):
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    log = _log(spark, sf).withColumn("pos", F.row_number().over(order))
    return log.select("session_id", "pos", "event_id", "query_doc_id", "confidence")


@query
def n_sessions(spark, sf):
    return _log(spark, sf).agg(F.count_distinct("session_id").alias("n_sessions"))


@query
def weighted_reliability(spark, sf):
    return history.weighted_reliability(_log(spark, sf))


@query
def session_summary(spark, sf):
    return history.session_summary(_log(spark, sf))


@query
def new_confusion_pairs(spark, sf):
    return history.new_pairs(_log(spark, sf))


# Store and manifest


def _entries(spark, sf):
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("cache_id"), F.col("o_orderpriority").alias("family"), F.col("o_custkey").alias("n_tokens"), F.col("o_orderdate").alias("created_at"))


@query
def store_stats(spark, sf):
    out = store.store_stats(_entries(spark, sf))
    return out.select("n_entries", "n_tokens", F.array_join(F.transform(F.map_entries("by_family"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("by_family"))


@query
def list_entries(spark, sf):
    return store.list_entries(_entries(spark, sf), 20, "1-URGENT").select("cache_id", _at("created_at"))


def _manifest(spark, sf):
    d = _t(spark, sf, "documents")
    path = F.concat(F.lit("docs/"), "lang", F.lit("/"), "doc_id", F.lit(".md"))
    return d.select(path.alias("path"), F.col("source").alias("project"), F.sha2("text", 256).alias("hash"), (F.expr("n_chars div 2000") + 1).alias("n_chunks"), "doc_id")


@query
def manifest_needs_reindex(spark, sf):
    now = _manifest(spark, sf)
    old = now.filter("doc_id % 3 <> 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("hash")))
    return store.needs_reindex(now, old).select("path", "hash")


@query
def manifest_register(spark, sf):
    now = _manifest(spark, sf)
    old = now.filter("doc_id % 3 <> 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("hash")))
    return store.register(old, store.needs_reindex(now, old)).select("path", "hash", "n_chunks")


@query
def manifest_summary(spark, sf):
    return store.manifest_summary(_manifest(spark, sf)).select("n_sources", F.col("n_chunks").cast("long").alias("n_chunks"), "projects")


@query
def list_indexed(spark, sf):
    by = _manifest(spark, sf).groupBy("project").agg(F.count("*").alias("n_sources"), F.sum("n_chunks").cast("long").alias("n_chunks"))
    return by.withColumn("report", F.to_json(F.struct("project", "n_sources", "n_chunks")))


# Texts


@query
def content_hash(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query
def slug(spark, sf):
    path = F.concat(F.lit("notes/"), F.regexp_replace("p_name", " ", "_"), F.lit(" v2.md"))
    return _t(spark, sf, "part").select("p_partkey", tx.slug(path).alias("slug"))


@query
def eng_filename(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", tx.file_name(tx.slug(F.col("p_name")), F.lit("2026-04-02"), F.col("p_size"), F.col("p_size") % 3).alias("name"))


@query
def model_family(spark, sf):
    name = F.concat(F.element_at(F.array(*map(F.lit, ("Meta-Llama-", "microsoft/Phi-", "gemma", "Qwen2", "Mistral-7B", "other"))), (F.col("p_partkey") % 6 + 1).cast("int")), "p_name")
    return _t(spark, sf, "part").select("p_partkey", tx.family(name).alias("family"))


@query
def keyword_overlap(spark, sf):
    # Words are a column, so they are found once a text.
    d = _t(spark, sf, "documents").select("doc_id", tx.keywords(F.col("text")).alias("a"), tx.keywords(F.lit("the nation that was with the best of a this is on")).alias("b"))
    return d.select("doc_id", F.size("a").alias("n_words"), F.round(tx.jaccard(F.col("a"), F.col("b")), 6).alias("overlap"))


@query
def text_truncate(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.octet_length(tx.truncated(F.col("text"), 256)).cast("long").alias("n_bytes"))


def markdown_of(turns: DataFrame) -> DataFrame:
    """source, content: conversations as markdown, a header for each turn."""
    part = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    one = turns.groupBy(F.col("conv_id").cast("string").alias("source")).agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("part")))).alias("t"))
    return one.select("source", F.array_join(F.transform("t", lambda s: s["part"]), "\n\n").alias("content"))


@query
def conversation_markdown(spark, sf):
    return markdown_of(_t(spark, sf, "conversations")).select("source", F.sha2("content", 256).alias("hash"))


@query
def chunk_markdown(spark, sf):
    c = chunk_rows(markdown_of(_t(spark, sf, "conversations")))
    return c.select("source", "chunk_index", "chunk_total", "char_start", "char_end", F.array_join("headers", " > ").alias("headers"), F.sha2(tx.context(F.lit(""), F.col("headers"), F.col("raw_text")), 256).alias("hash"))


@query
def last_session(spark, sf):
    newest = F.max_by(F.struct("session_id", "event_id", "query_doc_id"), F.struct("ts", "event_id")).alias("s")
    return _log(spark, sf).agg(newest).select("s.*")


@query
def relevant_sessions(spark, sf):
    """Best three labels' centroids for each query, scores rounded to four digits before they are ranked."""
    v = _vectors(spark, sf)
    centers = label_centroid(spark, sf).groupBy(F.col("label").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec"))
    hits = search.top_k(_asked(v), centers, 10).withColumn("score", F.round("score", 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order) - 1).filter("rank < 3").select("query_id", "rank", "id", "score")


# Evaluation


def _nearest_other(spark, sf):
    v = _vectors(spark, sf)
    hits = search.top_k(v.select(F.col("id").alias("query_id"), "vec"), v, 3, cosine=True).filter(F.col("id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy("rank")
    two = hits.withColumn("n", F.row_number().over(order)).withColumn("lead", F.col("score") - F.lead("score").over(order)).filter("n = 1")
    label = v.select("id", "label")
    return two.join(label, "id").withColumnRenamed("label", "dst").join(label.select(F.col("id").alias("query_id"), F.col("label").alias("src")), "query_id")


@query
def recall_at_1(spark, sf):
    h = _nearest_other(spark, sf)
    return h.agg(F.round(F.avg((F.col("src") == F.col("dst")).cast("double")), 6).alias("recall"), F.round(F.avg("lead"), 6).alias("mean_margin"), F.round(F.median("lead"), 6).alias("median_margin"), F.round(F.min("lead"), 6).alias("min_margin"), F.count_if(F.col("src") != F.col("dst")).alias("n_failures"))


@query
def confusion_matrix(spark, sf):
    return _nearest_other(spark, sf).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query
def margin_power_law(spark, sf):
    """m = a * n ** alpha over mean order values by number of orders."""
    by = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("m")).groupBy("n").agg(F.avg("m").alias("m"))
    x, y = F.log(F.col("n").cast("double")), F.log("m")
    return by.agg(F.round(F.exp(F.regr_intercept(y, x)), 2).alias("a"), F.round(F.regr_slope(y, x), 6).alias("alpha"))


@query
def trial_summary(spark, sf):
    by = _t(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("a"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return by.select("event_type", F.round("a", 4).alias("mean"), F.round("s", 4).alias("std"), F.round("lo", 4).alias("least"), F.round("hi", 4).alias("most"), (F.col("a") > 0.05).alias("passed"))


# Formats and streams


@query
def model_specs(spark, sf):
    """The known models, with what is derived from name and shape."""
    importable(spark)
    specs = models.registry(spark)
    return specs.select("model_id", tx.family(F.col("model_id")).alias("family"), F.size(models.read_layers(F.col("n_layers"))).alias("n_read"), models.vector_dims(F.col("head_dim"), F.col("n_kv_heads")).alias("dims"))


@query
def eng_roundtrip(spark, sf):
    """Certificates of all vectors, encoded and decoded: what is read back."""
    from mnemis.sources import eng

    rows = _vectors(spark, sf).select("id", "vec", F.concat(F.lit("vector "), "id").alias("text"))

    def run(batches):
        for pdf in batches:
            out = []
            for i, v, text in zip(pdf["id"], pdf["vec"], pdf["text"]):
                row = {"vec_perdoc": v, "vec_fcdb": v[::-1], "joint_center": np.zeros(128), "task_description": text, "cache_id": f"c{i}", "context_len": int(i), "vec_fourier": v[:16], "confusion_flag": i % 2 == 0}
                back = eng.decode(eng.encode(row))
                out.append((back["cache_id"], back["task_description"], back["context_len"], back["confusion_flag"], len(back["vec_perdoc"]), len(back["vec_fourier"]), float(np.abs(np.array(back["vec_perdoc"]) - v).max()) < 1e-3))
            yield pd.DataFrame(out, columns=["cache_id", "task_description", "context_len", "confusion_flag", "n_perdoc", "n_fourier", "near"])

    return rows.mapInPandas(run, "cache_id string, task_description string, context_len long, confusion_flag boolean, n_perdoc int, n_fourier int, near boolean")


@query
def state_blob_scan(spark, sf):
    """Each vector as a blob of 2 layers, 2 heads, 4 cells and 4 dims, keys equal to values, scanned back into cells."""
    from mnemis.sources import state_blob

    def blobs(batches):
        for pdf in batches:
            made = []
            for i, v in zip(pdf["id"], pdf["vec"]):
                x = np.asarray(v, np.float64).reshape(2, 2, 4, 4)
                made.append((str(i), state_blob.encode([(x, x)], turned=i % 2 == 0)))
            yield pd.DataFrame(made, columns=["path", "content"])

    files = _vectors(spark, sf).select("id", "vec").mapInPandas(blobs, "path string, content binary")
    cells = state_blob.cells_of(files, [state_blob.Section(2, 4)])
    return cells.select("path", "kind", "layer", "head", "cell", F.round(vx.total(vx.doubles(F.col("vec"))), 2).alias("x"))


def _stream(spark, sf):
    """The log as a stream of the table's files."""
    importable(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # As a pattern, the path may be one file or a folder of files.
    return log_of(spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]"))


def _folder(spark) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared}/stream-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="mnemis-stream-")


@query
def stream_doc_stats(spark, sf):
    out = live.drained(live.running_stats(_stream(spark, sf)), _folder(spark), ["query_doc_id"])
    return out.select("query_doc_id", "n_high", "n_medium", "n_low", _r("reliability"), _at("last_updated"))


@query
def stream_confusions(spark, sf):
    out = live.drained(live.running_confusions(_stream(spark, sf)), _folder(spark), ["doc_a", "doc_b"])
    return out.select("doc_a", "doc_b", "n", _at("first_seen"), _at("last_seen"))


@query
def stream_windowed(spark, sf):
    out = live.drained(live.windows(_stream(spark, sf)), _folder(spark), ["window_start", "confidence"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "confidence", "n", "n_wrong")


@query
def stream_sliding(spark, sf):
    """Windows of two days, a new one each day."""
    out = live.drained(live.windows(_stream(spark, sf), "2 days", slide="1 day"), _folder(spark), ["window_start", "confidence"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "confidence", "n", "n_wrong")


@query
def stream_new_sources(spark, sf):
    """Of log rows taken as files, each pair of path and hash once."""
    files = _stream(spark, sf).select(F.col("query_doc_id").alias("path"), F.col("result_doc_id").alias("hash"), "ts")
    return live.appended(live.new_sources(files), _folder(spark)).select("path", "hash")


@query
def stream_sessions(spark, sf):
    out = live.drained(live.sessions(_stream(spark, sf)), _folder(spark))
    return out.select("query_doc_id", _at("session_start"), "n", "n_correct")
