"""Staged retrieval of a query set: each stage searches only for the queries that earlier ones left open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemis.functions import text as tx
from mnemis.functions import vector as vx
from mnemis.operators.search import tier, top_k
from mnemis.session import cut

COLUMNS = ("query_id", "id", "score", "margin", "confidence", "stages_used", "constraint_used")


def constrained(queries: DataFrame, corpus: DataFrame, k: int = 5, weight: float = 0.5, threshold: float = 0.85, others: bool = False, n: int | None = None) -> DataFrame:
    """Cosine top-k with penalties for likeness to each query's `unlike` vectors."""
    return top_k(queries, corpus, k, cosine=True, weight=weight, threshold=threshold, others=others, n=n)


def first_flagged(corpus: DataFrame, n: int) -> DataFrame:
    """One row: the first n flagged vectors by id, as (id, vec). n is small, so this is a bounded aggregate."""
    few = corpus.filter("flagged").orderBy("id").limit(n).select(F.struct("id", "vec").alias("f"))
    return few.agg(F.sort_array(F.collect_list("f")).alias("first"))


def stages(queries: DataFrame, corpus: DataFrame, tau: float = 0.005, weight: float = 0.3, threshold: float = 0.85, scale: Column | None = None, others: bool = False, n: int | None = None) -> DataFrame:
    """Stages 1 to 3 of each query. queries: query_id, vec; corpus: id, vec, flagged. scale: factor on tau, by query column.

    1: cosine search; margin of 5 tau is HIGH, of tau MEDIUM, fewer than two hits LOW. 2: the query is moved
    towards its first hit and searched again; a first hit without a vector leaves the query as it is, LOW. 3: if
    that finds a flagged vector and others are flagged, a search that holds the first three others against each
    candidate. What stage 1 settles is not searched again. others: a query's own id is not searched.
    Each stage's open queries are cut, so a stage runs once and its successor knows how many there are.
    """
    limit = F.lit(tau) * (scale if scale is not None else F.lit(1.0))
    n, vectors = corpus.count() if n is None else n, corpus.select("id", "vec")
    asked = cut(queries.withColumn("tau", limit).select("query_id", "vec", "tau"))
    hits = top_k(asked, vectors, 2, cosine=True, others=others, n=n)
    hits = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("rank") == 0, F.struct("id", "score", "margin"))).alias("h"))
    one = hits.select("query_id", "n", "h.*").join(asked, "query_id").withColumn("confidence", F.when(F.col("n") < 2, "LOW").otherwise(tier(F.col("margin"), F.col("tau"))))
    one = cut(one.join(corpus.select("id", F.col("vec").alias("top")), "id", "left"))
    open_ = (F.col("n") >= 2) & (F.col("confidence") == "LOW") & F.col("top").isNotNull()
    settled = one.filter(~open_).withColumn("stages_used", F.lit(1)).withColumn("constraint_used", F.lit(False))
    refined = cut(one.filter(open_).select("query_id", vx.unit(vx.lerp(F.col("vec"), F.col("top"), weight)).alias("vec"), "tau"))
    two = top_k(refined, vectors, 2, cosine=True, others=others, n=n).filter("rank = 0")
    two = two.join(refined.select("query_id", "tau", F.col("vec").alias("refined")), "query_id").join(corpus.select("id", "flagged"), "id")
    unlike = F.filter("first", lambda f: (f["id"] != F.col("id")) & (~F.lit(others) | (f["id"] != F.col("query_id"))))
    two = cut(two.join(F.broadcast(first_flagged(corpus, 5)), F.lit(True)).withColumn("unlike", F.slice(unlike, 1, 3)["vec"]).drop("first"))
    third = F.col("flagged") & (F.size("unlike") > 0)
    plain = two.filter(~third).withColumn("confidence", F.when(F.col("margin") >= F.col("tau"), "MEDIUM").otherwise("LOW"))
    plain = plain.withColumn("stages_used", F.lit(2)).withColumn("constraint_used", F.lit(False))
    ask = two.filter(third).select("query_id", F.col("refined").alias("vec"), "unlike", "tau")
    three = constrained(ask, vectors, 2, threshold=threshold, others=others, n=n).filter("rank = 0").join(ask.select("query_id", "tau"), "query_id")
    three = three.withColumn("confidence", F.when(F.col("margin") >= F.col("tau"), "MEDIUM").otherwise("LOW"))
    three = three.withColumn("stages_used", F.lit(3)).withColumn("constraint_used", F.lit(True))
    return settled.select(*COLUMNS).unionByName(plain.select(*COLUMNS)).unionByName(three.select(*COLUMNS))


def with_prior(queries: DataFrame, corpus: DataFrame, priors: DataFrame, partners: DataFrame, tau: float = 0.005, threshold: float = 0.85, others: bool = False) -> DataFrame:
    """Stage 0 before the others. priors: query_id, n_total, n_low; partners: query_id, partner, pos.

    A chronic query (over half low, two records or more) with partners that have vectors is searched against its
    first three partners, and has used no stage. The others' tau grows by their share of low records.
    """
    n = corpus.count()
    known = queries.select("query_id", "vec").join(priors, "query_id", "left").fillna(0, ["n_total", "n_low"])
    three = partners.filter("pos <= 3").join(corpus.select(F.col("id").alias("partner"), F.col("vec").alias("pv")), "partner").filter(~F.lit(others) | (F.col("partner") != F.col("query_id")))
    unlike = three.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "pv"))), lambda s: s["pv"]).alias("unlike"))
    known = cut(known.join(unlike, "query_id", "left"))
    chronic = (F.col("n_total") >= 2) & (2 * F.col("n_low") > F.col("n_total")) & F.col("unlike").isNotNull()
    zero = constrained(known.filter(chronic).select("query_id", "vec", "unlike"), corpus.select("id", "vec"), 2, threshold=threshold, others=others, n=n).filter("rank = 0")
    zero = zero.withColumn("confidence", F.when(F.col("margin") >= tau, "MEDIUM").otherwise("LOW"))
    zero = zero.withColumn("stages_used", F.lit(0)).withColumn("constraint_used", F.lit(True))
    scale = 1 + F.coalesce(F.col("n_low") / F.nullif(F.col("n_total"), F.lit(0)), F.lit(0.0))
    rest = stages(known.filter(~chronic).drop("unlike"), corpus, tau, threshold=threshold, scale=scale, others=others, n=n)
    return zero.select(*COLUMNS).unionByName(rest)


def with_metadata(base: DataFrame, queries: DataFrame, corpus: DataFrame, meta: DataFrame, k: int = 5, others: bool = False) -> DataFrame:
    """Stage 4: of results that are LOW, the document that metadata prefers among the k nearest, with stage4_used.

    base: as `with_prior` gives it; meta: id, domain, len, norm, description, of queries by their id too. Score,
    margin, confidence and stages stay those of base. A query without metadata, or none of whose candidates has
    any, keeps its document. Only LOW queries are searched again.
    """
    base = cut(base)
    low = cut(base.filter("confidence = 'LOW'").select("query_id").join(queries.select("query_id", "vec"), "query_id"))
    hits = top_k(low, corpus.select("id", "vec"), k, cosine=True, others=others).select("query_id", "rank", "id")
    named = lambda p: meta.select(F.col("id").alias(f"{p}id"), *(F.col(c).alias(f"{p}{c}") for c in ("domain", "len", "norm", "description")))
    both = hits.join(named("c_"), F.col("id") == F.col("c_id")).join(named("q_"), F.col("query_id") == F.col("q_id"))
    columns = lambda p: {c: F.col(f"{p}{c}") for c in ("domain", "len", "norm", "description")}
    won = disambiguate(both.withColumns(meta_score(columns("q_"), columns("c_")))).select("query_id", F.col("id").alias("won"))
    out = base.join(won, "query_id", "left").withColumn("stage4_used", F.col("won").isNotNull())
    return out.withColumn("id", F.coalesce("won", "id")).drop("won")


def meta_score(query: dict[str, Column], cand: dict[str, Column], bonus: float = 0.3, most_len: float = 8192.0, most_norm: float = 10.0) -> dict[str, Column]:
    """Parts and sum of the metadata score of a candidate. Columns: domain, len, norm, description."""
    same = (query["domain"] != "") & (cand["domain"] != "") & (query["domain"] == cand["domain"])
    near = lambda a, b, most: 1 - F.least(F.abs(a - b) / F.lit(max(most, 1.0)), F.lit(1.0))
    length = near(tx.default_if_falsy(query["len"], 512.0), tx.default_if_falsy(cand["len"], 512.0), most_len)
    size = near(tx.default_if_falsy(query["norm"], 1.0), tx.default_if_falsy(cand["norm"], 1.0), most_norm)
    words = tx.jaccard(tx.keywords(F.substring(query["description"], 1, 80)), tx.keywords(F.substring(cand["description"], 1, 80)))
    domain = F.when(same, F.lit(bonus)).otherwise(0.0)
    return {"domain_part": domain, "len_part": length, "norm_part": size, "word_part": words, "meta_score": domain + length + size + words}


def disambiguate(candidates: DataFrame) -> DataFrame:
    """The candidate of each query with the highest meta_score, first by rank among equals."""
    order = Window.partitionBy("query_id").orderBy(F.desc("meta_score"), "rank")
    return candidates.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def density(queries: DataFrame, corpus: DataFrame, radius: float, neighbours: int = 20, over: int = 50) -> DataFrame:
    """query_id, id, similarity, density of those of a new vector's nearest `neighbours`, itself among them, that lie
    within the radius; confused if density > 3.

    density: how many of the `over` vectors nearest to the neighbour lie nearer than the radius, itself left out.
    """
    n = corpus.count()
    near = cut(top_k(queries, corpus, neighbours, cosine=True, n=n).filter(F.col("id") != F.col("query_id")).filter(F.col("score") >= radius))
    asked = cut(near.select("id").distinct().join(corpus, "id").select(F.col("id").alias("query_id"), "vec"))
    around = top_k(asked, corpus, over, cosine=True, n=n).filter((F.col("id") != F.col("query_id")) & (F.col("score") > radius))
    counts = around.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("density"))
    out = near.select("query_id", "id", F.col("score").alias("similarity")).join(counts, "id", "left").fillna(0, ["density"])
    return out.withColumn("confused", F.col("density") > 3)


def registered(confused: DataFrame, ts: Column) -> tuple[DataFrame, DataFrame]:
    """What `density` adds to the history: log rows of confusions (neighbour to new document), and neighbours whose stats were touched."""
    rows = confused.filter("confused").select(F.col("id").alias("query_doc_id"), F.col("query_id").alias("result_doc_id"), F.lit(False).alias("correct"), ts.alias("ts"))
    return rows, confused.select("id", ts.alias("last_updated")).distinct()
