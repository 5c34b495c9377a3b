"""Views over the append-only log of retrievals: session_id, query_doc_id, result_doc_id, confidence, margin,
stages_used, constraint_used, correct, ts, event_id. Nothing is kept beside the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def doc_stats(log: DataFrame) -> DataFrame:
    """Counts of each queried document by confidence; an unknown tag counts as medium."""
    tag = F.col("confidence")
    n = {"n_high": tag == "high", "n_low": tag == "low", "n_medium": ~tag.isin("high", "low") | tag.isNull()}
    out = log.groupBy("query_doc_id").agg(*(F.count_if(c).alias(k) for k, c in n.items()), F.max("ts").alias("last_updated"))
    total = F.col("n_high") + F.col("n_medium") + F.col("n_low")
    return out.withColumn("n_total", total).withColumn("reliability", (F.col("n_high") + F.col("n_medium")) / total)


def priors(docs: DataFrame, log: DataFrame) -> DataFrame:
    """Stats of every asked document; one without history has zeros and reliability 1. Chronic: over half low."""
    out = docs.select("query_doc_id").join(doc_stats(log), "query_doc_id", "left").fillna(0, ["n_high", "n_medium", "n_low", "n_total"]).fillna(1.0, ["reliability"])
    return out.withColumn("chronic", 2 * F.col("n_low") > F.col("n_total"))


def dominant(stats: DataFrame) -> DataFrame:
    """The most frequent confidence, ties high before medium before low; unknown without records."""
    h, m, low = F.col("n_high"), F.col("n_medium"), F.col("n_low")
    best = F.when(h + m + low == 0, "unknown").when((h >= m) & (h >= low), "high").when(m >= low, "medium").otherwise("low")
    return stats.withColumn("dominant", best)


def confusions(log: DataFrame) -> DataFrame:
    """Directed pairs of wrong retrievals: count, first and last time."""
    wrong = log.filter("not correct").groupBy(F.col("query_doc_id").alias("doc_a"), F.col("result_doc_id").alias("doc_b"))
    return wrong.agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def partners(pairs: DataFrame, most: int = 3) -> DataFrame:
    """query_doc_id, partner, pos: the first partners of each document, as doc_a before as doc_b, frequent first."""
    both = pairs.select(F.col("doc_a").alias("query_doc_id"), F.col("doc_b").alias("partner"), F.lit(0).alias("side"), "n").unionByName(pairs.select(F.col("doc_b").alias("query_doc_id"), F.col("doc_a").alias("partner"), F.lit(1).alias("side"), "n"))
    order = Window.partitionBy("query_doc_id").orderBy("side", F.desc("n"), "partner")
    return both.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most)


def weighted_reliability(log: DataFrame, decay: float = 0.85) -> DataFrame:
    """Share of right retrievals, each weighted by decay to the power of its age in records."""
    age = F.row_number().over(Window.partitionBy("query_doc_id").orderBy(F.desc("ts"), F.desc("event_id"))) - 1
    w = F.pow(F.lit(decay), F.col("age"))
    out = log.withColumn("age", age).groupBy("query_doc_id").agg((F.sum(F.when(F.col("correct"), w).otherwise(0.0)) / F.sum(w)).alias("x"))
    return out.select("query_doc_id", F.round("x", 6).alias("weighted_reliability"))


def session_summary(log: DataFrame) -> DataFrame:
    """Totals of each session by tier as tagged, preempted ones, and recall."""
    c = F.col("confidence")
    out = log.groupBy("session_id").agg(
        F.count("*").alias("n_total"), F.count_if(c == "high").alias("n_high"), F.count_if(c == "medium").alias("n_medium"), F.count_if(c == "low").alias("n_low"),
        F.count_if(F.col("stages_used") == 0).alias("n_preempted"), F.count_if("correct").alias("n_correct"),
    )
    return out.withColumn("recall", F.round(F.col("n_correct") / F.col("n_total"), 6))


def new_pairs(log: DataFrame) -> DataFrame:
    """session_id, doc_a, doc_b: confused pairs that no earlier session had."""
    wrong = log.filter("not correct").groupBy(F.col("query_doc_id").alias("doc_a"), F.col("result_doc_id").alias("doc_b"))
    return wrong.agg(F.min("session_id").alias("session_id"))
