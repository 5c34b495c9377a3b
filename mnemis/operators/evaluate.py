"""Trials, gates and series over search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemis.functions import vector as vx
from mnemis.operators.search import top_k


def trials(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, margin, correct of trials with two documents each. queries: query_id, vec, a, b (ids; a is the right one); corpus: id, vec.

    margin is the cosine to a less that to b; a trial is correct if a comes first."""
    side = lambda n: corpus.select(F.col("id").alias(n), vx.unit(F.col("vec")).alias(f"{n}_vec"))
    both = queries.join(side("a"), "a").join(side("b"), "b").withColumn("u", vx.unit(F.col("vec")))
    margin = vx.dot(F.col("u"), F.col("a_vec")) - vx.dot(F.col("u"), F.col("b_vec"))
    return both.select("query_id", margin.alias("margin")).withColumn("correct", F.col("margin") > 0)


def gate(summary: DataFrame) -> DataFrame:
    """summary (mean_margin, all_correct, overhead_ms, speed_up) with passed: margin over 0.05, all correct, under 200 ms, over 10 times as fast."""
    return summary.withColumn("passed", (F.col("mean_margin") > 0.05) & F.col("all_correct") & (F.col("overhead_ms") < 200) & (F.col("speed_up") > 10))


def recall_series(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """n, recall, mean_margin: recall at 1 and mean margin among the first n rows by id, each asked against the others. rows: id, vec, label."""
    out = None
    for n in sizes:
        few = rows.filter(F.col("id") < n)
        two = top_k(few.select(F.col("id").alias("query_id"), "vec"), few.select("id", "vec"), 2, cosine=True, others=True).filter("rank = 0")
        two = two.join(few.select("id", F.col("label").alias("dst")), "id").join(few.select(F.col("id").alias("query_id"), F.col("label").alias("src")), "query_id")
        one = two.agg(F.lit(n).alias("n"), F.round(F.avg((F.col("src") == F.col("dst")).cast("double")), 6).alias("recall"), F.round(F.avg("margin"), 6).alias("mean_margin"))
        out = one if out is None else out.unionByName(one)
    return out


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, a, b: the same documents' vectors (id, vec) of two models, side by side."""
    return left.select("id", F.col("vec").alias("a")).join(right.select("id", F.col("vec").alias("b")), "id")
