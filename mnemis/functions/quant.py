"""Quantisers as column expressions; rounding is half to even."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemis.functions import vector as vx


def scale_int8(v: Column) -> Column:
    return F.greatest(vx.largest(v), F.lit(1e-8)) / 127


def codes(v: Column, scale: Column) -> Column:
    return F.transform(vx.doubles(v), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x / scale))).cast("int"))


def q8_groups(v: Column, size: int = 32) -> Column:
    """scale and codes of each group of 32."""

    def one(g: Column) -> Column:
        s = F.greatest(vx.largest(g) / 127, F.lit(1e-10))
        return F.struct(s.alias("scale"), codes(g, s).alias("codes"))

    return F.transform(vx.groups(vx.doubles(v), size), one)


def layer_delta(rows: DataFrame) -> DataFrame:
    """id, layer, base or scale and codes: layer 0 as it is, each other as int8 differences to the layer before."""
    before = F.lag("vec").over(Window.partitionBy("id").orderBy("layer"))
    change = F.when(before.isNotNull(), F.zip_with(vx.doubles(F.col("vec")), vx.doubles(before), lambda a, b: a - b))
    out = rows.withColumn("delta", change).withColumn("scale", scale_int8(F.col("delta")))
    return out.select("id", "layer", F.when(F.col("delta").isNull(), vx.doubles(F.col("vec"))).alias("base"), "scale", F.when(F.col("delta").isNotNull(), codes(F.col("delta"), F.col("scale"))).alias("codes"))


def undo_layer_delta(coded: DataFrame) -> DataFrame:
    """id, layer, dim, x: running sums of the base and the scaled codes."""
    step = F.coalesce("base", F.transform(F.col("codes"), lambda c: c * F.col("scale")))
    long = coded.select("id", "layer", F.posexplode(step).alias("dim", "d"))
    running = Window.partitionBy("id", "dim").orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)
    return long.select("id", "layer", "dim", F.sum("d").over(running).alias("x"))


#: The eight centroids in standard deviations; zero stands twice.
CENTROIDS = (-1.748, -1.050, -0.501, 0.0, 0.0, 0.501, 1.050, 1.748)


@lru_cache(maxsize=4)
def rotation(dims: int, seed: int = 42) -> np.ndarray:
    """Orthogonal matrix of a seeded normal matrix in single precision, the triangular factor's diagonal positive."""
    q, r = np.linalg.qr(np.random.RandomState(seed).randn(dims, dims).astype(np.float32))
    return (q * np.sign(np.diag(r))).astype(np.float64)


def polar(rows: DataFrame, dims: int, deviation: list[float]) -> DataFrame:
    """id, vec: rotated, each entry put to the nearest centroid times its dimension's deviation, rotated back."""
    spread, levels = np.maximum(np.nan_to_num(np.array(deviation)), 1e-10), np.array(CENTROIDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = rotation(dims)
        for pdf in batches:
            if len(pdf):
                y = np.array([np.asarray(v, np.float64) for v in pdf["vec"]]) @ turn / spread
                z = levels[np.abs(y[:, :, None] - levels).argmin(axis=2)] * spread
                yield pd.DataFrame({"id": pdf["id"], "vec": list(z @ turn.T)})

    return rows.select("id", "vec").mapInPandas(run, "id long, vec array<double>")


def half(x: Column) -> Column:
    """A number as half precision holds it: 11 bits, half to even, small ones in steps of 2^-24."""
    size = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1e-30)))), F.lit(-14)) - 10)
    return F.when(size < 65520.0, F.rint(x / step) * step).when(x > 0, float("inf")).otherwise(float("-inf"))


def halves(v: Column) -> Column:
    return F.transform(vx.doubles(v), half)


METHODS = ("fp16", "q8_0", "q4_0", "int8", "polarquant", "layer_delta")


def round_trip(v: Column, method: str) -> Column:
    """What a method that works row by row gives back of a vector. q4_0 is kept as q8_0, as that is faster to read; the
    others need more than the row: see `polar` and `layer_delta`. An unknown method is an error."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if method in ("polarquant", "layer_delta"):
        raise ValueError(f"{method} needs all rows of a document")
    if method == "fp16":
        return halves(v)
    if method == "int8":
        s = scale_int8(v)
        return F.transform(codes(v, s), lambda c: c * half(s))
    return F.slice(F.flatten(F.transform(q8_groups(v), lambda g: F.transform(g["codes"], lambda c: c * g["scale"]))), 1, F.size(v))
