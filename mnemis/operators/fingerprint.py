"""Fingerprints of layered vectors: long tables of (id, layer, dim, x), reduced by grouped aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemis.functions import vector as vx


def cells(rows: DataFrame, dims: int) -> DataFrame:
    """id, layer, dim, x of vectors read as layers of `dims` values."""
    pos = rows.select("id", F.posexplode("vec").alias("p", "x"))
    return pos.select("id", F.expr(f"p div {dims}").alias("layer"), (F.col("p") % dims).alias("dim"), F.col("x").cast("double").alias("x"))


def mean_pool(long: DataFrame) -> DataFrame:
    """id, dim, x: mean over all layers and cells, not normalised."""
    return long.groupBy("id", "dim").agg(F.avg("x").alias("x"))


def amplitudes(long: DataFrame, frequencies: list[int], n_layers: int) -> DataFrame:
    """id, freq, dim, a: size of the discrete Fourier transform over layers."""
    parts = []
    for f in frequencies:
        turn = F.lit(2 * math.pi * f / n_layers) * F.col("layer")
        parts += [F.sum(F.col("x") * F.cos(turn)).alias(f"re{f}"), F.sum(F.col("x") * F.sin(turn)).alias(f"im{f}")]
    sums = long.groupBy("id", "dim").agg(*parts)
    size = [F.struct(F.lit(f).alias("freq"), F.sqrt(F.col(f"re{f}") ** 2 + F.col(f"im{f}") ** 2).alias("a")) for f in frequencies]
    return sums.select("id", "dim", F.explode(F.array(*size)).alias("s")).select("id", "s.freq", "dim", "s.a")


def _scaled(x: Column, *by: str, plus: bool = False) -> Column:
    length = F.sqrt(F.sum(x * x).over(Window.partitionBy(*by)))
    return x / (length + 1e-8) if plus else x / F.greatest(length, F.lit(1e-12))


def fourier(long: DataFrame, frequencies: list[int], n_layers: int, unit_layers: bool = False) -> DataFrame:
    """id, freq, dim, x: amplitudes, each frequency to unit length; unit_layers: layers are brought to unit length first.

    A frequency that so many layers don't have is an error."""
    if max(frequencies) >= n_layers // 2 + 1:
        raise ValueError(f"{n_layers} layers have no frequency {max(frequencies)}")
    if unit_layers:
        long = long.withColumn("x", _scaled(F.col("x"), "id", "layer"))
    return amplitudes(long, frequencies, n_layers).select("id", "freq", "dim", _scaled(F.col("a"), "id", "freq").alias("x"))


def fourier_whole(long: DataFrame, frequencies: list[int], n_layers: int) -> DataFrame:
    """id, freq, dim, x: each frequency scaled, then all; a frequency that isn't there gives zeros."""
    there = [f for f in frequencies if f < n_layers // 2 + 1]
    a = amplitudes(long, there, n_layers).select("id", "freq", "dim", _scaled(F.col("a"), "id", "freq", plus=True).alias("x"))
    for f in sorted({*frequencies} - {*there}):
        a = a.unionByName(long.select("id", "dim").distinct().select("id", F.lit(f).alias("freq"), "dim", F.lit(0.0).alias("x")))
    return a.select("id", "freq", "dim", _scaled(F.col("x"), "id", plus=True).alias("x"))


def project(pooled: DataFrame, basis: DataFrame) -> DataFrame:
    """id, comp, x: pooled vectors (id, dim, x) on a basis (comp, dim, b). The mean goes first: projection is linear.

    The basis is a table of rank times dimension values, whatever the corpus."""
    return pooled.join(F.broadcast(basis), "dim").groupBy("id", "comp").agg(F.sum(F.col("x") * F.col("b")).alias("x"))


def gram(rows: DataFrame) -> DataFrame:
    """i, j, g: sum of x_i * x_j over all rows, i <= j. rows: vec, all of one dimension; null vectors take no part.

    A task multiplies whole batches and sends its partial sums once, so the shuffle has dims squared values a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.array([np.asarray(v, np.float64) for v in pdf["vec"]])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i, "j": j, "g": total[i, j]})

    parts = rows.filter(F.size("vec") > 0).select("vec").mapInPandas(run, "i int, j int, g double")
    return parts.groupBy("i", "j").agg(F.sum("g").alias("g"))


def fourier_arrays(rows: DataFrame, frequencies: list[int], dims: int, n_layers: int, unit_layers: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns to keep, x: for each frequency an array of `dims` values; as `fourier` of vectors that are one row
    each, as layers of `dims` values, inside the row: no shuffle.

    rows: id, vec. A frequency that so many layers don't have is an error."""
    if max(frequencies) >= n_layers // 2 + 1:
        raise ValueError(f"{n_layers} layers have no frequency {max(frequencies)}")
    layers = vx.groups(vx.doubles(F.col("vec")), dims)
    if unit_layers:
        layers = F.transform(layers, lambda v: vx.unit(v))
    out = rows.select("id", *keep, layers.alias("l"))

    def size(f: int) -> Column:
        part = lambda fn, d: F.aggregate(F.sequence(F.lit(0), F.lit(n_layers - 1)), F.lit(0.0), lambda a, k: a + F.get(F.get(F.col("l"), k), d) * fn(F.lit(2 * math.pi * f / n_layers) * k))
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.sqrt(part(F.cos, d) ** 2 + part(F.sin, d) ** 2))

    sizes = out.select("id", *keep, F.array(*(size(f) for f in frequencies)).alias("a"))
    return sizes.select("id", *keep, F.transform("a", lambda a: vx.unit(a)).alias("x"))


def fourier_rows(rows: DataFrame, frequencies: list[int], dims: int, n_layers: int, unit_layers: bool = False) -> DataFrame:
    """id, freq, dim, x: `fourier_arrays`, a row for each value."""
    each = fourier_arrays(rows, frequencies, dims, n_layers, unit_layers).select("id", F.explode(F.arrays_zip(F.array(*map(F.lit, frequencies)).alias("freq"), "x")).alias("s"))
    return each.select("id", "s.freq", F.posexplode("s.x").alias("dim", "x"))


def select_layers(long: DataFrame, n_layers: int, span: tuple[int, int] | None = None, listed: list[int] | None = None) -> DataFrame:
    """Cells of the layers that are read: those of `span`, cut to what there is, else those listed that exist; all if that leaves none."""
    if span is not None:
        low = max(0, min(span[0], n_layers))
        chosen = list(range(low, max(low, min(span[1], n_layers))))
    else:
        chosen = [x for x in listed or [] if x < n_layers]
    return long.filter(F.col("layer").isin(chosen)) if chosen else long
