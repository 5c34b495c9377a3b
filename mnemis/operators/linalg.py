"""Singular value decompositions: per document in grouped Arrow batches, over a corpus by its Gram matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemis.operators.fingerprint import gram


def signed(basis: np.ndarray) -> np.ndarray:
    """Rows with their largest entry positive, so equal data give equal vectors."""
    at = np.abs(basis).argmax(axis=1)
    return basis * np.where(basis[np.arange(len(basis)), at] < 0, -1.0, 1.0)[:, None]


def svd_state(rows: DataFrame, rank: int, gate: int = 0) -> DataFrame:
    """id, comp, x, evr: mean of a document's rows (id, layer, vec) on its right singular vectors from `gate` on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([np.asarray(v, np.float64) for v in pdf.sort_values("layer")["vec"]])
        _, s, vh = np.linalg.svd(x, full_matrices=False)
        w = signed(vh[gate : gate + min(rank, *x.shape)])
        evr = float((s[: gate + len(w)] ** 2).sum() / max((s**2).sum(), 1e-12))
        return pd.DataFrame({"id": pdf["id"].iloc[0], "comp": range(len(w)), "x": x.mean(axis=0) @ w.T, "evr": evr})

    return rows.groupBy("id").applyInPandas(run, "id long, comp int, x double, evr double")


def extract(rows: DataFrame, mode: str, rank: int = 4, gate: int = 0) -> DataFrame:
    """id, comp, x, l2 of documents' layer vectors (id, layer, vec) by the named mode; l2 is the length of x.

    mean: the mean of the rows; svd: `svd_state`; svd_unit: the same to unit length, as certificates keep it;
    grouped: `grouped_state`, its parts one after the other. Another mode is an error."""
    if mode == "mean":
        out = rows.select("id", F.posexplode("vec").alias("comp", "v")).groupBy("id", "comp").agg(F.avg(F.col("v").cast("double")).alias("x"))
    elif mode in ("svd", "svd_unit"):
        out = svd_state(rows, rank, gate).select("id", "comp", "x")
    elif mode == "grouped":
        out = grouped_state(rows, rank).select("id", (F.col("part") * rank + F.col("comp")).cast("int").alias("comp"), "x")
    else:
        raise ValueError(f"unknown mode {mode}")
    l2 = F.sqrt(F.sum(F.col("x") ** 2).over(Window.partitionBy("id")))
    return out.select("id", "comp", (F.col("x") / (l2 + 1e-8) if mode == "svd_unit" else F.col("x")).alias("x"), l2.alias("l2"))


def grouped_state(rows: DataFrame, rank: int, size: int = 4) -> DataFrame:
    """id, part, comp, x: `svd_state` of each group of `size` layers, ranks shared among them."""
    n = rows.selectExpr("max(layer) + 1 as n").first()["n"] or size
    each = max(1, rank // max(1, -(-n // size)))
    parts = rows.selectExpr("id", f"layer div {size} as part", "layer", "vec")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([np.asarray(v, np.float64) for v in pdf.sort_values("layer")["vec"]])
        w = signed(np.linalg.svd(x, full_matrices=False)[2][: min(each, *x.shape)])
        return pd.DataFrame({"id": key[0], "part": key[1], "comp": range(len(w)), "x": x.mean(axis=0) @ w.T})

    return parts.groupBy("id", "part").applyInPandas(run, "id long, part long, comp int, x double")


def corpus_basis(rows: DataFrame, dims: int, rank: int, gate: int = 0) -> np.ndarray:
    """Right singular vectors of all rows (vec) stacked, from their Gram matrix: dims squared values come to the driver."""
    g = np.zeros((dims, dims))
    for i, j, x in gram(rows).collect():
        g[i, j] = g[j, i] = x
    return signed(np.linalg.eigh(g)[1][:, ::-1].T[gate : gate + rank])
