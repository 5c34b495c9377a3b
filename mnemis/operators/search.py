"""Exact top-k search of a query set over all vectors, in blocks of matrix products."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a corpus block and queries of a query block, which meet in a task. For more than so many tasks both
#: blocks grow, up to so many times.
BLOCK, ASKED, TASKS, GROWN = 16_384, 16_384, 256, 4
#: Queries and vectors multiplied at once, vectors whose largest product is kept, queries at once in double precision,
#: values multiplied again at once.
AT_ONCE, WIDE, GROUP, SLOWLY, AGAIN = 256, 2048, 32, 64, 2**22
#: Queries of a block at once in double precision, with what they find, and vectors copied at once.
PART = 4096


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _blocks(n: int, m: int) -> tuple[int, int]:
    """Blocks of n vectors and of m queries."""
    n, m = max(1, -(-n // BLOCK)), max(1, -(-m // ASKED))
    grown = min(GROWN, max(1.0, math.sqrt(n * m / TASKS)))
    return math.ceil(n / grown), math.ceil(m / grown)


def _of_size(rows: pa.Table, d: int) -> pa.Table:
    """The rows whose vectors have d values."""
    fits = pc.equal(pc.list_value_length(rows["vec"]), d)
    return rows if pc.all(fits, skip_nulls=False).as_py() else rows.filter(fits)


def _matrix(rows: pa.Table, d: int, at: list[int] | None, unit: bool) -> np.ndarray:
    """The vectors of d values, or their components `at`; unit: each divided by its length."""
    x = np.empty((len(rows), d if at is None else len(at)))
    for i in range(0, len(x), PART):
        part = pc.list_flatten(rows["vec"].slice(i, PART)).to_numpy().astype(np.float64).reshape(-1, d)
        part = part if at is None else part[:, at]
        x[i : i + PART] = _unit(part) if unit else part
    return x


def _first_copies(x: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows that fewer than `most` equal rows precede."""
    _, group = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    ordered = group[order]
    return np.sort(order[np.arange(len(x)) - np.searchsorted(ordered, ordered) < most])


def _kth(s: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; -inf if it has fewer."""
    return np.partition(s, s.shape[1] - k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(s), -np.inf, s.dtype)


def nearest(y: np.ndarray, x: np.ndarray, k: int, same: tuple[np.ndarray, np.ndarray] | None = None, less: Callable[[slice, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores, k for each row of y, best first: its largest products with rows of x, ties to the earlier row. What isn't there scores -inf.

    same: codes of y's and x's rows; pairs of equal codes are left out. less: gives what some rows of y lose against
    rows of x. Tiles of products in single precision give the largest of each group of GROUP rows of x; in the groups
    that by the error bound may hold one of the k best, products are made again in double precision, each pair alike, so
    equal rows tie. With `less`, and with values that aren't finite, all is in double precision. Of equal rows of x only
    the first can win, so large groups of them cost little.
    """
    return _against(x, k, same[1] if same else None)(y, same[0] if same else None, less)


def _against(x: np.ndarray, k: int, codes: np.ndarray | None = None) -> Callable[..., tuple[np.ndarray, np.ndarray]]:
    """`nearest` for one x, as a function of y, codes of y's rows and less, which may be called for any number of y."""
    spare = k + (int(np.bincount(codes).max(initial=0)) if codes is not None else 0)
    kept = _first_copies(x, spare)
    x, n, d = x if len(kept) == len(x) else x[kept], len(kept), x.shape[1]
    finite = all(np.isfinite(x[i : i + PART]).all() for i in range(0, n, PART))
    if finite:
        most = max(*(np.linalg.norm(x[i : i + PART], axis=1).max() for i in range(0, n, PART)), 1e-300, 0)
        groups = np.zeros((-(-n // WIDE) * WIDE // GROUP, GROUP, d), np.float32)
        for i in range(0, n, PART):
            groups.reshape(-1, d)[i : min(i + PART, n)] = x[i : i + PART] / most
        # In a tile, place t * (groups of a tile) + g is row t of group g, so the largest are found by long rows.
        tiles = np.ascontiguousarray(groups.reshape(-1, WIDE // GROUP, GROUP, d).transpose(0, 2, 1, 3)).reshape(-1, WIDE, d)
        missing = (np.arange(WIDE).reshape(-1, GROUP).T.ravel() + (len(tiles) - 1) * WIDE) >= n

    def found(y: np.ndarray, asks: np.ndarray | None = None, less: Callable[[slice, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        places, scores = np.zeros((len(y), k), np.int64), np.full((len(y), k), -np.inf)

        def take(r: np.ndarray, c: np.ndarray, v: np.ndarray) -> None:
            """r: rows of y, with all that may win; c: rows of x, ascending in each."""
            if codes is not None:
                v[asks[r] == codes[kept[c]]] = -np.inf
            order = np.lexsort((-v, r))
            r, c, v = r[order], c[order], v[order]
            j = np.arange(len(r)) - np.searchsorted(r, r)
            r, c, v, j = (t[j < k] for t in (r, c, v, j))
            places[r, j], scores[r, j] = kept[c], v

        if less is not None or not (finite and np.isfinite(y).all()):
            for i in range(0, len(y), SLOWLY):
                s = y[i : i + SLOWLY] @ x.T
                if less is not None:
                    s -= less(slice(i, i + len(s)), x)
                s[np.isnan(s)] = -np.inf
                r, c = np.nonzero(s >= _kth(s, spare)[:, None])
                take(i + r, c, s[r, c])
            return places, scores
        size = np.linalg.norm(y, axis=1)
        error = np.where(size > 0, (d + 4) * 2.0**-24, 0).astype(np.float32)
        a = (y / np.where(size > 0, size, 1)[:, None]).astype(np.float32)
        for i in range(0, len(y), AT_ONCE):
            few = a[i : i + AT_ONCE]
            top, s = np.empty((len(groups), len(few)), np.float32), np.empty((WIDE, len(few)), np.float32)
            for j, tile in enumerate(tiles):
                np.matmul(tile, few.T, out=s)
                if j == len(tiles) - 1:
                    s[missing] = -np.inf
                held = WIDE // GROUP
                np.maximum.reduce(s.reshape(GROUP, held, -1), axis=0, out=top[j * held : (j + 1) * held])
            top = np.ascontiguousarray(top.T)
            floor = np.nextafter(_kth(top, spare) - 2 * error[i : i + AT_ONCE], np.float32(-np.inf))
            r, g = np.nonzero(top >= floor[:, None])
            # Rows are taken together while their groups are few.
            low, ends = 0, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(few)))])
            while low < len(few):
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + AGAIN // (GROUP * d), "right")) - 1)
                rows, held = r[ends[low] : ends[high]], g[ends[low] : ends[high]]
                p, t = np.nonzero(np.matmul(groups[held], few[rows, :, None])[:, :, 0] >= floor[rows, None])
                rows, c = rows[p] + i, held[p] * GROUP + t
                rows, c, step, low = rows[c < n], c[c < n], max(1, AGAIN // d), high
                take(rows, c, np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", y[rows[q : q + step]], x[c[q : q + step]]) for q in range(0, len(c), step))]))
        return places, scores

    return found


def top_k(queries: DataFrame, corpus: DataFrame, k: int, cosine: bool = False, weight: float = 0.5, threshold: float = 0.85, others: bool = False, n: int | None = None, views: dict[str, list[int]] | None = None) -> DataFrame:
    """query_id, rank (from 0), id, score, margin: the k best of each query, ties to the smaller id.

    queries: query_id, vec and, at will, unlike (array of vectors): then a score loses `weight` times what its
    cosine to each of them exceeds `threshold`. corpus: id, vec. margin is the lead of the first over the second, 0
    elsewhere, taken on k + 1 rows before the cut. A query in the corpus finds itself too, unless `others`: then
    its own id is left out. n: the corpus' rows, if known. Null vectors, and those of another dimension than the
    query's, take no part. Rows are dealt into blocks, a block of each side meets in a task and gives k + 1 rows a
    query; up to ASKED queries the corpus is sent once. Both sides are counted first, so let them be tables.
    views: names and places of components; then each search is made on those components alone, without `unlike`, and
    column view has the name. Vectors travel once for all views.
    """
    negative = "unlike" in queries.columns
    n, m = _blocks(corpus.count() if n is None else n, queries.count())
    corpus, queries = corpus.filter(F.size("vec") > 0), queries.filter(F.size("vec") > 0)
    deal = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks))
    left = corpus.select(F.col("id").alias("id"), F.col("vec").alias("vec"), deal("id", n).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>")).alias("q"))
    asked = queries.select(F.col("query_id").alias("query_id"), F.col("vec").alias("vec"), *([F.col("unlike").alias("unlike")] if negative else []), deal("query_id", m).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")).alias("b"))
    kind = dict(corpus.dtypes)["id"], dict(queries.dtypes)["query_id"]

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        found, c = [], c.take(pc.sort_indices(c["id"]))
        # A cosine of what isn't finite is no number.
        fit = lambda t: np.flatnonzero(np.isfinite(t).all(axis=1)) if cosine else np.arange(len(t))
        sizes = [{*pc.unique(pc.list_value_length(t["vec"])).to_pylist()} for t in (c, q)]
        for d in sizes[0] & sizes[1]:
            part, few = _of_size(c, d), _of_size(q, d)
            for view, at in (views or {"": None}).items():
                xs = _matrix(part, d, at, cosine)
                ok = fit(xs)
                ids, xs = part["id"].take(pa.array(ok)), xs if len(ok) == len(xs) else xs[ok]
                known = pc.unique(ids) if others else None
                code = lambda t: pc.fill_null(pc.index_in(t.cast(known.type), known), -1).to_numpy().astype(np.int64)  # noqa: B023, E731
                seek = _against(xs, k + 1, code(ids) if others else None)
                # Queries go by parts, so of a block only the rows that came and those found are held as a whole.
                for i in range(0, len(few), PART):
                    some = few.slice(i, PART)
                    ys = _matrix(some, d, at, cosine)
                    ok = fit(ys)
                    asks, unlike = some["query_id"].take(pa.array(ok)), some["unlike"].take(pa.array(ok)).to_pylist() if negative else []

                    def less(rows: slice, block: np.ndarray) -> np.ndarray:
                        out, units = np.zeros((rows.stop - rows.start, len(block))), _unit(block)
                        for j, far in enumerate(unlike[rows]):  # noqa: B023
                            if far:
                                out[j] = weight * np.maximum(0, _unit(np.array(far, np.float64)) @ units.T - threshold).sum(axis=0)
                        return out

                    places, scores = seek(ys if len(ok) == len(ys) else ys[ok], code(asks) if others else None, less if any(unlike) else None)
                    r, j = np.nonzero(scores > -np.inf)
                    out = [asks.take(pa.array(r)), ids.take(pa.array(places[r, j])), pa.array(scores[r, j]), *([pa.array([view] * len(r), pa.string())] if views else [])]
                    found.append(pa.table(out, names=names))
        empty = pa.table([q["query_id"].slice(0, 0), c["id"].slice(0, 0), pa.array([], pa.float64()), *([pa.array([], pa.string())] if views else [])], names=names)
        return pa.concat_tables([empty, *found])

    key = ["query_id", *(["view"] if views else [])]
    names = ["query_id", "id", "score", *key[1:]]
    found = left.groupBy("b", "q").cogroup(asked.groupBy("b", "q")).applyInArrow(run, f"query_id {kind[1]}, id {kind[0]}, score double" + ", view string" * bool(views))
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") <= k)
    lead = F.col("score") - F.lead("score").over(order)
    return ranked.withColumn("margin", F.when(F.col("rank") == 0, F.coalesce(lead, F.lit(0.0))).otherwise(0.0)).filter(F.col("rank") < k)


def latest(versions: DataFrame) -> DataFrame:
    """The row of each id with the highest position."""
    order = Window.partitionBy("id").orderBy(F.desc("position"))
    return versions.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def active(versions: DataFrame, removed: DataFrame) -> DataFrame:
    """Latest rows without the removed ids; what a rebuild writes, positions closed up."""
    return latest(versions).join(removed.select("id"), "id", "left_anti")


def rebuilt(versions: DataFrame, removed: DataFrame) -> DataFrame:
    """Active rows with new positions, gapless in the old order. Counted in ranges, and ranges of ranges, so no task
    gets all rows, nor all ranges but those of ranges of a hundred million positions."""
    kept = active(versions, removed).withColumn("_p", F.expr("position div 10000"))
    before = kept.groupBy("_p").agg(F.count("*").alias("n")).withColumn("_q", F.expr("_p div 10000"))
    far = before.groupBy("_q").agg(F.sum("n").alias("m"))
    far = far.select("_q", (F.sum("m").over(Window.orderBy("_q")) - F.col("m")).alias("_far"))
    near = F.sum("n").over(Window.partitionBy("_q").orderBy("_p")) - F.col("n")
    before = before.withColumn("_near", near).join(far, "_q").select("_p", (F.col("_near") + F.col("_far")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("position")) - 1
    return kept.withColumn("_i", inside).join(before, "_p").withColumn("position", F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def tier(margin: Column, tau: Column) -> Column:
    return F.when(margin >= 5 * tau, "HIGH").when(margin >= tau, "MEDIUM").otherwise("LOW")
