"""Nearest neighbours by cosine: rotated binary codes in multi-index hashing, floats reranked."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemis.llm.common import map_rows, parts, short_batches, table

#: Rows that the rotation is learned from; rows of an index block, at least and at most; queries of a query block.
SAMPLE, LEAST_ROWS, INDEX_ROWS, QUERY_ROWS = 4096, 4096, 65_536, 16_384
#: Bits of a code and of a substring; rows of the sample that are asked for their neighbours in it, and the share of those that the radius must hold.
BITS, SUB, ASKED, HELD = 64, 16, 256, 0.97


def learn_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = 30) -> np.ndarray:
    """Iterative quantisation: principal axes, then the rotation that brings rows nearest to their own signs.

    Rows are first brought to unit length. With fewer dimensions than bits, further random rotations follow.
    """
    rng = np.random.default_rng(0)
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    d, out = x.shape[1], []
    for _ in range(-(-bits // d)):
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        y = x @ axes
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
            turn = (u @ v).T
        out.append(axes @ turn)
    return np.concatenate(out, axis=1)[:, :bits]


def codes_of(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return np.packbits((x @ rotation) >= 0, axis=1, bitorder="little").view(np.uint64).ravel()


def learn_radius(sample: np.ndarray, rotation: np.ndarray, k: int) -> int:
    """The Hamming radius that holds HELD of the k nearest rows, within the sample. More rows lie nearer, so of a
    larger table it holds no less."""
    if len(sample) < 2:
        return BITS
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    asked, codes = x[:ASKED], codes_of(x, rotation)
    scores = asked @ x.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -2
    near = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    return int(np.quantile(np.bitwise_count(codes[near] ^ codes[: len(asked), None]), HELD, method="higher"))


@lru_cache(maxsize=1)
def _masks() -> tuple[np.ndarray, np.ndarray]:
    """All substring differences by number of bits, and how many have at most so many bits."""
    every = np.arange(1 << SUB)
    bits = np.bitwise_count(every.astype(np.uint32))
    return every[np.argsort(bits, kind="stable")], np.cumsum(np.bincount(bits))


class MultiIndex:
    """Rows by each substring of their codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for j in range(BITS // SUB):
            sub = ((codes >> np.uint64(SUB * j)) & np.uint64((1 << SUB) - 1)).astype(np.int64)
            order = np.argsort(sub, kind="stable")
            self.tables.append((order, np.concatenate([[0], np.cumsum(np.bincount(sub, minlength=1 << SUB))])))

    def probed(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows that share a probed bucket with the code, all within the radius among them. Of radius = m * q + r, r + 1 of the m substrings are probed to q bits, the rest to q - 1:
        a code further off in each of them is further off than the radius."""
        masks, upto = _masks()
        m = BITS // SUB
        q, r = divmod(radius, m)
        seen = np.zeros(len(self.codes), bool)
        for j, (order, begin) in enumerate(self.tables):
            reach = q if j <= r else q - 1
            if reach < 0:
                continue
            sub = int((code >> np.uint64(SUB * j)) & np.uint64((1 << SUB) - 1))
            probes = masks[: upto[min(reach, SUB)]] ^ sub
            a, n = begin[probes], begin[probes + 1] - begin[probes]
            a, n = a[n > 0], n[n > 0]
            seen[order[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        return np.flatnonzero(seen)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """All rows with codes within the radius."""
        rows = self.probed(code, radius)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def _unique(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct vector, and which of these each row is."""
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, first, which = np.unique(raw, return_index=True, return_inverse=True)
    return first, which


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, rotation: np.ndarray, k: int, radius: int) -> list[tuple[int, int, float]]:
    """(query, row, cosine): each query's k nearest rows of a block but itself, ties to the smaller id.

    Equal vectors are one entry with their k + 1 smallest ids, as no others can be among k. Where a radius
    gives fewer than k rows it is widened, up to all rows.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    first, which = _unique(vectors)
    by = np.argsort(which, kind="stable")
    ends = np.cumsum(np.bincount(which))
    members = [ids[by[a : min(b, a + k + 1)]] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())]
    base = vectors[first].astype(np.float64)
    norms = np.sqrt((base * base).sum(axis=1))
    index = MultiIndex(codes_of(base, rotation))
    q_first, q_which = _unique(queries)
    out: list[tuple[int, int, float]] = []
    asking: list[list[int]] = [[] for _ in q_first]
    for q, u in zip(query_ids.tolist(), q_which.tolist()):
        asking[u].append(q)
    for u, q in enumerate(queries[q_first].astype(np.float64)):
        code = codes_of(q[None], rotation)[0]
        reach = radius
        while True:
            rows = index.within(code, reach)
            if reach >= BITS or sum(len(members[r]) for r in rows[: 2 * k + 2].tolist()) > k:
                break
            reach = min(BITS, reach + 8)
        scores = (base[rows] * q).sum(axis=1) / (norms[rows] * np.sqrt((q * q).sum()))
        if len(rows) > 4 * (k + 1):  # all ties of the last one stay
            least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            rows, scores = rows[scores >= least], scores[scores >= least]
        near = sorted((-s, i) for r, s in zip(rows.tolist(), scores.tolist()) for i in members[r].tolist())
        for asker in asking[u]:
            out += [(asker, i, -s) for s, i in [x for x in near if x[1] != asker][:k]]
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, radius: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of each query, a row's own id left out.

    rows, queries: vec_id and embedding; other columns are left out. Null, empty or zero vectors, and those with
    null or non-finite components, take no part, nor rows without vec_id; the dimension is that of most rows,
    and vectors of another take no part. Repeated rows count once for each query. The rotation, and the radius
    if none is given, are learned from `sample` rows at most, those with the smallest hash of vec_id; every row is indexed. Rows are dealt into index
    blocks and queries into query blocks, a block of each meet in a task, and the blocks' best are merged. Up to
    QUERY_ROWS queries a row is sent once. Candidates never leave their task, only k rows a query do. Extra columns
    and their names don't matter. Empty tables give no rows.
    """
    spark = rows.sparkSession
    whole = "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    form = "<f8" if dict(rows.dtypes)["embedding"] == "array<double>" else "<f4"
    clean = [df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if form == "<f8" else "array<float>").alias("embedding")).filter(whole) for df in (rows, queries)]
    sizes = clean[0].groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d, n = sizes[0]["d"], sizes[0]["n"]
    at, ask = (df.filter(F.size("embedding") == d) for df in clean)
    few = at.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    some = np.array([r["embedding"] for r in few], np.float64)
    rotation = learn_rotation(some)
    radius = learn_radius(some, rotation, k) if radius is None else radius
    n_at, n_ask = max(1, -(-n // INDEX_ROWS), min(parts(spark), n // LEAST_ROWS)), max(1, -(-ask.count() // QUERY_ROWS))

    def pack(it: Iterator[tuple]) -> Iterator[tuple]:
        for i, v in it:
            yield i, np.array(v, form).tobytes()

    at, ask = (map_rows(df, pack, "vec_id long, v binary") for df in (at, ask))
    mine = lambda blocks, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(blocks))
    at = at.withColumn("b", mine(n_at, 1)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_ask - 1)).cast("array<long>")))
    ask = ask.withColumn("q", mine(n_ask, 2)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_at - 1)).cast("array<long>")))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            left, right = left.drop_duplicates(["vec_id", "v"]), right.drop_duplicates(["vec_id", "v"])
            x, y = (np.frombuffer(b"".join(p["v"]), form).reshape(len(p), d) for p in (left, right))
            found = search_block(left["vec_id"].to_numpy(), x, right["vec_id"].to_numpy(), y, rotation, k, radius)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    short_batches(spark)
    best = at.groupBy("b", "q").cogroup(ask.groupBy("b", "q")).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of embeddings for each row whose vec_id is divisible by 50. Nulls as in `nearest`."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter("vec_id % 50 = 0"))
