"""Quality scores: random-indexing word vectors pooled per document, and a small network on top."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemis.llm.common import cut, map_rows, table

#: Dimensions of a word vector, rows that contexts are summed in, forms of words, and neighbours on each side.
DIM, BUCKETS, FORMS, NEAR = 32, 8192, 8, 2
#: Labelled rows that the network is fitted on, at most: those with the smallest hash of doc_id. Vectors are of all texts.
TRAIN_ROWS, FOLDS = 4000, 3
#: Words remembered; words pooled at once; words whose neighbours are summed at once; texts scored at once.
MEMO, CHUNK, BATCH, SCORED = 200_000, 1 << 14, 1 << 16, 256


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """Of each word its own random vector of -1, 0 and 1, from the 64 bits of its hash; nothing is stored for it."""
    bits = np.unpackbits(np.ascontiguousarray(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    return bits[:, :DIM] - bits[:, DIM:]


#: Vectors of the forms of words: letters only or not, in capitals, with more than one sign around.
_FORMS = index_vectors(np.arange(1, FORMS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.float32)


class _Words(dict):
    """Row of each word met, with its hash, form and vector. The empty word, in row 0, has vector 0 and stands between texts."""

    def __init__(self, make: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.make, self.new = make, []
        self.clear()

    def clear(self) -> None:
        super().clear()
        self[""] = 0
        self.hash, self.vectors = np.zeros(1024, np.uint64), np.zeros((1024, *self.make(np.zeros(1, np.uint64), np.zeros(1, np.int64)).shape[1:]), np.float32)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    @staticmethod
    def form(word: str) -> int:
        core = word.strip(".,;:!?\"'()")
        return (not core.isalpha()) + 2 * (len(core) > 1 and core.isupper()) + 4 * (len(word) - len(core) > 1)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) > MEMO:
            self.clear()
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            n, first = len(self), len(self) - len(self.new)
            if n > len(self.hash):
                more = 2 * n - len(self.hash)
                self.hash, self.vectors = np.pad(self.hash, (0, more)), np.pad(self.vectors, ((0, more), (0, 0)))
            self.hash[first:n] = np.fromiter(map(xxhash.xxh64_intdigest, self.new), np.uint64, len(self.new))
            self.vectors[first:n] = self.make(self.hash[first:n], np.fromiter(map(self.form, self.new), np.int64, len(self.new)))
            self.new = []
        return out


def features(text: str, words_of: _Words) -> np.ndarray:
    """Mean word vector, mean product of neighbours (high where words repeat), and the log of the word count."""
    total, pairs, n, words = np.zeros(DIM), np.zeros(DIM), 0, text.split()
    for i in range(0, len(words), CHUNK):  # chunks overlap by one word
        rows = words_of.rows(words[i : i + CHUNK + 1])
        v = words_of.vectors[rows]
        own = v[:CHUNK]
        total += own.sum(axis=0)
        pairs += (v[:-1] * v[1:]).sum(axis=0)
        n += len(own)
    return np.concatenate([total / max(n, 1), pairs / max(n - 1, 1), [np.log1p(n) / 10]])


class Network:
    """One hidden layer; probabilities are of the logit over a temperature.

    The temperature is the one that fits logits of rows best which their network wasn't fitted on, in FOLDS folds
    (or as many as there are rows), however few rows there are. Of a single row there is no such logit, and it is 1.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 400):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.p, self.temperature = self._fitted(x, y, hidden, rounds), 1.0
        fold = np.arange(len(y)) % min(FOLDS, len(y))
        if len(y) > 1:
            z = np.empty(len(y))
            for k in range(fold.max() + 1):
                z[fold == k] = self._logit(x[fold == k], self._fitted(x[fold != k], y[fold != k], hidden, rounds))
            loss = lambda s: np.mean(np.logaddexp(0, z / s) - y * z / s)
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def _fitted(self, x: np.ndarray, y: np.ndarray, hidden: int, rounds: int) -> list[np.ndarray]:
        rng, a = np.random.default_rng(0), self._in(x)
        p = [rng.standard_normal((a.shape[1], hidden)) / np.sqrt(a.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
        m, v = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
        for t in range(1, rounds + 1):
            h = np.maximum(a @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y) / len(y)
            back = np.outer(d, p[2]) * (h > 0)
            for i, g in enumerate([a.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return p

    def _in(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logit(self, x: np.ndarray, p: list[np.ndarray]) -> np.ndarray:
        w1, b1, w2, b2 = p
        return np.maximum(self._in(x) @ w1 + b1, 0) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        """Rounded to twelve digits, beyond which sums depend on how many rows are scored at once."""
        return np.round(1 / (1 + np.exp(-np.clip(self._logit(x, self.p) / self.temperature, -30, 30))), 12)


def _neighbours(rows: np.ndarray, words: _Words, out: np.ndarray, sign: int = 1) -> None:
    """Adds to each word's row of out, by its hash, the index vectors of its neighbours. Row 0 parts texts."""
    v = words.vectors[rows]
    s = np.zeros_like(v)
    for k in range(1, NEAR + 1):
        s[k:] += v[:-k]
        s[:-k] += v[k:]
    at = np.where(rows == 0, BUCKETS, words.hash[rows] % np.uint64(BUCKETS)).astype(np.uint16)
    order = np.argsort(at, kind="stable")
    at = at[order].astype(np.int64)
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    out[at[starts]] += sign * np.add.reduceat(s[order], starts, axis=0).astype(np.int64)


def context(docs: DataFrame) -> np.ndarray:
    """Sum of the index vectors of the neighbours of each word, over all texts of docs, in BUCKETS rows by the word's hash, to unit length.

    A task sends a row for each bucket it met, at most BUCKETS; they are summed by bucket, so BUCKETS rows at most
    come to the driver however large docs is. Sums are whole numbers, so their order doesn't matter.
    """

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        out, words = np.zeros((BUCKETS + 1, DIM), np.int64), _Words(lambda h, _: index_vectors(h))
        held: list[str] = []
        for (text,) in it:
            own = (text or "").split()
            for i in range(0, len(own), BATCH):
                held += own[i : i + BATCH]
                if len(held) >= BATCH:
                    _neighbours(words.rows(held), words, out)
                    # The last words stay for those after them; what they met already is taken off again.
                    held = held[-NEAR:]
                    _neighbours(words.rows(held), words, out, -1)
            held += [""] * NEAR
        if held:
            _neighbours(words.rows(held), words, out)
        for b in np.flatnonzero(out[:BUCKETS].any(axis=1)).tolist():
            yield b, *out[b].tolist()

    names = [f"d{i}" for i in range(DIM)]
    sums = map_rows(docs.select("text"), run, "b int, " + ", ".join(f"{c} long" for c in names))
    total = np.zeros((BUCKETS, DIM))
    for b, *row in sums.groupBy("b").agg(*(F.sum(c) for c in names)).collect():
        total[b] = row
    return (total / (np.linalg.norm(total, axis=1, keepdims=True) + 1e-9)).astype(np.float32)


def vectors_of(contexts: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A word's vector: its own index vector, that of its form, and its row of contexts."""
    return lambda h, form: 2 * _FORMS[form] + index_vectors(h) + 2 * contexts[(h % np.uint64(BUCKETS)).astype(np.int64)]


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


class Model:
    """fit: docs (doc_id, text) and labels (doc_id, quality; null or repeated labels are left out or taken once, the larger)."""

    def __init__(self, contexts: np.ndarray, network: Network | None):
        self.contexts, self.network = contexts, network

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
        spark = docs.sparkSession
        known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
        chosen = spark.createDataFrame(few, "doc_id long, quality int")
        sample = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # `rows` rows at most
        contexts = context(docs)

        def run(it: Iterator[tuple]) -> Iterator[tuple]:
            words = _Words(vectors_of(contexts))
            for doc, text, quality in it:
                yield doc, quality, features(text or "", words).tobytes()

        data = sorted(map_rows(sample, run, "doc_id long, quality int, x binary").collect(), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[2]))
        if not data:
            return cls(contexts, None)
        x = np.stack([np.frombuffer(r["x"]) for r in data])
        return cls(contexts, Network(x, np.array([r["quality"] for r in data], float)))

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and score. docs: doc_id and text; other columns are left out. A null text is empty, and empty
        texts are scored too; a long text is pooled in chunks; repeated rows get equal scores. An empty table gives
        no rows. Without labels every score is 0.5."""
        shared = docs.sparkSession.sparkContext.broadcast((self.contexts, self.network))

        def run(it: Iterator[tuple]) -> Iterator[tuple]:
            contexts, network = shared.value
            words = _Words(vectors_of(contexts))
            while held := list(islice(((doc, features(text or "", words)) for doc, text in it), SCORED)):
                scores = np.full(len(held), 0.5) if network is None else network.score(np.stack([x for _, x in held]))
                yield from zip((doc for doc, _ in held), scores.tolist())

        return map_rows(docs.select("doc_id", "text"), run, "doc_id long, score double")


def op4_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of documents, learned from labels whose doc_id isn't held out. Nulls as in `Model.score`."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = Model.fit(docs, labels.filter(~held_out())).score(docs)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
