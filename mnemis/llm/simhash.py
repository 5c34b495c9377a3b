"""Near copies by SimHash: fingerprints that differ in few bits, found by chains of segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemis.llm.common import cut, map_rows, parts, short_batches, table, whole

BITS, RADIUS, SHINGLE = 64, 4, 4
#: Segments of the ring, from the low bits on. With 4 differing bits over 5 segments, a chain of l segments
#: from some start differs in at most l * 4 / 5 bits for every l.
WIDTHS = (13, 13, 13, 13, 12)
SHIFTS = (0, 13, 26, 39, 52)
#: Members of one start segment beyond which they are dealt by the next segment too; rows of a task; pairs at once.
HOT, TASK_ROWS, PAIRS = 20_000, 100_000, 1 << 20
#: Whole sets of shingles, some kilobytes each, of a task.
TASK_SETS = 4000
#: The pipeline's rule: sets of shingles of five words with intersection / union of at least 4 / 5.
STAGE_SHINGLE = 5
#: Of the rarest-first order of shingles: one text in SAMPLE is counted, of what is common there the first COMMON are held. They change the cost only, never what is found.
SAMPLE, COMMON = 16, 1 << 18
#: Bytes of listed shingles of a task, partners that a set is first tried with, and slots of the filter of wanted texts.
LISTED_BYTES, FIRST_TRIES, SLOTS = 16 << 20, 4, 1 << 20
#: Slots, a bit each, of the table that tells rows that are alone in their class.
MARKS = 1 << 24
#: Rounds in which each set is tried with its likeliest partner; sets of a group beyond which it is dealt in blocks.
ROUNDS, GROUP = 2, 4096
_ORDER = np.array([8 * (b // 8) + 7 - b % 8 for b in range(BITS)])


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's shingles in order. Letters A-Z are lowered; a text shorter than a shingle is one; without words: none."""
    words = text.encode().lower().split()
    n = len(words) - shingle + 1
    if not words:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts, h = [0, *ends[:-1]], xxhash.xxh64_intdigest
    spans = zip(starts, ends[shingle - 1 :]) if n > 0 else [(0, len(joined) + 1)]
    return np.fromiter((h(joined[a : b - 1], 42) for a, b in spans), np.uint64, max(n, 1))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint; without words: 0."""
    return _print(shingles(text, shingle))


def _print(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.uint32)
    value = sum(1 << b for b in np.flatnonzero(2 * ones[_ORDER] > len(hashes)).tolist())
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp of each row of docs."""

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc, text in it:
            yield doc, fingerprint(text or "", shingle)

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    return (fp >> np.uint64(SHIFTS[i])) & np.uint64((1 << WIDTHS[i]) - 1)


def _mask(i: int, length: int) -> int:
    return sum(((1 << WIDTHS[j % 5]) - 1) << SHIFTS[j % 5] for j in range(i, i + length))


def _linked(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which pairs link. Chains from `start` of 2 to 4 segments must keep their budgets before all bits are counted."""
    keep = np.arange(len(a))
    for length in (2, 3, 4):
        masks = np.array([_mask(i, length) for i in range(5)], np.uint64)
        near = np.bitwise_count((a[keep] ^ b[keep]) & masks[start[keep]]) <= length * RADIUS // 5
        keep = keep[near]
    return keep[np.bitwise_count(a[keep] ^ b[keep]) <= RADIUS]


class _Sets:
    """Union by smallest member over 0 to n-1."""

    def __init__(self, n: int):
        self.low = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.low[a], self.low[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.low, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(nearer := self.low[self.low], self.low):
                self.low = nearer


def _links(keys: np.ndarray, fps: np.ndarray, probe: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints of a task as (fp, the smallest linked to it), a forest.

    keys: start, its segment and the next segment. Rows with probe look for rows without, under their key;
    rows with spread look under the keys that differ in no or one bit of the next segment.
    """
    own = np.unique(fps)
    at = np.searchsorted(own, fps)
    sets = _Sets(len(own))
    index = np.flatnonzero(~probe)
    index = index[np.argsort(keys[index], kind="stable")]
    sorted_keys = keys[index]

    def look(rows: np.ndarray, change: int) -> None:
        wanted = keys[rows] ^ np.uint64(change)
        lo, hi = np.searchsorted(sorted_keys, wanted, "left"), np.searchsorted(sorted_keys, wanted, "right")
        counts = hi - lo
        rows, lo, counts = rows[counts > 0], lo[counts > 0], counts[counts > 0]
        done = 0
        while done < len(rows):
            total = np.cumsum(counts[done:])
            if total[0] > PAIRS:  # one row with many partners
                step = 1
            else:
                step = int(np.searchsorted(total, PAIRS, "right"))
            left = np.repeat(rows[done : done + step], counts[done : done + step])
            first = np.repeat(lo[done : done + step] - np.concatenate([[0], total[: step - 1]]), counts[done : done + step])
            right = index[first + np.arange(len(left))]
            new = (sets.low[at[left]] != sets.low[at[right]]) & ((keys[left] >> np.uint64(13)) == (keys[right] >> np.uint64(13)))
            left, right = left[new], right[new]
            hit = _linked(fps[left], fps[right], (keys[left] >> np.uint64(26)).astype(np.int64))
            sets.join(at[left[hit]], at[right[hit]])
            done += step

    look(index, 0)
    look(np.flatnonzero(probe), 0)
    for bit in range(13):
        look(index[spread[index]], 1 << bit)
    root = own[sets.low]
    apart = root != own
    return own[apart], root[apart]


def links(distinct: DataFrame) -> DataFrame:
    """Edges u, v between fingerprints with the same connected sets as all links. distinct: fp, each once."""
    spark = distinct.sparkSession
    bits = F.col("fp")
    seg = [F.shiftrightunsigned(bits, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(SHIFTS, WIDTHS)]
    chains = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), seg[i].alias("a"), seg[(i + 1) % 5].alias("b")) for i in range(5)]))
    rows = distinct.select("fp", chains.alias("c")).select("fp", (F.shiftleft("c.i", 13) + F.col("c.a")).alias("k"), F.col("c.b").alias("b"))
    hot = rows.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("k", F.lit(True).alias("hot"))
    rows = rows.join(hot, "k", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    one = F.when(F.col("hot"), F.array(*[F.lit(x) for x in (0, *(1 << j for j in range(13)))])).otherwise(F.array(F.lit(0)))
    probes = rows.select("fp", "k", "hot", "b", F.explode(one).alias("x"))
    dealt = probes.select(
        "fp", (F.shiftleft("k", 13) + F.col("b").bitwiseXOR(F.col("x").cast("long"))).alias("key"), (F.col("x") != 0).alias("probe"), (~F.col("hot")).alias("spread"),
        F.when(F.col("hot"), F.xxhash64("k", F.col("b").bitwiseXOR(F.col("x").cast("long")))).otherwise(F.xxhash64("k")).alias("at"),
    )
    tasks = max(1, 5 * distinct.count() // TASK_ROWS, parts(spark))

    def run(t: pa.Table) -> pa.Table:
        key, fp = t["key"].to_numpy().astype(np.uint64), t["fp"].to_numpy().view(np.uint64)
        u, v = _links(key, fp, t["probe"].to_numpy(), t["spread"].to_numpy())
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    short_batches(spark)
    return dealt.withColumn("at", F.pmod("at", F.lit(tasks))).groupBy("at").applyInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of the edges u, v the smallest node of its connected set.

    Alternates stars (large, then small) until nothing changes; each round is cut, so a lost executor costs one round.
    A round has as many partitions as its edges need, so few edges are few files.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    tell = lambda: tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
    seen, state = None, tell()
    while state != seen:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        now = cut(small.select("e.u", "e.v").filter("u <> v").distinct().coalesce(1 + state[0] // TASK_ROWS))
        seen, state = state, tell()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(prints: DataFrame) -> DataFrame:
    """prints (fp and other columns) with root: the smallest fingerprint that theirs reaches over links."""
    roots = components(links(prints.select("fp").distinct()))
    rest = [c for c in prints.columns if c != "fp"]
    return prints.join(roots, prints["fp"] == roots["node"], "left").select(*rest, "fp", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over fingerprints that link.

    docs: doc_id and text; other columns are left out. A null text is empty, and all texts without words
    share fingerprint 0. Equal texts and repeated rows share a fingerprint, so groups of copies of any size are
    one fingerprint before anything is paired. A null doc_id is never a component_id unless it is alone.
    An empty table gives no rows.
    """
    labelled = _rooted(cut(fingerprints(docs, shingle)))
    low = cut(labelled.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return labelled.join(low, "root").select("doc_id", "fp", "component_id")


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of texts repeats, sorted, and in how many of its texts they are."""

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for (text,) in it:
            yield from ((h,) for h in np.unique(shingles(text or "", STAGE_SHINGLE)).view(np.int64).tolist())

    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    counts = map_rows(some, run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, n = np.array([r["h"] for r in counts], np.int64).view(np.uint64), np.array([r["n"] for r in counts], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _listed(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rarest first: sets with intersection / union >= 4 / 5 share one of theirs."""
    n = np.zeros(len(s), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        n = np.where(common[at] == s, counts[at], 0)
    return s[np.argsort(n, kind="stable")][: len(s) - -(-4 * len(s) // 5) + 1]


def _parity(s: np.ndarray) -> np.ndarray:
    """How many shingles fall on each bit, odd or even: two sets differ in at least as many shingles as parities do in bits."""
    n = max(64, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits(np.bincount((s % np.uint64(n)).astype(np.int64), minlength=n) & 1, bitorder="little")


def _may_be_near(a: int, b: int, x: np.ndarray, y: np.ndarray) -> bool:
    """False only for sets of a and b shingles, of parities x and y, with intersection / union below 4 / 5."""
    if 5 * min(a, b) < 4 * max(a, b):
        return False
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return 9 * int(np.bitwise_count(x ^ y).sum()) <= a + b


def _sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, _copy, fp, node (hash of the set of shingles), size, parities and listed shingles of each row."""
    common, counts = _common(docs)

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc, text, copy in it:
            h = shingles(text or "", STAGE_SHINGLE)
            s = np.unique(h)
            node = xxhash.xxh64_intdigest(s.tobytes())
            yield doc, copy, _print(h) if len(h) else 0, node - (1 << 64) if node >> 63 else node, len(s), _parity(s).tobytes(), _listed(s, common, counts).tobytes()

    return map_rows(docs.select("doc_id", "text", "_copy"), run, "doc_id long, _copy long, fp long, node long, size long, bits binary, listed binary")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a and b, sorted."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _shared(sets: DataFrame) -> DataFrame:
    """key, node: groups of two sets or more that list a shingle in common. sets: node, listed.

    A key is the sum of its members' mixed numbers, so shingles that the same sets list, as those of one passage,
    are one group. Different groups of one key would be joined, which loses no pair. Shingles travel packed, in a
    row a task and batch.
    """
    spark = sets.sparkSession
    tasks = max(parts(spark), (sets.agg(F.sum(F.length("listed"))).first()[0] or 0) // LISTED_BYTES)

    def deal(it: Iterator[tuple]) -> Iterator[tuple]:
        def flush(held: list[tuple]) -> Iterator[tuple]:
            h = np.frombuffer(b"".join(x[1] for x in held), np.uint64)
            node = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1]) // 8 for x in held])
            at = (h % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            h, node, at = h[order], node[order], at[order]
            edges = np.flatnonzero(np.diff(at, prepend=-1, append=-1)).tolist()
            for a, b in zip(edges, edges[1:]):
                yield int(at[a]), h[a:b].tobytes(), node[a:b].tobytes()

        held, n = [], 0
        for row in it:
            held.append(row)
            n += len(row[1])
            if n > LISTED_BYTES:
                yield from flush(held)
                held, n = [], 0
        yield from flush(held)

    def run(t: pa.Table) -> pa.Table:
        h, node = (np.concatenate([np.frombuffer(x, k) for x in t[c].to_pylist()]) for c, k in (("h", np.uint64), ("node", np.uint64)))
        h, node = _distinct(h, node)
        starts = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint64(1)))
        many = np.diff(np.append(starts, len(h)))
        key = np.repeat(np.add.reduceat(_mix(node), starts), many) if len(h) else h
        key, node = _distinct(key[np.repeat(many, many) > 1], node[np.repeat(many, many) > 1])
        return pa.table({"key": key.view(np.int64), "node": node.view(np.int64)})

    dealt = map_rows(sets.select("node", "listed"), deal, "at long, h binary, node binary", batch=64)
    return dealt.groupBy("at").applyInArrow(run, "key long, node long")


def _linked_prints(prints: DataFrame) -> DataFrame:
    """Pairs u < v of sets whose fingerprints are equal or linked, as a forest."""
    node_of = cut(prints.groupBy("fp").agg(F.min("node").alias("first")))
    same = prints.select("fp", "node").distinct().join(node_of, "fp").select(F.col("first").alias("u"), F.col("node").alias("v"))
    edges = links(node_of.select("fp"))
    ends = [node_of.select(F.col("fp").alias(c), F.col("first").alias(n)) for c, n in (("u", "a"), ("v", "b"))]
    near = edges.join(ends[0], "u").join(ends[1], "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return _upward(same.unionByName(near))


def _upward(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _hub_pairs(shared: DataFrame) -> DataFrame:
    """Pairs u < v of a set and one that stands for a group it is in, for FIRST_TRIES groups of it at most.

    They only spare work: what they join need not be paired again.
    """
    hub = shared.groupBy("key").agg(F.min_by("node", F.xxhash64("key", "node")).alias("u"))
    order = Window.partitionBy("v").orderBy(F.xxhash64("key", "v"))
    some = shared.select("key", F.col("node").alias("v")).join(hub, "key").filter("u <> v").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= FIRST_TRIES)
    return _upward(some.select("u", "v"))


class _Parities:
    """Parities of sets by place, of one length each, and folded to half of it."""

    def __init__(self, bits: list[bytes]):
        self.long = np.array([len(b) for b in bits])
        self.at, self.full, self.half = np.zeros(len(bits), np.int64), {}, {}
        for n in np.unique(self.long).tolist():
            own = np.flatnonzero(self.long == n)
            self.at[own] = np.arange(len(own))
            x = np.frombuffer(b"".join(bits[i] for i in own.tolist()), np.uint8).reshape(len(own), n)
            self.full[n], self.half[n] = x, x[:, : n // 2] ^ x[:, n // 2 :]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many shingles the sets at x and y differ at least. A y's parity is as long as x's, or twice that."""
        out = np.zeros(len(x), np.int64)
        for n in np.unique(self.long[x]).tolist():
            for twice in (False, True):
                there = np.flatnonzero((self.long[x] == n) & (self.long[y] == (2 * n if twice else n)))
                other = self.half.get(2 * n) if twice else self.full[n]
                step = max(1, (8 << 20) // n)
                for i in range(0, len(there), step):
                    k = there[i : i + step]
                    out[k] = np.bitwise_count(self.full[n][self.at[x[k]]] ^ other[self.at[y[k]]]).sum(axis=1, dtype=np.int64)
        return out


def _pairs_of_groups(key: np.ndarray, part: np.ndarray, node: np.ndarray, size: np.ndarray, root: np.ndarray, bits: list[bytes], nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of nodes of one key that may be near by sizes and parities and have not one root.

    nearest: of each node, only the pair that differs least by its parities. part: the member's own block where a
    key is two blocks' meeting, then only members of both are paired; else -1.
    """
    order = np.lexsort((size, key))
    key, part, node, size, root = key[order], part[order], node[order], size[order], root[order]
    parity = _Parities([bits[i] for i in order.tolist()])
    group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
    wide = 5 * int(size.max(initial=0)) + 1
    top = np.searchsorted(group * wide + 4 * size, group * wide + 5 * size, "right")
    counts, out, done = top - np.arange(len(key)) - 1, [], 0
    while done < len(key):
        total = np.cumsum(counts[done:])
        step = max(1, int(np.searchsorted(total, PAIRS, "right")))
        n = counts[done : done + step]
        x = np.repeat(np.arange(done, done + step), n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + x + 1
        meet = (root[x] != root[y]) & ((part[x] < 0) | (part[x] != part[y]))
        x, y = x[meet], y[meet]
        apart = parity.apart(x, y)
        near = 9 * apart <= size[x] + size[y]
        x, y, apart = x[near], y[near], apart[near] / (size[x[near]] + size[y[near]])
        if nearest:
            x, y, apart = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([apart, apart])
            by = np.lexsort((node[y], apart, node[x]))
            by = by[np.diff(node[x[by]], prepend=~node[x[by[:1]]]) != 0]
            x, y, apart = x[by], y[by], apart[by]
        out.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]))
        done += step
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _distinct(*np.concatenate(out, axis=1))


def _open_pairs(shared: DataFrame, roots: DataFrame, reps: DataFrame, nearest: bool) -> DataFrame:
    """Pairs u < v of sets that are in one group, may be near by their sizes and parities and have not one root.

    nearest: of each set, in each task, only the pair that differs least by its parities. A group of over GROUP sets
    is dealt as meetings of its blocks, two and two, so no task gets it whole.
    """
    rooted = shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    blocks = sizes.select("key", F.ceil(F.col("n") / GROUP).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    meets = rooted.join(blocks, "key").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    met = meets.select(
        F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high)).alias("key"), F.when(low == high, F.lit(-1)).otherwise(F.col("own")).cast("long").alias("part"), "node", "root"
    ).join(reps.select("node", F.col("size").cast("long").alias("size"), "bits"), "node")

    def run(t: pa.Table) -> pa.Table:
        rows = [t[c].to_numpy() for c in ("key", "part", "node", "size", "root")]
        u, v = _pairs_of_groups(*rows, t["bits"].to_pylist(), nearest)
        return pa.table({"u": u, "v": v})

    tasks = max(parts(shared.sparkSession), 4 * shared.count() // TASK_ROWS)
    return met.withColumn("at", F.pmod(F.xxhash64("key"), F.lit(tasks))).groupBy("at").applyInArrow(run, "u long, v long").distinct()


def _sifted(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of the pairs u, v, those that sizes and parities don't rule out."""
    known = lambda n: reps.select(F.col("node").alias(n), F.struct("size", "bits").alias(f"{n}s"))

    def sift(it: Iterator[tuple]) -> Iterator[tuple]:
        for u, v, x, y in it:
            if _may_be_near(x["size"], y["size"], np.frombuffer(x["bits"], np.uint8), np.frombuffer(y["bits"], np.uint8)):
                yield u, v

    return map_rows(pairs.join(known("u"), "u").join(known("v"), "v").select("u", "v", "us", "vs"), sift, "u long, v long")


def _near(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs u, v, those whose sets have intersection / union >= 4 / 5, counted. reps: node, and id and copy of a row of docs."""
    pairs = cut(pairs)
    n = pairs.count()  # at most two sets a pair; few pairs are few files
    asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    rows = cut(reps.select("node", "id", "copy").join(asked, "node", "left_semi").coalesce(1 + n // TASK_ROWS))
    wanted = np.zeros(SLOTS, bool)
    wanted[[r[0] for r in rows.select(F.pmod("copy", F.lit(SLOTS))).distinct().collect()]] = True

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc, copy, text in it:
            if wanted[copy % SLOTS]:
                yield doc, copy, np.unique(shingles(text or "", STAGE_SHINGLE)).tobytes()

    texts = map_rows(docs.select("doc_id", "_copy", "text"), run, "doc_id long, _copy long, s binary")
    found = texts.join(rows, texts["doc_id"].eqNullSafe(rows["id"]) & (texts["_copy"] == rows["copy"])).select("node", "s")
    sets = cut(found.dropDuplicates(["node"]).coalesce(1 + n // TASK_SETS))

    def check(it: Iterator[tuple]) -> Iterator[tuple]:
        for u, v, a, b in it:
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            if 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)):
                yield u, v

    side = lambda n, s: sets.select(F.col("node").alias(n), F.col("s").alias(s))
    return cut(map_rows(pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b"), check, "u long, v long").coalesce(1 + n // TASK_SETS))


def _near_roots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, _copy, node of each row of docs, and node, root of the nodes that are near to another, over any number of steps.

    Candidates are what SimHash links and, as at four fifths fingerprints differ in more bits than it can index,
    all pairs that share a listed shingle; each is counted before it links. None with four fifths is missed.
    """
    prints = cut(_sets_of(docs))
    reps = prints.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_copy")).alias("r"), F.first("size").alias("size"), F.first("bits").alias("bits"))
    reps = cut(reps.select("node", "size", "bits", F.col("r.doc_id").alias("id"), F.col("r._copy").alias("copy")))
    shared = cut(_shared(prints))
    found = _near(_sifted(_linked_prints(prints).unionByName(_hub_pairs(shared)).distinct(), reps), reps, docs)
    roots = components(found)
    for last in (*[False] * ROUNDS, True):
        found = _near(_open_pairs(shared, roots, reps, nearest=not last), reps, docs)
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found))
    return prints.select("doc_id", "_copy", "node"), roots


def _marks(rows: DataFrame, n: int) -> tuple[int, DataFrame]:
    """How many slots, and word and bits of those that the _copy of a row falls on. rows: n, of classes of two rows or more.

    A row whose slot has no mark is alone in its class. Slots are at most MARKS, so the table has a bound; beyond it,
    more rows than need be are marked, which costs their exchange only."""
    slots = min(MARKS, max(1 << 12, 1 << (16 * n).bit_length()))
    words = rows.selectExpr(f"pmod(_copy, {slots}) div 64 as word", f"shiftleft(1L, cast(pmod(_copy, {slots}) % 64 as int)) as bit")
    return slots, words.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def heads(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their classes of near copies, whole, one for each class.

    Near are texts whose sets of five-word shingles have intersection / union of at least 4 / 5; a class holds
    what is near over any number of steps. The row is the one with the smallest doc_id, null last; of rows that
    share it, the one with the smallest hash of its text; of rows that share both, any one. docs: doc_id, text
    and any other columns, whatever their names. Texts without words (null, empty, white space) are one class. A
    class of null doc_ids alone has its row too. A text of any length is read whole. An empty table gives no rows.
    Rows that are alone in their class stay where they are; only those that may share one are exchanged, with their texts.
    """
    own = F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_copy")
    prints, roots = _near_roots(docs.select(*own, "text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_copy")).alias("h")
    rooted = prints.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    chosen = cut(rooted.groupBy("root").agg(first, F.count("*").alias("n")).select("root", "n", F.col("h.doc_id").alias("id"), F.col("h._copy").alias("copy")))
    shared = chosen.filter("n > 1")
    slots, words = _marks(rooted.join(shared.select("root"), "root", "left_semi"), shared.agg(F.sum("n")).first()[0] or 0)
    marked = docs.select(*own, whole(docs).alias("row")).join(F.broadcast(words), F.expr(f"pmod(_copy, {slots}) div 64") == F.col("word"), "left")
    there = F.expr(f"coalesce(shiftrightunsigned(bits, cast(pmod(_copy, {slots}) % 64 as int)) & 1L = 1L, false)")
    tested = marked.filter(there).dropDuplicates(["doc_id", "_copy"])
    tested = tested.join(chosen, tested["doc_id"].eqNullSafe(chosen["id"]) & (tested["_copy"] == chosen["copy"]), "left_semi")
    return marked.filter(~there).select("row.*").unionByName(tested.select("row.*"))


def op6_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each row of documents."""
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
