"""Repeated passages, found by FM-indexes over shards of the corpus.

A window is `WINDOW` consecutive words. Equal windows share their smallest gram hash, the window's key, so
windows are dealt by key, and windows with an equal key that lie side by side travel as one segment.
Keys that occur once can't repeat and go no further. Of segments with equal words, the words are sent once and
the places of all. Each shard builds a compressed FM-index over its distinct segments (wavelet matrix of packed
bits, every fourth place of the suffix order kept) and streams them against it: backward search extends each
window to the left, word by word, which gives its matching statistic, the number of its last words that stand
elsewhere too. Windows whose statistic reaches the threshold are reported if the index has an earlier place.

Hashes only decide where windows go and which words are compared; words are compared before they are taken as one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mnemis.llm.common import parts, short_batches, table

WINDOW, GRAM = 20, 8
#: Segments of a key beyond which its windows are dealt one by one, by their own hash.
HOT = 2000
#: Words of documents after which a task merges the keys it holds; bytes of text that a bucket is meant to get.
FLUSH, BUCKET_BYTES = 1 << 20, 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words."""
    powers = _powers(size)
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        out += h[j : j + len(out)] * powers[j]
    return _mix(out)


def _slide(x: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """pick over each `size` neighbours, by doubling."""
    done = 1
    while done < size:
        step = min(done, size - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def window_keys(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Key of each window: its smallest gram hash."""
    return _slide(_rolling(h, gram), window - gram + 1, np.minimum)


def key_places(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The hash of each gram that is the smallest of a window. A segment that holds its gram twice gives it twice."""
    grams, width = _rolling(h, gram), window - gram + 1
    keys, edge = _slide(grams, width, np.minimum), np.zeros(width - 1, np.uint64)
    return grams[_slide(np.concatenate([edge, keys, edge]), width, np.maximum) == grams]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and count of each stretch of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(keys)]]))


#: Every so many places of a text are kept in its index; windows searched at once, places located at once.
KEPT, SEARCHED, LOCATED = 4, 1 << 17, 1 << 20


class _Bits:
    """Packed bits with the number of ones before each 64."""

    def __init__(self, bits: np.ndarray):
        packed, padded = np.packbits(bits.astype(np.uint8), bitorder="little"), np.zeros(8 * (len(bits) // 64 + 1), np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.uint32)

    def before(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.ones[word].astype(np.int64) + np.bitwise_count(below)

    def at(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes of text in order, by doubling; only what is still tied is sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    first = np.flatnonzero(np.diff(text[order], prepend=text[order[0]] - 1))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    rows, k = np.arange(n), 1
    while True:
        own = rank[order[rows]]
        tied = np.append(own[1:] == own[:-1], False) | np.insert(own[1:] == own[:-1], 0, False)
        rows = rows[tied]
        if not len(rows):
            return order
        at = order[rows]
        pair = rank[at] * (n + 1) + np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        by = np.argsort(pair, kind="stable")
        pair, order[rows] = pair[by], at[by]
        first = np.flatnonzero(np.diff(pair, prepend=pair[0] - 1))
        rank[at[by]] = np.repeat(rows[first], np.diff(np.append(first, len(rows))))
        k *= 2


class FMIndex:
    """FM-index over word numbers. The text ends with its only 0.

    The last column is a wavelet matrix: a level of packed bits for each bit of a number. Of the suffix order
    only places divisible by KEPT stay; others are found by walking back to one.
    """

    def __init__(self, text: np.ndarray):
        order = suffix_order(text)
        n = len(text)
        self.kept = _Bits(order % KEPT == 0)
        self.places = order[order % KEPT == 0].astype(np.uint32)
        current = text[order - 1].astype(np.int64)
        self.sigma = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.levels, self.zeros = [], []
        for level in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            bit = (current >> level) & 1
            self.levels.append(_Bits(bit))
            self.zeros.append(int(n - bit.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        symbols = np.arange(self.sigma)
        self.base = self._down(symbols, np.zeros(self.sigma, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        top = len(self.levels) - 1
        for j, bits in enumerate(self.levels):
            ones = bits.before(at)
            at = np.where((symbols >> (top - j)) & 1, self.zeros[j] + ones, at - ones)
        return at

    def back(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the patterns with `symbols` put before those of the ranges given."""
        both = self._down(np.concatenate([symbols, symbols]), np.concatenate([low, high])) - np.tile(self.base[symbols], 2)
        both += np.tile(self.first[symbols], 2)
        return both[: len(low)], both[len(low) :]

    def _before(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one word earlier."""
        at, symbols = rows, np.zeros(len(rows), np.int64)
        for j, bits in enumerate(self.levels):
            one, ones = bits.at(at), bits.before(at)
            symbols = 2 * symbols + one
            at = np.where(one, self.zeros[j] + ones, at - ones)
        return at - self.base[symbols] + self.first[symbols]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of rows of the suffix order."""
        out, open_, rows = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        for step in range(KEPT):
            there = self.kept.at(rows)
            out[open_[there]] = self.places[self.kept.before(rows[there])] + np.int64(step)
            open_, rows = open_[~there], rows[~there]
            if not len(open_):
                break
            rows = self._before(rows)
        return out


def matching_statistics(fm: FMIndex, text: np.ndarray, ends: np.ndarray, longest: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each end, how many words of text up to it, `longest` at most, the index has at `least` places or more, by
    backward search; and the range of rows of those that reach `longest`."""
    length, low, high = np.zeros(len(ends), np.int64), fm.first[text[ends]], fm.first[text[ends] + 1]
    from_, to, alive = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.arange(len(ends))
    for step in range(1, longest + 1):
        more = high - low >= least[alive]
        alive, low, high = alive[more], low[more], high[more]
        length[alive] = step
        if step == longest or not len(alive):
            break
        low, high = fm.back(text[ends[alive] - step], low, high)
    if len(alive):
        from_[alive], to[alive] = low, high
    return length, from_, to


def first_places(fm: FMIndex, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The first place in the text of each range of rows. Ranges are equal or apart."""
    found, which = np.unique(low, return_inverse=True)
    size = np.zeros(len(found), np.int64)
    size[which] = high - low
    begin, out, done = np.cumsum(size) - size, np.zeros(len(found), np.int64), 0
    while done < len(found):
        n = max(1, int(np.searchsorted(begin + size - begin[done], LOCATED, "right")) - done)
        part, start = size[done : done + n], begin[done : done + n] - begin[done]
        rows = np.repeat(found[done : done + n] - start, part) + np.arange(part.sum())
        out[done : done + n] = np.minimum.reduceat(fm.locate(rows), start)
        done += n
    return out[which]


#: A segment: its document, place in it, number of windows, hash of its words, and which of its row's texts it has.
_SEGMENT = np.dtype([("doc", "<i8"), ("minor", "<u8"), ("n", "<u4"), ("id", "<u8"), ("text", "<u4")])


def _order(doc: np.ndarray, minor: np.ndarray) -> np.ndarray:
    return np.lexsort((minor, doc))


def _numbered(texts: list[str | None], docs: list[int]) -> list[tuple[int, int, int]]:
    """(row, doc, number among the rows with this doc_id, in order of text): ties have an order."""
    out, last, k = [], None, 0
    for i in sorted(range(len(docs)), key=lambda i: (docs[i], texts[i] or "")):
        k = k + 1 if docs[i] == last else 0
        last = docs[i]
        out.append((i, docs[i], k))
    return out


def _send_keys(dealt: DataFrame, shards: int, window: int, gram: int) -> DataFrame:
    """shard, bucket and packed (key, count) of the segments of a bucket of documents, each key once.

    A key that is everywhere comes once from a bucket, however many documents hold it.
    """

    def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, which = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(which, np.concatenate(counts), len(key)).astype(np.int64)

    def run(t: pa.Table) -> pa.Table:
        keys, counts, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for text in t["text"].to_pylist():
            words = (text or "").encode().split()
            if len(words) < window:
                continue
            keys.append(key_places(word_hashes(words), window, gram))
            counts.append(np.ones(len(keys[-1]), np.int64))
            size += len(words)
            if size >= FLUSH:
                key, count = merged(keys, counts)
                keys, counts, size = [key], [count], 0
        key, count = merged(keys, counts)
        shard = (key % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        rows = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)])]
        return pa.table({
            "shard": pa.array([int(shard[r[0]]) for r in rows], pa.int32()), "bucket": pa.array([t["bucket"][0].as_py()] * len(rows), pa.int32()),
            "keys": pa.array([key[r].tobytes() for r in rows], pa.binary()), "counts": pa.array([count[r].tobytes() for r in rows], pa.binary()),
        })

    return dealt.groupBy("bucket").applyInArrow(run, "shard int, bucket int, keys binary, counts binary")


def _again(sent: DataFrame) -> DataFrame:
    """bucket and packed (key, hot) of its keys that occur more than once in the corpus."""

    def run(t: pa.Table) -> pa.Table:
        parts_of = [np.frombuffer(x, np.uint64) for x in t["keys"].to_pylist()]
        key, bucket = np.concatenate(parts_of), np.repeat(t["bucket"].to_numpy(), [len(x) for x in parts_of])
        count = np.concatenate([np.frombuffer(x, np.int64) for x in t["counts"].to_pylist()])
        order = np.argsort(key, kind="stable")
        key, bucket, count = key[order], bucket[order], count[order]
        starts, size = runs(key)
        total = np.repeat(np.add.reduceat(count, starts), size)
        many = total > 1
        key, bucket, hot = key[many], bucket[many], total[many] > HOT
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        rows = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)])]
        return pa.table({
            "bucket": pa.array([int(bucket[r[0]]) for r in rows], pa.int32()),
            "keys": pa.array([key[r].tobytes() for r in rows], pa.binary()), "hot": pa.array([hot[r].tobytes() for r in rows], pa.binary()),
        })

    return sent.groupBy("shard").applyInArrow(run, "bucket int, keys binary, hot binary")


def _bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of documents; `_bucket_column` is the same on columns."""
    bits = doc.view(np.uint64)
    return np.mod((bits ^ (bits >> np.uint64(7)) ^ (bits >> np.uint64(17))).view(np.int64), buckets)


def _bucket_column(buckets: int) -> Column:
    doc = F.col("doc_id")
    return F.pmod(doc.bitwiseXOR(F.shiftrightunsigned(doc, 7)).bitwiseXOR(F.shiftrightunsigned(doc, 17)), F.lit(buckets)).cast("int")


def _cut_segments(docs: DataFrame, again: DataFrame, shards: int, window: int, gram: int) -> DataFrame:
    """shard, packed segments, and the words of their distinct texts, one text after the other."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"shard": [], "segments": [], "words": []}
        if len(right) and len(left):
            known = np.concatenate([np.frombuffer(x, np.uint64) for x in right["keys"].to_pylist()])
            known_hot = np.concatenate([np.frombuffer(x, bool) for x in right["hot"].to_pylist()])
            order = np.argsort(known)
            known, known_hot = known[order], known_hot[order]
            texts, ids = left["text"].to_pylist(), left["doc_id"].to_pylist()
            segs, to, body = [], [], []
            for i, doc, k in _numbered(texts, ids):
                words = (texts[i] or "").encode().split()
                if len(words) < window:
                    continue
                h = word_hashes(words)
                keys = window_keys(h, window, gram)
                own = _rolling(h, window)
                starts, counts = runs(keys)
                where = np.minimum(np.searchsorted(known, keys[starts]), len(known) - 1)
                there = known[where] == keys[starts]
                starts, counts, hot = starts[there], counts[there], known_hot[where[there]]
                single = np.repeat(hot, np.where(hot, counts, 1))
                per = np.where(hot, counts, 1)
                offset = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                starts, counts = np.repeat(starts, per) + offset, np.where(single, 1, np.repeat(counts, per))
                seg = np.zeros(len(starts), _SEGMENT)
                seg["doc"], seg["minor"], seg["n"] = doc, (np.uint64(k) << np.uint64(40)) + starts.astype(np.uint64), counts
                total = np.concatenate([[np.uint64(0)], np.cumsum(own * _powers(len(own)))])
                seg["id"] = (total[starts + counts] - total[starts]) * _powers(len(own), _INVERSE)[starts]
                segs.append(seg)
                to.append(np.where(single, own[starts], keys[starts]) % np.uint64(shards))
                body += [b" ".join(words[s : s + c + window - 1]) for s, c in zip(starts.tolist(), counts.tolist())]
            if segs:
                seg, to = np.concatenate(segs), np.concatenate(to).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(order)]):
                    own, number = seg[order[a:b]], {}
                    own["text"] = [number.setdefault(body[i], len(number)) for i in order[a:b].tolist()]
                    out["shard"].append(int(to[order[a]]))
                    out["segments"].append(own.tobytes())
                    out["words"].append(zstandard.compress(b" ".join(number), 3))
        return pa.table({"shard": pa.array(out["shard"], pa.int32()), "segments": pa.array(out["segments"], pa.binary()), "words": pa.array(out["words"], pa.binary())})

    return docs.groupBy("bucket").cogroup(again.groupBy("bucket")).applyInArrow(run, "shard int, segments binary, words binary")


def _covered(seg: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Packed (doc, minor, windows), for each bucket of documents."""
    bucket = _bucket(seg["doc"].astype(np.int64), buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield int(bucket[order[a]]), seg[order[a:b]][["doc", "minor", "n"]].copy().astype(_SEGMENT_OUT).tobytes()


_SEGMENT_OUT = np.dtype([("doc", "<i8"), ("minor", "<u8"), ("n", "<u4")])


def _merged(words: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each text the first with the same hash and length, if their words are equal; else itself."""
    order = np.lexsort((size, ids))
    new = np.ones(len(order), bool)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (size[order[1:]] != size[order[:-1]])
    out = np.empty(len(order), np.int64)
    out[order] = order[new][np.cumsum(new) - 1]
    again = np.flatnonzero(out != np.arange(len(out)))
    if len(again):
        n = size[again]
        start = np.cumsum(n) - n
        inside = np.arange(n.sum()) - np.repeat(start, n)
        same = np.logical_and.reduceat(words[np.repeat(begin[again], n) + inside] == words[np.repeat(begin[out[again]], n) + inside], start)
        out[again[~same]] = again[~same]
    return out


def search_shard(seg: np.ndarray, words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The windows, as segments, that stand earlier too.

    seg: all segments of a shard, each naming its text; words: the texts as numbers, one after the other.
    """
    own = seg["text"].astype(np.int64)
    _, one = np.unique(own, return_index=True)
    size = seg["n"][one].astype(np.int64) + window - 1
    begin = np.cumsum(size) - size
    own = _merged(words, begin, size, seg["id"][one])[own]
    in_order = _order(seg["doc"], seg["minor"])
    texts, first, many = np.unique(own[in_order], return_index=True, return_counts=True)
    # Texts go by the place where they stand first, so an earlier place in the index is an earlier one in the corpus.
    lay = np.argsort(first)
    texts, first, many = texts[lay], in_order[first[lay]], many[lay]
    size, begin = size[texts], begin[texts]
    head = np.cumsum(size + 1) - size - 1
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    text = np.ones(int((size + 1).sum()), np.int64)  # a separator comes after each text
    text[np.repeat(head, size) + inside] = words[np.repeat(begin, size) + inside] + 2
    text[-1] = 0
    fm = FMIndex(text)
    n = size - window + 1
    opens = np.cumsum(n) - n
    inner = np.arange(n.sum()) - np.repeat(opens, n)
    starts, least = np.repeat(head, n) + inner, np.repeat(np.where(many > 1, 1, 2), n)
    found, low, high = np.zeros(len(starts), bool), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for i in range(0, len(starts), SEARCHED):
        part = slice(i, i + SEARCHED)
        length, low[part], high[part] = matching_statistics(fm, text, starts[part] + window - 1, window, least[part])
        found[part] = length >= window
    hit = np.flatnonzero(found)
    earlier = np.zeros(len(starts), bool)
    earlier[hit] = first_places(fm, low[hit], high[hit]) < starts[hit]
    # Where a text stands first, its windows that stand earlier, as runs; elsewhere, all that the index has.
    which = np.repeat(np.arange(len(texts)), n)
    opening = earlier & ~(np.concatenate([[False], earlier[:-1]]) & (inner > 0))
    at = np.flatnonzero(earlier)
    runs_of = np.flatnonzero(opening)
    out = np.zeros(len(runs_of), _SEGMENT)
    out["doc"], out["minor"] = seg["doc"][first[which[runs_of]]], seg["minor"][first[which[runs_of]]] + inner[runs_of].astype(np.uint64)
    out["n"] = np.diff(np.searchsorted(at, np.append(runs_of, len(starts))))
    whole = np.zeros(len(one), bool)
    whole[texts] = np.logical_and.reduceat(found, opens)
    later = whole[own]
    later[first] = False
    return np.concatenate([out, seg[later]])


def _search(segments: DataFrame, buckets: int, window: int) -> DataFrame:
    """bucket and packed covered windows, from the shards' indexes."""

    def run(t: pa.Table) -> pa.Table:
        segs, words, texts, number = [], [], 0, {}
        for packed, body in zip(t["segments"].to_pylist(), t["words"].to_pylist()):
            seg = np.frombuffer(packed, _SEGMENT).copy()
            seg["text"] += np.uint32(texts)
            texts = int(seg["text"].max()) + 1
            segs.append(seg)
            words += [number.setdefault(w, len(number)) for w in zstandard.decompress(body).split()]
        seg = search_shard(np.concatenate(segs), np.array(words, np.int64), window)
        rows = list(_covered(seg, buckets)) if len(seg) else []
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "covered": pa.array([c for _, c in rows], pa.binary())})

    return segments.groupBy("shard").applyInArrow(run, "bucket int, covered binary")


def covered_words(n: int, covered: list[tuple[int, int]], window: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which of n words a covered window holds, and the intervals that they make, end exclusive. covered: first window and count of windows."""
    gone = np.zeros(n + 1, np.int32)
    for start, count in covered:
        gone[start] += 1
        gone[min(start + count + window - 1, n)] -= 1
    held = np.cumsum(gone[:-1]) > 0
    edges = np.flatnonzero(np.diff(held, prepend=False, append=False)).tolist()
    return held, list(zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words of each text less those of windows that stand earlier; and
    intervals, the runs of words that are removed (from, to, end exclusive).

    docs: doc_id and text; other columns are left out, but for those that `carry` names, which come as the
    fields of a struct `row` beside the whole `text`. Earlier is a smaller doc_id or, in one text, an earlier
    start; rows with one doc_id go by text, and of repeated rows one stays whole. Windows are judged on the
    input. A null text has no words; a null doc_id comes first. Texts of fewer than `window` words stay whole.
    An empty table gives no rows. kept joins words by one space.

    Texts are dealt into buckets once, and the exchange is used three times. The number of buckets and shards
    grows with the bytes of the texts, so what a task holds doesn't.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = buckets = max(2 * parts(spark), -(-size // BUCKET_BYTES))
    least = -(1 << 63)
    row = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("doc_id"), "text", *row)
    short_batches(spark)
    dealt = docs.withColumn("bucket", _bucket_column(buckets))
    again = _again(_send_keys(dealt, shards, window, gram))
    covered = _search(_cut_segments(dealt, again, shards, window, gram), buckets, window)
    schema = T._parse_datatype_string("doc_id long, n_words long, n_removed long, kept string, intervals array<struct<start:int,end:int>>")
    arrow = list(to_arrow_schema(schema))
    if carry:
        schema = T.StructType([*schema, *(docs.schema[c] for c in ("text", "row"))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        gone = np.concatenate([np.zeros(0, _SEGMENT_OUT), *(np.frombuffer(x, _SEGMENT_OUT) for x in right["covered"].to_pylist())])
        gone = gone[_order(gone["doc"], gone["minor"])]
        own = np.stack([gone["doc"], (gone["minor"] >> np.uint64(40)).astype(np.int64)], 1)
        texts, ids, rows = left["text"].to_pylist(), left["doc_id"].to_pylist(), []
        cuts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)])) if len(own) else np.zeros(0, np.int64)
        spans = {tuple(own[a].tolist()): (a, b) for a, b in zip(cuts, [*cuts[1:], len(own)])}
        low, order = np.uint64((1 << 40) - 1), _numbered(texts, ids)
        for i, doc, k in order:
            words = (texts[i] or "").encode().split()
            kept, intervals = words, []
            if (doc, k) in spans:
                part = gone[slice(*spans[doc, k])]
                held, intervals = covered_words(len(words), list(zip((part["minor"] & low).tolist(), part["n"].tolist())), window)
                kept = [w for w, h in zip(words, held.tolist()) if not h]
            rows.append((None if doc == least else doc, len(words), len(words) - len(kept), b" ".join(kept).decode(), [{"start": a, "end": b} for a, b in intervals]))
        columns = list(zip(*rows)) or [[] for _ in arrow]
        out = {f.name: pa.array(c, f.type) for c, f in zip(columns, arrow)}
        if carry:
            at = pa.array([i for i, _, _ in order], pa.int64())
            out |= {n: left[n].take(at) for n in ("text", "row")}
        return pa.table(out)

    return dealt.groupBy("bucket").cogroup(covered.groupBy("bucket")).applyInArrow(run, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each row of documents. A null text has no words."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as text, each with its first place; words that a window with an earlier place covers go.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
m AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM g),
c AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM m, range(20) r(k) WHERE n > 1 GROUP BY doc_id),
k AS (SELECT d.doc_id, w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)) AS stay FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(stay) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(stay, lambda i: w[i]), ' ')) AS kept_sha256
FROM k"""
