"""Sum-of-squares packing of tokenised documents into sequences of equal room."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemis.llm import bpe
from mnemis.llm.common import map_rows, short_batches, table, unpacked, whole

ROOM = 2048
#: Pieces that one packing task gets. Each leaves a few open sequences.
GROUP = 16_384


def place(lengths: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given.

    An item goes where the sum over gaps of the squared number of open bins with that gap becomes
    smallest; a new bin is one of the choices, and a full bin isn't open. Equal choices: the smallest
    gap. Among bins of one gap, the newest.
    """
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    count = np.zeros(room + 1, dtype=np.int64)
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        # A bin of gap g leaves g and comes to g - size: 1 - 2 * count[g], and 1 + 2 * count[g - size] unless it is full.
        change = 2 * (count[: room + 1 - size] - count[size:]) + 2
        change[0] = 1 - 2 * count[size]
        change[count[size:] == 0] = 1 << 40
        fresh = 0 if size == room else 1 + 2 * count[room - size]
        best = int(change.argmin())
        if change[best] <= fresh and count[best + size]:
            gap = best + size
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b, n = room, n, n + 1
        bins[i], offsets[i] = b, room - gap
        if gap - size:
            open_bins[gap - size].append(b)
            count[gap - size] += 1
    return bins, offsets


def orders(lengths: np.ndarray, room: int) -> list[np.ndarray]:
    """Orders to try, of lengths that fall: as they are; shuffled; and the large ones as they are, then the small ones shuffled."""
    mixed = np.random.default_rng(0).permutation(len(lengths))
    large = lengths > room // 7
    return [np.arange(len(lengths)), mixed, np.concatenate([np.flatnonzero(large), mixed[~large[mixed]]])]


def place_best(lengths: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """`place` in the order, of those tried, that opens the fewest bins."""
    best = None
    for order in orders(lengths, room):
        b, o = place(lengths[order], room)
        if best is None or b.max(initial=-1) < best[0].max(initial=-1):
            bins, offsets = np.empty_like(b), np.empty_like(o)
            bins[order], offsets[order] = b, o
            best = bins, offsets
    return best


def pieces(docs: DataFrame, room: int = ROOM, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids (packed): each text's ids and a closing id 0, cut only if over `room`.

    Of a document that is cut, the first piece takes what is left over, and the others are full.
    A null text is empty and gives one piece of length 1. Rows are judged alone, a null doc_id stays null, a text of
    any length is read in blocks, columns but doc_id and text are left out. An empty table gives no rows.
    """
    path, ranks = path or bpe.default_path(), ranks or bpe.default_path("byte_bpe_50k.tiktoken")

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        v = bpe.vocabulary(path, ranks)
        for doc, text in it:
            ids = bpe.encode(text or "", v) + b"\0\0\0\0"
            n = len(ids) // 4
            ends = [*range(n % room or room, n + 1, room)] if n > room else [n]
            start = 0
            for k, end in enumerate(ends):
                yield doc, k, start, end - start, ids[4 * start : 4 * end]
                start = end

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids binary")


def pack(rows: DataFrame, n_groups: int, room: int = ROOM) -> DataFrame:
    """rows with sequence_id and offset. rows: doc_id, piece and length, from 1 to `room`; other columns stay, whatever
    their names, but for those with the added names, which are replaced.

    Rows are dealt in turn, by their place in the input, into n_groups groups of equal size, so neither null nor
    repeated doc_ids gather. A group is packed alone, in the best of a few orders, all from longest first, ties by
    doc_id (null first) and piece. What is lost is a sequence or so for each group. An empty table gives no rows.
    """
    held = rows.select(whole(rows).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.col("piece").cast("long").alias("piece"), F.col("length").cast("long").alias("length"))
    held = held.withColumn("at", F.pmod(F.monotonically_increasing_id(), F.lit(max(1, n_groups))))
    least = -(1 << 63)

    def run(t: pa.Table) -> pa.Table:
        doc, piece, length = (t[c].fill_null(least).to_numpy() for c in ("doc", "piece", "length"))
        order = np.lexsort((piece, doc, -length))
        bins, offsets = place_best(length[order], room)
        first = t["at"][0].as_py() * (1 << 32)
        return pa.table({"row": t["row"].take(pa.array(order)), "sequence_id": pa.array(first + bins, pa.int64()), "offset": pa.array(offsets, pa.int64())})

    short_batches(rows.sparkSession)
    schema = T.StructType([held.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return unpacked(held.groupBy("at").applyInArrow(run, schema), "row", ["sequence_id", "offset"])


def groups_for(docs: DataFrame, rows: int = GROUP, room: int = ROOM) -> int:
    """How many groups of about `rows` pieces docs gives, at four bytes a token; at one byte a token they are four times as large."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return max(1, round((n + (size or 0) // (4 * room)) / rows))


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of documents, packed into sequences of 2048 ids. A null text is one piece of length 1."""
    docs = table(spark, sf_dir, "documents")

    def crc(it: Iterator[tuple]) -> Iterator[tuple]:
        for *head, ids in it:
            yield *head, zlib.crc32(ids)

    cut = map_rows(pieces(docs), crc, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return pack(cut, groups_for(docs))
