"""Weighted rendezvous sharding, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemis.llm.common import table, unpacked, whole

#: Rows that one numbering task is meant to get; only the number of tasks depends on it.
ROWS_PER_RUN = 20_000


def _score(key: Column, shard: int, weight: float) -> Column:
    """Rendezvous score of a key on a shard: weight / -ln(u), u uniform in (0, 1) by the first 52 bits of the MD5 of both."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("long")
    return F.lit(float(weight)) / -F.log((bits + 0.5) / float(1 << 52))


def _best(scores: list[Column]) -> Column:
    at = [F.struct(score.alias("score"), F.lit(-s).alias("s")) for s, score in enumerate(scores)]
    return (-(F.greatest(*at) if len(at) > 1 else at[0])["s"]).cast("int")


def _checked(weights: Sequence[float]) -> Sequence[float]:
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("every shard needs a weight above 0")
    return weights


def _key(key: Column) -> Column:
    """A key as text; a null key is a key of its own."""
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, with the highest score. A null key is a key of its own.

    Raising the number of shards, with the old weights kept, moves a row only if the new shard
    scores highest, so rows go into the new shard alone and about its share of them moves.
    """
    return _best([_score(_key(key), s, w) for s, w in enumerate(_checked(weights))])


def shard(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """df with shard, slot (gapless from 0 in each shard) and grown_shard (under the weights `grown`; else null).

    Slots are counted in runs: rows of a shard are dealt by hash into runs small enough for a task,
    numbered inside by key, and moved by the counts of the runs before. So no task gets a whole shard. Equal rows
    by the thousand are dealt by their place in the input instead, over as many runs as they need.
    Rows with one key share a shard; ties are numbered by a hash of the row. Null keys share one shard. A text of
    any length is only hashed. Columns of df with the added names are replaced; others stay, whatever their names.
    An empty table gives no rows.
    """
    plain = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind]
    out = df.select(whole(df).alias("_row"), F.col(f"`{key}`").alias("_key"), F.xxhash64(*plain).alias("_mix"))
    scores = {f"_{s}": _score(_key(F.col("_key")), s, w) for s, w in enumerate(_checked(weights))}
    out = out.withColumns(scores).withColumn("shard", _best([F.col(c) for c in scores]))
    if grown:
        more = [F.col(f"_{s}") if s < len(weights) and weights[s] == w else _score(_key(F.col("_key")), s, w) for s, w in enumerate(_checked(grown))]
        out = out.withColumn("grown_shard", _best(more))
    else:
        out = out.withColumn("grown_shard", F.lit(None).cast("int"))
    runs = max(1, -(-df.count() // (ROWS_PER_RUN * len(weights))))
    hot = out.groupBy("_mix").agg(F.count("*").alias("_copies")).filter(F.col("_copies") > ROWS_PER_RUN)
    out = out.drop(*scores).withColumn("_place", F.monotonically_increasing_id()).join(hot, "_mix", "left")
    spread = F.pmod("_place", F.ceil(F.col("_copies") / ROWS_PER_RUN).cast("long"))
    run = F.when(F.col("_copies").isNull(), F.pmod("_mix", F.lit(runs))).otherwise(F.lit(runs) + F.pmod(F.xxhash64("_mix", spread), F.lit(1 << 40)))
    out = out.withColumn("_run", run).drop("_place", "_copies")
    sizes = out.groupBy("shard", "_run").agg(F.count("*").alias("_n"))
    before = F.expr("sum(_n) over (partition by shard order by _run rows between unbounded preceding and 1 preceding)")
    sizes = sizes.select("shard", "_run", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.expr("row_number() over (partition by shard, _run order by _key, _mix)") - 1
    numbered = out.withColumn("_at", inside.cast("long")).join(sizes, ["shard", "_run"]).withColumn("slot", F.col("_at") + F.col("_before"))
    return unpacked(numbered, "_row", ["shard", "slot", "grown_shard"])


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in 16 equal shards by doc_id, law `key`; grown_shard is the shard among 17. A null text has size 1."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law")
    )
    out = shard(docs, "doc_id", [1.0] * 16, [1.0] * 17)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: Slots follow doc_id where a shard is one run, up to ROWS_PER_RUN rows a shard. The CRC goes byte by byte over a table made by rule.
ORACLE = """
WITH s(n) AS (SELECT unnest(range(17))),
v AS (
  SELECT doc_id, n, 1.0 / -ln((CAST('0x' || substr(md5(coalesce('k' || doc_id, 'n') || ':' || n), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS score FROM documents, s),
b AS (SELECT doc_id, arg_max(n, score) FILTER (n < 16) AS shard, arg_max(n, score) AS grown_shard FROM v GROUP BY doc_id),
step AS (SELECT list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x, i FROM (SELECT unnest(range(256)) AS i)),
tab AS (SELECT list(x ORDER BY i) AS t FROM step),
hex AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, len(h) // 2 AS n, list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)) AS b FROM hex),
crc AS (SELECT doc_id, n + 1 AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, tab)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard
FROM crc JOIN b USING (doc_id)"""
