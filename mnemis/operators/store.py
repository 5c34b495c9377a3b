"""Store listing, manifest and token blocks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a block.
BLOCK = 256


def store_stats(entries: DataFrame) -> DataFrame:
    """One row: totals, and counts by family as a map. entries: family, n_tokens; a null family is unknown."""
    by = entries.groupBy(F.coalesce("family", F.lit("unknown")).alias("family")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    one = F.sort_array(F.collect_list(F.struct("family", "n")))
    return by.agg(F.sum("n").alias("n_entries"), F.sum("t").alias("n_tokens"), F.map_from_entries(one).alias("by_family"))


def list_entries(entries: DataFrame, most: int, family: str | None = None, agent: str | None = None) -> DataFrame:
    """The newest entries; the filters go before the limit."""
    kept = entries if family is None else entries.filter(F.col("family") == family)
    kept = kept if agent is None else kept.filter(F.col("agent") == agent)
    return kept.orderBy(F.desc("created_at"), "cache_id").limit(most)


def needs_reindex(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources (path, hash) that the manifest doesn't have, or has with another hash."""
    known = manifest.select("path", F.col("hash").alias("_old"))
    return sources.join(known, "path", "left").filter(~F.col("hash").eqNullSafe(F.col("_old"))).drop("_old")


def register(manifest: DataFrame, changed: DataFrame) -> DataFrame:
    """The manifest with the changed sources in place of their old rows."""
    return manifest.join(changed.select("path"), "path", "left_anti").unionByName(changed)


def unregister(manifest: DataFrame, paths: DataFrame) -> DataFrame:
    """The manifest without the sources of paths (path)."""
    return manifest.join(paths.select("path"), "path", "left_anti")


def of_project(rows: DataFrame, project: str) -> DataFrame:
    """A project's rows; the filter goes before any limit or search."""
    return rows.filter(F.col("project") == project)


def save_manifest(manifest: DataFrame, path: str) -> None:
    """Written as a whole beside what is there; a reader sees the old rows or the new ones."""
    manifest.write.mode("overwrite").option("compression", "gzip").json(path)


def load_manifest(spark, path: str, schema: str) -> DataFrame:
    """Records of a saved manifest; one that isn't there yet is empty."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """One row: sources, chunks and projects. manifest: path, project, n_chunks."""
    projects = F.array_join(F.sort_array(F.collect_set("project")), ",")
    return manifest.agg(F.count("*").alias("n_sources"), F.sum("n_chunks").alias("n_chunks"), projects.alias("projects"))


def segments(cells: DataFrame) -> DataFrame:
    """stream, block, token_start, token_end, n_tokens: blocks of 256 tokens of each stream. cells: stream, cell from 0."""
    blocks = cells.withColumn("block", F.expr(f"cell div {BLOCK}")).groupBy("stream", "block").agg(F.count("*").alias("n_tokens"))
    start = F.col("block") * BLOCK
    return blocks.select("stream", "block", start.alias("token_start"), (start + F.col("n_tokens")).alias("token_end"), "n_tokens")


def extended(blocks: DataFrame, more: DataFrame) -> DataFrame:
    """Blocks after appending n tokens to each stream (stream, n): the last partial one is filled first."""
    now = blocks.groupBy("stream").agg(F.max("token_end").alias("had"))
    ends = now.join(more, "stream", "full_outer").select("stream", (F.coalesce("had", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("end")).filter("end > 0")
    each = ends.select("stream", "end", F.explode(F.expr(f"sequence(cast(0 as bigint), (end - 1) div {BLOCK})")).alias("block"))
    end = F.least(F.col("end"), (F.col("block") + 1) * BLOCK)
    return each.select("stream", "block", (F.col("block") * BLOCK).alias("token_start"), end.alias("token_end"), (end - F.col("block") * BLOCK).alias("n_tokens"))


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with cell: their place in their stream, from 0."""
    return rows.withColumn("cell", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))


def payload_blocks(cells: DataFrame) -> DataFrame:
    """stream, block, token_start, token_end, rows: blocks of up to 256 cells with their vectors in order. cells: stream, cell, vec.

    A block is a bounded group, so no row grows with its stream."""
    own = cells.withColumn("block", F.expr(f"cell div {BLOCK}"))
    rows = F.sort_array(F.collect_list(F.struct("cell", "vec"))).alias("rows")
    out = own.groupBy("stream", "block").agg(F.min("cell").alias("token_start"), (F.max("cell") + 1).alias("token_end"), rows)
    return out.select("stream", "block", "token_start", "token_end", F.transform("rows", lambda r: r["vec"]).alias("rows"))


def assembled(blocks: DataFrame) -> DataFrame:
    """The cells that payload blocks hold: stream, cell, vec."""
    each = blocks.select("stream", "token_start", F.posexplode("rows").alias("i", "vec"))
    return each.select("stream", (F.col("token_start") + F.col("i")).alias("cell"), "vec")
