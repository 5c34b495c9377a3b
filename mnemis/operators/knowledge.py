"""The knowledge index: markdown files, chunked, embedded and kept as certificates with sidecar columns; searched by text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemis.functions import embed
from mnemis.functions import text as tx
from mnemis.functions import vector as vx
from mnemis.functions.chunker import chunk_rows
from mnemis.operators.search import top_k
from mnemis.operators.store import needs_reindex, register

#: Folders and files that are not knowledge.
SKIP_FOLDERS = ("node_modules", ".venv", "__pycache__", ".git", ".eng", "site-packages")
SKIP_FILES = ("LICENSE.md", "CHANGELOG.md", "SECURITY.md")
SIDECAR = "cache_id string, task_description string, source_path string, project string, fp_source string, chunk_index int, chunk_total int, char_start long, char_end long, headers array<string>, type string"


def markdown_files(listing: DataFrame) -> DataFrame:
    """Of a listing of files (path, length), those that are indexed: *.md, not empty, in no skipped folder, of no skipped name."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return listing.filter(name.endswith(".md") & ~name.isin(*SKIP_FILES) & (F.col("length") > 0) & ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, SKIP_FOLDERS))))


def listed(spark: SparkSession, patterns: list[str], suffix: str = "*") -> DataFrame:
    """path and length of the files that any of the patterns names, each once, in order; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(patterns)
    return files.select("path", "length").distinct().orderBy("path")


def read_markdown(spark: SparkSession, folder: str, project: str) -> DataFrame:
    """path, project, content, file_size of the markdown files under a folder; broken UTF-8 becomes U+FFFD."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder)
    return markdown_files(files).select("path", F.lit(project).alias("project"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("length").alias("file_size"))


def index_sources(sources: DataFrame, manifest: DataFrame, date: str, embedder: str = "hash", force: bool = False, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Chunks of what is new or changed, and the manifest after it.

    sources: path, project, content, file_size; manifest: path, hash, project, file_size, n_chunks. Files whose hash the
    manifest has are skipped unless forced. A chunk has its certificate's name, id, text, vector and sidecar columns; the
    chunks of a file replace those it had before. A blank file has none and is in the manifest with none.
    """
    named = sources.withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    changed = named if force else needs_reindex(named, manifest)
    parts = chunk_rows(changed.select(F.col("path").alias("source"), "content"), most)
    rows = parts.join(changed.select(F.col("path").alias("source"), "project"), "source")
    slug = tx.slug(F.col("source"))
    prefix = F.concat(F.lit("Source: "), F.regexp_replace("source", r"^.*/", ""), F.lit(" | Project: "), F.col("project"))
    text = tx.context(prefix, F.col("headers"), F.col("raw_text"))
    number = F.when(F.col("chunk_total") > 1, F.concat(F.lit("_c"), F.lpad((F.col("chunk_index") + 1).cast("string"), 3, "0"))).otherwise("")
    chunks = rows.select(
        F.col("source").alias("source_path"), "project", F.concat("project", F.lit("/"), slug, number).alias("cache_id"), tx.file_name(slug, F.lit(date), F.col("chunk_index"), F.col("chunk_total")).alias("file_name"),
        text.alias("text"), "chunk_index", "chunk_total", "char_start", "char_end", "headers", F.lit(embedder).alias("fp_source"),
    )
    chunks = chunks.withColumn("vec", embed.embed(F.col("text"), embedder)).withColumn("task_description", F.substring("text", 1, 500))
    counts = parts.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("n_chunks"))
    now = changed.select("path", "hash", "project", "file_size").join(counts, "path", "left").fillna(0, ["n_chunks"])
    return chunks, register(manifest, now.select(*manifest.columns))


def with_sidecars(certificates: DataFrame, sidecars: DataFrame, longer: bool = False) -> DataFrame:
    """Certificates (path, cache_id, task_description, ...) that could be read, with the sidecar beside each (path of the
    certificate, and SIDECAR's columns), if there is one. A sidecar's description goes first if it says anything; with
    `longer`, as sessions have it, the longer of the two."""
    good = certificates.filter("corrupt is null").drop("corrupt")
    side = sidecars.select("path", F.col("task_description").alias("_text"), "source_path", "project", "fp_source", "chunk_index", "chunk_total", "headers")
    both = good.join(side, "path", "left")
    own, other = F.coalesce("task_description", F.lit("")), F.coalesce("_text", F.lit(""))
    said: Column = F.when(F.length(other) > F.length(own), other).otherwise(own) if longer else F.when(other != "", other).otherwise(own)
    rest = {"source_path": "", "project": "", "fp_source": "unknown", "chunk_index": 0, "chunk_total": 1}
    return both.withColumn("task_description", said).drop("_text").fillna(rest).withColumn("headers", F.coalesce("headers", F.array().cast("array<string>")))


def build_index(rows: DataFrame, fingerprint: str | None = None) -> DataFrame:
    """id, vec to unit length, and the other columns, of certificates that have an id and a vector.

    fingerprint: perdoc, fcdb or fourier, then just that vector; else the second fourier vector where there is one, or the
    first. Another name is an error."""
    if fingerprint not in (None, "perdoc", "fcdb", "fourier"):
        raise ValueError(f"unknown fingerprint {fingerprint}")
    vec = F.coalesce("vec_fourier_v2", "vec_fourier") if fingerprint is None else F.col(f"vec_{fingerprint}")
    rest = [c for c in rows.columns if not c.startswith("vec_") and c not in ("cache_id", "joint_center")]
    return rows.select(F.col("cache_id").alias("id"), vx.unit(vec).alias("vec"), *rest).filter("id is not null and id <> '' and size(vec) > 0")


def save_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def vectors_of(index: DataFrame, ids: DataFrame) -> DataFrame:
    """id and vec of each of ids (id); null where the index has none."""
    return ids.select("id").distinct().join(index.select("id", "vec"), "id", "left")


def search_text(index: DataFrame, queries: DataFrame, k: int = 5, embedder: str = "hash", project: str | None = None) -> DataFrame:
    """query_id, rank, id, score, margin of texts (query_id, text), embedded as the index was. The project's filter goes before the search."""
    known = index if project is None else index.filter(F.col("project") == project)
    asked = queries.select("query_id", embed.embed(F.col("text"), embedder).alias("vec"))
    return top_k(asked, known.select("id", "vec"), k, cosine=True)
