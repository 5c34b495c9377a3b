"""The store of state entries: a partitioned table, deletions beside it, and what retrieval does with both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemis.operators.search import top_k
from mnemis.operators.store import list_entries, store_stats

#: Folders of the table; an entry lies under its family, agent and day.
LAYOUT = ("family", "agent", "day")
SCHEMA = "cache_id string, task_description string, model_id string, created_at timestamp, n_tokens long, l2_norm double, vec array<double>, payload array<struct<kind:string,layer:int,head:int,cell:int,vec:array<float>>>, version long, family string, agent string, day string"
META = ("cache_id", "family", "agent", "day", "task_description", "model_id", "created_at", "n_tokens", "l2_norm")


@dataclass(frozen=True)
class Settings:
    """What a store and its searches go by; `of` reads mnemis.<name> from the session's configuration."""

    path: str = "store"
    top_k: int = 5
    min_similarity: float = 0.0
    block_tokens: int = 256
    compression: str = "q8_0"

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        known = {n: spark.conf.get(f"mnemis.{n}", None) for n in cls.__dataclass_fields__}
        return cls(**{n: type(getattr(cls, n))(v) for n, v in known.items() if v is not None})


class Store:
    """Entries in Parquet under `path`. Nothing is changed in place: an entry that is put again is a row with a higher
    version, a deletion is a row of another table, and `vacuum` writes what is left to a new folder. So readers never see
    half a change, and a task that is lost is run again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).option("basePath", f"{self.path}/entries").parquet(f"{self.path}/entries")
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def _deleted(self) -> DataFrame:
        try:
            return self.spark.read.schema("cache_id string, version long").parquet(f"{self.path}/deleted")
        except AnalysisException:
            return self.spark.createDataFrame([], "cache_id string, version long")

    def put(self, entries: DataFrame, version: int) -> None:
        """Adds entries, columns as in SCHEMA but for version; columns that are missing are null. The later version of an id holds."""
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], SCHEMA).schema}
        have = {c.lower() for c in entries.columns}
        full = entries.select(*(F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c != "version"))
        full = full.withColumn("family", F.coalesce("family", F.lit("unknown"))).withColumn("agent", F.coalesce("agent", F.lit("unknown"))).withColumn("day", F.coalesce("day", F.date_format("created_at", "yyyy-MM-dd"), F.lit("unknown")))
        full.withColumn("version", F.lit(version).cast("long")).write.mode("append").partitionBy(*LAYOUT).parquet(f"{self.path}/entries")

    def delete(self, ids: DataFrame, version: int) -> None:
        """Hides what is there of these ids (cache_id) up to this version."""
        ids.select(F.col("cache_id").cast("string"), F.lit(version).cast("long").alias("version")).distinct().write.mode("append").parquet(f"{self.path}/deleted")

    def entries(self) -> DataFrame:
        """The last row of each id that isn't deleted."""
        order = Window.partitionBy("cache_id").orderBy(F.desc("version"))
        last = self._rows().withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
        gone = self._deleted().groupBy("cache_id").agg(F.max("version").alias("_gone"))
        return last.join(gone, "cache_id", "left").filter("_gone is null or _gone < version").drop("_gone")

    def vacuum(self, path: str) -> Store:
        """A new store with the entries of this one and no more."""
        self.entries().write.mode("errorifexists").partitionBy(*LAYOUT).parquet(f"{path}/entries")
        return Store(self.spark, path)

    def metadata(self) -> DataFrame:
        """All but vectors and payload, which aren't read."""
        return self.entries().select(*META)

    def get(self, ids: DataFrame, payload: bool = True) -> DataFrame:
        """The entries of ids (cache_id); ids that aren't there give no row."""
        rows = self.entries() if payload else self.metadata()
        return rows.join(ids.select("cache_id").distinct(), "cache_id", "left_semi")

    def exists(self, ids: DataFrame) -> DataFrame:
        """cache_id and there, for each of ids."""
        known = self.entries().select("cache_id", F.lit(True).alias("there"))
        return ids.select("cache_id").distinct().join(known, "cache_id", "left").select("cache_id", F.coalesce("there", F.lit(False)).alias("there"))

    def list(self, most: int, family: str | None = None, agent: str | None = None) -> DataFrame:
        return list_entries(self.metadata(), most, family, agent)

    def stats(self) -> DataFrame:
        return store_stats(self.metadata())

    def health(self) -> DataFrame:
        """One row: how many entries, rows that are superseded, and deletions."""
        rows, gone = self._rows().agg(F.count("*").alias("n_rows"), F.count_distinct("cache_id").alias("n_ids")), self._deleted().agg(F.count("*").alias("n_deletions"))
        return rows.join(gone, F.lit(True)).join(self.entries().agg(F.count("*").alias("n_entries")), F.lit(True))

    def retrieve(self, queries: DataFrame, k: int = 5, payload: bool = False, where: Column | None = None, least: float = 0.0) -> DataFrame:
        """query_id, rank, score and the entry of each query's nearest, by inner product. queries: query_id, vec.

        The filter goes before the search, so k rows come back if there are that many. Payload is read for hits only."""
        known = self.entries() if where is None else self.entries().filter(where)
        hits = top_k(queries, known.select(F.col("cache_id").alias("id"), "vec"), k).filter(F.col("score") >= least)
        rows = self.entries() if payload else self.metadata()
        return hits.select("query_id", "rank", "score", F.col("id").alias("cache_id")).join(rows, "cache_id")


def coded(cells: DataFrame, method: str) -> DataFrame:
    """doc, kind, layer, head, cell, base, scale, codes of cells (doc, kind, layer, head, cell, vec), as a container keeps them.

    int8: codes and a half-precision scale a cell. layer_delta: the first layer in half precision, then int8 differences to
    the layer before. Others: what the method gives back, in half precision. An unknown method is an error."""
    from mnemis.functions import quant
    from mnemis.functions import vector as vx

    none = F.lit(None)
    head = ["doc", "kind", "layer", "head", "cell"]
    if method == "int8":
        s = quant.scale_int8(F.col("vec"))
        return cells.select(*head, none.cast("array<double>").alias("base"), quant.half(s).alias("scale"), quant.codes(F.col("vec"), s).alias("codes"))
    if method == "layer_delta":
        before = F.lag("vec").over(Window.partitionBy("doc", "kind", "head", "cell").orderBy("layer"))
        d = F.zip_with(vx.doubles(F.col("vec")), vx.doubles(F.col("_before")), lambda a, b: a - b)
        rows = cells.withColumn("_before", before).withColumn("_d", F.when(F.col("_before").isNotNull(), d)).withColumn("_s", quant.scale_int8(F.col("_d")))
        first = F.col("_d").isNull()
        return rows.select(*head, F.when(first, quant.halves(F.col("vec"))).alias("base"), F.when(~first, quant.half(F.col("_s"))).alias("scale"), F.when(~first, quant.codes(F.col("_d"), F.col("_s"))).alias("codes"))
    back = quant.halves(quant.round_trip(F.col("vec"), method))
    return cells.select(*head, back.alias("base"), none.cast("double").alias("scale"), none.cast("array<int>").alias("codes"))


def decoded(rows: DataFrame) -> DataFrame:
    """doc, kind, layer, head, cell, vec of what `coded` made, by any method: sums over layers where differences are kept."""
    step = F.coalesce("base", F.transform(F.col("codes"), lambda c: c * F.col("scale")))
    so_far = Window.partitionBy("doc", "kind", "head", "cell").orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)
    steps = rows.withColumn("_own", step).withColumn("_chain", F.max(F.col("base").isNotNull()).over(so_far))
    # Differences follow a base; int8 rows stand alone.
    parts = F.when(F.col("_chain") & F.col("codes").isNotNull(), F.collect_list("_own").over(so_far)).otherwise(F.array("_own"))
    added = F.aggregate(parts, F.transform("_own", lambda x: F.lit(0.0)), lambda a, p: F.zip_with(a, p, lambda x, y: x + y))
    return steps.select("doc", "kind", "layer", "head", "cell", added.alias("vec"))
