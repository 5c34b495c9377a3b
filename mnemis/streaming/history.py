"""The history views over a stream of log rows, for Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemis.operators.history import confusions, doc_stats
from mnemis.operators.retrieve import density


def running_stats(log: DataFrame) -> DataFrame:
    """Doc stats so far; for update or complete mode."""
    return doc_stats(log)


def running_confusions(log: DataFrame) -> DataFrame:
    return confusions(log)


def windows(log: DataFrame, length: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Records and wrong ones in tumbling windows, or sliding ones; a window closes when the watermark passes it."""
    by = log.withWatermark("ts", late).groupBy(F.window("ts", length, slide or length).alias("w"), "confidence")
    return by.agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("n_wrong")).select(F.col("w.start").alias("window_start"), "confidence", "n", "n_wrong")


def sessions(log: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each queried document: rows nearer than the gap."""
    by = log.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "query_doc_id")
    return by.agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct")).select("query_doc_id", F.col("s.start").alias("session_start"), "n", "n_correct")


def new_sources(files: DataFrame, late: str = "30 days") -> DataFrame:
    """Each (path, hash) once: what incremental indexing has to read. files: path, hash, ts."""
    return files.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "hash"])


def block_counter(rows: DataFrame, block: int = 256) -> DataFrame:
    """stream, n_tokens, n_blocks after each batch: tokens appended to a stream's last block, kept as state. rows: stream, n."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(int(b["n"].sum()) for b in batches)
        state.update((n,))
        yield pd.DataFrame({"stream": [key[0]], "n_tokens": [n], "n_blocks": [-(-n // block)]})

    return rows.groupBy("stream").applyInPandasWithState(run, "stream string, n_tokens long, n_blocks long", "n long", "update", "NoTimeout")


def density_on_insert(corpus: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], radius: float = 0.85) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of new vectors (id, vec): their neighbours in corpus() whose surroundings got dense go to the sink."""

    def run(batch: DataFrame, number: int) -> None:
        new = batch.select(F.col("id").alias("query_id"), "vec")
        sink(density(new, corpus().select("id", "vec"), radius), number)

    return run


def drained(view: DataFrame, folder: str, key: list[str] | None = None) -> DataFrame:
    """What a streaming aggregate holds after all input that is there now. In update mode a batch writes only the rows
    that it changed; of each key the last batch's row holds. Without a key, as for session windows, which Spark
    doesn't update, each batch writes all, and the last one holds."""
    spark = view.sparkSession
    write = lambda batch, number: batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number}")
    q = view.writeStream.outputMode("update" if key else "complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out/*")
    if not key:
        return rows.join(rows.agg(F.max("_batch").alias("_batch")), "_batch").drop("_batch")
    rest = [c for c in rows.columns if c not in (*key, "_batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*key, "r.*")


def appended(view: DataFrame, folder: str) -> DataFrame:
    """What a streaming view with a watermark has closed, and as batch rows: append mode, each row written once."""
    spark = view.sparkSession
    q = view.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    q.awaitTermination()
    return spark.read.schema(view.schema).parquet(f"{folder}/out")
