"""Sessions of retrieval: a snapshot of priors at the start, rows that are buffered, and a summary at the end."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemis.operators import history

LOG = "session_id string, query_doc_id string, result_doc_id string, confidence string, margin double, stages_used int, constraint_used boolean, correct boolean, ts timestamp, event_id long"


class Log:
    """The append-only log of retrievals in Parquet; what others keep as tables beside it are views over it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], LOG)

    def append(self, rows: DataFrame) -> None:
        have = {c.lower() for c in rows.columns}
        fields = self.spark.createDataFrame([], LOG).schema
        rows.select(*(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in fields)).write.mode("append").parquet(self.path)


class Session:
    """One session: `priors` as they were at its start, `record` to note a retrieval, `end` to append them all and sum up."""

    def __init__(self, log: Log, session_id: str):
        self.log, self.session_id, self.held = log, session_id, []

    def priors(self, docs: DataFrame) -> DataFrame:
        return history.priors(docs, self.log.rows())

    def record(self, **row) -> None:
        """A row of the log; ts must be given. Rows wait in memory for the end of their session."""
        if row.get("ts") is None:
            raise ValueError("a record needs its time")
        self.held.append({"session_id": self.session_id, "event_id": len(self.held)} | row)

    def end(self) -> DataFrame:
        """Appends the rows; one row: the session's summary and the confused pairs that no earlier session had."""
        names = [x.split()[0] for x in LOG.split(", ")]
        if self.held:
            self.log.append(self.log.spark.createDataFrame([tuple(r.get(n) for n in names) for r in self.held], LOG))
            self.held = []
        return report(self.log.rows()).filter(F.col("session_id") == self.session_id)


def report(log: DataFrame) -> DataFrame:
    """Each session's summary with how many confused pairs it was first to have, and a line to print."""
    first = history.new_pairs(log).groupBy("session_id").agg(F.count("*").alias("n_new_pairs"))
    out = history.session_summary(log).join(first, "session_id", "left").fillna(0, ["n_new_pairs"])
    return out.withColumn("line", F.format_string("%s: %d retrievals, %d high, %d medium, %d low, recall %.3f, %d new pairs", "session_id", "n_total", "n_high", "n_medium", "n_low", "recall", "n_new_pairs"))
