"""What the corpus operators share: reading tables, cutting lineage, mapping rows through Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mnemis.session import cut, importable

#: One word of a text: a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch on its way to Python. Texts can be long, so batches are short.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds of the rows on their way in, and lets local workers import this package."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, batch: int = 4096) -> DataFrame:
    """The rows that `rows` makes of each partition's rows, streamed; both sides are tuples in column order."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        held: list[tuple] = []
        size = 0
        for row in rows(each()):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if len(held) >= batch or size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    short_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(df: DataFrame, but: str = "") -> Column:
    """All columns of df, but for one perhaps, as one struct, so that whatever their names, none meets a column that is added."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c.lower() != but))


def unpacked(df: DataFrame, row: str, added: list[str]) -> DataFrame:
    """The fields of the struct `row`, then the added columns, which take the place of fields with their names."""
    names = {c.lower() for c in added}
    fields = [f.name for f in df.schema[row].dataType if f.name.lower() not in names]
    return df.select(*(F.col(row).getField(c).alias(c) for c in fields), *added)
