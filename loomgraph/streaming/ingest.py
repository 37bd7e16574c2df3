"""Incremental ingest: a file stream of chunk rows, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.sources.store import Store


def chunk_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def upsert_stream(stream: DataFrame, store: Store, name: str, keys: list[str], order: list[str], checkpoint: str, once: bool = True):
    """Upsert a stream into a table. A batch that is repeated after a failure changes nothing,
    since of each key only the last row by ``order`` stays."""

    def one(batch: DataFrame, number: int) -> None:
        store.upsert(name, batch, keys, order)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def mentions_per_window(stream: DataFrame, time_col: str, size: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows per event-time window; rows later than the watermark are dropped by Spark."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, size)).agg(F.count(F.lit(1)).alias("rows")).select("window.start", "window.end", "rows")
