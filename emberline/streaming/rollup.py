"""Incremental forms of the batch operators for tiles that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tiles(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as they come; files that were read once are not read again."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def parcel_windows(rows: DataFrame, at: str, parcel: str, flag: str, window: str = "1 day", late: str = "14 days", key: str | None = None) -> DataFrame:
    """parcel, window start, n, flagged. Rows later than `late` are dropped by the watermark; repeated keys count once."""
    marked = rows.withWatermark(at, late)
    if key:
        marked = marked.dropDuplicatesWithinWatermark([key])
    return marked.groupBy(F.window(at, window), parcel).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("flagged")).select(
        parcel, F.col("window.start").alias("start"), "n", "flagged"
    )


def run_once(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; a later call goes on where this one ended."""
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
