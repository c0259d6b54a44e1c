"""Streaming ingestion: new documents pass the row-wise filters, repeated texts within a horizon are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.functions import text as T
from gristmill.operators.filters import apply_filter


def document_stream(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def filtered(stream: DataFrame, names: list[str], time: str = "loaded_at", horizon: str = "7 days") -> DataFrame:
    """The filter chain on a stream; of equal texts within the horizon the first to arrive is kept."""
    for name in names:
        if name == "dedup":
            stream = stream.withWatermark(time, horizon).withColumn("_digest", F.sha1(T.normal(F.coalesce("text", F.lit("")))))
            stream = stream.dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")
        else:
            stream = apply_filter(stream, name)
    return stream


def event_rates(stream: DataFrame, time: str, key: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and means per window and key; rows later than the watermark are left out."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key)
    return grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select("w.start", "w.end", key, "n", "mean")


def write(stream: DataFrame, folder: str, state: str, mode: str = "append") -> StreamingQuery:
    """Run until all that is there has been taken in; state must be in a folder that all executors share."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
