"""Streams: new raw files into the index, and query statistics over an event-time window (an extension)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_pages(spark: SparkSession, folder: str, state: str, build: Callable[[DataFrame, int], None], schema: str) -> StreamingQuery:
    """Hands every batch of Parquet pages that is new in ``folder`` to ``build`` once, then ends; ``state`` remembers what was seen."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(build).option("checkpointLocation", state).trigger(availableNow=True).start()


def windowed_stats(log: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Queries, mean latency and cache hits by window of ``timestamp`` (a streaming or batch frame)."""
    g = log.withWatermark("timestamp", late).groupBy(F.window("timestamp", width))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("avg_latency_ms"), F.sum(F.col("cache_hit").cast("int")).alias("cache_hits")).select("window.start", "n", "avg_latency_ms", "cache_hits")
