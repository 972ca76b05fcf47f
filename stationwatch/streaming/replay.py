"""Replay of stored results as a stream, and a streaming version of the statistical range check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import STATION, TIME


def replay(spark: SparkSession, path: str, schema: T.StructType, files_per_tick: int = 1) -> DataFrame:
    """Parquet files as a stream, so many a tick."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_tick).parquet(path)


def alert_stream(results: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Suspicious and alerted rows, each key once within the watermark."""
    rows = results.withColumn(TIME, F.col(TIME).cast("timestamp")).withWatermark(TIME, delay)
    return rows.where(F.col("final_severity") != "normal").dropDuplicatesWithinWatermark([STATION, TIME])


def hourly_stream(readings: DataFrame, value: str, delay: str = "2 hours") -> DataFrame:
    """Hourly mean, count and maximum of raw readings (station_id, ts, value), late ones beyond the watermark dropped."""
    rows = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    hours = rows.groupBy(F.col(STATION), F.window("ts", "1 hour")).agg(F.avg(value).alias("temperature"), F.count("*").alias("humidity"), F.max(value).alias("pressure"))
    return hours.select(STATION, F.col("window.start").alias(TIME), "temperature", F.col("humidity").cast("double").alias("humidity"), "pressure")


def score_micro_batches(stream: DataFrame, score: Callable[[DataFrame], DataFrame], history: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch is scored together with the history it needs, by the batch operators, and only its own rows reach the sink.

    Neighbours and rolling windows need rows that came earlier, so the batch is
    joined by ``history()``; the sink must be idempotent by batch id.
    """
    def run(batch: DataFrame, number: int) -> None:
        keys = batch.select(STATION, TIME).distinct()
        scored = score(history().unionByName(batch, allowMissingColumns=True).dropDuplicates([STATION, TIME]))
        sink(scored.join(keys, [STATION, TIME], "left_semi"), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
