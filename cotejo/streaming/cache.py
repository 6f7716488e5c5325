"""Incremental caches: new records arrive as a stream, the last of each key wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cotejo.sources.tables import latest


def stream_records(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """JSON-line records as they appear in a folder, broken lines left out."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path).where("url is not null")


def first_seen(records: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each url once within the delay: repeats of late fetches drop out, with bounded state."""
    return records.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["url"])


def upsert_into(records: DataFrame, path: str, checkpoint: str, key: str = "url", seq: str = "ts", trigger: dict | None = None) -> StreamingQuery:
    """Writes each batch's last record of each key as a new generation under ``path``.

    A batch is one folder, named by its number: a repeated batch overwrites
    itself, so a restart neither loses nor doubles records.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch.withColumn("__seq", F.col(seq)), key, "__seq").write.mode("overwrite").parquet(f"{path}/generation={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str, key: str = "url", seq: str = "ts") -> DataFrame:
    """The cache as of the generations written."""
    rows = spark.read.parquet(path)
    return latest(rows.withColumn("__seq", F.struct(F.col(seq), F.col("generation"))), key, "__seq").drop("generation")


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling windows; late rows beyond the delay drop out."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def score_stream(articles: DataFrame, verify: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Verifies articles batch by batch with the batch plan."""

    def write(batch: DataFrame, number: int) -> None:
        verify(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return articles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
