"""Extension: incremental runs over files that arrive, with Structured Streaming. The batch operators do not depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.sinks import upsert_batch


def arriving(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def once_by_key(rows: DataFrame, key: str, time: str, lateness: str = "90 days") -> DataFrame:
    """First delivery of every key; the state of keys older than the watermark is dropped."""
    return rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_rates(rows: DataFrame, time: str, flag: str, by: list[str], width: str = "1 day", lateness: str = "90 days") -> DataFrame:
    """Rows and successes per window and group, late rows included up to the watermark."""
    return (
        rows.withWatermark(time, lateness)
        .groupBy(F.window(time, width), *by)
        .agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias("successes"))
    )


def upserting(rows: DataFrame, path: str, checkpoint: str, key: str, order: list[str]) -> StreamingQuery:
    """Keeps a table with the newest row of every key; a batch that runs twice writes the same."""
    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, _: upsert_batch(batch, path, key, order))
        .start()
    )
