"""Inventories that arrive as files: published batch by batch, counted by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators.generations import latest_rows


def read_inventory(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def upsert_stream(rows: DataFrame, target: str, checkpoint: str, keys: list[str], order: str = "loaded_at", after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Latest row per key and batch, appended under its batch number; a replayed batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        held = latest_rows(batch, keys, F.col(order))
        held.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if after:
            after(held, number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, keys: list[str], order: str = "loaded_at") -> DataFrame:
    """State after all batches."""
    return latest_rows(spark.read.parquet(target), keys, F.struct(order, "batch")).drop("batch")


def deliveries(rows: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Rows and read errors per window of delivery; late rows are waited for."""
    return rows.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", window).alias("w"), "repo").agg(F.count("*").alias("n_rows"), F.count("read_error").alias("n_errors")).select(F.col("w.start").alias("window_start"), "repo", "n_rows", "n_errors")
