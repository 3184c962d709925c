"""Structured Streaming: matching, incremental clustering and drift over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import clusters as G
from tessera.operators import discovery as D
from tessera.operators import matching as M


def in_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]):
    """Runs each over everything that is there, batch by batch, and waits."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def matched(stream: DataFrame, entities: DataFrame, out: str, checkpoint: str, threshold: float = 0.5) -> None:
    """Writes the best match of streamed queries (query_id, text) against entities (id, text)."""

    def each(batch: DataFrame, n: int) -> None:
        M.lexical_match(batch, entities, 1, threshold).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    in_batches(stream, checkpoint, each)


def clustered(stream: DataFrame, means: DataFrame, dims: int, out: str, checkpoint: str, threshold: float = 0.7, found_of: int | None = None) -> None:
    """Assigns streamed vectors (id, v) to the nearest of means (label, n, mean), whose running means follow; the state
    table is versioned by batch, so a batch that is repeated reads the same state. found_of: rows of a batch that no
    cluster takes found new ones, where so many of them are that similar to each other."""
    spark = means.sparkSession
    means.write.mode("overwrite").parquet(f"{out}/state/version=0")

    def each(batch: DataFrame, n: int) -> None:
        state = spark.read.parquet(f"{out}/state/version={n}")
        got = G.assign(batch, state, threshold)
        if found_of:
            got = G.founded(batch, got, state, threshold, found_of)
        got.write.mode("overwrite").parquet(f"{out}/assigned/batch={n}")
        rows = spark.read.parquet(f"{out}/assigned/batch={n}").where("cluster >= 0").join(batch, "id").select(F.col("cluster").alias("label"), "v")
        fresh = rows.groupBy("label").agg(F.count("*").alias("m"), V.mean_vector(F.col("v"), dims).alias("new"))
        moved = F.zip_with("mean", "new", lambda a, b: (a * F.col("n") + b * F.col("m")) / (F.col("n") + F.col("m")))
        after = state.join(fresh, "label", "full").select("label", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.when(F.col("m").isNull(), F.col("mean")).when(F.col("n").isNull(), F.col("new")).otherwise(moved).alias("mean"))
        after.write.mode("overwrite").parquet(f"{out}/state/version={n + 1}")

    in_batches(stream, checkpoint, each)


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(window, event_type, n, mean) of events (ts, event_type, value), final once the watermark has passed."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def drifting(stream: DataFrame, base: DataFrame, dims: int, out: str, checkpoint: str, threshold: float = 0.05) -> None:
    """Compares each batch of streamed vectors (v) with a snapshot."""

    def each(batch: DataFrame, n: int) -> None:
        rows = D.mean_drift(base, batch, dims).withColumn("recommendation", D.recommendation(F.col("mmd_linear"), threshold))
        rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    in_batches(stream, checkpoint, each)
