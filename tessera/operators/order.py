"""Order over whole tables without a task that holds them: running sums, positions and exact percentiles."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which one buffer takes all values of a percentile.
SMALL = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Only a local master, whose executors are
    the driver, gets a temporary one where that is unset; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder or current.isDefined():
        return (folder or current.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with the sums, by key, of all rows up to each in the order, which must tell rows of a key apart.

    The rows are dealt by ranges of the order and added up within and then over the ranges; no key has a task of its
    own."""
    local = [f"{n}_here" for n in sums]
    dealt = cut(rows.withColumns(dict(zip(local, sums.values()))).repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("part_", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "part_").agg(*[F.sum(h).alias(f"{h}_all") for h in local])
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "part_", *[F.coalesce(F.sum(f"{h}_all").over(before), F.lit(0)).alias(f"{h}_before") for h in local])
    inner = Window.partitionBy(*keys, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(parts, [*keys, "part_"])
    return out.select(*rows.columns, *[(F.sum(h).over(inner) + F.col(f"{h}_before")).alias(n) for n, h in zip(sums, local)])


def percentile(rows: DataFrame, column: str, share: float) -> float | None:
    """The exact percentile, between two values by their distance. Of many rows the range of the two values is narrowed by
    counts in 4096 bins until few rows are left in it."""
    rows = rows.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n = rows.count()
    if n <= SMALL:
        return rows.agg(F.percentile("x", share)).first()[0]
    rows = cut(rows)
    at = share * (n - 1)
    return _ranked(rows, int(at), n) * (1 - at % 1) + _ranked(rows, min(int(at) + 1, n - 1), n) * (at % 1)


def _ranked(rows: DataFrame, rank: int, n: int) -> float:
    """The value at a rank, from 0."""
    while n > SMALL:
        low, high = rows.agg(F.min("x"), F.max("x")).first()
        if low == high:
            return low
        bin_ = F.least(F.lit(4095), F.floor((F.col("x") - low) / (high - low) * 4096)).alias("b")
        for r in sorted(rows.groupBy(bin_).count().collect(), key=lambda r: r["b"]):  # at most 4096 rows
            if rank < r["count"]:
                rows, n = rows.withColumn("b", bin_).where(F.col("b") == r["b"]).select("x"), r["count"]
                break
            rank -= r["count"]
    return rows.orderBy("x").collect()[rank]["x"]
