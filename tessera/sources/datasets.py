"""Registered datasets, jobs that fetch and process, snapshots and proposal files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.sources import readers, sinks


@dataclass(frozen=True)
class Dataset:
    """A dataset by name; task: resolution, classification or novelty."""

    name: str
    task: str
    path: str
    classes: int = 0
    columns: tuple[str, ...] = field(default=("text", "label"))

    @property
    def version(self) -> str:
        return readers.version_key(self.name, self.path, *self.columns)


class Registry:
    def __init__(self, datasets: list[Dataset] = ()):
        self.by_name = {d.name: d for d in datasets}

    def add(self, dataset: Dataset) -> None:
        if dataset.name in self.by_name:
            raise ValueError(f"dataset {dataset.name!r} is already there")
        self.by_name[dataset.name] = dataset

    def of_task(self, task: str) -> list[Dataset]:
        return [d for d in self.by_name.values() if d.task == task]

    def load(self, spark: SparkSession, name: str, cache: str | None = None) -> DataFrame:
        """The dataset's rows; with cache, from a Parquet copy that is written once for each version."""
        d = self.by_name[name]
        if cache is None:
            return spark.read.parquet(d.path).select(*d.columns)
        copy = f"{cache}/{d.name}-{d.version}"
        try:
            return spark.read.parquet(copy)
        except Exception:
            spark.read.parquet(d.path).select(*d.columns).write.mode("overwrite").parquet(copy)
            return spark.read.parquet(copy)


@dataclass
class Ingestion:
    """fetch -> process -> CSV; what fails is reported, and a fallback can stand in for what can't be fetched."""

    name: str
    fetch: Callable[[], DataFrame]
    process: Callable[[DataFrame], DataFrame]
    fallback: Callable[[], DataFrame] | None = None

    def run(self, out: str) -> dict:
        raw = readers.with_fallback(self.fetch, self.fallback()) if self.fallback else self.fetch()
        rows = self.process(raw)
        sinks.csv(rows, f"{out}/{self.name}")
        return {"name": self.name, "rows": rows.count()}


def ingest_all(jobs: list[Ingestion], out: str, continue_on_error: bool = True) -> list[dict]:
    results = []
    for job in jobs:
        try:
            results.append(job.run(out))
        except Exception as e:
            if not continue_on_error:
                raise
            results.append({"name": job.name, "error": str(e)})
    return results


def snapshot(vectors: DataFrame, dims: int) -> DataFrame:
    """One row for each class (label) and one for all (null): n, mean, and a hash of the rows that doesn't depend on
    their order."""
    digest = F.bit_xor(F.xxhash64("v", "label")).alias("digest")
    each = vectors.groupBy(F.col("label").cast("string").alias("label")).agg(F.count("*").alias("n"), V.mean_vector(F.col("v"), dims).alias("mean"), digest)
    return each.unionByName(vectors.agg(F.count("*").alias("n"), V.mean_vector(F.col("v"), dims).alias("mean"), digest).select(F.lit(None).cast("string").alias("label"), "n", "mean", "digest"))


def proposal_files(spark: SparkSession, folder: str, newest: bool = True) -> DataFrame:
    """(path, created) of discovery reports, by the time in their name."""
    files = spark.read.format("binaryFile").load(f"{folder}/discovery_*.json").select("path")
    created = F.to_timestamp(F.regexp_extract("path", r"discovery_(\d{8}_\d{6})", 1), "yyyyMMdd_HHmmss")
    return files.select("path", created.alias("created")).orderBy(F.desc("created") if newest else F.asc("created"))
