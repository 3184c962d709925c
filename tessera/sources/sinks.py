"""Writers: CSV, Parquet, JSON reports, review stores, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    """With a header; nothing to write is an error."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    df.write.mode("overwrite").option("header", True).csv(path)


def capped_parquet(df: DataFrame, path: str, key: str, n: int | None = None) -> None:
    """All rows, or a stable sample of n by the hash of key."""
    rows = df.orderBy(F.xxhash64(key), key).limit(n) if n else df
    rows.write.mode("overwrite").parquet(path)


def report(df: DataFrame, path: str, format: str = "json") -> None:
    """json or csv; nested columns become JSON text in CSV."""
    if format == "json":
        df.write.mode("overwrite").json(path)
    elif format == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"no format {format!r}")


def replaced(df: DataFrame, path: str) -> None:
    """Overwrites path with rows that may come from it: written beside it, then moved."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(f"{path}.new"), jvm.org.apache.hadoop.fs.Path(path)
    fs = old.getFileSystem(conf)
    fs.delete(new, True)
    df.write.parquet(f"{path}.new")
    fs.delete(old, True)
    fs.rename(new, old)


def markdown(samples: DataFrame, counts: DataFrame, n: int = 20) -> str:
    """A short summary: the first n samples by score, and the counts by state."""
    lines = ["# Discovery report", "", "| state | n |", "|-|-|", *(f"| {r[0]} | {r[1]} |" for r in counts.orderBy(counts.columns[0]).collect()), "", "| query | score |", "|-|-|"]
    lines += [f"| {r['query_id']} | {r['score']:.3f} |" for r in samples.select("query_id", "score").orderBy(F.desc("score"), "query_id").limit(n).collect()]
    return "\n".join(lines) + "\n"
