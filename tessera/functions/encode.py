"""Text to vectors without a model: hashed character n-grams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V


def gram_bucket(gram: Column, dims: int) -> Column:
    """A bucket that any SQL engine with md5 can compute."""
    return (F.conv(F.substring(F.md5(gram.cast("binary")), 1, 8), 16, 10).cast("long") % dims).cast("int")


def lexical_vector(text: Column, dims: int = 64, n: int = 3) -> Column:
    """Counts of a text's n-grams by bucket, scaled to length 1."""
    buckets = F.transform(T.char_ngrams(F.lower(text), n), lambda g: gram_bucket(g, dims))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    return V.unit(counts)


def encoded(rows: DataFrame, encoder: Callable[[Column], Column] | None = None, text: str = "text") -> DataFrame:
    """rows with v; every distinct text is encoded once and joined back."""
    encoder = encoder or lexical_vector
    distinct = rows.select(F.col(text).alias("t")).distinct().withColumn("v", encoder(F.col("t")))
    return rows.join(distinct.withColumnRenamed("t", text), text, "left")
