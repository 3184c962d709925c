"""The catalog of entities: id, name, aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

SCHEMA = "id string, name string, aliases array<string>"


class CatalogError(ValueError):
    """Entities that can't be a catalog."""


def flatten(entities: DataFrame) -> DataFrame:
    """(id, text): a row for each name and each alias."""
    texts = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.select("id", F.explode(texts).alias("text")).where("text is not null")


def duplicates(entities: DataFrame) -> DataFrame:
    """(id, n) of ids that are not unique."""
    return entities.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def validated(entities: DataFrame) -> DataFrame:
    """entities, or CatalogError if it is empty, lacks an id or a name, or repeats an id."""
    if not {"id", "name"} <= set(entities.columns) or entities.isEmpty():
        raise CatalogError("a catalog needs rows with id and name")
    if not entities.where("id is null or name is null or name = ''").isEmpty():
        raise CatalogError("an entity lacks its id or name")
    again = [r["id"] for r in duplicates(entities).orderBy("id").limit(20).collect()]
    if again:
        raise CatalogError(f"repeated ids: {', '.join(map(str, again))}")
    return entities


def unique_aliases(entities: DataFrame) -> DataFrame:
    """(id, alias) of aliases that one entity alone has and that are not its id."""
    rows = entities.select("id", F.explode("aliases").alias("alias")).where(F.col("alias") != F.col("id").cast("string"))
    single = rows.groupBy("alias").agg(F.count("*").alias("n")).where("n = 1").select("alias")
    return rows.join(single, "alias", "left_semi").select("id", "alias")


def holdout_queries(entities: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(id, variant, text): perturbed names, without empty ones, without those that clean texts of the same entity in
    excluded (id, text) are, and without repeats within an entity."""
    rows = entities.select("id", F.posexplode(T.holdout_variants(F.col("name"))).alias("at", "v")).select("id", "at", "v.variant", "v.text")
    rows = rows.where(F.col("text") != "")
    if excluded is not None:
        rows = rows.join(excluded.where("text <> ''").select("id", T.clean(F.col("text")).alias("text")).distinct(), ["id", "text"], "left_anti")
    first = Window.partitionBy("id", "text").orderBy("at")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("id", "variant", "text")


def appended(entities: DataFrame, more: DataFrame) -> DataFrame:
    return entities.unionByName(more, allowMissingColumns=True)


def synthetic(spark, entities: int = 10, variants: int = 50) -> DataFrame:
    """(text, label) of made-up entities."""
    n = F.col("id")
    return spark.range(entities * variants).select(F.format_string("ENTITY_%d text variant %d", F.floor(n / variants), n % variants).alias("text"), F.format_string("ENTITY_%d", F.floor(n / variants)).alias("label"))


def mode(examples: DataFrame, label: str = "label") -> DataFrame:
    """One row: n_labels, least and all examples, and the matching mode that they allow."""
    counts = examples.groupBy(label).agg(F.count("*").alias("n"))
    row = counts.agg(F.count("*").alias("n_labels"), F.coalesce(F.min("n"), F.lit(0)).alias("least"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    mode = F.when(F.col("n_labels") == 0, "zero-shot").when((F.col("least") >= 8) & (F.col("total") >= 100), "bert").when(F.col("least") < 3, "head-only").otherwise("full")
    return row.withColumn("mode", mode)
