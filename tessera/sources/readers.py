"""Readers: catalogs, processed sections, raw registries, entity-resolution pairs, reports."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def entities(spark: SparkSession, rows: list[Mapping]) -> DataFrame:
    """A catalog from dictionaries with id, name and optional aliases."""
    from tessera.operators.catalog import SCHEMA, validated

    return validated(spark.createDataFrame([(str(r["id"]), r["name"], list(r.get("aliases") or [])) for r in rows], SCHEMA))


def processed_sections(spark: SparkSession, folder: str, sections: list[str] | None = None, max_entities: int | None = None) -> DataFrame:
    """(section, id, name, aliases, type) of folder/*/*.csv; section is parent/stem; aliases are parted by bars, and
    those equal to the id are dropped. max_entities keeps the first of each section by id."""
    raw = spark.read.option("header", True).csv(f"{folder}/*/*.csv", schema="id string, name string, aliases string, type string", enforceSchema=False)
    path = F.col("_metadata.file_path")
    rows = raw.select(F.regexp_extract(path, r"([^/]+/[^/]+)\.csv$", 1).alias("section"), "id", "name", "aliases", "type")
    rows = rows.withColumn("aliases", F.filter(T.split_aliases(F.col("aliases")), lambda a: a != F.col("id")))
    rows = rows.where(F.col("section").isin(sections)) if sections else rows
    if max_entities:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("section").orderBy("id"))).where(F.col("n") <= max_entities).drop("n")
    return rows


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(left, right, label) of an entity-resolution dataset: test.csv with both tables' texts; missing ones are empty."""
    from tessera.operators.evaluation import er_pairs

    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/{name}.csv")

    def side(name):
        df = read(name)
        return df.select("id", F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns if c != "id"]).alias("text"))

    test = read("test").select(F.col("ltable_id").alias("left_id"), F.col("rtable_id").alias("right_id"), F.col("label").cast("int").alias("label"))
    return er_pairs(test, side("tableA"), side("tableB")).select("left", "right", "label")


# ---- raw registries to (id, name, aliases) -------------------------------------------


def _bars(*parts: Column, but: Column | None = None) -> Column:
    """Distinct non-empty parts, without `but`, joined by bars."""
    found = F.array_distinct(F.filter(F.array(*[F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts]), lambda p: p.isNotNull()))
    return F.array_join(F.filter(found, lambda p: p != but) if but is not None else found, "|")


def _pick(df: DataFrame, *names: str) -> Column:
    """The first non-empty of the columns there are."""
    have = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(None).cast("string")) if have else F.lit(None).cast("string")


def _first(df: DataFrame, key: str) -> DataFrame:
    """One row for each key: the least of its other values."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(c).alias(c) for c in df.columns if c != key]).select(*df.columns)


def currencies(raw: DataFrame) -> DataFrame:
    rows = raw.select(_pick(raw, "AlphabeticCode").alias("id"), F.coalesce(_pick(raw, "Currency"), _pick(raw, "Entity")).alias("name"), _bars(_pick(raw, "AlphabeticCode"), _pick(raw, "NumericCode")).alias("aliases"), F.lit("currency").alias("type"))
    return _first(rows, "id")


def languages(raw: DataFrame) -> DataFrame:
    """Headers with hyphens or underscores."""
    a2, a3b, a3t = (_pick(raw, n, n.replace("-", "_")) for n in ("alpha2", "alpha3-b", "alpha3-t"))
    english, french = _pick(raw, "English"), _pick(raw, "French")
    rows = raw.select(F.coalesce(a2, a3b).alias("id"), english.alias("name"), _bars(a2, a3b, a3t, F.when(french != english, french)).alias("aliases"), F.lit("language").alias("type"))
    return _first(rows, "id")


def _coded(code: Column, name: Column, prefixes: tuple[int, ...], kind: str, df: DataFrame) -> DataFrame:
    """A classification: a code's prefixes are its aliases."""
    rows = df.select(F.trim(code).alias("id"), F.trim(name).alias("name"), _bars(*[F.left(F.trim(code), F.lit(n)) for n in prefixes], but=F.trim(code)).alias("aliases"), F.lit(kind).alias("type"))
    return _first(rows.where("name <> ''"), "id")


def industries(raw: DataFrame, system: str = "NAICS") -> DataFrame:
    return _coded(_pick(raw, "code", "Code", "NAICS", "SIC"), _pick(raw, "title", "Title", "description", "Description"), (2,), "industry", raw).withColumn("system", F.lit(system))


def occupations(raw: DataFrame) -> DataFrame:
    return _coded(_pick(raw, "O*NET-SOC Code", "code"), _pick(raw, "Title", "title"), (2, 4), "occupation", raw)


def products_unspsc(raw: DataFrame) -> DataFrame:
    return _coded(_pick(raw, "code", "Commodity"), _pick(raw, "title", "Commodity Title", "name"), (2, 4, 6), "product", raw)


def products_mcc(raw: DataFrame) -> DataFrame:
    return _coded(_pick(raw, "mcc"), _pick(raw, "edited_description", "combined_description", "usda_description", "irs_description"), (2,), "product", raw)


def timezones(lines: DataFrame) -> DataFrame:
    """From zone.tab lines (value): comments are skipped; the name is the zone's last part."""
    part = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(part) >= 3)).select(F.get(part, F.lit(2)).alias("id"), F.get(part, F.lit(0)).alias("country_code"))
    name = F.translate(F.element_at(F.split("id", "/"), -1), "_", " ")
    return rows.select("id", name.alias("name"), F.col("id").alias("aliases"), F.lit("timezone").alias("type"), "country_code")


def universities(raw: DataFrame) -> DataFrame:
    """From (name, country), one for each name."""
    name = F.trim("name")
    rows = raw.where("trim(name) <> ''").select(F.regexp_replace(F.translate(F.lower(name), " ,", "_"), ",", "").alias("id"), name.alias("name"), F.lit("").alias("aliases"), F.lit("university").alias("type"), "country")
    return _first(rows, "id")


INGESTERS = {"currencies": currencies, "languages": languages, "industries": industries, "occupations": occupations, "products_unspsc": products_unspsc, "products_mcc": products_mcc, "timezones": timezones, "universities": universities}


def with_fallback(read, fallback: DataFrame) -> DataFrame:
    """read()'s rows, or fallback where it fails or is empty."""
    try:
        df = read()
        return fallback if df.isEmpty() else df
    except Exception:
        return fallback


# ---- configuration, versions ----------------------------------------------------------


def merged_config(base: Mapping, override: Mapping) -> dict:
    """A deep merge; override wins."""
    out = dict(base)
    for k, v in override.items():
        out[k] = merged_config(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def config_value(config: Mapping, dotted: str, default=None):
    for part in dotted.split("."):
        if not isinstance(config, Mapping) or part not in config:
            return default
        config = config[part]
    return config


def load_config(path: str, override: Mapping | None = None) -> dict:
    """A JSON file, merged with override."""
    with open(os.path.abspath(path)) as f:
        return merged_config(json.load(f), override or {})


def version_key(*parts: str) -> str:
    """Cache key of a dataset's version."""
    import hashlib

    return hashlib.sha256(":".join(parts).encode()).hexdigest()[:12]
