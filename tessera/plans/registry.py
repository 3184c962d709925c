"""Where queries register themselves, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIMS = 64


def query(name: str, sql: str | None = None):
    """Registers f(t), t("name") reading a table, as a query; sql is DuckDB's for the same rows."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
            read.spark = spark
            return f(read)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def catalog_of_parts(t) -> DataFrame:
    """Distinct part names as entities; the words of a name are its aliases."""
    return t("part").select("p_name").distinct().select(F.translate("p_name", " ", "_").alias("id"), F.col("p_name").alias("name"), F.split("p_name", " ").alias("aliases"))


def vectors(t) -> DataFrame:
    """(id, v, label) of all embeddings, as doubles."""
    return t("embeddings").select(F.col("vec_id").alias("id"), V.dbl(F.col("embedding")).alias("v"), "label")


def references(t) -> DataFrame:
    """(ref_id, v, label): labels below 8 are the known classes."""
    return vectors(t).where("label < 8").withColumnRenamed("id", "ref_id")


def probes(t) -> DataFrame:
    """(query_id, v, label): all vectors; labels 8 and 9 are novel."""
    return vectors(t).withColumnRenamed("id", "query_id")


#: Common parts of the SQL.
SQL_PARTS = "ents AS (SELECT DISTINCT replace(p_name, ' ', '_') AS id, p_name AS name, string_split(p_name, ' ') AS aliases FROM part), flat AS (SELECT DISTINCT id, unnest(list_concat([name], aliases)) AS text FROM ents)"
SQL_EMB = """e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), ref AS (SELECT * FROM e WHERE label < 8),
means AS (SELECT label, any_value(n) AS n, list(m ORDER BY i) AS mean FROM (SELECT label, i, count(*) AS n, avg(v[i]) AS m FROM ref, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
cd AS (SELECT vec_id, e.label AS truth, m.label, m.n, list_cosine_similarity(v, mean) AS c FROM e, means m)"""
SQL_PROBS = SQL_EMB + """, mx AS (SELECT vec_id, max(c) AS top FROM cd GROUP BY vec_id), ex AS (SELECT cd.*, exp((c - top) * 10) AS x FROM cd JOIN mx USING (vec_id)),
probs AS (SELECT vec_id, truth, label, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM ex),
pred AS (SELECT vec_id, any_value(truth) AS truth, max_by(label, p) AS predicted, max(p) AS confidence, list(p ORDER BY p DESC) AS ps FROM probs GROUP BY vec_id)"""
SQL_SCORES = SQL_EMB + """, limits AS (SELECT quantile_cont(1 - c, 0.95) AS lim FROM cd WHERE truth = label),
dist AS (SELECT vec_id, any_value(truth) AS truth, round(min(round(1 - c, 9)), 9) AS d FROM cd GROUP BY vec_id),
scores AS (SELECT vec_id, truth >= 8 AS novel, round(d, 6) AS score FROM dist)"""
