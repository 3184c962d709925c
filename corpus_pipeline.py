"""A corpus pipeline of five stages, each calling one operator of tessera.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, minhash, mixing, quality_classifier
from tessera.llm.common import table, unused, written


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars brought up to date where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Every row is judged by its text alone: null, empty and very long texts are scored like any other, rows without doc_id
    and rows that repeat one are each judged. Without labels all stay. An empty table stays empty."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go from the texts, and documents that have nothing else.

    Null, empty and blank texts lose nothing and stay. Rows that repeat a doc_id are one document, of which a line goes
    from all; rows without doc_id stay as they are and count as the first. An empty table stays empty."""
    out = line_dedup.deduplicated(docs, width=3)
    return _with_length(out.where(F.col("removed").isNull() | F.col("text").isNull() | (F.length(F.btrim("text", F.lit(" \t\x0b\x0c\r\n"))) > 0)).drop("removed"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more.

    Decided for each row: of rows with the same doc_id, or none, each is a document of its own, so that exact repeats of a
    row go too. Of a group the row of the least doc_id stays, one without doc_id only where none has one, and of equal
    ones any. Rows without words (null, empty, blank texts) are no duplicates and stay. An empty table stays empty."""
    row = unused(docs, "row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = minhash.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), k=5, percent=80).select(F.col("doc_id").alias(row), "component_id")
    ids = numbered.select(row, F.col("doc_id").cast("long").alias("of"))
    first = F.min(F.struct(F.col("of").isNull().alias("nameless"), "of", row))
    kept = ids.join(found.hint("merge"), row).groupBy("component_id").agg(first.alias("first")).select(f"first.{row}")
    return numbered.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go; other such spans are cut out.

    Every row is judged by its text alone; those without words (null, empty, blank texts) stay as they are. Without
    benchmark items all stay. An empty table stays empty."""
    return _with_length(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), window=13, max_share=0.05))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is to be used, so that the domains' expected tokens match their targets.

    One row for each row of docs, see mixing.mixed: null, empty and blank texts have no tokens and the priors' posterior;
    without labels all domains are equally likely. An empty table gives no rows."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mix)]

#: SQL can't express the classifiers and the fitted rates; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
