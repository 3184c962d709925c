"""Line dedup by overlapping three-line windows, in DataFrame operations only.

Every three consecutive lines of a document are hashed together. A window that occurs more than once in the corpus is
kept where it comes first, by doc_id and then by place; all lines that any later occurrence covers are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

_BLANK = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _is_blank(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(_BLANK))) == 0


def repeated_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, removed): the places, from 0, of the lines to remove, for documents that lose any."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _lines(text).alias("lines"))
    full = F.filter(F.transform("lines", lambda line, i: F.struct(i.alias("at"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(width), line).alias("h2"), _is_blank(line).alias("blank"))), lambda x: ~x["blank"])
    rows = rows.select("doc_id", full.alias("full")).where(F.size("full") >= width)
    place = lambda i, name: [F.get("full", i + j)[name] for j in range(width)]
    windows = F.transform(F.sequence(F.lit(0), F.size("full") - width), lambda i: F.struct(F.xxhash64(*place(i, "h1")).alias("w1"), F.xxhash64(*place(i, "h2")).alias("w2"), F.array(*place(i, "at")).alias("at")))
    windows = rows.select("doc_id", F.explode(windows).alias("w")).select("doc_id", "w.w1", "w.w2", "w.at")
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", F.get("at", F.lit(0)).alias("place"))).alias("first"), F.count("*").alias("n")).where("n > 1").select("w1", "w2", "first")
    later = windows.join(first, ["w1", "w2"]).where(F.struct("doc_id", F.get("at", F.lit(0)).alias("place")) > F.col("first"))
    return later.select("doc_id", F.explode("at").alias("at")).groupBy("doc_id").agg(F.collect_set("at").alias("removed"))


def _runs(places: Column) -> tuple[Column, Column]:
    """(first, last) places of the runs of consecutive places in a sorted array."""
    before = lambda x, i: (i == 0) | (F.get(places, i - 1) != x - 1)
    after = lambda x, i: (i == F.size(places) - 1) | (F.get(places, i + 1) != x + 1)
    return F.filter(places, before), F.filter(places, after)


def _without(lines: Column, first: Column, last: Column) -> Column:
    """lines but for the runs: the slices between them, so that the work is linear in both."""
    start = lambda i: F.when(i == 0, 0).otherwise(F.get(last, i - 1) + 1)
    end = lambda i: F.coalesce(F.get(first, i), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(first)), lambda i: F.slice(lines, start(i) + 1, F.greatest(end(i) - start(i), F.lit(0)))))


def deduplicated(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs with all their columns, their texts without the removed lines, and removed, the removed places or null.

    Lines are what newlines part. A line with nothing but ASCII white space is blank: it belongs to no window and is
    never removed. Null texts stay null, a text of fewer than `width` lines stays as it is, and one that loses all its
    lines becomes empty. Rows that repeat a doc_id are one document: an occurrence at the same place is not a later
    one, and a line to be removed goes from all of them; rows without doc_id come first and stay as they are. An empty table gives no
    rows. A column of docs named removed is left out.
    """
    of, gone, lines, first, last = (unused(docs, n) for n in ("of", "gone", "lines", "first", "last"))
    found = repeated_lines(docs, width).select(F.col("doc_id").alias(of), F.sort_array("removed").alias(gone))
    found = found.select(of, gone, *[runs.alias(n) for runs, n in zip(_runs(F.col(gone)), (first, last))])
    rows = docs.join(found.hint("merge"), docs["doc_id"].cast("long") == F.col(of), "left")
    rows = rows.withColumn(lines, F.when(F.col(gone).isNotNull(), _lines(F.col("text").cast("string"))))
    # of rows that repeat a doc_id one may have fewer lines
    kept = F.array_join(_without(F.col(lines), F.col(first), F.col(last)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    return rows.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns if c != "removed"], F.col(gone).alias("removed"))


def line_counts(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, n_spans (runs of consecutive removed places) and the kept text of every row."""
    rows = docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_lines", F.size(F.filter(_lines(F.col("text")), lambda line: ~_is_blank(line))).cast("long"))
    out = deduplicated(rows, width)
    spans = F.size(_runs(F.col("removed"))[0])
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.when(F.col("removed").isNotNull(), spans), F.lit(0)).cast("long").alias("n_spans"), "text")
