"""Evidence, proposals, review, active learning and drift."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators.order import cut
from tessera.operators.strategies import scatter

#: Allowed moves of a review.
TRANSITIONS = {"pending": ["approved", "rejected"], "approved": ["approved", "promoted"], "rejected": ["rejected"], "promoted": ["promoted"]}


def keywords(docs: DataFrame, by: str, top: int = 8, features: int = 1000) -> DataFrame:
    """(by, rank, token, score): mean tf-idf weight of evidence tokens over the documents (id, text) of each group, of its
    most frequent `features` tokens.

    All sums are hash aggregations by (group, token) or document: no window orders a whole group."""
    tf = docs.select(by, "id", F.explode(T.evidence_tokens(F.col("text"))).alias("token")).groupBy(by, "id", "token").agg(F.count("*").alias("tf"))
    n = docs.groupBy(by).agg(F.count("*").alias("n"))
    df = tf.groupBy(by, "token").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    df = df.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("total"), "token"))).where(F.col("k") <= features).join(n, by)
    idf = df.select(by, "token", "n", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf, [by, "token"]).withColumn("w", F.col("tf") * F.col("idf"))
    # the weights of a document, one row, scaled to length 1 within it
    w = w.groupBy(by, "id").agg(F.collect_list(F.struct("token", "w")).alias("ws"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), F.max("n").alias("n"))
    w = w.select(by, "n", "length", F.explode("ws").alias("x")).select(by, "x.token", (F.col("x.w") / F.col("length")).alias("w"), "n")
    mean = w.groupBy(by, "token").agg(F.round(F.sum("w") / F.max("n"), 9).alias("score"))
    order = Window.partitionBy(by).orderBy(F.desc("score"), "token")
    return mean.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(by, "rank", "token", F.round("score", 6).alias("score"))


#: Words up to which runs are counted without hashes, hashes of runs that a task holds, and those sent to every task at most.
FEW_WORDS, RUNS_HELD, SENT_HASHES = 10_000_000, 4_000_000, 5_000_000


def rake(docs: DataFrame, by: str, top: int = 8) -> DataFrame:
    """(by, rank, phrase, score): runs of two or three evidence tokens of a sentence. A word's degree is the number of
    other words in its sentences; a run scores the sum of its words' degrees over the sum of their frequencies, times how
    often it occurs. The end of a document ends a sentence.

    Most runs occur once, so of many words they are counted by hashes first, which are 4 bytes a run where rows are a hundred. As runs of
    one hash are counted together, the counts are upper bounds, and no run scores more than its count times the greatest
    degree over frequency of a word of its group. The exact scores of the most frequent give the least that counts; the
    runs that may reach it are counted and scored exactly, in the end by their words."""
    docs = docs.where(F.col(by).isNotNull())
    sentences = docs.select(by, F.explode(F.split("text", r"[.!?;]+")).alias("s")).select(by, T.evidence_tokens(F.col("s")).alias("w")).where(F.size("w") > 0)
    words = cut(sentences.select(by, F.size("w").alias("len"), F.explode("w").alias("word")).groupBy(by, "word").agg(F.count("*").alias("freq"), F.sum(F.col("len") - 1).alias("degree")))
    runs = lambda n: F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.slice("w", i + 1, n))
    rows = sentences.where(F.size("w") > 1).select(by, F.explode(F.when(F.size("w") > 2, F.concat(runs(2), runs(3))).otherwise(runs(2))).alias("run"))
    rows = rows.select(by, "run", (F.xxhash64("run").bitwiseAND(0xFFFFFFFF)).alias("h"))

    def exact(hashes: DataFrame | None) -> DataFrame:
        some = rows
        if hashes is not None:
            hashes = cut(hashes)
            some = rows.join(F.broadcast(hashes) if hashes.count() <= SENT_HASHES else hashes, [by, "h"], "left_semi")
        counts = some.groupBy(by, "run").agg(F.count("*").alias("n"))
        each = counts.select(by, "run", "n", F.explode("run").alias("word")).join(words, [by, "word"])
        return each.groupBy(by, "run").agg(F.round(F.max("n") * F.sum("degree") / F.sum("freq"), 6).alias("score")).select(by, F.array_join("run", " ").alias("phrase"), "score")

    def best(scored: DataFrame) -> DataFrame:
        order = Window.partitionBy(by).orderBy(F.desc("score"), "phrase")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    n_words = words.agg(F.sum("freq")).first()[0] or 0
    if n_words <= FEW_WORDS:
        return best(exact(None)).select(by, "rank", "phrase", "score")
    counted = cut(_hash_counts(rows.select(by, "h"), by, n_words))
    first = _unpacked(counted, by, 4 * top).withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "h"))).where(F.col("k") <= 4 * top)
    least = best(exact(first.select(by, "h"))).groupBy(by).agg(F.count("*").alias("found"), F.min("score").alias("least"))
    limits = words.groupBy(by).agg(F.max(F.col("degree") / F.col("freq")).alias("most")).join(least, by)
    limits = limits.select(by, F.when(F.col("found") < top, 0).otherwise(F.floor((F.col("least") - 1e-5) / F.col("most"))).cast("long").alias("n_least"))
    return best(exact(_unpacked(counted.join(F.broadcast(cut(limits)), by), by, None).select(by, "h"))).select(by, "rank", "phrase", "score")


def _hash_counts(rows: DataFrame, by: str, n_words: int) -> DataFrame:
    """(by, bucket, hashes, counts): of rows (by, h) with h of 32 bits how often each occurs, packed as unsigned integers.

    Tasks count before they send; buckets are parts of the range of h, so many that one fits a task."""
    kind = rows.schema[by].dataType
    bits = max(0, int(np.ceil(np.log2(max(1.0, 2 * n_words / RUNS_HELD)))))
    schema = StructType([StructField(by, kind), StructField("bucket", IntegerType()), StructField("hashes", BinaryType()), StructField("counts", BinaryType())])

    def packed(values, keys, counts):
        # keys: place in values above the hash, in order
        part = keys >> np.uint64(32 - bits)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(keys) else np.zeros(0, int)
        ends = np.append(starts[1:], len(keys))
        hashes, counts = keys.astype(np.uint32), counts.astype(np.uint32)
        return pa.RecordBatch.from_arrays([
            values.take(pa.array((keys[starts] >> np.uint64(32)).astype(np.int64))), pa.array((part[starts] & np.uint64((1 << bits) - 1)).astype(np.int32)),
            pa.array([hashes[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            pa.array([b"" if (counts[a:b] == 1).all() else counts[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
        ], names=schema.names)

    def sent(batches):
        seen: dict = {}
        held, size = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return packed(pa.array(list(seen), kind_), keys, counts)

        kind_ = None
        for batch in batches:
            coded = batch.column(by).dictionary_encode()
            kind_ = batch.schema.field(by).type
            place = np.array([seen.setdefault(v, len(seen)) for v in coded.dictionary.to_pylist()], np.uint64)
            if batch.num_rows:
                held.append(place[coded.indices.to_numpy()] << np.uint64(32) | batch.column("h").to_numpy().astype(np.uint64))
                size += batch.num_rows
            if size >= RUNS_HELD:
                yield flush()
                seen, held, size = {}, [], 0
        if held:
            yield flush()

    def added(group: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.frombuffer(h, np.uint32) for h in group["hashes"].to_pylist()])
        counts = np.concatenate([np.frombuffer(c, np.uint32) if c else np.ones(len(h) // 4, np.uint32) for h, c in zip(group["hashes"].to_pylist(), group["counts"].to_pylist())])
        found, at = np.unique(hashes, return_inverse=True)
        n = np.bincount(at, weights=counts, minlength=len(found)).astype(np.uint32)
        out = [group[by][:1].combine_chunks(), group["bucket"][:1].combine_chunks(), pa.array([found.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())]
        return pa.Table.from_arrays(out, names=schema.names)

    return rows.mapInArrow(sent, schema).groupBy(by, "bucket").applyInArrow(added, schema)


def _unpacked(counted: DataFrame, by: str, most: int | None) -> DataFrame:
    """(by, h, n) of packed counts: those of n_least or more, or of each pack the `most` greatest."""
    schema = StructType([counted.schema[by], StructField("h", LongType()), StructField("n", LongType())])

    def run(batches):
        for batch in batches:
            least = [0] * batch.num_rows if most else batch.column("n_least").to_pylist()
            for i in range(batch.num_rows):
                h, n = (np.frombuffer(batch.column(c)[i].as_py(), np.uint32).astype(np.int64) for c in ("hashes", "counts"))
                keep = np.argsort(-n, kind="stable")[:most] if most else np.flatnonzero(n >= least[i])
                yield pa.RecordBatch.from_arrays([batch.column(by).take(pa.array([i] * len(keep), pa.int64())), pa.array(h[keep]), pa.array(n[keep])], names=schema.names)

    return counted.mapInArrow(run, schema)


def representatives(docs: DataFrame, by: str, budget: int = 256, most: int = 4, dims: int | None = None) -> DataFrame:
    """(by, rank, id, tokens): examples of each group as far as the token budget goes; one at least.

    With dims, docs have vectors v of so many dimensions, and those nearest to their group's mean by cosine come first;
    without, or where the mean has no length, they come in the order of id."""
    rows = docs.select(by, "id", T.token_estimate(F.col("text")).alias("tokens"), (F.col("v") if dims else F.lit(None)).alias("v"))
    near = F.lit(0.0)
    if dims:
        rows = rows.join(rows.groupBy(by).agg(V.mean_vector(F.col("v"), dims).alias("mean")), by)
        near = F.round(F.when(V.norm(F.col("mean")) < 1e-12, 0.0).otherwise(V.cosine(F.col("v"), F.col("mean"))), 9)
    order = Window.partitionBy(by).orderBy(F.desc("near"), "id")
    rows = rows.select(by, "id", "tokens", near.alias("near")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    rows = rows.withColumn("used", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("used") <= budget) | (F.col("rank") == 1)).select(by, "rank", "id", "tokens")


def fallback_proposals(novel: DataFrame, min_samples: int = 3, examples: int = 3) -> DataFrame:
    """(name, confidence, sample_count, examples) for each predicted class of novel (id, text, predicted) with enough samples."""
    order = Window.partitionBy("predicted").orderBy("id")
    # the filter on the rank keeps few rows of each class before they are dealt
    first = novel.withColumn("n", F.row_number().over(order)).where(F.col("n") <= examples)
    first = first.groupBy("predicted").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("e"))
    out = novel.groupBy("predicted").agg(F.count("*").alias("sample_count")).where(F.col("sample_count") >= min_samples).join(first, "predicted")
    return out.select(F.concat(F.lit("Novel "), F.col("predicted").cast("string")).alias("name"), F.lit(0.5).alias("confidence"), "sample_count", F.transform("e", lambda x: x["text"]).alias("examples"))


def conflicts(proposals: DataFrame, limit: float = 0.3) -> DataFrame:
    """(a, b, overlap, kind, recommendation) of proposals (name, source_ids, examples, confidence, sample_count) that share
    sources or have similar names, a before b.

    Names are similar if they are equal without case and spaces, or one of three letters or more is within the other.
    Pairs meet on a shared source, on an equal name, or on the first three letters of the one and any three of the other,
    so that only those are compared. overlap is the greater of the Jaccard similarities of sources and of examples; a pair
    with less than limit is a duplicate by name. Of a duplicate the more confident stays, of nested ones the one with more
    sources, else a only if it has no less confidence and samples."""
    plain = F.translate(F.lower("name"), " ", "")
    none = F.array().cast("array<string>")
    rows = proposals.select("name", F.array_distinct(F.coalesce("source_ids", none.cast(proposals.schema["source_ids"].dataType))).alias("ids"), F.array_distinct(F.coalesce("examples", none)).alias("ex"), "confidence", "sample_count", plain.alias("plain"))
    long = F.length("plain") > 2
    common = F.concat(F.transform("ids", lambda s: F.concat(F.lit("s:"), s.cast("string"))), F.array(F.concat(F.lit("n:"), "plain")))
    inner = F.concat(common, F.when(long, F.array(F.concat(F.lit("g:"), F.left("plain", F.lit(3))))).otherwise(none))
    outer = F.concat(common, F.transform(F.array_distinct(T.char_ngrams(F.col("plain"), 3)), lambda g: F.concat(F.lit("g:"), g)))
    keys = lambda key, n: rows.select(F.col("name").alias(n), F.explode(key).alias("key"))
    met = keys(inner, "x").join(keys(outer, "y"), "key").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    named = lambda s: rows.select(*[F.col(c).alias(s if c == "name" else f"{c}_{s}") for c in rows.columns])
    both = met.join(named("a"), "a").join(named("b"), "b")
    c = F.col
    shared = F.size(F.array_intersect("ids_a", "ids_b"))
    similar = (c("plain_a") == c("plain_b")) | ((F.length("plain_a") > 2) & (F.length("plain_b") > 2) & (c("plain_a").contains(c("plain_b")) | c("plain_b").contains(c("plain_a"))))
    both = both.withColumns({"by_source": F.round(T.jaccard(c("ids_a"), c("ids_b")), 6), "by_example": F.round(T.jaccard(c("ex_a"), c("ex_b")), 6), "shared": shared, "similar": similar})
    little = (c("by_source") < limit) & (c("by_example") < limit)
    both = both.where(((c("shared") > 0) | c("similar")) & (~little | c("similar")))
    one_empty = (F.size("ids_a") == 0) | (F.size("ids_b") == 0)
    same = (F.size("ids_a") == c("shared")) & (F.size("ids_b") == c("shared"))
    nested = (c("shared") > 0) & ((c("shared") == F.size("ids_a")) | (c("shared") == F.size("ids_b")))
    kind = F.when(little, "duplicate").when(one_empty, "partial").when(same, "duplicate").when(nested, "nested").otherwise("partial")
    out = both.withColumn("kind", kind).withColumn("overlap", F.when(little, 1.0).otherwise(F.greatest("by_source", "by_example")))
    first = F.when(c("kind") == "duplicate", c("confidence_a") >= c("confidence_b")).when(c("kind") == "nested", F.size("ids_a") >= F.size("ids_b")).otherwise((c("confidence_a") >= c("confidence_b")) & (c("sample_count_a") >= c("sample_count_b")))
    return out.select("a", "b", "overlap", "kind", F.when(F.coalesce(first, F.lit(False)), "keep_a").otherwise("keep_b").alias("recommendation"))


def resolved(proposals: DataFrame, limit: float = 0.3) -> DataFrame:
    """proposals without those that a conflict's recommendation gives up."""
    found = conflicts(proposals, limit)
    gone = found.select(F.when(F.col("recommendation") == "keep_a", F.col("b")).otherwise(F.col("a")).alias("name")).distinct()
    return proposals.join(gone, "name", "left_anti").select(*proposals.columns)


def moved(reviews: DataFrame, requests: DataFrame) -> DataFrame:
    """reviews (review_id, state) after requests (review_id, to): allowed moves happen, others leave ok false."""
    allowed = F.create_map(*[x for s, to in TRANSITIONS.items() for x in (F.lit(s), F.array(*[F.lit(t) for t in to]))])
    rows = reviews.join(requests, "review_id", "left")
    ok = F.array_contains(allowed[F.col("state")], F.col("to"))
    return rows.select("review_id", F.when(ok, F.col("to")).otherwise(F.col("state")).alias("state"), F.when(F.col("to").isNotNull(), F.coalesce(ok, F.lit(False))).alias("ok"))


def upserted(store: DataFrame, changes: DataFrame, key: str = "review_id") -> DataFrame:
    """store with the rows of changes instead of those with the same key."""
    return store.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def promoted(reviews: DataFrame) -> DataFrame:
    """(id, name, aliases) entities of promoted reviews (proposal_name, state)."""
    name = F.col("proposal_name")
    return reviews.where("state = 'promoted'").select(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_").alias("id"), name.alias("name"), F.array().cast("array<string>").alias("aliases"))


# ---- active learning ----------------------------------------------------------------


def uncertainty_sample(predicted: DataFrame, n: int, method: str = "margin") -> DataFrame:
    """The n rows of predicted (query_id, confidence, probabilities) that are least certain, by rank."""
    top = F.sort_array("probabilities", asc=False)
    scores = {"least_confident": 1 - F.col("confidence"), "margin": 1 - (F.get(top, F.lit(0)) - F.get(top, F.lit(1))), "entropy": V.entropy(F.col("probabilities"))}
    if method not in scores:
        raise ValueError(f"no method {method!r}")
    rows = predicted.select("query_id", F.round(F.coalesce(scores[method], 1 - F.col("confidence")), 6).alias("uncertainty"))
    return rows.orderBy(F.desc("uncertainty"), "query_id").limit(n)


def annotated(annotations: DataFrame, entities: DataFrame) -> DataFrame:
    """(kind, n): what annotations (text, label) do: novel:X adds an entity and a training row, a known label a training
    row, any other nothing."""
    known = entities.select(F.col("id").alias("label"), F.lit(True).alias("known"))
    rows = annotations.join(known, "label", "left")
    kind = F.when(F.col("label").startswith("novel:"), "new_entity").when(F.col("known"), "training").otherwise("unknown_label")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# ---- drift --------------------------------------------------------------------------


def _mean(rows: DataFrame, dims: int, name: str) -> DataFrame:
    return rows.agg(V.mean_vector(F.col("v"), dims).alias(name))


def mean_drift(base: DataFrame, current: DataFrame, dims: int) -> DataFrame:
    """One row, mmd_linear and cosine_centroid, of two tables of vectors."""
    both = _mean(base, dims, "b").join(F.broadcast(_mean(current, dims, "c")), how="inner")
    gap = F.zip_with("b", "c", lambda x, y: y - x)
    return both.select(F.round(V.dot(gap, gap), 6).alias("mmd_linear"), F.round(1 - V.cosine(F.col("b"), F.col("c")), 6).alias("cosine_centroid"))


def class_drift(base: DataFrame, current: DataFrame, dims: int) -> DataFrame:
    """(label, drift): cosine distance of the class means."""
    side = lambda df, n: df.groupBy("label").agg(V.mean_vector(F.col("v"), dims).alias(n))
    return side(base, "b").join(side(current, "c"), "label").select("label", F.round(1 - V.cosine(F.col("b"), F.col("c")), 6).alias("drift"))


def kl_gaussian(base: DataFrame, current: DataFrame, dims: int, ridge: float = 1e-6) -> float:
    """Divergence of two Gaussians: moments by Spark, d x d algebra on the driver; not below 0."""
    def moments(df):
        n, s, q = scatter(df, dims)[None]
        m = s / n
        return m, (q - n * np.outer(m, m)) / max(n - 1, 1) + ridge * np.eye(dims)

    (m0, s0), (m1, s1) = moments(base), moments(current)
    inv, gap = np.linalg.inv(s0), m1 - m0
    return max(0.0, 0.5 * float(np.trace(inv @ s1) + gap @ inv @ gap - dims + np.linalg.slogdet(s0)[1] - np.linalg.slogdet(s1)[1]))


def recommendation(score: Column, threshold: float) -> Column:
    return F.when(score <= threshold, "monitor").when(score > 3 * threshold, "retrain").otherwise("add_entities")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
