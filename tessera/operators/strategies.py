"""Out-of-distribution strategies. Each takes queries (query_id, v, ...) and references (ref_id, v, label) and returns
(query_id, <metrics>, is_novel); a registry holds them by name."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import matching as M
from tessera.operators.matching import matrix
from tessera.operators.order import cut, percentile, running

STRATEGIES: dict[str, Callable] = {}
#: Weights of the parts of the pattern score.
PATTERN_WEIGHTS = [0.25, 0.2, 0.15, 0.1, 0.15, 0.15]


def strategy(name: str):
    """Registers a strategy under an unused name."""

    def register(f):
        if name in STRATEGIES:
            raise ValueError(f"strategy {name!r} is already there")
        STRATEGIES[name] = f
        return f

    return register


@strategy("confidence")
def confidence(predicted: DataFrame, threshold: float = 0.7) -> DataFrame:
    """predicted (query_id, confidence)."""
    return predicted.select("query_id", F.round("confidence", 6).alias("confidence"), (F.round("confidence", 6) < threshold).alias("is_novel"))


@strategy("knn_distance")
def knn_distance(queries: DataFrame, refs: DataFrame, k: int = 20, threshold: float = 0.55, skip_same: bool = False) -> DataFrame:
    near = M.nearest(queries, refs, k, skip_same=skip_same)
    rows = near.groupBy("query_id").agg(F.round(F.avg(1 - F.col("score")), 6).alias("mean_distance"), F.round(F.max(1 - F.col("score")), 6).alias("max_distance"))
    return rows.withColumn("is_novel", F.col("mean_distance") >= threshold)


@strategy("uncertainty")
def uncertainty(predicted: DataFrame, margin_threshold: float = 0.3, entropy_threshold: float = 1.5) -> DataFrame:
    """predicted (query_id, probabilities)."""
    top = F.sort_array("probabilities", asc=False)
    margin = F.round(F.get(top, F.lit(0)) - F.coalesce(F.get(top, F.lit(1)), F.lit(0.0)), 6)
    entropy = F.round(V.entropy(F.col("probabilities")), 6)
    return predicted.select("query_id", margin.alias("margin"), entropy.alias("entropy"), (1 - margin).alias("score"), ((margin < margin_threshold) | (entropy > entropy_threshold)).alias("is_novel"))


def own_class_threshold(refs: DataFrame, means: DataFrame, share: float = 0.95) -> float:
    """The percentile of references' cosine distances to their own class mean; 0.5 without references."""
    own = refs.join(means.select("label", "mean"), "label").select((1 - V.cosine(F.col("v"), F.col("mean"))).alias("d"))
    got = percentile(own, "d", share)
    return 0.5 if got is None else got


def _nearest_mean(queries: DataFrame, means: DataFrame) -> DataFrame:
    """(query_id, label, distance) of the nearest class mean by cosine distance."""
    rows = M.against_classes(queries, means, [], distance=True)
    best = F.array_min(F.transform("scores", lambda s: F.struct(F.round(s["score"], 9).alias("d"), s["label"].alias("label"))))
    return rows.select("query_id", best["label"].alias("label"), best["d"].alias("distance"))


@strategy("setfit_centroid")
def centroid(queries: DataFrame, refs: DataFrame, dims: int, threshold: float | None = None) -> DataFrame:
    means = M.class_means(refs, dims)
    limit = own_class_threshold(refs, means) if threshold is None else threshold
    score = 1 / (1 + F.exp(-10 * (F.col("distance") - limit)))
    rows = _nearest_mean(queries, means)
    return rows.select("query_id", "label", F.round("distance", 6).alias("distance"), F.round(score, 6).alias("score"), (F.col("distance") > limit).alias("is_novel"))


@strategy("setfit")
def pairwise_margin(queries: DataFrame, refs: DataFrame, share: float = 0.95) -> DataFrame:
    """Least distance to any reference against the percentile of the references' own least distances; the score rises
    with the distance."""
    own = M.nearest(refs.select(F.col("ref_id").alias("query_id"), "v"), refs, 1, skip_same=True).select((1 - F.col("score")).alias("d"))
    limit = percentile(own, "d", share) or 0.5
    rows = M.nearest(queries, refs, 1).select("query_id", (1 - F.col("score")).alias("d"))
    return rows.select("query_id", F.round("d", 6).alias("distance"), F.round(1 / (1 + F.exp(-5 * (F.col("d") - limit))), 6).alias("score"), (F.col("d") > limit).alias("is_novel"))


@strategy("prototypical")
def prototypical(queries: DataFrame, refs: DataFrame, dims: int, threshold: float = 0.5) -> DataFrame:
    rows = _nearest_mean(queries, M.class_means(refs, dims))
    return rows.select("query_id", "label", F.round("distance", 6).alias("distance"), F.round(F.least(F.col("distance") / threshold, F.lit(1.0)), 6).alias("score"), (F.col("distance") > threshold).alias("is_novel"))


def energies(queries: DataFrame, means: DataFrame, temperature: float = 1.0, scale: float = 25.0) -> DataFrame:
    """(query_id, energy): -T * logsumexp(scale * cosine / T) over class means."""
    rows = M.against_classes(queries, means, [])
    return rows.select("query_id", (-temperature * V.logsumexp(F.transform("scores", lambda s: s["score"] * scale / temperature))).alias("energy"))


@strategy("energy_ood")
def energy(queries: DataFrame, refs: DataFrame, dims: int, temperature: float = 1.0, scale: float = 25.0, deviations: float = 2.0) -> DataFrame:
    means = M.class_means(refs, dims)
    own = energies(refs.select(F.col("ref_id").alias("query_id"), "v"), means, temperature, scale).agg(F.avg("energy").alias("m"), F.stddev_pop("energy").alias("s")).first()
    limit = own["m"] + deviations * own["s"]
    return energies(queries, means, temperature, scale).select("query_id", F.round("energy", 6).alias("energy"), (F.col("energy") > limit).alias("is_novel"))


def trimmed(rows: DataFrame, share: float) -> DataFrame:
    """v clipped to the percentile of all values of the batch."""
    limit = percentile(rows.select(F.explode("v").alias("x")), "x", share)
    return rows.withColumn("v", F.transform("v", lambda x: F.least(x, F.lit(limit)))) if limit is not None else rows


@strategy("react_energy")
def react_energy(queries: DataFrame, refs: DataFrame, dims: int, share: float = 0.9, **energy_args) -> DataFrame:
    return energy(trimmed(queries, share), trimmed(refs, share), dims, **energy_args)


@strategy("clustering")
def clustering(queries: DataFrame, refs: DataFrame, dims: int, min_size: int = 5, cohesion_limit: float = 0.45, noise_percentile: float = 0.9, cohesive_too: bool = True) -> DataFrame:
    """Nearest reference cluster; far ones of the batch are noise, and clusters too small or too loose support nothing.

    cohesive_too: those of cohesive clusters are novel as well, so that all are but those of a cohesion that equals the
    limit; without it, members of valid clusters are known."""
    means = M.class_means(refs, dims)
    cohesion = class_cohesion(refs, dims).select("label", "n", "cohesion")
    rows = _nearest_mean(queries, means)
    limit = percentile(rows, "distance", noise_percentile)
    rows = rows.join(cohesion, "label")
    noise = F.col("distance") > F.lit(limit)
    valid = (F.col("n") >= min_size) & (F.col("cohesion") >= cohesion_limit)
    return rows.select("query_id", F.when(noise, F.lit(-1)).otherwise(F.col("label")).alias("cluster"), F.round("distance", 6).alias("distance"), F.round("cohesion", 6).alias("cohesion"), (noise | ~valid | (F.lit(cohesive_too) & (F.col("cohesion") > cohesion_limit))).alias("is_novel"))


def class_cohesion(rows: DataFrame, dims: int, label: str = "label") -> DataFrame:
    """(label, n, cohesion): mean cosine of distinct members, from the sum of unit vectors in one pass."""
    units = rows.select(label, V.unit(F.col("v")).alias("u"))
    sums = units.groupBy(label).agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("u", F.lit(i))) for i in range(dims)]).alias("s"))
    n = F.col("n")
    return sums.select(label, "n", F.when(n < 2, 0.0).otherwise((V.dot(F.col("s"), F.col("s")) - n) / (n * (n - 1))).alias("cohesion"))


@strategy("lof")
def local_outlier_factor(queries: DataFrame, refs: DataFrame, k: int = 20, threshold: float = -1.5) -> DataFrame:
    """Exact local outlier factor by cosine distance; score_samples = -factor, novel below threshold."""
    own = M.nearest(refs.select(F.col("ref_id").alias("query_id"), "v"), refs, k, skip_same=True).select("query_id", "ref_id", (1 - F.col("score")).alias("d"))
    k_dist = own.groupBy("query_id").agg(F.max("d").alias("kd")).withColumnRenamed("query_id", "ref_id")
    density = _density(own, k_dist).withColumnsRenamed({"query_id": "ref_id", "lrd": "ref_lrd"})
    near = M.nearest(queries, refs, k).select("query_id", "ref_id", (1 - F.col("score")).alias("d"))
    rows = near.join(density, "ref_id").groupBy("query_id").agg(F.avg("ref_lrd").alias("mean_lrd")).join(_density(near, k_dist), "query_id")
    score = F.round(-F.col("mean_lrd") / F.col("lrd"), 5)
    return rows.select("query_id", score.alias("score"), (score < threshold).alias("is_novel"))


def _density(near: DataFrame, k_dist: DataFrame) -> DataFrame:
    reach = near.join(k_dist, "ref_id").withColumn("reach", F.greatest("d", "kd"))
    return reach.groupBy("query_id").agg((1 / (F.avg("reach") + 1e-10)).alias("lrd"))


@strategy("pattern")
def pattern(queries: DataFrame, corpus: DataFrame, threshold: float = 0.5, by_case: bool = False) -> DataFrame:
    """Surface novelty of queries (query_id, text) against known texts (text).

    Parts, in this order: shares of unseen 3-grams and 4-grams, how far the length is out of the known range, letter case,
    rarity of the first and of the last three characters. A part that a text doesn't have (grams of short texts, length
    where all are equal, ends where no text has three characters) is left out, and the remaining parts take the first
    weights, scaled to a sum of 1. The case part is 0.7 for every text; by_case: 0 for a case that known texts have, else
    0.3. An empty text scores 1."""
    known = corpus.select(F.col("text")).where("text is not null")
    trimmed = known.select(F.trim("text").alias("text"))
    stats = known.agg(F.min(F.length("text")).alias("low"), F.max(F.length("text")).alias("high")).first()
    ended = trimmed.where(F.length("text") >= 3).count()
    rows = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    for n in (3, 4):
        seen = trimmed.select(F.explode(T.char_ngrams(F.col("text"), n)).alias("g")).distinct()
        grams = rows.select("query_id", F.explode(F.array_distinct(T.char_ngrams(F.trim("text"), n))).alias("g"))
        share = grams.join(seen.withColumn("known", F.lit(1)), "g", "left").groupBy("query_id").agg((1 - F.sum(F.coalesce("known", F.lit(0))) / F.count("*")).alias(f"new{n}"))
        rows = rows.join(share, "query_id", "left")
    for side, cut in (("prefix", F.left), ("suffix", F.right)):
        freq = trimmed.where(F.length("text") >= 3).groupBy(cut("text", F.lit(3)).alias(f"k_{side}")).agg((F.count("*") / F.lit(max(ended, 1))).alias(f"f_{side}"))
        rows = rows.withColumn(f"k_{side}", cut("text", F.lit(3))).join(freq, f"k_{side}", "left")
    size, low, high = F.length("text"), stats["low"] or 0, stats["high"] or 0
    out_of_range = F.when(size < low, (low - size) / max(low, 1)).when(size > high, (size - high) / max(high, 1)).otherwise(0.0)
    case = F.lit(0.7)
    if by_case:
        cases = [r[0] for r in known.select(T.letter_case(F.col("text"))).distinct().collect()]  # four at most
        case = F.when(T.letter_case(F.col("text")).isin(cases), 0.0).otherwise(0.3)
    rare = lambda side: 1 - F.coalesce(f"f_{side}", F.lit(0.0)) if ended else F.lit(None).cast("double")
    length = F.least(out_of_range, F.lit(1.0)) if high > low else F.lit(None).cast("double")
    parts = F.filter(F.array("new3", "new4", length, case, rare("prefix"), rare("suffix")), lambda x: x.isNotNull())
    weights = F.slice(F.array(*[F.lit(w) for w in PATTERN_WEIGHTS]), F.lit(1), F.size(parts))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    score = F.when(size == 0, 1.0).otherwise(V.clip(total(F.zip_with(parts, weights, lambda x, w: x * w)) / total(weights)))
    return rows.select("query_id", F.round(score, 6).alias("score"), (F.round(score, 6) >= threshold).alias("is_novel"))


# ---- Gaussian strategies: moments by Spark, d x d algebra on the driver -------------


def scatter(rows: DataFrame, dims: int, by: str | None = None, most_bytes: int = 1 << 30) -> dict:
    """{key: (n, sum, sum of outer products)}. Partial sums of each partition are added in two steps, so that one d x d
    matrix for each key comes to the driver, however many partitions there are; ValueError beyond most_bytes of them."""
    cols = [by] if by else []
    schema = "key string, salt int, n long, s array<double>, q array<double>"

    def sums(batches):
        found: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(pa.chunked_array([batch.column("v")]))
            keys = batch.column(by).to_pylist() if by else [None] * len(x)
            order: dict = {}
            for i, key in enumerate(keys):
                order.setdefault(key, []).append(i)
            for key, at in order.items():
                part = x[at]
                n, s, q = found.get(key, (0, 0.0, 0.0))
                found[key] = (n + len(part), s + part.sum(0), q + part.T @ part)
        salt = TaskContext.get().partitionId() % 64
        for key, (n, s, q) in found.items():
            yield pa.RecordBatch.from_pylist([{"key": None if key is None else str(key), "salt": salt, "n": n, "s": s.tolist(), "q": q.ravel().tolist()}], schema=types)

    def added(group: pa.Table) -> pa.Table:
        s, q = (matrix(group[c]).sum(0) for c in ("s", "q"))
        return pa.Table.from_pylist([{"key": group["key"][0].as_py(), "salt": 0, "n": sum(group["n"].to_pylist()), "s": s.tolist(), "q": q.tolist()}], schema=types)

    types = pa.schema([("key", pa.string()), ("salt", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64())), ("q", pa.list_(pa.float64()))])
    parts = rows.select(*cols, V.dbl(F.col("v")).alias("v")).mapInArrow(sums, schema)
    whole = parts.groupBy("key", "salt").applyInArrow(added, schema).groupBy("key").applyInArrow(added, schema)
    keys = rows.agg(F.approx_count_distinct(by)).first()[0] if by else 1
    if keys * dims * dims * 8 > most_bytes:
        raise ValueError(f"about {keys} matrices of {dims} x {dims} are too many for the driver")
    return {r["key"]: (r["n"], np.array(r["s"]), np.array(r["q"]).reshape(dims, dims)) for r in whole.collect()}


def pooled(moments: dict, ridge: float) -> tuple[dict, np.ndarray]:
    """({class: mean}, inverse of the pooled within-class covariance)."""
    means = {k: s / n for k, (n, s, _) in moments.items()}
    total = sum(n for n, _, _ in moments.values())
    within = sum(q - n * np.outer(means[k], means[k]) for k, (n, _, q) in moments.items()) / max(total - len(moments), 1)
    return means, np.linalg.inv(within + ridge * np.eye(len(within)))


def _scored(queries: DataFrame, keep: list[str], f) -> DataFrame:
    """queries with value = f(matrix, frame), in Arrow batches."""

    def run(batches):
        for pdf in batches:
            out = pdf[["query_id"]].copy()
            out["value"] = f(np.array(pdf["v"].tolist(), np.float64), pdf) if len(pdf) else []
            yield out

    return queries.select("query_id", "v", *keep).mapInPandas(run, "query_id long, value double")


@strategy("mahalanobis")
def mahalanobis(queries: DataFrame, refs: DataFrame, dims: int, threshold: float = 3.0, ridge: float = 1e-4) -> DataFrame:
    """Distance to the mean of the predicted class, of all class means if that is unseen; queries have `predicted`."""
    means, inverse = pooled(scatter(refs, dims, "label"), ridge)
    fallback = np.mean(list(means.values()), axis=0)

    def value(x, pdf):
        d = x - np.array([means.get(str(p), fallback) for p in pdf["predicted"]])
        return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, inverse, d), 0))

    m = F.round("value", 6)
    return _scored(queries, ["predicted"], value).select("query_id", m.alias("distance"), F.round(1 - F.exp(-m / threshold), 6).alias("score"), (m >= threshold).alias("is_novel"))


@strategy("mixture_gaussian")
def mixture_gaussian(queries: DataFrame, refs: DataFrame, dims: int, ridge: float = 1e-6, deviations: float = 2.0, priors: bool = True) -> DataFrame:
    """Best class log-likelihood under one Gaussian for each class."""
    moments = scatter(refs, dims, "label")
    total = sum(n for n, _, _ in moments.values())
    parts = []
    for n, s, q in moments.values():
        mean = s / n
        cov = (q - n * np.outer(mean, mean)) / max(n - 1, 1) + ridge * np.eye(dims)
        parts.append((mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1], np.log(n / total) if priors else 0.0))

    def value(x, _pdf):
        lls = [-0.5 * (np.einsum("ij,jk,ik->i", x - m, i, x - m) + logdet + dims * np.log(2 * np.pi)) + p for m, i, logdet, p in parts]
        return np.max(lls, axis=0)

    own = _scored(refs.select(F.col("ref_id").alias("query_id"), "v"), [], value).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).first()
    limit = own["m"] - deviations * own["s"]
    return _scored(queries, [], value).select("query_id", F.round("value", 4).alias("log_likelihood"), (F.col("value") < limit).alias("is_novel"))


def _sample(refs: DataFrame, limit: int) -> np.ndarray:
    """At most limit reference vectors, those of the least hash, in the order of ref_id."""
    rows = refs.select("ref_id", "v").orderBy(F.xxhash64("ref_id"), "ref_id").limit(limit).toPandas().sort_values("ref_id")
    return np.array(rows["v"].tolist(), np.float64)


@strategy("self_knowledge")
def self_knowledge(queries: DataFrame, refs: DataFrame, hidden: int = 128, threshold: float = 0.5, epochs: int = 100, batch: int = 32, rate: float = 1e-3, sparsity: float = 0.1, max_fit: int = 20_000) -> DataFrame:
    """Reconstruction error of a sparse autoencoder, scaled to 0..1 over the batch; fitted on at most max_fit references."""
    x = _sample(refs, max_fit)
    rng = np.random.default_rng(42)
    d = x.shape[1]
    w1, w2 = (rng.normal(0, np.sqrt(2 / (d + hidden)), s) for s in ((d, hidden), (hidden, d)))
    b1, b2 = np.zeros(hidden), np.zeros(d)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            xb = x[order[at : at + batch]]
            h = 1 / (1 + np.exp(-(xb @ w1 + b1)))
            e = 2 * (h @ w2 + b2 - xb) / len(xb)
            rho = np.clip(h.mean(0), 1e-6, 1 - 1e-6)
            back = (e @ w2.T + 0.001 * (-sparsity / rho + (1 - sparsity) / (1 - rho)) / len(xb)) * h * (1 - h)
            w2 -= rate * 10 * h.T @ e
            b2 -= rate * 10 * e.sum(0)
            w1 -= rate * 10 * xb.T @ back
            b1 -= rate * 10 * back.sum(0)

    def value(v, _pdf):
        return ((1 / (1 + np.exp(-(v @ w1 + b1))) @ w2 + b2 - v) ** 2).mean(axis=1)

    rows = _scored(queries, [], value)
    lo, hi = rows.agg(F.min("value"), F.max("value")).first()
    score = F.round((F.col("value") - lo) / (hi - lo), 6) if lo is not None and hi > lo else F.lit(0.0)
    return rows.select("query_id", score.alias("score"), (score >= threshold).alias("is_novel"))


@strategy("oneclass")
def oneclass(queries: DataFrame, refs: DataFrame, nu: float = 0.1, sweeps: int = 200, max_fit: int = 2_000) -> DataFrame:
    """One-class support vector machine with an RBF kernel, gamma 1 / (dims * variance), solved by pairwise descent on
    at most max_fit references."""
    x = _sample(refs, max_fit)
    n = len(x)
    gamma = 1 / (x.shape[1] * x.var()) if x.var() > 0 else 1.0
    kernel = lambda a, b: np.exp(-gamma * np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))
    k, cap = kernel(x, x), 1 / (nu * n)
    alpha = np.zeros(n)
    full = int(nu * n)
    alpha[:full] = cap
    if full < n:
        alpha[full] = 1 - full * cap
    g = k @ alpha
    for _ in range(sweeps * n):
        up, down = np.where(alpha < cap - 1e-12, g, np.inf).argmin(), np.where(alpha > 1e-12, g, -np.inf).argmax()
        if g[down] - g[up] < 1e-6:
            break
        step = min((g[down] - g[up]) / max(k[up, up] + k[down, down] - 2 * k[up, down], 1e-12), cap - alpha[up], alpha[down])
        alpha[up] += step
        alpha[down] -= step
        g += step * (k[:, up] - k[:, down])
    free = (alpha > 1e-9) & (alpha < cap - 1e-9)
    rho = g[free].mean() if free.any() else g[alpha > 1e-9].mean()
    support, weights = x[alpha > 1e-9], alpha[alpha > 1e-9]
    rows = _scored(queries, [], lambda v, _: kernel(v, support) @ weights - rho)
    return rows.select("query_id", F.round(V.clip(-F.col("value")), 6).alias("score"), (F.col("value") < 0).alias("is_novel"))


# ---- conformal calibration ----------------------------------------------------------


def calibration_split(refs: DataFrame, id_: str = "ref_id", share: int = 20) -> Column:
    """The rows held out for calibration: share of 100 by the hash of their id."""
    return F.conv(F.substring(F.md5(refs[id_].cast("string")), 1, 8), 16, 10).cast("long") % 100 < share


def p_values(tests: DataFrame, calibration: DataFrame, by: str | None = None) -> DataFrame:
    """(id, p): (calibration scores not below a test's score + 1) / (calibration scores + 1).

    Both have score, tests also id; with `by` each class is calibrated by itself, and one without calibration by all.
    Exact over all rows: distinct scores are counted, dealt by range and added up within and then over the ranges. Null
    scores count as the greatest."""
    score = F.coalesce(F.col("score").cast("double"), F.lit(float("nan"))).alias("score")
    of = (F.col(by) if by else F.lit(None)).cast("string").alias("of")
    cal = calibration.select(of, score).groupBy("of", "score").agg(F.count("*").alias("n"))
    # own: a class by itself, else all
    counts = cal.select(F.lit(False).alias("own"), F.lit("").alias("class"), "score", "n")
    rows = tests.select(F.col("id").cast("long").alias("id"), of, score)
    if by:
        classes = cal.where("of is not null").select("of").distinct().withColumn("known", F.lit(True))
        counts = counts.unionByName(cal.where("of is not null").select(F.lit(True).alias("own"), F.col("of").alias("class"), "score", "n"))
        rows = rows.join(classes, "of", "left").withColumn("own", F.col("known").isNotNull())
    else:
        rows = rows.withColumn("own", F.lit(False))
    rows = cut(rows.select("id", "own", F.when(F.col("own"), F.col("of")).otherwise(F.lit("")).alias("class"), "score"))
    key = ["own", "class"]
    marks = counts.unionByName(rows.select(*key, "score", F.lit(0).cast("long").alias("n"))).groupBy(*key, "score").agg(F.sum("n").alias("n"))
    above = running(marks, key, [F.desc("score")], {"above": F.col("n")})
    sizes = counts.groupBy(*key).agg(F.sum("n").alias("size"))
    return rows.join(above.select(*key, "score", "above"), [*key, "score"]).join(sizes, key, "left").select("id", ((F.col("above") + 1) / (F.coalesce("size", F.lit(0)) + 1)).alias("p"))
