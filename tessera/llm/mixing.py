"""Mixing to target weights by soft membership, in DataFrame operations only.

A classifier learned from the labels table gives every document a posterior over domains. Non-negative rates, one for
each document, are then fitted by projected-gradient least squares so that the expected tokens of each domain, the sum
of rate * tokens * posterior, match their targets. A document's step depends on its posterior alone, so the gradient
runs over the cells of a grid of rounded posteriors, and the rates follow from the residuals of all steps.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from math import comb, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed values of the mixing query: the share of the tokens that each domain of the labels table shall have.
TARGETS = {"good": 0.96, "junk": 0.02, "toxic": 0.02}
#: Cells that one task walks in a step; a grid of 256 has 33,153 of three domains, however many documents there are.
FEW_CELLS = 1 << 16
_SPACE = r"[\x20\x09-\x0D]+"


def domain(quality: Column, toxic: Column) -> Column:
    """The domain of a row of labels."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").otherwise("junk")


def _words(docs: DataFrame) -> DataFrame:
    """doc_id and the words of each text, A-Z lower-cased."""
    low = F.translate(F.coalesce(docs["text"].cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.filter(F.split(low, _SPACE), lambda w: w != "").alias("words"))


def _buckets(buckets: int) -> Column:
    """A bucket for each distinct word."""
    return F.transform(F.array_distinct("words"), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def learn(docs: DataFrame, labels: DataFrame, domains: list[str], buckets: int, max_labelled: int, smoothing: float = 200.0) -> tuple[list[float], dict[str, list[float]]]:
    """(log priors, log odds by bucket of each domain against the first) of a Bernoulli-like model over distinct words.

    Fitted on at most max_labelled labelled documents, those of the least hash; the table that comes to the driver has
    a row for each bucket."""
    named = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), domain(F.col("quality"), F.col("toxic")).alias("domain")).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = _words(docs).join(F.broadcast(chosen), "doc_id")
    is_of = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains)]
    words = sample.select("domain", F.explode(F.concat(_buckets(buckets), F.array(F.lit(-1)))).alias("bucket"))
    counts = {r["bucket"]: [r[f"n{k}"] for k in range(len(domains))] for r in words.groupBy("bucket").agg(*is_of).collect()}
    n = counts.pop(-1, [0] * len(domains))  # documents
    total = [sum(c[k] for c in counts.values()) for k in range(len(domains))]
    everything = sum(total)
    none = [0] * len(domains)

    def rate(b: int, k: int) -> float:
        """Smoothed towards all domains together, so that a word that a small domain lacks tells little."""
        c = counts.get(b, none)
        return log((c[k] + smoothing * (sum(c) + 1) / (everything + buckets)) / (total[k] + smoothing))

    priors = [log((n[k] + 1) / (sum(n) + len(domains))) for k in range(len(domains))]
    odds = {d: [rate(b, k) - rate(b, 0) for b in range(buckets)] for k, d in enumerate(domains) if k}
    return priors, odds


def _array(values: list[float]) -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def posteriors(docs: DataFrame, labels: DataFrame, domains: list[str], buckets: int = 1 << 14, max_labelled: int = 20_000, sharpness: float = 50.0, grid: int | None = 256) -> DataFrame:
    """doc_id, n_tokens and for each domain its share of grid, as a whole number (of 1 and as it is, without a grid), for
    every row of docs.

    The log odds are summed over a text's distinct words, as if it had at most `sharpness` of them, so that long texts
    don't become certain by length alone. A text without words has the priors."""
    priors, odds = learn(docs, labels, domains, buckets, max_labelled)
    rows = _words(docs).select("doc_id", F.size("words").cast("long").alias("n_tokens"), _buckets(buckets).alias("words"))
    scale = F.least(F.lit(1.0), F.lit(sharpness) / F.greatest(F.size("words"), F.lit(1)))
    def summed(weights: Column) -> Column:
        return F.aggregate("words", F.lit(0.0), lambda a, w: a + F.get(weights, w))

    sums = [F.lit(0.0)] + [summed(_array(odds[d])) for d in domains[1:]]
    rows = rows.select("doc_id", "n_tokens", *[(F.lit(priors[k]) + scale * s).alias(f"z{k}") for k, s in enumerate(sums)])
    top = F.greatest(*[F.col(f"z{k}") for k in range(len(domains))])
    exps = [F.exp(F.col(f"z{k}") - top) for k in range(len(domains))]
    total = reduce(lambda a, b: a + b, exps)
    if grid is None:
        return rows.select("doc_id", "n_tokens", *[(e / total).alias(f"g{k}") for k, e in enumerate(exps)])
    rows = rows.select("doc_id", "n_tokens", *[F.round(grid * e / total).cast("int").alias(f"g{k}") for k, e in enumerate(exps) if k])
    # the first domain has the rest, so that the shares add up to grid
    rest = F.lit(grid) - reduce(lambda a, b: a + b, [F.col(f"g{k}") for k in range(1, len(domains))])
    return rows.withColumn("g0", rest)


def _rate(p: list[Column], taken: list[list[float]]) -> Column:
    """The rate after the steps taken, from 1; each is its residuals times the length of a step.

    The steps are one constant array that is walked, so that every plan is alike and none grows with the steps: nested in
    each other, they would be compiled and printed anew by the driver for each step, and longer each time."""
    if not taken:
        return F.lit(1.0)
    steps = F.array(*[F.array(*map(F.lit, step)) for step in taken])
    return F.aggregate(steps, F.lit(1.0), lambda r, o: F.greatest(F.lit(0.0), r - reduce(lambda a, b: a + b, [q * F.get(o, F.lit(k)) for k, q in enumerate(p)])))


def mixed(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, steps: int = 25, tolerance: float = 2e-4, grid: int | None = 256, **model) -> DataFrame:
    """doc_id, n_tokens, p_<domain> for each domain, rate and copies for every row of docs (doc_id, text).

    labels (doc_id, quality, toxic) names the domains, see domain(). The targets are shares of the tokens of docs, that
    is, words between ASCII white space. rate: how often a document is to be used, fitted to minimise the sum over
    domains of (expected tokens - target)**2 / tokens now, over rates of 0 or more, from 1. copies: rate rounded up or
    down by a hash of doc_id. grid: posteriors are rounded to parts of it, so that the steps run over its cells; None
    leaves them exact, and each step runs over all documents. Null and empty texts have no tokens and the priors' posterior. Without labels all
    domains are equally likely. A domain that no document is in can't be reached. Repeated rows are mixed each; extra
    columns are ignored; an empty table gives no rows.
    """
    domains = list(targets)
    rows = written(posteriors(docs, labels, domains, grid=grid, **model), "posteriors")
    shares = [f"g{k}" for k in range(len(domains))]
    cells = rows.select(*shares, F.col("n_tokens").alias("tokens"))
    if grid is not None:
        cells = written(rows.groupBy(*shares).agg(F.sum("n_tokens").alias("tokens")).repartition(8), "cells")
        if comb(grid + len(domains) - 1, len(domains) - 1) <= FEW_CELLS:
            cells = cells.coalesce(1)  # each step is one task then, without an exchange
    p = [F.col(c) / F.lit(float(grid or 1)) for c in shares]
    taken: list[list[float]] = []
    totals = lambda: [x or 0.0 for x in cells.select("tokens", *shares, _rate(p, taken).alias("rate")).agg(*[F.sum(F.col("rate") * F.col("tokens") * q) for q in p]).first()]
    now = base = totals()
    goal = [w * sum(base) / sum(targets.values()) for w in targets.values()]
    for _ in range(steps):
        off = [(a - g) / max(c, 1.0) for a, g, c in zip(now, goal, base)]
        if max(abs(a - g) for a, g in zip(now, goal)) <= tolerance * max(1.0, sum(base)):
            break
        # the scaled normal matrix has no eigenvalue above 1, so any step below 2 descends
        taken.append([1.5 * o for o in off])
        before, now = now, totals()
        if max(abs(a - b) for a, b in zip(now, before)) <= tolerance / 20 * sum(base):
            break  # a target that can't be reached
    out = rows.select("doc_id", "n_tokens", *[q.alias(f"p_{d}") for q, d in zip(p, domains)], F.round(_rate(p, taken), 6).alias("rate"))
    chance = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return out.withColumn("copies", (F.floor("rate") + (F.col("rate") - F.floor("rate") > chance).cast("long")).cast("long"))
