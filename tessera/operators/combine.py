"""Signals of several strategies: calibration, combination, decisions, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import clip
from tessera.operators.order import percentile

#: How much each strategy counts in the weighted combination.
WEIGHTS = {
    "confidence": 0.35, "uncertainty": 0.35, "knn_distance": 0.45, "clustering": 0.2, "self_knowledge": 0.08, "pattern": 0.2, "oneclass": 0.1, "prototypical": 0.02,
    "setfit": 0.02, "setfit_centroid": 0.45, "mahalanobis": 0.35, "lof": 0.15, "energy_ood": 0.2, "mixture_gaussian": 0.2, "react_energy": 0.2,
}


def calibration(scores: DataFrame, score: str = "score") -> dict[str, float]:
    """low and high of the scores: the 5th and the 95th percentile, of fewer than 20 the least and the greatest."""
    n, low, high = scores.agg(F.count(score), F.min(score), F.max(score)).first()
    return {"low": low, "high": high} if n < 20 else {"low": percentile(scores, score, 0.05), "high": percentile(scores, score, 0.95)}


def calibrated(score: Column, low: float | None, high: float | None) -> Column:
    """Scaled to 0..1 between low and high; 0 where they are equal or missing."""
    if low is None or high is None or high <= low:
        return F.lit(0.0)
    return clip((score - low) / (high - low))


def _all(flags: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f), F.lit(False)) for f in flags]


def any_flag(flags: list[str]) -> Column:
    return reduce(lambda a, b: a | b, _all(flags), F.lit(False))


def every_flag(flags: list[str]) -> Column:
    """No strategies flag nothing."""
    return reduce(lambda a, b: a & b, _all(flags), F.lit(bool(flags)))


def vote_share(flags: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("int") for c in _all(flags)], F.lit(0)) / F.lit(max(1, len(flags)))


def majority(flags: list[str]) -> Column:
    return vote_share(flags) * len(flags) >= len(flags) // 2 + 1


def weighted(signals: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """The clipped weighted sum, divided by the sum of the weights of the signals there are; a null counts 0."""
    total = sum(weights[s] for s in signals)
    return clip(reduce(lambda a, b: a + b, [weights[s] * F.coalesce(c.cast("double"), F.lit(0.0)) for s, c in signals.items()])) / F.lit(total)


def gated(score: Column, uncertainty: Column | None = None, knn: Column | None = None, limit: float = 0.6, knn_gate: float = 0.45, strong: float = 0.85) -> Column:
    """Novel by score, or by a strong single signal."""
    out = score >= limit
    out = out | (F.coalesce(uncertainty, F.lit(0.0)) >= strong) if uncertainty is not None else out
    return out | (F.coalesce(knn, F.lit(0.0)) >= knn_gate) if knn is not None else out


def normalised(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total else weights


def adaptive(knn_mean: float, separability: float, effective_share: float, label_entropy: float, weights: dict[str, float] = WEIGHTS) -> dict[str, float]:
    """Weights that follow a dataset's shape; the other strategies keep theirs."""
    out = dict(weights)
    out["knn_distance"] *= 1 + 0.5 / (1 + knn_mean)
    out["setfit_centroid"] *= 1 + 0.5 * min(separability / 3, 1)
    out["uncertainty"] *= 1 + 0.3 * effective_share
    out["confidence"] *= 1 + 0.3 * (1 - label_entropy)
    return normalised(out)


def meta_learner(train: DataFrame, features: list[str], label: str = "novel"):
    """A logistic model over signals, classes weighing the same; returns a function that adds meta_score."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    n, pos = train.agg(F.count("*"), F.sum(F.col(label).cast("int"))).first()
    if not pos or pos == n:
        raise ValueError("both classes are needed")
    balance = F.when(F.col(label), n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
    rows = assembler.transform(train.withColumn("y", F.col(label).cast("double")).withColumn("w", balance))
    model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=0.01, maxIter=100).fit(rows)
    return lambda df: model.transform(assembler.transform(df)).withColumn("meta_score", F.round(F.get(vector_to_array("probability"), F.lit(1)), 4)).drop("features", "rawPrediction", "probability", "prediction")


def decision(id_: Column, score: Column, novel: Column, known: Column, threshold: float) -> Column:
    """How a match was decided."""
    return (
        F.when(id_.isNull(), "no_match").when(~known, "outside_existing_classes").when(novel, "novelty_detector")
        .when(score < threshold, "below_acceptance_threshold").otherwise("accepted_known")
    )


def signal_counts(rows: DataFrame, flags: list[str]) -> DataFrame:
    """(strategy, n_flagged)."""
    counts = rows.agg(*[F.sum(F.coalesce(F.col(f), F.lit(False)).cast("long")).alias(f) for f in flags])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("strategy"), F.coalesce(F.col(f), F.lit(0)).alias("n_flagged")) for f in flags])).alias("x")).select("x.*")


def report(rows: DataFrame, flags: list[str], score: str = "score") -> DataFrame:
    """(query_id, score, signals): a row for each novel sample, with its flags as a map."""
    entries = [x for f in flags for x in (F.lit(f), F.coalesce(F.col(f), F.lit(False)))]
    return rows.where(any_flag(flags)).select("query_id", F.col(score).alias("score"), F.create_map(*entries).alias("signals"))
