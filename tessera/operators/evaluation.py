"""Ranking, threshold and classification metrics, and splits.

Rank metrics first group equal scores; the ordered pass over these is dealt by ranges of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.order import cut, percentile, running


def _by_score(rows: DataFrame) -> DataFrame:
    """(score, p, n): positives and negatives of each distinct score; rows (score, novel)."""
    novel = F.col("novel").cast("int")
    return rows.groupBy("score").agg(F.sum(novel).alias("p"), F.sum(1 - novel).alias("n"))


def _running(rows: DataFrame) -> DataFrame:
    """With tp and fp of all scores from this one up, and the totals."""
    scores = cut(_by_score(rows))
    pos, neg = scores.agg(F.sum("p"), F.sum("n")).first()
    out = running(scores, [], [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n")})
    return out.withColumn("pos", F.lit(pos).cast("long")).withColumn("neg", F.lit(neg).cast("long"))


def auroc(rows: DataFrame) -> DataFrame:
    """One row, auroc: ties count half; 0.5 with one class only."""
    r = _running(rows)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / (F.max("pos") * F.max("neg"))
    return r.agg(F.round(F.when((F.max("pos") == 0) | (F.max("neg") == 0), 0.5).otherwise(area), 6).alias("auroc"))


def average_precision(rows: DataFrame) -> DataFrame:
    r = _running(rows)
    return r.agg(F.round(F.sum(F.col("p") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), 6).alias("average_precision"))


def auprc_trapezoid(rows: DataFrame) -> DataFrame:
    """Area under precision over recall by trapezoids, from precision 1 at recall 0. The point before each score is that
    of the counts without it."""
    r = _running(rows)
    earlier = F.col("tp") + F.col("fp") - F.col("p") - F.col("n")
    before = F.when(earlier > 0, (F.col("tp") - F.col("p")) / earlier)
    step = F.col("p") / F.col("pos")
    return r.agg(F.round(F.sum(step * (F.col("tp") / (F.col("tp") + F.col("fp")) + F.coalesce(before, F.lit(1.0))) / 2), 6).alias("auprc"))


def detection_rate_percentile(rows: DataFrame, fpr: float) -> DataFrame:
    """Share of novel scores above the known scores' (1 - fpr) percentile."""
    limit = percentile(rows.where("not novel"), "score", 1 - fpr)
    found = F.lit(1.0) if limit is None else (F.col("score") > F.lit(limit)).cast("double")  # without known rows nothing is held back
    return rows.where("novel").agg(F.round(F.coalesce(F.avg(found), F.lit(0.0)), 6).alias("detection_rate"))


def detection_rate_budget(rows: DataFrame, fpr: float, at_least: int = 1) -> DataFrame:
    """Share of novel rows found, by falling score, before the known rows found exceed max(at_least, floor(fpr * known))."""
    r = _running(rows)
    budget = F.greatest(F.lit(at_least), F.floor(F.lit(fpr) * F.col("neg")))
    return r.agg(F.round(F.coalesce(F.max(F.when(F.col("fp") <= budget, F.col("tp") / F.col("pos"))), F.lit(0.0)), 6).alias("detection_rate"))


def _counts(rows: DataFrame, predicted, truth) -> list:
    c = lambda cond: F.sum(cond.cast("long"))
    return [c(predicted & truth).alias("tp"), c(predicted & ~truth).alias("fp"), c(~predicted & truth).alias("fn"), c(~predicted & ~truth).alias("tn")]


def with_rates(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall and f1 of tp, fp, fn, tn; 0 where a denominator is."""
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"accuracy": F.round(ratio(tp + tn, tp + fp + fn + tn), 6), "precision": F.round(ratio(tp, tp + fp), 6), "recall": F.round(ratio(tp, tp + fn), 6), "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), 6)})


def confusion(rows: DataFrame, predicted: str, truth: str) -> DataFrame:
    return with_rates(rows.agg(*_counts(rows, F.col(predicted), F.col(truth))))


def threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Counts and rates at each threshold: one pass, each row adding to all thresholds."""
    at = rows.select("novel", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (F.col("score") >= t).alias("hit")) for t in thresholds])).alias("x")).select("novel", "x.*")
    return with_rates(at.groupBy("threshold").agg(*_counts(at, F.col("hit"), F.col("novel"))))


def optimal_threshold(rows: DataFrame) -> DataFrame:
    """The percentile of the scores, of 5, 10 ... 95, with the best f1; the first of equals."""
    cuts = rows.agg(F.percentile("score", [i / 100 for i in range(5, 100, 5)])).first()[0]
    sweep = threshold_sweep(rows, sorted({round(c, 6) for c in cuts}))
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1).select("threshold", "f1")


def classification_report(rows: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) of rows (truth, predicted)."""
    pairs = rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    each = pairs.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"), F.lit(0).cast("long").alias("named")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("hit"), F.col("n").alias("named")),
    )).alias("x")).select("x.*").where("label is not null")
    s = each.groupBy("label").agg(F.sum("support").alias("support"), F.sum("hit").alias("hit"), F.sum("named").alias("named"))
    ratio = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 6)
    return s.select("label", "support", ratio(F.col("hit"), F.col("named")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), ratio(2 * F.col("hit"), F.col("named") + F.col("support")).alias("f1"))


def er_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (left_id, right_id, label) with both texts; a missing text is empty."""
    a, b = left.select(F.col("id").alias("left_id"), F.col("text").alias("left")), right.select(F.col("id").alias("right_id"), F.col("text").alias("right"))
    out = pairs.join(a, "left_id", "left").join(b, "right_id", "left")
    return out.withColumns({"left": F.coalesce("left", F.lit("")), "right": F.coalesce("right", F.lit(""))})


# ---- splits -------------------------------------------------------------------------


def hash_rank(key: Column) -> Column:
    return F.md5(F.concat(F.lit("split:"), key.cast("string")))


def ood_classes(rows: DataFrame, known_share: float = 0.8, train_percent: int = 80) -> DataFrame:
    """rows (id, label) with part: train or test of the known classes, novel of the others; classes are taken in the
    order of a hash, max(1, floor(n * known_share)) of them known."""
    classes = rows.select("label").distinct()
    order = Window.orderBy(hash_rank(F.col("label")))
    n = classes.count()
    ranked = classes.withColumn("k", F.row_number().over(order)).select("label", (F.col("k") <= max(1, int(n * known_share))).alias("known"))
    train = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long") % 100 < train_percent
    return rows.join(ranked, "label").withColumn("part", F.when(~F.col("known"), "novel").when(train, "train").otherwise("test")).drop("known")


def three_way(rows: DataFrame) -> DataFrame:
    """rows (id, ...) with part: train, validation or test, 60 / 20 / 20 by hash."""
    h = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long") % 100
    return rows.withColumn("part", F.when(h < 60, "train").when(h < 80, "validation").otherwise("test"))


def gradual(rows: DataFrame, shares: tuple[float, ...] = (0.95, 0.9, 0.8, 0.7, 0.5)) -> DataFrame:
    """(known_share, part, n) of each split."""
    parts = [ood_classes(rows, s).groupBy("part").agg(F.count("*").alias("n")).select(F.lit(s).alias("known_share"), "part", "n") for s in shares]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
