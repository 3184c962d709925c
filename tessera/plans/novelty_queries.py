"""Queries over novelty strategies, their combination, evaluation and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import combine as K
from tessera.operators import evaluation as E
from tessera.operators import matching as M
from tessera.operators import strategies as S
from tessera.operators.order import cut
from tessera.plans.registry import DIMS, SQL_EMB, SQL_PROBS, SQL_SCORES, catalog_of_parts, probes, query, references, vectors


def _predicted(t):
    return M.centroid_probabilities(probes(t), M.class_means(references(t), DIMS), keep=("v", "label"))


@query("ood_confidence", f"WITH {SQL_PROBS} SELECT vec_id AS query_id, round(confidence, 6) AS confidence, round(confidence, 6) < 0.7 AS is_novel FROM pred")
def ood_confidence(t):
    return S.confidence(_predicted(t))


_KNN = """kn AS (SELECT a.vec_id, 1 - round(list_cosine_similarity(a.v, b.v), 9) AS d FROM e a, ref b QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) <= 20),
knn AS (SELECT vec_id, round(avg(d), 6) AS mean_distance, round(max(d), 6) AS max_distance FROM kn GROUP BY vec_id)"""


@query("ood_knn_distance", f"WITH {SQL_EMB}, {_KNN} SELECT vec_id AS query_id, mean_distance, max_distance, mean_distance >= 0.55 AS is_novel FROM knn")
def ood_knn_distance(t):
    return S.knn_distance(probes(t), references(t))


_UNC = "round(ps[1] - coalesce(ps[2], 0), 6) AS margin, round(-list_sum([CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END for p in ps]), 6) AS entropy"


@query("ood_uncertainty", f"WITH {SQL_PROBS}, u AS (SELECT vec_id AS query_id, {_UNC} FROM pred) SELECT query_id, margin, entropy, 1 - margin AS score, margin < 0.3 OR entropy > 1.5 AS is_novel FROM u")
def ood_uncertainty(t):
    return S.uncertainty(_predicted(t))


@query("ood_setfit_centroid", f"""WITH {SQL_SCORES}, b AS (SELECT vec_id, min_by(label, (round(1 - c, 9), label)) AS label FROM cd GROUP BY vec_id)
SELECT vec_id AS query_id, b.label, round(d, 6) AS distance, round(1 / (1 + exp(-10 * (d - lim))), 6) AS score, d > lim AS is_novel FROM dist JOIN b USING (vec_id), limits""")  # fmt: skip
def ood_setfit_centroid(t):
    return S.centroid(probes(t), references(t), DIMS)


@query("ood_setfit", f"""WITH {SQL_EMB}, own AS (SELECT a.vec_id, 1 - round(max(list_cosine_similarity(a.v, b.v)), 9) AS d FROM ref a, ref b WHERE a.vec_id <> b.vec_id GROUP BY a.vec_id), lim AS (SELECT quantile_cont(d, 0.95) AS lim FROM own),
n AS (SELECT a.vec_id, 1 - round(max(list_cosine_similarity(a.v, b.v)), 9) AS d FROM e a, ref b GROUP BY a.vec_id)
SELECT vec_id AS query_id, round(d, 6) AS distance, round(1 / (1 + exp(-5 * (d - lim))), 6) AS score, d > lim AS is_novel FROM n, lim""")  # fmt: skip
def ood_setfit(t):
    return S.pairwise_margin(probes(t), references(t))


@query("ood_prototypical", f"""WITH {SQL_SCORES}, b AS (SELECT vec_id, min_by(label, (round(1 - c, 9), label)) AS label FROM cd GROUP BY vec_id)
SELECT vec_id AS query_id, b.label, round(d, 6) AS distance, round(least(d / 0.5, 1.0), 6) AS score, d > 0.5 AS is_novel FROM dist JOIN b USING (vec_id)""")  # fmt: skip
def ood_prototypical(t):
    return S.prototypical(probes(t), references(t), DIMS)


_ENERGY = "en AS (SELECT vec_id, any_value(truth) AS truth, -(max(25 * c) + ln(sum(exp(25 * c - 25)) / exp(max(25 * c) - 25))) AS energy FROM cd GROUP BY vec_id), el AS (SELECT avg(energy) + 2 * stddev_pop(energy) AS lim FROM en WHERE truth < 8)"


@query("ood_energy", f"WITH {SQL_EMB}, {_ENERGY} SELECT vec_id AS query_id, round(energy, 6) AS energy, energy > lim AS is_novel FROM en, el")
def ood_energy(t):
    return S.energy(probes(t), references(t), DIMS)


_REACT = SQL_EMB.replace("e AS (", "raw AS (", 1).replace("ref AS (SELECT * FROM e WHERE label < 8)", """lq AS (SELECT quantile_cont(x, 0.9) AS l FROM (SELECT unnest(v) AS x FROM raw)), lr AS (SELECT quantile_cont(x, 0.9) AS l FROM (SELECT unnest(v) AS x FROM raw WHERE label < 8)),
e AS (SELECT vec_id, label, [least(x, l) for x in v] AS v FROM raw, lq), ref AS (SELECT vec_id, label, [least(x, l) for x in v] AS v FROM raw, lr WHERE label < 8)""")
_REACT_ENERGY = _ENERGY.replace("el AS (SELECT avg(energy) + 2 * stddev_pop(energy) AS lim FROM en WHERE truth < 8)", """rd AS (SELECT vec_id, list_cosine_similarity(v, mean) AS c FROM ref, means),
el AS (SELECT avg(energy) + 2 * stddev_pop(energy) AS lim FROM (SELECT -(max(25 * c) + ln(sum(exp(25 * c - 25)) / exp(max(25 * c) - 25))) AS energy FROM rd GROUP BY vec_id))""")


@query("ood_react_energy", f"WITH {_REACT}, {_REACT_ENERGY} SELECT vec_id AS query_id, round(energy, 6) AS energy, energy > lim AS is_novel FROM en, el")
def ood_react_energy(t):
    return S.react_energy(probes(t), references(t), DIMS)


_COHESION = "co AS (SELECT label, any_value(n) AS n, (sum(s * s) - any_value(n)) / (any_value(n) * (any_value(n) - 1)) AS cohesion FROM (SELECT label, i, count(*) AS n, sum(v[i] / sqrt(list_dot_product(v, v))) AS s FROM {src}, range(1, 65) r(i) GROUP BY label, i) GROUP BY label)"


@query("ood_clustering", f"""WITH {SQL_EMB}, {_COHESION.format(src='ref')}, b AS (SELECT vec_id, min_by(label, (round(1 - c, 9), label)) AS label, min(round(1 - c, 9)) AS d FROM cd GROUP BY vec_id), l AS (SELECT quantile_cont(d, 0.9) AS lim FROM b)
SELECT vec_id AS query_id, CASE WHEN d > lim THEN -1 ELSE b.label END AS cluster, round(d, 6) AS distance, round(cohesion, 6) AS cohesion, d > lim OR NOT (n >= 5 AND cohesion >= 0.45) OR cohesion > 0.45 AS is_novel FROM b JOIN co ON co.label = b.label, l""")  # fmt: skip
def ood_clustering(t):
    return S.clustering(probes(t), references(t), DIMS)


@query("ood_lof", f"""WITH {SQL_EMB}, o AS (SELECT a.vec_id AS q, b.vec_id AS r, 1 - round(list_cosine_similarity(a.v, b.v), 9) AS d FROM ref a, ref b WHERE a.vec_id <> b.vec_id
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) <= 20), kd AS (SELECT q AS r, max(d) AS kd FROM o GROUP BY q),
lr AS (SELECT q AS r, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM o JOIN kd USING (r) GROUP BY q),
nq AS (SELECT a.vec_id AS q, b.vec_id AS r, 1 - round(list_cosine_similarity(a.v, b.v), 9) AS d FROM e a, ref b QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) <= 20),
ql AS (SELECT q, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM nq JOIN kd USING (r) GROUP BY q), z AS (SELECT q, round(-avg(lr.lrd) / any_value(ql.lrd), 5) AS score FROM nq JOIN lr USING (r) JOIN ql USING (q) GROUP BY q)
SELECT q AS query_id, score, score < -1.5 AS is_novel FROM z""")  # fmt: skip
def ood_lof(t):
    return S.local_outlier_factor(probes(t), references(t))


def _nation_texts(t):
    """Names of all lengths: of two characters, which have no n-grams, of three, and longer ones."""
    name, k = F.lower("n_name"), F.col("n_nationkey") % 5
    text = F.when(k == 0, F.left(name, F.lit(2))).when(k == 1, F.left(name, F.lit(3))).when(k == 2, F.upper(name)).otherwise(F.concat_ws(" ", name, F.lit("bolt and more of it")))
    return t("nation").select(F.col("n_nationkey").alias("query_id"), text.alias("text"))


def _pattern_sql(case: str) -> str:
    return f"""WITH k AS (SELECT DISTINCT p_name AS text FROM part), st AS (SELECT min(len(text)) AS low, max(len(text)) AS high, bool_and(lower(text) = text) AS all_lower, count(*) FILTER (len(text) >= 3) AS n FROM k),
q AS (SELECT n_nationkey AS query_id, CASE n_nationkey % 5 WHEN 0 THEN left(lower(n_name), 2) WHEN 1 THEN left(lower(n_name), 3) WHEN 2 THEN upper(n_name) ELSE lower(n_name) || ' bolt and more of it' END AS text FROM nation),
g3 AS (SELECT DISTINCT unnest([substr(text, i, 3) for i in range(1, len(text) - 1)]) AS g FROM k), g4 AS (SELECT DISTINCT unnest([substr(text, i, 4) for i in range(1, len(text) - 2)]) AS g FROM k),
q3 AS (SELECT query_id, 1 - sum((g IN (SELECT g FROM g3))::INT) / count(*) AS a FROM (SELECT DISTINCT query_id, unnest([substr(text, i, 3) for i in range(1, len(text) - 1)]) AS g FROM q) GROUP BY query_id),
q4 AS (SELECT query_id, 1 - sum((g IN (SELECT g FROM g4))::INT) / count(*) AS b FROM (SELECT DISTINCT query_id, unnest([substr(text, i, 4) for i in range(1, len(text) - 2)]) AS g FROM q) GROUP BY query_id),
fp AS (SELECT left(text, 3) AS k, count(*) AS c FROM k WHERE len(text) >= 3 GROUP BY 1), fs AS (SELECT right(text, 3) AS k, count(*) AS c FROM k WHERE len(text) >= 3 GROUP BY 1),
y AS (SELECT query_id, list_filter([a::DOUBLE, b::DOUBLE, CASE WHEN high > low THEN least(1, CASE WHEN len(text) < low THEN (low - len(text)) / low WHEN len(text) > high THEN (len(text) - high) / high ELSE 0 END) END, {case},
1 - coalesce(fp.c, 0) / n, 1 - coalesce(fs.c, 0) / n], lambda x: x IS NOT NULL) AS s FROM q LEFT JOIN q3 USING (query_id) LEFT JOIN q4 USING (query_id) LEFT JOIN fp ON fp.k = left(q.text, 3) LEFT JOIN fs ON fs.k = right(q.text, 3), st),
z AS (SELECT query_id, round(list_sum([s[i] * ([0.25, 0.2, 0.15, 0.1, 0.15, 0.15])[i] for i in range(1, len(s) + 1)]) / list_sum(([0.25, 0.2, 0.15, 0.1, 0.15, 0.15])[1 : len(s)]), 6)::DOUBLE AS score FROM y) SELECT query_id, score, score >= 0.5 AS is_novel FROM z"""


@query("ood_pattern", _pattern_sql("0.7"))
def ood_pattern(t):
    return S.pattern(_nation_texts(t), catalog_of_parts(t).select(F.col("name").alias("text")))


@query("ood_pattern_by_case", _pattern_sql("CASE WHEN all_lower AND lower(q.text) = q.text AND upper(q.text) <> q.text THEN 0.0 ELSE 0.3 END"))
def ood_pattern_by_case(t):
    """All part names are lower case, so that lower case is known and any other is not."""
    return S.pattern(_nation_texts(t), catalog_of_parts(t).select(F.col("name").alias("text")), by_case=True)


@query("ood_mahalanobis")
def ood_mahalanobis(t):
    return S.mahalanobis(_predicted(t), references(t), DIMS)


@query("ood_mixture_gaussian")
def ood_mixture_gaussian(t):
    return S.mixture_gaussian(probes(t), references(t), DIMS, ridge=1e-3)


# Two dimensions, where SQL can invert the matrices.
SQL_TWO = """e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), ref AS (SELECT * FROM e WHERE label < 8),
mo AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, x) * count(*) AS xx, covar_pop(x, y) * count(*) AS xy, covar_pop(y, y) * count(*) AS yy FROM ref GROUP BY label)"""


def _two(df):
    return df.withColumn("v", F.slice("v", 1, 2))


@query("ood_mahalanobis_two", f"""WITH {SQL_TWO}, w AS (SELECT sum(xx) / (sum(n) - count(*)) + 1e-4 AS a, sum(xy) / (sum(n) - count(*)) AS b, sum(yy) / (sum(n) - count(*)) + 1e-4 AS d FROM mo), f AS (SELECT avg(mx) AS mx, avg(my) AS my FROM mo),
g AS (SELECT vec_id, x - coalesce(mo.mx, f.mx) AS x, y - coalesce(mo.my, f.my) AS y FROM e LEFT JOIN mo USING (label), f), m AS (SELECT vec_id, round(sqrt((d * x * x - 2 * b * x * y + a * y * y) / (a * d - b * b)), 6) AS m FROM g, w)
SELECT vec_id AS query_id, m AS distance, round(1 - exp(-m / 3), 6) AS score, m >= 3 AS is_novel FROM m""")  # fmt: skip
def ood_mahalanobis_two(t):
    """The predicted class is the true one, which is unseen for novel rows."""
    return S.mahalanobis(_two(probes(t)).withColumn("predicted", F.col("label")), _two(references(t)), 2)


@query("ood_mixture_gaussian_two", f"""WITH {SQL_TWO}, c AS (SELECT label, mx, my, xx / (n - 1) + 1e-3 AS a, xy / (n - 1) AS b, yy / (n - 1) + 1e-3 AS d, ln(n / sum(n) OVER ()) AS p FROM mo),
ll AS (SELECT vec_id, e.label < 8 AS known, max(-0.5 * ((d * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * d - b * b) + ln(a * d - b * b) + 2 * ln(2 * pi())) + p) AS l FROM e, c GROUP BY vec_id, e.label),
lim AS (SELECT avg(l) - 2 * stddev_pop(l) AS lim FROM ll WHERE known) SELECT vec_id AS query_id, round(l, 4) AS log_likelihood, l < lim AS is_novel FROM ll, lim""")  # fmt: skip
def ood_mixture_gaussian_two(t):
    return S.mixture_gaussian(_two(probes(t)), _two(references(t)), 2, ridge=1e-3)


@query("ood_self_knowledge")
def ood_self_knowledge(t):
    return S.self_knowledge(probes(t), references(t))


@query("ood_oneclass")
def ood_oneclass(t):
    return S.oneclass(probes(t), references(t))


_SPLIT = "CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) % 100"


def _energy_scores(t):
    """(tests, calibration) of energies; calibration is a fifth of the references."""
    means = M.class_means(references(t), DIMS)
    rows = S.energies(probes(t).select("query_id", "v"), means).withColumn("score", F.round("energy", 9)).join(probes(t).select("query_id", "label"), "query_id")
    held = rows.where(S.calibration_split(rows, "query_id") & (F.col("label") < 8))
    return rows.withColumnRenamed("query_id", "id"), held


_CONF = f"sc AS (SELECT vec_id, truth AS label, round(energy, 9) AS score FROM en), cal AS (SELECT * FROM sc WHERE label < 8 AND {_SPLIT} < 20)"


@query("ood_conformal_split", f"""WITH {SQL_EMB}, {_ENERGY}, {_CONF} SELECT vec_id AS id, round((SELECT count(*) - sum((cal.score < sc.score)::INT) + 1 FROM cal) / (SELECT count(*) + 1 FROM cal), 6) AS p FROM sc""")
def ood_conformal_split(t):
    tests, cal = _energy_scores(t)
    return S.p_values(tests, cal).select("id", F.round("p", 6).alias("p"))


@query("ood_conformal_mondrian", f"""WITH {SQL_EMB}, {_ENERGY}, {_CONF}, x AS (SELECT a.vec_id, count(c.vec_id) AS n, coalesce(sum((c.score < a.score)::INT), 0) AS b FROM sc a LEFT JOIN cal c ON c.label = a.label GROUP BY a.vec_id),
y AS (SELECT a.vec_id, count(*) AS n, sum((c.score < a.score)::INT) AS b FROM sc a, cal c GROUP BY a.vec_id)
SELECT x.vec_id AS id, round(CASE WHEN x.n > 0 THEN (x.n - x.b + 1) / (x.n + 1) ELSE (y.n - y.b + 1) / (y.n + 1) END, 6) AS p FROM x JOIN y USING (vec_id)""")  # fmt: skip
def ood_conformal_mondrian(t):
    tests, cal = _energy_scores(t)
    return S.p_values(tests, cal, by="label").select("id", F.round("p", 6).alias("p"))


# ---- signals ------------------------------------------------------------------------


def _signals(t):
    """(query_id, label, novel, c, k, u, d and their flags): confidence, kNN, uncertainty and centroid signals."""
    p = _predicted(t).persist()
    c = S.confidence(p).select("query_id", (1 - F.col("confidence")).alias("c"), F.col("is_novel").alias("f_confidence"))
    u = S.uncertainty(p).select("query_id", F.col("score").alias("u"), F.col("is_novel").alias("f_uncertainty"))
    k = S.knn_distance(probes(t), references(t)).select("query_id", F.col("mean_distance").alias("k"), F.col("is_novel").alias("f_knn"))
    d = S.centroid(probes(t), references(t), DIMS).select("query_id", F.col("score").alias("d"), F.col("is_novel").alias("f_centroid"))
    ids = p.select("query_id", "label", (F.col("label") >= 8).alias("novel"), "predicted", "confidence")
    return ids.join(c, "query_id").join(u, "query_id").join(k, "query_id").join(d, "query_id")


FLAGS = ["f_confidence", "f_uncertainty", "f_knn", "f_centroid"]
_SIG = f"""WITH {SQL_PROBS}, {_KNN}, limits AS (SELECT quantile_cont(1 - c, 0.95) AS lim FROM cd WHERE truth = label), dist AS (SELECT vec_id, round(min(round(1 - c, 9)), 9) AS d FROM cd GROUP BY vec_id),
un AS (SELECT vec_id, {_UNC} FROM pred),
sig AS (SELECT vec_id AS query_id, truth >= 8 AS novel, predicted, 1 - round(confidence, 6) AS c, round(confidence, 6) < 0.7 AS f_confidence, 1 - margin AS u, margin < 0.3 OR entropy > 1.5 AS f_uncertainty, mean_distance AS k, mean_distance >= 0.55 AS f_knn,
round(1 / (1 + exp(-10 * (d - lim))), 6) AS d, d > lim AS f_centroid FROM pred JOIN un USING (vec_id) JOIN knn USING (vec_id) JOIN dist USING (vec_id), limits)"""
_W = "least(1, greatest(0, 0.35 * f_confidence::INT + 0.35 * u + 0.45 * k + 0.45 * d)) / 1.6"


def _weighted():
    return K.weighted({"confidence": F.col("f_confidence").cast("int"), "uncertainty": F.col("u"), "knn_distance": F.col("k"), "setfit_centroid": F.col("d")})


@query("combine_weighted", _SIG + f", w AS (SELECT *, round({_W}, 6) AS score FROM sig) SELECT query_id, score, (score >= 0.6 OR u >= 0.85 OR k >= 0.45) AND (f_confidence OR f_uncertainty OR f_knn OR f_centroid) AS is_novel FROM w")
def combine_weighted(t):
    rows = _signals(t).withColumn("score", F.round(_weighted(), 6))
    return rows.select("query_id", "score", (K.gated(F.col("score"), F.col("u"), F.col("k")) & K.any_flag(FLAGS)).alias("is_novel"))


@query("combine_flags", _SIG + """ SELECT query_id, f_confidence OR f_uncertainty OR f_knn OR f_centroid AS any_novel, f_confidence AND f_uncertainty AND f_knn AND f_centroid AS all_novel,
(f_confidence::INT + f_uncertainty::INT + f_knn::INT + f_centroid::INT) / 4 AS votes, f_confidence::INT + f_uncertainty::INT + f_knn::INT + f_centroid::INT >= 3 AS majority_novel FROM sig""")  # fmt: skip
def combine_flags(t):
    return _signals(t).select("query_id", K.any_flag(FLAGS).alias("any_novel"), K.every_flag(FLAGS).alias("all_novel"), K.vote_share(FLAGS).alias("votes"), K.majority(FLAGS).alias("majority_novel"))


@query("combine_meta_learner")
def combine_meta_learner(t):
    rows = cut(_signals(t))  # the fit reads them again and again
    train = rows.where(~S.calibration_split(rows, "query_id"))
    return K.meta_learner(train, ["c", "u", "k", "d"])(rows).select("query_id", "meta_score", "novel")


@query("calibrate_minmax", f"WITH {SQL_SCORES}, l AS (SELECT quantile_cont(score, 0.05) AS lo, quantile_cont(score, 0.95) AS hi FROM scores) SELECT vec_id AS query_id, round(least(1, greatest(0, (score - lo) / (hi - lo))), 6) AS calibrated FROM scores, l")
def calibrate_minmax(t):
    rows = S.prototypical(probes(t), references(t), DIMS).select("query_id", F.col("distance").alias("score"))
    return rows.select("query_id", F.round(K.calibrated(F.col("score"), **K.calibration(rows)), 6).alias("calibrated"))


@query("decide_match_method", _SIG + """ SELECT query_id, CASE WHEN predicted >= 7 THEN 'outside_existing_classes' WHEN f_knn OR f_centroid THEN 'novelty_detector' WHEN 1 - c < 0.5 THEN 'below_acceptance_threshold' ELSE 'accepted_known' END AS method FROM sig""")
def decide_match_method(t):
    rows = _signals(t)
    return rows.select("query_id", K.decision(F.col("predicted"), 1 - F.col("c"), F.col("f_knn") | F.col("f_centroid"), F.col("predicted") < 7, 0.5).alias("method"))


@query("report_signal_counts", _SIG + " SELECT unnest(['f_confidence', 'f_uncertainty', 'f_knn', 'f_centroid']) AS strategy, unnest([sum(f_confidence::INT)::BIGINT, sum(f_uncertainty::INT)::BIGINT, sum(f_knn::INT)::BIGINT, sum(f_centroid::INT)::BIGINT]) AS n_flagged FROM sig")
def report_signal_counts(t):
    return K.signal_counts(_signals(t), FLAGS)


@query("report_novel_samples", _SIG + f" SELECT query_id, round({_W}, 6) AS score, f_confidence, f_uncertainty, f_knn, f_centroid FROM sig WHERE f_confidence OR f_uncertainty OR f_knn OR f_centroid")
def report_novel_samples(t):
    rows = K.report(_signals(t).withColumn("score", F.round(_weighted(), 6)), FLAGS)
    return rows.select("query_id", "score", *[F.col("signals")[f].alias(f) for f in FLAGS])


@query("weights_adaptive", f"""WITH {SQL_EMB}, {_KNN.replace('e a, ref b', 'ref a, ref b WHERE a.vec_id <> b.vec_id')}, km AS (SELECT avg(mean_distance) AS m FROM knn),
ia AS (SELECT avg(1 - c) AS intra FROM cd WHERE truth = label), ie AS (SELECT avg(1 - list_cosine_similarity(a.mean, b.mean)) AS inter FROM means a, means b WHERE a.label < b.label),
ent AS (SELECT -sum(p * ln(p)) / ln(count(*)) AS h FROM (SELECT n / sum(n) OVER () AS p FROM means)), w AS (SELECT unnest(['knn_distance', 'setfit_centroid', 'confidence']) AS strategy,
unnest([0.45 * (1 + 0.5 / (1 + m)), 0.45 * (1 + 0.5 * least(inter / intra / 3, 1)), 0.35 * (1 + 0.3 * (1 - h))]) AS w FROM km, ia, ie, ent) SELECT strategy, round(w / (SELECT sum(w) FROM w), 6) AS weight FROM w""")  # fmt: skip
def weights_adaptive(t):
    refs = references(t)
    means = M.class_means(refs, DIMS)
    own = refs.join(means.select("label", "mean"), "label").agg(F.avg(1 - V.cosine(F.col("v"), F.col("mean")))).first()[0]
    pairs = M.against_classes(means.select(F.col("label").alias("query_id"), F.col("mean").alias("v")), means, [], distance=True)
    inter = pairs.select("query_id", F.explode("scores").alias("s")).where("query_id < s.label").agg(F.avg("s.score")).first()[0]
    knn = S.knn_distance(refs.withColumnRenamed("ref_id", "query_id"), refs, skip_same=True).agg(F.avg("mean_distance")).first()[0]
    total = refs.count()
    p = F.col("n") / total
    h = means.agg(-F.sum(p * F.log(p)) / F.log(F.count("*"))).first()[0]
    base = {k: K.WEIGHTS[k] for k in ("knn_distance", "setfit_centroid", "confidence")}
    w = K.adaptive(knn, inter / own, 0.0, h, base | {"uncertainty": 0.0})
    return t.spark.createDataFrame([(k, round(w[k], 6)) for k in base], "strategy string, weight double")


# ---- evaluation ---------------------------------------------------------------------


def _scores(t):
    rows = S.prototypical(probes(t), references(t), DIMS)
    return rows.select("query_id", F.col("distance").alias("score")).join(probes(t).select("query_id", (F.col("label") >= 8).alias("novel")), "query_id")


_RUN = f"""WITH {SQL_SCORES}, g AS (SELECT score, sum(novel::INT) AS p, sum((NOT novel)::INT) AS n FROM scores GROUP BY score),
r AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS tot, sum(n) OVER () AS neg FROM g)"""


@query("eval_auroc", _RUN + " SELECT round(sum(n * (tp - p / 2)) / (max(tot) * max(neg)), 6) AS auroc FROM r")
def eval_auroc(t):
    return E.auroc(_scores(t))


@query("eval_average_precision", _RUN + " SELECT round(sum(p / tot * tp / (tp + fp)), 6) AS average_precision FROM r")
def eval_average_precision(t):
    return E.average_precision(_scores(t))


@query("eval_auprc_trapezoid", _RUN + ", x AS (SELECT score, tp / (tp + fp) AS pr, tp / tot AS re FROM r) SELECT round(sum(a), 6) AS auprc FROM (SELECT (re - coalesce(lag(re) OVER (ORDER BY score DESC), 0)) * (pr + coalesce(lag(pr) OVER (ORDER BY score DESC), 1)) / 2 AS a FROM x)")
def eval_auprc_trapezoid(t):
    return E.auprc_trapezoid(_scores(t))


@query("eval_dr_percentile", f"WITH {SQL_SCORES} SELECT round(avg((score > (SELECT quantile_cont(score, 0.95) FROM scores WHERE NOT novel))::INT), 6) AS detection_rate FROM scores WHERE novel")
def eval_dr_percentile(t):
    return E.detection_rate_percentile(_scores(t), 0.05)


@query("eval_dr_budget", _RUN + " SELECT round(coalesce(max(CASE WHEN fp <= greatest(1, floor(0.05 * neg)) THEN tp / tot END), 0), 6) AS detection_rate FROM r")
def eval_dr_budget(t):
    return E.detection_rate_budget(_scores(t), 0.05)


_RATES = """round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"""
_SWEEP = "sw AS (SELECT t AS threshold, sum((score >= t AND novel)::INT)::BIGINT AS tp, sum((score >= t AND NOT novel)::INT)::BIGINT AS fp, sum((score < t AND novel)::INT)::BIGINT AS fn, sum((score < t AND NOT novel)::INT)::BIGINT AS tn FROM scores, {src} GROUP BY t)"


@query("eval_threshold_sweep", f"WITH {SQL_SCORES}, th AS (SELECT i / 100.0::DOUBLE AS t FROM range(0, 101) r(i)), {_SWEEP.format(src='th')} SELECT *, {_RATES} FROM sw")
def eval_threshold_sweep(t):
    return E.threshold_sweep(_scores(t), [i / 100 for i in range(101)])


@query("eval_optimal_threshold", f"WITH {SQL_SCORES}, th AS (SELECT DISTINCT round(unnest(quantile_cont(score, [{', '.join(str(i / 100) for i in range(5, 100, 5))}])), 6) AS t FROM scores), {_SWEEP.format(src='th')}, f AS (SELECT threshold, {_RATES} FROM sw) SELECT threshold, f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1")
def eval_optimal_threshold(t):
    return E.optimal_threshold(_scores(t))


@query("eval_confusion", f"WITH {SQL_SCORES}, th AS (SELECT 0.5 AS t), {_SWEEP.format(src='th')} SELECT tp, fp, fn, tn, {_RATES} FROM sw")
def eval_confusion(t):
    return E.confusion(_scores(t).withColumn("hit", F.col("score") >= 0.5), "hit", "novel")


@query("eval_classification_f1", f"""WITH {SQL_PROBS}, l AS (SELECT DISTINCT truth AS label FROM pred UNION SELECT DISTINCT predicted FROM pred), s AS (SELECT l.label, sum((truth = l.label)::INT)::BIGINT AS support, sum((truth = l.label AND predicted = l.label)::INT) AS hit, sum((predicted = l.label)::INT) AS named FROM pred, l GROUP BY l.label)
SELECT label, support, round(CASE WHEN named = 0 THEN 0 ELSE hit / named END, 6) AS precision, round(CASE WHEN support = 0 THEN 0 ELSE hit / support END, 6) AS recall, round(CASE WHEN named + support = 0 THEN 0 ELSE 2 * hit / (named + support) END, 6) AS f1 FROM s""")  # fmt: skip
def eval_classification_f1(t):
    return E.classification_report(_predicted(t).select(F.col("label").alias("truth"), "predicted"))


@query("eval_er_pairs", """WITH p AS (SELECT c_custkey AS left_id, c_custkey % 120 AS right_id, (c_custkey % 3 = 0)::INT AS label FROM customer)
SELECT left_id, right_id, label, coalesce(c_name, '') AS "left", coalesce(s_name, '') AS "right" FROM p LEFT JOIN customer ON c_custkey = left_id LEFT JOIN supplier ON s_suppkey = right_id""")  # fmt: skip
def eval_er_pairs(t):
    k = F.col("c_custkey")
    pairs = t("customer").select(k.alias("left_id"), (k % 120).alias("right_id"), (k % 3 == 0).cast("int").alias("label"))
    return E.er_pairs(pairs, t("customer").select(k.alias("id"), F.col("c_name").alias("text")), t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text")))


_OOD = """cl AS (SELECT label, row_number() OVER (ORDER BY md5('split:' || label)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM embeddings)),
sp AS (SELECT vec_id AS id, label, CASE WHEN k > greatest(1, floor(n * {s})) THEN 'novel' WHEN """ + _SPLIT + """ < 80 THEN 'train' ELSE 'test' END AS part FROM embeddings JOIN cl USING (label))"""


@query("split_ood_classes", f"WITH {_OOD.format(s=0.8)} SELECT id, label, part FROM sp")
def split_ood_classes(t):
    return E.ood_classes(vectors(t).select("id", "label")).select("id", "label", "part")


@query("split_gradual", " UNION ALL ".join(f"SELECT {s}::DOUBLE AS known_share, part, count(*) AS n FROM (WITH {_OOD.format(s=s)} SELECT * FROM sp) GROUP BY part" for s in (0.95, 0.9, 0.8, 0.7, 0.5)))
def split_gradual(t):
    return E.gradual(vectors(t).select("id", "label"))


@query("split_three_way", f"SELECT vec_id AS id, label, CASE WHEN {_SPLIT} < 60 THEN 'train' WHEN {_SPLIT} < 80 THEN 'validation' ELSE 'test' END AS part FROM embeddings")
def split_three_way(t):
    return E.three_way(vectors(t).select("id", "label"))
