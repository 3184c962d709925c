"""Queries over encoders, sweeps, further splits and comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import encode
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import catalog as C
from tessera.operators import combine as K
from tessera.operators import evaluation as E
from tessera.operators import matching as M
from tessera.operators.heads import LogisticHead
from tessera.operators.order import running
from tessera.plans.matching_queries import _LEX, _TYPO, _TYPO_TEXT, _typo_queries
from tessera.plans.novelty_queries import _RATES, _RUN, _SIG, _scores, _signals
from tessera.plans.registry import SQL_EMB, SQL_SCORES, catalog_of_parts, probes, query, references

_VEC = """{name} AS (SELECT k, [coalesce(m[i], 0)::DOUBLE FOR i IN range(0, 64)] AS v FROM (SELECT k, map(list(b), list(n)) AS m FROM (SELECT k, b, count(*) AS n FROM
(SELECT k, (CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % 64)::INT AS b FROM (SELECT k, unnest([substr(s, i, 3) for i in range(1, len(s) - 1)]) AS g FROM (SELECT {key} AS k, lower({text}) AS s FROM {source}))) GROUP BY k, b) GROUP BY k))"""


@query("encode_lexical_match", f"""WITH z AS ({_TYPO}), q AS (SELECT replace(p_name, ' ', '_') AS query_id, {_TYPO_TEXT} AS text FROM z), {_VEC.format(name='qv', key='query_id', text='text', source='q')},
{_VEC.format(name='ev', key='p_name', text='p_name', source='(SELECT DISTINCT p_name FROM part)')}, s AS (SELECT qv.k AS query_id, ev.k AS name, round(list_cosine_similarity(qv.v, ev.v), 6) AS score FROM qv, ev)
SELECT query_id, name, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) = 1""")  # fmt: skip
def encode_lexical_match(t):
    q = encode.encoded(_typo_queries(t)).select("query_id", "v")
    names = encode.encoded(catalog_of_parts(t).select(F.col("name").alias("text"))).select(F.col("text").alias("label"), F.col("v").alias("mean"))
    # the names come in order: of equal scores the first is taken within the row, so that no pair leaves it
    best = F.array_max(F.transform("scores", lambda s, i: F.struct(F.round(s["score"], 6).alias("score"), (-i).alias("i"), s["label"].alias("name"))))
    return M.against_classes(q, names, []).select("query_id", best["name"].alias("name"), best["score"].alias("score"))


_KS = (1, 5, 10, 20)


@query("eval_knn_parameter_sweep", f"""WITH {SQL_EMB}, n AS (SELECT a.vec_id, a.label >= 8 AS novel, 1 - round(list_cosine_similarity(a.v, b.v), 9) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS r
FROM e a, ref b WHERE a.vec_id <> b.vec_id QUALIFY r <= 20), s AS (SELECT k, vec_id, any_value(novel) AS novel, round(avg(d), 6) AS score FROM n, (SELECT unnest([1, 5, 10, 20]) AS k) WHERE r <= k GROUP BY ALL),
g AS (SELECT k, score, sum(novel::INT) AS p, sum((NOT novel)::INT) AS n FROM s GROUP BY ALL), x AS (SELECT *, sum(p) OVER (PARTITION BY k ORDER BY score DESC) AS tp, sum(p) OVER (PARTITION BY k) AS tot, sum(n) OVER (PARTITION BY k) AS neg FROM g)
SELECT k, round(sum(n * (tp - p / 2)) / (max(tot) * max(neg)), 6) AS auroc FROM x GROUP BY k""")  # fmt: skip
def eval_knn_parameter_sweep(t):
    near = M.nearest(probes(t), references(t), max(_KS), skip_same=True)
    truth = probes(t).select("query_id", (F.col("label") >= 8).alias("novel"))
    rows = near.join(truth, "query_id").persist()
    out = None
    for k in _KS:
        s = rows.where(F.col("rank") <= k).groupBy("query_id", "novel").agg(F.round(F.avg(1 - F.col("score")), 6).alias("score"))
        one = E.auroc(s).select(F.lit(k).alias("k"), "auroc")
        out = one if out is None else out.unionByName(one)
    return out


@query("eval_auto_tune_threshold", f"WITH {SQL_SCORES}, th AS (SELECT i / 10.0::DOUBLE AS t FROM range(3, 10) r(i)), sw AS (SELECT t AS threshold, round(avg(((score >= t) = novel)::INT), 6) AS accuracy FROM scores, th GROUP BY t) SELECT threshold, accuracy FROM sw ORDER BY accuracy DESC, threshold LIMIT 1")
def eval_auto_tune_threshold(t):
    sweep = E.threshold_sweep(_scores(t), [i / 10 for i in range(3, 10)])
    return sweep.orderBy(F.desc("accuracy"), "threshold").limit(1).select("threshold", "accuracy")


_GRID = [(a, b) for a in (0.0, 0.5, 1.0) for b in (0.0, 0.5, 1.0) if a + b > 0]


@query("weights_grid_search", _SIG + f""", grid AS (SELECT unnest([{', '.join(str(a) for a, _ in _GRID)}])::DOUBLE AS a, unnest([{', '.join(str(b) for _, b in _GRID)}])::DOUBLE AS b), sc AS (SELECT a, b, novel, round((a * k + b * d) / (a + b), 6) AS score FROM sig, grid),
g AS (SELECT a, b, score, sum(novel::INT) AS p, sum((NOT novel)::INT) AS n FROM sc GROUP BY ALL), x AS (SELECT *, sum(p) OVER (PARTITION BY a, b ORDER BY score DESC) AS tp, sum(p) OVER (PARTITION BY a, b) AS tot, sum(n) OVER (PARTITION BY a, b) AS neg FROM g)
SELECT a, b, round(sum(n * (tp - p / 2)) / (max(tot) * max(neg)), 6) AS auroc FROM x GROUP BY a, b""")  # fmt: skip
def weights_grid_search(t):
    """All weight pairs are scored in one pass: each row carries the grid."""
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _GRID])
    rows = _signals(t).select("novel", "k", "d", F.explode(grid).alias("g")).select("novel", "g.a", "g.b", F.round((F.col("g.a") * F.col("k") + F.col("g.b") * F.col("d")) / (F.col("g.a") + F.col("g.b")), 6).alias("score"))
    g = rows.groupBy("a", "b", "score").agg(F.sum(F.col("novel").cast("int")).alias("p"), F.sum(1 - F.col("novel").cast("int")).alias("n"))
    down = Window.partitionBy("a", "b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("tp", F.sum("p").over(down))
    return g.groupBy("a", "b").agg(F.round(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / (F.sum("p") * F.sum("n")), 6).alias("auroc"))


@query("split_processed_ood", """WITH n AS (SELECT c_mktsegment AS section, c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT section, id, CASE WHEN k > n - ceil(n * 0.2) THEN 'novel' ELSE 'known' END AS part FROM n""")  # fmt: skip
def split_processed_ood(t):
    """The last fifth of each section is novel."""
    rows = t("customer").select(F.col("c_mktsegment").alias("section"), F.col("c_custkey").alias("id"))
    placed = running(rows, ["section"], [F.col("id")], {"k": F.lit(1)}).join(rows.groupBy("section").agg(F.count("*").alias("n")), "section")
    return placed.select("section", "id", F.when(F.col("k") > F.col("n") - F.ceil(F.col("n") * F.lit(0.2)), "novel").otherwise("known").alias("part"))


@query("score_normalize", f"WITH {SQL_SCORES} SELECT vec_id AS query_id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS normalized FROM scores")
def score_normalize(t):
    rows = _scores(t)
    lo, hi = rows.agg(F.min("score"), F.max("score")).first()
    return rows.select("query_id", F.round(K.calibrated(F.col("score"), lo, hi), 6).alias("normalized"))


_GRAM_SET = "list_distinct([substr({0}, i, 3) for i in range(1, len({0}) - 1)])"
_ER = f"""er AS (SELECT c_nationkey = s_nationkey AS novel, {_GRAM_SET.format("coalesce(c_name, '')")} AS a, {_GRAM_SET.format("coalesce(s_name, '')")} AS w FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 120)"""


@query("eval_er_threshold_sweep", f"WITH {_ER}, scores AS (SELECT coalesce(novel, false) AS novel, CASE WHEN len(a) + len(w) = 0 THEN 0 ELSE round(len(list_intersect(a, w)) / len(list_distinct(list_concat(a, w))), 6) END AS score FROM er), th AS (SELECT i / 10.0::DOUBLE AS t FROM range(1, 10) r(i)), sw AS (SELECT t AS threshold, sum((score >= t AND novel)::INT)::BIGINT AS tp, sum((score >= t AND NOT novel)::INT)::BIGINT AS fp, sum((score < t AND novel)::INT)::BIGINT AS fn, sum((score < t AND NOT novel)::INT)::BIGINT AS tn FROM scores, th GROUP BY t) SELECT *, {_RATES} FROM sw")
def eval_er_threshold_sweep(t):
    """All labelled pairs, scored by the Jaccard similarity of the names' 3-grams."""
    k = F.col("c_custkey")
    left = t("customer").select(k.alias("id"), F.col("c_name").alias("text"), "c_nationkey")
    right = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"), "s_nationkey")
    labels = t("customer").join(right.withColumnRenamed("id", "right_id"), (k % 120) == F.col("right_id"), "left")
    pairs = labels.select(k.alias("left_id"), (k % 120).alias("right_id"), F.coalesce(F.col("c_nationkey") == F.col("s_nationkey"), F.lit(False)).alias("novel"))
    grams = lambda c: F.array_distinct(T.char_ngrams(F.col(c), 3))
    rows = E.er_pairs(pairs, left, right).select("novel", F.round(T.jaccard(grams("left"), grams("right")), 6).alias("score"))
    return E.threshold_sweep(rows, [i / 10 for i in range(1, 10)])


@query("compare_to_baseline", "WITH m AS (SELECT event_type, avg(value) AS v FROM events GROUP BY 1) SELECT event_type, round(v, 6) AS mean, round(v / (SELECT v FROM m WHERE event_type = 'click'), 6) AS ratio FROM m")
def compare_to_baseline(t):
    m = t("events").groupBy("event_type").agg(F.avg("value").alias("v"))
    base = F.max(F.when(F.col("event_type") == "click", F.col("v"))).over(Window.partitionBy())
    return m.select("event_type", F.round("v", 6).alias("mean"), F.round(F.col("v") / base, 6).alias("ratio"))


@query("proposal_group_summary", """WITH k AS (SELECT source, doc_id, len(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
SELECT source, CAST(floor((k - 1) / 20) AS BIGINT) AS part, count(*) AS members, CAST(sum(n) AS BIGINT) AS chars, min(doc_id) AS first_id FROM k GROUP BY ALL""")  # fmt: skip
def proposal_group_summary(t):
    """Members of each group in chunks of twenty."""
    rows = running(t("documents").select("source", "doc_id", F.length("text").alias("n")), ["source"], [F.col("doc_id")], {"k": F.lit(1)})
    return rows.groupBy("source", F.floor((F.col("k") - 1) / 20).alias("part")).agg(F.count("*").alias("members"), F.sum("n").alias("chars"), F.min("doc_id").alias("first_id"))


@query("retrieval_by_class", f"""WITH {SQL_EMB} SELECT a.vec_id AS query_id, b.label, b.vec_id AS ref_id, round(round(list_cosine_similarity(a.v, b.v), 9), 6) AS score FROM e a, ref b WHERE a.label >= 8
QUALIFY row_number() OVER (PARTITION BY a.vec_id, b.label ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) = 1""")  # fmt: skip
def retrieval_by_class(t):
    """The nearest example of each known class for every novel vector, in one search."""
    novel = probes(t).where("label >= 8").select("query_id", "v")
    return M.nearest(novel, references(t), 1, each="label").select("query_id", "label", "ref_id", F.round("score", 6).alias("score"))


@query("split_detection_by_share", _RUN + " SELECT round(sum(CASE WHEN fp <= floor(0.01 * neg) THEN p ELSE 0 END) / any_value(tot), 6) AS detection_rate FROM r")
def split_detection_by_share(t):
    return E.detection_rate_budget(_scores(t), 0.01, at_least=0)


@query("vector_store_query", f"""WITH {SQL_EMB} SELECT a.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS INT) AS rank, b.vec_id AS id,
round(round(list_cosine_similarity(a.v, b.v), 9), 6) AS score, b.kind FROM e a, (SELECT vec_id, v, CASE WHEN vec_id % 3 = 0 THEN 'late' ELSE 'early' END AS kind FROM e WHERE vec_id % 5 <> 0 AND label % 2 = 0) b WHERE a.label >= 8 QUALIFY rank <= 3""")  # fmt: skip
def vector_store_query(t):
    """Upserts replace, deletes remove, and a filter on metadata comes before the search."""
    rows = probes(t).select(F.col("query_id").alias("id"), "v", F.lit("early").alias("kind"), "label")
    store = M.VectorStore().upsert(rows).upsert(rows.where("id % 3 = 0").withColumn("kind", F.lit("late"))).delete(rows.where("id % 5 = 0"))
    near = store.query(probes(t).where("label >= 8").select("query_id", "v"), 3, where="label % 2 = 0")
    return near.select("query_id", "rank", "id", F.round("score", 6).alias("score"), "kind")


@query("match_explain", _LEX + """, best AS (SELECT query_id, id, text, round(score, 6) AS score FROM rowz QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id, text) = 1)
SELECT query_id, id, b.text, score, score >= 0.7 AS matched, array_to_string(list_sort(list_intersect(list_distinct([substr(lower(q.text), i, 3) for i in range(1, len(q.text) - 1)]), list_distinct([substr(lower(b.text), i, 3) for i in range(1, len(b.text) - 1)]))), ' ') AS shared
FROM best b JOIN q USING (query_id)""")  # fmt: skip
def match_explain(t):
    rows = M.explanation(_typo_queries(t), C.flatten(catalog_of_parts(t)).distinct(), 0.7, k=1)
    return rows.select("query_id", "id", "text", "score", "matched", F.array_join("shared", " ").alias("shared"))


@query("match_logistic_head")
def match_logistic_head(t):
    """A trained head over the known classes."""
    head = LogisticHead(references(t).select("label", "v"))
    return head.predict(probes(t)).select("query_id", "predicted", F.round("confidence", 4).alias("confidence"))
