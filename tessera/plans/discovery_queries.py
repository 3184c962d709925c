"""Queries over graphs, clusters, the hierarchy, evidence, proposals, review, active learning, drift and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import clusters as G
from tessera.operators import discovery as D
from tessera.operators import hierarchy as H
from tessera.operators import matching as M
from tessera.plans.matching_queries import SQL_EVIDENCE
from tessera.plans.novelty_queries import SQL_TWO, _predicted
from tessera.plans.registry import DIMS, SQL_EMB, SQL_PROBS, query, references, vectors

_GRAPH = f"""WITH RECURSIVE {SQL_EMB}, nn AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM e a, e b WHERE a.vec_id <> b.vec_id
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) <= {{k}}),
graph AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, round(max(s), 6) AS weight FROM nn GROUP BY ALL HAVING max(s) > 0)"""


@query("graph_knn", _GRAPH.format(k=15) + " SELECT * FROM graph")
def graph_knn(t):
    return G.knn_graph(vectors(t), 15)


_COMPONENTS = """, ed AS (SELECT src, dst FROM graph WHERE weight >= 0.3 UNION SELECT dst, src FROM graph WHERE weight >= 0.3),
reach AS (SELECT vec_id AS id, vec_id AS to_id FROM e UNION SELECT reach.id, ed.dst FROM reach JOIN ed ON ed.src = reach.to_id),
lab AS (SELECT id, min(to_id) AS component FROM reach GROUP BY id)"""


@query("graph_connected_components", _GRAPH.format(k=3) + _COMPONENTS + " SELECT id, CASE WHEN count(*) OVER (PARTITION BY component) >= 5 THEN component ELSE -1 END AS component FROM lab")
def graph_connected_components(t):
    v = vectors(t)
    return G.components(v, G.knn_graph(v, 3).where("weight >= 0.3"), min_size=5)


@query("cluster_communities")
def cluster_communities(t):
    v = vectors(t)
    return G.communities(v, G.knn_graph(v, 15))


@query("cluster_density", f"""WITH RECURSIVE {SQL_EMB}, s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM e a, e b WHERE a.vec_id <> b.vec_id AND round(list_cosine_similarity(a.v, b.v), 9) >= 1 - 0.7),
core AS (SELECT a AS id FROM s GROUP BY a HAVING count(*) >= 5), ed AS (SELECT a, b FROM s WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id, id AS to_id FROM core UNION SELECT reach.id, ed.b FROM reach JOIN ed ON ed.a = reach.to_id), lab AS (SELECT id, min(to_id) AS component FROM reach GROUP BY id),
border AS (SELECT a AS id, component FROM (SELECT a, b FROM s WHERE a NOT IN (SELECT id FROM core) AND b IN (SELECT id FROM core) QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) = 1) JOIN lab ON lab.id = b),
allof AS (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM (SELECT * FROM lab UNION ALL SELECT * FROM border)) SELECT vec_id AS id, CASE WHEN n >= 5 THEN component ELSE -1 END AS component FROM e LEFT JOIN allof ON allof.id = vec_id""")  # fmt: skip
def cluster_density(t):
    return G.density_components(vectors(t), eps=0.7)


_CO = "co AS (SELECT label, any_value(n) AS n, (sum(s * s) - any_value(n)) / (any_value(n) * (any_value(n) - 1)) AS cohesion FROM (SELECT label, i, count(*) AS n, sum(v[i] / sqrt(list_dot_product(v, v))) AS s FROM e, range(1, 65) r(i) GROUP BY label, i) GROUP BY label)"
_AM = "am AS (SELECT label, list(m ORDER BY i) AS mean FROM (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) r(i) GROUP BY label, i) GROUP BY label)"
_SEP = "se AS (SELECT a.label, round(min(1 - list_cosine_similarity(a.mean, b.mean)), 6) AS separation FROM am a, am b WHERE a.label <> b.label GROUP BY a.label)"


@query("cluster_cohesion", f"WITH {SQL_EMB}, {_CO} SELECT label, n, round(cohesion, 6) AS cohesion FROM co")
def cluster_cohesion(t):
    return G.class_cohesion(vectors(t), DIMS).withColumn("cohesion", F.round("cohesion", 6))


@query("cluster_separation", f"WITH {SQL_EMB}, {_AM}, {_SEP} SELECT * FROM se")
def cluster_separation(t):
    return G.separation(vectors(t), DIMS)


@query("cluster_quality", f"WITH {SQL_EMB}, {_CO}, {_AM}, {_SEP} SELECT label, n, round(cohesion, 6) AS cohesion, separation, n >= 5 AND round(cohesion, 6) >= 0.1 AS valid FROM co JOIN se USING (label)")
def cluster_quality(t):
    return G.quality(vectors(t), DIMS, min_cohesion=0.1)


@query("cluster_merges", f"WITH {SQL_EMB}, {_AM} SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.mean, b.mean), 6) AS similarity FROM am a, am b WHERE a.label < b.label AND round(list_cosine_similarity(a.mean, b.mean), 6) >= 0.1")
def cluster_merges(t):
    return G.merges(vectors(t), DIMS, limit=0.1)


@query("cluster_incremental_assign", f"WITH {SQL_EMB}, b AS (SELECT vec_id AS id, min_by(label, (-round(c, 9), label)) AS l, max(round(c, 9)) AS s FROM cd GROUP BY vec_id) SELECT id, CASE WHEN s >= 0.4 THEN l ELSE -1 END AS cluster, round(s, 6) AS similarity FROM b")
def cluster_incremental_assign(t):
    return G.assign(vectors(t), M.class_means(references(t), DIMS), threshold=0.4)


_H8 = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) % 10000"


@query("cluster_stability", f"""WITH {SQL_EMB}, sm AS (SELECT rep, vec_id, label, v FROM e, range(1, 6) r(rep) WHERE {_H8.format("rep || ':' || vec_id")} < 5507),
mm AS (SELECT rep, label, list(m ORDER BY i) AS mean FROM (SELECT rep, label, i, avg(v[i]) AS m FROM sm, range(1, 65) r(i) GROUP BY ALL) GROUP BY rep, label),
bb AS (SELECT s.rep, s.label, s.vec_id, min_by(m.label, (-round(list_cosine_similarity(v, mean), 9), m.label)) AS got FROM sm s JOIN mm m USING (rep) GROUP BY ALL),
ce AS (SELECT rep, label, got, count(*) AS k, sum(count(*)) OVER (PARTITION BY rep, label) AS n, sum(count(*)) OVER (PARTITION BY rep, got) AS m FROM bb GROUP BY rep, label, got)
SELECT label, round(avg(j), 6) AS stability FROM (SELECT rep, label, max(k / (n + m - k)) AS j FROM ce GROUP BY ALL) GROUP BY label""")  # fmt: skip
def cluster_stability(t):
    return G.stability(vectors(t), DIMS, replicates=5)


# ---- hierarchy ----------------------------------------------------------------------


def _tree(t):
    """Regions, nations and customers as entities with parents."""
    none = F.array().cast("array<string>")
    weights = F.lit(None).cast("map<string,double>")
    r = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), none.alias("parents"))
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.array(F.concat(F.lit("r"), "n_regionkey")).alias("parents"))
    c = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.array(F.concat(F.lit("n"), "c_nationkey"), F.lit("unknown")).alias("parents"))
    return r.unionByName(n).unionByName(c).select("id", "parents", none.alias("children"), weights.alias("weights"))


_EDGES = "ed AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"
_CLOSE = f"WITH RECURSIVE {_EDGES}, cl(id, ancestor, depth) AS (SELECT dst, src, 1 FROM ed UNION SELECT cl.id, ed.src, depth + 1 FROM cl JOIN ed ON ed.dst = cl.ancestor)"


@query("hier_edges", f"WITH {_EDGES} SELECT src, dst, 1.0::DOUBLE AS weight FROM ed")
def hier_edges(t):
    return H.edges(_tree(t))


@query("hier_ancestors", _CLOSE + " SELECT * FROM cl")
def hier_ancestors(t):
    return H.ancestors(H.edges(_tree(t)))


@query("hier_descendants", _CLOSE + " SELECT ancestor AS id, id AS descendant, depth FROM cl")
def hier_descendants(t):
    return H.descendants(H.edges(_tree(t)))


@query("hier_depth", _CLOSE + """, p AS (SELECT 'c' || c_custkey AS a, 'r' || (c_custkey % 5) AS b FROM customer UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region)
SELECT a, b, CASE WHEN a = b THEN 0 ELSE coalesce((SELECT min(depth) FROM cl WHERE id = a AND ancestor = b), (SELECT min(depth) FROM cl WHERE id = b AND ancestor = a), -1) END AS depth FROM p""")  # fmt: skip
def hier_depth(t):
    c = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("r"), (F.col("c_custkey") % 5).cast("string")).alias("b"))
    n = t("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("a"), F.concat(F.lit("n"), "n_nationkey").alias("b"))
    r = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("a"), F.concat(F.lit("r"), "r_regionkey").alias("b"))
    return H.relation_depth(c.unionByName(n).unionByName(r), H.closure(H.edges(_tree(t))))


@query("hier_path", f"WITH {_EDGES} SELECT DISTINCT src AS id, src AS path FROM ed WHERE src[1] = 'r' UNION ALL SELECT dst, src || '/' || dst FROM ed WHERE src[1] = 'r' UNION ALL SELECT b.dst, a.src || '/' || b.src || '/' || b.dst FROM ed b JOIN ed a ON a.dst = b.src")
def hier_path(t):
    return H.root_paths(H.edges(_tree(t))).select("id", F.array_join("path", "/").alias("path"))


@query("hier_match", _CLOSE + """, base AS (SELECT n_nationkey AS query_id, 'n' || n_nationkey AS id, 0.5 + n_nationkey / 100.0 AS score FROM nation),
c AS (SELECT query_id, id, score, 'self' AS relation, 0 AS depth, 0.5 AS boost FROM base UNION ALL SELECT query_id, ancestor, score, CASE WHEN depth = 1 THEN 'parent' ELSE 'ancestor' END, depth, CASE WHEN depth = 1 THEN 0.4 ELSE 0.3 END FROM base JOIN cl USING (id)
UNION ALL SELECT query_id, cl.id, score, CASE WHEN depth = 1 THEN 'child' ELSE 'descendant' END, depth, CASE WHEN depth = 1 THEN 0.4 ELSE 0.3 END FROM base JOIN cl ON cl.ancestor = base.id),
s AS (SELECT query_id, id, relation, depth, round((0.7 * score + 0.3 * boost) * CASE depth WHEN 0 THEN 1 WHEN 1 THEN 0.9 WHEN 2 THEN 0.75 WHEN 3 THEN 0.6 WHEN 4 THEN 0.5 ELSE 0.4 END, 6)::DOUBLE AS score FROM c)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank, id, score, relation, depth FROM s QUALIFY rank <= 5""")  # fmt: skip
def hier_match(t):
    k = F.col("n_nationkey")
    base = t("nation").select(k.alias("query_id"), F.concat(F.lit("n"), k.cast("string")).alias("id"), (0.5 + k / 100.0).alias("score"))
    return H.match(base, H.closure(H.edges(_tree(t))), 5)


# ---- evidence and proposals -----------------------------------------------------------


def _by_source(t):
    return t("documents").select("source", F.col("doc_id").alias("id"), "text")


@query("evidence_tfidf", f"""WITH tf AS (SELECT source, doc_id, token, count(*) AS tf FROM (SELECT source, doc_id, unnest({SQL_EVIDENCE.format('text')}) AS token FROM documents) GROUP BY ALL), n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
df AS (SELECT source, token, count(*) AS df FROM tf GROUP BY source, token QUALIFY row_number() OVER (PARTITION BY source ORDER BY sum(tf) DESC, token) <= 1000), w AS (SELECT source, doc_id, token, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (source, token) JOIN n USING (source)),
u AS (SELECT source, token, w / sqrt(sum(w * w) OVER (PARTITION BY source, doc_id)) AS w FROM w), m AS (SELECT source, token, round(sum(w) / any_value(n), 9) AS score FROM u JOIN n USING (source) GROUP BY source, token)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, token) AS INT) AS rank, token, round(score, 6) AS score FROM m QUALIFY rank <= 8""")  # fmt: skip
def evidence_tfidf(t):
    return D.keywords(_by_source(t), "source")


@query("evidence_rake", f"""WITH s AS (SELECT source, {SQL_EVIDENCE.format('s')} AS w FROM (SELECT source, unnest(regexp_split_to_array(text, '[.!?;]+')) AS s FROM documents)), f AS (SELECT * FROM s WHERE len(w) > 0),
wd AS (SELECT source, word, count(*) AS freq, sum(l - 1) AS degree FROM (SELECT source, len(w) AS l, unnest(w) AS word FROM f) GROUP BY ALL),
pr AS (SELECT source, w[i : i + k - 1] AS run, count(*) AS n FROM (SELECT source, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS k)) GROUP BY ALL),
sc AS (SELECT e.source, array_to_string(run, ' ') AS phrase, round(any_value(n) * sum(degree) / sum(freq), 6) AS score FROM (SELECT source, run, n, unnest(run) AS word FROM pr) e JOIN wd ON wd.source = e.source AND wd.word = e.word GROUP BY e.source, run)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, phrase) AS INT) AS rank, phrase, score FROM sc QUALIFY rank <= 8""")  # fmt: skip
def evidence_rake(t):
    return D.rake(_by_source(t), "source")


@query("evidence_representatives", r"""WITH k AS (SELECT source, doc_id AS id, CAST(greatest(1, ceil(1.2 * len([x for x in regexp_split_to_array(lower(text), '\s+') if x <> '']))) AS BIGINT) AS tokens FROM documents),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY id) AS INT) AS rank, sum(tokens) OVER (PARTITION BY source ORDER BY id ROWS UNBOUNDED PRECEDING) AS used FROM k)
SELECT source, rank, id, tokens FROM r WHERE rank <= 4 AND (used <= 256 OR rank = 1)""")  # fmt: skip
def evidence_representatives(t):
    return D.representatives(_by_source(t), "source")


@query("evidence_representatives_near", f"""WITH {SQL_EMB}, mm AS (SELECT label, list(m ORDER BY i) AS mean FROM (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
r AS (SELECT label, vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 5 ELSE 3 END::BIGINT AS tokens, CAST(row_number() OVER (PARTITION BY label ORDER BY round(list_cosine_similarity(v, mean), 9) DESC, vec_id) AS INT) AS rank FROM e JOIN mm USING (label)),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY label ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM r WHERE rank <= 4) SELECT label, rank, id, tokens FROM u WHERE used <= 12 OR rank = 1""")  # fmt: skip
def evidence_representatives_near(t):
    text = F.when(F.col("id") % 3 == 0, "one two three four").otherwise("one two")
    return D.representatives(vectors(t).withColumn("text", text), "label", budget=12, dims=DIMS)


@query("proposals_fallback", f"""WITH {SQL_PROBS}, n AS (SELECT vec_id, predicted, row_number() OVER (PARTITION BY predicted ORDER BY vec_id) AS k FROM pred WHERE round(confidence, 6) < 0.5)
SELECT 'Novel ' || predicted AS name, 0.5::DOUBLE AS confidence, count(*) AS sample_count, string_agg('vector ' || vec_id, ',' ORDER BY vec_id) FILTER (k <= 3) AS examples FROM n GROUP BY predicted HAVING count(*) >= 3""")  # fmt: skip
def proposals_fallback(t):
    novel = _predicted(t).where(F.round("confidence", 6) < 0.5).select(F.col("query_id").alias("id"), F.concat(F.lit("vector "), F.col("query_id").cast("string")).alias("text"), "predicted")
    return D.fallback_proposals(novel).withColumn("examples", F.array_join("examples", ","))


_CONFLICTS = """WITH p AS (SELECT n_name AS name, replace(lower(n_name), ' ', '') AS plain, CASE WHEN n_nationkey % 6 = 5 THEN [] ELSE list_distinct([n_nationkey % 7, n_nationkey % 5, n_regionkey]) END AS ids,
list_distinct([CAST(n_nationkey % 4 AS VARCHAR), CAST(n_nationkey % 2 AS VARCHAR)]) AS ex, (n_nationkey % 10) / 10.0 AS confidence, n_nationkey % 8 AS sample_count FROM nation),
x AS (SELECT a.name AS a, b.name AS b, a.confidence AS ca, b.confidence AS cb, a.sample_count AS sa, b.sample_count AS sb, len(a.ids) AS na, len(b.ids) AS nb, len(list_intersect(a.ids, b.ids)) AS shared,
CASE WHEN len(a.ids) + len(b.ids) = 0 THEN 0 ELSE round(len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids))), 6) END AS s, round(len(list_intersect(a.ex, b.ex)) / len(list_distinct(list_concat(a.ex, b.ex))), 6) AS e,
a.plain = b.plain OR (len(a.plain) > 2 AND len(b.plain) > 2 AND (contains(a.plain, b.plain) OR contains(b.plain, a.plain))) AS alike FROM p a JOIN p b ON a.name < b.name),
y AS (SELECT *, s < 0.3 AND e < 0.3 AS little FROM x WHERE shared > 0 OR alike),
z AS (SELECT *, CASE WHEN little THEN 1.0 ELSE greatest(s, e) END AS overlap, CASE WHEN little THEN 'duplicate' WHEN na = 0 OR nb = 0 THEN 'partial' WHEN shared = na AND shared = nb THEN 'duplicate' WHEN shared > 0 AND (shared = na OR shared = nb) THEN 'nested' ELSE 'partial' END AS kind FROM y WHERE NOT little OR alike),
c AS (SELECT a, b, overlap::DOUBLE AS overlap, kind, CASE WHEN CASE kind WHEN 'duplicate' THEN ca >= cb WHEN 'nested' THEN na >= nb ELSE ca >= cb AND sa >= sb END THEN 'keep_a' ELSE 'keep_b' END AS recommendation FROM z)"""


def _proposals(t):
    k = F.col("n_nationkey")
    ids = F.array((k % 7).cast("int"), (k % 5).cast("int"), F.col("n_regionkey").cast("int"))
    return t("nation").select(F.col("n_name").alias("name"), F.when(k % 6 == 5, F.array().cast("array<int>")).otherwise(ids).alias("source_ids"), F.array((k % 4).cast("string"), (k % 2).cast("string")).alias("examples"), ((k % 10) / 10.0).alias("confidence"), (k % 8).alias("sample_count"))


@query("proposals_conflicts", _CONFLICTS + " SELECT * FROM c")
def proposals_conflicts(t):
    return D.conflicts(_proposals(t))


@query("proposals_resolved", _CONFLICTS + " SELECT name FROM p WHERE name NOT IN (SELECT CASE recommendation WHEN 'keep_a' THEN b ELSE a END FROM c)")
def proposals_resolved(t):
    return D.resolved(_proposals(t)).select("name")


_STATE = "CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' ELSE 'pending' END"


@query("review_transitions", f"""WITH r AS (SELECT o_orderkey AS review_id, {_STATE} AS state, CASE o_orderkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'promoted' ELSE 'rejected' END AS "to" FROM orders), j AS (SELECT *, (state, "to") IN (('pending', 'approved'), ('pending', 'rejected'), ('approved', 'approved'), ('approved', 'promoted'), ('rejected', 'rejected'), ('promoted', 'promoted')) AS ok FROM r)
SELECT review_id, CASE WHEN ok THEN "to" ELSE state END AS state, ok FROM j""")  # fmt: skip
def review_transitions(t):
    state = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "rejected").otherwise("pending")
    key = F.col("o_orderkey")
    requests = t("orders").select(key.alias("review_id"), F.when(key % 3 == 0, "approved").when(key % 3 == 1, "promoted").otherwise("rejected").alias("to"))
    return D.moved(t("orders").select(key.alias("review_id"), state.alias("state")), requests)


@query("review_counts", f"SELECT {_STATE} AS state, count(*) AS n FROM orders GROUP BY 1")
def review_counts(t):
    state = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "rejected").otherwise("pending")
    return t("orders").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("active_uncertainty_topn", f"WITH {SQL_PROBS} SELECT vec_id AS query_id, round(1 - (ps[1] - ps[2]), 6) AS uncertainty FROM pred ORDER BY uncertainty DESC, query_id LIMIT 20")
def active_uncertainty_topn(t):
    return D.uncertainty_sample(_predicted(t), 20, "margin")


@query("active_apply_annotations", "SELECT CASE WHEN label % 3 = 0 THEN 'new_entity' WHEN label < 8 THEN 'training' ELSE 'unknown_label' END AS kind, count(*) AS n FROM embeddings GROUP BY 1")
def active_apply_annotations(t):
    label = F.col("label").cast("string")
    entities = references(t).select(label.alias("id")).distinct()
    return D.annotated(t("embeddings").select(F.when(F.col("label") % 3 == 0, F.concat(F.lit("novel:"), label)).otherwise(label).alias("label"), F.lit("").alias("text")), entities)


# ---- drift and metrics ----------------------------------------------------------------


def _halves(t):
    v = vectors(t)
    return v.where("id % 2 = 0"), v.where("id % 2 = 1")


_HALF = "m AS (SELECT i, avg(v[i]) FILTER (vec_id % 2 = 0) AS b, avg(v[i]) FILTER (vec_id % 2 = 1) AS c FROM e, range(1, 65) r(i) GROUP BY i), dr AS (SELECT round(sum((c - b) * (c - b)), 6) AS mmd_linear, round(1 - sum(b * c) / sqrt(sum(b * b) * sum(c * c)), 6) AS cosine_centroid FROM m)"


@query("drift_means", f"WITH {SQL_EMB}, {_HALF} SELECT * FROM dr")
def drift_means(t):
    return D.mean_drift(*_halves(t), DIMS)


@query("drift_per_class", f"""WITH {SQL_EMB}, m AS (SELECT label, i, avg(v[i]) FILTER (vec_id % 2 = 0) AS b, avg(v[i]) FILTER (vec_id % 2 = 1) AS c FROM e, range(1, 65) r(i) GROUP BY ALL)
SELECT label, round(1 - sum(b * c) / sqrt(sum(b * b) * sum(c * c)), 6) AS drift FROM m GROUP BY label""")  # fmt: skip
def drift_per_class(t):
    return D.class_drift(*_halves(t), DIMS)


@query("drift_recommendation", f"WITH {SQL_EMB}, {_HALF} SELECT mmd_linear AS score, CASE WHEN mmd_linear <= 0.05 THEN 'monitor' WHEN mmd_linear > 3 * 0.05 THEN 'retrain' ELSE 'add_entities' END AS recommendation FROM dr")
def drift_recommendation(t):
    return D.mean_drift(*_halves(t), DIMS).select(F.col("mmd_linear").alias("score"), D.recommendation(F.col("mmd_linear"), 0.05).alias("recommendation"))


@query("drift_kl_gaussian_two", f"""WITH {SQL_TWO}, h AS (SELECT vec_id % 2 AS h, avg(x) AS mx, avg(y) AS my, covar_samp(x, x) + 1e-3 AS a, covar_samp(x, y) AS b, covar_samp(y, y) + 1e-3 AS d FROM e GROUP BY 1)
SELECT round(greatest(0, 0.5 * ((o.d * n.a - 2 * o.b * n.b + o.a * n.d + o.d * (n.mx - o.mx) ** 2 - 2 * o.b * (n.mx - o.mx) * (n.my - o.my) + o.a * (n.my - o.my) ** 2) / (o.a * o.d - o.b * o.b) - 2 + ln(o.a * o.d - o.b * o.b) - ln(n.a * n.d - n.b * n.b))), 6) AS kl
FROM h o, h n WHERE o.h = 0 AND n.h = 1""")  # fmt: skip
def drift_kl_gaussian_two(t):
    halves = [h.withColumn("v", F.slice("v", 1, 2)) for h in _halves(t)]
    return t.spark.createDataFrame([(round(D.kl_gaussian(*halves, 2, ridge=1e-3), 6),)], "kl double")


@query("drift_kl_gaussian")
def drift_kl_gaussian(t):
    return t.spark.createDataFrame([(round(D.kl_gaussian(*_halves(t), DIMS, ridge=1e-3), 4),)], "kl double")


@query("metrics_summary", "SELECT event_type AS name, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def metrics_summary(t):
    p = F.percentile("value", [0.5, 0.95, 0.99])
    rows = t("events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), p.alias("p"))
    return rows.select("name", "n", "total", "mean", "low", "high", *[F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])
