"""Queries over texts, the catalog and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import blocking as B
from tessera.operators import catalog as C
from tessera.operators import matching as M
from tessera.plans.registry import DIMS, SQL_EMB, SQL_PARTS, SQL_PROBS, catalog_of_parts, probes, query, references, vectors

_SQ = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_NORM = _SQ.format(r"regexp_replace(lower(strip_accents(trim({0}))), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')")


@query("text_normalize", f"SELECT doc_id, md5({_NORM.format('text')}) AS normalized_md5 FROM documents")
def text_normalize(t):
    return t("documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("normalized_md5"))


_MARKED = "lower(trim(text))"
for _letters, _base in (("äàâ", "a"), ("éèê", "e"), ("íî", "i"), ("óöô", "o"), ("üúû", "u"), ("ñ", "n"), ("ç", "c")):
    _MARKED = f"regexp_replace({_MARKED}, '[{_letters}]', '{_base} ', 'g')"


@query("text_normalize_marks", "SELECT doc_id, md5(" + _SQ.format(f"regexp_replace({_MARKED}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')") + ") AS normalized_md5 FROM documents")
def text_normalize_marks(t):
    """Accents are kept, which decomposition makes marks of their own; with punctuation they become spaces."""
    return t("documents").select("doc_id", F.md5(T.normalize(F.col("text"), accents=False)).alias("normalized_md5"))


_CLEANED = lambda x: _SQ.format("regexp_replace(lower(" + _SQ.format(x) + r"), '[^\p{L}\p{N}_\s]', '', 'g')")


@query("text_clean", f"SELECT doc_id, md5({_CLEANED('text')}) AS clean_md5 FROM documents")
def text_clean(t):
    return t("documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("clean_md5"))


@query("text_tokenize", r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INT) AS n_tokens, CAST(len(list_distinct(w)) AS INT) AS n_distinct,
CAST(greatest(1, ceil(1.2 * len([x for x in regexp_split_to_array(lower(text), '\s+') if x <> '']))) AS BIGINT) AS token_estimate FROM w""")  # fmt: skip
def text_tokenize(t):
    w = T.tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(w).alias("n_tokens"), F.size(F.array_distinct(w)).alias("n_distinct"), T.token_estimate(F.col("text")).alias("token_estimate"))


SQL_EVIDENCE = "[x for x in regexp_extract_all(lower({0}), '[a-z0-9]+') if len(x) > 2 and x not in (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")]"


@query("text_evidence_tokens", f"SELECT doc_id, CAST(len({SQL_EVIDENCE.format('text')}) AS INT) AS n FROM documents")
def text_evidence_tokens(t):
    return t("documents").select("doc_id", F.size(T.evidence_tokens(F.col("text"))).alias("n"))


@query("text_char_ngrams", "SELECT DISTINCT p_name, CAST(len(list_distinct([substr(p_name, i, 3) for i in range(1, len(p_name) - 1)])) AS INT) AS n_grams FROM part")
def text_char_ngrams(t):
    return t("part").select("p_name").distinct().select("p_name", F.size(F.array_distinct(T.char_ngrams(F.col("p_name"), 3))).alias("n_grams"))


_TYPO_W = "string_split(p_name, ' ')"
_TYPO = f"""SELECT p_name, w, i, w[i] AS word FROM (SELECT p_name, w, list_position([len(x) for x in w], list_max([len(x) for x in w])) AS i FROM (SELECT DISTINCT p_name, {_TYPO_W} AS w FROM part))"""
_TYPO_TEXT = "CASE WHEN len(word) >= 5 THEN array_to_string([CASE WHEN j = i THEN substr(word, 1, len(word) // 2) || substr(word, len(word) // 2 + 2) ELSE w[j] END for j in range(1, len(w) + 1)], ' ') ELSE p_name END"


@query("text_perturb_holdout", f"""WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' & Sons' WHEN 2 THEN p_name || ' (' || p_brand || ')' ELSE p_name || ' & Sons (' || p_brand || '), ' || p_type END AS name,
p_name || ' SONS!' AS other FROM part), w AS (SELECT *, string_split({_CLEANED('name')}, ' ') AS w, {_CLEANED('name')} AS base FROM p), z AS (SELECT *, list_position([len(x) for x in w], list_max([len(x) for x in w])) AS i FROM w),
t AS (SELECT *, CASE WHEN len(w[i]) >= 5 THEN array_to_string([CASE WHEN j = i THEN substr(w[j], 1, len(w[j]) // 2) || substr(w[j], len(w[j]) // 2 + 2) ELSE w[j] END for j in range(1, len(w) + 1)], ' ') ELSE base END AS typo FROM z),
v AS (SELECT id, other, unnest([{{'at': 0, 'variant': 'typo', 'text': typo}}, {{'at': 1, 'variant': 'remove_parenthetical', 'text': {_CLEANED("regexp_replace(name, '[(][^)]*[)]', ' ', 'g')")}}}, {{'at': 2, 'variant': 'ampersand_expanded', 'text': {_CLEANED("replace(name, '&', ' and ')")}}},
{{'at': 3, 'variant': 'first_clause', 'text': {_CLEANED("regexp_extract(name, '^[^,;]*')")}}}, {{'at': 4, 'variant': 'normalized_verbatim', 'text': base}}]) AS u FROM t)
SELECT id, u.variant AS variant, u.text AS text FROM v WHERE u.text <> '' AND u.text <> {_CLEANED('other')} QUALIFY row_number() OVER (PARTITION BY id, u.text ORDER BY u.at) = 1""")  # fmt: skip
def text_perturb_holdout(t):
    """Names with ampersands, parentheses and clauses; a text that the entity has already is left out."""
    name, k = F.col("p_name"), F.col("p_partkey") % 4
    sons, brand = F.concat(name, F.lit(" & Sons")), F.concat(F.lit(" ("), "p_brand", F.lit(")"))
    full = F.when(k == 0, name).when(k == 1, sons).when(k == 2, F.concat(name, brand)).otherwise(F.concat(sons, brand, F.lit(", "), "p_type"))
    rows = t("part").select(F.col("p_partkey").alias("id"), full.alias("name"), F.concat(name, F.lit(" SONS!")).alias("text"))
    return C.holdout_queries(rows, rows.select("id", "text"))


@query("text_letter_case", r"""SELECT DISTINCT p_brand, CASE WHEN regexp_matches(p_brand, '^\P{L}*(\p{Lu}\p{Ll}*\P{L}+)*\p{Lu}\p{Ll}*\P{L}*$') THEN 'title_case' WHEN upper(p_brand) = p_brand AND lower(p_brand) <> p_brand THEN 'uppercase'
WHEN lower(p_brand) = p_brand AND upper(p_brand) <> p_brand THEN 'lowercase' ELSE 'mixed' END AS letter_case, list_distinct(regexp_extract_all(p_brand, '\\b[A-Z]{2,}')) = [] AS no_alias FROM part""".replace(r"\\b", r"\b"))  # fmt: skip
def text_letter_case(t):
    return t("part").select("p_brand").distinct().select("p_brand", T.letter_case(F.col("p_brand")).alias("letter_case"), (F.size(T.aliases_of(F.col("p_brand"))) == 0).alias("no_alias"))


@query("entity_flatten", f"WITH {SQL_PARTS} SELECT id, unnest(list_concat([name], aliases)) AS text FROM ents")
def entity_flatten(t):
    return C.flatten(catalog_of_parts(t))


@query("entity_validate_duplicates", "SELECT p_name AS id, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def entity_validate_duplicates(t):
    return C.duplicates(t("part").select(F.col("p_name").alias("id")))


@query("alias_unique_filter", """WITH a AS (SELECT c_custkey AS id, unnest(list_distinct([c_mktsegment, 'N' || c_nationkey, c_name])) AS alias FROM customer)
SELECT id, alias FROM a WHERE alias <> CAST(id AS VARCHAR) QUALIFY count(*) OVER (PARTITION BY alias) = 1""")  # fmt: skip
def alias_unique_filter(t):
    aliases = F.array_distinct(F.array("c_mktsegment", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), "c_name"))
    return C.unique_aliases(t("customer").select(F.col("c_custkey").alias("id"), aliases.alias("aliases")))


@query("synthetic_entities", "SELECT 'ENTITY_' || (i // 50) || ' text variant ' || (i % 50) AS text, 'ENTITY_' || (i // 50) AS label FROM range(500) r(i)")
def synthetic_entities(t):
    return C.synthetic(t.spark)


def _typo_queries(t):
    return t("part").select("p_name").distinct().select(F.translate("p_name", " ", "_").alias("query_id"), T.with_typo(F.col("p_name")).alias("text"))


_GRAMS = """{name} AS (SELECT k, gram, tf / sqrt(sum(tf * tf) OVER (PARTITION BY k)) AS w FROM (SELECT k, gram, CAST(count(*) AS DOUBLE) AS tf FROM
(SELECT k, unnest([substr(s, i, 3) for i in range(1, len(s) - 1)]) AS gram FROM (SELECT {key} AS k, lower(text) AS s FROM {source})) GROUP BY k, gram))"""
_LEX = f"""WITH {SQL_PARTS}, z AS ({_TYPO}), q AS (SELECT replace(p_name, ' ', '_') AS query_id, {_TYPO_TEXT} AS text FROM z),
{_GRAMS.format(name='qg', key='query_id', source='q')}, {_GRAMS.format(name='eg', key='text', source='(SELECT DISTINCT text FROM flat)')},
pairs AS (SELECT qg.k AS query_id, eg.k AS text, round(sum(qg.w * eg.w), 9) AS score FROM qg JOIN eg USING (gram) GROUP BY ALL),
rowz AS (SELECT query_id, id, text, score FROM pairs JOIN flat USING (text))"""
_BEST = """, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id, text) AS rn FROM {src} WHERE score >= {thr} QUALIFY rn <= 3 * {k}),
one AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY rn) = 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rn) AS INT) AS rank, id, text, round(score, 6) AS score FROM one QUALIFY rank <= {k}"""


@query("match_zero_shot_lexical", _LEX + _BEST.format(src="rowz", thr=0.5, k=1))
def match_zero_shot_lexical(t):
    return M.lexical_match(_typo_queries(t), C.flatten(catalog_of_parts(t)).distinct(), k=1, threshold=0.5)


@query("match_topk_alias_dedupe", _LEX + _BEST.format(src="rowz", thr=0.2, k=3))
def match_topk_alias_dedupe(t):
    return M.lexical_match(_typo_queries(t), C.flatten(catalog_of_parts(t)).distinct(), k=3, threshold=0.2)


@query("match_candidates_restricted", _LEX + ", few AS (SELECT * FROM rowz WHERE id IN (SELECT replace(p_name, ' ', '_') FROM part WHERE p_brand = 'Brand#1'))" + _BEST.format(src="few", thr=0.2, k=2))
def match_candidates_restricted(t):
    allowed = t("part").where("p_brand = 'Brand#1'").select(F.translate("p_name", " ", "_").alias("id"))
    return M.lexical_match(_typo_queries(t), C.flatten(catalog_of_parts(t)).distinct(), k=2, threshold=0.2, candidates=allowed)


@query("match_diagnose", _LEX + """, best AS (SELECT query_id, id, round(score, 6) AS score FROM rowz QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id, text) = 1)
SELECT query_id, id, score, CASE WHEN id IS NULL THEN 'no candidate' WHEN score < 0.7 THEN 'below threshold' ELSE 'matched' END AS issue, CASE WHEN score < 0.7 THEN 0.6::DOUBLE END AS suggested_threshold
FROM q LEFT JOIN best USING (query_id)""")  # fmt: skip
def match_diagnose(t):
    return M.diagnosis(_typo_queries(t), C.flatten(catalog_of_parts(t)).distinct(), threshold=0.7)


@query("match_centroid_softmax", f"WITH {SQL_PROBS} SELECT vec_id AS query_id, predicted, round(confidence, 6) AS confidence FROM pred")
def match_centroid_softmax(t):
    return M.centroid_probabilities(probes(t), M.class_means(references(t), DIMS)).select("query_id", "predicted", F.round("confidence", 6).alias("confidence"))


@query("match_mode_detect", """WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT count(*) AS n_labels, min(n) AS least, CAST(sum(n) AS BIGINT) AS total FROM c)
SELECT *, CASE WHEN n_labels = 0 THEN 'zero-shot' WHEN least >= 8 AND total >= 100 THEN 'bert' WHEN least < 3 THEN 'head-only' ELSE 'full' END AS mode FROM s""")  # fmt: skip
def match_mode_detect(t):
    return C.mode(t("orders").select(F.col("o_orderpriority").alias("label")))


def _benchmark(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(t):
    return t("documents").select(F.col("doc_id").alias("id"), "text")


@query("block_noop", "SELECT b.item_id AS query_id, CAST(rank AS INT) AS rank, id FROM benchmark b, (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 10)")
def block_noop(t):
    return B.first_entities(_benchmark(t), _docs(t), 10)


_BM = r"""WITH w AS (SELECT doc_id AS id, [x for x in regexp_split_to_array(lower(text), '\s+') if x <> ''] AS words FROM documents),
s AS (SELECT count(*) AS n, avg(len(words)) AS avg_len FROM w), tf AS (SELECT id, any_value(l) AS l, token, count(*) AS tf FROM (SELECT id, len(words) AS l, unnest(words) AS token FROM w) GROUP BY id, token),
df AS (SELECT token, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tf, s GROUP BY token, n), idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
q AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest([x for x in regexp_split_to_array(lower(text), '\s+') if x <> '']) AS token FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / avg_len))), 9) AS score FROM q JOIN idf USING (token) JOIN tf USING (token), s GROUP BY query_id, id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm)"""


@query("block_bm25", _BM + " SELECT query_id, CAST(rank AS INT) AS rank, id, round(score, 6) AS score FROM bmr WHERE rank <= 10")
def block_bm25(t):
    return B.bm25(_benchmark(t), _docs(t), 10)


_TOK = r"[x for x in regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') if len(x) >= 2]"
_TF = f"""n_docs AS (SELECT count(*) AS n FROM documents), dt AS (SELECT id, token, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_TOK}) AS token FROM documents) GROUP BY ALL),
voc AS (SELECT token, count(*) AS df FROM dt GROUP BY token), dw AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT id, token, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM dt JOIN voc USING (token), n_docs)),
qt AS (SELECT query_id, token, count(*) AS tf FROM (SELECT item_id AS query_id, unnest({_TOK}) AS token FROM benchmark) GROUP BY ALL),
qw AS (SELECT query_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM (SELECT query_id, token, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM qt JOIN voc USING (token), n_docs)),
ti AS (SELECT query_id, id, round(sum(qw.w * dw.w), 9) AS score FROM qw JOIN dw USING (token) GROUP BY query_id, id)"""


@query("block_tfidf", f"WITH {_TF} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank, id, round(score, 6) AS score FROM ti QUALIFY rank <= 10")
def block_tfidf(t):
    return B.tfidf(_benchmark(t), _docs(t), 10)


@query("hybrid_block_retrieve_rerank", _BM + f""", {_TF}, ret AS (SELECT t.query_id, t.id, round(t.score, 6) AS score FROM ti t JOIN bmr b ON b.query_id = t.query_id AND b.id = t.id AND b.rank <= 50
QUALIFY row_number() OVER (PARTITION BY t.query_id ORDER BY t.score DESC, t.id) <= 10), toks AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS td FROM documents),
qtok AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS tq FROM benchmark),
rr AS (SELECT query_id, id, score, round(len(list_intersect(tq, td)) / len(list_distinct(list_concat(tq, td))), 9) AS r FROM ret JOIN toks USING (id) JOIN qtok USING (query_id))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r DESC, id) AS INT) AS rank, id, score, round(r, 6) AS rerank_score FROM rr QUALIFY rank <= 3""")  # fmt: skip
def hybrid_block_retrieve_rerank(t):
    return B.hybrid(_benchmark(t), _docs(t))


@query("block_fuzzy")
def block_fuzzy(t):
    return B.fuzzy(_typo_queries(t), catalog_of_parts(t).select("id", F.col("name").alias("text")), 3)


@query("vector_knn_exact", f"""WITH {SQL_EMB} SELECT a.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS INT) AS rank, b.vec_id AS ref_id,
round(round(list_cosine_similarity(a.v, b.v), 9), 6) AS score FROM e a, e b WHERE a.vec_id <> b.vec_id QUALIFY rank <= 10""")  # fmt: skip
def vector_knn_exact(t):
    v = vectors(t)
    near = M.nearest(v.select(F.col("id").alias("query_id"), "v"), v.select(F.col("id").alias("ref_id"), "v"), 10, skip_same=True)
    return near.withColumn("score", F.round("score", 6))


@query("vector_knn_lsh")
def vector_knn_lsh(t):
    v = vectors(t)
    return M.nearest_lsh(v.select(F.col("id").alias("query_id"), "v"), v.select(F.col("id").alias("ref_id"), "v"), 10)


@query("vector_store_latest", """WITH ev AS (SELECT vec_id % 100 AS id, vec_id AS version, vec_id % 7 = 0 AS deleted, label FROM embeddings)
SELECT id, version, deleted, label FROM ev QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1 AND NOT deleted""")  # fmt: skip
def vector_store_latest(t):
    e = F.col("vec_id")
    return M.latest_versions(t("embeddings").select((e % 100).alias("id"), e.alias("version"), (e % 7 == 0).alias("deleted"), "label"))


@query("vector_truncated_similarity", """WITH u AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding[1:16]] AS v FROM embeddings), c AS (SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(v[i]) AS m FROM u, range(1, 17) r(i) GROUP BY i))
SELECT vec_id, round(list_cosine_similarity(v, mean), 6) AS cosine, round(1 / (1 + list_distance(v, mean)), 6) AS inverse_distance, round(list_dot_product(v, mean), 6) AS dot FROM u, c""")  # fmt: skip
def vector_truncated_similarity(t):
    u = vectors(t).select(F.col("id").alias("vec_id"), V.truncated(F.col("v"), 16, DIMS).alias("v"))
    mean = u.agg(V.mean_vector(F.col("v"), 16).alias("mean"))
    rows = u.join(F.broadcast(mean), how="inner")
    s = lambda m: F.round(V.similarity(F.col("v"), F.col("mean"), m), 6)
    return rows.select("vec_id", s("cosine").alias("cosine"), s("euclidean").alias("inverse_distance"), s("dot").alias("dot"))
