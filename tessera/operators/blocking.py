"""Blocking: cheap candidates for each query, by keys that both sides share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions import text as T
from tessera.operators.matching import ranked
from tessera.operators.order import cut


def first_entities(queries: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """No blocking: the first k entities (id, ...) for every query; they are k rows, sent as one array."""
    top = entities.select("id").orderBy("id").limit(k).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return queries.join(F.broadcast(top), how="inner").select("query_id", F.posexplode("ids").alias("p", "id")).select("query_id", (F.col("p") + 1).alias("rank"), "id")


#: Distinct tokens of the queries, and numbers of the matrix of a block of queries, that a task holds at most.
QUERY_TOKENS, BLOCK_CELLS = 2_000_000, 8_000_000


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_id, rank, id, score): Okapi scores over white-space tokens, zero scores left out.

    A negative idf becomes epsilon times the mean idf. One pass counts documents and their tokens, with partial sums; in
    a second one each task holds the queries' tokens and multiplies its documents' counts by their weights, block by
    block, of which only k rows a query leave it. ValueError beyond QUERY_TOKENS of all queries together."""
    words = docs.select("id", T.spaced_tokens(F.col("text")).alias("words"))
    # the empty token, which no text has, counts the documents and all their tokens
    seen = words.select(F.explode(F.concat(F.array_distinct("words"), F.array(F.lit("")))).alias("token"), F.size("words").alias("len"))
    df = cut(seen.groupBy("token").agg(F.count("*").alias("df"), F.sum(F.when(F.col("token") == "", F.col("len"))).alias("total")))
    total = df.where("token = ''").select("df", "total").first()
    n, mean_len = (total["df"], (total["total"] or 0) / total["df"] or 1.0) if total else (0, 1.0)
    df = df.where("token <> ''").withColumn("raw", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean_idf = df.agg(F.avg("raw")).first()[0] or 0.0
    idf = df.select("token", F.when(F.col("raw") < 0, epsilon * mean_idf).otherwise(F.col("raw")).alias("idf"))
    q = queries.select("query_id", F.explode(T.spaced_tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    rows = q.join(idf, "token").select("query_id", "token", (F.col("qtf") * F.col("idf")).alias("w")).orderBy("query_id", "token").limit(QUERY_TOKENS + 1).toArrow()
    if len(rows) > QUERY_TOKENS:
        raise ValueError(f"more than {QUERY_TOKENS} tokens of queries: score them in parts")
    shared = docs.sparkSession.sparkContext.broadcast(_blocks(rows))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column("words")
                size = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(len(size)), size)
                tokens = lists.flatten()
                norm = k1 * (1 - b + b * size / mean_len)
                for ids, vocabulary, weights in shared.value:
                    place = pc.index_in(tokens, vocabulary)
                    there = place.is_valid().to_numpy(zero_copy_only=False)
                    if not there.any():
                        continue
                    cell = doc[there] * len(vocabulary) + place.filter(pa.array(there)).to_numpy()
                    tf = np.bincount(cell, minlength=len(size) * len(vocabulary)).reshape(len(size), -1).astype(np.float64)
                    yield from _best((tf * (k1 + 1) / (tf + norm[:, None])) @ weights, ids, part.column("id"), k)

    id_, query_id = words.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    scores = words.where(F.size("words") > 0).mapInArrow(run, f"query_id {query_id}, id {id_}, score double")
    return ranked(scores, k).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def _blocks(rows: pa.Table) -> list[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(ids, tokens, matrix of weights, tokens by ids) of rows (query_id, token, w), some queries at a time."""
    out = []
    ids = rows["query_id"].combine_chunks()
    starts = np.flatnonzero(np.concatenate(([True], pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)))) if len(ids) else np.zeros(0, int)
    ends = np.append(starts[1:], len(ids))
    at = 0
    while at < len(starts):
        to = at + 1
        while to < len(starts) and (ends[to] - starts[at]) * (to + 1 - at) <= BLOCK_CELLS:
            to += 1
        part = rows.slice(starts[at], ends[to - 1] - starts[at])
        coded = part["token"].combine_chunks().dictionary_encode()
        weights = np.zeros((len(coded.dictionary), to - at))
        weights[coded.indices.to_numpy(), np.repeat(np.arange(to - at), (ends - starts)[at:to])] = part["w"].to_numpy()
        out.append((ids.take(pa.array(starts[at:to])), coded.dictionary, weights))
        at = to
    return out


def _best(scores: np.ndarray, query_ids: pa.Array, ids: pa.Array, k: int):
    """The k best documents of each query in a block of scores, documents by queries, and all that tie with the last."""
    scores = np.round(scores, 9)
    last = np.partition(scores, -k, axis=0)[-k] if len(scores) > k else np.full(scores.shape[1], -np.inf)
    d, q = np.nonzero((scores >= last) & (scores != 0))
    if len(d):
        yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(q)), ids.take(pa.array(d)), pa.array(scores[d, q])], ["query_id", "id", "score"])


#: Tokens of a vocabulary that are sent to every task, and tokens of documents that a task counts at a time.
VOCABULARY_SENT, TOKENS_HELD = 2_000_000, 2_000_000


def token_counts(batch: pa.RecordBatch, column: str, most: int = TOKENS_HELD):
    """(rows of the batch, row, code, count, distinct tokens) of the lists of tokens, some rows at a time: how often each
    row has each of its tokens."""
    size = np.diff(batch.column(column).offsets.to_numpy()).astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)
    at = 0
    while at < batch.num_rows:
        to = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), most, side="right")))
        part = batch.slice(at, to - at)
        coded = part.column(column).flatten().dictionary_encode()
        width = max(1, len(coded.dictionary))
        cell, n = np.unique(np.repeat(np.arange(to - at), size[at:to]) * width + coded.indices.to_numpy(), return_counts=True)
        yield part, cell // width, cell % width, n, coded.dictionary
        at = to


def one_text_an_id(docs: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, text); texts of equal keys become one."""
    docs = docs.select(*keys, "text").where("text is not null")
    again = docs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return docs if again.isEmpty() else docs.groupBy(*keys).agg(F.array_join(F.collect_list("text"), " ").alias("text"))


def document_counts(tokens: DataFrame) -> DataFrame:
    """(token, df) of rows (tokens); tasks count before they send."""

    def run(batches):
        for batch in batches:
            for _, _, code, _, dictionary in token_counts(batch, "tokens"):
                yield pa.RecordBatch.from_arrays([dictionary, pa.array(np.bincount(code, minlength=len(dictionary)))], ["token", "df"])

    return tokens.select("tokens").where("tokens is not null").mapInArrow(run, "token string, df long").groupBy("token").agg(F.sum("df").alias("df"))


def tfidf_vectors(docs: DataFrame, vocabulary: DataFrame, n_docs: int, id_: str, wanted: DataFrame | None = None) -> DataFrame:
    """(id, token, w) of unit length, of the tokens of wanted (token), if given; vocabulary (token, df); smooth idf
    ln((1 + n) / (1 + df)) + 1. Tokens that are not in the vocabulary don't count.

    A document is weighed in the task that reads it: tokens of two documents or more are sent to every task, others of the
    vocabulary have a df of 1. Where those are more than VOCABULARY_SENT, weights are joined and met by document."""
    docs = one_text_an_id(docs, id_)
    often = vocabulary.where("df <> 1").limit(VOCABULARY_SENT + 1).toArrow() if wanted is not None else None
    some = wanted.select("token").distinct().limit(VOCABULARY_SENT + 1).toArrow() if wanted is not None else None
    if wanted is None or max(len(often), len(some)) > VOCABULARY_SENT:
        tf = docs.select(id_, F.explode(T.long_tokens(F.col("text"))).alias("token")).groupBy(id_, "token").agg(F.count("*").alias("tf"))
        w = tf.join(vocabulary, "token").withColumn("w", F.col("tf") * (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0))
        rows = w.groupBy(id_).agg(F.collect_list(F.struct("token", "w")).alias("ws"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
        out = rows.select(id_, "length", F.explode("ws").alias("x")).select(id_, "x.token", (F.col("x.w") / F.col("length")).alias("w"))
        return out if wanted is None else out.join(wanted.select("token").distinct(), "token", "left_semi")
    sent = docs.sparkSession.sparkContext.broadcast((often["token"].combine_chunks(), often["df"].to_numpy(), some["token"].combine_chunks()))

    def run(batches):
        vocabulary, df, some = sent.value
        for batch in batches:
            for part, row, code, n, dictionary in token_counts(batch, "tokens"):
                place = pc.index_in(dictionary, vocabulary)
                dfs = np.ones(len(dictionary))
                dfs[place.is_valid().to_numpy(zero_copy_only=False)] = df[place.drop_null().to_numpy()]
                w = n * (np.log((1.0 + n_docs) / (1.0 + dfs)) + 1.0)[code]
                length = np.sqrt(np.bincount(row, w * w, minlength=part.num_rows))
                keep = pc.is_in(dictionary, some).to_numpy(zero_copy_only=False)[code]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[keep])), dictionary.take(pa.array(code[keep])), pa.array(w[keep] / length[row[keep]])], [id_, "token", "w"])

    return docs.select(id_, T.long_tokens(F.col("text")).alias("tokens")).mapInArrow(run, f"{id_} {docs.schema[id_].dataType.simpleString()}, token string, w double")


def tfidf(queries: DataFrame, docs: DataFrame, k: int | None, candidates: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score): cosine of tf-idf vectors of tokens of two characters or more; candidates
    (query_id, id) restricts the pairs that are scored, and the documents whose vectors are made."""
    vocabulary = cut(document_counts(docs.select(T.long_tokens(F.col("text")).alias("tokens"))))
    n = docs.count()
    if candidates is not None:
        candidates = cut(candidates.select("query_id", "id"))
        docs = docs.join(candidates.select("id").distinct(), "id", "left_semi")
    q = cut(tfidf_vectors(queries, vocabulary, n, "query_id").withColumnRenamed("w", "wq"))
    d = tfidf_vectors(docs, vocabulary, n, "id", q)
    rows = q.join(d, "token")
    if candidates is not None:
        rows = q.join(candidates, "query_id").join(d, ["id", "token"])
    scores = rows.groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") * F.col("wq")), 9).alias("score"))
    return ranked(scores, k).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / both lengths, by bit-parallel counting."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    free, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        u = free & masks.get(c, 0)
        free = ((free + u) | (free - u)) & full
    return 200.0 * (len(a) - free.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b)])


def fuzzy(queries: DataFrame, entities: DataFrame, k: int, cutoff: float = 70.0, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, id, score): token-sorted indel ratio; the best k of cutoff or more. Texts without tokens have none.

    Exact: all pairs meet block by block, and those whose counts of shared characters, which bound the longest common
    subsequence, allow the cutoff are scored; only k rows a query leave a task."""
    def sorted_text(df, id_):
        rows = df.select(F.col(id_).alias(id_), F.array_join(F.array_sort(T.spaced_tokens(F.col("text"))), " ").alias("s"))
        return rows.where(F.length("s") > 0)

    q, e = sorted_text(queries, "query_id"), sorted_text(entities, "id")
    n = max(1, -(-e.count() // block_rows))
    m = max(-(-q.count() // block_rows), -(-16 // n))
    dealt = lambda df, id_, own, at, other, to: df.withColumn(at, F.pmod(F.xxhash64(id_), F.lit(own)).cast("int")).withColumn(to, F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).groupBy("qb", "eb")

    def counts(texts):
        # characters share 64 counts, which only raises the bound
        out = np.zeros((len(texts), 64), np.int32)
        for i, t in enumerate(texts):
            np.add.at(out[i], np.frombuffer(t.encode("utf-32-le"), np.uint32) % 64, 1)
        return out

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            right = right.sort_values("id")
            ids, texts = right["id"].tolist(), right["s"].tolist()
            have = counts(texts)
            size = have.sum(1)
            for query_id, text, own in zip(left["query_id"], left["s"], counts(left["s"].tolist())):
                bound = 200.0 * np.minimum(have, own).sum(1) / (size + own.sum())
                scored = [(round(indel_ratio(text, texts[i]), 6), i) for i in np.flatnonzero(bound >= cutoff - 1e-5)]
                rows += [(query_id, ids[i], x) for x, i in sorted((x for x in scored if x[0] >= cutoff), key=lambda x: (-x[0], x[1]))[:k]]
        return pd.DataFrame(rows, columns=["query_id", "id", "score"])

    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {e.schema['id'].dataType.simpleString()}, score double"
    scores = dealt(q, "query_id", m, "qb", n, "eb").cogroup(dealt(e, "id", n, "eb", m, "qb")).applyInPandas(meet, schema)
    return ranked(scores, k).select("query_id", "rank", "id", "score")


def token_overlap(query: Column, text: Column) -> Column:
    """The Jaccard similarity of token sets."""
    return T.jaccard(F.array_distinct(T.tokens(query)), F.array_distinct(T.tokens(text)))


def reranked(candidates: DataFrame, queries: DataFrame, docs: DataFrame, k: int, reranker: Callable[[Column, Column], Column] = token_overlap) -> DataFrame:
    """(query_id, rank, id, score, rerank_score): candidates by reranker(text of the query, text of the document)."""
    rows = candidates.join(queries.select("query_id", F.col("text").alias("tq")), "query_id").join(docs.select("id", F.col("text").alias("td")), "id")
    rows = rows.select("query_id", "id", "score", F.round(reranker(F.col("tq"), F.col("td")), 9).alias("rerank_score"))
    return ranked(rows, k, score="rerank_score").select("query_id", "rank", "id", "score", F.round("rerank_score", 6).alias("rerank_score"))


def hybrid(queries: DataFrame, docs: DataFrame, block_k: int = 50, retrieve_k: int = 10, k: int = 3, threshold: float | None = None, reranker: Callable[[Column, Column], Column] = token_overlap) -> DataFrame:
    """Block by BM25, retrieve by tf-idf cosine, rerank by token overlap or what else; threshold: the least cosine."""
    blocked = cut(bm25(queries, docs, block_k))
    found = tfidf(queries, docs, retrieve_k, blocked).drop("rank")
    return reranked(found if threshold is None else found.where(F.col("score") >= threshold), queries, docs, k, reranker)
