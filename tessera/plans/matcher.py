"""The facade: a catalog that is fitted once and matched against many times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import blocking as B
from tessera.operators import catalog as C
from tessera.operators import combine as K
from tessera.operators.heads import LogisticHead
from tessera.operators import matching as M
from tessera.operators import strategies as S


class NotFitted(RuntimeError):
    """A trained mode is asked for before fit()."""


class Matcher:
    """Zero-shot by 3-gram cosine or by the cosine of an encoder's vectors, trained by class means or a logistic head over
    given vectors, or hybrid by blocking and reranking.

    encoder: a function of a text column that gives a vector; reranker: one of the texts of query and entity that gives a
    score. Both are columns, so that a model behind a Pandas UDF can stand in for the defaults."""

    def __init__(self, entities: DataFrame, threshold: float = 0.5, mode: str = "zero-shot", encoder=None, reranker=B.token_overlap):
        if not 0 <= threshold <= 1:
            raise ValueError("threshold must be in 0..1")
        if mode not in ("zero-shot", "trained", "hybrid"):
            raise ValueError(f"no mode {mode!r}")
        self.entities, self.threshold, self.mode = C.validated(entities), threshold, mode
        self.means = self.dims = self.head = None
        self.encoder, self.reranker = encoder, reranker

    def fit(self, examples: DataFrame, dims: int) -> Matcher:
        """Class means of examples (label, v)."""
        self.means, self.dims, self.mode = M.class_means(examples, dims).persist(), dims, "trained"
        return self

    def fit_head(self, examples: DataFrame, **settings) -> Matcher:
        """A logistic head on examples (label, v)."""
        self.head, self.mode = LogisticHead(examples, **settings), "trained"
        return self

    def add_class(self, entity: DataFrame, examples: DataFrame) -> Matcher:
        """An entity more, with its examples (label, v), for a fitted head."""
        if self.head is None:
            raise NotFitted("fit_head() first")
        self.add_entities(entity)
        self.head = self.head.add_class(examples)
        return self

    def add_entities(self, more: DataFrame) -> Matcher:
        self.entities = C.validated(C.appended(self.entities, more))
        return self

    def index(self) -> DataFrame:
        return C.flatten(self.entities).select("id", T.normalize(F.col("text")).alias("text")).distinct()

    def match(self, queries: DataFrame, k: int = 1, threshold: float | None = None, candidates: DataFrame | None = None) -> DataFrame:
        """Ranked matches of queries (query_id, text), in trained mode (query_id, v); nothing for those below threshold."""
        limit = self.threshold if threshold is None else threshold
        if self.mode == "trained":
            if self.means is None and self.head is None:
                raise NotFitted("fit() first")
            p = self.head.predict(queries) if self.head else M.centroid_probabilities(queries, self.means)
            rows = p.select("query_id", F.explode(F.arrays_zip("labels", "probabilities")).alias("x")).select("query_id", F.col("x.labels").alias("id"), F.round("x.probabilities", 6).alias("score"))
            if candidates is not None:
                rows = rows.join(candidates.select(F.col("id").cast(rows.schema["id"].dataType).alias("id")).distinct(), "id", "left_semi")
            return M.ranked(rows.where(F.col("score") >= limit), k)
        plain = queries.select("query_id", T.normalize(F.col("text")).alias("text"))
        index = self.index() if candidates is None else self.index().join(candidates.select("id").distinct(), "id", "left_semi")
        if self.mode == "hybrid":
            docs = index.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("text")), " ").alias("text"))
            return B.hybrid(plain, docs, k=k, threshold=limit, reranker=self.reranker)
        if self.encoder is not None:
            return M.encoded_match(plain, index, self.encoder, k, limit)
        return M.lexical_match(plain, index, k, limit)

    def explain(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """The best k entities of each query, whether they match, and what they share with it."""
        return M.explanation(queries.select("query_id", T.normalize(F.col("text")).alias("text")), self.index(), self.threshold, k)

    def diagnose(self, queries: DataFrame) -> DataFrame:
        return M.diagnosis(queries.select("query_id", T.normalize(F.col("text")).alias("text")), self.index(), self.threshold)

    def statistics(self) -> DataFrame:
        index = self.index()
        return index.agg(F.count("*").alias("n_texts"), F.countDistinct("id").alias("n_entities"))


class NoveltyDetector:
    """Runs strategies over vectors and combines their signals."""

    def __init__(self, references: DataFrame, dims: int, strategies: tuple[str, ...] = ("confidence", "knn_distance", "setfit_centroid"), combine: str = "weighted"):
        unknown = set(strategies) - {"confidence", "uncertainty", "knn_distance", "setfit_centroid", "prototypical", "energy_ood", "react_energy", "clustering", "lof", "setfit", "mahalanobis", "mixture_gaussian", "self_knowledge", "oneclass"}
        if unknown or combine not in ("weighted", "union", "intersection", "voting"):
            raise ValueError(f"unknown: {sorted(unknown) or combine}")
        self.references, self.dims, self.strategies, self.combine = references, dims, strategies, combine

    def _run(self, name: str, rows: DataFrame) -> DataFrame:
        run, refs, d = S.STRATEGIES[name], self.references, self.dims
        if name in ("confidence", "uncertainty"):
            return run(rows)
        if name in ("knn_distance", "lof", "setfit", "self_knowledge", "oneclass"):
            return run(rows, refs)
        return run(rows, refs, d)

    def detect(self, queries: DataFrame) -> DataFrame:
        """(query_id, predicted, confidence, f_<strategy>..., score, is_novel) of queries (query_id, v)."""
        rows = M.centroid_probabilities(queries, M.class_means(self.references, self.dims), keep=("v",)).persist()
        out = rows.select("query_id", "predicted", "confidence")
        signals = {}
        for name in self.strategies:
            got = self._run(name, rows)
            value = next((c for c in ("score", "mean_distance") if c in got.columns), None)
            got = got.select("query_id", F.col("is_novel").alias(f"f_{name}"), (F.col(value) if value else F.col("is_novel").cast("double")).cast("double").alias(f"s_{name}"))
            out = out.join(got, "query_id", "left")
            signals[name] = F.col(f"s_{name}")
        flags = [f"f_{n}" for n in self.strategies]
        score = {"weighted": K.weighted(signals), "union": K.any_flag(flags).cast("double"), "intersection": K.every_flag(flags).cast("double"), "voting": K.vote_share(flags)}[self.combine]
        novel = {"weighted": K.gated(F.col("score"), signals.get("uncertainty"), signals.get("knn_distance")) & K.any_flag(flags), "union": K.any_flag(flags), "intersection": K.every_flag(flags), "voting": K.majority(flags)}[self.combine]
        return out.withColumn("score", F.round(score, 6)).withColumn("is_novel", novel)
