"""A trained head over vectors: balanced multinomial logistic regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V


class LogisticHead:
    """Classes of vectors, each class weighing the same; the fit is distributed over the examples."""

    def __init__(self, examples: DataFrame, reg: float = 0.01, iterations: int = 100):
        """examples: (label, v); ValueError with fewer than two classes."""
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector

        counts = examples.groupBy("label").agg(F.count("*").alias("n"))
        self.labels = [r[0] for r in counts.where("label is not null").select("label").orderBy("label").limit(100_001).collect()]
        if not 2 <= len(self.labels) <= 100_000:
            raise ValueError(f"a head needs 2 to 100,000 classes, not {len(self.labels)}")
        self.examples, self.reg, self.iterations = examples, reg, iterations
        total = examples.where("label is not null").count()
        index = F.array_position(self._names(), F.col("label")) - 1
        rows = examples.join(counts, "label").select(array_to_vector(V.dbl(F.col("v"))).alias("features"), index.cast("double").alias("y"), (F.lit(float(total)) / (len(self.labels) * F.col("n"))).alias("w"))
        self.model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=reg, maxIter=iterations, family="multinomial").fit(rows)

    def _names(self):
        return F.array(*[F.lit(x) for x in self.labels])

    def predict(self, queries: DataFrame) -> DataFrame:
        """(query_id, predicted, confidence, labels, probabilities) of queries (query_id, v); the most likely class first."""
        from pyspark.ml.functions import array_to_vector, vector_to_array

        rows = self.model.transform(queries.select("query_id", array_to_vector(V.dbl(F.col("v"))).alias("features")))
        pairs = F.sort_array(F.transform(F.arrays_zip(vector_to_array("probability").alias("p"), self._names().alias("label")), lambda x: F.struct(x["p"].alias("p"), x["label"].alias("label"))), asc=False)
        rows = rows.select("query_id", pairs.alias("x"))
        return rows.select("query_id", F.get("x", F.lit(0))["label"].alias("predicted"), F.get("x", F.lit(0))["p"].alias("confidence"), F.transform("x", lambda e: e["label"]).alias("labels"), F.transform("x", lambda e: e["p"]).alias("probabilities"))

    def add_class(self, examples: DataFrame) -> LogisticHead:
        """A head that also knows the classes of examples (label, v); fitted anew over all of them."""
        return LogisticHead(self.examples.select("label", "v").unionByName(examples.select("label", "v")), self.reg, self.iterations)

    def retrained(self, examples: DataFrame) -> LogisticHead:
        """A head for the same classes on other examples; ValueError where these have other classes."""
        other = LogisticHead(examples, self.reg, self.iterations)
        if other.labels != self.labels:
            raise ValueError("the examples have other classes")
        return other
