"""The discovery pipeline: detect, cluster, describe, propose, record for review."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import clusters as G
from tessera.operators import discovery as D
from tessera.operators.order import cut
from tessera.plans.matcher import NoveltyDetector


class StageError(RuntimeError):
    """A stage failed."""


@dataclass
class Stages:
    """Ordered stages over a dictionary of DataFrames, with timings; a failed one stops the run unless told otherwise."""

    continue_on_error: bool = False
    stages: list[tuple[str, Callable[[dict], dict]]] = field(default_factory=list)

    def add(self, name: str, run: Callable[[dict], dict]) -> Stages:
        self.stages.append((name, run))
        return self

    def run(self, state: dict) -> dict:
        seconds, errors = {}, {}
        for name, run in self.stages:
            began = time.monotonic()
            try:
                state = state | run(state)
            except Exception as e:
                if not self.continue_on_error:
                    raise StageError(f"{name}: {e}") from e
                errors[name] = str(e)
            seconds[name] = time.monotonic() - began
        return state | {"seconds": seconds, "errors": errors}


def discover(queries: DataFrame, references: DataFrame, dims: int, similarity: float = 0.75, min_size: int = 5, k: int = 15, min_stability: float | None = None) -> dict:
    """Runs all stages over queries (query_id, v, text) and references (ref_id, v, label).

    Returns detected, clusters (id, component), evidence, proposals and reviews. Without a cluster of min_size all novel
    rows are one."""
    detector = NoveltyDetector(references, dims)

    def detect(s):
        return {"detected": cut(detector.detect(queries))}

    def cluster(s):
        novel = s["detected"].where("is_novel").select("query_id").join(queries, "query_id").select(F.col("query_id").alias("id"), "v", "text")
        labels = G.components(novel, G.knn_graph(novel, k).where(F.col("weight") >= similarity), min_size)
        if labels.where("component >= 0").isEmpty():
            labels = labels.withColumn("component", F.lit(0))
        return {"novel": novel, "clusters": labels}

    def stable(s):
        if min_stability is None:
            return {}
        rows = s["clusters"].join(s["novel"], "id").select("id", "v", F.col("component").alias("label")).where("label >= 0")
        keep = G.stability(rows, dims).where(F.col("stability") >= min_stability)
        return {"clusters": s["clusters"].join(keep.select(F.col("label").alias("component")), "component", "left_semi")}

    def evidence(s):
        rows = s["clusters"].where("component >= 0").join(s["novel"], "id").select("component", "id", "text")
        return {"members": rows, "evidence": D.keywords(rows, "component"), "examples": D.representatives(rows, "component")}

    def propose(s):
        named = s["members"].select("id", "text", F.col("component").alias("predicted"))
        proposals = D.fallback_proposals(named)
        reviews = proposals.select(F.sha2("name", 256).alias("review_id"), F.col("name").alias("proposal_name"), F.lit("pending").alias("state"))
        return {"proposals": proposals, "reviews": reviews}

    return Stages().add("detect", detect).add("cluster", cluster).add("stability", stable).add("evidence", evidence).add("propose", propose).run({})
