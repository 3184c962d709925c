"""Queries against their SQL on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
duckdb = pytest.importorskip("duckdb")

CHECKED = [n for n in sorted(catalog.ORACLE_SQL) if n.startswith(("match_", "hier_", "eval_", "split_", "cluster_", "drift_", "entity_", "graph_", "review_", "block_bm25", "ood_lof", "ood_conformal", "combine_flags", "evidence_tfidf", "stream_"))]


def rows(frame):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, db, name):
    got = rows(catalog.QUERIES[name](spark, SF).toPandas())
    assert got == rows(db.execute(catalog.ORACLE_SQL[name]).df())


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """Vectors in eleven files, more than a batch of a limited stream takes."""
    folder = tmp_path_factory.mktemp("many")
    spark.read.parquet(f"{SF}/embeddings.parquet").repartition(11).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["stream_drift", "stream_incremental_cluster"])
def test_streams_of_many_files_equal_their_sql(spark, db, many_files, name):
    assert rows(catalog.QUERIES[name](spark, many_files).toPandas()) == rows(db.execute(catalog.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_meta_learner_reads_its_signals_once(spark):
    """The fit and the scores read a checkpoint, not the searches that make the signals."""
    assert "Join" not in catalog.QUERIES["combine_meta_learner"](spark, SF)._jdf.queryExecution().toString()
