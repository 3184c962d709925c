"""The corpus pipeline, stage by stage, against brute force on each stage's own input."""

import os
import re

import pytest

from tests.llm.test_operators import brute_components, brute_hits, brute_lines

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{n}")
        after = spark.read.parquet(f"{folder}/{n}")
        out[name] = docs.collect(), after.collect(), docs.columns, after.columns
        docs = after
    return out


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_columns(stages):
    for name, (_, _, before, after) in list(stages.items())[:-1]:
        assert before == after == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near duplicates", "decontamination", "mixing"]


def test_quality(spark, stages):
    before, after, _, _ = stages["quality classifier"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(texts(after))
    judged = [(i in kept) == bool(labels[i]) for i in texts(before) if i in labels]
    assert sum(judged) >= 0.95 * len(judged)
    assert all(texts(before)[i] == t for i, t in texts(after).items())


def test_lines(stages):
    before, after, _, _ = stages["line dedup"]
    want = {i: (n, t) for i, (_, n, t) in brute_lines(list(texts(before).items())).items()}
    assert texts(after) == {i: t for i, (n, t) in want.items() if not n or t.strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_duplicates(stages):
    before, after, _, _ = stages["near duplicates"]
    groups = brute_components(texts(before).items(), 5, 80)
    assert texts(after) == {i: t for i, t in texts(before).items() if groups[i][1] == i}


def test_decontamination(spark, stages):
    before, after, _, _ = stages["decontamination"]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = texts(after)
    for i, t in texts(before).items():
        n, hit, _ = brute_hits(t, items, 13)
        assert (i in left) == (hit == 0 or 20 * hit < n)
        if i in left:
            assert (left[i] == t) == (hit == 0) and brute_hits(left[i], items, 13)[1] == 0


def test_mixing(stages):
    before, after, _, _ = stages["mixing"]
    assert {r["doc_id"] for r in after} == set(texts(before))
    assert sum(r["n_tokens"] for r in after) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts(before).values())
    assert all(r["rate"] >= 0 for r in after)


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, SF).select("doc_id").collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stages["mixing"][1]}


ODD = [(None, "a b c d e f g h"), (None, None), (None, "no one else has these words in it"), (1, "same words as the other row of it"), (1, "same words as the other row of it"), (1, "one two three four five"),
       (2, "Same words as the other row of it"), (3, ""), (4, " \n"), (5, "a b c d e f g h"), (6, "x " * 200_000), (7, "l1\nl2\nl3"), (8, "l1\nl2\nl3"), (8, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "en", 7) for i, t in ODD], "doc_id long, text string, row int, lang string, n_chars long")


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_near_duplicates_by_row(spark, odd):
    """Rows without doc_id, and of rows that repeat one each is judged by itself."""
    got = corpus_pipeline.near_duplicates(spark, odd, SF)
    assert got.columns == odd.columns
    assert pairs(got) == sorted([(None, None), (None, ODD[2][1]), (1, ODD[3][1]), (1, ODD[5][1]), (3, ""), (4, " \n"), (5, ODD[9][1]), (6, ODD[10][1]), (7, ODD[11][1]), (8, None)], key=str)


def test_lines_of_odd_rows(spark, odd):
    got = corpus_pipeline.lines(spark, odd, SF)
    assert pairs(got) == sorted([p for p in ODD if p != (8, ODD[12][1])], key=str)


def test_other_stages_on_odd_rows(spark, odd):
    assert pairs(corpus_pipeline.decontamination(spark, odd, SF)) == sorted(ODD, key=str)
    kept = pairs(corpus_pipeline.quality(spark, odd, SF))
    assert all(kept.count(p) in (0, ODD.count(p)) for p in ODD)
    rows = corpus_pipeline.mix(spark, odd, SF).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == sorted((str(i), len((t or "").split())) for i, t in ODD)


@pytest.mark.parametrize("n", range(5))
def test_empty_tables(spark, odd, n):
    assert corpus_pipeline.STAGES[n][1](spark, odd.limit(0), SF).count() == 0
