import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocking as B
from tessera.operators import catalog as C
from tessera.operators import clusters as G
from tessera.operators import combine as K
from tessera.operators import discovery as D
from tessera.operators import evaluation as E
from tessera.operators import hierarchy as H
from tessera.operators import matching as M
from tessera.operators import strategies as S
from tessera.plans.discovery import StageError, Stages, discover
from tessera.plans.matcher import Matcher, NotFitted, NoveltyDetector
from tessera.sources import readers, sinks

COUNTRIES = [{"id": "DE", "name": "Germany", "aliases": ["Deutschland", "Deutchland"]}, {"id": "FR", "name": "France", "aliases": ["Frankreich"]}, {"id": "US", "name": "United States", "aliases": ["USA", "America"]}]
SIX = [(0, [1.0, 0, 0], "a"), (1, [0.9, 0.1, 0], "a"), (2, [0, 1.0, 0], "b"), (3, [0.1, 0.9, 0], "b"), (4, [0, 0, 1.0], "c"), (5, [0, 0, 0.9], "c")]


@pytest.fixture(scope="module")
def catalog(spark):
    return readers.entities(spark, COUNTRIES)


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame([(i, [float(x) for x in v], label) for i, v, label in SIX], "ref_id long, v array<double>, label string")


@pytest.fixture(scope="module")
def probes(spark):
    return spark.createDataFrame([(0, [0.99, 0.01, 0.0]), (1, [0.5, 0.5, 0.5])], "query_id long, v array<double>")


def test_catalog(spark, catalog):
    assert C.flatten(catalog).count() == 8
    with pytest.raises(C.CatalogError):
        C.validated(catalog.unionByName(catalog))
    with pytest.raises(C.CatalogError):
        C.validated(catalog.limit(0))
    unique = spark.createDataFrame([("en", ["en", "english", "x"]), ("fr", ["x", "french"])], "id string, aliases array<string>")
    assert {tuple(r) for r in C.unique_aliases(unique).collect()} == {("en", "english"), ("fr", "french")}


@pytest.mark.parametrize(("counts", "mode"), [({}, "zero-shot"), ({"a": 50, "b": 60}, "bert"), ({"a": 2, "b": 60}, "head-only"), ({"a": 5, "b": 6}, "full")])
def test_mode(spark, counts, mode):
    rows = [(k,) for k, n in counts.items() for _ in range(n)]
    assert C.mode(spark.createDataFrame(rows, "label string")).first()["mode"] == mode


def test_matcher(spark, catalog, six):
    m = Matcher(catalog, threshold=0.4)
    q = spark.createDataFrame([(1, "germny"), (2, "Frankreich!"), (3, "zzz")], "query_id long, text string")
    got = {r["query_id"]: r["id"] for r in m.match(q).collect()}
    assert got == {1: "DE", 2: "FR"}
    only = m.match(q, candidates=spark.createDataFrame([("FR",)], "id string")).collect()
    assert [r["id"] for r in only] == ["FR"]
    assert {r["query_id"]: r["issue"] for r in m.diagnose(q).collect()}[3] == "no candidate"
    assert m.statistics().first()["n_entities"] == 3
    with pytest.raises(ValueError):
        Matcher(catalog, threshold=2)
    trained = Matcher(catalog, 0.0, mode="trained")
    v = spark.createDataFrame([(1, [0.95, 0.05, 0.0])], "query_id long, v array<double>")
    with pytest.raises(NotFitted):
        trained.match(v)
    top = trained.fit(six, 3).match(v, k=3).collect()
    assert [r["id"] for r in top][0] == "a" and len(top) == 3


def test_alias_dedupe(spark):
    """Three rows of one id and two of another: the best row of each id counts."""
    vecs = [("DE", "t1", [1.0, 0.0]), ("DE", "t2", [1.0, 0.0]), ("DE", "t3", [1.0, 0.0]), ("US", "u1", [0.7, 0.7]), ("FR", "f1", [0.0, 1.0])]
    rows = spark.createDataFrame([(0, i, t, float(v[0])) for i, t, v in vecs], "query_id long, id string, entity_text string, score double")
    assert [r["id"] for r in M.best_of_ids(rows, 2).orderBy("rank").collect()] == ["DE", "US"]


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = M.nearest(df.select(F.col("id").alias("query_id"), "v"), df.select(F.col("id").alias("ref_id"), "v"), 3, block_rows=7, skip_same=True).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    for r in got:
        assert r["ref_id"] == np.argsort(-s[r["query_id"]])[r["rank"] - 1]
    assert len(got) == 180


def test_versions(spark):
    ev = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False)], "id string, version int, deleted boolean")
    assert [r["id"] for r in M.latest_versions(ev).collect()] == ["b"]


def test_blocking(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green pear"), (3, "blue plum cake")], "id long, text string")
    q = spark.createDataFrame([(7, "apple pie")], "query_id long, text string")
    assert B.bm25(q, docs, 1).first()["id"] == 1
    assert B.tfidf(q, docs, 1).first()["id"] == 1
    assert B.hybrid(q, docs, 2, 2, 1).first()["id"] == 1
    assert B.fuzzy(q, docs, 3, cutoff=50).first()["id"] == 1
    assert B.indel_ratio("abc", "abc") == 100 and B.indel_ratio("", "") == 100 and B.indel_ratio("ab", "cd") == 0
    assert B.indel_ratio("kitten", "sitting") == pytest.approx(100 * 2 * 4 / 13)
    assert B.first_entities(q, docs, 2).count() == 2


@pytest.mark.parametrize("name", ["knn_distance", "setfit_centroid", "prototypical", "energy_ood", "react_energy"])
def test_strategies_find_the_odd_one(spark, six, probes, name):
    run = S.STRATEGIES[name]
    args = {"knn_distance": {"k": 2, "threshold": 0.3}, "prototypical": {"dims": 3, "threshold": 0.3}}.get(name, {"dims": 3})
    flags = {r["query_id"]: r["is_novel"] for r in run(probes, six, **args).collect()}
    assert flags == {0: False, 1: True}


def test_gaussian_strategies(spark, six, probes):
    rows = probes.withColumn("predicted", F.lit("a"))
    m = {r["query_id"]: r["distance"] for r in S.mahalanobis(rows, six, 3).collect()}
    x = {k: np.array([v for _, v, label in SIX if label == k]) for k in "abc"}
    within = sum((v - v.mean(0)).T @ (v - v.mean(0)) for v in x.values()) / 3 + 1e-4 * np.eye(3)
    d = np.array([0.99, 0.01, 0]) - x["a"].mean(0)
    assert m[0] == pytest.approx(np.sqrt(d @ np.linalg.inv(within) @ d), abs=1e-5) and m[1] > m[0]
    ll = {r["query_id"]: r["log_likelihood"] for r in S.mixture_gaussian(probes, six, 3, ridge=0.05).collect()}
    assert ll[0] > ll[1]


def test_uncertainty(spark):
    rows = spark.createDataFrame([(0, 0.95, [0.95, 0.03, 0.02]), (1, 0.5, [0.5, 0.4, 0.1])], "query_id long, confidence double, probabilities array<double>")
    assert {r["query_id"]: r["is_novel"] for r in S.uncertainty(rows).collect()} == {0: False, 1: True}
    assert D.uncertainty_sample(rows, 1).first()["query_id"] == 1
    with pytest.raises(ValueError):
        D.uncertainty_sample(rows, 1, "other")
    with pytest.raises(ValueError):
        S.strategy("confidence")(lambda: None)


def test_conformal(spark):
    cal = spark.createDataFrame([(i / 10, "A" if i <= 5 else "B") for i in range(1, 11)], "score double, label string")
    tests = spark.createDataFrame([(0, 0.05, "A"), (1, 0.15, "A"), (2, 0.5, "B"), (3, 1.5, "C")], "id long, score double, label string")
    p = {r["id"]: r["p"] for r in S.p_values(tests, cal).collect()}
    assert p[0] == 1 and p[0] > p[1] > p[2] > p[3] == pytest.approx(1 / 11)
    by = {r["id"]: r["p"] for r in S.p_values(tests, cal, by="label").collect()}
    assert by[2] == 1 and by[3] == pytest.approx(1 / 11)


def test_combination(spark):
    rows = spark.createDataFrame([(0, True, False), (1, True, True), (2, False, False)], "query_id long, a boolean, b boolean")
    got = rows.select("query_id", K.any_flag(["a", "b"]), K.every_flag(["a", "b"]), K.majority(["a", "b"]), K.every_flag([])).orderBy("query_id").collect()
    assert [tuple(r)[1:] for r in got] == [(True, False, False, False), (True, True, True, False), (False, False, False, False)]
    w = rows.select(K.weighted({"confidence": F.col("a"), "knn_distance": F.col("b")}).alias("s")).collect()
    assert w[1]["s"] == pytest.approx(0.8 / 0.8) and w[2]["s"] == 0
    assert K.calibration(spark.createDataFrame([(float(i),) for i in range(100)], "score double"))["low"] == pytest.approx(4.95)
    assert spark.range(1).select(K.calibrated(F.lit(1.0), 2.0, 2.0)).first()[0] == 0
    assert {r["strategy"]: r["n_flagged"] for r in K.signal_counts(rows, ["a", "b"]).collect()} == {"a": 2, "b": 1}
    assert sum(K.adaptive(0.5, 1.0, 0.5, 0.9).values()) == pytest.approx(1)


def test_evaluation(spark):
    rows = spark.createDataFrame([(False, 0.1), (False, 0.2), (True, 0.9), (True, 0.8)], "novel boolean, score double")
    assert E.auroc(rows).first()[0] == 1 and E.average_precision(rows).first()[0] == 1 and E.auprc_trapezoid(rows).first()[0] == 1
    assert E.auroc(rows.where("novel")).first()[0] == 0.5
    assert E.detection_rate_budget(rows, 0.0, at_least=0).first()[0] == 1
    assert E.optimal_threshold(rows).first()["f1"] == 1
    assert E.threshold_sweep(rows, [0.5]).first()["accuracy"] == 1


def test_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(8, 9)], "src long, dst long")
    got = {r["id"]: r["component"] for r in G.components(nodes, edges, min_size=3).collect()}
    assert all(got[i] == 0 for i in range(7)) and all(got[i] == -1 for i in range(7, 12))


def test_hierarchy(spark):
    rows = [("EU", [], ["DE", "FR"], None), ("DE", [], ["DE-BY"], None), ("FR", [], [], None), ("DE-BY", ["DE", "nowhere"], [], {"DE": 0.8})]
    tree = spark.createDataFrame(rows, "id string, parents array<string>, children array<string>, weights map<string,double>")
    edges = H.edges(tree)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("EU", "DE"), ("EU", "FR"), ("DE", "DE-BY")}
    assert [r["ancestor"] for r in H.ancestors(edges, 1).where("id = 'DE-BY'").collect()] == ["DE"]
    assert {r["descendant"] for r in H.descendants(edges).where("id = 'EU'").collect()} == {"DE", "FR", "DE-BY"}
    assert {r["id"]: r["path"] for r in H.root_paths(edges).collect()}["DE-BY"] == ["EU", "DE", "DE-BY"]


def test_proposals_and_reviews(spark):
    rows = [("Tech Startup", [1, 2, 3], ["x"], 0.9, 5), ("techstartup", [9], ["y"], 0.5, 2), ("Other", [2, 3, 4], ["x"], 0.4, 9), ("Nested", [2, 3], [], 0.7, 1), ("startup", [77], [], 0.2, 1), ("Alone", [50], ["x"], 0.9, 9)]
    p = spark.createDataFrame(rows, "name string, source_ids array<int>, examples array<string>, confidence double, sample_count int")
    got = {(r["a"], r["b"]): (r["overlap"], r["kind"], r["recommendation"]) for r in D.conflicts(p).collect()}
    assert got == {
        ("Tech Startup", "techstartup"): (1.0, "duplicate", "keep_a"), ("Other", "Tech Startup"): (1.0, "partial", "keep_b"), ("Nested", "Tech Startup"): (0.666667, "nested", "keep_b"), ("Nested", "Other"): (0.666667, "nested", "keep_b"),
        ("Tech Startup", "startup"): (1.0, "duplicate", "keep_a"), ("startup", "techstartup"): (1.0, "duplicate", "keep_b"),
    }
    assert {r["name"] for r in D.resolved(p).collect()} == {"Tech Startup", "Alone"}
    reviews = spark.createDataFrame([("x", "pending"), ("y", "rejected")], "review_id string, state string")
    moves = spark.createDataFrame([("x", "approved"), ("y", "promoted")], "review_id string, to string")
    assert {r["review_id"]: (r["state"], r["ok"]) for r in D.moved(reviews, moves).collect()} == {"x": ("approved", True), "y": ("rejected", False)}
    assert D.upserted(reviews, reviews.limit(1).withColumn("state", F.lit("approved"))).count() == 2


def test_drift(spark):
    rng = np.random.default_rng(1)
    make = lambda m: spark.createDataFrame([((rng.normal(size=3) * 0.1 + m).tolist(),) for _ in range(100)], "v array<double>")
    base, near, far = make([1, 0, 0]), make([1, 0, 0]), make([5, 0, 0])
    assert D.mean_drift(base, near, 3).first()["mmd_linear"] < 0.05 < D.mean_drift(base, far, 3).first()["mmd_linear"]
    assert D.kl_gaussian(base, near, 3) < 1 < D.kl_gaussian(base, far, 3)


def test_detector_and_discovery(spark):
    rng = np.random.default_rng(2)
    centers = np.eye(8) * 3
    ref = spark.createDataFrame([(i, (centers[i % 3] + rng.normal(size=8) * 0.05).tolist(), int(i % 3)) for i in range(60)], "ref_id long, v array<double>, label int")
    rows = [(i, (centers[i % 3 if i < 20 else 6] + rng.normal(size=8) * 0.05).tolist(), f"text {i} about cheese") for i in range(30)]
    q = spark.createDataFrame(rows, "query_id long, v array<double>, text string")
    got = {r["query_id"]: r["is_novel"] for r in NoveltyDetector(ref, 8).detect(q).collect()}
    assert all(got[i] for i in range(20, 30)) and not any(got[i] for i in range(20))
    out = discover(q, ref, 8)
    assert out["proposals"].first()["sample_count"] == 10 and out["reviews"].first()["state"] == "pending"
    assert out["evidence"].where("token = 'cheese'").count() == 1
    with pytest.raises(StageError):
        Stages().add("x", lambda s: 1 / 0).run({})
    assert Stages(continue_on_error=True).add("x", lambda s: 1 / 0).run({})["errors"]["x"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "languages").mkdir()
    (tmp_path / "languages" / "all.csv").write_text("id,name,aliases,type\nen,English,en|anglais,language\n")
    row = readers.processed_sections(spark, str(tmp_path)).first()
    assert row["section"] == "languages/all" and row["aliases"] == ["anglais"]
    raw = spark.createDataFrame([("aa", "aar", "", "Afar", "afar"), ("", "ace", "", "Achinese", "aceh")], ["alpha2", "alpha3-b", "alpha3-t", "English", "French"])
    got = {r["id"]: r["aliases"] for r in readers.languages(raw).collect()}
    assert got == {"aa": "aa|aar|afar", "ace": "ace|aceh"}
    zones = spark.createDataFrame([("# x",), ("AD\t+4230+00131\tEurope/Andorra",)], "value string")
    assert readers.timezones(zones).first()["name"] == "Andorra"
    assert readers.universities(spark.createDataFrame([("MIT, Boston", "US"), ("MIT, Boston", "US")], "name string, country string")).first()["id"] == "mit_boston"
    assert readers.products_unspsc(spark.createDataFrame([("10101501", "Cats")], "code string, title string")).first()["aliases"] == "10|1010|101015"
    assert readers.merged_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}} and readers.config_value({"a": {"b": 1}}, "a.b") == 1
    with pytest.raises(ValueError):
        sinks.csv(raw.limit(0), str(tmp_path / "o"))
    sinks.report(spark.createDataFrame([(1, ["a"])], "x int, y array<string>"), str(tmp_path / "r"), "csv")
    with pytest.raises(ValueError):
        sinks.report(raw, str(tmp_path / "r"), "xml")
    store = str(tmp_path / "store")
    raw.write.parquet(store)
    sinks.replaced(spark.read.parquet(store).limit(1), store)
    assert spark.read.parquet(store).count() == 1
    for name, text in (("tableA", "id,n\n1,x\n"), ("tableB", "id,n\n2,y\n"), ("test", "ltable_id,rtable_id,label\n1,2,1\n1,9,0\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    assert {tuple(r) for r in readers.pairs(spark, str(tmp_path)).collect()} == {("x", "y", 1), ("x", "", 0)}


def test_encoder(spark):
    from tessera.functions import encode

    rows = encode.encoded(spark.createDataFrame([(1, "small ring"), (2, "small ring"), (3, "zz")], "id int, text string")).orderBy("id").collect()
    assert rows[0]["v"] == rows[1]["v"] and sum(x * x for x in rows[0]["v"]) == pytest.approx(1) and set(rows[2]["v"]) == {0.0}


def test_datasets(spark, tmp_path, six):
    from tessera.sources import datasets as X

    spark.createDataFrame([("a", "x", 1)], "text string, label string, more int").write.parquet(str(tmp_path / "d"))
    reg = X.Registry([X.Dataset("d", "classification", str(tmp_path / "d"))])
    assert reg.load(spark, "d", str(tmp_path / "cache")).columns == ["text", "label"] and reg.load(spark, "d", str(tmp_path / "cache")).count() == 1
    with pytest.raises(ValueError):
        reg.add(reg.by_name["d"])
    assert [d.name for d in reg.of_task("classification")] == ["d"]
    raw = spark.createDataFrame([("EUR", "978", "Euro", "X")], ["AlphabeticCode", "NumericCode", "Currency", "Entity"])

    def broken():
        raise OSError("no network")

    jobs = [X.Ingestion("currencies", broken, readers.currencies, lambda: raw), X.Ingestion("bad", broken, readers.currencies)]
    got = X.ingest_all(jobs, str(tmp_path / "out"))
    assert got[0] == {"name": "currencies", "rows": 1} and "no network" in got[1]["error"]
    with pytest.raises(OSError):
        X.ingest_all(jobs, str(tmp_path / "out"), continue_on_error=False)
    a, b = (X.snapshot(df, 3).where("label is null").first() for df in (six, six.orderBy(F.desc("ref_id"))))
    assert a == b and a["n"] == 6
    (tmp_path / "discovery_20240102_030405_x.json").write_text("{}")
    assert X.proposal_files(spark, str(tmp_path)).first()["created"].year == 2024


def test_lsh_recall(spark):
    """Spread vectors, close groups, and buckets so narrow that queries find too few."""
    rng = np.random.default_rng(3)
    spread, groups = rng.normal(size=(300, 64)), np.repeat(rng.normal(size=(10, 64)), 30, 0) + rng.normal(size=(300, 64)) * 0.3
    for x, length in ((spread, 0.5), (groups, 0.5), (rng.normal(size=(300, 8)), 0.5), (spread[:60], 1e-6)):
        v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "query_id long, v array<double>")
        refs = v.withColumnRenamed("query_id", "ref_id")
        got, want = ({(r["query_id"], r["ref_id"]) for r in d.collect()} for d in (M.nearest_lsh(v, refs, 10, bucket_length=length), M.nearest(v, refs, 10)))
        assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_density_beyond_twenty_neighbours(spark):
    """Against brute force: groups of copies, a dense class, zero vectors, several blocks."""
    rng = np.random.default_rng(4)
    two = np.repeat([[1.0, 0.0], [0.9, np.sqrt(0.19)]], 25, 0)
    mixed = np.concatenate([np.repeat(rng.normal(size=(3, 6)), 30, 0), rng.normal(size=(60, 6)), rng.normal(size=6) * 3 + rng.normal(size=(40, 6)), np.zeros((8, 6))])
    for x, eps, block in ((two, 0.3, 4096), (mixed, 0.3, 4096), (mixed, 0.3, 30), (mixed, 0.1, 30)):
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
        got = {r["id"]: r["component"] for r in G.density_components(rows, eps=eps, block_rows=block).collect()}
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        s = np.round(u @ u.T, 9)
        np.fill_diagonal(s, -1)
        core = (s >= 1 - eps).sum(1) >= 5
        label = np.where(core, np.arange(len(x)), -1)
        for _ in range(len(x)):
            label = np.array([min([label[i], *label[core & (s[i] >= 1 - eps)]]) if core[i] else -1 for i in range(len(x))])
        near = np.where(core, s, -1).argmax(1)
        want = [label[i] if core[i] else label[near[i]] if core.any() and s[i, near[i]] >= 1 - eps else -1 for i in range(len(x))]
        want = [c if want.count(c) >= 5 else -1 for c in want]
        assert [got[i] for i in range(len(x))] == want
    assert len(set(want)) > 2


def test_conformal_counts_all(spark):
    """Against direct counts: ties, a third of the rows on one score, small, missing and null classes, null scores."""
    assert "max_calibration" not in S.p_values.__code__.co_varnames
    rng = np.random.default_rng(5)
    cal = [(0.5 if i % 3 == 0 else float(rng.integers(0, 50)) / 10, ["a", "b", None][i % 3] if i else "rare") for i in range(3000)] + [(None, "b")]
    tests = [(i, float(rng.integers(-2, 60)) / 10, ["a", "b", "rare", "new", None][i % 5]) for i in range(200)]
    c, t = spark.createDataFrame(cal, "score double, label string"), spark.createDataFrame(tests, "id long, score double, label string")
    for by in (None, "label"):
        got = {r["id"]: r["p"] for r in S.p_values(t, c, by).collect()}
        assert len(got) == len(tests)
        for i, score, label in tests:
            own = [s for s, of in cal if by and of == label and label is not None] or [s for s, _ in cal]
            assert got[i] == pytest.approx((sum(s is None or s >= score for s in own) + 1) / (len(own) + 1))
    assert [r["p"] for r in S.p_values(t, c.limit(0), "label").collect()] == [1.0] * len(tests)


def test_fuzzy_scores_all_pairs(spark):
    """Short names and scattered typos share no run of letters."""
    rng = np.random.default_rng(6)
    names = ["abc", "ibm", "wabxcdxef", "éa b", "b a"] + ["".join(rng.choice(list("abcd é"), rng.integers(1, 9))) for _ in range(150)]
    asked = ["bc", "bm", "qabcdef", "", None] + ["".join(rng.choice(list("abcd é"), rng.integers(1, 9))) for _ in range(40)]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    e = spark.createDataFrame(list(enumerate(names)), "id long, text string")
    key = lambda t: " ".join(sorted((t or "").lower().split()))
    for block in (4096, 20):
        got = {}
        for r in sorted(B.fuzzy(q, e, 3, block_rows=block).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        for i, text in enumerate(asked):
            scores = [(-round(B.indel_ratio(key(text), key(t)), 6), j) for j, t in enumerate(names) if key(text) and key(t)]
            assert got.get(i, []) == [(j, -s) for s, j in sorted(scores)[:3] if -s >= 70]
        assert (0, 80.0) in got[0] and (1, 80.0) in got[1] and (2, 75.0) in got[2]


def test_hierarchy_of_any_depth(spark):
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", 1.0) for i in range(40)] + [("x", "y", 1.0), ("y", "x", 1.0)], "src string, dst string, weight double")
    assert H.closure(chain).agg(F.max("depth")).first()[0] == 40 and H.closure(chain, 3).agg(F.max("depth")).first()[0] == 3
    paths = {r["id"]: r["path"] for r in H.root_paths(chain).collect()}
    assert len(paths["n40"]) == 41 and paths["n40"][0] == "n00" and paths["x"] == ["y", "x"]


def test_percentile_and_running_sums(spark, monkeypatch):
    from tessera.operators import order

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=700), np.full(300, 0.25)])
    rows = spark.createDataFrame([(i, i % 3, float(v)) for i, v in enumerate(x)], "id long, k int, x double").repartition(7)
    for limit in (1_000_000, 20):
        monkeypatch.setattr(order, "SMALL", limit)
        for share in (0.0, 0.05, 0.5, 0.937, 1.0):
            assert order.percentile(rows, "x", share) == pytest.approx(np.quantile(x, share))
    assert order.percentile(rows.limit(0), "x", 0.5) is None
    got = {r["id"]: r["s"] for r in order.running(rows, ["k"], [F.desc("id")], {"s": F.col("x")}).collect()}
    for i in (0, 500, 999):
        assert got[i] == pytest.approx(sum(x[j] for j in range(i, 1000) if j % 3 == i % 3))


def test_scatter_sums_partitions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    rows = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(x)], "label int, v array<double>").repartition(9)
    n, s, q = S.scatter(rows, 5, "label")["1"]
    part = x[1::3]
    assert n == 100 and np.allclose(s, part.sum(0)) and np.allclose(q, part.T @ part) and S.scatter(rows, 5)[None][0] == 300
    with pytest.raises(ValueError):
        S.scatter(rows, 5, "label", most_bytes=100)


def test_bm25_in_blocks_equals_formula(spark, monkeypatch):
    from tessera.operators import blocking as B

    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocab, int(rng.integers(0, 12)), p=np.arange(1, 31) / 465)) for _ in range(60)]
    queries = [" ".join(rng.choice(vocab + ["new"], 5)) for _ in range(15)]
    words = [t.split() for t in texts]
    n, mean = len(texts), np.mean([len(w) for w in words])
    df = {v: sum(v in w for w in words) for v in vocab if any(v in w for w in words)}
    raw = {v: np.log((n - d + 0.5) / (d + 0.5)) for v, d in df.items()}
    idf = {v: r if r >= 0 else 0.25 * np.mean(list(raw.values())) for v, r in raw.items()}
    score = lambda q, w: sum(idf.get(v, 0) * w.count(v) * 2.5 / (w.count(v) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for v in q.split())
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    qs = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    for cells in (8_000_000, 40):
        monkeypatch.setattr(B, "BLOCK_CELLS", cells)
        got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in B.bm25(qs, docs, 4).collect()}
        for i, q in enumerate(queries):
            best = sorted(((-round(score(q, w), 9), j) for j, w in enumerate(words) if round(score(q, w), 9)), key=lambda x: x)[:4]
            assert [got.get((i, k + 1)) for k in range(len(best))] == [(j, pytest.approx(-s, abs=1e-6)) for s, j in best] and (i, len(best) + 1) not in got


def test_vector_store(spark):
    rows = [("a", [1.0, 0.0, 0.0], "x"), ("b", [0.0, 1.0, 0.0], "x"), ("c", [0.0, 0.0, 1.0], "y"), ("d", [0.5, 0.5, 0.0], "y")]
    ids = {r[0]: i for i, r in enumerate(rows)}
    make = lambda rs: spark.createDataFrame([(ids[a], v, m) for a, v, m in rs], "id long, v array<double>, type string")
    store = M.VectorStore().upsert(make(rows))
    asked = spark.createDataFrame([(7, [1.0, 0.0, 0.0])], "query_id long, v array<double>")
    assert store.count() == 4 and [(r["id"], r["score"]) for r in store.query(asked, 2).orderBy("rank").collect()] == [(0, 1.0), (3, pytest.approx(0.5**0.5))]
    assert [r["id"] for r in store.query(asked, 1, where="type = 'y'").collect()] == [3]
    store = store.upsert(make([("a", [0.0, 0.0, 1.0], "z")])).delete(make(rows[3:]))
    assert store.count() == 3 and [(r["id"], r["type"]) for r in store.query(asked, 1, where="type = 'z'").collect()] == [(0, "z")] and M.VectorStore().count() == 0


def test_logistic_head(spark):
    from tessera.operators.heads import LogisticHead

    rng = np.random.default_rng(6)
    make = lambda classes, n: spark.createDataFrame([("abc"[k], (np.eye(4)[k] * 3 + rng.normal(size=4) * 0.3).tolist()) for k in classes for _ in range(n * (1 + 4 * (k == 0)))], "label string, v array<double>")
    head = LogisticHead(make([0, 1], 20))
    asked = make([0, 1, 2], 5).withColumn("query_id", F.monotonically_increasing_id())
    right = lambda h: {(r["label"], r["predicted"]) for r in h.predict(asked).join(asked, "query_id").collect()}
    assert {("a", "a"), ("b", "b")} <= right(head) and right(head.add_class(make([2], 20))) == {("a", "a"), ("b", "b"), ("c", "c")}
    row = head.predict(asked).first()
    assert sum(row["probabilities"]) == pytest.approx(1) and row["confidence"] == max(row["probabilities"]) and sorted(row["labels"]) == ["a", "b"]
    with pytest.raises(ValueError):
        head.retrained(make([0, 2], 5))
    with pytest.raises(ValueError):
        LogisticHead(make([0], 5))


def test_matcher_modes(spark):
    """Threshold and candidates hold in every mode; encoder and reranker are plugged in."""
    from tessera.functions import encode

    catalog = spark.createDataFrame([("DE", "Germany", ["Deutschland"]), ("FR", "France", ["Frankreich"]), ("US", "United States", ["USA"])], "id string, name string, aliases array<string>")
    asked = spark.createDataFrame([(1, "Germany"), (2, "united state")], "query_id long, text string")
    only = spark.createDataFrame([("FR",)], "id string")
    ids = lambda df: {r["query_id"]: r["id"] for r in df.collect()}
    for m in (Matcher(catalog, 0.3), Matcher(catalog, 0.3, "hybrid"), Matcher(catalog, 0.3, encoder=lambda t: encode.lexical_vector(t, 128))):
        assert ids(m.match(asked))[1] == "DE" and m.match(asked, threshold=0.9999).where("query_id = 2").count() == 0
        assert m.match(asked, candidates=only).where("id <> 'FR'").count() == 0
    calls = Matcher(catalog, 0.0, "hybrid", reranker=lambda q, t: F.length(t) * 1.0).match(asked)
    assert calls.select("rerank_score").distinct().count() > 1 and calls.agg(F.max("rerank_score")).first()[0] > 1
    vectors = spark.createDataFrame([("DE", [1.0, 0.1]), ("DE", [0.9, 0.0]), ("FR", [0.0, 1.0]), ("FR", [0.1, 0.9])], "label string, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, v array<double>")
    for m in (Matcher(catalog, 0.0).fit(vectors, 2), Matcher(catalog, 0.0).fit_head(vectors)):
        assert ids(m.match(q)) == {1: "DE"} and ids(m.match(q, candidates=only)) == {1: "FR"}
    why = Matcher(catalog, 0.99).explain(asked, k=2).orderBy("query_id", "rank").collect()
    assert why[0]["id"] == "DE" and why[0]["matched"] and "ger" in why[0]["shared"] and not why[-1]["matched"]


def test_new_clusters_are_founded(spark):
    rng = np.random.default_rng(8)
    point = lambda k: (np.eye(4)[k] * 10 + rng.normal(size=4) * 0.2).tolist()
    means = spark.createDataFrame([(k, 20, (np.eye(4)[k] * 10).tolist()) for k in range(3)], "label long, n long, mean array<double>")
    rows = spark.createDataFrame([(i, point(0)) for i in range(5)] + [(10 + i, point(3)) for i in range(6)] + [(30, [-9.0, -9.0, 0.0, 0.0])], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in G.founded(rows, G.assign(rows, means, 0.8), means, 0.8).collect()}
    assert got == {**{i: 0 for i in range(5)}, **{10 + i: 3 for i in range(6)}, 30: -1}


def test_exact_search_deals_no_pairs(spark):
    """Ties, zero vectors, repeated vectors and classes without a name against brute force; each side is dealt once."""
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(90, 3)), 1)
    v[40:70] = v[3]
    v[7] = 0
    classes = [None if i % 7 == 0 else f"c{i % 3}" for i in range(90)]
    df = spark.createDataFrame([(i, v[i].tolist(), classes[i]) for i in range(90)], "id long, v array<double>, c string")
    q, r = df.select(F.col("id").alias("query_id"), "v"), df.select(F.col("id").alias("ref_id"), "v", "c")
    u = v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n)
    s = np.round(u @ u.T, 9)
    for each in (None, "c"):
        near = M.nearest(q, r, 4, block_rows=16, skip_same=True, each=each)
        plan = near._jdf.queryExecution().toString()
        assert "Generate" not in plan and "CoGroup" not in plan
        got = sorted((x["query_id"], str(x["c"]) if each else "", x["rank"], x["ref_id"], x["score"]) for x in near.collect())
        want = []
        for i in range(90):
            for c in sorted({str(x) for x in classes}) if each else [""]:
                of = sorted((-s[i, j], j) for j in range(90) if j != i and (not each or str(classes[j]) == c))[:4]
                want += [(i, c, rank, j, -x) for rank, (x, j) in enumerate(of, 1)]
        assert [x[:4] for x in got] == [x[:4] for x in sorted(want)] and np.allclose([x[4] for x in got], [x[4] for x in sorted(want)], atol=2e-9)


def test_lsh_equals_the_join_of_its_buckets(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from tessera.functions import vectors as V

    v = np.random.default_rng(6).normal(size=(60, 5))
    v[11] = v[12] = 0
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "id long, v array<double>")
    near = M.nearest_lsh(df.select(F.col("id").alias("query_id"), "v"), df.select(F.col("id").alias("ref_id"), "v"), 3, bucket_length=0.4, tables=3, max_distance=1.2)
    plan = near._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan
    unit = df.withColumn("u", array_to_vector(V.unit(F.col("v"))))
    model = BucketedRandomProjectionLSH(inputCol="u", outputCol="h", bucketLength=0.4, numHashTables=3, seed=42).fit(unit)
    pairs = model.approxSimilarityJoin(unit, unit, 1.2, "d").select(F.col("datasetA.id").alias("query_id"), F.col("datasetB.id").alias("id"), F.round(1 - F.col("d") * F.col("d") / 2, 9).alias("score"))
    key = lambda d, ref: sorted((x["query_id"], x["rank"], x[ref], round(x["score"], 8)) for x in d.collect())
    assert key(near, "ref_id") == key(M.ranked(pairs, 3), "id")


def test_class_scores_are_made_once_a_row(spark):
    """Rows meet class means in matrix products, not in expressions that repeat each other; a row without a vector has no class."""
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "query_id long, v array<double>")
    means = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, 2.0])], "label string, mean array<double>")
    p = M.centroid_probabilities(q, means)
    scored = M.against_classes(q, means, [], distance=True)
    for df in (p, scored):
        assert "lambda" not in df._jdf.queryExecution().toString()
    got = {r["query_id"]: r for r in p.collect()}
    assert [got[i]["predicted"] for i in (1, 2, 3, 4)] == ["b", "a", "a", None] and got[4]["confidence"] is None
    assert got[1]["labels"] == ["a", "b"] and np.allclose(got[1]["probabilities"], [np.exp(-10) / (1 + np.exp(-10)), 1 / (1 + np.exp(-10))])
    assert {r["query_id"]: [(s["label"], None if s["score"] is None else round(s["score"], 6)) for s in r["scores"]] for r in scored.collect()} == {
        1: [("a", 1.0), ("b", 0.0)], 2: [("a", 0.292893), ("b", 0.292893)], 3: [("a", 1.0), ("b", 1.0)], 4: [("a", None), ("b", None)]
    }


def test_rake_by_hashes_equals_rake_by_runs(spark, monkeypatch):
    """Runs that cannot be among the best are ruled out by packed counts of their hashes; the rest is exact."""
    rng = np.random.default_rng(8)
    words = np.array([f"word{i}" for i in range(40)])
    texts = [". ".join(" ".join(rng.choice(words, p=np.r_[np.full(5, 0.1), np.full(35, 0.5 / 35)], size=rng.integers(1, 9))) for _ in range(6)) for _ in range(60)]
    docs = spark.createDataFrame([(None if i % 20 == 9 else i % 3, i, t) for i, t in enumerate(texts)] + [(7, 99, "alpha beta gamma")], "g int, id long, text string")
    plain = sorted(tuple(r) for r in D.rake(docs, "g").collect())
    monkeypatch.setattr(D, "FEW_WORDS", 0)
    monkeypatch.setattr(D, "RUNS_HELD", 100)
    assert sorted(tuple(r) for r in D.rake(docs, "g").collect()) == plain and len(plain) == 27
    rows = spark.createDataFrame([("a", 5), ("a", 2**32 - 1), ("a", 5), ("b", 5), ("b", 2**31)] * 60, "g string, h long")
    counts = D._unpacked(D._hash_counts(rows, "g", 150).withColumn("n_least", F.lit(61).cast("long")), "g", None)
    assert [tuple(r) for r in counts.collect()] == [("a", 5, 120)]


def test_density_deals_no_pairs_of_blocks(spark):
    rows = spark.createDataFrame([(i, [1.0, i % 7 / 50, float(i % 2)]) for i in range(40)], "id long, v array<double>")
    plan = G._meeting(rows.withColumn("n", F.lit(1)), "n", None, "id long, near long", 8)._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "Generate" not in plan


def test_tfidf_weighs_documents_where_they_are_read(spark, monkeypatch):
    """One pass over the documents, without a row for each token; repeated ids are one document, as by the join of weights."""
    docs = spark.createDataFrame([(i, f"common w{i % 3} w{i % 5} rare{i} common") for i in range(30)] + [(4, "w1 w1 late"), (50, None), (51, "x")], "id long, text string")
    q = spark.createDataFrame([(1, "common w1 late rare7"), (2, "nothing here")], "query_id long, text string")
    vocabulary = B.document_counts(docs.select(B.T.long_tokens(F.col("text")).alias("tokens")))
    assert {r["token"]: r["df"] for r in vocabulary.where("token in ('common', 'w1', 'late')").collect()} == {"common": 30, "w1": 15, "late": 1}
    wanted = q.select(F.explode(B.T.long_tokens(F.col("text"))).alias("token"))
    fast = B.tfidf_vectors(docs, vocabulary, 33, "id", wanted)
    monkeypatch.setattr(B, "VOCABULARY_SENT", 1)
    key = lambda d: sorted((r["id"], r["token"], round(r["w"], 9)) for r in d.collect())
    assert "Generate" not in fast._jdf.queryExecution().toString() and key(fast) == key(B.tfidf_vectors(docs, vocabulary, 33, "id", wanted))
