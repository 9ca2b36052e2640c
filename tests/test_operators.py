"""Hand-made cases: ties, single classes, tiny classes, and the learners, which have no SQL form."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.functions import scalar as S
from counterpoise.operators import blending as B, frames as R, knn, ladder as L, learners, metrics as M, samplers as O, stats as T
from counterpoise.plans import cli, experiment as X
from counterpoise.sources import tables
from counterpoise.streaming import scoring


def frame(spark, rows):
    return spark.createDataFrame([(i, list(map(float, f)), y) for i, (f, y) in enumerate(rows)], "row_id long, features array<double>, y int")


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.normal(0, 1, 3), 0) for _ in range(60)] + [(rng.normal(2.5, 0.7, 3), 1) for _ in range(15)]
    return frame(spark, rows).cache()


def test_average_precision_with_ties(spark):
    df = spark.createDataFrame([(0, 1, 0.9), (1, 0, 0.9), (2, 1, 0.5), (3, 0, 0.1)], "row_id long, y int, s double").withColumn("g", F.lit(0))
    assert M.average_precision(df, ["g"]).first()["ap"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert M.roc_auc(df, ["g"]).first()["auc"] == pytest.approx((0.5 + 1 + 0 + 1) / 4)


def test_single_class_has_no_ranking_metric(spark):
    df = spark.createDataFrame([(0, 0, 0.9), (1, 0, 0.1)], "row_id long, y int, s double").withColumn("g", F.lit(0))
    r = M.all_metrics(df, ["g"]).first()
    assert r["pr_auc"] is None and r["roc_auc"] is None and r["f1"] == 0 and r["mcc"] == 0 and r["balanced_accuracy"] == 0.5


def test_rank_of_one_row_and_half_shift(spark):
    df = spark.createDataFrame([("a", 0.3), ("b", 0.1), ("b", 0.2), ("b", 0.4)], "g string, s double")
    out = {(r["g"], r["s"]): r["r"] for r in M.rank01(df, "s", ["g"], "r").collect()}
    assert out[("a", 0.3)] == 0.5
    assert [out[("b", s)] for s in (0.1, 0.2, 0.4)] == [-0.25, 0.25, 0.75]


def test_scalars(spark):
    row = spark.range(1).select(S.sigmoid(S.logit(F.lit(0.3))).alias("p"), S.prior_correct(F.lit(0.5), F.lit(0.5), F.lit(0.1)).alias("c"), S.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), S.unit(F.array(F.lit(0.0))).alias("z")).first()
    assert row["p"] == pytest.approx(0.3) and row["c"] == pytest.approx(0.1) and row["u"] == [0.6, 0.8] and row["z"] is None
    assert S.alpha_ratio(0) == "1:0" and S.alpha_ratio(1) == "0:1" and S.alpha_ratio(1 / 3) == "2:1"


def test_validation(spark):
    R.validate(frame(spark, [((1, 2), 0), ((3, 4), 1)]))
    with pytest.raises(ValueError):
        R.validate(frame(spark, [((1, 2), 2)]))
    with pytest.raises(ValueError):
        R.validate(frame(spark, [((1, 2), 0), ((3,), 1)]))


def test_folds_are_balanced(spark, blobs):
    rows = R.folds(blobs, 4).groupBy("fold", "y").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in rows if r["y"] == y]
        assert max(sizes) - min(sizes) <= 1 and len(sizes) == 4


def test_dense_index_by_ranges_is_the_same(spark, blobs, monkeypatch):
    one = {r["row_id"]: r["i"] for r in R.dense_index(blobs).collect()}
    monkeypatch.setattr(R, "ONE_TASK", 10)
    assert {r["row_id"]: r["i"] for r in R.dense_index(blobs).collect()} == one


def test_blocked_neighbours_are_the_same(spark, blobs, monkeypatch):
    """Distances to the last bit, ties and ids alike, whether the base is one block or many."""
    ties = blobs.select("row_id", F.transform("features", lambda v: F.round(v)).alias("features"), "y")
    for df in (blobs, ties, ties.withColumn("row_id", F.concat(F.lit("k"), F.lpad(F.col("row_id").cast("string"), 3, "0")))):
        a = {(r["q"], r["rk"]): (r["j"], r["d"]) for r in knn.nearest(df, df, 4, True).collect()}
        monkeypatch.setattr(knn, "BLOCK", 20)
        b = {(r["q"], r["rk"]): (r["j"], r["d"]) for r in knn.nearest(df, df, 4, True, small=10).collect()}
        monkeypatch.undo()
        assert a == b and len(a) == 75 * 4


def test_neighbours_are_exact():
    """Against sums from the first dimension to the last, with ties, far-off points and components that are not finite."""
    rng = np.random.default_rng(0)
    for scale, shift in ((1.0, 0.0), (1e-3, 1e6), (3.0, 0.0)):
        y = np.round(rng.normal(size=(300, 5)) * scale * 4) / 4 + shift
        x = np.vstack([y[:40], rng.normal(size=(20, 5)) * scale + shift])
        y[7, 2], x[3, 1] = np.nan, np.inf
        r, c, d, rank = knn.block_top(np.arange(60), x, np.arange(300), y, 6, True)
        got = {}
        for i, j, v, k in zip(r.tolist(), c.tolist(), d.tolist(), rank.tolist()):
            got.setdefault(i, []).append((k, v, j))
        for i in range(60):
            want = []
            for j in range(300):
                s = 0.0
                for u, v in zip(x[i], y[j]):
                    s += (u - v) ** 2
                if j != i and np.isfinite(s):
                    want.append((float(np.sqrt(s)), j))
            assert [(v, j) for _, v, j in sorted(got.get(i, []))] == sorted(want)[:6]


def test_neighbours_of_a_small_base_need_no_shuffle(spark, blobs):
    plan = knn.nearest(blobs, blobs, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("name", sorted(set(O.ALIASES.values()) - {"none", "smote_tomek"}))
def test_resampling_reaches_the_ratio(spark, blobs, name):
    s = O.resample(blobs, name)
    c = {r["y"]: r["count"] for r in s.df.groupBy("y").count().collect()}
    assert c[0] == 60 and c[1] == 15 + s.n_generated
    # Without rows in danger there is nothing to interpolate from.
    want = 0 if name == "borderline_smote" and not O.danger(blobs, 10).count() else 45
    assert abs(s.n_generated - want) <= (6 if name in ("adasyn", "kmeans_smote") else 0), s.warning
    assert s.df.filter("row_id >= 0").count() == 75


def test_tomek_links_go_in_pairs(spark):
    df = frame(spark, [((0,), 0), ((1,), 1), ((10,), 0), ((10.5,), 0)])
    assert [(r["a"], r["b"]) for r in O.tomek_links(df).collect()] == [(0, 1)]


@pytest.mark.parametrize("rows,name", [([((0,), 0), ((1,), 0), ((2,), 1)], "outward_ladder"), ([((0,), 0), ((1,), 0), ((2,), 1)], "smote"), ([((0,), 1), ((1,), 0)], "smote")])
def test_tiny_classes_come_back_unchanged(spark, rows, name):
    s = O.resample(frame(spark, rows), name)
    assert s.n_generated == 0 and s.df.count() == len(rows)


def test_failing_sampler_returns_the_frame(spark, blobs):
    with pytest.warns(RuntimeWarning):
        s = O.resample(blobs, lambda df, need, n1, seed: 1 / 0)
    assert s.n_generated == 0 and "ZeroDivisionError" in s.warning


def test_ladder_points_are_new_and_inside(spark, blobs):
    made, _ = L.generate(blobs, 45, 15, 60, 1)
    box = R.bounds_row(blobs).first()
    points = [r["features"] for r in made.collect()]
    assert len({tuple(np.round(p, 9)) for p in points}) == len(points) == 45
    for p in points:
        assert all(lo <= v <= hi for v, lo, hi in zip(p, box["lo"], box["hi"]))


@pytest.mark.parametrize("name", ["rf", "extratrees", "bagged_cart", "random_subspace_trees", "decision_tree", *learners.RIVALS])
def test_learners_rank_separable_data(spark, blobs, name):
    out = learners.fit_score(blobs, blobs, name, 8).withColumn("g", F.lit(0))
    r = M.all_metrics(out, ["g"], "score").first()
    assert r["roc_auc"] > 0.9
    assert out.filter("score < 0 or score > 1").count() == 0


@pytest.mark.parametrize("name", ["extratrees", "random_subspace_trees", "decision_tree", "rus_boost"])
def test_larger_training_data_gives_the_same_members(spark, blobs, monkeypatch, name):
    scores = lambda: {r["row_id"]: round(r["score"], 9) for r in learners.fit_score(blobs, blobs, name, 4).collect()}
    one = scores()
    monkeypatch.setattr(learners, "BLOCK_BYTES", 10)
    monkeypatch.setattr(learners, "PIECE_ROWS", 7)
    assert scores() == one and len(one) == 75
    monkeypatch.setattr(learners, "TASK_BYTES", 100)
    with pytest.raises(ValueError, match="distributed_forest"):
        scores()
    if name == "decision_tree":
        assert learners.fit_score(blobs, blobs, "distributed_forest", 5).count() == 75


def test_positive_scores_of_every_kind(spark):
    df = spark.createDataFrame([(1, 0, 2.0, [0.3, 0.7], [1.0]), (2, 1, 4.0, [0.6, 0.4], [1.0])], "row_id long, y int, raw double, p array<double>, one array<double>")
    got = lambda x, *a: [r["score"] for r in learners.positive_scores(x, *a).orderBy("row_id").collect()]
    assert got(df.select("row_id", "y", F.col("p").alias("probability")), [0.0, 1.0]) == [0.7, 0.4]
    assert got(df.select("row_id", "y", F.col("p").alias("probability")), [1.0, 0.0]) == [0.3, 0.6]
    assert got(df.select("row_id", "y", F.col("one").alias("probability"))) == [0.0, 0.0]
    assert got(df.select("row_id", "y", "raw")) == [0.0, 1.0] and got(df.select("row_id", "y", F.lit(3.0).alias("raw"))) == [0.5, 0.5]
    assert got(df.select("row_id", "y", F.col("y").alias("prediction"))) == [0.0, 1.0]


def test_folds_by_ranges_are_the_same(spark, blobs, monkeypatch):
    one = {r["row_id"]: r["fold"] for r in R.folds(blobs, 4).collect()}
    monkeypatch.setattr(R, "ONE_TASK", 10)
    assert {r["row_id"]: r["fold"] for r in R.folds(blobs, 4).collect()} == one


def test_prepared_features(spark):
    """Median and deviation of the training rows alone; dimensions that training has no value for go."""
    train = spark.createDataFrame([(0, [1.0, None, 5.0], 0), (1, [3.0, float("nan"), 5.0], 1), (2, [None, None, 5.0], 1)], "row_id long, features array<double>, y int")
    test = spark.createDataFrame([(9, [4.0, 7.0, None], 0)], "row_id long, features array<double>, y int")
    a, b = R.prepared(train, test)
    v = np.array([1.0, 3.0, 2.0])
    assert [np.round(r["features"], 9).tolist() for r in a.orderBy("row_id").collect()] == [[round(x, 9), 0.0] for x in (v - 2.0) / v.std()]
    assert np.round(b.first()["features"], 9).tolist() == [round((4.0 - 2.0) / v.std(), 9), 0.0]


def test_runner_copes_with_missing_features(spark, blobs):
    df = blobs.withColumn("features", F.when(F.col("row_id") % 7 == 0, F.transform("features", lambda v: F.lit(None).cast("double"))).otherwise(F.transform("features", lambda v: v * 1000)))
    p = B.BlendParams(alphas=(0.0, 0.5), modes=("prob",), inner_folds=2, inner_repeats=1)
    names = X.Names(published="pub")
    out = X.run([R.Dataset(df, "d", "made")], ["rf"], ["smote"], ("native", "oversampler", "blend"), [1], 2, 4, p=p, names=names)
    assert out.schema.simpleString() == spark.createDataFrame([], X.RESULT).schema.simpleString()
    rows = out.collect()
    assert len(rows) == 6 and all(r["roc_auc"] > 0.6 for r in rows)
    by = {r["method"]: r for r in rows}
    assert by["blend_rf_smote"]["paper_method_alias"] == "pub_rf_smote" and by["rf_none"]["paper_method_alias"] == "rf_none"
    assert by["rf_smote"]["n_train_resampled"] > by["rf_smote"]["n_train_original"] and by["blend_rf_smote"]["estimators_by_component"].count("+") == 1
    assert X.published_alias("rf", "outward_ladder", "logit", names) == "pub_rf_fast_outward_ladder_smote_logit"


def test_two_branch_classifier_with_any_estimator(spark, blobs):
    from pyspark.ml.classification import LinearSVC, RandomForestClassifier

    p = B.BlendParams(alphas=(0.0, 0.5), modes=("prob",), inner_folds=2, inner_repeats=1, total_budget=None)
    forest = RandomForestClassifier(numTrees=6, labelCol="label", featuresCol="v")
    assert X.budget_of(forest, None) == 6 and X.sized(forest, 3, 0).getNumTrees() == 1 and forest.getNumTrees() == 6
    model = X.TwoBranchClassifier(forest, "smote", params=p).fit(blobs)
    assert model.original_budget + model.shadow_budget == 6 and model.inner_cv_splits == 2
    out = model.transform(blobs.drop("y")).collect()
    assert len(out) == 75 and all(0 <= r["score"] <= 1 for r in out)
    assert X.fit_one(blobs, blobs, LinearSVC(maxIter=5, featuresCol="v"), None, 1).agg(F.min("score"), F.max("score")).first()[:] == (0.0, 1.0)


def test_catalogue_names_what_there_is(spark, blobs, tmp_path):
    blobs.select("row_id", "features", "y").write.parquet(f"{tmp_path}/b.parquet")
    blobs.select("row_id", "features", "y").write.parquet(f"{tmp_path}/a.parquet")
    assert [d.name for d in tables.load_datasets(spark, ["b", "all"], data_dir=str(tmp_path))] == ["b", "a"]
    with pytest.raises(KeyError, match="a, b"):
        tables.load_dataset(spark, "c", data_dir=str(tmp_path))


# Published figures of the two summary tables: p and Holm's p of 23 comparisons.
PUBLISHED = [
    (0.9099259416588849, 0.9099259416588849), (0.19303357829106255, 0.3860671565821251), (0.03870231674182675, 0.154809266967307), (0.004611068421631857, 0.032277478951423),
    (0.008092181753423106, 0.04855309052053863), (0.020297385738033597, 0.10148692869016798), (0.00047746854422400597, 0.004297216898016053), (0.001693571612640736, 0.013548572901125887),
    (1.545260604349585e-05, 0.00016997866647845437), (0.1276485010161798, 0.3829455030485394), (8.248263326236009e-07, 1.0722742324106813e-05), (3.9370849855511967e-07, 5.511918979771675e-06),
    (8.847071704372732e-06, 0.00010616486045247279), (1.1590563067057968e-08, 1.738584460058695e-07), (2.307987591597135e-10, 4.154377664874843e-09), (0.0001145776299314279, 0.001145776299314279),
    (1.2838031187930553e-10, 2.5676062375861106e-09), (2.3884230291889263e-10, 4.154377664874843e-09), (2.4555124640692147e-09, 3.9288199425107434e-08), (3.244593450446946e-11, 6.813646245938587e-10),
    (1.329161164796056e-10, 2.5676062375861106e-09), (4.411918426246165e-13, 1.0147412380366179e-11), (7.306812225888249e-12, 1.6074986896954149e-10),
]


def test_holm_meets_published_figures(spark):
    df = spark.createDataFrame([(f"c{i:02d}", p) for i, (p, _) in enumerate(PUBLISHED)], "code string, p double")
    got = {r["code"]: r["holm_p"] for r in T.holm(df).collect()}
    assert all(abs(got[f"c{i:02d}"] - h) <= 1e-12 + 1e-9 * h for i, (_, h) in enumerate(PUBLISHED))


def test_alignment_says_what_differs(spark):
    rows = [(f"d{d}", c, s, f, m.replace("*", c), 0.5 + 0.1 * k + 0.01 * d) for d in range(3) for c in ("rf", "extratrees") for s in (42, 44) for f in (1, 2) for k, m in enumerate(("*_smote", "blend_*_smote"))]
    df = spark.createDataFrame(rows, "dataset string, classifier string, seed int, fold int, method string, pr_auc double").withColumn("paper_method_alias", F.col("method"))
    pairs = spark.createDataFrame([("A", 0.25)], "code string, holm_p double")
    good = T.Expected(rows=48, datasets=3, seeds=(42, 44), folds=2, blocks=6, champion_mean=0.61, against={"*_smote": (0.1, 6)}, pairs={("A", "holm_p"): 0.25})
    assert T.alignment(df, "blend_*_smote", good, pairs) == []
    bad = T.Expected(rows=47, datasets=3, seeds=(42,), folds=3, blocks=5, champion_mean=0.62, against={"*_smote": (0.2, 5)}, pairs={("A", "holm_p"): 0.26})
    assert len(T.alignment(df, "blend_*_smote", bad, pairs)) == 8
    with pytest.raises(KeyError):
        T.lookup(pairs, "B", "holm_p")


def test_selection_falls_back_to_the_default(spark):
    p = B.BlendParams(alphas=(0.0, 1.0), modes=("prob",), prior_drift_max=0.0, brier_degradation_max=0.0, precision_topk_loss_max=0.0)
    s = spark.createDataFrame([(i, k, i % 2, 0.5 + 0.1 * (i % 2), 0.4, 0.5, 0.5) for k in range(2) for i in range(6)], "row_id long, split int, y int, s_orig double, s_shadow double, source_prior double, target_prior double")
    assert B.choose(s, p).first()["reason"] == "default_relaxed_or_too_few_samples"


def test_grid_and_budgets():
    p = B.BlendParams()
    assert len(B.alpha_grid(p.alphas, p.default_alpha)) == 52
    assert B.split_budget(1, 0.5) == (1, 1) and B.split_budget(200, 0.0) == (199, 1)
    with pytest.raises(ValueError):
        B.modes(("nonsense",), "prob")


def test_holm_and_wilcoxon(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "code string, p double")
    assert {r["code"]: round(r["holm_p"], 9) for r in T.holm(df).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}
    assert T.wilcoxon_p(3, 6.0) == 1 / 8 and T.wilcoxon_p(0, 0.0) == 1.0
    assert T.wilcoxon_p(75, 2850.0) < 1e-10
    assert not T.close(math.nan, math.nan) and T.close(1.0, 1.0 + 1e-10)


def test_jobs_have_the_published_shape():
    nine = [n for n in dict.fromkeys(O.ALIASES.values()) if n != "none"]
    assert len(nine) == 9
    assert len(X.jobs(["rf", "extratrees", "bagged_cart"], nine, ("native", "oversamplers", "blend", "rivals"), True)) * 25 * 3 * 5 == 27_000


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,flag,c,one,gone,target\n" + "".join(f"{i},{str(i % 2 == 0).lower()},{'xyz'[i % 3]},1,,{'p' if i % 5 == 0 else 'n'}\n" for i in range(30)) + "1,true,x,1,,\n")
    d = tables.load_csv(spark, str(tmp_path / "t.csv"))
    assert d.metadata["positive_class"] == "p" and d.metadata["columns"] == ["a", "flag", "c"]
    assert d.df.count() == 30 and d.df.filter("y = 1").count() == 6
    out = X.run([d], ["decision_tree"], ["smote"], ("native", "oversampler"), [1], 2, 4)
    tables.write_results(out, str(tmp_path / "out"))
    assert tables.load_results(spark, str(tmp_path / "out")).count() == 4


def test_sources_and_summaries(spark, tmp_path):
    """Manifest rows, result files of one folder as one table, and the two summary tables with their schemas."""
    import json

    one = {"name": "a", "source": "x", "file": "a.f", "n_features": 4, "n_samples": 7, "positive_class": "2", "sha256": "00", "class_counts": {"0": 5, "1": 2}, "metadata": {"openml_id": 3, "original_classes": ["1", "2"]}}
    (tmp_path / "m.json").write_text(json.dumps({"suite": "s", "description": "d", "datasets": [one, one | {"name": "b", "metadata": {"keel_url": "u"}}]}, indent=1))
    rows = {r["name"]: r for r in tables.load_manifest(spark, str(tmp_path / "m.json")).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["class_counts"] == {"0": 5, "1": 2} and rows["a"]["metadata"]["openml_id"] == 3 and rows["b"]["metadata"]["keel_url"] == "u"
    (tmp_path / "r").mkdir()
    for k in range(2):
        (tmp_path / f"r/{k}.csv").write_text(f"dataset,seed,fold,method,classifier,pr_auc\nd{k},42,1,m,rf,0.{k}5\n")
    got = tables.load_results(spark, str(tmp_path / "r"))
    assert sorted((r["dataset"], r["pr_auc"]) for r in got.collect()) == [("d0", 0.05), ("d1", 0.15)] and T.shape(got).first()["n_datasets"] == 2
    (tmp_path / "ranks.csv").write_text("code,label,mean_pr_auc,avg_rank\nA,The a,0.5,1.5\n")
    (tmp_path / "pairs.csv").write_text("code,label,mean_delta,median_delta,wins,ties,losses,p,holm_p\nB,The b,0.1,0.2,3,0,1,0.04,0.08\n")
    assert T.lookup(tables.load_ranks(spark, str(tmp_path / "ranks.csv")), "A", "avg_rank") == 1.5 and T.lookup(tables.load_pairs(spark, str(tmp_path / "pairs.csv")), "B", "wins") == 3
    assert X.parse_list("a, b  c") == ["a", "b", "c"] and X.parse_options(None) == {} and X.parse_options('{"a": 1}') == {"a": 1}
    with pytest.raises(ValueError):
        X.parse_options("[1]")
    assert tables.resolve(["b", "paper", "b"], ["a", "b", "c"]) == ["b", "a", "c"]


def test_result_rows_use_published_names(spark):
    df = spark.createDataFrame([("m", "pub"), ("n", None)], "method string, paper_method_alias string")
    assert [r["method"] for r in T.method_key(df).orderBy("method").collect()] == ["n", "pub"]


def test_command_line(spark, blobs, tmp_path):
    """A whole run from the command line, with parameters of the blend and of the oversampler."""
    blobs.select("row_id", "features", "y").write.parquet(f"{tmp_path}/data/blobs.parquet")
    cli.main(["--data", "blobs", "--data-dir", f"{tmp_path}/data", "--classifiers", "decision_tree", "--oversamplers", "outward_ladder", "--groups", "oversampler", "--seeds", "1", "--folds", "2", "--total-estimators", "2", "--oversampler-options", '{"max_candidates": 50}', "--output", f"{tmp_path}/out"])
    assert tables.load_results(spark, f"{tmp_path}/out").count() == 2
    with pytest.raises(SystemExit):
        cli.main(["--help"])


def test_stream_scores_like_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(0.2, 0.6), (0.9, 0.8)], "s_orig double, s_shadow double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = scoring.blend_stream(stream, "priorcorr_logit", 0.3, 0.5, 0.1).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = scoring.blend_stream(rows, "priorcorr_logit", 0.3, 0.5, 0.1)
    assert sorted(r["score"] for r in spark.table("scored").collect()) == sorted(r["score"] for r in batch.collect())
    with pytest.raises(ValueError):
        scoring.blend_stream(rows, "rank", 0.3, 0.5, 0.1)
