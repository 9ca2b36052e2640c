"""Registered queries of the engine over the test tables, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import scalar as S
from .operators import blending as B, frames as R, knn, ladder as L, learners, metrics as M, samplers as O, stats as T
from .operators.storage import written
from .plans import experiment as X

P9 = 9
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def fix(c: str | Column, to: str | None = None, places: int = P9) -> Column:
    """Rounded, and without a negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, places) + 0.0).alias(to or c)


def counts(df: DataFrame) -> tuple[int, int, int]:
    c = R.class_counts(df).first()
    return int(c["need"]), int(c["n0"]), int(c["n1"])


def points(made: DataFrame, *columns: str) -> DataFrame:
    """What identifies a synthetic point: its draw, its parents and two checks of its coordinates."""
    return made.select(*columns, fix(S.total(F.col("features")), "f_sum"), fix(F.get("features", F.lit(0)), "f_first"))


# --- frames ---


@query
def class_counts_need(spark, d):
    frames_ = {"emb": R.emb(spark, d), "docs": R.docs(spark, d)}
    e = R.table(spark, d, "events").select((F.col("event_type") == "error").cast("int").alias("y"))
    li = R.table(spark, d, "lineitem").select(((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).cast("int").alias("y"))
    out = None
    for name, df in (frames_ | {"events": e, "line": li}).items():
        c = R.class_counts(df).select(F.lit(name).alias("frame"), "n0", "n1", fix("prior"), "target", "need")
        out = c if out is None else out.unionByName(c)
    return out


def _events(spark, d):
    e = R.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    value = F.when(F.col("event_id") % 17 == 0, None).otherwise(F.col("value"))
    return e.select(F.col("event_id").alias("row_id"), value.alias("value"), F.hour("ts").alias("hour"), k.alias("k"), "event_type", F.lit(1.0).alias("constant"), F.lit(None).cast("double").alias("nothing"), (F.col("event_type") == "error").cast("int").alias("y"))


@query
def encode_frame(spark, d):
    df, kept = R.encode(_events(spark, d).drop("y"), ["value", "hour", "k", "event_type", "constant", "nothing"])
    return df.select("row_id", *[fix(c) for c in kept])


@query
def binary_labels_two(spark, d):
    return R.positive_class(R.table(spark, d, "labels"), "toxic").select(F.col("label").cast("string").alias("label"), "n")


@query
def binary_labels_multi(spark, d):
    return R.positive_class(R.table(spark, d, "embeddings"), "label").select(F.col("label").cast("string").alias("label"), "n")


@query
def bounds_per_dim(spark, d):
    return R.bounds(R.emb(spark, d)).select("pos", fix("lo"), fix("hi"))


@query
def clip_to_bounds(spark, d):
    e = R.emb(spark, d)
    wide = e.withColumn("features", F.transform("features", lambda x: x * 1.5)).crossJoin(F.broadcast(R.bounds_row(e)))
    return wide.select("row_id", fix(S.total(S.clip_to(F.col("features"), F.col("lo"), F.col("hi"))), "f_sum"), S.within(F.col("features"), F.col("lo"), F.col("hi")).alias("inside"))


@query
def stratified_folds(spark, d):
    return R.folds(R.emb(spark, d), 5).select("row_id", "y", "fold")


@query
def fold_balance(spark, d):
    li = R.table(spark, d, "lineitem")
    row = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")], F.date_format("l_shipdate", "yyyy-MM-dd")))
    df = li.select(row.alias("row_id"), ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).cast("int").alias("y"))
    return R.folds(df, 5).groupBy("fold").agg(F.count_if(F.expr("y = 0")).alias("n0"), F.count_if(F.expr("y = 1")).alias("n1"))


@query
def fold_standardize(spark, d):
    df = R.folds(_events(spark, d), 5)
    return R.impute_and_scale(df, ["value", "hour", "k"], 5).groupBy("fold", "column").agg(F.count("*").alias("n"), fix(F.avg("value"), "mean", 6), fix(F.max("value"), "top", 6), fix(F.min("value"), "low", 6))


# --- neighbours ---


@query
def knn_minority(spark, d):
    m = O.minority(R.emb(spark, d))
    return knn.nearest(m, m, 5, skip_self=True).select("q", "j", F.col("rk").cast("long").alias("rk"), fix("d"))


@query
def knn_majority(spark, d):
    e = R.emb(spark, d)
    return knn.nearest(O.minority(e), O.majority(e), 6).select("q", "j", F.col("rk").cast("long").alias("rk"), fix("d"))


def _anchors(spark, d):
    e = R.emb(spark, d)
    need, n0, n1 = counts(e)
    return e, written(O.simple_smote(O.minority(e), n1, need, 42, 6, "ladder")), need, n0, n1


@query
def nn_distance_ratio(spark, d):
    e = R.emb(spark, d)
    q, m, maj = O.majority(e), O.minority(e), O.majority(e)
    near = knn.nearest_one(q, m).select("q", F.col("d").alias("d_min"))
    far = knn.nearest(q, maj, 1, skip_self=True).select("q", F.col("d").alias("d_maj"))
    return near.join(far, "q").select("q", fix("d_min"), fix("d_maj"), fix(F.col("d_maj") / (F.col("d_min") + S.TINY), "ratio", 6))


@query
def local_scale(spark, d):
    m = O.minority(R.emb(spark, d))
    return knn.nearest(m, m, 6).groupBy("q").agg(fix(F.avg("d"), "scale"))


@query
def weighted_majority_centroid(spark, d):
    e = R.emb(spark, d)
    near = knn.nearest(O.minority(e), O.majority(e), 6).join(O.majority(e).select(F.col("row_id").alias("j"), "features"), "j")
    w = near.select("q", (1 / (F.col("d") + S.TINY)).alias("w"), F.posexplode("features").alias("pos", "x"))
    return w.groupBy("q", "pos").agg(fix(F.sum(F.col("w") * F.col("x")) / F.sum("w"), "x"))


@query
def outward_direction(spark, d):
    e = R.emb(spark, d)
    at = O.minority(e).withColumnRenamed("row_id", "draw")
    return L.directions(e, at, L.Ladder()).select("draw", fix(S.total(F.col("direction")), "f_sum"), fix(F.get("direction", F.lit(0)), "f_first"), fix(S.norm(F.col("direction")), "length"))


# --- samplers ---


@query
def ros(spark, d):
    e = R.emb(spark, d)
    need, _, n1 = counts(e)
    return points(O.random_rows(e, need, n1, 42), "draw", "base_id")


@query
def smote(spark, d):
    e = R.emb(spark, d)
    need, _, n1 = counts(e)
    return points(O.smote(e, need, n1, 42), "draw", "base_id", "partner_id")


@query
def simple_smote(spark, d):
    e = R.emb(spark, d)
    need, _, n1 = counts(e)
    return points(O.simple_smote(O.minority(e), n1, need, 42), "draw", "base_id", "partner_id")


@query
def smote_tomek(spark, d):
    e = R.emb(spark, d)
    need, _, n1 = counts(e)
    return points(O.smote_tomek(e, need, n1, 42), "row_id", "y")


@query
def borderline_smote(spark, d):
    e = R.emb(spark, d, 3)
    need, _, n1 = counts(e)
    return points(O.borderline_smote(e, need, n1, 42), "draw", "base_id", "partner_id")


@query
def borderline_danger(spark, d):
    return O.danger(R.emb(spark, d, 3), 10)


@query
def adasyn(spark, d):
    e = R.emb(spark, d)
    need, _, n1 = counts(e)
    return points(O.adasyn(e, need, n1, 42), "draw", "base_id", "partner_id")


@query
def mgvae(spark, d):
    e = R.emb(spark, d)
    need, _, n1 = counts(e)
    return points(O.guided_smote(e, need, n1, 42), "draw", "base_id", "partner_id")


@query
def deep_smote(spark, d):
    e = R.emb(spark, d)
    need, _, n1 = counts(e)
    return points(O.latent_smote(e, need, n1, 42), "draw", "base_id", "partner_id")


@query
def kmeans_smote(spark, d):
    e = R.emb(spark, d)
    need, _, n1 = counts(e)
    return points(O.kmeans_smote(e, need, n1, 42), "draw", "base_id", "partner_id")


# --- ladder ---


def _ladder(spark, d, **options):
    p = L.Ladder(**options)
    e, pool, need, n0, n1 = _anchors(spark, d)
    n_base = round(p.base_share * need)
    kept = written(L.anchors(e, pool.filter(F.col("draw") < n_base), p))
    return p, e, pool, need, n_base, kept


@query
def ladder_anchors(spark, d):
    *_, kept = _ladder(spark, d)
    return kept.select("draw", "anchor_rank", fix("d_min"), fix("d_maj"), fix("ratio", places=6), fix("scale"))


def _candidates(spark, d, **options):
    p, e, pool, need, n_base, kept = _ladder(spark, d, **options)
    return p, e, pool, need, n_base, written(L.candidates(e, kept, need - n_base, p))


def _show(c: DataFrame) -> DataFrame:
    return c.select("pos", "anchor_rank", "step", fix("d_min"), fix("d_maj"), fix(S.total(F.col("x")), "f_sum"))


@query
def ladder_candidates(spark, d):
    return _show(_candidates(spark, d)[-1])


@query
def ladder_candidates_capped(spark, d):
    return _show(_candidates(spark, d, max_candidates=50)[-1])


@query
def ladder_scores(spark, d):
    p, e, pool, need, n_base, c = _candidates(spark, d)
    s = L.scored(c, pool.filter(F.col("draw") < n_base).select(F.col("draw").alias("row_id"), "features"), 42, p)
    return s.select("pos", fix("coverage"), fix("score", places=6))


@query
def outward_ladder(spark, d):
    e = R.emb(spark, d)
    need, n0, n1 = counts(e)
    made, _ = L.generate(e, need, n1, n0, 42)
    return points(made, "draw", "part")


@query
def outward_ladder_backfill(spark, d):
    e = R.docs(spark, d)
    need, n0, n1 = counts(e)
    made, _ = L.generate(e, need, n1, n0, 42)
    return made.groupBy("part").agg(F.count("*").alias("n"), F.min(F.size("features")).alias("dims"))


@query
def dedup_vs_real(spark, d):
    e = R.emb(spark, d)
    need, _, n1 = counts(e)
    parts = O.random_rows(e, need, n1, 42).select(F.lit(0).alias("part"), F.col("draw").alias("at"), F.transform("features", lambda x: F.when(F.col("draw") % 3 == 0, x).otherwise(x + 0.5)).alias("features"))
    return points(L.without_repeats(parts, e, need), "draw", "part")


# --- scores ---


def _scores(spark, d):
    return B.pseudo_scores(R.emb(spark, d))


@query
def prior_correct(spark, d):
    return _scores(spark, d).select("row_id", fix(S.prior_correct(F.col("s_shadow"), F.col("source_prior"), F.col("target_prior")), "p"))


def _blend(spark, d, mode, alpha=0.3):
    one = spark.createDataFrame([(0, mode, alpha)], "cand_idx int, mode string, alpha double")
    return B.scored(_scores(spark, d), one).select("row_id", "split", fix("s"))


@query
def blend_prob(spark, d):
    return _blend(spark, d, "prob")


@query
def blend_logit(spark, d):
    return _blend(spark, d, "priorcorr_logit")


@query
def blend_rank(spark, d):
    return _blend(spark, d, "rank")


@query
def rank01(spark, d):
    s = M.rank01(M.rank01(_scores(spark, d), "s_orig", ["split"], "r"), "s_orig", ["split"], "r_exact", exact=True)
    return s.select("row_id", fix("r"), fix("r_exact"))


@query
def normalize01(spark, d):
    return M.normalize01(_scores(spark, d), "s_orig", ["split"], "v").select("row_id", fix("v"))


def _by_split(spark, d):
    return _scores(spark, d).withColumnRenamed("s_orig", "s")


@query
def average_precision(spark, d):
    return M.average_precision(_by_split(spark, d), ["split"]).select("split", fix("ap"))


@query
def roc_auc(spark, d):
    return M.roc_auc(_by_split(spark, d), ["split"]).select("split", fix("auc"))


@query
def confusion_metrics(spark, d):
    return M.confusion(_by_split(spark, d), ["split"]).select("split", *[fix(c) for c in ("f1", "recall", "precision", "balanced_accuracy", "mcc", "accuracy")])


@query
def brier(spark, d):
    return M.calibration(_by_split(spark, d), ["split"]).select("split", *[fix(c) for c in ("brier", "predicted_prior", "true_prior", "prior_drift")])


@query
def precision_at_k(spark, d):
    return M.precision_at_top(_by_split(spark, d), ["split"]).select("split", fix("p_at_k"))


@query
def metrics_all(spark, d):
    return M.all_metrics(_by_split(spark, d), ["split"]).select("split", *[fix(c) for c in ("pr_auc", "roc_auc", "f1", "recall", "precision", "balanced_accuracy", "mcc", "accuracy")])


SMALL_GRID = B.BlendParams(alphas=(0.0, 0.25, 0.5, 0.75, 1.0), modes=("prob", "priorcorr"))


@query
def blend_grid_stats(spark, d):
    s = B.candidate_stats(B.scored(_scores(spark, d), B.grid(spark, SMALL_GRID)))
    return s.select("split", "cand_idx", *[fix(c) for c in ("ap", "brier", "prior_drift", "p_at_k")])


@query
def blend_bounds(spark, d):
    e, _ = B.evaluate(_scores(spark, d), SMALL_GRID)
    return e.select("cand_idx", *[fix(c, places=8) for c in ("ap_mean", "ap_lcb", "ap_delta_lcb", "prior_drift_ucb", "brier_ucb", "p_loss_ucb")], F.col("violations").cast("long").alias("violations"))


@query
def blend_select(spark, d):
    return B.choose(_scores(spark, d), SMALL_GRID)


@query
def blend_select_full_grid(spark, d):
    return B.choose(_scores(spark, d), B.BlendParams())


# --- parameters and plans ---


@query
def budget_split(spark, d):
    rows = [(t, a, *B.split_budget(t, a)) for t in (2, 80, 200) for a in (0.0, 0.25, 0.5, 0.3125, 1.0)]
    return spark.createDataFrame(rows, "total long, alpha double, original long, shadow long")


@query
def alpha_ratio(spark, d):
    return spark.createDataFrame([(a / 100, S.alpha_ratio(a / 100)) for a in range(101)], "alpha double, ratio string")


@query
def alpha_grid(spark, d):
    return spark.createDataFrame([(i, a) for i, a in enumerate(B.alpha_grid(B.BlendParams().alphas, 0.333333))], "i long, alpha double")


@query
def method_names(spark, d):
    rows = [(c, o, X.sampler_method(c, o), X.blend_method(c, o), X.blend_method(c, o, "logit")) for c in ("rf", "extratrees") for o in ("smote", "outward_ladder")]
    return spark.createDataFrame(rows, "classifier string, oversampler string, plain string, blended string, fixed string")


@query
def job_plan(spark, d):
    nine = ["random_over_sampler", "smote", "smote_tomek", "kmeans_smote", "adasyn", "borderline_smote", "deep_smote", "mgvae", "outward_ladder"]
    rows = X.jobs(["rf", "extratrees", "bagged_cart"], nine, ("native", "oversampler", "blend", "rivals"), exact=True)
    return spark.createDataFrame([r[2:3] for r in rows], "kind string").groupBy("kind").agg(F.count("*").alias("n"))


# --- comparison statistics ---


@query
def block_table(spark, d):
    t = T.block_table(T.pseudo_results(spark), ["A-1", "B-1", "C-1"])
    return t.select("classifier", "dataset", *[fix(c) for c in ("a_1", "b_1", "c_1")])


@query
def wins_losses(spark, d):
    w = T.wins(T.pseudo_results(spark), "A-1")
    return w.select("method", fix("mean_delta"), fix("median_delta"), "wins", "ties", "losses")


@query
def friedman_ranks(spark, d):
    return T.friedman_ranks(T.pseudo_results(spark)).select("method", fix("mean_pr_auc"), fix("avg_rank"))


@query
def holm(spark, d):
    p = T.wilcoxon(T.pseudo_results(spark), "A-1").select(F.col("method").alias("code"), (1 / (1 + F.col("w_plus"))).alias("p"))
    return T.holm(p).select("code", fix("p"), fix("holm_p"))


@query
def wilcoxon_w(spark, d):
    return T.wilcoxon(T.pseudo_results(spark), "A-1").select("method", "n", fix("w_plus"))


def _two(spark):
    r = T.pseudo_results(spark)
    made = r.filter("not (dataset = 'd3' and method = 'A-1')").union(r.filter("dataset = 'd4' and fold = 1"))
    return made.withColumn("pr_auc", F.when(F.col("method") == "B-1", F.col("pr_auc") + 0.01).otherwise(F.col("pr_auc"))), r


@query
def signature_diff(spark, d):
    return T.signature_diff(*_two(spark))


@query
def value_diff(spark, d):
    return T.value_diff(*_two(spark))


@query
def top_methods(spark, d):
    return T.top_methods(T.pseudo_results(spark)).select("method", fix("mean_pr_auc"))


@query
def result_shape(spark, d):
    s = T.shape(T.pseudo_results(spark))
    return s.select("n_rows", "n_datasets", "n_methods", F.array_join(F.transform("seeds", lambda x: x.cast("string")), ",").alias("seeds"), F.col("first_fold").cast("long").alias("first_fold"), F.col("last_fold").cast("long").alias("last_fold"))


@query
def scalar_lookup(spark, d):
    """The balance of the customer with the smallest key, found by its name."""
    c = R.table(spark, d, "customer").select(F.col("c_name").alias("code"), "c_acctbal", "c_custkey")
    code = c.orderBy("c_custkey").select("code").first()["code"]
    return spark.createDataFrame([(code, T.lookup(c, code, "c_acctbal"))], "code string, value double")


@query
def tube_residual(spark, d):
    e = R.emb(spark, d).crossJoin(F.broadcast(R.bounds_row(R.emb(spark, d))))
    return e.select("row_id", fix(S.residual(F.col("features"), S.unit(F.col("hi"))), "residual"))


@query
def positive_scores(spark, d):
    """Decision values (the first component) scaled over all rows; the shares of two components as probabilities."""
    e = R.emb(spark, d)
    raw = learners.positive_scores(e.select("row_id", "y", F.get("features", F.lit(0)).alias("raw"))).select("row_id", F.lit("raw").alias("kind"), fix("score"))
    p = learners.positive_scores(e.select("row_id", "y", F.array(F.lit(0.25), F.abs(F.get("features", F.lit(1)))).alias("probability")), [0.0, 1.0])
    one = learners.positive_scores(e.select("row_id", "y", F.array(F.lit(1.0)).alias("probability")), [0.0])
    return raw.union(p.select("row_id", F.lit("probability"), fix("score"))).union(one.select("row_id", F.lit("one class"), fix("score")))


# --- learners: no SQL form ---


def _learner(name: str, trees: int = 16, weighted: bool = False, folds: int = 5) -> Query:
    """Out-of-fold scores of every row."""

    def run(spark, d):
        at = written(R.folds(R.emb(spark, d), folds))
        parts = [learners.fit_score(at.filter(F.col("fold") != f), at.filter(F.col("fold") == f), name, trees, 42, weighted) for f in range(1, folds + 1)]
        return reduce(DataFrame.union, parts)

    run.__name__ = f"learner_{name}{'_weighted' if weighted else ''}"
    return query(run)


for _name in ("rf", "extratrees", "bagged_cart", "random_subspace_trees", "decision_tree", *learners.RIVALS):
    _learner(_name)
_learner("rf", weighted=True)


@query
def two_branch_fit_predict(spark, d):
    """Fitted on all rows, which it then scores."""
    p = B.BlendParams(alphas=(0.0, 0.5), modes=("prob", "priorcorr_logit"), inner_folds=2, inner_repeats=1, total_budget=8)
    e = R.emb(spark, d)
    return X.TwoBranchClassifier("rf", "smote", params=p).fit(e).transform(e)


@query
def experiment_smoke(spark, d):
    p = B.BlendParams(alphas=(0.0, 0.5), modes=("prob", "priorcorr_logit"), inner_folds=2, inner_repeats=1)
    data = [R.Dataset(R.emb(spark, d), "emb", "embeddings")]
    return X.run(data, ["rf"], ["smote"], ("native", "oversampler", "rivals"), [42], 2, 8, p=p)
