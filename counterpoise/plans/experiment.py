"""Experiment plans: method names, the job list, and the cross-validated runner."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar as S
from ..operators import blending, frames, learners, metrics, samplers
from ..operators.storage import written

# Names and order of the result columns.
RESULT = (
    "dataset string, dataset_source string, seed int, fold int, method string, paper_method_alias string, method_family string, classifier string, oversampler string, "
    "sampling_strategy string, pr_auc double, roc_auc double, f1 double, recall double, precision double, balanced_accuracy double, mcc double, accuracy double, "
    "n_train_original int, n_test int, n_train_resampled int, n_generated int, runtime_seconds double, sampler_warning string, estimator_budget int, "
    "ensemble_components string, estimators_by_component string, notes string"
)
GROUPS = ("native", "weighted", "oversampler", "blend", "rivals")
#: The published menu: classifiers, oversamplers, groups.
EXACT = (
    ("rf", "extratrees", "bagged_cart"),
    ("random_over_sampler", "smote", "smote_tomek", "kmeans_smote", "adasyn", "borderline_smote", "deep_smote", "mgvae", "outward_ladder"),
    ("native", "oversampler", "blend", "rivals"),
)


@dataclass(frozen=True)
class Names:
    """How results of the blend are named: readable names, and those under which a published table lists them."""

    prefix: str = "blend"
    published: str = "blend"
    family: str = "proposed_blend"
    #: The ladder's name in published aliases.
    ladder: str = "fast_outward_ladder_smote"
    #: Whether the method column, too, gets the published name.
    publish: bool = False


def sampler_method(classifier: str, oversampler: str) -> str:
    return f"{learners.canonical(classifier)}_{samplers.canonical(oversampler)}"


def blend_method(classifier: str, oversampler: str, mode: str | None = None, prefix: str = "blend") -> str:
    """prefix: the name under which results of the blend are published."""
    return "_".join([prefix, learners.canonical(classifier), samplers.canonical(oversampler), *([mode] if mode else [])])


def published_alias(classifier: str, oversampler: str, mode: str | None = None, names: Names = Names()) -> str:
    token = samplers.canonical(oversampler)
    return "_".join([names.published, learners.canonical(classifier), names.ladder if token == "outward_ladder" else token, *([mode] if mode else [])])


def jobs(classifiers: Sequence[str], oversamplers: Sequence[str], groups: Sequence[str], exact: bool = False) -> list[tuple[str, str | None, str, str | None]]:
    """(classifier, oversampler, kind, fixed mode) in running order.  ``exact`` adds the fixed-logit blend of the ladder
    and repeats the rivals once for each classifier, as the published table does."""
    g = {x.rstrip("s") if x in ("oversamplers", "rivals") else x for x in groups}
    out: list[tuple[str, str | None, str, str | None]] = []
    out += [(c, None, "native", None) for c in classifiers if "native" in g]
    out += [(c, None, "weighted", None) for c in classifiers if "weighted" in g]
    out += [(c, o, "oversampler", None) for c in classifiers for o in oversamplers if "oversampler" in g]
    for c in classifiers if "blend" in g else ():
        out += [(c, o, "blend", None) for o in oversamplers]
        if exact and "outward_ladder" in oversamplers:
            out.append((c, "outward_ladder", "blend", "logit"))
    if "rival" in g:
        out += [(r, None, "rival", None) for _ in (classifiers if exact else [None]) for r in learners.RIVALS]
    return out


def parse_list(text: str) -> list[str]:
    return text.replace(",", " ").split()


def parse_options(text: str | None) -> dict:
    found = json.loads(text) if text else {}
    if not isinstance(found, dict):
        raise ValueError("options must be a JSON object")
    return found


SIZES = ("numTrees", "n_estimators", "maxIter", "iterations")


def budget_of(base, total: int | None) -> int | None:
    """The number of trees to share out: ``total``, else what an estimator's own size parameter says, else None."""
    if total is not None or isinstance(base, str):
        return total
    found = [base.getOrDefault(n) for n in SIZES if base.hasParam(n) and base.isDefined(n)]
    return int(found[0]) if found else None


def sized(base, seed: int, budget: int | None):
    """A copy of an estimator with its seed and, where a budget is given, its first size parameter (at least 1) set."""
    made = base.copy()
    if made.hasParam("seed"):
        made.set(made.getParam("seed"), int(seed))
    for name in SIZES if budget is not None else ():
        if made.hasParam(name):
            made.set(made.getParam(name), max(1, int(budget)))
            break
    return made


def fit_one(train: DataFrame, test: DataFrame, base, budget: int | None, seed: int) -> DataFrame:
    """row_id, y, score of ``test`` by a registered classifier or any pyspark.ml classifier over a vector column."""
    if isinstance(base, str):
        return learners.fit_score(train, test, base, budget or 50, seed)
    from pyspark.ml.functions import array_to_vector, vector_to_array

    column, label = base.getOrDefault("featuresCol"), base.getOrDefault("labelCol")
    vectors = lambda df: df.select("row_id", "y", array_to_vector("features").alias(column), F.col("y").cast("double").alias(label if label != "y" else "_label"))
    fitted = sized(base, seed, budget).fit(vectors(train).withColumn(label, F.col("y").cast("double")))
    out = fitted.transform(vectors(test))
    columns = [out[c] for c in ("row_id", "y")]
    if "probability" in out.columns:
        return learners.positive_scores(out.select(*columns, vector_to_array("probability").alias("probability")), [float(c) for c in range(fitted.numClasses)])
    if "rawPrediction" in out.columns:
        return learners.positive_scores(out.select(*columns, vector_to_array("rawPrediction")[1].alias("raw")))
    return learners.positive_scores(out.select(*columns, "prediction"))


def fit_branches(train: DataFrame, test: DataFrame, classifier, oversampler, budgets: tuple[int | None, int | None], ratio: float, seed: int, options: dict | None = None) -> tuple[DataFrame, samplers.Sampled]:
    """(row_id, y, s_orig, s_shadow, source_prior, target_prior) of the test rows."""
    original = fit_one(train, test, classifier, budgets[0], seed + 101).select("row_id", "y", F.col("score").alias("s_orig"))
    made = samplers.resample(train, oversampler, ratio, seed + 202, **(options or {}))
    shadow = fit_one(made.df, test, classifier, budgets[1], seed + 303).select("row_id", F.col("score").alias("s_shadow"))
    prior = train.agg(F.avg("y")).first()[0] or 0.0
    source = made.df.agg(F.avg("y")).first()[0] or 0.0
    return written(original.join(shadow, "row_id").withColumns({"source_prior": F.lit(float(source)), "target_prior": F.lit(float(prior))})), made


@dataclass
class Selection:
    """What a blend was chosen by: mode, alpha, why, over how many inner splits, with what warnings."""

    mode: str
    alpha: float
    reason: str
    splits: int
    warnings: tuple[str, ...] = ()


def select_blend(train: DataFrame, classifier, oversampler="outward_ladder", ratio: float = 1.0, p: blending.BlendParams | None = None, options: dict | None = None) -> Selection:
    """Mode and alpha by repeated inner folds on ``train``."""
    p = p or blending.BlendParams()
    counts = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    least = min(counts.get(0, 0), counts.get(1, 0))
    parts, split, said = None, 0, set()
    if least >= 2:
        k = min(max(2, p.inner_folds), least)
        total = budget_of(classifier, p.total_budget)
        budget: tuple[int | None, int | None] = (None, None)
        if total is not None:
            both = [blending.split_budget(max(2, min(total, p.inner_budget_cap)), a) for a in blending.alpha_grid(p.alphas, p.default_alpha)]
            budget = (max(a for a, _ in both), max(b for _, b in both))
        for rep in range(max(1, p.inner_repeats)):
            at = written(frames.folds(train, k, p.seed + 3404 + 7919 * rep, "inner"))
            for fold in range(1, k + 1):
                scores, made = fit_branches(at.filter(F.col("fold") != fold).drop("fold"), at.filter(F.col("fold") == fold).drop("fold"), classifier, oversampler, budget, ratio, p.seed + 3600 + 1009 * rep + 37 * fold, options)
                said |= {made.warning} - {""}
                scores = scores.withColumn("split", F.lit(split))
                parts, split = scores if parts is None else parts.unionByName(scores), split + 1
    if parts is None:
        return Selection(p.default_mode, p.default_alpha, "default_relaxed_or_too_few_samples", 0)
    c = blending.choose(parts, p).first()
    return Selection(c["mode"], c["alpha"], c["reason"], split, tuple(sorted(said)))


def fit_blend(train: DataFrame, test: DataFrame, classifier, oversampler="outward_ladder", ratio: float = 1.0, p: blending.BlendParams | None = None, fixed_mode: str | None = None, options: dict | None = None) -> tuple[DataFrame, dict]:
    """Choose mode and alpha by inner folds, refit both branches on all of ``train``, score ``test``."""
    p = p or blending.BlendParams()
    if fixed_mode:
        p = replace(p, modes=(fixed_mode,), default_mode=fixed_mode)
    chosen = select_blend(train, classifier, oversampler, ratio, p, options)
    total = budget_of(classifier, p.total_budget)
    budgets = (None, None) if total is None else blending.split_budget(total, chosen.alpha)
    scores, made = fit_branches(train, test, classifier, oversampler, budgets, ratio, p.seed, options)
    out = blending.predict(scores, chosen.mode, chosen.alpha)
    warning = made.warning or "; ".join(chosen.warnings[:3])
    info = {"mode": chosen.mode, "alpha": chosen.alpha, "reason": chosen.reason, "budgets": budgets, "splits": chosen.splits, "n_generated": made.n_generated, "n_resampled": made.df.count(), "warning": warning}
    return out, info


class TwoBranchClassifier:
    """The two-branch blend as an estimator: ``fit`` a frame (row_id, features, y), then ``transform`` frames.

    base: a registered classifier's name or a pyspark.ml classifier; oversampler: a registered name or a callable.  Trees
    grow in the tasks that score, from the training frame that ``fit`` has written, so a fitted object is as
    small as its choices.
    """

    def __init__(self, base="rf", oversampler="outward_ladder", sampling_strategy: float = 1.0, params: blending.BlendParams | None = None, oversampler_options: dict | None = None) -> None:
        self.base, self.oversampler, self.ratio = base, oversampler, sampling_strategy
        self.params, self.options = params or blending.BlendParams(), dict(oversampler_options or {})

    def fit(self, train: DataFrame) -> TwoBranchModel:
        frames.validate(train)
        train = written(train.select("row_id", "features", "y"))
        return TwoBranchModel(self, train, select_blend(train, self.base, self.oversampler, self.ratio, self.params, self.options))


class TwoBranchModel:
    """selected_mode, selected_alpha, selected_ratio, selection_reason, inner_cv_splits and the branches' budgets."""

    def __init__(self, made_by: TwoBranchClassifier, train: DataFrame, chosen: Selection) -> None:
        self.by, self.train, self.chosen = made_by, train, chosen
        self.selected_mode, self.selected_alpha, self.selection_reason = chosen.mode, chosen.alpha, chosen.reason
        self.selected_ratio, self.inner_cv_splits = S.alpha_ratio(chosen.alpha), chosen.splits
        total = budget_of(made_by.base, made_by.params.total_budget)
        self.original_budget, self.shadow_budget = (None, None) if total is None else blending.split_budget(total, chosen.alpha)

    def transform(self, df: DataFrame) -> DataFrame:
        """row_id, y, score, label; rows without y get null there."""
        test = df.select("row_id", "features", F.col("y") if "y" in df.columns else F.lit(None).cast("int").alias("y"))
        scores, _ = fit_branches(self.train, test, self.by.base, self.by.oversampler, (self.original_budget, self.shadow_budget), self.by.ratio, self.by.params.seed, self.by.options)
        return blending.predict(scores, self.chosen.mode, self.chosen.alpha)


@dataclass
class Outcome:
    """What one job made of one fold: scored rows (row_id, y, score[, label]) and what its result row says."""

    scored: DataFrame
    n_resampled: int
    n_generated: int
    warning: str
    components: str
    estimators: str
    notes: str


def fit_native(classifier: str, train: DataFrame, test: DataFrame, seed: int, total: int, weighted: bool = False) -> Outcome:
    out = learners.fit_score(train, test, classifier, total, seed, weighted)
    return Outcome(out, train.count(), 0, "", f"{classifier} {'weighted' if weighted else 'native'}", str(total), "class_weight=balanced" if weighted else "")


def fit_sampled(classifier: str, oversampler: str, train: DataFrame, test: DataFrame, seed: int, total: int, ratio: float, options: dict | None = None) -> Outcome:
    s = samplers.resample(train, oversampler, ratio, seed, **(options or {}))
    out = learners.fit_score(s.df, test, classifier, total, seed)
    return Outcome(out, s.df.count(), s.n_generated, s.warning, oversampler, str(total), f"{classifier} trained after {oversampler} oversampling.")


def fit_blended(classifier: str, oversampler: str, train: DataFrame, test: DataFrame, seed: int, total: int, ratio: float, p: blending.BlendParams | None = None, mode: str | None = None, options: dict | None = None) -> Outcome:
    out, i = fit_blend(train, test, classifier, oversampler, ratio, replace(p or blending.BlendParams(), seed=seed, total_budget=total), mode, options)
    a, b = i["budgets"]
    notes = f"selected mode={i['mode']}, shadow alpha={i['alpha']:.6f} (approx original:shadow {S.alpha_ratio(i['alpha'])}); selection_reason={i['reason']}; inner_cv_splits={i['splits']}"
    return Outcome(out, i["n_resampled"], i["n_generated"], i["warning"], f"{classifier}_original:{a}+{oversampler}_shadow:{b}", f"{a}+{b}", notes)


def fit_rival(name: str, train: DataFrame, test: DataFrame, seed: int, total: int) -> Outcome:
    return Outcome(learners.fit_score(train, test, name, total, seed), train.count(), 0, "", name, str(total), "external imbalanced-ensemble baseline")


def run(data: Sequence[frames.Dataset], classifiers: Sequence[str], oversamplers: Sequence[str], groups: Sequence[str] = ("native", "oversampler", "blend", "rivals"), seeds: Sequence[int] = (42, 44, 49), folds: int = 5, total: int = 200, ratio: float = 1.0, p: blending.BlendParams | None = None, exact: bool = False, names: Names = Names(), options: dict | None = None) -> DataFrame:
    """One row of RESULT for each dataset, seed, fold and job.  In every fold features are imputed and standardised by the
    training rows; ``options`` go to the oversamplers."""
    if not data:
        raise ValueError("no datasets")
    classifiers, oversamplers = [learners.canonical(c) for c in classifiers], [samplers.canonical(o) for o in oversamplers]
    spark: SparkSession = data[0].df.sparkSession
    rows = []
    for d in data:
        counts = {r["y"]: r["count"] for r in d.df.groupBy("y").count().collect()}
        if min(counts.get(0, 0), counts.get(1, 0)) < folds:
            raise ValueError(f"{d.name}: the smaller class has fewer than {folds} rows")
        for seed in seeds:
            at = written(frames.folds(d.df, folds, seed))
            for fold in range(1, folds + 1):
                train, test = map(written, frames.prepared(at.filter(F.col("fold") != fold).drop("fold"), at.filter(F.col("fold") == fold).drop("fold")))
                n_train, n_test = train.count(), test.count()
                for clf, name, kind, mode in jobs(classifiers, oversamplers, groups, exact):
                    began = time.perf_counter()
                    if kind in ("native", "weighted"):
                        o = fit_native(clf, train, test, seed, total, kind == "weighted")
                        method, family = f"{clf}_{'none' if kind == 'native' else 'class_weight_balanced'}", "native_none" if kind == "native" else "weighted_or_cost_sensitive"
                        label, strategy = "none", "native"
                    elif kind == "rival":
                        o, method, family, label, strategy = fit_rival(clf, train, test, seed, total), clf, "rival_imbalanced_ensemble", "internal", "internal"
                    elif kind == "oversampler":
                        o, method = fit_sampled(clf, name, train, test, seed, total, ratio, options), sampler_method(clf, name)
                        family, label, strategy = "proposed_oversampler_downstream" if name == "outward_ladder" else "oversampler_downstream", name, str(ratio)
                    else:
                        o, family, label, strategy = fit_blended(clf, name, train, test, seed, total, ratio, p, mode, options), names.family, name, str(ratio)
                        method = blend_method(clf, name, mode, names.prefix)
                    alias = published_alias(clf, name, mode, names) if kind == "blend" else method
                    method = alias if names.publish else method
                    m = metrics.all_metrics(o.scored.withColumn("g", F.lit(0)), ["g"], "score").first()
                    values = [None if m is None else m[c] for c in ("pr_auc", "roc_auc", "f1", "recall", "precision", "balanced_accuracy", "mcc", "accuracy")]
                    rows.append((d.name, d.source, seed, fold, method, alias, family, clf, label, strategy, *values, n_train, n_test, o.n_resampled, o.n_generated, round(time.perf_counter() - began, 6), o.warning, total, o.components, o.estimators, o.notes))
    return spark.createDataFrame(rows, RESULT)
