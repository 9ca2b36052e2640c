"""Command line: python -m counterpoise.plans.cli --data x.csv --classifiers rf --oversamplers smote --output out"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators.blending import BlendParams
from ..sources import tables
from . import experiment


def blend_params(n: argparse.Namespace) -> BlendParams:
    same = ("inner_folds", "inner_repeats", "inner_budget_cap", "default_mode", "prior_drift_max", "brier_degradation_max", "precision_topk_loss_max", "confidence_z")
    given = {k: getattr(n, k) for k in same} | {"default_alpha": round(n.default_alpha, 6)}
    if n.alphas:
        given["alphas"] = tuple(float(x) for x in experiment.parse_list(n.alphas))
    if n.modes:
        given["modes"] = tuple(experiment.parse_list(n.modes))
    return BlendParams(**given | experiment.parse_options(n.options))


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--data", required=True, help="CSV or Parquet files, comma-separated")
    a.add_argument("--target")
    a.add_argument("--classifiers", default="rf,extratrees,bagged_cart")
    a.add_argument("--oversamplers", default="smote,outward_ladder")
    a.add_argument("--groups", default="native,oversampler,blend,rivals")
    a.add_argument("--seeds", default="42,44,49")
    a.add_argument("--folds", type=int, default=5)
    a.add_argument("--total-estimators", type=int, default=200)
    a.add_argument("--sampling-strategy", type=float, default=1.0)
    a.add_argument("--oversampler-options", help="JSON object passed to the oversamplers")
    a.add_argument("--alphas", help="shares of the shadow branch; default 0 to 1 by 0.02")
    a.add_argument("--modes", help="blend modes; default prob, logit, priorcorr, priorcorr_logit")
    a.add_argument("--inner-folds", type=int, default=3)
    a.add_argument("--inner-repeats", type=int, default=2)
    a.add_argument("--inner-budget-cap", type=int, default=80)
    a.add_argument("--default-alpha", type=float, default=1 / 3)
    a.add_argument("--default-mode", default="prob")
    a.add_argument("--prior-drift-max", type=float, default=0.05)
    a.add_argument("--brier-degradation-max", type=float, default=0.01)
    a.add_argument("--precision-topk-loss-max", type=float, default=0.05)
    a.add_argument("--confidence-z", type=float, default=1.96)
    a.add_argument("--options", help="JSON object of further blend parameters")
    a.add_argument("--published-prefix", default="blend", help="how published tables name the blend")
    a.add_argument("--method-names", choices=["readable", "published"], default="readable")
    a.add_argument("--data-dir", default="data", help="folder of named Parquet datasets")
    a.add_argument("--exact", action="store_true", help="the published menu: three classifiers, nine oversamplers, all groups, default parameters")
    a.add_argument("--output", required=True)
    n = a.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    data = tables.load_datasets(spark, experiment.parse_list(n.data), n.target, n.data_dir)
    lists = [experiment.parse_list(x) for x in (n.classifiers, n.oversamplers, n.groups)]
    names = experiment.Names(published=n.published_prefix, publish=n.method_names == "published" or n.exact)
    if n.exact:
        p, lists, total, ratio = BlendParams(), [list(x) for x in experiment.EXACT], 200, 1.0
    else:
        p, total, ratio = blend_params(n), n.total_estimators, n.sampling_strategy
    seeds = [int(s) for s in experiment.parse_list(n.seeds)]
    out = experiment.run(data, *lists, seeds, n.folds, total, ratio, p, n.exact, names, experiment.parse_options(n.oversampler_options))
    tables.write_results(out, n.output)
    out.groupBy("method").avg("pr_auc").orderBy("avg(pr_auc)", ascending=False).show(20, False)


if __name__ == "__main__":
    main()
