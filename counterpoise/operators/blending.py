"""Blending an original-prior model with one trained on oversampled data, and selecting the blend by constraints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar as S
from . import metrics as M


@dataclass
class BlendParams:
    default_alpha: float = 0.333333
    default_mode: str = "prob"
    prior_drift_max: float | None = 0.05
    brier_degradation_max: float | None = 0.01
    precision_topk_loss_max: float | None = 0.05
    confidence_z: float = 1.96
    alphas: tuple[float, ...] = tuple(round(0.02 * i, 6) for i in range(51))
    modes: tuple[str, ...] = ("prob", "logit", "priorcorr", "priorcorr_logit")
    inner_folds: int = 3
    inner_repeats: int = 2
    inner_budget_cap: int = 80
    total_budget: int = 200
    seed: int = 42


def alpha_grid(alphas: tuple[float, ...], default: float) -> list[float]:
    """Clipped, rounded to 6 places, distinct, ascending, with the default."""
    return sorted({round(min(1.0, max(0.0, a)), 6) for a in (*alphas, default)})


def modes(names: tuple[str, ...], default: str) -> list[str]:
    """Known modes, first occurrence wins, with the default."""
    out = list(dict.fromkeys(str(m).strip().lower() for m in names))
    for m in out:
        if m not in S.MODES:
            raise ValueError(f"unknown mode {m!r}; known: {', '.join(S.MODES)}")
    return out if default in out else [*out, default]


def grid(spark: SparkSession, p: BlendParams) -> DataFrame:
    """cand_idx, mode, alpha: mode-major, alpha ascending."""
    rows = [(m, a) for m in modes(p.modes, p.default_mode) for a in alpha_grid(p.alphas, p.default_alpha)]
    return spark.createDataFrame([(i, m, a) for i, (m, a) in enumerate(rows)], "cand_idx int, mode string, alpha double")


def split_budget(total: int, alpha: float) -> tuple[int, int]:
    """Trees of the original and the shadow branch: each at least one."""
    total = max(2, total)
    shadow = min(total - 1, max(1, round(total * alpha)))
    return total - shadow, shadow


def scored(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """split, cand_idx, mode, alpha, row_id, y, s for scores (split, row_id, y, s_orig, s_shadow, source_prior,
    target_prior): every row under every candidate of the (small, broadcast) grid, without any Python."""
    shadow = F.when(F.col("mode").startswith("priorcorr"), S.prior_correct(F.col("s_shadow"), F.col("source_prior"), F.col("target_prior"))).otherwise(F.col("s_shadow"))
    need_rank = candidates.filter(F.col("mode").isin("rank", "priorcorr_rank")).limit(1).count() > 0
    if need_rank:
        scores = M.rank01(scores, "s_orig", ["split"], "r_orig")
        scores = scores.withColumn("_corr", S.prior_correct(F.col("s_shadow"), F.col("source_prior"), F.col("target_prior")))
        scores = M.rank01(M.rank01(scores, "s_shadow", ["split"], "r_plain"), "_corr", ["split"], "r_corr")
        r1 = F.when(F.col("mode") == "priorcorr_rank", F.col("r_corr")).otherwise(F.col("r_plain"))
        s = S.blend(F.col("s_orig"), shadow, F.col("alpha"), F.col("mode"), F.col("r_orig"), r1)
    else:
        s = S.blend(F.col("s_orig"), shadow, F.col("alpha"), F.col("mode"))
    # The grid is a parameter list (208 rows at the defaults), not data.
    return scores.crossJoin(F.broadcast(candidates)).select("split", "cand_idx", "mode", "alpha", "row_id", "y", S.clip01(s).alias("s"))


def candidate_stats(scored_: DataFrame) -> DataFrame:
    """AP, Brier, prior drift and precision at k for each split and candidate."""
    by = ["split", "cand_idx"]
    rounded = scored_.withColumn("s", F.round("s", 9))
    out = M.average_precision(rounded, by).join(M.calibration(rounded, by), by).join(M.precision_at_top(rounded, by), by)
    return out.select(*by, "ap", "brier", "predicted_prior", "true_prior", "prior_drift", "p_at_k")


def bounds(stats: DataFrame, base: DataFrame, default_idx: int, p: BlendParams) -> DataFrame:
    """Means, confidence bounds, violations and feasibility of each candidate.

    base: split, brier, p_at_k of the original branch alone.
    """
    d = stats.filter(F.col("cand_idx") == default_idx).select("split", F.col("ap").alias("ap0"))
    b = base.select("split", F.col("brier").alias("brier0"), F.col("p_at_k").alias("p0"))
    rows = stats.join(F.broadcast(d), "split").join(F.broadcast(b), "split")  # one row for each split
    rows = rows.withColumns({"ap_delta": F.col("ap") - F.col("ap0"), "brier_loss": F.col("brier") - F.col("brier0"), "p_loss": F.col("p0") - F.col("p_at_k")})
    z = F.lit(p.confidence_z)
    # Infinite deviation times a zero factor is undefined and violates nothing.
    side = lambda name, sign: M.mean_finite(F.col(name)) + F.lit(float(sign)) * z * M.standard_error(F.col(name))
    agg = rows.groupBy("cand_idx").agg(
        M.mean_finite(F.col("ap")).alias("ap_mean"), side("ap", -1).alias("ap_lcb"), side("ap_delta", -1).alias("ap_delta_lcb"),
        side("prior_drift", 1).alias("prior_drift_ucb"), side("brier_loss", 1).alias("brier_ucb"), side("p_loss", 1).alias("p_loss_ucb"),
    )
    limit = lambda c, most: F.when(~F.isnan(c) & (F.col(c) > most), 1).otherwise(0) if enabled(most) else F.lit(0)
    v = limit("prior_drift_ucb", p.prior_drift_max) + limit("brier_ucb", p.brier_degradation_max) + limit("p_loss_ucb", p.precision_topk_loss_max)
    return agg.withColumn("violations", v).withColumn("feasible", F.col("violations") == 0)


def enabled(limit: float | None) -> bool:
    return limit is not None and limit == limit and 0 <= limit < float("inf")


def select(evaluated: DataFrame, candidates: DataFrame, p: BlendParams) -> DataFrame:
    """One row: mode, alpha, reason.  The default stays if it is feasible and no feasible other candidate surely gains;
    else the surest gain; else the best feasible; else the default."""
    number = lambda c: F.when(S.finite(F.col(c)), F.col(c))
    e = evaluated.join(F.broadcast(candidates), "cand_idx").withColumns({c: number(c) for c in ("ap_delta_lcb", "ap_lcb", "ap_mean")})
    e = e.withColumn("is_default", (F.col("mode") == p.default_mode) & (F.abs(F.col("alpha") - p.default_alpha) < 1e-9))
    e = e.withColumn("gains", F.col("feasible") & ~F.col("is_default") & (F.coalesce("ap_delta_lcb", F.lit(-1.0)) > 0)).withColumn("far", F.abs(F.col("alpha") - p.default_alpha))
    last = lambda c: F.coalesce(c, F.lit(float("-inf")))
    one = lambda cond, *keys: F.max_by(F.struct("mode", "alpha"), F.when(cond, F.struct(*keys, (-F.col("far")).alias("near"), (-F.col("cand_idx")).alias("at"))))
    r = e.agg(
        F.bool_or("gains").alias("any_gain"), F.bool_or("feasible").alias("any_ok"), F.bool_or(F.col("is_default") & F.col("feasible")).alias("default_ok"),
        one(F.col("gains"), last("ap_delta_lcb").alias("k1"), last("ap_lcb").alias("k2")).alias("gain"),
        one(F.col("feasible"), last("ap_lcb").alias("k1"), last("ap_mean").alias("k2")).alias("ok"),
    )
    default = F.struct(F.lit(p.default_mode).alias("mode"), F.lit(p.default_alpha).alias("alpha"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    keep, gain, ok = flag("default_ok") & ~flag("any_gain"), flag("any_gain"), flag("any_ok")
    chosen = F.when(keep, default).when(gain, F.col("gain")).when(ok, F.col("ok")).otherwise(default)
    reason = F.when(keep, "default_feasible_no_positive_lcb_delta").when(gain, "adapted_positive_lcb_delta").when(ok, "best_feasible_lcb_ap").otherwise("default_relaxed_or_too_few_samples")
    return r.select(chosen.alias("c"), reason.alias("reason")).select("c.mode", "c.alpha", "reason")


def original_stats(scores: DataFrame) -> DataFrame:
    """split, brier, p_at_k of the original branch."""
    s = scores.select("split", "row_id", "y", S.clip01(F.col("s_orig")).alias("s"))
    return M.calibration(s, ["split"]).join(M.precision_at_top(s, ["split"]), "split").select("split", "brier", "p_at_k")


def evaluate(scores: DataFrame, p: BlendParams) -> tuple[DataFrame, DataFrame]:
    """(evaluated, candidates) for one set of branch scores."""
    candidates = grid(scores.sparkSession, p)
    default = next(r["cand_idx"] for r in candidates.collect() if r["mode"] == p.default_mode and abs(r["alpha"] - p.default_alpha) < 1e-9)
    return bounds(candidate_stats(scored(scores, candidates)), original_stats(scores), default, p), candidates


def choose(scores: DataFrame, p: BlendParams) -> DataFrame:
    evaluated, candidates = evaluate(scores, p)
    return select(evaluated, candidates, p)


def predict(scores: DataFrame, mode: str, alpha: float) -> DataFrame:
    """row_id, y, score, label of (row_id, y, s_orig, s_shadow, source_prior, target_prior); rank modes rank the whole batch."""
    one = scores.sparkSession.createDataFrame([(0, mode, alpha)], "cand_idx int, mode string, alpha double")
    s = scored(scores.withColumn("split", F.lit(0)), one)
    return s.select("row_id", "y", F.col("s").alias("score"), (F.col("s") >= 0.5).cast("int").alias("label"))


def pseudo_scores(frame: DataFrame, splits: int = 4) -> DataFrame:
    """Deterministic branch scores without a learner, with many ties and a last split of one class."""
    split = F.pmod("row_id", F.lit(splits)).cast("int")
    y = F.when(split == splits - 1, 0).otherwise(F.col("y"))
    level = lambda w, u: F.floor(100 * (w * y + (0.95 - w) * u)) / 100 + 0.01
    part = lambda tag: S.uniform(42, tag, F.col("row_id"))
    s = frame.select("row_id", split.alias("split"), y.cast("int").alias("y"), level(F.lit(0.25), part("orig")).alias("s_orig"), level(F.lit(0.35), part("shadow")).alias("s_shadow"))
    return s.withColumns({"source_prior": F.lit(0.5), "target_prior": F.lit(0.1)})


