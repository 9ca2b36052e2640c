"""Scoring a stream of branch scores.

Prior correction and blending look at one row at a time, so the same expressions run on a stream unchanged and without
state.  Rank modes rank a whole batch and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalar as S


def blend_stream(scores: DataFrame, mode: str, alpha: float, source_prior: float, target_prior: float) -> DataFrame:
    """Adds score and label to a (streaming) frame with s_orig and s_shadow."""
    if mode not in S.MODES or mode.endswith("rank"):
        raise ValueError(f"mode {mode!r} cannot score row by row")
    shadow = F.col("s_shadow")
    if mode.startswith("priorcorr"):
        shadow = S.prior_correct(shadow, F.lit(source_prior), F.lit(target_prior))
    score = S.clip01(S.blend(F.col("s_orig"), shadow, F.lit(alpha), F.lit(mode)))
    return scores.withColumn("score", score).withColumn("label", (F.col("score") >= 0.5).cast("int"))
