"""Classification metrics as grouped aggregates over (group columns, row_id, y, s)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalar as S


def rank01(df: DataFrame, score: str, by: list[str], to: str, exact: bool = False) -> DataFrame:
    """Adds ``to``: the tie-averaged rank over (n - 1).  By default it is half a rank low, as published results have it;
    ``exact`` gives the true tie average.  A group of one row gets 0.5."""
    n = F.count("*").over(Window.partitionBy(*by))
    ties = F.count("*").over(Window.partitionBy(*by, score))
    rank = F.rank().over(Window.partitionBy(*by).orderBy(score))
    shift = 0.5 if exact else 1.0
    return df.withColumn(to, F.when(n <= 1, 0.5).otherwise((rank - 1 + ties / 2.0 - shift) / (n - 1)))


def normalize01(df: DataFrame, score: str, by: list[str], to: str) -> DataFrame:
    if not by:  # the whole table: one row of bounds instead of one task
        ends = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
        lo, hi = F.col("_lo"), F.col("_hi")
        value = F.when(hi - lo < S.TINY, 0.0).otherwise((F.col(score) - lo) / (hi - lo))
        return df.crossJoin(F.broadcast(ends)).withColumn(to, value).drop("_lo", "_hi")
    w = Window.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(to, F.when(hi - lo < S.TINY, 0.0).otherwise((F.col(score) - lo) / (hi - lo)))


def average_precision(df: DataFrame, by: list[str], score: str = "s") -> DataFrame:
    """Sum over distinct scores, high to low, of recall step times precision; null for a group of one class.
    Scores are aggregated before they are sorted, so ties and large groups cost one row a score."""
    g = df.groupBy(*by, score).agg(F.sum(F.col("y").cast("long")).alias("tp"), F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    c = g.select(*by, "tp", F.sum("tp").over(w).alias("ctp"), F.sum("n").over(w).alias("cn"), F.sum("tp").over(every).alias("p"), F.sum("n").over(every).alias("all"))
    part = F.when((F.col("p") > 0) & (F.col("p") < F.col("all")), F.col("tp") / F.col("p") * (F.col("ctp") / F.col("cn")))
    return c.groupBy(*by).agg(F.sum(part).alias("ap"))


def roc_auc(df: DataFrame, by: list[str], score: str = "s") -> DataFrame:
    """Share of pairs of a positive and a negative that are in order, ties one half; null for a group of one class."""
    g = df.groupBy(*by, score).agg(F.sum(F.col("y").cast("long")).alias("tp"), F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    c = g.withColumn("below", F.sum("n").over(w) - F.col("n"))
    a = c.groupBy(*by).agg(F.sum(F.col("tp") * (F.col("below") + (F.col("n") + 1) / 2.0)).alias("ranks"), F.sum("tp").alias("p"), F.sum("n").alias("all"))
    q = F.col("all") - F.col("p")
    return a.select(*by, F.when((F.col("p") > 0) & (q > 0), (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * q)).alias("auc"))


def confusion(df: DataFrame, by: list[str], score: str = "s", at: float = 0.5) -> DataFrame:
    """f1, recall, precision (0 if undefined), balanced accuracy over the classes present, MCC and accuracy."""
    hit = F.col(score) >= at
    c = df.groupBy(*by).agg(*[F.count_if((F.col("y") == y) & (hit if p else ~hit)).cast("double").alias(n) for n, y, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tpr, tnr = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    balanced = F.coalesce((tpr + tnr) / 2, tpr, tnr)
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return c.select(*by, ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp).alias("precision"), balanced.alias("balanced_accuracy"), mcc.alias("mcc"), ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"))


def precision_at_top(df: DataFrame, by: list[str], score: str = "s") -> DataFrame:
    """Share of positives among the k best scores, k the number of positives, at least 1; ties to the smaller row_id."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "row_id"))
    k = F.greatest(F.lit(1), F.sum(F.col("y").cast("long")).over(Window.partitionBy(*by)))
    a = df.select(*by, "y", rank.alias("rn"), k.alias("k"))
    return a.groupBy(*by).agg(F.avg(F.when(F.col("rn") <= F.col("k"), F.col("y").cast("double"))).alias("p_at_k"))


def calibration(df: DataFrame, by: list[str], score: str = "s") -> DataFrame:
    """Brier score, mean clipped score, prior and their absolute difference."""
    p = S.clip01(F.col(score))
    return df.groupBy(*by).agg(F.avg((p - F.col("y")) * (p - F.col("y"))).alias("brier"), F.avg(p).alias("predicted_prior"), F.avg("y").alias("true_prior"), F.abs(F.avg(p) - F.avg("y")).alias("prior_drift"))


def all_metrics(df: DataFrame, by: list[str], score: str = "s") -> DataFrame:
    """PR-AUC, ROC-AUC and the six of ``confusion``."""
    out = average_precision(df, by, score).withColumnRenamed("ap", "pr_auc").join(roc_auc(df, by, score).withColumnRenamed("auc", "roc_auc"), by)
    return out.join(confusion(df, by, score), by)


def mean_finite(v: Column) -> Column:
    return F.avg(F.when(S.finite(v), v))


def standard_error(v: Column) -> Column:
    """Sample deviation over the root of n; infinite below two values."""
    ok = F.when(S.finite(v), v)
    return F.when(F.count(ok) < 2, F.lit(float("inf"))).otherwise(F.stddev_samp(ok) / F.sqrt(F.count(ok)))
