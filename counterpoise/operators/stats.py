"""Paired comparison of methods over (dataset, classifier) blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import scalar as S


def pseudo_results(spark: SparkSession, datasets: int = 25) -> DataFrame:
    """Deterministic result rows: dataset, classifier, seed, fold, method, pr_auc."""
    lists = [("classifier", ("rf", "extratrees", "bagged_cart")), ("seed", (42, 44, 49)), ("fold", tuple(range(1, 6))), ("method", ("A-1", "A-2", "B-1", "B-2", "C-1", "C-2"))]
    df = spark.range(datasets).select(F.concat(F.lit("d"), F.col("id")).alias("dataset"))
    for name, values in lists:
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    u = S.uniform(42, "result", F.col("dataset"), F.col("classifier"), F.col("seed"), F.col("fold"), F.col("method"))
    bonus = F.when(F.col("method").startswith("A"), 0.06).when(F.col("method").startswith("B"), 0.03).otherwise(0.0)
    return df.withColumn("pr_auc", F.floor(1000 * (0.5 + 0.3 * u + bonus)) / 1000)


def method_key(df: DataFrame) -> DataFrame:
    """method becomes the published alias where there is one."""
    return df.withColumn("method", F.coalesce("paper_method_alias", "method")) if "paper_method_alias" in df.columns else df


def block_table(df: DataFrame, methods: list[str]) -> DataFrame:
    """Mean PR-AUC of each method in each block, one pass with conditional means."""
    return df.groupBy("classifier", "dataset").agg(*[F.avg(F.when(F.col("method") == m, F.col("pr_auc"))).alias(m.lower().replace("-", "_")) for m in methods])


def wins(df: DataFrame, champion: str) -> DataFrame:
    """For every other method: mean and median difference of block means, wins, ties, losses of the champion."""
    means = df.groupBy("classifier", "dataset", "method").agg(F.avg("pr_auc").alias("m"))
    best = means.filter(F.col("method") == champion).select("classifier", "dataset", F.col("m").alias("c"))
    d = means.filter(F.col("method") != champion).join(best, ["classifier", "dataset"]).withColumn("d", F.round(F.col("c") - F.col("m"), 9))
    return d.groupBy("method").agg(F.avg("d").alias("mean_delta"), F.median("d").alias("median_delta"), *[F.count_if(x).alias(n) for n, x in (("wins", F.col("d") > 0), ("ties", F.col("d") == 0), ("losses", F.col("d") < 0))])


def friedman_ranks(df: DataFrame) -> DataFrame:
    """Mean over the blocks of each method's tie-averaged rank, 1 for the highest mean."""
    means = df.groupBy("classifier", "dataset", "method").agg(F.round(F.avg("pr_auc"), 9).alias("m"))
    rank = F.rank().over(Window.partitionBy("classifier", "dataset").orderBy(F.desc("m"))) + (F.count("*").over(Window.partitionBy("classifier", "dataset", "m")) - 1) / 2.0
    return means.withColumn("r", rank).groupBy("method").agg(F.avg("m").alias("mean_pr_auc"), F.avg("r").alias("avg_rank"))


def wilcoxon(df: DataFrame, champion: str) -> DataFrame:
    """For every other method: non-zero differences and the sum of the ranks of positive ones (ties averaged)."""
    means = df.groupBy("classifier", "dataset", "method").agg(F.avg("pr_auc").alias("m"))
    best = means.filter(F.col("method") == champion).select("classifier", "dataset", F.col("m").alias("c"))
    d = means.filter(F.col("method") != champion).join(best, ["classifier", "dataset"]).withColumn("d", F.round(F.col("c") - F.col("m"), 9)).filter("d <> 0").withColumn("a", F.abs("d"))
    r = F.rank().over(Window.partitionBy("method").orderBy("a")) + (F.count("*").over(Window.partitionBy("method", "a")) - 1) / 2.0
    return d.withColumn("r", r).groupBy("method").agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"))


def wilcoxon_p(n: int, w_plus: float, exact_to: int = 25) -> float:
    """One-sided p (greater): exact for few differences without fractional ranks, else the normal approximation."""
    if n == 0:
        return 1.0
    if n <= exact_to and w_plus == int(w_plus):
        ways = [1]
        for r in range(1, n + 1):
            ways = [(ways[i] if i < len(ways) else 0) + (ways[i - r] if 0 <= i - r < len(ways) else 0) for i in range(len(ways) + r)]
        return sum(ways[int(w_plus) :]) / 2**n
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24
    return 0.5 * math.erfc((w_plus - mean) / math.sqrt(2 * var))


def holm(df: DataFrame, p: str = "p", name: str = "code") -> DataFrame:
    """Adds holm_p: the step-down maximum of (m - i + 1) p, at most 1."""
    order = Window.orderBy(p, name)  # one row for each comparison
    m = F.count("*").over(Window.partitionBy(F.lit(1)))
    step = df.withColumn("_i", F.row_number().over(order)).withColumn("_m", m).withColumn("_v", (F.col("_m") - F.col("_i") + 1) * F.col(p))
    return step.withColumn("holm_p", F.least(F.lit(1.0), F.max("_v").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_i", "_m", "_v")


def signature(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset", "seed", "fold", "method").agg(F.count("*").alias("n"))


def signature_diff(made: DataFrame, expected: DataFrame) -> DataFrame:
    """Keys whose row counts differ, with both counts and where the key occurs; null keys are equal to each other."""
    a, b = signature(made).alias("a"), signature(expected).alias("b")
    keys = ("dataset", "seed", "fold", "method")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    j = a.join(b, on, "full_outer")
    where = F.when(F.col("a.n").isNull(), "expected_only").when(F.col("b.n").isNull(), "made_only").otherwise("both")
    rows = j.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], F.col("a.n").alias("n_made"), F.col("b.n").alias("n_expected"), where.alias("side"))
    return rows.filter(~F.col("n_made").eqNullSafe(F.col("n_expected")))


def value_diff(made: DataFrame, expected: DataFrame) -> DataFrame:
    """Difference of mean PR-AUC by method, null where one side has none, the largest 20."""
    mean = lambda df, to: method_key(df).groupBy("method").agg(F.avg("pr_auc").alias(to))
    d = mean(made, "m").join(mean(expected, "e"), "method", "full_outer").select("method", F.round(F.col("m") - F.col("e"), 9).alias("delta"))
    return d.orderBy(F.desc_nulls_last(F.abs("delta")), "method").limit(20)


def top_methods(df: DataFrame, n: int = 20) -> DataFrame:
    return df.groupBy("method").agg(F.avg("pr_auc").alias("mean_pr_auc")).orderBy(F.desc("mean_pr_auc"), "method").limit(n)


def shape(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_datasets, n_methods, seeds (sorted), first_fold, last_fold of result rows."""
    seeds = F.array_sort(F.collect_set("seed"))
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct("dataset").alias("n_datasets"), F.count_distinct("method").alias("n_methods"), seeds.alias("seeds"), F.min("fold").alias("first_fold"), F.max("fold").alias("last_fold"))


def lookup(df: DataFrame, code: str, column: str, key: str = "code") -> float:
    """The value of ``column`` in the row named ``code`` of a summary table; KeyError if there is none."""
    found = df.filter(F.col(key) == code).select(column).limit(1).collect()
    if not found:
        raise KeyError(f"no row {code!r}")
    return found[0][0]


@dataclass(frozen=True)
class Expected:
    """Published figures that result rows and summary tables must meet; a None is not checked."""

    rows: int | None = None
    datasets: int | None = None
    seeds: tuple[int, ...] | None = None
    folds: int | None = None
    blocks: int | None = None
    champion_mean: float | None = None
    #: method -> (mean difference to the champion, its wins) over the blocks.
    against: dict[str, tuple[float, int]] = field(default_factory=dict)
    #: (code, column) -> value in the table of pairs and in that of ranks.
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    ranks: dict[tuple[str, str], float] = field(default_factory=dict)


def alignment(results: DataFrame | None, champion: str, expected: Expected, pairs: DataFrame | None = None, ranks: DataFrame | None = None, tolerance: float = 5e-10) -> list[str]:
    """What differs from ``expected``, as sentences; none if all agrees.  In ``champion`` and the keys of ``against`` a * stands
    for the classifier that a method's name holds."""
    wrong: list[str] = []

    def same(what: str, got, want, near: bool = False) -> None:
        if want is not None and not (close(float(got), want, tolerance) if near else got == want):
            wrong.append(f"{what}: {got} instead of {want}")

    if results is not None:
        df = method_key(results)
        df = df.withColumn("method", F.when(F.col("method") == F.col("classifier"), F.col("method")).otherwise(F.replace("method", F.col("classifier"), F.lit("*"))))
        r = shape(df).first()
        same("rows", r["n_rows"], expected.rows)
        same("datasets", r["n_datasets"], expected.datasets)
        same("seeds", tuple(r["seeds"]), expected.seeds)
        same("folds", (r["first_fold"], r["last_fold"]), None if expected.folds is None else (1, expected.folds))
        if expected.champion_mean is not None:
            same("mean of the champion", df.filter(F.col("method") == champion).agg(F.avg("pr_auc")).first()[0] or math.nan, expected.champion_mean, True)
        names = [champion, *expected.against]
        table = block_table(df, names).toDF("classifier", "dataset", *[f"m{i}" for i in range(len(names))])
        whole = table.filter(" and ".join(f"m{i} is not null" for i in range(len(names)))).count()
        same("complete blocks", whole, expected.blocks)
        for i, (name, (delta, won)) in enumerate(expected.against.items(), 1):
            d = table.agg(F.avg(F.col("m0") - F.col(f"m{i}")).alias("d"), F.count_if(F.col("m0") > F.col(f"m{i}")).alias("w")).first()
            same(f"mean difference to {name}", math.nan if d["d"] is None else d["d"], delta, True)
            same(f"wins against {name}", d["w"], won)
    for name, df, wanted in (("pairs", pairs, expected.pairs), ("ranks", ranks, expected.ranks)):
        for (code, column), value in wanted.items() if df is not None else ():
            same(f"{column} of {code} in {name}", lookup(df, code, column), value, True)
    return wrong


def close(actual: float, expected: float, tolerance: float = 5e-10) -> bool:
    """Whether two numbers agree; a number that is not finite agrees with nothing."""
    return math.isfinite(actual) and math.isfinite(expected) and abs(actual - expected) <= tolerance
