"""Feature frames: (row_id, features array<double>, y int), their validation, encoding, bounds and folds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import scalar as S

#: Rows up to which a one-task window may number a table; larger tables are numbered by partition.
ONE_TASK = 1_000_000


@dataclass
class Dataset:
    df: DataFrame
    name: str
    source: str
    metadata: dict = field(default_factory=dict)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str, positive: int = 5) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), (F.col("label") == positive).cast("int").alias("y"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    words = F.size(F.split(F.trim("text"), " +")).cast("double")
    code = F.when(F.col("lang") == "de", 0.0).when(F.col("lang") == "en", 1.0).when(F.col("lang") == "es", 2.0).otherwise(3.0)
    return d.join(labels, "doc_id").select(F.col("doc_id").alias("row_id"), F.array(F.col("n_chars").cast("double"), words, code).alias("features"), F.col("toxic").alias("y"))


def validate(df: DataFrame) -> None:
    """Raise ValueError unless every label is 0 or 1 and all feature arrays have one length: one pass, one row back."""
    r = df.agg(F.count_if(~F.coalesce(F.col("y").isin(0, 1), F.lit(False))).alias("bad"), F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi")).first()
    if r["bad"]:
        raise ValueError(f"{r['bad']} labels are not 0 or 1")
    if r["lo"] != r["hi"]:
        raise ValueError(f"feature arrays have {r['lo']} to {r['hi']} values")


def class_counts(df: DataFrame, ratio: float = 1.0) -> DataFrame:
    """n0, n1, prior, target minority count and how many rows are missing for ``ratio``."""
    c = df.agg(F.count_if(F.expr("y = 0")).alias("n0"), F.count_if(F.expr("y = 1")).alias("n1"), F.avg("y").alias("prior"))
    return c.select("n0", "n1", "prior", (F.col("n1") + S.need(F.col("n1"), F.col("n0"), ratio)).alias("target"), S.need(F.col("n1"), F.col("n0"), ratio).alias("need"))


def encode(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Numbers as doubles, infinities as null, strings as the place among their sorted distinct values; columns without
    two distinct values are dropped.  The values of a string column stay distributed: they are numbered and joined."""
    types = dict(df.dtypes)
    for c in columns:
        if types[c] == "string":
            values = df.select(c).filter(F.col(c).isNotNull()).distinct()
            codes = values.select(F.col(c).alias("_v"), (F.row_number().over(Window.orderBy(c)) - 1).cast("double").alias("_code"))
            df = df.join(codes, df[c] == codes["_v"], "left").drop(c, "_v").withColumnRenamed("_code", c)
        else:
            v = F.col(c).cast("double")
            df = df.withColumn(c, F.when(S.finite(v), v))
    low_high = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).first()
    kept = [c for c in columns if low_high[f"lo_{c}"] is not None and low_high[f"lo_{c}"] != low_high[f"hi_{c}"]]
    if not kept:
        raise ValueError("no column has two distinct values")
    return df, kept


def positive_class(df: DataFrame, label: str, least: int = 10) -> DataFrame:
    """One row (label, n): the rarest class; with more than two classes the rarest of those with ``least`` rows, if any."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    k = counts.agg(F.count("*").alias("k"))
    ranked = counts.crossJoin(F.broadcast(k))  # one row
    late = F.when((F.col("k") > 2) & (F.col("n") < least), 1).otherwise(0)
    return ranked.orderBy(late, "n", "label").limit(1).select("label", "n")


def bounds(df: DataFrame) -> DataFrame:
    """pos, lo, hi: each dimension's range widened by a hundredth of its span (at least 1e-9); NaN is ignored."""
    v = df.select(F.posexplode("features").alias("pos", "v")).filter(S.finite(F.col("v")))
    b = v.groupBy("pos").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    span = F.greatest(F.col("b") - F.col("a"), F.lit(1e-9))
    return b.select("pos", (F.col("a") - 0.01 * span).alias("lo"), (F.col("b") + 0.01 * span).alias("hi"))


def bounds_row(df: DataFrame) -> DataFrame:
    """``bounds`` as one row of two arrays."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "lo", "hi")))
    return bounds(df).agg(rows.alias("r")).select(F.transform("r", lambda x: x["lo"]).alias("lo"), F.transform("r", lambda x: x["hi"]).alias("hi"))


def dense_index(df: DataFrame, order: str | list = "row_id", name: str = "i") -> DataFrame:
    """Number the rows from 0 in the order of ``order``: in one task up to ONE_TASK rows; beyond, by sorted ranges, each
    from the count of the ranges before it."""
    order = order if isinstance(order, list) else [order]
    if df.count() <= ONE_TASK:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    from .storage import written

    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("_part", before.alias("_before")))  # one row for each partition
    return parts.join(sizes, "_part").withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")).drop("_part", "_before")


def folds(df: DataFrame, k: int, seed: int = 42, tag: str = "fold") -> DataFrame:
    """Adds fold (from 1): rows of each class in seeded order are dealt in turn, the positives from where the negatives
    ended, so class counts differ by at most one between folds and so do the fold sizes."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), F.col("row_id").cast("string")))
    # Numbered throughout, negatives first, a class need not fit into one task.
    at = dense_index(df.withColumn("_key", key), ["y", "_key", "row_id"], "_i")
    return at.withColumn("fold", (F.col("_i") % k + 1).cast("int")).drop("_key", "_i")


def impute_and_scale(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """For each test fold: nulls become the median of the training rows, then columns are standardised by the training
    rows' mean and population deviation (1 if that is 0).  Long form: fold, row_id, y, column, value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select("row_id", "y", "fold", F.explode(pairs).alias("p")).select("row_id", "y", "fold", "p.column", F.col("p.v").alias("v"))
    others = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda f: f != F.col("fold"))
    train = long.withColumn("test", F.explode(others))
    median = train.groupBy("test", "column").agg(F.median("v").alias("m"))
    filled = train.join(F.broadcast(median), ["test", "column"]).withColumn("v", F.coalesce("v", "m"))
    stats = filled.groupBy("test", "column").agg(F.first("m").alias("m"), F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    at = long.join(F.broadcast(stats.withColumnRenamed("test", "fold")), ["fold", "column"])  # k rows for each column
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return at.select("fold", "row_id", "y", "column", ((F.coalesce("v", "m") - F.col("mu")) / sd).alias("value"))


def prepared(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames with features imputed by the median of the training rows and standardised by their mean and population
    deviation (1 if that is 0).  Null, NaN and infinite values are missing; dimensions without any value in training
    are dropped."""
    v = train.select(F.posexplode("features").alias("pos", "v")).withColumn("v", F.when(S.finite(F.col("v")), F.col("v")))
    median = v.groupBy("pos").agg(F.median("v").alias("m")).filter("m is not null")
    filled = v.join(F.broadcast(median), "pos").withColumn("v", F.coalesce("v", "m"))  # one row a dimension
    stats = filled.groupBy("pos").agg(F.first("m").alias("m"), F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    one = F.broadcast(stats.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "mu", "sd"))).alias("_s")))

    def value(s: Column) -> Column:
        x = F.get("features", s["pos"])
        x = F.when(S.finite(x), x).otherwise(s["m"])
        return (x - s["mu"]) / F.when(s["sd"] > 0, s["sd"]).otherwise(1.0)

    done = lambda df: df.crossJoin(one).withColumn("features", F.transform("_s", value)).drop("_s")
    return done(train), done(test)
