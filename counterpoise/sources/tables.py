"""Sources and sinks: manifests, CSV and Parquet datasets, result and summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import frames

MANIFEST = (
    "datasets array<struct<class_counts:map<string,bigint>,file:string,metadata:struct<feature_count:int,sample_count:int,openml_id:int,openml_name:string,target:string,"
    "keel_url:string,one_vs_rest_positive_class:string,keel_columns:array<string>,original_classes:array<string>,original_counts:map<string,bigint>>,"
    "n_features:int,n_samples:int,name:string,positive_class:string,sha256:string,source:string>>, description string, suite string"
)
RANKS = "code string, label string, mean_pr_auc double, avg_rank double"
PAIRS = "code string, label string, mean_delta double, median_delta double, wins int, ties int, losses int, p double, holm_p double"


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each dataset that the manifest lists."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).select("suite", F.explode("datasets").alias("d")).select("suite", "d.*")


def resolve(names: list[str], known: list[str], groups: tuple[str, ...] = ("all", "paper", "suite")) -> list[str]:
    """Names with group names expanded, the first of repeated ones kept."""
    out = [x for n in names for x in (known if n.strip().lower() in groups else [n.strip()])]
    return list(dict.fromkeys(out))


def as_dataset(df: DataFrame, target: str | None, name: str, source: str) -> frames.Dataset:
    """Encode a raw table: the target (default: last column) becomes y by ``frames.positive_class``, the rest features."""
    target = target or df.columns[-1]
    if target not in df.columns:
        raise ValueError(f"no column {target!r} in {name}")
    df = df.filter(F.col(target).isNotNull())
    k = df.select(target).distinct().count()
    if k < 2:
        raise ValueError(f"{name}: the target has fewer than two classes")
    positive = frames.positive_class(df, target).first()["label"]
    columns = [c for c in df.columns if c != target]
    coded, kept = frames.encode(df.withColumn("_y", (F.col(target) == F.lit(positive)).cast("int")), columns)
    coded = frames.dense_index(coded.withColumn("_o", F.monotonically_increasing_id()), "_o", "row_id")
    out = coded.select("row_id", F.array(*[F.col(c) for c in kept]).alias("features"), F.col("_y").alias("y"))
    return frames.Dataset(out, name, source, {"target": target, "positive_class": str(positive), "columns": kept})


def load_csv(spark: SparkSession, path: str, target: str | None = None, name: str | None = None) -> frames.Dataset:
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return as_dataset(df, target, name or path.rstrip("/").rpartition("/")[2].rpartition(".")[0], "csv")


def catalogue(spark: SparkSession, data_dir: str) -> list[str]:
    """The names of the Parquet datasets in a folder of any store that Spark reads; none if there is no such folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(data_dir)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        return []
    return sorted(x.getPath().getName().removesuffix(".parquet") for x in store.listStatus(at) if x.getPath().getName().endswith(".parquet"))


def load_dataset(spark: SparkSession, name_or_path: str, target: str | None = None, data_dir: str = "data") -> frames.Dataset:
    """A .csv path, a .parquet path, or the name of a Parquet dataset (row_id, features, y) below ``data_dir``."""
    if name_or_path.endswith(".csv"):
        return load_csv(spark, name_or_path, target)
    if not name_or_path.endswith(".parquet") and name_or_path not in (known := catalogue(spark, data_dir)):
        raise KeyError(f"unknown dataset {name_or_path!r}; {data_dir} has: {', '.join(known) or 'none'}")
    path = name_or_path if name_or_path.endswith(".parquet") else f"{data_dir}/{name_or_path}.parquet"
    df = spark.read.parquet(path)
    name = path.rpartition("/")[2].removesuffix(".parquet")
    if {"row_id", "features", "y"} <= set(df.columns):
        return frames.Dataset(df.select("row_id", "features", "y"), name, "parquet")
    return as_dataset(df, target, name, "parquet")


def load_datasets(spark: SparkSession, names: list[str], target: str | None = None, data_dir: str = "data") -> list[frames.Dataset]:
    """The datasets of names, paths and group names (all of ``data_dir``), each once, in the order of first mention."""
    return [load_dataset(spark, x, target, data_dir) for x in resolve(names, catalogue(spark, data_dir))]


def write_results(df: DataFrame, output: str, form: str = "csv") -> str:
    """Write a result table; as CSV with a header by default."""
    df.write.mode("overwrite").option("header", True).format(form).save(output)
    return output


def load_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All CSV files below ``path`` as one table; an empty folder is an error of the reader."""
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def load_ranks(spark: SparkSession, path: str) -> DataFrame:
    return load_results(spark, path, RANKS)


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    return load_results(spark, path, PAIRS)
