"""What the corpus operators share: table reading, the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: inside a lambda a column expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a table of one small file is one task otherwise."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= n else df.repartition(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where a local session has none (tests) a temporary folder is made and set; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="counterpoise-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below this application's folder in the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    The lineage ends there: a lost executor costs no more than the tasks that read the table.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
