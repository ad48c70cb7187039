"""Where intermediate tables live.

Lineage is cut by writing a table into the folder that the cluster names in
``spark.checkpoint.dir`` (shared by all executors, so a lost executor costs
nothing).  Only where that setting is absent, as in local tests, a temporary
folder of this machine is set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = _local_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _local_root(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="skein-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/skein-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and read it back: later steps start from the files."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of an iterative operator; a round's files go once the next but one is written."""

    def __init__(self, spark: SparkSession, label: str, keep: int = 2):
        self.spark, self.label, self.keep, self.paths = spark, label, keep, []

    def cut(self, df: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, self.label)
        df.write.parquet(path)
        self.paths.append(path)
        while len(self.paths) > self.keep:
            delete_path(self.spark, self.paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file_system(spark, path)
    return fs.exists(p)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before costly work per row, where a scan gives fewer tasks than there are cores.

    A large input has more tasks than cores and is left as it is, so nothing is
    shuffled at scale; an input that has been shuffled already is left, too.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
