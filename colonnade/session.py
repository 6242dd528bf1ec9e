"""Session helper and staging of intermediate tables on shared storage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: str = "*", app: str = "colonnade", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster pass the cluster's own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("COLONNADE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set on a local master (tests).

    On a cluster a folder of one machine is of no use to the others, so there the setting is needed."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(configured)
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/colonnade/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several branches read and read it back: the lineage ends in files that survive
    lost executors, and each branch prunes its own columns."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


ROWS_A_PART = 1_000_000
PART_BYTES = 4 << 20


def stage_counts(df: DataFrame, name: str, tables: list[DataFrame]) -> DataFrame:
    """`stage` for counts of all values of `tables`, with a shuffle partition for every `ROWS_A_PART` rows of the largest table, and partitions that Spark
    joins up to `PART_BYTES` only: ordered keys compress so well that 64 MB of them are more than 1 GB in the task that counts them. The
    memory of a task then follows these two and not the input."""
    conf = df.sparkSession.conf
    parts, joined = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {k: conf.get(k) for k in (parts, joined)}
    most = max((t.count() for t in tables), default=0)
    try:
        conf.set(parts, str(max(int(before[parts]), -(-most // ROWS_A_PART))))
        conf.set(joined, str(PART_BYTES))
        return stage(df, name)
    finally:
        for k, v in before.items():
            conf.set(k, v)


class Workspace:
    """Staged tables of one computation, in a folder of their own, that can be dropped as soon as nothing reads them any more.

    A table may go once everything made from it is itself written: lost executors then find all they need in later tables. Within
    ``with`` Spark also removes the shuffle files of every job that is over, and the session has the settings ``conf``."""

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str, conf: dict[str, str] | None = None):
        self.spark, self.root, self.paths, self.before = spark, new_path(spark, name), {}, {}
        self.conf = {self.CLEANUP: "true"} | (conf or {})

    def __enter__(self) -> Workspace:
        self.before = {k: self.spark.conf.get(k) for k in self.conf}
        for k, v in self.conf.items():
            self.spark.conf.set(k, v)
        return self

    def __exit__(self, *_: object) -> None:
        for k, v in self.before.items():
            self.spark.conf.set(k, v)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
