"""Session builder and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "emberline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and skew handling on; `conf` keys use `_` for `.`."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is the one the cluster names in spark.checkpoint.dir. Where that is unset and the master is
    local, a folder of this machine serves; on a cluster an unset folder is an error, as a
    machine-local one would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark.sparkContext, "_emberline_dir", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="emberline-")
        spark.sparkContext._emberline_dir = made
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no one has used; release() removes it."""
    path = os.path.join(shared_dir(spark), f"emberline-{name}-{uuid.uuid4().hex}")
    written(spark).append(path)
    return path


def written(spark: SparkSession) -> list[str]:
    """The folders that this session wrote to the shared folder."""
    sc = spark.sparkContext
    if not hasattr(sc, "_emberline_written"):
        sc._emberline_written = []
    return sc._emberline_written


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the folders written by this session (from the number `since` on); results that read them must be used up."""
    paths = written(spark)
    for path in paths[since:]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del paths[since:]


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The same rows, written as parquet to the shared folder and read again (columnar, compressed)."""
    path = path or new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: a table in the shared folder.

    A checkpoint would keep the size estimate of the plan that it cuts, which a loop of joins multiplies in every round
    until no size-based choice is right any more; a table read again is estimated by its files.
    """
    return staged(df, "cut")
