"""Session helpers shared by every module: the shared folder, staging tables, partition counts."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> SparkSession:
    """Python workers of this session find the package where the driver has it; a cluster needs it by --py-files."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's own sizing knob; every explicit exchange uses it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local master may do without the setting: it then gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def workspace(spark: SparkSession) -> str:
    """The one folder of this application below the shared folder that all its staged tables and files go to."""
    return f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}"


def cleaned(spark: SparkSession) -> None:
    """Delete the workspace: for when all results have been written elsewhere or collected."""
    dropped(spark, workspace(spark))


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the workspace."""
    return f"{workspace(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str, codec: str = "snappy", rows: int = 0) -> tuple[DataFrame, str]:
    """Write df to a table in the workspace and read it back: cuts lineage, survives lost executors.

    With rows no file has more: readers hold up to 4,096 rows of a file at once, too many where rows are large.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", codec).option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def located(spark: SparkSession, path: str) -> tuple[object, object]:
    """The Hadoop file system of a path, and the path as it knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = located(spark, path)
    return system.exists(at)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later plan reads; one that is gone already is no fault."""
    system, at = located(spark, path)
    system.delete(at, True)
