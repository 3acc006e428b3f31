"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on; everything else stays as the cluster set it."""
    # For times read with a zone; TIMESTAMP_NTZ columns do not depend on it.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Split a hot join key even where the split costs a further shuffle.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, else one on the default file system.

    A cluster whose default file system is each machine's own disk has no folder that
    all executors see; there the setting must be given.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    root = context._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    if root.startswith("file:") and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}{'//' if root == 'file:///' else ''}/tmp/gridmill-{context.applicationId}"


def work_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, never used twice."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a path and what is under it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def create_empty(spark: SparkSession, path: str) -> None:
    """Create an empty file, and the folders above it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, False).close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if there is no such folder."""
    if not path_exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return [f.getPath().getName() for f in found]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: survives lost executors."""
    path = work_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
