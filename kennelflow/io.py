"""Reading the tables of a data directory and keeping intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "kennelflow-"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a session inside one process (tests) may leave it unset and gets a temporary one; on a cluster that raises.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix=PREFIX)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    It is computed once (``checkpoint()`` would compute it twice), and no later stage depends on the
    shuffle files of an executor that may be lost. ``release`` deletes it.
    """
    path = f"{shared_dir(df.sparkSession)}/{PREFIX}{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*kept: DataFrame | None) -> None:
    """Delete tables of ``cut_lineage`` that nothing reads any more."""
    for df in kept:
        if path := getattr(df, "_kept_at", None):
            delete_path(df.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete every table that ``cut_lineage`` left in the shared folder, once no result is read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(at) if fs.exists(at) else ():
        if f.getPath().getName().startswith(PREFIX):
            fs.delete(f.getPath(), True)


def latest_rows(df: DataFrame, key: str, version: str, cols: list[str]) -> DataFrame:
    """One row per ``key``: that with the greatest ``version`` (null is least), ties by the greater columns.

    Rows with a null key are left out. Aggregated with map-side combine, so repeats cost no exchange.
    """
    rest = [c for c in cols if c != key]
    kept = df.filter(F.col(key).isNotNull())
    return kept.groupBy(key).agg(F.max(F.struct(F.col(version).alias("_version"), *rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
