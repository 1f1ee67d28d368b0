"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of a local session without a setting.
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where everything runs in one process (a local master) a temporary folder takes the place of a missing setting;
    on a cluster executors would each write to their own disks, so there a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="orrery-"))
    return _LOCAL[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here.

    Every call takes a new table name, so a rerun never meets a half-written one.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        if path := getattr(table, "_written_to", None):
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
