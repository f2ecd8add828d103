"""Tables between steps, in a folder that the driver and all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir.

    Where none is set, a local master gets a temporary folder, removed at exit; on a cluster that is an
    error, as each machine would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="chunkloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        named = f"file://{made}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: cuts lineage and survives lost executors.

    The table stays until the folder is swept (swept); its path holds a fresh uuid, so runs never meet.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chunkloom-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession, least_age_s: float = 86_400) -> int:
    """Deletes the tables between steps that are at least that old, of finished runs and broken ones; how many folders went."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("chunkloom-") and s.getModificationTime() <= (time.time() - least_age_s) * 1000]
    for path in old:
        fs.delete(path, True)
    return len(old)
