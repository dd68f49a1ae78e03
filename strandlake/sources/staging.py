"""Tables written to the folder that the driver and all executors share, and read back.

This cuts the lineage: rows and generated ids stay the same when executors are lost, and
what follows several times is computed once.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has staged tables in.
STAGED: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where it names none, one is made on a single machine; on a cluster that is an error,
    since executors would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="strandlake-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        named = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing is at; clear_staged removes what is written there."""
    path = f"{shared_folder(spark)}/strandlake-{label}-{uuid.uuid4().hex}"
    STAGED.append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back. The files stay until clear_staged."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> int:
    """Delete what this process has staged; for when all results that read it are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths, STAGED[:] = [*STAGED], []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)
