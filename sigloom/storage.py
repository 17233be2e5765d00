"""Tables written on the way: what is read more than once, or must outlive a lost executor, lies in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where none is set (local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    home = tempfile.mkdtemp(prefix="sigloom-")
    atexit.register(shutil.rmtree, home, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(home)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage like checkpoint(), survives lost executors, and leaves a plan whose later exchanges AQE may split
    when they are skewed (a checkpoint would keep the partitioning of the query that made it).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sigloom_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder where Spark keeps it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*made: DataFrame) -> None:
    """Delete tables made by materialize() that nothing needs any more."""
    for df in made:
        path = getattr(df, "_sigloom_path", None)
        if path:
            delete(df.sparkSession, path)
