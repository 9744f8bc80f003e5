"""Written intermediate tables, which cut lineages and survive the loss of executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and the master is
    local, a temporary one. On a cluster without that setting this raises, as executors would not see a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{tempfile.gettempdir()}/tickloom-checkpoints"
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once below the shared folder and read it back: cuts the lineage, survives the loss of executors and
    pins down whatever depends on how the rows were dealt."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise wrote, once nothing that is still to be computed reads them, and let Spark drop shuffle files that no live
    plan refers to (it does so when the driver collects garbage)."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()
