"""Shared storage for intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a private folder where it is unset and all runs in one process (tests)."""
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="karst-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage of iterations, outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes what ``stored`` wrote for ``df``; to be called once nothing reads it any more, lazily or not."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
