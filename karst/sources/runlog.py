"""The benchmark run log (JSON lines) and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "run_id string, dataset string, scenario string, metric string, n_jobs int, execution_mode string, n_samples long, n_features long, "
    "params struct<n_neighbors:int, hub_num:int, metric:string, init:string, global_n_epochs:int, local_n_epochs:int, execution_mode:string, n_jobs:int, random_state:int>, "
    "duration_sec double, success boolean, error string, embedding_path string, similarity_reference string"
)


def append(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are no runs."""
    return spark.read.schema(SCHEMA).json(path).where(F.col("run_id").isNotNull())


def markdown(rows: DataFrame) -> str:
    """A table of a few report rows."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(str, r)) + " |" for r in rows.collect()]) + "\n"
