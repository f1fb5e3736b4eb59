"""Averages of field files in a folder, over time and over batches of it, as field files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators.statistics import average_arrays, file_index, time_batches
from nodeloom.sources.fieldfile import index_steps, read_steps, write_field


def step_batches(spark: SparkSession, folder: str, length: float, start: float = 0.0) -> DataFrame:
    """step, time, dt and batch of the steps in a folder: a batch takes steps while
    their intervals add up to length, some more allowed. start: where the first
    interval begins."""
    index = file_index(index_steps(spark, folder).withColumn("series", F.lit("")), "series", ["step"], "time", F.lit(float(start)))
    return time_batches(index.select("series", "step", "time", "dt"), "series", ["step"], length).select("step", "time", "dt", "batch")


def average_files(spark: SparkSession, folder: str, keys: list[str], length: float, start: float = 0.0) -> DataFrame:
    """batch, e, keys and dt: means over time, weighted by each file's interval."""
    batches = step_batches(spark, folder, length, start).select("step", "batch", "dt")
    rows = read_steps(spark, folder, ",".join(keys)).join(F.broadcast(batches), "step")  # a row per file
    return average_arrays(rows, ["batch", "e"], keys, "dt")


def write_averages(means: DataFrame, folder: str, shape: tuple[int, int, int]) -> None:
    """A folder of field files per batch; the time in a header is the batch's length."""
    kept = means.checkpoint()
    for r in kept.groupBy("batch").agg(F.max("dt").alias("dt")).orderBy("batch").collect():  # a row per batch
        write_field(kept.where(F.col("batch") == r["batch"]).drop("batch", "dt"), f"{folder}/batch{r['batch']:05d}", shape, r["dt"], int(r["batch"]))
