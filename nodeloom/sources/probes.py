"""Where probe results go: coordinates, one block of values per time, and a
report of the probes that were not found; and the values of a sequence of fields
at probes that are located once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.statistics import evaluate


def write_coordinates(located: DataFrame, folder: str, form: str = "csv") -> None:
    """probe_id, x, y, z under coordinates; form: csv or parquet."""
    rows = located.select("probe_id", "x", "y", "z").write.mode("overwrite")
    rows.option("header", True).csv(f"{folder}/coordinates") if form == "csv" else rows.parquet(f"{folder}/coordinates")


def write_values(values: DataFrame, folder: str, form: str = "csv", mode: str = "append") -> None:
    """values: time, probe_id and a column per field; each call adds its times, a folder each."""
    rows = values.write.mode(mode).partitionBy("time")
    rows.option("header", True).csv(f"{folder}/values") if form == "csv" else rows.parquet(f"{folder}/values")


def write_warnings(located: DataFrame, folder: str) -> None:
    """The probes without an inside element, as JSON lines: id, place, code and remaining error."""
    located.where("err_code <> 1").select("probe_id", "x", "y", "z", "err_code", "test_error").write.mode("overwrite").json(f"{folder}/warnings")


def read_values(spark, folder: str, schema: str, form: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(f"{folder}/values") if form == "csv" else reader.parquet(f"{folder}/values")


def interpolate_sequence(located: DataFrame, steps: DataFrame, field: str, n: int) -> DataFrame:
    """probe_id, time, value. steps: time, e and the field's array per element.
    Probes are located once; each joins its element's arrays of all times. 0
    where a probe was not found."""
    times = steps.select("time").distinct()
    asked = located.select("probe_id", "e", "r", "s", "t").crossJoin(F.broadcast(times))  # a few times
    own = steps.select(F.col("e").alias("_e"), F.col("time").alias("_time"), F.col(field).alias("_u"))
    met = asked.join(own, (F.col("e") == F.col("_e")) & (F.col("time") == F.col("_time")), "left")
    return evaluate(met.drop("_e", "_time"), None, "_u", n).select("probe_id", "time", "value")
