"""Structured Streaming forms: in-situ steps as a file stream, field files as a
source and a sink, tumbling windows of outputs, decompositions that go on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators.rom import StreamingPod
from nodeloom.sources.fieldfile import FieldSteps, write_field


def steps(spark: SparkSession, path: str, schema: str, files_per_step: int = 1) -> DataFrame:
    """A stream of steps from a folder that a producer writes to."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).parquet(path)


def windowed(stream: DataFrame, time: str, late: str, width: str, key: str, value: str) -> DataFrame:
    """Count and sum per key and tumbling window; late data beyond the watermark is left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def drain(stream: DataFrame, out: str, log: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and writes it as Parquet."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def stream_pod(stream: DataFrame, state, row: str, column: str, log: str) -> None:
    """Feeds each micro-batch (row, column array of new snapshots) to a streaming POD state."""

    def feed(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            state.update(batch.select(row, column), column)

    stream.writeStream.foreachBatch(feed).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def fold(stream: DataFrame, out: str, log: str) -> None:
    """Runs an aggregating stream over all that is there; each micro-batch writes
    the groups that it changed, under its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number:09d}")

    stream.writeStream.outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def field_steps(spark: SparkSession, folder: str, keys: str = "") -> DataFrame:
    """A stream of the field files in a folder of steps: step, e, time and an array
    per variable. Offsets are step numbers, so a query that starts again asks for
    the steps that it has not seen."""
    spark.dataSource.register(FieldSteps)
    reader = spark.readStream.format("fieldsteps").option("path", folder)
    return (reader.option("keys", keys) if keys else reader).load()


def write_steps(stream: DataFrame, folder: str, shape: tuple[int, int, int], log: str) -> None:
    """Field files of a stream of step, e, time and arrays, a folder per step. A
    batch that is repeated writes its steps anew."""

    def write(batch: DataFrame, number: int) -> None:
        for r in batch.groupBy("step").agg(F.first("time").alias("time")).collect():  # the steps of a batch
            write_field(batch.where(F.col("step") == r["step"]).drop("step", "time"), f"{folder}/step{r['step']:05d}", shape, r["time"], r["step"])

    stream.writeStream.foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def kept_state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """sigma, vt, steps of the last batch (before a number) that a kept decomposition has written; None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName()[6:]) for f in (store.listStatus(path) if store.exists(path) else []) if f.getPath().getName().startswith("batch-") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "right/_SUCCESS"))]
    done = [n for n in done if before is None or n < before]
    return spark.read.parquet(f"{folder}/batch-{max(done):09d}/right").withColumn("batch", F.lit(max(done))) if done else None


def kept_pod(stream: DataFrame, column: str, width: int, folder: str, log: str, k: int) -> None:
    """Decomposes a stream of fields (step, e, column of width values). The state of
    a batch - modes per node, singular values, right vectors, the steps so far - is
    written under the batch's number, and made from the one before: neither the
    driver nor a batch that is repeated loses or doubles a step."""

    def feed(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        steps = [r["step"] for r in batch.select("step").distinct().orderBy("step").collect()]  # the steps of a batch
        if not steps:
            return
        nodes = batch.select("step", F.posexplode(column).alias("p", "v"), "e").select((F.col("e") * width + F.col("p")).alias("row"), "step", "v")
        rows = nodes.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "v"))), lambda x: x["v"]).alias("a"))
        state, last = StreamingPod("row", k), kept_state(spark, folder, number)
        seen: list[int] = []
        if last is not None:
            r = last.first()
            state.sigma, state.vt, seen = np.array(r["sigma"]), np.array(r["vt"]).reshape(len(r["sigma"]), -1), list(r["steps"])
            state.modes = spark.read.parquet(f"{folder}/batch-{r['batch']:09d}/modes")
        state.update(rows, "a")
        home = f"{folder}/batch-{number:09d}"
        state.modes.write.mode("overwrite").parquet(f"{home}/modes")
        found = [([float(x) for x in state.sigma], [float(x) for x in state.vt.ravel()], seen + steps)]
        spark.createDataFrame(found, "sigma array<double>, vt array<double>, steps array<bigint>").write.mode("overwrite").parquet(f"{home}/right")

    stream.writeStream.foreachBatch(feed).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
