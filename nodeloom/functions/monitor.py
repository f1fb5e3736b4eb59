"""Timers, memory of the driver, and guards, for drivers that run the engine."""

from __future__ import annotations

import logging
import resource
import time

from pyspark.sql import DataFrame, SparkSession


class Logger:
    """Messages with a module's name, and timers that nest."""

    def __init__(self, module: str, level: int = logging.INFO):
        self.log, self.started = logging.getLogger(f"nodeloom.{module}"), []
        self.log.setLevel(level)

    def write(self, level: str, message: str) -> None:
        self.log.log(getattr(logging, level.upper()), message)

    def tic(self) -> None:
        self.started.append(time.perf_counter())

    def toc(self, message: str = "") -> float:
        took = time.perf_counter() - self.started.pop()
        self.log.info("%s%.3f s", f"{message}: " if message else "", took)
        return took


class MemoryMonitor:
    """Peak and current memory of the driver's Python, and what tables are estimated to hold."""

    def __init__(self):
        self.seen: dict[str, float] = {}

    def system_mb(self, name: str = "") -> float:
        now = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
        if name:
            self.seen[name] = now
        return now

    def table_mb(self, df: DataFrame, name: str = "") -> float:
        """The optimiser's estimate of a table's size; nothing is run."""
        size = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 2**20
        if name:
            self.seen[name] = size
        return size


def may_write(spark: SparkSession, path: str, overwrite: bool) -> str:
    """The write mode for a path; an existing one is an error unless overwrite."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) and not overwrite:
        raise FileExistsError(path)
    return "overwrite" if overwrite else "errorifexists"
