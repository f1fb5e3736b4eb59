"""Sending rows to numbered destinations: what a message router does between
processes are partitions and broadcasts here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_to_all(rows: DataFrame, destination: Column, parts: int) -> DataFrame:
    """Rows with destination, those of one destination in one partition."""
    return rows.withColumn("destination", destination).repartition(parts, "destination")


def scatter(rows: DataFrame, order: str, counts: list[int]) -> DataFrame:
    """destination by the order: the first counts[0] rows to 0, the next to 1, and
    so on. order numbers the rows from 0."""
    out, upto = F.lit(None).cast("int"), 0
    for k, n in enumerate(counts):
        out = F.when((F.col(order) >= upto) & (F.col(order) < upto + n), k).otherwise(out)
        upto += n
    return rows.withColumn("destination", out)


def exclusive_offsets(rows: DataFrame, rank: str) -> DataFrame:
    """rank, n and offset: how many rows the ranks before have. One row per rank."""
    from pyspark.sql import Window as W

    counts = rows.groupBy(rank).agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy(rank).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def all_gather(rows: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """A small table for every task; larger ones are an error, not a broadcast."""
    if rows.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    return F.broadcast(rows)
