"""Containers of named datasets, groups and meshes as folders of Parquet tables.

A dataset is a table with the place of each row on its distributed axis (row)
and its values; the logical shape lies beside it. A mesh file has its points and
point data; later files may point to the mesh of another."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPE = "__shape"


def _path(root: str, group: str, name: str) -> str:
    return "/".join(x.strip("/") if k else x.rstrip("/") for k, x in enumerate([root, group, name]) if x)


def write_dataset(df: DataFrame, root: str, name: str, shape: list[int], group: str = "", mode: str = "errorifexists") -> None:
    """df: row (place on the first axis) and v (the values of the other axes, flat)."""
    path = _path(root, group, name)
    df.select(F.col("row").cast("long").alias("row"), F.col("v").cast("array<double>").alias("v")).write.mode(mode).parquet(path)
    spark = df.sparkSession
    spark.createDataFrame([([int(s) for s in shape],)], "shape array<long>").coalesce(1).write.mode(mode).parquet(path + SHAPE)


def read_shape(spark: SparkSession, root: str, name: str, group: str = "") -> list[int]:
    return list(spark.read.parquet(_path(root, group, name) + SHAPE).first()["shape"])


def read_dataset(spark: SparkSession, root: str, name: str, group: str = "", first: tuple[int, int] | None = None, rest: list[tuple[int, int]] | None = None) -> DataFrame:
    """row, v. first: range [from, to) of the distributed axis, which reaches the
    scan; rest: ranges of the other axes, cut out of each row."""
    df = spark.read.parquet(_path(root, group, name))
    if first:
        df = df.where((F.col("row") >= first[0]) & (F.col("row") < first[1]))
    if rest:
        keep = _places(read_shape(spark, root, name, group)[1:], rest)
        df = df.withColumn("v", F.array(*[F.col("v")[k] for k in keep]))
    return df


SLICES = "__slices"


def _places(inner: list[int], rest: list[tuple[int, int]] | None) -> list[int]:
    """Flat places of a region of the other axes."""
    keep = [0]
    for size, (low, high) in zip(inner, rest or [(0, s) for s in inner], strict=True):
        keep = [k * size + x for k in keep for x in range(low, high)]
    return keep


def create_dataset(spark: SparkSession, root: str, name: str, shape: list[int], group: str = "", mode: str = "errorifexists") -> None:
    """A dataset of zeros, which slices fill."""
    path = _path(root, group, name)
    spark.createDataFrame([], "row long, v array<double>").write.mode(mode).parquet(path)
    spark.createDataFrame([([int(s) for s in shape],)], "shape array<long>").coalesce(1).write.mode(mode).parquet(path + SHAPE)


def write_slices(df: DataFrame, root: str, name: str, group: str = "", rest: list[tuple[int, int]] | None = None, layer: int = 0) -> None:
    """df: row and v, the values of the region rest of the other axes (flat) at each
    row. Any number of writers may add slices; where they meet, the higher layer,
    then the one that was written later, stays."""
    spark, path = df.sparkSession, _path(root, group, name)
    places = _places(read_shape(spark, root, name, group)[1:], rest)
    written = df.select(F.col("row").cast("long").alias("row"), F.lit(layer).alias("layer"), F.current_timestamp().alias("at"), F.lit(places).cast("array<int>").alias("place"), F.col("v").cast("array<double>").alias("v"))
    written.write.mode("append").parquet(path + SLICES)


def read_filled(spark: SparkSession, root: str, name: str, group: str = "", first: tuple[int, int] | None = None) -> DataFrame:
    """row, v of a dataset with its slices put in; places that none filled are zero. Rows without values are left out."""
    width = int(np.prod(read_shape(spark, root, name, group)[1:]))
    base = spark.read.parquet(_path(root, group, name)).select("row", F.lit(-1).alias("layer"), F.lit(0).cast("timestamp").alias("at"), F.lit(list(range(width))).cast("array<int>").alias("place"), "v")
    rows = base.unionByName(spark.read.schema(base.schema).parquet(_path(root, group, name) + SLICES))
    if first:
        rows = rows.where((F.col("row") >= first[0]) & (F.col("row") < first[1]))

    @F.pandas_udf("array<double>")
    def put(slices: pd.Series) -> pd.Series:
        out = []
        for s in slices:
            v = np.zeros(width)
            for x in s:
                v[x["place"]] = x["v"]
            out.append(v)
        return pd.Series(out, dtype=object)

    return rows.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("layer", "at", "place", "v"))).alias("s")).select("row", put("s").alias("v"))


def merged_axes(shape: list[int], flat: list[int]) -> list[tuple[int, int]] | None:
    """Which axes of a logical shape each axis of a flatter one holds: ranges, or None if they don't fit."""
    out, k = [], 0
    for size in flat:
        start, product = k, 1
        while k < len(shape) and (product < size or start == k):
            product *= shape[k]
            k += 1
        if product != size:
            return None
        out.append((start, k))
    return out if k == len(shape) else None


def write_mesh(points: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """points: e, p, x, y, z."""
    points.select("e", "p", "x", "y", "z").write.mode(mode).parquet(_path(root, "mesh", "points"))


def link_mesh(spark: SparkSession, root: str, mesh_of: str, mode: str = "errorifexists") -> None:
    """root has no points of its own: they are those of mesh_of."""
    spark.createDataFrame([(mesh_of,)], "root string").coalesce(1).write.mode(mode).parquet(_path(root, "mesh", "link"))


def write_point_data(data: DataFrame, root: str, name: str, mode: str = "errorifexists") -> None:
    """data: e, p, value."""
    data.select("e", "p", F.col("value").cast("double").alias("value")).write.mode(mode).parquet(_path(root, "point_data", name))


def read_mesh(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.parquet(_path(root, "mesh", "points"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return read_mesh(spark, spark.read.parquet(_path(root, "mesh", "link")).first()["root"])


def read_point_data(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """e, p, x, y, z and a column per dataset."""
    parts = [spark.read.parquet(_path(root, "point_data", n)).withColumnRenamed("value", n) for n in names]
    return reduce(lambda a, b: a.join(b, ["e", "p"]), parts, read_mesh(spark, root))


def write_cells(cells: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """cells: e, cell, ids (the numbers of its corners)."""
    cells.select("e", "cell", F.col("ids").cast("array<long>").alias("ids")).write.mode(mode).parquet(_path(root, "mesh", "cells"))


def read_cells(spark: SparkSession, root: str) -> DataFrame:
    """Cells of a mesh file, or of the one that it points to."""
    try:
        return spark.read.parquet(_path(root, "mesh", "cells"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return read_cells(spark, spark.read.parquet(_path(root, "mesh", "link")).first()["root"])
