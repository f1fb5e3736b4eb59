"""Reading and writing tables of fields by the kind of their files, and columns
that are added by name from memory or from a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.sources import container, fieldfile

NAMES = "__names"


def kind_of(path: str) -> str:
    """field, csv, json, parquet or container (a dataset per column), by the name's ending."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    ending = name.rsplit(".", 1)[-1] if "." in name else ""
    if ending in ("csv", "json", "parquet"):
        return ending
    if ending in ("hdf5", "h5", "vtkhdf", "container"):
        return "container"
    return "field" if ending == "fld" or (ending[:1] == "f" and ending[1:].isdigit()) else "parquet"


def read_data(spark: SparkSession, path: str, keys: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """The wanted columns (all without keys) of a file of fields; e stays beside them."""
    kind = kind or kind_of(path)
    if kind == "field":
        return fieldfile.read_field(spark, path, ",".join(keys or []))
    if kind == "container":
        names = keys or [r["name"] for r in spark.read.parquet(f"{path}/{NAMES}").orderBy("place").collect()]  # a row per column
        parts = [container.read_dataset(spark, path, c).withColumnsRenamed({"row": "e", "v": c}) for c in names]
        return reduce(lambda a, b: a.join(b, "e"), parts)
    df = spark.read.option("header", True).option("inferSchema", True).csv(path) if kind == "csv" else getattr(spark.read, kind)(path)
    return df.select(*[c for c in ("e",) if c in df.columns], *keys) if keys else df


def write_data(df: DataFrame, path: str, kind: str | None = None, mode: str = "errorifexists", shape: tuple[int, int, int] | None = None, **more) -> None:
    """A table of fields as files of a kind; field files need the shape of an element."""
    kind = kind or kind_of(path)
    if kind == "field":
        fieldfile.write_field(df, path, shape, **more)
        return
    if kind == "container":
        names, n = [c for c in df.columns if c != "e"], df.count()
        df.sparkSession.createDataFrame(list(enumerate(names)), "place int, name string").coalesce(1).write.mode(mode).parquet(f"{path}/{NAMES}")
        for c in names:
            container.write_dataset(df.select(F.col("e").alias("row"), F.col(c).alias("v")), path, c, [n, *(shape or ())], mode=mode)
        return
    rows = df.write.mode(mode)
    rows.option("header", True).csv(path) if kind == "csv" else getattr(rows, kind)(path)


def add_field(df: DataFrame, name: str, field: Column | DataFrame | str, key: str = "", kind: str | None = None, dtype: str = "") -> DataFrame:
    """df with a column name: an expression, the column key of another table with
    e, or of a file. An existing one is replaced. dtype: what its values become."""
    base = df.drop(name)
    if isinstance(field, Column):
        out = df.withColumn(name, field)
    else:
        other = field if isinstance(field, DataFrame) else read_data(df.sparkSession, field, [key], kind)
        out = base.join(other.select("e", F.col(key or name).alias(name)), "e", "left")
    return out.withColumn(name, F.col(name).cast(dtype)) if dtype else out


def rename_field(df: DataFrame, old: str, new: str) -> DataFrame:
    if new in df.columns:
        raise ValueError(f"{new} is there already")
    return df.withColumnRenamed(old, new)
