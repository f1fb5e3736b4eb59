"""Modal truncation, Gaussian-process sampling, and payload codecs."""

from __future__ import annotations

import bz2
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def keep_largest(coefficients: str, keep: int) -> Column:
    """The keep coefficients of largest magnitude (ties: the first), others zero; no shuffle."""
    ranked = F.array_sort(F.transform(coefficients, lambda c, p: F.struct((-F.abs(c)).alias("m"), p.alias("p"))))
    places = F.transform(F.slice(ranked, 1, keep), lambda s: s["p"])
    return F.transform(coefficients, lambda c, p: F.when(F.array_contains(places, p), c).otherwise(0.0))


def pack(column: str) -> Column:
    """bzip2 of the values' bytes."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([bz2.compress(np.asarray(v, dtype="<f8").tobytes(), 9) for v in values])

    return run(column)


def unpack(column: str) -> Column:
    @F.pandas_udf("array<double>")
    def run(payload: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(bz2.decompress(p), dtype="<f8") for p in payload])

    return run(column)


def bitplanes(values: np.ndarray, bits: int) -> tuple[float, float, bytes]:
    """Quantised between min and max, one plane of bits after another."""
    lo, hi = float(values.min()), float(values.max())
    q = np.round((values - lo) / ((hi - lo) or 1.0) * (2**bits - 1)).astype(np.uint64)
    planes = [np.packbits(((q >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)) for b in range(bits)]
    return lo, hi, b"".join(p.tobytes() for p in planes)


def from_bitplanes(lo: float, hi: float, data: bytes, n: int, bits: int) -> np.ndarray:
    size = (n + 7) // 8
    q = sum((np.unpackbits(np.frombuffer(data[b * size : (b + 1) * size], np.uint8))[:n].astype(np.uint64) << np.uint64(b) for b in range(bits)), np.zeros(n, np.uint64))
    return lo + q.astype(float) / (2**bits - 1) * (hi - lo)


def write_samples(samples, folder: str, settings: dict) -> None:
    """Compressed samples (a table of payloads) with the settings that read them back."""
    samples.write.mode("overwrite").parquet(f"{folder}/samples")
    spark = samples.sparkSession
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "settings string").coalesce(1).write.mode("overwrite").json(f"{folder}/settings")


def read_samples(spark, folder: str) -> tuple:
    """(samples, settings)."""
    kept = spark.read.schema("settings string").json(f"{folder}/settings").first()["settings"]
    return spark.read.parquet(f"{folder}/samples"), json.loads(kept)


def average_spectrum(rows, group: Column, kind: str = "mean"):
    """Diagonal covariance of groups of elements: g, p, power. rows: p (the mode)
    and c (its coefficient in an element). kind: mean (the square of the mean
    coefficient) or variance (the sample variance of the coefficients)."""
    power = {"mean": F.avg("c") * F.avg("c"), "variance": F.var_samp("c")}[kind]
    return rows.groupBy(group.alias("g"), "p").agg(power.alias("power"))


def bitplane_payload(column: str, bits: int) -> Column:
    """struct of low, high and data: each array's values between their extremes, as planes of bits."""

    @F.pandas_udf("low double, high double, data binary")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = [bitplanes(np.asarray(v, float), bits) for v in values]
        return pd.DataFrame(rows, columns=["low", "high", "data"])

    return run(column)


def from_payload(low: str, high: str, data: str, n: int, bits: int) -> Column:
    @F.pandas_udf("array<double>")
    def run(lo: pd.Series, hi: pd.Series, payload: pd.Series) -> pd.Series:
        return pd.Series([from_bitplanes(a, b, d, n, bits) for a, b, d in zip(lo, hi, payload, strict=True)])

    return run(low, high, data)
