"""Decompositions along a homogeneous direction: each wavenumber has its own.

Lines are transformed inside their rows, without a shuffle. A row is then a
wavenumber, a place and the complex values of all snapshots there. Triangles are
reduced per wavenumber in a tree, all wavenumbers in one job: a task keeps one
triangle per wavenumber it meets, tasks meet by (wavenumber, branch), then by
wavenumber. Singular values and right vectors are a row per wavenumber; modes and
reconstructions are rotations of the rows, which stay where they are."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HELD = 64 << 20  #: bytes of triangles that a task keeps before it passes them on
SENT = 64 << 20  #: bytes of right vectors that are sent to every task; more join by wavenumber
BRANCHES = 32
ROWS = 50_000  #: rows of a wavenumber that meet its right vectors in one group
TRIANGLE = "key int, rows int, r binary"


def spectra(df: DataFrame, row: str, column: str, n: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """row, keep, kappa, re, im: the discrete Fourier transform over sqrt(n) of the
    lines in column (snapshots x n values, the homogeneous index fastest), for
    kappa 0 .. n // 2; re and im hold a value per snapshot."""

    @F.pandas_udf("array<struct<kappa:int,re:array<double>,im:array<double>>>")
    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            x = np.fft.rfft(np.asarray(v, float).reshape(-1, n), axis=1) / np.sqrt(n)
            out.append([{"kappa": k, "re": x[:, k].real, "im": x[:, k].imag} for k in range(x.shape[1])])
        return pd.Series(out, dtype=object)

    return df.select(row, *keep, F.explode(run(column)).alias("_s")).select(row, *keep, "_s.kappa", "_s.re", "_s.im")


def weights(mass: Column | None = None, least: float = 1e-12) -> Column:
    """Factor of a row of kappa: the root of its mass (a zero mass counts as least),
    times the root of two where a wavenumber stands for its mirror image too."""
    twin = F.when(F.col("kappa") == 0, 1.0).otherwise(float(np.sqrt(2.0)))
    return twin if mass is None else twin * F.sqrt(F.when(mass == 0, least).otherwise(mass))


def weighted(rows: DataFrame, weight: Column, divide: bool = False) -> DataFrame:
    w = rows.withColumn("_w", weight)
    for c in ("re", "im"):
        w = w.withColumn(c, F.transform(c, lambda v: v / F.col("_w") if divide else v * F.col("_w")))
    return w.drop("_w")


def _complex(re: pd.Series, im: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in re]) + 1j * np.stack([np.asarray(v, float) for v in im])


def _merge(held: np.ndarray | None, m: np.ndarray) -> np.ndarray:
    return np.linalg.qr(m if held is None else np.vstack([held, m]), mode="r")


def triangles(rows: DataFrame, branches: int = BRANCHES) -> DataFrame:
    """kappa's triangle of the QR decomposition of its rows: key, rows, r."""

    def frame(held: dict[int, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"key": list(held), "rows": [r.shape[0] for r in held.values()], "r": [np.ascontiguousarray(r).tobytes() for r in held.values()]})

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for key, at in b.groupby("kappa").indices.items():
                held[int(key)] = _merge(held.get(int(key)), _complex(b["re"].iloc[at], b["im"].iloc[at]))
            if sum(r.nbytes for r in held.values()) > HELD:
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    def stack(group: pd.DataFrame) -> pd.DataFrame:
        r = None
        for rows, data in zip(group["rows"], group["r"], strict=True):
            r = _merge(r, np.frombuffer(data, complex).reshape(rows, -1))
        return frame({int(group["key"].iloc[0]): r})

    out = rows.select("kappa", "re", "im").mapInPandas(first, TRIANGLE).withColumn("_branch", F.spark_partition_id() % branches)
    return out.groupBy("key", "_branch").applyInPandas(stack, TRIANGLE).groupBy("key").applyInPandas(stack, TRIANGLE)


def decompose(rows: DataFrame, k: int) -> DataFrame:
    """kappa, sigma (the k largest singular values) and the right vectors, re and
    im, one behind the other. rows: kappa, re, im. One job, whatever the number of
    wavenumbers; nothing comes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, rows, data in zip(b["key"], b["rows"], b["r"], strict=True):
                _, s, vt = np.linalg.svd(np.frombuffer(data, complex).reshape(rows, -1), full_matrices=False)
                out.append((key, s[:k], vt[:k].real.ravel(), vt[:k].imag.ravel()))
            yield pd.DataFrame(out, columns=["kappa", "sigma", "right_re", "right_im"])

    return triangles(rows).mapInPandas(run, "kappa int, sigma array<double>, right_re array<double>, right_im array<double>")


def _matrices(sigma, re, im) -> tuple[np.ndarray, np.ndarray]:
    s = np.asarray(sigma, float)
    return s, (np.asarray(re, float) + 1j * np.asarray(im, float)).reshape(len(s), -1)


def rotate(rows: DataFrame, right: DataFrame, matrix: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """rows with re and im times a matrix of the wavenumber's singular values and
    right vectors. These go to every task if they are few, by their size;
    otherwise parts of a wavenumber's rows meet them in groups."""
    names = rows.columns
    schema = rows.schema.simpleString()[len("struct<") : -1]

    def turned(b: pd.DataFrame, m: np.ndarray) -> pd.DataFrame:
        x = _complex(b["re"], b["im"]) @ m
        return b.assign(re=list(x.real), im=list(x.imag))[names]

    size = right.agg(F.sum(F.size("right_re").cast("long") * 16)).first()[0] or 0
    if size <= SENT:
        found = {int(r["kappa"]): _matrices(r["sigma"], r["right_re"], r["right_im"]) for r in right.collect()}  # SENT bytes at most
        held = rows.sparkSession.sparkContext.broadcast(found)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for key, at in b.groupby("kappa").indices.items():
                    if int(key) in held.value:
                        yield turned(b.iloc[at], matrix(*held.value[int(key)]))

        return rows.mapInPandas(run, schema)
    counts = rows.groupBy("kappa").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("_parts"))
    copies = right.join(counts, "kappa").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    dealt = rows.join(F.broadcast(counts), "kappa").withColumn("_part", F.pmod(F.xxhash64(*[c for c in names if c not in ("re", "im")]), F.col("_parts")).cast("int")).drop("_parts")

    def meet(b: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return turned(b, matrix(*_matrices(*r.iloc[0][["sigma", "right_re", "right_im"]]))) if len(b) and len(r) else b[names].iloc[:0]

    return dealt.groupBy("kappa", "_part").cogroup(copies.groupBy("kappa", "_part")).applyInPandas(meet, schema)


def modes(rows: DataFrame, right: DataFrame) -> DataFrame:
    """rows with the modes in re and im: A v / sigma. Of the rows that were
    decomposed these are the left vectors, of another field its extended modes.
    Modes without energy are zero."""
    return rotate(rows, right, lambda s, vt: (vt * np.where(s > 1e-12 * max(s.max(initial=0.0), 1e-300), 1 / np.where(s > 0, s, 1.0), 0.0)[:, None]).conj().T)


def rebuilt(found: DataFrame, right: DataFrame, kept: list[int] | None = None, snapshots: list[int] | None = None) -> DataFrame:
    """The spectra that modes make up: all of them, or those in kept; of all snapshots or some."""

    def matrix(s: np.ndarray, vt: np.ndarray) -> np.ndarray:
        use = np.zeros(len(s)) if kept is not None else np.ones(len(s))
        if kept is not None:
            use[[k for k in kept if k < len(s)]] = 1.0
        m = (s * use)[:, None] * vt
        return m if snapshots is None else m[:, snapshots]

    return rotate(found, right, matrix)


def physical(rows: DataFrame, row: str, n: int, out: str = "u") -> DataFrame:
    """row and out: the inverse transform of all wavenumbers of a row, values
    ordered like the lines of spectra. What is not there counts as zero."""

    @F.pandas_udf("array<double>")
    def run(spectrum: pd.Series) -> pd.Series:
        made = []
        for lines in spectrum:
            x = np.zeros((n // 2 + 1, len(lines[0]["re"])), complex)
            for s in lines:
                x[s["kappa"]] = np.asarray(s["re"], float) + 1j * np.asarray(s["im"], float)
            made.append((np.fft.irfft(x, n, axis=0) * np.sqrt(n)).T.ravel())
        return pd.Series(made, dtype=object)

    whole = rows.groupBy(row).agg(F.collect_list(F.struct("kappa", "re", "im")).alias("_lines"))
    return whole.select(row, run("_lines").alias(out))


def save(folder: str, found: DataFrame, right: DataFrame) -> None:
    """The state as tables: modes, a folder per wavenumber; right vectors with
    singular values; and the modes' schema, as there may be none."""
    spark = found.sparkSession
    spark.range(1).select(F.lit(found.schema.json()).alias("value")).write.mode("overwrite").text(f"{folder}/schema")
    found.write.mode("overwrite").partitionBy("kappa").parquet(f"{folder}/modes")
    right.write.mode("overwrite").parquet(f"{folder}/right")


def load(spark, folder: str, kappas: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(modes, right), of some wavenumbers only the folders of those."""
    schema = StructType.fromJson(json.loads(spark.read.text(f"{folder}/schema").first()["value"]))
    found, right = spark.read.schema(schema).parquet(f"{folder}/modes"), spark.read.parquet(f"{folder}/right")
    if kappas is not None:
        found, right = found.where(F.col("kappa").isin(kappas)), right.where(F.col("kappa").isin(kappas))
    return found, right
