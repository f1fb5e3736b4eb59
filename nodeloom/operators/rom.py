"""Proper orthogonal decomposition of snapshots, whole and streaming.

A tall matrix is a table of rows, each an array of its values in all snapshots
(complex matrices have a second array, the imaginary parts). Its singular value
decomposition goes through QR: each batch of rows is reduced to its triangle,
triangles are stacked and reduced again in groups, and only the last few come to
the driver. That keeps the digits that a Gram matrix would lose. Left vectors
stay distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 32  #: triangles that a task of the next step stacks; as many at most come to the driver


def gram_arrays(rows: DataFrame, snap: str, column: str) -> DataFrame:
    """(a, b, g): inner products of snapshots that are an array each, upper triangle."""
    x, y = (rows.select(F.col(snap).alias(s), F.col(column).alias(f"_{s}")) for s in "ab")
    products = F.zip_with("_a", "_b", lambda p, q: p * q)
    return x.join(y, F.col("a") <= F.col("b")).select("a", "b", F.aggregate(products, F.lit(0.0), lambda s, p: s + p).alias("g"))


def gram_matrix(blocks: DataFrame, column: str) -> np.ndarray:
    """A^T A of a tall matrix whose rows are arrays in column; partial products per batch, added up by Spark."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                m = np.stack(b[column].to_numpy())
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pd.DataFrame({"p": range(total.size), "v": total.ravel()})

    parts = blocks.select(column).mapInPandas(part, "p long, v double").groupBy("p").agg(F.sum("v").alias("v")).toPandas().sort_values("p")
    n = int(round(len(parts) ** 0.5))
    return parts["v"].to_numpy().reshape(n, n)


def _triangle(m: np.ndarray) -> np.ndarray:
    return np.linalg.qr(m, mode="r")


def triangle(blocks: DataFrame, column: str, imaginary: str | None = None) -> np.ndarray:
    """R of the QR decomposition of the matrix, at most snapshots by snapshots."""

    def stacked(b: pd.DataFrame) -> np.ndarray:
        m = np.stack([np.asarray(v, float) for v in b[column]])
        return m + 1j * np.stack([np.asarray(v, float) for v in b[imaginary]]) if imaginary else m

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for b in batches:
            if len(b):
                r = _triangle(stacked(b) if r is None else np.vstack([r, stacked(b)]))
        if r is not None:
            yield pd.DataFrame({"rows": [r.shape[0]], "r": [np.ascontiguousarray(r, dtype=complex if imaginary else float).tobytes()]})

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for b in batches:
            for rows, data in zip(b["rows"], b["r"], strict=True):
                m = np.frombuffer(data, complex if imaginary else float).reshape(rows, -1)
                r = m if r is None else _triangle(np.vstack([r, m]))
        if r is not None:
            yield pd.DataFrame({"rows": [r.shape[0]], "r": [np.ascontiguousarray(r).tobytes()]})

    schema = "rows long, r binary"
    parts = blocks.rdd.getNumPartitions()
    out = blocks.select(*[column, *([imaginary] if imaginary else [])]).mapInPandas(reduce, schema)
    while parts > FAN:
        parts = -(-parts // FAN)
        out = out.repartition(parts).mapInPandas(again, schema)
    found = out.collect()  # FAN triangles at most
    if not found:
        return np.zeros((0, 0))
    return _triangle(np.vstack([np.frombuffer(r["r"], complex if imaginary else float).reshape(r["rows"], -1) for r in found]))


def svd(blocks: DataFrame, column: str, k: int, imaginary: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values and the right vectors (k x snapshots)."""
    r = triangle(blocks, column, imaginary)
    if not r.size:
        return np.zeros(0), np.zeros((0, 0))
    _, sigma, vt = np.linalg.svd(r, full_matrices=False)
    return sigma[:k], vt[:k]


def pod(blocks: DataFrame, row: str, column: str, k: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Singular values, right vectors (k x snapshots) and the modes: a table (row, mode array of k)."""
    sigma, vt = svd(blocks, column, k)
    rotate = (vt / np.where(sigma > 1e-12, sigma, 1.0)[:, None]).T

    @F.pandas_udf("array<double>")
    def modes(a: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(a.to_numpy()) @ rotate)) if len(a) else pd.Series([], dtype=object)

    return sigma, vt, blocks.select(row, modes(column).alias("mode"))


def complex_pod(blocks: DataFrame, row: str, re: str, im: str, k: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """The same for a complex matrix: modes has the arrays re and im."""
    sigma, vt = svd(blocks, re, k, im)
    rotate = (vt / np.where(sigma > 1e-12, sigma, 1.0)[:, None]).conj().T

    @F.pandas_udf("struct<re:array<double>,im:array<double>>")
    def modes(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        u = (np.stack(a.to_numpy()) + 1j * np.stack(b.to_numpy())) @ rotate if len(a) else np.zeros((0, k))
        return pd.DataFrame({"re": list(u.real), "im": list(u.imag)})

    return sigma, vt, blocks.select(row, modes(re, im).alias("_m")).select(row, "_m.re", "_m.im")


def scaled(blocks: DataFrame, column: str, mass: str, divide: bool = False, least: float = 1e-12) -> DataFrame:
    """Rows times the square root of their mass (a zero mass counts as least), or divided by it."""
    root = F.sqrt(F.when(F.col(mass) == 0, F.lit(least)).otherwise(F.col(mass)))
    return blocks.withColumn(column, F.transform(column, lambda v: v / root if divide else v * root))


def weighted_pod(blocks: DataFrame, row: str, column: str, mass: str, k: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """POD in the mass inner product; the modes are those of physical space."""
    own = scaled(blocks.select(row, column, mass), column, mass)
    sigma, vt, modes = pod(own, row, column, k)
    back = scaled(modes.join(blocks.select(row, mass), row), "mode", mass, divide=True)
    return sigma, vt, back.select(row, "mode")


def reconstructed(modes: DataFrame, row: str, sigma: np.ndarray, vt: np.ndarray, out: str = "a") -> DataFrame:
    """row and the snapshots that the modes make up: sum of mode, singular value and right vector."""
    back = sigma[:, None] * vt

    @F.pandas_udf("array<double>")
    def run(m: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(m.to_numpy()) @ back)) if len(m) else pd.Series([], dtype=object)

    return modes.select(row, run("mode").alias(out))


def complex_reconstructed(modes: DataFrame, row: str, sigma: np.ndarray, vt: np.ndarray) -> DataFrame:
    """row, re, im: what the modes of a complex decomposition make up."""
    back = sigma[:, None] * vt

    @F.pandas_udf("struct<re:array<double>,im:array<double>>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        x = (np.stack(a.to_numpy()) + 1j * np.stack(b.to_numpy())) @ back if len(a) else np.zeros((0, back.shape[1]))
        return pd.DataFrame({"re": list(x.real), "im": list(x.imag)})

    return modes.select(row, run("re", "im").alias("_m")).select(row, "_m.re", "_m.im")


def extended(modes_of: DataFrame, row: str, column: str, sigma: np.ndarray, vt: np.ndarray) -> DataFrame:
    """Extended modes: what other fields (row, column) have in common with the
    right vectors of a decomposition, A v / sigma."""
    rotate = (vt / np.where(sigma > 1e-12, sigma, 1.0)[:, None]).conj().T.real

    @F.pandas_udf("array<double>")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(a.to_numpy()) @ rotate)) if len(a) else pd.Series([], dtype=object)

    return modes_of.select(row, run(column).alias("mode"))


def perp_ratio(rows: DataFrame, modes: str, vector: str) -> float:
    """|v - u u^T v| / |v| of a vector (a number per row) and orthonormal modes (an array per row)."""
    n = F.size(modes)
    dots = rows.select(F.posexplode(F.transform(modes, lambda m: m * F.col(vector))).alias("k", "d")).groupBy("k").agg(F.sum("d").alias("d")).orderBy("k").collect()
    lit = F.array(*[F.lit(float(r["d"])) for r in dots]) if dots else F.array().cast("array<double>")
    left = F.col(vector) - F.aggregate(F.zip_with(modes, lit, lambda m, d: m * d), F.lit(0.0), lambda s, x: s + x)
    up, down = rows.where(n > 0).agg(F.sum(left * left), F.sum(F.col(vector) * F.col(vector))).first()
    return float((up / down) ** 0.5) if down else 0.0


class StreamingPod:
    """Rank-k update by batches of snapshots: the SVD of [U S, new columns] is
    taken through its triangle; U is never collected."""

    def __init__(self, row: str, k: int):
        self.row, self.k, self.modes, self.sigma, self.vt = row, k, None, np.zeros(0), None

    def update(self, batch: DataFrame, column: str) -> "StreamingPod":
        """batch: row and an array of new snapshot values per row."""
        new = batch.select(self.row, F.col(column).alias("_new"))
        first = new.first()
        if first is None:  # no rows, no state
            return self
        width = len(first["_new"])
        if self.modes is None:
            both, before = new.select(self.row, F.col("_new").alias("_a")), 0
        else:
            scale = F.array(*[F.lit(float(s)) for s in self.sigma])
            old = self.modes.select(self.row, F.zip_with("mode", scale, lambda m, s: m * s).alias("_old"))
            both, before = old.join(new, self.row).select(self.row, F.concat("_old", "_new").alias("_a")), len(self.sigma)
        both = both.checkpoint()
        self.sigma, rotated, self.modes = pod(both, self.row, "_a", min(self.k, before + width))
        self.modes = self.modes.checkpoint()
        keep = np.zeros((before + width, (self.vt.shape[1] if self.vt is not None else 0) + width))
        if before:
            keep[:before, : self.vt.shape[1]] = self.vt
        keep[before:, keep.shape[1] - width :] = np.eye(width)
        self.vt = rotated @ keep
        return self

    def save(self, folder: str) -> None:
        """The state as tables: modes; singular values with their right vectors."""
        spark = self.modes.sparkSession
        self.modes.write.mode("overwrite").parquet(f"{folder}/modes")
        rows = [(k, float(s), [float(x) for x in v]) for k, (s, v) in enumerate(zip(self.sigma, self.vt, strict=True))]
        spark.createDataFrame(rows, "k int, sigma double, vt array<double>").write.mode("overwrite").parquet(f"{folder}/right")

    @classmethod
    def load(cls, spark, folder: str, row: str, k: int) -> "StreamingPod":
        out = cls(row, k)
        out.modes = spark.read.parquet(f"{folder}/modes")
        right = spark.read.parquet(f"{folder}/right").orderBy("k").collect()  # k rows
        out.sigma, out.vt = np.array([r["sigma"] for r in right]), np.array([r["vt"] for r in right])
        return out


def products(rows: DataFrame, left: str, right: str) -> np.ndarray:
    """sum over rows of left^T right, of two arrays per row: a small matrix; batches are added up before they are sent."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                m = np.stack(b[left].to_numpy()).T @ np.stack(b[right].to_numpy())
                total = m if total is None else total + m
        if total is not None:
            yield pd.DataFrame({"i": np.repeat(np.arange(total.shape[0]), total.shape[1]), "j": np.tile(np.arange(total.shape[1]), total.shape[0]), "v": total.ravel()})

    got = rows.select(left, right).mapInPandas(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((got["i"].max() + 1, got["j"].max() + 1)) if len(got) else np.zeros((0, 0))
    out[got["i"], got["j"]] = got["v"]
    return out


class GrowingPod(StreamingPod):
    """A streaming decomposition that takes as many modes as the snapshots ask for:
    it begins with least, and each snapshot whose part outside the modes so far is
    at least ratio of it adds one, up to most. ratios: what the tests found."""

    def __init__(self, row: str, most: int, least: int = 1, ratio: float = 0.99):
        super().__init__(row, least)
        self.most, self.ratio, self.ratios = most, ratio, []

    def update(self, batch: DataFrame, column: str) -> "GrowingPod":
        if self.modes is not None:
            met = self.modes.join(batch.select(self.row, F.col(column).alias("_new")), self.row)
            both = met.select(F.concat("mode", "_new").alias("_both"), "_new")
            p, k = products(both, "_both", "_new"), len(self.sigma)
            whole = np.diag(p[k:]) if len(p) else np.zeros(0)
            inside = (p[:k] ** 2).sum(axis=0) if len(p) else np.zeros(0)
            for own, part in zip(whole, inside, strict=True):
                out = float(np.sqrt(max(0.0, 1 - part / own))) if own > 0 else 0.0
                self.ratios.append(out)
                if out >= self.ratio and self.k < self.most:
                    self.k += 1
        super().update(batch, column)
        return self


class LocalPods:
    """Decompositions of blocks of rows, each with k modes of its own, that go on
    side by side and are merged at the end. Tables: modes (block, row, mode) and
    right (block, sigma, vt: the right vectors one behind the other)."""

    STATE = "block long, row long, mode array<double>, sigma array<double>, vt array<double>"

    def __init__(self, k: int):
        self.k, self.modes, self.right = k, None, None

    def update(self, batch: DataFrame, column: str) -> "LocalPods":
        """batch: block, row and an array of new snapshot values. A block is one group: it should fit a task."""
        k = self.k
        new = batch.select("block", "row", F.col(column).alias("new"))
        if self.modes is None:
            rows, right = new.withColumn("mode", F.array().cast("array<double>")), new.select("block").distinct().select("block", F.array().cast("array<double>").alias("sigma"), F.array().cast("array<double>").alias("vt"))
        else:
            rows, right = new.join(self.modes, ["block", "row"]), self.right

        def run(b: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if not len(b):
                return pd.DataFrame(columns=["block", "row", "mode", "sigma", "vt"])
            x = np.stack(b["new"].to_numpy()).astype(float)
            s = np.asarray(r["sigma"].iloc[0], float)
            before = np.asarray(r["vt"].iloc[0], float).reshape(len(s), -1) if len(s) else np.zeros((0, 0))
            u = np.stack(b["mode"].to_numpy()).astype(float) * s if len(s) else np.zeros((len(x), 0))
            left, sigma, turn = np.linalg.svd(np.hstack([u, x]), full_matrices=False)
            left, sigma, turn = left[:, :k], sigma[:k], turn[:k]
            vt = np.hstack([turn[:, : len(s)] @ before if len(s) else np.zeros((len(sigma), before.shape[1])), turn[:, len(s) :]])
            out = b[["block", "row"]].assign(mode=list(left), sigma=None, vt=None)
            return pd.concat([out, pd.DataFrame({"block": [b["block"].iloc[0]], "row": [None], "mode": [None], "sigma": [sigma], "vt": [vt.ravel()]})], ignore_index=True).astype({"row": "Int64"})

        state = rows.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(run, self.STATE).checkpoint()
        self.modes = state.where("sigma is null").select("block", "row", "mode")
        self.right = state.where("sigma is not null").select("block", "sigma", "vt")
        return self

    def merge(self, k: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
        """Singular values, right vectors and modes (row, mode) of all rows together.
        What a block hands over is its singular values times its right vectors, a
        row per mode; their triangles are stacked like those of any tall matrix."""

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [v for s, vt in zip(b["sigma"], b["vt"], strict=True) for v in np.asarray(s, float)[:, None] * np.asarray(vt, float).reshape(len(s), -1)]
                yield pd.DataFrame({"a": rows})

        sigma, vt = svd(self.right.mapInPandas(spread, "a array<double>"), "a", k)
        turn = vt.T / np.where(sigma > 1e-12, sigma, 1.0) if len(sigma) else np.zeros((0, 0))

        def rotation(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"block": b["block"], "turn": [(np.asarray(s, float)[:, None] * np.asarray(v, float).reshape(len(s), -1) @ turn).ravel() for s, v in zip(b["sigma"], b["vt"], strict=True)]})

        @F.pandas_udf("array<double>")
        def turned(mode: pd.Series, by: pd.Series) -> pd.Series:
            return pd.Series([np.asarray(m, float) @ np.asarray(t, float).reshape(len(m), -1) for m, t in zip(mode, by, strict=True)], dtype=object)

        met = self.modes.join(self.right.mapInPandas(rotation, "block long, turn array<double>"), "block")
        return sigma, vt, met.select("row", turned("mode", "turn").alias("mode"))


def line_dft(rows: DataFrame, keys: list[str], index: str, value: str, n: int) -> DataFrame:
    """Discrete Fourier transform of lines over sqrt(n): kappa 0 .. n//2, re, im; no Python."""
    wave = rows.withColumn("kappa", F.explode(F.array(*[F.lit(k) for k in range(n // 2 + 1)])))
    turn = F.col("kappa") * F.col(index) * F.lit(2 * np.pi / n)
    return wave.groupBy(*keys, "kappa").agg((F.sum(F.col(value) * F.cos(turn)) / F.lit(n**0.5)).alias("re"), (-F.sum(F.col(value) * F.sin(turn)) / F.lit(n**0.5)).alias("im"))


def analytic_signal(values: np.ndarray) -> np.ndarray:
    """Hilbert transform by FFT along the last axis. The signal goes on mirrored at
    its last value, which, like the first, is not repeated."""
    n = values.shape[-1]
    x = np.concatenate([values, values[..., n - 2 : 0 : -1]], axis=-1)
    m = x.shape[-1]
    h = np.zeros(m)
    h[0] = 1
    h[1 : (m + 1) // 2] = 2
    if m % 2 == 0:
        h[m // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=-1) * h, axis=-1)[..., :n]


def analytic(rows: DataFrame, row: str, column: str) -> DataFrame:
    """row, re, im: the analytic signals of arrays; those of one length in a batch together."""

    @F.pandas_udf("struct<re:array<double>,im:array<double>>")
    def run(u: pd.Series) -> pd.DataFrame:
        out: list = [None] * len(u)
        sizes = u.map(len)
        for size in sizes.unique():
            at = np.flatnonzero(sizes == size)
            for k, h in zip(at, analytic_signal(np.stack([np.asarray(v, float) for v in u.iloc[at]])), strict=True):
                out[k] = h
        return pd.DataFrame({"re": [h.real for h in out], "im": [h.imag for h in out]})

    return rows.select(row, run(column).alias("_h")).select(row, "_h.re", "_h.im")
