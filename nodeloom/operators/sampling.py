"""Gaussian-process sampling of elements: covariances in a basis, greedy choice of
nodes, posterior mean and deviation.

A covariance is the power of each coefficient: of the element itself (all of its
coefficients, the largest, those that matter most to the error or to the
likelihood, or what planes of bits keep of them), or of a group of elements (the
square of the mean coefficient, or the variance). Whole batches of elements are
sampled together by a Cholesky decomposition that grows by a row per node: the
covariance of a node with all others is one pass through the tensor basis, so no
element has a dense matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.spectral import gll, modal
from nodeloom.operators.compression import average_spectrum, bitplanes, from_bitplanes
from nodeloom.operators.elements import in_pieces

ELEMENTS = 256  #: elements that are sampled together


class TensorBasis:
    """Products of a one-dimensional basis along three axes: m (nodes x modes)."""

    def __init__(self, m: np.ndarray):
        self.m, self.n = m, len(m)

    def apply(self, x: np.ndarray, m: np.ndarray | None = None) -> np.ndarray:
        n, y = self.n, x.reshape(-1, self.n, self.n, self.n)
        for axis in (3, 2, 1):
            y = np.moveaxis(np.tensordot(y, self.m if m is None else m, axes=([axis], [1])), -1, axis)
        return y.reshape(len(x), n**3)

    def back(self, x: np.ndarray) -> np.ndarray:
        return self.apply(x, self.m.T)

    def squares(self, power: np.ndarray) -> np.ndarray:
        return self.apply(power, self.m * self.m)

    def rows(self, node: np.ndarray) -> np.ndarray:
        k, j, i = node // self.n**2, node // self.n % self.n, node % self.n
        return np.einsum("ea,eb,ec->eabc", self.m[k], self.m[j], self.m[i]).reshape(len(node), -1)


class DenseBasis:
    """Any basis that all elements share: m (nodes x modes)."""

    def __init__(self, m: np.ndarray):
        self.m = m

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x @ self.m.T

    def back(self, x: np.ndarray) -> np.ndarray:
        return x @ self.m

    def squares(self, power: np.ndarray) -> np.ndarray:
        return power @ (self.m * self.m).T

    def rows(self, node: np.ndarray) -> np.ndarray:
        return self.m[node]


def sample(basis, power: np.ndarray, values: np.ndarray | None, samples: int, given: np.ndarray | None = None, given_values: np.ndarray | None = None, noise: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, mean, deviation) of elements. power: elements x modes. Nodes of the
    largest posterior deviation are taken one after the other (ties: the lowest
    number), or those that are given, with their values. noise: share of the mean
    variance, at each node taken."""
    variance = basis.squares(power)
    count, n = variance.shape
    each, eps = np.arange(count), noise * np.maximum(1e-300, variance.mean(axis=1))
    rows, z, mean = np.zeros((count, samples, n)), np.zeros((count, samples)), np.zeros((count, n))
    taken, free = np.zeros((count, samples), np.int64), np.ones((count, n), bool)
    for s in range(samples):
        c = given[:, s] if given is not None else np.argmax(np.where(free, variance, -1.0), axis=1)
        y = given_values[:, s] if given_values is not None else values[each, c]
        before = rows[each, :s, c]
        column = basis.apply(power * basis.rows(c)) - np.einsum("es,esn->en", before, rows[:, :s])
        pivot = np.sqrt(np.maximum(column[each, c], 0.0) + eps)
        rows[:, s] = column / pivot[:, None]
        z[:, s] = (y - np.einsum("es,es->e", before, z[:, :s])) / pivot
        mean += rows[:, s] * z[:, s : s + 1]
        variance = variance - rows[:, s] ** 2
        taken[:, s], free[each, c] = c, False
    return taken, mean, np.sqrt(np.abs(variance))


def keep(coefficients: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """The coefficients of the largest scores (ties: the first), others zero."""
    order = np.argsort(-np.abs(score), axis=1, kind="stable")[:, :most]
    out = np.zeros_like(coefficients)
    np.put_along_axis(out, order, np.take_along_axis(coefficients, order, axis=1), axis=1)
    return out


def error_gradient(basis, values: np.ndarray, mass: np.ndarray, step: float = 0.01) -> np.ndarray:
    """How the root mean square error (by mass) of values that come from raised
    coefficients changes with each of them: all are raised by the share step."""
    rms = np.sqrt((values**2 * mass).sum(axis=1) / mass.sum(axis=1))
    up = basis.back(values * mass) / mass.sum(axis=1)[:, None]
    return np.where(rms[:, None] > 0, up / np.where(rms > 0, rms, 1.0)[:, None], 0.0) * np.sign(step)


def likelihood_gradient(basis, values: np.ndarray, coefficients: np.ndarray, noise: float = 1e-10, share: float = 0.1) -> np.ndarray:
    """How the negative log likelihood of all values but the last changes with each
    coefficient, where the covariance is that of the coefficients with each other.
    They are bent by share times the hyperbolic tangent of their place between the
    least and the largest, so that the covariance is not exactly the values' own.
    The covariance has rank one, so its inverse and determinant are closed forms."""
    low, high = coefficients.min(axis=1, keepdims=True), coefficients.max(axis=1, keepdims=True)
    width = np.where(high > low, high - low, 1.0)
    place = np.tanh(2 * (coefficients - low) / width - 1)
    u = basis.apply(coefficients * (1 + share * place))
    u[:, -1] = 0.0  # the last value is not told
    y = values.copy()
    y[:, -1] = 0.0
    uu, uy = (u * u).sum(axis=1, keepdims=True), (u * y).sum(axis=1, keepdims=True)
    alpha = (y - u * uy / (noise + uu)) / noise
    slope = -alpha * (alpha * u).sum(axis=1, keepdims=True) + 2 * u / (noise + uu)
    return basis.back(slope) * coefficients * share * (1 - place**2) * 2 / width


def own_power(kind: str, basis, inverse, values: np.ndarray, most: int, mass: np.ndarray | None = None) -> np.ndarray:
    """Power of an element's own coefficients: own (all), largest, error or
    likelihood (the most by that gradient), bits (planes that are kept)."""
    c = inverse.apply(values)
    if kind == "largest":
        c = keep(c, c, most)
    elif kind == "error":
        c = keep(c, error_gradient(basis, values, np.ones_like(values) if mass is None else mass), most)
    elif kind == "likelihood":
        c = keep(c, likelihood_gradient(basis, values, c), most)
    elif kind == "bits":
        c = np.stack([from_bitplanes(*bitplanes(v, most), len(v), most) for v in c]) if len(c) else c
    elif kind != "own":
        raise ValueError(kind)
    return c * c


def _bases(n: int) -> tuple[TensorBasis, TensorBasis]:
    v, inverse = modal(n)
    return TensorBasis(v), TensorBasis(inverse)


RESULT = {"nodes": "array<int>", "samples": "array<double>", "mean": "array<double>", "std": "array<double>"}


def sampled(df: DataFrame, column: str, n: int, samples: int, kind: str = "own", most: int = 16, mass: str | None = None, power: str | None = None) -> DataFrame:
    """df with nodes, samples (the values there), mean and std. The power comes from
    the element itself (kind, most), or from a column."""
    basis, inverse = _bases(n)
    inputs = [column, *([mass] if mass else []), *([power] if power else [])]

    def run(*parts: np.ndarray) -> list[np.ndarray]:
        out = []
        for at in range(0, len(parts[0]), ELEMENTS):
            some = [p[at : at + ELEMENTS] for p in parts]
            u = some[0]
            w = some[-1] if power else own_power(kind, basis, inverse, u, most, some[1] if mass else None)
            nodes, mean, std = sample(basis, w, u, samples)
            out.append((nodes, np.take_along_axis(u, nodes, axis=1), mean, std))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    return in_pieces(df, inputs, RESULT, run)


def regressed(df: DataFrame, n: int, power: str, nodes: str = "nodes", samples: str = "samples") -> DataFrame:
    """df with mean and std, from samples that are kept and a power: what a reader
    of compressed elements does."""
    basis, _ = _bases(n)

    def run(taken: np.ndarray, values: np.ndarray, powers: np.ndarray) -> list[np.ndarray]:
        out = []
        for at in range(0, len(taken), ELEMENTS):
            p, y, w = (x[at : at + ELEMENTS] for x in (taken.astype(np.int64), values, powers))
            out.append(sample(basis, w, None, p.shape[1], p, y)[1:])
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    return in_pieces(df, [nodes, samples, power], {"mean": "array<double>", "std": "array<double>"}, run)


def coefficients(df: DataFrame, column: str, n: int, out: str) -> DataFrame:
    """Adds out: the modal coefficients of an array of nodal values."""
    from nodeloom.operators.elements import tensor

    return tensor(df, column, modal(n)[1], out)


def truncated(df: DataFrame, coefficient: str, column: str, n: int, most: int, kind: str, out: str, mass: str | None = None) -> DataFrame:
    """Adds out: the coefficients of each element that matter most (kind: largest,
    error, by mass, or likelihood), others zero."""
    basis, _ = _bases(n)

    def run(c_: np.ndarray, u_: np.ndarray, b_: np.ndarray) -> list[np.ndarray]:
        score = {"largest": lambda: c_, "error": lambda: error_gradient(basis, u_, b_), "likelihood": lambda: likelihood_gradient(basis, u_, c_)}[kind]()
        return [keep(c_, np.round(score, 9) if kind == "error" else score, most)]

    rows = df.withColumn("_b", F.col(mass) if mass else F.transform(column, lambda v: F.lit(1.0)))
    return in_pieces(rows, [coefficient, column, "_b"], {out: "array<double>"}, run, keep=df.columns)


def group_power(df: DataFrame, column: str, n: int, group: Column, kind: str) -> DataFrame:
    """g and power, an array over the modes, of groups of elements: kind mean or
    variance (without a second element: of the coefficients themselves). Elements
    meet it by g."""
    c = coefficients(df, column, n, "_c").select(group.alias("g"), F.posexplode("_c").alias("p", "c"))
    power = average_spectrum(c, F.col("g"), kind) if kind == "mean" else c.groupBy("g", "p").agg(F.coalesce(F.var_samp("c"), F.max(F.col("c") * F.col("c"))).alias("power"))
    return power.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "power"))), lambda x: x["power"]).alias("power"))


def weights(n: int) -> np.ndarray:
    """Quadrature weights of an element's nodes."""
    w = gll(n)[1]
    return np.einsum("k,j,i->kji", w, w, w).ravel()
