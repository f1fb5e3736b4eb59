"""Spectral-element matrices on Gauss-Lobatto-Legendre nodes (driver side).

They are small (n x n), so operators write them as literals into expressions."""

from __future__ import annotations

from functools import wraps

import numpy as np
from numpy.polynomial import legendre as leg


def _once(f):
    """Keeps f's results. A plain function, unlike those of functools.cache, goes to workers by value."""
    held: dict = {}

    @wraps(f)
    def run(n: int):
        if n not in held:
            held[n] = f(n)
        return held[n]

    return run


@_once
def gll(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (ascending) and weights 2 / (n (n-1) P_{n-1}(x)^2)."""
    if n < 2:
        raise ValueError("at least two nodes")
    top = np.zeros(n)
    top[-1] = 1
    inner = np.sort(leg.legroots(leg.legder(top)))
    x = np.concatenate([[-1.0], (inner - inner[::-1]) / 2, [1.0]])
    return x, 2.0 / (n * (n - 1) * leg.legval(x, top) ** 2)


def glc(n: int) -> np.ndarray:
    """Gauss-Lobatto-Chebyshev nodes, ascending."""
    return -np.cos(np.pi * np.arange(n) / (n - 1))


@_once
def derivative(n: int) -> np.ndarray:
    """D[i, l]: derivative at node i of the Lagrange polynomial of node l."""
    x, _ = gll(n)
    gap = x[:, None] - x[None, :] + np.eye(n)
    w = 1.0 / gap.prod(axis=1)
    d = (w[None, :] / w[:, None]) / gap
    np.fill_diagonal(d, 0.0)
    np.fill_diagonal(d, -d.sum(axis=1))
    return d


@_once
def modal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """v (nodes x modes, normalised Legendre; the last mode uses 2/(n-1)) and its inverse v^T W."""
    x, w = gll(n)
    v = leg.legvander(x, n - 1)
    norm = np.array([2.0 / (2 * k + 1) for k in range(n)])
    norm[-1] = 2.0 / (n - 1)
    v = v / np.sqrt(norm)
    return v, v.T * w


def lagrange_rows(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Barycentric interpolation rows from nodes x to points at; one-hot on a node."""
    x, at = np.asarray(x, float), np.atleast_1d(np.asarray(at, float))
    w = 1.0 / (x[:, None] - x[None, :] + np.eye(len(x))).prod(axis=1)
    gap = at[:, None] - x[None, :]
    hit = np.abs(gap) < 1e-15
    t = w / np.where(hit, 1.0, gap)
    rows = t / t.sum(axis=1, keepdims=True)
    some = hit.any(axis=1)
    rows[some] = hit[some].astype(float)
    return rows


def product_rows(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same rows from the products of the Lagrange polynomials."""
    x, at = np.asarray(x, float), np.atleast_1d(np.asarray(at, float))
    own = np.eye(len(x), dtype=bool)
    gap = np.where(own, 1.0, x[:, None] - x[None, :])
    return np.stack([(np.where(own[k], 1.0, at[:, None] - x[None, :]) / gap[k]).prod(axis=1) for k in range(len(x))], axis=1)


def legendre_rows(n: int, at: np.ndarray) -> np.ndarray:
    """Normalised Legendre polynomials (the columns of modal) at points."""
    norm = np.array([2.0 / (2 * k + 1) for k in range(n)])
    norm[-1] = 2.0 / (n - 1)
    return leg.legvander(np.atleast_1d(np.asarray(at, float)), n - 1) / np.sqrt(norm)


def legendre_slopes(n: int, at: np.ndarray) -> np.ndarray:
    """Their derivatives at points."""
    norm = np.array([2.0 / (2 * k + 1) for k in range(n)])
    norm[-1] = 2.0 / (n - 1)
    at = np.atleast_1d(np.asarray(at, float))
    return np.stack([leg.legval(at, leg.legder(np.eye(n)[k])) for k in range(n)], axis=1) / np.sqrt(norm)


def _by_modes(rows):
    """Rows for nodal values, by way of the modes."""
    return lambda n, at: rows(n, at) @ modal(n)[1]


#: Ways to interpolate nodal values at reference coordinates, by name, and their slopes.
POINT_ROWS = {"barycentric": lambda n, at: lagrange_rows(gll(n)[0], at), "lagrange": lambda n, at: product_rows(gll(n)[0], at), "legendre": _by_modes(legendre_rows)}
POINT_SLOPES = {"barycentric": lambda n, at: lagrange_rows(gll(n)[0], at) @ derivative(n), "lagrange": lambda n, at: product_rows(gll(n)[0], at) @ derivative(n), "legendre": _by_modes(legendre_slopes)}


def interpolation(n: int, m: int) -> np.ndarray:
    """m x n matrix between GLL nodes."""
    return lagrange_rows(gll(n)[0], gll(m)[0])


def points_1d(low: float, high: float, n: int, mode: str = "equal", gain: float = 1.0, endpoint: bool = True) -> np.ndarray:
    """One-dimensional point sets: equal, cheb, tanh, half_tanh."""
    if mode == "equal":
        return np.linspace(low, high, n, endpoint=endpoint)
    if mode == "cheb":
        s = (glc(n) + 1) / 2
    elif mode == "tanh":
        s = (np.tanh(gain * np.linspace(-1, 1, n)) / np.tanh(gain) + 1) / 2
    elif mode == "half_tanh":
        s = (np.tanh(gain * np.linspace(-1, 1, 2 * n)) / np.tanh(gain))[n:]  # the upper half of 2 n points from -1 to 1
    else:
        raise ValueError(mode)
    return low + (high - low) * s


def cell_widths(x: np.ndarray, period: float | None = None) -> np.ndarray:
    """Centred widths; with a period the ends are rescaled so that all add up to it."""
    mid = (x[1:] + x[:-1]) / 2
    w = np.diff(np.concatenate([[x[0]], mid, [x[-1]]]))
    if period is not None:
        w[0] = w[-1] = w[0] + w[-1]
        w = w * (period / w.sum())
    return w


def filter_matrix(n: int, transfer: tuple[float, ...]) -> np.ndarray:
    """Nodal form of a modal filter: v diag(transfer) v^-1."""
    v, inv = modal(n)
    return v @ np.diag(transfer) @ inv
