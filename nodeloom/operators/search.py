"""Candidate elements of a point: by a ball around box centres, refined by boxes
along the axes and by boxes along the element's own directions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.spectral import derivative, gll
from nodeloom.operators.statistics import level_join

GROWTH = 1.01 * (1 + 1e-6)  #: of the ball's radius over the largest half diagonal


def boxes(mesh: DataFrame) -> DataFrame:
    """e, the box (x_lo .. z_hi), its centre (cx ..) and half diagonal (half)."""
    pick = lambda f, c: f(f"{c}s")
    out = mesh.select("e", *[pick(f, c).alias(f"{c}_{s}") for c in "xyz" for f, s in ((F.array_min, "lo"), (F.array_max, "hi"))])
    out = out.withColumns({f"c{c}": (F.col(f"{c}_lo") + F.col(f"{c}_hi")) / 2 for c in "xyz"})
    return out.withColumn("half", F.sqrt(sum((F.col(f"{c}_hi") - F.col(f"{c}_lo")) * (F.col(f"{c}_hi") - F.col(f"{c}_lo")) for c in "xyz")) / 2)


def ball_candidates(points: DataFrame, mesh: DataFrame, radius: float | None = None) -> DataFrame:
    """point columns and e for elements whose box centre is within radius (by
    default the largest half diagonal, grown a little) and whose box holds the
    point. Points meet boxes in grid cells of the boxes' own sizes."""
    b = boxes(mesh)
    r = radius if radius is not None else float(b.agg(F.max("half")).first()[0] or 0.0) * GROWTH
    met = level_join(points, b, ["x", "y", "z"])
    near = sum((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz") <= r * r
    return met.where(near).select(*points.columns, "e")


def oriented_boxes(mesh: DataFrame, n: int, margin: float = 0.05) -> DataFrame:
    """e, obb: the centre (3), the unit directions of the element's axes at its
    middle (3 x 3) and the half extents along them (3), grown by margin; 15 numbers."""

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series, ys: pd.Series, zs: pd.Series) -> pd.Series:
        grid = np.stack([np.stack([np.asarray(v, float) for v in s]) for s in (xs, ys, zs)], axis=1).reshape(-1, 3, n, n, n)
        d, w = derivative(n), gll(n)[1]
        weight = np.einsum("k,j,i->kji", w, w, w) / 8
        slopes = [np.einsum("il,eckjl->eckji", d, grid), np.einsum("jl,eckli->eckji", d, grid), np.einsum("kl,eclji->eckji", d, grid)]
        axes = np.stack([np.einsum("eckji,kji->ec", s, weight) for s in slopes], axis=1)
        q = np.linalg.qr(np.swapaxes(axes, 1, 2))[0]  # columns: orthonormal directions
        local = np.einsum("eca,eckji->eakji", q, grid).reshape(len(grid), 3, -1)
        low, high = local.min(axis=2), local.max(axis=2)
        centre = np.einsum("eca,ea->ec", q, (low + high) / 2)
        half = (high - low) / 2 * (1 + margin)
        return pd.Series(list(np.concatenate([centre, np.swapaxes(q, 1, 2).reshape(len(grid), 9), half], axis=1)))

    return mesh.select("e", run("xs", "ys", "zs").alias("obb"))


def refine_oriented(candidates: DataFrame, obb: DataFrame) -> DataFrame:
    """Candidates (x, y, z, e) that the element's oriented box holds."""
    met = candidates.join(obb, "e")
    held = F.lit(True)
    for a in range(3):
        along = sum((F.col(c) - F.col("obb")[k]) * F.col("obb")[3 + 3 * a + k] for k, c in enumerate("xyz"))
        held = held & (F.abs(along) <= F.col("obb")[12 + a])
    return met.where(held).drop("obb")


#: Search structures by name: each gives the candidates of points in a mesh.
STRUCTURES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"kdtree": ball_candidates}


def structure(name: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """boxes (grid cells of the boxes' own sizes) or kdtree (balls around centres)."""
    if name == "boxes":
        return lambda points, mesh: level_join(points, boxes(mesh).select("e", *[f"{c}_{s}" for c in "xyz" for s in ("lo", "hi")]), ["x", "y", "z"]).select(*points.columns, "e")
    return STRUCTURES[name]
