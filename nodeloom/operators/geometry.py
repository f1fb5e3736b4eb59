"""Metric terms of curved elements: Jacobian, its inverse and determinant, mass,
derivatives in space by the chain rule, facet areas and outward normals, and the
weak operators that need them.

Node-wise terms are expressions over the long form (a row per node); nothing
here shuffles. The weak operators work on a row per element, in Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.spectral import derivative, gll
from nodeloom.operators.elements import in_pieces, mass, nodes

AXES = "rst"
#: Facets in order: the index that is fixed, whether at its end, and the sign that turns the cross product outward.
FACETS = (("i", 0, -1), ("i", 1, 1), ("j", 0, 1), ("j", 1, -1), ("k", 0, -1), ("k", 1, 1))


def with_derivatives(df: DataFrame, fields: list[str], n: int, coords: tuple[str, ...] = ("xs", "ys", "zs"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Long form of elements: e, k, j, i; x, y (, z) and their derivatives xr, xs, ..;
    each field f and fr, fs (, ft); keep: further arrays as they are."""
    names, axes = list("xyz")[: len(coords)], AXES[: len(coords)]
    made = [f"{c}{a}" for c in [*names, *fields] for a in axes]
    shape = (n,) * len(coords)

    def derive(*parts: np.ndarray) -> list[np.ndarray]:
        d, out = derivative(n), []
        for part in parts:
            u = part.reshape(-1, *shape)
            out += [np.moveaxis(np.tensordot(u, d, axes=([u.ndim - 1 - k], [1])), -1, u.ndim - 1 - k) for k in range(len(axes))]
        return out

    rows = df.select("e", *[F.col(c).alias(x) for c, x in zip(coords, names, strict=True)], *fields, *keep)
    rows = in_pieces(rows, [*names, *fields], dict.fromkeys(made, "array<double>"), derive)
    return nodes(rows, "e", [*names, *fields, *keep, *made], n) if len(coords) == 3 else _nodes_2d(rows, [*names, *fields, *keep, *made], n)


def _nodes_2d(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    long = df.select("e", F.posexplode(F.arrays_zip(*columns)).alias("p", "v"))
    return long.select("e", F.lit(0).alias("k"), F.expr(f"p div {n}").cast("int").alias("j"), (F.col("p") % n).cast("int").alias("i"), *[F.col("v")[c].alias(c) for c in columns])


def cofactors(names: str = "xyz", axes: str = AXES) -> tuple[dict[str, str], str]:
    """Expressions of the inverse metric times the determinant ("rx" is dr/dx),
    and of the determinant, over columns such as xr (dx/dr)."""
    m = [[f"{c}{a}" for a in axes] for c in names]  # m[c][a]
    if len(names) == 2:
        (a, b), (c, d) = m
        return {"rx": d, "ry": f"(-{b})", "sx": f"(-{c})", "sy": a}, f"({a} * {d} - {b} * {c})"
    out = {}
    for a in range(3):
        for c in range(3):
            p, q = [x for x in range(3) if x != c]
            u, v = [x for x in range(3) if x != a]
            minor = f"({m[p][u]} * {m[q][v]} - {m[p][v]} * {m[q][u]})"
            out[f"{axes[a]}{names[c]}"] = minor if (a + c) % 2 == 0 else f"(-{minor})"
    det = " + ".join(f"{m[0][a]} * {out[f'{axes[a]}{names[0]}']}" for a in range(3))
    return out, f"({det})"


def metric(long: DataFrame, dims: int = 3) -> DataFrame:
    """Adds jac (with its sign) and rx .. tz, the derivatives of the reference coordinates."""
    inverse, det = cofactors("xyz"[:dims], AXES[:dims])
    out = long.withColumn("jac", F.expr(det))
    return out.withColumns({k: F.expr(v) / F.col("jac") for k, v in inverse.items()})


def with_mass(long: DataFrame, n: int, dims: int = 3) -> DataFrame:
    """Adds b, the mass: jac times the quadrature weights."""
    if dims == 3:
        return long.withColumn("b", F.col("jac") * mass(n))
    w = F.array(*[F.lit(float(x)) for x in gll(n)[1]])
    return long.withColumn("b", F.col("jac") * F.element_at(w, F.col("j") + 1) * F.element_at(w, F.col("i") + 1))


def in_space(field: str, direction: str, dims: int = 3) -> Column:
    """d field / d direction at a node, by the chain rule."""
    terms = [F.col(f"{field}{a}") * F.col(f"{a}{direction}") for a in AXES[:dims]]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def gradient(long: DataFrame, fields: list[str], dims: int = 3) -> DataFrame:
    """Adds field_x, field_y (, field_z) for each field of a table with metric terms."""
    return long.withColumns({f"{f}_{c}": in_space(f, c, dims) for f in fields for c in "xyz"[:dims]})


def strain(velocity: tuple[str, str, str] = ("u", "v", "w"), sign: int = 1) -> dict[str, Column]:
    """S (sign 1) or the rotation (sign -1) from the columns u_x, u_y, ..; of the
    rotation only 12, 13 and 23, as the diagonal is zero."""
    pairs = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)] if sign > 0 else [(0, 1), (0, 2), (1, 2)]
    at = lambda i, j: F.col(f"{velocity[i]}_{'xyz'[j]}")
    return {f"{i + 1}{j + 1}": (at(i, j) + sign * at(j, i)) * 0.5 for i, j in pairs}


def facet_nodes(long: DataFrame, n: int) -> DataFrame:
    """A row per node of each facet: e, facet, the two indices, area (with the
    quadrature weights), nx, ny, nz (outward)."""
    w = F.array(*[F.lit(float(x)) for x in gll(n)[1]])
    tangents = {"i": ("s", "t"), "j": ("r", "t"), "k": ("r", "s")}
    found = []
    for f, (fixed, end, sign) in enumerate(FACETS):
        a, b = tangents[fixed]
        p, q = [c for c in "ijk" if c != fixed]
        cross = [F.expr(f"{u}{a} * {v}{b} - {v}{a} * {u}{b}") * sign for u, v in (("y", "z"), ("z", "x"), ("x", "y"))]
        found.append(F.when(F.col(fixed) == (n - 1 if end else 0), F.struct(F.lit(f).alias("facet"), F.col(p).alias("p"), F.col(q).alias("q"), *[c.alias(f"c{x}") for c, x in zip(cross, "xyz", strict=True)])))
    rows = long.withColumn("_f", F.explode(F.array_compact(F.array(*found)))).select("e", "k", "j", "i", "_f.*")
    norm = F.sqrt(F.expr("cx * cx + cy * cy + cz * cz"))
    rows = rows.withColumn("norm", norm)
    weight = F.element_at(w, F.col("p") + 1) * F.element_at(w, F.col("q") + 1)
    return rows.select("e", "facet", "k", "j", "i", (F.col("norm") * weight).alias("area"), *[(F.col(f"c{x}") / F.col("norm")).alias(f"n{x}") for x in "xyz"])


def _terms(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of elements x (count, 3, n, n, n): inverse metric (count, axis, space, nodes), determinant, mass."""
    d, w = derivative(n), gll(n)[1]
    jac = np.stack([np.einsum("il,eckjl->eckji", d, x), np.einsum("jl,eckli->eckji", d, x), np.einsum("kl,eclji->eckji", d, x)], axis=2)
    full = np.moveaxis(jac, (1, 2), (-2, -1))
    det = np.linalg.det(full)
    inverse = np.moveaxis(np.linalg.inv(full), (-2, -1), (1, 2))
    return inverse, det, det * np.einsum("k,j,i->kji", w, w, w)


def _grad(u: np.ndarray, n: int) -> np.ndarray:
    d = derivative(n)
    return np.stack([np.einsum("il,ekjl->ekji", d, u), np.einsum("jl,ekli->ekji", d, u), np.einsum("kl,elji->ekji", d, u)], axis=1)


def _stack(s: np.ndarray, n: int) -> np.ndarray:
    return s.reshape(-1, n, n, n)


def _kernel(df: DataFrame, columns: list[str], out: str, run) -> DataFrame:
    """Adds out: run over pieces of the array columns; null where one of them is null."""
    return in_pieces(df, columns, {out: "array<double>"}, lambda *parts: [run(*parts)])


def stiffness(df: DataFrame, field: str, out: str, n: int, coords: tuple[str, str, str] = ("xs", "ys", "zs")) -> DataFrame:
    """Weak Laplacian of each curved element: sum over axes of D_a^T (b G_ab D_b u)."""
    def run(u, *x):
        grid = np.stack([_stack(c, n) for c in x], axis=1)
        inverse, _, b = _terms(grid, n)
        g = np.einsum("eackji,ebckji->eabkji", inverse, inverse) * b[:, None, None]
        flux = np.einsum("eabkji,ebkji->eakji", g, _grad(_stack(u, n), n))
        d = derivative(n)
        return np.einsum("li,ekjl->ekji", d, flux[:, 0]) + np.einsum("lj,ekli->ekji", d, flux[:, 1]) + np.einsum("lk,elji->ekji", d, flux[:, 2])

    return _kernel(df, [field, *coords], out, run)


def advection(df: DataFrame, field: str, velocity: tuple[str, str, str], out: str, n: int, coords: tuple[str, str, str] = ("xs", "ys", "zs")) -> DataFrame:
    """(velocity . grad field) b of each curved element."""
    def run(f, u, v, w, *x):
        inverse, _, b = _terms(np.stack([_stack(c, n) for c in x], axis=1), n)
        space = np.einsum("eackji,eakji->eckji", inverse, _grad(_stack(f, n), n))
        return sum(_stack(c, n) * space[:, k] for k, c in enumerate((u, v, w))) * b

    return _kernel(df, [field, *velocity, *coords], out, run)


def spacing(df: DataFrame, n: int, coords: tuple[str, str, str] = ("xs", "ys", "zs"), fields: tuple[str, ...] = ()) -> DataFrame:
    """Node spacing of the mesh check, long form with hx, hy, hz: along each axis
    of space the length of its changes over half the distance between the
    reference neighbours; an end node has one neighbour, and half the distance to it.
    fields come along with their derivatives in reference coordinates."""
    x = gll(n)[0]
    half = (np.append(x[1:], x[-1]) - np.insert(x[:-1], 0, x[0])) / 2
    step = F.array(*[F.lit(float(v)) for v in half])
    long = with_derivatives(df, list(fields), n, coords).withColumns({f"_{a}": F.element_at(step, F.col(i) + 1) for a, i in zip(AXES, "ijk", strict=True)})
    out = long.withColumns({f"h{c}": F.sqrt(F.expr(" + ".join(f"{c}{a} * _{a} * {c}{a} * _{a}" for a in AXES))) for c in "xyz"})
    return out.drop(*[f"_{a}" for a in AXES])


def dissipation(long: DataFrame, velocity: tuple[str, str, str], scalar: str, pr: float, ra: float) -> DataFrame:
    """Adds eps_k and eps_t, the dissipation of kinetic and of thermal energy of a
    convection with these Prandtl and Rayleigh numbers, from the columns u_x, u_y .."""
    at = lambda i, j: F.col(f"{velocity[i]}_{'xyz'[j]}")
    square = lambda c: c * c
    strain_sq = sum((square(at(i, j) + at(j, i)) for i in range(3) for j in range(3)), F.lit(0.0)) * 0.25
    heat = sum((square(F.col(f"{scalar}_{c}")) for c in "xyz"), F.lit(0.0))
    return long.withColumns({"eps_k": strain_sq * (2 * (pr / ra) ** 0.5), "eps_t": heat / (ra * pr) ** 0.5})


def in_kolmogorov_units(nodes_: DataFrame, pr: float, ra: float) -> DataFrame:
    """Per element e: the mean dissipation by mass (eps_k), the Kolmogorov length
    eta from it, and the node spacings over it, again by mass (hx, hy, hz); and,
    the same in each row, the length from the mean over all elements (eta_all) and
    the Nusselt numbers by both dissipations. nodes_: e, b, hx, hy, hz, eps_k, eps_t."""
    mu, lamb = (pr / ra) ** 0.5, 1 / (ra * pr) ** 0.5
    each = nodes_.groupBy("e").agg(F.sum("b").alias("b"), *[F.sum(F.col(c) * F.col("b")).alias(c) for c in ("hx", "hy", "hz", "eps_k", "eps_t")])
    b, k, t = nodes_.agg(F.sum("b"), F.sum(F.col("eps_k") * F.col("b")), F.sum(F.col("eps_t") * F.col("b"))).first()
    if not b:
        return each.select("e", "eps_k", F.lit(None).cast("double").alias("eta"), "hx", "hy", "hz", *[F.lit(None).cast("double").alias(c) for c in ("eta_all", "nu_k", "nu_t")])
    whole = {"eta_all": (mu**3 / (k / b)) ** 0.25, "nu_k": 1 + k / b / (mu**3 * ra / pr**2), "nu_t": t / b / lamb}
    each = each.withColumn("eps_k", F.col("eps_k") / F.col("b")).withColumn("eta", F.pow(F.lit(mu**3) / F.col("eps_k"), 0.25))
    return each.select("e", "eps_k", "eta", *[(F.col(c) / F.col("b") / F.col("eta")).alias(c) for c in ("hx", "hy", "hz")], *[F.lit(v).alias(c) for c, v in whole.items()])


def space_derivatives(df: DataFrame, fields: list[str], n: int, coords: tuple[str, str, str] = ("xs", "ys", "zs")) -> DataFrame:
    """Adds, as arrays per element, f_x, f_y, f_z and the pure second derivatives
    f_xx, f_yy, f_zz of each field f, by the chain rule applied twice."""
    made = [f"{f}_{c}" for f in fields for c in ("x", "y", "z", "xx", "yy", "zz")]

    def derive(*parts: np.ndarray) -> list[np.ndarray]:
        out = []
        inverse, _, _ = _terms(np.stack([_stack(c, n) for c in parts[:3]], axis=1), n)
        space = lambda u: np.einsum("eackji,eakji->eckji", inverse, _grad(u, n))
        for part in parts[3:]:
            first = space(_stack(part, n))
            out += [*[first[:, k] for k in range(3)], *[space(first[:, k])[:, k] for k in range(3)]]
        return out

    return in_pieces(df, [*coords, *fields], dict.fromkeys(made, "array<double>"), derive)


def derived_statistics(df: DataFrame, wanted: dict[str, list[tuple[str, int, str]]], n: int, coords: tuple[str, str, str] = ("xs", "ys", "zs"), keep: tuple[str, ...] = ("e",)) -> DataFrame:
    """e (or what else to keep) and an array per wanted column: sums of first or second derivatives in
    space of df's statistics (arrays per element): name -> (statistic, order, axis)."""
    fields = list(dict.fromkeys(name for terms in wanted.values() for name, _, _ in terms))

    def derive(*parts: np.ndarray) -> list[np.ndarray]:
        inverse, _, _ = _terms(np.stack([_stack(c, n) for c in parts[:3]], axis=1), n)
        space = lambda u: np.einsum("eackji,eakji->eckji", inverse, _grad(u, n))
        first = {f: space(_stack(part, n)) for f, part in zip(fields, parts[3:], strict=True)}
        out = []
        for terms in wanted.values():
            total = 0.0
            for f, order, axis in terms:
                k = "xyz".index(axis)
                total = total + (first[f][:, k] if order == 1 else space(first[f][:, k])[:, k])
            out.append(total)
        return out

    return in_pieces(df, [*coords, *fields], dict.fromkeys(wanted, "array<double>"), derive, keep=list(keep))
