"""Weak operators and conjugate gradients on a brick mesh of unit elements."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.spectral import derivative, gll
from nodeloom.operators.elements import pieces, values_of


def weights(n: int) -> np.ndarray:
    w = gll(n)[1]
    return np.einsum("k,j,i->kji", w, w, w).ravel()


def _times(df: DataFrame, column: str, w: np.ndarray) -> DataFrame:
    lit = "array(" + ", ".join(f"{float(x)!r}D" for x in w) + ")"
    return df.withColumn(column, F.zip_with(column, F.expr(lit), lambda a, b: a * b))


def stiffness(df: DataFrame, column: str, out: str, n: int, h: float = 1.0) -> DataFrame:
    """Weak Laplacian sum_d D_d^T (G W D_d u) of each element of edge h, in Arrow batches; no shuffle."""

    @F.pandas_udf("array<double>")
    def kernel(values: pd.Series) -> pd.Series:
        u = np.stack([np.asarray(v, float) for v in values]) if len(values) else np.zeros((0, n**3))
        return pd.Series(list(weak_laplacian(u, n, h)))

    return df.withColumn(out, kernel(column))


def weak_laplacian(values: np.ndarray, n: int, h: float = 1.0) -> np.ndarray:
    """The same of a matrix, an element per row."""
    d, w = derivative(n), weights(n).reshape(n, n, n) * (h / 2)
    u = values.reshape(-1, n, n, n)
    total = np.zeros_like(u)
    for axis in (1, 2, 3):
        g = np.moveaxis(np.tensordot(u, d, axes=([axis], [1])), -1, axis) * w
        total += np.moveaxis(np.tensordot(g, d, axes=([axis], [0])), -1, axis)
    return total.reshape(len(values), -1)


def jacobi_diagonal(n: int, h: float = 1.0) -> np.ndarray:
    """Diagonal of the element operator."""
    d, w = derivative(n), gll(n)[1]
    one = np.einsum("qi,q->i", d * d, w)
    out = np.zeros((n, n, n))
    for k, j, i in np.ndindex(n, n, n):
        out[k, j, i] = one[i] * w[j] * w[k] + w[i] * one[j] * w[k] + w[i] * w[j] * one[k]
    return out.ravel() * h / 2


def advection(df: DataFrame, field: str, velocity: tuple[str, str, str], out: str, n: int, h: float = 1.0) -> DataFrame:
    """(u . grad f) B of each element, in Arrow batches; no shuffle."""
    d, w = derivative(n), weights(n) * (2 / h) * (h / 2) ** 3

    @F.pandas_udf("array<double>")
    def kernel(f: pd.Series, *u: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, float) for v in f]).reshape(-1, n, n, n) if len(f) else np.zeros((0, n, n, n))
        total = np.zeros((len(f), n**3))
        for axis, c in zip((3, 2, 1), u, strict=True):
            g = np.moveaxis(np.tensordot(x, d, axes=([axis], [1])), -1, axis).reshape(len(f), -1)
            total += g * (np.stack([np.asarray(v, float) for v in c]) if len(c) else np.zeros_like(g))
        return pd.Series(list(total * w))

    return df.withColumn(out, kernel(field, *velocity))


def conjugate_gradients(apply, b: DataFrame, key: list[str], inverse_diagonal: DataFrame | None = None, tol: float = 1e-8, most: int = 200, project=None) -> tuple[DataFrame, int, float]:
    """Solves apply(x) = b on unique nodes. b: key columns and v; apply maps such
    a table to another; inverse_diagonal likewise. project maps a table to its
    part that the system can reach (a singular system's right side, and what
    apply and the solution gain beside it). Stops when the root mean square of
    the residual is below tol. Vectors stay distributed; every step is
    written to the checkpoint folder, so lost executors recompute one step."""
    if project is not None:
        b, inner = project(b), apply
        apply = lambda v: project(inner(v))
    n = b.count()
    if not n:
        return b.select(*key, "v"), 0, 0.0
    state = b.select(*key, F.lit(0.0).alias("x"), F.col("v").alias("r"))
    state = state.join(inverse_diagonal.select(*key, F.col("v").alias("m")), key) if inverse_diagonal is not None else state.withColumn("m", F.lit(1.0))
    state = state.withColumn("p", F.col("r") * F.col("m")).checkpoint()
    rz, rr = state.agg(F.sum(F.col("r") * F.col("r") * F.col("m")), F.sum(F.col("r") * F.col("r"))).first()
    step = 0
    while (rr / n) ** 0.5 >= tol and step < most:
        ap = apply(state.select(*key, F.col("p").alias("v"))).select(*key, F.col("v").alias("ap"))
        both = state.join(ap, key).checkpoint()
        pap = both.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        alpha = rz / pap
        state = both.select(*key, (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "m", "p")
        new, rr = state.agg(F.sum(F.col("r") * F.col("r") * F.col("m")), F.sum(F.col("r") * F.col("r"))).first()
        state = state.withColumn("p", F.col("r") * F.col("m") + (new / rz) * F.col("p"))
        rz, step = new, step + 1
    x = state.select(*key, F.col("x").alias("v"))
    return (project(x) if project is not None else x), step, (rr / n) ** 0.5


def without_mean(table: DataFrame) -> DataFrame:
    """v less its mean over all nodes. The table is written before, as it is read twice."""
    kept = table.checkpoint()
    mean = kept.agg(F.avg("v")).first()[0] or 0.0
    return kept.withColumn("v", F.col("v") - F.lit(float(mean)))


BLOCK = 4096  #: elements of a block, at most
WRITTEN = 4  #: steps after which vectors are written; those since then are replayed, without a shuffle


def solve_in_blocks(rows: DataFrame, column: str, number: Callable, kernel: Callable, diagonal: np.ndarray, mass: np.ndarray, folder: str, tol: float = 1e-8, most: int | None = None) -> tuple[DataFrame, int, float]:
    """Solves sum_e Q_e^T K Q_e x = sum_e Q_e^T (mass u_e) on unique nodes by conjugate
    gradients with the inverse diagonal: (node, v), the steps and the root mean
    square of the residual. rows: e and the array column; number gives the global
    numbers of the nodes of elements e (a matrix); kernel applies K to a matrix of
    elements, diagonal is K's; mass: weights of the right side.

    Elements whose ids are neighbours make a block, a row that holds each of its
    nodes once. Of a step only the sums at nodes that blocks share (the rim) are
    sent and kept; the vectors stay in buckets of blocks, are written every WRITTEN
    steps and brought forward by the sums in between. most: steps, by default as
    many as unknowns."""
    from nodeloom.operators.sequence import _bucketed

    rows = rows.where(F.col(column).isNotNull())
    count = rows.count()
    if not count:
        return rows.sparkSession.createDataFrame([], "node long, v double"), 0, 0.0
    shift = int(np.log2(max(64, min(BLOCK, count // 32))))
    dealt = rows.select(F.shiftright("e", shift).alias("block"), F.struct("e", F.col(column).alias("u")).alias("s"))
    buckets = -(-dealt.select("block").distinct().count() // 4)
    write = lambda df, name: _bucketed(df, folder, name, buckets, "block")
    held = lambda b, c, i: b.column(c)[i].values.to_numpy(zero_copy_only=False)
    per = len(diagonal)

    def row(values: dict):
        import pyarrow as pa

        return pa.RecordBatch.from_pydict({c: pa.array([v]) for c, v in values.items()})

    def places(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, at = np.unique(number(e), return_inverse=True)
        return node, at.ravel()

    def applied(p: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bincount(at, kernel(p[at].reshape(-1, per)).ravel(), len(p))

    def inverse(b, i: int, at: np.ndarray, size: int) -> np.ndarray:
        m = 1 / np.bincount(at, np.tile(diagonal, len(at) // per), size)
        m[held(b, "rim", i)] = held(b, "inverse", i)
        return m

    def begin(batches):
        for b in pieces(batches):
            for i in range(b.num_rows):
                e, u = b.column("s")[i].values.flatten()
                e = e.to_numpy()
                node, at = places(e)
                yield row({"block": b.column("block")[i].as_py(), "es": e, "node": node, "b": np.bincount(at, (values_of(u) * mass).ravel(), len(node)), "d": np.bincount(at, np.tile(diagonal, len(e)), len(node))})

    grouped = dealt.repartition(buckets, "block").groupBy("block").agg(F.array_sort(F.collect_list("s")).alias("s"))
    own = write(grouped.mapInArrow(begin, "block long, es array<long>, node array<long>, b array<double>, d array<double>"), "own")
    each = own.select("block", F.posexplode(F.arrays_zip("node", "b", "d")).alias("rim", "s")).select("block", "rim", "s.*")
    total = each.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("owner"), F.sum("b").alias("b"), F.sum("d").alias("d")).where("n > 1").drop("n")
    shared = each.select("block", "rim", "node").join(total, "node").select("block", F.struct("rim", F.col("node").alias("label"), (F.col("owner") == F.col("block")).cast("double").alias("mine"), "b", (1 / F.col("d")).alias("inverse")).alias("s"))
    shared = shared.repartition(buckets, "block").groupBy("block").agg(F.array_sort(F.collect_list("s")).alias("s"))
    rim = [f"coalesce(s.{c}, cast(array() as array<{t}>)) as {c}" for c, t in (("rim", "int"), ("label", "long"), ("mine", "double"), ("inverse", "double"))]
    joined = own.join(shared, "block", "left").selectExpr("block", "es", "b as r", *rim, "coalesce(s.b, cast(array() as array<double>)) as c")
    kinds = "block long, es array<long>, rim array<int>, label array<long>, mine array<double>, inverse array<double>, x array<double>, r array<double>, p array<double>"
    fixed = ("es", "rim", "label", "mine", "inverse")

    def first(batches):
        for b in pieces(batches):
            for i in range(b.num_rows):
                r = held(b, "r", i).copy()
                r[held(b, "rim", i)] = held(b, "c", i)
                at = places(held(b, "es", i))[1]
                yield row({"block": b.column("block")[i].as_py(), **{c: held(b, c, i) for c in fixed}, "x": np.zeros(len(r)), "r": r, "p": r * inverse(b, i, at, len(r))})

    def products(b, i: int, r: np.ndarray, m: np.ndarray) -> dict:
        once = np.ones(len(r))
        once[held(b, "rim", i)] = held(b, "mine", i)
        return {"rz": float((r * r * m * once).sum()), "rr": float((r * r * once).sum()), "n": float(once.sum())}

    def replayed(b, i: int, taken: list, p: np.ndarray, at: np.ndarray) -> tuple:
        """x, r and p after the steps taken since they were written."""
        x, r, m = held(b, "x", i), held(b, "r", i), inverse(b, i, at, len(p)) if taken else None
        for k, (alpha, beta) in enumerate(taken):
            q = applied(p, at)
            q[held(b, "rim", i)] = held(b, f"c{k}", i)
            x, r = x + alpha * p, r - alpha * q
            p = m * r + beta * p if beta is not None else p
        return x, r, p

    def applications(taken: list):
        def run(batches):
            for b in pieces(batches):
                for i in range(b.num_rows):
                    at = places(held(b, "es", i))[1]
                    p = replayed(b, i, taken, held(b, "p", i), at)[2]
                    q = applied(p, at)
                    yield row({"block": b.column("block")[i].as_py(), "pq": float(p @ q), "rim": held(b, "rim", i), "label": held(b, "label", i), "q": q[held(b, "rim", i)]})

        return run

    def residuals(taken: list):
        def run(batches):
            for b in pieces(batches):
                for i in range(b.num_rows):
                    at = places(held(b, "es", i))[1]
                    r = replayed(b, i, taken, held(b, "p", i), at)[1]
                    yield row(products(b, i, r, inverse(b, i, at, len(r))))

        return run

    def advanced(taken: list):
        def run(batches):
            for b in pieces(batches):
                for i in range(b.num_rows):
                    new = replayed(b, i, taken, held(b, "p", i), places(held(b, "es", i))[1])
                    yield row({"block": b.column("block")[i].as_py(), **{c: held(b, c, i) for c in fixed}, **dict(zip("xrp", new, strict=True))})

        return run

    def summed(df: DataFrame) -> tuple[float, ...]:
        return tuple(df.agg(*[F.sum(c) for c in df.columns]).first())

    def told(taken: list):
        def run(batches):
            import pyarrow as pa

            for b in pieces(batches):
                for i in range(b.num_rows):
                    node, at = places(held(b, "es", i))
                    x, once = replayed(b, i, taken, held(b, "p", i), at)[0], np.ones(len(node), bool)
                    once[held(b, "rim", i)] = held(b, "mine", i) > 0
                    yield pa.RecordBatch.from_pydict({"node": pa.array(node[once]), "v": pa.array(x[once])})

        return run

    def beside(state: DataFrame, back: DataFrame, k: int) -> DataFrame:
        made = back.select("block", F.transform("s", lambda v: v["c"]).alias(f"c{k}")).repartition(buckets, "block")
        return state.hint("merge").join(made, "block", "left").select(*state.columns, F.coalesce(f"c{k}", F.array().cast("array<double>")).alias(f"c{k}"))

    three = "rz double, rr double, n double"
    state, taken = write(joined.mapInArrow(first, kinds), "state0"), []
    rz, rr, n = summed(state.mapInArrow(residuals([]), three))
    step = 0
    while (rr / n) ** 0.5 >= tol and step < (n if most is None else most):
        sent = state.mapInArrow(applications(list(taken)), "block long, pq double, rim array<int>, label array<long>, q array<double>").checkpoint()
        alpha = rz / sent.agg(F.sum("pq")).first()[0]
        out = sent.select("block", F.explode(F.arrays_zip("rim", "label", "q")).alias("s")).select("block", "s.*")
        sums = out.groupBy("label").agg(F.sum("q").alias("c"))
        back = out.select("block", "rim", "label").join(sums, "label").select("block", F.struct("rim", "c").alias("s")).repartition(buckets, "block").groupBy("block").agg(F.array_sort(F.collect_list("s")).alias("s")).checkpoint()
        state = beside(state, back, len(taken))
        new, rr, _ = summed(state.mapInArrow(residuals([*taken, (alpha, None)]), three))
        taken.append((alpha, new / rz))
        rz, step = new, step + 1
        if len(taken) == WRITTEN:
            state, taken = write(state.mapInArrow(advanced(list(taken)), kinds), f"state{step}"), []
    return state.mapInArrow(told(list(taken)), "node long, v double"), step, (rr / n) ** 0.5
