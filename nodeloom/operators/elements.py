"""Elements as rows: one array of n^3 nodal values per element and field, in the
order (k, j, i), i fastest. Tensor kernels are expressions over the arrays, so
they need no shuffle; the long form (a row per node) serves relational work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.spectral import derivative, gll

AXES = {"r": 2, "s": 1, "t": 0}  #: place of the axis in (k, j, i)
PIECE = 4 << 20  #: bytes of rows, with what is made of them, that a kernel has in hand
UNROLLED = 5  #: up to this order a kernel is one generated expression; beyond, an Arrow kernel


def values_of(column) -> np.ndarray:
    """An Arrow column of arrays of the same length as a matrix, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists_of(m: np.ndarray, some: np.ndarray | None = None):
    """The rows of a matrix as an Arrow column of arrays; some: rows that have one (others are null)."""
    import pyarrow as pa

    flat = pa.array(np.ascontiguousarray(m).ravel())
    if some is None or some.all():
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), flat)
    ends = np.concatenate([[0], np.cumsum(some)]).astype(np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(~some))


def pieces(batches: Iterator, more: int = 0) -> Iterator:
    """Arrow batches in slices of about PIECE bytes, where more bytes are made of a row."""
    for b in batches:
        some = max(1, PIECE // (b.nbytes // max(1, b.num_rows) + more + 1))
        for at in range(0, b.num_rows, some):
            yield b.slice(at, some)


def in_pieces(df: DataFrame, inputs: list[str], made: dict[str, str], run: Callable, keep: list[str] | None = None) -> DataFrame:
    """df (its columns keep) with made (name -> type of array): run takes matrices of
    the input arrays, a row per row, and returns one per made column. Rows go
    through in slices of batches without becoming Python objects, so that a task
    holds a batch and PIECE bytes, however many arrays are made of it. Null where
    one of the inputs is null."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in made]
    rows = df.select(*dict.fromkeys([*kept, *inputs]))
    kinds = {c: np.int32 if "int" in t else np.float64 for c, t in made.items()}
    empty = spark_types(df.select(*kept), made)

    def go(batches):
        import pyarrow as pa

        for b in pieces(batches, 512 * len(kinds)):
            some = np.logical_and.reduce([b.column(c).is_valid().to_numpy(zero_copy_only=False) for c in inputs])
            own = b if some.all() else b.filter(pa.array(some))
            out = run(*[values_of(own.column(c)) for c in inputs]) if own.num_rows else [np.zeros((0, 0))] * len(kinds)
            made_ = [lists_of(np.asarray(m).reshape(own.num_rows, -1).astype(k, copy=False) if own.num_rows else np.zeros((0, 0), k), some) for m, k in zip(out, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *made_], names=[*kept, *kinds])

    return rows.mapInArrow(go, empty)


def spark_types(df: DataFrame, made: dict[str, str]):
    """The schema of df with more columns."""
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

    return StructType([*df.schema.fields, *[StructField(c, ArrayType(IntegerType() if "int" in t else DoubleType())) for c, t in made.items()]])


def _terms(column: str, m: np.ndarray, axis: int, shape: tuple[int, int, int]) -> str:
    out = []
    new = list(shape)
    new[axis] = m.shape[0]
    for k, j, i in np.ndindex(*new):
        at = [k, j, i]
        row = m[at[axis]]
        parts = []
        for c, value in enumerate(row):
            at[axis] = c
            if value != 0.0:
                parts.append(f"{float(value)!r}D * {column}[{(at[0] * shape[1] + at[1]) * shape[2] + at[2]}]")
        out.append(" + ".join(parts) or "0.0D")
    return f"array({', '.join(out)})"


def apply_axis(df: DataFrame, column: str, matrix: np.ndarray, axis: str, out: str, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """out = matrix applied along an axis of column. shape (k, j, i) defaults to a cube of matrix's width."""
    n = matrix.shape[1]
    shape = shape or (n, n, n)
    if max(shape) <= UNROLLED:
        return df.withColumn(out, F.expr(_terms(column, matrix, AXES[axis], shape)))

    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.stack(s.to_numpy()).reshape(-1, *shape) if len(s) else np.zeros((0, *shape))
            y = np.moveaxis(np.tensordot(x, matrix, axes=([1 + AXES[axis]], [1])), -1, 1 + AXES[axis])
            yield pd.Series(list(y.reshape(len(s), -1)))

    return df.withColumn(out, F.pandas_udf(kernel, "array<double>")(F.col(column)))


def tensor(df: DataFrame, column: str | list[str], matrix: np.ndarray, out: str | list[str]) -> DataFrame:
    """(m x m x m) applied one axis after another, to one column or to several together, in
    slices of Arrow batches: three nested expressions would grow with the cube of the order, and
    a function in a column would run again in each filter that Spark infers of an explode behind it."""
    n = matrix.shape[1]
    columns, outs = [[x] if isinstance(x, str) else list(x) for x in (column, out)]

    def run(*parts: np.ndarray) -> list[np.ndarray]:
        made = []
        for part in parts:
            u = part.reshape(-1, n, n, n)
            for axis in (3, 2, 1):
                u = np.moveaxis(np.tensordot(u, matrix, axes=([axis], [1])), -1, axis)
            made.append(u)
        return made

    rows = in_pieces(df, columns, dict.fromkeys(outs, "array<double>"), run)
    return rows.select(*df.columns, *[c for c in outs if c not in df.columns])


def gradient_rst(df: DataFrame, column: str, n: int, transposed: bool = False) -> DataFrame:
    """Adds column_r, column_s, column_t: derivatives in reference coordinates, all of an Arrow batch together."""
    d = derivative(n).T if transposed else derivative(n)

    @F.pandas_udf("r array<double>, s array<double>, t array<double>")
    def kernel(values: pd.Series) -> pd.DataFrame:
        u = np.stack([np.asarray(v, float) for v in values]).reshape(-1, n, n, n) if len(values) else np.zeros((0, n, n, n))
        out = {a: np.moveaxis(np.tensordot(u, d, axes=([1 + k], [1])), -1, 1 + k) for a, k in AXES.items()}
        return pd.DataFrame({a: list(v.reshape(len(values), -1)) for a, v in out.items()})

    made = df.withColumn("_g", kernel(column))
    return made.select(*df.columns, *[F.col(f"_g.{a}").alias(f"{column}_{a}") for a in AXES])


def nodes(df: DataFrame, element: str, columns: list[str], n: int, names: list[str] | None = None) -> DataFrame:
    """Long form: element as e, k, j, i, and each array's value."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns]) if len(columns) > 1 else F.transform(F.col(columns[0]), lambda x: F.struct(x.alias(columns[0])))
    long = df.select(F.col(element).alias("e"), F.posexplode(zipped).alias("p", "v"))
    place = [F.expr(f"p div {n * n}").cast("int").alias("k"), (F.expr(f"p div {n}") % n).cast("int").alias("j"), (F.col("p") % n).cast("int").alias("i")]
    return long.select("e", *place, *[F.col("v")[c].alias(x) for c, x in zip(columns, names or columns, strict=True)])


def elements(long: DataFrame, value: str) -> DataFrame:
    """Back to a row per element: e and the array of value, ordered by (k, j, i)."""
    return long.groupBy("e").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "j", "i", value))), lambda x: x[value]).alias(value))


def linear_index(i: Column, j: Column, k: Column, e: Column, lx: int, ly: int, lz: int) -> Column:
    return i + lx * (j + ly * (k + lz * e))


def brick(long: DataFrame, nx: int = 8, ny: int = 8, n: int = 4) -> DataFrame:
    """Places elements in a brick, nx by ny in a layer: shared node ids gx, gy, gz
    and coordinates x, y, z of unit elements."""
    ex, ey, ez = F.col("e") % nx, F.expr(f"e div {nx}") % ny, F.expr(f"e div {nx * ny}")
    x = F.array(*[F.lit(float(v)) for v in (gll(n)[0] + 1) / 2])
    out = long
    for axis, cell, local in (("x", ex, "i"), ("y", ey, "j"), ("z", ez, "k")):
        out = out.withColumn(f"g{axis}", (cell * (n - 1) + F.col(local)).cast("long")).withColumn(axis, cell + F.element_at(x, F.col(local) + 1))
    return out


def mass(n: int) -> Column:
    """Product of the three quadrature weights of a node."""
    w = F.array(*[F.lit(float(v)) for v in gll(n)[1]])
    at = lambda c: F.element_at(w, F.col(c) + 1)
    return at("i") * at("j") * at("k")


def shared_sum(long: DataFrame, value: str, key: list[str], mode: str = "sum", weight: str | None = None) -> Column:
    """Gather-scatter over co-located nodes: sum, average (by multiplicity) or mass (weighted mean)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*key)
    if mode == "sum":
        return F.sum(value).over(w)
    if mode == "average":
        return F.avg(value).over(w)
    if mode == "mass":
        return F.sum(F.col(value) * F.col(weight)).over(w) / F.sum(weight).over(w)
    if mode == "multiplicity":
        return F.count(F.lit(1)).over(w)
    raise ValueError(mode)


def bounding_boxes(long: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Box per element, widened by extent * tolerance / 2 on each side."""
    box = long.groupBy("e").agg(*[f(c).alias(f"{c}_{s}") for c in "xyz" for f, s in ((F.min, "lo"), (F.max, "hi"))])
    for c in "xyz" if tolerance else "":
        margin = (F.col(f"{c}_hi") - F.col(f"{c}_lo")) * (tolerance / 2)
        box = box.withColumns({f"{c}_lo": F.col(f"{c}_lo") - margin, f"{c}_hi": F.col(f"{c}_hi") + margin})
    return box


def vertices(long: DataFrame, n: int) -> DataFrame:
    last = n - 1
    ends = [F.col(c).isin(0, last) for c in "kji"]
    v = (F.expr(f"i div {last}") + 2 * F.expr(f"j div {last}") + 4 * F.expr(f"k div {last}")).cast("int")
    return long.where(ends[0] & ends[1] & ends[2]).select("e", v.alias("vertex"), "x", "y", "z")


def entity_centres(long: DataFrame, n: int, kind: str) -> DataFrame:
    """Centres (middle of the extent per axis) of the 12 edges or 6 facets of each element."""
    last, rows = n - 1, []
    if kind == "facet":
        for f, (c, at) in enumerate([("i", 0), ("i", last), ("j", 0), ("j", last), ("k", 0), ("k", last)]):
            rows.append((f, {c: at}))
    else:
        pairs = [("j", "k"), ("i", "k"), ("i", "j")]
        for p, (a, b) in enumerate(pairs):
            for q, (x, y) in enumerate([(0, 0), (last, 0), (0, last), (last, last)]):
                rows.append((4 * p + q, {a: x, b: y}))
    on = [F.when(F.expr(" and ".join(f"{c} = {v}" for c, v in at.items())), F.lit(f)) for f, at in rows]
    spread = long.withColumn("entity", F.explode(F.array_compact(F.array(*on))))
    mid = [(F.min(c) + (F.max(c) - F.min(c)) / 2).alias(f"c{c}") for c in "xyz"]
    return spread.groupBy("e", F.col("entity").alias(kind)).agg(*mid)


def hex_cells(n: int, e: Column) -> Column:
    """The linear hexahedra of an element: array of arrays of 8 node ids (VTK order)."""
    node = lambda k, j, i: e * n**3 + F.lit(int((k * n + j) * n + i)).cast("long")
    corner = [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0)]
    return F.array(*[F.array(*[node(k + a, j + b, i + c) for a, b, c in corner]) for k, j, i in np.ndindex(n - 1, n - 1, n - 1)])
