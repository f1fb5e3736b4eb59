"""A sequence of fields on one mesh: operate on each, then sample the results at
probes that were located once.

What does not change with time is prepared once: the elements' coordinates, the
places that their nodes share with others, and the probes in them, as tables that
are bucketed by element. A field of a step is dealt by element into as many
buckets and then meets them without moving them. Only values of shared nodes are
sent from element to element."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.spectral import gll, lagrange_rows
from nodeloom.operators.connectivity import place
from nodeloom.operators.elements import in_pieces, lists_of, nodes, pieces, spark_types, values_of
from nodeloom.operators.geometry import _grad, _stack, _terms
from nodeloom.operators.statistics import boxes_meet, hull_of, locate
from nodeloom.sources.fieldfile import read_steps, steps_of


TOGETHER = 1000  #: probes of an element in a row, about; an element with more has several rows


NAMED = 200_000  #: elements that hold or touch a probe, up to which a field is thinned to them before it is dealt


@dataclass
class Prepared:
    """Tables by element, of the elements that hold probes and those that share a
    node with one of these: geometry (xs, ys, zs), classes (probed: whether it
    holds probes; shared: p, label and copies of each node that an element with
    probes shares) and probes (arrays of probe_id, r, s, t); and the probes that no
    element holds. near: the ids of these elements, if they are at most NAMED."""

    geometry: DataFrame
    classes: DataFrame
    probes: DataFrame
    lost: DataFrame
    n: int
    buckets: int
    near: DataFrame | None = None


def _bucketed(df: DataFrame, folder: str, name: str, buckets: int, by: str = "e") -> DataFrame:
    spark = df.sparkSession
    table = f"{name}_{hashlib.md5(folder.encode()).hexdigest()}"
    df.write.mode("overwrite").bucketBy(buckets, by).sortBy(by).option("path", f"{folder}/{name}").saveAsTable(table)
    return spark.table(table)


def prepare(spark: SparkSession, mesh: DataFrame, probes: DataFrame, n: int, folder: str, tol: float = 1e-7, buckets: int = 8) -> Prepared:
    """mesh: e, xs, ys, zs; probes: probe_id, x, y, z. Tables go to folder, which
    all machines have to see. buckets should give each task some MB of a field.
    Values at probes come from their elements and what those share, so nodes are
    matched only where boxes touch the hull of the elements with probes."""
    locate(probes, mesh, n).select("probe_id", "e", "r", "s", "t").write.mode("overwrite").parquet(f"{folder}/located")
    located = spark.read.parquet(f"{folder}/located")
    inside = located.where("e is not null").select("e", F.struct("probe_id", "r", "s", "t").alias("q"))
    many = inside.groupBy("e").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("_parts"))
    dealt = inside.join(many, "e").withColumn("_part", F.pmod(F.xxhash64("q.probe_id"), F.col("_parts")))
    found = _bucketed(dealt.groupBy("e", "_part").agg(F.collect_list("q").alias("probes")).select("e", "probes"), folder, "probes", buckets)
    ids = found.select("e").distinct()
    hull = hull_of(mesh.join(ids, "e", "left_semi").select(*[F.array_min(f"{c}s").alias(c) for c in "xyz"], *[F.array_max(f"{c}s").alias(f"{c}_2") for c in "xyz"]), {c: (c, f"{c}_2") for c in "xyz"})
    near = mesh.where(boxes_meet(hull, {c: (F.array_min(f"{c}s"), F.array_max(f"{c}s")) for c in "xyz"}, 2 * tol)).select("e", "xs", "ys", "zs")
    long = nodes(near, "e", ["xs", "ys", "zs"], n, ["x", "y", "z"]).withColumn("node", F.expr(f"e * {n**3} + (k * {n} + j) * {n} + i"))
    rim = long.where(" or ".join(f"{c} in (0, {n - 1})" for c in "kji"))  # inner nodes are shared with none
    labelled = place(rim, "node", ["x", "y", "z"], tol).withColumn("e", F.expr(f"node div {n**3}"))
    labelled = labelled.join(ids.withColumn("probed", F.lit(True)), "e", "left")
    copies = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("copies"), F.max("probed").alias("_asked")).where("copies > 1 and _asked").drop("_asked")
    shared = labelled.join(copies, "label").select("e", F.struct((F.col("node") % n**3).cast("int").alias("p"), "label", "copies").alias("s"))
    each = shared.unionByName(ids.withColumn("s", F.lit(None).cast(shared.schema["s"].dataType))).groupBy("e").agg(F.array_sort(F.collect_list("s")).alias("shared"))
    classes = _bucketed(each.join(ids.withColumn("probed", F.lit(True)), "e", "left").select("e", F.coalesce("probed", F.lit(False)).alias("probed"), "shared"), folder, "classes", buckets)
    geometry = _bucketed(near.join(classes.select("e"), "e", "left_semi"), folder, "geometry", buckets)
    near = None
    if classes.count() <= NAMED:
        classes.select("e").write.mode("overwrite").parquet(f"{folder}/near")
        near = spark.read.parquet(f"{folder}/near")
    return Prepared(geometry, classes, found, located.where("e is null").select("probe_id"), n, buckets, near)


def dealt(p: Prepared, rows: DataFrame) -> DataFrame:
    """rows (e and arrays of a field) of the elements that count, by element in as many parts as there are buckets."""
    if p.near is not None:
        rows = rows.join(F.broadcast(p.near), "e", "left_semi")
    return rows.repartition(p.buckets, "e")


def derivatives(p: Prepared, step: DataFrame, fields: list[str]) -> DataFrame:
    """step (e and an array per field) with d<f>dx, d<f>dy, d<f>dz of each field, element by element."""
    made = [f"d{f}d{c}" for f in fields for c in "xyz"]
    n = p.n

    def derive(*parts: np.ndarray) -> list[np.ndarray]:
        inverse, _, _ = _terms(np.stack([_stack(c, n) for c in parts[:3]], axis=1), n)
        out = []
        for part in parts[3:]:
            g = np.einsum("eackji,eakji->eckji", inverse, _grad(_stack(part, n), n))
            out += [g[:, k] for k in range(3)]
        return out

    return in_pieces(dealt(p, step).join(p.geometry.hint("merge"), "e"), ["xs", "ys", "zs", *fields], dict.fromkeys(made, "array<double>"), derive, keep=step.columns)


def averaged(p: Prepared, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of elements with probes, the values of shared nodes replaced by their
    mean over all copies (gather-scatter, divided by the multiplicity). Per element
    the shared values go out by place and come back as sums."""
    met = rows.join(p.classes.hint("merge"), "e")
    out = met.select("e", "probed", F.explode("shared").alias("s"), *columns).select("e", "probed", "s.p", "s.label", "s.copies", *[F.element_at(c, F.col("s.p") + 1).alias(c) for c in columns])
    sums = out.groupBy("label").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    back = out.where("probed").select("e", "p", "label", "copies").join(sums, "label").select("e", F.struct("p", *[(F.col(f"_{c}") / F.col("copies")).alias(c) for c in columns]).alias("m"))
    back = back.repartition(p.buckets, "e").groupBy("e").agg(F.array_sort(F.collect_list("m")).alias("_means"))
    whole = met.where("probed").join(back, "e", "left")

    rest = [c for c in rows.columns if c not in columns]

    def put(batches):
        import pyarrow as pa

        for b in pieces(batches):
            means = b.column("_means")
            row = np.repeat(np.arange(b.num_rows), means.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at, *new = means.flatten().flatten()
            at, out = at.to_numpy(zero_copy_only=False), []
            for c, v in zip(columns, new, strict=True):
                whole = values_of(b.column(c)).copy()
                whole[row, at] = v.to_numpy(zero_copy_only=False)
                out.append(lists_of(whole))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], *out], names=[*rest, *columns])

    return whole.select(*rest, "_means", *columns).mapInArrow(put, spark_types(rows.select(*rest), dict.fromkeys(columns, "array<double>")))


def products(rows: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds node-wise products of two fields."""
    return rows.withColumns({k: F.zip_with(a, b, lambda x, y: x * y) for k, (a, b) in wanted.items()})


def sampled(p: Prepared, rows: DataFrame, columns: list[str], steps: list[tuple[int, float]] | None = None) -> DataFrame:
    """probe_id and the value of each column; 0 for probes that no element holds.
    With steps (step and time of each) rows have a step, and so has the result."""
    n, x = p.n, gll(p.n)[0]

    more = [] if steps is None else ["step", "time"]

    def at(batches):
        import pyarrow as pa

        for b in pieces(batches):
            held = b.column("probes")
            ends = np.concatenate([[0], np.cumsum(held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            ids, *place = held.flatten().flatten()
            r, s, t = (lagrange_rows(x, v.to_numpy(zero_copy_only=False)) for v in place)
            weights = np.einsum("pk,pj,pi->pkji", t, s, r).reshape(len(row), n**3)
            grid = np.stack([values_of(b.column(c)) for c in columns], axis=2)
            values = np.zeros((len(row), len(columns)))
            for k in np.flatnonzero(np.diff(ends)):  # an element's probes together
                values[ends[k] : ends[k + 1]] = weights[ends[k] : ends[k + 1]] @ grid[k]
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(of) for c in more], ids, *[pa.array(np.ascontiguousarray(v)) for v in values.T]], names=[*more, "probe_id", *columns])

    # An element's fields meet its probes once; only values leave the task.
    met = p.probes.hint("merge").join(rows, "e")
    kinds = ", ".join([*[f"{c} {t}" for c, t in zip(more, ("long", "double"), strict=False)], "probe_id long", *[f"{c} double" for c in columns]])
    if steps is None:
        got = met.select("probes", *columns).mapInArrow(at, kinds)
        return got.unionByName(p.lost.select("probe_id", *[F.lit(0.0).alias(c) for c in columns]))
    got = met.select(*more, "probes", *columns).mapInArrow(at, kinds)
    each = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("step"), F.lit(float(t)).alias("time")) for s, t in steps])) if steps else F.explode(F.array().cast("array<struct<step:bigint,time:double>>"))
    return got.unionByName(p.lost.select("probe_id", each.alias("s")).select("s.*", "probe_id", *[F.lit(0.0).alias(c) for c in columns]))


def operate(p: Prepared, step: DataFrame, fields: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """One step: fields, their continuous derivatives in space and their products, at the probes."""
    made = [f"d{f}d{c}" for f in fields for c in "xyz"]
    rows = products(averaged(p, derivatives(p, step, fields), made), pairs)
    return sampled(p, rows, [*fields, *made, *pairs])



def sample_files(p: Prepared, folder: str, keys: list[str]) -> DataFrame:
    """step, time, probe_id and the value of each variable, of all field files in a
    folder of steps: one plan, in which files are read by element ranges."""
    spark = p.geometry.sparkSession
    steps = [(s, files[0][1]["time"]) for s, files in steps_of(folder).items()]
    rows = dealt(p, read_steps(spark, folder, ",".join(keys)))
    return sampled(p, rows, keys, steps)
