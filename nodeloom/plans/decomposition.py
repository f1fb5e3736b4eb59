"""Queries on decompositions with a mass, extended modes, states that are kept, and projections."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from nodeloom.operators import rom
from nodeloom.plans.catalogue import N, SQL_NODES, SQL_W, _blocks, _folder, arrays, query


def _massive(spark, d):
    """Rows of the snapshot matrix with a mass: some have none."""
    return _blocks(spark, d).withColumn("mass", (F.col("row") % 7).cast("double"))


@query(f"with {SQL_NODES} select e as row, cast(p as int) as p, round(u*sqrt(case when e%7=0 then 1e-12::double else e%7 end), 6) as v from nodes")
def mass_scaling(spark, d):
    s = rom.scaled(_massive(spark, d), "a", "mass")
    return s.select("row", F.posexplode("a").alias("p", "v")).select("row", "p", F.round("v", 6).alias("v"))


@query()
def weighted_pod_sigma(spark, d):
    sigma, _, _ = rom.weighted_pod(_massive(spark, d), "row", "a", "mass", 64)
    return spark.createDataFrame([(k, float(s)) for k, s in enumerate(sigma)], "k int, sigma double")


@query(f"with {SQL_NODES} select round(sum(u*u*case when e%7=0 then 1e-12::double else e%7 end), 2) as energy from nodes")
def weighted_pod_energy(spark, d):
    """Sum of the squared singular values: the energy in the mass inner product."""
    s = weighted_pod_sigma(spark, d)
    return s.agg(F.round(F.sum(F.col("sigma") * F.col("sigma")), 2).alias("energy"))


@query()
def weighted_pod_modes(spark, d):
    _, _, modes = rom.weighted_pod(_massive(spark, d), "row", "a", "mass", 4)
    return modes.select("row", F.posexplode("mode").alias("k", "value"))


@query(f"with {SQL_NODES} select e as row, true as same from nodes where p = 0")
def pod_snapshots(spark, d):
    """All modes together give the snapshots back, up to rounding."""
    b = _blocks(spark, d)
    sigma, vt, modes = rom.pod(b, "row", "a", 64)
    back = rom.reconstructed(modes, "row", sigma, vt, "back").join(b, "row")
    return back.select("row", (F.array_max(F.zip_with("a", "back", lambda x, y: F.abs(x - y))) < 1e-9).alias("same"))


@query()
def extended_modes(spark, d):
    """Modes of another field (the squares) that go with the right vectors of the first."""
    b = _blocks(spark, d)
    sigma, vt, _ = rom.pod(b, "row", "a", 4)
    other = b.select("row", F.transform("a", lambda x: x * x).alias("q"))
    return rom.extended(other, "row", "q", sigma, vt).select("row", F.posexplode("mode").alias("k", "value"))


@query()
def perpendicular_ratio(spark, d):
    """How much of a snapshot the first modes of the others leave out."""
    b = _blocks(spark, d)
    _, _, modes = rom.pod(b.select("row", F.slice("a", 1, 32).alias("a")), "row", "a", 8)
    rows = modes.join(b.select("row", F.col("a")[40].alias("v")), "row")
    return spark.createDataFrame([(rom.perp_ratio(rows, "mode", "v"),)], "ratio double")


@query()
def pod_restart(spark, d):
    """A streaming decomposition that is written after two batches, read and gone on with."""
    home = f"{_folder(spark)}/pod-{uuid.uuid4().hex}"
    b = _blocks(spark, d)
    state = rom.StreamingPod("row", 16)
    for at in (0, 16):
        state.update(b.select("row", F.slice("a", at + 1, 16).alias("a")), "a")
    state.save(home)
    again = rom.StreamingPod.load(spark, home, "row", 16)
    for at in (32, 48):
        again.update(b.select("row", F.slice("a", at + 1, 16).alias("a")), "a")
    return spark.createDataFrame([(k, float(s)) for k, s in enumerate(again.sigma)], "k int, sigma double")


@query()
def pod_growing(spark, d):
    """Rank by the snapshots: each that the modes so far leave out adds one."""
    _folder(spark)
    state, b = rom.GrowingPod("row", 12, 2, 0.9), _blocks(spark, d)
    for at in range(0, 64, 8):
        state.update(b.select("row", F.slice("a", at + 1, 8).alias("a")), "a")
    return spark.createDataFrame([(k, float(s)) for k, s in enumerate(state.sigma)], "k int, sigma double")


def _local(spark, d, k: int):
    _folder(spark)
    state = rom.LocalPods(k)
    b = _blocks(spark, d).withColumn("block", F.expr("row div 100"))
    for at in range(0, 64, 16):
        state.update(b.select("block", "row", F.slice("a", at + 1, 16).alias("a")), "a")
    return state


@query(f"with {SQL_NODES} select e as row, cast(p as int) as p, round(u, 5) as v from nodes")
def pod_local_merge(spark, d):
    """Blocks of rows decomposed by themselves in four batches, merged: together the modes make up the snapshots."""
    sigma, vt, modes = _local(spark, d, 64).merge(64)
    back = rom.reconstructed(modes, "row", sigma, vt, "v")
    return back.select("row", F.posexplode("v").alias("p", "v")).select("row", "p", F.round("v", 5).alias("v"))


@query(f"with {SQL_NODES} select round(sum(u*u), 2) as energy from nodes")
def pod_local_energy(spark, d):
    """Sum of the squared singular values after the merge."""
    sigma, _, _ = _local(spark, d, 64).merge(64)
    return spark.createDataFrame([(round(float(np.square(sigma).sum()), 2),)], "energy double")


def _mass_sql() -> str:
    return f"with {SQL_NODES}, {SQL_W} select e, round(sum(u*u*a.w*b.w*c.w), 6) as energy from nodes n join w a on a.a=n.i join w b on b.a=n.j join w c on c.a=n.k group by e"


@query(_mass_sql())
def mass_energy(spark, d):
    """Energy of each element in the quadrature inner product."""
    from nodeloom.operators import solver

    w = F.array(*[F.lit(float(x)) for x in solver.weights(N)])
    return arrays(spark, d).select("e", F.round(F.aggregate(F.zip_with("u", w, lambda x, y: x * x * y), F.lit(0.0), lambda s, x: s + x), 6).alias("energy"))
