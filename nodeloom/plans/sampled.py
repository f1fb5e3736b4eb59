"""Queries on Gaussian-process sampling with the covariances of elements and of groups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nodeloom.functions import spectral as sp
from nodeloom.operators import compression, sampling
from nodeloom.operators import elements as el
from nodeloom.operators import geometry as geo
from nodeloom.plans.catalogue import _INV, _V, N, SQL_NODES, _folder, _sql_deriv, arrays, brick_arrays, matrix, query
from nodeloom.plans.curved import _sql_metric


@query()
def gp_sampling(spark, d):
    """Sixteen nodes of each element by its own covariance, and the posterior mean."""
    s = sampling.sampled(arrays(spark, d), "u", N, 16)
    return s.select("e", F.size("nodes").alias("n"), F.size(F.array_distinct("nodes")).alias("different"), "nodes", "mean")


def _grouped(spark, d, kind: str):
    a = arrays(spark, d).withColumn("g", F.expr("e div 10"))
    return a.join(sampling.group_power(a, "u", N, F.col("g"), kind), "g")


@query()
def gp_group_mean(spark, d):
    """Samples by the covariance that ten elements share, with the posterior deviation."""
    return sampling.sampled(_grouped(spark, d, "mean"), "u", N, 12, power="power").select("e", "nodes", "mean", "std")


@query()
def gp_group_variance(spark, d):
    return sampling.sampled(_grouped(spark, d, "variance"), "u", N, 12, power="power").select("e", "nodes", "mean", "std")


@query(f"with {SQL_NODES} select e, true as same, true as near, true as surer from nodes where p = 0")
def gp_stored(spark, d):
    """Samples and group covariances, written and read: the reader has the writer's
    means, at a sampled node the value itself, and nowhere more doubt than before."""
    home = f"{_folder(spark)}/samples-{uuid.uuid4().hex}"
    rows = sampling.sampled(_grouped(spark, d, "variance"), "u", N, 12, power="power")
    compression.write_samples(rows.select("e", "g", "nodes", "samples"), home, {"n": N, "samples": 12})
    rows.select("g", "power").distinct().write.mode("overwrite").parquet(f"{home}/power")
    kept, settings = compression.read_samples(spark, home)
    got = sampling.regressed(kept.join(spark.read.parquet(f"{home}/power"), "g"), settings["n"], "power")
    both = got.join(rows.select("e", F.col("mean").alias("m"), F.col("std").alias("s")), "e")
    far = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    at = F.transform("nodes", lambda p: F.element_at("mean", p + 1))
    scale = F.array_max(F.transform("samples", lambda v: F.abs(v))) + 1e-12
    return both.select("e", (far("mean", "m") <= 1e-9 * scale).alias("same"), (far(at, "samples") <= 1e-3 * scale).alias("near"), (F.array_max(F.transform("nodes", lambda p: F.element_at("std", p + 1))) <= F.array_max("std") + 1e-12).alias("surer"))


_BACK = " ".join(f"t{n} as ({_sql_deriv(c, 'vt', s, x)})," for n, c, s, x in ((4, "i", "mm", "bu"), (5, "j", "t4", "v"), (6, "k", "t5", "v"))).rstrip(",")
_TO_MODES = " ".join(f"t{n} as ({_sql_deriv(c, 'vi', s, x)})," for n, c, s, x in ((1, "i", "mm", "u"), (2, "j", "t1", "v"), (3, "k", "t2", "v"))).rstrip(",")


@query(f"{_sql_metric({'u': 'u'})}, {matrix('vi', _INV)}, {matrix('vt', _V.T)}, mm as (select e, k, j, i, u, b*u as bu from m), {_TO_MODES}, {_BACK} select e, k, j, i, round(case when row_number() over (partition by e order by round(abs(t6.v), 9) desc, k, j, i) <= 16 then t3.v else 0 end, 5) as v from t3 join t6 using (e, k, j, i)")
def gradient_truncation(spark, d):
    """The sixteen coefficients of curved elements whose change changes the error by mass most."""
    rows = brick_arrays(spark, d)
    b = geo.with_mass(geo.metric(geo.with_derivatives(rows, [], N)), N).select("e", "k", "j", "i", "b")
    rows = sampling.coefficients(rows.join(el.elements(b, "b"), "e"), "u", N, "c")
    kept = sampling.truncated(rows, "c", "u", N, 16, "error", mass="b", out="v")
    return el.nodes(kept, "e", ["v"], N).withColumn("v", F.round("v", 5))


@query(f"with {SQL_NODES}, {matrix('m', sp.modal(N)[1])}, t1 as ({_sql_deriv('i', 'm')}), t2 as ({_sql_deriv('j', 'm', 't1', 'v')}), t3 as ({_sql_deriv('k', 'm', 't2', 'v')}) select e // 10 as g, cast(k*16+j*4+i as int) as p, round(case when count(*) > 1 then (sum(v*v) - sum(v)*sum(v)/count(*))/(count(*) - 1) else max(v*v) end, 6) as power from t3 group by 1, 2")
def group_covariance(spark, d):
    """Covariances that groups of ten elements share, as arrays."""
    g = sampling.group_power(arrays(spark, d), "u", N, F.expr("e div 10"), "variance")
    return g.select("g", F.posexplode("power").alias("p", "power")).select("g", "p", F.round("power", 6).alias("power"))
