"""Queries on registries, search structures, a singular system, streams, JSON and aggregates of one's own."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from nodeloom.operators import elements as el
from nodeloom.operators import rom, search
from nodeloom.operators import statistics as st
from nodeloom.plans.catalogue import N, SQL_NODES, SQL_PROBES, _blocks, _folder, _probes, arrays, brick_arrays, query, table
from nodeloom.sources import fieldfile, registry
from nodeloom.streaming import pipelines


def _home(spark, name: str) -> str:
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"with {SQL_NODES} select e, k, j, i, round(u, 6) as vel_0, round(3*u, 4) as temp, round(cast(u as float)::double, 6) as scal_0 from nodes")
def registry_fields(spark, d):
    """Columns added from an expression, from a table, and from field files; one renamed."""
    a, path = arrays(spark, d), _home(spark, "field") + ".fld"
    registry.write_data(a.select("e", F.transform("u", lambda v: v * 3).alias("t")), path, shape=(N, N, N))
    out = registry.rename_field(a, "u", "vel_0")
    out = registry.add_field(out, "temp", path, "t")
    out = registry.add_field(out, "scal_0", a, "u", dtype="array<float>")
    out = registry.add_field(out, "scal_0", F.col("scal_0").cast("array<double>"))
    n = el.nodes(out, "e", ["vel_0", "temp", "scal_0"], N)
    return n.select("e", "k", "j", "i", F.round("vel_0", 6).alias("vel_0"), F.round("temp", 4).alias("temp"), F.round("scal_0", 6).alias("scal_0"))


_IN = "p.x >= v.e%8 and p.x <= v.e%8+1 and p.y >= (v.e//8)%8 and p.y <= (v.e//8)%8+1 and p.z >= v.e//64 and p.z <= v.e//64+1"


@query(f"with {SQL_PROBES}, v as (select vec_id as e from embeddings) select p.probe_id, v.e from pr p join v on {_IN}")
def ball_candidates(spark, d):
    """Candidates by balls around the centres of boxes, refined by the boxes."""
    mesh = brick_arrays(spark, d, 0.0)
    return search.ball_candidates(_probes(spark, d), mesh).select("probe_id", "e")


@query(f"with {SQL_PROBES}, v as (select vec_id as e from embeddings) select p.probe_id, v.e from pr p join v on {_IN}")
def oriented_candidates(spark, d):
    """The same after oriented boxes, which along straight elements hold all of them."""
    mesh = brick_arrays(spark, d, 0.0)
    found = search.structure("boxes")(_probes(spark, d).select("probe_id", "x", "y", "z"), mesh)
    return search.refine_oriented(found, search.oriented_boxes(mesh, N)).select("probe_id", "e")


# --- streams ------------------------------------------------------------------
@query("select event_type, epoch(time_bucket(interval '6 hours', ts))::bigint as starts, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def stream_windows(spark, d):
    """Tumbling windows over a stream of steps; nothing is late enough to be left out."""
    src, out = _home(spark, "steps"), _home(spark, "windows")
    events = table(spark, d, "events")
    events.select("event_type", "ts", "value").repartition(3).write.parquet(src)
    stream = pipelines.windowed(pipelines.steps(spark, src, "event_type string, ts timestamp, value double"), "ts", "3650 days", "6 hours", "event_type", "value")
    pipelines.fold(stream.select("event_type", F.unix_timestamp("window.start").alias("starts"), "n", "total"), out, f"{out}-log")
    last = spark.read.option("recursiveFileLookup", "true").parquet(out).groupBy("event_type", "starts").agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return last.select("event_type", "starts", "s.n", F.round("s.total", 2).alias("total"))


@query()
def stream_pod(spark, d):
    """Snapshots that arrive as a stream feed a streaming decomposition."""
    src, log = _home(spark, "snapshots"), _home(spark, "log")
    b = _blocks(spark, d)
    state = rom.StreamingPod("row", 16)
    for at in range(0, 64, 16):
        b.select("row", F.slice("a", at + 1, 16).alias("a")).repartition(4).write.mode("append").parquet(src)
        pipelines.stream_pod(pipelines.steps(spark, src, "row long, a array<double>", 4), state, "row", "a", log)
    return spark.createDataFrame([(k, float(s)) for k, s in enumerate(state.sigma)], "k int, sigma double")


def _write_steps(spark, d, folder: str, first: int, last: int) -> None:
    """Field files of some steps: at step s the values are u (1 + s (p % 3))."""
    for s in range(first, last):
        a = arrays(spark, d).select("e", F.expr(f"transform(u, (v, p) -> v * (1 + {s} * (p % 3)))").alias("t"))
        fieldfile.write_field(a, f"{folder}/step{s:05d}", (N, N, N), time=0.5 * s, step=s, files=2)


@query(f"with {SQL_NODES} select e, k, j, i, cast(s as bigint) as step, s*0.5::double as time, round(u*(1 + s*(p%3)), 5) as t from nodes, range(4) q(s)")
def stream_field_files(spark, d):
    """Steps of field files as a stream: two are there at first, two come before the query starts again."""
    folder, out = _home(spark, "steps"), _home(spark, "fields")
    for first, last in ((0, 2), (2, 4)):
        _write_steps(spark, d, folder, first, last)
        pipelines.drain(pipelines.field_steps(spark, folder, "t"), out, f"{out}-log")
    got = spark.read.schema("step long, e long, time double, t array<double>").parquet(out)
    n = got.select("step", "time", "e", F.posexplode("t").alias("p", "t"))
    return n.select("e", F.expr("p div 16").cast("int").alias("k"), F.expr("p div 4 % 4").cast("int").alias("j"), (F.col("p") % 4).alias("i"), "step", "time", F.round("t", 5).alias("t"))


@query(f"with {SQL_NODES} select round(sum(power(u*(1 + s*(p%3)), 2)), 1) as energy, 4 as snapshots from nodes, range(4) q(s) having count(*) > 0")
def stream_field_pod(spark, d):
    """A decomposition of field files as they come, whose state is a table of the
    last batch: a query that starts again goes on from there."""
    folder, state, log = _home(spark, "steps"), _home(spark, "state"), _home(spark, "log")
    _folder(spark)
    for first, last in ((0, 2), (2, 4)):
        _write_steps(spark, d, folder, first, last)
        pipelines.kept_pod(pipelines.field_steps(spark, folder, "t"), "t", N**3, state, log, 8)
    right = pipelines.kept_state(spark, state)
    return right.select(F.explode("sigma").alias("s"), F.size("steps").alias("snapshots")).groupBy("snapshots").agg(F.round(F.sum(F.col("s") * F.col("s")), 1).alias("energy"))


# --- JSON, aggregates, sorting --------------------------------------------------
@query("select p_partkey, json_object('size', p_size, 'brand', p_brand)::varchar as settings, p_size * 2 as twice from part")
def settings_json(spark, d):
    """Settings as JSON texts, written and read back."""
    p = table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))).alias("settings"))
    back = F.from_json("settings", "size int, brand string")
    return p.select("p_partkey", "settings", (back["size"] * 2).alias("twice"))


@query("select l_suppkey, round(sqrt(avg(l_quantity*l_quantity)), 6) as rms, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, max(l_quantity)::double as top from lineitem group by 1")
def own_aggregates(spark, d):
    """Root mean square, slope of a fitted line and maximum by functions of the
    user's: states of parts of the rows that merge."""
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))

    def part(c):
        x, y = c["x"], c["y"]
        return np.array([len(x), x.sum(), y.sum(), (x * x).sum(), (x * y).sum(), x.max()])

    def merge(a, b):
        return np.append(a[:5] + b[:5], max(a[5], b[5]))

    def finish(s):
        n, x, y, xx, xy, top = s
        return (xx / n) ** 0.5, (n * xy - x * y) / (n * xx - x * x) if n * xx > x * x else None, top

    t = st.own_aggregate(rows, ["l_suppkey"], ["x", "y"], part, merge, finish, {"rms": "double", "slope": "double", "top": "double"}, gather=True)
    return t.select("l_suppkey", F.round("rms", 6).alias("rms"), F.round("slope", 4).alias("slope"), "top")


@query("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 25")
def largest_prices(spark, d):
    """A top-k report: what sorts, and keeps, the first rows only."""
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25)
