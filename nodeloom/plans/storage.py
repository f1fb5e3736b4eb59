"""Queries on files: fields in several files, containers, probe results,
compressed samples, the statistics' places in files, routing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nodeloom.operators import budgets as bg
from nodeloom.operators import compression, connectivity, routing, sequence, transform_codec
from nodeloom.operators import elements as el
from nodeloom.operators import geometry as geo
from nodeloom.operators import statistics as st
from nodeloom.plans.catalogue import _INV, _KEYS, N, QUERIES, SQL, SQL_D, SQL_NODES, SQL_PROBES, _folder, _located, _probes, _sql_deriv, _sql_lagrange, arrays, brick_arrays, matrix, on_brick, query, table
from nodeloom.plans.meshes import _shaken
from nodeloom.sources import averages, container, fieldfile, probes, registry


def _home(spark, name: str) -> str:
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"with {SQL_NODES} select e, k, j, i, round(u, 6) as x, round(2*u, 6) as t, round(e - u, 6) as s1, 2.5::double as time from nodes")
def field_files(spark, d):
    """A field written by tasks, a file each, and read back by element ranges: variables x, t and s1 of five."""
    a = arrays(spark, d).withColumn("c", F.col("e").cast("double")).selectExpr("e", "u as x", "u as y", "u as z", "transform(u, v -> 2 * v) as t", "u as s0", "transform(u, v -> c - v) as s1")
    path = _home(spark, "field")
    fieldfile.write_field(a, path, (N, N, N), time=2.5, step=3)
    got = fieldfile.read_field(spark, path, "x,t,s1", 3)
    time = fieldfile.read_header(fieldfile.files_of(path)[0])["time"]
    return el.nodes(got, "e", ["x", "t", "s1"], N).select("e", "k", "j", "i", *[F.round(c, 6).alias(c) for c in ("x", "t", "s1")], F.lit(time).alias("time"))


@query(f"with {SQL_NODES} select e, j, i, round(cast(u as float)::double, 4) as u, round(cast(3*u as float)::double, 4) as v from nodes where k = 0")
def field_files_2d(spark, d):
    """A two-dimensional field in single precision."""
    a = arrays(spark, d).selectExpr("e", "slice(u, 1, 16) as x", "slice(u, 1, 16) as y", "slice(u, 1, 16) as u", "transform(slice(u, 1, 16), q -> 3 * q) as v")
    path = _home(spark, "field")
    fieldfile.write_field(a, path, (N, N, 1), wdsz=4, files=2)
    got = fieldfile.read_field(spark, path, "u,v")
    rows = got.select("e", F.posexplode(F.arrays_zip("u", "v")).alias("p", "q"))
    return rows.select("e", F.expr("p div 4").cast("int").alias("j"), (F.col("p") % 4).cast("int").alias("i"), F.round("q.u", 4).alias("u"), F.round("q.v", 4).alias("v"))


@query(f"with {SQL_NODES} select e as row, cast((k-1)*4 + (i-1)*1 + (j-2)*2 as int) as place, round(u, 6) as v from nodes where e >= 10 and e < 60 and k >= 1 and k < 3 and j >= 2 and i >= 1 and i < 2")
def container_slices(spark, d):
    """A dataset with four axes in a group; elements 10 to 59 and a block of each are read."""
    root, rows = _home(spark, "container"), arrays(spark, d).select(F.col("e").alias("row"), F.col("u").alias("v"))
    container.write_dataset(rows, root, "u", [rows.count(), 4, 4, 4], group="fields/step0")
    got = container.read_dataset(spark, root, "u", "fields/step0", (10, 60), [(1, 3), (2, 4), (1, 2)])
    cut = got.select("row", F.posexplode("v").alias("q", "v"))
    return cut.select("row", F.expr("cast((q div 2) * 4 + (q % 2) * 2 as int)").alias("place"), F.round("v", 6).alias("v"))


@query(f"with {SQL_NODES} select e as row, cast(p as int) as p, round(case when k in (1, 2) and e % 3 = 0 then -u when k < 2 then u when e % 2 = 0 then 2*u else 0 end, 6) + 0.0 as v from nodes")
def container_regions(spark, d):
    """A dataset that writers fill by regions: the lower half of all elements, the
    upper half of even ones, and over both the middle of every third."""
    root, rows = _home(spark, "container"), arrays(spark, d).select(F.col("e").alias("row"), F.col("u").alias("v"))
    container.create_dataset(spark, root, "u", [rows.count(), 4, 4, 4], group="fields")
    of = lambda e: F.expr(f"transform(v, x -> x * {e})")
    part = lambda df, low, high, e: df.select("row", F.slice(of(e), 16 * low + 1, 16 * (high - low)).alias("v"))
    for df, low, high, factor, layer in ((rows.where("row % 3 = 0"), 1, 3, -1, 1), (rows, 0, 2, 1, 0), (rows.where("row % 2 = 0"), 2, 4, 2, 0)):
        container.write_slices(part(df, low, high, factor), root, "u", "fields", [(low, high), (0, 4), (0, 4)], layer)
    got = container.read_filled(spark, root, "u", "fields")
    return got.select("row", F.posexplode("v").alias("p", "v")).select("row", "p", (F.round("v", 6) + 0.0).alias("v"))


@query(f"with {SQL_NODES} select e, k, j, i, round(u, 6) as u, round(u*u, 6) as q from nodes")
def registry_containers(spark, d):
    """Fields written and read by the ending of a container's name."""
    path = _home(spark, "fields") + ".hdf5"
    registry.write_data(arrays(spark, d).withColumn("q", F.transform("u", lambda x: x * x)), path, shape=(N, N, N))
    return el.nodes(registry.read_data(spark, path), "e", ["u", "q"], N).select("e", "k", "j", "i", *[F.round(c, 6).alias(c) for c in ("u", "q")])


@query(SQL["global_cells"])
def stored_cells(spark, d):
    """Global hexahedra in a mesh file, read through a second one that points to it."""
    one, two = _home(spark, "mesh"), _home(spark, "mesh")
    container.write_cells(connectivity.global_cells(connectivity.numbered_places(_shaken(spark, d), "node", ["x", "y", "z"], 1e-7), "node", N), one)
    container.link_mesh(spark, two, one)
    return container.read_cells(spark, two).select("e", "cell", F.posexplode("ids").alias("corner", "place"))


@query(f"with {SQL_NODES} select e, cast(p as int) as p, round(u, 6) as x, round(2*u, 6) as a, round(u*u, 6) as b from nodes")
def mesh_container(spark, d):
    """Two mesh files, the second with the points of the first."""
    one, two = _home(spark, "mesh"), _home(spark, "mesh")
    rows = arrays(spark, d).select("e", F.posexplode("u").alias("p", "u"))
    container.write_mesh(rows.select("e", "p", F.col("u").alias("x"), F.col("u").alias("y"), F.col("u").alias("z")), one)
    container.link_mesh(spark, two, one)
    container.write_point_data(rows.select("e", "p", (F.col("u") * 2).alias("value")), two, "a")
    container.write_point_data(rows.select("e", "p", (F.col("u") * F.col("u")).alias("value")), two, "b")
    got = container.read_point_data(spark, two, ["a", "b"])
    return got.select("e", "p", *[F.round(c, 6).alias(c) for c in ("x", "a", "b")])


_VALUE = SQL["probe_interpolation"].rsplit("round(coalesce(sum(", 1)
_SEQUENCE = _VALUE[0].rsplit("select probe_id, ", 1)[0] + ", one as (select probe_id, coalesce(sum(" + _VALUE[1].replace(", 0), 6) as value", ", 0) as value") + ") select probe_id, s*0.5::double as time, round((s + 1)*value, 5) as value from one, range(3) t(s)"


def _steps(spark, d):
    a = arrays(spark, d).select("e", "u", F.explode(F.array(*[F.lit(s) for s in range(3)])).alias("s"))
    return a.select((F.col("s") * 0.5).alias("time"), "e", F.transform("u", lambda v: v * (F.col("s") + 1)).alias("u"))


@query(_SEQUENCE)
def interpolate_sequence(spark, d):
    """Three fields at probes that are located once; the values go to a file per time and come back."""
    out = _home(spark, "probes")
    values = probes.interpolate_sequence(_located(spark, d), _steps(spark, d), "u", N)
    probes.write_values(values, out)
    got = probes.read_values(spark, out, "probe_id long, value double, time double")
    return got.select("probe_id", "time", F.round("value", 5).alias("value"))


# Operating on each field before it is sampled: derivatives of the straight brick are those of the reference
# coordinates times two, made continuous over shared nodes.
_OPERATED_G = ", ".join(f"g{c} as ({_sql_deriv(a)})" for c, a in zip("xyz", "ijk", strict=True))
_OPERATED = f"with {SQL_PROBES}, q as (select probe_id, e, 2*(x-floor(x))-1 as r, 2*(y-floor(y))-1 as s, 2*(z-floor(z))-1 as t from lo), b as (select probe_id, e, [{', '.join(_sql_lagrange('r'))}] as lr, [{', '.join(_sql_lagrange('s'))}] as ls, [{', '.join(_sql_lagrange('t'))}] as lt from q), {SQL_NODES}, {SQL_D}, {_OPERATED_G}, g as (select n.*, " + ", ".join(f"avg(2*g{c}.v) over (partition by {_KEYS}) as d{c}" for c in "xyz") + " from nodes n join gx using (e, k, j, i) join gy using (e, k, j, i) join gz using (e, k, j, i)), one as (select probe_id, " + ", ".join(f"coalesce(sum(lr[i+1]*ls[j+1]*lt[k+1]*{c}), 0) as {n}" for n, c in (("u", "u"), ("uu", "u*u"), ("dudx", "dx"), ("dudy", "dy"), ("dudz", "dz"))) + " from b left join g using (e) group by probe_id) select probe_id, s*0.5::double as time, round((s+1)*u, 5) as u, round((s+1)*(s+1)*uu, 4) as uu, " + ", ".join(f"round((s+1)*dud{c}, 4) as dud{c}" for c in "xyz") + " from one, range(2) t(s)"


@query(_OPERATED)
def operate_sequence(spark, d):
    """Continuous gradients and products of two fields in time, sampled at probes; mesh, shared nodes and probes stay in their buckets."""
    mesh = brick_arrays(spark, d, 0.0)
    ready = sequence.prepare(spark, mesh.select("e", "xs", "ys", "zs"), _probes(spark, d), N, _home(spark, "sequence"))
    out = None
    for s in range(2):
        step = arrays(spark, d).select("e", F.expr(f"transform(u, v -> v * {s + 1})").alias("u"))
        got = sequence.operate(ready, step, ["u"], {"uu": ("u", "u")}).withColumn("time", F.lit(s * 0.5))
        out = got if out is None else out.unionByName(got)
    return out.select("probe_id", "time", F.round("u", 5).alias("u"), F.round("uu", 4).alias("uu"), *[F.round(f"dud{c}", 4).alias(f"dud{c}") for c in "xyz"])


@query(f"with {SQL_PROBES} select probe_id, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, 0 as err_code from lo where e is null")
def probe_warnings(spark, d):
    """The report of probes that no element holds."""
    out = _home(spark, "probes")
    located = _located(spark, d)
    probes.write_warnings(located, out)
    got = spark.read.schema("probe_id long, x double, y double, z double, err_code int, test_error double").json(f"{out}/warnings")
    return got.select("probe_id", *[F.round(c, 6).alias(c) for c in "xyz"], "err_code")


@query("select event_id as probe_id, round((event_id%83)*0.0973::double+0.0131::double, 6) as x, round((event_id%59)*0.1351::double+0.0171::double, 6) as y, round((event_id%37)*0.2113::double+0.0117::double, 6) as z from events")
def probe_coordinates(spark, d):
    out = _home(spark, "probes")
    probes.write_coordinates(_probes(spark, d), out)
    got = spark.read.schema("probe_id long, x double, y double, z double").option("header", True).csv(f"{out}/coordinates")
    return got.select("probe_id", *[F.round(c, 6).alias(c) for c in "xyz"])


# --- compressed samples -----------------------------------------------------------
@query(f"with {SQL_NODES} select e, k, j, i, u from nodes")
def stored_samples(spark, d):
    """Payloads with their settings, written and read."""
    home = _home(spark, "samples")
    compression.write_samples(arrays(spark, d).select("e", compression.pack("u").alias("payload")), home, {"n": N, "codec": "bz2"})
    got, settings = compression.read_samples(spark, home)
    return el.nodes(got.select("e", compression.unpack("payload").alias("u")), "e", ["u"], settings["n"])


@query("select vec_id as e, true as near from embeddings")
def stored_bitplanes(spark, d):
    """Planes of 20 bits, written and read: within half a step of the values."""
    home = _home(spark, "samples")
    rows = arrays(spark, d).select("e", compression.bitplane_payload("u", 20).alias("p")).select("e", "p.*")
    compression.write_samples(rows, home, {"bits": 20, "n": N**3})
    got, s = compression.read_samples(spark, home)
    back = got.select("e", (F.col("high") - F.col("low")).alias("width"), compression.from_payload("low", "high", "data", s["n"], s["bits"]).alias("v")).join(arrays(spark, d), "e")
    far = F.array_max(F.zip_with("u", "v", lambda a, b: F.abs(a - b)))
    return back.select("e", (far <= F.col("width") / (2 ** s["bits"] - 1) * 0.5001 + 1e-12).alias("near"))


_TOLERANCES = (1e-1, 1e-3, 1e-6)


@query("select vec_id as e, tolerance, true as within, true as smaller from embeddings, (values " + ", ".join(f"({t!r}::double)" for t in _TOLERANCES) + ") t(tolerance)")
def block_codec(spark, d):
    """Payloads of fixed accuracy, written and read: each value within the
    tolerance, and a payload no larger than that of the next tolerance."""
    home, out = _home(spark, "samples"), None
    for t in _TOLERANCES:
        packed = arrays(spark, d).select("e", F.lit(t).alias("tolerance"), transform_codec.packed("u", N, tolerance=t).alias("payload"))
        out = packed if out is None else out.unionByName(packed)
    compression.write_samples(out, home, {"n": N, "codec": "blocks"})
    got, settings = compression.read_samples(spark, home)
    back = got.withColumn("v", transform_codec.unpacked("payload", settings["n"])).join(arrays(spark, d), "e")
    size = F.lead(F.octet_length("payload")).over(W.partitionBy("e").orderBy(F.desc("tolerance")))
    return back.select("e", "tolerance", (F.array_max(F.zip_with("u", "v", lambda a, b: F.abs(a - b))) <= F.col("tolerance")).alias("within"), F.coalesce(F.octet_length("payload") <= size, F.lit(True)).alias("smaller"))


@query("select vec_id as e, planes, cast(3 + case when planes > 0 then 8*(planes + 1) else 0 end as int) as size from embeddings, (values (0), (6), (20)) p(planes)")
def block_codec_rates(spark, d):
    """Payloads of a fixed rate: as large for every element."""
    out = None
    for p in (0, 6, 20):
        packed = arrays(spark, d).select("e", F.lit(p).alias("planes"), F.octet_length(transform_codec.packed("u", N, planes=p)).alias("size"))
        out = packed if out is None else out.unionByName(packed)
    return out


_SQL_MODAL = f"with {SQL_NODES}, {matrix('m', _INV)}, t1 as ({_sql_deriv('i', 'm')}), t2 as ({_sql_deriv('j', 'm', 't1', 'v')}), t3 as ({_sql_deriv('k', 'm', 't2', 'v')})"


def _spectrum(kind: str):
    def run(spark, d):
        t = el.nodes(el.tensor(arrays(spark, d), "u", _INV, "c"), "e", ["c"], N).withColumn("p", F.expr("k*16 + j*4 + i"))
        return compression.average_spectrum(t, F.expr("e div 10"), kind).select("g", "p", F.round("power", 6).alias("power"))

    return run


for _name, _kind, _power in (("average_spectrum", "mean", "avg(v)*avg(v)"), ("spectrum_variance", "variance", "case when count(*) > 1 then (sum(v*v) - sum(v)*sum(v)/count(*))/(count(*) - 1) end")):
    QUERIES[_name] = _spectrum(_kind)
    SQL[_name] = f"{_SQL_MODAL} select e // 10 as g, cast(k*16+j*4+i as int) as p, round({_power}, 6) as power from t3 group by 1, 2"


# --- where statistics lie ------------------------------------------------------------
#: The statistics in the order of their files' variables.
MEAN_FIELDS = ["P", "U", "V", "W"]
STAT_FIELDS = ["PP", "UU", "VV", "WW", "UV", "UW", "VW", "UUU", "VVV", "WWW", "UUV", "UUW", "UVV", "UVW", "VVW", "UWW", "VWW", "UUUU", "VVVV", "WWWW", "PPP", "PPPP", "PU", "PV", "PW", "PDU/DX", "PDU/DY", "PDU/DZ", "PDV/DX", "PDV/DY", "PDV/DZ", "PDW/DX", "PDW/DY", "PDW/DZ", "E11", "E22", "E33", "E12", "E13", "E23"]


def file_fields(mean: str = "mean_field.fld", stats: str = "stats.fld") -> list[tuple[str, str, str, str]]:
    """(statistic, file, key, short key): pressure, the velocities, temperature, then scalars by number."""
    keys = [("pres", "p"), ("vel_0", "u"), ("vel_1", "v"), ("vel_2", "w"), ("temp", "t")] + [(f"scal_{k}", f"s{k}") for k in range(99)]
    return [(name, file, *key) for file, names in ((mean, MEAN_FIELDS), (stats, STAT_FIELDS)) for name, key in zip(names, keys, strict=False)]


@query("with s(name, n) as (values " + ", ".join(f"('{n}', {k})" for k, n in enumerate(STAT_FIELDS)) + "), m(name, n) as (values " + ", ".join(f"('{n}', {k})" for k, n in enumerate(MEAN_FIELDS)) + "), a as (select name, n, 'mean_field.fld' as file, n as place from m union all select name, n, 'stats.fld', n + 4 from s) select p_partkey, name, file, case when n = 0 then 'pres' when n < 4 then concat('vel_', n - 1) when n = 4 then 'temp' else concat('scal_', n - 5) end as key, case when n < 5 then substr('puvwt', n + 1, 1) else concat('s', n - 5) end as short from part join a on p_partkey % 45 = place")
def statistics_files(spark, d):
    """Requests for statistics (parts, by number) with the file and the keys where each lies."""
    known = spark.createDataFrame([(k, *f) for k, f in enumerate(file_fields())], "place int, name string, file string, key string, short string")
    asked = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 45).cast("int").alias("place"))
    return asked.join(F.broadcast(known), "place").drop("place")  # some forty rows


# --- files of a folder ----------------------------------------------------------------
def _step_files(spark, d, steps: int) -> str:
    """Field files in time: at step s, time s + 1, the values of t are u (1 + s (p % 3))."""
    folder = _home(spark, "steps")
    for s in range(steps):
        a = arrays(spark, d).select("e", F.expr(f"transform(u, (v, p) -> v * (1 + {s} * (p % 3)))").alias("t"), F.expr(f"transform(u, v -> v * {s + 1})").alias("s0"))
        fieldfile.write_field(a, f"{folder}/step{s:05d}", (N, N, N), time=s + 1.0, step=s, files=2)
    return folder


@query(f"with {SQL_NODES} select cast(s // 2 as bigint) as batch, e, k, j, i, round(avg(u*(1 + s*(p%3))), 5) as t, round(avg(u*(s + 1)), 5) as s0, 2.0::double as dt from nodes, range(6) q(s) group by 1, 2, 3, 4, 5")
def average_files(spark, d):
    """Means over batches of two intervals of six field files, written as field files and read back."""
    _folder(spark)
    folder, out = _step_files(spark, d, 6), _home(spark, "means")
    averages.write_averages(averages.average_files(spark, folder, ["t", "s0"], 2.0), out, (N, N, N))
    got = fieldfile.read_steps(spark, out).withColumnsRenamed({"step": "batch", "time": "dt"})
    n = got.select("batch", "dt", "e", F.posexplode(F.arrays_zip("t", "s0")).alias("p", "v"))
    return n.select("batch", "e", F.expr("p div 16").cast("int").alias("k"), F.expr("p div 4 % 4").cast("int").alias("j"), (F.col("p") % 4).alias("i"), F.round("v.t", 5).alias("t"), F.round("v.s0", 5).alias("s0"), F.round("dt", 6).alias("dt"))


@query(_SEQUENCE.replace("s*0.5::double as time, round((s + 1)*value, 5) as value from one, range(3)", "cast(s as bigint) as step, s + 1.0::double as time, round((s + 1)*value, 5) as value from one, range(3)"))
def interpolate_files(spark, d):
    """Field files of three steps at probes that are located once, in one plan."""
    mesh = brick_arrays(spark, d, 0.0)
    ready = sequence.prepare(spark, mesh.select("e", "xs", "ys", "zs"), _probes(spark, d), N, _home(spark, "sequence"))
    got = sequence.sample_files(ready, _step_files(spark, d, 3), ["s0"])
    return got.select("probe_id", "step", "time", F.round("s0", 5).alias("value"))


# --- from files of statistics to budgets at points -----------------------------------
_BUDGET = {k: v.replace("100.0", "100.0e0").replace("1.0/", "1.0e0/").replace("-2.0/", "-2.0e0/").replace("0.5*(", "0.5e0*(") for k, v in bg.energy_budget("100.0").items()}
_WANTED = {name: bg.derived()[name] for name in bg.names_in(_BUDGET) if name in bg.derived()}
_STATS = list(dict.fromkeys([*[n for n in bg.names_in(_BUDGET) if n not in _WANTED], *[s for s, _, _ in _WANTED.values()]]))
#: The made statistics are multiples of a field.
_TIMES = {name: k % 7 + 1 for k, name in enumerate(_STATS)}
_FIRST_G = ", ".join(f"g{c} as ({_sql_deriv(a)}), h{c} as ({_sql_deriv(a, 'd', f'g{c}', 'v')})" for c, a in zip("xyz", "ijk", strict=True))
_BASE = {"u": "u"} | {f"d{c}": f"d{c}" for c in "xyz"} | {f"s{c}": f"s{c}" for c in "xyz"}
_AT_POINTS = f"with {SQL_PROBES}, q as (select probe_id, e, 2*(x-floor(x))-1 as r, 2*(y-floor(y))-1 as s, 2*(z-floor(z))-1 as t from lo), b as (select probe_id, e, [{', '.join(_sql_lagrange('r'))}] as lr, [{', '.join(_sql_lagrange('s'))}] as ls, [{', '.join(_sql_lagrange('t'))}] as lt from q), {SQL_NODES}, {SQL_D}, {_FIRST_G}, g as (select n.*, " + ", ".join(f"avg(2*g{c}.v) over (partition by {_KEYS}) as d{c}, avg(4*h{c}.v) over (partition by {_KEYS}) as s{c}" for c in "xyz") + " from nodes n " + " ".join(f"join {t}{c} using (e, k, j, i)" for t in "gh" for c in "xyz") + "), one as (select probe_id, " + ", ".join(f"coalesce(sum(lr[i+1]*ls[j+1]*lt[k+1]*{v}), 0) as {k}" for k, v in _BASE.items()) + " from b left join g using (e) group by probe_id), mean as (select probe_id % 10 as line, " + ", ".join(f"avg({k}) as {k}" for k in _BASE) + " from one group by 1), pts as (select line, " + ", ".join([f"{_TIMES[n]}*u as {n}" for n in _STATS] + [f"{_TIMES[f]}*{'d' if order == 1 else 's'}{axis} as {n}" for n, (f, order, axis) in _WANTED.items()]) + f") select line, {', '.join(f'round({f}, 3) as {k}' for k, f in _BUDGET.items())} from pts"
_AT_POINTS = _AT_POINTS.replace(") select line, round", " from mean) select line, round", 1)


@query(_AT_POINTS)
def budgets_at_points(spark, d):
    """Statistics in field files, their derivatives made continuous, all sampled at
    probes, averaged over lines of probes by a function of the user's, and the
    budget of the kinetic energy from what comes out."""
    path = _home(spark, "stats")
    scalars = {f"s{k}": name for k, name in enumerate(_STATS)}
    made = lambda a: a.select("e", F.col("xs").alias("x"), F.col("ys").alias("y"), F.col("zs").alias("z"), *[F.expr(f"transform(u, v -> v * {_TIMES[name]})").alias(s) for s, name in scalars.items()])
    fieldfile.write_field(arrays(spark, d), path, (N, N, N), made=lambda a: made(on_brick(a, 0.0)))
    stats = fieldfile.read_field(spark, path).withColumnsRenamed({"x": "xs", "y": "ys", "z": "zs"} | scalars)
    ready = sequence.prepare(spark, fieldfile.read_field(spark, path, "x,y,z").withColumnsRenamed({"x": "xs", "y": "ys", "z": "zs"}), _probes(spark, d), N, _home(spark, "points"))
    rows = geo.derived_statistics(sequence.dealt(ready, stats), {n: [t] for n, t in _WANTED.items()}, N, keep=("e", *_STATS))
    at = sequence.sampled(ready, sequence.averaged(ready, rows, list(_WANTED)), [*_STATS, *_WANTED])
    names = [*_STATS, *_WANTED]

    def part(c):
        return np.stack([np.full(len(names), float(len(c[names[0]]))), np.array([c[n].sum() for n in names])])

    lines = st.own_aggregate(at.withColumn("line", F.col("probe_id") % 10), ["line"], names, part, lambda x, y: x + y, lambda s: (s[1] / s[0]).tolist(), dict.fromkeys(names, "double"))
    return lines.select("line", *[F.round(F.expr(f), 3).alias(k) for k, f in _BUDGET.items()])


# --- routing --------------------------------------------------------------------------
@query("select l_suppkey % 7 as destination, count(*) as n, sum(l_orderkey) as keys, 1 as parts from lineitem group by 1")
def routed_rows(spark, d):
    """Each destination's rows are in one partition."""
    r = routing.all_to_all(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("l_suppkey") % 7, 7)
    return r.withColumn("part", F.spark_partition_id()).groupBy("destination").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"), F.count_distinct("part").cast("int").alias("parts"))


@query("select l_suppkey % 5 as rank, count(*) as n, coalesce(sum(count(*)) over (order by l_suppkey % 5 rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from lineitem group by 1")
def write_offsets(spark, d):
    """Where each rank's rows begin in a common file."""
    return routing.exclusive_offsets(table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("rank")), "rank")


@query("with n as (select count(*) as n from customer) select case when c_custkey < n // 10 then 0 when c_custkey < n // 10 + n // 3 then 1 when c_custkey < n then 2 end as destination, count(*) as n from customer, n group by 1")
def scattered_rows(spark, d):
    """Customers in three shares, by their numbers; what is beyond goes nowhere."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("place"))
    n = c.count()
    return routing.scatter(c, "place", [n // 10, n // 3, n - n // 10 - n // 3]).groupBy("destination").agg(F.count(F.lit(1)).alias("n"))
