"""The queries of the engine over the driver's tables, each with the SQL that
has to give the same rows. Embeddings of 64 values are elements of 4 x 4 x 4
nodes; events are outputs of files over time; lineitem holds weighted samples."""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions import spectral as sp
from nodeloom.operators import budgets as bg
from nodeloom.operators import compression, rom, solver
from nodeloom.operators import elements as el
from nodeloom.operators import statistics as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
N = 4
MODULES = ("curved", "meshes", "decomposition", "spectra", "sampled", "storage", "drivers")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("e"), F.col("embedding").cast("array<double>").alias("u"))


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.nodes(arrays(spark, sf_dir), "e", ["u"], N)


def brick_arrays(spark: SparkSession, sf_dir: str, warp: float = 0.02) -> DataFrame:
    """Elements with coordinate arrays of a slightly deformed brick."""
    return on_brick(arrays(spark, sf_dir), warp)


def on_brick(out: DataFrame, warp: float = 0.02) -> DataFrame:
    x = "array(" + ", ".join(f"{float(v)!r}D" for v in (sp.gll(N)[0] + 1) / 2) + ")"
    for name, cell, local, more in (("xs", "e % 8", "p % 4", f" + {warp}D * v" if warp else ""), ("ys", "(e div 8) % 8", "(p div 4) % 4", ""), ("zs", "e div 64", "p div 16", "")):
        out = out.withColumn(name, F.expr(f"transform(u, (v, p) -> {cell} + {x}[cast({local} as int)]{more})"))
    return out


def long_brick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.nodes(brick_arrays(spark, sf_dir), "e", ["u", "xs", "ys", "zs"], N, ["u", "x", "y", "z"])


def values(name: str, cols: str, rows) -> str:
    return f"{name}({cols}) as (values {', '.join('(' + ', '.join(repr(v) + '::double' if isinstance(v, float) else str(v) for v in r) + ')' for r in rows)})"


def matrix(name: str, m: np.ndarray) -> str:
    return values(name, "a, l, c", [(i, j, float(m[i, j])) for i, j in np.ndindex(*m.shape)])


SQL_NODES = "nodes as (select vec_id as e, cast(p // 16 as int) as k, cast((p // 4) % 4 as int) as j, cast(p % 4 as int) as i, p, cast(embedding[p + 1] as double) as u from embeddings, range(64) t(p))"
SQL_D = matrix("d", sp.derivative(N))
SQL_W = values("w", "a, w", [(i, float(v)) for i, v in enumerate(sp.gll(N)[1])])
SQL_X = values("gx", "a, x", [(i, float(v)) for i, v in enumerate((sp.gll(N)[0] + 1) / 2)])
SQL_BRICK = SQL_NODES + ", " + SQL_X + ", brick as (select n.e, n.k, n.j, n.i, n.u, 3*(e%8)+i as gx, 3*((e//8)%8)+j as gy, 3*(e//64)+k as gz, (e%8)+a.x+0.02::double*u as x, ((e//8)%8)+b.x as y, (e//64)+c.x as z from nodes n join gx a on a.a=n.i join gx b on b.a=n.j join gx c on c.a=n.k)"


def _sql_deriv(axis: str, m: str = "d", src: str = "nodes", val: str = "u") -> str:
    """select e,k,j,i,v: matrix m applied along i, j or k."""
    keep = [x for x in "kji" if x != axis]
    cols = ", ".join(f"{m}.a as {x}" if x == axis else f"n.{x}" for x in "kji")
    return f"select n.e, {cols}, sum({m}.c*n.{val}) as v from {src} n join {m} on n.{axis}={m}.l group by n.e, {', '.join('n.' + x for x in keep)}, {m}.a"


SHOW = ", round(v, 6) as v"


@query(f"with {SQL_NODES}, {SQL_W} select e, round(sum(u*a.w*b.w*c.w), 6) as integral from nodes n join w a on a.a=n.i join w b on b.a=n.j join w c on c.a=n.k group by e")
def gll_quadrature(spark, d):
    w = "array(" + ", ".join(f"{float(x)!r}D" for x in solver.weights(N)) + ")"
    return arrays(spark, d).select("e", F.round(F.aggregate(F.zip_with("u", F.expr(w), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 6).alias("integral"))


def _along(axis, m):
    def run(spark, d):
        return el.nodes(el.apply_axis(arrays(spark, d), "u", m, axis, "v"), "e", ["v"], N).withColumn("v", F.round("v", 6))

    return run


for _axis, _c in (("r", "i"), ("s", "j"), ("t", "k")):
    QUERIES[f"dud{_axis}"] = _along(_axis, sp.derivative(N))
    SQL[f"dud{_axis}"] = f"with {SQL_NODES}, {SQL_D} select e, k, j, i{SHOW} from ({_sql_deriv(_c)})"
QUERIES["dudr_transposed"] = _along("r", np.ascontiguousarray(sp.derivative(N).T))
SQL["dudr_transposed"] = f"with {SQL_NODES}, {matrix('d', sp.derivative(N).T)} select e, k, j, i{SHOW} from ({_sql_deriv('i')})"

_GRAD = ", ".join(f"g{x} as ({_sql_deriv(c)})" for x, c in zip("xyz", "ijk", strict=True))
_JOINED = "grad as (select a.e, a.k, a.j, a.i, 2*a.v as dx, 2*b.v as dy, 2*c.v as dz from gx_ a join gy b using (e,k,j,i) join gz c using (e,k,j,i))".replace("gx_", "gx")
_KEYS = "3*(e%8)+i, 3*((e//8)%8)+j, 3*(e//64)+k"


@query(f"with {SQL_NODES}, {SQL_D}, {_GRAD}, {_JOINED} select e, k, j, i, " + ", ".join(f"round(avg({x}) over (partition by {_KEYS}), 6) as dud{x[1]}" for x in ("dx", "dy", "dz")) + " from grad")
def spectral_gradient_dssum(spark, d):
    g = el.gradient_rst(arrays(spark, d), "u", N)
    n = el.brick(el.nodes(g, "e", ["u_r", "u_s", "u_t"], N))
    key = ["gx", "gy", "gz"]
    return n.select("e", "k", "j", "i", *[F.round(el.shared_sum(n.withColumn(c, F.col(c)), c, key, "average") * 2, 6).alias(f"dud{x}") for c, x in (("u_r", "x"), ("u_s", "y"), ("u_t", "z"))])


def _dssum(mode, alias):
    def run(spark, d):
        n = el.brick(long(spark, d)).withColumn("b", el.mass(N))
        v = el.shared_sum(n, "u", ["gx", "gy", "gz"], mode, "b")
        return n.select("e", "k", "j", "i", (v if mode == "multiplicity" else F.round(v, 6)).alias(alias))

    return run


for _mode, _expr in (("sum", "round(sum(u) over w, 6)"), ("average", "round(avg(u) over w, 6)"), ("mass", "round(sum(u*b) over w / sum(b) over w, 6)"), ("multiplicity", "count(*) over w")):
    _name = {"sum": "dssum_sum", "average": "dssum_multiplicity", "mass": "dssum_mass", "multiplicity": "multiplicity"}[_mode]
    QUERIES[_name] = _dssum(_mode, "n" if _mode == "multiplicity" else "v")
    SQL[_name] = f"with {SQL_NODES}, {SQL_W}, m as (select n.*, a.w*b.w*c.w as b from nodes n join w a on a.a=n.i join w b on b.a=n.j join w c on c.a=n.k) select e, k, j, i, {_expr} as {'n' if _mode == 'multiplicity' else 'v'} from m window w as (partition by {_KEYS})"


def _velocity(spark, d):
    """Elements in threes as the components of a velocity; incomplete threes are left out."""
    a = arrays(spark, d).withColumn("c", (F.col("e") % 3).cast("int")).withColumn("e", F.expr("e div 3"))
    return a.groupBy("e").agg(*[F.max(F.when(F.col("c") == k, F.col("u"))).alias(x) for k, x in enumerate("uvw")]).where("u is not null and v is not null and w is not null")


def _velocity_gradient(spark, d):
    g = _velocity(spark, d)
    for c in "uvw":
        g = el.gradient_rst(g, c, N)
    return el.nodes(g, "e", [f"{c}_{a}" for c in "uvw" for a in "rst"], N)


_VGRAD = f"{SQL_NODES}, {SQL_D}, {_GRAD}, full_ as (select e//3 as e from nodes where p=0 group by 1 having count(*)=3), vg as (select a.e//3 as e, a.e%3 as c, a.k, a.j, a.i, a.v as r, b.v as s, c.v as t from gx a join gy b using (e,k,j,i) join gz c using (e,k,j,i)), wide as (select e, k, j, i, " + ", ".join(f"max(case when c={n} then {a} end) as {x}_{a}" for n, x in enumerate("uvw") for a in "rst") + " from vg join full_ using (e) group by 1,2,3,4)"
_SYM = [(a, b) for a, b in bg.PAIRS]


def _pair(sign):
    return [(f"(0.5*({'uvw'[i]}_{'rst'[j]} {sign} {'uvw'[j]}_{'rst'[i]}))", f"{'s' if sign == '+' else 'a'}{i + 1}{j + 1}") for i, j in (_SYM if sign == "+" else [(0, 1), (0, 2), (1, 2)])]


for _sign, _name in (("+", "strain_tensor"), ("-", "rotation_tensor")):
    QUERIES[_name] = (lambda s: lambda spark, d: _velocity_gradient(spark, d).select("e", "k", "j", "i", *[F.round(F.expr(x), 6).alias(n) for x, n in _pair(s)]))(_sign)
    SQL[_name] = f"with {_VGRAD} select e, k, j, i, " + ", ".join(f"round({x}, 6) as {n}" for x, n in _pair(_sign)) + " from wide"


def _sql_tensor(m: np.ndarray, show: str = "select e, k, j, i, round(v, 6) as v from t3") -> str:
    return f"with {SQL_NODES}, {matrix('m', m)}, t1 as ({_sql_deriv('i', 'm')}), t2 as ({_sql_deriv('j', 'm', 't1', 'v')}), t3 as ({_sql_deriv('k', 'm', 't2', 'v')}) {show}"


def _tensor(m, size=N):
    return lambda spark, d: el.nodes(el.tensor(arrays(spark, d), "u", m, "v"), "e", ["v"], size).withColumn("v", F.round("v", 6))


_V, _INV = sp.modal(N)
_FILTER = sp.filter_matrix(N, (1.0, 1.0, 0.5, 0.0))
for _name, _m in (("modal_transform", _INV), ("modal_filter", _FILTER), ("p_refine", sp.interpolation(N, 3)), ("p_refine_up", sp.interpolation(N, 5)), ("p_map_equidistant", sp.lagrange_rows(sp.gll(N)[0], np.linspace(-1, 1, N)))):
    QUERIES[_name], SQL[_name] = _tensor(_m, _m.shape[0]), _sql_tensor(_m)


@query(_sql_tensor(_INV, "select e, k, j, i, round(case when row_number() over (partition by e order by abs(v) desc, k, j, i) <= 16 then v else 0 end, 6) as v from t3"))
def legendre_truncation(spark, d):
    t = el.tensor(arrays(spark, d), "u", _INV, "c").withColumn("v", compression.keep_largest("c", 16))
    return el.nodes(t, "e", ["v"], N).withColumn("v", F.round("v", 6))


@query(f"with {SQL_BRICK} select e, " + ", ".join(f"round({f}({c}), 6) as {c}_{s}" for c in "xyz" for f, s in (("min", "lo"), ("max", "hi"))) + " from brick group by e")
def element_bbox(spark, d):
    b = el.bounding_boxes(long_brick(spark, d))
    return b.select("e", *[F.round(c, 6).alias(c) for c in b.columns if c != "e"])


@query(f"with {SQL_BRICK} select e, cast(i//3 + 2*(j//3) + 4*(k//3) as int) as vertex, round(x,6) as x, round(y,6) as y, round(z,6) as z from brick where i%3=0 and j%3=0 and k%3=0")
def vertices(spark, d):
    return el.vertices(long_brick(spark, d), N).select("e", "vertex", *[F.round(c, 6).alias(c) for c in "xyz"])


_FACETS = [f"select e, {f} as facet, x, y, z from brick where {c} = {v}" for f, (c, v) in enumerate([("i", 0), ("i", 3), ("j", 0), ("j", 3), ("k", 0), ("k", 3)])]
_EDGES = [f"select e, {4 * p + q} as edge, x, y, z from brick where {a} = {x} and {b} = {y}" for p, (a, b) in enumerate([("j", "k"), ("i", "k"), ("i", "j")]) for q, (x, y) in enumerate([(0, 0), (3, 0), (0, 3), (3, 3)])]
_MID = ", ".join(f"round(min({c}) + (max({c})-min({c}))/2, 6) as c{c}" for c in "xyz")
for _kind, _rows in (("facet", _FACETS), ("edge", _EDGES)):
    QUERIES[f"{_kind}_centers"] = (lambda k: lambda spark, d: (lambda t: t.select("e", k, *[F.round(f"c{c}", 6).alias(f"c{c}") for c in "xyz"]))(el.entity_centres(long_brick(spark, d), N, k)))(_kind)
    SQL[f"{_kind}_centers"] = f"with {SQL_BRICK}, f as ({' union all '.join(_rows)}) select e, {_kind}, {_MID} from f group by e, {_kind}"


@query(f"with {SQL_BRICK}, f as ({' union all '.join(_FACETS)}), c as (select e, facet, round(min(y)+(max(y)-min(y))/2,6) as cy, round(min(z)+(max(z)-min(z))/2,6) as cz, round(min(x)+(max(x)-min(x))/2,1) as cx from f group by e, facet) select a.e, a.facet, b.e as e2, b.facet as facet2 from c a join c b on a.cx=b.cx and a.cy=b.cy and a.cz=b.cz and a.e<>b.e where a.facet // 2 = b.facet // 2")
def shared_facets(spark, d):
    """Connectivity: facets of different elements with the same centre, by an equi-join on quantised centres."""
    c = el.entity_centres(long_brick(spark, d), N, "facet").select("e", "facet", F.round("cx", 1).alias("cx"), F.round("cy", 6).alias("cy"), F.round("cz", 6).alias("cz"))
    o = c.withColumnsRenamed({"e": "e2", "facet": "facet2"})
    return c.join(o, ["cx", "cy", "cz"]).where("e <> e2 and facet div 2 = facet2 div 2").select("e", "facet", "e2", "facet2")


@query("select e, cast(c as int) as cell, node_at as corner, e*64 + ((c//9)+dk)*16 + (((c//3)%3)+dj)*4 + (c%3)+di as node from (select vec_id as e from embeddings) x, range(27) r(c), (values (0,0,0,0),(1,0,0,1),(2,0,1,1),(3,0,1,0),(4,1,0,0),(5,1,0,1),(6,1,1,1),(7,1,1,0)) t(node_at, dk, dj, di)")
def hex_cells(spark, d):
    c = arrays(spark, d).select("e", F.posexplode(el.hex_cells(N, F.col("e"))).alias("cell", "ids"))
    return c.select("e", "cell", F.posexplode("ids").alias("corner", "node"))


# --- files, time and space -------------------------------------------------
_EPOCH = "epoch_us({}) / 1000000.0::double"


def _outputs(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"), "value", "event_type")


SQL_INDEX = "idx as (select user_id, event_id, value, event_type, t as time, row_number() over w - 1 as idx, coalesce(lag(t) over w, t) as time_prev, t - coalesce(lag(t) over w, t) as dt from (select *, epoch_us(ts)/1000000.0::double as t from events) window w as (partition by user_id order by t, event_id))"


@query(f"with {SQL_INDEX} select user_id, event_id, idx, round(time_prev, 3) as time_prev, round(dt, 3) as dt from idx")
def file_index(spark, d):
    i = st.file_index(_outputs(spark, d), "user_id", ["time", "event_id"], "time")
    return i.select("user_id", "event_id", F.col("idx").cast("long").alias("idx"), F.round("time_prev", 3).alias("time_prev"), F.round("dt", 3).alias("dt"))


@query("with a as (select concat('o', o_orderkey) as path, epoch_us(o_orderdate)/1000000.0::double as time from orders where o_orderstatus <> 'P' union all select concat('e', event_id), epoch_us(ts)/1000000.0::double from events) select path, round(time, 3) as time, round(min(time) over (), 3) as start_time from a")
def merge_index(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "file_not_in_folder").otherwise(F.concat(F.lit("o"), "o_orderkey")).alias("path"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("time"))
    e = _outputs(spark, d).select(F.concat(F.lit("e"), "event_id").alias("path"), "time")
    return st.merge_index([o, e]).select("path", F.round("time", 3).alias("time"), F.round("start_time", 3).alias("start_time"))


@query("with a as (select concat('o', o_orderkey) as path, epoch_us(o_orderdate)/1000000.0::double as time from orders where o_orderstatus <> 'P' union all select concat('e', event_id), epoch_us(ts)/1000000.0::double from events) select path, round(time, 3) as time, row_number() over (order by time, path) - 1 as idx from a")
def merge_index_sorted(spark, d):
    """Two indexes merged and numbered anew in the order of time."""
    o = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "file_not_in_folder").otherwise(F.concat(F.lit("o"), "o_orderkey")).alias("path"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("time"))
    e = _outputs(spark, d).select(F.concat(F.lit("e"), "event_id").alias("path"), "time")
    return st.merge_index([o, e], sort_by_time=True).select("path", F.round("time", 3).alias("time"), "idx")


@query("select l_suppkey, " + ", ".join(f"round({f}({c}), 4) as {n}_{c}" for c in ("l_quantity", "l_extendedprice") for f, n in (("max", "max"), ("min", "min"), ("avg", "mean"))) + " from lineitem group by l_suppkey")
def inspect_fields(spark, d):
    t = st.inspect(table(spark, d, "lineitem"), "l_suppkey", ["l_quantity", "l_extendedprice"])
    return t.select("l_suppkey", *[F.round(c, 4).alias(c) for c in t.columns[1:]])


_LENGTH = 200_000.0
SQL_BATCHES = f"with recursive {SQL_INDEX}, run as (select user_id, event_id, value, idx, dt, dt as total, 0 as batch from idx where idx = 0 union all select n.user_id, n.event_id, n.value, n.idx, n.dt, case when r.total + n.dt > {_LENGTH * 1.05} then n.dt else r.total + n.dt end, case when r.total + n.dt > {_LENGTH * 1.05} then r.batch + 1 else r.batch end from run r join idx n on n.user_id = r.user_id and n.idx = r.idx + 1)"


def _batches(spark, d):
    i = st.file_index(_outputs(spark, d), "user_id", ["time", "event_id"], "time").select("user_id", "event_id", "time", "dt", "value")
    return st.time_batches(i, "user_id", ["time", "event_id"], _LENGTH)


@query(SQL_BATCHES + " select user_id, event_id, cast(batch as bigint) as batch from run")
def time_batches(spark, d):
    return _batches(spark, d).select("user_id", "event_id", "batch")


@query(SQL_BATCHES + " select user_id, cast(batch as bigint) as batch, round(sum(value*dt)/sum(dt), 4) as value from run group by 1, 2 having sum(dt) > 0")
def time_average(spark, d):
    return st.weighted_mean(_batches(spark, d), ["user_id", "batch"], ["value"], "dt").where("weight > 0").select("user_id", "batch", F.round("value", 4).alias("value"))


@query("select l_linestatus, l_linenumber, round(sum(l_discount*l_quantity)/sum(l_quantity), 6) as l_discount, round(sum(l_tax*l_quantity)/sum(l_quantity), 6) as l_tax from lineitem group by 1, 2")
def space_average(spark, d):
    t = st.weighted_mean(table(spark, d, "lineitem"), ["l_linestatus", "l_linenumber"], ["l_discount", "l_tax"], "l_quantity")
    return t.select("l_linestatus", "l_linenumber", F.round("l_discount", 6).alias("l_discount"), F.round("l_tax", 6).alias("l_tax"))


@query("select event_type, round(avg(value), 4) as mean, round((avg(value*value)-avg(value)*avg(value))/count(*), 4) as variance from events group by 1")
def nobm(spark, d):
    return st.batch_means(table(spark, d, "events"), ["event_type"], "value").select("event_type", F.round("mean", 4).alias("mean"), F.round("variance", 4).alias("variance"))


_SAMPLE = {"u": "l_quantity/50.0", "v": "l_discount*10.0", "w": "l_tax*10.0", "p": "l_extendedprice/100000.0"}


@query("with s as (select l_suppkey, " + ", ".join(f"{x}::double as {c}" for c, x in _SAMPLE.items()) + " from lineitem) select l_suppkey, " + ", ".join(f"round({f}, 6) as m_{k}" for k, f in zip(map(str, range(99)), bg.moments().values(), strict=False)) + " from s group by 1")
def field_moments(spark, d):
    s = table(spark, d, "lineitem").select("l_suppkey", *[F.expr(x.replace("0.0", "0.0D").replace("00D00", "0000")).cast("double").alias(c) for c, x in _SAMPLE.items()])
    return s.groupBy("l_suppkey").agg(*[F.round(F.expr(f), 6).alias(f"m_{k}") for k, f in enumerate(bg.moments().values())])


def _points_sql(names: list[str]) -> str:
    return "pts as (select vec_id as e, " + ", ".join(f"(cast(embedding[{m % 64 + 1}] as double) * {1.0 + m // 64}::double) as {x}" for m, x in enumerate(names)) + " from embeddings)"


def _points(spark, d, names):
    return arrays(spark, d).select("e", *[F.expr(f"u[{m % 64}] * {1.0 + m // 64}D").alias(x) for m, x in enumerate(names)])


def _budget(name: str, formulas: dict[str, str]) -> None:
    names = bg.names_in(formulas)
    QUERIES[name] = lambda spark, d: _points(spark, d, names).select("e", *[F.round(F.expr(f), 6).alias(k) for k, f in formulas.items()])
    SQL[name] = f"with {_points_sql(names)} select e, {', '.join(f'round({f}, 6) as {k}' for k, f in formulas.items())} from pts"


_RE, _PR = "100.0", "0.5"
for _name, _f in {"reynolds_stress": bg.reynolds(), "triple_products": bg.central(), "rs_production": bg.production(), "rs_convection": bg.convection(), "rs_dissipation": bg.dissipation(_RE), "rs_turbulent_transport": bg.turbulent_transport(), "rs_viscous_diffusion": bg.viscous_diffusion(_RE), "rs_pressure_strain": bg.pressure_strain(), "rs_pressure_transport": bg.pressure_transport(), "rs_residual": {k: v for k, v in bg.stress_budget(_RE).items() if k[:3] in ("vpg", "res")}, "tke_budget": bg.energy_budget(_RE), "momentum_budget": bg.momentum_budget(_RE), "scalar_budget": bg.scalar_budget(_RE, _PR)}.items():
    _budget(_name, {k: v.replace("100.0", "100.0e0").replace("1.0/", "1.0e0/").replace("-2.0/", "-2.0e0/").replace("*0.5)", "*0.5e0)").replace("0.5*(", "0.5e0*(") for k, v in _f.items()})


# --- search, rotation, clouds ----------------------------------------------
@query("with b as (select min(value) as lo, max(value) as hi from events) select cast(least(greatest(floor((value-lo)/((hi-lo)/7)), 0), 7) as bigint) as bin, count(*) as n from events, b group by 1")
def grid_bins(spark, d):
    e = table(spark, d, "events")
    lo, hi = e.agg(F.min("value"), F.max("value")).first()
    return e.groupBy(st.grid_bin(F.col("value"), F.lit(lo), F.lit(hi), 8).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("with p as (select event_id, value/10.0::double as x, (event_id%50)::double as y from events), b as (select p_partkey, p_size*1.0::double as x_lo, p_size+1.5::double as x_hi, (p_partkey%50)::double as y_lo, (p_partkey%50)+2.0::double as y_hi from part) select event_id, p_partkey from p join b on x between x_lo and x_hi and y between y_lo and y_hi")
def bbox_range_join(spark, d):
    p = table(spark, d, "events").select("event_id", F.expr("value / 10.0D").alias("x"), F.expr("cast(event_id % 50 as double)").alias("y"))
    b = table(spark, d, "part").select("p_partkey", F.expr("p_size * 1.0D").alias("x_lo"), F.expr("p_size + 1.5D").alias("x_hi"), F.expr("cast(p_partkey % 50 as double)").alias("y_lo"), F.expr("p_partkey % 50 + 2.0D").alias("y_hi"))
    return st.level_join(p, b, ["x", "y"]).select("event_id", "p_partkey")


@query("with p as (select event_id, value as x, (event_id%500)::double as y from events), b as (select p_partkey, (p_retailprice*7) % 60 as x_lo, (p_retailprice*7) % 60 + power(10, p_partkey%7 - 5) as x_hi, (p_partkey%499)::double as y_lo, p_partkey%499 + power(10, p_partkey%5 - 2) as y_hi from part) select event_id, p_partkey from p join b on x between x_lo and x_hi and y between y_lo and y_hi")
def graded_boxes(spark, d):
    """Boxes whose sides differ by up to a million times, each met on its own grid level."""
    p = table(spark, d, "events").select("event_id", F.col("value").alias("x"), F.expr("cast(event_id % 500 as double)").alias("y"))
    x, y = (F.col("p_retailprice") * 7) % 60, (F.col("p_partkey") % 499).cast("double")
    b = table(spark, d, "part").select("p_partkey", x.alias("x_lo"), (x + F.pow(F.lit(10.0), F.expr("p_partkey % 7 - 5"))).alias("x_hi"), y.alias("y_lo"), (y + F.pow(F.lit(10.0), F.expr("p_partkey % 5 - 2"))).alias("y_hi"))
    return st.level_join(p, b, ["x", "y"]).select("event_id", "p_partkey")


@query(f"with {SQL_BRICK}, c as (select e, (min(x)+max(x))/2 as cx, (min(y)+max(y))/2 as cy, (min(z)+max(z))/2 as cz from brick group by e) select e, k, j, i, round(u, 6) as u from brick semi join (select e from c where cx > 1 and cx < 5 and cy > 2 and cy < 7 and cz > -1 and cz < 4) using (e)")
def subdomain_filter(spark, d):
    """Elements whose box centre lies strictly inside a box."""
    a = brick_arrays(spark, d)
    for c in "xyz":
        a = a.withColumn(f"c{c}", (F.array_min(f"{c}s") + F.array_max(f"{c}s")) / 2)
    return el.nodes(a.where("cx > 1 and cx < 5 and cy > 2 and cy < 7 and cz > -1 and cz < 4"), "e", ["u"], N).withColumn("u", F.round("u", 6))


@query(f"with {SQL_BRICK}, kept as (select e, row_number() over (order by e) - 1 as new_e from brick group by e having bool_or(x > 3 and u > 0)) select e, new_e from kept")
def partition_elements(spark, d):
    return st.keep_elements(long_brick(spark, d), F.expr("x > 3 and u > 0"))


_ROT = "select e, k, j, i, x, y, u, case when sqrt(x*x+y*y) <= 1e-7 then 1 else x/sqrt(x*x+y*y) end as c, case when sqrt(x*x+y*y) <= 1e-7 then 0 else y/sqrt(x*x+y*y) end as s from brick"


@query(f"with {SQL_BRICK}, r as ({_ROT}) select e, k, j, i, round(c*u + s*2*u, 6) as vr, round(c*2*u - s*u, 6) as vt, round(3*u, 6) as vz from r")
def rotate_vector(spark, d):
    n = long_brick(spark, d)
    v = st.rotate_vector(F.col("x"), F.col("y"), [F.col("u"), F.col("u") * 2, F.col("u") * 3])
    return n.select("e", "k", "j", "i", *[F.round(c, 6).alias(a) for c, a in zip(v, ("vr", "vt", "vz"), strict=True)])


@query(f"with {SQL_BRICK}, r as ({_ROT}) select e, k, j, i, round(c*c*u + 2*c*s*4*u + s*s*2*u, 6) as t11, round(s*s*u - 2*c*s*4*u + c*c*2*u, 6) as t22, round(3*u, 6) as t33, round(c*s*(2*u-u) + (c*c-s*s)*4*u, 6) as t12, round(c*5*u + s*6*u, 6) as t13, round(c*6*u - s*5*u, 6) as t23 from r")
def rotate_tensor(spark, d):
    n = long_brick(spark, d)
    t = st.rotate_tensor(F.col("x"), F.col("y"), {k: F.col("u") * (m + 1) for m, k in enumerate(("11", "22", "33", "12", "13", "23"))})
    return n.select("e", "k", "j", "i", *[F.round(c, 6).alias(f"t{k}") for k, c in t.items()])


_CLOUD = {"r": sp.points_1d(0.0, 1.0, 6, "half_tanh", 1.5), "th": sp.points_1d(0.0, 2 * np.pi, 8, "equal", endpoint=False), "z": sp.points_1d(0.0, 1.0, 7, "cheb")}
_WIDTH = {"r": sp.cell_widths(_CLOUD["r"]), "th": np.full(8, 2 * np.pi / 8), "z": sp.cell_widths(_CLOUD["z"])}
# The points and widths written out: the upper half of 12 stretched points, equal angles, Chebyshev points.
_SQL_CLOUD = "r1 as (select cast(i as int) as ir, tanh(1.5*(2*(6 + i)/11.0::double - 1))/tanh(1.5) as r from range(6) t(i)), lr as (select ir, r, (coalesce(lead(r) over (order by ir), r) - coalesce(lag(r) over (order by ir), r))/2 as dr from r1), lth as (select cast(i as int) as ith, 2*pi()*i/8 as th, 2*pi()/8 as dth from range(8) t(i)), z1 as (select cast(i as int) as iz, (1 - cos(pi()*i/6))/2 as z from range(7) t(i)), lz as (select iz, z, (coalesce(lead(z) over (order by iz), z) - coalesce(lag(z) over (order by iz), z))/2 as dz from z1)"


@query(f"with {_SQL_CLOUD} select s_suppkey, iz, ith, ir, round(0.05*(s_suppkey%5+1)*r*cos(th), 8) as x, round(0.05*(s_suppkey%5+1)*r*sin(th), 8) as y, round(z*(1 + s_nationkey), 8) as z, round(0.0025*(s_suppkey%5+1)*(s_suppkey%5+1)*r*dr*dth*dz*(1 + s_nationkey), 9) as mass from supplier, lr, lth, lz")
def point_cloud(spark, d):
    """A structured cylinder cloud per supplier, of its own radius and height: the
    points of three lines (a few each) unrolled per row, mass = r dr dth dz."""
    line = lambda a: F.explode(F.array(*[F.struct(F.lit(i).alias(f"i{a}"), F.lit(float(v)).alias(a), F.lit(float(w)).alias(f"d{a}")) for i, (v, w) in enumerate(zip(_CLOUD[a], _WIDTH[a], strict=True))]))
    g = table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 5 + 1) * 0.05).alias("radius"), (F.col("s_nationkey") + 1).alias("height"))
    for a in ("z", "th", "r"):
        g = g.withColumn(f"_{a}", line(a)).select(*g.columns, f"_{a}.*")
    r = F.col("r") * F.col("radius")
    return g.select("s_suppkey", "iz", "ith", "ir", F.round(r * F.cos("th"), 8).alias("x"), F.round(r * F.sin("th"), 8).alias("y"), F.round(F.col("z") * F.col("height"), 8).alias("z"), F.round(r * F.col("dr") * F.col("radius") * F.col("dth") * F.col("dz") * F.col("height"), 9).alias("mass"))


@query("with o as (select p_partkey as i, p_retailprice as x from part), m as (select i, x, lag(x) over w as a, lead(x) over w as b from o window w as (order by x, i)) select i, round((coalesce(b, x) - coalesce(a, x))/2, 6) as width from m")
def cell_widths(spark, d):
    o = table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("x"))
    n = st.neighbours(o, ["x", "i"], "x")
    return n.select("i", F.round((F.coalesce("after", "x") - F.coalesce("before", "x")) / 2, 6).alias("width"))


def _probes(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("probe_id"), F.expr("(event_id % 83) * 0.0973D + 0.0131D").alias("x"), F.expr("(event_id % 59) * 0.1351D + 0.0171D").alias("y"), F.expr("(event_id % 37) * 0.2113D + 0.0117D").alias("z"))


SQL_PROBES = "pr as (select event_id as probe_id, (event_id%83)*0.0973::double+0.0131::double as x, (event_id%59)*0.1351::double+0.0171::double as y, (event_id%37)*0.2113::double+0.0117::double as z from events), lo as (select p.*, v.vec_id as e from pr p left join embeddings v on v.vec_id = cast(floor(x) as bigint) + 8*cast(floor(y) as bigint) + 64*cast(floor(z) as bigint) and x < 8 and y < 8)"


def _located(spark, d):
    mesh = brick_arrays(spark, d, 0.0).drop("u")
    return st.locate(_probes(spark, d), mesh, N)


@query(f"with {SQL_PROBES} select probe_id, e, case when e is null then 0 else 1 end as err_code, round(case when e is not null then 2*(x-floor(x))-1 end, 6) as r, round(case when e is not null then 2*(y-floor(y))-1 end, 6) as s, round(case when e is not null then 2*(z-floor(z))-1 end, 6) as t from lo")
def locate_points(spark, d):
    return _located(spark, d).select("probe_id", "e", "err_code", *[F.round(c, 6).alias(c) for c in "rst"])


def _sql_lagrange(var: str) -> str:
    x = sp.gll(N)[0]
    w = [float(1.0 / np.prod([x[i] - x[j] for j in range(N) if j != i])) for i in range(N)]
    return [f"({w[i]!r}::double" + "".join(f"*({var} - ({float(x[j])!r}::double))" for j in range(N) if j != i) + ")" for i in range(N)]


@query(f"with {SQL_PROBES}, q as (select probe_id, e, 2*(x-floor(x))-1 as r, 2*(y-floor(y))-1 as s, 2*(z-floor(z))-1 as t from lo), b as (select probe_id, e, [{', '.join(_sql_lagrange('r'))}] as lr, [{', '.join(_sql_lagrange('s'))}] as ls, [{', '.join(_sql_lagrange('t'))}] as lt from q), {SQL_NODES} select probe_id, round(coalesce(sum(lr[i+1]*ls[j+1]*lt[k+1]*u), 0), 6) as value from b left join nodes using (e) group by probe_id")
def probe_interpolation(spark, d):
    return st.evaluate(_located(spark, d), arrays(spark, d), "u", N).select("probe_id", F.round("value", 6).alias("value"))


@query(SQL["probe_interpolation"].replace("as value from", "as value, round(coalesce(sum(lr[i+1]*ls[j+1]*lt[k+1]*dr), 0), 4) as slope from").replace(SQL_NODES, f"{SQL_NODES}, {SQL_D}, gr as ({_sql_deriv('i')}), nb as (select n.*, gr.v as dr from nodes n join gr using (e, k, j, i))").replace("left join nodes using", "left join nb using"))
def probe_strategies(spark, d):
    """The value at probes by way of the modes, which equals the other ways, and the slope along r."""
    at = _located(spark, d)
    ways = {way: st.evaluate(at, arrays(spark, d), "u", N, way).select("probe_id", F.col("value").alias(way)) for way in ("legendre", "lagrange")}
    slope = st.evaluate(at, arrays(spark, d), "u", N, "legendre", "r").select("probe_id", F.col("value").alias("slope"))
    both = ways["legendre"].join(ways["lagrange"], "probe_id").join(slope, "probe_id")
    return both.select("probe_id", F.round((F.col("legendre") + F.col("lagrange")) / 2, 6).alias("value"), F.round("slope", 4).alias("slope"))


# --- decomposition ----------------------------------------------------------
@query(f"with {SQL_NODES} select cast(a.p as int) as a, cast(b.p as int) as b, round(sum(a.u*b.u), 4) as g from nodes a join nodes b on a.e=b.e where a.p <= b.p group by 1, 2")
def gram_matrix(spark, d):
    """Inner products of all snapshots (the 64 values of an element) over all elements."""
    g = rom.gram_matrix(arrays(spark, d), "u")
    return spark.createDataFrame([(i, j, round(float(g[i, j]), 4)) for i in range(len(g)) for j in range(i, len(g))], "a int, b int, g double")


@query(f"with {SQL_NODES} select e, round(sum(u*u), 6) as energy from nodes group by e")
def snapshot_energy(spark, d):
    return arrays(spark, d).select("e", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x), 6).alias("energy"))


def _blocks(spark, d):
    """Rows of the snapshot matrix: an element is a row, its 64 values are snapshots."""
    return arrays(spark, d).select(F.col("e").alias("row"), F.col("u").alias("a"))


@query()
def pod_modes(spark, d):
    sigma, _, modes = rom.pod(_blocks(spark, d), "row", "a", 8)
    return modes.select("row", F.posexplode("mode").alias("k", "value")).where(F.col("k") < int((sigma > 1e-10).sum()))


@query()
def pod_singular_values(spark, d):
    sigma, _, _ = rom.pod(_blocks(spark, d), "row", "a", 64)
    return spark.createDataFrame([(k, float(s)) for k, s in enumerate(sigma)], "k int, sigma double")


@query()
def pod_reconstruction(spark, d):
    """Largest error per row when all modes are kept: zero up to rounding."""
    b = _blocks(spark, d)
    sigma, vt, modes = rom.pod(b, "row", "a", 64)
    both = rom.reconstructed(modes, "row", sigma, vt, "back").join(b, "row")
    return both.select("row", F.round(F.array_max(F.zip_with("back", "a", lambda x, y: F.abs(x - y))), 4).alias("error"))


@query()
def pod_streaming(spark, d):
    _folder(spark)
    state, b = rom.StreamingPod("row", 16), _blocks(spark, d)
    for at in range(0, 64, 16):
        state.update(b.select("row", F.slice("a", at + 1, 16).alias("a")), "a")
    return spark.createDataFrame([(k, float(s)) for k, s in enumerate(state.sigma)], "k int, sigma double")


_DFT = "sum(u*cos(2*pi()*kappa*i/4))/2"


@query(f"with {SQL_NODES} select e, k, j, cast(kappa as int) as kappa, round({_DFT}, 6) + 0.0 as re, round(-sum(u*sin(2*pi()*kappa*i/4))/2, 6) + 0.0 as im from nodes, range(3) t(kappa) group by 1, 2, 3, 4")
def line_dft(spark, d):
    t = rom.line_dft(long(spark, d), ["e", "k", "j"], "i", "u", N)
    return t.select("e", "k", "j", "kappa", (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))


# --- compression ------------------------------------------------------------
@query(f"with {SQL_NODES} select e, k, j, i, u from nodes")
def bz2_roundtrip(spark, d):
    packed = arrays(spark, d).select("e", compression.pack("u").alias("payload"))
    return el.nodes(packed.select("e", compression.unpack("payload").alias("u")), "e", ["u"], N)


@query()
def bitplane_roundtrip(spark, d):
    @F.pandas_udf("double")
    def error(u):
        import pandas as pd

        out = []
        for v in u:
            v = np.asarray(v)
            lo, hi, data = compression.bitplanes(v, 16)
            out.append(float(np.abs(compression.from_bitplanes(lo, hi, data, len(v), 16) - v).max() / ((hi - lo) or 1.0)))
        return pd.Series(out)

    return arrays(spark, d).select("e", (error("u") <= 1.0 / 2**16).alias("exact"))


# --- solvers ----------------------------------------------------------------
def _weighted(src: str) -> str:
    return f"(select n.e, n.k, n.j, n.i, n.v*0.5::double*a.w*b.w*c.w as v from ({src}) n join w a on a.a=n.i join w b on b.a=n.j join w c on c.a=n.k)"


_STIFF = " union all ".join(_sql_deriv(c, "dt_", _weighted(_sql_deriv(c)), "v") for c in "ijk")


@query(f"with {SQL_NODES}, {SQL_D}, {matrix('dt_', sp.derivative(N).T)}, {SQL_W} select e, k, j, i, round(sum(v), 6) as v from ({_STIFF}) group by 1, 2, 3, 4")
def stiffness_apply(spark, d):
    return el.nodes(solver.stiffness(arrays(spark, d), "u", "v", N), "e", ["v"], N).withColumn("v", F.round("v", 6))


@query(f"with {SQL_NODES}, {SQL_D}, {SQL_W}, o as (select l as a, sum(c*c*w) as o from d join w on w.a=d.a group by l), g as (select z.a as k, y.a as j, x.a as i, 0.5*(x.o*wy.w*wz.w + wx.w*y.o*wz.w + wx.w*wy.w*z.o) as v from o x, o y, o z, w wx, w wy, w wz where wx.a=x.a and wy.a=y.a and wz.a=z.a) select 3*(e%8)+i as gx, 3*((e//8)%8)+j as gy, 3*(e//64)+k as gz, round(sum(v), 6) as v, count(*) as copies from nodes join g using (k, j, i) group by 1, 2, 3")
def jacobi_diag(spark, d):
    """The assembled diagonal of the stiffness on the unique nodes of all elements."""
    lit = F.array(*[F.lit(float(x)) for x in solver.jacobi_diagonal(N)])
    n = el.brick(long(spark, d)).select("gx", "gy", "gz", F.element_at(lit, F.expr("k*16 + j*4 + i") + 1).alias("v"))
    return n.groupBy("gx", "gy", "gz").agg(F.round(F.sum("v"), 6).alias("v"), F.count(F.lit(1)).alias("copies"))


@query(f"with {_VGRAD}, {SQL_W}, vel as (select e//3 as e, k, j, i, max(case when e%3=0 then u end) as u, max(case when e%3=1 then u end) as v, max(case when e%3=2 then u end) as w from nodes group by 1,2,3,4) select x.e, x.k, x.j, x.i, round((v.u*x.u_r + v.v*x.u_s + v.w*x.u_t)*2*0.125*a.w*b.w*c.w, 6) as v from wide x join vel v using (e,k,j,i) join w a on a.a=x.i join w b on b.a=x.j join w c on c.a=x.k")
def advection_apply(spark, d):
    a = solver.advection(_velocity(spark, d), "u", ("u", "v", "w"), "adv", N)
    return el.nodes(a, "e", ["adv"], N, ["v"]).withColumn("v", F.round("v", 6))


def _folder(spark) -> str:
    """The shared folder; a run within one process gets a temporary one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        import re
        import tempfile

        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")

        base = tempfile.mkdtemp(prefix="nodeloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base


@query()
def pcg_poisson(spark, d):
    """(A + M) x = b on all elements by preconditioned conjugate gradients: the
    solution v on the unique nodes, with the steps taken and whether the residual
    is below the tolerance."""
    w, tol = solver.weights(N) / 8, 1e-4
    k, j, i = np.indices((N, N, N)).reshape(3, 1, -1)

    def number(e: np.ndarray) -> np.ndarray:
        """The place (gx, gy, gz) of each node in the brick of elements, in one number."""
        e = e[:, None]
        row, layer = np.fmod(e, 8), np.fmod(e, 64)
        gx, gy, gz = 3 * row + i, 3 * ((layer - row) // 8) + j, 3 * ((e - layer) // 64) + k
        return (gz * 64 + gy + 32) * 64 + gx + 32

    kernel = lambda u: solver.weak_laplacian(u, N) + u * w
    rows = arrays(spark, d).withColumn("u", F.transform("u", lambda v: F.coalesce(v, F.lit(0.0))))
    x, steps, rms = solver.solve_in_blocks(rows, "u", number, kernel, solver.jacobi_diagonal(N) + w, w, f"{_folder(spark)}/poisson-{uuid.uuid4().hex}", tol)
    place = {"gx": "(node & 63) - 32", "gy": "(shiftright(node, 6) & 63) - 32", "gz": "shiftright(node, 12)"}
    return x.select(*[F.expr(f).alias(c) for c, f in place.items()], "v", F.lit(steps).alias("steps"), F.lit(rms < tol).alias("small"))


# --- sources and streams ----------------------------------------------------
@query(f"with {SQL_NODES} select e, cast(p as int) as p, round(u + p/10.0::double, 6) as x, round(2*u - p*0.5::double, 6) as t from nodes")
def field_file_roundtrip(spark, d):
    """The whole field in one file, of which two variables are read back by partitions."""
    from nodeloom.sources import fieldfile as ff

    a = arrays(spark, d).selectExpr("e", "transform(u, (v, p) -> v + p / 10.0D) as x", "u as y", "u as z", "transform(u, (v, p) -> 2 * v - p * 0.5D) as t")
    path = f"{_folder(spark)}/field-{uuid.uuid4().hex}"
    ff.write_field(a, path, (N, N, N), time=1.5, files=1)
    got = ff.read_field(spark, path, "x,t")
    return got.select("e", F.posexplode(F.arrays_zip("x", "t")).alias("p", "v")).select("e", "p", F.round("v.x", 6).alias("x"), F.round("v.t", 6).alias("t"))


@query("with n as (select s_suppkey, row_number() over (order by s_suppkey) - 1 as probe_id, s_acctbal from supplier) select probe_id, step, round(step*0.5::double, 6) as time, name, round(case when name='u' then s_acctbal + step else s_acctbal * step end, 6)::double as value from n, range(3) b(step), (values ('u'), ('v')) v(name)")
def probe_csv_roundtrip(spark, d):
    """A probe file of three times for all suppliers, written as text and read."""
    from nodeloom.sources import fieldfile as ff

    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    p = s.join(st.number_elements(s.select("s_suppkey"), element="s_suppkey", out="probe_id"), "s_suppkey")
    n = p.count()
    head = spark.range(1).select(F.lit(0).cast("long").alias("line_no"), F.lit(f"{n},0,0,u,v").alias("text"))
    places = p.select((F.col("probe_id") + 1).alias("line_no"), F.concat_ws(",", "s_suppkey", F.lit("0.0"), F.lit("1.0")).alias("text"))
    steps = p.withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    values = steps.select((F.col("probe_id") + 1 + n * (F.col("step") + 1)).alias("line_no"), F.concat_ws(",", F.col("step") * 0.5, F.col("s_acctbal") + F.col("step"), F.col("s_acctbal") * F.col("step")).alias("text"))
    return ff.read_probes_csv(head.unionByName(places).unionByName(values)).select("probe_id", "step", F.round("time", 6).alias("time"), "name", F.round("value", 6).alias("value"))


@query("with w as (select event_type, event_id, last_value(case when event_id % 3 = 0 then concat('fld', event_id, '.f0') end ignore nulls) over w as file, last_value(case when event_id % 2 = 0 then value end ignore nulls) over w as time from events window w as (partition by event_type order by event_id)) select event_type, event_id as number, file, round(time, 6) as time from w")
def log_index(spark, d):
    """A solver's log per type of event, in several text files; an output has the
    last file name and time that its log told before."""
    from nodeloom.sources import fieldfile as ff

    path = f"{_folder(spark)}/logs-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_type", "event_id", "value").repartitionByRange(4, "event_id").sortWithinPartitions("event_type", "event_id")
    told = F.array_compact(F.array(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("File name : fld"), "event_id", F.lit(".f0"))), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" t = "), "value")), F.lit("noise"), F.concat(F.lit("Output number : "), "event_id")))
    e.select("event_type", F.explode(told).alias("text")).write.partitionBy("event_type").text(path)
    got = ff.index_log(ff.read_lines(spark, path))
    return got.select(F.regexp_extract("log", "event_type=(.*)$", 1).alias("event_type"), "number", "file", F.round("time", 6).alias("time"))


@query("select event_type, count(*) as n, round(sum(value), 2) as total from events group by 1")
def stream_totals(spark, d):
    """A file stream of events folded by event type, in update mode through foreachBatch."""
    base = _folder(spark)
    schema = table(spark, d, "events").schema
    src = f"{base}/steps-{uuid.uuid4().hex}"
    table(spark, d, "events").repartition(3).write.parquet(src)
    out = f"{base}/totals-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}-log").trigger(availableNow=True).foreachBatch(lambda b, k: b.withColumn("k", F.lit(k)).write.mode("overwrite").parquet(f"{out}/k={k:05d}")).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    return rows.groupBy("event_type").agg(F.max_by(F.struct("n", "total"), "k").alias("s")).select("event_type", "s.n", F.round("s.total", 2).alias("total"))


def _whole() -> None:
    """The other modules add their queries when they are imported."""
    for name in MODULES:
        importlib.import_module(f"nodeloom.plans.{name}")


def queries() -> dict:
    _whole()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _whole()
    return dict(SQL)
