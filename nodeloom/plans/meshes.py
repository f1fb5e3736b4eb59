"""Queries on connectivity by coordinates, columns of elements, extrusion,
orientation, second derivatives and the augmented statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nodeloom.operators import budgets as bg
from nodeloom.operators import connectivity as co
from nodeloom.operators import elements as el
from nodeloom.operators import geometry as geo
from nodeloom.operators import statistics as st
from nodeloom.plans.catalogue import N, SQL_NODES, SQL_W, SQL_X, _outputs, _sql_deriv, arrays, brick_arrays, query, table
from nodeloom.plans.curved import _AT, _FLOW, _chain, _sql_metric

TOL = 1e-7
SQL_FLAT = f"{SQL_NODES}, {SQL_X}, flat as (select n.*, 3*(e%8)+i as gx, 3*((e//8)%8)+j as gy, 3*(e//64)+k as gz, (e%8)+a.x as x, ((e//8)%8)+b.x as y, (e//64)+c.x as z from nodes n join gx a on a.a=n.i join gx b on b.a=n.j join gx c on c.a=n.k)"


def _shaken(spark, d):
    """The straight brick, its coordinates off by up to some 1e-8."""
    n = el.nodes(brick_arrays(spark, d, 0.0), "e", ["u", "xs", "ys", "zs"], N, ["u", "x", "y", "z"])
    shake = (F.pmod(F.xxhash64("e", "k", "j", "i"), F.lit(1000)) - 500) * 4e-11
    return n.withColumns({c: F.col(c) + shake for c in "xyz"}).withColumn("node", F.expr("e * 64 + k * 16 + j * 4 + i"))


@query(f"with {SQL_FLAT}, v as (select e, cast(i//3 + 2*(j//3) + 4*(k//3) as int) as vertex, gx, gy, gz from flat where i%3=0 and j%3=0 and k%3=0) select a.e, a.vertex, b.e as e2, b.vertex as vertex2 from v a join v b using (gx, gy, gz) where a.e <> b.e")
def shared_vertices(spark, d):
    """Vertices of different elements in the same place, within a tolerance."""
    return co.shared(el.vertices(_shaken(spark, d), N), "vertex", ["x", "y", "z"], TOL)


_SQL_FACETS = " union all ".join(f"select e, {f} as facet, min(gx)+max(gx) as cx, min(gy)+max(gy) as cy, min(gz)+max(gz) as cz from flat where {c} = {v} group by e" for f, (c, v) in enumerate([("i", 0), ("i", 3), ("j", 0), ("j", 3), ("k", 0), ("k", 3)]))


@query(f"with {SQL_FLAT}, f as ({_SQL_FACETS}) select e, facet from f a where not exists (select 1 from f b where a.cx=b.cx and a.cy=b.cy and a.cz=b.cz and a.e<>b.e)")
def boundary_facets(spark, d):
    """Facets that no other element shares: the incomplete ones."""
    centres = el.entity_centres(_shaken(spark, d), N, "facet")
    return co.incomplete(centres, "facet", ["cx", "cy", "cz"], TOL)


@query(f"with {SQL_FLAT} select e, k, j, i, round(sum(u) over (partition by gx, gy, gz), 6) as total, count(*) over (partition by gx, gy, gz) as copies from flat")
def dssum_coordinates(spark, d):
    """Gather-scatter without any numbering: nodes are shared where their coordinates agree."""
    g = co.gather_scatter(_shaken(spark, d), "node", "u", ["x", "y", "z"], TOL)
    return g.select("e", "k", "j", "i", F.round("total", 6).alias("total"), "copies")


_SQL_PLACES = f"with {SQL_FLAT}, l as (select *, e*64 + k*16 + j*4 + i as node, min(e*64 + k*16 + j*4 + i) over (partition by gx, gy, gz) as label from flat), pl as (select *, dense_rank() over (order by label) - 1 as place from l)"


@query(f"{_SQL_PLACES} select e, k, j, i, place from pl")
def global_places(spark, d):
    """Dense numbers of the distinct places of all nodes, from coordinates alone."""
    n = _shaken(spark, d)
    return n.join(co.numbered_places(n, "node", ["x", "y", "z"], TOL, 1000), "node").select("e", "k", "j", "i", "place")


@query(f"{_SQL_PLACES}, c(cell, k, j, i) as (select cast(c as int), cast(c // 9 as int), cast(c // 3 % 3 as int), cast(c % 3 as int) from range(27) t(c)), o(corner, dk, dj, di) as (values (0,0,0,0),(1,0,0,1),(2,0,1,1),(3,0,1,0),(4,1,0,0),(5,1,0,1),(6,1,1,1),(7,1,1,0)) select pl.e, c.cell, o.corner, pl.place from c, o, pl where pl.k = c.k + o.dk and pl.j = c.j + o.dj and pl.i = c.i + o.di")
def global_cells(spark, d):
    """Linear hexahedra of all elements by the global numbers of their corners."""
    cells = co.global_cells(co.numbered_places(_shaken(spark, d), "node", ["x", "y", "z"], TOL, 1000), "node", N)
    return cells.select("e", "cell", F.posexplode("ids").alias("corner", "place"))


_SQL_EDGES = " union all ".join(f"select e, {k} as edge, j, i, gx, gy from flat2 where {c} = {v}" for k, (c, v) in enumerate([("j", 0), ("j", 3), ("i", 0), ("i", 3)]))


@query(f"with {SQL_FLAT}, flat2 as (select * replace (gx + 27*(e//64) as gx) from flat where k = 0), en as ({_SQL_EDGES}), c as (select e, edge, min(gx)+max(gx) as cx, min(gy)+max(gy) as cy from en group by e, edge), free as (select e, edge from c a where not exists (select 1 from c b where a.cx=b.cx and a.cy=b.cy and a.e<>b.e)) select e, edge, j, i from en join free using (e, edge) where gx - 27*(e//64) <= 12")
def boundary_nodes_2d(spark, d):
    """The lowest faces of all layers as two-dimensional meshes side by side: nodes on their boundaries with x at most 4."""
    aside = F.expr("9.0D * (e div 64)")
    flat = _shaken(spark, d).where("k = 0").select("e", "j", "i", (F.col("x") + aside).alias("x"), "y")
    return co.boundary_nodes_2d(flat, N, TOL, F.col("x") - aside <= 4 + 1e-6)


@query(f"with {SQL_FLAT}, {SQL_W}, m as (select f.*, a.w*b.w*c.w/8 as b from flat f join w a on a.a=f.i join w b on b.a=f.j join w c on c.a=f.k), o as (select *, min(e) over (partition by e%64) as owner from m) select owner, j, i, round(sum(u*b)/sum(b), 6) as u, round(sum(b), 6) as weight from o group by owner, j, i")
def column_average(spark, d):
    """Mean along z over the columns of elements that share a centroid in x and y."""
    n = _shaken(spark, d).withColumn("b", el.mass(N) / 8)
    return co.column_average(n, ["u"], TOL).select("owner", "j", "i", F.round("u", 6).alias("u"), F.round("weight", 6).alias("weight"))


@query(f"with {SQL_FLAT}, h(k, z) as (values (0, 0.0::double), (1, 0.25::double), (2, 1.0::double)) select e, cast(h.k as int) as k, j, i, round(x, 6) as x, round(y, 6) as y, round(h.z, 6) as z, round(u, 6) as u from flat, h where flat.k = 0")
def extrude_layer(spark, d):
    flat = el.nodes(brick_arrays(spark, d, 0.0), "e", ["u", "xs", "ys"], N, ["u", "x", "y"]).where("k = 0")
    out = co.extrude(flat, [0.0, 0.25, 1.0], ["x", "y", "u"])
    return out.select("e", "k", "j", "i", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "u")])


def _turned(spark, d):
    """Every second element has i along z and k along x, downwards."""
    n = el.nodes(brick_arrays(spark, d, 0.0), "e", ["u", "xs", "ys", "zs"], N, ["u", "x", "y", "z"])
    odd = F.col("e") % 2 == 1
    i, k = F.when(odd, F.col("k")).otherwise(F.col("i")), F.when(odd, 3 - F.col("i")).otherwise(F.col("k"))
    return n.withColumn("i2", i).withColumn("k2", k).select("e", F.col("k2").alias("k"), "j", F.col("i2").alias("i"), "u", "x", "y", "z")


@query("select vec_id as e, case when vec_id%2=1 then 2 else 0 end as i_axis, 1 as i_sign, 1 as j_axis, 1 as j_sign, case when vec_id%2=1 then 0 else 2 end as k_axis, case when vec_id%2=1 then -1 else 1 end as k_sign from embeddings")
def axis_orientation(spark, d):
    return co.orientation(_turned(spark, d), N)


@query(f"with {SQL_NODES} select e, k, j, i, round(u, 6) as u from nodes")
def axis_reorder(spark, d):
    """Turned elements come back to the order of the straight brick."""
    return co.reorder(_turned(spark, d), N).select("e", "k", "j", "i", F.round("u", 6).alias("u"))


# --- derivatives of statistics ------------------------------------------------
_FIRST = ", ".join(f"{_chain('u', c)} as u_{c}" for c in "xyz")
_SECOND_DERS = ", ".join(f"s_{c}{a} as ({_sql_deriv(_AT[a], 'd', 'first1', f'u_{c}')})" for c in "xyz" for a in "rst")
_SECOND = ", ".join("round(" + " + ".join(f"s_{c}{a}.v*{a}{c}" for a in "rst") + f", 4) as u_{c}{c}" for c in "xyz")
_SECOND_JOIN = " ".join(f"join s_{c}{a} using (e, k, j, i)" for c in "xyz" for a in "rst")


@query(f"{_sql_metric({'u': 'u'})}, first1 as (select *, {_FIRST} from m), {_SECOND_DERS} select e, k, j, i, round(u_x, 5) as u_x, round(u_y, 5) as u_y, round(u_z, 5) as u_z, {_SECOND} from first1 {_SECOND_JOIN}")
def scalar_derivatives(spark, d):
    """First and pure second derivatives in space of a field on curved elements."""
    out = geo.space_derivatives(brick_arrays(spark, d), ["u"], N)
    n = el.nodes(out, "e", ["u_x", "u_y", "u_z", "u_xx", "u_yy", "u_zz"], N)
    return n.select("e", "k", "j", "i", *[F.round(f"u_{c}", 5).alias(f"u_{c}") for c in "xyz"], *[F.round(f"u_{c}{c}", 4).alias(f"u_{c}{c}") for c in "xyz"])


_AUG_SQL = bg.augmented(("f1", "f2", "f3"), "u", _chain)


@query(f"{_sql_metric(_FLOW)} select e, " + ", ".join(f"round(sum(b*({f}))/sum(b), 4) as {k.lower()}_" for k, f in _AUG_SQL.items()) + " from m group by e")
def augmented_statistics(spark, d):
    """The 44 statistics of a flow, averaged by mass over each element."""
    a = brick_arrays(spark, d).withColumns({"f1": F.col("u"), "f2": F.zip_with("u", "ys", lambda p, q: p * q), "f3": F.zip_with("zs", "u", lambda p, q: p * p - q)})
    n = geo.with_mass(geo.metric(geo.with_derivatives(a, list(_FLOW), N, keep=("u",))), N)
    n = geo.gradient(n, list(_FLOW))
    cols = bg.augmented(("f1", "f2", "f3"), "u", lambda f, c: f"{f}_{c}")
    return n.groupBy("e").agg(*[F.round(F.sum(F.col("b") * F.expr(f)) / F.sum("b"), 4).alias(f"{k.lower()}_") for k, f in cols.items()])


def _sql_derived(wanted: dict, factor: dict[str, int]) -> str:
    term = lambda f, order, axis: f"{factor[f]}*{f'u_{axis}' if order == 1 else f'({" + ".join(f"s_{axis}{a}.v*{a}{axis}" for a in "rst")})'}"
    shown = ", ".join(f"round(avg({' + '.join(term(*t) for t in terms)}), 3) as {name}" for name, terms in wanted.items())
    return f"{_sql_metric({'u': 'u'})}, first1 as (select *, {_FIRST} from m), {_SECOND_DERS} select e, {shown} from first1 {_SECOND_JOIN} group by e"


_DERIVED = {name: [term] for name, term in bg.derived().items()}
for _name, _wanted in (("derived_statistics", _DERIVED), ("derived_scalar_statistics", bg.derived_scalar())):
    _factor = {f: k % 9 + 1 for k, f in enumerate(dict.fromkeys(f for terms in _wanted.values() for f, _, _ in terms))}

    def _derived(spark, d, wanted=_wanted, factor=_factor):
        """Derivative columns of a solver's statistics (multiples of a field here), averaged over each element's nodes."""
        a = brick_arrays(spark, d)
        a = a.select("e", "xs", "ys", "zs", *[F.expr(f"transform(u, v -> {k} * v)").alias(f) for f, k in factor.items()])
        out = geo.derived_statistics(a, wanted, N)
        mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
        return out.select("e", *[F.round(mean(c), 3).alias(c) for c in wanted])

    _derived.__name__ = _name
    query(_sql_derived(_wanted, _factor))(_derived)


# --- averages with start times --------------------------------------------------
_LONG = 200_000.0
_STARTED = "idx as (select user_id, event_id, value, t, row_number() over w - 1 as idx, t - coalesce(lag(t) over w, start) as dt from (select *, epoch_us(ts)/1000000.0::double as t, (select min(epoch_us(ts))/1000000.0::double from events) as start from events) window w as (partition by user_id order by t, event_id))"


@query(f"with recursive {_STARTED}, run as (select user_id, event_id, idx, dt, dt as total, case when dt > {_LONG * 1.05} then 1 else 0 end as batch from idx where idx = 0 union all select n.user_id, n.event_id, n.idx, n.dt, case when r.total + n.dt > {_LONG * 1.05} then n.dt else r.total + n.dt end, case when r.total + n.dt > {_LONG * 1.05} then r.batch + 1 else r.batch end from run r join idx n on n.user_id = r.user_id and n.idx = r.idx + 1) select user_id, event_id, round(dt, 3) as dt, cast(batch as bigint) as batch from run")
def time_batches_started(spark, d):
    """Batches whose first interval begins with the run; a first interval that is too long leaves batch 0 empty."""
    o = _outputs(spark, d)
    start = o.agg(F.min("time")).first()[0]
    i = st.file_index(o, "user_id", ["time", "event_id"], "time", start=F.lit(start)).select("user_id", "event_id", "time", "dt", "value")
    return st.time_batches(i, "user_id", ["time", "event_id"], _LONG, empty_first=True).select("user_id", "event_id", F.round("dt", 3).alias("dt"), "batch")


# --- general rotation ------------------------------------------------------------
_Q = {"11": "c", "12": "s", "13": "0", "21": "-s*0.6", "22": "c*0.6", "23": "0.8", "31": "s*0.8", "32": "-c*0.8", "33": "0.6"}
_T6 = dict(zip(("11", "22", "33", "12", "13", "23"), range(1, 7), strict=True))


def _sym(i: int, j: int) -> str:
    return f"{min(i, j)}{max(i, j)}"


_TURN = {k: " + ".join(f"q{k[0]}{a}*q{k[1]}{b}*t{_sym(a, b)}" for a in (1, 2, 3) for b in (1, 2, 3)) for k in _T6}


@query("with b as (select vec_id as e, cos(vec_id*0.1::double) as c, sin(vec_id*0.1::double) as s, " + ", ".join(f"cast(embedding[{n}] as double) as t{k}" for k, n in _T6.items()) + " from embeddings), q as (select *, " + ", ".join(f"{v}::double as q{k}" if v == "0" else f"({v})::double as q{k}" for k, v in _Q.items()) + " from b) select e, " + ", ".join(f"round({v}, 5) as t{k}" for k, v in _TURN.items()) + " from q")
def rotate_general(spark, d):
    """Six-component tensors turned into bases that are given by three vectors per point."""
    a = arrays(spark, d).withColumns({"c": F.cos(F.col("e") * 0.1), "s": F.sin(F.col("e") * 0.1)})
    vectors = [[F.expr(_Q[f"{i}{j}"].replace("0.6", "0.6D").replace("0.8", "0.8D")).cast("double") for j in (1, 2, 3)] for i in (1, 2, 3)]
    t = st.rotate_six(st.basis(*vectors), {k: F.col("u")[n - 1] for k, n in _T6.items()})
    return a.select("e", *[F.round(c, 5).alias(f"t{k}") for k, c in t.items()])


@query("select p_partkey, p_size from (select p_partkey, p_size, p_brand from part) where p_brand in (select p_brand from part where p_size > 40 intersect select p_brand from part where p_size < 5 except select p_brand from part where p_size = 25 and p_partkey % 7 = 0)")
def set_operations(spark, d):
    """Candidates that two searches agree on, without those that a third one rules out."""
    p = table(spark, d, "part")
    brands = p.where("p_size > 40").select("p_brand").intersect(p.where("p_size < 5").select("p_brand")).exceptAll(p.where("p_size = 25 and p_partkey % 7 = 0").select("p_brand").distinct())
    return p.join(brands, "p_brand", "left_semi").select("p_partkey", "p_size")


@query("select l_suppkey, count(distinct l_partkey) as parts, count(distinct l_returnflag) as modes from lineitem group by 1")
def distinct_counts(spark, d):
    t = table(spark, d, "lineitem")
    return t.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_returnflag").alias("modes"))


@query("select user_id, event_id, round(t, 3) as time from (select user_id, event_id, epoch_us(ts)/1000000.0::double as t, row_number() over (partition by user_id order by epoch_us(ts) desc, event_id desc) as n from events) where n <= 3")
def last_outputs(spark, d):
    """The three latest outputs of each series."""
    latest = W.partitionBy("user_id").orderBy(F.desc("time"), F.desc("event_id"))
    return _outputs(spark, d).withColumn("n", F.row_number().over(latest)).where("n <= 3").select("user_id", "event_id", F.round("time", 3).alias("time"))
