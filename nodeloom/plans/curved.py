"""Queries on curved elements: metric terms, gradients, facets, weak operators, mesh check."""

from __future__ import annotations

from pyspark.sql import functions as F

from nodeloom.functions import spectral as sp
from nodeloom.operators import elements as el
from nodeloom.operators import geometry as geo
from nodeloom.plans.catalogue import N, SQL_BRICK, SQL_D, SQL_W, _sql_deriv, brick_arrays, matrix, query

_INVERSE, _DET = geo.cofactors()
_AT = {"r": "i", "s": "j", "t": "k"}


def _sql_metric(fields: dict[str, str] = {}) -> str:  # noqa: B006
    """m: per node of the brick x, y, z, each field, their derivatives, jac, rx .. tz and b."""
    src = "src as (select *" + "".join(f", {expr} as {name}" for name, expr in fields.items() if expr != name) + " from brick)"
    names = ["x", "y", "z", *fields]
    ders = ", ".join(f"d_{c}{a} as ({_sql_deriv(_AT[a], 'd', 'src', c)})" for c in names for a in "rst")
    cols = ", ".join(f"d_{c}{a}.v as {c}{a}" for c in names for a in "rst")
    joins = " ".join(f"join d_{c}{a} using (e, k, j, i)" for c in names for a in "rst")
    joined = f"g as (select src.*, {cols} from src {joins}), h as (select *, {_DET} as jac from g)"
    metric = "m as (select h.*, " + ", ".join(f"{v}/jac as {k}" for k, v in _INVERSE.items()) + ", jac*wa.w*wb.w*wc.w as b from h join w wa on wa.a=i join w wb on wb.a=j join w wc on wc.a=k)"
    return f"with {SQL_BRICK}, {SQL_D}, {SQL_W}, {src}, {ders}, {joined}, {metric}"


def _chain(f: str, c: str) -> str:
    return "(" + " + ".join(f"{f}{a}*{a}{c}" for a in "rst") + ")"


def _metric(spark, d, fields=()):
    return geo.with_mass(geo.metric(geo.with_derivatives(brick_arrays(spark, d), list(fields), N)), N)


def _rounded(df, keys, columns, digits=6):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in columns])


_TERMS = ["jac", *_INVERSE, "b"]


@query(f"{_sql_metric()} select e, k, j, i, " + ", ".join(f"round({c}, 6) as {c}" for c in _TERMS) + " from m")
def metric_terms(spark, d):
    return _rounded(_metric(spark, d), ["e", "k", "j", "i"], _TERMS)


@query(f"{_sql_metric()} select e, round(sum(b), 6) as volume from m group by e")
def element_volume(spark, d):
    return _metric(spark, d).groupBy("e").agg(F.round(F.sum("b"), 6).alias("volume"))


@query(f"{_sql_metric({'u': 'u'})} select e, k, j, i, " + ", ".join(f"round({_chain('u', c)}, 5) as u_{c}" for c in "xyz") + " from m")
def gradient_xyz(spark, d):
    g = geo.gradient(_metric(spark, d, ["u"]), ["u"])
    return _rounded(g, ["e", "k", "j", "i"], ["u_x", "u_y", "u_z"], 5)


_FLOW = {"f1": "u", "f2": "u*y", "f3": "z*z - u"}


def _flow(spark, d):
    a = brick_arrays(spark, d).withColumns({"f1": F.col("u"), "f2": F.zip_with("u", "ys", lambda p, q: p * q), "f3": F.zip_with("zs", "u", lambda p, q: p * p - q)})
    return geo.gradient(geo.metric(geo.with_derivatives(a, list(_FLOW), N)), list(_FLOW))


for _sign, _name in ((1, "strain_tensor_xyz"), (-1, "rotation_tensor_xyz")):
    _pairs = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)] if _sign > 0 else [(0, 1), (0, 2), (1, 2)]
    _shown = ", ".join(f"round(0.5*({_chain(f'f{i + 1}', 'xyz'[j])} {'+' if _sign > 0 else '-'} {_chain(f'f{j + 1}', 'xyz'[i])}), 5) as t{i + 1}{j + 1}" for i, j in _pairs)

    def _tensor(spark, d, sign=_sign):
        t = geo.strain(("f1", "f2", "f3"), sign)
        return _flow(spark, d).select("e", "k", "j", "i", *[F.round(c, 5).alias(f"t{k}") for k, c in t.items()])

    _tensor.__name__ = _name
    query(f"{_sql_metric(_FLOW)} select e, k, j, i, {_shown} from m")(_tensor)


def _sql_facets() -> str:
    tangents, out = {"i": "st", "j": "rt", "k": "rs"}, []
    for f, (fixed, end, sign) in enumerate(geo.FACETS):
        a, b = tangents[fixed]
        p, q = [c for c in "ijk" if c != fixed]
        cross = [f"{sign}*({u}{a}*{v}{b} - {v}{a}*{u}{b})" for u, v in (("y", "z"), ("z", "x"), ("x", "y"))]
        out.append(f"select e, {f} as facet, k, j, i, {cross[0]} as cx, {cross[1]} as cy, {cross[2]} as cz, p.w*q.w as ww from m join w p on p.a=m.{p} join w q on q.a=m.{q} where {fixed} = {(N - 1) * end}")
    return " union all ".join(out)


@query(f"{_sql_metric()}, fc as ({_sql_facets()}), fn as (select *, sqrt(cx*cx+cy*cy+cz*cz) as norm from fc) select e, facet, round(sum(norm*ww), 6) as area, round(sum(cx*ww), 6) as ax, round(sum(cy*ww), 6) as ay, round(sum(cz*ww), 6) as az from fn group by e, facet")
def facet_areas(spark, d):
    """Area of each facet, and its outward normal times area."""
    f = geo.facet_nodes(geo.with_derivatives(brick_arrays(spark, d), [], N), N)
    return f.groupBy("e", "facet").agg(F.round(F.sum("area"), 6).alias("area"), *[F.round(F.sum(F.col("area") * F.col(f"n{c}")), 6).alias(f"a{c}") for c in "xyz"])


def _sql_stiffness() -> str:
    metric = {(a, b): "(" + " + ".join(f"{a}{c}*{b}{c}" for c in "xyz") + ")" for a in "rst" for b in "rst"}
    flux = ", ".join(f"b*({' + '.join(f'{metric[a, b]}*u{b}' for b in 'rst')}) as f{a}" for a in "rst")
    parts = " union all ".join(_sql_deriv(_AT[a], "dt_", "fl", f"f{a}") for a in "rst")
    return f"{_sql_metric({'u': 'u'})}, {matrix('dt_', sp.derivative(N).T)}, fl as (select e, k, j, i, {flux} from m) select e, k, j, i, round(sum(v), 5) as v from ({parts}) group by e, k, j, i"


@query(_sql_stiffness())
def stiffness_curved(spark, d):
    a = geo.stiffness(brick_arrays(spark, d), "u", "v", N)
    return el.nodes(a, "e", ["v"], N).withColumn("v", F.round("v", 5))


@query(f"{_sql_metric({'u': 'u'})} select e, k, j, i, round(b*(u*{_chain('u', 'x')} + y*{_chain('u', 'y')} + z*{_chain('u', 'z')}), 5) as v from m")
def advection_curved(spark, d):
    a = geo.advection(brick_arrays(spark, d), "u", ("u", "ys", "zs"), "v", N)
    return el.nodes(a, "e", ["v"], N).withColumn("v", F.round("v", 5))


# Half distances of four nodes at -1, -1/sqrt(5), 1/sqrt(5), 1: the ends have one neighbour.
_SQL_HALF = "hh(a, h) as (values (0, (1 - 1/sqrt(5.0::double))/2), (1, (1 + 1/sqrt(5.0::double))/2), (2, (1 + 1/sqrt(5.0::double))/2), (3, (1 - 1/sqrt(5.0::double))/2))"


def _tilted(spark, d):
    """The brick turned about z and sheared, so that no reference axis runs along one of space."""
    a = brick_arrays(spark, d)
    turned = {"xs": lambda x, y: 0.8 * x - 0.6 * y, "ys": lambda x, y: 0.6 * x + 0.8 * y}
    return a.select("e", "u", *[F.zip_with("xs", "ys", f).alias(c) for c, f in turned.items()], F.zip_with("zs", "xs", lambda z, x: z + 0.5 * x).alias("zs"))


_TILTED = {"px": "0.8::double*x - 0.6::double*y", "py": "0.6::double*x + 0.8::double*y", "pz": "z + 0.5::double*x"}


@query(f"{_sql_metric(_TILTED)}, {_SQL_HALF} select e, " + ", ".join(f"round(max(sqrt(p{c}r*hr.h*p{c}r*hr.h + p{c}s*hs.h*p{c}s*hs.h + p{c}t*ht.h*p{c}t*ht.h)), 6) as h{c}" for c in "xyz") + " from m join hh hr on hr.a=i join hh hs on hs.a=j join hh ht on ht.a=k group by e")
def mesh_check(spark, d):
    """Largest node spacing per element and axis of space, on tilted elements."""
    return geo.spacing(_tilted(spark, d), N).groupBy("e").agg(*[F.round(F.max(f"h{c}"), 6).alias(f"h{c}") for c in "xyz"])


_PR, _RA = 0.5, 100.0
_MU, _LAMB = "sqrt(0.5::double/100)", "(1/sqrt(0.5::double*100))"
_STRAIN_SQ = " + ".join(f"power({_chain(f'f{i + 1}', 'xyz'[j])} + {_chain(f'f{j + 1}', 'xyz'[i])}, 2)" for i in range(3) for j in range(3))
_HEAT = " + ".join(f"power({_chain('u', c)}, 2)" for c in "xyz")
_HXYZ = ", ".join(f"sqrt({c}r*hr.h*{c}r*hr.h + {c}s*hs.h*{c}s*hs.h + {c}t*ht.h*{c}t*ht.h) as h{c}" for c in "xyz")


@query(f"{_sql_metric(_FLOW | {'u': 'u'})}, {_SQL_HALF}, q as (select e, b, 2.5*2*{_MU}*0.25*({_STRAIN_SQ}) as eps_k, 2.5*{_LAMB}*({_HEAT}) as eps_t, {_HXYZ} from m join hh hr on hr.a=i join hh hs on hs.a=j join hh ht on ht.a=k), whole as (select sum(eps_k*b)/sum(b) as k, sum(eps_t*b)/sum(b) as t from q), el as (select e, sum(eps_k*b)/sum(b) as eps, " + ", ".join(f"sum(h{c}*b)/sum(b) as h{c}" for c in "xyz") + f" from q group by e) select e, round(eps, 3) as eps_k, round(power(power({_MU}, 3)/eps, 0.25), 6) as eta, " + ", ".join(f"round(h{c}/power(power({_MU}, 3)/eps, 0.25), 5) as h{c}" for c in "xyz") + f", round(power(power({_MU}, 3)/k, 0.25), 6) as eta_all, round(1 + k/(power({_MU}, 3)*100/0.25), 3) as nu_k, round(t/{_LAMB}, 3) as nu_t from el, whole")
def mesh_kolmogorov(spark, d):
    """Node spacing in Kolmogorov lengths, from the dissipation of two fields in time."""
    a = brick_arrays(spark, d).withColumns({"f1": F.col("u"), "f2": F.zip_with("u", "ys", lambda p, q: p * q), "f3": F.zip_with("zs", "u", lambda p, q: p * p - q)})
    fields = ["f1", "f2", "f3", "u"]
    steps = None
    for s in (1, 2):
        of = a.select("e", "xs", "ys", "zs", *[F.expr(f"transform({f}, v -> v * {s})").alias(f) for f in fields])
        n = geo.gradient(geo.with_mass(geo.metric(geo.spacing(of, N, fields=tuple(fields))), N), fields)
        n = geo.dissipation(n, ("f1", "f2", "f3"), "u", _PR, _RA).select("e", "k", "j", "i", "b", "hx", "hy", "hz", "eps_k", "eps_t")
        steps = n if steps is None else steps.unionByName(n)
    mean = steps.groupBy("e", "k", "j", "i").agg(*[F.avg(c).alias(c) for c in ("b", "hx", "hy", "hz", "eps_k", "eps_t")])
    digits = {"eps_k": 3, "eta": 6, "hx": 5, "hy": 5, "hz": 5, "eta_all": 6, "nu_k": 3, "nu_t": 3}
    return geo.in_kolmogorov_units(mean, _PR, _RA).select("e", *[F.round(c, k).alias(c) for c, k in digits.items()])
