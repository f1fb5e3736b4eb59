"""Turbulence statistics and budgets as plain arithmetic over named columns.

Names: U V W P means; uu .. products of instantaneous components; dUdx first and
d2Udx2 pure second derivatives, and so on for every column. Symmetric pairs come
in the order 11 22 33 12 13 23. Everything is one projection: no shuffle."""

from __future__ import annotations

from itertools import combinations_with_replacement as combos

C, X = "UVW", "xyz"
PAIRS = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]


def low(*idx: int) -> str:
    return "".join("uvw"[i] for i in sorted(idx))


def moments() -> dict[str, str]:
    """Averages of products up to the fourth order over u, v, w, p."""
    out = {x.upper(): f"avg({x})" for x in "uvwp"}
    out |= {a + b: f"avg({a}*{b})" for a, b in combos("uvw", 2)} | {"pp": "avg(p*p)", "ppp": "avg(p*p*p)", "pppp": "avg(p*p*p*p)"}
    out |= {a + b + c: f"avg({a}*{b}*{c})" for a, b, c in combos("uvw", 3)}
    return out | {f"{a}{a}{a}{a}": f"avg({a}*{a}*{a}*{a})" for a in "uvw"} | {f"p{a}": f"avg(p*{a})" for a in "uvw"}


def reynolds() -> dict[str, str]:
    return {f"R{low(i, j)}": f"({low(i, j)} - {C[i]}*{C[j]})" for i, j in PAIRS}


def R(i: int, j: int) -> str:
    return f"({low(i, j)} - {C[i]}*{C[j]})"


def d(name: str, k: int) -> str:
    return f"d{name}d{X[k]}"


def d2(name: str, k: int) -> str:
    return f"d2{name}d{X[k]}2"


def dR(i: int, j: int, k: int) -> str:
    return f"({d(low(i, j), k)} - {C[i]}*{d(C[j], k)} - {C[j]}*{d(C[i], k)})"


def plus(terms) -> str:
    return "(" + " + ".join(terms) + ")"


def central() -> dict[str, str]:
    """Third central moments of all triples, fourth of the components."""
    out = {}
    for i, j, k in combos(range(3), 3):
        out[f"C{low(i, j, k)}"] = f"({low(i, j, k)} - {C[i]}*{C[j]}*{C[k]} - {C[i]}*{R(j, k)} - {C[j]}*{R(i, k)} - {C[k]}*{R(i, j)})"
    for i in range(3):
        u, q = C[i], low(i) * 4
        third = f"({low(i) * 3} - {u}*{u}*{u} - 3*{u}*{R(i, i)})"
        out[f"C{q}"] = f"({q} - {u}*{u}*{u}*{u} - 6*{u}*{u}*{R(i, i)} - 4*{u}*{third})"
    return out


def production() -> dict[str, str]:
    return {f"prod_{low(i, j)}": "-" + plus(f"({R(i, k)}*{d(C[j], k)} + {R(j, k)}*{d(C[i], k)})" for k in range(3)) for i, j in PAIRS}


def convection() -> dict[str, str]:
    return {f"conv_{low(i, j)}": "-" + plus(f"{C[k]}*{dR(i, j, k)}" for k in range(3)) for i, j in PAIRS}


def dissipation(re: float) -> dict[str, str]:
    return {f"diss_{low(i, j)}": f"(-2.0/{re})*(e{low(i, j)} - {plus(f'{d(C[i], k)}*{d(C[j], k)}' for k in range(3))})" for i, j in PAIRS}


def turbulent_transport() -> dict[str, str]:
    out = {}
    for i, j in PAIRS:
        terms = plus(f"(-{d(low(i, j, k), k)} + {C[i]}*{C[k]}*{d(C[j], k)} + {C[j]}*{C[k]}*{d(C[i], k)} + {C[i]}*{dR(j, k, k)} + {C[j]}*{dR(i, k, k)})" for k in range(3))
        out[f"turb_{low(i, j)}"] = f"({terms} - ({convection()[f'conv_{low(i, j)}']}) - ({production()[f'prod_{low(i, j)}']}))"
    return out


def viscous_diffusion(re: float) -> dict[str, str]:
    return {f"visc_{low(i, j)}": f"(1.0/{re})*" + plus(f"({d2(low(i, j), k)} - {C[i]}*{d2(C[j], k)} - {C[j]}*{d2(C[i], k)} - 2*{d(C[i], k)}*{d(C[j], k)})" for k in range(3)) for i, j in PAIRS}


def pressure_strain() -> dict[str, str]:
    one = lambda i, j: f"(p{d(low(i), j)} - P*{d(C[i], j)})"
    return {f"prs_{low(i, j)}": f"({one(i, j)} + {one(j, i)})" for i, j in PAIRS}


def pressure_transport() -> dict[str, str]:
    one = lambda i, j: f"({d(f'p{low(i)}', j)} - P*{d(C[i], j)} - {C[i]}*{d('P', j)})"
    return {f"ptr_{low(i, j)}": f"-({one(i, j)} + {one(j, i)})" for i, j in PAIRS}


def stress_budget(re: float) -> dict[str, str]:
    """All terms of the six budgets, the velocity-pressure-gradient term, and residuals."""
    terms = production() | convection() | dissipation(re) | turbulent_transport() | viscous_diffusion(re) | pressure_strain() | pressure_transport()
    for i, j in PAIRS:
        p = low(i, j)
        terms[f"vpg_{p}"] = f"(({terms[f'ptr_{p}']}) - ({terms[f'prs_{p}']}))"
        terms[f"res_{p}"] = plus(f"({terms[f'{x}_{p}']})" for x in ("prod", "diss", "turb", "visc", "vpg", "conv"))
    return terms


def energy_budget(re: float) -> dict[str, str]:
    """Half the trace of every term."""
    terms = stress_budget(re)
    return {f"tke_{x}": f"0.5*{plus(f'({terms[f"{x}_{low(i, i)}"]})' for i in range(3))}" for x in ("prod", "diss", "turb", "visc", "vpg", "conv", "res")}


def momentum_budget(re: float) -> dict[str, str]:
    out = {}
    for i in range(3):
        c = low(i)
        out |= {f"mconv_{c}": plus(f"{C[j]}*{d(C[i], j)}" for j in range(3)), f"mpress_{c}": f"-{d('P', i)}", f"mturb_{c}": "-" + plus(dR(i, j, j) for j in range(3)), f"mvisc_{c}": f"(1.0/{re})*" + plus(d2(C[i], j) for j in range(3))}
        out[f"mres_{c}"] = f"(({out[f'mvisc_{c}']}) + ({out[f'mturb_{c}']}) + ({out[f'mpress_{c}']}) - ({out[f'mconv_{c}']}))"
    return out


def scalar_budget(re: float, pr: float) -> dict[str, str]:
    """Mean, variance and flux budgets of a passive scalar S."""
    k = f"(1.0/({re}*{pr}))"
    flux = lambda i: f"({low(i)}s - {C[i]}*S)"
    dflux = lambda i, j: f"({d(f'{low(i)}s', j)} - {C[i]}*{d('S', j)} - S*{d(C[i], j)})"
    var, dvar = "(ss - S*S)", lambda j: f"({d('ss', j)} - 2*S*{d('S', j)})"
    out = {"s_conv": "-" + plus(f"{C[i]}*{d('S', i)}" for i in range(3)), "s_turb": "-" + plus(dflux(i, i) for i in range(3)), "s_diff": f"{k}*" + plus(d2("S", i) for i in range(3))}
    out["s_res"] = plus(f"({out[x]})" for x in ("s_conv", "s_turb", "s_diff"))
    out |= {"s_var": var, "v_conv": "-" + plus(f"{C[i]}*{dvar(i)}" for i in range(3)), "v_prod": "-2*" + plus(f"{flux(i)}*{d('S', i)}" for i in range(3))}
    out["v_turb"] = "-" + plus(f"({d(f'{low(i)}ss', i)} - {C[i]}*{d('ss', i)} - ss*{d(C[i], i)} - 2*S*{dflux(i, i)} - 2*{flux(i)}*{d('S', i)})" for i in range(3))
    out["v_diff"] = f"{k}*" + plus(f"({d2('ss', i)} - 2*{d('S', i)}*{d('S', i)} - 2*S*{d2('S', i)})" for i in range(3))
    out["v_diss"] = f"(-2*{k})*(es - " + plus(f"{d('S', i)}*{d('S', i)}" for i in range(3)) + ")"
    out["v_res"] = plus(f"({out[x]})" for x in ("v_conv", "v_prod", "v_turb", "v_diff", "v_diss"))
    for i in range(3):
        c = low(i)
        out[f"f_conv_{c}"] = "-" + plus(f"{C[j]}*{dflux(i, j)}" for j in range(3))
        out[f"f_gradu_{c}"] = "-" + plus(f"{flux(j)}*{d(C[i], j)}" for j in range(3))
        out[f"f_grads_{c}"] = "-" + plus(f"{R(i, j)}*{d('S', j)}" for j in range(3))
    return out


def names_in(formulas: dict[str, str]) -> list[str]:
    """Column names that formulas read, in order of first use."""
    import re

    return list(dict.fromkeys(x for f in formulas.values() for x in re.findall(r"[A-Za-z_]\w*", f) if x not in ("avg",)))


def augmented(u: tuple[str, str, str], p: str, grad) -> dict[str, str]:
    """The 44 statistics of a velocity u and a pressure p at a node, by name;
    grad(f, c): the derivative of component f along c."""
    out = {x: f for x, f in zip("UVW", u, strict=True)} | {"P": p, "PP": f"{p}*{p}"}
    at = dict(zip("UVW", u, strict=True))
    second = ["UU", "VV", "WW", "UV", "UW", "VW"]
    third = ["UUU", "VVV", "WWW", "UUV", "UUW", "UVV", "UVW", "VVW", "UWW", "VWW"]
    fourth = ["UUUU", "VVVV", "WWWW"]
    out |= {name: "*".join(at[c] for c in name) for name in [*second, *third, *fourth]}
    out |= {"PPP": f"{p}*{p}*{p}", "PPPP": f"{p}*{p}*{p}*{p}"} | {f"P{c}": f"{p}*{at[c]}" for c in "UVW"}
    out |= {f"PD{c}D{x.upper()}": f"{p}*{grad(at[c], x)}" for c in "UVW" for x in "xyz"}
    pairs = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]
    return out | {f"E{i + 1}{j + 1}": "(" + " + ".join(f"{grad(u[i], x)}*{grad(u[j], x)}" for x in "xyz") + ")" for i, j in pairs}


def derived() -> dict[str, tuple[str, int, str]]:
    """The 99 derivatives that the budgets need: name -> (statistic, order, axis),
    as d() and d2() name them."""
    pairs, triples = [low(i, j) for i, j in PAIRS], [low(*t) for t in combos(range(3), 3)]
    out: dict[str, tuple[str, int, str]] = {}
    for names, orders in ((list(C), (1, 2)), (["P"], (1, 2)), ([f"P{c}" for c in C], (1,)), (pairs, (1, 2)), (triples, (1,))):
        for name in names:
            for order in orders:
                out |= {(d if order == 1 else d2)(name, k): (name, order, X[k]) for k in range(3)}
    return out


def derived_scalar() -> dict[str, list[tuple[str, int, str]]]:
    """The 34 derivatives of the scalar's statistics: name -> terms that add up.
    Flux and gradient statistics are named by their factors: uS, uSS, uuS, PS,
    UdSdx, SdUdx."""
    out: dict[str, list[tuple[str, int, str]]] = {}
    for name in ("S", "SS"):
        for order in (1, 2):
            out |= {(d if order == 1 else d2)(name, k): [(name, order, X[k])] for k in range(3)}
    out |= {d(f"{low(i)}S", k): [(f"{low(i)}S", 1, X[k])] for i in range(3) for k in range(3)}
    out["div_uSS"] = [(f"{low(j)}SS", 1, X[j]) for j in range(3)]
    out |= {f"div_{low(i)}uS": [(f"{low(i, j)}S", 1, X[j]) for j in range(3)] for i in range(3)}
    out |= {d("PS", k): [("PS", 1, X[k])] for k in range(3)}
    out |= {f"div_{C[i]}dS": [(f"{C[i]}dSd{X[j]}", 1, X[j]) for j in range(3)] for i in range(3)}
    return out | {f"div_Sd{C[i]}": [(f"Sd{C[i]}d{X[j]}", 1, X[j]) for j in range(3)] for i in range(3)}
