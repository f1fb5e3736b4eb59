"""Queries on decompositions along a homogeneous direction and of analytic signals."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from nodeloom.operators import elements as el
from nodeloom.operators import rom
from nodeloom.operators import spectral_pod as sp
from nodeloom.plans.catalogue import N, SQL_NODES, _blocks, _folder, arrays, query

_LINES = f"{SQL_NODES}, t as (select e, k, j, kappa, sum(u*cos(2*pi()*kappa*i/4))/2 as re, -sum(u*sin(2*pi()*kappa*i/4))/2 as im from nodes, range(3) t(kappa) group by 1, 2, 3, 4)"


def _mass():
    """A mass per element; some have none."""
    return F.col("e") % 7


def _lines(spark, d, column: str = "u"):
    """Wavenumbers of the lines along i; the 16 lines of an element are its values in 16 snapshots."""
    a = arrays(spark, d).withColumn("q", F.transform("u", lambda x: x * x))
    return sp.spectra(a, "e", column, N)


def _sigma(right):
    return right.select("kappa", F.posexplode("sigma").alias("k", "sigma"))


@query(f"with {SQL_NODES} select e, k, j, cast(kappa as int) as kappa, round(sum(u*cos(2*pi()*kappa*i/4))/2, 6) + 0.0 as re, round(-sum(u*sin(2*pi()*kappa*i/4))/2, 6) + 0.0 as im from nodes, range(3) t(kappa) group by 1, 2, 3, 4")
def line_spectra(spark, d):
    """Transformed lines, without a shuffle."""
    s = _lines(spark, d).select("e", "kappa", F.posexplode(F.arrays_zip("re", "im")).alias("p", "v"))
    return s.select("e", F.expr("p div 4").cast("int").alias("k"), (F.col("p") % 4).alias("j"), "kappa", (F.round("v.re", 6) + 0.0).alias("re"), (F.round("v.im", 6) + 0.0).alias("im"))


@query()
def fft_pod(spark, d):
    """Singular values per wavenumber: each has a decomposition of its own, all in one job."""
    return _sigma(sp.decompose(sp.weighted(_lines(spark, d), sp.weights()), 16))


@query(f"with {_LINES} select cast(kappa as int) as kappa, round(sum(re*re+im*im)*case when kappa > 0 then 2 else 1 end, 2) as energy from t group by kappa")
def fft_pod_energy(spark, d):
    """Sum of the squared singular values of each wavenumber: the energy of its lines."""
    return fft_pod(spark, d).groupBy("kappa").agg(F.round(F.sum(F.col("sigma") * F.col("sigma")), 2).alias("energy"))


def _massive(spark, d, keep: int = 16):
    """(rows, weight, right, modes) of the decomposition with a mass per element."""
    _folder(spark)
    rows = _lines(spark, d)
    right = sp.decompose(sp.weighted(rows, sp.weights(_mass())), keep).checkpoint()
    return rows, right, sp.weighted(sp.modes(sp.weighted(rows, sp.weights(_mass())), right), sp.weights(_mass()), divide=True)


@query()
def fft_pod_modes(spark, d):
    """Complex modes of each wavenumber, with a mass, in the scale of the field."""
    found = _massive(spark, d, 4)[2]
    return found.select("e", "kappa", F.posexplode(F.arrays_zip("re", "im")).alias("k", "v")).select("e", "kappa", "k", "v.re", "v.im")


@query(f"with {_LINES} select cast(kappa as int) as kappa, round(sum((re*re+im*im)*case when e%7=0 then 1e-12::double else e%7 end)*case when kappa > 0 then 2 else 1 end, 2) as energy from t group by kappa")
def fft_pod_mass_energy(spark, d):
    """Energy of each wavenumber in the mass inner product, from the singular values."""
    s = _sigma(_massive(spark, d)[1])
    return s.groupBy("kappa").agg(F.round(F.sum(F.col("sigma") * F.col("sigma")), 2).alias("energy"))


@query(f"with {SQL_NODES} select e, k, j, i, round(u, 5) as u from nodes")
def fft_pod_reconstruction(spark, d):
    """All modes of all wavenumbers, written as a state and read again, make up the field in physical space."""
    home = f"{_folder(spark)}/state-{uuid.uuid4().hex}"
    _, right, found = _massive(spark, d)
    sp.save(home, found, right)
    found, right = sp.load(spark, home)
    back = sp.physical(sp.rebuilt(found, right), "e", N)
    return el.nodes(back, "e", ["u"], N).withColumn("u", F.round("u", 5))


@query(f"with {_LINES} select e, k, j, cast(i as int) as i, round(sum(case when kappa = 0 then re else 2*re*cos(2*pi()*i/4) - 2*im*sin(2*pi()*i/4) end)/2, 5) as u from t, range(4) q(i) where kappa < 2 and j = 2 group by 1, 2, 3, 4")
def fft_pod_filtered(spark, d):
    """Two wavenumbers of four of the snapshots, from the folders of their modes alone."""
    home = f"{_folder(spark)}/state-{uuid.uuid4().hex}"
    _, right, found = _massive(spark, d)
    sp.save(home, found, right)
    found, right = sp.load(spark, home, [0, 1])
    back = sp.physical(sp.rebuilt(found, right, snapshots=[2, 6, 10, 14]), "e", N)
    n = back.select("e", F.posexplode("u").alias("p", "u"))
    return n.select("e", F.expr("p div 4").cast("int").alias("k"), F.lit(2).alias("j"), (F.col("p") % 4).alias("i"), F.round("u", 5).alias("u"))


@query()
def fft_extended_modes(spark, d):
    """Modes of another field (the squares) that go with the right vectors of the first, per wavenumber."""
    _folder(spark)
    right = sp.decompose(sp.weighted(_lines(spark, d), sp.weights()), 4).checkpoint()
    other = sp.weighted(sp.modes(sp.weighted(_lines(spark, d, "q"), sp.weights()), right), sp.weights(), divide=True)
    return other.select("e", "kappa", F.posexplode(F.arrays_zip("re", "im")).alias("k", "v")).select("e", "kappa", "k", "v.re", "v.im")


# --- analytic signals ---------------------------------------------------------
# The mirrored line has 2 * 64 - 2 = 126 values; place q of it is place q, or 126 - q, of the line. The discrete
# Hilbert transform of an even number M of values sums x[q] * (2 / M) * cot(pi * (p - q) / M) over odd p - q.
_SQL_HILBERT = f"{SQL_NODES}, mirrored as (select e, q, u from nodes, range(126) t(q) where p = case when q < 64 then q else 126 - q end), h as (select n.e, n.p, n.u as re, sum(case when (n.p - m.q) % 2 <> 0 then m.u * (2/126.0::double) / tan(pi() * (n.p - m.q) / 126) else 0 end) as im from nodes n join mirrored m using (e) group by 1, 2, 3)"


@query(f"with {_SQL_HILBERT} select e, cast(p as int) as p, round(re, 5) as re, round(im, 5) as im from h")
def hilbert_line(spark, d):
    """Analytic signal of each row of 64 values."""
    h = rom.analytic(arrays(spark, d), "e", "u")
    return h.select("e", F.posexplode(F.arrays_zip("re", "im")).alias("p", "h")).select("e", "p", F.round("h.re", 5).alias("re"), F.round("h.im", 5).alias("im"))


@query(f"with {_SQL_HILBERT} select e as row, cast(p as int) as p, round(re, 4) as re, round(im, 4) as im from h")
def hilbert_pod(spark, d):
    """Complex decomposition of analytic signals (64 snapshots of each row); all modes make them up again."""
    h = rom.analytic(_blocks(spark, d), "row", "a")
    sigma, vt, modes = rom.complex_pod(h, "row", "re", "im", N**3)
    back = rom.complex_reconstructed(modes, "row", sigma, vt)
    return back.select("row", F.posexplode(F.arrays_zip("re", "im")).alias("p", "h")).select("row", "p", F.round("h.re", 4).alias("re"), F.round("h.im", 4).alias("im"))


@query(f"with {_SQL_HILBERT} select round(sum(re*re+im*im), 1) as energy from h")
def hilbert_pod_energy(spark, d):
    """Sum of the squared singular values of the analytic signals."""
    h = rom.analytic(_blocks(spark, d), "row", "a")
    sigma, _ = rom.svd(h, "re", N**3, "im")
    return spark.createDataFrame([(round(float(np.square(sigma).sum()), 1),)], "energy double")
