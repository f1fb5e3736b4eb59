"""Covariances and greedy sampling against dense matrices and numerical gradients."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.functions import spectral as sp
from nodeloom.operators import sampling as sa
from nodeloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def _dense(basis, power, values, samples, noise=1e-10, follow=None):
    """One element with whole covariance matrices. follow: nodes that are taken
    instead, where they are as doubtful up to rounding (mirrored nodes are)."""
    cov = basis @ np.diag(power) @ basis.T
    eps, taken = noise * max(1e-300, np.trace(cov) / len(cov)), []
    for n in range(samples + 1):
        k = cov[np.ix_(taken, taken)] + eps * np.eye(n)
        gain = np.linalg.solve(k, cov[taken]) if n else np.zeros((0, len(cov)))
        var = np.diag(cov) - np.einsum("ij,ij->j", cov[taken], gain)
        if n == samples:
            return taken, gain.T @ values[taken], np.sqrt(np.abs(var))
        free = var.copy()
        free[taken] = -1
        best = int(np.argmax(free))
        if follow is not None and free[follow[n]] >= free[best] - 1e-7 * np.trace(cov):
            best = int(follow[n])
        taken.append(best)


def _bases(n=4):
    v, inverse = sp.modal(n)
    cube = lambda m: np.kron(np.kron(m, m), m)
    return sa.TensorBasis(v), sa.TensorBasis(inverse), cube(v), cube(inverse)


def test_sampling_equals_dense_matrices():
    rng = np.random.default_rng(1)
    tensor, _, basis, _ = _bases()
    power, u = rng.uniform(0.1, 2, (7, 64)), rng.standard_normal((7, 64))
    nodes, mean, std = sa.sample(tensor, power, u, 20)
    for e in range(7):
        want = _dense(basis, power[e], u[e], 20, follow=nodes[e])
        assert nodes[e].tolist() == want[0] and np.allclose(mean[e], want[1], atol=1e-6) and np.allclose(std[e], want[2], atol=1e-5)
    again = sa.sample(tensor, power, None, 20, nodes, np.take_along_axis(u, nodes, axis=1))
    assert np.allclose(again[1], mean) and np.allclose(again[2], std)


def test_sampling_in_the_basis_of_all_elements(spark):
    """The left vectors of all elements as a basis: the covariance of their coefficients."""
    a = np.stack([np.asarray(r["embedding"], float) for r in catalogue.table(spark, SF, "embeddings").orderBy("vec_id").collect()])
    left, s, right = np.linalg.svd(a.T, full_matrices=False)
    power = np.var(s[:, None] * right, axis=1, ddof=1)
    nodes, mean, std = sa.sample(sa.DenseBasis(left), np.repeat(power[None], 3, axis=0), a[:3], 10)
    for e in range(3):
        want = _dense(left, power, a[e], 10)
        assert nodes[e].tolist() == want[0] and np.allclose(mean[e], want[1], atol=1e-6) and np.allclose(std[e], want[2], atol=1e-6)


@pytest.mark.parametrize("kind", ["own", "largest", "error", "likelihood", "bits"])
def test_powers_of_own_coefficients(kind):
    rng = np.random.default_rng(2)
    tensor, back, _, inverse = _bases()
    u = rng.standard_normal((5, 64))
    got = sa.own_power(kind, tensor, back, u, 12)
    c = u @ inverse.T
    if kind == "own":
        assert np.allclose(got, c * c)
    elif kind == "bits":
        step = (c.max(axis=1) - c.min(axis=1)) / (2**12 - 1)
        assert (np.abs(np.sqrt(got) - np.abs(c)) <= step[:, None]).all()
    else:
        assert ((got > 0).sum(axis=1) == 12).all() and np.allclose(got[got > 0], (c * c)[got > 0])
    if kind == "largest":
        assert (np.sqrt(got).min(axis=1) <= np.abs(c).max(axis=1)).all() and all(set(np.flatnonzero(g)) == set(np.argsort(-np.abs(x))[:12]) for g, x in zip(got, c, strict=True))


def test_error_gradient_equals_differences():
    """The root mean square of what raised coefficients miss, by mass: its slope in each coefficient."""
    rng = np.random.default_rng(3)
    tensor, _, basis, inverse = _bases()
    u, mass = rng.standard_normal((1, 64)), rng.uniform(0.5, 2, (1, 64))
    c, raised = inverse @ u[0], 0.01

    def miss(extra):
        r = u[0] - basis @ (c * (1 + raised) + extra)
        return np.sqrt((r * r * mass[0]).sum() / mass[0].sum())

    got = sa.error_gradient(tensor, u, mass)[0]
    h = 1e-6
    want = np.array([(miss(h * x) - miss(-h * x)) / (2 * h) for x in np.eye(64)])
    assert np.allclose(got, want, atol=1e-6)


def test_likelihood_gradient_equals_differences():
    rng = np.random.default_rng(4)
    tensor, _, basis, inverse = _bases()
    u = rng.standard_normal((1, 64))
    c, noise, share = inverse @ u[0], 1e-2, 0.1
    low, high = c.min(), c.max()

    def nll(x):
        bent = c * (1 + share * np.tanh(2 * (x - low) / (high - low) - 1))
        k = np.outer((basis @ bent)[:-1], (basis @ bent)[:-1]) + noise * np.eye(63)
        y = u[0][:-1]
        return 0.5 * y @ np.linalg.solve(k, y) + np.linalg.slogdet(k)[1]

    got = sa.likelihood_gradient(tensor, u, c[None], noise, share)[0]
    h = 1e-6
    want = np.array([(nll(c + h * x) - nll(c - h * x)) / (2 * h) for x in np.eye(64)])
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4)


def test_group_samples_equal_dense_matrices(spark):
    rows = catalogue.table(spark, SF, "embeddings").orderBy("vec_id").collect()
    a = np.stack([np.asarray(r["embedding"], float) for r in rows])
    _, _, basis, inverse = _bases()
    c = a @ inverse.T
    for name, power in (("gp_group_mean", lambda x: x.mean(axis=0) ** 2), ("gp_group_variance", lambda x: x.var(axis=0, ddof=1))):
        got = {r["e"]: r for r in catalogue.queries()[name](spark, SF).collect()}
        assert len(got) == len(a)
        for e in range(0, 500, 97):
            want = _dense(basis, power(c[e // 10 * 10 : e // 10 * 10 + 10]), a[e], 12, follow=got[e]["nodes"])
            cov = basis @ np.diag(power(c[e // 10 * 10 : e // 10 * 10 + 10])) @ basis.T
            assert got[e]["nodes"] == want[0] and np.allclose(got[e]["mean"], want[1], atol=1e-3) and np.allclose(got[e]["std"], want[2], atol=1e-3 * np.sqrt(np.trace(cov)))


def test_elements_with_a_mass_and_none(spark):
    u = [(k, [float(x) for x in np.random.default_rng(k).standard_normal(8)], [1.0] * 8) for k in range(3)]
    df = spark.createDataFrame(u, "e long, u array<double>, b array<double>")
    for kind in ("error", "likelihood", "bits"):
        got = sa.sampled(df, "u", 2, 8, kind, 8, mass="b").collect()
        assert all(np.allclose(r["mean"], r["u"], atol=1e-3) and sorted(r["nodes"]) == list(range(8)) for r in got)
    assert sa.sampled(df.limit(0), "u", 2, 3).collect() == []
    same = sa.coefficients(df, "u", 2, "c").withColumn("k", F.size("c"))
    assert same.where("k <> 8").count() == 0
