"""The block codec: lossless steps, bounds on every value, sizes; ways to interpolate."""

import numpy as np
import pytest

from nodeloom.functions import spectral as sp
from nodeloom.operators import transform_codec as tc


def _fields(n):
    g = np.linspace(0, 1, n)
    z, y, x = np.meshgrid(g, g, g, indexing="ij")
    u = [(np.sin(3 * x + k) * np.cos(y * 2) + z * k).ravel() * 10.0 ** (k % 7 - 3) for k in range(20)]
    rng = np.random.default_rng(1)
    return np.stack([*u, np.zeros(n**3), rng.standard_normal(n**3), np.full(n**3, 1e300), 1e-300 * rng.standard_normal(n**3)])


def test_the_transform_is_undone_without_loss():
    q = np.random.default_rng(2).integers(-(2**tc.BITS), 2**tc.BITS, (200, 4, 4, 4))
    assert (tc.inverse(tc.forward(q)) == q).all() and np.abs(tc.forward(q)).max() < 2**tc.TOP


@pytest.mark.parametrize("n", [2, 4, 6, 8])
def test_every_value_is_within_the_tolerance(n):
    u, before = _fields(n), 0
    for tolerance in (1e-1, 1e-3, 1e-6, 1e-12, 0.0):
        payloads = tc.encode(u, n, tolerance=tolerance)
        assert np.abs(tc.decode(payloads, n) - u).max() <= tolerance
        size = sum(map(len, payloads))
        assert size >= before
        before = size
    assert sum(map(len, tc.encode(u, n, tolerance=1e-3))) < (0.6 if n % 4 == 0 else 10) * u.nbytes


def test_a_fixed_rate_has_one_size_and_less_error_with_more_planes():
    u = _fields(8)
    errors = []
    for planes in (8, 16, 24, 40):
        payloads = tc.encode(u, 8, planes=planes)
        assert len(set(map(len, payloads))) == 1
        errors.append(np.abs(tc.decode(payloads, 8) - u)[:20].max(axis=1))
    assert all((b <= a + 1e-12).all() for a, b in zip(errors, errors[1:]))


def test_no_elements():
    assert tc.encode(np.zeros((0, 64)), 4, tolerance=0.1) == [] and tc.decode([], 4).shape == (0, 64)


def test_ways_to_interpolate_agree():
    at = np.random.default_rng(3).uniform(-1, 1, 50)
    for n in (3, 4, 8):
        x = sp.gll(n)[0]
        p = np.polynomial.Polynomial(np.arange(1.0, n + 1))
        for way in ("barycentric", "lagrange", "legendre"):
            assert np.allclose(sp.POINT_ROWS[way](n, at) @ p(x), p(at)) and np.allclose(sp.POINT_SLOPES[way](n, at) @ p(x), p.deriv()(at))
        assert np.allclose(sp.legendre_rows(n, x), sp.modal(n)[0])
