"""How many combinations of grid levels points are sent for, and that what is chosen for cost changes no pair."""

import numpy as np
import pytest

from nodeloom.operators import statistics as st
from nodeloom.plans import catalogue
from tests.compare import connect, differences

SF = "/root/testdata/sf0.01"


def _asked(joined) -> int:
    """The combinations that the plan unrolls each point over."""
    plan = joined._jdf.queryExecution().analyzed().toString()
    return next(x for x in plan.splitlines() if "explode(array(struct(" in x).split("explode(array(")[1].split(")), false")[0].count("struct(")


def test_small_sides_share_levels_where_it_costs_less(spark):
    """35 combinations of sides, most of them tiny: points are sent a few times, not 35 times."""
    got = catalogue.queries()["graded_boxes"](spark, SF)
    assert _asked(got) <= 9
    assert not differences(got.toPandas(), connect(SF).sql(catalogue.oracle_sql()["graded_boxes"]).df())


@pytest.mark.parametrize("sent", [0, 1, 10**9])
def test_costs_change_no_pair(spark, monkeypatch, sent):
    """Sending points for nothing, or never more than once: pairs are those of all compared, sides without extent and empty sides included."""
    rng = np.random.default_rng(31)
    low, side = rng.uniform(-9, 9, (500, 2)), 10.0 ** rng.integers(-4, 2, (500, 2))
    side[:30] = 0.0
    points = np.concatenate([rng.uniform(-10, 12, (300, 2)), low[:60], low[60:90] + side[60:90]])
    rows = [(k, *map(float, v)) for k, v in enumerate(np.c_[low[:, 0], low[:, 0] + side[:, 0], low[:, 1], low[:, 1] + side[:, 1]])]
    p = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(points)] + [(1000, None, 0.0)], "id long, x double, y double")
    b = spark.createDataFrame([*rows, (1000, None, 1.0, 0.0, 1.0)], "e long, x_lo double, x_hi double, y_lo double, y_hi double")
    want = sorted((i, e) for i, v in enumerate(points) for e in np.flatnonzero(((low <= v) & (v <= low + side)).all(axis=1)).tolist())
    monkeypatch.setattr(st, "SENT", sent)
    joined = st.level_join(p, b, ["x", "y"])
    assert sorted((r["id"], r["e"]) for r in joined.collect()) == want
    assert (_asked(joined) == 1) == (sent == 10**9)
    assert st.level_join(p.limit(0), b, ["x", "y"]).count() == 0


def test_levels_of_crowded_small_boxes_stay():
    """A million boxes from 1 down to 2^-19 side by side, as many of each size, points in them: the small ones keep levels of their
    own, and a point meets far fewer boxes than on one level."""
    rng = np.random.default_rng(2)
    size = 2.0 ** -rng.integers(0, 20, 1000)
    low = np.stack([rng.uniform(0, 1, 1000) * size] * 2, axis=1)
    high = low + size[:, None] / 1000
    k = np.ceil(np.log2(high - low)).astype(int)
    found = sorted({tuple(v) for v in k.tolist()})
    least = st._least_levels((low + high) / 2, low, high, 1_000_000, found, -60)
    assert max(least) < max(k[:, 0]) - 4
