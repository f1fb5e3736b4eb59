"""What Python workers hold: slices of batches and parts of files, not all that is made of them."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nodeloom.operators import elements as el
from nodeloom.operators import geometry as geo
from nodeloom.operators import sampling
from nodeloom.plans import catalogue
from nodeloom.sources import fieldfile as ff

SF = "/root/testdata/sf0.001"


def test_kernels_go_through_slices(spark):
    """The same rows from slices of one row as from whole batches, nulls included; no array becomes a Python object."""
    a = catalogue.brick_arrays(spark, SF).where("e < 20")
    wanted = {"a": [("u", 1, "x")], "b": [("u", 2, "y"), ("u", 1, "z")]}
    made = {"derived": lambda: geo.derived_statistics(a, wanted, 4), "long": lambda: geo.with_derivatives(a, ["u"], 4), "gp": lambda: sampling.sampled(a.select("e", "u"), "u", 4, 3)}
    for name, f in made.items():
        whole = f()
        plan = whole._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan, name
        with pytest.MonkeyPatch.context() as m:
            m.setattr(el, "PIECE", 1)
            assert sorted(map(repr, f().collect())) == sorted(map(repr, whole.collect()))
    u = a.select("e", F.when(F.col("e") % 3 != 0, F.col("u")).alias("u"))
    got = {r["e"]: r["v"] for r in el.in_pieces(u, ["u"], {"v": "array<double>"}, lambda x: [2 * x]).collect()}
    want = {r["e"]: r["u"] for r in u.collect()}
    assert len(got) == 20 and all(got[e] is None if v is None else got[e] == [2 * x for x in v] for e, v in want.items())


def test_coefficients_are_made_once(spark):
    """One pass through Python before an explode, not one more for a filter that is inferred of it; as the matrix says, nulls included."""
    a = catalogue.arrays(spark, SF).where("e < 20")
    plan = sampling.group_power(a, "u", 4, F.expr("e div 10"), "variance")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    m = np.random.default_rng(2).standard_normal((3, 4))
    u = a.select(F.when(F.col("e") % 3 != 0, F.col("u")).alias("u"), "e", (F.col("e") * 2).alias("twice")).withColumn("w", F.transform("u", lambda v: v + 1))
    both = el.tensor(u, ["u", "w"], m, ["u", "made"])
    assert both.columns == ["u", "e", "twice", "w", "made"]
    got, want = ({r["e"]: r for r in x.collect()} for x in (both, u))
    dense = np.einsum("ck,bj,ai->cbakji", m, m, m).reshape(27, 64)
    assert len(got) == 20
    for e, r in want.items():
        if r["u"] is None:
            assert got[e]["u"] is None and got[e]["made"] is None
        else:
            assert np.allclose(got[e]["u"], dense @ r["u"]) and np.allclose(got[e]["made"], dense @ r["w"]) and got[e]["w"] == r["w"]


def test_a_file_is_written_in_parts(tmp_path, monkeypatch):
    """20,000 elements (21 MB) in one file, from batches that are made as they are asked for."""
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("C", (), {"partitionId": lambda s: 0, "taskAttemptId": lambda s: 0})()))
    monkeypatch.setattr(tempfile_module(), "tempdir", str(tmp_path))
    count, n = 20_000, 64

    def batches():
        for at in range(0, count, 1000):
            e = np.arange(at, at + 1000)
            one = lambda k: el.lists_of((e[:, None] * k + np.arange(n)).astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(e), one(1), one(3)], names=["e", "p", "t"])

    w = ff.FieldWriter({"path": f"{tmp_path}/field", "shape": "4,4,4", "elements": str(count), "files": "1"}, ["e", "p", "t"], False)
    tracemalloc.start()
    name = w.write(batches()).path
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15e6
    h = ff.read_header(name)
    with open(name, "rb") as f:
        ids, got = ff.read_block(f, h, ["p", "t"], 0, count)
        raw = f.seek(0) or f.read()
    e = np.arange(count)
    arrays = {"p": (e[:, None] + np.arange(n)).astype(float), "t": (e[:, None] * 3 + np.arange(n)).astype(float)}
    assert (ids == e).all() and all((got[c] == v).all() for c, v in arrays.items())
    assert raw == ff.encode(arrays, e + 1, (4, 4, 4), total=count, files=1)


def tempfile_module():
    import tempfile

    return tempfile


def test_aggregates_see_their_keys_together(spark):
    """Of 2,000 keys with 10 rows each that lie apart, a user's function sees nearly all rows of a key at once."""
    from nodeloom.operators import statistics as st

    rows = spark.range(20_000).selectExpr("id % 2000 as key", "cast(id as double) as x").repartition(8)
    part = lambda c: np.array([len(c["x"]), c["x"].sum(), 1.0])
    kinds = {"n": "double", "total": "double", "parts": "double"}
    got = st.own_aggregate(rows, ["key"], ["x"], part, lambda a, b: a + b, lambda s: s.tolist(), kinds, gather=True).collect()
    assert len(got) == 2000 and all(r["n"] == 10 and r["total"] == 10 * r["key"] + 90_000 for r in got)
    assert sum(r["parts"] for r in got) < 2100  # 10,000 and more where rows stay in their tasks


def test_means_of_arrays_in_slices(spark):
    """Keys that go on over slices and tasks, with a null key; no group is a Python call."""
    from nodeloom.operators import statistics as st

    rng = np.random.default_rng(4)
    data = [((None, "a", "b")[k % 3], int(k % 2), rng.standard_normal(3).tolist(), float(k + 1)) for k in range(120)]
    df = spark.createDataFrame(data, "g string, h int, v array<double>, w double").repartition(5)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(el, "PIECE", 200)
        means = st.average_arrays(df, ["g", "h"], ["v"], "w")
        assert "FlatMapGroupsInPandas" not in means._jdf.queryExecution().executedPlan().toString()
        got = {(r["g"], r["h"]): r for r in means.collect()}
    assert len(got) == 6
    for key, r in got.items():
        own = [x for x in data if x[:2] == key]
        assert np.isclose(r["w"], sum(x[3] for x in own)) and np.allclose(r["v"], np.average([x[2] for x in own], axis=0, weights=[x[3] for x in own]))
