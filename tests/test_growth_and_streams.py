"""Ranks that grow, local decompositions, field files as streams, a user's aggregates, dissipation in known flows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.operators import geometry as geo
from nodeloom.operators import rom
from nodeloom.operators import statistics as st
from nodeloom.plans import catalogue
from nodeloom.sources import fieldfile as ff
from nodeloom.streaming import pipelines

SF = "/root/testdata/sf0.001"


def _columns(spark, a, at, width):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(a[:, at : at + width])], "row long, a array<double>")


def _grown(a, most, least, ratio, width):
    """The same walk with whole matrices."""
    k, u, s, ratios = least, None, None, []
    for at in range(0, a.shape[1], width):
        x = a[:, at : at + width]
        if u is not None:
            for v in x.T:
                r = np.linalg.norm(v - u @ (u.T @ v)) / np.linalg.norm(v)
                ratios.append(r)
                k += r >= ratio and k < most
        u, s, _ = np.linalg.svd(x if u is None else np.hstack([u * s, x]), full_matrices=False)
        u, s = u[:, :k], s[:k]
    return k, s, ratios


def test_rank_grows_from_one_to_twelve(spark):
    """Each new snapshot points in a direction of its own; then they repeat, and the rank stays."""
    catalogue._folder(spark)
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.standard_normal((80, 12)))[0] * np.linspace(3, 1, 12)
    a = np.hstack([q, q[:, ::-1] * 1.1])
    state = rom.GrowingPod("row", 16)
    ranks = []
    for at in range(0, 24, 2):
        state.update(_columns(spark, a, at, 2), "a")
        ranks.append(state.k)
    k, s, ratios = _grown(a, 16, 1, 0.99, 2)
    assert ranks[0] == 1 and state.k == k and 11 <= k <= 12 + 1 and ranks[5:] == sorted(ranks[5:])
    assert np.allclose(state.sigma, s) and np.allclose(state.ratios, ratios, atol=1e-7)
    limited = rom.GrowingPod("row", 3)
    for at in range(0, 12, 3):
        limited.update(_columns(spark, a, at, 3), "a")
    assert limited.k == 3 and len(limited.sigma) == 3


def test_growing_query_equals_numpy(spark):
    rows = catalogue.table(spark, SF, "embeddings").orderBy("vec_id").collect()
    a = np.stack([np.asarray(r["embedding"], float) for r in rows])
    got = [r["sigma"] for r in catalogue.queries()["pod_growing"](spark, SF).orderBy("k").collect()]
    assert np.allclose(got, _grown(a, 12, 2, 0.9, 8)[1])


def test_local_decompositions_merge_to_the_whole(spark):
    """Blocks with few modes each, of a matrix of low rank: the merge has the digits of one decomposition."""
    catalogue._folder(spark)
    rng = np.random.default_rng(8)
    a = rng.standard_normal((90, 5)) @ rng.standard_normal((5, 12))
    state = rom.LocalPods(5)
    for at in (0, 4, 8):
        state.update(_columns(spark, a, at, 4).withColumn("block", F.expr("row div 25")), "a")
    sigma, vt, modes = state.merge(5)
    assert np.allclose(sigma, np.linalg.svd(a, compute_uv=False)[:5])
    u = np.stack([r["mode"] for r in modes.orderBy("row").collect()])
    assert np.allclose((u * sigma) @ vt, a) and np.allclose(u.T @ u, np.eye(5), atol=1e-9)


def _step(spark, folder, s, u):
    df = spark.createDataFrame([(e, (v * (s + 1) + s).tolist()) for e, v in enumerate(u)], "e long, t array<double>")
    ff.write_field(df, f"{folder}/step{s:05d}", (2, 2, 2), time=0.1 * s, step=s, files=2)


def test_a_stream_that_stops_between_steps(spark, tmp_path):
    """Started anew after each step or run over all at once: the same singular values; an incomplete step waits."""
    catalogue._folder(spark)
    u = np.random.default_rng(9).standard_normal((10, 8))
    one, whole = f"{tmp_path}/one", f"{tmp_path}/whole"
    for s in range(4):
        _step(spark, f"{tmp_path}/steps", s, u)
        pipelines.kept_pod(pipelines.field_steps(spark, f"{tmp_path}/steps", "t"), "t", 8, one, f"{one}-log", 4)
    pipelines.kept_pod(pipelines.field_steps(spark, f"{tmp_path}/steps", "t"), "t", 8, whole, f"{whole}-log", 4)
    a, b = pipelines.kept_state(spark, one).first(), pipelines.kept_state(spark, whole).first()
    x = np.stack([(u * (s + 1) + s).ravel() for s in range(4)], axis=1)
    want = np.linalg.svd(x, compute_uv=False)
    assert a["steps"] == b["steps"] == [0, 1, 2, 3] and np.allclose(a["sigma"], want, atol=1e-8) and np.allclose(b["sigma"], want, atol=1e-8)
    # A batch that is repeated is made from the state before it.
    assert pipelines.kept_state(spark, one, a["steps"][-1] - 1).first()["steps"] == [0, 1]
    # Half of a step is not a step.
    _step(spark, f"{tmp_path}/more", 4, u)
    part = ff.files_of(f"{tmp_path}/more/step00004")[0]
    (tmp_path / "steps" / "step00004").mkdir()
    (tmp_path / "steps" / "step00004" / "half.f00004").write_bytes(open(part, "rb").read())
    assert ff.StepReader(f"{tmp_path}/steps", ["t"]).latestOffset() == {"step": 4}


def test_a_stream_of_steps_becomes_field_files(spark, tmp_path):
    catalogue._folder(spark)
    u = np.random.default_rng(10).standard_normal((6, 8))
    for s in range(3):
        _step(spark, f"{tmp_path}/steps", s, u)
    pipelines.write_steps(pipelines.field_steps(spark, f"{tmp_path}/steps"), f"{tmp_path}/out", (2, 2, 2), f"{tmp_path}/log")
    for s in range(3):
        got = {r["e"]: r for r in ff.read_field(spark, f"{tmp_path}/out/step{s:05d}").collect()}
        assert all(np.allclose(got[e]["t"], u[e] * (s + 1) + s) and abs(got[e]["time"] - 0.1 * s) < 1e-12 for e in range(6))


def test_own_aggregates_merge(spark):
    """A key with most of the rows, null keys, arrays as values; the functions see parts."""
    rng = np.random.default_rng(11)
    rows = [("big" if k % 5 else ("b", None)[k % 2], rng.standard_normal(3).tolist(), float(k)) for k in range(500)]
    df = spark.createDataFrame(rows, "key string, v array<double>, w double").repartition(7)
    part = lambda c: np.concatenate([[c["w"].sum(), c["w"].max()], (c["v"] * c["w"][:, None]).sum(axis=0)])
    merge = lambda a, b: np.concatenate([[a[0] + b[0], max(a[1], b[1])], a[2:] + b[2:]])
    got = {r["key"]: r for r in st.own_aggregate(df, ["key"], ["v", "w"], part, merge, lambda s: (s[1], (s[2:] / s[0]).tolist()), {"top": "double", "mean": "array<double>"}).collect()}
    assert set(got) == {"big", "b", None}
    for key, r in got.items():
        own = [x for x in rows if x[0] == key]
        assert r["top"] == max(x[2] for x in own) and np.allclose(r["mean"], np.average([x[1] for x in own], axis=0, weights=[x[2] for x in own]))


def test_dissipation_of_a_shear(spark):
    """u = y, t = 2 z: du/dy = 1, dt/dz = 2 everywhere."""
    a = catalogue.brick_arrays(spark, SF, 0.02).where("e < 8").withColumns({"f1": F.col("ys"), "f2": F.transform("ys", lambda v: v * 0), "t": F.transform("zs", lambda v: v * 2)})
    n = geo.gradient(geo.with_mass(geo.metric(geo.spacing(a, 4, fields=("f1", "f2", "t"))), 4), ["f1", "f2", "t"])
    n = geo.dissipation(n, ("f1", "f2", "f2"), "t", 1.0, 400.0)
    got = n.select("eps_k", "eps_t").toPandas()
    mu = lamb = 0.05
    assert np.allclose(got.eps_k, 0.25 * 2 * 2 * mu) and np.allclose(got.eps_t, 4 * lamb)
    rows = geo.in_kolmogorov_units(n, 1.0, 400.0).collect()
    assert len(rows) == 8 and all(np.allclose((r["eta"], r["eta_all"], r["nu_t"]), ((mu**3 / mu) ** 0.25, (mu**3 / mu) ** 0.25, 4.0)) for r in rows)


@pytest.mark.parametrize("name", ["pod_growing", "pod_local_merge", "stream_field_files", "mesh_kolmogorov", "own_aggregates", "gp_stored", "gradient_truncation"])
def test_empty_tables(spark, tmp_path_factory, name):
    d = tmp_path_factory.mktemp("empty")
    for t in ("embeddings", "lineitem"):
        catalogue.table(spark, SF, t).limit(0).write.parquet(f"{d}/{t}.parquet")
    assert catalogue.queries()[name](spark, str(d)).collect() == []


def test_averages_of_files_of_uneven_times(spark, tmp_path):
    """Intervals of 1, 2 and 4 in one batch, then one that is too long."""
    from nodeloom.sources import averages

    catalogue._folder(spark)
    u = np.random.default_rng(12).standard_normal((5, 8))
    for s, t in enumerate((1.0, 3.0, 7.0, 27.0)):
        df = spark.createDataFrame([(e, (v * (s + 1)).tolist()) for e, v in enumerate(u)], "e long, t array<double>")
        ff.write_field(df, f"{tmp_path}/steps/step{s}", (2, 2, 2), time=t, step=s)
    got = {(r["batch"], r["e"]): r for r in averages.average_files(spark, f"{tmp_path}/steps", ["t"], 7.0).collect()}
    assert set(got) == {(b, e) for b in (0, 1) for e in range(5)}
    for e in range(5):
        assert np.allclose(got[0, e]["t"], u[e] * (1 * 1 + 2 * 2 + 3 * 4) / 7) and np.allclose(got[1, e]["t"], u[e] * 4)
        assert got[0, e]["dt"] == 7.0 and got[1, e]["dt"] == 20.0


def test_the_entry_stands_without_the_corpus_operators(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    real = importlib.import_module

    def gone(name):
        if name.startswith(("nodeloom.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
        return real(name)

    monkeypatch.setattr(importlib, "import_module", gone)
    assert "dudr" in entry.queries() and "op1_embedding_near_dedup" not in entry.queries() and "dudr" in entry.oracle_sql()
