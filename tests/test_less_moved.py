"""What is sent from task to task: elements that probes need, values that blocks share."""

import numpy as np
from pyspark.sql import functions as F

from nodeloom.operators import geometry as geo
from nodeloom.operators import sequence
from nodeloom.plans import catalogue
from nodeloom.sources import fieldfile as ff

SF = "/root/testdata/sf0.001"


def test_only_elements_near_probes_are_dealt(spark):
    """Two probes in one of 500 elements: it and the seven that touch it are kept, with all copies of its nodes, and
    values are those of means over all elements."""
    mesh = catalogue.brick_arrays(spark, SF, 0.0)
    probes = spark.createDataFrame([(1, 0.3, 0.4, 0.5), (2, 1.0, 1.0, 1.0), (3, -9.0, 0.0, 0.0)], "probe_id long, x double, y double, z double")
    ready = sequence.prepare(spark, mesh.select("e", "xs", "ys", "zs"), probes, 4, f"{catalogue._folder(spark)}/near")
    beside = {0, 1, 8, 9, 64, 65, 72, 73}
    assert {r["e"] for r in ready.geometry.collect()} == beside == {r["e"] for r in ready.classes.collect()}
    assert {r["e"] for r in sequence.dealt(ready, mesh).collect()} == beside
    shared = ready.classes.where("e = 0").first()["shared"]
    assert {r["p"]: r["copies"] for r in shared}[63] == 8 and len(shared) == 64 - 27
    got = {r["probe_id"]: r for r in sequence.operate(ready, mesh.select("e", "u"), ["u"], {}).collect()}
    rows = {r["e"]: r for r in geo.space_derivatives(mesh.where(F.col("e").isin(*beside)), ["u"], 4).collect()}
    corner = {0: 63, 1: 60, 8: 51, 9: 48, 64: 15, 65: 12, 72: 3, 73: 0}
    assert np.isclose(got[2]["dudx"], np.mean([rows[e]["u_x"][p] for e, p in corner.items()])) and got[3]["u"] == 0.0


def test_a_field_is_made_where_it_is_written(spark, tmp_path):
    """Variables that are made of a row are not sent before: the file is the same."""
    a = catalogue.arrays(spark, SF)
    made = lambda d: d.select("e", *[F.transform("u", lambda v, k=k: v * k).alias(c) for k, c in enumerate(("x", "y", "z", "p", "s0"), 1)])
    ff.write_field(made(a), f"{tmp_path}/a", (4, 4, 4))
    ff.write_field(a, f"{tmp_path}/b", (4, 4, 4), made=made)
    files = [sorted(ff.files_of(f"{tmp_path}/{c}")) for c in "ab"]
    assert len(files[0]) == len(files[1]) and all(open(x, "rb").read() == open(y, "rb").read() for x, y in zip(*files, strict=True))


def test_blocks_send_their_rim_alone(spark, tmp_path, monkeypatch):
    """On two layers of the brick in blocks of 64 elements only the 625 nodes between them are sent, and no step moves
    what it keeps; vectors that are replayed are those that are written."""
    from nodeloom.operators import solver

    u = np.random.default_rng(5).standard_normal((128, 64))
    d = str(tmp_path)
    spark.createDataFrame([(e, v.tolist()) for e, v in enumerate(u)], "vec_id long, embedding array<double>").write.parquet(f"{d}/embeddings.parquet")
    sent = []
    kept = type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda self, *a: sent.append(kept(self, *a)) or sent[-1])
    got = {(r["gx"], r["gy"], r["gz"]): r for r in catalogue.queries()["pcg_poisson"](spark, d).collect()}
    assert len(got) == 25 * 25 * 7 and all(r["small"] for r in got.values())
    assert [x.selectExpr("sum(size(rim))").first()[0] for x in sent if "rim" in x.columns][0] == 2 * 625
    monkeypatch.setattr(solver, "WRITTEN", 1)
    again = {(r["gx"], r["gy"], r["gz"]): r["v"] for r in catalogue.queries()["pcg_poisson"](spark, d).collect()}
    assert again.keys() == got.keys() and all(np.isclose(v, got[g]["v"], rtol=0, atol=1e-12) for g, v in again.items())
