"""Keyed decompositions, analytic signals, mesh check, spectra, point sets, grid levels, numbering, logs, sequences, field files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.functions import spectral as sf
from nodeloom.operators import compression, rom, search, sequence
from nodeloom.operators import connectivity as co
from nodeloom.operators import geometry as geo
from nodeloom.operators import spectral_pod as sp
from nodeloom.operators import statistics as st
from nodeloom.plans import catalogue
from nodeloom.sources import fieldfile as ff

SF = "/root/testdata/sf0.001"


def _snapshots(spark):
    rows = catalogue.table(spark, SF, "embeddings").orderBy("vec_id").collect()
    return np.array([r["vec_id"] for r in rows]), np.stack([np.asarray(r["embedding"], float) for r in rows])


def _pivot(frame, k):
    """kappa -> (elements x k) complex."""
    return {kappa: (g.pivot(index="e", columns="k", values="re") + 1j * g.pivot(index="e", columns="k", values="im")).sort_index().to_numpy()[:, :k] for kappa, g in frame.groupby("kappa")}


# --- decompositions per wavenumber ---------------------------------------------
def test_modes_per_wavenumber_equal_numpy(spark):
    ids, a = _snapshots(spark)
    q = catalogue.queries()
    got, extended = _pivot(q["fft_pod_modes"](spark, SF).toPandas(), 4), _pivot(q["fft_extended_modes"](spark, SF).toPandas(), 4)
    m = np.sqrt(np.where(ids % 7 == 0, 1e-12, ids % 7.0))[:, None]
    x, y = (np.fft.rfft(v.reshape(-1, 16, 4), axis=-1) / 2 for v in (a, a * a))
    for kappa in range(3):
        twin = 2**0.5 if kappa else 1.0
        u = np.linalg.svd(x[..., kappa] * m * twin, full_matrices=False)[0][:, :4] / m / twin
        # Up to a phase per mode.
        phase = np.sum(u.conj() * got[kappa] * m * m, axis=0)
        phase /= np.abs(phase)
        assert np.allclose(got[kappa], u * phase, atol=1e-6 * np.abs(u).max())
        _, s, vt = np.linalg.svd(x[..., kappa], full_matrices=False)
        want = y[..., kappa] @ (vt[:4].conj().T / s[:4]) / twin
        phase = np.sum(want.conj() * extended[kappa], axis=0)
        assert np.allclose(extended[kappa], want * phase / np.abs(phase), atol=1e-8)


def _waves(spark, lines: int = 300, snapshots: int = 3, n: int = 16, parts: int = 9):
    u = np.random.default_rng(7).standard_normal((lines, snapshots, n))
    return u, spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate(u)], "e long, u array<double>").repartition(parts)


def test_one_job_for_any_number_of_wavenumbers(spark, monkeypatch):
    """Sixteen values make nine wavenumbers; triangles go through branches; nothing runs before the result is asked for."""
    u, df = _waves(spark)
    spark.sparkContext.setJobGroup("keyed", "keyed")
    right = sp.decompose(sp.spectra(df, "e", "u", 16), 3)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("keyed")
    spark.sparkContext.setJobGroup("other", "other")
    got = {r["kappa"]: r["sigma"] for r in right.collect()}
    x = np.fft.rfft(u, axis=-1) / 4
    assert sorted(got) == list(range(9)) and all(np.allclose(got[k], np.linalg.svd(x[..., k], compute_uv=False)) for k in got)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_reconstruction_in_physical_space(spark, monkeypatch, sent, tmp_path):
    """Right vectors sent to all tasks, or joined by wavenumber: the lines come back; a state is kept; few modes are the best of their rank."""
    monkeypatch.setattr(sp, "SENT", sent)
    monkeypatch.setattr(sp, "ROWS", 50)
    u, df = _waves(spark)
    rows = sp.spectra(df, "e", "u", 16)
    right = sp.decompose(rows, 3)
    found = sp.modes(rows, right)
    sp.save(str(tmp_path), found, right)
    again, kept = sp.load(spark, str(tmp_path))
    back = np.stack([np.array(r["u"]) for r in sp.physical(sp.rebuilt(again, kept), "e", 16).orderBy("e").collect()])
    assert np.allclose(back, u.reshape(len(u), -1))
    one = {(r["e"], r["kappa"]): np.array(r["re"]) + 1j * np.array(r["im"]) for r in sp.rebuilt(again, kept, kept=[0]).collect()}
    x = np.fft.rfft(u, axis=-1) / 4
    for k in (0, 5, 8):
        a, s, vt = np.linalg.svd(x[..., k], full_matrices=False)
        assert np.allclose(np.stack([one[e, k] for e in range(len(u))]), s[0] * np.outer(a[:, 0], vt[0]))


def test_no_rows_no_wavenumbers(spark):
    none = spark.createDataFrame([], "e long, u array<double>")
    rows = sp.spectra(none, "e", "u", 8)
    assert sp.decompose(rows, 2).collect() == [] and sp.modes(rows, sp.decompose(rows, 2)).collect() == []


# --- formulas ------------------------------------------------------------------
def test_analytic_signal_of_known_lines(spark):
    """A cosine that the mirror goes on turns into its sine; and six values worked out by hand."""
    n = 33
    for k in (1, 3, 7):
        at = np.arange(n) * np.pi * k / (n - 1)
        assert np.allclose(rom.analytic_signal(np.cos(at)), np.exp(1j * at))
    h = rom.analytic_signal(np.array([1.0, 2, 4, 3, 0, 1]))
    assert np.allclose(h.real, [1, 2, 4, 3, 0, 1]) and np.allclose(h.imag, [0, -1.2654, -0.4702, 2.6075, 1.0858, 0], atol=1e-4)
    df = spark.createDataFrame([(0, [1.0, 2.0, 4.0, 3.0, 0.0, 1.0]), (1, [1.0, 0.0, 1.0])], "row long, a array<double>")
    assert np.allclose(rom.analytic(df, "row", "a").where("row = 0").first()["im"], h.imag)


def test_spacing_of_known_elements(spark):
    """A box of sides 2, 4 and 6, straight and turned about z by 45 degrees."""
    x = sf.gll(4)[0]
    t, s, r = (v.ravel() for v in np.meshgrid(x, x, x, indexing="ij"))
    a = 0.5**0.5
    straight, turned = (r, 2 * s, 3 * t), (a * r - a * 2 * s, a * r + a * 2 * s, 3 * t)
    df = spark.createDataFrame([(k, *[c.tolist() for c in g]) for k, g in enumerate((straight, turned))], "e long, xs array<double>, ys array<double>, zs array<double>")
    got = {(v["e"], v["k"], v["j"], v["i"]): v for v in geo.spacing(df, 4).collect()}
    half = [0.276393, 0.723607, 0.723607, 0.276393]  # an end node has half the distance to its neighbour
    for (e, k, j, i), v in got.items():
        hr, hs, ht = half[i], 2 * half[j], 3 * half[k]
        want = (hr, hs, ht) if e == 0 else (a * math.hypot(hr, hs), a * math.hypot(hr, hs), ht)
        assert np.allclose((v["hx"], v["hy"], v["hz"]), want, atol=1e-5)


def test_group_spectra_worked_out_by_hand(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 1, -2.0), (1, 0, 3.0), (1, 1, 2.0)], "e long, p int, c double")
    got = {k: [r["power"] for r in compression.average_spectrum(rows, F.lit(0), k).orderBy("p").collect()] for k in ("mean", "variance")}
    assert got == {"mean": [4.0, 0.0], "variance": [2.0, 8.0]}


def test_half_tanh_is_the_upper_half(spark):
    assert np.allclose(sf.points_1d(0.0, 1.0, 6, "half_tanh", 1.5), [0.1497, 0.4283, 0.6548, 0.8196, 0.93, 1.0], atol=1e-4)


# --- grid levels, numbering, filling ---------------------------------------------
def test_level_join_of_graded_boxes(spark):
    """Sides from 1e-4 to 1e3, points without extent, points outside; each pair once, as by comparing all."""
    rng = np.random.default_rng(5)
    low = rng.uniform(-50, 50, (400, 2))
    side = 10.0 ** rng.uniform(-4, 3, (400, 2))
    side[:20] = 0.0
    points = np.concatenate([rng.uniform(-60, 60, (300, 2)), low[:40], low[40:80] + side[40:80], [[1e6, 1e6]]])
    p = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(points)], "id long, x double, y double")
    b = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(np.c_[low[:, 0], low[:, 0] + side[:, 0], low[:, 1], low[:, 1] + side[:, 1]])], "e long, x_lo double, x_hi double, y_lo double, y_hi double")
    got = sorted((r["id"], r["e"]) for r in st.level_join(p, b, ["x", "y"]).collect())
    high = low + side
    want = sorted((i, e) for i, v in enumerate(points) for e in np.flatnonzero(((low <= v) & (v <= high)).all(axis=1)).tolist())
    assert got == want and len(set(got)) == len(got)
    assert st.level_join(p, b.limit(0), ["x", "y"]).count() == 0 and st.level_join(p.limit(0), b, ["x", "y"]).count() == 0


def test_candidates_grow_with_the_points_on_graded_meshes(spark):
    """Elements from 1 down to 1/1000 side by side: a point meets a handful of boxes before they are looked at."""
    edges = np.concatenate([[0.0], np.cumsum(10.0 ** np.linspace(0, -3, 200))])
    x = (sf.gll(2)[0] + 1) / 2
    t, s, r = (v.ravel() for v in np.meshgrid(x, x, x, indexing="ij"))
    mesh = spark.createDataFrame([(k, (edges[k] + (edges[k + 1] - edges[k]) * r).tolist(), (s * (edges[k + 1] - edges[k])).tolist(), (t * (edges[k + 1] - edges[k])).tolist()) for k in range(200)], "e long, xs array<double>, ys array<double>, zs array<double>")
    rows = [(k, float((edges[k] + edges[k + 1]) / 2), float((edges[k + 1] - edges[k]) / 2), float((edges[k + 1] - edges[k]) / 2)) for k in range(200)]
    points = spark.createDataFrame(rows, "probe_id long, x double, y double, z double")
    assert sorted((r["probe_id"], r["e"]) for r in search.structure("boxes")(points, mesh).collect()) == [(k, k) for k in range(200)]
    boxes = search.boxes(mesh).select("e", *[f"{c}_{q}" for c in "xyz" for q in ("lo", "hi")])
    b = boxes.withColumn("level", F.ceil(F.log2(F.greatest(*[F.col(f"{c}_hi") - F.col(f"{c}_lo") for c in "xyz"])))).collect()
    met = sum(all(math.floor(lo / 2.0 ** r["level"]) <= math.floor(v / 2.0 ** r["level"]) <= math.floor(hi / 2.0 ** r["level"]) for v, lo, hi in zip(q[1:], (r["x_lo"], r["y_lo"], r["z_lo"]), (r["x_hi"], r["y_hi"], r["z_hi"]), strict=True)) for q in rows for r in b)
    assert met < 8 * len(rows)


def test_numbers_carry_over_groups_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(st, "GROUPED", 4)
    ids = sorted(set(np.random.default_rng(1).integers(0, 20_000, 900).tolist()))
    got = st.number_elements(spark.createDataFrame([(i,) for i in ids], "label long"), 100, "label", "place")
    assert [(r["label"], r["place"]) for r in got.orderBy("label").collect()] == [(i, k) for k, i in enumerate(ids)]


def test_values_are_filled_over_parts(spark):
    rng = np.random.default_rng(2)
    rows = [(g, k // 7, k, None if rng.random() < 0.85 else f"v{k}", None if rng.random() < 0.95 else float(k)) for g in "ab" for k in range(200)]
    got = {(r["g"], r["k"]): (r["a"], r["b"]) for r in st.filled(spark.createDataFrame(rows, "g string, part long, k long, a string, b double"), ["g"], "part", "k", ["a", "b"]).collect()}
    for g in "ab":
        a = b = None
        for r in (r for r in rows if r[0] == g):
            a, b = r[3] or a, b if r[4] is None else r[4]
            assert got[g, r[2]] == (a, b)


def test_a_log_of_many_blocks(spark, tmp_path):
    """One file read in blocks of 2 kB: no block holds more than a few of its lines, and values go on from block to block."""
    lines, want, name = [], [], None
    for k in range(2000):
        if k % 150 == 0:
            name = f"fld{k}.f"
            lines.append(f"File name : {name}")
        lines += [f" t = {k * 0.5}", "other words", f"Output number : {k}"] if k % 2 else ["other words", f"Output number : {k}"]
        want.append((k, name, (k if k % 2 else k - 1) * 0.5 if k else None))
    (tmp_path / "solver.log").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        read = ff.read_lines(spark, str(tmp_path))
        assert read.select("part").distinct().count() > 10
        got = [(r["number"], r["file"], r["time"]) for r in ff.index_log(read).orderBy("number").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want


# --- sequences -------------------------------------------------------------------
def test_a_step_moves_no_mesh(spark):
    """The plan of a step: what is prepared is scanned by buckets and goes into its joins without an exchange."""
    home = f"{catalogue._folder(spark)}/plan"
    mesh = catalogue.brick_arrays(spark, SF, 0.0)
    ready = sequence.prepare(spark, mesh.select("e", "xs", "ys", "zs"), catalogue._probes(spark, SF), 4, home)
    step = sequence.operate(ready, catalogue.arrays(spark, SF), ["u"], {"uu": ("u", "u")})
    plan = step._jdf.queryExecution().executedPlan().toString().splitlines()

    def depth(line):
        return len(line) - len(line.lstrip(" :+-*()0123456789"))

    found = 0
    for at, line in enumerate(plan):
        if "Scan parquet" in line and any(f"{t}_" in line.lower() for t in ("geometry", "classes", "probes")) and "Bucketed: true" in line:
            found += 1
            level, row = depth(line), at
            while row:  # upwards to the join that it feeds
                row -= 1
                if depth(plan[row]) < level:
                    level = depth(plan[row])
                    assert "Exchange" not in plan[row]
                    if "Join" in plan[row]:
                        break
    assert found >= 3
    assert sum("Exchange" in line for line in plan) > 0


def test_operating_on_curved_elements(spark, tmp_path):
    """A field linear in space has constant derivatives at every probe of warped elements, and outside there is nothing."""
    mesh = catalogue.brick_arrays(spark, SF, 0.01).where("e < 64")
    long = mesh.withColumn("f", F.zip_with("xs", "ys", lambda x, y: 2 * x - 3 * y)).withColumn("f", F.zip_with("f", "zs", lambda v, z: v + 0.5 * z))
    probes = spark.createDataFrame([(1, 2.3, 4.4, 0.5), (2, 5.0, 3.0, 0.2), (3, 100.0, 0.0, 0.0)], "probe_id long, x double, y double, z double")
    ready = sequence.prepare(spark, mesh.select("e", "xs", "ys", "zs"), probes, 4, f"{catalogue._folder(spark)}/warped")
    got = {r["probe_id"]: r for r in sequence.operate(ready, long.select("e", "f"), ["f"], {"ff": ("f", "f")}).collect()}
    for k, at in ((1, (2.3, 4.4, 0.5)), (2, (5.0, 3.0, 0.2))):
        value = 2 * at[0] - 3 * at[1] + 0.5 * at[2]
        assert abs(got[k]["f"] - value) < 1e-6 and np.allclose([got[k]["dfdx"], got[k]["dfdy"], got[k]["dfdz"]], [2, -3, 0.5], atol=1e-6)
    assert got[3]["f"] == 0.0 and got[3]["ff"] == 0.0


def test_places_have_dense_numbers(spark):
    nodes = spark.createDataFrame([(k, float(k % 5), float(k // 10), 0.0) for k in range(40)], "node long, x double, y double, z double")
    got = {r["node"]: (r["label"], r["place"]) for r in co.numbered_places(nodes, "node", ["x", "y", "z"], 1e-7, 3).collect()}
    labels = sorted({k % 5 + k // 10 * 10 for k in range(40)})
    assert got == {k: (k % 5 + k // 10 * 10, labels.index(k % 5 + k // 10 * 10)) for k in range(40)}


# --- field files -------------------------------------------------------------------
def test_field_files_by_bytes(spark, tmp_path, monkeypatch):
    """Small limits make many files, tasks and batches; a field without elements is one file."""
    monkeypatch.setattr(ff, "WRITE_BYTES", 4000)
    monkeypatch.setattr(ff, "READ_BYTES", 1500)
    u = np.random.default_rng(3).standard_normal((97, 8))
    df = spark.createDataFrame([(int(e), v.tolist(), (v * 2).tolist()) for e, v in zip(np.random.default_rng(4).permutation(97), u, strict=True)], "e long, x array<double>, y array<double>").selectExpr("e", "x", "y", "x as z", "x as p")
    ff.write_field(df, f"{tmp_path}/a", (2, 2, 2), time=0.5)
    assert len(ff.files_of(f"{tmp_path}/a")) > 4
    read = ff.read_field(spark, f"{tmp_path}/a", "y,p")
    assert read.rdd.getNumPartitions() > 4
    got = {r["e"]: (r["time"], r["y"], r["p"]) for r in read.collect()}
    want = {r["e"]: (0.5, r["y"], r["p"]) for r in df.collect()}
    assert got == want
    ff.write_field(df.limit(0), f"{tmp_path}/b", (2, 2, 2))
    assert ff.read_field(spark, f"{tmp_path}/b", "x,p").collect() == []


@pytest.mark.parametrize("name", ["pod_streaming", "field_files", "pcg_poisson", "fft_pod", "fft_pod_reconstruction", "hilbert_pod", "global_cells", "log_index", "operate_sequence", "stream_pod"])
def test_empty_tables(spark, tmp_path_factory, name):
    d = tmp_path_factory.mktemp("empty")
    for t in ("embeddings", "events", "supplier", "part"):
        catalogue.table(spark, SF, t).limit(0).write.parquet(f"{d}/{t}.parquet")
    assert catalogue.queries()[name](spark, str(d)).collect() == []


def test_level_join_of_flat_boxes(spark):
    """Thin boxes in every direction and more combinations of sides than a point asks: each pair once, and of what
    meets in the cells a fair share holds."""
    rng = np.random.default_rng(21)
    low, side = rng.uniform(0, 60, (600, 2)), 10.0 ** rng.integers(-5, 2, (600, 2))
    points = rng.uniform(0, 70, (400, 2))
    p = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(points)], "id long, x double, y double")
    b = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(np.c_[low[:, 0], low[:, 0] + side[:, 0], low[:, 1], low[:, 1] + side[:, 1]])], "e long, x_lo double, x_hi double, y_lo double, y_hi double")
    want = sorted((i, e) for i, v in enumerate(points) for e in np.flatnonzero(((low <= v) & (v <= low + side)).all(axis=1)).tolist())
    for asked, whole in ((64, 10_000), (64, 50), (5, 50)):  # as it is, cells in parts, levels rounded up
        with pytest.MonkeyPatch.context() as m:
            m.setattr(st, "ASKED", asked)
            m.setattr(st, "WHOLE", whole)
            joined = st.level_join(p, b, ["x", "y"])
            assert sorted((r["id"], r["e"]) for r in joined.collect()) == want
            if asked == 64:
                assert "_lx" in joined._jdf.queryExecution().analyzed().toString()
    thin = spark.range(400).selectExpr("id as e", "id % 20 * 1.0D as x_lo", "id % 20 + 1e-4D as x_hi", "0.0D as y_lo", "64.0D as y_hi")
    plan = st.level_join(p, thin, ["x", "y"])._jdf.queryExecution().analyzed().toString()
    assert "_lx" in plan and "_ly" in plan  # a level per axis: a point meets the boxes of its 1e-4 of x, not all of them
