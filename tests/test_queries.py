"""Every query of the engine against its SQL, and identities of the operators."""

import numpy as np
import pytest
from compare import connect, differences

from nodeloom.functions import spectral as sp
from nodeloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    assert not differences(got, con.sql(catalogue.oracle_sql()[name]).df())


def test_golden_matrices():
    x, w = sp.gll(4)
    assert np.allclose(x, [-1, -0.447213595500, 0.447213595500, 1]) and np.allclose(w, [1 / 6, 5 / 6, 5 / 6, 1 / 6])
    assert np.allclose(sp.derivative(4)[0], [-3, 4.045084971875, -1.545084971875, 0.5])
    v, inv = sp.modal(4)
    assert np.allclose(v @ inv, np.eye(4)) and np.allclose(v[0], [0.707106781187, -1.224744871392, 1.581138830084, -1.224744871392])
    assert np.allclose(sp.interpolation(4, 3), [[1, 0, 0, 0], [-0.125, 0.625, 0.625, -0.125], [0, 0, 0, 1]])
    assert np.allclose(sp.cell_widths(np.linspace(0, 2 * np.pi, 5), 2 * np.pi).sum(), 2 * np.pi)


def test_high_order_kernel_equals_matrix(spark):
    from nodeloom.operators.elements import apply_axis

    n = 6
    u = np.random.default_rng(0).standard_normal(n**3)
    df = spark.createDataFrame([(u.tolist(),)], "u array<double>")
    got = np.array(apply_axis(df, "u", sp.derivative(n), "s", "v").first()["v"])
    assert np.allclose(got, np.einsum("ab,kbi->kai", sp.derivative(n), u.reshape(n, n, n)).ravel())


def test_decompositions(spark):
    a = np.stack([np.asarray(r["embedding"], float) for r in catalogue.table(spark, SF, "embeddings").orderBy("vec_id").collect()])
    want = np.linalg.svd(a, compute_uv=False)
    got = [r["sigma"] for r in catalogue.queries()["pod_singular_values"](spark, SF).orderBy("k").collect()]
    assert np.allclose(np.square(got), np.square(want), rtol=1e-6)
    assert catalogue.queries()["pod_reconstruction"](spark, SF).where("error > 0.001").count() == 0
    stream = [r["sigma"] for r in catalogue.queries()["pod_streaming"](spark, SF).orderBy("k").collect()]
    assert np.allclose(stream[0], want[0], rtol=0.05)
    again = [r["sigma"] for r in catalogue.queries()["pod_restart"](spark, SF).orderBy("k").collect()]
    assert np.allclose(again, stream, rtol=1e-10)


def _snapshots(spark):
    rows = catalogue.table(spark, SF, "embeddings").orderBy("vec_id").collect()
    return np.array([r["vec_id"] for r in rows]), np.stack([np.asarray(r["embedding"], float) for r in rows])


def test_singular_values_keep_their_digits(spark):
    """A matrix whose small singular values a Gram matrix would lose."""
    from nodeloom.operators import rom

    rng = np.random.default_rng(4)
    a = np.linalg.qr(rng.standard_normal((300, 6)))[0] @ np.diag([1.0, 1e-2, 1e-5, 1e-8, 1e-10, 1e-12]) @ np.linalg.qr(rng.standard_normal((6, 6)))[0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(a)], "row long, a array<double>").repartition(40)
    sigma, vt, modes = rom.pod(df, "row", "a", 6)
    assert np.allclose(sigma, [1.0, 1e-2, 1e-5, 1e-8, 1e-10, 1e-12], rtol=1e-3)
    u = np.stack([r["mode"] for r in modes.orderBy("row").collect()])
    assert np.allclose((u * sigma) @ vt, a, atol=1e-13)


def test_fourier_decomposition_equals_numpy(spark):
    _, a = _snapshots(spark)
    x = np.fft.fft(a.reshape(-1, 4, 4, 4), axis=-1) / 2
    got = catalogue.queries()["fft_pod"](spark, SF).toPandas()
    for kappa in range(3):
        want = np.linalg.svd(x[..., kappa].reshape(len(a), 16), compute_uv=False) * (2**0.5 if kappa else 1)
        assert np.allclose(got[got.kappa == kappa].sort_values("k").sigma, want, atol=1e-10)


def test_modes_equal_numpy(spark):
    """Values of the modes, weighted and not, up to their signs; extended modes; what a projection leaves."""
    ids, a = _snapshots(spark)
    q = catalogue.queries()

    def modes(name):
        f = q[name](spark, SF).toPandas().pivot(index="row", columns="k", values="value").sort_index()
        return f.to_numpy()

    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(np.abs(modes("pod_modes")), np.abs(u[:, :8]), atol=1e-6)
    m = np.where(ids % 7 == 0, 1e-12, ids % 7.0)
    w = np.linalg.svd(a * np.sqrt(m)[:, None], full_matrices=False)
    assert np.allclose([r["sigma"] for r in q["weighted_pod_sigma"](spark, SF).orderBy("k").collect()], w[1], rtol=1e-9)
    assert np.allclose(np.abs(modes("weighted_pod_modes")), np.abs(w[0][:, :4] / np.sqrt(m)[:, None]), rtol=1e-4, atol=1e-6)
    assert np.allclose(np.abs(modes("extended_modes")), np.abs((a * a) @ vt[:4].T / s[:4]), atol=1e-8)
    part = np.linalg.svd(a[:, :32], full_matrices=False)[0][:, :8]
    v = a[:, 40]
    assert abs(q["perpendicular_ratio"](spark, SF).first()[0] - np.linalg.norm(v - part @ (part.T @ v)) / np.linalg.norm(v)) < 1e-9


def test_location_on_curved_elements(spark):
    """Points of known reference coordinates in warped elements come back."""
    from nodeloom.operators import statistics as st

    rng, x = np.random.default_rng(5), sp.gll(4)[0]
    t, s, r = np.meshgrid(x, x, x, indexing="ij")
    mesh, probes, want = [], [], {}
    for e in range(12):
        grid = [e + (r + 1) / 2 + 0.05 * np.sin(2 * s + t), (s + 1) / 2 + 0.05 * np.cos(r * t + e), (t + 1) / 2 + 0.04 * r * s]
        mesh.append((e, *[g.ravel().tolist() for g in grid]))
        for k in range(6):
            q = rng.uniform(-0.9, 0.9, 3)
            rows = [sp.lagrange_rows(x, v)[0] for v in q]
            at = [float(np.einsum("kji,k,j,i", g, rows[2], rows[1], rows[0])) for g in grid]
            probes.append((100 * e + k, *at))
            want[100 * e + k] = (e, *q)
    probes.append((9999, 100.0, 0.5, 0.5))
    m = spark.createDataFrame(mesh, "e long, xs array<double>, ys array<double>, zs array<double>")
    got = {p["probe_id"]: p for p in st.locate(spark.createDataFrame(probes, "probe_id long, x double, y double, z double"), m, 4, 0.7).collect()}
    assert got.pop(9999)["err_code"] == 0
    for k, p in got.items():
        assert p["err_code"] == 1 and p["e"] == want[k][0] and np.allclose([p["r"], p["s"], p["t"]], want[k][1:], atol=1e-7)


def test_field_files_of_any_byte_order(spark, tmp_path):
    """Big-endian values, element numbers out of order, and a wrong tag."""
    from nodeloom.sources import fieldfile as ff

    u = np.random.default_rng(1).standard_normal((5, 8))
    ids = np.array([3, 1, 5, 2, 4])
    ff.write(f"{tmp_path}/a0.f00001", {"x": u, "y": u + 1, "z": u + 2, "p": 2 * u}, (2, 2, 2), ids=ids, order=">")
    got = {r["e"]: r for r in ff.read_field(spark, f"{tmp_path}/a0.f00001", "y,p", 2).collect()}
    assert all(np.allclose(got[i - 1]["y"], u[k] + 1) and np.allclose(got[i - 1]["p"], 2 * u[k]) for k, i in enumerate(ids))
    raw = bytearray((tmp_path / "a0.f00001").read_bytes())
    raw[132:136] = b"\0\0\0\0"
    (tmp_path / "b0.f00001").write_bytes(raw)
    with pytest.raises(Exception, match="byte-order"):
        ff.read_field(spark, f"{tmp_path}/b0.f00001")
    got = ff.parse_header(ff.header(4, (3, 3, 1), 7, 0.5, 9, "XUPTS02", 20, 1, 3) + np.array([6.54321], "<f4").tobytes())
    assert (got["elements"], got["total"], got["number"], got["files"], got["order"]) == (7, 20, 1, 3, "<")


def test_merged_axes_and_guards(spark, tmp_path):
    from nodeloom.functions import monitor
    from nodeloom.operators import routing
    from nodeloom.sources import container

    assert container.merged_axes([2, 3, 4, 5], [6, 20]) == [(0, 2), (2, 4)] and container.merged_axes([2, 3], [4]) is None
    assert monitor.may_write(spark, str(tmp_path), True) == "overwrite"
    with pytest.raises(FileExistsError):
        monitor.may_write(spark, str(tmp_path), False)
    log = monitor.Logger("test")
    log.tic()
    assert log.toc("step") >= 0 and monitor.MemoryMonitor().table_mb(spark.range(1000), "range") > 0
    assert routing.all_gather(spark.range(10)).count() == 10
    with pytest.raises(ValueError):
        routing.all_gather(spark.range(11), 10)


def test_solver_and_codecs(spark):
    q = catalogue.queries()
    assert q["pcg_poisson"](spark, SF).first()["small"]
    assert q["bitplane_roundtrip"](spark, SF).where("not exact").count() == 0
    assert q["gp_sampling"](spark, SF).where("n <> 16 or different <> 16").count() == 0


@pytest.fixture(scope="module")
def few_elements(spark, tmp_path_factory):
    """A folder with 70 elements (two layers of the brick), and their values."""
    u = np.random.default_rng(3).standard_normal((70, 64)).astype(np.float32)
    d = str(tmp_path_factory.mktemp("few"))
    spark.createDataFrame([(e, v.tolist()) for e, v in enumerate(u)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d, u.astype(float)


def test_solver_goes_to_its_tolerance_on_all_elements(spark, few_elements):
    """The residual of the assembled dense system."""
    d, u = few_elements
    w1, dm = sp.gll(4)[1], sp.derivative(4)
    one, m = dm.T @ np.diag(w1) @ dm, np.diag(w1)
    local = (np.kron(np.kron(m, m), one) + np.kron(np.kron(m, one), m) + np.kron(np.kron(one, m), m)) / 2
    mass = np.kron(np.kron(w1, w1), w1) / 8
    k, j, i = (x.ravel() for x in np.meshgrid(*[np.arange(4)] * 3, indexing="ij"))
    at = [list(zip(e % 8 * 3 + i, e // 8 % 8 * 3 + j, e // 64 * 3 + k, strict=True)) for e in range(70)]
    number = {g: n for n, g in enumerate(sorted({tuple(map(int, g)) for a in at for g in a}))}
    a, b = np.zeros((len(number), len(number))), np.zeros(len(number))
    for e, places in enumerate(at):
        ids = np.array([number[tuple(map(int, g))] for g in places])
        a[np.ix_(ids, ids)] += local + np.diag(mass)
        b[ids] += u[e] * mass
    got = {(r["gx"], r["gy"], r["gz"]): r for r in catalogue.queries()["pcg_poisson"](spark, d).collect()}
    assert got.keys() == number.keys() and all(r["small"] for r in got.values())
    x = np.array([got[g]["v"] for g in number])
    assert np.sqrt(np.mean((b - a @ x) ** 2)) < 1.01e-4 < np.sqrt(np.mean(b**2))


def test_gp_samples_of_all_elements(spark, few_elements):
    """Every node taken has the largest posterior deviation of those that are free; the mean is the posterior's."""
    d, u = few_elements
    got = {r["e"]: r for r in catalogue.queries()["gp_sampling"](spark, d).collect()}
    assert sorted(got) == list(range(70))
    v, inv = sp.modal(4)
    basis, back = np.kron(np.kron(v, v), v), np.kron(np.kron(inv, inv), inv)
    for e, r in got.items():
        cov = basis @ np.diag((back @ u[e]) ** 2) @ basis.T
        noise = 1e-10 * np.trace(cov) / 64
        for n in range(16):
            s = r["nodes"][:n]
            var = np.diag(cov - cov[:, s] @ np.linalg.inv(cov[np.ix_(s, s)] + noise * np.eye(n)) @ cov[s])
            free = [p for p in range(64) if p not in s]
            assert r["nodes"][n] in free and var[r["nodes"][n]] >= var[free].max() - 1e-6 * np.trace(cov)
        s = r["nodes"]
        assert np.allclose(r["mean"], cov[:, s] @ np.linalg.solve(cov[np.ix_(s, s)] + noise * np.eye(16), u[e][s]), atol=1e-5)


def test_box_join_of_all_boxes(spark, tmp_path):
    rng = np.random.default_rng(8)
    value, size = rng.uniform(0, 500, 200).round(1), rng.integers(1, 51, 1200)
    spark.createDataFrame([(k, float(v)) for k, v in enumerate(value)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(k + 1, int(v)) for k, v in enumerate(size)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = sorted((e, b + 1) for e, v in enumerate(value) for b, s in enumerate(size) if s <= v / 10 <= s + 1.5 and (b + 1) % 50 <= e % 50 <= (b + 1) % 50 + 2)
    got = sorted((r["event_id"], r["p_partkey"]) for r in catalogue.queries()["bbox_range_join"](spark, str(tmp_path)).collect())
    assert got == want and any(b > 500 for _, b in want)


def test_singular_system_without_mean(spark):
    """The Laplacian of a path of six nodes against its pseudo-inverse; the solver keeps out of the constants."""
    from pyspark.sql import functions as F

    from nodeloom.operators import solver

    catalogue._folder(spark)
    a = np.diag([1.0, 2, 2, 2, 2, 1]) - np.eye(6, k=1) - np.eye(6, k=-1)
    entries = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(6) if a[i, j]], "i long, k long, m double")
    b = np.arange(6.0) ** 2
    rhs = spark.createDataFrame([(k, float(v)) for k, v in enumerate(b)], "k long, v double")

    def apply(v):
        return entries.join(v, "k").groupBy("i").agg(F.sum(F.col("m") * F.col("v")).alias("v")).withColumnRenamed("i", "k")

    x, steps, rms = solver.conjugate_gradients(apply, rhs, ["k"], tol=1e-10, most=8, project=solver.without_mean)
    got = np.array([r["v"] for r in x.orderBy("k").collect()])
    assert steps <= 6 and rms < 1e-10 and np.allclose(got, np.linalg.pinv(a) @ (b - b.mean()), atol=1e-8)


def test_stream_of_snapshots(spark):
    q = catalogue.queries()
    want = [r["sigma"] for r in q["pod_streaming"](spark, SF).orderBy("k").collect()]
    assert np.allclose([r["sigma"] for r in q["stream_pod"](spark, SF).orderBy("k").collect()], want, rtol=1e-9)


def test_oriented_boxes_hold_turned_elements(spark):
    """A long element along a diagonal: its oriented box is far smaller than the straight one, and holds it."""
    from nodeloom.operators import search

    x = sp.gll(4)[0]
    t, s, r = (v.ravel() for v in np.meshgrid(x, x, x, indexing="ij"))
    mesh = spark.createDataFrame([(0, (5 * r - 0.1 * s).tolist(), (5 * r + 0.1 * s).tolist(), (0.1 * t).tolist())], "e long, xs array<double>, ys array<double>, zs array<double>")
    b = np.array(search.oriented_boxes(mesh, 4).first()["obb"])
    assert np.allclose(np.sort(b[12:]), np.sort([5 * 2**0.5 * 1.05, 0.1 * 2**0.5 * 1.05, 0.1 * 1.05]))
    points = spark.createDataFrame([(1, 2.0, 2.0, 0.0), (2, 2.0, -2.0, 0.0)], "probe_id long, x double, y double, z double")
    found = search.ball_candidates(points, mesh)
    assert found.count() == 2 and [r["probe_id"] for r in search.refine_oriented(found, search.oriented_boxes(mesh, 4)).collect()] == [1]


def test_command_lines(spark, tmp_path):
    from nodeloom import cli
    from nodeloom.sources import fieldfile as ff

    u = np.random.default_rng(2).standard_normal((4, 8))
    x = np.array([[k + (p % 2) for p in range(8)] for k in range(4)], float)
    zero = np.array([[(p // 2) % 2 for p in range(8)]] * 4, float), np.array([[p // 4 for p in range(8)]] * 4, float)
    for n, time in ((0, 0.5), (1, 1.5), (2, 3.0)):
        ff.write(f"{tmp_path}/mean0.f{n:05d}", {"x": x, "y": zero[0], "z": zero[1], "p": u + n}, (2, 2, 2), time=time)
    (tmp_path / "notes.txt").write_text("no field file")
    rows = [(r["idx"], r["time_prev"], r["dt"]) for r in cli.index_folder(spark, str(tmp_path), 0.25, 0.0).orderBy("number").collect()]
    assert rows == [(0, 0.0, 0.5), (1, 0.5, 1.0), (2, 1.5, 1.5)]
    assert cli.sequence(str(tmp_path), "mean").splitlines() == ["filetemplate: mean%01d.f%05d", "firsttimestep: 0", "numtimesteps: 3"]
    assert cli.subdomain(spark, f"{tmp_path}/mean0.f00001", f"{tmp_path}/cut", cli.parse_bounds("1,3,,,,"), ["p"]) == 2
    assert cli.subdomain(spark, f"{tmp_path}/mean0.f00001", f"{tmp_path}/finer", cli.parse_bounds("1,3,,,,"), ["p"], 4) == 2
    finer = {r["e"]: r for r in ff.read_field(spark, f"{tmp_path}/finer", "x,p").collect()}
    m = sp.interpolation(2, 4)
    assert np.allclose(finer[1]["p"], np.kron(np.kron(m, m), m) @ (u[2] + 1)) and np.allclose(sorted(set(np.round(finer[0]["x"], 9))), 1 + (sp.gll(4)[0] + 1) / 2)
    got = {r["e"]: r["p"] for r in ff.read_field(spark, f"{tmp_path}/cut", "p").collect()}
    assert np.allclose([got[0], got[1]], u[1:3] + 1)


def test_workers_need_no_package(tmp_path):
    """The driver runs in another folder and workers can't import the package."""
    import os
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(catalogue.__file__)))!r} + "/..")
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
from nodeloom.plans import catalogue
q = catalogue.queries()
for name in ("strain_tensor", "modal_filter", "metric_terms", "stiffness_curved", "scalar_derivatives", "locate_points", "probe_interpolation", "fft_pod", "gp_sampling", "stored_bitplanes", "field_files", "oriented_candidates"):
    assert q[name](spark, {SF!r}).count() > 0, name
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "all ran" in out.stdout, out.stderr[-2000:]
