import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumivox import jobs, sinks
from lumivox.api import Scan
from lumivox.functions import numeric as N
from lumivox.functions.storage import checkpointed
from lumivox.operators import decon, dense, models, qc, tissue
from lumivox.operators import order_stats as O
from lumivox.operators import voxel as V
from lumivox.plans import pipelines
from lumivox.sinks import fits
from lumivox.sources import nifti, text
from lumivox.sources.schemas import VOXEL

NAN = float("nan")


def cube(spark, n=4, value=lambda x, y, z: 1.0):
    return spark.createDataFrame([("s", x, y, z, True, [float(value(x, y, z))] * 2) for x in range(n) for y in range(n) for z in range(n)], VOXEL)


def test_erosion_clears_the_border(spark):
    assert V.erode(cube(spark, 4)).count() == 8
    assert V.erode(cube(spark, 4), 2).count() == 0


def test_order_statistics_keep_their_conventions(spark):
    df = spark.createDataFrame([("a", v) for v in (4.0, 1.0, 3.0, 2.0, NAN)] + [("b", 5.0), ("b", None)], "g string, v double")
    assert {r.g: r.q for r in O.nearest_rank(df, ["g"], "v", {"q": 0.5}).collect()} == {"a": 3.0, "b": 5.0}
    assert {r.g: r.median for r in O.averaging_median(df, ["g"], "v").collect()} == {"a": 2.5, "b": 5.0}
    assert {r.g: r.median for r in O.upper_median(df, ["g"], "v").collect()} == {"a": 3.0, "b": 5.0}
    q = {r.g: (r.q1, r.q3) for r in O.iqr_quartiles(df.where("g = 'a'"), ["g"], "v").collect()}
    assert q == {"a": (1.0, 4.0)}  # NaN first: NaN 1 2 3 4, elements 1 and 4
    assert O.top_n(df.where("g = 'a'"), ["g"], "v", 2).count() == 2
    hot = spark.createDataFrame([("a", 7.0)] * 500 + [("a", float(k)) for k in range(7)], "g string, v double")  # most rows have one value
    assert O.nearest_rank(hot, ["g"], "v", {"a": 0.005, "b": 0.5, "c": 1.0}).first()[1:] == (3.0, 7.0, 7.0)
    with pytest.raises(ValueError):
        O.top_n(df, ["g"], "v", 0)
    with pytest.raises(Exception, match="values asked for"):
        O.top_n(df, ["g"], "v", 5).count()
    with pytest.raises(Exception, match="round to none"):
        df.groupBy("g").agg(O.percent_count(F.count("v"), 1.0).alias("n")).collect()
    ties = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 2.0)], "g string, v double")
    assert O.top_n(ties, ["g"], "v", 1).count() == 3


def test_optimal_threshold_splits_two_groups(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 1.1, 0.9, 1.05] * 5 + [5.0, 5.2, 4.9] * 5], "v double")
    assert 1.1 < O.optimal_threshold(df, "v") < 4.9
    assert O.optimal_threshold(df.select(F.lit(2.0).alias("v")), "v") is None


def plain_threshold(v, tol=0.01):
    """The rule on an array: golden section from the middle, stopping by the bracket's own values."""
    v = np.asarray(v, float)
    g, a, b = 0.61803399, v.min() + 0.001 * np.ptp(v), v.max() - 0.001 * np.ptp(v)
    cost = lambda t: -np.corrcoef(v, v > t)[0, 1]
    y = (v.min() + v.max()) / 2
    x = y - (1 - g) * (y - a)
    while b - a > tol * (abs(x) + abs(y)):
        if cost(y) < cost(x):
            a, x, y = x, y, g * y + (1 - g) * b
        else:
            b, y, x = y, x, g * x + (1 - g) * a
    return min((y, x), key=cost)  # the latter one where they are equal


def test_ranks_are_exact_where_quantiles_are_approximate(spark):
    df = spark.range(150_000).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7).alias("v"), F.concat(F.lit("group "), F.col("id") % 3).alias("g"))
    found = O.nearest_rank(df, ["g"], "v", {f"q{k}": k / 20 for k in range(21)})
    # approximate quantiles come out otherwise each time that they are made: a plan that both counts and orders by them may make them once
    assert "percentile_approx" not in found._jdf.queryExecution().toString()
    got, top = {r.g: r for r in found.collect()}, {r.v for r in O.top_n(df, ["g"], "v", 700).collect()}
    for g, some in df.toPandas().groupby("g")["v"]:
        v = np.sort(some.to_numpy())
        assert [got[g][f"q{k}"] for k in range(21)] == [v[int((len(v) - 1) * k / 20 + 0.5)] for k in range(21)]
        assert top >= set(v[-700:])
    assert len(top) == 2100


@pytest.mark.parametrize("seed", range(3))
def test_optimal_threshold_follows_the_rule(spark, seed):
    rng = np.random.default_rng(seed)
    v = [np.concatenate([rng.normal(1, 0.2, 600), rng.normal(2.2, 0.3, 300)]), rng.gamma(2, 1, 900), rng.uniform(1, 3, 900)][seed]
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert O.optimal_threshold(df, "v") == pytest.approx(plain_threshold(v), rel=1e-9)
    assert O.optimal_threshold(df, "v", 0.7) == pytest.approx(plain_threshold(v - 0.7), rel=1e-9)
    kept = {r.v for r in O.threshold_select(df, "v", 0.7, below=True).collect()}
    assert kept == {float(x) for x in v if x - 0.7 < plain_threshold(v - 0.7)}


def test_constant_volumes_have_no_correlation(spark):
    v = spark.createDataFrame([("s", k, 0, 0, True, [float(k), 7.0, float(2 * k)]) for k in range(5)], VOXEL)
    pairs = spark.createDataFrame([("s", 0, 1), ("s", 0, 2)], "scan_id string, i int, j int")
    r = {x.j: x.r for x in qc.pair_correlations(v, pairs).collect()}
    assert np.isnan(r[1]) and r[2] == pytest.approx(1)


def test_flat_slices_are_no_outliers(spark):
    s = qc.outlier_slices(cube(spark, 4), qc.SliceOptions(min_voxels=1)).collect()
    assert len(s) == 4 and qc.outlier_slices(cube(spark, 4)).count() == 0 and all(np.isnan(r.ratio) and not r.outlier for r in s)
    spiky = qc.outlier_slices(cube(spark, 5, lambda x, y, z: 100.0 * (z == 2) + z), qc.SliceOptions(min_voxels=1)).collect()
    assert {r.slice for r in spiky if r.outlier} == {2}


def test_corrupted_slices_are_found_and_no_others(spark):
    rng = np.random.default_rng(5)
    x, y, z = np.meshgrid(*(np.arange(n) for n in (20, 20, 12)), indexing="ij")
    data = np.stack([100 + 10 * np.sin(x / 5 + k) + 8 * np.cos(y / 6) + 3 * z + rng.normal(0, 0.5, x.shape) for k in range(4)], axis=-1)
    make = lambda d: spark.createDataFrame([("s", *map(int, k), True, d[k].tolist()) for k in np.ndindex(20, 20, 12)], VOXEL)
    assert qc.outlier_slices(make(data)).where("outlier").count() == 0
    data[:, :, 6, 1] *= 0.3
    bad = {(r.vol, r.slice) for r in qc.outlier_slices(make(data)).where("outlier").collect()}
    assert (1, 6) in bad and all(v == 1 and 5 <= k <= 7 for v, k in bad)


def test_planes_are_smoothed_over_the_whole_grid(spark):
    rng, kernel = np.random.default_rng(3), np.array(qc.gaussian_kernel(1.0))
    data = np.zeros((4, 5, 3, 2), np.float32)
    there = [k for k in np.ndindex(4, 5, 3) if k[2] < 2 or k[1] < 3 and k != (3, 2, 2)]  # the last plane isn't full
    for k in there:
        data[k] = rng.uniform(1, 2, 2)
    v = spark.createDataFrame([("s", *map(int, k), True, data[k].astype(float).tolist()) for k in there], VOXEL)
    for axis in range(3):
        want = data
        for a in (a for a in range(3) if a != axis):
            n = want.shape[a]
            at = [[min(i % (2 * n), 2 * n - 1 - i % (2 * n)) for i in range(p - 4, p + 5)] for p in range(n)]
            want = np.stack([sum(w * want.take(i, a).astype(float) for w, i in zip(kernel, row)) for row in at], axis=a).astype(np.float32)
        got = {(r.x, r.y, r.z): r.signal for r in qc.smooth_in_plane(v, 1.0, axis).collect()}
        assert got.keys() == set(np.ndindex(4, 5, 3)) and all(np.allclose(got[k], want[k], rtol=1e-6) for k in got)
    # the slice before the last is compared at all its voxels
    sent = {(r.vol, r.slice): r.ratio for r in qc.outlier_slices(v, qc.SliceOptions(min_voxels=1, sigma=1.0)).collect()}
    off, spread = (np.abs(x).sum(axis=(0, 1)) for x in (want[:, :, 1] - (want[:, :, 0] + want[:, :, 2]) / 2, (want[:, :, 2] - want[:, :, 0]) / 2))
    assert sent == {(k, 1): pytest.approx(off[k] / spread[k], rel=1e-4) for k in range(2)}


def field(spark, shape, direction, fa=lambda k: 0.6):
    """One unit direction for each place of a grid."""
    rows = []
    for k in np.ndindex(*shape):
        d = np.asarray(direction(*k), float)
        rows.append(("s", *map(int, k), float(fa(k)), (d / np.linalg.norm(d)).tolist()))
    return spark.createDataFrame(rows, "scan_id string, x int, y int, z int, fa double, principal_dir array<double>")


def test_smooth_fields_are_coherent_and_random_ones_are_not(spark):
    rng = np.random.default_rng(9)
    smooth, wild = field(spark, (8, 8, 4), lambda x, y, z: (1, 0, 0)), field(spark, (8, 8, 4), lambda x, y, z: rng.random(3) - 0.5)
    a, b = qc.fixel_coherence(smooth).first(), qc.fixel_coherence(wild).first()
    assert a.coherence == 1 and a.n_evaluated == a.n_connected == 256 and b.coherence < 0.5
    assert qc.chain_lengths(smooth, (2.0, 1.0, 1.0)).first().chain_length == pytest.approx(14)  # seven steps of 2 mm
    assert qc.chain_lengths(wild).first().chain_length < 2
    # a voxel whose only neighbour on the line lies behind it is connected, one without any isn't but counts
    two = field(spark, (2, 1, 1), lambda x, y, z: (1, 0, 0)).union(field(spark, (1, 1, 1), lambda x, y, z: (0, 0, 1)).withColumn("z", F.lit(9)))
    assert qc.fixel_coherence(two, quantile=0.0).first().coherence == pytest.approx(2 / 3)
    # the lowest tenth by anisotropy is left out
    assert qc.fixel_coherence(field(spark, (10, 1, 1), lambda x, y, z: (1, 0, 0), lambda k: 0.1 + 0.05 * k[0])).first().n_evaluated == 9


def test_long_rings_settle_and_a_flipped_table_is_named(spark):
    ring = lambda flip: lambda x, y, z: (flip * -(y - 7.5), x - 7.5, 0)
    good = qc.table_ratio(qc.gradient_table_check(field(spark, (16, 16, 2), ring(1)), quantile=0.0)).first()
    assert good.best == "012" and good.current_is_best and good.gradient_table_ratio == 1
    bad = qc.table_ratio(qc.gradient_table_check(field(spark, (16, 16, 2), ring(-1)), quantile=0.0)).first()
    assert bad.best in ("012fx", "012fy") and not bad.current_is_best and bad.gradient_table_ratio > 1.2


def test_neighbours_of_all_voxels_are_not_broadcast(spark):
    some = checkpointed(field(spark, (6, 6, 4), lambda x, y, z: (1, 0, 0)))
    for df in (qc._ends(some, ["scan_id"], 15.0, (1.0, 1.0, 1.0)), qc._links(some, ["scan_id"], 15.0, (1.0, 1.0, 1.0))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert df.count() == 5 * 24


def fibre_scan(spark, n=5):
    """All voxels with one fibre direction along x."""
    v = np.arange(32)
    gz = 1 - 2 * (v + 0.5) / 32
    r = np.sqrt(1 - gz * gz)
    g = np.vstack([[[0, 0, 0]] * 2, np.tile(np.stack([r * np.cos(v * 2.399963), r * np.sin(v * 2.399963), gz], axis=1), (3, 1))])
    b = np.concatenate([[0, 0], np.repeat([1000.0, 2000, 3000], 32)])
    rng = np.random.default_rng(1)
    wm = np.exp(-b * (0.3e-3 + 1.4e-3 * g[:, 0] ** 2))
    gm, csf = np.exp(-b * 0.8e-3), np.exp(-b * 3e-3)
    data = np.zeros((n, n, n, len(b)))
    for x, y, z in np.ndindex(n, n, n):
        data[x, y, z] = 1000 * (wm if z < 2 else gm * 1.3 if z < 4 else csf * 2.6) * np.exp(rng.normal(size=len(b)) * 2e-3)
    return Scan.from_array(spark, data, b, g, np.ones((n, n, n)))


def test_report_and_coherence_of_parallel_fibres(spark):
    scan = fibre_scan(spark, 4)
    wm = scan.tensor.where("z < 2")
    assert qc.fixel_coherence(wm, quantile=0.0).first().coherence == pytest.approx(1)
    chains = qc.chain_lengths(wm, quantile=0.0, long_mm=2.5).first()
    assert chains.chain_length == pytest.approx(3, abs=0.1)
    table = {r.table: r.score for r in qc.gradient_table_check(wm, quantile=0.0).collect()}
    assert len(table) == 24 and table["012"] == max(table.values())
    row = scan.report(coherence=False).first()
    assert row.n_b0_volumes == 2 and row.n_dwi_volumes == 96 and row.ndc > 0.9 and row.fixel_coherence is None
    assert qc.warnings(scan.report(coherence=False)).count() == 1
    assert qc.input_quality(scan.voxels, scan.gradient).first().summary.startswith("NDC ")


def test_dense_pipeline_tells_tissues_apart(spark):
    scan = fibre_scan(spark, 5)
    pick = tissue.Selection(*(scan.voxels.where(w).select(*V.KEY) for w in ("z < 2", "z in (2, 3)", "z = 4")))
    run = pipelines.dense(scan.voxels, scan.bvals, scan.directions, scan.shape, pick, o=decon.DenseOptions(lmax=4, floor=False), n=decon.NormaliseOptions(order=0, rounds=1, inner=1))
    rows = run.tissue.collect()
    for r in rows:
        shares = {"wm": r.wm0 * decon.SQRT4PI, "gm": r.gm, "csf": r.csf}
        assert max(shares, key=shares.get) == ("wm" if r.z < 2 else "gm" if r.z < 4 else "csf")
    y = N.sh_matrix(N.hemisphere(), 4)
    assert (np.array([r.wm for r in rows], dtype=float) @ y.T).min() > -1e-3
    assert run.details["reference_b0"] == pytest.approx(1000, rel=0.05)
    first = {t: r[0, 0] / decon.SQRT4PI for t, r in run.responses.items()}
    assert first == pytest.approx({"wm": 1.0, "gm": 1.3, "csf": 2.6}, rel=0.01)


def test_kurtosis_fit_recovers_planted_parameters():
    b = np.repeat([0.0, 500, 1000, 2000, 3000], 11)
    c = np.tile(np.linspace(0, 1, 11), 5)
    truth = tissue.KurtosisFit(np.array([1.0, 1.6, 0.4, 0.05, 0.0, 0.0, 0.02]), False, 0, 0, 0, True)
    f = tissue.fit_kurtosis(b, c, truth.signal(b, c))
    assert f.rmsr < 5e-3
    with pytest.raises(ValueError):
        tissue.fit_kurtosis(b[:22], c[:22], truth.signal(b, c)[:22])


def test_smooth_rows_fall_with_b(spark):
    s = spark.createDataFrame([("s", "gm", 1.3, float(b), 1.0, 1.3 * float(np.exp(-b * 1e-3)), 1.0) for b in (500, 1000, 1500, 2000) for _ in range(3)], "scan_id string, tissue string, level double, b double, cos double, y double, w double")
    r = np.array([x.coeffs[0] for x in dense.smooth_rows(s, 2000.0, 0, 250.0).orderBy("row").collect()])
    assert (np.diff(r) <= 1e-6).all() and r[0] == pytest.approx(1.3 * np.sqrt(4 * np.pi), rel=1e-3) and r.min() >= -1e-9
    assert r[4] == pytest.approx(1.3 * np.exp(-1) * np.sqrt(4 * np.pi), rel=0.02)


def selected_of(scan, scan_id="scan"):
    pick = tissue.Selection(*(scan.voxels.where(w).select(*V.KEY) for w in ("z < 2", "z in (2, 3)", "z = 4")))
    return dense.union_of(pick, scan.voxels, scan.tensor).withColumn("scan_id", F.lit(scan_id))


@pytest.mark.parametrize("estimator", ["kernel", "smooth", "kurtosis"])
def test_dense_responses_keep_what_tissues_differ_in_without_weighting(spark, estimator):
    scan = fibre_scan(spark, 5)
    own = selected_of(scan, "a")
    both = own.union(own.withColumn("scan_id", F.lit("b")).withColumn("signal", F.transform("signal", lambda v: v * F.lit(7.0))))  # another gain
    got = dense.responses(both, scan.bvals, scan.directions, estimator, lmax=4).collect()
    rows = {(r.scan_id, r.tissue, r.row): np.array(r.coeffs) for r in got}
    assert len(rows) == len(got) == 2 * 3 * 63
    for t, level in (("wm", 1.0), ("gm", 1.3), ("csf", 2.6)):
        assert rows["a", t, 0][0] / dense.SQRT4PI == pytest.approx(level, rel=0.01)
        assert not rows["a", t, 0][1:].any() or estimator != "kernel"
        for k in range(63):
            assert rows["a", t, k] == pytest.approx(rows["b", t, k], rel=1e-4, abs=1e-4)
    for t, level, decay in (("gm", 1.3, 0.8e-3), ("csf", 2.6, 3e-3)):
        for k in (20, 40, 60):
            assert rows["a", t, k][0] / dense.SQRT4PI == pytest.approx(level * np.exp(-50 * k * decay), rel=0.03, abs=0.02)
    with pytest.raises(ValueError):
        dense.responses(both, scan.bvals, scan.directions, "spline")


def test_dense_samples_stand_where_each_voxel_saw_them(spark):
    scan = fibre_scan(spark, 5)
    stretch = np.diag([1.1, 1.0, 0.9])
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    own = selected_of(scan).withColumn("graddev", F.when(F.col("tissue") == "gm", F.array(*[F.lit(float(x)) for x in stretch.ravel()])).otherwise(F.array(*[F.lit(float(x)) for x in np.eye(3).ravel()])))
    for r in (None, turn):
        s = dense.pooled_samples(own, dense.levels(own, scan.bvals), scan.bvals, scan.directions, rotation=r)
        want, g = models.effective_table(scan.bvals, scan.directions, stretch, rotation=r)
        got = sorted({round(x.b, 6) for x in s.where("tissue = 'gm'").select("b").distinct().collect()})
        assert got == sorted({round(float(b), 6) for b in want[scan.bvals > 50]})
        assert {x.b for x in s.where("tissue = 'wm'").select("b").distinct().collect()} == {1000.0, 2000.0, 3000.0}
    # turned table and turned frame: the same deviations seen from another frame
    here, there = models.effective_table(scan.bvals, scan.directions, stretch), models.effective_table(scan.bvals, scan.directions @ turn.T, stretch, rotation=turn)
    assert np.allclose(here[0], there[0]) and np.allclose(here[1] @ turn.T, there[1])
    table = decon.graddev_table(own.where("tissue = 'gm'").limit(1).withColumns({c: F.lit(0) for c in "xyz"}), scan.bvals, scan.directions @ turn.T, turn).orderBy("vol").collect()
    assert np.allclose([t.b_eff for t in table], there[0]) and np.allclose([t.direction for t in table], there[1])
    moved = dense.b_shift(own.withColumn("in_mask", F.lit(True)), scan.bvals, scan.directions).first()
    assert moved.largest == pytest.approx(want.max(), rel=1e-6) and 0 < moved["shift"] < 0.21 * 3000


def test_b_shift_sees_deviations_in_the_frame_of_the_table(spark):
    scan = fibre_scan(spark, 2)
    stretch, turn = np.diag([1.1, 1.0, 0.9]), np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    own = scan.voxels.withColumn("graddev", F.array(*[F.lit(float(x)) for x in stretch.ravel()])).withColumn("in_mask", F.lit(True))
    largest = []
    for r in (None, turn):
        want = models.effective_table(scan.bvals, scan.directions, stretch, rotation=r)[0]
        got = dense.b_shift(own, scan.bvals, scan.directions, rotation=r).first()
        assert got.largest == pytest.approx(want.max(), rel=1e-9)
        largest.append(got.largest)
    assert abs(largest[0] - largest[1]) > 0.01

def test_peaks_of_two_crossing_fibres(spark):
    d = np.array([[1, 0, 0], [0, 1, 0.0]])
    y = N.sh_matrix(N.hemisphere(), 8)
    amp = sum(np.maximum(0, (N.hemisphere() @ u) ** 2) ** 12 for u in d)
    sh = np.linalg.lstsq(y, amp, rcond=None)[0]
    df = spark.createDataFrame([("s", 0, 0, 0, sh.tolist())], "scan_id string, x int, y int, z int, sh array<double>")
    f = models.peaks(df, 8).first().fixels
    assert len(f) == 2
    for p in f:
        assert max(abs(np.array(p.dir) @ u) for u in d) > 0.99
    with pytest.raises(ValueError):
        models.with_options(models.ShoreOptions(), eps=2.0)


def plain_normalise(x, places, order, rounds, inner, target):
    """The rule on arrays: x (voxels, tissues), places in -1..1."""
    n, t = x.shape
    p = np.stack([np.prod(places**np.array(k), axis=1) for k in N.polynomial_terms(order)], axis=1)
    balance, field, coef = np.ones(t), np.ones(n), np.zeros(p.shape[1])

    def weights(k):
        with np.errstate(divide="ignore"):
            log = np.log(x @ balance / field)
        s = np.sort(log)
        q1, q3 = (s[min(int(np.floor(n * q + 0.5)), n - 1)] for q in (0.25, 0.75))
        return np.isfinite(log) & (log >= q1 - k * (q3 - q1)) & (log <= q3 + k * (q3 - q1))

    w = weights(3.0)
    for _ in range(rounds):
        for _ in range(inner):
            s = x[w] / field[w, None]
            b = np.linalg.solve(s.T @ s, s.sum(0))
            balance = b / np.exp(np.log(b).mean())
            before, w = w, weights(1.5)
            if (w == before).all():
                break
        coef = np.linalg.lstsq(p[w], np.log(x[w] @ balance / target), rcond=None)[0]
        field = np.exp(p @ coef)
    return balance, field


def test_normalisation_follows_the_rule(spark):
    rng = np.random.default_rng(7)
    shape = (8, 7, 4)
    k = np.array(list(np.ndindex(*shape)))
    places = 2 * k / (np.array(shape) - 1) - 1
    true = np.exp(0.3 * places[:, 0] - 0.2 * places[:, 1] ** 2)
    x = rng.dirichlet([2, 1, 1], len(k)) * true[:, None] * np.array([1.0, 0.7, 1.4]) * np.exp(rng.normal(0, 0.02, (len(k), 1)))
    x[:6] *= 8  # outliers
    x[6] = 0
    rows = [("s", *map(int, c), True, *map(float, v), [float(v[0]), 0.5, -0.25]) for c, v in zip(k, x)]
    df = spark.createDataFrame(rows, "scan_id string, x int, y int, z int, in_mask boolean, wm0 double, gm double, csf double, wm array<double>")
    sums = np.sort(x.sum(1)[x.sum(1) > 0])
    target = sums[len(sums) // 2]
    balance, f = plain_normalise(x, places, 2, 3, 7, target)
    level = decon.fit_level(df, ["wm0", "gm", "csf"], shape, decon.NormaliseOptions(order=2, rounds=3))
    assert level.target == pytest.approx(target) and level.balance == pytest.approx(balance, rel=1e-6)
    out = {(r.x, r.y, r.z): r for r in decon.normalise(df, ["wm0", "gm", "csf"], shape, level=level).collect()}
    for c, v, g in zip(k, x, f):
        r = out[tuple(c)]
        assert r.field == pytest.approx(g, rel=1e-6) and r.gm == pytest.approx(v[1] / g) and r.wm == pytest.approx([v[0] / g, 0.5 / g, -0.25 / g])
    with pytest.raises(ValueError):
        decon.fit_level(df.withColumn("gm", F.lit(0.0)).withColumn("csf", F.col("wm0") * 2), ["wm0", "gm", "csf"], shape, decon.NormaliseOptions(target=-1.0))


def test_scans_normalised_together_are_as_if_alone(spark):
    rng = np.random.default_rng(11)
    rows, shapes, alone = [], [], {}
    o = decon.NormaliseOptions(order=2, rounds=3)
    for scan, shape, spread in (("a", (9, 8, 5), 0.02), ("b", (5, 5, 5), 0.3), ("c", (12, 6, 7), 0.1)):
        k = np.array(list(np.ndindex(*shape)))
        places = 2 * k / (np.array(shape) - 1) - 1
        x = rng.dirichlet([2, 1, 1], len(k)) * np.exp(0.4 * places[:, :1] * places[:, 1:2]) * [1.0, 0.6, 1.9] * np.exp(rng.normal(0, spread, (len(k), 1)))
        x[:4] *= 9
        sums = np.sort(x.sum(1))
        alone[scan] = (sums[len(sums) // 2], *plain_normalise(x, places, 2, 3, 7, sums[len(sums) // 2]), k)
        rows += [(scan, *map(int, c), True, *map(float, v)) for c, v in zip(k, x)]
        shapes.append((scan, *shape))
    df = spark.createDataFrame(rows, "scan_id string, x int, y int, z int, in_mask boolean, wm0 double, gm double, csf double").repartition(5)
    sizes = spark.createDataFrame(shapes, "scan_id string, nx int, ny int, nz int")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("levels"))
    spark.sparkContext.setJobGroup("levels", "all")
    found = decon.fit_levels(df, ["wm0", "gm", "csf"], sizes, o)
    together = jobs()
    decon.fit_levels(df.where("scan_id = 'b'"), ["wm0", "gm", "csf"], sizes, o)
    spark.sparkContext.setJobGroup("rest", "rest")
    assert together <= 1.5 * (jobs() - together) + 20  # as many passes as the slowest scan needs, not three times as many
    for scan, (target, balance, f, k) in alone.items():
        assert found[scan].target == pytest.approx(target) and found[scan].balance == pytest.approx(balance, rel=1e-6)
        out = {(r.x, r.y, r.z): r.field for r in decon.normalise(df, ["wm0", "gm", "csf"], sizes, o, found).where(F.col("scan_id") == scan).collect()}
        assert [out[tuple(c)] for c in k] == pytest.approx(list(f), rel=1e-6)
    with pytest.raises(ValueError, match="c: "):
        decon.fit_levels(df.withColumn("gm", F.when(F.col("scan_id") == "c", 0.0).otherwise(F.col("gm"))).withColumn("csf", F.when(F.col("scan_id") == "c", 0.0).otherwise(F.col("csf"))).withColumn("wm0", F.when(F.col("scan_id") == "c", -1.0).otherwise(F.col("wm0"))), ["wm0", "gm", "csf"], sizes, o)


def test_scans_selected_together_are_as_if_alone(spark):
    scan = fibre_scan(spark, 6)
    groups = N.shells(list(scan.bvals))
    o = tissue.StagedOptions(erosions=1, wm_percent=20, gm_percent=20, csf_percent=20)
    one, dti = scan.voxels.persist(), scan.tensor
    more, also = [one], [dti]
    for k, (name, cut) in enumerate((("bright", "x < 6"), ("small", "x < 5"))):
        rename = lambda df: df.where(cut).withColumn("scan_id", F.lit(name))  # noqa: B023, E731
        more.append(rename(one).withColumn("signal", F.transform("signal", lambda v: v * F.lit(2.0 + k)).cast(dict(one.dtypes)["signal"])))  # noqa: B023
        also.append(rename(dti))
    every, dtis = more[0].union(more[1]).union(more[2]), also[0].union(also[1]).union(also[2])
    got = tissue.select_staged(every, dtis, groups, o)
    assert len(got.by_scan) == 3 and got.by_scan["bright"] == got.by_scan[one.first().scan_id]  # gain doesn't matter
    for v, d in [(more[2], also[2])]:
        alone = tissue.select_staged(v, d, groups, o)
        name = v.first().scan_id
        assert got.by_scan[name] == alone.counts
        for kind in ("wm", "gm", "csf"):
            keys = lambda s: sorted((r.x, r.y, r.z) for r in getattr(s, kind).where(F.col("scan_id") == name).collect())  # noqa: B023, E731
            assert keys(got) == keys(alone)


def test_staged_selection_caps_the_metric_and_names_empty_stages(spark):
    scan = fibre_scan(spark, 6)
    groups = N.shells(list(scan.bvals))
    s = tissue.select_staged(scan.voxels, scan.tensor, groups, tissue.StagedOptions(erosions=1, wm_percent=20, gm_percent=20, csf_percent=20))
    assert s.counts["safe"] == 64 and all(s.counts.values())
    assert {r.z for r in s.wm.collect()} == {1} and {r.z for r in s.csf.collect()} == {4}
    with pytest.raises(ValueError, match="eroded"):
        tissue.select_staged(scan.voxels, scan.tensor, groups, tissue.StagedOptions(erosions=3))
    with pytest.raises(ValueError, match="round to none"):
        tissue.select_staged(scan.voxels, scan.tensor, groups, tissue.StagedOptions(erosions=1))
    v = spark.createDataFrame([("s", 0, 0, 0, True, [100.0, 120.0]), ("s", 1, 0, 0, True, [100.0, 1e-4])], VOXEL)
    m = {r.x: r.m for r in v.select("x", tissue.decay_metric([(0.0, [0]), (1000.0, [1])]).alias("m")).collect()}
    assert np.isnan(m[0]) and m[1] > 10  # growth isn't decay; the selection lowers the other to its cap


def test_a_set_without_positive_rows_keeps_its_scale(spark):
    r = spark.createDataFrame([("a", "gm", 0, 0.0, [2.0]), ("b", "gm", 0, 0.0, [4.0]), ("c", "gm", 0, 0.0, [-1.0])], "scan_id string, tissue string, row int, b double, coeffs array<double>")
    assert {x.scan_id: x.multiplier for x in tissue.multipliers(r).collect()}["c"] == 1


def test_response_pool_is_exact_for_scaled_copies(spark):
    rows = [(f"s{k}", "wm", i, 1000.0 * i, [c * f, -0.5 * c * f]) for k, f in enumerate((1.0, 2.0, 4.0)) for i, c in enumerate((3.0, 2.0))]
    r = spark.createDataFrame(rows, "scan_id string, tissue string, row int, b double, coeffs array<double>")
    pooled, off = pipelines.group_responses(r)
    assert off.agg(F.max("percent")).first()[0] < 1e-9
    assert pooled.count() == 2 and tissue.response_faults(r).count() == 3
    ragged = r.union(spark.createDataFrame([("s9", "wm", 0, 0.0, [1.0])], r.schema))
    with pytest.raises(ValueError):
        pipelines.group_responses(ragged)


def test_files_round_trip(spark, tmp_path):
    a = np.diag([2.0, 2.0, 2.5, 1.0])
    data = np.random.default_rng(0).uniform(100, 200, (3, 4, 2, 5)).astype(np.float32)
    sinks.write_file(str(tmp_path / "in" / "one.nii.gz"), nifti.encode(data, a))
    with pytest.raises(FileExistsError):
        sinks.write_file(str(tmp_path / "in" / "one.nii.gz"), b"")
    (tmp_path / "b").write_text("0 1000 1000 2000 2000")
    (tmp_path / "v").write_text("0 1 0 0 1\n0 0 1 0 0\n0 0 0 1 0\n")
    scan = Scan.from_files(spark, str(tmp_path / "in"), str(tmp_path / "b"), str(tmp_path / "v"))
    got = {(r.x, r.y, r.z): r.signal for r in scan.voxels.collect()}
    assert len(got) == 24 and got[2, 3, 1] == data[2, 3, 1].tolist() and scan.voxel_mm == (2.0, 2.0, 2.5)
    sinks.write_image(scan.voxels.withColumn("v", F.get("signal", F.lit(1))), "v", scan.shape, a, str(tmp_path / "out"))
    assert np.array_equal(nifti.decode((tmp_path / "out.nii.gz").read_bytes()).data, data[..., 1])
    sinks.write_bundle({"voxel": scan.voxels}, str(tmp_path / "bundle"), {"kind": "test"})
    assert sinks.read_header(spark, str(tmp_path / "bundle")) == {"kind": "test"}
    sinks.report_tsv(scan.report(coherence=False), str(tmp_path / "report"))
    assert "n/a" in next((tmp_path / "report").glob("*.csv")).read_text()
    assert json.dumps(sinks.data_dictionary("q_"))
    rows = np.array([[1.0, -0.5], [0.25, 0.125]])
    assert np.array_equal(text.parse_response(text.format_response(rows, "made here")), rows)
    for bad in ("", "1 2\n3", "1 x"):
        with pytest.raises(ValueError):
            text.parse_response(bad)
    b, g = text.parse_table("1 0 0 1000 # first\n0,1,0,2000")
    assert b.tolist() == [1000, 2000] and g[1].tolist() == [0, 1, 0]


def test_stream_of_scans(spark, tmp_path):
    from lumivox.streaming.ingest import watch

    scan = fibre_scan(spark, 3)
    scan.voxels.write.parquet(str(tmp_path / "in"))
    q = watch(spark, str(tmp_path / "in"), scan.gradient, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_order_of_exchange_is_the_basis_of_exchange():
    """Blocks of cosines from l down to 1, the zonal term and sines from 1 up to l, all with the phase, sines turned about."""
    rng = np.random.default_rng(4)
    d = rng.normal(size=(9, 3))
    d /= np.linalg.norm(d, axis=1)[:, None]
    _, azimuth, polar = N.sphere_angles(d)
    ours, order = N.sh_matrix(d, 4), 4
    places, at = fits.exchange(order), 0
    for n in range(order + 1):
        for l in range(0, n + 1, 2):
            p = [np.sqrt((2 * l + 1) / (4 * np.pi) * N.factorial(l - k) / N.factorial(l + k)) * N.legendre(l, k, np.cos(polar)) for k in range(l + 1)]
            theirs = [np.sqrt(2) * p[k] * np.cos(k * azimuth) for k in range(l, 0, -1)] + [p[0]] + [(-1) ** (k + 1) * np.sqrt(2) * p[k] * np.sin(k * azimuth) for k in range(1, l + 1)]
            for o, want in enumerate(theirs):
                k, sign = places[at + o]
                assert sign * ours[:, N.sh_index(l, k - at - l)] == pytest.approx(want)
            at += 2 * l + 1
    assert at == len(places) == len(N.shore_indices(order))


def test_fits_are_saved_and_loaded(spark, tmp_path):
    scan = fibre_scan(spark, 3)
    o = models.ShoreOptions(order=4, regularisation="l2")
    fit = models.fit_shore(scan.voxels, scan.bvals, scan.directions, o=o)
    scan.save_fit(fit, str(tmp_path / "fit"), o)
    with pytest.raises(Exception):
        scan.save_fit(fit, str(tmp_path / "fit"), o)
    rows, header, b, g = fits.load_fit(spark, str(tmp_path / "fit"))
    want = {(r.x, r.y, r.z): r.coef for r in fit.collect()}
    assert {(r.x, r.y, r.z): r.coef for r in rows.collect()} == want and header["radial_order"] == 4 and header["solver"]["kind"] == "tikhonov"
    assert b == pytest.approx(scan.bvals) and g == pytest.approx(scan.directions)
    path = str(tmp_path / "scan.nii.gz")
    fits.write_coefficients(fit, path, o, scan.shape, scan.affine, {"note": 1})
    back, side = fits.read_coefficients(spark, path)
    for r in back.collect():
        assert r.coef == pytest.approx(want[r.x, r.y, r.z])
    assert back.count() == 27 and side["note"] == 1 and side["n_coeffs"] == len(N.shore_indices(4))
    fits.write_result("shore", fits.shore_tables(fit, o), str(tmp_path / "bundle"), {"provenance": fits.Provenance("t", "full").finish(spark)})
    assert sinks.read_header(spark, str(tmp_path / "bundle"))["content"]["odf"] == ["sh"]
    with pytest.raises(ValueError, match="lacks"):
        fits.write_result("shore", {"coefficients": fit}, str(tmp_path / "other"), {})
    assert fits.bids_sidecar("shore", o, ["a"])["Model"]["Parameters"]["order"] == 4 and fits.Provenance("t", "none").finish(spark) is None
    fits.write_directory(str(tmp_path / "whole"), lambda f: open(f"{f}/a", "w").close())
    with pytest.raises(RuntimeError):
        fits.write_directory(str(tmp_path / "half"), lambda f: (_ for _ in ()).throw(RuntimeError()))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bundle", "fit", "scan.json", "scan.nii.gz", "whole"]


def test_gradient_deviation_from_files_and_jobs(spark, tmp_path):
    scan = fibre_scan(spark, 3)
    data = np.zeros((3, 3, 3, len(scan.bvals)), np.float32)
    for r in scan.voxels.collect():
        data[r.x, r.y, r.z] = r.signal
    dev = np.zeros((3, 3, 3, 9), np.float32)
    dev[0, 0, 0] = [0.02, 0, 0, 0.01, -0.02, 0, 0, 0, 0]
    for folder, image in (("s", data), ("g", dev), ("i", dev + np.eye(3).ravel()), ("bad", dev[:2])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.nii.gz").write_bytes(nifti.encode(image, np.eye(4)))
    at = lambda f: str(tmp_path / f / "a.nii.gz")
    for f in ("g", "i"):
        got = {(r.x, r.y, r.z): r.graddev for r in nifti.with_graddev(nifti.read_voxels(spark, at("s")), at("s"), at(f)).collect()}
        assert got[0, 0, 0] == pytest.approx([1.02, 0, 0, 0.01, 0.98, 0, 0, 0, 1]) and got[1, 1, 1] == pytest.approx(np.eye(3).ravel())
    with pytest.raises(ValueError, match="grid"):
        nifti.with_graddev(nifti.read_voxels(spark, at("s")), at("s"), at("bad"))
    meta = nifti.read_scans(spark, at("s")).first()
    assert (meta.nx, meta.ny, meta.nz, meta.n_vol) == (3, 3, 3, len(scan.bvals))
    (tmp_path / "b").write_text(" ".join(map(str, scan.bvals)))
    (tmp_path / "v").write_text("\n".join(" ".join(map(str, r)) for r in scan.directions.T))
    common = ["--series", at("s"), "--bvals", str(tmp_path / "b"), "--bvecs", str(tmp_path / "v")]
    jobs.run(spark, jobs.arguments(["shore", *common, "--out", str(tmp_path / "shore"), "--order", "4", "--regularisation", "l2"]))
    assert fits.load_fit(spark, str(tmp_path / "shore"))[0].count() == 27
    jobs.run(spark, jobs.arguments(["qc", *common, "--out", str(tmp_path / "qc"), "--no-coherence"]))
    assert json.loads(next((tmp_path / "qc" / "report").glob("*.json")).read_text().splitlines()[0])["metrics"]["max_b"] == 3000
    jobs.run(spark, jobs.arguments(["tensor", *common, "--graddev", at("g"), "--out", str(tmp_path / "dti")]))
    assert spark.read.parquet(str(tmp_path / "dti")).count() == 27


def test_series_read_by_byte_ranges_equals_whole_files(spark, tmp_path):
    import gzip
    import struct

    from lumivox.sources import series

    rng = np.random.default_rng(4)
    a = np.diag([2.0, 2.0, 3.0, 1.0])
    data = rng.normal(size=(5, 4, 3, 6)).astype(np.float32)
    inside = (rng.random((5, 4, 3)) > 0.4).astype(np.float32)
    for folder in ("s", "m"):
        (tmp_path / folder).mkdir()
    packed = nifti.encode(data, a)
    raw = bytearray(gzip.decompress(nifti.encode(np.zeros((5, 4, 3, 6), np.float32), a))[:352])
    struct.pack_into("<2h", raw, 70, 4, 16)  # whole numbers with a scale
    struct.pack_into("<2f", raw, 112, 0.5, 3.0)
    (tmp_path / "s" / "packed.nii.gz").write_bytes(packed)
    (tmp_path / "s" / "plain.nii").write_bytes(gzip.decompress(packed))
    (tmp_path / "s" / "scaled.nii").write_bytes(bytes(raw) + rng.integers(-99, 99, data.size).astype("<i2").tobytes())
    (tmp_path / "m" / "packed.nii.gz").write_bytes(nifti.encode(inside, a))
    (tmp_path / "m" / "plain.nii").write_bytes(gzip.decompress(nifti.encode(inside, a)))
    key = lambda r: (r.scan_id, r.x, r.y, r.z)
    rows = lambda df: sorted(map(tuple, df.collect()))
    at = str(tmp_path / "s")
    for block_bytes in (1, 700, 1 << 20):  # a row, some rows, everything
        got = series.read_series(spark, at, block_bytes=block_bytes)
        assert rows(got) == rows(nifti.read_voxels(spark, at)) and got.schema == nifti.read_voxels(spark, at).schema
    names = {r.scan_id: r.n for r in series.read_series(spark, at, str(tmp_path / "m"), 700).where("in_mask").groupBy("scan_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert names == {"packed": int(inside.sum()), "plain": int(inside.sum()), "scaled": inside.size}
    got = {key(r): r.in_mask for r in series.read_series(spark, at, str(tmp_path / "m"), 700).collect()}
    assert all(got[s, x, y, z] == (inside[x, y, z] > 0) for s in ("packed", "plain") for x, y, z in np.ndindex(5, 4, 3))
    # a task holds its range alone
    of = series.layout(f"{at}/plain.nii")
    part = series.Rows(of, 2, 4, None, 2)
    (batch,) = series.voxels(part)
    assert batch.num_rows == 10 and {tuple(r) for r in zip(batch["y"].to_pylist(), batch["z"].to_pylist())} == {(2, 0), (3, 0)}
    assert len(series.SeriesReader({"path": at, "blockbytes": "700"}, False).partitions()) == sum(-(-12 // series.layout(f"{at}/{n}.nii").rows_of(700)) for n in ("plain", "scaled"))
    (tmp_path / "s" / "plain.nii").write_bytes(gzip.decompress(packed)[:-10])
    with pytest.raises(Exception, match="too early"):
        series.read_series(spark, at, block_bytes=700).collect()
    with pytest.raises(FileNotFoundError):
        series.read_series(spark, str(tmp_path / "none"))


def test_jobs_from_files_to_bundles(spark, tmp_path):
    scan = fibre_scan(spark, 6)
    data = np.zeros((6, 6, 6, len(scan.bvals)), np.float32)
    for r in scan.voxels.collect():
        data[r.x, r.y, r.z] = r.signal
    one = np.flatnonzero(np.isin(scan.bvals, (0, 3000)))

    def files_of(name, volumes):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.nii.gz").write_bytes(nifti.encode(data[..., volumes], np.eye(4)))
        (tmp_path / name / "b").write_text(" ".join(map(str, scan.bvals[volumes])))
        (tmp_path / name / "v").write_text("\n".join(" ".join(map(str, r)) for r in scan.directions[volumes].T))
        return ["--series", str(tmp_path / name / "a.nii.gz"), "--bvals", str(tmp_path / name / "b"), "--bvecs", str(tmp_path / name / "v")]

    every, single = files_of("every", np.arange(len(scan.bvals))), files_of("single", one)
    out = lambda name: str(tmp_path / "out" / name)
    job = lambda *argv: jobs.run(spark, jobs.arguments(list(argv)))
    few = ["--erosions", "1", "--wm-percent", "20", "--gm-percent", "20", "--csf-percent", "20", "--lmax", "4"]
    job("response", *every, *few, "--out", out("dense-rows"))
    got = fits.load_responses(spark, out("dense-rows"))
    first = {t: r[0, 0] / decon.SQRT4PI for t, r in got.items()}
    assert first == pytest.approx({"wm": 1.0, "gm": 1.3, "csf": 2.6}, rel=0.01) and got["wm"].shape == (63, 3)
    assert fits.load_responses(spark, out("dense-rows"), 2)["wm"].shape == (63, 2)
    shells = {t: r[[0, 60]] for t, r in got.items()}  # rows of b 0 and 3000
    sinks.write_bundle({"responses": fits.response_rows(spark, shells, bs=[0.0, 3000.0])}, out("shell-rows"), {"kind": "responses"})
    job("responses", "--bundles", out("dense-rows"), out("dense-rows"), "--out", out("pooled"))
    assert fits.load_responses(spark, out("pooled"))["csf"] == pytest.approx(got["csf"])
    (tmp_path / "ref").mkdir()
    (tmp_path / "ref" / "a.nii.gz").write_bytes(nifti.encode((np.indices((6, 6, 6))[2] >= 4).astype(np.float32), np.eye(4)))
    job("dense", *every, "--responses", out("pooled"), "--lmax", "4", "--reference-mask", str(tmp_path / "ref" / "a.nii.gz"), "--out", out("dense"))
    header = sinks.read_header(spark, out("dense"))
    assert header["details"]["reference_b0_source"] == "user mask" and header["details"]["reference_b0"] == pytest.approx(2600, rel=0.05)
    assert header["kind"] == "dense" and header["provenance"]["tool"] == "dense"
    job("single-shell", *single, "--responses", out("shell-rows"), "--lmax", "4", "--out", out("shell"))
    rows = sinks.read_table(spark, out("shell"), "tissue")
    assert rows.count() == 216
    job("normalise", "--bundle", out("shell"), "--order", "1", "--target", "1.0", "--out", out("level"))
    level = sinks.read_table(spark, out("level"), "tissue")
    assert level.count() == 216 and sinks.read_header(spark, out("level"))["levels"]["a"]["target"] == 1.0
    job("shore", *every, "--order", "4", "--regularisation", "l2", "--out", out("fit"))
    job("odf", "--fit", out("fit"), "--out", out("odf"))
    assert sinks.read_table(spark, out("odf"), "scalars").columns[-1] and sinks.read_table(spark, out("odf"), "odf").count() == 216
    job("synth", "--fit", out("fit"), "--bvals", str(tmp_path / "single" / "b"), "--bvecs", str(tmp_path / "single" / "v"), "--out", out("signal"))
    back = {(r.x, r.y, r.z): r.signal for r in sinks.read_table(spark, out("signal"), "voxels").collect()}
    assert np.array(back[2, 2, 2]) == pytest.approx(data[2, 2, 2, one] / 1300, abs=0.08) or np.array(back[2, 2, 2]) == pytest.approx(data[2, 2, 2, one], rel=0.2)
    with pytest.raises(FileExistsError):
        job("odf", "--fit", out("fit"), "--out", out("odf"))
    job("odf", "--fit", out("fit"), "--out", out("odf"), "--overwrite")
    assert len([p for p in (tmp_path / "out" / "odf").iterdir() if p.name.startswith("version-")]) == 1


def test_a_broken_overwrite_leaves_the_old_bundle(spark, tmp_path):
    path = str(tmp_path / "bundle")
    sinks.write_bundle({"t": spark.range(3)}, path, {"n": 3})
    bad = spark.range(5).select(F.raise_error(F.lit("broken")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_bundle({"t": spark.range(9), "u": bad}, path, {"n": 9}, overwrite=True)
    assert sinks.read_header(spark, path) == {"n": 3} and sinks.read_table(spark, path, "t").count() == 3
    sinks.write_bundle({"t": spark.range(4)}, path, {"n": 4}, overwrite=True)
    assert sinks.read_header(spark, path) == {"n": 4} and sinks.read_table(spark, path, "t").count() == 4
    (tmp_path / "bundle" / "header.json").rename(next((tmp_path / "bundle").glob("version-*")) / "header-before")  # broken between the two renames
    assert sinks.read_table(spark, path, "t").count() == 4
