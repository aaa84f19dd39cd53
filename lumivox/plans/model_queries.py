"""Queries of the fits, responses and deconvolution over the virtual scan; registered beside plans.queries."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.functions import numeric as N
from lumivox.functions.storage import scratch_folder
from lumivox.operators import decon, dense, models, qc, tissue
from lumivox.operators import voxel as V
from lumivox.plans import pipelines
from lumivox.plans import virtual_scan as S
from lumivox.plans.queries import query, r6
from lumivox.sinks import fits

BVALS, DIRS = S.gradient_arrays()
GROUPS = N.shells(list(BVALS))
SHORE = models.ShoreOptions(order=4, regularisation="l2", lambda_n=1e-3, lambda_l=1e-3)
ONE_SHELL = np.flatnonzero((BVALS == 0) | (BVALS == 2000))
XYZ = ["x", "y", "z"]


def selection(v: DataFrame) -> tissue.Selection:
    """Tissue by label, as the virtual scan has no anatomy."""
    return tissue.Selection(*(v.where(F.col("label") == k).select(*V.KEY) for k in (3, 5, 8)))


def shape(v: DataFrame) -> tuple[int, int, int]:
    return 10, 10, v.agg(F.max("z")).first()[0] + 1


def one_shell(v: DataFrame) -> DataFrame:
    return v.withColumn("signal", F.array(*[F.get("signal", F.lit(int(k))) for k in ONE_SHELL]))


def _coefs(spark, d) -> DataFrame:
    """Coefficients of order 5 made from the embedding: 1 first, the rest scaled down."""
    n = len(N.shore_indices(5))
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    i = F.col("vec_id")
    c = F.concat(F.array(F.lit(1.0)), F.transform(F.slice("embedding", 2, n - 1), lambda x: x.cast("double") * 0.1))
    return e.select(F.lit(S.SCAN).alias("scan_id"), (i % 10).cast("int").alias("x"), (F.floor(i / 10) % 10).cast("int").alias("y"), F.floor(i / 100).cast("int").alias("z"), c.alias("coef"))


def _dot(w: np.ndarray) -> str:
    return " + ".join(f"c[{k + 1}] * {float(v)!r}::DOUBLE" for k, v in enumerate(w) if v)


_W = N.scalar_weights(5, 700.0)


@query(f""", k AS (SELECT CAST(vec_id % 10 AS INTEGER) AS x, CAST(vec_id // 10 % 10 AS INTEGER) AS y, CAST(vec_id // 100 AS INTEGER) AS z, list_concat([1.0::DOUBLE], list_transform(embedding[2:44], lambda e: CAST(e AS DOUBLE) * 0.1::DOUBLE)) AS c FROM embeddings),
m AS (SELECT x, y, z, {_dot(_W['e0'])} AS e0, {_dot(_W['rtop'])} AS rtop, {_dot(_W['msd'])} AS msd, list_sum(list_transform(c, lambda e: e * e)) AS energy FROM k)
SELECT x, y, z, round(greatest(rtop / e0, 0) * 1e-9::DOUBLE, 6) AS rtop, round(greatest(msd / e0, 0) * 1e6::DOUBLE, 6) AS msd, round(sqrt(greatest(1 - 1 / energy, 0)), 6) AS ng FROM m""")
def propagator_scalars(spark, d):
    return models.propagator_scalars(_coefs(spark, d), models.ShoreOptions(order=5)).select(*XYZ, *r6("rtop", "msd", "ng"))


@query(""" SELECT CAST(vec_id % 10 AS INTEGER) AS x, CAST(vec_id // 10 % 10 AS INTEGER) AS y, CAST(vec_id // 100 AS INTEGER) AS z, 3 AS radial_order, list_sum(list_transform(range(14), lambda k: (k + 1) * CASE WHEN k = 0 THEN 1 ELSE round(embedding[k + 1]::DOUBLE * 0.1::DOUBLE, 6) END))::DECIMAL(18, 4)::DOUBLE AS check_sum FROM embeddings""")
def fit_round_trip(spark, d):
    """Coefficients written in the order of exchange and read back in ours: each counts by its place, so none may have moved."""
    o = models.ShoreOptions(order=3, regularisation="l2")
    c = F.transform(F.slice(F.col("coef"), 1, len(N.shore_indices(3))), lambda x: F.round(x, 6))
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    fits.save_fit(_coefs(spark, d).withColumn("coef", c), path, o, np.eye(4), (10, 10, 5), BVALS, DIRS)
    rows, header, *_ = fits.load_fit(spark, path)
    total = F.aggregate(F.transform("coef", lambda x, k: (k + 1) * x), F.lit(0.0), lambda a, x: a + x)
    return rows.select(*XYZ, F.lit(header["radial_order"]).alias("radial_order"), total.cast("decimal(18,4)").cast("double").alias("check_sum"))


_AXIS = [0.0, 0.6, 0.8]
_ALONG = N.sh_matrix(np.array([_AXIS]), 4)[0][[N.sh_index(l, m) for _, l, m in N.shore_indices(5)]]


@query(f""", k AS (SELECT CAST(vec_id % 10 AS INTEGER) AS x, CAST(vec_id // 10 % 10 AS INTEGER) AS y, CAST(vec_id // 100 AS INTEGER) AS z, list_concat([1.0::DOUBLE], list_transform(embedding[2:44], lambda e: CAST(e AS DOUBLE) * 0.1::DOUBLE)) AS c FROM embeddings),
m AS (SELECT x, y, z, {_dot(_W['e0'])} AS e0, {_dot(_W['q2'])} AS q2, {_dot(_ALONG * N.axis_weights(5, 700.0, False))} AS a, {_dot(_ALONG * N.axis_weights(5, 700.0, True))} AS p FROM k)
SELECT x, y, z, round(CASE WHEN q2 / e0 > 0 THEN e0 / q2 * {models.MICRO['qiv']!r}::DOUBLE ELSE 'nan'::DOUBLE END, 6) AS qiv, round(greatest(a / e0, 0) * {models.MICRO['rtap']!r}::DOUBLE, 6) AS rtap, round(greatest(p / e0, 0) * {models.MICRO['rtpp']!r}::DOUBLE, 6) AS rtpp FROM m""")
def axis_probabilities(spark, d):
    c = _coefs(spark, d).withColumn("axis", F.array(*map(F.lit, _AXIS)))
    return models.propagator_scalars(c, models.ShoreOptions(order=5), axis="axis").select(*XYZ, *r6("qiv", "rtap", "rtpp"))


@query()
def robust_tensor(spark, d):
    return models.fit_tensor(S.voxels(spark, d), BVALS, DIRS).select(*XYZ, *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("s0", "fa", "md", "outlier_fraction")], "iterations", "converged")


def _graddev(v: DataFrame) -> DataFrame:
    t = F.array(*[F.lit(x) for x in (1.02, 0.0, 0.0, 0.01, 0.98, 0.0, 0.0, 0.0, 1.0)])
    return v.withColumn("graddev", F.when(F.col("label") % 2 == 0, F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])).otherwise(t))


@query()
def robust_tensor_graddev(spark, d):
    return models.fit_tensor_graddev(_graddev(S.voxels(spark, d)), BVALS, DIRS).select(*XYZ, *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("fa", "md")])


@query(""" SELECT x, y, z, vol, round(CASE WHEN bval > 50 AND label % 2 = 1 THEN bval * ((1.02 * gx + 0.01 * gy) ** 2 + (0.98 * gy) ** 2 + gz ** 2) ELSE bval * 1.0::DOUBLE END, 3) AS b_eff FROM (SELECT DISTINCT x, y, z, label FROM long), g""")
def effective_b(spark, d):
    return decon.graddev_table(_graddev(S.voxels(spark, d)), BVALS, DIRS).select(*XYZ, "vol", F.round("b_eff", 3).alias("b_eff"))


@query()
def shore_l2(spark, d):
    return models.fit_shore(S.voxels(spark, d), BVALS, DIRS, o=SHORE).select(*XYZ, "reg_kind", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("r2", "residual_l2")])


@query()
def shore_l1_anchored(spark, d):
    f = models.fit_shore(S.voxels(spark, d), BVALS, DIRS, o=models.with_options(SHORE, regularisation="l1", eps=1e-4))
    return f.select(*XYZ, "reg_kind", "iterations", F.round(F.col("r2").cast("double"), 3).alias("r2"), (F.round(V.sparsity(F.col("coef")), 3)).alias("share"))


@query()
def shore_l1_bic(spark, d):
    f = models.fit_shore(S.voxels(spark, d), BVALS, DIRS, o=models.with_options(SHORE, regularisation="l1", strategy="bic", eps=1e-3))
    return models.alpha_spread(f.withColumn("alpha", F.col("alpha").cast("double"))).select("scan_id", *[F.round(c, 2).alias(c) for c in ("median", "p10", "p90")])


@query()
def shore_nonneg(spark, d):
    return models.fit_shore(S.voxels(spark, d), BVALS, DIRS, o=models.with_options(SHORE, regularisation="nonneg")).select(*XYZ, "reg_kind", F.round(F.col("r2").cast("double"), 3).alias("r2"))


@query()
def synthesis(spark, d):
    f = models.fit_shore(S.voxels(spark, d), BVALS, DIRS, o=SHORE)
    return models.synthesize(f, BVALS, DIRS, o=SHORE).select(*XYZ, F.round(F.get("signal", F.lit(1)).cast("double"), 2).alias("s1"))


@query()
def odf_peaks(spark, d):
    p = models.peaks(models.odf(models.fit_shore(S.voxels(spark, d), BVALS, DIRS, o=SHORE), SHORE), 4)
    return p.select(*XYZ, F.round("gfa", 4).alias("gfa"), F.size("fixels").alias("n_peaks"))


@query()
def fixel_amplitudes(spark, d):
    p = models.peaks(models.odf(models.fit_shore(S.voxels(spark, d), BVALS, DIRS, o=SHORE), SHORE), 4)
    return models.amplitude_floor(p, fraction=0.5).select(*XYZ, "idx", F.round("amplitude", 2).alias("amplitude"))


@query()
def fitted_coherence(spark, d):
    """The whole chain from signals to the report's direction columns."""
    dti = models.fit_tensor(S.voxels(spark, d), BVALS, DIRS)
    return qc.fixel_coherence(dti).select("scan_id", F.round("coherence", 5).alias("coherence"), "n_evaluated", "n_connected")


_SHELL_SQL = ", ".join(f"avg(greatest(s, 0)) FILTER (vol IN ({', '.join(map(str, v))})) AS m{k}" for k, (_, v) in enumerate(GROUPS))


@query(f", m AS (SELECT x, y, z, {_SHELL_SQL} FROM long GROUP BY ALL) SELECT x, y, z, round(({' + '.join(f'{len(v)} * ln(m0 / m{k})' for k, (b, v) in enumerate(GROUPS) if b > 0)}) / {sum(len(v) for b, v in GROUPS if b > 0)}, 6) AS sdm FROM m")
def decay_metric(spark, d):
    return S.voxels(spark, d).select(*XYZ, F.round(tissue.decay_metric(GROUPS), 6).alias("sdm"))


@query()
def staged_selection(spark, d):
    v = S.voxels(spark, d)
    s = tissue.select_staged(v, models.fit_tensor(v, BVALS, DIRS), GROUPS, tissue.StagedOptions(erosions=1, fa=0.05, wm_percent=20, gm_percent=20, csf_percent=50))
    return spark.createDataFrame(list(s.counts.items()), "stage string, voxels long")


@query()
def threshold_classes(spark, d):
    return tissue.classify_by_threshold(models.fit_tensor(S.voxels(spark, d), BVALS, DIRS), fa=0.1, dominance=1.05).groupBy("tissue").count()


_ROW_SQL = " ".join(f"WHEN vol IN ({', '.join(map(str, v))}) THEN {k}" for k, (_, v) in enumerate(GROUPS))


@query(f'SELECT CAST(label AS VARCHAR) AS scan_id, CAST(CASE {_ROW_SQL} END AS INTEGER) AS "row", round(avg(s) * sqrt(4 * pi()), 4) AS c FROM long GROUP BY 1, 2')
def isotropic_response(spark, d):
    v = S.voxels(spark, d).withColumn("scan_id", F.col("label").cast("string"))
    return tissue.isotropic_response(v, GROUPS, "gm").select("scan_id", "row", F.round(F.get("coeffs", F.lit(0)), 4).alias("c"))


@query()
def wm_response(spark, d):
    v = S.voxels(spark, d)
    own = v.where("label = 3").join(models.fit_tensor(v, BVALS, DIRS).select(*V.KEY, "principal_dir"), V.KEY)
    return tissue.wm_response(own, GROUPS, DIRS, 4).select("row", "b", F.transform("coeffs", lambda c: F.round(c, 2)).alias("coeffs"))


def _labelled(spark, d) -> DataFrame:
    """Voxels with their label as the tissue."""
    return S.voxels(spark, d).select("scan_id", F.col("label").cast("string").alias("tissue"), "signal")


#: All labels over the upper median of label 3's unweighted signal, in one scan.
_LEVEL_SQL = """, b0 AS (SELECT x, y, z, label, avg(s) AS b0 FROM long WHERE vol % 8 = 0 GROUP BY ALL),
ref AS (SELECT b0 AS ref FROM (SELECT b0, row_number() OVER (ORDER BY b0) AS k, count(*) OVER () AS n FROM b0 WHERE label = 3) WHERE k = n // 2 + 1),
lev AS (SELECT label, avg(b0) / any_value(ref) AS level FROM b0, ref WHERE b0 > 0 GROUP BY 1)"""


@query(_LEVEL_SQL + """ SELECT CAST(label AS VARCHAR) AS tissue, round(ref, 6) AS reference, round(level, 6) AS level FROM lev, ref""")
def tissue_levels(spark, d):
    return dense.levels(_labelled(spark, d), BVALS, "3").select("tissue", *r6("reference", "level"))


@query(_LEVEL_SQL + """, p AS (SELECT label, g.bval AS b, s / ref AS y FROM long JOIN b0 USING (x, y, z, label) JOIN g USING (vol), ref WHERE b0 > 0 AND g.bval > 50),
k AS (SELECT label, i AS "row", sum(exp(-((b - i * 50) ** 2) / 45000.0::DOUBLE) * y) AS wy, sum(exp(-((b - i * 50) ** 2) / 45000.0::DOUBLE)) AS w, count(*) / 63.0::DOUBLE AS mean FROM p, range(63) t(i) GROUP BY 1, 2),
f AS (SELECT label, "row", last_value(CASE WHEN "row" <= 1 THEN level WHEN w >= CASE WHEN label = 3 THEN 0.05 * mean ELSE 1e-12 END THEN wy / w END IGNORE NULLS) OVER (PARTITION BY label ORDER BY "row") AS m FROM k JOIN lev USING (label))
SELECT CAST(label AS VARCHAR) AS tissue, CAST("row" AS INTEGER) AS "row", "row" * 50.0::DOUBLE AS b, round(m * sqrt(4 * pi()), 6) AS c FROM f""")
def kernel_rows(spark, d):
    r = dense.responses(_labelled(spark, d), BVALS, DIRS, "kernel", lmax=0, reference="3")
    return r.select("tissue", "row", "b", F.round(F.get("coeffs", F.lit(0)), 6).alias("c"))


@query(_LEVEL_SQL + """, p AS (SELECT label, vol, count(*) AS n, round(sum(s / b0 * level * (b0 / ref) * (b0 / ref)) / sum((b0 / ref) * (b0 / ref)), 6) AS y FROM long JOIN b0 USING (x, y, z, label) JOIN lev USING (label), ref WHERE b0 > 0 AND vol % 8 <> 0 GROUP BY 1, 2)
SELECT CAST(label AS VARCHAR) AS tissue, g.bval AS b, sum(n)::BIGINT AS samples, round(avg(y), 4) AS y FROM p JOIN g USING (vol) GROUP BY 1, 2""")
def shape_samples(spark, d):
    own = _labelled(spark, d)
    s = dense.shapes(dense.pooled_samples(own, dense.levels(own, BVALS, "3"), BVALS, DIRS))
    # voxels of a label differ, volumes of a shell don't, in how many there are: so the mean over volumes is the weighted mean
    return s.groupBy("tissue", "b").agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum(F.col("w") * F.col("y")) / F.sum("w"), 4).alias("y"))


def _scan_responses(spark, d) -> DataFrame:
    """A response set for each label, each label being a scan."""
    v = S.voxels(spark, d).withColumn("scan_id", F.col("label").cast("string"))
    r = tissue.isotropic_response(v, GROUPS, "gm")
    return r.withColumn("coeffs", F.array(F.get("coeffs", F.lit(0)), F.get("coeffs", F.lit(0)) * -0.5))


_SCANS_SQL = f""", r AS (SELECT CAST(label AS VARCHAR) AS scan_id, CAST(CASE {_ROW_SQL} END AS INTEGER) AS "row", avg(s) * sqrt(4 * pi()) AS c FROM long GROUP BY 1, 2),
m AS (SELECT scan_id, exp(avg(ln(a / c))) AS f FROM r JOIN (SELECT "row", avg(c) AS a FROM r GROUP BY 1) USING ("row") GROUP BY 1)
"""


@query(_SCANS_SQL + "SELECT scan_id, round(f, 6) AS multiplier FROM m")
def response_multipliers(spark, d):
    return tissue.multipliers(_scan_responses(spark, d)).select("scan_id", *r6("multiplier"))


@query(_SCANS_SQL + """SELECT "row", round(avg(c * f), 4) AS c0, round(-0.5 * avg(c * f), 4) AS c1 FROM r JOIN m USING (scan_id) GROUP BY 1""")
def pooled_response(spark, d):
    return tissue.pool(_scan_responses(spark, d)).select("row", *[F.round(F.get("coeffs", F.lit(k)), 4).alias(f"c{k}") for k in (0, 1)])


@query(_SCANS_SQL + """SELECT "row", round(median(c * f), 4) AS c0 FROM r JOIN m USING (scan_id) GROUP BY 1""")
def pooled_median(spark, d):
    return tissue.pool(_scan_responses(spark, d), "median").select("row", F.round(F.get("coeffs", F.lit(0)), 4).alias("c0"))


@query(_SCANS_SQL + """, p AS (SELECT "row", avg(c * f) AS p FROM r JOIN m USING (scan_id) GROUP BY 1) SELECT scan_id, round(100 * avg(abs(c * f - p) / abs(p)), 5) AS percent FROM r JOIN m USING (scan_id) JOIN p USING ("row") GROUP BY 1""")
def response_deviation(spark, d):
    r = _scan_responses(spark, d)
    return tissue.deviation_percent(r, tissue.pool(r)).select("scan_id", F.round("percent", 5).alias("percent"))


@query()
def smooth_response(spark, d):
    r = dense.responses(_labelled(spark, d), BVALS, DIRS, "smooth", lmax=0, step=250.0, reference="3")
    return r.select("tissue", "row", F.round(F.get("coeffs", F.lit(0)), 3).alias("c"))


@query()
def kurtosis_response(spark, d):
    r = dense.responses(_labelled(spark, d), BVALS, DIRS, "kurtosis", lmax=0, step=500.0, reference="3")
    return r.select("tissue", "row", F.round(F.get("coeffs", F.lit(0)), 3).alias("c"))


@query()
def single_shell(spark, d):
    v = one_shell(S.voxels(spark, d))
    b, g = BVALS[ONE_SHELL], DIRS[ONE_SHELL]
    dti = models.fit_tensor(v, b, g)
    r = pipelines.shell_responses(selection(v), v, dti, N.shells(list(b)), g, 4)
    f = decon.fit_single_shell(v, b, g, r, decon.ShellOptions(lmax=4))
    return f.select(*XYZ, "converged", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in ("gm", "csf")], F.round(F.get("wm", F.lit(0)).cast("double"), 3).alias("wm0"))


@query()
def single_shell_by_criterion(spark, d):
    v = one_shell(S.voxels(spark, d))
    b, g = BVALS[ONE_SHELL], DIRS[ONE_SHELL]
    r = pipelines.shell_responses(selection(v), v, models.fit_tensor(v, b, g), N.shells(list(b)), g, 4)
    return decon.fit_single_shell(v, b, g, r, decon.ShellOptions(lmax=None, candidates=(0, 2, 4))).groupBy("chosen_lmax").count()


@query()
def dense_b(spark, d):
    v = S.voxels(spark, d)
    r = pipelines.dense_responses(selection(v), v, models.fit_tensor(v, BVALS, DIRS), BVALS, DIRS, lmax=4)
    f = decon.fit_dense(v, BVALS, DIRS, r, decon.DenseOptions(lmax=4))
    return f.select(*XYZ, "converged", *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("gm", "csf", "floor")])


@query()
def normalised(spark, d):
    v = S.voxels(spark, d)
    t = v.select(*V.KEY, F.lit(True).alias("in_mask"), *[F.get("signal", F.lit(k)).alias(c) for k, c in ((0, "wm0"), (1, "gm"), (2, "csf"))])
    n = decon.normalise(t, ["wm0", "gm", "csf"], shape(v))
    return n.select(*XYZ, F.round("field", 4).alias("field"), F.round("wm0", 4).alias("wm0"))
