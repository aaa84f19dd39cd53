"""Queries over the driver's tables, one or more for each group of operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.operators import order_stats as O
from lumivox.operators import qc
from lumivox.operators import voxel as V
from lumivox.plans import virtual_scan as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, scan: bool = True):
    """Registers a query under its name; sql: the same in DuckDB's SQL, after the virtual scan's CTEs if scan."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (S.SQL + sql) if scan else sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


BVALS = S.gradient_arrays()[0].tolist()
SHAPE_SQL = "(SELECT max(z) + 1 FROM v)"
#: CTEs of q-space pairs: p (all), nbr and con (chosen).
PAIRS_SQL = """, q AS (SELECT vol, sqrt(bval) * gx AS qx, sqrt(bval) * gy AS qy, sqrt(bval) * gz AS qz FROM g WHERE bval > 50),
p AS (SELECT a.vol AS i, b.vol AS j, a.qx AS ax, a.qy AS ay, a.qz AS az, b.qx AS bx, b.qy AS by_, b.qz AS bz, a.qx * a.qx + a.qy * a.qy + a.qz * a.qz AS aa, a.qx * b.qx + a.qy * b.qy + a.qz * b.qz AS ab FROM q a JOIN q b ON a.vol <> b.vol),
nbr AS (SELECT i, arg_min(j, (least(sqrt((ax - bx) ** 2 + (ay - by_) ** 2 + (az - bz) ** 2), sqrt((ax + bx) ** 2 + (ay + by_) ** 2 + (az + bz) ** 2)), j)) AS j FROM p GROUP BY i),
p2 AS (SELECT *, bx - ab / aa * ax AS px, by_ - ab / aa * ay AS py, bz - ab / aa * az AS pz FROM p),
p3 AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS pn, sqrt(aa) AS an FROM p2),
con AS (SELECT i, arg_min(j, (sqrt((bx - px / pn * an) ** 2 + (by_ - py / pn * an) ** 2 + (bz - pz / pn * an) ** 2), j)) AS j FROM p3 WHERE pn > 1e-8 * greatest(an, 1) GROUP BY i)
"""
CORR_SQL = PAIRS_SQL + ", c AS (SELECT k.kind, k.i, k.j, corr(a.s, b.s) AS r, avg(a.s) AS mi, avg(b.s) AS mj FROM (SELECT 'near' AS kind, * FROM nbr UNION ALL SELECT 'contrast', * FROM con) k JOIN long a ON a.vol = k.i JOIN long b ON b.vol = k.j AND a.x = b.x AND a.y = b.y AND a.z = b.z WHERE {mask} GROUP BY ALL)\n"


@query("SELECT x, y, z, label FROM v WHERE in_mask")
def masked_voxels(spark, d):
    return V.masked(S.voxels(spark, d)).select("x", "y", "z", "label")


#: The pairs of each scan's own table.
SCAN_PAIRS_SQL = S.TABLES_SQL + """, q AS (SELECT scan_id, vol, sqrt(bval) * gx AS qx, sqrt(bval) * gy AS qy, sqrt(bval) * gz AS qz FROM tg WHERE bval > 50),
p AS (SELECT a.scan_id, a.vol AS i, b.vol AS j, a.qx AS ax, a.qy AS ay, a.qz AS az, b.qx AS bx, b.qy AS by_, b.qz AS bz, a.qx * a.qx + a.qy * a.qy + a.qz * a.qz AS aa, a.qx * b.qx + a.qy * b.qy + a.qz * b.qz AS ab FROM q a JOIN q b ON a.scan_id = b.scan_id AND a.vol <> b.vol),
nbr AS (SELECT scan_id, i, arg_min(j, (least(sqrt((ax - bx) ** 2 + (ay - by_) ** 2 + (az - bz) ** 2), sqrt((ax + bx) ** 2 + (ay + by_) ** 2 + (az + bz) ** 2)), j)) AS j FROM p GROUP BY ALL),
p2 AS (SELECT *, bx - ab / aa * ax AS px, by_ - ab / aa * ay AS py, bz - ab / aa * az AS pz FROM p),
p3 AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS pn, sqrt(aa) AS an FROM p2),
con AS (SELECT scan_id, i, arg_min(j, (sqrt((bx - px / pn * an) ** 2 + (by_ - py / pn * an) ** 2 + (bz - pz / pn * an) ** 2), j)) AS j FROM p3 WHERE pn > 1e-8 * greatest(an, 1) GROUP BY ALL)
"""


@query(S.TABLES_SQL + "SELECT scan_id, vol, bval <= 50 AS b0 FROM tg")
def b0_predicate(spark, d):
    return S.table_gradients(spark, d).select("scan_id", "vol", V.is_b0(F.col("bval")).alias("b0"))


@query(", m AS (SELECT x, y, z, avg(s) AS b0 FROM long WHERE vol % 8 = 0 GROUP BY ALL) SELECT x, y, z, round(b0, 1) AS b0, b0 > 0.01 * (SELECT max(b0) FROM m) AS in_mask FROM m")
def fallback_mask(spark, d):
    return V.fallback_mask(S.voxels(spark, d), BVALS).select("x", "y", "z", F.round("b0", 1).alias("b0"), "in_mask")


@query(""", o(dx, dy, dz) AS (VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))
SELECT v.x + dx AS x, v.y + dy AS y, v.z + dz AS z FROM v, o WHERE in_mask GROUP BY ALL HAVING count(*) = 7""")
def erosion(spark, d):
    return V.erode(S.voxels(spark, d), 1).select("x", "y", "z")


@query("SELECT x, y, z FROM v WHERE label = 3 OR z = 1")
def mask_union(spark, d):
    v = S.voxels(spark, d)
    return V.union(V.select_where(v, F.col("label") == 3), V.select_where(v, F.col("z") == 1)).select("x", "y", "z")


@query("SELECT x, y, z FROM v WHERE label = 3 AND z <> 1")
def mask_difference(spark, d):
    v = S.voxels(spark, d)
    return V.difference(V.select_where(v, F.col("label") == 3), V.select_where(v, F.col("z") == 1)).select("x", "y", "z")


@query("SELECT x, y, z, round(CASE WHEN in_mask THEN signal[2] ELSE 0 END, 6) AS value FROM v")
def masked_projection(spark, d):
    return V.projected(S.voxels(spark, d), F.get("signal", F.lit(1)), "value").select("x", "y", "z", *r6("value"))


@query("SELECT x, y, z, round(s, 6) AS value FROM long WHERE vol = 5 AND in_mask AND s <> 0")
def finite_values(spark, d):
    v = S.voxels(spark, d).withColumn("value", F.get("signal", F.lit(5)))
    return V.finite(v, "value", nonzero=True).select("x", "y", "z", *r6("value"))


@query("SELECT x, y, z, round(s, 6) AS value FROM long WHERE vol = 0 AND label IN (2, 4)")
def voxel_gather(spark, d):
    v = S.voxels(spark, d)
    return V.gather(v.select(*V.KEY, F.get("signal", F.lit(0)).alias("value")), V.select_where(v, F.col("label").isin(2, 4))).select("x", "y", "z", *r6("value"))


@query("SELECT 9 - y AS x, x AS y, z, label FROM v")
def canonical_axes(spark, d):
    affine = [[0.0, -2.0, 0.0, 10.0], [2.0, 0.0, 0.0, 0.0], [0.0, 0.0, 2.0, 0.0]]
    return V.canonical(S.voxels(spark, d), affine, (10, 10, 5))[0].select("x", "y", "z", "label")


@query("SELECT x, y, z, round(len(list_filter(signal, lambda s: s > 100)) / 64, 6) AS share, list_any_value(list_filter(signal, lambda s: s > 500)) IS NOT NULL AS any_large FROM v")
def coefficient_shares(spark, d):
    v = S.voxels(spark, d).withColumn("c", F.transform("signal", lambda s: F.when(s > 100, s).otherwise(0.0)))
    return v.select("x", "y", "z", F.round(V.sparsity(F.col("c")), 6).alias("share"), V.any_nonzero(F.transform("signal", lambda s: F.when(s > 500, s).otherwise(0.0))).alias("any_large"))


@query(SCAN_PAIRS_SQL + "SELECT scan_id, i, j FROM nbr")
def neighbour_pairs(spark, d):
    return qc.neighbour_pairs(S.table_gradients(spark, d)).select("scan_id", "i", "j")


@query(SCAN_PAIRS_SQL + "SELECT nbr.scan_id, nbr.i, nbr.j AS near, con.j AS contrast FROM nbr JOIN con ON nbr.scan_id = con.scan_id AND nbr.i = con.i")
def contrast_triples(spark, d):
    return qc.contrast_triples(S.table_gradients(spark, d)).select("scan_id", "i", "near", "contrast")


@query(CORR_SQL.format(mask="true") + "SELECT i, j, round(r, 6) AS r, round(mi, 4) AS mean_i, round(mj, 4) AS mean_j FROM c WHERE kind = 'near'")
def pair_correlations(spark, d):
    return qc.pair_correlations(S.voxels(spark, d), qc.neighbour_pairs(S.gradient(spark))).select("i", "j", *r6("r"), F.round("mean_i", 4).alias("mean_i"), F.round("mean_j", 4).alias("mean_j"))


@query(CORR_SQL.format(mask="true") + "SELECT 'virtual' AS scan_id, round(avg(r), 6) AS ndc FROM c WHERE kind = 'near'")
def ndc(spark, d):
    return qc.ndc(S.voxels(spark, d), S.gradient(spark)).select("scan_id", *r6("ndc"))


@query(CORR_SQL.format(mask="a.in_mask") + "SELECT 'virtual' AS scan_id, round(avg(r), 6) AS ndc FROM c WHERE kind = 'near'")
def ndc_masked(spark, d):
    return qc.ndc(V.masked(S.voxels(spark, d)), S.gradient(spark)).select("scan_id", *r6("ndc"))


@query(CORR_SQL.format(mask="true") + "SELECT round(avg(r) FILTER (kind = 'near') / avg(r) FILTER (kind = 'contrast'), 6) AS contrast_ratio, CASE WHEN avg(r) FILTER (kind = 'near') / avg(r) FILTER (kind = 'contrast') < 1.1 THEN 'poor' WHEN avg(r) FILTER (kind = 'near') / avg(r) FILTER (kind = 'contrast') <= 1.3 THEN 'fair' ELSE 'good' END AS grade FROM c")
def contrast_ratio(spark, d):
    r = qc.contrast_ratio(S.voxels(spark, d), S.gradient(spark))
    return r.select(*r6("contrast_ratio"), qc.contrast_grade(F.col("contrast_ratio")).alias("grade"))


#: sm: the long view smoothed in planes, single precision after either axis.
_AT = "CASE WHEN ((n.i + w.d) % 20 + 20) % 20 < 10 THEN ((n.i + w.d) % 20 + 20) % 20 ELSE 19 - ((n.i + w.d) % 20 + 20) % 20 END"
SMOOTH_SQL = f""", w AS (SELECT i - 8 AS d, exp(-((i - 8) ** 2) / 8.0) / (SELECT sum(exp(-((k - 8) ** 2) / 8.0)) FROM range(17) u(k)) AS w FROM range(17) t(i)),
sx AS (SELECT CAST(n.i AS INTEGER) AS x, p.y, p.z, p.vol, CAST(sum(CAST(p.s AS FLOAT)::DOUBLE * w.w) AS FLOAT) AS s FROM range(10) n(i) JOIN w ON true JOIN long p ON p.x = {_AT} GROUP BY ALL),
sm AS (SELECT p.x, CAST(n.i AS INTEGER) AS y, p.z, p.vol, CAST(sum(p.s::DOUBLE * w.w) AS FLOAT)::DOUBLE AS s FROM range(10) n(i) JOIN w ON true JOIN sx p ON p.y = {_AT} GROUP BY ALL)
"""
SLICES_SQL = SMOOTH_SQL + """, k AS (SELECT vol, z, sum(abs(s - (b + a) / 2)) AS off, sum(abs(a - b) / 2) AS spread, count(*) AS n FROM
 (SELECT o.vol, o.z, o.s, b.s AS b, a.s AS a FROM sm o JOIN v USING (x, y, z) JOIN sm b ON o.x = b.x AND o.y = b.y AND o.vol = b.vol AND b.z = o.z - 1 JOIN sm a ON o.x = a.x AND o.y = a.y AND o.vol = a.vol AND a.z = o.z + 1 WHERE v.in_mask) GROUP BY ALL)
"""


@query(SLICES_SQL + "SELECT vol, z AS slice, round(off / spread, 4) AS ratio, off / spread > 2.5 AS outlier FROM k WHERE n >= 80")
def outlier_slices(spark, d):
    return qc.outlier_slices(S.voxels(spark, d), qc.SliceOptions(min_voxels=80)).select("vol", "slice", F.round("ratio", 4).alias("ratio"), "outlier")


@query(SMOOTH_SQL + "SELECT x, y, z, vol, round(s, 2) AS value FROM sm")
def smooth_in_plane(spark, d):
    v = qc.smooth_in_plane(S.voxels(spark, d), 2.0).select("x", "y", "z", F.posexplode("signal").alias("vol", "value"))
    return v.withColumn("value", F.round(F.col("value").cast("double"), 2))


#: dti: planted directions that circle about the z axis, bent by the embedding, and their anisotropies.
DTI_SQL = """, dti0 AS (SELECT CAST(vec_id % 10 AS INTEGER) AS x, CAST(vec_id // 10 % 10 AS INTEGER) AS y, CAST(vec_id // 100 AS INTEGER) AS z, 0.2::DOUBLE + 0.05::DOUBLE * label + 0.001::DOUBLE * embedding[4]::DOUBLE AS fa,
  4.5::DOUBLE - (vec_id // 10 % 10) + 0.3::DOUBLE * embedding[1]::DOUBLE AS a, (vec_id % 10) - 4.5::DOUBLE + 0.3::DOUBLE * embedding[2]::DOUBLE AS b, 0.3::DOUBLE * embedding[3]::DOUBLE AS c FROM embeddings),
dti AS (SELECT x, y, z, fa, a / sqrt(a * a + b * b + c * c) AS d1, b / sqrt(a * a + b * b + c * c) AS d2, c / sqrt(a * a + b * b + c * c) AS d3 FROM dti0 WHERE fa > 0),
cut AS (SELECT list(fa ORDER BY fa)[CAST(round((count(*) - 1) * 0.1) AS BIGINT) + 1] AS low, list(fa ORDER BY fa)[CAST(round((count(*) - 1) * 0.9) AS BIGINT) + 1] AS high FROM dti)
"""
COHERENCE_SQL = DTI_SQL + """, ev AS (SELECT dti.* FROM dti, cut WHERE fa >= low),
st AS (SELECT *, greatest(abs(d1), abs(d2), abs(d3)) AS top FROM ev),
way AS (SELECT st.*, st.x + w.w * CAST(round(d1 / top) AS INTEGER) AS tx, st.y + w.w * CAST(round(d2 / top) AS INTEGER) AS ty, st.z + w.w * CAST(round(d3 / top) AS INTEGER) AS tz FROM st, (VALUES (1), (-1)) w(w)),
co AS (SELECT way.x, way.y, way.z, any_value(way.fa) AS fa, coalesce(bool_or(abs(way.d1 * o.d1 + way.d2 * o.d2 + way.d3 * o.d3) >= cos(radians(15))), false) AS agree FROM way LEFT JOIN ev o ON o.x = tx AND o.y = ty AND o.z = tz GROUP BY ALL)
"""


def chains_sql(source: str) -> str:
    """CTEs from `source` (t, x, y, z, fa, d1, d2, d3) to cl (t, chain_length): mutual best links, and what each voxel reaches along them."""
    return f""", of AS (SELECT a.v AS dx, b.v AS dy, c.v AS dz, sqrt(a.v * a.v + b.v * b.v + c.v * c.v) AS len FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v), (VALUES (-1), (0), (1)) c(v) WHERE a.v <> 0 OR b.v <> 0 OR c.v <> 0),
ah AS (SELECT f.*, f.x + dx AS tx, f.y + dy AS ty, f.z + dz AS tz, len, (d1 * dx + d2 * dy + d3 * dz) / len AS ahead FROM {source} f, of),
me AS (SELECT ah.t, ah.x, ah.y, ah.z, ahead, tx, ty, tz, len, abs(ah.d1 * o.d1 + ah.d2 * o.d2 + ah.d3 * o.d3) AS c FROM ah JOIN {source} o ON o.t = ah.t AND o.x = tx AND o.y = ty AND o.z = tz WHERE abs(ahead) >= cos(radians(60))),
en AS (SELECT t, (x, y, z) AS a, arg_max((tx, ty, tz), (c * abs(ahead), tx, ty, tz)) AS b, arg_max(len, (c * abs(ahead), tx, ty, tz)) AS len FROM me WHERE c >= cos(radians(15)) GROUP BY t, x, y, z, ahead > 0),
li AS (SELECT DISTINCT p.t, p.a, p.b, p.len FROM en p JOIN en q ON p.t = q.t AND p.a = q.b AND p.b = q.a),
re AS (SELECT t, (x, y, z) AS a, (x, y, z) AS b FROM {source} UNION SELECT re.t, re.a, li.b FROM re JOIN li ON li.t = re.t AND li.a = re.b),
ro AS (SELECT t, a, min(b) AS root FROM re GROUP BY t, a),
ln AS (SELECT ro.t, root, sum(len) AS mm FROM ro JOIN li ON li.t = ro.t AND li.a = ro.a WHERE li.a < li.b GROUP BY ALL),
cl AS (SELECT f.t, sum(fa * coalesce(mm, 0)) / sum(fa) AS chain_length FROM {source} f JOIN ro ON ro.t = f.t AND ro.a = (f.x, f.y, f.z) LEFT JOIN ln ON ln.t = ro.t AND ln.root = ro.root GROUP BY f.t)
"""


CHAIN_SQL = DTI_SQL + ", ch AS (SELECT 0 AS t, dti.* FROM dti, cut WHERE fa >= low)" + chains_sql("ch")
_TABLES = ", ".join(f"('{n}', {', '.join(str(p + 1) for p in perm)}, {', '.join(map(str, sign))})" for n, perm, sign in qc.table_candidates())
TABLE_SQL = DTI_SQL + f""", tb(t, p1, p2, p3, s1, s2, s3) AS (VALUES {_TABLES}),
ca AS (SELECT t, x, y, z, fa, s1 * [d1, d2, d3][p1] AS d1, s2 * [d1, d2, d3][p2] AS d2, s3 * [d1, d2, d3][p3] AS d3 FROM dti, cut, tb WHERE fa >= high)""" + chains_sql("ca")
recursive = lambda sql: (S.SQL + sql).replace("WITH ", "WITH RECURSIVE ", 1)


def planted_directions(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "embeddings"), F.col("vec_id")
    m = [F.get("embedding", F.lit(k)).cast("double") for k in range(4)]
    x, y, z = (i % 10).cast("int"), (F.floor(i / 10) % 10).cast("int"), F.floor(i / 100).cast("int")
    w = [4.5 - y + 0.3 * m[0], x - 4.5 + 0.3 * m[1], 0.3 * m[2]]
    norm = F.sqrt(w[0] * w[0] + w[1] * w[1] + w[2] * w[2])
    return e.select(F.lit(S.SCAN).alias("scan_id"), x.alias("x"), y.alias("y"), z.alias("z"), (0.2 + 0.05 * F.col("label") + 0.001 * m[3]).alias("fa"), F.array(*[c / norm for c in w]).alias("principal_dir"))


@query(COHERENCE_SQL + "SELECT 'virtual' AS scan_id, round(sum(fa) FILTER (agree) / sum(fa), 6) AS coherence, count(*) AS n_evaluated, count(*) FILTER (agree) AS n_connected, (SELECT low FROM cut) AS fa_threshold FROM co")
def coherence(spark, d):
    return qc.fixel_coherence(planted_directions(spark, d)).select("scan_id", *r6("coherence"), "n_evaluated", "n_connected", "fa_threshold")


@query(recursive(CHAIN_SQL) + "SELECT 'virtual' AS scan_id, round(chain_length, 6) AS chain_length FROM cl", scan=False)
def chain_lengths(spark, d):
    return qc.chain_lengths(planted_directions(spark, d)).select("scan_id", *r6("chain_length"))


@query(recursive(TABLE_SQL) + 'SELECT t AS "table", round(chain_length, 6) AS score FROM cl', scan=False)
def gradient_table_check(spark, d):
    return qc.gradient_table_check(planted_directions(spark, d)).select("table", *r6("score"))


_CORR_BOTH = CORR_SQL.replace("corr(a.s, b.s) AS r,", "corr(a.s, b.s) AS r, corr(a.s, b.s) FILTER (a.in_mask) AS rm,").format(mask="true")


@query(recursive(_CORR_BOTH + SLICES_SQL + COHERENCE_SQL + ", ch AS (SELECT 'm' AS t, * FROM ev UNION ALL SELECT t, x, y, z, fa, s1 * [d1, d2, d3][p1], s2 * [d1, d2, d3][p2], s3 * [d1, d2, d3][p3] FROM dti, cut, (VALUES " + _TABLES + ") tb(t, p1, p2, p3, s1, s2, s3) WHERE fa >= high)" + chains_sql("ch")) + """SELECT 'virtual' AS scan_id, 10::DOUBLE AS dimension_x, 10::DOUBLE AS dimension_y, (SELECT max(z) + 1 FROM v)::DOUBLE AS dimension_z, 1::DOUBLE AS voxel_size_x, 1::DOUBLE AS voxel_size_y, 1::DOUBLE AS voxel_size_z,
3000::DOUBLE AS max_b, 56::DOUBLE AS n_dwi_volumes, 8::DOUBLE AS n_b0_volumes, round(avg(r) FILTER (kind = 'near'), 6) AS ndc, round(avg(rm) FILTER (kind = 'near'), 6) AS ndc_masked,
round(avg(r) FILTER (kind = 'near') / avg(r) FILTER (kind = 'contrast'), 6) AS dwi_contrast_ratio, round(avg(rm) FILTER (kind = 'near') / avg(rm) FILTER (kind = 'contrast'), 6) AS dwi_contrast_ratio_masked,
(SELECT count(*) FROM k WHERE n >= 80 AND off / spread > 2.5)::DOUBLE AS n_outlier_slices, (SELECT round(sum(fa) FILTER (agree) / sum(fa), 6) FROM co) AS fixel_coherence, (SELECT round(chain_length, 6) FROM cl WHERE t = 'm') AS fixel_chain_length,
(SELECT round(max(chain_length) / max(chain_length) FILTER (t = '012'), 6) FROM cl WHERE t <> 'm') AS gradient_table_ratio FROM c""", scan=False)
def qc_report(spark, d):
    r = qc.assess(S.voxels(spark, d), S.gradient(spark), dti=planted_directions(spark, d), o=qc.SliceOptions(min_voxels=80))
    whole = ["dimension_x", "dimension_y", "dimension_z", "voxel_size_x", "voxel_size_y", "voxel_size_z", "max_b", "n_dwi_volumes", "n_b0_volumes", "n_outlier_slices"]
    return r.select("scan_id", *[F.col(c) if c in whole else F.round(c, 6).alias(c) for c in qc.COLUMNS])


@query(CORR_SQL.format(mask="a.in_mask") + """, m AS (SELECT avg(r) FILTER (kind = 'near') AS ndc, avg(r) FILTER (kind = 'near') / avg(r) FILTER (kind = 'contrast') AS con FROM c)
SELECT 'virtual' AS scan_id, round(ndc, 6) AS ndc, round(con, 6) AS dwi_contrast, format('NDC {:.3f}, DWI contrast {:.3f} ({})', ndc, con, CASE WHEN con < 1.1 THEN 'poor' WHEN con <= 1.3 THEN 'fair' ELSE 'good' END) AS summary,
  CAST((ndc < 0.4)::INT + (con < 1.1)::INT AS INTEGER) AS n_warnings FROM m""")
def input_quality(spark, d):
    return qc.input_quality(S.voxels(spark, d), S.gradient(spark)).select("scan_id", *r6("ndc", "dwi_contrast"), "summary", F.size("warnings").alias("n_warnings"))


# order statistics run over the larger relational tables


@query("""SELECT g AS l_returnflag, v[CAST(round((n - 1) * 0.1) AS BIGINT) + 1] AS p10, v[CAST(round((n - 1) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(round((n - 1) * 0.9) AS BIGINT) + 1] AS p90
FROM (SELECT l_returnflag AS g, list(l_extendedprice ORDER BY l_extendedprice) AS v, count(*) AS n FROM lineitem GROUP BY 1)""", scan=False)
def nearest_rank(spark, d):
    return O.nearest_rank(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query("SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY 1, 2", scan=False)
def averaging_median(spark, d):
    return O.averaging_median(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice").select("l_returnflag", "l_linestatus", *r6("median"))


@query("SELECT o_orderpriority, list(o_totalprice ORDER BY o_totalprice)[count(*) // 2 + 1] AS median FROM orders GROUP BY 1", scan=False)
def upper_median(spark, d):
    return O.upper_median(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")


@query("SELECT event_type, v[CAST(least(round(n * 0.25), n - 1) AS BIGINT) + 1] AS q1, v[CAST(least(round(n * 0.75), n - 1) AS BIGINT) + 1] AS q3 FROM (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)", scan=False)
def iqr_quartiles(spark, d):
    return O.iqr_quartiles(table(spark, d, "events").where("value is not null"), ["event_type"], "value")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS r FROM orders WHERE o_totalprice <> 0) WHERE r <= 20", scan=False)
def top_n(spark, d):
    return O.top_n(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", 20).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS r FROM orders WHERE o_totalprice <> 0) WHERE r <= 20", scan=False)
def bottom_n(spark, d):
    return O.bottom_n(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", 20).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderstatus, CAST(round_even(count(*) * 2.5 / 100, 0) AS INTEGER) AS n FROM orders GROUP BY 1", scan=False)
def percent_count(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("c")).select("o_orderstatus", O.percent_count(F.col("c"), 2.5).alias("n"))


@query()
def optimal_threshold(spark, d):
    t = O.optimal_threshold(table(spark, d, "orders"), "o_totalprice")
    return spark.createDataFrame([(float(t),)], "threshold double")


@query("SELECT event_type, min(value) AS least FROM events WHERE value > 1 GROUP BY 1", scan=False)
def masked_min(spark, d):
    return O.masked_min(table(spark, d, "events").withColumn("in_mask", F.col("value") > 1), ["event_type"], "value")


@query("""SELECT event_type, count(*) FILTER (value > 2 * p99) AS rejected FROM events JOIN (SELECT event_type, list(value ORDER BY value)[CAST(round((count(value) - 1) * 0.99) AS BIGINT) + 1] AS p99 FROM events WHERE value IS NOT NULL GROUP BY 1) USING (event_type) GROUP BY 1""", scan=False)
def reject_outliers(spark, d):
    r = O.reject_outliers(table(spark, d, "events"), ["event_type"], "value", 2.0)
    return r.groupBy("event_type").agg(F.count(F.when(F.col("rejected"), 1)).alias("rejected"))


@query("""SELECT event_type, n AS n_finite, v[1] AS least, v[n] AS largest, v[CAST(round((n - 1) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(round((n - 1) * 0.95) AS BIGINT) + 1] AS p95, v[CAST(round((n - 1) * 0.99) AS BIGINT) + 1] AS p99,
least(v[CAST(round((n - 1) * 0.99) AS BIGINT) + 1], 100.0::DOUBLE) AS suggested_max FROM (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)""", scan=False)
def display_stats(spark, d):
    return O.display_stats(table(spark, d, "events"), ["event_type"], "value", 100.0)


@query("SELECT event_id, least(value, 50.0::DOUBLE) AS value FROM events", scan=False)
def winsorize(spark, d):
    return table(spark, d, "events").select("event_id", O.winsorize(F.col("value"), 50.0).alias("value"))


@query("SELECT l_shipmode_ AS flag, round(1.4826 * list(v ORDER BY v)[count(*) // 2 + 1], 6) AS sigma FROM (SELECT l_returnflag AS l_shipmode_, abs(l_discount - 0.05) AS v FROM lineitem) GROUP BY 1", scan=False)
def robust_sigma(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_discount") - 0.05).alias("r"))
    return O.robust_sigma(v, ["flag"], "r").select("flag", *r6("sigma"))


@query("SELECT round(coalesce(avg(signal[4]) FILTER (in_mask), 0), 6) AS mean FROM v")
def mean_in_mask(spark, d):
    v = S.voxels(spark, d).withColumn("value", F.get("signal", F.lit(3)))
    return O.mean_in_mask(v, ["scan_id"], "value").select(*r6("mean"))


@query("WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), k AS (SELECT list(v ORDER BY v) AS v, count(*) AS n FROM s WHERE i % greatest(n // 5000, 1) = 0) SELECT v[CAST(round((n - 1) * 0.95) AS BIGINT) + 1] AS quantile FROM k", scan=False)
def strided_quantile(spark, d):
    return O.strided_quantile(table(spark, d, "orders"), ["o_orderkey"], "o_totalprice", 0.95, aim=5000)
