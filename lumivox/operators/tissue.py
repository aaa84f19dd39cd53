"""Tissue selection, response estimation and pooling across scans."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumivox.functions import numeric as N
from lumivox.functions.storage import checkpointed
from lumivox.operators import order_stats as O
from lumivox.operators import solvers
from lumivox.operators.models import map_rows
from lumivox.operators.voxel import KEY, erode, gather, is_finite

NAN = float("nan")


def decay_metric(groups: list[tuple[float, list[int]]]) -> Column:
    """Mean over weighted volumes of ln(S0 / Sb) by shell means of samples raised to 0; NaN where a mean or the metric isn't positive."""
    positive = lambda v: F.greatest(F.get("signal", v).cast("double"), F.lit(0.0))
    mean = lambda vols: F.aggregate(F.array(*[F.lit(v) for v in vols]), F.lit(0.0), lambda a, v: a + positive(v)) / float(len(vols))
    s0 = next(mean(v) for b, v in groups if b == 0)
    weighted = [(mean(v), len(v)) for b, v in groups if b > 0]
    total = sum((n * (F.ln(s0) - F.ln(m)) for m, n in weighted), F.lit(0.0)) / float(sum(n for _, n in weighted))
    fine = s0 > 0
    for m, _ in weighted:
        fine &= m > 0
    return F.when(fine & (total > 0), total).otherwise(F.lit(NAN))


@dataclass(frozen=True)
class StagedOptions:
    erosions: int = 3
    metric_cap: float = 10.0
    fa: float = 0.2
    wm_percent: float = 0.5
    gm_percent: float = 2.0
    csf_percent: float = 10.0


@dataclass
class Selection:
    """Voxels of single-fibre white matter, grey matter and fluid; how many each stage left in all, and in each scan."""

    wm: DataFrame
    gm: DataFrame
    csf: DataFrame
    counts: dict[str, int] = field(default_factory=dict)
    by_scan: dict[str, dict[str, int]] = field(default_factory=dict)


def select_staged(voxels: DataFrame, dti: DataFrame, groups: list[tuple[float, list[int]]], o: StagedOptions = StagedOptions()) -> Selection:
    """Tissue by decay and anisotropy: crude classes, splits at optimal thresholds, then the extremes of each.

    Thresholds are each scan's own; all scans, which share a table of shells, go through a stage together, so the jobs are as many
    for one as for thousands. Voxels stay distributed; counts and thresholds of scans come to the driver. A stage that leaves a scan no voxel is an error that names both.
    """
    counts: dict[str, dict[str, int]] = {}
    one = ["scan_id"]

    def left(name: str, df: DataFrame) -> DataFrame:
        counts[name] = {r.scan_id: r["count"] for r in df.groupBy("scan_id").count().collect()}
        scans = counts["mask"].keys()
        if not scans or (gone := scans - counts[name].keys()):
            raise ValueError(f"tissue selection: no voxel is left as {name}" + (f" in {', '.join(sorted(map(str, gone)))}" if scans else ""))
        return df

    def beside(df: DataFrame, of: DataFrame, value: str = "sdm", to: str = "centre") -> DataFrame:
        """df with the averaging median of `of` in its scan."""
        return df.join(O.averaging_median(of, one, value).withColumnRenamed("median", to), one)

    left("mask", voxels.where("in_mask"))
    eroded = left("eroded", erode(voxels, o.erosions))
    metric = gather(voxels, eroded).withColumn("sdm", decay_metric(groups)).where(is_finite(F.col("sdm")))
    metric = metric.select(*KEY, F.least("sdm", F.lit(o.metric_cap)).alias("sdm"))
    f = left("safe", checkpointed(metric.join(dti.select(*KEY, F.col("fa").cast("double").alias("fa")), KEY).withColumn("in_mask", F.lit(True))))
    plain = f.columns
    crude_wm, rest = left("crude_wm", f.where(F.col("fa") > o.fa)), left("crude_rest", f.where(~(F.col("fa") > o.fa)))
    rest = checkpointed(beside(rest, rest).withColumn("off", F.col("sdm") - F.col("centre")))
    cuts = O.optimal_thresholds(rest, "scan_id", "off")
    if constant := sorted(str(k) for k, t in cuts.items() if t is None):
        raise ValueError(f"tissue selection: the decay metric is constant outside white matter in {', '.join(constant)}")
    rest = rest.join(f.sparkSession.createDataFrame(list(cuts.items()), rest.select("scan_id", F.lit(0.0).alias("cut")).schema), one)
    crude_csf, crude_gm = (left(name, rest.where(w).select(*plain)) for name, w in (("crude_csf", F.col("off") >= F.col("cut")), ("crude_gm", F.col("off") < F.col("cut"))))
    off_wm = checkpointed(beside(crude_wm, crude_wm).withColumn("off", F.abs(F.col("sdm") - F.col("centre"))))
    limit = F.col("centre") + 2 * 1.4826 * F.col("spread")
    off_wm = checkpointed(beside(off_wm, off_wm, "off", "spread"))
    wm, outliers = left("wm", off_wm.where(F.col("sdm") <= limit).select(*plain)), off_wm.where(F.col("sdm") > limit).select(*plain)
    # of each side of the median the half next to it; the lower side is turned about
    sided, halves = checkpointed(beside(crude_gm, crude_gm)), []
    for side, sign in (("sdm > centre", 1.0), ("sdm <= centre", -1.0)):
        half = sided.where(side).withColumn("off", sign * (F.col("sdm") - F.col("centre")))
        halves.append(O.threshold_select(half, "off", below=True, by="scan_id").select(*plain))
    gm = left("gm", checkpointed(halves[0].union(halves[1])))
    least = crude_csf.groupBy("scan_id").agg(F.min("sdm").alias("least"))
    wet = crude_csf.join(least, one).union(outliers.join(least, one).where(F.col("sdm") > F.col("least")))
    csf = left("csf", checkpointed(O.threshold_select(wet.withColumn("off", F.col("sdm") - F.col("least")), "off", by="scan_id").select(*plain)))
    near = checkpointed(beside(gm, gm)).withColumn("off", F.abs(F.col("sdm") - F.col("centre")) + 1.0)  # never 0, which a selection leaves out
    for name, percent in (("wm", o.wm_percent), ("gm", o.gm_percent), ("csf", o.csf_percent)):
        for scan, n in counts[name].items():
            if not round(n * percent / 100):  # half to even
                raise ValueError(f"tissue selection: {percent}% of {n} {name} voxels of {scan} round to none")
    best_wm = left("best_wm", O.top_percent(wm, one, "fa", o.wm_percent))
    best_gm = left("best_gm", O.bottom_percent(near, one, "off", o.gm_percent).select(*plain))
    best_csf = left("best_csf", O.top_percent(csf, one, "sdm", o.csf_percent))
    by_scan = {scan: {stage: c.get(scan, 0) for stage, c in counts.items()} for scan in counts["mask"]}
    return Selection(best_wm, best_gm, best_csf, {stage: sum(c.values()) for stage, c in counts.items()}, by_scan)


def classify_by_threshold(dti: DataFrame, fa: float = 0.7, dominance: float = 2.0, md_percent: float = 2.5) -> DataFrame:
    """`tissue` by fixed rules: csf above the cut of mean diffusivity, wm by anisotropy and dominance, gm else; all-zero fits drop out."""
    from lumivox.operators.models import fiber_dominance
    from lumivox.operators.voxel import without_degenerate

    some = without_degenerate(dti).withColumn("_md", F.col("md").cast("double"))
    cut = O.nearest_rank(some, ["scan_id"], "_md", {"cut": 1 - md_percent / 100})
    kind = F.when(F.col("_md") > F.col("cut"), "csf").when((F.col("fa") > fa) & (fiber_dominance(F.col("evals")) > dominance), "wm").otherwise("gm")
    return some.join(cut, "scan_id").withColumn("tissue", kind).drop("_md", "cut")


def isotropic_response(selected: DataFrame, groups: list[tuple[float, list[int]]], tissue: str) -> DataFrame:
    """scan_id, tissue, row, b, coeffs: the pooled mean of each shell times the root of 4 pi."""
    shell = F.explode(F.array(*[F.struct(F.lit(i).alias("row"), F.lit(float(b)).alias("b"), F.array(*[F.lit(v) for v in vols]).alias("vols")) for i, (b, vols) in enumerate(groups)])).alias("g")
    each = selected.select("scan_id", "signal", shell).select("scan_id", "g.row", "g.b", F.explode(F.transform("g.vols", lambda v: F.get("signal", v).cast("double"))).alias("s"))
    return each.groupBy("scan_id", "row", "b").agg((F.avg("s") * F.lit(float(np.sqrt(4 * np.pi)))).alias("c")).select("scan_id", F.lit(tissue).alias("tissue"), "row", "b", F.array("c").alias("coeffs"))


def zonal_fit(cosines: np.ndarray, values: np.ndarray, lmax: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Zonal harmonic coefficients by least squares; with weights, zeros where the design is singular."""
    x = np.stack([np.sqrt((2 * l + 1) / (4 * np.pi)) * N.legendre(l, 0, cosines) for l in range(0, lmax + 1, 2)], axis=1)
    if weights is None:
        return np.linalg.lstsq(x, values, rcond=None)[0]
    g = x.T @ (weights[:, None] * x)
    if np.linalg.matrix_rank(g) < len(g):
        return np.zeros(len(g))
    return np.linalg.solve(g, x.T @ (weights * values))


def wm_response(selected: DataFrame, groups: list[tuple[float, list[int]]], directions: np.ndarray, lmax: int = 8) -> DataFrame:
    """Mean over voxels of each shell's zonal fit about the voxel's principal direction; the b0 row is isotropic.

    selected: key, signal and principal_dir.
    """
    width = lmax // 2 + 1

    def fit(s: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
        out = np.zeros((len(s), len(groups), width))
        for i, (b, vols) in enumerate(groups):
            if b == 0:
                out[:, i, 0] = s[:, vols].mean(1) * np.sqrt(4 * np.pi)
            else:
                cos = np.abs(d @ directions[vols].T)
                design = np.stack([np.sqrt((2 * l + 1) / (4 * np.pi)) * N.legendre(l, 0, cos) for l in range(0, lmax + 1, 2)], axis=2)
                out[:, i] = (np.linalg.pinv(design) @ s[:, vols, None])[:, :, 0]
        return {"rows": out.reshape(len(s), -1)}

    flat = map_rows(selected, ["signal", "principal_dir"], fit, "rows array<double>")
    mean = flat.select("scan_id", F.posexplode("rows").alias("i", "c")).groupBy("scan_id", "i").agg(F.avg("c").alias("c"))
    rows = mean.groupBy("scan_id", F.floor(F.col("i") / width).cast("int").alias("row")).agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("c"))
    bs = F.array(*[F.lit(float(b)) for b, _ in groups])
    return rows.select("scan_id", F.lit("wm").alias("tissue"), "row", F.get(bs, "row").alias("b"), F.transform("c", lambda x: x.c).alias("coeffs"))


def _legendre_column(l: int, c: Column) -> Column:
    """A Legendre polynomial as a column, by its power coefficients."""
    p = np.polynomial.legendre.leg2poly([0] * l + [1])
    return sum((F.lit(float(a)) * F.pow(c, F.lit(float(k))) for k, a in enumerate(p) if a), F.lit(0.0))


@dataclass
class KurtosisFit:
    """theta: S0, diffusivities, kurtosis terms, offset; b is in thousands here."""

    theta: np.ndarray
    isotropic: bool
    rmsr: float
    aic: float
    iterations: int
    converged: bool

    def signal(self, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return _kurtosis_model(self.theta, np.asarray(b) / 1000, np.asarray(c), self.isotropic)


def _kurtosis_terms(b: np.ndarray, c: np.ndarray, isotropic: bool) -> np.ndarray:
    """Derivatives of the exponent by its parameters."""
    if isotropic:
        return np.stack([-b, b * b], axis=1)
    return np.stack([-b * c**2, -b * (1 - c**2), b * b, b * b * c**2, b * b * c**4], axis=1)


def _kurtosis_model(theta: np.ndarray, b: np.ndarray, c: np.ndarray, isotropic: bool) -> np.ndarray:
    return theta[0] * np.exp(_kurtosis_terms(b, c, isotropic) @ theta[1:-1]) + theta[-1]


def fit_kurtosis(b: np.ndarray, c: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, isotropic: bool = False, max_iter: int = 200) -> KurtosisFit:
    """S0 exp(-b D(c) + b^2 W(c)) + C by Gauss-Newton with step halving, on samples summed up beforehand.

    S0, diffusivities and C aren't negative, and the signal falls with b for every angle up to the largest b.
    """
    if len(np.unique(np.round(b))) < 3:
        raise ValueError("three b-values are needed")
    b, w = np.asarray(b) / 1000, np.ones(len(y)) if w is None else np.asarray(w, dtype=float)
    cs = np.zeros(1) if isotropic else np.linspace(0, 1, 33)
    slope = -_kurtosis_terms(np.full(len(cs), 1.0), cs, isotropic)  # -d/db of the exponent at b: D - 2 b W
    nd = 1 if isotropic else 2
    slope[:, nd:] *= 2 * b.max()
    constraints = [np.concatenate([[0], r, [0]]) for r in slope]
    n = 2 + slope.shape[1]
    constraints += [np.eye(n)[k] for k in (0, *range(1, 1 + nd), n - 1)]
    cmat = np.array(constraints)
    logs = y > 0.02 * y.max()
    x = np.column_stack([np.ones(logs.sum()), _kurtosis_terms(b[logs], c[logs], isotropic)])
    v = np.sqrt(w[logs]) * y[logs]
    start = solvers.Inequality(x * v[:, None], np.array([r[:-1] for r in constraints[: len(slope)]] + [np.eye(n - 1)[k] for k in range(1, 1 + nd)])).solve((v * np.log(y[logs]))[None])[0][0]
    theta = np.concatenate([[np.exp(start[0])], start[1:], [0.0]])
    cost = lambda t: float(np.sum(w * (y - _kurtosis_model(t, b, c, isotropic)) ** 2))
    now, done, k = cost(theta), False, 0
    for k in range(1, max_iter + 1):
        terms = _kurtosis_terms(b, c, isotropic)
        e = np.exp(terms @ theta[1:-1])
        j = np.column_stack([e, theta[0] * e[:, None] * terms, np.ones(len(b))]) * np.sqrt(w)[:, None]
        target = j @ theta + np.sqrt(w) * (y - theta[0] * e - theta[-1])
        size = np.maximum(np.linalg.norm(j, axis=0), 1e-12)
        aim = solvers.Inequality(j / size, cmat / size).solve(target[None])[0][0] / size
        step = 1.0
        while step > 1e-8 and cost(theta + step * (aim - theta)) > now:
            step /= 2
        new = theta + step * (aim - theta)
        change = now - cost(new)
        if change <= 0:
            done = True
            break
        theta, now = new, cost(new)
        if change <= 1e-12 * max(now, 1e-300):
            done = True
            break
    rmsr = float(np.sqrt(now / w.sum()))
    return KurtosisFit(theta, isotropic, rmsr, float(len(y) * np.log(max(rmsr**2, 1e-300)) + 2 * n), k, done)


def kurtosis_rows(fit: KurtosisFit, grid: np.ndarray, lmax: int, nodes: int = 64) -> np.ndarray:
    """Zonal coefficients of the fitted signal at each grid b, by quadrature over the angle."""
    c, wt = N.gauss_legendre(nodes)
    basis = np.stack([np.sqrt((2 * l + 1) / (4 * np.pi)) * N.legendre(l, 0, c) for l in range(0, lmax + 1, 2)])
    return np.array([4 * np.pi * basis @ (wt * fit.signal(np.full(nodes, b), c)) for b in grid])


def choose_estimator(shift: float | None, sigma: float = 150.0, interpolate: bool = False) -> str:
    """smooth where effective b-values are off by more than the kernel's width or, without such, where rows are interpolated; kernel else."""
    if shift is None:
        return "smooth" if interpolate else "kernel"
    return "smooth" if shift > sigma else "kernel"


def response_faults(responses: DataFrame) -> DataFrame:
    """Rows that a response set may not have: anisotropic grey matter or fluid, or an anisotropic unweighted white matter row."""
    extra = F.exists(F.slice("coeffs", 2, 1000), lambda c: c != 0)
    return responses.where(extra & (F.col("tissue").isin("gm", "csf") | (F.col("row") == 0)))


def pool_faults(responses: DataFrame) -> DataFrame:
    """tissue of response sets that can't be pooled: other numbers of rows or widths, or an unweighted term that isn't positive."""
    per_scan = responses.groupBy("tissue", "scan_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("coeffs")).alias("width"), F.min(F.when(F.col("row") == 0, F.get("coeffs", F.lit(0)))).alias("first"))
    bad = per_scan.groupBy("tissue").agg(F.countDistinct("rows").alias("r"), F.countDistinct("width").alias("w"), F.min("first").alias("f"), F.count_if(F.col("first").isNull()).alias("n"))
    return bad.where((F.col("r") > 1) | (F.col("w") > 1) | ~(F.col("f") > 0) | (F.col("n") > 0)).select("tissue")


def multipliers(responses: DataFrame, legacy: bool = False) -> DataFrame:
    """scan_id, tissue, multiplier: the geometric mean over positive rows of the group's mean first coefficient over the own one; 1 without such a row."""
    if legacy:
        return responses.select("scan_id", "tissue").distinct().withColumn("multiplier", F.lit(1.0))
    first = responses.select("scan_id", "tissue", "row", F.get("coeffs", F.lit(0)).alias("c"))
    mean = first.groupBy("tissue", "row").agg(F.avg("c").alias("mean"))
    ratio = F.when((F.col("c") > 0) & (F.col("mean") > 0), F.ln(F.col("mean") / F.col("c")))
    return first.join(mean, ["tissue", "row"]).groupBy("scan_id", "tissue").agg(F.coalesce(F.exp(F.avg(ratio)), F.lit(1.0)).alias("multiplier"))


def pool(responses: DataFrame, statistic: str = "mean", legacy: bool = False) -> DataFrame:
    """tissue, row, b, coeffs: rescaled responses pooled coefficient by coefficient, by mean or averaging median."""
    m = multipliers(responses, legacy)
    each = responses.join(m, ["scan_id", "tissue"]).select("tissue", "row", "b", "multiplier", F.posexplode("coeffs").alias("l", "c"))
    scaled = F.col("c") * F.col("multiplier")
    stat = F.avg(scaled) if statistic == "mean" else F.median(scaled)
    rows = each.groupBy("tissue", "row", "l").agg(stat.alias("c"), F.avg("b").alias("b"))
    out = rows.groupBy("tissue", "row").agg(F.avg("b").alias("b"), F.sort_array(F.collect_list(F.struct("l", "c"))).alias("c"))
    return out.select("tissue", "row", "b", F.transform("c", lambda x: x.c).alias("coeffs"))


def deviation_percent(responses: DataFrame, pooled: DataFrame, legacy: bool = False) -> DataFrame:
    """scan_id, tissue, percent: mean relative difference of the rescaled first coefficients from the pool's over rows where that isn't about 0, else 0."""
    p = pooled.select("tissue", "row", F.get("coeffs", F.lit(0)).alias("p"))
    own = responses.join(multipliers(responses, legacy), ["scan_id", "tissue"]).select("scan_id", "tissue", "row", (F.get("coeffs", F.lit(0)) * F.col("multiplier")).alias("c"))
    off = F.when(F.abs("p") > 1e-9, F.abs(F.col("c") - F.col("p")) / F.abs("p"))
    return own.join(p, ["tissue", "row"]).groupBy("scan_id", "tissue").agg(F.coalesce(100 * F.avg(off), F.lit(0.0)).alias("percent"))
