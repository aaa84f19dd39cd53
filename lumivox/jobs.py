"""Jobs for spark-submit, from files to bundles: quality control, tensor and basis fits, orientation densities, synthesis, responses, deconvolution, normalisation.

    spark-submit -m lumivox.jobs qc --series dwi.nii.gz --bvals bvals --bvecs bvecs --out report
"""

from __future__ import annotations

import argparse
import json
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox import sinks
from lumivox.api import Scan
from lumivox.functions import numeric as N
from lumivox.operators import decon, models, qc, tissue
from lumivox.operators import dense as dense_rows
from lumivox.operators.voxel import KEY
from lumivox.plans import pipelines
from lumivox.sinks import fits
from lumivox.sources import text
from lumivox.sources.series import read_series


def arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="lumivox", description=__doc__)
    sub = top.add_subparsers(dest="job", required=True)

    def job(name: str, series: bool = True, **kw) -> argparse.ArgumentParser:
        p = sub.add_parser(name, **kw)
        if series:
            p.add_argument("--series", required=True)
            p.add_argument("--bvals", required=True, help="b-values or, without --bvecs, a table of four columns")
            p.add_argument("--bvecs")
            p.add_argument("--mask")
            p.add_argument("--graddev", help="gradient deviation on the series' grid")
        p.add_argument("--out", required=True)
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--provenance", choices=("minimal", "full", "none"), default="minimal")
        return p

    def staged(p: argparse.ArgumentParser) -> None:
        o = tissue.StagedOptions()
        p.add_argument("--erosions", type=int, default=o.erosions)
        for t in ("wm", "gm", "csf"):
            p.add_argument(f"--{t}-percent", type=float, default=getattr(o, f"{t}_percent"), help="share of its voxels that responses come from")
        p.add_argument("--estimator", choices=("kernel", "smooth", "kurtosis"), help="of dense-b rows; by default chosen by the scan")

    p = job("qc")
    p.add_argument("--no-coherence", action="store_true")
    p.add_argument("--prefix", default="")
    job("tensor")
    p = job("shore")
    for name, kind, value in (("order", int, 6), ("zeta", float, 700.0), ("alpha", float, 1.0), ("eps", float, None)):
        p.add_argument(f"--{name}", type=kind, default=value)
    p.add_argument("--regularisation", choices=("l1", "l2", "nonneg"), default="l1")
    p.add_argument("--strategy", choices=("fixed", "ratio", "bic", "l2-anchored"), default="l2-anchored")
    p = job("odf", series=False, help="orientation densities, peaks and microstructure maps of a saved fit")
    p.add_argument("--fit", required=True)
    p = job("synth", series=False, help="the signal that a saved fit gives at a table")
    p.add_argument("--fit", required=True)
    p.add_argument("--bvals", help="by default the fit's own table")
    p.add_argument("--bvecs")
    p.add_argument("--keep-negative", action="store_true")
    p = job("response", help="tissue responses of a scan")
    p.add_argument("--kind", choices=("shells", "dense"), default="dense")
    p.add_argument("--lmax", type=int, default=8)
    staged(p)
    for name in ("single-shell", "dense"):
        p = job(name)
        p.add_argument("--lmax", type=int, default=8)
        p.add_argument("--target", type=float, help="tissue sum after normalisation; by default the upper median of the sums")
        p.add_argument("--responses", help="a bundle of responses to use; by default they are estimated from the scan")
        staged(p)
    p.add_argument("--reference-mask", help="image, named as the series, over which the reference unweighted signal is taken")
    p = job("normalise", series=False, help="normalises the tissues of a deconvolution's bundle anew")
    p.add_argument("--bundle", required=True)
    p.add_argument("--order", type=int, default=3)
    p.add_argument("--target", type=float)
    p.add_argument("--balance", action="store_true", help="multiply by the balance factors too")
    p = job("responses", series=False, help="pools responses of several bundles")
    p.add_argument("--bundles", nargs="+", required=True)
    p.add_argument("--statistic", choices=("mean", "median"), default="mean")
    return top.parse_args(argv)


def table_of(spark: SparkSession, bvals: str, bvecs: str | None) -> tuple[np.ndarray, np.ndarray]:
    if bvecs is None:
        return text.parse_table(text.read_text(spark, bvals))
    return text.parse_bvals(text.read_text(spark, bvals)), text.parse_bvecs(text.read_text(spark, bvecs))


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    told = fits.Provenance(a.job, a.provenance)
    if a.job in WITHOUT_SERIES:
        WITHOUT_SERIES[a.job](spark, a, told)
        return
    scan = Scan.from_files(spark, a.series, a.bvals, a.bvecs, a.mask)
    if a.graddev:
        scan = scan.with_graddev(a.series, a.graddev)
    if a.job == "qc":
        report = scan.report(coherence=not a.no_coherence)
        sinks.report_tsv(report, f"{a.out}/table", a.prefix, a.overwrite)
        sinks.report_json(report, f"{a.out}/report", "file" if a.mask else "unweighted signal", a.overwrite)
        return
    for r in qc.input_quality(scan.voxels, scan.gradient).limit(20).collect():
        print(f"[{a.job}] {r.scan_id}: {r.summary}", *r.warnings, sep="; ", file=sys.stderr)
    WITH_SERIES[a.job](spark, a, scan, told)


def header_of(spark: SparkSession, scan: Scan, told: fits.Provenance, **more) -> dict:
    return {"affine": scan.affine.tolist(), "shape": list(map(int, scan.shape)), "provenance": told.finish(spark)} | more


def tensor(spark: SparkSession, a: argparse.Namespace, scan: Scan, told: fits.Provenance) -> None:
    fit = models.fit_tensor_graddev(scan.voxels, scan.bvals, scan.directions) if a.graddev else scan.tensor
    fit.write.mode("overwrite" if a.overwrite else "errorifexists").partitionBy("scan_id").parquet(a.out)
    one = spark.createDataFrame([(json.dumps(header_of(spark, scan, told, kind="tensor"), sort_keys=True),)], "value string").coalesce(1)
    one.write.mode("overwrite").text(f"{a.out}/_header")  # a name that readers of the rows pass over


def shore(spark: SparkSession, a: argparse.Namespace, scan: Scan, told: fits.Provenance) -> None:
    o = models.ShoreOptions(order=a.order, zeta=a.zeta, alpha=a.alpha, eps=a.eps, regularisation=a.regularisation, strategy=a.strategy)
    fit = models.fit_shore(scan.voxels, scan.bvals, scan.directions, o=o)
    fits.save_fit(fit, a.out, o, scan.affine, scan.shape, scan.bvals, scan.directions, told.finish(spark), a.overwrite)


def selected(a: argparse.Namespace, scan: Scan) -> tissue.Selection:
    return scan.tissue(tissue.StagedOptions(erosions=a.erosions, wm_percent=a.wm_percent, gm_percent=a.gm_percent, csf_percent=a.csf_percent))


def response(spark: SparkSession, a: argparse.Namespace, scan: Scan, told: fits.Provenance) -> None:
    pick = selected(a, scan)
    if a.kind == "shells":
        groups = N.shells(scan.bvals.tolist())
        rows = fits.response_rows(spark, pipelines.shell_responses(pick, scan.voxels, scan.tensor, groups, scan.directions, a.lmax), bs=[float(b) for b, _ in groups])
        used = "shells"
    else:
        moved = dense_rows.b_shift(scan.voxels, scan.bvals, scan.directions).first() if a.graddev else None
        used = a.estimator or tissue.choose_estimator(moved.shift if moved else None)
        found = pipelines.dense_responses(pick, scan.voxels, scan.tensor, scan.bvals, scan.directions, used, a.lmax, b_max=moved.largest if moved else None)
        rows = fits.response_rows(spark, found, step=50.0)
    sinks.write_bundle({"responses": rows}, a.out, header_of(spark, scan, told, kind="responses", estimator=used, counts=pick.counts), a.overwrite)


def deconvolution(spark: SparkSession, a: argparse.Namespace, scan: Scan, told: fits.Provenance) -> None:
    n = decon.NormaliseOptions(target=a.target)
    given = fits.load_responses(spark, a.responses, a.lmax) if a.responses else None
    kw = {"n": n, "responses": given, "selection": None if given is not None else selected(a, scan)}
    if a.job == "dense":
        reference = read_series(spark, a.reference_mask).where(F.get("signal", F.lit(0)) > 0).select(*KEY) if a.reference_mask else None
        done = scan.dense(decon.DenseOptions(lmax=a.lmax), estimator=a.estimator, reference=reference, **kw)
    else:
        done = scan.single_shell(o=decon.ShellOptions(lmax=a.lmax), **kw)
    tables = fits.deconvolution_tables(spark, done.tissue, done.responses, a.lmax)
    fits.write_result(a.job.replace("-", "_"), tables, a.out, header_of(spark, scan, told, details=done.details, lmax=a.lmax, responses=a.responses), a.overwrite)


def odf(spark: SparkSession, a: argparse.Namespace, told: fits.Provenance) -> None:
    rows, header, _, _ = fits.load_fit(spark, a.fit)
    o = models.ShoreOptions(order=header["radial_order"], zeta=header["zeta"])
    more = {k: header[k] for k in ("affine", "shape", "basis", "radial_order", "zeta")}
    fits.write_result("shore", fits.shore_tables(rows, o), a.out, more | {"fit": a.fit, "provenance": told.finish(spark)}, a.overwrite)


def synth(spark: SparkSession, a: argparse.Namespace, told: fits.Provenance) -> None:
    rows, header, b, g = fits.load_fit(spark, a.fit)
    if a.bvals:
        b, g = table_of(spark, a.bvals, a.bvecs)
    o = models.ShoreOptions(order=header["radial_order"], zeta=header["zeta"])
    signal = models.synthesize(rows, b, g, o=o, clip=not a.keep_negative).select(*KEY, "signal")
    tables = {"voxels": signal, "gradient": text.gradient_frame(spark, "", b, g).drop("scan_id")}
    sinks.write_bundle(tables, a.out, {"kind": "signal", "affine": header["affine"], "shape": header["shape"], "fit": a.fit, "provenance": told.finish(spark)}, a.overwrite)


def normalise(spark: SparkSession, a: argparse.Namespace, told: fits.Provenance) -> None:
    header = sinks.read_header(spark, a.bundle)
    if header.get("kind") not in ("single_shell", "dense"):
        raise ValueError(f"{a.bundle} holds no tissues")
    o = decon.NormaliseOptions(order=a.order, target=a.target, balance=a.balance)
    rows = sinks.read_table(spark, a.bundle, "tissue").drop("field")
    levels = decon.fit_levels(rows, ["wm0", "gm", "csf"], tuple(header["shape"]), o)
    done = decon.normalise(rows, ["wm0", "gm", "csf"], tuple(header["shape"]), o, levels)
    said = {k: {"target": v.target, "balance": v.balance.tolist(), "fitted": v.fitted, "residual": v.residual, "scale": v.scale} for k, v in levels.items()}
    sinks.write_bundle({"tissue": done}, a.out, {"kind": "normalised", "bundle": a.bundle, "shape": header["shape"], "levels": said, "provenance": told.finish(spark)}, a.overwrite)


def pooled(spark: SparkSession, a: argparse.Namespace, told: fits.Provenance) -> None:
    every: DataFrame | None = None
    for path in a.bundles:
        # the bundle stands for a scan; rows of a dense bundle stand on its own grid of b-values
        one = sinks.read_table(spark, path, "responses").select(F.lit(path).alias("scan_id"), "tissue", "row", F.col("row").cast("double").alias("b"), "coeffs")
        every = one if every is None else every.union(one)
    found, off = pipelines.group_responses(every, a.statistic)
    sinks.write_bundle({"pooled": found, "deviation": off}, a.out, {"kind": "pooled", "statistic": a.statistic, "bundles": a.bundles, "provenance": told.finish(spark)}, a.overwrite)


WITH_SERIES = {"tensor": tensor, "shore": shore, "response": response, "single-shell": deconvolution, "dense": deconvolution}
WITHOUT_SERIES = {"odf": odf, "synth": synth, "normalise": normalise, "responses": pooled}


if __name__ == "__main__":
    run(SparkSession.builder.appName("lumivox").getOrCreate(), arguments(sys.argv[1:]))
