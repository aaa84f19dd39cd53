"""Fits that outlast a session: coefficients in the order of exchange, with a header; as tables, as an image with a sidecar, and in bundles."""

from __future__ import annotations

import getpass
import json
import os
import platform
import shutil
import sys
import tempfile
import time
from dataclasses import asdict, is_dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox import sinks
from lumivox.functions import numeric as N
from lumivox.operators import models, tissue
from lumivox.operators.voxel import KEY
from lumivox.sources import nifti, text

VERSION = "0.2"


def exchange(order: int) -> list[tuple[int, float]]:
    """For each place in the order of exchange, the place and the sign of ours.

    A block of degree l there holds cosines of order l down to 1, the zonal
    term and sines of order 1 up to l; cosines carry the phase (-1)^m, sines a minus. The same list leads back, with places and signs turned about.
    """
    out, start = [], 0
    for n in range(order + 1):
        for l in range(0, n + 1, 2):
            out += [(start + 2 * l - o, (-1.0) ** (l - o) if o < l else 1.0 if o == l else -1.0) for o in range(2 * l + 1)]
            start += 2 * l + 1
    return out


def to_exchange(coef: Column, order: int) -> Column:
    return F.array(*[F.get(coef, F.lit(k)) * F.lit(s) for k, s in exchange(order)])


def from_exchange(coef: Column, order: int) -> Column:
    back = {k: (at, s) for at, (k, s) in enumerate(exchange(order))}
    return F.array(*[F.get(coef, F.lit(back[k][0])) * F.lit(back[k][1]) for k in range(len(back))])


def solver_header(o: models.ShoreOptions, alphas: dict | None = None) -> dict:
    """What the sidecar says of a fit: basis, order and solver, with the alphas that were used if there are any."""
    solver = {"l2": {"kind": "tikhonov", "lambda_n": o.lambda_n, "lambda_l": o.lambda_l}, "l1": {"kind": "fista", "alpha_strategy": o.strategy, "non_negative": o.positive, "max_iter": o.max_iter, "tol": o.tol, "chosen_alpha": alphas}, "nonneg": {"kind": "shore_icls", "lmax": o.order - o.order % 2, "n_constraint_dirs": len(N.hemisphere())}}
    return {"basis": "shore", "radial_order": o.order, "zeta": o.zeta, "n_coeffs": len(N.shore_indices(o.order)), "solver": solver[o.regularisation]}


class Provenance:
    """Started before a run and finished after it. minimal: version and durations; full: also command line, host and start; none: nothing."""

    def __init__(self, tool: str, mode: str = "minimal"):
        if mode not in ("minimal", "full", "none"):
            raise ValueError(f"unknown provenance mode {mode}")
        self.tool, self.mode, self.started = tool, mode, time.time()

    def finish(self, spark: SparkSession) -> dict | None:
        if self.mode == "none":
            return None
        out = {"tool": self.tool, "version": VERSION, "spark_version": spark.version, "default_parallelism": spark.sparkContext.defaultParallelism, "duration_secs": round(time.time() - self.started, 3)}
        if self.mode == "full":
            out |= {"argv": sys.argv, "hostname": platform.node(), "user": getpass.getuser(), "started_at_utc": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(self.started))}
        return out


def save_fit(fit: DataFrame, path: str, o: models.ShoreOptions, affine: np.ndarray, shape: tuple[int, int, int], bvals: np.ndarray, directions: np.ndarray, provenance: dict | None = None, overwrite: bool = False) -> None:
    """A fit as a bundle: coefficients and diagnostics partitioned by scan, the gradient table, and the header that makes it whole."""
    table = text.gradient_frame(fit.sparkSession, "", bvals, directions).drop("scan_id")
    header = solver_header(o) | {"kind": "fit", "affine": np.asarray(affine).tolist(), "shape": list(map(int, shape)), "provenance": provenance}
    sinks.write_bundle({"coefficients": fit.withColumn("coef", to_exchange(F.col("coef"), o.order)), "gradient": table}, path, header, overwrite)


def load_fit(spark: SparkSession, path: str) -> tuple[DataFrame, dict, np.ndarray, np.ndarray]:
    """The fit's rows in our order, its header, b-values and directions."""
    header = sinks.read_header(spark, path)
    if header.get("basis") != "shore":
        raise ValueError(f"{path} holds no fit of this basis")
    rows = sinks.read_table(spark, path, "coefficients")
    g = sinks.read_table(spark, path, "gradient").orderBy("vol").collect()  # a row for each volume
    order = header["radial_order"]
    kind = dict(rows.dtypes)["coef"]
    return rows.withColumn("coef", from_exchange(F.col("coef"), order).cast(kind)), header, np.array([r.bval for r in g]), np.array([[r.gx, r.gy, r.gz] for r in g])


def response_rows(spark: SparkSession, responses: dict[str, np.ndarray], step: float | None = None, bs: list[float] | None = None) -> DataFrame:
    """tissue, row, b, coeffs of a response set, on the grid k * step or at the shells' b-values."""
    at = lambda k: float(k * step) if step else float(bs[k])
    rows = [(t, k, at(k), [float(c) for c in np.atleast_1d(r)]) for t, m in responses.items() for k, r in enumerate(m)]
    return spark.createDataFrame(rows, "tissue string, row int, b double, coeffs array<double>")


def load_responses(spark: SparkSession, path: str, lmax: int | None = None) -> dict[str, np.ndarray]:
    """The response set of a bundle of responses, own or pooled, or of a deconvolution: by tissue its rows, white matter's to lmax at most.

    A set without one of the tissues, with tissues of unlike numbers of rows, with rows that are missing, or with anisotropic rows where there can't be any is an error.
    """
    kind = sinks.read_header(spark, path).get("kind")
    rows = sinks.read_table(spark, path, "pooled" if kind == "pooled" else "responses")
    if tissue.response_faults(rows).limit(1).count():
        raise ValueError(f"{path}: grey matter, fluid and unweighted rows must be isotropic")
    by: dict[str, dict[int, list[float]]] = {}
    for r in rows.collect():  # a row for each b-value of each tissue
        by.setdefault(r.tissue, {})[r.row] = r.coeffs
    if set(by) != {"wm", "gm", "csf"} or len({len(v) for v in by.values()}) > 1 or any(set(v) != set(range(len(v))) for v in by.values()):
        raise ValueError(f"{path} holds no whole response set of white matter, grey matter and fluid")
    width = {t: max(map(len, v.values())) for t, v in by.items()}
    if lmax is not None:
        width["wm"] = min(width["wm"], lmax // 2 + 1)
    out = {t: np.zeros((len(v), width[t] if t == "wm" else 1)) for t, v in by.items()}
    for t, v in by.items():
        for k, c in v.items():
            out[t][k, : len(c)] = c[: out[t].shape[1]]
    return out


def write_pair(first: str, content: bytes, second: str, other: bytes, overwrite: bool = False) -> None:
    """Two local files, both whole or neither: both are written aside before either is moved."""
    for p in (first, second):
        sinks.preflight(p, overwrite)
    aside = []
    try:
        for p, c in ((first, content), (second, other)):
            handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(p)))
            aside.append(name)
            with os.fdopen(handle, "wb") as f:
                f.write(c)
        for name, p in zip(aside, (first, second)):
            os.replace(name, p)
    finally:
        for name in aside:
            if os.path.exists(name):
                os.unlink(name)


def write_directory(path: str, fill, overwrite: bool = False) -> None:
    """A local folder, whole or not at all: fill(folder) writes into one beside it, which then takes its place."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    parent = os.path.dirname(os.path.abspath(path))
    os.makedirs(parent, exist_ok=True)
    aside = tempfile.mkdtemp(dir=parent)
    try:
        fill(aside)
        if os.path.exists(path):
            shutil.rmtree(path)
        os.replace(aside, path)
    except BaseException:
        shutil.rmtree(aside, ignore_errors=True)
        raise


def grid(df: DataFrame, value: str, shape: tuple[int, int, int], width: int | None = None) -> np.ndarray:
    """One scan's column on its grid, as Arrow batches come; what one image holds is all that comes to the driver."""
    out = np.zeros((*shape, width) if width else shape, np.float32)
    t = df.where(F.col(value).isNotNull()).select("x", "y", "z", value).toArrow()
    at = tuple(t.column(c).to_numpy() for c in "xyz")
    column = t.column(value).combine_chunks()
    if len(at[0]):
        out[at] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(at[0]), -1) if width else column.to_numpy(zero_copy_only=False)
    return out


def write_coefficients(fit: DataFrame, path: str, o: models.ShoreOptions, shape: tuple[int, int, int], affine: np.ndarray, extra: dict | None = None, overwrite: bool = False) -> None:
    """One scan's coefficients as a four-dimensional image in the order of exchange, and a sidecar of the same name."""
    path = sinks.with_suffix(path)
    data = grid(fit.withColumn("coef", to_exchange(F.col("coef"), o.order)), "coef", shape, len(N.shore_indices(o.order)))
    write_pair(path, nifti.encode(data, affine), sinks.sibling(path, ".json"), json.dumps(solver_header(o) | (extra or {}), indent=2).encode(), overwrite)


def read_coefficients(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """KEY and coef, in our order, of the voxels with any coefficient, and the sidecar."""
    header = json.loads(text.read_text(spark, sinks.sibling(path, ".json")))
    order = header["radial_order"]
    rows = nifti.read_voxels(spark, path).where(F.exists("signal", lambda c: c != 0))
    return rows.select(*KEY, from_exchange(F.col("signal"), order).alias("coef")), header


def bids_sidecar(model: str, parameters: dict, sources: list[str] | None = None, description: str = "") -> dict:
    """The derivative's JSON in the community's terms."""
    plain = asdict(parameters) if is_dataclass(parameters) else dict(parameters)
    out = {"Model": {"Description": description or model, "Name": model, "Parameters": plain}, "OrientationEncoding": {"EncodingAxis": 3, "Reference": "xyz"}, "GeneratedBy": [{"Name": "lumivox", "Version": VERSION}]}
    return out | ({"Sources": sources} if sources else {})


#: What a bundle of each kind holds.
CONTENTS = {
    "single_shell": {"tissue": ["wm", "gm", "csf"], "responses": ["tissue", "row", "coeffs"], "peaks": ["fixels"], "scalars": ["gfa"]},
    "dense": {"tissue": ["wm", "gm", "csf", "floor"], "responses": ["tissue", "row", "coeffs"], "peaks": ["fixels"], "scalars": ["gfa"]},
    "shore": {"coefficients": ["coef"], "odf": ["sh"], "peaks": ["fixels"], "scalars": ["rtop", "msd", "ng"]},
}


def deconvolution_tables(spark: SparkSession, tissue: DataFrame, responses: dict[str, np.ndarray], lmax: int) -> dict[str, DataFrame]:
    """tissue, responses, peaks and scalars of a deconvolution, whose wm coefficients are the orientation density."""
    rows = [(t, k, [float(c) for c in np.atleast_1d(r)]) for t, m in responses.items() for k, r in enumerate(m)]
    p = models.peaks(tissue.select(*KEY, F.col("wm").cast("array<double>").alias("sh")), lmax)
    return {"tissue": tissue, "responses": spark.createDataFrame(rows, "tissue string, row int, coeffs array<double>"), "peaks": p.select(*KEY, "fixels"), "scalars": p.select(*KEY, "gfa")}


def shore_tables(fit: DataFrame, o: models.ShoreOptions) -> dict[str, DataFrame]:
    """coefficients (in the order of exchange), odf, peaks and scalars of a basis fit."""
    odf = models.odf(fit, o)
    return {"coefficients": fit.withColumn("coef", to_exchange(F.col("coef"), o.order)), "odf": odf.select(*KEY, "sh"), "peaks": models.peaks(odf, o.order - o.order % 2).select(*KEY, "fixels"), "scalars": models.propagator_scalars(fit, o)}


def write_result(kind: str, tables: dict[str, DataFrame], path: str, header: dict, overwrite: bool = False) -> None:
    """A bundle with the content that its kind asks for; scalars may hold further columns, such as microstructure maps."""
    for name, columns in CONTENTS[kind].items():
        missing = set(columns) - set(tables[name].columns) if name in tables else {name}
        if missing:
            raise ValueError(f"a {kind} bundle lacks {', '.join(sorted(missing))} in {name}")
    sinks.write_bundle(tables, path, header | {"kind": kind, "content": CONTENTS[kind]}, overwrite)
