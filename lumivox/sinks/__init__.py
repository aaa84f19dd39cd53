"""Results as Parquet bundles, report files and images; fits and their content are in `fits`."""

from __future__ import annotations

import json
import math
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.operators.qc import COLUMNS, warnings
from lumivox.sources import nifti

def sibling(path: str, suffix: str) -> str:
    """The path without .nii or .nii.gz, and a suffix."""
    return path.removesuffix(".gz").removesuffix(".nii") + suffix


def with_suffix(path: str) -> str:
    return path if path.endswith((".nii", ".nii.gz")) else f"{path}.nii.gz"


def preflight(path: str, overwrite: bool = False) -> None:
    """Raises before a long run if the local path can't be written at its end."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    if not os.access(folder, os.W_OK):
        raise PermissionError(folder)


def write_file(path: str, content: bytes, overwrite: bool = False) -> None:
    """A local file, whole or not at all."""
    preflight(path, overwrite)
    handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def write_bundle(tables: dict[str, DataFrame], path: str, header: dict, overwrite: bool = False) -> None:
    """Parquet tables side by side, partitioned by scan, and header.json as text, which names the folder of this version.

    Tables go to a folder of their own; only when all are whole does the header, written last, name it, so a run broken in the middle leaves
    what was there before readable. Folders that no header names any more are deleted afterwards.
    """
    spark = next(iter(tables.values())).sparkSession
    context = spark.sparkContext
    top = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(context._jsc.hadoopConfiguration())
    at = lambda name: context._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if fs.exists(at("header.json")) and not overwrite:
        raise FileExistsError(path)
    version = f"version-{uuid.uuid4().hex}"
    for name, df in tables.items():
        (df.write.partitionBy("scan_id") if "scan_id" in df.columns else df.write).parquet(f"{path}/{version}/{name}")
    one = spark.createDataFrame([(json.dumps(header | {"version": version}, sort_keys=True),)], "value string").coalesce(1)
    one.write.text(f"{path}/{version}/header")
    fresh, old = at("header.json"), at(f"{version}/header-before")
    if fs.exists(fresh):
        fs.rename(fresh, old)
    if not fs.rename(at(f"{version}/header"), fresh):
        raise OSError(f"the header of {path} can't be put in place")
    fs.delete(old, True)
    for status in fs.listStatus(top):
        if status.getPath().getName().startswith("version-") and status.getPath().getName() != version:
            fs.delete(status.getPath(), True)


def read_table(spark, path: str, name: str) -> DataFrame:
    """A table of the bundle's version; bundles from before versions have theirs beside the header."""
    version = _header(spark, path).get("version")
    return spark.read.parquet(f"{path}/{version}/{name}" if version else f"{path}/{name}")


def read_header(spark, path: str) -> dict:
    return {k: v for k, v in _header(spark, path).items() if k != "version"}


def _header(spark, path: str) -> dict:
    """The header of the bundle's version; where a run was broken between two versions, of the one before."""
    context = spark.sparkContext
    top = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(context._jsc.hadoopConfiguration())
    whole = f"{path}/header.json"
    if not fs.exists(context._jvm.org.apache.hadoop.fs.Path(whole)):
        kept = fs.globStatus(context._jvm.org.apache.hadoop.fs.Path(f"{path}/version-*/header-before"))
        if not kept:
            raise FileNotFoundError(f"{path} holds no whole bundle")
        whole = kept[0].getPath().toString()
    return json.loads(spark.read.text(whole).first().value)


def report_tsv(report: DataFrame, path: str, prefix: str = "", overwrite: bool = False) -> None:
    """Report rows as tab-separated values, n/a for what is missing or not finite, and the dictionary of their columns beside them."""
    shown = [F.when(F.isnan(c) | F.col(c).isNull() | (F.abs(c) == F.lit(math.inf)), "n/a").otherwise(F.col(c).cast("string")).alias(f"{prefix}{c}") for c in COLUMNS]
    report.select("scan_id", *shown).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").csv(path, sep="\t", header=True)
    one = report.sparkSession.createDataFrame([(json.dumps(data_dictionary(prefix), indent=2),)], "value string").coalesce(1)
    one.write.mode("overwrite" if overwrite else "errorifexists").text(f"{path.rstrip('/')}.json")


def report_json(report: DataFrame, path: str, mask_source: str = "file", overwrite: bool = False) -> None:
    """A line of JSON for each scan: its columns, where the mask came from and what is worth a look."""
    row = F.struct(*COLUMNS)
    told = report.select("scan_id", row.alias("metrics")).join(warnings(report), "scan_id")
    told.select("scan_id", "metrics", F.lit(mask_source).alias("mask_source"), "warnings").write.mode("overwrite" if overwrite else "errorifexists").json(path, ignoreNullFields=False)


def data_dictionary(prefix: str = "") -> dict[str, dict[str, str]]:
    return {f"{prefix}{c}": {"Description": d} for c, d in COLUMNS.items()}


def write_image(df: DataFrame, value: str, shape: tuple[int, int, int], affine: np.ndarray, path: str, width: int | None = None, overwrite: bool = False) -> None:
    """One scan's column as an image, of four dimensions where it holds arrays of `width`; one image is bounded by its grid."""
    from lumivox.sinks.fits import grid

    write_file(with_suffix(path), nifti.encode(grid(df, value, shape, width), affine), overwrite)
