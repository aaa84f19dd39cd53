"""NIfTI-1 images as voxel rows, and back.

Files are found and read by Spark's binaryFile source, so any store that Spark
reads will do; each file is decoded in the task that has it, and its voxels
leave in batches of planes. One image is one row of the source: images up to
what binaryFile can carry (2 GB packed) are supported.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.operators.voxel import KEY
from lumivox.sources.schemas import VOXEL

#: Data type codes of the format.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


@dataclass
class Image:
    """data: x, y, z and, for series, volume; scaled to floats."""

    data: np.ndarray
    affine: np.ndarray
    warnings: list[str]


def decode(raw: bytes, data: bool = True) -> Image:
    """An image from a file's bytes, packed by gzip or not."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw) if data else zlib.decompressobj(31).decompress(raw, 352)
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", raw[:4])[0] != 348 or raw[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack(order + "8h", raw[40:56])
    code = struct.unpack(order + "h", raw[70:72])[0]
    if code not in TYPES or not 3 <= dim[0] <= 4:
        raise ValueError(f"data type {code} with {dim[0]} dimensions isn't supported")
    pixdim = struct.unpack(order + "8f", raw[76:108])
    offset, slope, inter = struct.unpack(order + "3f", raw[108:120])
    shape = dim[1 : dim[0] + 1]
    affine, warnings = _affine(raw, order, pixdim)
    values = np.broadcast_to(np.float32(0), shape)
    if data:
        stored = np.frombuffer(raw, np.dtype(order + TYPES[code]), count=int(np.prod(shape)), offset=int(offset)).reshape(shape, order="F")
        scaled = np.isfinite(slope) and slope not in (0, 1) or inter not in (0,) and slope != 0
        values = (stored * np.float64(slope) + inter if scaled else stored).astype(np.float32)
    return Image(values, affine, warnings)


def _affine(raw: bytes, order: str, pixdim: tuple) -> tuple[np.ndarray, list[str]]:
    qcode, scode = struct.unpack(order + "2h", raw[252:256])
    sform = np.vstack([np.array(struct.unpack(order + "12f", raw[280:328])).reshape(3, 4), [0, 0, 0, 1]])
    b, c, d, *at = struct.unpack(order + "6f", raw[256:280])
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
    qform = np.eye(4)
    qform[:3, :3] = r * np.array([pixdim[1], pixdim[2], pixdim[3] * (-1 if pixdim[0] < 0 else 1)])
    qform[:3, 3] = at
    out = sform if scode > 0 else qform if qcode > 0 else np.diag([*pixdim[1:4], 1.0])
    warnings = []
    if scode > 0 and qcode > 0 and np.abs(sform - qform).max() > 1e-3:
        warnings.append("the two transforms of the header differ")
    size = np.linalg.norm(out[:3, :3], axis=0)
    if np.abs(size - np.abs(pixdim[1:4])).max() > 1e-3:
        warnings.append("voxel sizes and transform differ")
    tilt = np.degrees(np.arccos(np.clip(np.abs(out[:3, :3] / np.where(size > 0, size, 1)).max(axis=0), -1, 1))).max()
    if tilt > 0.1:
        warnings.append(f"oblique by {tilt:.1f} degrees")
    return out, warnings


def quaternion(affine: np.ndarray) -> tuple[np.ndarray, float]:
    """b, c, d and the sign of the third axis, for any rotation, turned by half or left-handed ones too."""
    a = affine[:3, :3] / np.linalg.norm(affine[:3, :3], axis=0)
    u, _, v = np.linalg.svd(a)
    r = u @ v
    sign = 1.0 if np.linalg.det(r) > 0 else -1.0
    r[:, 2] *= sign
    k = np.array([[r[0, 0] - r[1, 1] - r[2, 2], 0, 0, 0], [r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], 0, 0], [r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1], 0], [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], np.trace(r)]])
    q = np.linalg.eigh((k + np.tril(k, -1).T) / 3)[1][:, -1]
    q = q if q[3] >= 0 else -q
    return q[:3], sign


def encode(data: np.ndarray, affine: np.ndarray) -> bytes:
    """A single-precision NIfTI-1 file, packed by gzip."""
    h = bytearray(352)
    size, (q, sign) = np.linalg.norm(affine[:3, :3], axis=0), quaternion(affine)
    struct.pack_into("<i", h, 0, 348)
    struct.pack_into("<8h", h, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<2h", h, 70, 16, 32)
    struct.pack_into("<8f", h, 76, sign, *size, *[1] * 4)
    struct.pack_into("<3f", h, 108, 352, 1, 0)
    struct.pack_into("<2h", h, 252, 1, 1)
    struct.pack_into("<6f", h, 256, *q, *affine[:3, 3])
    struct.pack_into("<12f", h, 280, *affine[:3].ravel())
    h[123] = 10
    h[344:348] = b"n+1\0"
    return gzip.compress(bytes(h) + np.asarray(data, dtype="<f4").tobytes(order="F"), 6)


def check_same_grid(shape: tuple, affine: np.ndarray, other_shape: tuple, other_affine: np.ndarray, tolerance: float = 1e-3) -> None:
    if tuple(shape[:3]) != tuple(other_shape[:3]) or np.abs(np.asarray(affine) - np.asarray(other_affine)).max() > tolerance:
        raise ValueError("the images aren't on the same grid")


def read_voxels(spark: SparkSession, path: str, mask: str | None = None) -> DataFrame:
    """Voxel rows of the series at `path` (a file, folder or pattern); scan_id is the file's name without suffix.

    A mask is a three-dimensional image of the same name in the folder `mask`,
    true above 0; without one all voxels are in the mask.
    """
    name = F.regexp_extract(F.col("path"), r"([^/]+?)\.nii(?:\.gz)?$", 1)
    series = spark.read.format("binaryFile").load(path).select(name.alias("scan_id"), "content")
    masks = spark.read.format("binaryFile").load(mask).select(name.alias("scan_id"), F.col("content").alias("mask")) if mask else None
    both = series.join(masks, "scan_id", "left") if masks is not None else series.withColumn("mask", F.lit(None).cast("binary"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for scan, content, m in zip(b["scan_id"], b["content"], b["mask"]):
                image = decode(content)
                data = image.data if image.data.ndim == 4 else image.data[..., None]
                inside = np.ones(data.shape[:3], bool)
                if m is not None:
                    other = decode(m)
                    if other.data.ndim != 3:
                        raise ValueError("a mask has three dimensions")
                    check_same_grid(data.shape, image.affine, other.data.shape, other.affine)
                    inside = other.data > 0
                for x in range(data.shape[0]):
                    y, z = np.indices(data.shape[1:3]).reshape(2, -1)
                    yield pd.DataFrame({"scan_id": scan, "x": np.int32(x), "y": y.astype(np.int32), "z": z.astype(np.int32), "in_mask": inside[x].ravel(), "signal": list(data[x].reshape(-1, data.shape[3]))})

    return both.mapInPandas(run, VOXEL)


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """scan_id, nx, ny, nz, n_vol, affine, warnings of each file, from its header."""
    name = F.regexp_extract(F.col("path"), r"([^/]+?)\.nii(?:\.gz)?$", 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for scan, content in zip(b["scan_id"], b["content"]):
                i = decode(content, data=False)
                s = i.data.shape
                yield pd.DataFrame({"scan_id": [scan], "nx": [s[0]], "ny": [s[1]], "nz": [s[2]], "n_vol": [s[3] if len(s) > 3 else 1], "affine": [i.affine.tolist()], "warnings": [i.warnings]})

    schema = "scan_id string, nx int, ny int, nz int, n_vol int, affine array<array<double>>, warnings array<string>"
    return spark.read.format("binaryFile").load(path).select(name.alias("scan_id"), "content").mapInPandas(run, schema)


def with_graddev(voxels: DataFrame, series: str, path: str, holds_identity: bool | None = None) -> DataFrame:
    """Adds `graddev`, row by row the nine entries of what a gradient becomes at each voxel, from images of nine volumes named as the series.

    Fields hold the deviation alone or the identity too; where that isn't told, a field whose diagonals are nearer to 1 than to 0
    on average holds it. Another grid than the series' is an error; voxels without a field keep the identity.
    """
    spark = voxels.sparkSession
    if read_scans(spark, path).where("n_vol <> 9").limit(1).count():
        raise ValueError("a gradient deviation has nine volumes")
    grid = lambda p, end: read_scans(spark, p).select("scan_id", F.struct("nx", "ny", "nz").alias(f"shape{end}"), F.flatten("affine").alias(f"affine{end}"))
    both = grid(series, "").join(grid(path, "2"), "scan_id")
    far = F.array_max(F.zip_with("affine", "affine2", lambda a, b: F.abs(a - b))) > 1e-3
    if both.where(far | (F.col("shape") != F.col("shape2"))).limit(1).count():
        raise ValueError("the gradient deviation isn't on the series' grid")
    field = read_voxels(spark, path).select(*KEY, F.col("signal").cast("array<double>").alias("t"))
    eye = F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)])
    whole = F.lit(holds_identity) if holds_identity is not None else F.col("mean") > 0.5
    mean = field.groupBy("scan_id").agg(F.avg((F.get("t", F.lit(0)) + F.get("t", F.lit(4)) + F.get("t", F.lit(8))) / 3).alias("mean"))
    field = field.join(mean, "scan_id").select(*KEY, F.when(whole, F.col("t")).otherwise(F.zip_with("t", eye, lambda a, b: a + b)).alias("_t"))
    return voxels.join(field, KEY, "left").withColumn("graddev", F.coalesce("_t", eye)).drop("_t")
