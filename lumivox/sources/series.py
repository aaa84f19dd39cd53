"""NIfTI series read by byte ranges, as a data source of Spark.

A plain file is cut into ranges of image rows: a task reads the bytes of its rows from each volume and leaves whole voxels, so
nothing is shuffled. A file packed by gzip can only be read from its start: one task inflates it and leaves each volume's rows as
blocks, which meet again by range. Neither holds more than a block. Files are read by pyarrow's file systems (file, hdfs, s3, gcs);
nifti.read_voxels() is for stores that only Spark reads.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumivox.functions.storage import filesystem
from lumivox.sources import nifti
from lumivox.sources.schemas import VOXEL

BLOCK = "scan_id string, first int, vol int, nx int, ny int, n_vol int, values binary"
HEADER = 352


@dataclass
class Layout:
    """Where a file's numbers are: shape with its volumes, type, first byte, scale."""

    name: str
    path: str
    packed: bool
    shape: tuple[int, int, int, int]
    affine: np.ndarray
    dtype: str
    offset: int
    slope: float
    inter: float

    def rows_of(self, block_bytes: int) -> int:
        """Image rows of which all volumes are a block, one at least."""
        return max(1, block_bytes // (self.shape[0] * self.shape[3] * (np.dtype(self.dtype).itemsize + 8)))

    def scaled(self, raw: bytes) -> np.ndarray:
        stored = np.frombuffer(raw, self.dtype)
        plain = not np.isfinite(self.slope) or self.slope == 0 or (self.slope == 1 and self.inter == 0)
        return (stored if plain else stored * np.float64(self.slope) + self.inter).astype("<f4")


def scan_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".nii")


def open_stream(path: str):
    """The file from its start, inflated where it is packed."""
    fs, at = filesystem(path)
    return fs.open_input_stream(at, compression="gzip" if is_packed(path) else None)


def is_packed(path: str) -> bool:
    fs, at = filesystem(path)
    with fs.open_input_stream(at, compression=None) as f:
        return f.read(2) == b"\x1f\x8b"


def layout(path: str) -> Layout:
    """From the first bytes of a file."""
    with open_stream(path) as f:
        raw = f.read(HEADER)
    head = nifti.decode(raw, data=False)
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dtype = order + nifti.TYPES[struct.unpack(order + "h", raw[70:72])[0]]
    offset, slope, inter = struct.unpack(order + "3f", raw[108:120])
    shape = tuple(int(n) for n in head.data.shape)
    return Layout(scan_name(path), path, is_packed(path), shape if len(shape) == 4 else (*shape, 1), head.affine, dtype, int(offset), slope, inter)


def files(path: str) -> dict[str, str]:
    """By name the images at a path, a file or a folder."""
    from pyarrow import fs as pafs

    fs, at = filesystem(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return {scan_name(path): path}
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.File and f.base_name.endswith((".nii", ".nii.gz"))]
    return {scan_name(p): f"{path.rstrip('/')}/{p.rsplit('/', 1)[-1]}" for p in sorted(found)}


@dataclass
class Rows(InputPartition):
    """Image rows [first, last) of a plain file, or, without `last`, a whole packed one; mask: the file of that."""

    of: Layout
    first: int
    last: int | None
    mask: str | None
    step: int


def inside_of(mask: str | None, of: Layout, ranges: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    """Which voxels of each range of image rows, in their order, are in the mask; one range's bytes are held at a time."""
    nx = of.shape[0]
    if mask is None:
        yield from (np.ones((last - first) * nx, bool) for first, last in ranges)
        return
    m = layout(mask)
    if m.shape[3] != 1:
        raise ValueError("a mask has three dimensions")
    nifti.check_same_grid(of.shape, of.affine, m.shape, m.affine)
    size = np.dtype(m.dtype).itemsize
    with open_stream(mask) as f:
        skip(f, m.offset + ranges[0][0] * nx * size)
        for first, last in ranges:
            yield m.scaled(whole(f, (last - first) * nx * size)) > 0


def skip(f, n: int, at_most: int = 1 << 20) -> None:
    while n > 0:
        n -= len(whole(f, min(n, at_most)))


def whole(f, n: int) -> bytes:
    raw = f.read(n)
    if len(raw) < n:
        raise ValueError(f"the file ends {n - len(raw)} bytes too early")
    return raw


def voxel_batch(of_name: str, nx: int, ny: int, first: int, signal: np.ndarray, inside: np.ndarray) -> pa.RecordBatch:
    """Voxel rows of image rows from `first` on; signal: voxels by volumes."""
    n, vols = signal.shape
    place = first * nx + np.arange(n)
    offsets = pa.array(np.arange(n + 1, dtype=np.int64) * vols, pa.int32())
    columns = [pa.array([of_name] * n), *(pa.array(a.astype(np.int32)) for a in (place % nx, place // nx % ny, place // (nx * ny))), pa.array(inside), pa.ListArray.from_arrays(offsets, pa.array(signal.ravel(), pa.float32()))]
    return pa.RecordBatch.from_arrays(columns, ["scan_id", "x", "y", "z", "in_mask", "signal"])


class SeriesReader(DataSourceReader):
    def __init__(self, options: dict, packed: bool):
        self.block = int(options.get("blockbytes", 32 << 20))
        self.packed = packed
        self.paths = files(options["path"])
        self.masks = files(options["mask"]) if options.get("mask") else {}

    def partitions(self) -> list[Rows]:
        out = []
        for name, path in self.paths.items():
            of = layout(path)
            if of.packed != self.packed:
                continue
            step, rows = of.rows_of(self.block), of.shape[1] * of.shape[2]
            starts = [0] if self.packed else range(0, rows, step)
            out += [Rows(of, k, None if self.packed else min(rows, k + step), self.masks.get(name), step) for k in starts]
        return out or [Rows(None, 0, 0, None, 1)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.of is not None:
            yield from blocks(part) if self.packed else voxels(part)


def voxels(part: Rows) -> Iterator[pa.RecordBatch]:
    """The rows' bytes of each volume, put side by side."""
    of = part.of
    nx, ny, nz, n_vol = of.shape
    size, n = np.dtype(of.dtype).itemsize, (part.last - part.first) * nx
    signal = np.empty((n, n_vol), np.float32)
    fs, at = filesystem(of.path)
    with fs.open_input_file(at) as f:
        for v in range(n_vol):
            f.seek(of.offset + (v * nx * ny * nz + part.first * nx) * size)
            signal[:, v] = of.scaled(whole(f, n * size))
    yield voxel_batch(of.name, nx, ny, part.first, signal, next(inside_of(part.mask, of, [(part.first, part.last)])))


def blocks(part: Rows) -> Iterator[pa.RecordBatch]:
    """A packed file from start to end: of each volume the rows of each block, and those of the mask as volume -1."""
    of = part.of
    nx, ny, nz, n_vol = of.shape
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def block(first: int, vol: int, values: bytes) -> pa.RecordBatch:
        row = [[of.name], [first], [vol], [nx], [ny], [n_vol], [values]]
        kinds = [pa.string(), *[pa.int32()] * 5, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)

    starts = [(k, min(ny * nz, k + part.step)) for k in range(0, ny * nz, part.step)]
    if part.mask is not None:
        for (a, _), inside in zip(starts, inside_of(part.mask, of, starts)):
            yield block(a, -1, np.packbits(inside).tobytes())
    size = np.dtype(of.dtype).itemsize
    with open_stream(of.path) as f:
        skip(f, of.offset)
        for v in range(n_vol):
            for a, b in starts:
                yield block(a, v, of.scaled(whole(f, (b - a) * nx * size)).tobytes())


class PlainSeries(DataSource):
    """Voxel rows of plain files; options: path, mask, blockBytes."""

    @classmethod
    def name(cls) -> str:
        return "lumivox_series"

    def schema(self) -> str:
        return VOXEL

    def reader(self, schema) -> SeriesReader:
        return SeriesReader(self.options, False)


class PackedSeries(PlainSeries):
    """Blocks of packed files."""

    @classmethod
    def name(cls) -> str:
        return "lumivox_series_blocks"

    def schema(self) -> str:
        return BLOCK

    def reader(self, schema) -> SeriesReader:
        return SeriesReader(self.options, True)


def _voxels_of(rows: pd.DataFrame) -> pd.DataFrame:
    """Voxel rows of one range, from its blocks of all volumes."""
    nx, ny, n_vol = (int(rows[c].iloc[0]) for c in ("nx", "ny", "n_vol"))
    own = rows[rows["vol"] >= 0]
    signal = np.empty((len(own["values"].iloc[0]) // 4, n_vol), np.float32)
    for v, raw in zip(own["vol"], own["values"]):
        signal[:, v] = np.frombuffer(raw, "<f4")
    mask = rows.loc[rows["vol"] < 0, "values"]
    inside = np.unpackbits(np.frombuffer(mask.iloc[0], np.uint8), count=len(signal)).astype(bool) if len(mask) else np.ones(len(signal), bool)
    return voxel_batch(rows["scan_id"].iloc[0], nx, ny, int(rows["first"].iloc[0]), signal, inside).to_pandas()


def read_series(spark: SparkSession, path: str, mask: str | None = None, block_bytes: int = 32 << 20) -> DataFrame:
    """Voxel rows of the series at `path`, a file or a folder; the same as nifti.read_voxels() gives, with memory bounded by block_bytes.

    mask: a three-dimensional image of the same name, or a folder of such, true above 0.
    """
    for source in (PlainSeries, PackedSeries):
        spark.dataSource.register(source)
    kinds = {is_packed(p) for p in files(path).values()}
    if not kinds:
        raise FileNotFoundError(f"no series in {path}")
    options = {"blockBytes": str(block_bytes)} | ({"mask": mask} if mask else {})
    plain = spark.read.format(PlainSeries.name()).options(**options).load(path) if False in kinds else None
    if True not in kinds:
        return plain
    found = spark.read.format(PackedSeries.name()).options(**options).load(path)
    packed = found.groupBy("scan_id", "first").applyInPandas(_voxels_of, VOXEL)  # a range has block_bytes at most
    return packed if plain is None else plain.union(packed)
