"""A scan as an object: rows, table and cached products, over the operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.functions import numeric as N
from lumivox.operators import decon, models, qc, tissue
from lumivox.operators import voxel as V
from lumivox.plans import pipelines
from lumivox.sinks import fits
from lumivox.sources import nifti, text
from lumivox.sources.series import files, layout, read_series


@dataclass
class Scan:
    """Voxel rows and the gradient table of one scan."""

    voxels: DataFrame
    bvals: np.ndarray
    directions: np.ndarray
    shape: tuple[int, int, int]
    affine: np.ndarray = field(default_factory=lambda: np.eye(4))

    @classmethod
    def from_files(cls, spark: SparkSession, series: str, bvals: str, bvecs: str | None = None, mask: str | None = None) -> Scan:
        """From a series with b-value and direction files or, without bvecs, a four-column table."""
        meta = layout(next(iter(files(series).values())))
        if bvecs is None:
            b, g = text.parse_table(text.read_text(spark, bvals))
            g = N.rotate_directions(g, np.linalg.inv(N.affine_rotation(meta.affine)))
        else:
            b, g = text.parse_bvals(text.read_text(spark, bvals)), text.parse_bvecs(text.read_text(spark, bvecs))
        if len(b) != meta.shape[3] or len(g) != meta.shape[3]:
            raise ValueError(f"{meta.shape[3]} volumes, {len(b)} b-values, {len(g)} directions")
        scan = cls(read_series(spark, series, mask), b, g, meta.shape[:3], meta.affine)
        return scan if mask else scan.masked_by_b0()

    @classmethod
    def from_array(cls, spark: SparkSession, data: np.ndarray, bvals: np.ndarray, directions: np.ndarray, mask: np.ndarray | None = None, affine: np.ndarray | None = None, scan_id: str = "scan") -> Scan:
        if data.ndim != 4 or data.shape[3] != len(bvals) or len(bvals) != len(directions) or (mask is not None and mask.shape != data.shape[:3]):
            raise ValueError("data, table and mask don't belong together")
        inside = np.ones(data.shape[:3], bool) if mask is None else mask > 0
        spark_planes = [(scan_id, x, np.asarray(data[x], "<f4").tobytes(), inside[x].tobytes()) for x in range(data.shape[0])]  # a plane a row, unpacked in tasks
        ny, nz, n = data.shape[1:]

        def unpack(batches):
            for b in batches:
                for scan, x, values, within in zip(b["scan"], b["x"], b["values"], b["inside"]):
                    y, z = np.indices((ny, nz)).reshape(2, -1)
                    yield pd.DataFrame({"scan_id": scan, "x": np.int32(x), "y": y.astype(np.int32), "z": z.astype(np.int32), "in_mask": np.frombuffer(within, bool), "signal": list(np.frombuffer(values, "<f4").reshape(-1, n))})

        from lumivox.sources.schemas import VOXEL

        planes = spark.createDataFrame(spark_planes, "scan string, x int, values binary, inside binary").repartition(max(1, min(data.shape[0], spark.sparkContext.defaultParallelism)))
        scan = cls(planes.mapInPandas(unpack, VOXEL), np.asarray(bvals, float), np.asarray(directions, float), data.shape[:3], np.eye(4) if affine is None else affine)
        return scan if mask is not None else scan.masked_by_b0()

    def masked_by_b0(self) -> Scan:
        return Scan(V.fallback_mask(self.voxels, self.bvals.tolist()).drop("b0"), self.bvals, self.directions, self.shape, self.affine)

    @cached_property
    def gradient(self) -> DataFrame:
        spark = self.voxels.sparkSession
        table = text.gradient_frame(spark, "", self.bvals, self.directions)
        rows = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in table.columns[1:]]) for r in table.collect()])
        return self.voxels.select("scan_id").distinct().select("scan_id", F.explode(rows).alias("g")).select("scan_id", "g.*")

    @cached_property
    def tensor(self) -> DataFrame:
        return models.fit_tensor(self.voxels, self.bvals, self.directions).persist()

    @property
    def voxel_mm(self) -> tuple[float, float, float]:
        return tuple(V.voxel_size(self.affine.tolist()))

    def report(self, coherence: bool = True) -> DataFrame:
        return qc.assess(self.voxels, self.gradient, self.voxel_mm, self.tensor if coherence else None)

    def input_quality(self) -> DataFrame:
        return qc.input_quality(self.voxels, self.gradient)

    def with_graddev(self, series: str, path: str, holds_identity: bool | None = None) -> Scan:
        return Scan(nifti.with_graddev(self.voxels, series, path, holds_identity), self.bvals, self.directions, self.shape, self.affine)

    def save_fit(self, fit: DataFrame, path: str, o: models.ShoreOptions, overwrite: bool = False) -> None:
        fits.save_fit(fit, path, o, self.affine, self.shape, self.bvals, self.directions, overwrite=overwrite)

    def fit_shore(self, **options) -> DataFrame:
        return models.fit_shore(self.voxels, self.bvals, self.directions, o=models.ShoreOptions(**options))

    def tissue(self, o: tissue.StagedOptions = tissue.StagedOptions()) -> tissue.Selection:
        return tissue.select_staged(self.voxels, self.tensor, N.merge_small_shells(N.shells(self.bvals.tolist(), 100.0)), o)

    def single_shell(self, **kw) -> pipelines.Run:
        return pipelines.single_shell(self.voxels, self.bvals, self.directions, self.shape, **kw)

    def dense(self, o: decon.DenseOptions = decon.DenseOptions(), **kw) -> pipelines.Run:
        return pipelines.dense(self.voxels, self.bvals, self.directions, self.shape, o=o, **kw)
