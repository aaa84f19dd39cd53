"""Scans that arrive as files: each micro-batch becomes voxel rows and one report row per scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lumivox.operators import qc
from lumivox.sources.schemas import VOXEL


def watch(spark: SparkSession, folder: str, gradient: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Reads new Parquet files of voxel rows in `folder` and appends neighbour correlations by scan to `out`.

    A scan must arrive within one micro-batch. Written by batch number, so a
    batch that is run again replaces what it wrote.
    """

    def report(batch: DataFrame, number: int) -> None:
        qc.ndc(batch.where("in_mask"), gradient).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(VOXEL).parquet(folder).writeStream.foreachBatch(report).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
