"""A deterministic scan made from the `embeddings` table, and the same one in DuckDB's SQL.

Voxels: x = vec_id % 10, y = vec_id div 10 % 10, z = vec_id div 100; 64 volumes,
every eighth without weighting, the others on three shells along a golden-angle
spiral. The label sets a baseline, the embedding modulates it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_VOL, GOLDEN, SCAN = 64, 2.399963229728653, "virtual"


def gradient(spark: SparkSession) -> DataFrame:
    """scan_id, vol, bval, gx, gy, gz: one row per volume."""
    v = F.col("vol")
    gz = 1 - 2 * (v + 0.5) / N_VOL
    r = F.sqrt(1 - gz * gz)
    g = spark.range(N_VOL).select(F.col("id").cast("int").alias("vol"))
    return g.select(
        F.lit(SCAN).alias("scan_id"), "vol",
        F.when(v % 8 == 0, 0.0).otherwise(1000.0 * (1 + v % 3)).alias("bval"),
        (r * F.cos(v * GOLDEN)).alias("gx"), (r * F.sin(v * GOLDEN)).alias("gy"), gz.alias("gz"),
    )


def table_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_id, vol, bval, gx, gy, gz: each run of 64 vectors is a scan's table, with directions from their first three numbers and shells by label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", *[F.get("embedding", F.lit(k)).cast("double").alias(f"e{k}") for k in range(3)])
    size = F.sqrt(F.col("e0") * F.col("e0") + F.col("e1") * F.col("e1") + F.col("e2") * F.col("e2"))
    g = e.withColumn("size", size).where("size > 0")
    return g.select(F.floor(F.col("vec_id") / N_VOL).cast("string").alias("scan_id"), (F.col("vec_id") % N_VOL).cast("int").alias("vol"), (1000.0 * (F.col("label") % 4)).alias("bval"), *[(F.col(f"e{k}") / F.col("size")).alias(f"g{a}") for k, a in enumerate("xyz")])


#: The same for DuckDB, after SQL: tg.
TABLES_SQL = f""", te AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1, CAST(embedding[3] AS DOUBLE) AS e2 FROM embeddings),
ts AS (SELECT *, sqrt(e0 * e0 + e1 * e1 + e2 * e2) AS size FROM te),
tg AS (SELECT CAST(vec_id // {N_VOL} AS VARCHAR) AS scan_id, CAST(vec_id % {N_VOL} AS INTEGER) AS vol, 1000.0::DOUBLE * (label % 4) AS bval, e0 / size AS gx, e1 / size AS gy, e2 / size AS gz FROM ts WHERE size > 0)
"""


def gradient_arrays() -> tuple[np.ndarray, np.ndarray]:
    """bvals and unit directions, as gradient() has them."""
    v = np.arange(N_VOL)
    gz = 1 - 2 * (v + 0.5) / N_VOL
    r = np.sqrt(1 - gz * gz)
    return np.where(v % 8 == 0, 0.0, 1000.0 * (1 + v % 3)), np.stack([r * np.cos(v * GOLDEN), r * np.sin(v * GOLDEN), gz], axis=1)


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_id, x, y, z, label, in_mask (label not 0), signal: one row per voxel."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    decay = lambda v: F.when(v % 8 == 0, 1.0).otherwise(F.when(v % 3 == 0, 0.5).when(v % 3 == 1, 0.25).otherwise(0.125))
    base = 1000.0 * (0.5 + F.col("label") / 10)
    signal = F.transform("embedding", lambda m, v: base * decay(v) * (1 + 0.5 * m.cast("double")))
    i = F.col("vec_id")
    return e.select(
        F.lit(SCAN).alias("scan_id"), (i % 10).cast("int").alias("x"), (F.floor(i / 10) % 10).cast("int").alias("y"), F.floor(i / 100).cast("int").alias("z"),
        "label", (F.col("label") != 0).alias("in_mask"), signal.alias("signal"),
    )


#: CTEs g (gradient), v (voxels) and long (a row per voxel and volume) for the SQL beside each query.
SQL = f"""WITH g AS (SELECT CAST(i AS INTEGER) AS vol, CASE WHEN i % 8 = 0 THEN 0.0 ELSE 1000.0 * (1 + i % 3) END::DOUBLE AS bval,
  sqrt(1 - (1 - 2 * (i + 0.5::DOUBLE) / {N_VOL}) ** 2) * cos(i * {GOLDEN}::DOUBLE) AS gx, sqrt(1 - (1 - 2 * (i + 0.5::DOUBLE) / {N_VOL}) ** 2) * sin(i * {GOLDEN}::DOUBLE) AS gy,
  1 - 2 * (i + 0.5::DOUBLE) / {N_VOL} AS gz FROM range({N_VOL}) t(i)),
e AS (SELECT vec_id, label, embedding, unnest(range({N_VOL})) AS i FROM embeddings),
long AS (SELECT CAST(vec_id % 10 AS INTEGER) AS x, CAST(vec_id // 10 % 10 AS INTEGER) AS y, CAST(vec_id // 100 AS INTEGER) AS z, label, label <> 0 AS in_mask, CAST(i AS INTEGER) AS vol,
  1000.0::DOUBLE * (0.5::DOUBLE + label / 10.0::DOUBLE) * CASE WHEN i % 8 = 0 THEN 1 WHEN i % 3 = 0 THEN 0.5 WHEN i % 3 = 1 THEN 0.25 ELSE 0.125 END::DOUBLE * (1 + 0.5::DOUBLE * CAST(embedding[i + 1] AS DOUBLE)) AS s FROM e),
v AS (SELECT x, y, z, label, in_mask, list(s ORDER BY vol) AS signal FROM long GROUP BY ALL)
"""
