"""Shared helpers: tables, the cluster's shared folder, hashing rules and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conf(spark: SparkSession, key: str) -> str | None:
    """A setting of the session, None where it is unset and has no default."""
    try:
        return spark.conf.get(key)
    except Exception as e:
        if "SQL_CONF_NOT_FOUND" in str(e) or "NoSuchElement" in str(e):
            return None
        raise


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Only where that is unset and everything runs on one machine, as in tests, a
    folder of our own is made and handed to the context for checkpoint().
    """
    named = conf(spark, "spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="lumivox-")
        spark.sparkContext.setCheckpointDir(_OWN_DIRS[app])
    return _OWN_DIRS[app]


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumivox/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables made by `written` once nothing will read them, nor anything that a lost task would have to make again."""
    for t in tables:
        if t is not None and (path := getattr(t, "scratch_path", None)):
            context = t.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bounds the bytes of an Arrow batch for operators on whole texts, so that long texts fit a worker; short rows stay many to a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf(spark, key) or "")
    if not (now.removesuffix("b").isdigit() and 0 < int(now.removesuffix("b")) <= most):
        spark.conf.set(key, str(most))


def held_out(doc_id, modulus: int, remainder: int):
    """True where crc32 of the id as text leaves the remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", "a"))).first())


def _with_least(edges: DataFrame, key: str, other: str, salts: int) -> DataFrame:
    """Adds m, the least node among key and its neighbours; hub rows are spread by a salt of the other end."""
    least = edges.groupBy(key).agg(F.least(F.min(other), F.col(key)).alias("m"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # hinted, as Spark's size of `least` leaves out its salts
    return edges.withColumn("salt", F.pmod(F.hash(other), F.lit(salts))).join(least.hint("merge"), [key, "salt"]).drop("salt")


def components(edges: DataFrame, name: str, salts: int = 8, rounds: int = 60) -> DataFrame:
    """Connected components of the graph with edges (a, b), two longs that differ.

    Alternating large-star and small-star rounds; each round is written to the
    shared folder, so lineage stays short and no task holds a hub's neighbours.
    Returns (node, root) for every node with an edge; root is the component's
    least node. An empty edge table gives an empty result.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    before = _signature(e)
    if not before[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, "a", "b", salts).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), f"{name}-large")
        star = _with_least(large, "a", "b", salts)
        star = star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(star.select("a", F.col("m").alias("b")))
        before_, e = e, written(star.where("a <> b").distinct(), f"{name}-small")
        discard(before_, large)
        now = _signature(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def filesystem(path: str):
    """pyarrow's file system for a folder that all machines share, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)
