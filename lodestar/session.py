"""Session helpers: durable lineage cuts and exact global ranks."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once per application: tasks that call its functions need no installation there."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestar_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="lodestar-ship-")) / "lodestar_package.zip"     # read by the driver only, Spark sends it on
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(path))
    sc._lodestar_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; pick one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        path = tempfile.mkdtemp(prefix="lodestar-checkpoint-")
    sc.setCheckpointDir(path)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor never restarts the loop."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Later plans prune its columns, know its size, and never recompute what is above it."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_count(sizes: DataFrame, work: Column) -> int:
    """Tasks for a join whose work is its output: Spark sizes tasks by the bytes they read, so rows that are few and small but meet
    many others would all come to one or two. ``work`` is the part of a task a row of ``sizes`` makes; one number reaches the driver."""
    return 1 + int(sizes.agg(F.sum(work)).first()[0] or 0)


def spread(df: DataFrame, key: str, rows: int = 1 << 13) -> DataFrame:
    """The same rows in tasks of about ``rows``, by a hash of ``key``: for costly work on each row of a table that lies in few pieces."""
    return df.repartition(task_count(df, F.lit(1 / rows)), key)


def with_global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1-based rank over the whole table without a single-task window.

    Rows are range-partitioned on the full (unique) order and checkpointed, then each partition is
    ranked on its own and shifted by the row count of the partitions before it.
    """
    parts = durable(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    # one row per partition: this window is bounded by the partition count
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = (parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
               .select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    rank = F.row_number().over(W.partitionBy("_pid").orderBy(*order)) + F.col("_off")
    return parts.join(offsets, "_pid").withColumn(name, rank.cast("long")).drop("_pid", "_off")
