"""Incremental price updates from a drop folder of fetched closes.

Fetched files overlap what is stored by some days; late and corrected prices therefore arrive as ordinary rows
that replace the stored ones from the first fetched date on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators.incremental import changed_partitions, refetch_cuts, upsert
from lodestar.session import stored
from lodestar.sources import store
from lodestar.sources.tables import drop_years, read_store, write_store

SCHEMA = "asset string, date date, close double, is_full boolean"


def touched_years(store: DataFrame, fetched: DataFrame, cuts: DataFrame) -> list[int]:
    """Years a batch can change: those of its own rows, those at or after an asset's cut, and for a full refetch all that
    hold the asset. The calendar bounds the list; without a full refetch only partitions from the first cut on are read."""
    first = cuts.agg(F.min(F.year("cut")).alias("y"), F.max("is_full").alias("full")).first()
    if first["y"] is None:
        return []
    near = store if first["full"] else store.where(F.col("year") >= first["y"])
    hit = near.join(cuts, "asset").where(F.col("is_full") | (F.col("year") >= F.year("cut"))).select("year")
    return sorted(r["year"] for r in hit.union(fetched.select(F.year("date"))).distinct().collect())


def apply_batch(spark: SparkSession, root: str, fetched: DataFrame) -> None:
    """Merge one batch into the store: only years it can change are read, only those that change are written, and years
    that end empty are deleted. A repeated batch changes nothing."""
    cuts = stored(refetch_cuts(fetched))
    years = touched_years(read_store(spark, root), fetched, cuts)
    if not years:
        return
    old = read_store(spark, root).where(F.col("year").isin(years))
    new = stored(upsert(old.drop("year"), fetched, cuts).withColumn("year", F.year("date")))
    changed = stored(changed_partitions(old, new))
    write_store(new.drop("year"), root, changed.where(F.col("status") != "gone"))
    drop_years(spark, root, [r["year"] for r in changed.where(F.col("status") == "gone").collect()])


def run_available(spark: SparkSession, drop_folder: str, root: str, checkpoint: str) -> StreamingQuery:
    """Process every file that has arrived since the last run, then stop."""
    files = spark.readStream.schema(SCHEMA).parquet(drop_folder)
    return (files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda batch, _: apply_batch(spark, root, batch)).start())


#: Rows of a feed of all tables: ``kind`` is close, dividend, fx or rate; ``key`` the asset or currency.
ALL_SCHEMA = "kind string, key string, date date, value double, is_full boolean"


def apply_all(spark: SparkSession, root: str, feed: str, batch: DataFrame, number: int) -> None:
    """Merge one batch of all tables into the versioned store as one version; a batch that is delivered again changes nothing."""
    rows = stored(batch)
    of = lambda kind: rows.where(F.col("kind") == kind)
    name = lambda kind, key, value: of(kind).select(F.col("key").alias(key), "date", F.col("value").alias(value))
    closes = of("close").select(F.col("key").alias("asset"), "date", F.col("value").alias("close"), F.coalesce("is_full", F.lit(False)).alias("is_full"))
    store.apply(spark, root, closes, name("dividend", "asset", "amount"), name("fx", "currency", "rate"), of("rate").select("date", F.col("value").alias("rate")), (feed, number))


def run_all(spark: SparkSession, drop_folder: str, root: str, checkpoint: str, feed: str = "feed") -> StreamingQuery:
    """Process every file of all tables that has arrived since the last run, then stop."""
    files = spark.readStream.schema(ALL_SCHEMA).parquet(drop_folder)
    return (files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda batch, n: apply_all(spark, root, feed, batch, n)).start())
