"""Incremental price, dividend and rate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.params import DEFAULTS, Params


def refetch_cuts(closes: DataFrame) -> DataFrame:
    """Per asset the first fetched date; a full refetch cuts everything."""
    return closes.groupBy("asset").agg(F.min("date").alias("cut"), F.max("is_full").alias("is_full"))


def upsert(stored: DataFrame, fetched: DataFrame, cuts: DataFrame) -> DataFrame:
    """Stored rows before the cut plus all fetched rows. The cut table has one row per fetched asset."""
    kept = (stored.join(cuts, "asset", "left")
            .where(F.col("cut").isNull() | (~F.col("is_full") & (F.col("date") < F.col("cut")))))
    return kept.select(*stored.columns).unionByName(fetched.select(*stored.columns))


def changed_partitions(old: DataFrame, new: DataFrame, partition: str = "year") -> DataFrame:
    """Partitions whose rows differ, appeared or vanished: one fingerprint per partition and side."""
    cols = [c for c in old.columns if c != partition]

    def print_(df: DataFrame, name: str) -> DataFrame:
        h = F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))
        return df.groupBy(partition).agg(F.struct(F.count(F.lit(1)).alias("n"), h.alias("h")).alias(name))

    both = print_(old, "o").join(print_(new, "n"), partition, "full")
    status = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "gone").otherwise("changed")
    return both.where(~F.col("o").eqNullSafe(F.col("n"))).select(partition, status.alias("status"))


def split_refetch_flags(closes: DataFrame, splits: DataFrame) -> DataFrame:
    """Assets with a split dated after their stored history."""
    last = closes.groupBy("asset").agg(F.max("date").alias("last"))
    newest = splits.groupBy("asset").agg(F.max("date").alias("split_date"))
    return last.join(newest, "asset").where(F.col("split_date") > F.col("last")).select("asset", "last", "split_date")


def fx_fetch_start(old: DataFrame, wanted: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """First date to fetch: full history for a new currency, else the last date less a margin."""
    last = old.groupBy("currency").agg(F.max("date").alias("last"))
    start = F.coalesce(F.date_sub("last", p.fx_margin_days), F.lit(p.fx_start).cast("date"))
    return wanted.select("currency").distinct().join(last, "currency", "left").select("currency", start.alias("start"))


def fx_merge(old: DataFrame, new: DataFrame, seq: Column) -> DataFrame:
    """Union of old and new rates; the last row of (date, currency) wins."""
    both = old.select("date", "currency", "rate", F.lit(0).alias("src"), F.lit(0).cast("long").alias("seq")).unionByName(
        new.select("date", "currency", "rate", F.lit(1).alias("src"), seq.cast("long").alias("seq")))
    return both.groupBy("date", "currency").agg(F.max_by("rate", F.struct("src", "seq")).alias("rate"))


def price_meta(closes: DataFrame, failures: DataFrame, today: Column, p: Params = DEFAULTS) -> DataFrame:
    """First and last date and count per asset; failed assets and stale series are not ok."""
    per = closes.groupBy("asset").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n_obs"))
    fresh = F.col("last_date") >= F.date_sub(today, p.max_stale_days)
    good = per.join(failures.select("asset"), "asset", "left_anti").select(
        "*", fresh.alias("ok"), F.when(~fresh, F.concat(F.lit("stale (last "), F.col("last_date").cast("string"), F.lit(")"))).alias("error"))
    return good.unionByName(failures.select("asset", F.lit(False).alias("ok"), "error"), allowMissingColumns=True)


def candidate_history(bars: DataFrame, keys: list[str]) -> DataFrame:
    """First and last date and distinct months per probed ticker."""
    return bars.groupBy(*keys).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                                   F.count_distinct(F.trunc("date", "month")).alias("n_months"))
