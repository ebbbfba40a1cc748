"""Raw chart answers (one JSON document per row) as closes, dividends and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SCHEMA = """struct<meta:struct<currency:string,gmtoffset:bigint,regularMarketTime:bigint,regularMarketPrice:double>,
timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>>>>,
events:struct<dividends:map<string,struct<date:bigint,amount:double>>,splits:map<string,struct<date:bigint,numerator:double,denominator:double>>>>"""


def local_date(ts: Column, offset: Column) -> Column:
    """Trading date at the exchange."""
    return F.date_from_unix_date(F.floor((ts + F.coalesce(offset, F.lit(0))) / 86400).cast("int"))


def parse(raw: DataFrame, key: str = "asset") -> DataFrame:
    return raw.select(key, F.from_json("json", SCHEMA.replace("\n", "")).alias("j"))


def closes(parsed: DataFrame, key: str = "asset") -> DataFrame:
    """Positive closes per local date, the last bar of a date wins.

    An empty last bar takes the market price when that is from the same local day."""
    bars = parsed.select(key, F.col("j.meta").alias("m"), F.size("j.timestamp").alias("n"),
                         F.posexplode(F.arrays_zip(F.col("j.timestamp").alias("ts"), F.col("j.indicators.quote")[0]["close"].alias("c"))).alias("i", "b"))
    day = local_date(F.col("b.ts"), F.col("m.gmtoffset"))
    live = (F.col("i") == F.col("n") - 1) & F.col("b.c").isNull() & (local_date(F.col("m.regularMarketTime"), F.col("m.gmtoffset")) == day)
    close = F.when(live, F.col("m.regularMarketPrice")).otherwise(F.col("b.c"))
    return (bars.select(key, day.alias("date"), F.col("i"), close.alias("close")).where(F.col("close") > 0)
            .groupBy(key, "date").agg(F.max_by("close", "i").alias("close")))


def dividends(parsed: DataFrame, key: str = "asset") -> DataFrame:
    d = parsed.select(key, F.col("j.meta.gmtoffset").alias("off"), F.explode(F.map_values("j.events.dividends")).alias("d"))
    return d.where(F.col("d.amount") != 0).select(key, local_date(F.col("d.date"), F.col("off")).alias("date"), F.col("d.amount").alias("amount"))


def splits(parsed: DataFrame, key: str = "asset") -> DataFrame:
    s = parsed.select(key, F.col("j.meta.gmtoffset").alias("off"), F.explode(F.map_values("j.events.splits")).alias("s"))
    one = F.lit(1.0)
    part = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, one).otherwise(F.col(c))
    return s.select(key, local_date(F.col("s.date"), F.col("off")).alias("date"), (part("s.numerator") / part("s.denominator")).alias("ratio"))
