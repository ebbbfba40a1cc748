"""As-of joins. Prices are (asset, date, close) with at most one row per asset and day, so a window per
asset or per currency is bounded by the number of calendar days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lodestar.functions.fixed_values import BASE_CURRENCY, SUBUNITS
from lodestar.params import DEFAULTS, Params


def daily_fill(series: DataFrame, keys: list[str], until) -> DataFrame:
    """Repeat each (keys, date) row for every calendar day until the next one, the last one to ``until``."""
    order = W.partitionBy(*keys).orderBy("date")
    stop = F.coalesce(F.date_sub("_next", 1), F.greatest(F.col("date"), until))
    return (series.withColumn("_next", F.lead("date").over(order)).withColumn("_to", stop)
            .withColumn("date", F.explode(F.sequence("date", "_to"))).drop("_next", "_to"))


def asof_backward(prices: DataFrame, fx: DataFrame, value: str = "close", until=None) -> DataFrame:
    """Value times the last rate on or before the date. The base currency passes through; rows before the
    first rate and unknown currencies give nothing.

    Rates are filled to one row per currency and day, so the join is an equi-join on (currency, date): a
    currency that holds a third of the prices is still spread over its days.
    """
    until = prices.agg(F.max("date")).scalar() if until is None else until
    rates = daily_fill(fx.select("currency", "date", "rate"), ["currency"], until)
    joined = prices.join(rates, ["currency", "date"], "left")
    rate = F.when(F.col("currency") == BASE_CURRENCY, 1.0).otherwise(F.col("rate"))
    return joined.withColumn(value, F.col(value) * rate).drop("rate").where(F.col(value).isNotNull())


def subunit_map_join(df: DataFrame, col: str = "currency") -> DataFrame:
    """Pence-style quote units -> main currency and factor."""
    unit = F.create_map(*[F.lit(x) for k, (cur, _) in SUBUNITS.items() for x in (k, cur)])
    factor = F.create_map(*[F.lit(x) for k, (_, f) in SUBUNITS.items() for x in (k, f)])
    return (df.withColumn("factor", F.coalesce(F.try_element_at(factor, F.col(col)), F.lit(1.0)))
            .withColumn(col, F.coalesce(F.try_element_at(unit, F.col(col)), F.col(col))))


def with_dividends(closes: DataFrame, divs: DataFrame) -> DataFrame:
    """Closes with the dividend amount that counts on each trading day (null when none).

    Closes and daily dividend sums go through one window per asset: every row finds the first trading day
    on or after its date, and one aggregate on the same partitioning puts the amounts there."""
    daily = divs.groupBy("asset", "date").agg(F.sum("amount").alias("amount"))
    rows = (closes.select("asset", "date", "close", F.col("date").alias("trade_date"))
            .unionByName(daily, allowMissingColumns=True))
    # newest first: a growing frame, one pass per asset
    ahead = W.partitionBy("asset").orderBy(F.col("date").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    return (rows.withColumn("trade_date", F.min("trade_date").over(ahead)).where(F.col("trade_date").isNotNull())
            .groupBy("asset", F.col("trade_date").alias("date"))
            .agg(F.max("close").alias("close"), F.sum("amount").alias("amount")))


def asof_forward(closes: DataFrame, divs: DataFrame) -> DataFrame:
    """Dividend amount per trading day: an ex-date without a close counts on the next trading day, amounts
    of one day add up, dividends after the last close are dropped."""
    return with_dividends(closes, divs).where(F.col("amount").isNotNull()).drop("close")


def price_at(target, gap_days: int):
    """Aggregate: last close on or before ``target``, null when it is more than ``gap_days`` old."""
    hit = F.max_by(F.struct("date", "close"), F.when(F.col("date") <= target, F.col("date")))
    return F.when(F.datediff(target, hit["date"]) <= gap_days, hit["close"])


def asof_tolerance(prices: DataFrame, as_of, p: Params = DEFAULTS) -> DataFrame:
    """Annualised returns over whole calendar years ending at ``as_of``; one aggregate pass per asset."""
    end = price_at(as_of, p.gap_days)
    cols = [F.round(F.pow(end / price_at(F.add_months(as_of, -12 * y), p.gap_days), F.lit(1.0 / y)) - 1, 5).alias(f"r{y}")
            for y in p.periods]
    out = prices.where(F.col("date") <= as_of).groupBy("asset").agg(*cols)
    return out.where(F.coalesce(*[F.col(f"r{y}") for y in p.periods]).isNotNull())


def trailing_day_returns(prices: DataFrame, as_of, days: list[int], p: Params = DEFAULTS) -> DataFrame:
    """Cumulative percent return over calendar days back from the last close (at most ``gap_days`` old)."""
    ends = (prices.where(F.col("date") <= as_of).groupBy("asset")
            .agg(F.max("date").alias("end_date"), F.max_by("close", "date").alias("end_close"))
            .where(F.datediff(as_of, "end_date") <= p.gap_days))
    hist = prices.join(ends, "asset").where(F.col("date") <= F.col("end_date"))
    aggs = []
    for d in days:
        target = F.date_sub(F.col("end_date"), d)
        base = F.max_by("close", F.when(F.col("date").between(F.date_sub(target, p.gap_days), target), F.col("date")))
        aggs.append(((F.max("end_close") / base - 1) * 100).alias(f"d{d}"))
    return hist.groupBy("asset").agg(*aggs)
