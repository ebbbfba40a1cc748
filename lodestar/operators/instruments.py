"""Instrument rows for presentation, name control and share-class checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.functions import fixed_values as fv
from lodestar.functions.classify import classify, name_tokens, normalize_name
from lodestar.functions.scalars import annualise, number
from lodestar.operators.asof import asof_backward, trailing_day_returns
from lodestar.operators.pairs import min_jaccard
from lodestar.operators.predicates import ask_eligible
from lodestar.operators.ranking import cluster_pick, truthy
from lodestar.params import DEFAULTS, Params


def name_control(u: DataFrame, limit: float = 0.2) -> DataFrame:
    """(kind, cluster_id, norm, hedged, value): clusters whose names diverge, and equal names in several clusters."""
    n = u.select("isin", "cluster_id", "hedged", F.array_sort(F.array_distinct(name_tokens(F.col("name")))).alias("tokens"),
                 normalize_name(F.col("name")).alias("norm"))
    several = n.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("tokens") == 0).alias("blank")).where(F.col("n") > 1)
    distinct = n.join(several.select("cluster_id"), "cluster_id", "left_semi").select("cluster_id", "tokens").distinct()
    low = several.join(min_jaccard(distinct, "cluster_id"), "cluster_id", "left")
    value = F.when(F.col("blank") > 1, 0.0).otherwise(F.coalesce("min_similarity", F.lit(1.0)))
    diverge = low.withColumn("value", value).where(F.col("value") < limit).select(
        F.lit("divergent").alias("kind"), F.col("cluster_id").cast("long").alias("cluster_id"), F.lit(None).cast("string").alias("norm"),
        F.lit(None).cast("boolean").alias("hedged"), "value")
    split = (n.where(F.col("norm") != "").groupBy("norm", "hedged").agg(F.count_distinct("cluster_id").cast("double").alias("value"))
             .where(F.col("value") > 1))
    return diverge.unionByName(split.select(F.lit("split").alias("kind"), F.lit(None).cast("long").alias("cluster_id"), "norm", "hedged", "value"))


def share_class_check(closes: DataFrame, fx: DataFrame, rows: DataFrame, end: Column, p: Params = DEFAULTS) -> DataFrame:
    """Returns in the base currency and last price against the published ones.

    ``closes``: asset, currency (main unit), date, close. ``rows``: asset, row_currency, price, yield_1y, yield_3y."""
    days = [365, 3 * 365]
    raw = trailing_day_returns(closes.select("asset", "date", "close"), end, days, p)
    base = asof_backward(closes, fx).select("asset", "date", "close")
    conv = trailing_day_returns(base, end, days, p).select("asset", F.col("d365").alias("b1"), F.col("d1095").alias("b3"))
    known = base.select("asset").distinct().withColumn("has_fx", F.lit(True))
    last = closes.where(F.col("date") <= end).groupBy("asset").agg(F.max_by("close", "date").alias("last"), F.first("currency").alias("currency"))
    j = rows.join(last, "asset", "left").join(raw, "asset", "left").join(conv, "asset", "left").join(known, "asset", "left")
    fxok = F.coalesce("has_fx", F.lit(False))
    j = (j.withColumn("r1", F.when(fxok, F.col("b1")).otherwise(F.col("d365"))).withColumn("r3", F.when(fxok, F.col("b3")).otherwise(F.col("d1095")))
         .withColumn("d1", F.when(fxok, F.col("r1") - F.col("yield_1y"))).withColumn("d3", F.when(fxok, F.col("r3") - F.col("yield_3y"))))
    same = F.col("row_currency").isNull() | (F.col("row_currency") == F.col("currency"))
    j = j.withColumn("price_ratio", F.when(fxok & same & (F.col("price") != 0), F.col("last") / F.col("price")))
    checks = [F.abs("d1") <= p.tol_1y_pp, F.abs("d3") <= p.tol_3y_pp, F.abs(F.col("price_ratio") - 1) <= p.price_ratio_tol]
    good, any_ = F.lit(True), F.lit(False)
    for c in checks:
        good, any_ = good & F.coalesce(c, F.lit(True)), any_ | c.isNotNull()
    status = (F.when(F.col("last").isNull(), "ukjent").when(~fxok, "ulik valuta").when(~any_, "ukjent").when(good, "ok").otherwise("avvik"))
    return j.select("asset", "r1", "r3", "d1", "d3", "price_ratio", status.alias("status"))


FUND_JSON = """struct<fund_info:struct<fund_yearly_fee:string,fund_total_fee:string,fund_refunding:string,fund_platform_fee:string,
fund_branding_company:string,fund_admin_company:string,fund_raw_sfdr:string,fund_nordnet_selection:boolean>,
historical_returns_info:struct<yield_1y:string,yield_3y:string,yield_5y:string,yield_10y:string,yield_ytd:string,yield_1m:string,yield_3m:string>,
instrument_info:struct<long_name:string>,nnx_info:struct<display_slug:string>,price_info:struct<tick_timestamp:string>>"""


def fund_row(funds: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Presentation row per fund from its stored columns and raw JSON."""
    f = funds.withColumn("j", F.from_json("raw_json", FUND_JSON.replace("\n", "")))
    f = classify(f.withColumn("name", F.coalesce("name", "j.instrument_info.long_name")))
    info, hist = (lambda c: F.col(f"j.fund_info.{c}")), (lambda c: F.col(f"j.historical_returns_info.{c}"))
    fee, total = number(info("fund_yearly_fee")), number(info("fund_total_fee"))
    ts = F.col("j.price_info.tick_timestamp").try_cast("double")
    name = F.coalesce("name", F.lit(""))
    policy = F.when(F.col("dividend_policy") != "", F.lower("dividend_policy").startswith("akk"))
    return f.select(
        "isin", "name", "category", "fund_type", "asset_class", "region", "sector", "theme", "style", "esg",
        ((F.coalesce("fund_type", F.lit("")) == "Indeks") | name.rlike(f"(?i){fv.INDEX_NAME}")).alias("is_index"),
        F.coalesce(info("fund_branding_company"), info("fund_admin_company")).alias("company"),
        ask_eligible(F.substring("isin", 1, 2)).alias("ask"), fee.alias("fee"), number(info("fund_refunding")).alias("kickback"),
        F.coalesce(total, fee).alias("cost"), policy.alias("acc"), name.rlike(f"(?i){fv.HEDGED_NAME}").alias("hedged"),
        number(info("fund_raw_sfdr")).alias("sfdr"), F.coalesce(info("fund_nordnet_selection"), F.lit(False)).alias("selection"),
        *[F.round(annualise(hist(f"yield_{y}y"), y), 5).alias(f"r{y}") for y in p.periods], number(hist("yield_ytd")).alias("ytd"),
        F.date_from_unix_date(F.floor(ts / 86400000).cast("int")).alias("nav_date"), truthy("is_tradable").alias("tradable"),
        F.col("j.nnx_info.display_slug").alias("slug"))


def etf_row(u: DataFrame, prices: DataFrame, returns: DataFrame) -> DataFrame:
    """Presentation row per instrument: labels, facts, flags with missing as false, first and last price, pick and representative.

    ``u`` has a column ``asset`` that names the instrument's price series."""
    last = prices.groupBy("asset").agg(F.max_by("close", "date").alias("price"), F.max("date").alias("price_date"), F.min("date").alias("first_price"))
    sizes = u.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    series = returns.groupBy("asset").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2).select("asset", F.lit(True).alias("has_returns"))
    picks = cluster_pick(u).select("isin", F.lit(True).alias("pick"))
    rows = classify(u).join(picks, "isin", "left").join(last, "asset", "left").join(series, "asset", "left").join(sizes, "cluster_id", "left")
    no = F.lit(False)
    return rows.select(
        "isin", "ticker", "name", "issuer", "category", "asset_class", "region", "sector", "theme", "style", "esg", "fee", "fund_size", "owners",
        "currency", "risk", "rating", F.col("spread_pct").alias("spread"), "cluster_size", "max_te", "history_years", "first_price", "url", F.coalesce("hedged", no).alias("hedged"),
        F.coalesce("leveraged", no).alias("leveraged"), F.coalesce("ask_eligible", no).alias("ask"),
        F.when(F.col("dividend_policy").isNotNull(), F.col("accumulating")).alias("acc"), F.col("cluster_id").alias("cluster"),
        F.coalesce("pick", no).alias("pick"), F.col("is_rep").alias("rep"), "price", "price_date", F.coalesce("has_returns", no).alias("has_returns"))
