"""The universe build as one job: prices to returns, clusters, eligibility and one representative per cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestar.operators.cluster import renumber_clusters, te_clusters
from lodestar.operators.predicates import ask_eligible, eligibility_reasons, instrument_flags
from lodestar.operators.ranking import effective_fee, representatives
from lodestar.operators.timeseries import period_returns
from lodestar.params import DEFAULTS, Params
from lodestar.session import stored


def build_universe(listings: DataFrame, prices: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(asset, isin, cluster_id, cluster_size, history_years, is_representative, reason), one row per instrument.

    ``listings``: asset (its price series), isin, name, category, dividend_policy, is_tradable, fee, fund_size, owners, was_rep.
    ``prices``: asset, date, close in one base currency; read twice, as are the returns, so both should be stored tables."""
    returns = stored(period_returns(prices, "ME", p))
    labels = stored(te_clusters(returns, listings, p=p).select("asset", "cluster"))
    span = prices.groupBy("asset").agg(F.min("date").alias("_first"))
    years = F.round(F.date_diff(prices.select(F.max("date")).scalar(), F.col("_first")) / 365.25, 2)
    u = (listings.join(renumber_clusters(labels), "asset").join(span, "asset", "left")
         .withColumns({"has_prices": F.col("_first").isNotNull(), "history_years": years, "ask_eligible": ask_eligible(F.substring("isin", 1, 2))}))
    u = eligibility_reasons(instrument_flags(u), p=p).withColumn("eff_fee", effective_fee(F.col("fee"), F.col("accumulating")))
    u = stored(u.drop("_first"))
    return u.select("asset", "isin", "cluster_size", "history_years").join(representatives(u, p), "isin").select(
        "asset", "isin", "cluster_id", "cluster_size", "history_years", "is_representative", "reason")
