"""One row per key, top rows and representative choice.

Picks are written as ``min_by`` over an order struct, so they combine before the shuffle and a key that
holds a third of the rows costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.operators.overlap import BLOCK, salted
from lodestar.params import DEFAULTS, Params


def truthy(c: str | Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)).isin("1", "true", "yes"), F.lit(False))


def first_per(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Smallest row of each key under ``order`` (built from non-null ascending columns)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_s")).select(key, "_s.*")


def owners_sum(listings: DataFrame) -> DataFrame:
    return listings.groupBy("isin").agg(F.sum("owners").alias("owners"))


def pick_listing(listings: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One listing per ISIN: tradable, preferred currency, lowest spread, most owners, id; owners summed."""
    rank = F.lit(len(p.listing_currency_preference))
    for i, cur in reversed(list(enumerate(p.listing_currency_preference))):
        rank = F.when(F.col("currency") == cur, i).otherwise(rank)
    order = [(~truthy("is_tradable")).cast("int"), rank, F.coalesce("spread_pct", F.lit(float("inf"))),
             -F.coalesce("owners", F.lit(0)), F.col("instrument_id")]
    return first_per(listings, "isin", order).drop("owners").join(owners_sum(listings), "isin")


def one_per_isin(items: DataFrame, prefer: Column | None = None) -> DataFrame:
    """Listing with most owners per ISIN; ``prefer`` (lower is better) goes first when given."""
    order = ([prefer] if prefer is not None else []) + [-F.coalesce("owners", F.lit(-1)), F.col("instrument_id")]
    return first_per(items.where(F.col("active") & F.col("isin").isNotNull()), "isin", order)


def effective_fee(fee: Column, accumulating: Column, p: Params = DEFAULTS) -> Column:
    return F.coalesce(fee, F.lit(9.99)) + F.when(accumulating, 0.0).otherwise(p.dist_fee_penalty)


def cluster_pick(u: DataFrame) -> DataFrame:
    """One ISIN per cluster: representative, account-eligible, fee, history, size."""
    order = [-F.col("is_rep").cast("int"), -F.coalesce(F.col("ask_eligible").cast("int"), F.lit(0)),
             F.coalesce("eff_fee", "fee", F.lit(99.0)), -F.coalesce("history_years", F.lit(0.0)),
             -F.coalesce("fund_size", F.lit(-1.0)), F.col("isin")]
    return u.groupBy("cluster_id").agg(F.min_by("isin", F.struct(*order)).alias("isin"))


def representatives(u: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Representative per cluster with hysteresis towards the previous one, and a reason for every row.

    ``u``: isin, cluster_id, eligible, ineligible_reason, eff_fee, fund_size, owners, history_years, was_rep.
    Each cluster needs four small facts (best, runner-up fee, best previous, count), all from one aggregate."""
    key = F.struct(F.round("eff_fee", 4).alias("f"), (-F.coalesce("fund_size", F.lit(-1.0))).alias("s"),
                   (-F.coalesce(F.col("owners").cast("double"), F.lit(-1.0))).alias("o"),
                   (-F.coalesce("history_years", F.lit(0.0))).alias("h"), F.col("isin").alias("i"))
    el = u.where("eligible").select("cluster_id", "isin", "eff_fee", "was_rep", key.alias("k"))
    row = F.struct("isin", "eff_fee")
    c = el.groupBy("cluster_id").agg(
        F.min_by(row, "k").alias("best"), F.count(F.lit(1)).alias("n"),
        F.min_by(row, F.when(F.col("was_rep"), F.col("k"))).alias("held"))
    # the runner-up: smallest key that is not the best
    second = (el.join(c.select("cluster_id", F.col("best.isin").alias("b")), "cluster_id").where(F.col("isin") != F.col("b"))
              .groupBy("cluster_id").agg(F.min_by("eff_fee", "k").alias("second_fee")))
    gain = F.col("held.eff_fee") - F.col("best.eff_fee")
    other = F.col("held.isin").isNotNull() & (F.col("held.isin") != F.col("best.isin"))
    keep = other & (gain < p.hysteresis_fee_pp - 1e-9)
    why = (F.when(keep, "beholdt forrige representant (hysterese)")
           .when(other, F.concat(F.lit("byttet: "), F.format_string("%.2f", gain), F.lit(" pp lavere avgift enn forrige representant")))
           .when(F.col("held.isin").isNotNull(), "beholdt forrige representant")
           .when(F.col("n") == 1, "eneste kvalifiserte")
           .when(F.col("best.eff_fee") == F.col("second_fee"), "lik avgift, størst fond/flest eiere").otherwise("lavest avgift"))
    choice = c.join(second, "cluster_id", "left").select(
        "cluster_id", F.when(keep, F.col("held.isin")).otherwise(F.col("best.isin")).alias("choice"), why.alias("why"))
    j = u.join(choice, "cluster_id", "left")
    rep = F.coalesce(F.col("isin") == F.col("choice"), F.lit(False))
    reason = F.when(rep, F.col("why")).when(F.col("eligible"), "alternativ i klyngen").otherwise(F.col("ineligible_reason"))
    return j.select("isin", "cluster_id", rep.alias("is_representative"), reason.alias("reason"))


def candidate_merge(cands: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Candidates of an ISIN over all sources in order, source names joined, at most ``max_candidates``.

    ``cands``: isin, ticker, source, source_rank, pos. A ticker keeps its first place."""
    firsts = cands.groupBy("isin", "ticker", "source").agg(F.min(F.struct("source_rank", "pos")).alias("at"))
    merged = firsts.groupBy("isin", "ticker").agg(
        F.min("at").alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda x: x["source"]), ",").alias("sources"))
    order = W.partitionBy("isin").orderBy("at")
    return (merged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= p.max_candidates)
            .select("isin", "ticker", "sources", F.col("place").cast("long").alias("place")))


def choose_candidate(probes: DataFrame, today: Column, p: Params = DEFAULTS) -> DataFrame:
    """Best probed ticker per ISIN: recent last price, most months, earliest place."""
    fresh = F.col("ok") & (F.col("last_date") >= F.date_sub(today, p.max_stale_days))
    return (probes.where(fresh).groupBy("isin").agg(F.max_by("ticker", F.struct("n_months", (-F.col("place")).alias("p"))).alias("ticker")))


# rank name -> value to sort by, largest first (fixed set of rankings)
RANK = {"sharpe": lambda: F.col("sharpe"), "alpha": lambda: F.col("alpha"), "ir": lambda: F.col("ir"), "ret": lambda: F.col("ret"),
        "vol_low": lambda: -F.col("vol"), "mdd_low": lambda: F.col("mdd"), "fee_low": lambda: -F.col("fee")}


def top_n_per_group(df: DataFrame, group: str, rank: str, n: int, key: str) -> DataFrame:
    """Best ``n`` rows per group; rows without a rank value are left out.

    Spark limits each group to ``n`` rows in every map task before the shuffle."""
    order = W.partitionBy(group).orderBy(F.col("_v").desc(), key)
    return (df.withColumn("_v", RANK[rank]()).where(F.col("_v").isNotNull())
            .withColumn("position", F.row_number().over(order)).where(F.col("position") <= n).drop("_v"))


def cluster_report(u: DataFrame) -> DataFrame:
    """Members of multi-member clusters: largest cluster first, representative first, then fee."""
    return (u.where(F.col("cluster_size") > 1)
            .orderBy(F.col("cluster_size").desc(), "cluster_id", F.col("is_rep").desc(), F.col("eff_fee").asc_nulls_last(), "isin"))


def cluster_alternates(u: DataFrame, held: DataFrame, block: int = BLOCK) -> DataFrame:
    """Other members of a held instrument's cluster; large clusters meet in blocks."""
    h = held.select(F.col("isin").alias("id_a"), "cluster_id")
    both = salted(h, u.select("cluster_id", F.col("isin").alias("id_b"), "fee", "history_years", "r5", "ask_eligible"), ["cluster_id"], block)
    return both.where(F.col("id_a") != F.col("id_b")).select(F.col("id_a").alias("held"), "cluster_id", F.col("id_b").alias("isin"), "fee", "history_years", "r5", "ask_eligible")
