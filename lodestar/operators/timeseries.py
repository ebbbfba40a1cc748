"""Price cleaning, total return, period returns and performance numbers.

Series are long tables. A window partition is one instrument with at most one row per day (or month),
so its size is bounded by the calendar however many instruments there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from lodestar.operators.asof import asof_backward, daily_fill, subunit_map_join, with_dividends
from lodestar.params import DEFAULTS, Params


def by_date() -> WindowSpec:
    return W.partitionBy("asset").orderBy("date")


def by_month() -> WindowSpec:
    return W.partitionBy("asset").orderBy("mi")


def whole() -> WindowSpec:
    return W.partitionBy("asset")


def month_index(date: Column) -> Column:
    return (F.year(date) * 12 + F.month(date) - 1).cast("long")


def month_end(mi: Column) -> Column:
    return F.last_day(F.make_date((mi / 12).cast("int"), (mi % 12 + 1).cast("int"), F.lit(1)))


# ------------------------------------------------------------------ cleaning

def _with_median(df: DataFrame, name: str, lo: int, hi: int) -> DataFrame:
    """Median of the closes in a row frame (at most 43 values): sorted frame, mean of its middle."""
    v, n = F.col("_frame"), F.size("_frame")
    mid = (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2
    return df.withColumn("_frame", F.sort_array(F.collect_list("close").over(by_date().rowsBetween(lo, hi)))).withColumn(name, mid).drop("_frame")


def unit_flip_fix(closes: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Drop missing and non-positive closes; rescale points near 100x or 1/100 of the local median."""
    n = p.clean_window
    ratio = F.col("close") / F.col("_med")
    fixed = (F.when(ratio.between(80, 125), F.col("close") / 100)
             .when(ratio.between(0.008, 0.0125), F.col("close") * 100).otherwise(F.col("close")))
    sized = closes.where(F.col("close") > 0).withColumn("_n", F.count(F.lit(1)).over(whole()))
    return (_with_median(sized, "_med", -n, n)
            .withColumn("close", F.when(F.col("_n") < p.min_clean_obs, F.col("close")).otherwise(fixed))
            .drop("_n", "_med"))


def spike_removal(closes: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Drop points far from both the median before and the median after; end points judged one-sided."""
    n = p.clean_window

    def off(m: str) -> Column:
        g = F.col("close") / F.col(m)
        return F.coalesce((g > p.spike_ratio) | (g < 1 / p.spike_ratio), F.lit(False))

    for _ in range(p.clean_passes):
        bad = (F.when(F.col("_n") < p.min_clean_obs, F.lit(False)).when(F.col("_i") == 1, off("_fwd"))
               .when(F.col("_i") == F.col("_n"), off("_back")).otherwise(off("_back") & off("_fwd")))
        sized = closes.withColumn("_n", F.count(F.lit(1)).over(whole())).withColumn("_i", F.row_number().over(by_date()))
        closes = _with_median(_with_median(sized, "_back", -n, -1), "_fwd", 1, n).where(~bad).drop("_n", "_i", "_back", "_fwd")
    return closes


def jump_trim(closes: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Keep the history from the last daily jump on; adds the jump count and the length before the cut."""
    g = F.col("close") / F.lag("close").over(by_date())
    return (closes.withColumn("_jump", (g > p.jump_ratio) | (g < 1 / p.jump_ratio))
            .withColumn("n_clean", F.count(F.lit(1)).over(whole()))
            .withColumn("_jump", F.col("_jump") & (F.col("n_clean") >= 3))
            .withColumn("_cut", F.max(F.when(F.col("_jump"), F.col("date"))).over(whole()))
            .withColumn("n_jumps", F.count_if("_jump").over(whole()))
            .where(F.col("_cut").isNull() | (F.col("date") >= F.col("_cut"))).drop("_jump", "_cut"))


def total_return_index(closes: DataFrame, divs: DataFrame) -> DataFrame:
    """Close plus reinvested dividends, at the level of the close on the last day."""
    g = F.ln((F.col("close") + F.coalesce("amount", F.lit(0.0))) / F.lag("close").over(by_date()))
    newest_first = W.partitionBy("asset").orderBy(F.col("date").desc()).rowsBetween(W.unboundedPreceding, -1)
    later = F.coalesce(F.sum("_g").over(newest_first), F.lit(0.0))
    last = F.last("close").over(by_date().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return (with_dividends(closes, divs).withColumn("_g", g)
            .withColumn("tr", last * F.exp(-later)).drop("_g", "amount"))


def clean_series(closes: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return jump_trim(spike_removal(unit_flip_fix(closes, p), p), p)


def nok_prices(closes: DataFrame, divs: DataFrame, fx: DataFrame, currencies: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adjusted price per asset and day in the base currency."""
    tr = total_return_index(clean_series(closes, p), divs).select("asset", "date", F.col("tr").alias("close"))
    quoted = subunit_map_join(tr.join(currencies, "asset"))
    priced = quoted.withColumn("close", F.col("close") * F.col("factor")).drop("factor")
    return asof_backward(priced, fx, until=closes.agg(F.max("date")).scalar()).select("asset", "date", "close")


def cleaning_counts(closes: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Per series: removed points, jumps and trimmed points."""
    kept = clean_series(closes, p).groupBy("asset").agg(
        F.max("n_jumps").alias("jumps"), F.max("n_clean").alias("n_clean"), F.count(F.lit(1)).alias("n_kept"))
    raw = closes.where(F.col("close").isNotNull()).groupBy("asset").agg(F.count(F.lit(1)).alias("n_raw"))
    n_clean = F.coalesce("n_clean", F.lit(0))
    return raw.join(kept, "asset", "left").select(
        "asset", (F.col("n_raw") - n_clean).alias("removed"), F.coalesce("jumps", F.lit(0)).alias("jumps"),
        (n_clean - F.coalesce("n_kept", F.lit(0))).alias("trimmed"))


# ------------------------------------------------------------------ period returns

def last_complete_month(last_date: Column, p: Params = DEFAULTS) -> Column:
    return F.when(F.datediff(F.last_day(last_date), last_date) <= p.month_slack_days, F.last_day(last_date)).otherwise(
        F.last_day(F.add_months(last_date, -1)))


def monthly_returns(prices: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Month-end to month-end returns (asset, mi, r) through the last complete month.

    A month needs a price within ``stale_days`` of its end; months missing inside a series return 0 and
    the next one catches up."""
    end = last_complete_month(prices.agg(F.max("date")).scalar(), p)
    months = (prices.where(F.col("date") <= end).groupBy("asset", month_index(F.col("date")).alias("mi"))
              .agg(F.max_by("close", "date").alias("v"), F.max("date").alias("d"))
              .where(F.datediff(F.last_day("d"), "d") <= p.stale_days))
    steps = (months.withColumn("r", F.col("v") / F.lag("v").over(by_month()) - 1)
             .withColumn("to", F.coalesce(F.lead("mi").over(by_month()) - 1, F.col("mi"))))
    return (steps.select("asset", F.col("mi").alias("_own"), F.explode(F.sequence("mi", "to")).alias("mi"), "r")
            .withColumn("r", F.when(F.col("mi") == F.col("_own"), F.col("r")).otherwise(0.0))
            .where(F.col("r").isNotNull()).select("asset", "mi", "r"))


_PERIOD = {   # rule -> (period number, calendar end, periods per year)
    "ME": (lambda d: (F.year(d) * 12 + F.month(d)).cast("long"), F.last_day, 12),
    "W-FRI": (lambda d: F.floor((F.unix_date(d) + 5) / 7),
              lambda d: F.date_add(d, F.pmod(6 - F.dayofweek(d), F.lit(7))), 52),
    "QE": (lambda d: (F.year(d) * 4 + F.quarter(d)).cast("long"),
           lambda d: F.last_day(F.add_months(F.trunc(d, "quarter"), 2)), 4),
}


def period_returns(prices: DataFrame, rule: str = "ME", p: Params = DEFAULTS) -> DataFrame:
    """Returns (asset, period, period_end, r) of smoothed period-end prices.

    The price of a panel date is the mean over the last ``te_smooth_days`` panel dates, whether or not the
    instrument traded on each. Each observation is repeated only over the panel dates that its mean can
    reach, so the panel is never filled out to (instrument x date)."""
    number, ends, _ = _PERIOD[rule]
    n = p.te_smooth_days
    # calendar: one row per day of the panel
    cal = prices.select("date").distinct().withColumn("pos", F.row_number().over(W.orderBy("date")).cast("long"))
    last_pos, last_date = cal.agg(F.max("pos")).scalar(), prices.agg(F.max("date")).scalar()
    obs = prices.join(cal, "date").select("asset", "pos", "close")
    by_pos = W.partitionBy("asset").orderBy("pos")
    reach = F.least(F.coalesce(F.lead("pos").over(by_pos) - 1, last_pos), F.col("pos") + n - 1)
    spread = (obs.withColumn("_to", reach)
              .select("asset", "close", F.col("pos").alias("_own"), F.explode(F.sequence("pos", "_to")).alias("pos"))
              .withColumn("close", F.when(F.col("pos") == F.col("_own"), F.col("close"))))
    recent = by_pos.rangeBetween(-(n - 1), 0)
    smooth = (spread.withColumn("v", F.avg("close").over(recent)).withColumn("_c", F.count("close").over(recent))
              .where(F.col("_c") >= (max(2, n // 2) if n > 1 else 1)).join(cal, "pos"))
    closed = (smooth.groupBy("asset", number(F.col("date")).alias("period"))
              .agg(F.max_by("v", "pos").alias("v"), F.max(ends(F.col("date"))).alias("period_end"))
              .where(F.col("period_end") <= last_date))
    by_period = W.partitionBy("asset").orderBy("period")
    r = F.when(F.lag("period").over(by_period) == F.col("period") - 1, F.col("v") / F.lag("v").over(by_period) - 1)
    out = closed.withColumn("r", r).where(F.col("r").isNotNull()).select("asset", "period", "period_end", "r")
    if p.te_window_periods:
        newest = closed.agg(F.max("period")).scalar()
        out = out.where(F.col("period") > newest - p.te_window_periods)
    return out


# ------------------------------------------------------------------ risk-free rate

def daily_rates(primary: DataFrame, fallback: DataFrame, until: Column) -> DataFrame:
    """Forward-filled primary rate, days without one taken from the forward-filled fallback table."""
    a = daily_fill(primary.select("date", "rate"), [], until)
    b = daily_fill(fallback.select("date", F.col("rate").alias("fallback")), [], until)
    return a.join(b, "date", "full").select("date", F.coalesce("rate", "fallback").alias("rate"),
                                            F.col("rate").isNull().alias("from_fallback"))


def rf_monthly(months: DataFrame, daily: DataFrame) -> DataFrame:
    """Monthly risk-free return per requested month; months before the first rate take the first."""
    avg = daily.groupBy(month_index(F.col("date")).alias("mi")).agg((F.avg("rate") / 100).alias("a"))
    first = avg.agg(F.min_by("a", "mi")).scalar()
    return months.join(avg, "mi", "left").select(
        "mi", (F.pow(1 + F.coalesce("a", first), F.lit(1 / 12)) - 1).alias("rf"))


# ------------------------------------------------------------------ packing

def pack_returns(returns: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(asset, offset, packed array<int>): scaled integer returns from the first to the last month."""
    start = returns.agg(F.min("mi")).scalar()
    per = (returns.groupBy("asset").agg(
        F.min("mi").alias("a"), F.max("mi").alias("b"), F.count("r").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("mi", F.bround(F.col("r") * p.return_scale).cast("int").alias("v")))).alias("m"))
        .where(F.col("n") >= 2))
    return per.select("asset", (F.col("a") - start).alias("offset"),
                      F.transform(F.sequence("a", "b"), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("packed"))


def unpack_returns(packed: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return (packed.select("asset", "offset", F.posexplode("packed").alias("k", "v"))
            .select("asset", (F.col("offset") + F.col("k")).alias("pos"), (F.col("v") / p.return_scale).alias("r")))


# ------------------------------------------------------------------ performance

def performance_stats(returns: DataFrame, bench: DataFrame, rf: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Return, risk and benchmark numbers per asset and window of whole years ending at the last month.

    A window counts only when every month exists; benchmark numbers need a complete benchmark too."""
    end = returns.agg(F.max("mi")).scalar()
    monthly = rf.join(bench.select("mi", F.col("r").alias("b")), "mi", "left")
    rows = (returns.join(monthly, "mi").withColumn("years", F.explode(F.array(*[F.lit(y) for y in p.periods])))
            .where(F.col("mi") > end - 12 * F.col("years")))
    per = W.partitionBy("asset", "years").orderBy("mi").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("v", F.product(1 + F.col("r")).over(per))
    rows = rows.withColumn("dd", F.col("v") / F.greatest(F.lit(1.0), F.max("v").over(per)) - 1)
    ex, eb, n = F.col("r") - F.col("rf"), F.col("b") - F.col("rf"), F.col("years") * 12

    def annual(c: str) -> Column:
        return F.pow(F.product(1 + F.col(c)), 12 / F.count(F.lit(1))) - 1

    agg = (rows.groupBy("asset", "years").agg(
        F.count(F.lit(1)).alias("n"), F.count("b").alias("nb"), annual("r").alias("ret"), annual("rf").alias("rf"),
        (F.stddev_samp("r") * F.sqrt(F.lit(12.0))).alias("vol"), F.min("dd").alias("mdd"), annual("b").alias("bret"),
        F.regr_slope(ex, eb).alias("beta"), F.regr_intercept(ex, eb).alias("am"), F.covar_samp(ex, eb).alias("cxy"),
        (F.var_samp(ex) * F.var_samp(eb)).alias("vxy"),
        (F.stddev_samp(F.col("r") - F.col("b")) * F.sqrt(F.lit(12.0))).alias("te")).where(F.col("n") == n))
    full = F.col("nb") == F.col("n")
    return agg.select(
        "asset", F.col("years").cast("long").alias("years"), "ret", "vol",
        F.when(F.col("vol") > 0, (F.col("ret") - F.col("rf")) / F.col("vol")).alias("sharpe"), "mdd", "rf",
        F.when(full, F.col("beta")).alias("beta"), F.when(full, F.pow(1 + F.col("am"), 12) - 1).alias("alpha"),
        F.when(full, F.try_divide(F.col("cxy") * F.col("cxy"), F.col("vxy"))).alias("r2"), F.when(full, F.col("te")).alias("te"),
        F.when(full & (F.col("te") > 1e-9), (F.col("ret") - F.col("bret")) / F.col("te")).alias("ir"),
        F.when(full, F.col("ret") - F.col("bret")).alias("excess"))


def drawdown_series(returns: DataFrame) -> DataFrame:
    """Cumulative value from 1 and its distance from the running peak."""
    run = by_month().rowsBetween(W.unboundedPreceding, 0)
    return (returns.withColumn("value", F.product(1 + F.col("r")).over(run))
            .withColumn("drawdown", F.col("value") / F.greatest(F.lit(1.0), F.max("value").over(run)) - 1)
            .select("asset", "mi", "value", "drawdown"))


def growth_index(returns: DataFrame, years: int, base: float = 100.0) -> DataFrame:
    """Value path from ``base`` over the last ``years``; a missing month counts as 0. Also gives the returns
    back from the path."""
    end = returns.agg(F.max("mi")).scalar()
    grid = returns.select("asset").distinct().withColumn("mi", F.explode(F.sequence(end - 12 * years + 1, end)))
    run = by_month().rowsBetween(W.unboundedPreceding, 0)
    path = (grid.join(returns, ["asset", "mi"], "left")
            .withColumn("value", base * F.product(1 + F.coalesce("r", F.lit(0.0))).over(run)))
    return path.select("asset", "mi", "value",
                       (F.col("value") / F.lag("value", 1, base).over(by_month()) - 1).alias("path_return"))


def risk_story(returns: DataFrame) -> DataFrame:
    """Worst and best 12 months, nearest-rank quantiles, deepest fall and the way back; 13 months or more."""
    first = returns.groupBy("asset").agg((F.min("mi") - 1).alias("mi")).select("asset", "mi", F.lit(0.0).alias("r"))
    w0 = by_month().rowsBetween(W.unboundedPreceding, 0)
    v = (first.unionByName(returns.select("asset", "mi", "r"))
         .withColumn("k", (F.row_number().over(by_month()) - 1).cast("long"))
         .withColumn("n", (F.count(F.lit(1)).over(whole()) - 1).cast("long")).where(F.col("n") >= 13)
         .withColumn("v", F.product(1 + F.col("r")).over(w0)))
    v = (v.withColumn("top", F.max(F.struct("v", (-F.col("k")).alias("nk"))).over(w0))
         .withColumn("peak", -F.col("top.nk")).withColumn("dd", F.col("v") / F.col("top.v") - 1)
         .withColumn("roll", F.col("v") / F.lag("v", 12).over(by_month()) - 1))
    # deepest fall per asset, then the first month back at the peak value
    fall = F.min(F.struct("dd", "k", "peak", F.col("top.v").alias("pv"))).over(whole())
    v = v.withColumn("fall", fall).withColumn("rank", F.row_number().over(W.partitionBy("asset").orderBy(F.col("roll").asc_nulls_last(), "k")))
    m = F.col("n") - 12 + 1                                   # number of rolling years

    def nearest(q: float) -> Column:
        return F.max(F.when(F.col("rank") == F.floor(q * (m - 1) + 0.5) + 1, F.col("roll")))

    back = F.min(F.when((F.col("k") > F.col("fall.k")) & (F.col("v") >= F.col("fall.pv")), F.col("k")))
    has = F.when(F.col("roll").isNotNull(), F.col("roll"))
    agg = v.groupBy("asset").agg(
        F.max("n").alias("months"), F.min("mi").alias("m0"), F.min(F.struct(F.coalesce(has, F.lit(float("inf"))).alias("r"), "k")).alias("lo"),
        F.min(F.struct(F.coalesce(-has, F.lit(float("inf"))).alias("r"), "k")).alias("hi"), nearest(0.5).alias("median"),
        nearest(0.1).alias("bad"), (F.count_if(F.col("roll") < 0) / F.count("roll")).alias("neg_share"),
        F.max("fall").alias("f"), back.alias("back"))
    m0 = F.col("m0")                                          # month before the first return
    return agg.select(
        "asset", "months", F.col("lo.r").alias("worst_ret"), (m0 + F.col("lo.k") - 11).alias("worst_from"),
        (m0 + F.col("lo.k")).alias("worst_to"), (-F.col("hi.r")).alias("best_ret"), (m0 + F.col("hi.k") - 11).alias("best_from"),
        (m0 + F.col("hi.k")).alias("best_to"), "median", "bad", "neg_share", F.col("f.dd").alias("depth"),
        (m0 + F.col("f.peak")).alias("peak"), (m0 + F.col("f.k")).alias("trough"), (m0 + F.col("back")).alias("recovered"),
        (F.col("f.k") - F.col("f.peak")).alias("months_down"), (F.col("back") - F.col("f.k")).alias("months_back"),
        (F.col("months") - F.col("f.k")).alias("months_since_trough"))


def donor_backfill(returns: DataFrame, clusters: DataFrame) -> DataFrame:
    """Months before an asset's own start, taken from its cluster's earliest-starting donor with data.

    A donor for a month before the own start always starts earlier, so the best donor of a (cluster, month)
    is the same for every asset that needs it: one row per cluster and month is joined, never pairs of
    assets. Only the unbroken block that ends right before the own start is kept."""
    own = returns.join(clusters, "asset")
    starts = own.groupBy("asset", "cluster").agg(F.min("mi").alias("start"))
    donors = (own.join(starts.drop("cluster"), "asset").groupBy("cluster", "mi")
              .agg(F.min_by("r", F.struct("start", "asset")).alias("r")))
    # runs of consecutive months, bounded by the months of one cluster
    run = F.col("mi") - F.row_number().over(W.partitionBy("cluster").orderBy("mi"))
    donors = donors.withColumn("run", run)
    anchor = donors.select("cluster", (F.col("mi") + 1).alias("start"), "run")
    fill = (starts.join(anchor, ["cluster", "start"]).join(donors, ["cluster", "run"])
            .where(F.col("mi") < F.col("start")).select("asset", "mi", "r", F.lit(True).alias("filled")))
    return returns.select("asset", "mi", "r", F.lit(False).alias("filled")).unionByName(fill)


def series_bounds(prices: DataFrame) -> DataFrame:
    last = prices.agg(F.max("date")).scalar()
    return (prices.where(F.col("close").isNotNull()).groupBy("asset")
            .agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
            .withColumn("history_years", F.round(F.datediff(last, "first_date") / 365.25, 2)))


def calendar_year_returns(returns: DataFrame) -> DataFrame:
    """Compounded return and month count per calendar year, and whether a full year ended up."""
    g = returns.groupBy("asset", F.floor(F.col("mi") / 12).alias("year")).agg(
        F.product(1 + F.col("r")).alias("g"), F.count(F.lit(1)).alias("months"))
    return g.select("asset", "year", (F.col("g") - 1).alias("ret"), "months",
                    ((F.col("months") == 12) & (F.col("g") >= 1)).alias("positive_full_year"))
