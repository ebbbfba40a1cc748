"""Portfolio model. Weights are a table (portfolio_id, asset, w), so thousands of portfolios run at once.

Variances are taken from the weighted return series, not from a covariance matrix: for any weights
w'Sw = var(sum of w*r), and the constant-correlation target has a closed form in sums over assets. Cost is
linear in (assets x months); no pair of assets is ever formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import PandasUDFType

from lodestar.params import DEFAULTS, Params
from lodestar.session import ship, stored, task_count

BLOCK = 512

CAL_RULES = ("monthly", "quarterly", "annual", "none")
SEGMENTS = 1 << 21      # segments of weights worked out in a task of a calendar back-test, in expectation


def last_months(returns: DataFrame, n: int) -> DataFrame:
    return returns.where(F.col("mi") > returns.agg(F.max("mi")).scalar() - n)


def common_months(returns: DataFrame) -> DataFrame:
    """Months in which every asset has a return: what covariances are estimated on."""
    n = returns.agg(F.count_distinct("asset")).scalar()
    whole = returns.groupBy("mi").agg(F.count("r").alias("_n")).where(F.col("_n") == n).select("mi")
    return returns.join(whole, "mi", "left_semi").select(*returns.columns)


def _block_sums(v: np.ndarray) -> np.ndarray:
    """What one block of centred series (assets x months) adds: N, ds, ds2 and x4, then the sums by month, then the month x month products."""
    sd = np.sqrt((v * v).sum(axis=1, keepdims=True) / (v.shape[1] - 1))
    s = sd * sd
    by_month = [(v * v).sum(axis=0), (v / sd).sum(axis=0), (v * sd).sum(axis=0), (v ** 3 / sd).sum(axis=0)]
    return np.concatenate([[len(v), s.sum(), (s * s).sum(), (v ** 4).sum()], *by_month, (v.T @ v).ravel()])


def _finished(sums: np.ndarray) -> dict[str, float]:
    t = int(round(np.sqrt(len(sums)))) - 2                    # 4 + 4 T + T * T sums
    q, z, u, c = sums[4:4 + 4 * t].reshape(4, t)
    g = sums[4 + 4 * t:]
    return dict(zip(_SUMS, (*sums[:4], t, q @ q, z @ z, u @ u, c @ u, g @ g)))


_SUMS = ("N", "ds", "ds2", "x4", "T", "qq", "zz", "uu", "cu", "gg")


def _sums_task(whole: bool) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame | pd.Series]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame | pd.Series]:
        for rows in batches:
            with np.errstate(divide="raise", invalid="raise"):
                sums = [_block_sums(np.stack([np.asarray(x, float) for x in r])) for r in rows]
            yield pd.DataFrame([_finished(x) for x in sums], columns=list(_SUMS)) if whole else pd.Series([x.tolist() for x in sums], dtype=object)

    return run


def _finish_task(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame([_finished(np.asarray(r, float)) for r in rows], columns=list(_SUMS))


def _moments(returns: DataFrame, by: list[str], block: int) -> DataFrame:
    """``_SUMS`` per selection. A selection's series meet as arrays in blocks of about ``block``; a selection of one block is finished
    where it is, the sums of several are added up place by place."""
    ship(returns.sparkSession)
    per = returns.groupBy(*by, "asset").agg(F.array_sort(F.collect_list(F.struct("mi", "r"))).alias("s"), F.avg("r").alias("m"))
    vec = stored(per.select(*by, "asset", F.transform("s", lambda x: x["r"] - F.col("m")).alias("v")))
    n = vec.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    sized = vec.join(n, by) if by else vec.withColumn("_n", n.scalar())
    blocks = stored(sized.groupBy(*by, "_n", F.pmod(F.xxhash64("asset"), F.col("_n")).alias("_b")).agg(F.collect_list("v").alias("vs")))
    fields = ", ".join(f"{c} double" for c in _SUMS)
    done = F.pandas_udf(_sums_task(True), fields, PandasUDFType.SCALAR_ITER)
    part = F.pandas_udf(_sums_task(False), "array<double>", PandasUDFType.SCALAR_ITER)
    finish = F.pandas_udf(_finish_task, fields, PandasUDFType.SCALAR_ITER)
    one = blocks.where("_n = 1").select(*by, done("vs").alias("s"))
    many = (blocks.where("_n > 1").select(*by, F.posexplode(part("vs")).alias("_i", "_v")).groupBy(*by, "_i").agg(F.sum("_v").alias("_v"))
            .groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("x")))
    many = many.where(F.size("x") > 0).select(*by, finish(F.transform("x", lambda x: x["_v"])).alias("s"))
    return one.unionByName(many).select(*by, "s.*")


def shrinkage(returns: DataFrame, by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """One row (n_assets, n_months, rbar, delta) per selection ``by``: Ledoit-Wolf shrinkage towards constant correlation.

    ``returns`` must hold every month of a selection for each of its assets. The squared norm of the covariance matrix comes from
    the month x month products (a fixed window, 60 x 60) of whole blocks of series, so nothing grows with the square of the assets
    and no product becomes a row."""
    s = _moments(returns, list(by), block).withColumn("N", F.col("N").cast("long"))
    k = (F.col("T") - 1) / F.col("T")
    s = (s.withColumn("norm", F.col("gg") / F.pow(F.col("T") - 1, F.lit(2.0)))
         .withColumn("Q", F.col("uu") / (F.col("T") - 1))
         .withColumn("rbar", F.try_divide(F.col("zz") / (F.col("T") - 1) - F.col("N"), F.col("N") * (F.col("N") - 1)))
         .withColumn("pi", F.col("qq") / F.col("T") + (1 - 2 * k) * F.col("norm"))
         .withColumn("pid", F.col("x4") / F.col("T") + (1 - 2 * k) * F.col("ds2"))
         .withColumn("theta", F.col("cu") / F.col("T") + (1 - 2 * k) * F.col("Q") - F.col("pid"))
         .withColumn("rho", F.col("pid") + F.col("rbar") * F.col("theta"))
         .withColumn("gamma", F.col("norm") - F.col("ds2") - 2 * F.col("rbar") * (F.col("Q") - F.col("ds2"))
                     + F.col("rbar") * F.col("rbar") * (F.col("ds") * F.col("ds") - F.col("ds2"))))
    raw = F.when(F.col("gamma") > 0, (F.col("pi") - F.col("rho")) / F.col("gamma")).otherwise(0.0) / F.col("T")
    delta = F.when(F.col("N") == 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return s.select(*by, F.col("N").alias("n_assets"), F.col("T").cast("long").alias("n_months"),
                    F.coalesce("rbar", F.lit(0.0)).alias("rbar"), delta.alias("delta"))


def shrunk_covariance(pairs: DataFrame, scalars: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shrink a covariance pair table towards constant correlation, each selection ``by`` by its own scalars; variances stay."""
    s = scalars.select(*by, F.struct("rbar", "delta").alias("s"))
    shrunk = F.col("s.delta") * F.col("s.rbar") * F.col("sd_ab") + (1 - F.col("s.delta")) * F.col("cov")
    pairs = pairs.join(s, list(by)) if by else pairs.withColumn("s", s.scalar())
    return pairs.select(*by, "a", "b", "cov", F.when(F.col("a") == F.col("b"), F.col("cov")).otherwise(shrunk).alias("shrunk"))


def estimate(returns: DataFrame, bench: DataFrame, costs: DataFrame, rf_now: Column, p: Params = DEFAULTS, by: Sequence[str] = ()) -> DataFrame:
    """Per asset: sd (monthly), beta from the shrunk covariance, yearly historical mean and expected return.

    The benchmark is one more series in the shrinkage. With ``by`` each selection has its own months and its own shrinkage."""
    months = returns.select(*by, "mi").distinct().join(bench.select("mi", "r"), "mi") if by else bench
    everything = returns.select(*by, "asset", "mi", "r").unionByName(months.select(*by, F.lit("\u0000benchmark").alias("asset"), "mi", "r"))
    scalars = shrinkage(everything, by).select(*by, F.struct("rbar", "delta").alias("s"))
    per = (returns.join(bench.select("mi", F.col("r").alias("b")), "mi").groupBy(*by, "asset")
           .agg(F.stddev_samp("r").alias("sd"), F.covar_samp("r", "b").alias("cib"), F.stddev_samp("b").alias("sb"),
                (F.avg("r") * 12).alias("hist")))
    shr = F.col("s.delta") * F.col("s.rbar") * F.col("sd") * F.col("sb") + (1 - F.col("s.delta")) * F.col("cib")
    h = p.history_weight
    per = per.join(scalars, list(by)) if by else per.withColumn("s", scalars.scalar())
    return (per.withColumn("beta", F.try_divide(shr, F.col("sb") * F.col("sb")))
            .join(costs, "asset", "left").withColumn("rf", rf_now)
            .withColumn("mu", (1 - h) * (F.col("rf") + F.coalesce("beta", F.lit(1.0)) * p.market_risk_premium
                                         - F.coalesce("cost", F.lit(0.0)) / 100) + h * F.col("hist"))
            .select(*by, "asset", "sd", "beta", "hist", "mu", "rf", "s.rbar", "s.delta"))


def _on(table: DataFrame) -> list[str]:
    """A table of returns or estimates holds for all portfolios, or has rows of its own for each."""
    return [c for c in ("portfolio_id", "asset") if c in table.columns]


def selection_returns(weights: DataFrame, returns: DataFrame, bench: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(portfolio_id, asset, mi, r): the returns of a portfolio's own holdings over its own window, which is the estimation
    years' part of its unbroken months (``portfolio_mix``), 12 at least. Other portfolios' holdings play no part."""
    first = returns.agg(F.max("mi")).scalar() - 12 * p.estimation_years
    window = portfolio_mix(weights, returns).select("portfolio_id", "mi").where(F.col("mi") > first).join(bench.select("mi"), "mi", "left_semi")
    # a portfolio's months as one array, bounded by the window: its rows are made where its weights lie
    months = window.groupBy("portfolio_id").agg(F.collect_list("mi").alias("months")).where(F.size("months") >= 12)
    wanted = weights.select("portfolio_id", "asset").join(months, "portfolio_id").select("portfolio_id", "asset", F.explode("months").alias("mi"))
    return wanted.join(returns.select("asset", "mi", "r"), ["asset", "mi"]).select("portfolio_id", "asset", "mi", "r")


def mix_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Fixed-weight return per portfolio and month."""
    return (weights.join(returns, _on(returns)).groupBy("portfolio_id", "mi")
            .agg(F.sum(F.col("w") * F.col("r")).alias("r"), F.count(F.lit(1)).alias("n")))


def _target_part(w: Column, sd: Column) -> Column:
    ws = F.sum(w * sd)
    own = F.sum(w * w * sd * sd)
    return F.first("rbar") * (ws * ws - own) + own


def portfolio_perf(weights: DataFrame, returns: DataFrame, est: DataFrame) -> DataFrame:
    """Expected return, volatility and Sharpe per weight vector under the shrunk covariance."""
    mix = mix_returns(weights, returns).groupBy("portfolio_id").agg(F.var_samp("r").alias("v"))
    sums = (weights.join(est, _on(est)).groupBy("portfolio_id")
            .agg(F.sum(F.col("w") * F.col("mu")).alias("ret"), _target_part(F.col("w"), F.col("sd")).alias("target"),
                 F.first("delta").alias("delta"), F.first("rf").alias("rf")))
    var = 12 * (F.col("delta") * F.col("target") + (1 - F.col("delta")) * F.col("v"))
    return (sums.join(mix, "portfolio_id").withColumn("vol", F.sqrt(F.greatest(var, F.lit(0.0))))
            .select("portfolio_id", "ret", "vol", F.when(F.col("vol") > 1e-9, (F.col("ret") - F.col("rf")) / F.col("vol")).alias("sharpe")))


def risk_contribution(weights: DataFrame, returns: DataFrame, est: DataFrame) -> DataFrame:
    """Share of a portfolio's variance per holding, and how far it lies over the holding's weight."""
    mix = mix_returns(weights, returns).select("portfolio_id", "mi", F.col("r").alias("m"))
    cov = (weights.join(returns, _on(returns)).join(mix, ["portfolio_id", "mi"]).groupBy("portfolio_id", "asset")
           .agg(F.max("w").alias("w"), F.covar_samp("r", "m").alias("c")))
    ws = weights.join(est.select(*_on(est), "sd"), _on(est)).groupBy("portfolio_id").agg(F.sum(F.col("w") * F.col("sd")).alias("ws"))
    sw = (1 - F.col("delta")) * F.col("c") + F.col("delta") * (
        F.col("rbar") * F.col("sd") * (F.col("ws") - F.col("w") * F.col("sd")) + F.col("sd") * F.col("sd") * F.col("w"))
    part = (cov.join(est.select(*_on(est), "sd", "rbar", "delta"), _on(est)).join(ws, "portfolio_id")
            .select("portfolio_id", "asset", "w", (F.col("w") * sw).alias("part")))
    total = part.groupBy("portfolio_id").agg(F.sum("part").alias("total"))
    return (part.join(total, "portfolio_id")
            .withColumn("rc", F.when(F.col("total") > 0, F.col("part") / F.col("total")).otherwise(0.0))
            .select("portfolio_id", "asset", "w", "rc", (F.col("rc") - F.col("w")).alias("excess")))


def portfolio_mix(weights: DataFrame, returns: DataFrame, min_months: int = 13) -> DataFrame:
    """Fixed-weight returns over the unbroken months up to the last one in which every holding has data."""
    n = weights.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("holdings"))
    end = returns.agg(F.max("mi")).scalar()
    whole = (mix_returns(weights, returns).join(n, "portfolio_id").where(F.col("n") == F.col("holdings"))
             .withColumn("_end", end))
    back = W.partitionBy("portfolio_id").orderBy(F.col("mi").desc())          # months of one portfolio
    run = whole.withColumn("_i", F.row_number().over(back)).where(F.col("_end") - F.col("mi") == F.col("_i") - 1)
    return (run.withColumn("months", F.count(F.lit(1)).over(W.partitionBy("portfolio_id")))
            .where(F.col("months") >= min_months).select("portfolio_id", "mi", "r", "months"))


def largest_remainder(weights: DataFrame, total: int = 100) -> DataFrame:
    """Whole percent per holding that still sum to ``total``.

    At most ``total`` holdings of a portfolio can be rounded up, so only that many per portfolio are ranked
    (Spark limits them before the shuffle), however large the portfolio is."""
    pct = weights.withColumn("pct", F.col("w") * total).withColumn("whole", F.floor("pct"))
    rest = pct.groupBy("portfolio_id").agg((F.lit(total) - F.sum("whole")).alias("rest"))
    order = W.partitionBy("portfolio_id").orderBy((F.col("pct") - F.col("whole")).desc(), "asset")
    top = pct.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= total)
    up = top.join(rest, "portfolio_id").where(F.col("pos") <= F.col("rest")).select("portfolio_id", "asset", F.lit(1).alias("up"))
    return (pct.join(up, ["portfolio_id", "asset"], "left")
            .select("portfolio_id", "asset", (F.col("whole") + F.coalesce("up", F.lit(0))).cast("long").alias("pct")))


# ------------------------------------------------------------------ calendar rebalancing

def calendar_rebalance(weights: DataFrame, returns: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Back-test of fixed targets per (portfolio, rule): final value, turnover, costs and trades per year.

    Growth inside a segment depends on asset and rule only, so it is worked out once per asset, as one list, and joined to
    the weights where they lie; a portfolio's months are then plain sums."""
    span = returns.agg(F.struct(F.min("mi").alias("a"), F.max("mi").alias("b"))).scalar()
    grid = (returns.select("asset").distinct().withColumn("span", span)
            .select("asset", F.col("span.a").alias("start"), F.col("span.b").alias("stop"),
                    F.explode(F.sequence("span.a", "span.b")).alias("mi"))
            .join(returns, ["asset", "mi"], "left").withColumn("rule", F.explode(F.array(*[F.lit(r) for r in CAL_RULES]))))
    m = F.col("mi") % 12 + 1
    due = (F.when(F.col("rule") == "monthly", F.lit(True)).when(F.col("rule") == "quarterly", m % 3 == 0)
           .when(F.col("rule") == "annual", m == 12).otherwise(False)) & (F.col("mi") < F.col("stop"))
    order = W.partitionBy("asset", "rule").orderBy("mi")
    segs = (grid.withColumn("due", due)
            .withColumn("seg", F.coalesce(F.sum(F.col("due").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("g", F.product(1 + F.coalesce("r", F.lit(0.0))).over(
                W.partitionBy("asset", "rule", "seg").orderBy("mi").rowsBetween(W.unboundedPreceding, 0)))
            .where(F.col("due") | (F.col("mi") == F.col("stop"))).withColumn("n_months", F.col("stop") - F.col("start") + 1)
            .select("asset", "rule", "seg", "due", "n_months", "g"))
    # every asset has every segment, so a segment's place is the same in all lists; these are bounded by the calendar
    segs = stored(segs)
    places = stored(segs.select("rule", "seg", "due", "n_months").distinct().withColumn("at", F.row_number().over(W.orderBy("rule", "seg")) - 1))
    growth = stored(segs.join(places.select("rule", "seg", "at"), ["rule", "seg"]).groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("at", "g"))).alias("_l"))
                    .select("asset", F.transform("_l", lambda x: x["g"]).alias("_g")))
    # weights are placed by portfolio once; whatever follows has the portfolio among its keys, so a weight's segments are never shuffled
    held = stored(weights.select("portfolio_id", "asset", "w"))
    own = held.repartition(task_count(held, F.lit(places.count() / SEGMENTS)), "portfolio_id")
    keys = ["portfolio_id", "at"]
    worth = (own.join(growth, "asset").select("portfolio_id", "w", F.posexplode("_g").alias("at", "g"))
             .groupBy(*keys).agg(F.sum(F.col("w") * F.col("g")).alias("v"))
             .groupBy("portfolio_id").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("_l"))
             .select("portfolio_id", F.transform("_l", lambda x: x["v"]).alias("_v")))
    drift = (own.join(worth, "portfolio_id").join(growth, "asset").select("portfolio_id", "w", "_v", F.posexplode("_g").alias("at", "g"))
             .withColumn("v", F.get("_v", F.col("at"))))
    moved = (drift.groupBy(*keys).agg(F.max("v").alias("v"), F.sum(F.abs(F.col("w") - F.col("w") * F.col("g") / F.col("v"))).alias("traded"))
             .join(places, "at"))
    trade = F.col("due") & (F.col("traded") > 1e-9)
    done = (moved.withColumn("traded", F.when(trade, F.col("traded")).otherwise(0.0))
            .withColumn("cost", F.col("traded") * p.trading_cost))
    years = F.max("n_months") / 12
    return done.groupBy("portfolio_id", "rule").agg(
        F.product(F.col("v") * (1 - F.col("cost"))).alias("final_value"), (F.sum("traded") / 2 / years).alias("turnover_per_year"),
        (F.sum("cost") / years).alias("costs_per_year"), (F.count_if(F.col("traded") > 0) / years).alias("trades_per_year"))


# ------------------------------------------------------------------ weight scan

def simplex(scans: DataFrame, n: int, steps: int) -> DataFrame:
    """Every weight vector w1..wn with multiples of 1/steps that sum to 1, for each row of ``scans``."""
    left = F.lit(steps)
    for i in range(1, n):
        scans = scans.withColumn(f"k{i}", F.explode(F.sequence(F.lit(0), left)))
        left = left - F.col(f"k{i}")
    scans = scans.withColumn(f"k{n}", left)
    return scans.select(*[c for c in scans.columns if not c.startswith("k")], *[(F.col(f"k{i}") / steps).alias(f"w{i}") for i in range(1, n + 1)])


def weight_scan(models: DataFrame, n: int, steps: int, vol_bucket: float = 0.01) -> DataFrame:
    """Grid answers per scan: best Sharpe, least variance, best return per volatility bucket, equal and manual.

    ``models`` has one row per scan: mu array<n>, s array<n*n> (yearly covariance), hi array<n> (upper
    bounds), manual array<n>, rf. Bounds that cannot reach 100 % are lifted. Answers are exact on the grid."""
    lifted = F.transform("hi", lambda h: F.when(F.col("cap") < 1 - 1e-9, F.lit(1.0)).otherwise(h))
    base = models.withColumn("cap", F.aggregate("hi", F.lit(0.0), lambda a, h: a + h)).withColumn("hi", lifted)
    w = [F.col(f"w{i}") for i in range(1, n + 1)]
    grid = simplex(base, n, steps)
    ok = w[0] <= F.col("hi")[0] + 1e-9
    for i in range(1, n):
        ok = ok & (w[i] <= F.col("hi")[i] + 1e-9)
    grid = grid.where(ok).withColumn("set", F.lit("grid"))
    pos = F.transform("manual", lambda x: F.greatest(x, F.lit(0.0)))
    fixed = (base.withColumn("pos", pos).withColumn("sum", F.aggregate("pos", F.lit(0.0), lambda a, x: a + x))
             .withColumn("set", F.explode(F.array(F.lit("equal"), F.lit("manual")))))
    for i in range(n):
        fixed = fixed.withColumn(f"w{i + 1}", F.when((F.col("set") == "manual") & (F.col("sum") > 0), F.col("pos")[i] / F.col("sum"))
                                 .otherwise(F.lit(1.0 / n)))
    rows = grid.unionByName(fixed.drop("pos", "sum"))
    ret, var = F.lit(0.0), F.lit(0.0)
    for i in range(n):
        ret = ret + w[i] * F.col("mu")[i]
        for j in range(n):
            var = var + w[i] * w[j] * F.col("s")[i * n + j]
    rows = (rows.withColumn("ret", ret).withColumn("vol", F.sqrt(F.greatest(var, F.lit(0.0))))
            .withColumn("sharpe", F.when(F.col("vol") > 0, (F.col("ret") - F.col("rf")) / F.col("vol")))
            .withColumn("row", F.struct(*[f"w{i}" for i in range(1, n + 1)], "ret", "vol", "sharpe")))
    is_grid = F.col("set") == "grid"
    ws = F.struct(*w)
    best = rows.where(is_grid).groupBy("scan_id").agg(
        F.max_by("row", F.struct("sharpe", ws)).alias("max_sharpe"), F.min_by("row", F.struct("vol", ws)).alias("min_variance"))
    named = best.select("scan_id", F.lit(None).cast("long").alias("bucket"),
                        F.expr("stack(2, 'max_sharpe', max_sharpe, 'min_variance', min_variance) AS (kind, row)"))
    front = (rows.where(is_grid).groupBy("scan_id", F.floor(F.col("vol") / vol_bucket).alias("bucket"))
             .agg(F.max_by("row", F.struct("ret", ws)).alias("row")).withColumn("kind", F.lit("frontier")))
    plain = rows.where(~is_grid).select("scan_id", F.lit(None).cast("long").alias("bucket"), F.col("set").alias("kind"), "row")
    return named.unionByName(front).unionByName(plain).select("scan_id", "kind", "bucket", "row.*")


def risk_target_mix(frontier: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """Weights at a wanted volatility by linear interpolation between frontier rows, clamped at both ends."""
    ws = [f"w{i}" for i in range(1, n + 1)]
    line = W.partitionBy("scan_id").orderBy("vol")                             # frontier points of one scan
    seg = frontier.where(F.col("vol").isNotNull())
    for c in ["vol", *ws]:
        seg = seg.withColumn(f"{c}_a", F.lag(c).over(line))
    seg = (seg.withColumn("is_last", F.lead("vol").over(line).isNull()).join(targets, "scan_id")
           .where((F.col("target") <= F.col("vol")) | F.col("is_last"))
           .where(F.col("vol_a").isNull() | (F.col("target") > F.col("vol_a"))))
    f = (F.when(F.col("vol_a").isNull() | (F.col("target") > F.col("vol")), 1.0)
         .when(F.col("vol") > F.col("vol_a"), (F.col("target") - F.col("vol_a")) / (F.col("vol") - F.col("vol_a"))).otherwise(1.0))
    return seg.withColumn("f", f).select("scan_id", "target", *[
        (F.coalesce(f"{c}_a", c) + F.col("f") * (F.col(c) - F.coalesce(f"{c}_a", c))).alias(c) for c in ws])
