"""Queries over the price panel: cleaning, as-of joins, returns, performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import asof, timeseries as ts
from lodestar.params import DEFAULTS
from lodestar.plans.adapters import DUCK, SQL
from lodestar.plans.registry import query, shared, stage

BENCH = "Brand#1"

# ------------------------------------------------------------------ SQL forms shared by several oracles
DUCK["unitfix"] = """
SELECT asset, date, CASE WHEN n < 5 THEN close WHEN close / med BETWEEN 80 AND 125 THEN close / 100
                         WHEN close / med BETWEEN 0.008 AND 0.0125 THEN close * 100 ELSE close END AS close
FROM (SELECT *, count(*) OVER (PARTITION BY asset) AS n, quantile_cont(close, 0.5) OVER (PARTITION BY asset ORDER BY date
             ROWS BETWEEN 21 PRECEDING AND 21 FOLLOWING) AS med FROM {dirty} WHERE close > 0) s"""


def _pass(src: str) -> str:
    off = "coalesce(close / {0} > 1.3 OR close / {0} < 1 / 1.3, false)"
    return f"""
SELECT asset, date, close FROM (
  SELECT *, count(*) OVER (PARTITION BY asset) AS n, lag(date) OVER w IS NULL AS is_first, lead(date) OVER w IS NULL AS is_last,
         quantile_cont(close, 0.5) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING) AS back,
         quantile_cont(close, 0.5) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) AS fwd
  FROM {{{src}}} WINDOW w AS (PARTITION BY asset ORDER BY date)) s
WHERE n < 5 OR NOT (CASE WHEN is_first THEN {off.format('fwd')} WHEN is_last THEN {off.format('back')}
                         ELSE {off.format('back')} AND {off.format('fwd')} END)"""


DUCK["pass1"] = _pass("unitfix")
DUCK["clean"] = _pass("pass1")
DUCK["jumps"] = """
SELECT asset, date, close, n, n >= 3 AND (close / prev > 1.3 OR close / prev < 1 / 1.3) AS jump
FROM (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY date) AS prev, count(*) OVER (PARTITION BY asset) AS n FROM {clean}) s"""
DUCK["trimmed"] = """
SELECT j.asset, j.date, j.close, c.n_jumps, j.n AS n_clean
FROM {jumps} j JOIN (SELECT asset, max(date) FILTER (jump) AS cut, count(*) FILTER (jump) AS n_jumps FROM {jumps} GROUP BY asset) c
  ON j.asset = c.asset AND (c.cut IS NULL OR j.date >= c.cut)"""
DUCK["paid"] = """
SELECT d.asset, p.date, sum(d.amount) AS amount
FROM {divs} d ASOF JOIN {panel} p ON d.asset = p.asset AND d.date <= p.date GROUP BY d.asset, p.date"""


def _tr(src: str) -> str:
    return f"""
SELECT asset, date, close, exp(lg) * last_close / exp(last_lg) AS tr FROM (
  SELECT *, last_value(close) OVER f AS last_close, last_value(lg) OVER f AS last_lg FROM (
    SELECT asset, date, close, sum(coalesce(ln(g), 0)) OVER (PARTITION BY asset ORDER BY date) AS lg FROM (
      SELECT c.asset, c.date, c.close, (c.close + coalesce(d.amount, 0)) / lag(c.close) OVER (PARTITION BY c.asset ORDER BY c.date) AS g
      FROM {{{src}}} c LEFT JOIN (SELECT d.asset, p.date, sum(d.amount) AS amount FROM {{divs}} d
           ASOF JOIN {{{src}}} p ON d.asset = p.asset AND d.date <= p.date GROUP BY d.asset, p.date) d
        ON c.asset = d.asset AND c.date = d.date) a) b
  WINDOW f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) c"""


DUCK["tr_panel"] = _tr("panel")
DUCK["tr_clean"] = _tr("trimmed")
DUCK["subunit"] = """
SELECT asset, CASE currency WHEN 'GBp' THEN 'GBP' WHEN 'GBX' THEN 'GBP' WHEN 'ZAc' THEN 'ZAR' WHEN 'ILA' THEN 'ILS' ELSE currency END AS currency,
       CASE WHEN currency IN ('GBp', 'GBX', 'ZAc', 'ILA') THEN 0.01 ELSE 1.0 END::DOUBLE AS factor FROM {asset_ccy}"""


def _in_base(src: str, col: str) -> str:
    return f"""
SELECT asset, date, v AS close FROM (
  SELECT p.asset, p.date, p.{col} * u.factor * CASE WHEN u.currency = 'NOK' THEN 1.0 ELSE r.rate END AS v
  FROM {{{src}}} p JOIN {{subunit}} u ON p.asset = u.asset
  ASOF LEFT JOIN {{fx}} r ON r.currency = u.currency AND r.date <= p.date) s WHERE v IS NOT NULL"""


DUCK["base_prices"] = _in_base("tr_clean", "tr")
DUCK["base_panel"] = _in_base("panel", "close")
DUCK["last_month"] = """
SELECT CASE WHEN last_day(m) - m <= 3 THEN last_day(m) ELSE CAST(date_trunc('month', m) - INTERVAL 1 DAY AS DATE) END AS e
FROM (SELECT max(date) AS m FROM {panel}) s"""
DUCK["mret"] = """
SELECT asset, mi, r FROM (
  SELECT asset, mi, v / lag(v) OVER (PARTITION BY asset ORDER BY mi) - 1 AS r FROM (
    SELECT g.asset, g.mi, last_value(m.v IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.mi) AS v
    FROM (SELECT asset, unnest(generate_series(min(mi), max(mi))) AS mi FROM month_ends GROUP BY asset) g
    LEFT JOIN month_ends m ON g.asset = m.asset AND g.mi = m.mi) f) s WHERE r IS NOT NULL"""
DUCK["month_ends"] = """
SELECT asset, year(date) * 12 + month(date) - 1 AS mi, arg_max(close, date) AS v
FROM {panel} WHERE date <= (SELECT e FROM {last_month}) GROUP BY 1, 2 HAVING last_day(max(date)) - max(date) <= 7"""
DUCK["mret"] = DUCK["mret"].replace("month_ends", "{month_ends}")
DUCK["daily_rate"] = """
SELECT d.date, coalesce(p.rate, f.rate) AS rate, p.rate IS NULL AS from_fallback
FROM (SELECT CAST(unnest(generate_series(least((SELECT min(date) FROM {policy}), (SELECT min(date) FROM {fallback})),
             greatest((SELECT max(date) FROM {policy}), (SELECT max(date) FROM {fallback}), (SELECT max(date) FROM {panel})), INTERVAL 1 DAY)) AS DATE) AS date) d
ASOF LEFT JOIN {policy} p ON p.date <= d.date ASOF LEFT JOIN {fallback} f ON f.date <= d.date
WHERE d.date <= (SELECT max(date) FROM {panel}) OR d.date IN (SELECT date FROM {policy}) OR d.date IN (SELECT date FROM {fallback})"""
DUCK["rfm"] = """
SELECT m.mi, pow(1 + coalesce(a.a, (SELECT arg_min(a, mi) FROM rate_months)), 1 / 12.0::DOUBLE) - 1 AS rf
FROM (SELECT DISTINCT mi FROM {mret}) m LEFT JOIN rate_months a ON m.mi = a.mi"""
DUCK["rate_months"] = "SELECT year(date) * 12 + month(date) - 1 AS mi, avg(rate) / 100 AS a FROM {daily_rate} GROUP BY 1"
DUCK["rfm"] = DUCK["rfm"].replace("rate_months", "{rate_months}")


# ------------------------------------------------------------------ operator outputs shared by queries
@stage
def mret(t):
    # every statistic reads this small table instead of the daily prices
    return ts.monthly_returns(t.panel)


@shared
def daily_rate(t):
    return ts.daily_rates(t.policy, t.fallback, t.panel.agg(F.max("date")).scalar())


@stage
def rfm(t):
    return ts.rf_monthly(t.mret.select("mi").distinct(), t.daily_rate)


@shared
def bench(t):
    return t.mret.where(F.col("asset") == BENCH).select("mi", "r")


@shared
def perf(t):
    return ts.performance_stats(t.mret, t.bench, t.rfm)


# ------------------------------------------------------------------ cleaning
@query("unit_flip_fix", "unitfix", "SELECT asset, date, R6(close) AS close FROM unitfix")
def _(t):
    return ts.unit_flip_fix(t.dirty)


@query("spike_removal", "clean", "SELECT asset, date, R6(close) AS close FROM clean")
def _(t):
    return ts.spike_removal(ts.unit_flip_fix(t.dirty))


@query("jump_trim", "trimmed", "SELECT asset, date, R6(close) AS close, n_jumps, n_clean FROM trimmed")
def _(t):
    return ts.clean_series(t.dirty)


@query("asof_forward", "paid", "SELECT asset, date, R6(amount) AS amount FROM paid")
def _(t):
    return asof.asof_forward(t.panel, t.divs)


@query("total_return_index", "tr_panel", "SELECT asset, date, R6(close) AS close, R6(tr) AS tr FROM tr_panel")
def _(t):
    return ts.total_return_index(t.panel, t.divs)


@query("subunit_map_join", "subunit", "SELECT asset, currency, factor FROM subunit")
def _(t):
    return asof.subunit_map_join(t.asset_ccy)


@query("asof_backward", "base_panel", "SELECT asset, date, R6(close) AS close FROM base_panel")
def _(t):
    units = asof.subunit_map_join(t.asset_ccy)
    priced = t.panel.join(units, "asset").withColumn("close", F.col("close") * F.col("factor"))
    return asof.asof_backward(priced, t.fx).select("asset", "date", "close")


@query("nok_prices", "base_prices", "SELECT asset, date, R6(close) AS close FROM base_prices")
def _(t):
    return ts.nok_prices(t.dirty, t.divs, t.fx, t.asset_ccy)


@query("cleaning_counts", "trimmed clean", """
SELECT r.asset, r.n - coalesce(k.n_clean, 0) AS removed, coalesce(k.jumps, 0) AS jumps, coalesce(k.n_clean - k.n_kept, 0) AS trimmed
FROM (SELECT asset, count(*) AS n FROM dirty GROUP BY asset) r
LEFT JOIN (SELECT asset, max(n_jumps) AS jumps, max(n_clean) AS n_clean, count(*) AS n_kept FROM trimmed GROUP BY asset) k USING (asset)""")
def _(t):
    return ts.cleaning_counts(t.dirty)


AS_OF = "DATE '2001-10-20'"


@query("asof_tolerance", "panel", f"""
WITH ends AS (SELECT asset, arg_max(close, date) AS c FROM panel WHERE date <= {AS_OF} GROUP BY asset HAVING {AS_OF} - max(date) <= 10),
b AS (SELECT a.asset, y, arg_max(p.close, p.date) AS c, CAST({AS_OF} - to_years(CAST(y AS INT)) AS DATE) - max(p.date) AS age
      FROM ends a CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS y) JOIN panel p
        ON p.asset = a.asset AND p.date <= CAST({AS_OF} - to_years(CAST(y AS INT)) AS DATE) GROUP BY a.asset, y),
r AS (SELECT e.asset, b.y, round(pow(e.c / b.c, 1.0::DOUBLE / b.y) - 1, 5) + 0.0 AS r FROM ends e JOIN b ON e.asset = b.asset WHERE b.age <= 10)
SELECT asset, max(r) FILTER (y = 1) AS r1, max(r) FILTER (y = 3) AS r3, max(r) FILTER (y = 5) AS r5, max(r) FILTER (y = 10) AS r10
FROM r GROUP BY asset""")
def _(t):
    return asof.asof_tolerance(t.panel, F.expr(AS_OF))


@query("trailing_day_returns", "panel", f"""
WITH e AS (SELECT asset, max(date) AS d, arg_max(close, date) AS c FROM panel WHERE date <= {AS_OF} GROUP BY asset HAVING {AS_OF} - max(date) <= 10)
SELECT e.asset, R6((e.c / b1.close - 1) * 100) AS d365, R6((e.c / b3.close - 1) * 100) AS d1095
FROM (SELECT asset, d, c, d - 365 AS t1, d - 1095 AS t3 FROM e) e
ASOF LEFT JOIN panel b1 ON b1.asset = e.asset AND b1.date <= e.t1
ASOF LEFT JOIN panel b3 ON b3.asset = e.asset AND b3.date <= e.t3
WHERE (b1.date IS NULL OR e.t1 - b1.date <= 10) AND (b3.date IS NULL OR e.t3 - b3.date <= 10)""")
def _(t):
    return asof.trailing_day_returns(t.panel, F.expr(AS_OF), [365, 1095])


# ------------------------------------------------------------------ returns
@query("monthly_returns", "mret", """
SELECT asset, mi, last_day(make_date(CAST(mi // 12 AS INT), CAST(mi % 12 + 1 AS INT), 1)) AS month, R8(r) AS r FROM mret""", digits=8)
def _(t):
    return t.mret.withColumn("month", ts.month_end(F.col("mi")))


def _period_sql(period: str, end: str) -> str:
    return f"""
WITH cal AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM panel) d),
dense AS (SELECT a.asset, c.date, c.pos, p.close FROM (SELECT DISTINCT asset FROM panel) a CROSS JOIN cal c LEFT JOIN panel p ON p.asset = a.asset AND p.date = c.date),
sm AS (SELECT asset, date, avg(close) OVER w AS v, count(close) OVER w AS c FROM dense WINDOW w AS (PARTITION BY asset ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
per AS (SELECT asset, CAST({period} AS BIGINT) AS period, arg_max(v, date) AS v, max(CAST({end} AS DATE)) AS period_end FROM sm WHERE c >= 2 GROUP BY 1, 2),
ok AS (SELECT * FROM per WHERE period_end <= (SELECT max(date) FROM panel)),
ret AS (SELECT a.asset, a.period, a.period_end, a.v / b.v - 1 AS r FROM ok a JOIN ok b ON a.asset = b.asset AND a.period = b.period + 1)
SELECT asset, period, period_end, R8(r) AS r FROM ret WHERE period > (SELECT max(period) FROM ok) - 60"""


@query("period_returns", "panel", _period_sql("year(date) * 12 + month(date)", "last_day(date)"), digits=8)
def _(t):
    return ts.period_returns(t.panel, "ME")


@query("period_returns_weekly", "panel", _period_sql(
    "floor((date - DATE '1970-01-01' + 5) / 7.0)", "date + (5 - dayofweek(date) + 7) % 7 * INTERVAL 1 DAY"), digits=8)
def _(t):
    return ts.period_returns(t.panel, "W-FRI")


@query("period_returns_quarterly", "panel", _period_sql(
    "year(date) * 4 + quarter(date)", "last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE))"), digits=8)
def _(t):
    return ts.period_returns(t.panel, "QE")


@query("rate_fallback_join", "daily_rate", "SELECT date, R6(rate) AS rate, from_fallback FROM daily_rate WHERE rate IS NOT NULL")
def _(t):
    return t.daily_rate


@query("rf_monthly", "rfm", "SELECT mi, R8(rf) AS rf FROM rfm", digits=8)
def _(t):
    return t.rfm


PACKED = """
SELECT asset, min(mi) - (SELECT min(mi) FROM mret) AS offset_, string_agg(CAST(CAST(round_even(r * 10000, 0) AS INT) AS VARCHAR), ',' ORDER BY mi) AS packed
FROM mret GROUP BY asset HAVING count(*) >= 2"""


@query("pack_returns", "mret", PACKED)
def _(t):
    p = ts.pack_returns(t.mret)
    return p.select("asset", F.col("offset").alias("offset_"), F.array_join(F.transform("packed", lambda x: x.cast("string")), ",").alias("packed"))


@query("unpack_returns", "mret", """
SELECT asset, mi - (SELECT min(mi) FROM mret) AS pos, R6(round_even(r * 10000, 0) / 10000) AS r FROM mret""")
def _(t):
    return ts.unpack_returns(ts.pack_returns(t.mret))


# ------------------------------------------------------------------ performance
DUCK["perf"] = f"""
SELECT asset, y AS years, ret, vol, CASE WHEN vol > 0 THEN (ret - rf) / vol END AS sharpe, mdd, rf,
       CASE WHEN nb = n THEN beta END AS beta, CASE WHEN nb = n THEN pow(1 + am, 12) - 1 END AS alpha, CASE WHEN nb = n THEN rho * rho END AS r2,
       CASE WHEN nb = n THEN te END AS te, CASE WHEN nb = n AND te > 1e-9 THEN (ret - bret) / te END AS ir, CASE WHEN nb = n THEN ret - bret END AS excess
FROM (SELECT asset, y, count(*) AS n, count(b) AS nb, pow(product(1 + r), 12.0::DOUBLE / count(*)) - 1 AS ret, stddev_samp(r) * sqrt(12) AS vol, min(dd) AS mdd,
             pow(product(1 + rf), 12.0::DOUBLE / count(*)) - 1 AS rf, pow(product(1 + b), 12.0::DOUBLE / count(*)) - 1 AS bret,
             regr_slope(r - rf, b - rf) AS beta, regr_intercept(r - rf, b - rf) AS am, corr(r - rf, b - rf) AS rho, stddev_samp(r - b) * sqrt(12) AS te
      FROM (SELECT *, v / greatest(1, max(v) OVER w) - 1 AS dd FROM (
              SELECT m.asset, m.mi, m.r, f.rf, k.r AS b, y.y, product(1 + m.r) OVER (PARTITION BY m.asset, y.y ORDER BY m.mi) AS v
              FROM {{mret}} m JOIN {{rfm}} f ON m.mi = f.mi LEFT JOIN {{mret}} k ON k.asset = '{BENCH}' AND k.mi = m.mi
              JOIN (SELECT unnest([1, 3, 5, 10]) AS y) y ON m.mi > (SELECT max(mi) FROM {{mret}}) - 12 * y.y) a
            WINDOW w AS (PARTITION BY asset, y ORDER BY mi)) b
      GROUP BY asset, y HAVING count(*) = 12 * y) c"""


@query("performance_stats", "perf", """
SELECT asset, CAST(years AS BIGINT) AS years, R6(ret) AS ret, R6(vol) AS vol, R6(sharpe) AS sharpe, R6(mdd) AS mdd, R6(rf) AS rf, R6(beta) AS beta,
       R6(alpha) AS alpha, R6(r2) AS r2, R6(te) AS te, R6(ir) AS ir, R6(excess) AS excess FROM perf""")
def _(t):
    return t.perf


@query("drawdown_series", "mret", """
SELECT asset, mi, R6(value) AS value, R6(value / greatest(1, max(value) OVER (PARTITION BY asset ORDER BY mi)) - 1) AS drawdown
FROM (SELECT asset, mi, product(1 + r) OVER (PARTITION BY asset ORDER BY mi) AS value FROM mret) s""")
def _(t):
    return ts.drawdown_series(t.mret)


@query("growth_index", "mret", """
WITH e AS (SELECT max(mi) AS e FROM mret),
g AS (SELECT asset, unnest(generate_series((SELECT e - 59 FROM e), (SELECT e FROM e))) AS mi FROM (SELECT DISTINCT asset FROM mret) a),
v AS (SELECT g.asset, g.mi, coalesce(m.r, 0) AS r, 100 * product(1 + coalesce(m.r, 0)) OVER (PARTITION BY g.asset ORDER BY g.mi) AS value
      FROM g LEFT JOIN mret m ON m.asset = g.asset AND m.mi = g.mi),
firsts AS (SELECT asset, value FROM v WHERE mi = (SELECT e FROM e))
SELECT asset, mi, R6(value) AS value, R6(r) AS path_return, asset = (SELECT arg_max(asset, value) FROM firsts) AS is_best FROM v""")
def _(t):
    path = ts.growth_index(t.mret, 5)
    shown = path.where(F.col("mi") == t.mret.agg(F.max("mi")).scalar())
    return path.withColumn("is_best", F.col("asset") == shown.agg(F.max_by("asset", "value")).scalar())


def story_sql(src: str, key: str) -> str:
    return f"""
WITH base AS (SELECT {key}, mi, r FROM {src} UNION ALL SELECT {key}, min(mi) - 1, 0 FROM {src} GROUP BY {key}),
v AS (SELECT {key}, mi, row_number() OVER w - 1 AS k, product(1 + r) OVER w AS v, count(*) OVER (PARTITION BY {key}) - 1 AS n FROM base WINDOW w AS (PARTITION BY {key} ORDER BY mi)),
x AS (SELECT *, max(v) OVER w AS top, v / lag(v, 12) OVER w - 1 AS roll, v > coalesce(max(v) OVER (PARTITION BY {key} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS newtop
      FROM v WHERE n >= 13 WINDOW w AS (PARTITION BY {key} ORDER BY k)),
y AS (SELECT *, last_value(CASE WHEN newtop THEN k END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY k) AS pk, v / top - 1 AS dd FROM x),
f AS (SELECT DISTINCT ON ({key}) {key}, dd AS depth, pk, k AS tr, top AS pv FROM y ORDER BY {key}, dd, k),
rec AS (SELECT y.{key}, min(k) AS back FROM y JOIN f ON f.{key} = y.{key} AND y.k > f.tr AND y.v >= f.pv GROUP BY y.{key}),
ro AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY roll, k) AS rk, count(*) OVER (PARTITION BY {key}) AS m FROM y WHERE roll IS NOT NULL),
q AS (SELECT {key}, max(n) AS months, min(roll) AS worst_ret, arg_min(mi, (roll, k)) AS worst_to, max(roll) AS best_ret, arg_min(mi, (-roll, k)) AS best_to,
             max(roll) FILTER (rk = floor(0.5 * (m - 1) + 0.5) + 1) AS median, max(roll) FILTER (rk = floor(0.1 * (m - 1) + 0.5) + 1) AS bad,
             count(*) FILTER (roll < 0) / count(*) AS neg_share FROM ro GROUP BY {key}),
m0 AS (SELECT {key}, min(mi) AS m0 FROM y GROUP BY {key})
SELECT q.{key}, q.months, R6(worst_ret) AS worst_ret, worst_to - 11 AS worst_from, worst_to, R6(best_ret) AS best_ret, best_to - 11 AS best_from, best_to,
       R6(median) AS median, R6(bad) AS bad, R6(neg_share) AS neg_share, R6(depth) AS depth, m0 + pk AS peak, m0 + tr AS trough, m0 + back AS recovered,
       tr - pk AS months_down, back - tr AS months_back, months - tr AS months_since_trough
FROM q JOIN f USING ({key}) JOIN m0 USING ({key}) LEFT JOIN rec USING ({key})"""


@query("risk_story", "mret", story_sql("mret", "asset"))
def _(t):
    return ts.risk_story(t.mret)


# brands start one to twelve quarters late, clusters are groups of five brand numbers
SQL["late"] = """
SELECT m.asset, m.mi, m.r FROM {mret} m JOIN (SELECT asset, min(mi) AS f FROM {mret} GROUP BY asset) s ON m.asset = s.asset
WHERE m.mi >= s.f + 3 * (CAST(substr(m.asset, 7) AS INT) % 12)"""
SQL["clusters5"] = "SELECT DISTINCT p_brand AS asset, CAST(substr(p_brand, 7) AS INT) % 5 AS cluster FROM {part}"


@query("donor_backfill", "late clusters5", """
WITH s AS (SELECT asset, cluster, min(mi) AS f0 FROM late JOIN clusters5 USING (asset) GROUP BY asset, cluster),
cand AS (SELECT s.asset, l.mi, l.r, row_number() OVER (PARTITION BY s.asset, l.mi ORDER BY d.f0, d.asset) AS rk, s.f0
         FROM s JOIN s d ON d.cluster = s.cluster AND d.asset <> s.asset JOIN late l ON l.asset = d.asset AND l.mi < s.f0),
best AS (SELECT asset, mi, r, f0, f0 - mi AS back, row_number() OVER (PARTITION BY asset ORDER BY mi DESC) AS step FROM cand WHERE rk = 1)
SELECT asset, mi, R6(r) AS r, false AS filled FROM late UNION ALL SELECT asset, mi, R6(r), true FROM best WHERE back = step""")
def _(t):
    return ts.donor_backfill(t.late, t.clusters5)


@query("series_bounds", "panel", """
SELECT asset, min(date) AS first_date, max(date) AS last_date, R2(((SELECT max(date) FROM panel) - min(date)) / 365.25::DOUBLE) AS history_years
FROM panel GROUP BY asset""")
def _(t):
    return ts.series_bounds(t.panel)


@query("calendar_year_returns", "mret", """
SELECT asset, CAST(mi // 12 AS BIGINT) AS year, R6(product(1 + r) - 1) AS ret, count(*) AS months, count(*) = 12 AND product(1 + r) >= 1 AS positive_full_year
FROM mret GROUP BY asset, mi // 12""")
def _(t):
    return ts.calendar_year_returns(t.mret)
