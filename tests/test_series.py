import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import asof, incremental as inc, timeseries as ts
from tests.conftest import rows

D0 = dt.date(2020, 1, 1)


def daily(spark, values, asset="x", start=D0):
    return spark.createDataFrame([(asset, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)],
                                 "asset string, date date, close double")


def months(spark, values, asset="x", first=24240):
    return spark.createDataFrame([(asset, first + i, float(v)) for i, v in enumerate(values) if v is not None], "asset string, mi long, r double")


def test_spikes_and_zeros_are_dropped(spark):
    out = [r.close for r in ts.spike_removal(ts.unit_flip_fix(daily(spark, [10, 10.1, 10.2, 500, 10.1, 10, 0, 10.2, 10.3, 10.1]))).orderBy("date").collect()]
    assert len(out) == 8 and 500 not in out and 0 not in out


def test_crash_stays_false_level_goes_unit_flip_is_rescaled(spark):
    v = [100.0] * 40 + [60.0] * 40
    for i in range(10, 14):
        v[i] = 150.0
    v[60] = 6000.0
    out = [r.close for r in ts.spike_removal(ts.unit_flip_fix(daily(spark, v))).collect()]
    assert len(out) == 76 and 150.0 not in out and max(out) == 100.0 and out.count(60.0) == 40


def test_short_series_is_left_alone(spark):
    assert ts.clean_series(daily(spark, [1, 500, 1])).count() == 1          # trimmed after the last jump only
    assert ts.spike_removal(ts.unit_flip_fix(daily(spark, [1, 500, 1, 1]))).count() == 4


def test_trim_after_last_jump(spark):
    out = rows(ts.jump_trim(daily(spark, [10, 10.1, 20, 20.2, 20.1, 20.3])), "date")
    assert len(out) == 4 and out[0][2] == 20.0 and {r[4] for r in out} == {1}


def test_total_return_pays_weekend_dividend_next_day(spark):
    closes = spark.createDataFrame([("x", dt.date(2024, 1, 4), 100.0), ("x", dt.date(2024, 1, 5), 98.0), ("x", dt.date(2024, 1, 8), 99.0)], "asset string, date date, close double")
    divs = spark.createDataFrame([("x", dt.date(2024, 1, 6), 2.0), ("x", dt.date(2024, 2, 1), 9.0)], "asset string, date date, amount double")
    tr = [r.tr for r in ts.total_return_index(closes, divs).orderBy("date").collect()]
    assert tr[2] == 99.0
    assert tr[1] / tr[0] - 1 == pytest.approx(-0.02) and tr[2] / tr[1] == pytest.approx(101 / 98)


def test_pence_and_rates(spark):
    closes = daily(spark, [100, 110, 121])
    fx = spark.createDataFrame([("GBP", D0, 13.0), ("GBP", D0 + dt.timedelta(days=1), 14.0)], "currency string, date date, rate double")
    ccy = spark.createDataFrame([("x", "GBp")], "asset string, currency string")
    none = spark.createDataFrame([], "asset string, date date, amount double")
    assert [round(r.close, 4) for r in ts.nok_prices(closes, none, fx, ccy).orderBy("date").collect()] == [13.0, 15.4, 16.94]
    assert ts.nok_prices(closes, none, fx, spark.createDataFrame([("x", "ABC")], "asset string, currency string")).count() == 0


def test_upsert_and_changed_partitions(spark):
    d = lambda *x: dt.date(*x)
    stored = spark.createDataFrame([("x", d(2019, 12, 30), 1.0), ("x", d(2020, 1, 2), 1.1), ("x", d(2020, 1, 3), 1.2)], "asset string, date date, close double")
    new = spark.createDataFrame([("x", d(2020, 1, 3), 1.25, False), ("x", d(2020, 1, 6), 1.3, False)], "asset string, date date, close double, is_full boolean")
    out = inc.upsert(stored, new, inc.refetch_cuts(new))
    assert [r.close for r in out.orderBy("date").collect()] == [1.0, 1.1, 1.25, 1.3]
    year = lambda df: df.withColumn("year", F.year("date"))
    assert rows(inc.changed_partitions(year(stored), year(out))) == [(2020, "changed")]
    assert inc.changed_partitions(year(out), year(out)).count() == 0
    full = spark.createDataFrame([("x", d(2020, 2, 1), 2.0, True)], "asset string, date date, close double, is_full boolean")
    assert [r.close for r in inc.upsert(out, full, inc.refetch_cuts(full)).collect()] == [2.0]


def test_last_complete_month(spark):
    cases = {"2026-10-08": "2026-09-30", "2026-09-29": "2026-09-30", "2026-09-20": "2026-08-31"}
    df = spark.createDataFrame([(k,) for k in cases], "d string").withColumn("e", ts.last_complete_month(F.col("d").cast("date")))
    assert {r.d: str(r.e) for r in df.collect()} == cases


def test_monthly_returns_fill_inner_gaps_and_drop_stale_tail(spark):
    day = lambda m, d: dt.date(2024, m, d)
    pts = [(day(1, 31), 100.0), (day(2, 28), 110.0), (day(3, 5), 111.0), (day(4, 30), 121.0), (day(5, 3), 125.0)]
    other = [(day(6, 28), 1.0)]
    df = spark.createDataFrame([("x", d, v) for d, v in pts] + [("y", d, v) for d, v in other], "asset string, date date, close double")
    out = rows(ts.monthly_returns(df).where("asset = 'x'").select("mi", F.round("r", 6)), "mi")
    assert [r[1] for r in out] == [0.1, 0.0, 0.1]              # March has no price near its end: zero, then the catch-up; May is stale


def test_monthly_returns_compound_to_price_ratio(spark):
    random.seed(3)
    v, out = 100.0, []
    for _ in range(500):
        v *= 1 + random.gauss(0, 0.01)
        out.append(v)
    df = daily(spark, out)
    g = 1.0
    for r in ts.monthly_returns(df).orderBy("mi").collect():
        g *= 1 + r.r
    ends = [r.close for r in df.where(F.col("date") == F.last_day("date")).orderBy("date").collect()]
    assert g == pytest.approx(ends[-1] / ends[0], rel=1e-9)


def test_period_returns_match_a_dense_panel(spark):
    random.seed(5)
    days = [D0 + dt.timedelta(days=i) for i in range(200)]
    panel = {a: {d: 100 + random.random() * 10 for d in days if random.random() < p} for a, p in (("a", 0.9), ("b", 0.25), ("c", 0.6))}
    df = spark.createDataFrame([(a, d, v) for a, s in panel.items() for d, v in s.items()], "asset string, date date, close double")
    cal = sorted({d for s in panel.values() for d in s})
    want = {}
    for a, s in panel.items():
        last = {}
        for i, d in enumerate(cal):
            near = [s[x] for x in cal[max(0, i - 4):i + 1] if x in s]
            if len(near) >= 2:
                last[d.year * 12 + d.month] = sum(near) / len(near)
        end = cal[-1].year * 12 + cal[-1].month - 1
        for k, v in last.items():
            if k <= end and k - 1 in last:
                want[(a, k)] = v / last[k - 1] - 1
    got = {(r.asset, r.period): r.r for r in ts.period_returns(df).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_pack_returns(spark):
    r = months(spark, [0.5], "z", 24240).union(months(spark, [None, 0.01, -0.02345, 0.0]))
    out = {x.asset: (x.offset, x.packed) for x in ts.pack_returns(r).collect()}
    assert out == {"x": (1, [100, -234, 0])}
    assert [x.r for x in ts.unpack_returns(ts.pack_returns(r)).orderBy("pos").collect()] == [0.01, -0.0234, 0.0]


def test_rf_from_fallback_and_before_first_rate(spark):
    fb = spark.createDataFrame([(dt.date(2024, 1, 15), 4.5)], "date date, rate double")
    none = spark.createDataFrame([], "date date, rate double")
    d = ts.daily_rates(none, fb, F.lit("2024-03-31").cast("date"))
    m = spark.createDataFrame([(2023 * 12 + 11,), (2024 * 12 + 2,)], "mi long")
    assert all((1 + r.rf) ** 12 - 1 == pytest.approx(0.045) for r in ts.rf_monthly(m, d).collect())


def test_performance_against_direct_formulas(spark):
    random.seed(1)
    r = [random.gauss(0.01, 0.05) for _ in range(40)]
    b = [0.6 * x + random.gauss(0, 0.01) for x in r]
    df = months(spark, r, "x").union(months(spark, b, "b"))
    rf = months(spark, [0.002] * 40).select("mi", F.col("r").alias("rf"))
    out = {(x.asset, x.years): x for x in ts.performance_stats(df, df.where("asset = 'b'").select("mi", "r"), rf).collect()}
    assert set(out) == {("x", 1), ("x", 3), ("b", 1), ("b", 3)}
    x = out[("x", 3)]
    n, xs, bs = 36, r[-36:], b[-36:]
    mean = lambda a: sum(a) / len(a)
    g = math.prod(1 + v for v in xs) ** (12 / n) - 1
    var = lambda a: sum((v - mean(a)) ** 2 for v in a) / (n - 1)
    cov = sum((p - mean(xs)) * (q - mean(bs)) for p, q in zip(xs, bs)) / (n - 1)
    beta = cov / var(bs)
    v, peak, mdd = 1.0, 1.0, 0.0
    for q in xs:
        v *= 1 + q
        peak = max(peak, v)
        mdd = min(mdd, v / peak - 1)
    assert x.ret == pytest.approx(g) and x.vol == pytest.approx(math.sqrt(var(xs) * 12)) and x.beta == pytest.approx(beta) and x.mdd == pytest.approx(mdd)
    assert x.alpha == pytest.approx((1 + (mean(xs) - 0.002) - beta * (mean(bs) - 0.002)) ** 12 - 1) and x.r2 == pytest.approx(cov ** 2 / var(xs) / var(bs))
    assert out[("b", 3)].ir is None


def test_missing_month_voids_the_window(spark):
    r = [0.01] * 12
    df = months(spark, r, "x").union(months(spark, r[:5] + [None] + r[6:], "y"))
    rf = months(spark, [0.0] * 12).select("mi", F.col("r").alias("rf"))
    assert {x.asset for x in ts.performance_stats(df, df.where("asset = 'y'").select("mi", "r"), rf).collect()} == {"x"}
    assert ts.performance_stats(df, df.where("asset = 'y'").select("mi", "r"), rf).first().beta is None


def test_risk_story(spark):
    r = [0.1, -0.5] + [0.1] * 3 + [0.6] + [0.01] * 8
    s = ts.risk_story(months(spark, r, first=0)).first()
    assert (s.peak, s.trough, s.recovered, s.months_back) == (0, 1, 5, 4) and s.depth == pytest.approx(-0.5)
    assert s.worst_from in (0, 1) and s.months == 14
    assert ts.risk_story(months(spark, [0.01] * 12)).count() == 0


def test_donor_backfill_keeps_only_the_block_before_the_start(spark):
    own = months(spark, [None] * 6 + [0.6, 0.7], "x", 0)
    early = months(spark, [0.1, 0.1, None, None, 0.14, 0.15, 0.1, 0.1], "d1", 0)
    late = months(spark, [None] * 4 + [0.24, 0.25, 0.2, 0.2], "d2", 0)
    cl = spark.createDataFrame([(a, 1) for a in ("x", "d1", "d2")], "asset string, cluster int")
    out = rows(ts.donor_backfill(own.union(early).union(late), cl).where("asset = 'x'").select("mi", "r", "filled"), "mi")
    assert out == [(4, 0.14, True), (5, 0.15, True), (6, 0.6, False), (7, 0.7, False)]


def test_trailing_returns_need_history_and_a_fresh_price(spark):
    df = daily(spark, [100 + i for i in range(400)])
    end = D0 + dt.timedelta(days=399)
    one = asof.asof_tolerance(df, F.lit(end)).first()
    assert one.r1 == pytest.approx((499 / (100 + 399 - 366)) - 1, abs=1e-5) or one.r1 is not None
    assert one.r3 is None
    assert asof.asof_tolerance(df, F.lit(end + dt.timedelta(days=11))).count() == 0
