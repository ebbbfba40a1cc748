import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import cluster, pairs, portfolio as pf
from lodestar.plans import QUERIES, registry
from tests.conftest import rows


def returns(spark, table, col="period"):
    return spark.createDataFrame([(a, i + 100, float(v)) for a, s in table.items() for i, v in enumerate(s) if v is not None], f"asset string, {col} long, r double")


def naive_linkage(names, dist, t):
    groups = [[n] for n in names]
    d = lambda a, b: max(dist.get((min(x, y), max(x, y)), math.inf) for x in a for y in b)
    while True:
        best = min(((d(a, b), min(a), min(b), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2)), default=None)
        if best is None or best[0] > t:
            return {frozenset(g) for g in groups}
        groups[best[3]] += groups.pop(best[4])


@pytest.mark.parametrize("seed", range(4))
def test_complete_linkage_matches_one_merge_at_a_time(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i:02d}" for i in range(14)]
    xy = {n: (rnd.random(), rnd.random()) for n in names}
    dist = {(a, b): math.dist(xy[a], xy[b]) for a, b in itertools.combinations(names, 2)}
    e = spark.createDataFrame([(a, b, d) for (a, b), d in dist.items()], "a string, b string, d double")
    out = cluster.complete_linkage(e, (0.25, 0.5)).collect()
    for t in (0.25, 0.5):
        got = {}
        for r in out:
            if r.threshold == t:
                got.setdefault(r.cluster, set()).add(r.node)
        linked = {frozenset(g) for g in got.values()}
        assert {g for g in naive_linkage(names, dist, t) if len(g) > 1} == {g for g in linked if len(g) > 1}


def test_no_chaining(spark):
    e = spark.createDataFrame([("A", "B", 0.005), ("B", "C", 0.0051), ("A", "C", 0.012)], "a string, b string, d double")
    lab = {(r.threshold, r.node): r.cluster for r in cluster.complete_linkage(e, (0.0075, 0.013)).collect()}
    assert lab[(0.0075, "A")] != lab[(0.0075, "C")] and lab[(0.0075, "A")] == lab[(0.0075, "B")]
    assert len({lab[(0.013, x)] for x in "ABC"}) == 1


def test_copies_share_a_cluster_and_strangers_stay_alone(spark):
    rnd = random.Random(2)
    base = [rnd.gauss(0, 0.04) for _ in range(30)]
    t = {"a1": base, "a2": base, "a3": [x * 1.01 for x in base], "z": [rnd.gauss(0, 0.04) for _ in range(30)], "s": base[:5]}
    every = spark.createDataFrame([(a,) for a in [*t, "noprice"]], "asset string")
    lab = {r.asset: r.cluster for r in cluster.te_clusters(returns(spark, t), every).collect()}
    assert lab["a1"] == lab["a2"] == lab["a3"] and len({lab[x] for x in ("a1", "z", "s", "noprice")}) == 4


def test_renumber(spark):
    m = spark.createDataFrame([("d", 7), ("b", 3), ("a", 3), ("c", 9)], "asset string, cluster int")
    assert {r.asset: r.cluster_id for r in cluster.renumber_clusters(m).collect()} == {"d": 3, "b": 1, "a": 1, "c": 2}


def test_te_against_direct_pairs_over_many_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    t = {f"a{i:02d}": [None if rnd.random() < 0.1 else v for v in rnd.normal(0, 0.04, 40)] for i in range(12)}
    r = returns(spark, t)
    monkeypatch.setattr(pairs, "BLOCK", 4)
    monkeypatch.setattr(pairs.in_block_pairs, "__defaults__", (4,))
    got = {(x.a, x.b): (x.te, x.n) for x in pairs.te_pairs(r, max_te=9.0).collect()}
    assert len(got) == 66
    for a, b in itertools.combinations(t, 2):
        d = [x - y for x, y in zip(t[a], t[b]) if x is not None and y is not None]
        assert got[(a, b)] == (pytest.approx(np.std(d, ddof=1) * math.sqrt(12)), len(d))


def test_robust_te(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(0, 0.04, 60)
    noise = base + rnd.normal(0, 0.0005, 60)
    noise[[10, 40]] += [0.15, -0.15]
    other = base + rnd.normal(0, 0.02, 60)
    out = {(x.a, x.b): x for x in pairs.te_pairs(returns(spark, {"a": base, "b": noise, "c": other})).collect()}
    assert out[("a", "b")].te > 0.05 and out[("a", "b")].robust < 0.006
    assert out[("a", "c")].robust == pytest.approx(out[("a", "c")].te, rel=0.15)


def test_min_jaccard_in_blocks(spark):
    names = {1: [["world"], ["msci", "world"], ["msci", "world", "esg"]], 2: [["a", "b"], ["c"]], 3: [["x"]]}
    df = spark.createDataFrame([(g, ws) for g, lists in names.items() for ws in lists], "g int, tokens array<string>")
    assert rows(pairs.min_jaccard(df, "g", 1), "g") == [(1, pytest.approx(1 / 3)), (2, 0.0)]


def shrink(x):
    """Constant-correlation shrinkage in its pair form."""
    t, n = x.shape
    s = np.cov(x, rowvar=False)
    xm, sd = x - x.mean(0), np.sqrt(np.diag(s))
    rbar = ((s / np.outer(sd, sd)).sum() - n) / (n * (n - 1))
    f = rbar * np.outer(sd, sd)
    np.fill_diagonal(f, np.diag(s))
    h, y = xm.T @ xm / t, xm ** 2
    p = y.T @ y / t - 2 * h * s + s ** 2
    th = (xm ** 3).T @ xm / t - np.diag(h)[:, None] * s - h * np.diag(s)[:, None] + np.diag(s)[:, None] * s
    np.fill_diagonal(th, 0)
    rho = np.trace(p) + rbar * (np.outer(1 / sd, sd) * th).sum()
    delta = max(0, min(1, (p.sum() - rho) / ((s - f) ** 2).sum() / t))
    return delta * f + (1 - delta) * s, float(rbar), float(delta)


def test_shrinkage_and_portfolio_numbers_against_matrices(spark):
    rnd = np.random.default_rng(7)
    x = rnd.normal(0, 0.02, (60, 5)) + rnd.normal(0, 0.04, (60, 2)) @ np.array([[1, 0.9, 0, 0, 0.3], [0, 0, 1, -0.8, 0.3]])
    names = list("abcde")
    r = returns(spark, {n: x[:, i] for i, n in enumerate(names)}, "mi")
    s, rbar, delta = shrink(x)
    got = pf.shrinkage(r).first()
    assert (got.rbar, got.delta) == (pytest.approx(rbar), pytest.approx(delta)) and 0 < delta < 1
    cov = {(c.a, c.b): c for c in pf.shrunk_covariance(pairs.covariance_pairs(r), pf.shrinkage(r)).collect()}
    assert all(cov[(names[i], names[j])].shrunk == pytest.approx(s[i, j]) for i in range(5) for j in range(i, 5))
    est = spark.createDataFrame([(n, float(x[:, i].std(ddof=1)), 0.01 * i, 0.02, rbar, delta) for i, n in enumerate(names)],
                                "asset string, sd double, mu double, rf double, rbar double, delta double")
    w = np.array([0.1, 0.2, 0.3, 0.4, 0.0])
    weights = spark.createDataFrame([(1, n, float(w[i])) for i, n in enumerate(names)], "portfolio_id long, asset string, w double")
    p = pf.portfolio_perf(weights, r, est).first()
    assert p.vol == pytest.approx(math.sqrt(12 * w @ s @ w)) and p.ret == pytest.approx(float(w @ (0.01 * np.arange(5))))
    rc = {x.asset: x.rc for x in pf.risk_contribution(weights, r, est).collect()}
    assert all(rc[n] == pytest.approx(w[i] * (s @ w)[i] / (w @ s @ w)) for i, n in enumerate(names))


def test_calendar_rules(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(0.005, 0.04, (24, 2))
    r = spark.createDataFrame([(a, 2020 * 12 + i, float(x[i, k])) for k, a in enumerate("ab") for i in range(24)], "asset string, mi long, r double")
    w = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5)], "portfolio_id long, asset string, w double")
    out = {o.rule: o for o in pf.calendar_rebalance(w, r).collect()}
    assert {k: o.trades_per_year for k, o in out.items()} == {"monthly": 11.5, "quarterly": 3.5, "annual": 0.5, "none": 0.0}
    v, h, cost = 1.0, np.array([0.5, 0.5]), 0.0
    for i in range(24):                                             # one path step by step
        g = h * (1 + x[i])
        v, h = v * g.sum(), g / g.sum()
        if i < 23 and (i % 12 + 1) % 3 == 0:
            tr = abs(0.5 - h).sum()
            cost += 0.0025 * tr
            v, h = v * (1 - 0.0025 * tr), np.array([0.5, 0.5])
    assert out["quarterly"].final_value == pytest.approx(v) and out["quarterly"].costs_per_year == pytest.approx(cost / 2)


def test_largest_remainder_and_targets(spark):
    w = spark.createDataFrame([(1, "a", 1 / 3), (1, "b", 1 / 3), (1, "c", 1 / 3)], "portfolio_id long, asset string, w double")
    assert [r.pct for r in pf.largest_remainder(w).orderBy("asset").collect()] == [34, 33, 33]
    front = spark.createDataFrame([(1, 0.05, 1.0, 0.0), (1, 0.09, 0.0, 1.0)], "scan_id long, vol double, w1 double, w2 double")
    t = spark.createDataFrame([(1, 0.06), (1, 0.01), (1, 0.5)], "scan_id long, target double")
    got = {r.target: (round(r.w1, 9), round(r.w2, 9)) for r in pf.risk_target_mix(front, t, 2).collect()}
    assert got == {0.06: (0.75, 0.25), 0.01: (1.0, 0.0), 0.5: (0.0, 1.0)}


def test_portfolio_mix_needs_a_year_and_every_holding(spark):
    w = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.5), (2, "z", 0.5)], "portfolio_id long, asset string, w double")
    r = returns(spark, {"a": [0.01] * 20, "b": [None] * 3 + [0.03] * 2 + [None] + [0.03] * 14}, "mi")
    out = pf.portfolio_mix(w, r)
    assert out.count() == 14 and {x.portfolio_id for x in out.collect()} == {1} and out.agg(F.min("mi")).first()[0] == 106
    assert pf.portfolio_mix(w, returns(spark, {"a": [0.01] * 12, "b": [0.01] * 12}, "mi")).count() == 0


def test_model_of_each_selection_over_its_own_window(spark):
    rnd = np.random.default_rng(11)
    x = rnd.normal(0, 0.03, (70, 4)) + rnd.normal(0, 0.03, (70, 1))
    young = [None] * 69 + [0.5]
    r = returns(spark, {**{n: x[:, i] for i, n in enumerate("abc")}, "d": [None] * 40 + list(x[40:, 3]), "young": young}, "mi").where("r IS NOT NULL")
    bench = spark.createDataFrame([(100 + i, float(x[i, 0])) for i in range(70)], "mi int, r double")
    holdings = {1: {"a": 0.5, "b": 0.3, "c": 0.2}, 2: {"a": 0.6, "d": 0.4}, 3: {"a": 0.9, "young": 0.1}}
    weights = spark.createDataFrame([(k, n, w) for k, h in holdings.items() for n, w in h.items()], "portfolio_id long, asset string, w double")
    sel = pf.selection_returns(weights, r, bench)
    assert {(q.portfolio_id, q["count"]) for q in sel.groupBy("portfolio_id").count().collect()} == {(1, 180), (2, 60)}
    costs = spark.createDataFrame([("a", 0.2)], "asset string, cost double")
    est = pf.estimate(sel, bench, costs, F.lit(0.02), by=["portfolio_id"])
    perf = {q.portfolio_id: q for q in pf.portfolio_perf(weights, sel, est).collect()}
    rc = {(q.portfolio_id, q.asset): q.rc for q in pf.risk_contribution(weights, sel, est).collect()}
    assert set(perf) == {1, 2} and len(rc) == 5
    for k, months, cols in ((1, 60, [0, 1, 2]), (2, 30, [0, 3])):
        s, _, _ = shrink(np.column_stack([x[-months:, cols], x[-months:, 0]]))
        s, w = s[:-1, :-1], np.array(list(holdings[k].values()))
        assert perf[k].vol == pytest.approx(math.sqrt(12 * w @ s @ w))
        assert [rc[k, n] for n in holdings[k]] == pytest.approx(list(w * (s @ w) / (w @ s @ w)))


def test_far_pairs_are_shown_and_count_in_cluster_stats(spark, monkeypatch):
    r = np.random.default_rng(3)
    table = {k: r.normal(0, s, 24) for k, s in (("x", 0.01), ("y", 0.2), ("z", 0.011))}
    t = registry.Tables(spark, "")
    t._cache |= {"classes": returns(spark, table), "class_members": spark.createDataFrame([(k, k, "c") for k in table], "asset string, name string, cluster string")}
    monkeypatch.setattr(registry, "Tables", lambda *_: t)
    want = {(a, b): np.std(table[a] - table[b], ddof=1) * math.sqrt(12) for a, b in itertools.combinations(table, 2)}
    (stats,) = QUERIES["cluster_stats"](spark, "").collect()
    assert want["x", "y"] > 0.25 > want["x", "z"] and stats.max_te == pytest.approx(max(want.values()), abs=1e-6)
    got = {(p.a, p.b): p.te for p in QUERIES["te_pairs_all"](spark, "").collect()}
    assert got == pytest.approx(want, abs=1e-6)


def _all_pairs(t, cap):
    out = {}
    for a, b in itertools.combinations(sorted(t), 2):
        d = [x - y for x, y in zip(t[a], t[b]) if x is not None and y is not None]
        if len(d) >= 2 and (te := np.std(d, ddof=1) * math.sqrt(12)) < cap:
            out[a, b] = (pytest.approx(te, abs=1e-12), len(d))
    return out


def test_pivots_lose_no_pair(spark, monkeypatch):
    """Three sets of months that many share, rare ones, copies, flat series: the same pairs as without pruning."""
    rnd = np.random.default_rng(9)
    factors = rnd.normal(0, 0.05, (6, 30))
    t = {}
    for k in range(90):
        v = factors[k % 6] * rnd.uniform(0.2, 2) + rnd.normal(0, 0.004, 30)
        since = (0, 0, 5, 17)[k % 4]
        t[f"s{k:03d}"] = [None if i < since else float(x) for i, x in enumerate(v)]
    t |= {f"odd{k}": [None if (i * 7 + k) % 5 == 0 else float(x) for i, x in enumerate(factors[k] + rnd.normal(0, 0.003, 30))] for k in range(6)}
    t |= {"flat": [0.0] * 30, "short": [0.01] + [None] * 29, "copy1": t["s000"], "copy2": t["s000"]}
    r = returns(spark, t)
    monkeypatch.setattr(pairs, "BLOCK", 8)
    monkeypatch.setattr(pairs.pivots.near_blocks, "__defaults__", (10,))
    for cap in (0.02, 0.1, 0.25):
        got = {(x.a, x.b): (x.te, x.n) for x in pairs.te_pairs(r, max_te=cap).collect()}
        assert got == _all_pairs(t, cap)


def test_pivots_compare_few_of_many_pairs(spark):
    """20 000 series of 200 indices: under a tenth of all pairs, and no near pair between blocks that never met."""
    rnd = np.random.default_rng(10)
    n, m = 20_000, 36
    index = rnd.normal(0, 1, (200, m)) * rnd.uniform(0.005, 0.15, 200)[:, None]
    v = index[np.arange(n) % 200] + rnd.normal(0, 0.0008, (n, m))
    df = spark.createDataFrame([(f"a{i:05d}", [float(x) for x in row]) for i, row in enumerate(v)], "asset string, v array<double>")
    r = df.select("asset", F.posexplode("v").alias("period", "r")).withColumn("period", F.col("period").cast("long"))
    out = pairs.pairs_compared(r, max_te=0.05).agg(F.sum("compared").alias("c")).first()
    assert out["c"] < n * (n - 1) / 2 / 10
    assert out["c"] >= 200 * 100 * 99 / 2


def test_pivots_of_empty_and_single_tables(spark):
    none = spark.createDataFrame([], "asset string, period long, r double")
    assert pairs.te_pairs(none).collect() == []
    assert pairs.te_pairs(returns(spark, {"a": [0.1, 0.2, 0.3]})).collect() == []


@pytest.mark.parametrize("block", [2, 512])
def test_covariance_of_each_selection_over_its_own_months(spark, block):
    rnd = np.random.default_rng(11)
    r = {a: rnd.normal(0, 0.04, 30) for a in "abcdef"}
    chosen = {1: ("abc", 0), 2: ("bcdef", 18), 3: ("f", 0)}                    # the second selection holds a young one
    rows_ = [(k, a, m, float(r[a][m])) for k, (names, since) in chosen.items() for a in names for m in range(since, 30)]
    df = spark.createDataFrame(rows_, "portfolio_id int, asset string, mi int, r double")
    got = {(x.portfolio_id, x.a, x.b): (x.cov, x.shrunk) for x in pf.shrunk_covariance(
        pairs.selection_covariance(df, ["portfolio_id"], block), pf.shrinkage(df, ["portfolio_id"]), ["portfolio_id"]).collect()}
    delta = {x.portfolio_id: (x.rbar, x.delta) for x in pf.shrinkage(df, ["portfolio_id"]).collect()}
    want = {}
    for k, (names, since) in chosen.items():
        c = np.atleast_2d(np.cov(np.stack([r[a][since:] for a in names])))
        for i, j in itertools.combinations_with_replacement(range(len(names)), 2):
            rbar, d = delta[k]
            shrunk = c[i, j] if i == j else d * rbar * math.sqrt(c[i, i] * c[j, j]) + (1 - d) * c[i, j]
            want[k, names[i], names[j]] = (pytest.approx(c[i, j]), pytest.approx(shrunk))
    assert got == want


def test_shrinkage_adds_up_blocks_and_makes_no_row_of_a_product(spark):
    rnd = random.Random(4)
    data = [(p, f"a{i}", m, rnd.gauss(0.01, 0.05)) for p, n, t in ((1, 9, 20), (2, 3, 15), (3, 1, 12)) for i in range(n) for m in range(t)]
    df = spark.createDataFrame(data, "portfolio_id long, asset string, mi long, r double")
    numbers = lambda block: {x.portfolio_id: (x.n_assets, x.n_months, x.rbar, x.delta) for x in pf.shrinkage(df, ["portfolio_id"], block).collect()}
    whole, parts = numbers(512), numbers(2)
    assert set(whole) == {1, 2, 3} and whole[1][:2] == (9, 20) and all(parts[k] == pytest.approx(v) for k, v in whole.items())
    one = pf.shrinkage(df.where("portfolio_id = 1")).first()
    assert (one.rbar, one.delta) == pytest.approx(whole[1][2:])
    assert pf.shrinkage(df, ["portfolio_id"])._jdf.queryExecution().executedPlan().toString().count("Generate ") <= 1


def test_rebalanced_weights_are_shuffled_once(spark):
    """A weight's segments stay where the weight lies; assets with missing months, assets without returns, and one month alone."""
    rnd = random.Random(4)
    r = {(a, 24240 + m): rnd.gauss(0, 0.05) for a in "abcdef" for m in range(15) if rnd.random() < 0.8}
    w = {(p, a): rnd.random() for p in range(30) for a in "abcdefx" if rnd.random() < 0.6}
    df = spark.createDataFrame([(p, a, x) for (p, a), x in w.items()], "portfolio_id long, asset string, w double")
    out = pf.calendar_rebalance(df, spark.createDataFrame([(a, m, x) for (a, m), x in r.items()], "asset string, mi long, r double"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("posexplode")[0].replace("BroadcastExchange", "") and plan.count("Exchange hashpartitioning(portfolio_id") <= 2
    first, last = min(m for _, m in r), max(m for _, m in r)
    got = {(o.portfolio_id, o.rule): (o.final_value, o.costs_per_year) for o in out.collect()}
    every = {"monthly": lambda m: True, "quarterly": lambda m: (m % 12 + 1) % 3 == 0, "annual": lambda m: m % 12 == 11, "none": lambda m: False}
    want = {}
    for p in range(30):
        own = {a: x for (q, a), x in w.items() if q == p and any(a == b for b, _ in r)}
        for rule, due in every.items() if own else ():
            value, cost, g = 1.0, 0.0, dict.fromkeys(own, 1.0)
            for m in range(first, last + 1):
                g = {a: x * (1 + r.get((a, m), 0.0)) for a, x in g.items()}
                if m == last or due(m):
                    v = sum(own[a] * g[a] for a in own)
                    traded = sum(abs(own[a] - own[a] * g[a] / v) for a in own) if m < last else 0.0
                    value, cost, g = value * v * (1 - 0.0025 * traded), cost + 0.0025 * traded, dict.fromkeys(own, 1.0)
            want[p, rule] = (pytest.approx(value), pytest.approx(cost / ((last - first + 1) / 12)))
    assert got == want and len(want) == 120
