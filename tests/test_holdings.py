import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions.scalars import annualise, savings_value
from lodestar.operators import holdings as ho
from tests.conftest import rows

REC = {"reg": {"USA": 70.0, "Europa": 20.0, "Asia": 10.0}, "sec": {"Tek": 50.0, "Fin": 50.0}, "ast": {"Aksjer": 98.0, "Kontanter": 2.0},
       "top": {1: 5.0, 2: 4.0, 3: 3.0, 4: 2.0, 5: 1.0}}


def long(spark, funds):
    return spark.createDataFrame([(i, k, str(lab), float(w)) for i, r in funds.items() for k, m in r.items() for lab, w in m.items()],
                                 "isin string, kind string, label string, weight double")


def score(spark, a, b):
    rec = ho.records(long(spark, {"a": a, "b": b}))
    side = lambda i, s: rec.where(F.col("isin") == i).select(*[F.col(c).alias(f"{c}_{s}") for c in ho.PARTS], F.lit(1).alias("j"))
    return ho.score_pairs(side("a", "a").join(side("b", "b"), "j")).first()


def test_similarity(spark):
    assert score(spark, REC, REC).score == pytest.approx(1)
    other = {"reg": {"Asia": 80.0, "USA": 20.0}, "sec": {"Tek": 100.0}, "ast": {"Aksjer": 100.0}, "top": {1: 1.0, 11: 4.0, 12: 4.0, 13: 3.0, 14: 3.0}}
    s = score(spark, REC, other)
    assert (s.reg, s.sec, s.top) == (pytest.approx(0.3), pytest.approx(0.5), pytest.approx(1 / 15))
    assert s.score == pytest.approx((0.5 * 0.4 + 0.5 / 15) * 0.98)
    only = score(spark, {"ast": {"Aksjer": 100.0}}, {"ast": {"Aksjer": 50.0, "Renter": 50.0}})
    assert only.score == pytest.approx(0.25) and only.reg is None
    few = score(spark, {**REC, "top": {1: 5.0}}, REC)
    assert few.top is None and few.score == pytest.approx(1)


def test_prefixes_find_every_pair_above_the_thresholds(spark):
    rnd = random.Random(6)
    mix = lambda names: {n: rnd.random() ** 2 + 0.01 for n in names}
    funds = {f"f{i:02d}": {"reg": mix("abc"), "sec": mix("xyz"), "ast": mix("pq"), "top": mix(range(6))} for i in range(40)}
    for i in range(0, 40, 4):                                        # near copies
        funds[f"f{i + 1:02d}"] = {k: {n: v * (1 + rnd.random() * 0.1) for n, v in m.items()} for k, m in funds[f"f{i:02d}"].items()}
    alloc = long(spark, funds)
    got = {(r.id_a, r.id_b) for r in ho.similar_within(alloc).collect()}

    def over(x, y):
        sx, sy = sum(x.values()), sum(y.values())
        return sum(min(v / sx, y[k] / sy) for k, v in x.items() if k in y)

    want = set()
    for a, b in itertools.permutations(funds, 2):
        x, y = funds[a], funds[b]
        top = sum(min(v, y["top"][k]) for k, v in x["top"].items()) / min(sum(x["top"].values()), sum(y["top"].values()))
        if over(x["reg"], y["reg"]) >= 0.9 and over(x["sec"], y["sec"]) >= 0.85 and over(x["ast"], y["ast"]) >= 0.9 and min(1, top) >= 0.6:
            want.add((a, b))
    assert got == want and len(want) >= 20


def test_look_through(spark):
    other = {"reg": {"USA": 100.0}, "sec": {"Tek": 100.0}, "ast": {"Renter": 100.0}, "top": {5: 1.0}}
    w = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.3), (1, "none", 0.2)], "portfolio_id long, isin string, w double")
    out = {(r.kind, r.label): r.share for r in ho.look_through(w, long(spark, {"a": REC, "b": other})).collect()}
    assert out[("ast", "Aksjer")] == pytest.approx(0.49) and out[("ast", "Renter")] == pytest.approx(0.3)
    assert out[("reg", "USA")] == pytest.approx(0.7) and out[("company", "1")] == pytest.approx(0.025) and out[("company", "5")] == pytest.approx(0.008)
    assert out[("total", "covered")] == pytest.approx(0.8) and out[("total", "equity")] == pytest.approx(0.49)


def test_company_names(spark):
    cases = {"Alphabet Inc Class A": "Alphabet", "Alphabet Inc. Class C": "Alphabet", "Novo Nordisk A/S B": "Novo Nordisk A/S", "Equinor ASA": "Equinor", "Alphabet A": "Alphabet", "3M A": "3M A"}
    df = spark.createDataFrame([(k,) for k in cases], "n string").withColumn("c", ho.clean_company(F.col("n")))
    assert {r.n: r.c for r in df.collect()} == cases


def test_allocation_compact(spark):
    doc = {"regional_allocation": [{"type": "USA", "weight": 60.123}, {"type": "USA", "weight": "1.0"}, {"type": "X", "weight": 0}, {"type": "Y", "weight": 0.04}, {"type": "Z", "weight": "bad"}],
           "instrument_underlying_info": [{"instrument_id": 1, "weight": 5.9}, {"instrument_id": 2, "weight": 3.5}, {"instrument_id": 3, "weight": 0}, {"instrument_id": None, "weight": 1}]}
    raw = spark.createDataFrame([("i", json.dumps(doc))], "isin string, json string")
    assert rows(ho.allocation_compact(raw), "kind", "label") == [("i", "reg", "USA", 61.12), ("i", "top", "1", 5.9), ("i", "top", "2", 3.5)]


def test_money(spark):
    v = lambda *a: spark.range(1).select(savings_value(*[F.lit(float(x)) for x in a]).alias("v")).first().v
    assert v(0, 1000, 20, 0.07, 0.002) == pytest.approx(499000, rel=0.01) and v(0, 1000, 20, 0.07, 0.015) == pytest.approx(431000, rel=0.01)
    assert v(1000, 0, 2, 0.1, 0) == pytest.approx(1210) and v(100, 10, 1, 0.02, 0.02) == pytest.approx(220)
    df = spark.createDataFrame([("21",), ("abc",), (None,), ("-100",), ("NaN",)], "s string").select(annualise(F.col("s"), 2).alias("a"))
    assert [r.a if r.a is None else round(r.a, 9) for r in df.collect()] == [0.1, None, None, None, None]


def params(spark, **kw):
    base = dict(id="f", proxy=None, k=1.0, vol=0.02, corr=0.0, mkt_vol=0.15, target_years=5, target_ret=0.08, drag=0.012)
    return spark.createDataFrame([tuple({**base, **kw}.values())], "id string, proxy string, k double, vol double, corr double, mkt_vol double, target_years int, target_ret double, drag double")


def test_proxy_history(spark):
    rnd = random.Random(1)
    p = [rnd.gauss(0.008, 0.04) for _ in range(120)]
    series = spark.createDataFrame([("p", i, v) for i, v in enumerate(p)], "asset string, mi long, r double")
    rf = spark.createDataFrame([(i, 0.002) for i in range(120)], "mi long, rf double")
    mkt = series.select("mi", "r")
    own = [r.r for r in ho.proxy_history(params(spark, proxy="p"), series, mkt, rf).orderBy("mi").collect()]
    assert math.prod(1 + x for x in own[60:]) ** (1 / 5) - 1 == pytest.approx(0.08)
    assert all(own[i] == pytest.approx(p[i] - 0.001) for i in range(60))
    syn = [r.r for r in ho.proxy_history(params(spark, target_ret=0.04), series, mkt, rf).orderBy("mi").collect()]
    m = sum(syn) / 120
    assert math.sqrt(sum((x - m) ** 2 for x in syn) / 119 * 12) == pytest.approx(0.02, rel=0.1) and {round(x - 0.002 - (syn[-1] - 0.002), 4) for x in syn} != {0.0}


def test_reco_weights(spark):
    b = spark.createDataFrame([(r, r.upper()) for r in ("core", "em", "small", "safe")], "role string, isin string")
    out = {}
    for r in ho.reco_weights(b).collect():
        out.setdefault(r.profile, {})[r.role] = r.w
    assert out["Balansert"] == {"core": 48, "em": 6, "small": 6, "safe": 40} and out["Forsiktig"] == {"core": 20, "safe": 80}
    assert out["Bare aksjer"] == {"core": 80, "em": 10, "small": 10} and all(sum(x.values()) == 100 for x in out.values())
    assert ho.reco_weights(b.where("role <> 'core'")).count() == 0


def test_overlap_pairs_need_no_asset_classes_and_score_by_all_parts(spark):
    rows = [(f, k, x, w) for f, first in (("a", 60.0), ("b", 58.0), ("c", 5.0)) for k in ("reg", "sec") for x, w in (("x", first), ("y", 100 - first))]
    alloc = spark.createDataFrame([*rows, ("d", "reg", "x", 60.0), ("d", "ast", "Aksjer", 100.0)], "isin string, kind string, label string, weight double")
    held = spark.createDataFrame([(1, f, 0.25) for f in "abcd"] + [(2, "a", 0.5), (2, "c", 0.5), (3, "a", 1.0)], "portfolio_id long, isin string, w double")
    got = {(r.portfolio_id, r.a, r.b): round(r.score, 6) for r in ho.overlap_pairs(held, alloc).collect()}
    assert got == {(1, "a", "b"): 0.98}
    assert ho.overlap_pairs(held, alloc.where("false")).count() == 0


def mixed_funds(rnd, n=70):
    """Funds with missing parts, single labels, equal weights and near copies."""
    funds = {}
    for i in range(n):
        parts = {k: {x: rnd.choice([rnd.random() ** 3 + 0.01, 0.5, 1.0]) for x in rnd.sample(names, rnd.randint(1, len(names)))}
                 for k, names in (("reg", "abcd"), ("sec", "uvwxyz"), ("ast", "pq")) if rnd.random() < 0.75}
        if rnd.random() < 0.7:
            parts["top"] = {x: rnd.random() * 5 + 0.1 for x in rnd.sample(range(12), rnd.randint(3, 9))}
        funds[f"f{i:02d}"] = parts or {"ast": {"p": 1.0}}
    for i in range(0, n, 5):
        funds[f"f{i + 1:02d}"] = {k: {x: v * (1 + rnd.random() * 0.2) for x, v in m.items()} for k, m in funds[f"f{i:02d}"].items()}
    return funds


def plain_score(x, y):
    def over(k):
        if not x.get(k) or not y.get(k):
            return None
        sx, sy = sum(x[k].values()), sum(y[k].values())
        return sum(min(v / sx, y[k][n] / sy) for n, v in x[k].items() if n in y[k])

    reg, sec, ast, top = over("reg"), over("sec"), over("ast"), None
    if len(x.get("top", {})) >= 5 and len(y.get("top", {})) >= 5:
        top = min(1, sum(min(v, y["top"][n]) for n, v in x["top"].items() if n in y["top"]) / min(sum(x["top"].values()), sum(y["top"].values())))
    alloc = [v for v in (reg, sec) if v is not None]
    if not alloc and top is None:
        return None if ast is None else 0.5 * ast
    base = sum(alloc) / len(alloc) if alloc else top
    return (base if top is None else 0.5 * base + 0.5 * top) * (1 if ast is None else ast)


@pytest.mark.parametrize("least,block", [(0.02, 7), (0.4, 512), (0.55, 5), (0.9, 512)])
def test_similar_pairs_are_all_pairs_above_a_score(spark, monkeypatch, least, block):
    funds = mixed_funds(random.Random(int(least * 100)))
    monkeypatch.setattr(ho.overlap.candidates, "__defaults__", (block,))
    got = {(r.id_a, r.id_b): r.score for r in ho.similar_pairs(long(spark, funds), least).collect()}
    want = {(a, b): s for a, b in itertools.combinations(sorted(funds), 2) if (s := plain_score(funds[a], funds[b])) is not None and s >= least}
    assert got == {p: pytest.approx(s) for p, s in want.items()} and len(want) > 5


def test_prefixes_stay_short_and_pairs_come_once(spark):
    rnd = random.Random(8)
    alloc = long(spark, {f"f{i}": {"reg": {x: rnd.random() for x in "abcdefgh"}, "sec": {x: rnd.random() for x in "qrstuvwxyz"}} for i in range(60)})
    index = ho.overlap.lists(alloc)
    copies = index.select("kind", F.size(ho.overlap._prefix(0.85)).alias("n")).groupBy("kind").agg(F.avg("n").alias("n")).collect()
    assert math.prod(r.n for r in copies) < 10 * 2
    pairs = ho.overlap.reaching(index, {"reg": 0.3, "sec": 0.3})
    assert pairs.count() == pairs.distinct().count() == 60 * 59 / 2


def product_rows(rnd, n):
    return [(f"p{i:03d}", rnd.choice(["Aksjer", "Renter", None]), rnd.random() < 0.3, rnd.choice(["x", "y"]), "NOK", rnd.random() < 0.1, rnd.random() < 0.8, rnd.random() < 0.5,
             rnd.choice([None, round(rnd.random() * 2, 2), 0.5]), rnd.randint(0, 99), rnd.choice([None, 1, 2]), rnd.choice([None, 0.02, 0.05, 0.005]),
             rnd.choice([None, round(rnd.gauss(0.03, 0.006), 4)]), rnd.choice([None, round(rnd.gauss(0.03, 0.006), 4)])) for i in range(n)]


PRODUCT = ["id", "asset_class", "hedged", "category", "currency", "leveraged", "tradable", "ask", "cost", "owners", "cluster", "vol", "r5", "r3"]


def plain_fits(a, b):
    return (a["asset_class"] is not None and a["asset_class"] == b["asset_class"] and a["hedged"] == b["hedged"] and not b["leveraged"] and b["tradable"]
            and (not a["ask"] or b["ask"]) and b["cost"] is not None and a["id"] != b["id"])


@pytest.mark.parametrize("block", [1, 7, 512])
def test_band_joins_match_all_pairs(spark, block):
    data = product_rows(random.Random(block), 260)
    df = spark.createDataFrame(data, "id string, asset_class string, hedged boolean, category string, currency string, leveraged boolean, tradable boolean, ask boolean, "
                                     "cost double, owners long, cluster long, vol double, r5 double, r3 double")
    ps = [dict(zip(PRODUCT, r)) for r in data]
    got = sorted((r.id_a, r.id_b) for r in ho.cheaper_candidates(df, block=block).collect())
    assert got == sorted((a["id"], b["id"]) for a, b in itertools.permutations(ps, 2) if plain_fits(a, b) and a["cost"] is not None and b["cost"] < a["cost"] - 0.05)

    def rate(a, b):
        if not plain_fits(a, b) or a["asset_class"] != "Renter" or a["category"] != b["category"] or None in (a["vol"], b["vol"], a["cost"]):
            return False
        y = next((y for y in ("r5", "r3") if a[y] is not None and b[y] is not None), None)
        lo, hi = sorted((a["vol"], b["vol"]))
        return y is not None and abs((a[y] + a["cost"] / 100) - (b[y] + b["cost"] / 100)) <= 0.006 and (hi < 0.01 or hi / max(lo, 1e-6) <= 1.3)

    got = sorted((r.id_a, r.id_b) for r in ho.rate_twins(df, block=block).collect())
    want = sorted((a["id"], b["id"]) for a, b in itertools.permutations(ps, 2) if rate(a, b))
    assert got == want and len(want) > 10


def test_one_large_portfolio_is_cut_into_blocks(spark):
    """2 000 funds in one portfolio: every pair once, no join key with more than about a block of rows."""
    held = spark.range(2000).select(F.lit(1).alias("portfolio_id"), F.format_string("f%04d", "id").alias("isin"), F.lit(0.1).alias("w"))
    alloc = held.select("isin", F.explode(F.array(F.lit("reg"), F.lit("sec"))).alias("kind"), F.concat(F.lit("x"), F.pmod(F.crc32("isin"), F.lit(400))).alias("label"), F.lit(100.0).alias("weight"))
    out = ho.overlap_pairs(held, alloc, block=100)
    groups = [r.n for r in held.groupBy(F.pmod(F.crc32("isin"), F.lit(400)).alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert out.count() == out.distinct().count() == sum(n * (n - 1) // 2 for n in groups)
    ids = held.select("portfolio_id", F.col("isin").alias("id_a"))
    salted = ho.overlap.salted(ids, ids.withColumnRenamed("id_a", "id_b"), ["portfolio_id"], 100)
    assert salted.count() == 2000 * 2000
    assert ho.overlap_pairs(held.limit(40), alloc, least=0.0).count() == 40 * 39 // 2


def test_proxy_is_the_longest_history_near_the_best(spark):
    rnd = random.Random(12)
    funds = {f"u{i}": v for i, v in enumerate(mixed_funds(rnd, 30).values())}
    etfs = {f"e{i}": v for i, v in enumerate(mixed_funds(rnd, 40).values())}
    alloc = long(spark, funds | etfs)
    months = {e: rnd.choice([36, 60, 120]) for e in etfs}
    u = spark.createDataFrame([(i, "Aksjer", False, "c", 0.1) for i in funds], "id string, asset_class string, hedged boolean, category string, vol double")
    e = spark.createDataFrame([(i, "Aksjer", False, "c", 0.12, months[i]) for i in etfs], "id string, asset_class string, hedged boolean, category string, vol double, n_months int")
    df = ho.proxy_choice(u, e, alloc)
    got = {r.id: (r.proxy, r.sim) for r in df.collect()}
    for i, f in funds.items():
        scores = {x: s for x, h in etfs.items() if (s := plain_score(f, h)) is not None}
        best = max(scores.values(), default=0)
        pick = max(((months[x], round(s, 9), x) for x, s in scores.items() if s >= best - 0.08), default=None)
        if pick and pick[1] >= 0.3:
            assert got[i] == (pick[2], pytest.approx(pick[1])), i
        else:
            assert got[i][1] == 0.0


def test_copies_of_a_fund_are_compared_once(spark, monkeypatch):
    """Every fund ten times, weights apart in their last digits: as many pairs are scored as without copies, and no pair is lost."""
    funds = mixed_funds(random.Random(5), 30)
    many = {f"{f}-{k}": {x: {n: v * (1 + k * 1e-15) for n, v in m.items()} for x, m in r.items()} for f, r in funds.items() for k in range(10)}
    compared, plain = [], ho.scored
    monkeypatch.setattr(ho, "scored", lambda pairs, rec: (compared.append(pairs.count()), plain(pairs, rec))[1])
    got = {(r.id_a, r.id_b): r.score for r in ho.similar_pairs(long(spark, many), 0.41237).collect()}
    want = {(a, b): s for a, b in itertools.combinations(sorted(many), 2) if (s := plain_score(many[a], many[b])) is not None and s >= 0.41237}
    assert got == {p: pytest.approx(s) for p, s in want.items()} and compared[0] <= 30 * 31 / 2
    held = spark.createDataFrame([(p, f, 0.1) for p in range(3) for f in many], "portfolio_id long, isin string, w double")
    out = {(r.portfolio_id, r.a, r.b) for r in ho.overlap_pairs(held, long(spark, many), least=0.41237).collect()}
    apart = {(a, b) for a, b in want if any(k in many[a] and k in many[b] for k in ("reg",)) or all(len(many[x].get("top", {})) >= 5 for x in (a, b))}
    assert out == {(p, a, b) for p in range(3) for a, b in apart} and compared[1] <= 30 * 31 / 2


def test_look_through_joins_equal_holdings_where_the_weights_lie(spark):
    names = [f"f{i}" for i in range(60)]
    alloc = long(spark, {f: REC if i % 2 else {"reg": {"USA": 1.0}, "ast": {"Renter": 1.0, "Aksjer": 3.0}} for i, f in enumerate(names)})
    held = spark.createDataFrame([(p, f, 1 / 60) for p in range(5) for f in names], "portfolio_id long, isin string, w double").repartition("portfolio_id")
    out = ho.look_through(held, alloc)
    got = {(r.portfolio_id, r.kind, r.label): r.share for r in out.collect()}
    assert got[3, "ast", "Aksjer"] == pytest.approx(0.5 * 0.98 + 0.5 * 0.75) and got[4, "company", "1"] == pytest.approx(0.025) and got[0, "total", "covered"] == pytest.approx(1)
    assert len(got) == 5 * 16 and "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def pairs_of_tasks(pairs):
    return [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]


def test_cheaper_candidates_are_spread_by_their_pairs(spark, monkeypatch):
    """400 products of a few bytes make 79 800 pairs: no task makes more than a few times its share."""
    monkeypatch.setattr(ho.bands, "PAIRS", 4000, raising=False)
    u = spark.range(400).select(F.format_string("p%03d", "id").alias("id"), F.lit("Aksjer").alias("asset_class"), F.lit(False).alias("hedged"), F.lit(False).alias("leveraged"),
                                F.lit(True).alias("tradable"), F.lit(True).alias("ask"), F.col("id").cast("double").alias("cost"), F.lit(1).alias("owners"), F.lit(1).alias("cluster"))
    n = pairs_of_tasks(ho.cheaper_candidates(u, block=40))
    assert sum(n) == 400 * 399 // 2 and len(n) >= 10 and max(n) < sum(n) / 4


def test_pairs_of_one_index_are_spread_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(ho.overlap, "PAIRS", 4000, raising=False)
    u = spark.createDataFrame([(f"p{k:04}", "Aksjer", False, False, True, True, 0.1, 1, k % 6) for k in range(1200)],
                              "id string, asset_class string, hedged boolean, leveraged boolean, tradable boolean, ask boolean, cost double, owners long, cluster long")
    n = pairs_of_tasks(ho.same_index(u))
    assert sum(n) == 6 * 200 * 199 and len(n) >= 4 and max(n) < sum(n) * 0.6


def test_look_through_adds_up_blocks_and_makes_no_row_of_a_held_label(spark, monkeypatch):
    """Portfolios in several blocks, each summed in small steps, some funds repeated, unknown or null; held labels are never exploded."""
    rnd = random.Random(8)
    funds = mixed_funds(rnd, 25)
    alloc = long(spark, funds)
    names = [*funds, "none", None]
    held = [(p if p else None, rnd.choice(names), rnd.choice([0.3, 0.2, 0.1, 0.0, None])) for p in range(40) for _ in range(12)]
    w = spark.createDataFrame(held, "portfolio_id long, isin string, w double")
    monkeypatch.setattr(ho, "LOOK", 50, raising=False)
    out = ho.look_through(w, alloc)
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = {(r.portfolio_id, r.kind, r.label): r.share for r in out.collect()}
    want = {}
    for p, f, x in held:
        if f not in funds or not x:
            continue
        r = {k: m for k, m in funds[f].items() if m}
        ast = r.get("ast")
        eq = ast.get("Aksjer", 0) / sum(ast.values()) if ast else 1
        unit = {("company", str(n)): v / 100 for n, v in r.get("top", {}).items()} | {("ast", n): v / sum(ast.values()) for n, v in (ast or {}).items()}
        if eq > 0:
            unit |= {(k, n): eq * v / sum(r[k].values()) for k in ("reg", "sec") if k in r for n, v in r[k].items()}
        unit |= {("total", "covered"): 1, ("total", "equity"): eq if "reg" in r else 0, ("total", "top_covered"): min(1, sum(r.get("top", {}).values()) / 100)}
        for c, v in unit.items():
            want[p, *c] = want.get((p, *c), 0) + x * v
    for k in ("reg", "sec"):
        whole = {p: sum(v for (q, g, _), v in want.items() if q == p and g == k) for p, *_ in want}
        want = {c: v / whole[c[0]] if c[1] == k else v for c, v in want.items()}
    assert got == {c: pytest.approx(v) for c, v in want.items()} and len(got) > 400
    assert plan.count("Generate") <= 1 and "Aggregate" not in plan
    some = ho.look_through(w, alloc, ["ast", "total"])
    assert {(r.portfolio_id, r.kind, r.label): r.share for r in some.collect()} == {c: pytest.approx(v) for c, v in want.items() if c[1] in ("ast", "total")}


def test_look_block_takes_few_products_at_a_time(monkeypatch):
    import pyarrow as pa

    item = pa.struct([("kind", pa.string()), ("label", pa.string()), ("unit", pa.float64())])
    units = {"a": [("reg", "x", 1.0), ("company", None, 0.5)], "b": [("reg", "y", 3.0), ("reg", "x", 1.0)]}
    funds = pa.table({"isin": ["a", "b", "c"], "rep": ["a", "b", "a"], "items": pa.array([[dict(zip(("kind", "label", "unit"), x)) for x in units[f]] if f in units else None for f in "abc"], pa.list_(item))})
    held = pa.table({"portfolio_id": [p for p in range(50) for _ in range(3)], "isin": ["c", "b", "a"] * 50, "w": [0.25, 0.25, 0.5] * 50})
    monkeypatch.setattr(ho, "ITEMS", 7, raising=False)
    out = {(r["portfolio_id"], r["kind"], r["label"]): r["share"] for r in ho._look_block(held, funds).to_pylist()}
    assert len(out) == 150 and all((out[p, "reg", "x"], out[p, "reg", "y"], out[p, "company", None]) == (1 / 1.75, 0.75 / 1.75, 0.375) for p in range(50))
    assert ho._look_block(held.slice(0, 0), funds).num_rows == 0 and ho._look_block(held, funds.slice(0, 0)).num_rows == 0


def test_twins_of_unique_and_repeated_ids_with_and_without_an_index(spark, monkeypatch):
    """All rules against each other, one product a row in plain Python; some ids come twice with other facts, some products are not held."""
    rnd = random.Random(21)
    base = mixed_funds(rnd, 12)
    funds = {f"{f}{k}": r for f, r in base.items() for k in "abc"}
    names = [*funds, *(f"x{i}" for i in range(30))]
    names += names[::9]
    cols = "id asset_class hedged leveraged tradable ask cost owners cluster category currency vol r3 r5".split()
    prods = [dict(zip(cols, (i, rnd.choice(["Aksjer", "Renter"]), False, rnd.random() < 0.1, rnd.random() < 0.9, rnd.random() < 0.7, rnd.choice([0.1, 0.3, 0.5, 0.5, None]), rnd.choice([None, 5, 9]),
                             rnd.choice([None, None, 1, 2, 3]), "c", "NOK", rnd.choice([0.004, 0.008]), rnd.choice([0.01, 0.012]), rnd.choice([0.01, 0.03, None])))) for i in names]
    kinds = "id string, asset_class string, hedged boolean, leveraged boolean, tradable boolean, ask boolean, cost double, owners long, cluster long, category string, currency string, vol double, r3 double, r5 double"
    products = spark.createDataFrame([tuple(x.values()) for x in prods], kinds)
    held = products.where(F.col("id") != "f00a").select("id")
    alloc = long(spark, funds)
    near = {(r.id_a, r.id_b): r.score for r in ho.similar_within(alloc).collect()}
    index = {(r.id_a, r.id_b) for r in ho.best_same_index(products).collect()}
    rate = {(r.id_a, r.id_b) for r in ho.rate_twins(products).collect()}
    fit = lambda a, b: not b["leveraged"] and b["tradable"] and (not a["ask"] or b["ask"]) and b["cost"] is not None and a["id"] != b["id"]
    content = {(a["id"], b["id"]) for a in prods for b in prods if a["asset_class"] == b["asset_class"] and fit(a, b) and (a["id"], b["id"]) in near}
    for every in (False, True):
        rows_of = {}
        for a, b in index | rate | content:
            if a == "f00a":
                continue
            score, rule = (1.0, 0) if (a, b) in index else (near[a, b], 1) if (a, b) in content else (0.8, 2)
            for y in (y for y in prods if y["id"] == b):
                k = b if y["cluster"] is None else f"c{y['cluster']}"
                rows_of.setdefault((a, k), []).append((y["cost"] if y["cost"] is not None else -1, -score, -(y["owners"] or 0), b, round(score, 9), rule))
        want = {}
        for (a, k), found in rows_of.items():
            first = min(found)
            costs = {x["cost"] for x in prods if x["id"] == a}
            want[a, k] = first[3], first[4], first[5], None if first[0] < 0 else first[0], costs
        got = [(r.id, r.twin, round(r.score, 9), r.rule, r.cost) for r in ho.twins(products, alloc, held, every).collect()]
        sure = [(a, *w[:4]) for (a, _), w in want.items() if len(w[4]) == 1 and (every or (own := next(iter(w[4]))) is not None and w[3] is not None and w[3] < own - 0.05)]
        twice = {x["id"] for x in prods if len({y["cost"] for y in prods if y["id"] == x["id"]}) > 1}
        key = lambda r: tuple((x is None, x) if x is not None else (True, 0) for x in r)
        assert sorted((r for r in got if r[0] not in twice), key=key) == sorted(sure, key=key) and len(sure) > 60


def test_members_of_equal_funds_are_spread_by_their_pairs(spark, monkeypatch):
    """30 groups of 20 funds that report the same make 11 400 pairs from a few rows."""
    monkeypatch.setattr(ho.overlap, "PAIRS", 1000)
    names = [f"f{g:02}-{i:02}" for g in range(30) for i in range(20)]
    alloc = long(spark, {f: {"reg": {f"r{f[:3]}": 1.0}, "sec": {"s": 1.0}, "top": {f"{f[:3]}{i}": 1.0 for i in range(5)}} for f in names})
    u = spark.createDataFrame([(f, "Aksjer", False, False, True, True, 0.1, 1, None) for f in names],
                              "id string, asset_class string, hedged boolean, leveraged boolean, tradable boolean, ask boolean, cost double, owners long, cluster long")
    n = pairs_of_tasks(ho.content_twins(u, alloc))
    assert sum(n) == 30 * 20 * 19 and len(n) >= 6 and max(n) < sum(n) / 3


def test_scores_and_fits_are_dealt_by_their_number(spark, monkeypatch):
    ids = lambda s: spark.range(200).select(F.lit(1).alias("k"), F.col("id").alias(f"id_{s}"))
    n = pairs_of_tasks(ho.overlap.salted(ids("a"), ids("b"), ["k"], pairs=1000))
    assert sum(n) == 40000 and len(n) >= 10 and max(n) < 20000
    monkeypatch.setattr(ho, "SCORES", 100)
    funds = mixed_funds(random.Random(3), 40)
    names = sorted(funds)
    pairs = spark.createDataFrame(list(itertools.combinations(names, 2)), "id_a string, id_b string").coalesce(1)
    tasks = []
    monkeypatch.setattr(ho, "stored", lambda df, keep=ho.stored: (tasks.append(df.rdd.getNumPartitions()), keep(df))[1])
    ho.scored(pairs, ho.overlap.stored(ho.records(long(spark, funds)).withColumnRenamed("isin", "id")))
    assert max(tasks) >= 7


def test_pairs_inside_portfolios_are_not_shuffled_to_find_their_scores(spark, monkeypatch):
    """What scores enough and the funds of portfolios are written, so Spark knows how few they are and neither is worked out twice."""
    funds = mixed_funds(random.Random(4), 20)
    held = spark.createDataFrame([(p, f, 0.1) for p in range(30) for f in funds], "portfolio_id long, isin string, w double")
    kept = []
    monkeypatch.setattr(ho, "stored", lambda df, keep=ho.stored: (kept.append(sorted(df.columns)), keep(df))[1])
    out = ho.overlap_pairs(held, long(spark, funds), least=0.4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ["id", "portfolio_id", "rep"] in kept and ["id_a", "id_b", "score"] in kept and "SortMergeJoin [least" not in plan
    assert out.count() % 30 == 0
