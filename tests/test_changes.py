import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import changes as ch, checks, overlap, pairs, ranking as rk, sampling
from tests.conftest import rows

DAY = lambda n: dt.date(2024, 1, n)


def run(spark, n, ids, edits=()):
    e = dict(edits)
    return spark.createDataFrame([(n, i, f"Fund {i}", e.get((i, "category"), "A"), e.get((i, "fee"), 0.2)) for i in ids],
                                 "run_id long, instrument_id long, name string, category string, fee double")


def test_bulk_log_and_single_run_agree(spark):
    one, two, three = run(spark, 1, range(1, 11)), run(spark, 2, range(2, 12), {(5, "category"): "B", (5, "fee"): 0.3}.items()), run(spark, 3, range(1, 12), {(5, "category"): "B", (5, "fee"): 0.3}.items())
    runs = spark.createDataFrame([(n, DAY(n), False) for n in (1, 2, 3)], "run_id long, run_at date, partial boolean")
    log = ch.change_log(one.union(two).union(three), runs)
    got = rows(ch.run_summary(runs, log), "run_id")
    assert got == [(1, 10, 0, 0, 0), (2, 1, 1, 0, 2), (3, 0, 0, 1, 0)]
    master = one.select("instrument_id", "name", "category", "fee", F.lit(DAY(1)).alias("first_seen"), F.lit(DAY(1)).alias("last_seen"),
                        F.lit(None).cast("date").alias("delisted_at"), F.lit(True).alias("active"))
    found = two.drop("run_id")
    assert rows(ch.snapshot_diff(master, found), "instrument_id") == [(1, "gone"), (11, "new")]
    assert rows(ch.snapshot_diff(master, found, partial=True)) == [(11, "new")]
    assert rows(ch.field_changes(master, found), "field") == [(5, "category", "A", "B"), (5, "fee", "0.2", "0.3")]
    after = {r.instrument_id: r for r in ch.master_merge(master, found, F.lit(DAY(2))).collect()}
    assert len(after) == 11 and not after[1].active and after[1].delisted_at == DAY(2) and after[11].first_seen == DAY(2) and after[5].fee == 0.3
    assert rows(ch.snapshot_diff(ch.master_merge(master, found, F.lit(DAY(2))), three.drop("run_id"))) == [(1, "reappeared")]


def test_missing_new_value_keeps_the_old(spark):
    master = run(spark, 1, [1]).select("instrument_id", "name", "category", "fee", F.lit(DAY(1)).alias("first_seen"), F.lit(DAY(1)).alias("last_seen"),
                                       F.lit(None).cast("date").alias("delisted_at"), F.lit(True).alias("active"))
    found = spark.createDataFrame([(1, "Fund 1", None, 0.2)], "instrument_id long, name string, category string, fee double")
    assert ch.master_merge(master, found, F.lit(DAY(2))).first().category == "A"
    assert ch.field_changes(master, found).count() == 0


def test_text_compare(spark):
    df = spark.createDataFrame([(2.0, True, "0.2")], "a double, b boolean, c string")
    r = df.select(*[ch.as_text(df, c).alias(c) for c in df.columns]).first()
    assert tuple(r) == ("2", "1", "0.2")


@pytest.mark.parametrize("found,prior,partial,ok", [(0, 0, False, False), (0, 100, True, False), (89, 100, False, False), (90, 100, False, True), (10, 100, True, True)])
def test_gate(spark, found, prior, partial, ok):
    assert spark.range(1).select(checks.run_gate(F.lit(found), F.lit(prior), F.lit(partial)).alias("ok")).first().ok is ok


def test_require_stops_the_job(spark):
    with pytest.raises(Exception, match="too few"):
        checks.require(spark.range(3), F.col("id") < 2, "too few").collect()


def test_pick_listing(spark):
    df = spark.createDataFrame([("A", 1, "USD", "True", 0.1, 10), ("A", 2, "EUR", "1", 0.5, 5), ("A", 3, "NOK", "false", 0.1, None)],
                               "isin string, instrument_id long, currency string, is_tradable string, spread_pct double, owners long")
    r = rk.pick_listing(df).first()
    assert (r.instrument_id, r.owners) == (2, 15)


def _u(spark, data):
    cols = "isin string, cluster_id long, eligible boolean, ineligible_reason string, eff_fee double, fund_size double, owners long, history_years double, was_rep boolean"
    return spark.createDataFrame([(i, 1, True, "", f, s, 1, 6.0, w) for i, f, s, w in data], cols)


def test_hysteresis(spark):
    base = [("A", 0.20, 1.0, False), ("B", 0.18, 1.0, False), ("D", 0.15, 1.0, False)]
    pick = lambda d: [(r.isin, r.reason) for r in rk.representatives(_u(spark, d)).where("is_representative").collect()]
    assert pick(base) == [("D", "lavest avgift")]
    assert pick([base[0], ("B", 0.18, 1.0, True), base[2]]) == [("B", "beholdt forrige representant (hysterese)")]
    assert pick([("A", 0.20, 1.0, True), *base[1:]])[0][0] == "D" and pick([("A", 0.20, 1.0, True), *base[1:]])[0][1].startswith("byttet: 0.05")
    assert pick([("A", 0.2, 1.0, False), ("B", 0.2, 2.0, False)]) == [("B", "lik avgift, størst fond/flest eiere")]
    assert pick([("A", 0.2, 1.0, False)]) == [("A", "eneste kvalifiserte")]


def test_merge_and_choose_candidates(spark):
    c = spark.createDataFrame([("I", "T1", "a", 1, 0), ("I", "T2", "a", 1, 1), ("I", "T2", "b", 2, 0), ("I", "T3", "b", 2, 1)], "isin string, ticker string, source string, source_rank int, pos long")
    from dataclasses import replace
    from lodestar.params import DEFAULTS
    assert rows(rk.candidate_merge(c, replace(DEFAULTS, max_candidates=2)), "place") == [("I", "T1", "a", 1), ("I", "T2", "a,b", 2)]
    p = spark.createDataFrame([("I", "T1", True, DAY(30), 10, 1), ("I", "T2", True, DAY(30), 10, 2), ("I", "T3", True, dt.date(2023, 1, 1), 99, 3)],
                              "isin string, ticker string, ok boolean, last_date date, n_months long, place long")
    assert rk.choose_candidate(p, F.lit(DAY(31))).first().ticker == "T1"


def test_stratified_quotas(spark):
    data = [(f"i{k:03d}", "Aksje" if k < 70 else "Rente" if k < 98 else "Kombi") for k in range(100)]
    df = spark.createDataFrame(data, "isin string, fund_type string")
    pick = lambda d: sorted(r.isin for r in sampling.stratified_sample(d, 20).collect())
    n = {r.fund_type: r["count"] for r in sampling.stratified_sample(df, 20).groupBy("fund_type").count().collect()}
    assert n == {"Aksje": 14, "Rente": 5, "Kombi": 1}
    assert pick(df) == pick(spark.createDataFrame(data[::-1], "isin string, fund_type string"))
    assert sampling.stratified_sample(df, 0).count() == 100 and sampling.stratified_sample(df, 500).count() == 100


def test_members_are_those_with_the_smallest_digests(spark):
    import hashlib
    rnd = random.Random(4)
    data = [(f"I{i:05d}", rnd.choice(["a", "a", "a", "b", None, "c"])) for i in range(3000)] + [("I00001", "a")] * 3
    df = spark.createDataFrame(data, "isin string, fund_type string")
    for n in (1, 3, 7, 500, 2900):
        got = sampling.stratified_sample(df, n, seed=9).collect()
        assert len(got) == n
        for kind in ("a", "b", None, "c"):
            order = sorted((hashlib.md5(f"9|{i}".encode()).hexdigest(), i) for i, k in data if k == kind)
            mine = sorted(r.isin for r in got if r.fund_type == kind)
            assert mine == sorted(i for _, i in order[:len(mine)])


def test_large_clusters_and_names_meet_in_blocks(spark):
    u = spark.range(300).select(F.col("id").cast("string").alias("isin"), (F.col("id") % 3 == 0).cast("int").alias("cluster_id"), F.lit(0.1).alias("fee"), F.lit(5.0).alias("history_years"),
                                F.lit(0.1).alias("r5"), F.lit(True).alias("ask_eligible"))
    got = [(r.held, r.isin) for r in rk.cluster_alternates(u, u.where(F.col("isin").cast("int") % 10 == 0), block=16).collect()]
    want = [(str(a), str(b)) for a in range(0, 300, 10) for b in range(300) if a != b and (a % 3 == 0) == (b % 3 == 0)]
    assert sorted(got) == sorted(want)
    names = spark.range(60).select(F.lit(1).alias("g"), F.array(F.lit("x"), F.concat(F.lit("t"), F.col("id") % 20), F.col("id").cast("string")).alias("tokens"))
    assert pairs.min_jaccard(names, "g", 8).collect() == pairs.min_jaccard(names, "g").collect() == [(1, 1 / 5)]


def test_alternates_are_spread_by_their_pairs(spark, monkeypatch):
    """One cluster of 640 small rows, 320 of them held: its blocks go to many tasks."""
    monkeypatch.setattr(overlap, "PAIRS", 5000, raising=False)
    u = spark.range(640).select(F.col("id").cast("string").alias("isin"), F.lit(1).alias("cluster_id"), F.lit(0.1).alias("fee"), F.lit(5.0).alias("history_years"),
                                F.lit(0.1).alias("r5"), F.lit(True).alias("ask_eligible"))
    n = [r["count"] for r in rk.cluster_alternates(u, u.where("isin % 2 = 0"), block=32).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(n) == 320 * 639 and len(n) >= 10 and max(n) < sum(n) / 4
