"""The versioned store: what a reader sees before, during and after saves of all tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar.sources import store
from lodestar.streaming import price_feed

D = dt.date


def frames(spark, closes=(), dividends=(), fx=(), rates=()):
    return {"close": spark.createDataFrame(list(closes), store.SCHEMAS["close"]), "dividend": spark.createDataFrame(list(dividends), store.SCHEMAS["dividend"]),
            "fx": spark.createDataFrame(list(fx), store.SCHEMAS["fx"]), "rate": spark.createDataFrame(list(rates), store.SCHEMAS["rate"])}


def seen(spark, root, version=None):
    return {t: sorted(tuple(r)[:-1] for r in store.read(spark, root, t, version=version).collect()) for t in store.SCHEMAS}


def first(spark):
    return frames(spark, [("x", D(2018, 5, 2), 0.9), ("x", D(2019, 5, 2), 1.0), ("z", D(2017, 6, 1), 4.0)], [("x", D(2019, 5, 3), 0.1)], [("EUR", D(2019, 1, 2), 11.0)], [(D(2019, 1, 2), 1.5)])


def test_reader_sees_old_or_new_whatever_happens_to_a_save(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    assert seen(spark, root) == {t: [] for t in store.SCHEMAS} and store.versions(spark, root) == []
    assert store.save(spark, root, first(spark)) == 1
    before = seen(spark, root)
    opened = {t: store.read(spark, root, t) for t in store.SCHEMAS}                       # plans of a reader that began before the save
    new = frames(spark, [("x", D(2019, 5, 2), 2.0), ("y", D(2020, 1, 2), 7.0)], [("x", D(2020, 2, 2), 0.2)], [("EUR", D(2019, 1, 2), 12.0)], [(D(2020, 1, 2), 2.5)])

    def lost(*args):
        assert seen(spark, root) == before                                                 # all folders are written, no manifest yet
        raise OSError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lost)
        with pytest.raises(OSError):
            store.save(spark, root, new)
    assert seen(spark, root) == before and store.versions(spark, root) == [1]
    assert store.save(spark, root, new) == 2
    after = seen(spark, root)
    assert after["close"] == [("x", D(2019, 5, 2), 2.0), ("y", D(2020, 1, 2), 7.0)] and after["dividend"] == [("x", D(2020, 2, 2), 0.2)]
    assert {t: sorted(tuple(r)[:-1] for r in df.collect()) for t, df in opened.items()} == before == seen(spark, root, 1)
    assert store.vacuum(spark, root, keep=1) >= 8 and seen(spark, root) == after and store.versions(spark, root) == [2]


def test_only_changed_years_are_written(spark, tmp_path):
    root = str(tmp_path / "store")
    store.save(spark, root, first(spark))
    old = store.manifest(spark, root)[1]["tables"]
    assert store.save(spark, root, first(spark)) == 1                                      # nothing changed, no version
    more = first(spark) | {"close": first(spark)["close"].where(F.year("date") != 2018).unionByName(spark.createDataFrame([("x", D(2019, 5, 6), 1.1), ("n", None, 1.0)], store.SCHEMAS["close"]))}
    assert store.save(spark, root, more) == 2
    new = store.manifest(spark, root)[1]["tables"]
    assert new["close"]["2017"] == old["close"]["2017"] and new["close"]["2019"] != old["close"]["2019"] and "2018" not in new["close"]
    assert new["dividend"] == old["dividend"] and new["fx"] == old["fx"]
    plan = store.read(spark, root, "close", since_year=2019)._jdf.queryExecution().optimizedPlan().toString()
    assert store.read(spark, root, "close", since_year=2019).count() == 2 and "relation" in plan.lower()


def test_two_savers_do_not_overwrite_each_other(spark, tmp_path):
    root = str(tmp_path / "store")
    store.save(spark, root, first(spark))
    store.save(spark, root, {"rate": spark.createDataFrame([(D(2021, 1, 2), 9.0)], store.SCHEMAS["rate"])}, base=1)
    with pytest.raises(RuntimeError):
        store.save(spark, root, {"rate": spark.createDataFrame([(D(2022, 1, 2), 8.0)], store.SCHEMAS["rate"])}, base=1)
    assert seen(spark, root)["rate"] == [(D(2021, 1, 2), 9.0)] and seen(spark, root)["close"]


def test_updates_replace_from_the_first_fetched_date(spark, tmp_path):
    root = str(tmp_path / "store")
    store.save(spark, root, frames(spark, [("x", D(2019, 1, 2), 1.0), ("x", D(2019, 1, 3), 1.1), ("y", D(2019, 1, 2), 5.0), ("w", D(2019, 1, 2), 3.0)],
                                   [("x", D(2019, 1, 1), 0.1), ("x", D(2019, 1, 3), 0.2), ("w", D(2019, 1, 2), 0.5)], [("EUR", D(2019, 1, 2), 11.0)]))
    closes = spark.createDataFrame([("x", D(2019, 1, 3), 1.2, False), ("x", D(2019, 1, 4), 1.3, False), ("y", D(2020, 1, 2), 6.0, True), ("w", None, None, True)],
                                   "asset string, date date, close double, is_full boolean")
    dividends = spark.createDataFrame([("x", D(2019, 1, 4), 0.3), ("nobody", D(2019, 1, 4), 0.9)], store.SCHEMAS["dividend"])
    fx = spark.createDataFrame([("EUR", D(2019, 1, 2), 11.5), ("USD", D(2019, 1, 2), 9.0)], store.SCHEMAS["fx"])
    assert store.apply(spark, root, closes, dividends, fx, batch=("f", 0)) == 2
    out = seen(spark, root)
    assert out["close"] == [("x", D(2019, 1, 2), 1.0), ("x", D(2019, 1, 3), 1.2), ("x", D(2019, 1, 4), 1.3), ("y", D(2020, 1, 2), 6.0)]
    assert out["dividend"] == [("x", D(2019, 1, 1), 0.1), ("x", D(2019, 1, 4), 0.3)]
    assert out["fx"] == [("EUR", D(2019, 1, 2), 11.5), ("USD", D(2019, 1, 2), 9.0)]
    assert store.apply(spark, root, closes, dividends, fx, batch=("f", 0)) == 2            # delivered again


def test_feed_of_all_tables(spark, tmp_path):
    root, drop, cp = str(tmp_path / "store"), str(tmp_path / "drop"), str(tmp_path / "cp")
    for rows in ([("close", "x", D(2020, 1, 2), 1.0, True), ("dividend", "x", D(2020, 1, 3), 0.1, None), ("fx", "EUR", D(2020, 1, 2), 10.0, None), ("rate", None, D(2020, 1, 2), 1.5, None)],
                 [("close", "x", D(2020, 1, 3), 1.1, False), ("fx", "EUR", D(2020, 1, 3), 10.1, None)]):
        spark.createDataFrame(rows, price_feed.ALL_SCHEMA).write.mode("append").parquet(drop)
        price_feed.run_all(spark, drop, root, cp).awaitTermination()
    out = seen(spark, root)
    assert out["close"] == [("x", D(2020, 1, 2), 1.0), ("x", D(2020, 1, 3), 1.1)] and len(out["fx"]) == 2
    assert out["dividend"] == [] and out["rate"] == [(D(2020, 1, 2), 1.5)]                 # the second batch fetched x anew from 3 January, without a dividend
    assert store.versions(spark, root) == [1, 2]
