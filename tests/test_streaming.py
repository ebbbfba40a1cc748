import datetime as dt

from lodestar.sources.tables import read_store, write_store
from lodestar.streaming.price_feed import SCHEMA, apply_batch, run_available


def test_feed_replaces_the_overlap(spark, tmp_path):
    d, root, drop, cp = dt.date, str(tmp_path / "store"), str(tmp_path / "drop"), str(tmp_path / "cp")
    base = spark.createDataFrame([("x", d(2019, 12, 30), 1.0), ("x", d(2020, 1, 2), 1.1), ("x", d(2020, 1, 3), 1.2)], "asset string, date date, close double")
    write_store(base, root)
    first = [("x", d(2020, 1, 3), 1.25, False), ("x", d(2020, 1, 6), 1.3, False)]
    for batch in (first, [("y", d(2020, 1, 6), 7.0, True)]):
        spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(drop)
        run_available(spark, drop, root, cp).awaitTermination()
    out = [(r.asset, r.close) for r in read_store(spark, root).orderBy("asset", "date").collect()]
    assert out == [("x", 1.0), ("x", 1.1), ("x", 1.25), ("x", 1.3), ("y", 7.0)]


def test_full_refetch_deletes_vanished_years_and_leaves_other_years_alone(spark, tmp_path):
    d, root = dt.date, str(tmp_path / "store")
    base = [("x", d(2018, 5, 2), 0.9), ("x", d(2019, 5, 2), 1.0), ("z", d(2019, 6, 3), 5.0), ("z", d(2017, 6, 1), 4.0)]
    write_store(spark.createDataFrame(base, "asset string, date date, close double"), root)
    files = lambda: {str(f.relative_to(root)) for f in (tmp_path / "store").rglob("*.parquet")}
    before = files()
    batch = spark.createDataFrame([("x", d(2019, 5, 2), 2.0, True), ("x", d(2020, 5, 4), 2.5, True)], SCHEMA)
    apply_batch(spark, root, batch)
    out = [(r.asset, r.date.year, r.close) for r in read_store(spark, root).orderBy("asset", "date").collect()]
    assert out == [("x", 2019, 2.0), ("x", 2020, 2.5), ("z", 2017, 4.0), ("z", 2019, 5.0)]
    once = files()
    assert {f for f in before if "2017" in f} == {f for f in once if "2017" in f} and not any("2018" in f for f in once)
    apply_batch(spark, root, batch)
    assert files() == once
    apply_batch(spark, root, batch.limit(0))
    assert files() == once
