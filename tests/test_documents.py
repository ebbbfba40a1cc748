import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestar import session
from lodestar.functions.classify import classify, normalize_name
from lodestar.operators import incremental as inc, ingest, predicates as pr, ranking as rk, reports as rp
from lodestar.plans import QUERIES, documents
from lodestar.sources import bars, pages, tables
from tests.conftest import rows


def ts(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())


def test_chart_document(spark):
    doc = {"meta": {"currency": "EUR", "gmtoffset": 7200, "regularMarketTime": ts(2026, 10, 7, 15), "regularMarketPrice": 64.0},
           "timestamp": [ts(2026, 10, 2, 7), ts(2026, 10, 5, 7), ts(2026, 10, 6, 7), ts(2026, 10, 7, 7)],
           "indicators": {"quote": [{"close": [62.5, None, 63.0, None]}]},
           "events": {"dividends": {"a": {"date": ts(2026, 10, 5, 7), "amount": 0.5}}, "splits": {"b": {"date": ts(2026, 10, 2, 7), "numerator": 2, "denominator": 1}}}}
    p = bars.parse(spark.createDataFrame([("x", json.dumps(doc)), ("y", "{}")], "asset string, json string"))
    assert [(str(r.date)[5:], r.close) for r in bars.closes(p).orderBy("date").collect()] == [("10-02", 62.5), ("10-06", 63.0), ("10-07", 64.0)]
    assert rows(bars.dividends(p)) == [("x", dt.date(2026, 10, 5), 0.5)] and rows(bars.splits(p)) == [("x", dt.date(2026, 10, 2), 2.0)]


def test_delimited_rates(spark):
    fx = spark.createDataFrame([("EUR", "0", "2024-01-02", "11.70"), ("SEK", "2", "2024-01-02", "107.5"), ("USD", "0", "2024-01-02", "ND")], tables.FX_COLUMNS)
    assert {r.currency: round(r.rate, 6) for r in tables.fx_rates(fx).collect()} == {"EUR": 11.7, "SEK": 1.075}


def page(arr, escaped):
    state = '{"total_hits": 7, "results":' + arr + ',"more":1}'
    return "<html>" + ('<script>x="' + state.replace("\\", "\\\\").replace('"', '\\"') + '"</script>' if escaped else f"<script>{state}</script>") + "</html>"


@pytest.mark.parametrize("escaped", [True, False])
def test_pages(spark, escaped):
    raw = [{"instrument_info": {"instrument_id": i, "name": f'ETF "{i}"', "isin": "IE00B4L5Y983" if i else "bad", "is_tradable": True},
            "fund_info": {"fund_yearly_fee": {"value": 0.2}, "fund_start_date": 1609459200000}, "price_info": {"close": {"price": 9.5}}} for i in (0, 1, 1)]
    good, broken = json.dumps(raw), '[{"instrument_info":{"instrument_id":5,"name":"Old","isin":"LU0000000001"},{"oops"'
    df = spark.createDataFrame([(1, page(good, escaped)), (2, page(broken, escaped)), (3, "<html></html>")], "page_id long, html string")
    out = {r.instrument_id: r for r in pages.normalise_rows(pages.first_per_instrument(pages.results(df))).collect()}
    assert set(out) == {0, 1, 5} and out[0].isin is None and out[1].fee == 0.2 and out[1].price == 9.5 and out[1].start_date == "2021-01-01"
    assert out[1].name == 'ETF "1"' and out[5].name == "Old" and out[5].domicile == "LU" and out[5].fee is None and out[1].ask_eligible


def test_all_arrays_of_a_page_and_escaped_pretty_json(spark):
    one = lambda i: '{"instrument_info": {"instrument_id": %d, "name": "a\\"b\\nc"}, "fund_info": {"results": [1]}}' % i
    plain = '{"total_hits": 5, "results": [{"headline": 1}]} {"total_hits": 99, "results": [%s, %s]} {"results": [%s], "total_hits": 3}' % (one(1), one(2), one(3))
    pretty = '{\n "total_hits": 7,\n "results": [\n\t%s]}' % one(4)
    quoted = pretty.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t")
    df = spark.createDataFrame([(1, plain), (2, f'<script>s="{quoted}"</script>'), (3, "no records"), (4, None)], "page_id long, html string")
    got = pages.results(df).selectExpr("page_id", "total", "get_json_object(record, '$.instrument_info.instrument_id')",
                                       "get_json_object(record, '$.instrument_info.name')", "get_json_object(record, '$.fund_info.results')").collect()
    assert sorted(map(tuple, got)) == [(1, 99, "1", 'a"b\nc', "[1]"), (1, 99, "2", 'a"b\nc', "[1]"), (1, 99, "3", 'a"b\nc', "[1]"), (2, 7, "4", 'a"b\nc', "[1]")]


def test_flatten_has_no_depth(spark):
    deep = {"leaf": 1, "e": {}}
    for k in range(20):
        deep = {f"n{k}": deep, "x": {"value": k, "unit": "u"}}
    df = spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":{"e":{"f":1}}}}},"z":2}'), (2, json.dumps(deep)), (3, None), (4, "[1]")], "k int, record string")
    out = {(r.k, r.path): r.value for r in pages.flatten(df, "k").collect()}
    assert out[1, "a.b.c.d.e.f"] == "1" and out[1, "z"] == "2"
    path = ".".join(f"n{k}" for k in reversed(range(20)))
    assert out[2, f"{path}.leaf"] == "1" and out[2, "x"] == "19" and out[2, "n19.x"] == "18" and (2, f"{path}.e") not in out
    assert len(out) == 2 + 21 + 2 and out[3, ""] is None and out[4, ""] == "[1]"
    for name in ("value", "path"):
        with pytest.raises(ValueError):
            pages.flatten(df.withColumnRenamed("k", name), name)
    assert {r.path for r in pages.flatten(df.withColumnRenamed("k", "_m"), "_m").collect()} == {p for _, p in out}
    assert pages.flatten(df.where("false"), "k").count() == 0


def test_fields_are_found_wherever_they_stand(spark):
    raw = [{"instrument_info": {"instrument_id": 1, "fund_type": "not this"}, "a": {"b": {"c": {"d": {"e": {"f": {"g": {"fund_type": "deep"}}}}}}}, "other": {"number_of_owners": {"value": 5}}},
           {"instrument_info": {"instrument_id": 2}, "x": {"close": {"price": 2.0}}, "y": {"last": {"price": 1.0}}, "z": {"last": {"price": 3.0}}, "my_fund_type": "no",
            "one": {"fund_category": ""}, "two": {"fund_category": "second"}, "three": {"fund_category": "third"}, "fund_calculated_fee": 0.5, "m": {"fund_yearly_fee": None}},
           {"instrument_info": {"instrument_id": 3}}]
    df = spark.createDataFrame([(1, page(json.dumps(raw), False))], "page_id long, html string")
    out = {r.instrument_id: r for r in pages.normalise_rows(pages.first_per_instrument(pages.results(df))).collect()}
    assert out[1].fund_type == "deep" and out[1].number_of_owners == 5.0
    assert out[2].price == 1.0 and out[2].fund_type is None and out[2].category == "second" and out[2].fee == 0.5
    assert out[3].fee is None and out[3].price is None


def test_arrays_in_arrays_and_pages_of_many_arrays(spark):
    inner = '{"instrument_info": {"instrument_id": %d}, "more": {"results": [{"instrument_info": {"instrument_id": %d}}, {"s": "] } \\" {["}]}}'
    html = '<p>"total_hits": 1 "results": [%s, {"instrument_info": {"instrument_id": 5}}] } "results":[1,2] </p>' % (inner % (1, 2))
    many = "".join('<x>{"total_hits": %d, "results": [{"instrument_info": {"instrument_id": %d, "name": "%s"}}]}' % (k, k, "n" * 200) for k in range(400))
    cut = '"total_hits": 8, "results": [{"instrument_info": {"instrument_id": 7, "is_tradable": true, "name": "a}b"}, "fund_info": {"fee": 1'
    df = spark.createDataFrame([(1, html), (2, many), (3, cut), (4, '"results": ["instrument_info": {"instrument_id": "x"}')], "page_id long, html string")
    out = pages.results(df).selectExpr("page_id", "total", "cast(get_json_object(record, '$.instrument_info.instrument_id') AS INT) AS i", "record").collect()
    assert sorted((r.total, r.i) for r in out if r.page_id == 1) == [(1, 1), (1, 2), (1, 5)]
    assert sorted((r.total, r.i) for r in out if r.page_id == 2) == [(k, k) for k in range(400)]
    last = [json.loads(r.record) for r in out if r.page_id == 3]
    assert last == [{"instrument_info": {"instrument_id": 7, "is_tradable": True, "name": "a}b"}}] and not any(r.page_id == 4 for r in out)


def test_flatten(spark):
    doc = {"a": {"b": {"value": 3, "unit": "%"}, "c": [1, {"x": 2}]}, "d": None, "e": {"value": {"z": 1}}}
    df = spark.createDataFrame([(1, json.dumps(doc))], "id long, record string")
    assert {r.path: r.value for r in pages.flatten(df, "id").collect()} == {"a.b": "3", "a.c": '[1,{"x":2}]', "d": None, "e.value.z": "1"}


def test_risk_page(spark):
    html = '<script>s="{\\"risksStatistics\\":{\\"oneYear\\":{\\"r2\\":95.5,\\"trackingError\\":\\"-\\"}},\\"x\\":1}"</script>'
    d = spark.createDataFrame([(1, '{"risk_statistics":{"standard_deviation_y1":12.34,"sharpe_ratio_y1":0.5}}', html)], "instrument_id long, api_json string, html string")
    r = pages.risk_fields(d.withColumn("page_json", pages.page_risk(F.col("html")))).first()
    assert (r.vol1, r.sharpe1, r.r21, r.te1, r.vol3) == (0.1234, 0.5, 0.955, None, None)


CASES = [  # name, category, fund type -> class, region, sector, theme, style, esg
    ("iShares Core MSCI World UCITS ETF", "Global Equity Large Cap", "Aksje", "Aksjer", "Global", "Bred", None, "Markedsvektet", False),
    ("iShares S&P 500 Information Technology", "Technology Sector Equity", "Aksje", "Aksjer", "USA", "Teknologi", None, "Markedsvektet", False),
    ("Xtrackers MSCI World ex USA", "Global Equity Large Cap", None, "Aksjer", "Global", "Bred", None, "Markedsvektet", False),
    ("MSCI Emerging Markets ex China ESG", "Miscellaneous", "Aksje", "Aksjer", "Fremvoksende", "Bred", None, "Markedsvektet", True),
    ("US High Yield Corp Bond", "US Fixed Income", "Rente", "Renter", "USA", "High yield", None, None, False),
    ("Enhanced AI Leaders", "Sector Equity Other", "Aksje", "Aksjer", "Global", "Bred", None, "Aktiv", False),
    ("AI and Big Data", "Technology Sector Equity", "Aksje", "Aksjer", "Global", "Teknologi", "Kunstig intelligens", "Markedsvektet", False),
    ("Nasdaq 100 Covered Call", "Options Trading", None, "Opsjonsstrategi", "USA", "Opsjonsstrategi", None, "Opsjonsinntekt", False),
    ("Gold", "Commodities - Precious Metals", None, "Råvarer", "Global", "Råvarer", None, None, False),
    (None, None, "Kombi", "Blandet", "Global", "Blandet", None, None, False)]


def test_labels(spark):
    df = classify(spark.createDataFrame([c[:3] for c in CASES], "name string, category string, fund_type string"))
    got = [(r.asset_class, r.region, r.sector, r.theme, r.style, r.esg) for r in df.collect()]
    assert got == [c[3:] for c in CASES]


def test_names_and_flags(spark):
    df = spark.createDataFrame([("iShares Core MSCI World UCITS ETF USD (Acc)", "X", "Akkumulerende"), ("S&P 500 2x Leveraged", "X", None), ("World EUR Hedged", "X", "Utdelende"), ("World Tail Hedge", "Trading Tools", "")],
                               "name string, category string, dividend_policy string")
    assert df.select(normalize_name(F.col("name")).alias("n")).first().n == "core msci world"
    f = [(r.leveraged, r.hedged, r.accumulating) for r in pr.instrument_flags(df).collect()]
    assert f == [(False, False, True), (True, False, False), (False, True, False), (True, False, False)]


def test_symbols(spark):
    s = spark.range(1).select(pr.price_symbol(F.lit(" XACT OMXS30"), F.lit(".ST")).alias("a"), pr.price_symbol(F.lit(" "), F.lit(".ST")).alias("b")).first()
    assert (s.a, s.b) == ("XACT-OMXS30.ST", None)
    codes = spark.createDataFrame([("I", c, t, n) for n, (c, t) in enumerate([("SE", "A"), ("GY", "B"), ("SW", "C"), ("SW", "D"), ("GY", "B"), ("QQ", "E"), ("LN", "F")])], "isin string, exch string, code string, pos long")
    assert [r.ticker for r in pr.code_candidates(codes).orderBy("place").collect()] == ["B.DE", "F.L", "C.SW", "D.SW"]


def test_covers_start(spark):
    d = lambda s: F.lit(s).cast("date")
    c = [("2008-04-01", "1999-01-01"), ("2008-06-01", "1999-01-01"), ("2015-03-01", "2015-01-01"), ("2015-03-01", None)]
    assert [spark.range(1).select(pr.covers_start(d(a), d(b), F.lit(True)).alias("c")).first().c for a, b in c] == [True, False, True, False]


def test_exports(spark):
    df = spark.createDataFrame([(1, "a;b", 1.23456, float("nan")), (2, 'q"', None, 2.0)], "id int, s string, x double, y double")
    assert [r.line for r in tables.csv_lines(df.select("id", "s", "x"), "id", {"x": 4}, comma=True).orderBy("id").collect()] == ['1;"a;b";1,2346', '2;"q""";']
    assert [json.loads(r.json) for r in tables.json_lines(df, "id").orderBy("id").collect()] == [{"id": 1, "s": "a;b", "x": 1.23456, "y": None}, {"id": 2, "s": 'q"', "x": None, "y": 2.0}]


def test_store_round_trip(spark, tmp_path):
    d = dt.date
    df = spark.createDataFrame([("x", d(2019, 1, 1), 1.0), ("x", d(2020, 1, 1), 2.0)], "asset string, date date, close double")
    tables.write_store(df, str(tmp_path))
    new = spark.createDataFrame([("x", d(2019, 1, 1), 1.0), ("x", d(2020, 1, 1), 3.0)], "asset string, date date, close double")
    year = lambda x: x.withColumn("year", F.year("date"))
    tables.write_store(new, str(tmp_path), inc.changed_partitions(year(df), year(new)))
    assert [r.close for r in tables.read_store(spark, str(tmp_path)).orderBy("date").collect()] == [1.0, 3.0]
    assert "PartitionFilters: [isnotnull(year" in tables.read_store(spark, str(tmp_path), 2020)._jdf.queryExecution().executedPlan().toString()


def test_medians_steps_and_summary(spark):
    df = spark.createDataFrame([(True, 1.0, f"a{i}") if i < 3 else (False, float(i), f"a{i}") for i in range(8)] + [(True, None, "n")], "is_index boolean, cost double, isin string")
    assert {r.is_index: r.median_cost for r in rp.exact_median(df, "is_index", "cost", "isin").collect()} == {True: 1.0, False: 5.0}
    p = spark.createDataFrame([("A", "n", "T1", "Aksje", "NO", "ok", 5.0, True, "a,b", "X"), ("B", "n", "T2", "Aksje", "SE", "ok", 2.0, True, "a", "X"),
                               ("C", "n", "T3", "Rente", "NO", "avvik", 9.0, False, "a", None), ("D", "n", None, "Rente", "NO", None, None, None, None, None)],
                              "isin string, name string, ticker string, fund_type string, domicile string, status string, years double, covers_start boolean, source string, exchange string")
    out = {(r.kind, r.grp): r for r in rp.probe_summary(p).collect()}
    t = out[("total", "total")]
    assert (t.n, t.with_ticker, t.usable, t.usable_share) == (4, 3, 1, 0.25) and out[("source", "a")].n == 3 and out[("source", "b")].n == 1


def test_one_per_isin(spark):
    df = spark.createDataFrame([("A", 1, 5, True), ("A", 2, 9, True), ("B", 3, None, True), ("C", 4, 1, False), (None, 5, 1, True)], "isin string, instrument_id long, owners long, active boolean")
    assert {r.isin: r.instrument_id for r in rk.one_per_isin(df).collect()} == {"A": 2, "B": 3}


def test_list_run_stops_when_too_little_is_found(spark):
    day = F.expr("DATE '2024-01-15'")
    page = lambda ids: '{"total_hits": 3, "results": [%s]}' % ", ".join('{"instrument_info": {"instrument_id": %d, "name": "n%d"}}' % (i, i) for i in ids)
    before = spark.createDataFrame([(i, f"n{i}", None, None, None, True) for i in (1, 2, 3)], "instrument_id long, name string, first_seen date, last_seen date, delisted_at date, active boolean")
    pages_of = lambda ids: spark.createDataFrame([(1, page(ids))], "page_id long, html string")
    run = ingest.ingest_list(pages_of([2, 3, 4]), before, day)
    assert {(r.instrument_id, r.change) for r in run.log.collect()} == {(1, "gone"), (4, "new")}
    assert {r.instrument_id for r in run.master.where("active").collect()} == {2, 3, 4} and run.master.count() == 4
    for ids in ([], [2]):
        with pytest.raises(ValueError, match="list run stopped"):
            ingest.ingest_list(pages_of(ids), before, day)
    assert ingest.ingest_list(pages_of([2]), before, day, partial=True).log.count() == 0


def test_files_are_read_back_as_written(spark, tmp_path):
    rows = [("USD", "0", "2024-01-02", "10,5"), ("JPY", "2", "2024-01-02", "7.25"), ("SEK", "0", "bad", "1")]
    df = spark.createDataFrame(rows, "BASE_CUR string, UNIT_MULT string, TIME_PERIOD string, OBS_VALUE string")
    tables.write_csv(df, f"{tmp_path}/rates")
    back = tables.read_semicolon(spark, f"{tmp_path}/rates")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert sorted(map(tuple, tables.fx_rates(back).collect())) == sorted(map(tuple, tables.fx_rates(df).collect()))
    tables.write_json(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "id long, x double"), f"{tmp_path}/rows")
    assert sorted(map(tuple, spark.read.schema("id long, x double").json(f"{tmp_path}/rows").collect())) == [(1, None), (2, 0.5)]
    assert any('"x":null' in r.value for r in spark.read.text(f"{tmp_path}/rows").collect())


def test_texts_of_pages_stay_out_of_the_driver(spark):
    from lodestar.plans.registry import Tables
    plan = Tables(spark, "/root/testdata/sf0.01").state_pages._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "LeftOuter" in x]
    leaves = pages.unfolded(spark.createDataFrame([(1, '{"a": {"b": 1}}')], "k long, json string"), "json")
    assert leaves.select("_row.*").columns == ["k"]          # a leaf does not carry its whole record


def test_instruments_are_classified_in_many_tasks(spark, monkeypatch):
    """The table lies in one piece; the rows of ``etf_row`` are made in tasks of about as many rows as asked for."""
    monkeypatch.setattr(documents, "spread", lambda df, key: session.spread(df, key, 200), raising=False)
    out = QUERIES["etf_row"](spark, "/root/testdata/sf0.01")
    n = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(n) == 2000 and len(n) >= 8 and max(n) < 400
