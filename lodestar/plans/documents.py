"""Queries over raw documents (JSON, pages, delimited text), classification and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar.functions import fixed_values as fv
from lodestar.functions.classify import classify
from lodestar.functions.scalars import annualise
from lodestar.operators import ingest, instruments as ins
from lodestar.operators.asof import subunit_map_join
from lodestar.plans.adapters import DUCK, SQL
from lodestar.plans.listings import flagged
from lodestar.plans.registry import query, shared, stage
from lodestar.session import ensure_checkpoint_dir, spread, stored
from lodestar.sources import bars, pages, store, tables


# ------------------------------------------------------------------ price store
@query("price_store_scan", "panel", "SELECT asset, date, R6(close) AS close, CAST(year(date) AS INT) AS year FROM panel WHERE year(date) >= 2000")
def _(t):
    ensure_checkpoint_dir(t.spark)
    root = f"{t.spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"
    tables.write_store(t.panel, root)
    return tables.read_store(t.spark, root, 2000)


@query("price_store_tables", "panel divs fx policy", """
SELECT 'close' AS kind, asset AS key, date, R6(close) AS value FROM panel UNION ALL SELECT 'dividend', asset, date, R6(amount) FROM divs
UNION ALL SELECT 'fx', currency, date, R6(rate) FROM fx UNION ALL SELECT 'rate', NULL, date, R6(rate) FROM policy""")
def _(t):
    """Saved up to 1995, then brought up to date as one version."""
    ensure_checkpoint_dir(t.spark)
    root = f"{t.spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"
    old, new = F.year("date") < 1996, F.year("date") >= 1996
    store.save(t.spark, root, {"close": t.panel.where(old), "dividend": t.divs.where(old), "fx": t.fx.where(old), "rate": t.policy.where(old)})
    store.apply(t.spark, root, t.panel.where(new).withColumn("is_full", F.lit(False)), t.divs.where(new), t.fx.where(new), t.policy.where(new))
    part = lambda table, key, value: store.read(t.spark, root, table).select(F.lit(table).alias("kind"), key.alias("key"), "date", F.col(value).alias("value"))
    return (part("close", F.col("asset"), "close").unionByName(part("dividend", F.col("asset"), "amount"))
            .unionByName(part("fx", F.col("currency"), "rate")).unionByName(part("rate", F.lit(None).cast("string"), "rate")))


# ------------------------------------------------------------------ delimited text
@query("fx_csv_source", "fx", """
SELECT date, currency, R6(rate) AS rate FROM fx WHERE day(date) <> 13""")
def _(t):
    mult = F.when(F.col("currency") == "SEK", 2).otherwise(0)
    value = F.when(F.day("date") == 13, F.lit("n/a")).otherwise((F.col("rate") * F.pow(F.lit(10.0), mult)).cast("string"))
    lines = t.fx.select(F.concat_ws(";", "currency", mult.cast("string"), F.col("date").cast("string"), value).alias("line"))
    rows = lines.select(F.from_csv("line", tables.FX_COLUMNS, {"sep": ";"}).alias("_row")).select("_row.*")
    return tables.fx_rates(rows)


@query("rate_csv_source", "policy", "SELECT date, R6(rate) AS rate FROM policy WHERE day(date) <> 13")
def _(t):
    value = F.when(F.day("date") == 13, F.lit("")).otherwise(F.col("rate").cast("string"))
    lines = t.policy.select(F.concat_ws(";", F.lit("B"), F.lit("KPRA"), F.lit("SD"), F.lit("R"), F.col("date").cast("string"), value).alias("line"))
    return tables.policy_rates(lines.select(F.from_csv("line", tables.RATE_COLUMNS, {"sep": ";"}).alias("_row")).select("_row.*"))


# ------------------------------------------------------------------ chart documents: one per brand and year, bars at 23:30 UTC + 1 h
SQL["bar_rows"] = """
SELECT asset, year(date) AS y, date, row_number() OVER (PARTITION BY asset, year(date) ORDER BY date) AS n,
       row_number() OVER (PARTITION BY asset, year(date) ORDER BY date DESC) AS back, close FROM {dirty}"""


@query("bar_json_explode", "bar_rows day_divs splits", """
WITH b AS (SELECT asset, date, CASE WHEN back = 1 THEN CASE WHEN y % 2 = 1 THEN close * 1.01 END WHEN n % 17 = 3 THEN NULL ELSE close END AS c FROM bar_rows)
SELECT 'close' AS kind, asset, CAST(date + INTERVAL 1 DAY AS DATE) AS date, R6(c) AS value FROM b WHERE c > 0
UNION ALL SELECT 'dividend', d.asset, CAST(d.date + INTERVAL 1 DAY AS DATE), R6(amount) FROM day_divs d WHERE EXISTS (SELECT 1 FROM bar_rows b WHERE b.asset = d.asset AND b.y = year(d.date))
UNION ALL SELECT 'split', s.asset, CAST(s.date + INTERVAL 1 DAY AS DATE), R6(CASE WHEN ratio = 0 THEN 1 ELSE ratio END / 2) FROM splits s
          WHERE EXISTS (SELECT 1 FROM bar_rows b WHERE b.asset = s.asset AND b.y = year(s.date))""")
def _(t):
    ts = F.unix_date("date").cast("long") * 86400 + 84600
    close = F.when((F.col("back") == 1) | (F.col("n") % 17 == 3), None).otherwise(F.col("close"))
    last = F.max(F.struct(ts.alias("ts"), F.col("close")))
    docs = t.bar_rows.groupBy("asset", "y").agg(F.array_sort(F.collect_list(F.struct(ts.alias("ts"), close.alias("c")))).alias("b"), last.alias("last"))
    div = t.day_divs.groupBy("asset", F.year("date").alias("y")).agg(F.map_from_entries(F.collect_list(
        F.struct(ts.cast("string"), F.struct(ts.alias("date"), "amount")))).alias("dividends"))
    spl = t.splits.groupBy("asset", F.year("date").alias("y")).agg(F.map_from_entries(F.collect_list(
        F.struct(F.concat_ws("-", ts.cast("string"), "ratio"), F.struct(ts.alias("date"), F.col("ratio").alias("numerator"), F.lit(2.0).alias("denominator"))))).alias("splits"))
    late = F.when(F.col("y") % 2 == 1, F.col("last.ts")).otherwise(F.col("last.ts") + 86400)
    meta = F.struct(F.lit("EUR").alias("currency"), F.lit(3600).alias("gmtoffset"), late.alias("regularMarketTime"), (F.col("last.close") * 1.01).alias("regularMarketPrice"))
    quote = F.struct(F.array(F.struct(F.col("b.c").alias("close"))).alias("quote"))
    raw = docs.join(div, ["asset", "y"], "left").join(spl, ["asset", "y"], "left").select("asset", F.to_json(F.struct(
        meta.alias("meta"), F.col("b.ts").alias("timestamp"), quote.alias("indicators"), F.struct("dividends", "splits").alias("events")), {"ignoreNullFields": "false"}).alias("json"))
    p = bars.parse(stored(raw))
    return (bars.closes(p).select(F.lit("close").alias("kind"), "asset", "date", F.col("close").alias("value"))
            .union(bars.dividends(p).select(F.lit("dividend"), "asset", "date", "amount"))
            .union(bars.splits(p).select(F.lit("split"), "asset", "date", "ratio")))


# ------------------------------------------------------------------ pages around instrument records: plain, escaped and broken
SQL["page_items"] = """
SELECT CAST(floor(e.instrument_id / 10) AS BIGINT) AS page_id, e.* FROM {etf} e WHERE CAST(floor(e.instrument_id / 10) AS BIGINT) IN (SELECT page_id FROM {pages})"""


@shared
def state_pages(t):
    info = F.struct("instrument_id", F.col("name"), F.col("ticker").alias("symbol"), "isin", "currency", (F.col("is_tradable") != "false").alias("is_tradable"))
    moved = F.col("instrument_id") % 4 == 1
    fund = F.struct(F.struct(F.col("fee").alias("value"), F.lit("%").alias("unit")).alias("fund_yearly_fee"), F.when(~moved, F.col("category")).alias("fund_category"), F.col("fund_type"),
                    (F.unix_date(F.lit("2001-01-01").cast("date")).cast("long") * 86400000 + F.col("instrument_id") * 86400000).alias("fund_start_date"), F.array("r1", "vol1").alias("marks"))
    # a field in another group, and one that lies deep
    other = F.struct(F.struct(F.when(moved, F.col("category")).alias("fund_category")).alias("group"))
    deep = F.col("instrument_id").alias("f")
    for k in "edcba":
        deep = F.struct(deep).alias(k)
    price = F.struct(F.struct(F.col("r3").alias("price")).alias("last"), F.struct(F.col("vol1").alias("price")).alias("close"))
    rec = F.struct(info.alias("instrument_info"), fund.alias("fund_info"), price.alias("price_info"), F.struct(F.col("owners").alias("number_of_owners")).alias("statistical_info"),
                   other.alias("other_info"), deep)
    per = t.page_items.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("instrument_id", rec.alias("rec")))).alias("rs"))
    arr = F.to_json(F.transform("rs", lambda x: x["rec"]), {"ignoreNullFields": "false"})
    arr = F.when(F.col("page_id") % 3 == 2, F.substring(arr, F.lit(1), F.length(arr) - 4)).otherwise(arr)
    state = F.concat(F.lit('{"total_hits": 1234, "results" : '), arr, F.lit(', "next":null}'))
    quoted = F.replace(F.replace(state, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    script = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit('<script>window.state="'), quoted, F.lit('"</script>'))).otherwise(
        F.concat(F.lit("<script>window.state="), state, F.lit("</script>")))
    decoy = F.lit('{"total_hits": 5, "results": [{"headline": "no instrument"}]}')
    # Spark guesses the texts' size from the numbers they are made of: never by way of the driver
    made = per.withColumn("script", script).select("page_id", "script").hint("merge")
    return t.pages.join(made, "page_id", "left").select("page_id", F.concat("html", decoy, F.coalesce("script", F.lit(""))).alias("html"))


@stage
def page_records(t):
    return pages.results(t.state_pages)


@query("page_record_extract", "page_items", "SELECT instrument_id, page_id, CAST(1234 AS BIGINT) AS total, name, ticker AS symbol, isin, currency FROM page_items")
def _(t):
    r = pages.first_per_instrument(t.page_records)
    return r.select("instrument_id", "page_id", "total", *[F.get_json_object("record", f"$.instrument_info.{f}").alias(f) for f in ("name", "symbol", "isin", "currency")])


_OK = "CASE WHEN page_id % 3 <> 2 THEN {} END"


@query("normalise_rows", "page_items", f"""
SELECT instrument_id, name, ticker AS symbol, currency, isin, CASE WHEN is_tradable = 'false' THEN 'false' ELSE 'true' END AS is_tradable, R6({_OK.format('fee')}) AS fee,
       {_OK.format('category')} AS category, {_OK.format('fund_type')} AS fund_type, {_OK.format('CAST(owners AS DOUBLE)')} AS number_of_owners, R6({_OK.format('coalesce(r3, vol1)')}) AS price,
       {_OK.format("CAST(CAST(DATE '2001-01-01' + CAST(instrument_id AS INT) AS DATE) AS VARCHAR)")} AS start_date, substr(isin, 1, 2) AS domicile,
       substr(isin, 1, 2) IN ('IE', 'LU', 'NO') AS ask_eligible FROM page_items""")
def _(t):
    n = pages.normalise_rows(pages.first_per_instrument(t.page_records))
    return n.select("instrument_id", "name", "symbol", "currency", "isin", "is_tradable", "fee", "category", "fund_type", "number_of_owners", "price", "start_date", "domicile", "ask_eligible")


_LEAVES = {"instrument_info.instrument_id": "instrument_id", "instrument_info.name": "name", "instrument_info.symbol": "ticker", "instrument_info.isin": "isin",
           "instrument_info.currency": "currency", "instrument_info.is_tradable": "is_tradable", "fund_info.fund_yearly_fee": "fee", "fund_info.fund_category": "CASE WHEN instrument_id % 4 <> 1 THEN category END",
           "other_info.group.fund_category": "CASE WHEN instrument_id % 4 = 1 THEN category END", "a.b.c.d.e.f": "instrument_id",
           "fund_info.fund_type": "fund_type", "fund_info.fund_start_date": "instrument_id", "fund_info.marks": "instrument_id", "price_info.last.price": "r3",
           "price_info.close.price": "vol1", "statistical_info.number_of_owners": "owners"}


# every third page is broken JSON: only instrument_info can be read there
@query("json_field_report", "page_items", " UNION ALL ".join(
    f"SELECT '{p}' AS path, count({c}) AS n FROM page_items" + ("" if p.startswith("instrument_info.") else " WHERE page_id % 3 <> 2") for p, c in _LEAVES.items()))
def _(t):
    return pages.field_report(pages.flatten(t.page_records.withColumnRenamed("pos", "k"), "k"))


# ------------------------------------------------------------------ the whole list run: pages, gate, log, master
SQL["listed_before"] = """
SELECT CASE WHEN instrument_id % 41 = 0 THEN instrument_id + 5000000000 ELSE CAST(instrument_id AS BIGINT) END AS instrument_id,
       CASE WHEN instrument_id % 13 = 0 THEN 'Old ' || name ELSE name END AS name, ticker AS symbol, isin, CASE WHEN instrument_id % 17 = 0 THEN NULL ELSE currency END AS currency,
       DATE '2023-05-01' AS first_seen, DATE '2023-12-01' AS last_seen, CASE WHEN instrument_id % 11 = 0 THEN DATE '2023-12-15' END AS delisted_at, instrument_id % 11 <> 0 AS active
FROM {etf} WHERE instrument_id % 7 <> 0"""
_FOUND = "SELECT CAST(instrument_id AS BIGINT) AS instrument_id, name, ticker AS symbol, isin, currency FROM page_items"
_RUN_DAY = "DATE '2024-01-15'"


@query("list_ingest", "page_items listed_before", f"""
WITH found AS ({_FOUND}),
j AS (SELECT coalesce(n.instrument_id, m.instrument_id) AS instrument_id, m.instrument_id IS NOT NULL AS known, n.instrument_id IS NOT NULL AS seen, coalesce(m.active, false) AS was,
             coalesce(n.name, m.name) AS name, m.name AS old_name, n.name AS new_name, m.currency AS old_cur, n.currency AS new_cur, m.last_seen, m.delisted_at
      FROM listed_before m FULL JOIN found n ON m.instrument_id = n.instrument_id)
SELECT instrument_id, CASE WHEN NOT known THEN 'new' WHEN seen THEN 'reappeared' ELSE 'gone' END AS change, NULL AS field, NULL AS old, NULL AS new FROM j WHERE NOT known OR (seen AND NOT was) OR (NOT seen AND was)
UNION ALL SELECT instrument_id, 'changed', 'name', old_name, new_name FROM j WHERE known AND seen AND old_name <> new_name
UNION ALL SELECT instrument_id, 'changed', 'currency', old_cur, new_cur FROM j WHERE known AND seen AND old_cur IS DISTINCT FROM new_cur
UNION ALL SELECT instrument_id, 'master', name, CAST(CASE WHEN seen THEN {_RUN_DAY} ELSE last_seen END AS VARCHAR), CAST(CASE WHEN seen THEN NULL WHEN was THEN {_RUN_DAY} ELSE delisted_at END AS VARCHAR) FROM j""")
def _(t):
    run = ingest.ingest_list(t.state_pages, t.listed_before, F.expr(_RUN_DAY))
    after = run.master.select("instrument_id", F.lit("master").alias("change"), F.col("name").alias("field"), F.col("last_seen").cast("string").alias("old"),
                              F.col("delisted_at").cast("string").alias("new"))
    return run.log.unionByName(after)


# ------------------------------------------------------------------ classification
def _rule(pattern: str) -> str:
    """The pattern as a DuckDB condition; look-around is written as removal or as a second test."""
    n = "n"
    if pattern.startswith("^(?!"):
        return "NOT regexp_matches(n, 'enhanced|optimi[sz]ed') AND regexp_matches(n, '\\bai\\b|artificial intelligence|machine learning')"
    if "(?! transition)" in pattern:
        n, pattern = "replace(n, 'energy transition', '')", pattern.replace("(?! transition)", "")
    if "(?! average)" in pattern:
        n, pattern = "replace(replace(n, 'industrials average', ''), 'industrial average', '')", pattern.replace("(?! average)", "")
    if "(?<!" in pattern:
        n, pattern = "replace(replace(n, 'ex china', ''), 'ex-china', '')", pattern.replace("(?<!ex-)(?<!ex )", "")
    return f"regexp_matches({n}, '{pattern}')"


def _chain(rules, default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {_rule(p)} THEN '{lab}'" for p, lab in rules) + f" ELSE {default} END"


def _map(table, key, default="NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


DUCK["labels_x"] = f"""
WITH a AS (SELECT *, lower(name) AS n, CASE WHEN category = 'Trading Tools' THEN 'Giret/invers' WHEN category = 'Options Trading' THEN 'Opsjonsstrategi' WHEN category LIKE '%Money Market%' THEN 'Pengemarked'
    WHEN category LIKE 'Commodities%' THEN 'Råvarer' WHEN category LIKE '%Fixed Income%' THEN 'Renter' WHEN category LIKE '%Allocation%' THEN 'Blandet' WHEN category LIKE '%Equity%' THEN 'Aksjer'
    WHEN lower(fund_type) = 'aksje' THEN 'Aksjer' WHEN lower(fund_type) = 'rente' THEN 'Renter' WHEN lower(fund_type) = 'kombi' THEN 'Blandet' ELSE 'Alternativ' END AS ac FROM {{etf}}),
b AS (SELECT *, {_map(fv.REGION_FROM_CATEGORY, 'category')} AS rc, {_chain(fv.REGION_FROM_NAME)} AS rn, {_map(fv.SECTOR_FROM_CATEGORY, 'category')} AS sc, {_chain(fv.SECTOR_FROM_NAME, "'Bred'")} AS sn,
      {_chain(fv.BOND_SEGMENTS, "'Annen rente'")} AS bn, {_chain(fv.THEMES)} AS tn, {_chain(fv.STYLES)} AS yn, regexp_matches(n, '{fv.ESG}') AS is_esg FROM a)
SELECT isin, ac, CASE WHEN rc IS NULL THEN coalesce(rn, 'Global') WHEN rc = 'Global' AND rn = 'Fremvoksende' THEN rn ELSE rc END AS reg,
       CASE WHEN ac = 'Renter' THEN CASE WHEN category LIKE '%Emerging%' THEN 'Fremvoksende markeder (rente)' ELSE bn END WHEN ac <> 'Aksjer' THEN ac ELSE coalesce(sc, sn) END AS sec,
       CASE WHEN ac = 'Aksjer' THEN tn END AS thm, is_esg,
       CASE WHEN ac IN ('Aksjer', 'Opsjonsstrategi') THEN coalesce(yn, CASE WHEN category LIKE '%Growth%' THEN 'Vekst' WHEN category LIKE '%Value%' THEN 'Verdi'
            WHEN category LIKE '%Mid/Small%' OR category LIKE '%Small Cap%' OR category LIKE '%Mid Cap%' THEN 'Små/mellomstore' END, CASE WHEN ac = 'Opsjonsstrategi' THEN 'Opsjonsinntekt' ELSE 'Markedsvektet' END) END AS sty FROM b"""


@shared
def classified(t):
    return classify(t.etf.drop("asset_class", "region", "sector", "style", "esg"))


@query("classify_asset_class", "labels_x", "SELECT isin, ac AS asset_class FROM labels_x")
def _(t):
    return t.classified.select("isin", "asset_class")


@query("classify_region", "labels_x", "SELECT isin, reg AS region FROM labels_x")
def _(t):
    return t.classified.select("isin", "region")


@query("classify_sector", "labels_x", "SELECT isin, sec AS sector FROM labels_x")
def _(t):
    return t.classified.select("isin", "sector")


@query("classify_theme_style_esg", "labels_x", "SELECT isin, thm AS theme, sty AS style, is_esg AS esg FROM labels_x")
def _(t):
    return t.classified.select("isin", "theme", "style", "esg")


DUCK["norm_names"] = "SELECT isin, cluster_id, hedged, regexp_extract_all(regexp_replace(" + "".join("replace(" for _ in fv.ISSUERS) + "lower(name)" + "".join(
    f", '{i}', ' ')" for i in fv.ISSUERS) + f", '{fv.NAME_NOISE}', ' ', 'g'), '[a-z0-9]+') AS tokens FROM {{univ}}"


@query("name_control", "norm_names", """
WITH p AS (SELECT a.cluster_id, min(len(list_intersect(a.tokens, b.tokens)) / greatest(1, len(list_distinct(list_concat(a.tokens, b.tokens))))) AS low
           FROM norm_names a JOIN norm_names b ON a.cluster_id = b.cluster_id AND a.isin < b.isin GROUP BY a.cluster_id)
SELECT 'divergent' AS kind, cluster_id, NULL AS norm, NULL AS hedged, R6(low) AS value FROM p WHERE low < 0.2
UNION ALL SELECT 'split', NULL, array_to_string(tokens, ' ') AS norm, hedged, CAST(count(DISTINCT cluster_id) AS DOUBLE) FROM norm_names WHERE len(tokens) > 0 GROUP BY 3, 4 HAVING count(DISTINCT cluster_id) > 1""")
def _(t):
    return ins.name_control(t.univ)


# ------------------------------------------------------------------ fund details
SQL["cum_text"] = """
SELECT isin, CASE WHEN instrument_id % 7 = 0 THEN 'n/a' WHEN instrument_id % 11 = 0 THEN '-100' ELSE CAST(r1 * 137 AS STRING) END AS cum,
       CAST(1 + instrument_id % 3 * 2 AS INT) AS years FROM {fund}"""


@query("annualise", "cum_text", "SELECT isin, R6(CASE WHEN try_cast(cum AS DOUBLE) > -100 THEN pow(1 + try_cast(cum AS DOUBLE) / 100, 1.0::DOUBLE / years) - 1 END) AS yearly FROM cum_text")
def _(t):
    y = F.when(F.col("years") == 1, annualise(F.col("cum"), 1)).when(F.col("years") == 3, annualise(F.col("cum"), 3)).otherwise(annualise(F.col("cum"), 5))
    return t.cum_text.select("isin", y.alias("yearly"))


@query("fund_row", "fund", r"""
SELECT isin, name, fund_type = 'Indeks' AS is_index, company, R6(CASE WHEN instrument_id % 5 = 0 THEN floor(cost * 100) / 125 ELSE cost END) AS cost, R6(floor(cost * 100) / 125) AS fee, sfdr::DOUBLE AS sfdr, selection,
       round(pow(1 + r1, 1.0::DOUBLE / 1) - 1, 5) + 0.0 AS r1, round(pow(1 + r5, 1.0::DOUBLE / 5) - 1, 5) + 0.0 AS r5, nav_date, tradable,
       'fond-' || instrument_id AS slug, CASE acc WHEN true THEN true WHEN false THEN false END AS acc, true AS ask FROM fund""")
def _(t):
    fee = F.floor(F.col("cost") * 100) / 125
    raw = F.to_json(F.struct(
        F.struct(fee.alias("fund_yearly_fee"), F.when(F.col("instrument_id") % 5 != 0, F.col("cost")).alias("fund_total_fee"),
                 F.when(F.col("instrument_id") % 2 == 0, F.col("company")).alias("fund_branding_company"), F.col("company").alias("fund_admin_company"),
                 F.col("sfdr").alias("fund_raw_sfdr"), F.col("selection").alias("fund_nordnet_selection")).alias("fund_info"),
        F.struct((F.col("r1") * 100).alias("yield_1y"), (F.col("r5") * 100).alias("yield_5y")).alias("historical_returns_info"),
        F.struct(F.col("name").alias("long_name")).alias("instrument_info"), F.struct(F.concat(F.lit("fond-"), F.col("instrument_id").cast("string")).alias("display_slug")).alias("nnx_info"),
        F.struct((F.unix_date("nav_date").cast("long") * 86400000 + 36000000).alias("tick_timestamp")).alias("price_info")))
    f = t.fund.select("isin", F.when(F.col("instrument_id") % 3 != 0, F.col("name")).alias("name"), "category", "fund_type", raw.alias("raw_json"),
                      F.when(F.col("acc"), "Akkumulerende").when(~F.col("acc"), "Utdelende").alias("dividend_policy"), F.col("tradable").cast("string").alias("is_tradable"))
    return ins.fund_row(f).select("isin", "name", "is_index", "company", "cost", "fee", "sfdr", "selection", "r1", "r5", "nav_date", "tradable", "slug", "acc", "ask")


@query("risk_fields", "fund", """
SELECT instrument_id, R6(round(vol1 * 100 * 0.01, 6)) AS vol1, R6(round(vol3 * 100 * 0.01, 6)) AS vol3, R6(round(vol5 * 100 * 0.01, 6)) AS vol5, R3(r1 * 10) AS sharpe1, R6(round(r3 * 3 * 0.01, 6)) AS alpha3,
       round(vol1 * 0.01, 4) + 0.0 AS r21, CASE WHEN instrument_id % 6 = 0 THEN NULL ELSE round(vol3 * 7 * 0.01, 5) + 0.0 END AS te3 FROM fund""")
def _(t):
    api = F.to_json(F.struct(F.struct((F.col("vol1") * 100).alias("standard_deviation_y1"), (F.col("vol3") * 100).alias("standard_deviation_y3"), (F.col("vol5") * 100).alias("standard_deviation_y5"),
                                      (F.col("r1") * 10).alias("sharpe_ratio_y1"), (F.col("r3") * 3).alias("alpha_y3")).alias("risk_statistics")))
    te = F.when(F.col("instrument_id") % 6 == 0, "-").otherwise((F.col("vol3") * 7).cast("string"))
    obj = F.to_json(F.struct(F.struct(F.col("vol1").alias("r2")).alias("oneYear"), F.struct(te.alias("trackingError")).alias("threeYears")))
    quoted = F.replace(obj, F.lit('"'), F.lit('\\"'))
    html = F.when(F.col("instrument_id") % 2 == 0, F.concat(F.lit('<p>x</p><script>s="{\\"risksStatistics\\":'), quoted, F.lit(',\\"z\\":1}"</script>'))).otherwise(
        F.concat(F.lit('<script>s={"risksStatistics" : '), obj, F.lit("}</script>")))
    d = t.fund.select("instrument_id", api.alias("api_json"), pages.page_risk(html).alias("page_json"))
    return pages.risk_fields(d).select("instrument_id", "vol1", "vol3", "vol5", "sharpe1", "alpha3", "r21", "te3")


SQL["class_rows"] = """
SELECT c.asset, CASE WHEN no % 5 = 0 THEN NULL ELSE CASE c.currency WHEN 'GBp' THEN 'GBP' WHEN 'ZAc' THEN 'SEK' ELSE c.currency END END AS row_currency,
       CASE WHEN no % 4 <> 1 THEN p.close * CASE WHEN c.currency IN ('GBp', 'ZAc') THEN 0.01 ELSE 1.0 END * (1 + (no % 3) * 0.02) END AS price,
       CASE WHEN no % 2 = 0 THEN CAST(no - 10 AS DOUBLE) END AS yield_1y, CASE WHEN no % 3 = 0 THEN CAST(no * 2 - 20 AS DOUBLE) END AS yield_3y
FROM (SELECT asset, currency, CAST(substr(asset, 7) AS INT) AS no FROM {asset_ccy}) c
LEFT JOIN (SELECT asset, max_by(close, date) AS close FROM {panel} WHERE date <= DATE '2001-10-20' GROUP BY asset) p ON p.asset = c.asset"""


def _ret(src: str) -> str:
    return f"""SELECT e.asset, (e.c / b1.close - 1) * 100 AS r1, (e.c / b3.close - 1) * 100 AS r3
FROM (SELECT asset, max(date) - 365 AS t1, max(date) - 1095 AS t3, arg_max(close, date) AS c FROM {src} WHERE date <= DATE '2001-10-20' GROUP BY asset HAVING DATE '2001-10-20' - max(date) <= 10) e
ASOF LEFT JOIN {src} b1 ON b1.asset = e.asset AND b1.date <= e.t1 ASOF LEFT JOIN {src} b3 ON b3.asset = e.asset AND b3.date <= e.t3"""


@query("share_class_check", "base_panel panel subunit class_rows", f"""
WITH rb AS ({_ret('base_panel')}), rr AS ({_ret('panel')}),
j AS (SELECT c.*, u.currency AS cur, l.last, CASE WHEN h.asset IS NULL THEN rr.r1 ELSE rb.r1 END AS r1, CASE WHEN h.asset IS NULL THEN rr.r3 ELSE rb.r3 END AS r3, h.asset IS NOT NULL AS fx
      FROM class_rows c JOIN subunit u ON u.asset = c.asset LEFT JOIN rb ON rb.asset = c.asset LEFT JOIN rr ON rr.asset = c.asset LEFT JOIN (SELECT DISTINCT asset FROM base_panel) h ON h.asset = c.asset
      LEFT JOIN (SELECT p.asset, arg_max(close * factor, date) AS last FROM panel p JOIN subunit s ON s.asset = p.asset WHERE date <= DATE '2001-10-20' GROUP BY p.asset) l ON l.asset = c.asset),
k AS (SELECT *, CASE WHEN fx THEN r1 - yield_1y END AS d1, CASE WHEN fx THEN r3 - yield_3y END AS d3, CASE WHEN fx AND (row_currency IS NULL OR row_currency = cur) THEN last / price END AS price_ratio FROM j)
SELECT asset, R6(r1) AS r1, R6(r3) AS r3, R6(d1) AS d1, R6(d3) AS d3, R6(price_ratio) AS price_ratio,
       CASE WHEN NOT fx THEN 'ulik valuta' WHEN d1 IS NULL AND d3 IS NULL AND price_ratio IS NULL THEN 'ukjent'
            WHEN coalesce(abs(d1) <= 2, true) AND coalesce(abs(d3) <= 5, true) AND coalesce(abs(price_ratio - 1) <= 0.03, true) THEN 'ok' ELSE 'avvik' END AS status FROM k""")
def _(t):
    closes = t.panel.join(subunit_map_join(t.asset_ccy), "asset").withColumn("close", F.col("close") * F.col("factor")).drop("factor")
    return ins.share_class_check(closes, t.fx, t.class_rows, F.lit("2001-10-20").cast("date"))


@query("etf_row", "labels_x univ panel mret etf", """
WITH pk AS (SELECT cluster_id, isin, row_number() OVER (PARTITION BY cluster_id ORDER BY is_rep DESC, ask DESC, eff_fee, history_years DESC, fund_size DESC NULLS LAST, isin) AS rn FROM univ),
l AS (SELECT asset, arg_max(close, date) AS price, max(date) AS price_date, min(date) AS first_price FROM panel GROUP BY asset)
SELECT u.isin, u.ticker, split_part(u.name, ' ', 1) AS issuer, u.category, CAST(u.fund_size AS DOUBLE) AS fund_size, u.owners, e.currency, CAST(u.instrument_id % 7 AS BIGINT) AS risk, CAST(u.instrument_id % 5 AS BIGINT) AS rating,
       R6(u.fee / 10) AS spread, count(*) OVER (PARTITION BY u.cluster_id) AS cluster_size, R6((u.cluster_id % 10) / 1000.0::DOUBLE) AS max_te, R6(u.history_years) AS history_years, l.first_price,
       'https://example.org/' || u.isin AS url, u.name, x.ac AS asset_class, x.reg AS region, x.sec AS sector, x.thm AS theme, x.sty AS style, x.is_esg AS esg, R6(u.fee) AS fee, u.hedged, u.leveraged, u.ask,
       CASE WHEN e.dividend_policy IS NOT NULL THEN u.accumulating END AS acc, u.cluster_id AS cluster, pk.rn = 1 AS pick, u.is_rep AS rep, R6(l.price) AS price, l.price_date,
       l.asset IN (SELECT asset FROM mret GROUP BY asset HAVING count(*) >= 2) AS has_returns
FROM univ u JOIN labels_x x ON x.isin = u.isin JOIN pk ON pk.isin = u.isin JOIN etf e ON e.isin = u.isin LEFT JOIN l ON l.asset = 'Brand#' || CAST(u.cluster_id // 100 AS VARCHAR)""")
def _(t):
    # dozens of patterns a name: spread over tasks, in however few pieces the table lies
    u = flagged(spread(t.etf, "isin")).drop("asset_class", "region", "sector", "style", "esg").withColumn("asset", F.concat(F.lit("Brand#"), F.floor(F.col("cluster_id") / 100).cast("string")))
    u = u.withColumns({"issuer": F.split_part("name", F.lit(" "), F.lit(1)), "risk": (F.col("instrument_id") % 7).cast("long"), "rating": (F.col("instrument_id") % 5).cast("long"),
                       "fund_size": F.col("fund_size").cast("double"), "spread_pct": F.col("fee") / 10, "max_te": (F.col("cluster_id") % 10) / 1000, "url": F.concat(F.lit("https://example.org/"), "isin")})
    return ins.etf_row(u, t.panel, t.mret)


# ------------------------------------------------------------------ exports
@query("json_export", "etf", """
SELECT isin, CAST(json_object('isin', isin, 'name', name, 'fee', fee, 'owners', owners, 'hedged', hedged) AS VARCHAR) AS json FROM etf""")
def _(t):
    nan = F.when(F.col("fee").isNull(), F.lit(float("nan"))).otherwise(F.col("fee"))
    return tables.json_lines(t.etf.select("isin", "name", nan.alias("fee"), "owners", "hedged"), "isin")


@query("csv_export", "etf", '''
SELECT isin, isin || ',' || name || ',' || coalesce(printf('%.4f', fee), '') || ',' || cluster_id AS report_line,
       isin || ';' || CASE WHEN instrument_id % 7 = 0 THEN '"' || name || '; ""x"""' ELSE name END || ';' || coalesce(replace(printf('%.4f', fee), '.', ','), '') AS local_line FROM etf''')
def _(t):
    report = tables.csv_lines(t.etf.select("isin", "name", "fee", "cluster_id"), "isin", {"fee": 4}).withColumnRenamed("line", "report_line")
    odd = F.when(F.col("instrument_id") % 7 == 0, F.concat("name", F.lit('; "x"'))).otherwise(F.col("name"))
    local = tables.csv_lines(t.etf.select("isin", odd.alias("name"), "fee"), "isin", {"fee": 4}, comma=True).withColumnRenamed("line", "local_line")
    return report.join(local, "isin")
