"""Queries over runs, snapshots, work lists, incremental tables and listings."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W, functions as F

from lodestar.operators import changes as ch, checks, incremental as inc, ranking as rk
from lodestar.params import DEFAULTS
from lodestar.plans.adapters import DUCK, SQL
from lodestar.plans.registry import query, shared, stage

NOW = "DATE '2024-01-31'"
_TXT_FEE = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"

# ------------------------------------------------------------------ incremental price tables
SQL["stored"] = "SELECT * FROM {panel} WHERE date < DATE '2001-10-15'"
SQL["fetched"] = """
SELECT p.asset, p.date, p.close * CASE WHEN c.currency = 'USD' THEN 1.02 ELSE 1.01 END AS close, c.currency = 'USD' AS is_full
FROM {panel} p JOIN {asset_ccy} c ON p.asset = c.asset
WHERE c.currency = 'USD' OR (c.currency <> 'JPY' AND p.date >= DATE '2001-10-01')"""
SQL["day_divs"] = "SELECT asset, date, sum(amount) AS amount FROM {divs} GROUP BY asset, date"
DUCK["upserted"] = """
SELECT asset, date, close FROM {fetched} UNION ALL
SELECT s.asset, s.date, s.close FROM {stored} s WHERE NOT EXISTS (SELECT 1 FROM {fetched} f WHERE f.asset = s.asset AND (f.is_full OR f.date <= s.date))"""


@query("price_upsert", "upserted fetched day_divs", """
SELECT 'close' AS kind, asset, date, R6(close) AS value FROM upserted
UNION ALL SELECT 'dividend', d.asset, d.date, R6(CASE WHEN f.asset IS NULL THEN d.amount ELSE d.amount * 3 END)
FROM day_divs d LEFT JOIN (SELECT asset, min(date) AS cut, bool_or(is_full) AS is_full FROM fetched GROUP BY asset) f ON f.asset = d.asset AND (f.is_full OR d.date >= f.cut)""")
def _(t):
    cuts = inc.refetch_cuts(t.fetched)
    closes = inc.upsert(t.stored, t.fetched, cuts)
    new_divs = (t.day_divs.join(cuts, "asset").where(F.col("is_full") | (F.col("date") >= F.col("cut")))
                .select("asset", "date", (F.col("amount") * 3).alias("amount")))
    divs = inc.upsert(t.day_divs, new_divs, cuts)
    return closes.select(F.lit("close").alias("kind"), "asset", "date", F.col("close").alias("value")).union(
        divs.select(F.lit("dividend"), "asset", "date", "amount"))


@query("changed_partitions", "panel", """
WITH o AS (SELECT *, year(date) AS y FROM panel WHERE year(date) <> 1995),
n AS (SELECT asset, date, CASE WHEN date >= DATE '2001-10-01' THEN close * 1.01 ELSE close END AS close, year(date) AS y FROM panel WHERE year(date) <> 1997),
d AS (SELECT y FROM (SELECT * FROM o EXCEPT SELECT * FROM n) a UNION SELECT y FROM (SELECT * FROM n EXCEPT SELECT * FROM o) b)
SELECT CAST(y AS BIGINT) AS year, CASE WHEN y NOT IN (SELECT y FROM o) THEN 'new' WHEN y NOT IN (SELECT y FROM n) THEN 'gone' ELSE 'changed' END AS status FROM d""")
def _(t):
    rows = t.panel.withColumn("year", F.year("date").cast("long"))
    new = rows.where(F.col("year") != 1997).withColumn("close", F.when(F.col("date") >= F.lit("2001-10-01").cast("date"), F.col("close") * 1.01).otherwise(F.col("close")))
    return inc.changed_partitions(rows.where(F.col("year") != 1995), new)


@query("split_refetch_flags", "stored splits", """
SELECT asset, l.d AS last, s.d AS split_date FROM (SELECT asset, max(date) AS d FROM stored GROUP BY asset) l
JOIN (SELECT asset, max(date) AS d FROM splits GROUP BY asset) s USING (asset) WHERE s.d > l.d""")
def _(t):
    return inc.split_refetch_flags(t.stored, t.splits)


SQL["fx_old"] = "SELECT * FROM {fx} WHERE date < DATE '2000-01-01' AND currency <> 'GBP'"
# later passes repeat some days with another rate; the last one counts
SQL["fx_new"] = """
SELECT currency, date, rate * 1.09371737 AS rate, 1 AS seq FROM {fx} WHERE date >= DATE '1999-12-20' AND currency <> 'ZAR'
UNION ALL SELECT currency, date, rate * 1.20711313, 2 FROM {fx} WHERE day(date) = 28 AND date >= DATE '1999-12-20' AND currency <> 'ZAR'"""


@query("fx_merge", "fx_old fx_new", """
SELECT date, currency, R6(arg_max(rate, seq)) AS rate FROM (SELECT date, currency, rate, 0 AS seq FROM fx_old UNION ALL SELECT date, currency, rate, seq FROM fx_new) u
GROUP BY date, currency""")
def _(t):
    return inc.fx_merge(t.fx_old, t.fx_new, F.col("seq"))


@query("fx_fetch_start", "fx_old fx", """
SELECT c.currency, coalesce(max(o.date) - 10, DATE '1999-01-01') AS start FROM (SELECT DISTINCT currency FROM fx) c LEFT JOIN fx_old o USING (currency) GROUP BY c.currency""")
def _(t):
    return inc.fx_fetch_start(t.fx_old, t.fx)


SQL["failures"] = "SELECT asset, 'no data' AS error FROM {asset_ccy} WHERE currency = 'JPY'"


@query("price_meta", "panel failures", """
WITH p AS (SELECT asset, min(date) AS f, max(date) AS l, count(*) AS n FROM panel WHERE asset NOT IN (SELECT asset FROM failures) GROUP BY asset)
SELECT asset, f AS first_date, l AS last_date, n AS n_obs, l >= DATE '2001-12-12' - 30 AS ok,
       CASE WHEN l < DATE '2001-12-12' - 30 THEN 'stale (last ' || CAST(l AS VARCHAR) || ')' END AS error FROM p
UNION ALL SELECT asset, NULL, NULL, NULL, false, error FROM failures""")
def _(t):
    return inc.price_meta(t.panel, t.failures, F.lit("2001-12-12").cast("date"))


@query("candidate_history", "cand", """
SELECT isin, ticker, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date_trunc('month', date)) AS n_months FROM cand GROUP BY isin, ticker""")
def _(t):
    return inc.candidate_history(t.cand, ["isin", "ticker"])


# ------------------------------------------------------------------ runs and change log
@query("run_gate", "runs", """
SELECT run_id, n_found, prior, partial, n_found > 0 AND (partial OR prior = 0 OR n_found >= 0.9 * prior) AS ok,
       n_found > 0 AND (partial OR prior = 0 OR n_found >= 0.97 * prior) AS ok_strict
FROM (SELECT *, coalesce(lag(n_found) OVER (ORDER BY run_id), 0) AS prior FROM runs) r""")
def _(t):
    prior = F.coalesce(F.lag("n_found").over(W.orderBy("run_id")), F.lit(0))       # run table: one row per run
    r = t.runs.withColumn("prior", prior)
    args = F.col("n_found"), F.col("prior"), F.col("partial")
    return r.select("run_id", "n_found", "prior", "partial", checks.run_gate(*args).alias("ok"),
                    checks.run_gate(*args, replace(DEFAULTS, min_fraction_of_previous=0.97)).alias("ok_strict"))


@query("snapshot_diff", "master run_now", """
SELECT coalesce(m.instrument_id, n.instrument_id) AS instrument_id,
       CASE WHEN m.instrument_id IS NULL THEN 'new' WHEN n.instrument_id IS NULL THEN 'gone' ELSE 'reappeared' END AS change
FROM master m FULL JOIN run_now n ON m.instrument_id = n.instrument_id
WHERE m.instrument_id IS NULL OR (n.instrument_id IS NULL AND m.active) OR (n.instrument_id IS NOT NULL AND NOT m.active)""")
def _(t):
    return ch.snapshot_diff(t.master, t.run_now)


_CELLS = [("isin", "{}.isin"), ("name", "{}.name"), ("category", "{}.category"), ("fee", _TXT_FEE.format("{0}.fee")), ("is_tradable", "{}.is_tradable")]


@query("field_changes", "master run_now", " UNION ALL ".join(
    f"SELECT instrument_id, '{f}' AS field, {e.format('m')} AS old, {e.format('n')} AS new FROM master m JOIN run_now n USING (instrument_id) "
    f"WHERE n.{f} IS NOT NULL AND {e.format('m')} IS DISTINCT FROM {e.format('n')}" for f, e in _CELLS))
def _(t):
    return ch.field_changes(t.master, t.run_now)


@query("master_merge", "master run_now", f"""
SELECT coalesce(n.instrument_id, m.instrument_id) AS instrument_id, coalesce(n.isin, m.isin) AS isin, coalesce(n.name, m.name) AS name,
       coalesce(n.category, m.category) AS category, R6(coalesce(n.fee, m.fee)) AS fee, coalesce(n.owners, m.owners) AS owners,
       coalesce(n.is_tradable, m.is_tradable) AS is_tradable, coalesce(m.first_seen, {NOW}) AS first_seen,
       CASE WHEN n.instrument_id IS NULL THEN m.last_seen ELSE {NOW} END AS last_seen,
       CASE WHEN n.instrument_id IS NULL THEN CASE WHEN m.active THEN {NOW} ELSE m.delisted_at END END AS delisted_at, n.instrument_id IS NOT NULL AS active
FROM master m FULL JOIN run_now n ON m.instrument_id = n.instrument_id""")
def _(t):
    return ch.master_merge(t.master, t.run_now, F.expr(NOW))


DUCK["events_log"] = """
SELECT r.run_id, i.instrument_id, max(s.run_id) FILTER (s.run_id < r.run_id) AS ls, bool_or(s.run_id = r.run_id) AS here, max(r.partial) AS partial
FROM {runs} r CROSS JOIN (SELECT DISTINCT instrument_id FROM {snap}) i JOIN {snap} s ON s.instrument_id = i.instrument_id AND s.run_id <= r.run_id
GROUP BY r.run_id, i.instrument_id"""
DUCK["status_log"] = """
SELECT run_id, instrument_id, CASE WHEN ls IS NULL THEN 'new' WHEN here THEN 'reappeared' ELSE 'gone' END AS change
FROM (SELECT *, (SELECT count(*) FROM {runs} f WHERE NOT f.partial AND f.run_id > ls AND f.run_id < e.run_id) AS between_ FROM {events_log} e) x
WHERE (ls IS NULL AND here) OR (here AND between_ > 0) OR (NOT here AND ls IS NOT NULL AND NOT partial AND between_ = 0)"""
DUCK["cells"] = " UNION ALL ".join(
    f"SELECT run_id, instrument_id, '{f}' AS field, last_value({e.format('s')} IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old, "
    f"{e.format('s')} AS new, lag(run_id) OVER (PARTITION BY instrument_id ORDER BY run_id) AS prev FROM {{snap}} s" for f, e in _CELLS)
DUCK["log"] = """
SELECT l.run_id, l.instrument_id, l.change, NULL AS field, CASE WHEN l.change = 'gone' THEN 'Fund ' || l.instrument_id END AS old,
       CASE WHEN l.change <> 'gone' THEN 'Fund ' || l.instrument_id END AS new FROM {status_log} l
UNION ALL SELECT run_id, instrument_id, 'changed', field, old, new FROM {cells} WHERE prev IS NOT NULL AND new IS NOT NULL AND old IS DISTINCT FROM new"""


@stage
def log(t):
    return ch.change_log(t.snap, t.runs)


@query("change_log", "log", "SELECT * FROM log")
def _(t):
    return t.log


@query("run_summary", "log runs", """
SELECT r.run_id, count(*) FILTER (change = 'new') AS n_new, count(*) FILTER (change = 'gone') AS n_gone,
       count(*) FILTER (change = 'reappeared') AS n_reappeared, count(*) FILTER (change = 'changed') AS n_changed
FROM runs r LEFT JOIN log USING (run_id) GROUP BY r.run_id""")
def _(t):
    return ch.run_summary(t.runs, t.log)


@query("change_log_rollup", "log runs master", """
WITH c AS (SELECT run_id, change, count(*) AS n FROM log GROUP BY run_id, change)
SELECT c.run_id, r.run_at, c.change, c.n, l.instrument_id, l.field, l.old, l.new, m.isin, m.name AS instrument
FROM c JOIN runs r ON r.run_id = c.run_id LEFT JOIN log l ON l.run_id = c.run_id AND l.change = c.change AND l.run_id > (SELECT min(run_id) FROM log)
LEFT JOIN master m ON m.instrument_id = l.instrument_id""")
def _(t):
    return ch.change_log_rollup(t.log, t.runs, t.master)


DUCK["latest"] = """
SELECT s.* FROM {snap} s JOIN (SELECT instrument_id, max(run_id) AS r FROM {snap} GROUP BY instrument_id) x ON x.instrument_id = s.instrument_id AND x.r = s.run_id
JOIN {master} m ON m.instrument_id = s.instrument_id WHERE m.active AND m.isin IS NOT NULL"""


@shared
def latest(t):
    return ch.latest_snapshot(t.snap, t.master)


@query("latest_snapshot", "latest", "SELECT run_id, run_date, instrument_id, isin, name, category, R6(fee) AS fee, k, owners, is_tradable FROM latest")
def _(t):
    return t.latest


@query("fund_snapshot_join", "master snap runs", """
SELECT m.instrument_id, m.isin, s.category, R6(s.fee) AS fee, r.run_at, r.n_found
FROM master m JOIN snap s ON s.instrument_id = m.instrument_id AND s.run_id = (SELECT max(run_id) FROM snap x WHERE x.instrument_id = m.instrument_id)
JOIN runs r ON r.run_id = s.run_id WHERE m.active AND m.isin IS NOT NULL""")
def _(t):
    return (t.latest.join(t.runs.select("run_id", "run_at", "n_found"), "run_id").join(t.master.select("instrument_id", F.col("isin").alias("m_isin")), "instrument_id")
            .select("instrument_id", F.col("m_isin").alias("isin"), "category", "fee", "run_at", "n_found"))


@query("listing_left_join", "listing snap", """
WITH l AS (SELECT * FROM snap WHERE run_id = (SELECT max(run_id) FROM snap)),
j AS (SELECT li.isin, li.instrument_id, li.currency, l.k, row_number() OVER (PARTITION BY li.isin ORDER BY li.instrument_id % 2 DESC, li.instrument_id) AS rn
      FROM listing li LEFT JOIN l ON l.instrument_id = li.instrument_id)
SELECT isin, instrument_id, currency, k FROM j WHERE rn = 1""")
def _(t):
    last = t.snap.where(F.col("run_id") == t.snap.agg(F.max("run_id")).scalar()).select("instrument_id", "k")
    j = t.listing.join(last, "instrument_id", "left")
    return rk.first_per(j.select("isin", "instrument_id", "currency", "k"), "isin", [-(F.col("instrument_id") % 2), F.col("instrument_id")])


# ------------------------------------------------------------------ work lists
SQL["fetches"] = """
SELECT user_id AS instrument_id, CAST(max(ts) AS DATE) AS fetched_at,
       CASE WHEN max(event_id) % 5 = 0 THEN 500 WHEN max(event_id) % 5 = 1 THEN 404 ELSE 200 END AS api_status,
       CASE WHEN max(event_id) % 4 = 0 THEN 0 WHEN max(event_id) % 4 = 1 THEN -1 ELSE 200 END AS page_status
FROM {events} WHERE event_type = 'purchase' GROUP BY user_id"""
_FRESH = {"details": ("api_status = 200 AND page_status IN (200, 404, -1)", "2024-01-20"), "holdings": ("api_status IN (200, 404)", "2024-01-27"),
          "mapping": ("page_status <> 0", "2024-01-29")}


@query("stale_work_list", "master fetches", " UNION ALL ".join(
    f"SELECT '{w}' AS what, instrument_id, isin, owners FROM master m WHERE active AND NOT EXISTS (SELECT 1 FROM fetches f "
    f"WHERE f.instrument_id = m.instrument_id AND fetched_at >= DATE '{d}' AND {c})" for w, (c, d) in _FRESH.items()))
def _(t):
    live = t.master.where("active").select("instrument_id", "isin", "owners")
    parts = [ch.stale_work_list(live, t.fetches, "instrument_id", F.expr(f"fetched_at >= DATE '{d}' AND {c}"))
             .select(F.lit(w).alias("what"), "instrument_id", "isin", "owners") for w, (c, d) in _FRESH.items()]
    return parts[0].union(parts[1]).union(parts[2])


SQL["top_rows"] = "SELECT isin, CAST(label AS BIGINT) AS holding_id, weight FROM {alloc} WHERE kind = 'top'"
SQL["known_names"] = """
SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS holding_id,
       split_part('Alphabet Inc|Novo Nordisk A/S|Equinor ASA|Volvo AB|Shell plc|Nokia Oyj|Alphabet Corp|Berkshire Corporation|Volvo|Siemens AG', '|', CAST(CAST(substr(p_brand, 7) AS INT) % 10 + 1 AS INT))
       || split_part(' Class A| Ser. B|, Inc.| C|.', '|', CAST(CAST(substr(p_brand, 7) AS INT) % 5 + 1 AS INT)) AS name,
       split_part('US|DK|NO|SE', '|', CAST(CAST(substr(p_brand, 7) AS INT) % 4 + 1 AS INT)) AS country
FROM {part} WHERE CAST(substr(p_brand, 7) AS INT) % 6 <> 0"""


@query("missing_names", "top_rows known_names", "SELECT DISTINCT holding_id FROM top_rows WHERE holding_id NOT IN (SELECT holding_id FROM known_names)")
def _(t):
    return ch.missing_names(t.top_rows, t.known_names)


@query("known_isin_semi", "top_rows known_names panel asset_ccy", """
SELECT isin AS owner, CAST(holding_id AS VARCHAR) AS item, R6(weight) AS value FROM top_rows WHERE holding_id IN (SELECT holding_id FROM known_names)
UNION ALL SELECT asset, CAST(date AS VARCHAR), R6(close) FROM panel WHERE asset IN (SELECT asset FROM asset_ccy WHERE currency <> 'NOK')""")
def _(t):
    held = t.top_rows.join(t.known_names, "holding_id", "left_semi").select(F.col("isin").alias("owner"), F.col("holding_id").cast("string").alias("item"), F.col("weight").alias("value"))
    series = t.panel.join(t.asset_ccy.where("currency <> 'NOK'"), "asset", "left_semi")
    return held.unionAll(series.select("asset", F.col("date").cast("string"), "close"))


@query("schema_evolve", "", """
SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, R6(s_acctbal) AS balance, NULL AS segment FROM supplier
UNION ALL SELECT c_custkey, c_name, c_nationkey, R6(c_acctbal), c_mktsegment FROM customer""")
def _(t):
    old = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    new = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"),
                            F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return ch.schema_evolve(["id", "name", "nation", "balance", "segment"], old, new)


@query("universe_history", "snap etf", """
SELECT run_date AS built_at, isin, k AS cluster_id, k % 2 = 0 AS is_representative FROM snap WHERE isin IS NOT NULL
UNION ALL SELECT DATE '2024-01-31', isin, cluster_id, is_rep FROM etf""")
def _(t):
    history = t.snap.where(F.col("isin").isNotNull()).select(F.col("run_date").alias("built_at"), "isin", F.col("k").alias("cluster_id"), (F.col("k") % 2 == 0).alias("is_representative"))
    return ch.universe_history(history, t.etf.withColumnRenamed("is_rep", "is_representative"), F.expr(NOW))


SQL["mapping"] = """
SELECT isin, ticker, min_by(source, pos) AS source, min(pos) % 3 <> 0 AS chosen, min(pos) % 4 <> 0 AS ok, CASE WHEN min(pos) % 4 = 0 THEN 'stale' END AS error FROM {cand} GROUP BY isin, ticker"""
SQL["broken"] = "SELECT ticker, 'no quotes' AS error, max(pos) AS pos FROM {cand} WHERE source = 'codes' GROUP BY ticker HAVING count(*) % 2 = 0"


@query("mapping_invalidate", "mapping broken", """
SELECT m.isin, m.ticker, m.chosen, m.ok AND NOT (m.chosen AND b.ticker IS NOT NULL) AS ok,
       CASE WHEN m.chosen AND b.ticker IS NOT NULL THEN b.error ELSE m.error END AS error, m.chosen AND m.ok AND b.ticker IS NULL AS valid
FROM mapping m LEFT JOIN broken b ON b.ticker = m.ticker""")
def _(t):
    return ch.mapping_invalidate(t.mapping.drop("source"), t.broken)


SQL["passes"] = """
SELECT r.round, s.instrument_id, CAST(floor(s.instrument_id / 20) AS BIGINT) AS page, s.instrument_id % 20 AS pos, s.category
FROM {snap} s JOIN (SELECT run_id, CAST(row_number() OVER (ORDER BY run_id) AS BIGINT) AS round FROM {runs}) r ON r.run_id = s.run_id"""


@query("page_round_union", "passes", """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY round, page, pos) AS rn FROM passes),
c AS (SELECT round, count(*) AS n FROM f WHERE rn = 1 GROUP BY round),
s AS (SELECT min(round) AS stop FROM (SELECT round, sum(n) OVER (ORDER BY round) AS seen FROM c) x WHERE seen >= (SELECT floor(0.97 * count(DISTINCT instrument_id)) FROM passes))
SELECT instrument_id, round, page, pos, category FROM f WHERE rn = 1 AND round <= coalesce((SELECT stop FROM s), round)""")
def _(t):
    return ch.page_round_union(t.passes, F.floor(t.passes.agg(F.count_distinct("instrument_id") * 0.97).scalar()))
