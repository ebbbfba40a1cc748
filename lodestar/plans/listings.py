"""Queries over instruments, funds and listings: flags, filters, picks, rankings, facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.fixed_values import ASK_COUNTRIES, CODE_SUFFIX, LISTING_SUFFIX
from lodestar.operators import predicates as pr, ranking as rk, reports as rp, timeseries as ts
from lodestar.plans.adapters import DUCK, SQL
from lodestar.plans.registry import query, shared, stage

_LEV = r"(category = 'Trading Tools' OR regexp_matches(lower(name), 'leverag|\b[2-5]x\b|\(-?[1-5]x\)|short|invers|\bbear\b|\bbull\b'))"
_HEDGED = r"regexp_matches(replace(lower(name), 'tail hedg', ''), 'hedg|\bhdg\b|\bhgd\b|pfhdg')"
_TRUE = "coalesce(lower(trim(is_tradable)) IN ('1', 'true', 'yes'), false)"
_ASK = "substr(isin, 1, 2) IN (" + ", ".join(f"'{c}'" for c in ASK_COUNTRIES) + ")"

DUCK["univ"] = f"""
SELECT *, reason = '' AS eligible, coalesce(fee, 9.99) + CASE WHEN accumulating THEN 0 ELSE 0.1 END AS eff_fee FROM (
  SELECT *, concat_ws('; ', CASE WHEN NOT has_prices THEN 'mangler prisdata' WHEN history_years < 5 THEN 'historikk ' || replace(printf('%.1f', history_years), '.', ',') || ' år < 5' END,
                      CASE WHEN NOT {_TRUE} THEN 'ikke handlebar' END, CASE WHEN leveraged THEN 'giret/invers/handelsverktøy' END,
                      CASE WHEN NOT ask THEN 'ikke ASK-tillatt' END) AS reason
  FROM (SELECT instrument_id, isin, name, cluster_id, fee, fund_size, owners, history_years, is_tradable, has_prices, was_rep, is_rep, category, r5, vol5, ticker,
               coalesce({_LEV}, false) AS leveraged, {_HEDGED} AS hedged, coalesce(starts_with(lower(dividend_policy), 'akk'), false) AS accumulating, {_ASK} AS ask FROM {{etf}}) a) b"""


def flagged(etf):
    flags = pr.instrument_flags(etf).withColumn("ask_eligible", pr.ask_eligible(F.substring("isin", 1, 2)))
    return pr.eligibility_reasons(flags).withColumn("eff_fee", rk.effective_fee(F.col("fee"), F.col("accumulating")))


@shared
def univ(t):
    return flagged(t.etf)


@query("instrument_flags", "univ", "SELECT isin, leveraged, hedged, accumulating, ask FROM univ")
def _(t):
    return t.univ.select("isin", "leveraged", "hedged", "accumulating", F.col("ask_eligible").alias("ask"))


@query("eligibility_reasons", "univ", "SELECT isin, reason AS ineligible_reason, eligible FROM univ")
def _(t):
    return t.univ.select("isin", "ineligible_reason", "eligible")


# ------------------------------------------------------------------ picks
_PREF = "CASE currency WHEN 'NOK' THEN 0 WHEN 'EUR' THEN 1 WHEN 'SEK' THEN 2 WHEN 'DKK' THEN 3 WHEN 'USD' THEN 4 ELSE 5 END"


@query("pick_listing", "listing", f"""
SELECT isin, instrument_id, name, currency, is_tradable, R6(spread_pct) AS spread_pct, CAST(total AS BIGINT) AS owners
FROM (SELECT *, sum(owners) OVER (PARTITION BY isin) AS total, row_number() OVER (PARTITION BY isin ORDER BY NOT {_TRUE}, {_PREF}, spread_pct NULLS LAST, coalesce(owners, 0) DESC, instrument_id) AS rn FROM listing) s WHERE rn = 1""")
def _(t):
    return rk.pick_listing(t.listing)


@query("owners_sum", "listing", "SELECT isin, CAST(sum(owners) AS BIGINT) AS owners FROM listing GROUP BY isin")
def _(t):
    return rk.owners_sum(t.listing)


@query("one_per_isin", "master", """
WITH m AS (SELECT isin, instrument_id, owners, category, row_number() OVER (PARTITION BY isin ORDER BY owners DESC NULLS LAST, instrument_id) AS a,
                  row_number() OVER (PARTITION BY isin ORDER BY CASE WHEN category = 'click' THEN 0 ELSE 1 END, owners DESC NULLS LAST, instrument_id) AS b
           FROM master WHERE active AND isin IS NOT NULL)
SELECT 'owners' AS rule, isin, instrument_id FROM m WHERE a = 1 UNION ALL SELECT 'preferred', isin, instrument_id FROM m WHERE b = 1""")
def _(t):
    m = t.master.select("isin", "instrument_id", "owners", "category", "active")
    pref = F.when(F.col("category") == "click", 0).otherwise(1)
    return (rk.one_per_isin(m).select(F.lit("owners").alias("rule"), "isin", "instrument_id")
            .union(rk.one_per_isin(m, pref).select(F.lit("preferred"), "isin", "instrument_id")))


@query("cluster_pick", "univ", """
SELECT cluster_id, isin FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY is_rep DESC, ask DESC, eff_fee, history_years DESC, fund_size DESC NULLS LAST, isin) AS rn FROM univ) s WHERE rn = 1""")
def _(t):
    return rk.cluster_pick(t.univ)


DUCK["reps"] = """
SELECT u.isin, u.cluster_id, u.isin = c.choice AND c.choice IS NOT NULL AS rep,
       CASE WHEN u.isin = c.choice THEN c.why WHEN u.eligible THEN 'alternativ i klyngen' ELSE u.reason END AS why
FROM {univ} u LEFT JOIN (
  SELECT cluster_id, CASE WHEN keep THEN held ELSE best END AS choice,
         CASE WHEN keep THEN 'beholdt forrige representant (hysterese)' WHEN held <> best THEN 'byttet: ' || printf('%.2f', gain) || ' pp lavere avgift enn forrige representant'
              WHEN held IS NOT NULL THEN 'beholdt forrige representant' WHEN n = 1 THEN 'eneste kvalifiserte' WHEN f1 = f2 THEN 'lik avgift, størst fond/flest eiere' ELSE 'lavest avgift' END AS why
  FROM (SELECT *, hf - f1 AS gain, held IS NOT NULL AND held <> best AND hf - f1 < 0.05 - 1e-9 AS keep FROM (
    SELECT cluster_id, count(*) AS n, max(isin) FILTER (rn = 1) AS best, max(eff_fee) FILTER (rn = 1) AS f1, max(eff_fee) FILTER (rn = 2) AS f2,
           max(isin) FILTER (rh = 1 AND was_rep) AS held, max(eff_fee) FILTER (rh = 1 AND was_rep) AS hf
    FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, was_rep ORDER BY rn) AS rh FROM (
      SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(eff_fee, 4), coalesce(fund_size, -1) DESC, coalesce(owners, -1) DESC, history_years DESC, isin) AS rn
      FROM {univ} WHERE eligible) a) b GROUP BY cluster_id) c) d) c ON c.cluster_id = u.cluster_id"""


@shared
def reps(t):
    return rk.representatives(t.univ)


@query("representatives", "reps", "SELECT isin, cluster_id, rep AS is_representative, why AS reason FROM reps")
def _(t):
    return t.reps


@query("cluster_report", "univ", """
SELECT cluster_id, n AS cluster_size, isin, is_rep, eligible, R6(eff_fee) AS eff_fee, R6(history_years) AS history_years, owners
FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n FROM univ) s WHERE n > 1""")
def _(t):
    sizes = t.univ.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return rk.cluster_report(t.univ.join(sizes, "cluster_id")).select(
        "cluster_id", "cluster_size", "isin", "is_rep", "eligible", "eff_fee", "history_years", "owners")


@query("cluster_alternates", "univ", """
SELECT h.isin AS held, u.cluster_id, u.isin, R6(u.fee) AS fee, R6(u.history_years) AS history_years, R6(u.r5) AS r5, u.ask AS ask_eligible
FROM univ h JOIN univ u ON u.cluster_id = h.cluster_id AND u.isin <> h.isin WHERE h.was_rep""")
def _(t):
    return rk.cluster_alternates(t.univ, t.univ.where("was_rep"))


_METRIC = "vol5 AS vol, r5 / vol5 AS sharpe, r3 - r1 AS alpha, r10 AS ir, r5 AS ret, -vol3 AS mdd, fee"
_RANKS = {"sharpe": "r5 / vol5", "alpha": "r3 - r1", "ir": "r10", "ret": "r5", "vol_low": "-vol5", "mdd_low": "-vol3", "fee_low": "-fee"}


@query("top_n_per_group", "etf", " UNION ALL ".join(f"""
SELECT '{k}' AS ranking, sector, isin, CAST(rn AS INT) AS position FROM (SELECT coalesce(sector, '–') AS sector, isin,
  row_number() OVER (PARTITION BY coalesce(sector, '–') ORDER BY {e} DESC, isin) AS rn FROM etf WHERE {e} IS NOT NULL) s WHERE rn <= 5""" for k, e in _RANKS.items()))
def _(t):
    m = t.etf.select("isin", F.coalesce("sector", F.lit(pr.MISSING)).alias("sector"), F.expr(
        "struct(vol5 AS vol, r5 / vol5 AS sharpe, r3 - r1 AS alpha, r10 AS ir, r5 AS ret, -vol3 AS mdd, fee)").alias("_m")).select("isin", "sector", "_m.*")
    parts = [rk.top_n_per_group(m, "sector", k, 5, "isin").select(F.lit(k).alias("ranking"), "sector", "isin", "position") for k in _RANKS]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


# ------------------------------------------------------------------ candidates
DUCK["merged"] = """
SELECT isin, ticker, string_agg(source, ',' ORDER BY source_rank, pos) AS sources, min((source_rank, pos)) AS at_
FROM (SELECT isin, ticker, source, min(source_rank) AS source_rank, min(pos) AS pos FROM {cand} GROUP BY isin, ticker, source) s GROUP BY isin, ticker"""
DUCK["placed"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY at_) AS place FROM {merged}) s WHERE place <= 8"
DUCK["probed"] = """
SELECT p.isin, p.ticker, p.place, p.sources, h.l AS last_date, h.n AS n_months FROM {placed} p
JOIN (SELECT isin, ticker, max(date) AS l, count(DISTINCT date) AS n FROM {cand} GROUP BY isin, ticker) h ON h.isin = p.isin AND h.ticker = p.ticker"""


@query("candidate_merge_choose", "probed", """
WITH best AS (SELECT isin, arg_max(ticker, (n_months, -place)) AS ticker FROM probed WHERE last_date >= DATE '2024-02-15' - 30 GROUP BY isin)
SELECT p.isin, p.ticker, p.sources, p.place, coalesce(b.ticker = p.ticker, false) AS chosen FROM probed p LEFT JOIN best b ON b.isin = p.isin""")
def _(t):
    merged = rk.candidate_merge(t.cand)
    days = t.cand.groupBy("isin", "ticker").agg(F.max("date").alias("last_date"), F.count_distinct("date").alias("n_months"))
    probed = merged.join(days, ["isin", "ticker"]).withColumn("ok", F.lit(True))
    best = rk.choose_candidate(probed, F.lit("2024-02-15").cast("date")).select("isin", F.col("ticker").alias("best"))
    return probed.join(best, "isin", "left").select("isin", "ticker", "sources", "place", F.coalesce(F.col("best") == F.col("ticker"), F.lit(False)).alias("chosen"))


SQL["slugs"] = """
SELECT isin, lower(replace(name, ' ', '-')) || split_part('-xeta|-xsto|-XOSL|-xlon|', '|', CAST(instrument_id % 5 + 1 AS INT)) AS slug, ' ' || ticker || ' a/b ' AS identifier,
       CASE WHEN instrument_id % 3 = 0 THEN NULL ELSE lower(ticker) || ' A-B' END AS symbol FROM {etf}"""
SQL["codes"] = """
SELECT isin, split_part('GY|LN|NA|SW|SE|XX|GF|SE', '|', CAST(source_rank * 2 + pos % 3 AS INT)) AS exch, CASE WHEN pos % 11 = 0 THEN NULL ELSE ticker END AS code, pos FROM {cand}"""
_SUF = {k: v for k, v in CODE_SUFFIX.items()}


def _case(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in table.items()) + " END"


@query("symbol_candidates", "slugs codes", f"""
WITH l AS (SELECT isin, {_case(LISTING_SUFFIX, "CASE WHEN contains(slug, '-') THEN lower(split_part(slug, '-', -1)) END")} AS suf, identifier, symbol FROM slugs),
a AS (SELECT isin, replace(replace(upper(trim(identifier)), ' ', '-'), '/', '-') || suf AS ticker, 0 AS pos FROM l WHERE suf IS NOT NULL
      UNION ALL SELECT isin, replace(replace(upper(trim(symbol)), ' ', '-'), '/', '-') || suf, 1 FROM l WHERE suf IS NOT NULL AND symbol IS NOT NULL),
c AS (SELECT isin, {_case({k: i for i, k in enumerate(CODE_SUFFIX)}, 'exch')} AS prio, pos, replace(replace(upper(trim(code)), ' ', '-'), '/', '-') || {_case(CODE_SUFFIX, 'exch')} AS ticker FROM codes),
f AS (SELECT isin, ticker, min((prio, pos, ticker)) AS at_ FROM c WHERE ticker IS NOT NULL GROUP BY isin, ticker),
k AS (SELECT *, row_number() OVER (PARTITION BY isin, split_part(ticker, '.', -1) ORDER BY at_) AS n FROM f)
SELECT 'listing' AS source, isin, ticker, CAST(min(pos) AS BIGINT) AS place FROM a GROUP BY isin, ticker
UNION ALL SELECT 'codes', isin, ticker, row_number() OVER (PARTITION BY isin ORDER BY at_) FROM k WHERE n <= 2
UNION ALL SELECT 'search', isin, ticker, min(pos) FROM cand WHERE source <> 'codes' GROUP BY isin, ticker""")
def _(t):
    quotes = t.cand.select("isin", F.col("ticker").alias("symbol"), "pos", F.when(F.col("source") == "codes", "INDEX").otherwise("ETF").alias("quote_type"))
    return (pr.listing_candidates(t.slugs).select(F.lit("listing").alias("source"), "isin", "ticker", F.col("pos").alias("place"))
            .union(pr.code_candidates(t.codes).select(F.lit("codes"), "isin", "ticker", "place"))
            .union(pr.search_candidates(quotes).select(F.lit("search"), "isin", "ticker", "pos")))


@query("covers_start", "fund", """
SELECT isin, CASE WHEN s_nation % 6 = 0 THEN false ELSE first_date <= greatest(start_date, DATE '1996-01-01') + 120 END AS covered
FROM (SELECT isin, start_date, instrument_id % 6 AS s_nation, CAST(start_date + INTERVAL 1 DAY * (instrument_id % 40) * 10 AS DATE) AS first_date FROM fund) f""")
def _(t):
    from dataclasses import replace
    from lodestar.params import DEFAULTS
    first = F.date_add("start_date", ((F.col("instrument_id") % 40) * 10).cast("int"))
    start = F.when(F.col("instrument_id") % 6 != 0, F.col("start_date"))
    return t.fund.select("isin", pr.covers_start(first, start, F.lit(True), replace(DEFAULTS, history_floor="1996-01-01")).alias("covered"))


# ------------------------------------------------------------------ filters
@query("etf_filter", "etf", """
WITH e AS (SELECT *, CASE WHEN dividend_policy IS NULL THEN NULL ELSE starts_with(lower(dividend_policy), 'akk') END AS acc, is_rep AS pick, was_rep AS mine FROM etf)
SELECT 'default' AS filter, isin FROM e WHERE (pick OR mine) AND ask_eligible AND NOT leveraged AND coalesce(asset_class, '') <> 'Giret/invers'
UNION ALL SELECT 'narrow', isin FROM e WHERE ask_eligible AND coalesce(sector, '–') IN ('–', 'Teknologi') AND history_years >= 3 AND fee <= 0.8 AND fund_size / 1e6 >= 100
          AND NOT hedged AND acc = false AND contains(lower(name), 'msci')
UNION ALL SELECT 'mine', isin FROM e WHERE mine UNION ALL SELECT 'esg', isin FROM e WHERE esg AND acc""")
def _(t):
    e = t.etf.withColumn("acc", F.lower("dividend_policy").startswith("akk")).withColumn("pick", F.col("is_rep")).withColumn("mine", F.col("was_rep"))
    loose = dict(pick=False, ask=False, no_leverage=False)
    cases = {"default": pr.EtfFilter(), "mine": pr.EtfFilter(mine_only=True), "esg": pr.EtfFilter(esg="yes", acc="acc", **loose),
             "narrow": pr.EtfFilter(q=" MSCI ", facets={"sector": [pr.MISSING, "Teknologi"]}, min_history=3, max_fee=0.8, min_size_m=100,
                                    hedged="no", acc="dist", pick=False, no_leverage=False)}
    return _tagged(e, {k: pr.etf_filter(f) for k, f in cases.items()})


def _tagged(df, conds):
    """One scan: a row appears once per filter it passes."""
    hits = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in conds.items()])))
    return df.select(hits.alias("filter"), "isin")


@query("fund_filter", "fund", """
WITH f AS (SELECT *, (DATE '2001-12-01' - start_date) / 365.25::DOUBLE AS years, selection AND tradable AS mine FROM fund)
SELECT 'default' AS filter, isin FROM f WHERE ask UNION ALL SELECT 'index', isin FROM f WHERE ask AND is_index AND cost <= 1.2 AND sfdr >= 8 AND NOT hedged
UNION ALL SELECT 'active', isin FROM f WHERE NOT is_index AND sfdr = 9 AND acc = false UNION ALL SELECT 'selection', isin FROM f WHERE ask AND selection AND region IN ('Global') AND years >= 6.9
UNION ALL SELECT 'search', isin FROM f WHERE contains(lower(company), 'company 1') UNION ALL SELECT 'mine', isin FROM f WHERE mine""")
def _(t):
    years = F.datediff(F.lit("2001-12-01").cast("date"), "start_date") / 365.25
    f = t.fund.withColumn("years", years).withColumn("mine", F.col("selection") & F.col("tradable")).withColumn("ticker", F.lit(None).cast("string"))
    cases = {"default": pr.FundFilter(), "index": pr.FundFilter(kind="index", max_cost=1.2, sfdr="8", unhedged=True),
             "active": pr.FundFilter(kind="active", sfdr="9", acc="dist", ask=False), "selection": pr.FundFilter(selection=True, facets={"region": ["Global"]}, min_years=6.9),
             "search": pr.FundFilter(q="Company 1", ask=False), "mine": pr.FundFilter(mine_only=True)}
    return _tagged(f, {k: pr.fund_filter(c) for k, c in cases.items()})


DUCK["products"] = """
SELECT isin AS id, 'etf' AS kind, name, ticker, fee AS cost, asset_class, category, coalesce(style, '') <> 'Aktiv' AS is_index, coalesce(ask_eligible, false) AS ask, hedged,
       leveraged OR asset_class = 'Giret/invers' AS leveraged, owners, CASE WHEN count(*) OVER (PARTITION BY cluster_id) > 1 THEN cluster_id END AS cluster, currency, true AS tradable,
       r1, r3, r5, r10, coalesce(vol5, vol3, vol1) AS vol, CASE WHEN asset_class IN ('Renter', 'Pengemarked') THEN 'Rente-ETF' ELSE 'ETF' END AS kind_label FROM {etf}
UNION ALL SELECT isin, 'fond', name, '', cost, asset_class, category, is_index, ask, hedged, false, owners, NULL, currency, tradable, r1, r3, r5, r10, coalesce(vol5, vol3, vol1),
       CASE WHEN asset_class IN ('Renter', 'Pengemarked') THEN 'Rentefond' WHEN is_index THEN 'Indeksfond' WHEN asset_class = 'Blandet' THEN 'Kombinasjonsfond' ELSE 'Aktivt fond' END FROM {fund}"""


@stage
def products(t):
    return pr.product_view(t.etf, t.fund)


@query("product_view", "products", """
SELECT id, kind, name, ticker, R6(cost) AS cost, asset_class, category, is_index, ask, hedged, leveraged, owners, cluster, currency, tradable,
       R6(r1) AS r1, R6(r3) AS r3, R6(r5) AS r5, R6(r10) AS r10, R6(vol) AS vol, kind_label FROM products""")
def _(t):
    return t.products


@query("product_search", "products", """
SELECT id, name, kind_label, owners FROM products WHERE NOT leveraged AND tradable AND contains(lower(name || ' ' || ticker || ' ' || id || ' ' || kind_label), 'world')
  AND contains(lower(name || ' ' || ticker || ' ' || id || ' ' || kind_label), 'core') AND id NOT IN (SELECT isin FROM etf WHERE was_rep)
ORDER BY coalesce(owners, 0) DESC, id LIMIT 12""")
def _(t):
    held = t.etf.where("was_rep").select(F.col("isin").alias("id"))
    return pr.product_search(t.products, " World  CORE ", held).select("id", "name", "kind_label", "owners")


@query("broad_flag", "products alloc", """
SELECT p.id, CASE WHEN asset_class IN ('Renter', 'Pengemarked') THEN coalesce(vol <= 0.03, false) WHEN asset_class = 'Blandet' THEN true
                  ELSE coalesce(is_index AND asset_class = 'Aksjer' AND n >= 3 AND m <= 40, false) END AS broad
FROM products p LEFT JOIN (SELECT isin, count(*) FILTER (kind = 'reg' AND weight >= 4) AS n, coalesce(max(weight) FILTER (kind = 'sec'), 0) AS m FROM alloc GROUP BY isin) a ON a.isin = p.id""")
def _(t):
    return pr.broad_flag(t.products, t.alloc)


@query("benchmark_candidates", "etf", """
SELECT isin, name FROM etf WHERE asset_class = 'Aksjer' AND region = 'Global' AND sector = 'Bred' AND style = 'Markedsvektet' AND NOT hedged AND NOT esg AND NOT leveraged
  AND history_years >= 5 AND live_to_end AND has_prices ORDER BY coalesce(fund_size, 0) DESC, isin LIMIT 40""")
def _(t):
    return pr.benchmark_candidates(t.etf).select("isin", "name")


@query("proxy_candidates", "etf", "SELECT isin FROM etf WHERE has_prices AND NOT leveraged AND asset_class <> 'Giret/invers' AND live_to_end AND n_months >= 36")
def _(t):
    return pr.proxy_candidates(t.etf).select("isin")


# ------------------------------------------------------------------ reports
_FACETS = ["asset_class", "region", "sector", "style", "category"]


@query("facet_counts", "etf", " UNION ALL ".join(f"""
SELECT facet, value, n, row_number() OVER (ORDER BY value = '–', n DESC, value) AS position FROM (SELECT '{f}' AS facet, coalesce({f}, '–') AS value, count(*) AS n FROM etf GROUP BY 2) s""" for f in _FACETS))
def _(t):
    return rp.facet_counts(t.etf, _FACETS)


@query("median_kpi", "fund", """
SELECT is_index, R6(quantile_cont(cost, 0.5)) AS median_cost, R6(quantile_cont(r5, 0.5)) AS median_return, count(*) AS n FROM fund GROUP BY is_index""")
def _(t):
    return rp.median_kpi(t.fund, "r5")


@query("metrics_wide", "perf fund", """
SELECT 'etf' AS kind, asset AS id, R6(max(ret) FILTER (years = 1)) AS r1, R6(max(ret) FILTER (years = 3)) AS r3, R6(max(ret) FILTER (years = 5)) AS r5, R6(max(ret) FILTER (years = 10)) AS r10,
       R6(max(vol) FILTER (years = 5)) AS vol, R6(max(sharpe) FILTER (years = 5)) AS sharpe, NULL::DOUBLE AS age_years, NULL::DOUBLE AS size_m FROM perf GROUP BY asset
UNION ALL SELECT 'fond', isin, R6(r1), R6(r3), R6(r5), R6(r10), R6(vol5), NULL, R6((DATE '2001-12-01' - start_date) / 365.25::DOUBLE), R6(fund_size / 1e6) FROM fund""")
def _(t):
    return rp.metrics_wide(t.perf, 5).unionByName(rp.fund_metrics(t.fund, 10, F.lit("2001-12-01").cast("date")))


@query("sharpe_buckets", "perf", """
SELECT years, CASE WHEN sharpe < 0 THEN 'Svært dårlig' WHEN sharpe < 0.25 THEN 'Dårlig' WHEN sharpe < 0.5 THEN 'Middels' WHEN sharpe < 1 THEN 'Bra' ELSE 'Svært bra' END AS step,
       CASE WHEN vol < 0.015 THEN 'Svært lavt' WHEN vol < 0.05 THEN 'Lavt' WHEN vol < 0.09 THEN 'Middels' WHEN vol < 0.135 THEN 'Høyt' ELSE 'Svært høyt' END AS risk_level,
       count(*) AS n, R6(count(*) FILTER (sharpe >= 0.5) / count(*)) AS good_share
FROM (SELECT CAST(years AS BIGINT) AS years, sharpe, vol FROM perf WHERE sharpe IS NOT NULL) p GROUP BY 1, 2, 3""")
def _(t):
    return rp.sharpe_buckets(t.perf)


@query("export_summary", "runs fund mret rfm panel", """
SELECT (SELECT count(*) FROM fund) AS n_funds, (SELECT count(*) FROM fund WHERE vol5 IS NOT NULL) AS n_risk, (SELECT count(*) FROM (SELECT asset FROM mret GROUP BY asset HAVING count(*) >= 2)) AS n_returns,
       (SELECT max(date) FROM panel) AS data_until, (SELECT min(mi) FROM mret) AS first_month, (SELECT max(mi) FROM mret) AS last_month,
       (SELECT R8(pow(1 + arg_max(rf, mi), 12) - 1) FROM rfm) AS rf_now, (SELECT max(run_at) FROM runs) AS last_run, (SELECT arg_max(n_found, run_id) FROM runs) AS n_found""", digits=8)
def _(t):
    return rp.export_summary(t.fund, t.mret, t.panel, t.rfm, t.runs)


@query("mode_date", "fund", "SELECT coalesce((SELECT nav_date FROM fund GROUP BY nav_date ORDER BY count(*) DESC, nav_date LIMIT 1), DATE '2024-01-30') AS as_of")
def _(t):
    return rp.mode_date(t.fund, "nav_date", F.lit("2024-01-30").cast("date"))


@query("coverage_report", "panel univ mapping trimmed clean", """
WITH first AS (SELECT asset, min(date) AS f FROM panel GROUP BY asset),
v AS (SELECT * FROM mapping WHERE chosen AND ok),
k AS (SELECT r.asset, r.n - coalesce(k.n_clean, 0) AS removed, coalesce(k.jumps, 0) AS jumps, coalesce(k.n_clean - k.n_kept, 0) AS trimmed FROM (SELECT asset, count(*) AS n FROM dirty GROUP BY asset) r
      LEFT JOIN (SELECT asset, max(n_jumps) AS jumps, max(n_clean) AS n_clean, count(*) AS n_kept FROM trimmed GROUP BY asset) k USING (asset)),
c AS (SELECT 'active' AS metric, count(DISTINCT isin) AS n FROM univ UNION ALL SELECT 'ask_eligible', count(DISTINCT isin) FROM univ WHERE ask
UNION ALL SELECT 'mapped', count(DISTINCT isin) FROM v UNION ALL SELECT 'with_prices', count(*) FROM first
UNION ALL SELECT 'min_' || y || 'y', count(*) FILTER (f <= CAST(DATE '2001-12-01' - to_years(CAST(y AS INT)) AS DATE)) FROM first CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS y) GROUP BY y
UNION ALL SELECT 'suffix ' || CASE WHEN contains(ticker, '.') THEN '.' || split_part(ticker, '.', -1) ELSE '(US)' END, count(*) FROM v GROUP BY 1
UNION ALL SELECT 'source ' || source, count(*) FROM v GROUP BY 1
UNION ALL SELECT unnest(['isins_with_removed_points', 'removed_points', 'isins_trimmed', 'trimmed_points']),
                 unnest([count(*) FILTER (removed > 0), sum(removed), count(*) FILTER (jumps > 0), sum(trimmed)]) FROM k)
SELECT metric, CAST(n AS DOUBLE) AS n, CAST(NULL AS DATE) AS day FROM c
UNION ALL SELECT 'coverage_pct', round(100.0::DOUBLE * (SELECT count(*) FROM first) / greatest((SELECT count(DISTINCT isin) FROM univ), 1), 1), NULL
UNION ALL SELECT 'last_price_date', NULL, (SELECT max(date) FROM panel)""")
def _(t):
    return rp.coverage_report(t.univ, t.mapping, t.panel, ts.cleaning_counts(t.dirty), F.lit("2001-12-01").cast("date"))


# ------------------------------------------------------------------ probe
SQL["probe"] = """
SELECT isin, name, CASE WHEN instrument_id % 9 = 0 THEN NULL ELSE 'T' || CAST(instrument_id AS STRING) END AS ticker, fund_type, company AS domicile,
       split_part('ok|ok|avvik|ulik valuta|ukjent', '|', CAST(instrument_id % 5 + 1 AS INT)) AS status, CAST(instrument_id % 12 AS DOUBLE) AS years,
       instrument_id % 4 <> 0 AS covers_start, split_part('listing,search|search|codes,search|', '|', CAST(instrument_id % 4 + 1 AS INT)) AS source,
       CASE WHEN instrument_id % 13 = 0 THEN NULL ELSE 'Exchange ' || CAST(instrument_id % 15 AS STRING) END AS exchange FROM {fund}"""
_STATS = """count(*) AS n, count(ticker) AS with_ticker, count(*) FILTER (ticker IS NOT NULL AND years >= 3) AS min_3y, count(*) FILTER (ticker IS NOT NULL AND covers_start) AS covers,
 count(*) FILTER (ticker IS NOT NULL AND status = 'ok') AS ok, count(*) FILTER (ticker IS NOT NULL AND status = 'avvik') AS mismatch,
 count(*) FILTER (ticker IS NOT NULL AND status = 'ok' AND years >= 3) AS usable"""


@query("probe_summary", "probe", f"""
WITH g AS (SELECT domicile, row_number() OVER (ORDER BY count(*) DESC, domicile) AS rn FROM probe GROUP BY domicile),
p AS (SELECT probe.*, CASE WHEN rn <= 8 THEN domicile ELSE 'Andre' END AS dom FROM probe JOIN g USING (domicile)),
s AS (SELECT 'total' AS kind, 'total' AS grp, {_STATS} FROM p UNION ALL SELECT 'fund_type', fund_type, {_STATS} FROM p GROUP BY fund_type UNION ALL SELECT 'domicile', dom, {_STATS} FROM p GROUP BY dom)
SELECT *, R3(usable / n) AS usable_share FROM s
UNION ALL SELECT 'source', src, count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT unnest(string_split(source, ',')) AS src FROM probe WHERE ticker IS NOT NULL) x WHERE src <> '' GROUP BY src
UNION ALL SELECT 'exchange', CASE WHEN place <= 10 THEN e ELSE 'Andre' END, CAST(sum(n) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (
  SELECT coalesce(exchange, '?') AS e, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, coalesce(exchange, '?')) AS place FROM probe WHERE ticker IS NOT NULL GROUP BY 1) y GROUP BY 2""")
def _(t):
    return rp.probe_summary(t.probe)


@query("sample_quotas", "probe", """
WITH g AS (SELECT coalesce(fund_type, 'Ukjent') AS grp, count(*) AS n, (SELECT count(*) FROM probe) AS total FROM probe GROUP BY 1),
q AS (SELECT *, 40 * n / total AS quota, greatest(floor(40 * n / total), 1) AS base FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY base < n ORDER BY quota - floor(quota) DESC, grp) AS rk, 40 - sum(base) OVER () AS rest FROM q)
SELECT grp AS fund_type, CAST(CASE WHEN base < n AND rk <= rest THEN base + 1 ELSE base END AS BIGINT) AS sampled FROM r""")
def _(t):
    from lodestar.operators.sampling import stratified_sample
    return stratified_sample(t.probe, 40, key="fund_type").groupBy("fund_type").agg(F.count(F.lit(1)).alias("sampled"))


@query("stratified_sample", "probe", """
WITH g AS (SELECT coalesce(fund_type, 'Ukjent') AS grp, count(*) AS n, (SELECT count(*) FROM probe) AS total FROM probe GROUP BY 1),
q AS (SELECT *, 40 * n / total AS quota, greatest(floor(40 * n / total), 1) AS base FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY base < n ORDER BY quota - floor(quota) DESC, grp) AS rk, 40 - sum(base) OVER () AS rest FROM q),
m AS (SELECT *, coalesce(fund_type, 'Ukjent') AS grp, row_number() OVER (PARTITION BY coalesce(fund_type, 'Ukjent') ORDER BY md5('1|' || isin), isin) AS place FROM probe)
SELECT m.fund_type, m.isin FROM m JOIN r USING (grp) WHERE place <= CASE WHEN base < n AND rk <= rest THEN base + 1 ELSE base END""")
def _(t):
    from lodestar.operators.sampling import stratified_sample
    return stratified_sample(t.probe, 40, key="fund_type").select("fund_type", "isin")
