"""Domain tables over the driver tables, in SQL that both Spark and DuckDB accept.

``SQL`` holds the input side (prices, rates, runs, listings, funds, holdings ...). ``DUCK`` holds the
SQL form of operator outputs that several oracles build on; Spark computes those with the operators.
"""

from __future__ import annotations

import re


def deps(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"{(\w+)}", sql)))


def duck(name: str) -> str:
    return DUCK[name] if name in DUCK else SQL[name]


_BRAND_NO = "CAST(substr(p_brand, 7) AS INT)"

SQL: dict[str, str] = {}
# tables a user would have stored: several joins of raw tables, then read more than once by a query
STORED = {"alloc", "panel", "snap", "dirty"}
DUCK: dict[str, str] = {}

# ------------------------------------------------------------------ prices, dividends, rates
SQL["panel"] = """
SELECT asset, date, 100 * exp(sum(step) OVER (PARTITION BY asset ORDER BY date)) AS close
FROM (SELECT p_brand AS asset, CAST(l_shipdate AS DATE) AS date, (avg(l_discount) - 0.05) / 2 AS step
      FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand, CAST(l_shipdate AS DATE)) s"""

# bad ticks: zeros, 100x unit flips, short false levels, and one lasting level change per odd brand
SQL["dirty"] = f"""
SELECT asset, date, CASE WHEN n % 211 = 7 THEN 0.0 WHEN n % 97 = 50 THEN close * 100
                         WHEN n % 131 IN (20, 21) THEN close * 1.6 ELSE close END
                    * CASE WHEN n <= 200 AND CAST(substr(asset, 7) AS INT) % 2 = 1 THEN 2.0 ELSE 1.0 END AS close
FROM (SELECT asset, date, close, row_number() OVER (PARTITION BY asset ORDER BY date) AS n FROM {{panel}}) s"""

SQL["divs"] = """
SELECT p_brand AS asset, CAST(CAST(l_shipdate AS DATE) + INTERVAL '1' DAY AS DATE) AS date, l_tax AS amount
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_tax > 0"""

SQL["splits"] = """
SELECT DISTINCT p_brand AS asset, CAST(l_shipdate AS DATE) AS date, l_tax * 100 AS ratio
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_quantity = 50"""

SQL["fx"] = """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'EUR' WHEN '2-HIGH' THEN 'USD' WHEN '3-MEDIUM' THEN 'SEK'
            WHEN '4-NOT SPECIFIED' THEN 'GBP' ELSE 'ZAR' END AS currency,
       CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 97531 AS rate
FROM {orders} GROUP BY 1, 2"""

SQL["asset_ccy"] = f"""
SELECT asset, split_part('NOK|EUR|USD|SEK|GBp|ZAc|GBP|JPY', '|', no % 8 + 1) AS currency
FROM (SELECT DISTINCT p_brand AS asset, {_BRAND_NO} AS no FROM {{part}}) s"""

SQL["policy"] = """
SELECT CAST(l_shipdate AS DATE) AS date, avg(l_tax) * 100 AS rate
FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY CAST(l_shipdate AS DATE)"""

# sparse table of rate decisions that also starts before the daily series
SQL["fallback"] = """
SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 97531 AS rate
FROM {orders} WHERE day(o_orderdate) = 15 GROUP BY CAST(o_orderdate AS DATE)"""

# ------------------------------------------------------------------ runs and snapshots
SQL["snap"] = """
SELECT CAST(year(d) * 10000 + month(d) * 100 + day(d) AS BIGINT) AS run_id, d AS run_date,
       user_id AS instrument_id,
       CASE WHEN user_id % 29 = 3 THEN NULL ELSE
       split_part('IE|LU|NO|US', '|', CAST(user_id % 4 + 1 AS INT)) || lpad(CAST(user_id % 97 AS STRING), 10, '0') END AS isin,
       'Fund ' || CAST(user_id AS STRING) AS name, category, fee, k, owners,
       CASE WHEN k % 7 = 0 THEN NULL WHEN k % 2 = 0 THEN 'True' ELSE '1' END AS is_tradable
FROM (SELECT CAST(ts AS DATE) AS d, user_id, max_by(event_type, event_id) AS category,
             max_by(value, event_id) AS fee, count(*) AS owners,
             CAST(regexp_extract(max_by(props, event_id), '([0-9]+)', 1) AS BIGINT) AS k
      FROM {events} GROUP BY CAST(ts AS DATE), user_id) e"""

SQL["runs"] = """
SELECT run_id, run_date AS run_at, count(*) + max(k) % 3 AS total_hits, count(*) AS n_found,
       day(run_date) % 10 = 0 AS partial
FROM {snap} GROUP BY run_id, run_date"""

SQL["run_now"] = "SELECT * FROM {snap} WHERE run_id = (SELECT max(run_id) FROM {snap})"

# state before the last run: latest row per instrument, active when seen in the run just before
SQL["before"] = "SELECT * FROM {snap} WHERE run_id < (SELECT max(run_id) FROM {snap})"

SQL["master"] = """
SELECT instrument_id, max_by(isin, CASE WHEN isin IS NOT NULL THEN run_id END) AS isin,
       max_by(name, CASE WHEN name IS NOT NULL THEN run_id END) AS name,
       max_by(category, CASE WHEN category IS NOT NULL THEN run_id END) AS category,
       max_by(fee, CASE WHEN fee IS NOT NULL THEN run_id END) AS fee,
       max_by(owners, CASE WHEN owners IS NOT NULL THEN run_id END) AS owners,
       max_by(is_tradable, CASE WHEN is_tradable IS NOT NULL THEN run_id END) AS is_tradable,
       min(run_date) AS first_seen, max(run_date) AS last_seen,
       CASE WHEN max(run_date) < (SELECT max(run_date) FROM {before}) THEN max(run_date) END AS delisted_at,
       max(run_date) = (SELECT max(run_date) FROM {before}) AS active
FROM {before} GROUP BY instrument_id"""

# ------------------------------------------------------------------ listings and candidates
SQL["listing"] = f"""
SELECT l_suppkey * 100 + no AS instrument_id, 'IE' || lpad(CAST(no AS STRING), 10, '0') AS isin, p_brand AS name,
       split_part('USD|SEK|NOK|EUR|DKK|CHF', '|', CAST(s_nationkey % 6 + 1 AS INT)) AS currency,
       CASE WHEN s_nationkey % 9 = 4 THEN 'false' ELSE 'True' END AS is_tradable,
       CASE WHEN sum(l_tax) > 1.2 THEN NULL ELSE floor(avg(l_tax) * 1000) / 10 END AS spread_pct,
       CASE WHEN count(*) % 5 = 0 THEN NULL ELSE count(*) END AS owners
FROM (SELECT l_suppkey, l_tax, p_brand, {_BRAND_NO} AS no FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey) l
JOIN {{supplier}} ON l_suppkey = s_suppkey
GROUP BY l_suppkey, no, p_brand, s_nationkey"""

SQL["cand"] = """
SELECT 'IE' || lpad(CAST(user_id AS STRING), 10, '0') AS isin,
       'T' || CAST(user_id % 50 AS STRING) || split_part('.DE|.L|.AS|.PA|.MI', '|', CAST(1 + floor(value) % 5 AS INT)) AS ticker,
       CASE event_type WHEN 'click' THEN 'listing' WHEN 'view' THEN 'search' ELSE 'codes' END AS source,
       CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS source_rank,
       event_id AS pos, CAST(ts AS DATE) AS date FROM {events}"""

# ------------------------------------------------------------------ instruments
SQL["etf"] = f"""
SELECT p_partkey AS instrument_id, split_part('IE|LU|US|NO', '|', p_size % 4 + 1) || lpad(CAST(p_partkey AS STRING), 10, '0') AS isin,
       'T' || CAST(p_partkey AS STRING) AS ticker,
       split_part('iShares Core |Xtrackers |Amundi |Vanguard |SPDR ', '|', CAST(floor(p_partkey / 26) % 5 + 1 AS INT))
       || split_part('MSCI World|S&P 500|MSCI Emerging Markets|STOXX Europe 600|MSCI Japan|FTSE 100|NASDAQ 100|MSCI China|MSCI World ex China|Energy Transition|Global Water|Euro Govt Bond|USD High Yield Corp|Semiconductor|MSCI Europe ex-UK|MSCI India|Physical Gold|S&P 500 2x Leveraged|MSCI World Tail Hedge|Enhanced AI and Robotics|AI and Big Data|World Momentum|US Dividend Aristocrats|Nordic Banks|Private Equity|Industrials Average',
                     '|', CAST(p_partkey % 26 + 1 AS INT))
       || split_part(' UCITS ETF USD (Acc)| UCITS ETF EUR Hedged| UCITS ETF (Dist)| ESG Screened UCITS ETF| UCITS ETF', '|', p_size % 5 + 1) AS name,
       split_part('Global Equity Large Cap|US Equity Large Cap Blend|Technology Sector Equity|Global Emerging Markets Equity|Europe Equity Large Cap|Global Fixed Income|Euro Money Market|Trading Tools|Commodities - Broad|Global Equity Mid/Small Cap|US Equity Large Cap Growth|Allocation EUR|Options Trading|Miscellaneous|Emerging Markets Fixed Income',
                  '|', p_size % 15 + 1) AS category,
       CASE p_type WHEN 'STANDARD' THEN 'Aksje' WHEN 'ECONOMY' THEN 'Rente' WHEN 'PROMO' THEN 'Kombi' WHEN 'LARGE' THEN 'Øvrig' END AS fund_type,
       split_part('Aksjer|Renter|Aksjer|Blandet|Aksjer|Giret/invers', '|', length(p_type) % 6 + 1) AS asset_class,
       split_part('Global|USA|Europa|Global|Norden', '|', {_BRAND_NO} % 5 + 1) AS region,
       CASE WHEN p_size % 10 = 0 THEN NULL ELSE split_part('Bred|Teknologi|Helse|Bred', '|', p_size % 4 + 1) END AS sector,
       split_part('Markedsvektet|Verdi|Markedsvektet|Aktiv', '|', CAST(p_partkey % 4 + 1 AS INT)) AS style,
       CASE WHEN p_size = 13 THEN NULL ELSE floor(p_retailprice / 10) / 200 END AS fee,
       CASE WHEN p_size = 17 THEN NULL ELSE floor(p_retailprice) * p_size * 100000 END AS fund_size,
       CASE WHEN p_size = 23 THEN NULL ELSE CAST((p_partkey * 37) % 1000 AS BIGINT) END AS owners,
       split_part('NOK|EUR|USD|SEK|GBP', '|', CAST(p_partkey % 5 + 1 AS INT)) AS currency,
       CASE p_size % 3 WHEN 0 THEN 'Akkumulerende' WHEN 1 THEN 'Utdelende' END AS dividend_policy,
       CASE WHEN p_size % 11 = 0 THEN 'false' WHEN p_size % 2 = 0 THEN 'True' ELSE '1' END AS is_tradable,
       p_size % 4 <> 2 AS ask_eligible, p_size % 5 = 1 AS hedged, p_partkey % 26 = 17 AS leveraged,
       p_size % 5 = 3 AS esg, p_size <> 19 AS has_prices,
       floor(p_retailprice) % 150 / 10 AS history_years,
       CAST({_BRAND_NO} * 100 + p_size AS BIGINT) AS cluster_id, p_partkey % 5 = 0 AS was_rep,
       p_partkey % 7 = 0 AS is_rep, p_partkey % 13 <> 0 AS live_to_end, CAST(floor(p_retailprice) % 90 AS BIGINT) AS n_months,
       (p_size - 20) / 100.0 AS r1, CASE WHEN p_size % 4 = 0 THEN NULL ELSE floor(p_retailprice) / 10000 END AS r3,
       CASE WHEN p_size % 3 = 0 THEN NULL ELSE floor(p_retailprice) / 12500 END AS r5,
       CASE WHEN p_size % 2 = 0 THEN NULL ELSE floor(p_retailprice) / 20000 END AS r10,
       0.01 + p_size / 250.0 AS vol1, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 0.012 + p_size / 240.0 END AS vol3,
       CASE WHEN p_size % 3 = 0 THEN NULL ELSE 0.011 + p_size / 230.0 END AS vol5
FROM {{part}}"""

SQL["fund"] = """
SELECT s_suppkey AS instrument_id, 'LU9' || lpad(CAST(s_suppkey AS STRING), 9, '0') AS isin, s_name AS name,
       'Company ' || CAST(s_nationkey AS STRING) AS company,
       split_part('Global Equity Large Cap|Global Emerging Markets Equity|Global Equity Mid/Small Cap|Euro Money Market|Global Fixed Income', '|', s_nationkey % 5 + 1) AS category,
       split_part('Aksjer|Aksjer|Aksjer|Pengemarked|Renter', '|', s_nationkey % 5 + 1) AS asset_class,
       split_part('Global|Fremvoksende|Global|Europa|Global', '|', s_nationkey % 5 + 1) AS region,
       split_part('Aksje|Indeks|Rente|Indeks|Kombi', '|', CAST(s_suppkey % 5 + 1 AS INT)) AS fund_type,
       s_suppkey % 5 IN (1, 3) AS is_index, s_suppkey % 9 = 0 AS hedged,
       CASE s_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS acc,
       s_nationkey % 7 <> 0 AS ask, s_suppkey % 10 = 4 AS esg,
       split_part('NOK|NOK|SEK|EUR', '|', CAST(s_suppkey % 4 + 1 AS INT)) AS currency,
       CASE WHEN s_suppkey % 31 = 5 THEN NULL ELSE floor((s_acctbal + 1000) / 55) / 100 END AS cost,
       n AS owners, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(6 + s_suppkey % 4 AS BIGINT) END AS sfdr,
       CAST(first_trade AS DATE) AS start_date, floor(turnover) AS fund_size, s_suppkey % 14 <> 0 AS tradable,
       s_suppkey % 3 = 0 AS selection,
       CASE WHEN s_nationkey < 13 THEN 'fond' ELSE 'etf' END AS kind,
       CAST(36 + (s_suppkey * 13) % 80 AS BIGINT) AS n_months,
       floor(s_acctbal) / 100000 AS r1, floor(s_acctbal + 500) / 110000 AS r3,
       CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE floor(s_acctbal + 700) / 120000 END AS r5,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE floor(s_acctbal + 900) / 130000 END AS r10,
       0.004 + (s_suppkey % 60) / 500.0 AS vol1, 0.005 + (s_suppkey % 50) / 500.0 AS vol3,
       CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE 0.003 + (s_suppkey % 40) / 500.0 END AS vol5,
       CAST(last_trade AS DATE) AS nav_date
FROM {supplier} JOIN (SELECT l_suppkey, count(*) AS n, min(l_shipdate) AS first_trade, max(l_shipdate) AS last_trade,
                             sum(l_extendedprice) AS turnover
                      FROM {lineitem} GROUP BY l_suppkey) t ON s_suppkey = l_suppkey"""

# holdings: percent shares per fund, long form (kind reg / sec / ast / top)
SQL["alloc"] = f"""
SELECT isin, kind, label, 100 * v / sum(v) OVER (PARTITION BY isin, kind) AS weight
FROM (SELECT 'LU9' || lpad(CAST(l_suppkey AS STRING), 9, '0') AS isin, kind, label,
             CASE WHEN kind IN ('reg', 'sec') THEN pow(sum(v), 3) ELSE sum(v) END AS v
      FROM (SELECT l_suppkey, 'sec' AS kind, p_type AS label, l_extendedprice AS v FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
            UNION ALL SELECT l_suppkey, 'top', CAST({_BRAND_NO} AS STRING), l_extendedprice FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
            UNION ALL SELECT l_suppkey, 'ast', CASE l_returnflag WHEN 'A' THEN 'Renter' WHEN 'N' THEN 'Aksjer' ELSE 'Kontanter' END, l_extendedprice FROM {{lineitem}}
            UNION ALL SELECT l_suppkey, 'reg', r_name, l_extendedprice FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
                      JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey) l
      GROUP BY l_suppkey, kind, label) s"""

# an order is a basket of funds
SQL["pf_fund"] = """
SELECT portfolio_id, isin, v / sum(v) OVER (PARTITION BY portfolio_id) AS w
FROM (SELECT l_orderkey AS portfolio_id, 'LU9' || lpad(CAST(l_suppkey AS STRING), 9, '0') AS isin, sum(l_extendedprice) AS v
      FROM {lineitem} GROUP BY l_orderkey, l_suppkey) s"""

SQL["pf_asset"] = """
SELECT portfolio_id, asset, v / sum(v) OVER (PARTITION BY portfolio_id) AS w
FROM (SELECT l_suppkey AS portfolio_id, p_brand AS asset, sum(l_extendedprice) AS v
      FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand) s"""
