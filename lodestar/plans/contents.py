"""Queries over fund holdings: similarity, twins, look-through, cost, proxies, suggestions."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from lodestar.functions.scalars import gross_return, savings_value
from lodestar.operators import holdings as ho, reports as rp
from lodestar.plans.adapters import DUCK, SQL
from lodestar.plans.registry import query, shared, stage
from lodestar.session import stored

SQL["pf_cust"] = """
SELECT portfolio_id, isin, v / sum(v) OVER (PARTITION BY portfolio_id) AS w
FROM (SELECT o_custkey AS portfolio_id, 'LU9' || lpad(CAST(l_suppkey AS STRING), 9, '0') AS isin, sum(l_extendedprice) AS v
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey) s"""


@shared
def pf_cust(t):
    """The table of ``SQL["pf_cust"]``, cut into blocks of portfolios by the one shuffle that sums and look-through need."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("portfolio_id"), "l_suppkey", F.col("l_extendedprice").alias("v"))
    v = ho.in_blocks(rows, "portfolio_id", ho.block_count(t.lineitem.count())).groupBy(ho.BLOCKED, "portfolio_id", "l_suppkey").agg(F.sum("v").alias("v"))
    isin = F.concat(F.lit("LU9"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    return v.select(ho.BLOCKED, "portfolio_id", isin.alias("isin"), (F.col("v") / F.sum("v").over(W.partitionBy(ho.BLOCKED, "portfolio_id"))).alias("w"))


@shared
def pf_fund(t):
    """The table of ``SQL["pf_fund"]``, shuffled once, by portfolio."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("portfolio_id"), "l_suppkey", "l_extendedprice").repartition("portfolio_id")
    v = rows.groupBy("portfolio_id", "l_suppkey").agg(F.sum("l_extendedprice").alias("v"))
    isin = F.concat(F.lit("LU9"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    return v.select("portfolio_id", isin.alias("isin"), (F.col("v") / F.sum("v").over(W.partitionBy("portfolio_id"))).alias("w"))


DUCK["shares"] = "SELECT isin, kind, label, weight / sum(weight) OVER (PARTITION BY isin, kind) AS share FROM {alloc} WHERE kind <> 'top' AND weight > 0"
DUCK["sim"] = """
SELECT *, CASE WHEN reg IS NULL AND sec IS NULL AND top IS NULL THEN 0.5 * ast ELSE
   (CASE WHEN reg IS NULL AND sec IS NULL THEN top ELSE CASE WHEN top IS NULL THEN 1 ELSE 0.5 END * (coalesce(reg, 0) + coalesce(sec, 0)) / (CAST(reg IS NOT NULL AS INT) + CAST(sec IS NOT NULL AS INT))
      + CASE WHEN top IS NULL THEN 0 ELSE 0.5 * top END END) * coalesce(ast, 1) END AS score
FROM (SELECT x.a, x.b, max(v) FILTER (kind = 'reg') AS reg, max(v) FILTER (kind = 'sec') AS sec, max(v) FILTER (kind = 'ast') AS ast,
             max(CASE WHEN p.n >= 5 AND q.n >= 5 THEN least(1, v / least(p.s, q.s)) END) FILTER (kind = 'top') AS top
      FROM (SELECT a.isin AS a, b.isin AS b, a.kind, sum(least(a.share, b.share)) AS v FROM {shares} a JOIN {shares} b ON a.kind = b.kind AND a.label = b.label AND a.isin <> b.isin GROUP BY 1, 2, 3
            UNION ALL SELECT a.isin, b.isin, 'top', sum(least(a.weight, b.weight)) FROM {alloc} a JOIN {alloc} b ON a.kind = 'top' AND b.kind = 'top' AND a.label = b.label AND a.isin <> b.isin GROUP BY 1, 2) x
      JOIN (SELECT isin, sum(weight) AS s, count(*) AS n FROM {alloc} WHERE kind = 'top' GROUP BY isin) p ON p.isin = x.a
      JOIN (SELECT isin, sum(weight) AS s, count(*) AS n FROM {alloc} WHERE kind = 'top' GROUP BY isin) q ON q.isin = x.b GROUP BY x.a, x.b) z"""
_FITS = "NOT b.leveraged AND b.tradable AND (NOT a.ask OR b.ask) AND b.cost IS NOT NULL AND a.id <> b.id AND a.asset_class = b.asset_class AND a.hedged = b.hedged"
DUCK["same_index"] = f"SELECT a.id AS a, b.id AS b FROM {{products}} a JOIN {{products}} b ON a.cluster = b.cluster AND {_FITS}"
DUCK["content"] = f"""
SELECT s.* FROM {{sim}} s JOIN {{products}} a ON a.id = s.a JOIN {{products}} b ON b.id = s.b AND {_FITS}
WHERE reg >= 0.9 AND sec >= 0.85 AND top >= 0.6 AND (ast IS NULL OR ast >= 0.9)"""
DUCK["rate_pairs"] = f"""
SELECT a.id AS a, b.id AS b FROM {{products}} a JOIN {{products}} b ON a.category = b.category AND a.currency = b.currency AND {_FITS}
WHERE a.asset_class IN ('Renter', 'Pengemarked') AND a.cost IS NOT NULL AND abs(CASE WHEN a.r5 IS NOT NULL AND b.r5 IS NOT NULL THEN a.r5 + a.cost / 100 - (b.r5 + b.cost / 100) ELSE a.r3 + a.cost / 100 - (b.r3 + b.cost / 100) END) <= 0.006
  AND (greatest(a.vol, b.vol) < 0.01 OR greatest(a.vol, b.vol) / greatest(least(a.vol, b.vol), 1e-6) <= 1.3)"""
DUCK["twin_rows"] = """
SELECT a AS id, b AS twin, cost, own_cost, score, rule, row_number() OVER (PARTITION BY a ORDER BY cost, score DESC, owners DESC, b) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY a, coalesce('c' || cluster, b) ORDER BY cost, score DESC, owners DESC, b) AS rn FROM (
    SELECT u.a, u.b, arg_min(u.score, u.rule) AS score, min(u.rule) AS rule, max(y.cost) AS cost, max(coalesce(y.owners, 0)) AS owners, max(y.cluster) AS cluster, max(x.cost) AS own_cost
    FROM (SELECT a, b, 1.0::DOUBLE AS score, 0 AS rule FROM {same_index} UNION ALL SELECT a, b, score, 1 FROM {content} UNION ALL SELECT a, b, 0.8, 2 FROM {rate_pairs}) u
    JOIN {products} x ON x.id = u.a JOIN {products} y ON y.id = u.b GROUP BY u.a, u.b) s) t WHERE rn = 1 AND own_cost IS NOT NULL AND cost < own_cost - 0.05"""


@shared
def twin_rows(t):
    return ho.twins(t.products, t.alloc, t.products)


# ------------------------------------------------------------------ similarity and twins
# funds that report no regions, no sectors, few or no holdings, or asset classes only
SQL["alloc_gaps"] = """
SELECT a.* FROM {alloc} a JOIN (SELECT isin, CAST(substr(isin, 4) AS BIGINT) AS no FROM {alloc} GROUP BY isin) i ON a.isin = i.isin
WHERE NOT (kind = 'reg' AND (no % 5 = 2 OR no % 9 = 4)) AND NOT (kind = 'sec' AND (no % 7 = 3 OR no % 9 = 4)) AND NOT (kind = 'top' AND no % 3 = 1)
  AND NOT (kind = 'top' AND no % 8 = 5 AND label > '13') AND NOT (kind = 'ast' AND no % 6 = 1)"""
DUCK["sim_any"] = f"""
WITH s AS (SELECT isin, kind, label, CASE WHEN kind = 'top' THEN weight ELSE weight / sum(weight) OVER (PARTITION BY isin, kind) END AS v FROM {{alloc_gaps}} WHERE weight > 0),
h AS (SELECT isin, bool_or(kind = 'reg') AS reg, bool_or(kind = 'sec') AS sec, bool_or(kind = 'ast') AS ast, count(*) FILTER (kind = 'top') >= 5 AS top, sum(v) FILTER (kind = 'top') AS t FROM s GROUP BY isin),
c AS (SELECT x.isin AS a, y.isin AS b, x.kind, sum(least(x.v, y.v)) AS v FROM s x JOIN s y ON x.kind = y.kind AND x.label = y.label AND x.isin <> y.isin GROUP BY 1, 2, 3),
w AS (SELECT a, b, max(v) FILTER (kind = 'reg') AS reg, max(v) FILTER (kind = 'sec') AS sec, max(v) FILTER (kind = 'ast') AS ast, max(v) FILTER (kind = 'top') AS top FROM c GROUP BY a, b),
o AS (SELECT a.id AS a, b.id AS b, CASE WHEN x.reg AND y.reg THEN coalesce(w.reg, 0) END AS reg, CASE WHEN x.sec AND y.sec THEN coalesce(w.sec, 0) END AS sec,
             CASE WHEN x.ast AND y.ast THEN coalesce(w.ast, 0) END AS ast, CASE WHEN x.top AND y.top THEN least(1, coalesce(w.top, 0) / least(x.t, y.t)) END AS top
      FROM {{products}} a JOIN {{products}} b ON {_FITS} JOIN h x ON x.isin = a.id JOIN h y ON y.isin = b.id LEFT JOIN w ON w.a = a.id AND w.b = b.id)
SELECT *, CASE WHEN reg IS NULL AND sec IS NULL AND top IS NULL THEN 0.5 * ast ELSE
   (CASE WHEN reg IS NULL AND sec IS NULL THEN top ELSE CASE WHEN top IS NULL THEN 1 ELSE 0.5 END * (coalesce(reg, 0) + coalesce(sec, 0)) / (CAST(reg IS NOT NULL AS INT) + CAST(sec IS NOT NULL AS INT))
      + CASE WHEN top IS NULL THEN 0 ELSE 0.5 * top END END) * coalesce(ast, 1) END AS score FROM o"""


@query("content_similarity", "sim_any", "SELECT a, b, R6(reg) AS reg, R6(sec) AS sec, R6(ast) AS ast, R6(top) AS top, R6(score) AS score FROM sim_any WHERE score >= 0.45")
def _(t):
    return ho.similar_fitting(t.alloc_gaps, t.products, 0.45).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "reg", "sec", "ast", "top", "score")


@query("content_twins", "content", "SELECT a, b, R6(reg) AS reg, R6(sec) AS sec, R6(ast) AS ast, R6(top) AS top, R6(score) AS score FROM content")
def _(t):
    return ho.content_twins(t.products, t.alloc).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "reg", "sec", "ast", "top", "score")


@query("twin_theta_join", "products", f"SELECT a.id AS a, b.id AS b FROM products a JOIN products b ON {_FITS} AND b.cost < a.cost - 0.05")
def _(t):
    return ho.cheaper_candidates(t.products).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


@query("same_index_pairs", "same_index", "SELECT a, b FROM same_index")
def _(t):
    return ho.same_index(t.products).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


@query("rate_twins", "rate_pairs", "SELECT a, b FROM rate_pairs")
def _(t):
    return ho.rate_twins(t.products).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


@query("twins", "twin_rows", "SELECT id, twin, R6(cost) AS cost, R6(own_cost) AS own_cost, R6(score) AS score, rule FROM twin_rows")
def _(t):
    return t.twin_rows


_PLAN = "(100000 * pow(1 + m, 240) + 1000 * (1 + m) * (pow(1 + m, 240) - 1) / m)"


@query("twin_savings", "twin_rows pf_fund fund", f"""
WITH c AS (SELECT portfolio_id, sum(w * coalesce(cost, 0)) / 100 AS cost FROM pf_fund JOIN fund USING (isin) GROUP BY portfolio_id),
x AS (SELECT p.portfolio_id, p.isin AS id, t.twin, c.cost, c.cost - p.w * (t.own_cost - t.cost) / 100 AS less FROM pf_fund p JOIN c USING (portfolio_id) JOIN twin_rows t ON t.id = p.isin),
v AS (SELECT *, (SELECT {_PLAN} FROM (SELECT pow(1 + 0.06 - cost, 1 / 12.0::DOUBLE) - 1 AS m)) AS base, (SELECT {_PLAN} FROM (SELECT pow(1 + 0.06 - less, 1 / 12.0::DOUBLE) - 1 AS m)) AS swapped FROM x)
SELECT portfolio_id, id, twin, R4(swapped - base) AS gain FROM v""", digits=4)
def _(t):
    cost = (t.pf_fund.join(stored(t.fund.select("isin", "cost")), "isin").groupBy("portfolio_id")
            .agg((F.sum(F.col("w") * F.coalesce("cost", F.lit(0.0))) / 100).alias("pf_cost")))
    plan = lambda c: savings_value(F.lit(100000.0), F.lit(1000.0), F.lit(20), F.lit(0.06), c)
    own = t.pf_fund.join(cost, "portfolio_id").withColumn("base", plan(F.col("pf_cost")))
    j = own.join(t.twin_rows.withColumnRenamed("id", "isin"), "isin")
    less = F.col("pf_cost") - F.col("w") * (F.col("own_cost") - F.col("cost")) / 100
    return j.select("portfolio_id", F.col("isin").alias("id"), "twin", (plan(less) - F.col("base")).alias("gain"))


@query("weighted_cost", "twin_rows pf_fund products", """
WITH b AS (SELECT id, min(cost) AS tc FROM twin_rows GROUP BY id)
SELECT portfolio_id, R6(sum(w * coalesce(p.cost, 0))) AS cost, R6(sum(w * coalesce(b.tc, p.cost, 0))) AS cheapest_cost
FROM pf_fund f JOIN products p ON p.id = f.isin LEFT JOIN b ON b.id = f.isin GROUP BY portfolio_id""")
def _(t):
    return ho.weighted_cost(t.pf_fund, t.products, ho.cheapest_twin(t.twin_rows))


@query("overlap_pairs", "sim pf_fund", """
SELECT x.portfolio_id, x.isin AS a, y.isin AS b, R6(s.score) AS score FROM pf_fund x JOIN pf_fund y ON x.portfolio_id = y.portfolio_id AND x.isin < y.isin
JOIN sim s ON s.a = x.isin AND s.b = y.isin WHERE s.score >= 0.7 AND (s.reg IS NOT NULL OR s.top IS NOT NULL)""")
def _(t):
    return ho.overlap_pairs(t.pf_fund, t.alloc)


# ------------------------------------------------------------------ look-through
DUCK["look"] = """
WITH e AS (SELECT p.*, coalesce(q.eq, 1) * p.w AS e, coalesce(k.s, 0) AS tops FROM {pf_cust} p
           LEFT JOIN (SELECT isin, sum(share) FILTER (label = 'Aksjer') AS eq FROM {shares} WHERE kind = 'ast' GROUP BY isin) q USING (isin)
           LEFT JOIN (SELECT isin, sum(weight) AS s FROM {alloc} WHERE kind = 'top' GROUP BY isin) k USING (isin)),
l AS (SELECT portfolio_id, kind, label, sum(CASE WHEN kind = 'ast' THEN w ELSE e END * share) AS v FROM e JOIN {shares} USING (isin) GROUP BY 1, 2, 3)
SELECT portfolio_id, kind, label, CASE WHEN kind = 'ast' THEN v ELSE v / sum(v) OVER (PARTITION BY portfolio_id, kind) END AS share FROM l
UNION ALL SELECT portfolio_id, 'company', label, sum(w * weight / 100) FROM {pf_cust} JOIN {alloc} USING (isin) WHERE kind = 'top' GROUP BY 1, 3
UNION ALL SELECT portfolio_id, 'total', unnest(['covered', 'equity', 'top_covered']), unnest([sum(w), sum(e), sum(w * least(1, tops / 100))]) FROM e GROUP BY portfolio_id"""


def look(t, *kinds):
    return ho.look_through(t.pf_cust, t.alloc, [*kinds] or None, ho.block_count(t.lineitem.count()))


@query("look_through", "look", "SELECT portfolio_id, kind, label, R6(share) AS share FROM look")
def _(t):
    return look(t)


@query("company_merge", "look known_names", r"""
WITH n AS (SELECT CAST(holding_id AS VARCHAR) AS label, country, trim(regexp_replace(regexp_replace(regexp_replace(name, ',?\s+(class|cl\.?|ser\.?|series)\s+[a-c]\b\.?', '', 'i'),
             '\s+(inc\.?|corp\.?|corporation|plc|ltd\.?|asa|ab|a/s|oyj|n\.v\.|se|ag)\.?$', '', 'i'), '[,.\s]+$', '')) AS nm FROM known_names),
m AS (SELECT portfolio_id, CASE WHEN regexp_matches(nm, '^.{4,} [A-C]$') THEN left(nm, length(nm) - 2) ELSE nm END AS name, share, country, label FROM look JOIN n USING (label) WHERE kind = 'company')
SELECT portfolio_id, name, R6(sum(share)) AS share, arg_max(country, (share, label)) AS country FROM m GROUP BY portfolio_id, name""")
def _(t):
    return ho.company_merge(look(t, "company"), t.known_names)


@query("top_rows_rest", "look", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id, kind ORDER BY share DESC, label) AS position FROM look WHERE kind IN ('reg', 'sec', 'company'))
SELECT portfolio_id, kind, label, R6(share) AS share, position FROM r WHERE position <= 4
UNION ALL SELECT portfolio_id, kind, 'Resten', R6(sum(share)), 5 FROM r WHERE position > 4 GROUP BY portfolio_id, kind HAVING sum(share) > 0.005""")
def _(t):
    return rp.top_rows_rest(look(t, "reg", "sec", "company"), ["portfolio_id", "kind"], 4)


@query("tile_map", "look", """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY share DESC, label) AS rn FROM look WHERE kind = 'company'),
s AS (SELECT portfolio_id, sum(share) AS s FROM c WHERE rn <= 14 GROUP BY 1),
t AS (SELECT portfolio_id, coalesce(max(share) FILTER (label = 'Aksjer'), 0) AS eq, coalesce(sum(share) FILTER (label <> 'Aksjer'), 0) AS bond FROM look WHERE kind = 'ast' GROUP BY 1),
r AS (SELECT portfolio_id, label, share FROM c WHERE rn <= 14 UNION ALL SELECT portfolio_id, 'Resten av aksjene', greatest(0, eq - s) FROM t JOIN s USING (portfolio_id)
      UNION ALL SELECT portfolio_id, 'Renter og kontanter', bond FROM t UNION ALL SELECT portfolio_id, 'Annet', greatest(0, 1 - eq - bond) FROM t)
SELECT portfolio_id, label, R6(share) AS share FROM r WHERE share > 0.004""")
def _(t):
    both = stored(look(t, "ast", "company"))
    ast = both.where(F.col("kind") == "ast").groupBy("portfolio_id").agg(
        F.sum(F.when(F.col("label") == ho.EQUITY, F.col("share")).otherwise(0.0)).alias("equity"),
        F.sum(F.when(F.col("label") != ho.EQUITY, F.col("share")).otherwise(0.0)).alias("interest"))
    return rp.tile_map(both.where(F.col("kind") == "company").select("portfolio_id", "label", "share"), ast)


# ------------------------------------------------------------------ holdings as stored
SQL["alloc_json"] = """
SELECT isin, kind, label, CASE WHEN kind = 'top' THEN weight ELSE weight - 9.0 END AS weight FROM {alloc}"""


@query("allocation_compact", "alloc_json", """
SELECT isin, kind, label, R2(weight) AS weight FROM alloc_json WHERE CASE WHEN kind = 'top' THEN weight > 0 ELSE abs(weight) >= 0.05 END""")
def _(t):
    names = {"reg": ("regional_allocation", "type"), "sec": ("sector_allocation", "type"), "ast": ("asset_allocation", "type"),
             "top": ("instrument_underlying_info", "instrument_id")}
    lists = [F.collect_list(F.when(F.col("kind") == k, F.struct(F.col("label").alias(n), F.col("weight")))).alias(f) for k, (f, n) in names.items()]
    raw = t.alloc_json.groupBy("isin").agg(*lists).select("isin", F.to_json(F.struct(*[f for f, _ in names.values()])).alias("json"))
    return ho.allocation_compact(raw)


@query("holdings_export", "top_rows known_names", """
SELECT isin AS owner, holding_id, name, country FROM top_rows JOIN known_names USING (holding_id)""")
def _(t):
    items, used = ho.holdings_export(t.top_rows, t.known_names)
    return items.join(used, "holding_id").select(F.col("isin").alias("owner"), "holding_id", "name", "country")


# ------------------------------------------------------------------ proxies and suggestions
@stage
def proxy(t):
    f = t.fund.withColumn("vol", F.coalesce("vol5", "vol3", "vol1")).withColumnRenamed("isin", "id")
    quiet = F.col("asset_class").isin("Renter", "Pengemarked") & (F.col("currency") == "NOK")
    return ho.proxy_choice(f.where((F.col("kind") == "fond") & ~quiet), f.where(F.col("kind") == "etf"), t.alloc)


DUCK["proxy"] = """
WITH f AS (SELECT *, coalesce(vol5, vol3, vol1) AS vol FROM {fund}), u AS (SELECT * FROM f WHERE kind = 'fond' AND NOT (asset_class IN ('Renter', 'Pengemarked') AND currency = 'NOK')),
e AS (SELECT * FROM f WHERE kind = 'etf'),
s AS (SELECT u.isin AS id, e.isin AS p, e.vol AS pv, s.score, e.n_months, max(s.score) OVER (PARTITION BY u.isin) AS best FROM u JOIN e ON e.asset_class = u.asset_class AND e.hedged = u.hedged JOIN {sim} s ON s.a = u.isin AND s.b = e.isin),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n_months DESC, score DESC, p DESC) AS rn FROM s WHERE score >= best - 0.08),
a AS (SELECT id, p, pv, score AS sim FROM k WHERE rn = 1 AND score >= 0.3),
b AS (SELECT u.isin AS id, e.isin AS p, e.vol AS pv, 0.0 AS sim, row_number() OVER (PARTITION BY u.isin ORDER BY coalesce(abs(ln(e.vol / u.vol)), 5), e.isin) AS rn
      FROM u JOIN e ON e.category = u.category AND e.hedged = u.hedged WHERE u.isin NOT IN (SELECT id FROM a)),
c AS (SELECT id, p, pv, sim FROM a UNION ALL SELECT id, p, pv, sim FROM b WHERE rn = 1)
SELECT u.isin AS id, c.p AS proxy, c.sim, CASE WHEN c.p IS NULL THEN NULL WHEN c.sim >= 0.85 OR pv <= 0 THEN 1 ELSE greatest(0.5, least(1.8, u.vol / pv)) END AS k FROM u LEFT JOIN c ON c.id = u.isin"""


@query("proxy_choice", "proxy", "SELECT id, proxy, R6(sim) AS sim, R6(k) AS k FROM proxy")
def _(t):
    return t.proxy


SQL["proxy_ret"] = """
SELECT f.isin AS asset, m.mi, m.r FROM {fund} f JOIN {late} m ON m.asset = 'Brand#' || CAST(f.instrument_id % 25 + 1 AS STRING) WHERE f.kind = 'etf'"""


DUCK["proxy_par"] = """
SELECT f.isin AS id, p.proxy, coalesce(p.k, 1) AS k, coalesce(vol5, vol3, vol1) AS vol,
       CASE WHEN p.proxy IS NULL AND asset_class IN ('Renter', 'Pengemarked') AND coalesce(vol5, vol3, vol1) > 0.012 THEN 0.5 ELSE 0 END AS corr,
       CASE WHEN r5 IS NOT NULL THEN 60 WHEN r3 IS NOT NULL THEN 36 ELSE 12 END AS len, coalesce(r5, r3, r1) AS ret, (coalesce(f.cost, 0) - coalesce(c.cost, 0)) / 100 AS drag
FROM {fund} f LEFT JOIN {proxy} p ON p.id = f.isin LEFT JOIN (SELECT isin, cost FROM {fund}) c ON c.isin = p.proxy WHERE f.kind = 'fond'"""
DUCK["proxy_base"] = f"""
SELECT p.id, p.proxy, p.len, p.ret, p.drag, x.mi, lim.b - p.len + 1 AS first, CASE WHEN p.proxy IS NOT NULL THEN x.rf + p.k * (q.r - x.rf) ELSE
       x.rf + p.vol * sqrt(1 - corr * corr) / sqrt(12) * CASE WHEN s - floor(s) < 0.5 THEN -1 ELSE 1 END + corr * p.vol / 0.15 * coalesce(m.r - x.rf, 0) END AS base
FROM {{proxy_par}} p CROSS JOIN (SELECT min(mi) AS a, max(mi) AS b FROM {{rfm}}) lim CROSS JOIN (SELECT *, sin((mi - (SELECT min(mi) FROM {{rfm}}) + 1) * 12.9898::DOUBLE) * 43758.5453::DOUBLE AS s FROM {{rfm}}) x
LEFT JOIN {{proxy_ret}} q ON q.asset = p.proxy AND q.mi = x.mi LEFT JOIN {{mret}} m ON m.asset = 'Brand#1' AND m.mi = x.mi WHERE p.proxy IS NULL OR q.r IS NOT NULL"""


@query("proxy_history", "proxy_base", """
WITH RECURSIVE w AS (SELECT id, list(base) AS bs, pow(1 + max(ret), max(len) / 12.0::DOUBLE) AS want FROM proxy_base WHERE mi >= first GROUP BY id HAVING count(*) = max(len)),
it AS (SELECT id, bs, want, -0.05::DOUBLE AS lo, 0.05::DOUBLE AS hi, 0.0::DOUBLE AS c, 0 AS i FROM w
       UNION ALL SELECT id, bs, want, CASE WHEN g < want THEN mid ELSE lo END, CASE WHEN g < want THEN hi ELSE mid END, mid, i + 1
       FROM (SELECT *, (lo + hi) / 2 AS mid, list_aggregate(list_transform(bs, lambda b: 1 + b + (lo + hi) / 2), 'product') AS g FROM it WHERE i < 60) s),
c AS (SELECT id, c FROM it WHERE i = 60)
SELECT b.id, b.mi, R8(CASE WHEN c.id IS NOT NULL AND b.mi >= b.first THEN b.base + c.c ELSE b.base - b.drag / 12 + CASE WHEN b.proxy IS NULL THEN coalesce(c.c, 0) ELSE 0 END END) AS r
FROM proxy_base b LEFT JOIN c ON c.id = b.id""", digits=8)
def _(t):
    vol = F.coalesce("vol5", "vol3", "vol1")
    years = F.when(F.col("r5").isNotNull(), 5).when(F.col("r3").isNotNull(), 3).when(F.col("r1").isNotNull(), 1)
    cost = t.fund.select(F.col("isin").alias("proxy"), F.col("cost").alias("proxy_cost"))
    credit = F.col("asset_class").isin("Renter", "Pengemarked") & (vol > 0.012)
    params = (t.fund.where(F.col("kind") == "fond").withColumnRenamed("isin", "id").join(t.proxy, "id", "left").join(cost, "proxy", "left").select(
        "id", "proxy", F.coalesce("k", F.lit(1.0)).alias("k"), vol.alias("vol"), F.when(credit, 0.5).otherwise(0.0).alias("corr"), F.lit(0.15).alias("mkt_vol"),
        years.alias("target_years"), F.coalesce("r5", "r3", "r1").alias("target_ret"),
        ((F.coalesce("cost", F.lit(0.0)) - F.coalesce("proxy_cost", F.lit(0.0))) / 100).alias("drag")))
    return ho.proxy_history(params, t.proxy_ret, t.bench, t.rfm)


DUCK["blocks"] = """
WITH f AS (SELECT *, CASE WHEN asset_class IN ('Renter', 'Pengemarked') AND vol5 < 0.012 THEN 'safe' WHEN is_index AND ask AND NOT esg THEN
             CASE category WHEN 'Global Equity Large Cap' THEN 'core' WHEN 'Global Emerging Markets Equity' THEN 'em' WHEN 'Global Equity Mid/Small Cap' THEN 'small' END END AS role
           FROM {fund} WHERE cost IS NOT NULL AND r5 IS NOT NULL AND tradable AND currency = 'NOK' AND owners >= 400 AND NOT hedged),
c AS (SELECT *, min(cost) OVER (PARTITION BY role) AS low FROM f WHERE role IS NOT NULL), g AS (SELECT *, max(r5) OVER (PARTITION BY role) AS best FROM c WHERE cost <= low + 0.15)
SELECT role, arg_min(isin, (cost, -owners, isin)) AS isin FROM g WHERE r5 >= best - 0.005 GROUP BY role"""


@shared
def blocks(t):
    return ho.reco_blocks(t.fund, 400)


@query("reco_blocks", "blocks", "SELECT role, isin FROM blocks")
def _(t):
    return t.blocks


@query("reco_weights", "blocks", """
WITH b AS (SELECT max(isin) FILTER (role = 'core') AS core, max(isin) FILTER (role = 'em') AS em, max(isin) FILTER (role = 'small') AS small, max(isin) FILTER (role = 'safe') AS safe FROM blocks),
p AS (SELECT unnest([20, 40, 60, 80, 100]) AS eq, unnest(['Forsiktig', 'Moderat', 'Balansert', 'Offensiv', 'Bare aksjer']) AS profile),
x AS (SELECT profile, eq, b.*, CASE WHEN em IS NOT NULL AND eq * 0.1 >= 3 THEN floor(eq * 0.1 + 0.5) ELSE 0 END AS we, CASE WHEN small IS NOT NULL AND eq * 0.1 >= 3 THEN floor(eq * 0.1 + 0.5) ELSE 0 END AS ws
      FROM p CROSS JOIN b WHERE core IS NOT NULL AND safe IS NOT NULL)
SELECT * FROM (SELECT profile, unnest(['core', 'em', 'small', 'safe']) AS role, unnest([core, em, small, safe]) AS isin, CAST(unnest([eq - we - ws, we, ws, 100 - eq]) AS BIGINT) AS w FROM x) y WHERE w > 0""")
def _(t):
    return ho.reco_weights(t.blocks)


# ------------------------------------------------------------------ savings plans: one per customer, costs from the fund list
@query("savings_value", "", """
WITH p AS (SELECT c_custkey AS plan_id, greatest(c_acctbal, 0) AS start, 500 + c_nationkey * 100 AS monthly, 0.03 + (c_custkey % 9) / 200.0::DOUBLE AS gross, years, fee
           FROM customer, (SELECT unnest([1, 5, 20]) AS years) y, (SELECT unnest([0.002, 0.015, 0.03]::DOUBLE[]) AS fee) f),
m AS (SELECT *, pow(greatest(1e-9, 1 + gross - fee), 1 / 12.0::DOUBLE) - 1 AS m, years * 12 AS n, floor((gross + fee) * 200 + 0.5) / 200 AS shown FROM p)
SELECT plan_id, CAST(years AS BIGINT) AS years, fee, R4(start * pow(1 + m, n) + CASE WHEN abs(m) < 1e-12 THEN monthly * n ELSE monthly * (1 + m) * (pow(1 + m, n) - 1) / m END) AS value, shown AS default_gross FROM m""", digits=4)
def _(t):
    p = t.customer.select(F.col("c_custkey").alias("plan_id"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("start"),
                          (500 + F.col("c_nationkey") * 100).cast("double").alias("monthly"), (0.03 + (F.col("c_custkey") % 9) / 200).alias("gross"))
    p = p.withColumn("years", F.explode(F.array(*[F.lit(y).cast("long") for y in (1, 5, 20)]))).withColumn("fee", F.explode(F.array(*[F.lit(f) for f in (0.002, 0.015, 0.03)])))
    value = savings_value(F.col("start"), F.col("monthly"), F.col("years"), F.col("gross"), F.col("fee"))
    return p.select("plan_id", "years", "fee", value.alias("value"), gross_return(F.col("gross"), F.col("fee")).alias("default_gross"))
