"""Queries over pairs of instruments, clusters and portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import checks, cluster, pairs, portfolio as pf, timeseries as ts, universe
from lodestar.params import DEFAULTS
from lodestar.plans import listings, series  # noqa: F401  (their SQL is built on)
from lodestar.plans.adapters import DUCK, SQL
from lodestar.plans.registry import query, shared, stage
from lodestar.plans.series import BENCH, story_sql
from lodestar.session import stored

# ------------------------------------------------------------------ share classes of each brand
DUCK["pret"] = series._period_sql("year(date) * 12 + month(date)", "last_day(date)").replace("panel", "{panel}").replace("R8(r)", "r")
# copies (a, b), close and less close classes, one with error months, one with a short history
DUCK["classes"] = """
SELECT p.asset || '-' || k.cls AS asset, p.period, p.r * k.f + CASE WHEN k.cls = 'f' AND p.period % 25 = 3 THEN 0.15 ELSE 0.0 END AS r
FROM {pret} p JOIN (SELECT 'a' AS cls, CAST(1.0 AS DOUBLE) AS f, 0 AS since UNION ALL SELECT 'b', 1.0, 0 UNION ALL SELECT 'c', 1.012, 0
                    UNION ALL SELECT 'd', 1.031, 0 UNION ALL SELECT 'e', 1.043, 0 UNION ALL SELECT 'f', 1.02, 0
                    UNION ALL SELECT 'g', 1.1, 24014) k ON p.period > k.since"""
SQL["class_members"] = """
SELECT DISTINCT asset, asset AS name, split_part(asset, '-', 1) || CASE WHEN asset LIKE '%-e' THEN ' far' ELSE '' END AS cluster FROM {classes}"""


@stage
def pret(t):
    return ts.period_returns(t.panel, "ME")


@stage
def te_full(t):
    return pairs.te_pairs(t.classes, max_te=float("inf"))


@stage
def tep(t):
    return pairs.te_pairs(t.classes)


DUCK["te_all"] = """
SELECT a.asset AS a, b.asset AS b, stddev_samp(a.r - b.r) * sqrt(12) AS te, count(*) AS n
FROM {classes} a JOIN {classes} b ON a.period = b.period AND a.asset < b.asset GROUP BY a.asset, b.asset HAVING count(*) >= 2"""
DUCK["te_near"] = "SELECT * FROM {te_all} WHERE te < 0.25"
DUCK["te_robust"] = """
SELECT a, b, stddev_samp(greatest(least(d, med + lim), med - lim)) * sqrt(12) AS te
FROM (SELECT *, 4 * 1.4826 * quantile_cont(abs(d - med), 0.5) OVER (PARTITION BY a, b) AS lim
      FROM (SELECT n.a, n.b, x.r - y.r AS d, quantile_cont(x.r - y.r, 0.5) OVER (PARTITION BY n.a, n.b) AS med
            FROM {te_near} n JOIN {classes} x ON x.asset = n.a JOIN {classes} y ON y.asset = n.b AND y.period = x.period WHERE n.n >= 12) s) q
GROUP BY a, b"""
DUCK["edges"] = """
SELECT n.a, n.b, coalesce(r.te, n.te) AS d FROM {te_near} n LEFT JOIN {te_robust} r ON n.a = r.a AND n.b = r.b WHERE n.n >= 12"""
DUCK["edges_all"] = DUCK["edges"].replace("{te_near}", "{te_all}")


@query("pair_self_join", "te_all", "SELECT a, b, n FROM te_all")
def _(t):
    return t.te_full.select("a", "b", "n")


@query("te_pairs", "te_near", "SELECT a, b, R6(te) AS te, n FROM te_near")
def _(t):
    return t.tep.select("a", "b", "te", "n")


@query("te_pairs_all", "te_all", "SELECT a, b, R6(te) AS te, n FROM te_all")
def _(t):
    return t.te_full.select("a", "b", "te", "n")


@query("robust_te", "te_robust", "SELECT a, b, R6(te) AS te FROM te_robust")
def _(t):
    return t.tep.where(F.col("robust").isNotNull()).select("a", "b", F.col("robust").alias("te"))


@query("te_edges", "edges", "SELECT a, b, R6(d) AS d FROM edges")
def _(t):
    return pairs.te_edges(t.tep)


@query("cluster_stats", "edges_all class_members", """
SELECT s.cluster, s.cluster_size, R6(coalesce(m.max_te, 0)) AS max_te
FROM (SELECT cluster, count(*) AS cluster_size FROM class_members GROUP BY cluster) s
LEFT JOIN (SELECT x.cluster, max(d) AS max_te FROM edges_all JOIN class_members x ON x.asset = a JOIN class_members y ON y.asset = b AND x.cluster = y.cluster
           GROUP BY x.cluster) m ON s.cluster = m.cluster""")
def _(t):
    return cluster.cluster_stats(t.class_members, pairs.te_edges(t.te_full))


def _linkage(thresholds: tuple[float, ...], edges: str = "edges", members: str = "class_members") -> str:
    """One merge at a time: the nearest two clusters of each threshold whose members all have an edge; the name is the first member's."""
    return f"""
WITH RECURSIVE near AS MATERIALIZED (SELECT * FROM {edges} WHERE d <= {max(thresholds)}),
lab AS (SELECT 0 AS step, t, asset AS node, asset AS cluster FROM {members}, (SELECT unnest({list(thresholds)}::DOUBLE[]) AS t) q
UNION ALL
SELECT step + 1, l.t, l.node, CASE WHEN l.cluster = m.gone THEN m.stays ELSE l.cluster END
FROM lab l JOIN (
  SELECT t, arg_min(a, (d, a, b)) AS stays, arg_min(b, (d, a, b)) AS gone FROM (
    SELECT x.t, least(x.cluster, y.cluster) AS a, greatest(x.cluster, y.cluster) AS b, max(e.d) AS d, count(*) AS cnt
    FROM near e JOIN lab x ON x.node = e.a JOIN lab y ON y.node = e.b AND y.t = x.t WHERE e.d <= x.t AND x.cluster <> y.cluster GROUP BY 1, 2, 3) p
  JOIN (SELECT t, cluster AS a, count(*) AS na FROM lab GROUP BY ALL) v USING (t, a) JOIN (SELECT t, cluster AS b, count(*) AS nb FROM lab GROUP BY ALL) w USING (t, b)
  WHERE cnt = na * nb GROUP BY t) m ON m.t = l.t),
done AS (SELECT t, node, arg_max(cluster, step) AS cluster FROM lab GROUP BY t, node)"""


@query("te_clusters", "edges class_members", f"{_linkage((DEFAULTS.te_threshold,))} SELECT node AS asset, cluster FROM done")
def _(t):
    return cluster.te_clusters(t.classes, t.class_members).select("asset", "cluster")


@query("threshold_sensitivity", "edges class_members", f"""{_linkage(DEFAULTS.te_thresholds_report)}
SELECT t AS threshold, count(*) AS clusters, count(*) FILTER (el) AS clusters_with_eligible, count(*) FILTER (n > 1) AS multi_member_clusters
FROM (SELECT t, cluster, count(*) AS n, bool_or(coalesce(h.el, false)) AS el FROM done
      LEFT JOIN (SELECT asset, count(*) >= {12 * DEFAULTS.min_history_years} AS el FROM classes GROUP BY asset) h ON h.asset = node GROUP BY t, cluster) c GROUP BY t""")
def _(t):
    labels = cluster.te_clusters(t.classes, t.class_members, DEFAULTS.te_thresholds_report)
    history = t.classes.groupBy("asset").agg((F.count(F.lit(1)) >= 12 * DEFAULTS.min_history_years).alias("eligible"))
    return cluster.threshold_sensitivity(labels, history)


# ------------------------------------------------------------------ the whole build: NOK prices of share classes, clusters, representatives
_UNI = {"a": (1.0, "1990-01-01"), "b": (1.0, "1990-01-01"), "c": (1.012, "1990-01-01"), "e": (1.043, "1990-01-01"), "g": (1.004, "1998-03-01")}
DUCK["uni_prices"] = "SELECT asset || '-' || cls AS asset, date, 100 * pow(close / 100, f) AS close FROM {base_prices} JOIN (" + " UNION ALL ".join(
    f"SELECT '{c}' AS cls, CAST({f} AS DOUBLE) AS f, DATE '{since}' AS since" for c, (f, since) in _UNI.items()) + ") k ON date >= k.since"
SQL["uni_list"] = f"""
SELECT asset || '-' || split_part('{"|".join([*_UNI, "z"])}', '|', CAST((instrument_id - 1) % 6 + 1 AS INT)) AS asset, instrument_id, isin, name, category, dividend_policy,
       is_tradable, fee, fund_size, owners, was_rep
FROM {{etf}} JOIN {{asset_ccy}} ON CAST(floor((instrument_id - 1) / 6) AS BIGINT) + 1 = CAST(substr(asset, 7) AS BIGINT)"""


@stage
def uni_prices(t):
    k = F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.lit(f).alias("f"), F.lit(since).cast("date").alias("since")) for c, (f, since) in _UNI.items()]))
    p = ts.nok_prices(t.dirty, t.divs, t.fx, t.asset_ccy).select("*", k.alias("k")).where(F.col("date") >= F.col("k.since"))
    return p.select(F.concat_ws("-", "asset", "k.cls").alias("asset"), "date", (100 * F.pow(F.col("close") / 100, F.col("k.f"))).alias("close"))


DUCK["uni_ret"] = series._period_sql("year(date) * 12 + month(date)", "last_day(date)").replace("panel", "{uni_prices}").replace("R8(r)", "r")
for _name in ("te_all", "te_near", "te_robust", "edges"):
    DUCK[f"uni_{_name}"] = DUCK[_name].replace("{classes}", "{uni_ret}").replace("{te_", "{uni_te_")
DUCK["uni_lab"] = _linkage((DEFAULTS.te_threshold,), "{uni_edges}", "{uni_list}") + " SELECT node AS asset, cluster FROM done"
DUCK["uni_rows"] = """
SELECT l.*, r.id AS cluster_id, r.n AS cluster_size, f.f IS NOT NULL AS has_prices, round(((SELECT max(date) FROM {uni_prices}) - f.f) / 365.25::DOUBLE, 2) AS history_years,
       false AS is_rep, 0.0 AS r5, 0.0 AS vol5, '' AS ticker
FROM {uni_list} l JOIN {uni_lab} b ON b.asset = l.asset
JOIN (SELECT c, n, row_number() OVER (ORDER BY n DESC, k) AS id FROM (SELECT cluster AS c, count(*) AS n, min(asset) AS k FROM {uni_lab} GROUP BY 1) s) r ON r.c = b.cluster
LEFT JOIN (SELECT asset, min(date) AS f FROM {uni_prices} GROUP BY asset) f ON f.asset = l.asset"""
DUCK["uni_univ"] = DUCK["univ"].replace("{etf}", "{uni_rows}").replace("history_years < 5", "coalesce(history_years, 0) < 5")
DUCK["uni_reps"] = DUCK["reps"].replace("{univ}", "{uni_univ}")


@query("universe_build", "uni_reps uni_rows", """
SELECT asset, isin, p.cluster_id, cluster_size, R6(history_years) AS history_years, p.rep AS is_representative, p.why AS reason FROM uni_rows JOIN uni_reps p USING (isin)""")
def _(t):
    return universe.build_universe(t.uni_list, t.uni_prices)


@query("renumber_clusters", "etf", """
WITH s AS (SELECT cluster_id AS c, count(*) AS n, min(isin) AS k FROM etf GROUP BY 1),
r AS (SELECT c, n, row_number() OVER (ORDER BY n DESC, k) AS id FROM s)
SELECT isin AS asset, r.id AS cluster_id, r.n AS cluster_size FROM etf JOIN r ON cluster_id = c""")
def _(t):
    return cluster.renumber_clusters(t.etf.select(F.col("isin").alias("asset"), F.col("cluster_id").alias("cluster")))


@query("acceptance_checks", "class_members classes", """
WITH te AS (SELECT x.asset AS a, y.asset AS b, stddev_samp(x.r - y.r) * sqrt(12) AS te FROM classes x JOIN classes y
            ON x.period = y.period AND x.asset LIKE '%-a' AND y.asset = split_part(x.asset, '-', 1) || '-e' GROUP BY 1, 2)
SELECT 'one cluster: brand 7' AS "check", count(DISTINCT cluster) = 1 AS ok, CAST(count(DISTINCT cluster) AS DOUBLE) AS detail
FROM class_members WHERE starts_with(name, 'Brand#7-') AND NOT name LIKE '%-e'
UNION ALL SELECT 'one cluster: copies', count(DISTINCT cluster) = 1, CAST(count(DISTINCT cluster) AS DOUBLE) FROM class_members WHERE name LIKE '%-a' OR name LIKE '%-b'
UNION ALL SELECT 'apart: -a$ -e$', count(*) = 0, CAST(count(*) AS DOUBLE) FROM (SELECT cluster FROM class_members GROUP BY cluster
          HAVING bool_or(name LIKE '%-a') AND bool_or(name LIKE '%-e')) s
UNION ALL SELECT 'te: ' || a || ' ' || b, x.cluster <> y.cluster, R6(te) FROM te JOIN class_members x ON x.asset = a JOIN class_members y ON y.asset = b""")
def _(t):
    first = t.class_members.where(F.col("asset").endswith("-a")).select(
        F.col("asset").alias("a"), F.regexp_replace("asset", "-a$", "-e").alias("b"))
    return checks.acceptance_checks(t.class_members, t.classes, {"brand 7": "^Brand#7-[^e]", "copies": "-[ab]$"}, [("-a$", "-e$")], first)


# ------------------------------------------------------------------ covariance and expected return
SQL["asset_cost"] = "SELECT p_brand AS asset, avg(p_size) / 40 AS cost FROM {part} GROUP BY p_brand"
DUCK["ret60"] = """
SELECT * FROM {mret} WHERE mi IN (SELECT mi FROM {mret} WHERE mi > (SELECT max(mi) FROM {mret}) - 60
                                  GROUP BY mi HAVING count(*) = (SELECT count(DISTINCT asset) FROM {mret} WHERE mi > (SELECT max(mi) FROM {mret}) - 60))"""


# copies (a, b), close and less close classes, one with error months (f), one with a short history (g)
CLASSES = {"a": (1.0, 0), "b": (1.0, 0), "c": (1.012, 0), "d": (1.031, 0), "e": (1.043, 0), "f": (1.02, 0), "g": (1.1, 24014)}


@stage
def classes(t):
    k = F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.lit(f).alias("f"), F.lit(s).alias("since")) for c, (f, s) in CLASSES.items()]))
    e = t.pret.select("*", k.alias("k")).where(F.col("period") > F.col("k.since"))
    slip = F.when((F.col("k.cls") == "f") & (F.col("period") % 25 == 3), 0.15).otherwise(0.0)
    return e.select(F.concat_ws("-", "asset", "k.cls").alias("asset"), "period", (F.col("r") * F.col("k.f") + slip).alias("r"))


@stage
def ret60(t):
    return pf.common_months(pf.last_months(t.mret, 12 * DEFAULTS.estimation_years))


@shared
def bench60(t):
    return t.ret60.where(F.col("asset") == BENCH).select("mi", "r")


@stage
def est(t):
    rf_now = t.rfm.agg((F.pow(1 + F.max_by("rf", "mi"), 12) - 1).alias("rf")).scalar()
    return pf.estimate(t.ret60, t.bench60, t.asset_cost, rf_now)


def _lw(src: str, by: str = "") -> tuple[str, str]:
    """Pair form of the shrinkage: moments per ordered pair, then one row (per selection ``by``) with rbar and delta."""
    key = f"{by}, " if by else ""
    same = lambda x, y: f" AND {x}.{by} = {y}.{by}" if by else ""
    whole, groups = (f"PARTITION BY m.{by}", f"GROUP BY {by}") if by else ("", "")
    centred = f"(SELECT *, r - avg(r) OVER (PARTITION BY {key}asset) AS x FROM ({src}) q)"
    moments = f"""
SELECT {f"a.{key}" if by else ""}a.asset AS a, b.asset AS b, count(*) AS t, sum(a.x * b.x) / (count(*) - 1) AS s, sum(a.x * b.x) / count(*) AS h,
       sum(a.x * a.x * b.x * b.x) / count(*) AS y2, sum(a.x * a.x * a.x * b.x) / count(*) AS t1
FROM {centred} a JOIN {centred} b ON a.mi = b.mi{same("a", "b")} GROUP BY {f"a.{key}" if by else ""}a.asset, b.asset"""
    scalars = f"""
SELECT {key}rbar, greatest(0, least(1, CASE WHEN gamma > 0 THEN (pi - pid - rbar * theta) / gamma ELSE 0 END / t)) AS delta
FROM (SELECT {key}max(rbar) AS rbar, max(t) AS t, sum(y2 - 2 * h * s + s * s) AS pi, sum(y2 - 2 * h * s + s * s) FILTER (a = b) AS pid,
             sum(sdb / sda * (t1 - haa * s - h * saa + saa * s)) FILTER (a <> b) AS theta,
             sum(pow(s - CASE WHEN a = b THEN s ELSE rbar * sda * sdb END, 2)) AS gamma
      FROM (SELECT m.*, sqrt(x.s) AS sda, sqrt(y.s) AS sdb, x.s AS saa, x.h AS haa,
                   (sum(m.s / sqrt(x.s * y.s)) OVER ({whole}) - sqrt(count(*) OVER ({whole}))) / (sqrt(count(*) OVER ({whole})) * (sqrt(count(*) OVER ({whole})) - 1)) AS rbar
            FROM {{mom}} m JOIN {{mom}} x ON x.a = m.a AND x.b = m.a{same("x", "m")} JOIN {{mom}} y ON y.a = m.b AND y.b = m.b{same("y", "m")}) p {groups}) z"""
    return moments, scalars


DUCK["mom_u"], _s = _lw("SELECT asset, mi, r FROM {ret60}")
DUCK["lw_u"] = _s.replace("{mom}", "{mom_u}")
DUCK["mom_b"], _s = _lw(f"SELECT asset, mi, r FROM {{ret60}} UNION ALL SELECT '~bench', mi, r FROM {{ret60}} WHERE asset = '{BENCH}'")
DUCK["lw_b"] = _s.replace("{mom}", "{mom_b}")
DUCK["sh_b"] = """
SELECT m.a, m.b, m.s AS cov, CASE WHEN m.a = m.b THEN m.s ELSE l.delta * l.rbar * sqrt(x.s * y.s) + (1 - l.delta) * m.s END AS s
FROM {mom_b} m JOIN {mom_b} x ON x.a = m.a AND x.b = m.a JOIN {mom_b} y ON y.a = m.b AND y.b = m.b CROSS JOIN {lw_b} l"""
DUCK["est"] = """
SELECT d.a AS asset, sqrt(d.s) AS sd, c.s / b.s AS beta, h.hist, f.rf,
       0.75 * (f.rf + c.s / b.s * 0.045 - k.cost / 100) + 0.25 * h.hist AS mu
FROM {sh_b} d JOIN {sh_b} c ON c.a = d.a AND c.b = '~bench' JOIN {sh_b} b ON b.a = '~bench' AND b.b = '~bench'
JOIN (SELECT asset, avg(r) * 12 AS hist FROM {ret60} GROUP BY asset) h ON h.asset = d.a JOIN {asset_cost} k ON k.asset = d.a
CROSS JOIN (SELECT pow(1 + arg_max(rf, mi), 12) - 1 AS rf FROM {rfm}) f WHERE d.a = d.b AND d.a <> '~bench'"""


@query("covariance_pairs", "mom_u", "SELECT a, b, R8(s) AS cov FROM mom_u WHERE a <= b", digits=8)
def _(t):
    return pairs.covariance_pairs(t.ret60).select("a", "b", "cov")


@query("shrinkage", "ret60 lw_u", "SELECT (SELECT count(DISTINCT asset) FROM ret60) AS n_assets, (SELECT count(DISTINCT mi) FROM ret60) AS n_months, R6(rbar) AS rbar, R6(delta) AS delta FROM lw_u")
def _(t):
    return pf.shrinkage(t.ret60)


@query("shrunk_covariance", "mom_u lw_u", """
SELECT m.a, m.b, R8(m.s) AS cov, R8(CASE WHEN m.a = m.b THEN m.s ELSE l.delta * l.rbar * sqrt(x.s * y.s) + (1 - l.delta) * m.s END) AS shrunk
FROM mom_u m JOIN mom_u x ON x.a = m.a AND x.b = m.a JOIN mom_u y ON y.a = m.b AND y.b = m.b CROSS JOIN lw_u l WHERE m.a <= m.b""", digits=8)
def _(t):
    return pf.shrunk_covariance(pairs.covariance_pairs(t.ret60), pf.shrinkage(t.ret60))


@query("estimate_mu_beta", "est", "SELECT asset, R6(sd) AS sd, R6(beta) AS beta, R6(hist) AS hist, R6(mu) AS mu FROM est")
def _(t):
    return t.est.select("asset", "sd", "beta", "hist", "mu")


DUCK["pvar"] = """
SELECT x.portfolio_id, sum(x.w * y.w * c.s) * 12 AS v FROM {pf_asset} x JOIN {pf_asset} y ON x.portfolio_id = y.portfolio_id
JOIN {sh_b} c ON c.a = x.asset AND c.b = y.asset GROUP BY x.portfolio_id"""


@query("portfolio_perf", "pvar est pf_asset", """
SELECT p.portfolio_id, R6(ret) AS ret, R6(sqrt(v)) AS vol, R6(CASE WHEN sqrt(v) > 1e-9 THEN (ret - rf) / sqrt(v) END) AS sharpe
FROM (SELECT portfolio_id, sum(w * mu) AS ret, max(rf) AS rf FROM pf_asset JOIN est USING (asset) GROUP BY portfolio_id) p JOIN pvar USING (portfolio_id)""")
def _(t):
    return pf.portfolio_perf(t.pf_asset, t.ret60, t.est)


@query("risk_contribution", "pvar sh_b pf_asset", """
SELECT portfolio_id, asset, R6(w) AS w, R6(part / v) AS rc, R6(part / v - w) AS excess
FROM (SELECT x.portfolio_id, x.asset, max(x.w) AS w, sum(x.w * y.w * c.s) * 12 AS part FROM pf_asset x JOIN pf_asset y ON x.portfolio_id = y.portfolio_id
      JOIN sh_b c ON c.a = x.asset AND c.b = y.asset GROUP BY x.portfolio_id, x.asset) s JOIN pvar USING (portfolio_id)""")
def _(t):
    return pf.risk_contribution(t.pf_asset, t.ret60, t.est)


DUCK["mix"] = """
SELECT portfolio_id, mi, r, months FROM (
  SELECT *, count(*) OVER (PARTITION BY portfolio_id) AS months FROM (
    SELECT m.* FROM (SELECT p.portfolio_id, l.mi, sum(p.w * l.r) AS r, count(*) AS n FROM {pf_asset} p JOIN {late} l USING (asset) GROUP BY 1, 2) m
    JOIN (SELECT portfolio_id, count(*) AS h FROM {pf_asset} GROUP BY 1) c ON c.portfolio_id = m.portfolio_id AND m.n = c.h
    WHERE m.mi > coalesce((SELECT max(g.mi) FROM (SELECT p.portfolio_id, s.mi FROM {pf_asset} p CROSS JOIN (SELECT DISTINCT mi FROM {late}) s
                          LEFT JOIN {late} l ON l.asset = p.asset AND l.mi = s.mi WHERE l.r IS NULL) g WHERE g.portfolio_id = m.portfolio_id), -1)) a) b
WHERE months >= 13"""


# one model per portfolio: its own holdings over its own window
DUCK["sel"] = f"""
SELECT p.portfolio_id, p.asset, l.mi, l.r FROM {{pf_asset}} p JOIN {{late}} l USING (asset)
JOIN (SELECT portfolio_id, mi, count(*) OVER (PARTITION BY portfolio_id) AS n FROM {{mix}}
      WHERE mi > (SELECT max(mi) FROM {{late}}) - 60 AND mi IN (SELECT mi FROM {{mret}} WHERE asset = '{BENCH}')) m ON m.portfolio_id = p.portfolio_id AND m.mi = l.mi
WHERE m.n >= 12"""
DUCK["mom_s"], _s = _lw(f"""SELECT portfolio_id, asset, mi, r FROM {{sel}} UNION ALL
SELECT w.portfolio_id, '~bench', w.mi, b.r FROM (SELECT DISTINCT portfolio_id, mi FROM {{sel}}) w JOIN {{mret}} b ON b.mi = w.mi AND b.asset = '{BENCH}'""", "portfolio_id")
DUCK["lw_s"] = _s.replace("{mom}", "{mom_s}")
DUCK["sh_s"] = """
SELECT m.portfolio_id, m.a, m.b, CASE WHEN m.a = m.b THEN m.s ELSE l.delta * l.rbar * sqrt(x.s * y.s) + (1 - l.delta) * m.s END AS s
FROM {mom_s} m JOIN {mom_s} x ON x.a = m.a AND x.b = m.a AND x.portfolio_id = m.portfolio_id
JOIN {mom_s} y ON y.a = m.b AND y.b = m.b AND y.portfolio_id = m.portfolio_id JOIN {lw_s} l ON l.portfolio_id = m.portfolio_id"""
DUCK["est_s"] = """
SELECT d.portfolio_id, d.a AS asset, sqrt(d.s) AS sd, c.s / b.s AS beta, h.hist, f.rf,
       0.75 * (f.rf + c.s / b.s * 0.045 - k.cost / 100) + 0.25 * h.hist AS mu
FROM {sh_s} d JOIN {sh_s} c ON c.a = d.a AND c.b = '~bench' AND c.portfolio_id = d.portfolio_id
JOIN {sh_s} b ON b.a = '~bench' AND b.b = '~bench' AND b.portfolio_id = d.portfolio_id
JOIN (SELECT portfolio_id, asset, avg(r) * 12 AS hist FROM {sel} GROUP BY ALL) h ON h.asset = d.a AND h.portfolio_id = d.portfolio_id JOIN {asset_cost} k ON k.asset = d.a
CROSS JOIN (SELECT pow(1 + arg_max(rf, mi), 12) - 1 AS rf FROM {rfm}) f WHERE d.a = d.b AND d.a <> '~bench'"""
DUCK["pvar_s"] = """
SELECT x.portfolio_id, x.asset, max(x.w) AS w, sum(x.w * y.w * c.s) * 12 AS part FROM {pf_asset} x JOIN {pf_asset} y ON x.portfolio_id = y.portfolio_id
JOIN {sh_s} c ON c.portfolio_id = x.portfolio_id AND c.a = x.asset AND c.b = y.asset GROUP BY x.portfolio_id, x.asset"""


@stage
def sel(t):
    return pf.selection_returns(t.pf_asset, t.late, t.mret.where(F.col("asset") == BENCH).select("mi", "r"))


@stage
def est_s(t):
    rf_now = t.rfm.agg((F.pow(1 + F.max_by("rf", "mi"), 12) - 1).alias("rf")).scalar()
    return pf.estimate(t.sel, t.mret.where(F.col("asset") == BENCH).select("mi", "r"), t.asset_cost, rf_now, by=["portfolio_id"])


DUCK["mom_su"], _s = _lw("SELECT portfolio_id, asset, mi, r FROM {sel}", "portfolio_id")
DUCK["lw_su"] = _s.replace("{mom}", "{mom_su}")


@query("selection_covariance", "mom_su lw_su", """
SELECT m.portfolio_id, m.a, m.b, R8(m.s) AS cov, R8(CASE WHEN m.a = m.b THEN m.s ELSE l.delta * l.rbar * sqrt(x.s * y.s) + (1 - l.delta) * m.s END) AS shrunk
FROM mom_su m JOIN mom_su x ON x.a = m.a AND x.b = m.a AND x.portfolio_id = m.portfolio_id JOIN mom_su y ON y.a = m.b AND y.b = m.b AND y.portfolio_id = m.portfolio_id
JOIN lw_su l ON l.portfolio_id = m.portfolio_id WHERE m.a <= m.b""", digits=8)
def _(t):
    by = ["portfolio_id"]
    return pf.shrunk_covariance(pairs.selection_covariance(t.sel, by), pf.shrinkage(t.sel, by), by)


@query("selection_estimate", "est_s", "SELECT portfolio_id, asset, R6(sd) AS sd, R6(beta) AS beta, R6(hist) AS hist, R6(mu) AS mu FROM est_s")
def _(t):
    return t.est_s.select("portfolio_id", "asset", "sd", "beta", "hist", "mu")


@query("selection_perf", "pvar_s est_s pf_asset", """
SELECT p.portfolio_id, R6(ret) AS ret, R6(sqrt(v)) AS vol, R6(CASE WHEN sqrt(v) > 1e-9 THEN (ret - rf) / sqrt(v) END) AS sharpe
FROM (SELECT portfolio_id, sum(w * mu) AS ret, max(rf) AS rf FROM pf_asset JOIN est_s USING (portfolio_id, asset) GROUP BY portfolio_id) p
JOIN (SELECT portfolio_id, sum(part) AS v FROM pvar_s GROUP BY portfolio_id) v USING (portfolio_id)""")
def _(t):
    return pf.portfolio_perf(t.pf_asset, t.sel, t.est_s)


@query("selection_risk", "pvar_s", """
SELECT portfolio_id, asset, R6(w) AS w, R6(part / v) AS rc, R6(part / v - w) AS excess FROM (SELECT *, sum(part) OVER (PARTITION BY portfolio_id) AS v FROM pvar_s) s""")
def _(t):
    return pf.risk_contribution(t.pf_asset, t.sel, t.est_s)


@query("portfolio_mix", "mix", "SELECT portfolio_id, mi, R6(r) AS r, months FROM mix")
def _(t):
    return pf.portfolio_mix(t.pf_asset, t.late)


@query("portfolio_risk_story", "mix", story_sql("mix", "portfolio_id"))
def _(t):
    mixes = pf.portfolio_mix(t.pf_asset, t.late)
    return ts.risk_story(mixes.select(F.col("portfolio_id").alias("asset"), "mi", "r")).withColumnRenamed("asset", "portfolio_id")


@query("largest_remainder", "pf_asset", """
WITH f AS (SELECT portfolio_id, asset, w * 100 AS p, floor(w * 100) AS f FROM pf_asset),
r AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY p - f DESC, asset) AS pos, 100 - sum(f) OVER (PARTITION BY portfolio_id) AS rest FROM f)
SELECT portfolio_id, asset, CAST(f + CASE WHEN pos <= rest THEN 1 ELSE 0 END AS BIGINT) AS pct FROM r""")
def _(t):
    return pf.largest_remainder(t.pf_asset)


@query("calendar_rebalance_returns", "mret pf_asset", """
WITH RECURSIVE months AS (SELECT DISTINCT mi FROM mret), lim AS (SELECT min(mi) AS a, max(mi) AS b FROM mret),
rules AS (SELECT unnest(['monthly', 'quarterly', 'annual', 'none']) AS rule),
due AS (SELECT rule, mi, mi < b AND CASE rule WHEN 'monthly' THEN true WHEN 'quarterly' THEN (mi % 12 + 1) % 3 = 0 WHEN 'annual' THEN mi % 12 = 11 ELSE false END AS due FROM rules, months, lim),
seg AS (SELECT *, coalesce(sum(CAST(due AS INT)) OVER (PARTITION BY rule ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM due),
g AS (SELECT a.asset, s.rule, s.seg, product(1 + coalesce(m.r, 0)) AS g FROM seg s CROSS JOIN (SELECT DISTINCT asset FROM mret) a LEFT JOIN mret m ON m.mi = s.mi AND m.asset = a.asset GROUP BY 1, 2, 3),
ends AS (SELECT rule, seg, bool_or(due) AS due FROM seg GROUP BY 1, 2),
v AS (SELECT p.portfolio_id, g.rule, g.seg, sum(p.w * g.g) AS v FROM pf_asset p JOIN g USING (asset) GROUP BY 1, 2, 3),
tr AS (SELECT p.portfolio_id, g.rule, g.seg, max(v.v) AS v, sum(abs(p.w - p.w * g.g / v.v)) AS tr FROM pf_asset p JOIN g USING (asset)
       JOIN v ON v.portfolio_id = p.portfolio_id AND v.rule = g.rule AND v.seg = g.seg GROUP BY 1, 2, 3),
x AS (SELECT tr.portfolio_id, tr.rule, tr.v, CASE WHEN e.due AND tr.tr > 1e-9 THEN tr.tr ELSE 0 END AS tr FROM tr JOIN ends e ON e.rule = tr.rule AND e.seg = tr.seg)
SELECT portfolio_id, rule, R6(product(v * (1 - 0.0025 * tr))) AS final_value, R6(sum(tr) / 2 / ((SELECT b - a + 1 FROM lim) / 12)) AS turnover_per_year,
       R6(sum(0.0025 * tr) / ((SELECT b - a + 1 FROM lim) / 12)) AS costs_per_year, R6(count(*) FILTER (tr > 0) / ((SELECT b - a + 1 FROM lim) / 12)) AS trades_per_year
FROM x GROUP BY portfolio_id, rule""")
def _(t):
    return pf.calendar_rebalance(t.pf_asset, t.mret)


# ------------------------------------------------------------------ weight scan: five sets of five brands
N, STEPS = 5, 20


@stage
def scan(t):
    e = t.est.join(t.clusters5, "asset").withColumn("no", F.substring("asset", 7, 9).cast("int"))
    mu = e.groupBy("cluster").agg(
        F.array_sort(F.collect_list(F.struct("asset", "mu", F.when(F.col("no") % 2 == 1, DEFAULTS.narrow_cap).otherwise(1.0).alias("hi"),
                                             (F.col("no") % 7 - 1).cast("double").alias("manual")))).alias("rows"), F.max("rf").alias("rf"))
    cov = pairs.covariance_pairs(t.ret60)
    shr = pf.shrunk_covariance(cov, t.est.agg(F.max("rbar").alias("rbar"), F.max("delta").alias("delta")))
    both = shr.union(shr.where(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"), "cov", "shrunk"))
    c = t.clusters5
    s = (both.join(c.select(F.col("asset").alias("a"), "cluster"), "a").join(c.select(F.col("asset").alias("b"), "cluster"), ["b", "cluster"])
         .groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("a", "b", (F.col("shrunk") * 12).alias("s")))).alias("m")))
    models = mu.join(s, "cluster").select(
        F.col("cluster").cast("long").alias("scan_id"), "rf", F.col("rows.mu").alias("mu"), F.col("rows.hi").alias("hi"),
        F.col("rows.manual").alias("manual"), F.col("m.s").alias("s"))
    return pf.weight_scan(stored(models), N, STEPS)


_W = ", ".join(f"w{i}" for i in range(1, N + 1))
_RW = ", ".join(f"R6(w{i}) AS w{i}" for i in range(1, N + 1))
_RET = " + ".join(f"w{i} * mu[{i}]" for i in range(1, N + 1))
_VAR = " + ".join(f"w{i} * w{j} * s[{(i - 1) * N + j}]" for i in range(1, N + 1) for j in range(1, N + 1))
DUCK["scan_all"] = f"""
WITH mod AS (SELECT c.cluster AS scan_id, list(e.mu ORDER BY c.asset) AS mu, max(e.rf) AS rf,
                    list(CASE WHEN CAST(substr(c.asset, 7) AS INT) % 2 = 1 THEN 0.25 ELSE 1 END::DOUBLE ORDER BY c.asset) AS hi,
                    list(greatest(CAST(substr(c.asset, 7) AS INT) % 7 - 1, 0)::DOUBLE ORDER BY c.asset) AS man
             FROM {{clusters5}} c JOIN {{est}} e ON e.asset = c.asset GROUP BY c.cluster),
cov AS (SELECT x.cluster AS scan_id, list(m.s * 12 ORDER BY m.a, m.b) AS s FROM {{sh_b}} m JOIN {{clusters5}} x ON x.asset = m.a
        JOIN {{clusters5}} y ON y.asset = m.b AND y.cluster = x.cluster GROUP BY x.cluster),
k AS (SELECT unnest(generate_series(0, {STEPS})) AS k),
grid AS (SELECT 'grid' AS kind, a.k / {STEPS}.0::DOUBLE AS w1, b.k / {STEPS}.0::DOUBLE AS w2, c.k / {STEPS}.0::DOUBLE AS w3, d.k / {STEPS}.0::DOUBLE AS w4,
                ({STEPS} - a.k - b.k - c.k - d.k) / {STEPS}.0::DOUBLE AS w5 FROM k a, k b, k c, k d WHERE a.k + b.k + c.k + d.k <= {STEPS}),
cand AS (SELECT mod.*, cov.s, g.* FROM mod JOIN cov USING (scan_id) JOIN grid g ON list_sum(hi) < 1 - 1e-9 OR (
              w1 <= hi[1] + 1e-9 AND w2 <= hi[2] + 1e-9 AND w3 <= hi[3] + 1e-9 AND w4 <= hi[4] + 1e-9 AND w5 <= hi[5] + 1e-9)
         UNION ALL SELECT mod.*, cov.s, 'equal', 0.2, 0.2, 0.2, 0.2, 0.2 FROM mod JOIN cov USING (scan_id)
         UNION ALL SELECT mod.*, cov.s, 'manual', man[1] / list_sum(man), man[2] / list_sum(man), man[3] / list_sum(man), man[4] / list_sum(man), man[5] / list_sum(man)
                   FROM mod JOIN cov USING (scan_id)),
p AS (SELECT scan_id, kind, {_W}, {_RET} AS ret, sqrt(greatest({_VAR}, 0)) AS vol, rf FROM cand),
q AS (SELECT *, CASE WHEN vol > 0 THEN (ret - rf) / vol END AS sharpe, CAST(floor(vol / 0.01) AS BIGINT) AS vb FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY sharpe DESC, w1 DESC, w2 DESC, w3 DESC, w4 DESC) AS rs,
             row_number() OVER (PARTITION BY scan_id ORDER BY vol, w1, w2, w3, w4) AS rv,
             row_number() OVER (PARTITION BY scan_id, vb ORDER BY ret DESC, w1 DESC, w2 DESC, w3 DESC, w4 DESC) AS rr FROM q WHERE kind = 'grid')
SELECT scan_id, 'max_sharpe' AS kind, CAST(NULL AS BIGINT) AS bucket, {_W}, ret, vol, sharpe FROM r WHERE rs = 1
UNION ALL SELECT scan_id, 'min_variance', NULL, {_W}, ret, vol, sharpe FROM r WHERE rv = 1
UNION ALL SELECT scan_id, 'frontier', vb, {_W}, ret, vol, sharpe FROM r WHERE rr = 1
UNION ALL SELECT scan_id, kind, NULL, {_W}, ret, vol, sharpe FROM q WHERE kind <> 'grid'"""


@query("weight_scan", "scan_all", f"SELECT CAST(scan_id AS BIGINT) AS scan_id, kind, bucket, {_RW}, R6(ret) AS ret, R6(vol) AS vol, R6(sharpe) AS sharpe FROM scan_all", held=True)
def _(t):
    return t.scan


@query("risk_target_mix", "scan_all", f"""
WITH fr AS (SELECT * FROM scan_all WHERE kind = 'frontier'),
lim AS (SELECT scan_id, min(vol) AS lo, max(vol) AS hi FROM fr GROUP BY scan_id),
tg AS (SELECT scan_id, lo + (hi - lo) * f AS target, f, lo, hi FROM lim, (SELECT unnest([-0.1, 0.33, 0.66, 1.1]::DOUBLE[]) AS f) s),
lohi AS (SELECT t.scan_id, t.target, max(fr.vol) FILTER (fr.vol < t.target) AS va, min(fr.vol) FILTER (fr.vol >= t.target) AS vb
         FROM tg t JOIN fr ON fr.scan_id = t.scan_id GROUP BY t.scan_id, t.target)
SELECT CAST(l.scan_id AS BIGINT) AS scan_id, R6(target) AS target, {", ".join(
    f"R6(CASE WHEN va IS NULL THEN b.w{i} WHEN vb IS NULL THEN a.w{i} ELSE a.w{i} + (target - va) / (vb - va) * (b.w{i} - a.w{i}) END) AS w{i}" for i in range(1, N + 1))}
FROM lohi l LEFT JOIN fr a ON a.scan_id = l.scan_id AND a.vol = va LEFT JOIN fr b ON b.scan_id = l.scan_id AND b.vol = vb""", held=True)
def _(t):
    front = t.scan.where(F.col("kind") == "frontier")
    lim = front.groupBy("scan_id").agg(F.min("vol").alias("lo"), F.max("vol").alias("hi"))
    f = F.explode(F.array(*[F.lit(x) for x in (-0.1, 0.33, 0.66, 1.1)]))
    targets = lim.withColumn("f", f).select("scan_id", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f")).alias("target"))
    return pf.risk_target_mix(front, targets, N)
