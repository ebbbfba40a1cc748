"""Filters, flags and small projections: column expressions without a shuffle of their own."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.functions.fixed_values import (ASK_COUNTRIES, CODE_SUFFIX, EXCLUDE_CATEGORIES, EXCLUDE_NAME, HEDGED_NAME,
                                             LISTING_SUFFIX, QUOTE_TYPES)
from lodestar.operators.ranking import truthy
from lodestar.params import DEFAULTS, Params

MISSING = "–"            # label of the bucket for missing facet values


def ask_eligible(domicile: Column) -> Column:
    return F.coalesce(domicile.isin(*ASK_COUNTRIES), F.lit(False))


def instrument_flags(u: DataFrame) -> DataFrame:
    name = F.coalesce("name", F.lit(""))
    lev = F.coalesce(F.col("category").isin(*EXCLUDE_CATEGORIES), F.lit(False)) | name.rlike(f"(?i){EXCLUDE_NAME}")
    return (u.withColumn("leveraged", lev).withColumn("hedged", name.rlike(f"(?i){HEDGED_NAME}"))
            .withColumn("accumulating", F.lower(F.coalesce("dividend_policy", F.lit(""))).startswith("akk")))


def one_decimal(x: Column) -> Column:
    """Text of a number >= 0 with one decimal after a comma, rounded by its exact binary value (3.65 is below the tie)."""
    ten = 8 * x + 2 * x
    error = 2 * x - (ten - 8 * x)                    # what the sum above lost
    whole = F.floor(ten)
    part = ten - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    n = (whole + up.cast("int")).cast("long")
    return F.concat(F.floor(n / 10).cast("string"), F.lit(","), (n % 10).cast("string"))


def eligibility_reasons(u: DataFrame, account: str = "ASK", p: Params = DEFAULTS) -> DataFrame:
    """Ordered reasons against choosing an instrument; none means eligible."""
    years = F.coalesce("history_years", F.lit(0.0))
    short = F.concat(F.lit("historikk "), one_decimal(years), F.lit(f" år < {p.min_history_years:g}"))
    why = F.concat_ws(
        "; ", F.when(~F.col("has_prices"), "mangler prisdata").when(years < p.min_history_years, short),
        F.when(~truthy("is_tradable"), "ikke handlebar"), F.when(F.col("leveraged"), "giret/invers/handelsverktøy"),
        F.when(F.lit(account == "ASK") & ~F.coalesce("ask_eligible", F.lit(False)), "ikke ASK-tillatt"))
    return u.withColumn("ineligible_reason", why).withColumn("eligible", F.col("ineligible_reason") == "")


# ------------------------------------------------------------------ list filters

@dataclass(frozen=True)
class EtfFilter:
    q: str = ""
    facets: dict = field(default_factory=dict)       # column -> accepted values (MISSING for null)
    min_history: float = 0
    max_fee: float | None = None
    min_size_m: float | None = None
    hedged: str = "all"
    acc: str = "all"
    esg: str = "all"
    pick: bool = True
    ask: bool = True
    no_leverage: bool = True
    mine_only: bool = False


@dataclass(frozen=True)
class FundFilter:
    q: str = ""
    facets: dict = field(default_factory=dict)
    kind: str = "all"
    max_cost: float | None = None
    min_years: float = 0
    sfdr: str = "all"
    acc: str = "all"
    ask: bool = True
    selection: bool = False
    unhedged: bool = False
    mine_only: bool = False


def _all(conds: list[Column]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & F.coalesce(c, F.lit(False))          # a missing value fails
    return out


def _facets(facets: dict) -> list[Column]:
    return [F.coalesce(F.col(k), F.lit(MISSING)).isin(*v) for k, v in facets.items() if v]


def _contains(q: str, cols: list[str]) -> list[Column]:
    q = q.strip().lower()
    if not q:
        return []
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(q)
    return [hit]


def etf_filter(f: EtfFilter) -> Column:
    """Predicate over etf rows with a boolean column ``mine``."""
    if f.mine_only:
        return F.col("mine")
    conds = _facets(f.facets) + _contains(f.q, ["name", "ticker", "isin"])
    if f.pick:
        conds.append(F.col("pick") | F.col("mine"))
    if f.ask:
        conds.append(F.col("ask_eligible"))
    if f.no_leverage:
        conds.append(~(F.col("leveraged") | (F.coalesce("asset_class", F.lit("")) == "Giret/invers")))
    if f.min_history > 0:
        conds.append(F.col("history_years") >= f.min_history)
    if f.max_fee is not None:
        conds.append(F.col("fee") <= f.max_fee)
    if f.min_size_m is not None:
        conds.append(F.col("fund_size") / 1e6 >= f.min_size_m)
    for want, col in ((f.hedged, "hedged"), (f.esg, "esg")):
        if want != "all":
            conds.append(F.col(col) == (want == "yes"))
    if f.acc != "all":
        conds.append(F.col("acc") == (f.acc == "acc"))
    return _all(conds)


def fund_filter(f: FundFilter) -> Column:
    if f.mine_only:
        return F.col("mine")
    conds = _facets(f.facets) + _contains(f.q, ["name", "company", "isin", "ticker"])
    if f.ask:
        conds.append(F.col("ask"))
    if f.selection:
        conds.append(F.col("selection"))
    if f.unhedged:
        conds.append(~F.col("hedged"))
    if f.kind != "all":
        conds.append(F.col("is_index") == (f.kind == "index"))
    if f.max_cost is not None:
        conds.append(F.col("cost") <= f.max_cost)
    if f.min_years > 0:
        conds.append(F.col("years") >= f.min_years)
    if f.sfdr == "8":
        conds.append(F.col("sfdr") >= 8)
    if f.sfdr == "9":
        conds.append(F.col("sfdr") == 9)
    if f.acc != "all":
        conds.append(F.col("acc") == (f.acc == "acc"))
    return _all(conds)


def product_search(products: DataFrame, q: str, held: DataFrame, n: int = 12) -> DataFrame:
    """Products whose name, ticker, id and kind contain every word; most owners first."""
    words = F.filter(F.split(F.lit(q.lower()), r"\s+"), lambda w: w != "")
    hay = F.lower(F.concat_ws(" ", "name", "ticker", "id", "kind_label"))
    hits = products.where(~F.col("leveraged") & F.col("tradable") & (F.size(words) > 0)).withColumn("_hay", hay)
    return (hits.where(F.forall(words, lambda w: F.contains(F.col("_hay"), w))).join(held.select("id"), "id", "left_anti")
            .drop("_hay").orderBy(F.coalesce("owners", F.lit(0)).desc(), "id").limit(n))


def is_rate(c: str = "asset_class") -> Column:
    return F.coalesce(F.col(c).isin("Renter", "Pengemarked"), F.lit(False))


def product_view(etfs: DataFrame, funds: DataFrame) -> DataFrame:
    """ETFs and funds under one schema; an ETF has a cluster only when the cluster has other members."""
    sizes = etfs.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    e = etfs.join(sizes, "cluster_id").select(
        F.col("isin").alias("id"), F.lit("etf").alias("kind"), "name", "ticker", F.col("fee").alias("cost"), "asset_class", "category",
        (F.coalesce("style", F.lit("")) != "Aktiv").alias("is_index"), F.coalesce("ask_eligible", F.lit(False)).alias("ask"), "hedged",
        (F.col("leveraged") | (F.col("asset_class") == "Giret/invers")).alias("leveraged"), "owners",
        F.when(F.col("cluster_size") > 1, F.col("cluster_id")).alias("cluster"), "currency", F.lit(True).alias("tradable"),
        "r1", "r3", "r5", "r10", F.coalesce("vol5", "vol3", "vol1").alias("vol"),
        F.when(is_rate(), "Rente-ETF").otherwise("ETF").alias("kind_label"))
    label = (F.when(is_rate(), "Rentefond").when(F.col("is_index"), "Indeksfond")
             .when(F.col("asset_class") == "Blandet", "Kombinasjonsfond").otherwise("Aktivt fond"))
    f = funds.select(
        F.col("isin").alias("id"), F.lit("fond").alias("kind"), "name", F.lit("").alias("ticker"), "cost", "asset_class", "category", "is_index",
        F.coalesce("ask", F.lit(False)).alias("ask"), "hedged", F.lit(False).alias("leveraged"), "owners",
        F.lit(None).cast("long").alias("cluster"), "currency", F.coalesce("tradable", F.lit(True)).alias("tradable"),
        "r1", "r3", "r5", "r10", F.coalesce("vol5", "vol3", "vol1").alias("vol"), label.alias("kind_label"))
    return e.unionByName(f)


def broad_flag(products: DataFrame, alloc: DataFrame) -> DataFrame:
    """Broad building blocks: quiet interest products, mixed ones, and index equity spread over regions and sectors."""
    spread = alloc.where(F.col("kind").isin("reg", "sec")).groupBy(F.col("isin").alias("id")).agg(
        F.count_if((F.col("kind") == "reg") & (F.col("weight") >= 4)).alias("regions"),
        F.max(F.when(F.col("kind") == "sec", F.col("weight"))).alias("top_sector"))
    quiet = F.coalesce(F.col("vol") <= 0.03, F.lit(False))
    wide = (F.col("is_index") & (F.col("asset_class") == "Aksjer") & (F.col("regions") >= 3)
            & (F.coalesce("top_sector", F.lit(0.0)) <= 40))
    broad = F.when(is_rate(), quiet).when(F.col("asset_class") == "Blandet", True).otherwise(F.coalesce(wide, F.lit(False)))
    return products.join(spread, "id", "left").select("id", broad.alias("broad"))


def benchmark_candidates(etfs: DataFrame, n: int = 40) -> DataFrame:
    ok = ((F.col("asset_class") == "Aksjer") & (F.col("region") == "Global") & (F.col("sector") == "Bred") & (F.col("style") == "Markedsvektet")
          & ~F.col("hedged") & ~F.col("esg") & ~F.col("leveraged") & (F.col("history_years") >= 5) & F.col("live_to_end") & F.col("has_prices"))
    return etfs.where(ok).orderBy(F.coalesce("fund_size", F.lit(0.0)).desc(), "isin").limit(n)


def proxy_candidates(etfs: DataFrame, min_months: int = 36) -> DataFrame:
    return etfs.where(F.col("has_prices") & ~F.col("leveraged") & (F.col("asset_class") != "Giret/invers") & F.col("live_to_end")
                      & (F.col("n_months") >= min_months))


# ------------------------------------------------------------------ symbols

def price_symbol(symbol: Column, suffix: Column) -> Column:
    """Exchange symbol with the suffix of its exchange; null without a symbol."""
    s = F.regexp_replace(F.upper(F.trim(symbol)), "[ /]", "-")
    return F.when(s != "", F.concat(s, suffix))


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def listing_candidates(listings: DataFrame) -> DataFrame:
    """(isin, ticker, pos) from a listing's slug and its symbols; the exchange is the slug's last part."""
    exch = F.when(F.col("slug").contains("-"), F.lower(F.element_at(F.split("slug", "-"), -1)))
    sym = listings.withColumn("suffix", _lookup(LISTING_SUFFIX, exch)).where(F.col("suffix").isNotNull())
    out = sym.select("isin", "suffix", F.posexplode(F.array("identifier", "symbol")).alias("pos", "s"))
    return (out.withColumn("ticker", price_symbol(F.col("s"), F.col("suffix"))).where(F.col("ticker").isNotNull())
            .groupBy("isin", "ticker").agg(F.min("pos").cast("long").alias("pos")))


def code_candidates(items: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(isin, ticker, place) from exchange code lists: by exchange priority, at most two per suffix."""

    prio = _lookup({k: i for i, k in enumerate(CODE_SUFFIX)}, F.col("exch"))
    t = (items.withColumn("prio", prio).withColumn("ticker", price_symbol(F.col("code"), _lookup(CODE_SUFFIX, F.col("exch"))))
         .where(F.col("ticker").isNotNull()))
    first = (t.groupBy("isin", "ticker").agg(F.min(F.struct("prio", "pos", "ticker")).alias("at"))
             .withColumn("suffix", F.substring_index("ticker", ".", -1)))
    top = (first.withColumn("n", F.row_number().over(W.partitionBy("isin", "suffix").orderBy("at")))
           .where(F.col("n") <= p.per_suffix))
    return top.select("isin", "ticker", F.row_number().over(W.partitionBy("isin").orderBy("at")).cast("long").alias("place"))


def search_candidates(quotes: DataFrame) -> DataFrame:
    return (quotes.where(F.col("symbol").isNotNull() & F.col("quote_type").isin(*QUOTE_TYPES))
            .groupBy("isin", F.col("symbol").alias("ticker")).agg(F.min("pos").alias("pos")))


def covers_start(first_date: Column, fund_start: Column, ok: Column, p: Params = DEFAULTS) -> Column:
    """History starts within the slack after the fund's start (not before the data floor); missing is false."""
    start = F.when(fund_start.isNotNull(), F.greatest(fund_start, F.lit(p.history_floor).cast("date")))
    return F.coalesce(ok & (first_date <= F.date_add(start, p.start_slack_days)), F.lit(False))
