"""What funds own: compact allocations, similarity, look-through, twins, proxies, suggestions.

Holdings are long rows (isin, kind, label, weight) with kind reg / sec / ast / top. A fund's record is one row
with four small maps, bounded by the labels one fund reports.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.functions.scalars import js_round, number
from lodestar.operators import bands, overlap
from lodestar.operators.predicates import is_rate
from lodestar.params import DEFAULTS, Params
from lodestar.session import ship, spread, stored, task_count

EQUITY = "Aksjer"        # asset-class label of shares in allocations


# ------------------------------------------------------------------ records

def allocation_compact(raw: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(isin, kind, label, weight) from raw JSON answers.

    Allocation slices below 0.05 in size are dropped, the same label is summed, two decimals; holdings need a
    positive weight."""
    slices = "array<struct<type:string,weight:string>>"
    schema = (f"struct<regional_allocation:{slices},sector_allocation:{slices},asset_allocation:{slices},"
              "instrument_underlying_info:array<struct<instrument_id:string,weight:string>>>")
    j = raw.select("isin", F.from_json("json", schema).alias("j"))

    def part(kind: str, field: str, name: str) -> Column:
        row = lambda x: F.struct(F.lit(kind).alias("kind"), x[name].alias("label"), number(x["weight"]).alias("weight"))
        return F.transform(F.coalesce(F.col(f"j.{field}"), F.array()), row)

    items = [part(*a) for a in (("reg", "regional_allocation", "type"), ("sec", "sector_allocation", "type"),
                                 ("ast", "asset_allocation", "type"), ("top", "instrument_underlying_info", "instrument_id"))]
    rows = j.select("isin", F.explode(F.concat(*items)).alias("_row")).select("isin", "_row.*")
    top = F.col("kind") == "top"
    keep = F.when(top, (F.col("weight") > 0) & F.col("label").try_cast("long").isNotNull()).otherwise(F.abs("weight") >= p.min_alloc)
    rows = rows.where(F.col("label").isNotNull() & (F.col("label") != "") & keep)
    return rows.groupBy("isin", "kind", "label").agg(F.round(F.sum("weight"), 2).alias("weight"))


def holdings_export(top: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holdings with a name, and the names in use; unnamed holdings are left out."""
    named = names.where(F.col("name").isNotNull() & (F.col("name") != ""))
    items = top.join(named.select("holding_id"), "holding_id", "left_semi")
    return items, named.join(items.select("holding_id"), "holding_id", "left_semi")


def shares(alloc: DataFrame) -> DataFrame:
    """Positive allocation weights as shares of their kind."""
    pos = alloc.where((F.col("weight") > 0) & (F.col("kind") != "top"))
    total = pos.groupBy("isin", "kind").agg(F.sum("weight").alias("_t"))
    return pos.join(total, ["isin", "kind"]).select("isin", "kind", "label", (F.col("weight") / F.col("_t")).alias("share"))


def records(alloc: DataFrame) -> DataFrame:
    """One row per fund: reg, sec, ast as share maps and top as a weight map; a missing part is null."""
    def part(kind: str) -> Column:
        w = F.col("weight")
        keep = (F.col("kind") == kind) if kind == "top" else (F.col("kind") == kind) & (w > 0)
        return F.map_from_entries(F.collect_list(F.when(keep, F.struct("label", "weight")))).alias(kind)

    r = alloc.groupBy("isin").agg(*[part(k) for k in ("reg", "sec", "ast", "top")])
    for k in ("reg", "sec", "ast"):
        r = (r.withColumn("_sum", F.aggregate(F.map_values(k), F.lit(0.0), lambda a, x: a + x))
             .withColumn(k, F.when(F.size(k) > 0, F.transform_values(k, lambda _, v: v / F.col("_sum")))).drop("_sum"))
    return r.withColumn("top", F.when(F.size("top") >= 5, F.col("top")))


# ------------------------------------------------------------------ similarity

def _common(a: str, b: str) -> Column:
    zero = F.lit(0.0)
    both = F.map_zip_with(a, b, lambda _, x, y: F.least(F.coalesce(x, zero), F.coalesce(y, zero)))
    return F.aggregate(F.map_values(both), zero, lambda s, v: s + v)


def _sum(m: str) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v)


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Adds reg, sec, ast, top overlaps and the score to rows that carry two records (suffix _a and _b)."""
    for k in ("reg", "sec", "ast"):
        pairs = pairs.withColumn(k, F.when(F.col(f"{k}_a").isNotNull() & F.col(f"{k}_b").isNotNull(), _common(f"{k}_a", f"{k}_b")))
    den = F.least(_sum("top_a"), _sum("top_b"))
    pairs = pairs.withColumn("top", F.when(F.col("top_a").isNotNull() & F.col("top_b").isNotNull() & (den > 0),
                                           F.least(F.lit(1.0), _common("top_a", "top_b") / den)))
    alloc = (F.coalesce("reg", F.lit(0.0)) + F.coalesce("sec", F.lit(0.0))) / (
        F.col("reg").isNotNull().cast("int") + F.col("sec").isNotNull().cast("int"))
    has = F.col("reg").isNotNull() | F.col("sec").isNotNull()
    base = F.when(has, alloc).otherwise(F.col("top"))
    score = F.when(F.col("top").isNotNull(), 0.5 * base + 0.5 * F.col("top")).otherwise(base) * F.coalesce("ast", F.lit(1.0))
    score = F.when(~has & F.col("top").isNull(), 0.5 * F.col("ast")).otherwise(score)
    return pairs.withColumn("score", score).drop(*[f"{k}_{s}" for k in ("reg", "sec", "ast", "top") for s in "ab"])


PARTS = ("reg", "sec", "ast", "top")
SCORES = 1 << 14     # pairs a task scores: much work on few bytes


def scored(pairs: DataFrame, rec: DataFrame) -> DataFrame:
    """Scores of pairs (id_a, id_b) of records; each pair once, written before any filter: pushed below the projection, a filter
    would score every pair several times."""
    side = lambda s: rec.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", *PARTS)])
    pairs = stored(pairs)
    dealt = pairs.repartition(task_count(pairs, F.lit(1 / SCORES)), "id_a", "id_b")
    return stored(score_pairs(dealt.join(side("a"), "id_a").join(side("b"), "id_b")))


def copies(alloc: DataFrame) -> DataFrame:
    """(id, rep): the least id of the funds that report the same holdings, each weight equal to twelve significant digits (weights
    are ratios of sums, which differ in the last digits with the order of adding up). Only ``rep`` is compared with others."""
    item = F.struct("kind", "label", F.format_string("%.11e", "weight").alias("w"))
    per = alloc.groupBy(F.col("isin").alias("id")).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(item))), 256).alias("_same"))
    return stored(per.join(per.groupBy("_same").agg(F.min("id").alias("rep")), "_same").select("id", "rep"))


def _of_reps(alloc: DataFrame, same: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holdings of the representatives, and (id_a, id_b) of those that have copies, each with itself."""
    own = alloc.join(same.select(F.col("rep").alias("isin")).distinct(), "isin", "left_semi")
    itself = same.groupBy("rep").count().where("count > 1").select(F.col("rep").alias("id_a"), F.col("rep").alias("id_b"))
    return own, itself


def _members(pairs: DataFrame, same: DataFrame) -> DataFrame:
    """Pairs of representatives (id_a <= id_b) as the pairs of all funds, each once with id_a < id_b."""
    rest = [c for c in pairs.columns if c not in ("id_a", "id_b")]
    side = lambda s: same.select(F.col("rep").alias(f"id_{s}"), F.col("id").alias(f"_{s}"))
    both = pairs.join(side("a"), "id_a").join(side("b"), "id_b").where((F.col("id_a") != F.col("id_b")) | (F.col("_a") < F.col("_b")))
    return both.select(F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b"), *rest)


def _similar_reps(alloc: DataFrame, same: DataFrame, least: float) -> DataFrame:
    own, itself = _of_reps(alloc, same)
    rec = stored(records(own).withColumnRenamed("isin", "id"))
    return scored(overlap.candidates(own, least).unionByName(itself), rec).where(F.col("score") >= least)


def similar_pairs(alloc: DataFrame, least: float) -> DataFrame:
    """(id_a < id_b) with reg, sec, ast, top and score: every pair of funds that scores ``least`` (above 0) or more, those with missing
    parts among them. Funds that report the same are compared once."""
    same = copies(alloc)
    return _members(_similar_reps(alloc, same, least), same)


def similar_fitting(alloc: DataFrame, products: DataFrame, least: float) -> DataFrame:
    """Similar pairs in both directions of which b may replace a."""
    same = copies(alloc)
    return fitting(_similar_reps(alloc, same, least), products, same)


def both_ways(pairs: DataFrame) -> DataFrame:
    rest = [c for c in pairs.columns if c not in ("id_a", "id_b")]
    return pairs.unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), *rest))


def _near_reps(alloc: DataFrame, same: DataFrame, p: Params) -> DataFrame:
    """Scored pairs of representatives that own nearly the same: found by one region and one sector of their prefixes, checked by all
    regions, then all sectors; what is left is scored by everything."""
    own, itself = _of_reps(alloc, same)
    rec = stored(records(own).withColumnRenamed("isin", "id"))
    index = stored(overlap.lists(own.where(F.col("kind") != "top")))
    side = lambda s: rec.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "reg", "sec")])
    near = overlap.reaching(index, {"reg": p.twin_reg, "sec": p.twin_sec}).join(side("a"), "id_a").join(side("b"), "id_b")
    near = near.where(_common("reg_a", "reg_b") >= p.twin_reg - overlap.SLACK).where(_common("sec_a", "sec_b") >= p.twin_sec - overlap.SLACK)
    return scored(near.select("id_a", "id_b").unionByName(itself), rec).where(is_twin(p))


def similar_within(alloc: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Scored pairs (id_a, id_b, in both directions) that own nearly the same. Funds that report the same are compared once."""
    same = copies(alloc)
    return both_ways(_members(_near_reps(alloc, same, p), same))


def is_twin(p: Params = DEFAULTS) -> Column:
    ok = (F.col("reg") >= p.twin_reg) & (F.col("sec") >= p.twin_sec) & (F.col("top") >= p.twin_top) & (
        F.col("ast").isNull() | (F.col("ast") >= p.twin_ast))
    return F.coalesce(ok, F.lit(False))


# ------------------------------------------------------------------ twins

def fits(p_cols: str = "_a", c_cols: str = "_b") -> Column:
    """What a twin candidate must satisfy besides class and hedging, which are join keys."""
    a, b = (lambda c: F.col(f"{c}{p_cols}")), (lambda c: F.col(f"{c}{c_cols}"))
    return ~b("leveraged") & b("tradable") & (~a("ask") | b("ask")) & b("cost").isNotNull() & (a("id") != b("id"))


def _two_sides(products: DataFrame, keys: list[str], cols: list[str]) -> tuple[DataFrame, DataFrame]:
    def side(s: str) -> DataFrame:
        return products.select(*keys, *[F.col(c).alias(f"{c}{s}") for c in cols])
    return side("_a"), side("_b")


FACTS = ["id", "leveraged", "tradable", "ask", "cost", "owners", "cluster"]


def same_index(products: DataFrame) -> DataFrame:
    """Pairs on the same index: an equi-join on (cluster, class, hedging), large clusters in blocks, with the residual conditions."""
    own = products.where(F.col("cluster").isNotNull()).withColumn("_c", F.col("cluster"))
    keys = ["_c", "asset_class", "hedged"]
    a, b = _two_sides(own, keys, FACTS)
    return overlap.salted(a, b, keys).where(fits()).select("id_a", "id_b")


def cheaper_candidates(products: DataFrame, p: Params = DEFAULTS, block: int = bands.BLOCK) -> DataFrame:
    """(id_a, id_b): for every product with a cost, all products of its class and hedging that may replace it and cost less by more
    than ``twin_cheaper``: a join on sorted cost ranges."""
    return bands.below(products.select("asset_class", "hedged", *FACTS), ["asset_class", "hedged"], "cost", p.twin_cheaper, FACTS, block).where(fits()).select("id_a", "id_b")


def best_same_index(products: DataFrame) -> DataFrame:
    """Per product the first twin on its own index: a list shows one instrument per index, so two leaders per
    (cluster, class, hedging) are enough, one to show and one for the leader itself. Linear in the cluster."""
    keys = ["cluster", "asset_class", "hedged", "needs_ask"]
    ok = products.where(F.col("cluster").isNotNull() & ~F.col("leveraged") & F.col("tradable") & F.col("cost").isNotNull())
    lists = ok.withColumn("needs_ask", F.explode(F.when(F.col("ask"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    order = F.struct("cost", (-F.coalesce("owners", F.lit(0))).alias("o"), "id")
    first = (lists.withColumn("ord", order).withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy("ord")))
             .where(F.col("_i") <= 2).select(*keys, "ord", F.col("id").alias("id_b")))
    own = products.where(F.col("cluster").isNotNull()).select("cluster", "asset_class", "hedged", F.col("ask").alias("needs_ask"), F.col("id").alias("id_a"))
    return own.join(first, keys).where(F.col("id_a") != F.col("id_b")).groupBy("id_a").agg(F.min_by("id_b", "ord").alias("id_b"))


def rate_twins(products: DataFrame, gap: float = 0.006, ratio: float = 1.3, quiet: float = 0.01, block: int = bands.BLOCK) -> DataFrame:
    """Interest products of one category and currency with nearly the same gross return and swings.

    The return is compared over 5 years when both have it, else over 3. Pairs come from sorted ranges of the return, each once,
    and are then taken in both directions."""
    return _rate_pairs(products, FACTS, gap, ratio, quiet, block).select("id_a", "id_b")


def _rate_pairs(products: DataFrame, facts: list[str], gap: float = 0.006, ratio: float = 1.3, quiet: float = 0.01, block: int = bands.BLOCK) -> DataFrame:
    base = products.where(is_rate() & F.col("vol").isNotNull() & F.col("cost").isNotNull())
    keys, found = ["asset_class", "hedged", "category", "currency"], []
    for y in ("r5", "r3"):
        g = base.withColumn("g", F.col(y) + F.col("cost") / 100)
        lo, hi = F.least("vol_a", "vol_b"), F.greatest("vol_a", "vol_b")
        near = (hi < quiet) | (hi / F.greatest(lo, F.lit(1e-6)) <= ratio)
        both5 = F.col("r5_a").isNotNull() & F.col("r5_b").isNotNull()
        found.append(bands.near(g, keys, "g", gap, [*facts, "vol", "r5"], block).where(near & (both5 if y == "r5" else ~both5)))
    cols = [f"{c}_{x}" for c in facts for x in "ab"]
    once = found[0].select(*cols).unionByName(found[1].select(*cols))
    other = once.select(*[F.col(f"{c}_{y}").alias(f"{c}_{x}") for c in facts for x, y in (("a", "b"), ("b", "a"))])
    return once.unionByName(other).where(fits())


def content_twins(products: DataFrame, alloc: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Scored pairs that own nearly the same, in the same class and hedging."""
    same = copies(alloc)
    return fitting(_near_reps(alloc, same, p), products, same)


def fitting(pairs: DataFrame, products: DataFrame, same: DataFrame, cols: list[str] = FACTS) -> DataFrame:
    """Pairs (id_a, id_b) of products of which b may replace a, from scored pairs of representatives (each once). The members of a
    are few rows; they meet those of b in blocks spread by their pairs, and these rows are not shuffled."""
    keys = ["asset_class", "hedged"]
    a, b = _two_sides(products, keys, cols)
    side = lambda df, s: df.join(same.select(F.col("id").alias(f"id_{s}"), F.col("rep").alias(f"rep_{s}")), f"id_{s}")
    once = pairs.withColumnsRenamed({"id_a": "rep_a", "id_b": "rep_b"})
    other = once.where("rep_a <> rep_b").select(*[F.col({"rep_a": "rep_b", "rep_b": "rep_a"}.get(c, c)).alias(c) for c in once.columns])
    left = stored(once.unionByName(other).join(side(a, "a"), "rep_a"))
    return overlap.salted(left, stored(side(b, "b")), ["rep_b", *keys]).where(fits()).drop("rep_a", "rep_b", *keys)


def twins(products: DataFrame, alloc: DataFrame, held: DataFrame, every: bool = False, p: Params = DEFAULTS) -> DataFrame:
    """(id, twin, cost, score, rule) for held products: same index, same content or same kind of interest fund.

    One ETF per index; only cheaper ones unless ``every``. ``place`` is the order of the list. A pair of products with ids of their own whose
    twin has no index competes with no other: its row comes as the rule makes it, and a pair of two rules is left to the first by the
    representatives of its holdings. Only the other rows are shuffled, once, by product."""
    same = copies(alloc)
    n = products.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    facts = (products.join(n, "id").withColumn("once", F.col("_n") == 1).drop("_n").join(held.select("id").distinct().withColumn("held", F.lit(True)), "id", "left")
             .join(same, "id", "left"))
    facts = stored(facts.withColumn("held", F.col("held").isNotNull()))
    cols = [*FACTS, "once", "held"]
    near = _near_reps(alloc, same, p)
    both = stored(near.select(F.col("id_a").alias("rep_a"), F.col("id_b").alias("rep_b")).union(near.select("id_b", "id_a")).distinct())
    alike = fitting(near.select("id_a", "id_b", "score").dropDuplicates(["id_a", "id_b"]), facts, same, cols).withColumn("rule", F.lit(1))
    rates = _rate_pairs(facts, [*cols, "rep"]).withColumn("score", F.lit(0.8)).withColumn("rule", F.lit(2))
    own = F.col("once_a") & F.col("once_b")
    cheaper = F.lit(True) if every else ~own | (F.col("cost_b") < F.col("cost_a") - p.twin_cheaper)
    alone = own & F.col("cluster_b").isNull()
    rows = lambda df: df.where(F.col("held_a") & cheaper)
    out = lambda df: df.select(F.col("id_a").alias("id"), F.col("id_b").alias("twin"), F.col("cost_b").alias("cost"), F.col("cost_a").alias("own_cost"), "score", "rule")
    single = out(rows(alike).where(alone)).unionByName(out(rows(rates).where(alone).join(both, ["rep_a", "rep_b"], "left_anti")))

    # what is left: products in an index, or ids that are not unique
    known = F.when(own, F.struct(F.col("cost_b").alias("cost"), F.col("owners_b").alias("owners"), F.col("cluster_b").alias("cluster"), F.col("cost_a").alias("own_cost"))).alias("f")
    some = lambda df: rows(df).where(~alone).select("id_a", "id_b", "score", "rule", known)
    index = best_same_index(products).join(held.select(F.col("id").alias("id_a")), "id_a", "left_semi").select("id_a", "id_b", F.lit(1.0).alias("score"), F.lit(0).alias("rule"))
    best = (some(alike).unionByName(some(rates)).unionByName(index, allowMissingColumns=True).repartition("id_a").groupBy("id_a", "id_b")
            .agg(F.min_by("score", "rule").alias("score"), F.min("rule").alias("rule"), F.max("f").alias("f")))
    best = stored(best)
    b_side = products.select(F.col("id").alias("id_b"), "cost", "owners", "cluster")
    a_side = products.select(F.col("id").alias("id_a"), F.col("cost").alias("own_cost"))
    full = best.where("f IS NOT NULL").select("id_a", "id_b", "score", "rule", "f.*").unionByName(
        best.where("f IS NULL").drop("f").join(b_side, "id_b").join(a_side, "id_a"))
    # the cheapest of each index stands for it
    order = F.struct("cost", (-F.col("score")).alias("s"), (-F.coalesce("owners", F.lit(0))).alias("o"), "id_b")
    one = F.coalesce(F.concat(F.lit("c"), F.col("cluster").cast("string")), "id_b")
    group = (full.withColumn("ord", order).groupBy("id_a", one.alias("_k"))
             .agg(F.min_by(F.struct("id_b", "cost", "score", "rule", "own_cost"), "ord").alias("_row")).select("id_a", "_row.*"))
    if not every:
        group = group.where(F.col("own_cost").isNotNull() & (F.col("cost") < F.col("own_cost") - p.twin_cheaper))
    return single.unionByName(group.select(F.col("id_a").alias("id"), F.col("id_b").alias("twin"), "cost", "own_cost", "score", "rule"))


def cheapest_twin(twin_rows: DataFrame) -> DataFrame:
    return twin_rows.groupBy("id").agg(F.min("cost").alias("twin_cost"))


def weighted_cost(weights: DataFrame, products: DataFrame, cheapest: DataFrame) -> DataFrame:
    """Portfolio cost as held and with the cheapest twins (percent). Costs are a table of the held products only: while it is
    small, weights that lie by portfolio are summed where they are."""
    held = products.select(F.col("id").alias("isin"), "cost").join(weights.select("isin").distinct(), "isin", "left_semi")
    j = weights.join(stored(held.join(cheapest.withColumnRenamed("id", "isin"), "isin", "left")), "isin")
    return j.groupBy("portfolio_id").agg(F.sum(F.col("w") * F.coalesce("cost", F.lit(0.0))).alias("cost"),
                                         F.sum(F.col("w") * F.coalesce("twin_cost", "cost", F.lit(0.0))).alias("cheapest_cost"))


# ------------------------------------------------------------------ look-through

LOOK = 1 << 20       # rows of weights that a task looks through, in expectation
ITEMS = 1 << 21      # products of weights and items it holds at a time
BLOCKED = "_block"   # column of weights whose portfolios are cut into blocks, and lie in them


def block_count(rows: int) -> int:
    return 1 + rows // LOOK


def in_blocks(df: DataFrame, portfolio: str, blocks: int) -> DataFrame:
    """``df`` with its portfolios dealt into ``blocks``; a block lies in one task."""
    return df.withColumn(BLOCKED, F.pmod(F.xxhash64(portfolio, F.lit(7)), F.lit(blocks).cast("long"))).repartition(BLOCKED)


def _look_items(alloc: DataFrame) -> DataFrame:
    """(isin, items): what one unit of a fund adds to each (kind, label); totals are items too."""
    def total(kind: str, cond: Column | None = None) -> Column:
        hit = (F.col("kind") == kind) & (F.col("weight") > 0)
        return F.sum(F.when(hit if cond is None else hit & cond, F.col("weight")))

    rows = F.collect_list(F.struct("kind", "label", "weight")).alias("rows")
    facts = alloc.groupBy("isin").agg(
        total("reg").alias("reg_sum"), total("sec").alias("sec_sum"), total("ast").alias("ast_sum"),
        total("ast", F.col("label") == EQUITY).alias("eq_sum"), F.sum(F.when(F.col("kind") == "top", F.col("weight"))).alias("top_sum"), rows)
    # all equity when a fund reports no asset classes
    facts = facts.withColumn("eq", F.when(F.col("ast_sum").isNull(), 1.0).otherwise(F.coalesce("eq_sum", F.lit(0.0)) / F.col("ast_sum")))

    def item(x: Column) -> Column:
        kind, weight = x["kind"], x["weight"]
        share = (F.when(kind == "top", weight / 100).when(weight <= 0, None).when(kind == "ast", weight / F.col("ast_sum"))
                 .when(F.col("eq") <= 0, None).when(kind == "reg", F.col("eq") * weight / F.col("reg_sum")).otherwise(F.col("eq") * weight / F.col("sec_sum")))
        return F.struct(F.when(kind == "top", "company").otherwise(kind).alias("kind"), x["label"].alias("label"), share.alias("unit"))

    one = lambda label, unit: F.struct(F.lit("total").alias("kind"), F.lit(label).alias("label"), unit.alias("unit"))
    totals = F.array(one("covered", F.lit(1.0)), one("equity", F.when(F.col("reg_sum").isNotNull(), F.col("eq")).otherwise(0.0)),
                     one("top_covered", F.least(F.lit(1.0), F.coalesce("top_sum", F.lit(0.0)) / 100)))
    return facts.select("isin", F.filter(F.concat(F.transform("rows", item), totals), lambda x: x["unit"].isNotNull()).alias("items"))


def _codes(values: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Place of each value among the different ones, a null among them."""
    coded = values.combine_chunks().dictionary_encode(null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(False).astype(np.int64), coded.dictionary


def _look_block(held: pa.Table, funds: pa.Table) -> pa.Table:
    """Shares of the portfolios of one block: sums of weight times unit per portfolio, kind and label. ``funds``: isin, rep and the
    items of ``rep`` on its own row. Weights are taken in order of their portfolios, some ``ITEMS`` products at a time."""
    places = funds.column("isin").combine_chunks()
    rep, names = _codes(pa.chunked_array([*funds.column("rep").chunks, *funds.column("isin").chunks]) if funds.num_rows else funds.column("rep"))
    rep, own = rep[:funds.num_rows], rep[funds.num_rows:]
    lists = funds.column("items").combine_chunks()
    has = np.flatnonzero(lists.is_valid().to_numpy(False))
    flat = lists.flatten()
    size = np.zeros(len(names), np.int64)
    size[own[has]] = lists.value_lengths().to_numpy(False)[has].astype(np.int64)
    begin = np.zeros(len(names), np.int64)
    begin[own[has]] = np.cumsum(size[own[has]]) - size[own[has]]
    kind, kinds = _codes(pa.chunked_array([flat.field("kind")]))
    label, labels = _codes(pa.chunked_array([flat.field("label")]))
    unit = flat.field("unit").to_numpy(False)
    cell, column = np.unique(kind * max(1, len(labels)) + label, return_inverse=True)
    kind, label = cell // max(1, len(labels)), cell % max(1, len(labels))
    scaled = np.array([k in ("reg", "sec") for k in kinds.to_pylist()], bool)

    fund = pc.index_in(held.column("isin"), value_set=places, skip_nulls=True).fill_null(-1).to_numpy().astype(np.int64)
    folio, folios = _codes(held.column("portfolio_id"))
    w = held.column("w").to_numpy()
    use = np.flatnonzero(fund >= 0)
    use = use[np.argsort(folio[use], kind="stable")]
    folio, w, fund = folio[use], w[use], rep[fund[use]]
    upto = np.cumsum(size[fund])
    parts, i = [], 0
    while i < len(folio):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + ITEMS)))
        j = int(np.searchsorted(folio, folio[min(j, len(folio)) - 1], "right"))           # whole portfolios
        n = size[fund[i:j]]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[fund[i:j]], n)
        first = folio[i]
        key = np.repeat(folio[i:j] - first, n) * len(cell) + column[at]
        share = np.repeat(w[i:j], n) * unit[at]
        cells = int(folio[j - 1] - first + 1) * len(cell)
        if cells <= 4 * len(key):
            seen = np.flatnonzero(np.bincount(key, minlength=cells))
            sums = np.bincount(key, share, cells)[seen]
        else:                                                                             # many labels, few of them in a portfolio
            seen, back = np.unique(key, return_inverse=True)
            sums = np.bincount(back, share, len(seen))
        who, what = first + seen // len(cell), seen % len(cell)
        # regions and sectors as shares of their own sum
        group = (who - first) * len(kinds) + kind[what]
        whole = np.bincount(group, sums, int(folio[j - 1] - first + 1) * len(kinds))[group]
        parts.append((who, what, np.divide(sums, whole, out=sums.copy(), where=scaled[kind[what]] & (whole > 0))))
        i = j
    who, what, share = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"portfolio_id": folios.take(pa.array(who)), "kind": kinds.take(pa.array(kind[what])), "label": labels.take(pa.array(label[what])), "share": share})


def look_through(weights: DataFrame, alloc: DataFrame, kinds: list[str] | None = None, blocks: int | None = None) -> DataFrame:
    """(portfolio_id, kind, label, share): asset classes, regions and sectors of the equity part, companies, totals; or only some ``kinds``.

    The product of two sparse matrices, weights and what a unit of a fund holds: portfolios are cut into blocks of about ``LOOK``
    weights, each block gets the holdings once, and its sums are made in arrays. Weights are shuffled once, a held fund's labels
    never become rows, and what is copied is the table of holdings, as often as there are blocks. Funds that report the same are
    one list in it. Weights that lie in ``blocks`` already (``in_blocks``) are not shuffled again."""
    if blocks is None:
        weights = stored(weights.select("portfolio_id", "isin", "w"))
        blocks = block_count(weights.count())
        weights = in_blocks(weights, "portfolio_id", blocks)
    same = copies(alloc)
    items = _look_items(_of_reps(alloc, same)[0])
    if kinds is not None:
        items = items.withColumn("items", F.filter("items", lambda x: x["kind"].isin(kinds)))
    funds = stored(same.join(items.withColumnRenamed("isin", "id"), "id", "left").select(F.col("id").alias("isin"), "rep", "items"))
    everywhere = funds.withColumn(BLOCKED, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    held = weights.where(F.col("w") > 0).select(BLOCKED, "portfolio_id", "isin", "w")
    ship(weights.sparkSession)
    who = held.schema["portfolio_id"].dataType.simpleString()
    return held.groupBy(BLOCKED).cogroup(everywhere.groupBy(BLOCKED)).applyInArrow(_look_block, f"portfolio_id {who}, kind string, label string, share double")


def clean_company(name: Column) -> Column:
    """Company name without share class, legal form and trailing punctuation."""
    s = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i),?\s+(class|cl\.?|ser\.?|series)\s+[a-c]\b\.?", "")
    s = F.regexp_replace(s, r"(?i)\s+(inc\.?|corp\.?|corporation|plc|ltd\.?|asa|ab|a/s|oyj|n\.v\.|se|ag)\.?$", "")
    s = F.trim(F.regexp_replace(s, r"[,.\s]+$", ""))
    return F.when(s.rlike("^.{4,} [A-C]$"), F.substring(s, F.lit(1), F.length(s) - 2)).otherwise(s)


def company_merge(companies: DataFrame, names: DataFrame) -> DataFrame:
    """Company shares per cleaned name, with the country of the largest line."""
    j = companies.join(names.select(F.col("holding_id").cast("string").alias("label"), "name", "country"), "label")
    return j.groupBy("portfolio_id", clean_company(F.col("name")).alias("name")).agg(
        F.sum("share").alias("share"), F.max_by("country", F.struct("share", "label")).alias("country"))


def overlap_pairs(weights: DataFrame, alloc: DataFrame, least: float = 0.7, block: int = overlap.BLOCK) -> DataFrame:
    """Pairs of funds in one portfolio that own mostly the same (score of ``least`` or more).

    Pairs of ids are formed inside each portfolio in blocks, as the result has them; each different pair of holdings is scored once,
    however many portfolios and funds have it, and only those that score enough are joined back. Funds with missing parts take part
    like the others."""
    same = copies(alloc)
    own = stored(weights.select("portfolio_id", F.col("isin").alias("id")).distinct().join(same, "id"))      # both sides, twice
    side = lambda s: own.select("portfolio_id", F.col("id").alias(f"id_{s}"), F.col("rep").alias(f"rep_{s}"))
    inside = overlap.salted(side("a"), side("b"), ["portfolio_id"], block).where("id_a < id_b")
    inside = inside.select("portfolio_id", F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.least("rep_a", "rep_b").alias("id_a"), F.greatest("rep_a", "rep_b").alias("id_b"))
    rec = stored(records(_of_reps(alloc, same)[0]).withColumnRenamed("isin", "id"))
    alike = scored(inside.select("id_a", "id_b").distinct(), rec).select("id_a", "id_b", "reg", "top", "score")
    # few, and known to be few: then the pairs inside portfolios are not shuffled to find theirs
    enough = stored(alike.where((F.col("score") >= least) & (F.col("reg").isNotNull() | F.col("top").isNotNull())).select("id_a", "id_b", "score"))
    return inside.join(enough, ["id_a", "id_b"]).select("portfolio_id", "a", "b", "score")


# ------------------------------------------------------------------ proxies

def proxy_choice(funds: DataFrame, etfs: DataFrame, alloc: DataFrame, near: float = 0.08, floor: float = 0.3) -> DataFrame:
    """ETF whose months stand in for a fund without prices, with the scale of its swings.

    Among ETFs of the same class and hedging within ``near`` of the best similarity the longest history wins;
    below ``floor`` the closest volatility of the category is taken. Funds that report the same are matched once, and of ETFs that do
    only one for each length of history. A class is matched in salted blocks. Of the ETFs with one length of history only the most
    similar can win, so the pairs of a task shrink to one per fund and length before they are shuffled; the lengths of a fund,
    bounded by the calendar, then meet in one small list. Volatilities are matched value by value."""
    kept = alloc.join(funds.select(F.col("id").alias("isin")).union(etfs.select("id")), "isin", "left_semi")
    same = copies(kept)
    rec = stored(records(_of_reps(kept, same)[0]).withColumnRenamed("isin", "rep"))
    cls = ["asset_class", "hedged"]
    f = funds.select("id", *cls).join(same, "id")
    e = etfs.select("id", *cls, "vol", "n_months").join(same, "id").groupBy("rep", *cls, "n_months").agg(F.max("id").alias("id"), F.max_by("vol", "id").alias("vol"))
    l = f.select("rep", *cls).distinct().join(rec, "rep").select(*cls, F.col("rep").alias("id_a"), *[F.col(c).alias(f"{c}_a") for c in PARTS])
    r = e.join(rec, "rep").select(*cls, *[F.col(c).alias(f"{c}_b") for c in ("id", "vol", "n_months", *PARTS)])
    sim = score_pairs(overlap.salted(l, r, cls, pairs=SCORES)).where(F.col("score").isNotNull())
    own = ["id_a", *cls]
    lengths = sim.groupBy(*own, "n_months_b").agg(F.max_by(F.struct("score", "id_b", "vol_b"), F.struct("score", "id_b")).alias("s"))
    front = lengths.groupBy(*own).agg(F.collect_list(F.struct(F.col("n_months_b").alias("m"), F.col("s.score").alias("score"), F.col("s.id_b").alias("id"), F.col("s.vol_b").alias("vol"))).alias("f"))
    top = F.array_max(F.transform("f", lambda x: x["score"]))
    best = (front.withColumn("_top", top).select(F.col("id_a").alias("rep"), *cls, F.array_max(F.filter("f", lambda x: x["score"] >= F.col("_top") - near)).alias("s")).where(F.col("s.score") >= floor))
    pick = stored(f.join(best, ["rep", *cls]).select("id", F.col("s.id").alias("proxy"), F.col("s.vol").alias("proxy_vol"), F.col("s.score").alias("sim")))       # read twice
    keys = ["category", "hedged"]
    without = funds.join(pick, "id", "left_anti").select("id", *keys, "vol")
    left = without.select(*keys, F.col("vol").alias("id_a"), F.col("vol").alias("vol_a")).distinct()
    right = etfs.groupBy(*keys, F.col("vol").alias("vol_b")).agg(F.min("id").alias("id_b"))
    gap = F.abs(F.ln(F.col("vol_b") / F.col("vol_a")))
    closest = (overlap.salted(left, right, keys).groupBy(*keys, "vol_a")
               .agg(F.min_by(F.struct("id_b", "vol_b"), F.struct(F.coalesce(gap, F.lit(5.0)).alias("g"), "id_b")).alias("s")))
    hit = (F.col("w.category") == F.col("c.category")) & (F.col("w.hedged") == F.col("c.hedged")) & F.col("w.vol").eqNullSafe(F.col("c.vol_a"))
    same = (without.alias("w").join(closest.alias("c"), hit)
            .select(F.col("w.id").alias("id"), F.col("c.s.id_b").alias("proxy"), F.col("c.s.vol_b").alias("proxy_vol"), F.lit(0.0).alias("sim")))
    out = funds.select("id", "vol").join(pick.unionByName(same), "id", "left")
    k = F.when((F.col("sim") >= 0.85) | F.col("vol").isNull() | F.col("proxy_vol").isNull() | (F.col("proxy_vol") <= 0), 1.0).otherwise(
        F.greatest(F.lit(0.5), F.least(F.lit(1.8), F.col("vol") / F.col("proxy_vol"))))
    return out.select("id", "proxy", "sim", F.when(F.col("proxy").isNotNull(), k).alias("k"))


FITS = 1 << 9        # funds whose returns a task fits


def proxy_history(params: DataFrame, proxies: DataFrame, market: DataFrame, rf: DataFrame) -> DataFrame:
    """Monthly returns (id, mi, r) for funds without prices.

    ``params``: id, proxy (null = synthetic), k, vol, corr (0 = none), mkt_vol, target_years, target_ret, drag.
    ``proxies``: asset, mi, r. With a proxy the return is rf + k * (proxy - rf) less the cost drag; without one
    it is rf plus a fixed +-1 pattern at the fund's volatility and a share of the market. Inside the target
    window one constant per fund makes the compounded return equal the reported one: 60 bisection steps over
    the fund's own months (one bounded array per fund)."""
    end = rf.agg(F.struct(F.min("mi").alias("a"), F.max("mi").alias("b"))).scalar()
    t = F.col("mi") - F.col("start")
    x = F.sin((t + 1) * 12.9898) * 43758.5453
    sign = F.when(x - F.floor(x) < 0.5, -1.0).otherwise(1.0)
    corr = F.when(F.col("proxy").isNull() & (F.col("mkt_vol") > 0) & F.col("vol").isNotNull(), F.coalesce("corr", F.lit(0.0))).otherwise(0.0)
    months = rf.join(market.select("mi", F.col("r").alias("mkt")), "mi", "left")
    keyed = params.withColumn("_end", end).withColumn("start", F.col("_end.a")).withColumn("stop", F.col("_end.b")).drop("_end")
    own = keyed.where(F.col("proxy").isNotNull()).join(proxies.select(F.col("asset").alias("proxy"), "mi", F.col("r").alias("pr")), "proxy")
    syn = keyed.where(F.col("proxy").isNull()).withColumn("mi", F.explode(F.sequence("start", "stop"))).withColumn("pr", F.lit(None).cast("double"))
    rows = own.unionByName(syn).join(months, "mi").withColumn("c0", corr)
    beta = F.when(F.col("c0") != 0, F.col("c0") * F.col("vol") / F.col("mkt_vol")).otherwise(0.0)
    sm = F.coalesce(F.col("vol") * F.sqrt(1 - F.col("c0") * F.col("c0")) / F.sqrt(F.lit(12.0)), F.lit(0.0))
    base = F.when(F.col("proxy").isNotNull(), F.col("rf") + F.col("k") * (F.col("pr") - F.col("rf"))).otherwise(
        F.col("rf") + sm * sign + beta * F.coalesce(F.col("mkt") - F.col("rf"), F.lit(0.0)))
    rows = (rows.withColumn("base", base).withColumn("len", js_round(F.col("target_years") * 12).cast("long"))
            .withColumn("first", F.col("stop") - F.col("len") + 1))
    inside = F.col("mi") >= F.col("first")
    win = rows.where(inside).groupBy("id").agg(F.collect_list("base").alias("bs"), F.max("len").alias("len"), F.max("target_ret").alias("ret"))
    # 3 600 steps a fund over a few hundred bytes: dealt by their number
    win = spread(stored(win.where((F.size("bs") == F.col("len")) & F.col("ret").isNotNull())), "id", FITS).withColumn("want", F.pow(1 + F.col("ret"), F.col("len") / 12))

    def step(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        g = F.aggregate("bs", F.lit(1.0), lambda a, b: a * (1 + b + mid))
        return F.struct(F.when(g < F.col("want"), mid).otherwise(acc["lo"]).alias("lo"), F.when(g < F.col("want"), acc["hi"]).otherwise(mid).alias("hi"), mid.alias("c"))

    zero = F.struct(F.lit(-0.05).alias("lo"), F.lit(0.05).alias("hi"), F.lit(0.0).alias("c"))
    shift = win.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(60)), zero, step)).select("id", F.col("s.c").alias("c"), F.lit(True).alias("fits"))
    out = rows.join(shift, "id", "left")
    r = F.when(F.coalesce("fits", F.lit(False)) & inside, F.col("base") + F.col("c")).otherwise(
        F.col("base") - F.coalesce("drag", F.lit(0.0)) / 12 + F.when(F.col("proxy").isNull(), F.coalesce("c", F.lit(0.0))).otherwise(0.0))
    return out.select("id", "mi", r.alias("r"))


# ------------------------------------------------------------------ suggested building blocks

# role -> category of the index fund that fills it (fixed); the buffer is a quiet interest fund
ROLES = {"core": "Global Equity Large Cap", "em": "Global Emerging Markets Equity", "small": "Global Equity Mid/Small Cap"}
PROFILES = [(20, "Forsiktig"), (40, "Moderat"), (60, "Balansert"), (80, "Offensiv"), (100, "Bare aksjer")]
SPLIT = {"em": 0.1, "small": 0.1}
MIN_PIECE = 3


def reco_blocks(funds: DataFrame, min_owners: int = 1000) -> DataFrame:
    """(role, isin): among cheap funds that nearly match the best five-year return, the cheapest."""
    ok = (F.col("cost").isNotNull() & F.col("r5").isNotNull() & F.coalesce("tradable", F.lit(True)) & (F.col("currency") == "NOK")
          & (F.coalesce("owners", F.lit(0)) >= min_owners) & ~F.col("hedged"))
    index = F.col("is_index") & F.col("ask") & ~F.col("esg")
    role = F.when(is_rate() & (F.col("vol5") < 0.012), "safe")
    for r, cat in ROLES.items():
        role = F.when(index & (F.col("category") == cat), r).otherwise(role)
    c = funds.where(ok).withColumn("role", role).where(F.col("role").isNotNull()).select("role", "isin", "cost", "r5", "owners")
    cheap = c.join(c.groupBy("role").agg(F.min("cost").alias("low")), "role").where(F.col("cost") <= F.col("low") + 0.15)
    good = cheap.join(cheap.groupBy("role").agg(F.max("r5").alias("best")), "role").where(F.col("r5") >= F.col("best") - 0.005)
    return good.groupBy("role").agg(F.min_by("isin", F.struct("cost", (-F.coalesce("owners", F.lit(0))).alias("o"), "isin")).alias("isin"))


def reco_weights(blocks: DataFrame) -> DataFrame:
    """(profile, role, isin, w): whole percents per share of equity. Small pieces go to the core, and so does
    what rounding leaves over. Nothing without a core and a buffer."""
    b = blocks.groupBy().pivot("role", ["core", "em", "small", "safe"]).agg(F.first("isin")).where(F.col("core").isNotNull() & F.col("safe").isNotNull())
    b = b.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(e).alias("eq"), F.lit(n).alias("profile")) for e, n in PROFILES]))).select("*", "_p.*")
    for k, share in SPLIT.items():
        piece = F.when(F.col(k).isNotNull(), F.col("eq") * share).otherwise(0.0)
        b = b.withColumn(f"{k}_raw", piece)
    b = b.withColumn("core_raw", F.col("eq") - F.col("em_raw") - F.col("small_raw")).withColumn("safe_raw", (100 - F.col("eq")).cast("double"))
    for k in SPLIT:
        small = F.col(f"{k}_raw") < MIN_PIECE
        b = b.withColumn("core_raw", F.col("core_raw") + F.when(small, F.col(f"{k}_raw")).otherwise(0.0)).withColumn(f"{k}_raw", F.when(small, 0.0).otherwise(F.col(f"{k}_raw")))
    for k in ("core", "em", "small", "safe"):
        b = b.withColumn(f"{k}_w", js_round(F.col(f"{k}_raw")))
    b = b.withColumn("core_w", F.col("core_w") + 100 - F.col("core_w") - F.col("em_w") - F.col("small_w") - F.col("safe_w"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("role"), F.col(k).alias("isin"), F.col(f"{k}_w").alias("w")) for k in ("core", "em", "small", "safe")]))
    return b.select("profile", rows.alias("_row")).select("profile", "_row.*").where(F.col("w") > 0)


def first_twins(twin_rows: DataFrame, products: DataFrame, n: int) -> DataFrame:
    """The first ``n`` twins of each product in list order: cost, score, owners."""
    owners = products.select(F.col("id").alias("twin"), F.coalesce("owners", F.lit(0)).alias("owners"))
    order = W.partitionBy("id").orderBy("cost", F.col("score").desc(), F.col("owners").desc(), "twin")
    return (twin_rows.join(owners, "twin").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("owners"))
