"""Pair statistics over many instruments.

A pair table is quadratic by nature, so pairs are never made by joining rows: each instrument is one vector,
vectors are spread over hash blocks of about ``BLOCK`` instruments, and every pair of blocks is one task that
works on two small dense matrices and returns only the pairs asked for. No task sees more than two blocks,
whatever the number of instruments.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestar.operators import pivots
from lodestar.operators.overlap import salted
from lodestar.operators.portfolio import common_months
from lodestar.params import DEFAULTS, Params
from lodestar.session import ship

BLOCK = 512


def in_block_pairs(df: DataFrame, ident: str, group: list[str], block: int = BLOCK) -> DataFrame:
    """Send every row to each pair of blocks (``lo`` <= ``hi``) that its own block is part of."""
    n = df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    sized = df.join(n, group) if group else df.withColumn("_blocks", n.scalar())
    return (sized.withColumn("block", F.pmod(F.xxhash64(ident), F.col("_blocks")).cast("int"))
            .withColumn("_last", F.col("_blocks") - 1)
            .withColumn("_other", F.explode(F.sequence(F.lit(0), "_last")))
            .withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other"))
            .drop("_blocks", "_last", "_other"))


def vectors(returns: DataFrame, time: str = "period") -> DataFrame:
    """One dense vector per asset over the common time axis (NaN = missing, only inside tasks)."""
    span = returns.agg(F.struct(F.min(time).alias("a"), F.max(time).alias("b"))).scalar()
    per = (returns.groupBy("asset").agg(F.map_from_entries(F.collect_list(F.struct(time, "r"))).alias("m"))
           .withColumn("span", span).withColumn("axis", F.sequence("span.a", "span.b")))
    return per.select("asset", F.transform("axis", lambda i: F.coalesce(F.try_element_at("m", i), F.lit(float("nan")))).alias("v"))


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return pdf[pdf.block == pdf.lo], pdf[pdf.block == pdf.hi]


def _open(pdf: pd.DataFrame, cap: float) -> Callable[[int], np.ndarray]:
    """By row of the left side: which rows of the right side no pivot rules out (all of them where months differ), each pair once."""
    left, right = _sides(pdf)
    names, ids, same = left.asset.to_numpy(), right.asset.to_numpy(), bool((pdf.lo == pdf.hi).iloc[0])
    months = left.months.iloc[0] if "d" in pdf and len(left) and len(right) and left.months.iloc[0] == right.months.iloc[0] else ""
    near = (np.stack(left.d.to_numpy()), np.stack(right.d.to_numpy())) if months else None

    def row(k: int) -> np.ndarray:
        keep = ids > names[k] if same else np.ones(len(ids), bool)
        return keep if near is None else keep & (np.abs(near[1] - near[0][k]) <= cap * (1 + pivots.SLACK) + pivots.SLACK).all(axis=1)

    return row


def _te_task(periods: int, max_te: float, p: Params) -> Callable[[pd.DataFrame], pd.DataFrame]:
    root = np.sqrt(periods)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(pdf)
        names, other = left.asset.to_numpy(), np.stack(right.v.to_numpy())
        ids, out = right.asset.to_numpy(), []
        may = _open(pdf, max_te)
        for k, (name, x) in enumerate(zip(names, left.v)):
            keep = may(k)
            if not keep.any():
                continue
            d = other[keep] - x
            n = np.isfinite(d).sum(axis=1)
            d, b = d[n >= 2], ids[keep][n >= 2]
            n = n[n >= 2]
            if not len(n):
                continue
            te = np.nanstd(d, axis=1, ddof=1) * root
            robust = np.full(len(n), np.nan)
            near = (te < p.robust_prefilter_te) & (n >= p.min_overlap)
            if near.any():
                e = d[near]
                med = np.nanmedian(e, axis=1, keepdims=True)
                lim = p.robust_clip_sigma * 1.4826 * np.nanmedian(np.abs(e - med), axis=1, keepdims=True)
                robust[near] = np.nanstd(np.clip(e, med - lim, med + lim), axis=1, ddof=1) * root
            sel = te < max_te
            out.append(pd.DataFrame({"a": np.minimum(b[sel], name), "b": np.maximum(b[sel], name), "te": te[sel],
                                     "n": n[sel], "robust": robust[sel]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["a", "b", "te", "n", "robust"])

    return run


def te_pairs(returns: DataFrame, periods: int = 12, max_te: float | None = None, p: Params = DEFAULTS) -> DataFrame:
    """Annualised tracking error (a, b, te, n, robust) of pairs below ``max_te`` on their common periods.

    ``max_te`` defaults to the cap under which pairs are refined at all; pairs above it can never share a
    cluster. ``robust`` clips the difference around its median and is null where the overlap is too short.
    Under a finite cap pairs are ruled out by their distances to pivots before any vector is copied."""
    cap = p.robust_prefilter_te if max_te is None else max_te
    ship(returns.sparkSession)
    vec = vectors(returns)
    blocks = in_block_pairs(vec, "asset", []) if np.isinf(cap) else pivots.near_blocks(vec, float(np.sqrt(periods)), cap, BLOCK)
    out = blocks.groupBy("lo", "hi").applyInPandas(
        _te_task(periods, cap, p), "a string, b string, te double, n long, robust double")
    return out.withColumn("robust", F.when(~F.isnan("robust"), F.col("robust")))


def pairs_compared(returns: DataFrame, periods: int = 12, max_te: float | None = None, p: Params = DEFAULTS, block: int = BLOCK) -> DataFrame:
    """(lo, hi, compared, pairs) of each task of ``te_pairs`` under a cap: pairs whose vectors are compared, of those in it."""
    cap = p.robust_prefilter_te if max_te is None else max_te

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(pdf)
        may, n = _open(pdf, cap), len(left)
        same = bool((pdf.lo == pdf.hi).iloc[0])
        return pd.DataFrame({"lo": pdf.lo.iloc[:1], "hi": pdf.hi.iloc[:1], "compared": sum(int(may(k).sum()) for k in range(n)), "pairs": n * (n - 1) // 2 if same else n * len(right)})

    blocks = pivots.near_blocks(vectors(returns), float(np.sqrt(periods)), cap, block)
    return blocks.groupBy("lo", "hi").applyInPandas(run, "lo int, hi int, compared long, pairs long")


def te_between(returns: DataFrame, pairs: DataFrame, periods: int = 12) -> DataFrame:
    """Tracking error of named pairs only."""
    a = returns.select(F.col("asset").alias("a"), "period", F.col("r").alias("ra"))
    b = returns.select(F.col("asset").alias("b"), "period", F.col("r").alias("rb"))
    return (pairs.join(a, "a").join(b, ["b", "period"]).groupBy("a", "b")
            .agg((F.stddev_samp(F.col("ra") - F.col("rb")) * F.sqrt(F.lit(float(periods)))).alias("te"),
                 F.count(F.lit(1)).alias("n")))


def te_edges(pairs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Distance of pairs with enough overlap; a missing edge means never together."""
    return pairs.where(F.col("n") >= p.min_overlap).select("a", "b", F.coalesce("robust", "te").alias("d"))


def _cov_task(pdf: pd.DataFrame) -> pd.DataFrame:
    left, right = _sides(pdf)
    x, y = np.stack(left.v.to_numpy()), np.stack(right.v.to_numpy())
    t = x.shape[1]
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    s = x @ y.T / (t - 1)
    sx, sy = x.std(axis=1, ddof=0) * np.sqrt(t / (t - 1)), y.std(axis=1, ddof=0) * np.sqrt(t / (t - 1))
    i, j = np.meshgrid(np.arange(len(x)), np.arange(len(y)), indexing="ij")
    a, b = left.asset.to_numpy()[i.ravel()], right.asset.to_numpy()[j.ravel()]
    sel = a <= b if bool((pdf.lo == pdf.hi).iloc[0]) else np.ones(len(a), bool)
    swap = a > b
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return pd.DataFrame({"a": a, "b": b, "cov": s.ravel(), "sd_ab": (sx[:, None] * sy[None, :]).ravel()})[sel]


def covariance_pairs(returns: DataFrame) -> DataFrame:
    """Sample covariance (a <= b) over months where every asset has a return; also sd_a * sd_b."""
    ship(returns.sparkSession)
    ordered = common_months(returns)
    vec = ordered.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("mi", "r"))).alias("s")).select(
        "asset", F.transform("s", lambda x: x["r"]).alias("v"))
    return (in_block_pairs(vec, "asset", []).groupBy("lo", "hi")
            .applyInPandas(_cov_task, "a string, b string, cov double, sd_ab double"))


def selection_covariance(returns: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """(by, a, b, cov, sd_ab) with a <= b inside each selection, over its own months, so one young instrument shortens no other selection's
    window. ``returns`` holds every month of a selection for each of its assets. One array per asset; large selections meet in blocks."""
    per = returns.groupBy(*by, "asset").agg(F.array_sort(F.collect_list(F.struct("mi", "r"))).alias("s"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"))
    vec = per.select(*by, "asset", F.transform("s", lambda x: x["r"] - F.col("m")).alias("v"), "sd")
    side = lambda s: vec.select(*by, F.col("asset").alias(f"id_{s}"), F.col("v").alias(f"v_{s}"), F.col("sd").alias(f"sd_{s}"))
    both = salted(side("a"), side("b"), by, block).where(F.col("id_a") <= F.col("id_b"))
    cov = F.aggregate(F.zip_with("v_a", "v_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / (F.size("v_a") - 1)
    return both.select(*by, F.col("id_a").alias("a"), F.col("id_b").alias("b"), cov.alias("cov"), (F.col("sd_a") * F.col("sd_b")).alias("sd_ab"))


def min_jaccard(names: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """Smallest token overlap between two different names of a group; large groups meet in blocks and one number leaves each task.

    ``names`` has one row per (group, distinct token list); copies of a name are dropped before pairing."""
    side = lambda s: names.select(group, F.concat_ws(" ", "tokens").alias(f"id_{s}"), F.col("tokens").alias(f"_{s}"))
    pairs = salted(side("a"), side("b"), [group], block).where(F.col("id_a") < F.col("id_b"))
    same = F.size(F.array_intersect("_a", "_b"))
    return pairs.groupBy(group).agg(F.min(same / F.greatest(F.lit(1), F.size(F.array_union("_a", "_b")))).alias("min_similarity"))
