"""Data-quality assertions and run gates: one row per check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.operators.pairs import te_between
from lodestar.params import DEFAULTS, Params


def acceptance_checks(members: DataFrame, returns: DataFrame, same: dict[str, str], apart: list[tuple[str, str]],
                      lookups: DataFrame) -> DataFrame:
    """Name-pattern groups that must share one cluster, groups that must never share one, and tracking error of
    named pairs that must lie in different clusters. ``members`` is (asset, name, cluster)."""
    parts = []
    for label, pattern in same.items():
        parts.append(members.where(F.col("name").rlike(pattern)).agg(F.count_distinct("cluster").alias("n")).select(
            F.lit(f"one cluster: {label}").alias("check"), (F.col("n") == 1).alias("ok"), F.col("n").cast("double").alias("detail")))
    for a, b in apart:
        both = (members.groupBy("cluster").agg(F.max(F.col("name").rlike(a)).alias("x"), F.max(F.col("name").rlike(b)).alias("y"))
                .agg(F.count_if(F.col("x") & F.col("y")).alias("n")))
        parts.append(both.select(F.lit(f"apart: {a} {b}").alias("check"), (F.col("n") == 0).alias("ok"),
                                 F.col("n").cast("double").alias("detail")))
    named = (lookups.join(members.select(F.col("asset").alias("a"), F.col("cluster").alias("ca")), "a")
             .join(members.select(F.col("asset").alias("b"), F.col("cluster").alias("cb")), "b")
             .join(te_between(returns, lookups), ["a", "b"], "left"))
    parts.append(named.select(F.concat_ws(" ", F.lit("te:"), "a", "b").alias("check"), (F.col("ca") != F.col("cb")).alias("ok"),
                              F.col("te").alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def run_gate(found: Column, prior_active: Column, partial: Column, p: Params = DEFAULTS) -> Column:
    """False when nothing was found, or a full run found too few of the earlier active rows."""
    enough = partial | (prior_active == 0) | (found >= p.min_fraction_of_previous * prior_active)
    return (found > 0) & enough


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Pass the rows on, or stop the job at the first row that fails."""
    return df.where(F.assert_true(ok, F.lit(message)).isNull())
