"""Proportional stratified sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: Hexadecimal digits by which digests are counted.
DIGITS = 3


def stratum_quotas(sizes: DataFrame, n: int) -> DataFrame:
    """(stratum, quota) by largest remainder, at least one each when ``n`` allows, never above the size.

    ``sizes`` is (stratum, size): one row per stratum, so its windows stay small."""
    every = W.partitionBy(F.lit(1))
    s = (sizes.withColumn("total", F.sum("size").over(every)).withColumn("k", F.count(F.lit(1)).over(every))
         .withColumn("exact", n * F.col("size") / F.col("total"))
         .withColumn("base", F.when(F.lit(n) >= F.col("k"), F.greatest(F.floor("exact"), F.lit(1))).otherwise(F.floor("exact"))))
    rest = F.lit(n) - F.sum("base").over(every)
    room = F.col("base") < F.col("size")
    rank = F.row_number().over(W.partitionBy(room).orderBy((F.col("exact") - F.floor("exact")).desc(), "stratum"))
    s = (s.withColumn("rest", rest).withColumn("rank", rank)
         .withColumn("quota", F.col("base") + F.when(room & (F.col("rank") <= F.col("rest")), 1).otherwise(0)))
    # the minimum of one may overshoot, by less than a unit for each stratum: take single units off the largest quotas
    units = s.where("rest < 0").select("stratum", "rest", F.explode(F.sequence(F.greatest(F.lit(1), F.col("quota") + F.col("rest")), "quota")).alias("level"))
    cut = (units.withColumn("i", F.row_number().over(W.orderBy(F.col("level").desc(), "stratum")))     # at most strata x strata units
           .where(F.col("i") <= -F.col("rest")).groupBy("stratum").agg(F.count(F.lit(1)).alias("cut")))
    everything = (F.lit(n) <= 0) | (F.lit(n) >= F.col("total"))
    return s.join(cut, "stratum", "left").select("stratum", F.when(everything, F.col("size")).otherwise(
        F.least("size", F.col("quota") - F.coalesce("cut", F.lit(0)))).cast("long").alias("quota"), everything.alias("everything"))


def stratified_sample(rows: DataFrame, n: int, seed: int = 1, key: str = "fund_type", ident: str = "isin") -> DataFrame:
    """Sample of ``n`` rows; the same for a seed whatever the row order. n <= 0 or n >= rows gives all.

    A stratum's members are its rows with the smallest md5 of (seed, ``ident``): the digests are counted by their first digits, in
    every map task before the shuffle, and the counts give the digits at which the quota ends. Rows before them are taken where
    they are; only rows with those digits, a small part of a stratum of any size, are ranked. Rows of equal ``ident`` go by their
    values."""
    own = rows.columns
    tagged = (rows.withColumn("_stratum", F.coalesce(F.col(key), F.lit("Ukjent")))
              .withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(ident).cast("string")))).withColumn("_d", F.substring("_h", 1, DIGITS)))
    counts = tagged.groupBy("_stratum", "_d").agg(F.count(F.lit(1)).alias("_n"))
    quotas = stratum_quotas(counts.groupBy(F.col("_stratum").alias("stratum")).agg(F.sum("_n").alias("size")), n)
    # at most 16 ** DIGITS counts a stratum
    upto = W.partitionBy("_stratum").orderBy("_d").rowsBetween(W.unboundedPreceding, 0)
    reached = counts.withColumn("_upto", F.sum("_n").over(upto)).join(quotas.select(F.col("stratum").alias("_stratum"), "quota"), "_stratum")
    end = (reached.where(F.col("_upto") >= F.col("quota")).groupBy("_stratum")
           .agg(F.min(F.struct("_d", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("need"))).alias("_end")))
    marked = tagged.join(end, "_stratum").where(F.col("_d") <= F.col("_end._d"))
    order = W.partitionBy("_stratum").orderBy("_h", ident, F.xxhash64(*own))
    last = marked.where(F.col("_d") == F.col("_end._d")).withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= F.col("_end.need"))
    return marked.where(F.col("_d") < F.col("_end._d")).select(*own).unionByName(last.select(*own))
