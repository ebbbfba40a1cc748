"""Metric pruning of pairs of return series.

On a common window the tracking error is a distance (the length of the centred difference), so it obeys the triangle
inequality: two series whose distances to any third one differ by more than a cap are themselves further apart than the cap.
Series with the same months are measured against a few pivots; neighbours in that space are put into blocks, and only blocks
whose ranges of pivot distances come within the cap of each other meet. Vectors are copied to those tasks only, and a task
compares only the pairs that no pivot rules out.

The inequality holds only where both series have the same months. Months that fewer than ``SMALL`` series share are put
together, and pairs across different months are compared without pruning. No pair within the cap is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.session import stored, with_global_rank

PIVOTS = 4
SMALL = 64
#: Steps of the cap on the curve along which neighbours are lined up, and bits of each of its three coordinates.
STEPS, BITS = 4, 8
SLACK = 1e-9


def _sd(x: Column) -> Column:
    """Sample standard deviation of an array without its NaN."""
    def of(v: Column) -> Column:
        mean = F.aggregate(v, F.lit(0.0), lambda s, a: s + a) / F.size(v)
        return F.transform(F.array(mean), lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, a: s + (a - m) * (a - m)) / (F.size(v) - 1)))[0]

    return F.transform(F.array(F.filter(x, lambda a: ~F.isnan(a))), of)[0]


def _curve(distances: list[Column], step: float) -> Column:
    """Place on a Z-order curve through three coordinates."""
    cells = [F.least(F.floor(d / step), F.lit((1 << BITS) - 1)).cast("long") for d in distances]
    bits = [F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)), len(cells) * b + i) for i, c in enumerate(cells) for b in range(BITS)]
    return reduce(lambda a, b: a + b, bits)


def measured(vec: DataFrame, root: float, small: int = SMALL) -> DataFrame:
    """``asset``, ``v``, ``months`` (which months the series has, or empty if few share them) and ``d``: distances to no return at
    all and to the pivots of its months, null where ``months`` is empty."""
    own = vec.withColumn("months", F.array_join(F.transform("v", lambda x: F.when(F.isnan(x), "0").otherwise("1")), ""))
    pivots = own.groupBy("months").agg(F.count(F.lit(1)).alias("_n"), *[F.min_by("v", F.xxhash64(F.lit(k), "asset")).alias(f"_p{k}") for k in range(PIVOTS)])
    joined = own.join(pivots.where((F.col("_n") >= small) & (F.length(F.replace("months", F.lit("0"), F.lit(""))) >= 2)), "months", "left")
    away = [_sd(F.col("v")), *[_sd(F.zip_with("v", f"_p{k}", lambda a, b: a - b)) for k in range(PIVOTS)]]
    known = F.col("_n").isNotNull()
    return joined.select("asset", "v", F.when(known, F.col("months")).otherwise("").alias("months"), F.when(known, F.array(*[x * root for x in away])).alias("d"))


def near_blocks(vec: DataFrame, root: float, cap: float, block: int, small: int = SMALL) -> DataFrame:
    """Rows ``lo``, ``hi``, ``block``, ``asset``, ``v``, ``months``, ``d``: every series in each task (lo, hi) of two blocks that may hold a pair within ``cap``."""
    rows = measured(vec, root, small).withColumn("_z", F.coalesce(_curve([F.col("d")[k] for k in range(3)], cap / STEPS), F.lit(0)))
    ranked = with_global_rank(rows, [F.col("months"), F.col("_z"), F.col("asset")], "_rank")
    cut = stored(ranked.withColumn("_cut", F.floor((F.col("_rank") - 1) / block)).drop("_rank", "_z"))
    ends = [f(F.col("d")[k]).alias(f"{n}{k}") for k in range(PIVOTS + 1) for n, f in (("a", F.min), ("b", F.max))]
    boxes = cut.groupBy("months", "_cut").agg(*ends)
    # one row per block, so this window is short
    boxes = stored(boxes.withColumn("block", (F.row_number().over(W.orderBy("months", "_cut")) - 1).cast("int")))
    count = boxes.agg(F.max("block")).scalar()
    left = boxes.select(F.col("block").alias("lo"), *[F.col(c).alias(f"l_{c}") for c in boxes.columns if c != "block"]).withColumn("_last", count)
    right = boxes.select(F.col("block").alias("hi"), *[F.col(c).alias(f"r_{c}") for c in boxes.columns if c != "block"])
    far = reduce(lambda a, b: a | b, [(F.col(f"l_a{k}") - F.col(f"r_b{k}") > cap * (1 + SLACK) + SLACK) | (F.col(f"r_a{k}") - F.col(f"l_b{k}") > cap * (1 + SLACK) + SLACK)
                                      for k in range(PIVOTS + 1)])
    apart = (F.col("l_months") == F.col("r_months")) & F.coalesce(far, F.lit(False))
    meet = left.withColumn("hi", F.explode(F.sequence("lo", "_last"))).join(right, "hi").where(~apart).select("lo", "hi")
    placed = cut.join(boxes.select("months", "_cut", "block"), ["months", "_cut"]).drop("_cut")
    sides = meet.select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    return placed.join(sides, "block")
