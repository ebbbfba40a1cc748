"""Pairs of funds by what they have in common: joins on a weighted inverted index with prefix filters.

The overlap of two funds in one kind of label is the sum of the smaller shares. Labels are put in one order, rarest first. A
fund's prefix is the labels it needs until what is left weighs less than the least overlap asked for: two funds that reach it
share a label of both prefixes, so only prefixes are joined. A pair comes out once, at its first common label; popular labels
are cut into blocks. Several kinds at once are joined on one label of each.

The lists of largest holdings (``top``) are compared relative to the lighter list; there the lighter side's prefix is joined with
the other's whole list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.session import stored, task_count

SLACK = 1e-9
BLOCK = 512
PAIRS = 1 << 21      # pairs of rows a task looks at, in expectation
COPIES = 1 << 17     # rows it gets


def salted(left: DataFrame, right: DataFrame, keys: list[str], block: int = BLOCK, pairs: int | None = None) -> DataFrame:
    """Match two sides (``id_a``, ``id_b``) on keys some of which may be hot: each key is cut into tasks of about block x block rows,
    and these are spread by their pairs, however few bytes the two sides have: ``pairs`` a task, fewer where a pair is much work."""
    block, pairs = (min(block, max(1, int(pairs ** 0.5))), pairs) if pairs else (block, PAIRS)
    def count(df: DataFrame, side: str) -> DataFrame:
        n = df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(f"_t{side}"))
        return n.withColumn(f"_n{side}", F.ceil(F.col(f"_t{side}") / block).cast("int"))

    def every(c: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1))

    n = stored(count(left, "l").join(count(right, "r"), keys))
    copies = F.col("_tl") * F.col("_nr") + F.col("_tr") * F.col("_nl")
    tasks, cut = task_count(n, F.col("_tl") * F.col("_tr") / pairs), n.select(*keys, "_nl", "_nr")
    l = left.join(cut, keys).withColumn("_bl", F.pmod(F.xxhash64("id_a"), F.col("_nl"))).withColumn("_br", every("_nr"))
    r = right.join(cut, keys).withColumn("_br", F.pmod(F.xxhash64("id_b"), F.col("_nr"))).withColumn("_bl", every("_nl"))
    l, r = l.drop("_nl", "_nr"), r.drop("_nl", "_nr")
    if tasks > 1:        # fewer pairs are no more than a task's work: Spark's own number of tasks does
        tasks += task_count(n, copies / COPIES)
        l, r = (x.repartition(tasks, *keys, "_bl", "_br") for x in (l, r))
    return l.join(r, [*keys, "_bl", "_br"]).drop("_bl", "_br")


def lists(alloc: DataFrame) -> DataFrame:
    """``id``, ``kind``, ``total`` and ``labels``: struct(place, label, share, rest) in order, rarest label first; ``rest`` is what it and
    the labels after it weigh. Bounded by the labels one fund reports."""
    pos = alloc.where(F.col("weight") > 0).select(F.col("isin").alias("id"), "kind", "label", "weight")
    seen = pos.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("_df"))
    total = pos.groupBy("id", "kind").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("_n"))
    # records of less than five holdings are no list
    rows = pos.join(seen, ["kind", "label"]).join(total.where((F.col("kind") != "top") | (F.col("_n") >= 5)), ["id", "kind"])
    w = W.partitionBy("id", "kind").orderBy(F.col("_df").desc(), F.col("label").desc()).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("share", F.col("weight") / F.col("total"))
    item = F.struct("_df", "label", "share", F.sum("share").over(w).alias("rest"))
    return rows.select("id", "kind", "total", item.alias("x")).groupBy("id", "kind").agg(F.max("total").alias("total"), F.sort_array(F.collect_list("x")).alias("labels"))


def _prefix(least: float) -> Column:
    return F.transform(F.filter("labels", lambda x: x["rest"] >= least - SLACK), lambda x: x["label"])


def _first_common(a: str, b: str, label: str) -> Column:
    return F.array_intersect(a, b)[0] == F.col(label)


def reaching(index: DataFrame, least: dict[str, float], block: int = BLOCK) -> DataFrame:
    """(id_a < id_b): all pairs that overlap by ``least`` in every one of these kinds (reg, sec, ast), and some that don't.

    Shares add up to 1, so an overlap is at most 1 less the difference in any one label: pairs too far apart in the label they
    meet on are left out at once."""
    rows = None
    for k, t in least.items():
        part = index.where(F.col("kind") == k).select("id", _prefix(t).alias(f"__{k}"), F.explode(F.filter("labels", lambda x: x["rest"] >= t - SLACK)).alias("x"))
        part = part.select("id", f"__{k}", F.col("x.label").alias(f"l_{k}"), F.col("x.share").alias(f"w_{k}"))
        rows = part if rows is None else rows.join(part, "id")
    keys = [f"l_{k}" for k in least]
    side = lambda s: rows.select(*keys, F.col("id").alias(f"id_{s}"), *[F.col(f"{c}_{k}").alias(f"{c}_{k}_{s}") for k in least for c in ("_", "w")])
    both = salted(side("a"), side("b"), keys, block).where(F.col("id_a") < F.col("id_b"))
    close = [F.abs(F.col(f"w_{k}_a") - F.col(f"w_{k}_b")) <= 1 - t + SLACK for k, t in least.items()]
    first = [_first_common(f"__{k}_a", f"__{k}_b", f"l_{k}") for k in least]
    return both.where(reduce(lambda x, y: x & y, [*close, *first])).select("id_a", "id_b")


def reaching_top(index: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(id_a < id_b): all pairs whose largest holdings overlap by ``least`` of the lighter list, and some that don't."""
    rows = index.where(F.col("kind") == "top")
    light = rows.select("id", "total", _prefix(least).alias("_p")).select(F.col("id").alias("id_a"), F.col("total").alias("_ta"), F.col("_p"), F.explode("_p").alias("label"))
    whole = rows.select(F.col("id").alias("id_b"), F.col("total").alias("_tb"), F.transform("labels", lambda x: x["label"]).alias("_w"))
    both = salted(light, whole.withColumn("label", F.explode("_w")), ["label"], block)
    lighter = (F.col("_ta") < F.col("_tb")) | ((F.col("_ta") == F.col("_tb")) & (F.col("id_a") < F.col("id_b")))
    both = both.where(lighter & _first_common("_p", "_w", "label"))
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def candidates(alloc: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(id_a < id_b): all pairs whose score may reach ``least`` (above 0). The score is at most the mean of regions and sectors, or of
    that and the largest holdings, so one of the three reaches it; without any, half the overlap of asset classes does."""
    if least <= 0:
        raise ValueError("a least score above 0; pairs of any score are formed inside portfolios")
    index = stored(lists(alloc))
    found = [reaching(index, {k: least}, block) for k in ("reg", "sec")] + [reaching_top(index, least, block)]
    if least <= 0.5:
        found.append(reaching(index, {"ast": 2 * least}, block))
    return reduce(DataFrame.union, found).distinct()
