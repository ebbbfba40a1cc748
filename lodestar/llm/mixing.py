"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

The rate of a source is (its target share x the size of all rows) / its own size. Each row draws its number of copies from
a Poisson distribution of that mean by inverting the distribution function at a hash of (seed, doc_id, term); a rate above
``STEP`` is the sum of equal terms, so no exponential underflows. Rows are exploded by their counts and put into a global
random order by a sort on a hash of (seed, doc_id, copy).

A null source is a source of its own. Sizes count 8 bytes per row besides the text, so sources of empty texts have a rate.
Rows with equal doc_id draw alike. A source without a target gets no copies; an empty table gives an empty result. Columns
of other names stay with ``mix``, its own names replace theirs; ``replicate`` keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.llm.rows import packed, unpacked

SEED = "mix-1"
STEP = 8.0
LAST = 48       # no double lies above the distribution function at 48 for means up to 8


def _uniform(*parts: Column) -> Column:
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, targets: dict[str | None, float] | None = None, budget: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """One row per source: ``size``, ``rate`` and the distribution function of one Poisson term.

    ``targets``: shares by source, scaled to sum to 1; by default all sources alike. ``budget``: size of the mix as a part of all rows' size.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    by = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("size"))
    if targets is None:
        share = F.lit(1.0)
    else:
        share = F.lit(0.0)
        for k, w in targets.items():
            share = F.when(F.col("_source").eqNullSafe(F.lit(k)), F.lit(float(w))).otherwise(share)
    by = by.withColumn("share", share)
    total = by.agg(F.sum("size").alias("_all"), F.sum("share").alias("_shares"))
    # one row of sums beside one row per source
    by = by.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one")
    by = by.withColumn("rate", F.when(F.col("_shares") > 0, F.lit(budget) * (F.col("share") / F.col("_shares")) * F.col("_all") / F.col("size")).otherwise(0.0))
    by = by.withColumn("terms", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
    mean = F.col("rate") / F.col("terms")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    step = lambda a, k: F.struct((a["p"] * mean / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * mean / k)).alias("c"))
    by = by.withColumn("below", F.aggregate(F.sequence(F.lit(1), F.lit(LAST)), start, step, lambda a: a["c"]))
    return by.select("_source", "size", "rate", "terms", "below")


def mix(docs: DataFrame, targets: dict[str | None, float] | None = None, budget: float = 1.0, doc_id: str = "doc_id", source: str = "source",
        text: str = "text", seed: str = SEED, shuffle: bool = True) -> DataFrame:
    """The rows, each as often as drawn, in random order, with ``copy`` (from 1), ``mix_rate`` and ``mix_order``."""
    r = rates(docs, targets, budget, source, text).select(F.col("_source"), F.col("rate").alias("mix_rate"), F.col("terms").alias("_terms"), F.col("below").alias("_below"))
    rows = packed(docs, _key=F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), _of=F.col(source))
    key = F.col("_key")
    draws = F.transform(F.sequence(F.lit(1), F.col("_terms")), lambda j: _uniform(F.lit(seed), key, j.cast("string")))
    count = F.aggregate(draws, F.lit(0), lambda a, u: a + F.size(F.filter("_below", lambda c: c <= u)))
    out = rows.join(r, F.col("_of").eqNullSafe(F.col("_source"))).withColumn("_count", count).where(F.col("_count") > 0)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    out = out.withColumn("mix_order", F.md5(F.concat_ws("|", F.lit(seed + "-order"), key, F.col("copy").cast("string"))))
    out = out.select("_row", "copy", "mix_rate", "mix_order")
    return unpacked(out.orderBy("mix_order") if shuffle else out, docs, "copy", "mix_rate", "mix_order")


def replicate(docs: DataFrame, **options) -> DataFrame:
    """The mix with the columns it came with, in random order."""
    bare = packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), text=F.col("text"))
    return unpacked(mix(bare, **options), docs)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "copy", F.round("mix_rate", 6).alias("mix_rate"), "mix_order")


ORACLE = f"""
WITH s AS (SELECT source, sum(coalesce(strlen(text), 0) + 8) AS size FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE * (1.0::DOUBLE / (SELECT count(*) FROM s)) * (SELECT sum(size) FROM s)::DOUBLE / size AS rate FROM s),
m AS (SELECT source, rate, greatest(1, ceil(rate / {STEP}))::INT AS terms, rate / greatest(1, ceil(rate / {STEP})) AS mean FROM r),
p AS (SELECT source, k, sum(exp(-mean) * pow(mean, k) / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS c FROM m, range(0, {LAST + 1}) t(k)),
i AS (SELECT doc_id, source, row_number() OVER () AS place FROM documents),
d AS (SELECT place, doc_id, i.source, rate, coalesce(doc_id::VARCHAR, 'null') AS key, unnest(range(1, terms + 1)) AS j
      FROM i JOIN m ON i.source IS NOT DISTINCT FROM m.source),
u AS (SELECT *, (('0x' || substr(md5('{SEED}|' || key || '|' || j), 1, 13))::BIGINT + 0.5) / {float(1 << 52)} AS u FROM d),
n AS (SELECT place, doc_id, u.source, rate, key, count(*) AS n FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source AND p.c <= u.u GROUP BY ALL),
e AS (SELECT doc_id, source, key, rate, unnest(range(1, n + 1)) AS copy FROM n)
SELECT doc_id, source, copy::INT AS copy, round(rate, 6) AS mix_rate, md5('{SEED}-order|' || key || '|' || copy) AS mix_order FROM e
"""
