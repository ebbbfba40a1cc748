"""Shards by a hierarchical weighted hash tree.

A row descends from the root over regions and racks to a shard. At each node every child draws ``-ln(u) / weight`` with u from
a hash of (seed, child's path, doc_id); the smallest draw wins, so children get rows in proportion to their weights and a
changed weight moves rows only into or out of the changed subtree. A shard added by ``grow`` is a region of its own: rows
move only into it (law ``key``: doc_id and the tree decide, nothing else).

Rows with equal doc_id go to one shard; a null doc_id is hashed as the word ``null``; a null text has no bytes. An empty
table gives an empty result. Only doc_id and text are read; columns of other names stay with ``assign``, its own name
replaces theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.session import durable

SEED = "shards-1"
Tree = dict[str, dict[str, list[float]]]   # region -> rack -> weights of its shards; shards are numbered in this order


def tree(regions: int = 3, racks: int = 2, shards: int = 4, weight: float = 1.0) -> Tree:
    return {f"g{i}": {f"r{j}": [weight] * shards for j in range(racks)} for i in range(regions)}


def grow(t: Tree, weight: float = 1.0) -> Tree:
    """One more shard, numbered last, as a region with one rack."""
    return t | {f"g{len(t)}": {"r0": [weight]}}


def shard_count(t: Tree) -> int:
    return sum(len(s) for racks in t.values() for s in racks.values())


def _draw(path: str, key: Column, weight: float, seed: str) -> Column:
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(path), key)), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def _choose(children: list[tuple[str, float, Column]], key: Column, seed: str) -> Column:
    """The value of the child with the smallest draw; a child without weight gets nothing."""
    live = [c for c in children if c[1] > 0]
    draws = [F.struct(_draw(path, key, weight, seed).alias("d"), F.lit(k).alias("k")) for k, (path, weight, _) in enumerate(live)]

    def value(won: Column) -> Column:
        out = F.when(won == 0, live[0][2])
        for k, (_, _, below) in enumerate(live[1:], 1):
            out = out.when(won == k, below)
        return out

    # the one-element transform draws once and then evaluates the chosen child only
    return live[0][2] if len(live) == 1 else F.transform(F.array(F.array_min(F.array(*draws))["k"]), value)[0]


def shard_of(doc_id: Column, t: Tree, seed: str = SEED) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    n = 0
    regions = []
    for g, racks in t.items():
        inner = []
        for r, weights in racks.items():
            leaves = []
            for s, w in enumerate(weights):
                leaves.append((f"{g}/{r}/s{s}", w, F.lit(n)))
                n += 1
            inner.append((f"{g}/{r}", sum(weights), _choose(leaves, key, seed)))
        regions.append((g, sum(w for _, w, _ in inner), _choose(inner, key, seed)))
    return _choose(regions, key, seed).cast("int")


def assign(docs: DataFrame, t: Tree | None = None, doc_id: str = "doc_id", name: str = "shard", seed: str = SEED) -> DataFrame:
    """The rows with their shard; no shuffle."""
    return docs.withColumn(name, shard_of(F.col(f"`{doc_id}`"), t or tree(), seed))


def number(rows: DataFrame, shard: str = "shard", order: str = "doc_id", name: str = "slot") -> DataFrame:
    """Gapless places from 0 in each shard without one task per shard: rows are checkpointed where they are, ranked inside
    (partition, shard) and shifted by the counts of earlier partitions. The shift table has partitions x shards rows."""
    parts = durable(rows.withColumn("_pid", F.spark_partition_id()))
    before = W.partitionBy(shard).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    shift = parts.groupBy(shard, "_pid").agg(F.count(F.lit(1)).alias("_n")).select(shard, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy(shard, "_pid").orderBy(order)) - 1 + F.col("_before")
    return parts.join(shift, [shard, "_pid"]).withColumn(name, rank.cast("long")).drop("_pid", "_before")


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    t = tree()
    rows = assign(assign(docs, t), grow(t), name="grown_shard").select(
        "doc_id", size_of(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "grown_shard")
    return number(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
