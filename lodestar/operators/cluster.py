"""Complete-linkage groups from a distance edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestar.operators.pairs import te_edges, te_pairs, vectors
from lodestar.params import DEFAULTS, Params
from lodestar.session import durable, with_global_rank


def complete_linkage(edges: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, node, cluster) for every node with an edge; all thresholds share the same rounds.

    Complete linkage is reducible, so each round merges every pair of clusters that are each other's nearest
    (ties by name). Two clusters are joined by an edge only while all pairs across them have one, so the edge
    table shrinks every round. Only the question "was anything merged?" reaches the driver."""
    e = (edges.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
         .where(F.col("d") <= F.col("t")).select("t", "a", "b", "d", F.lit(1).cast("long").alias("cnt")))
    e = durable(e)
    nodes = durable(e.select("t", F.col("a").alias("node")).union(e.select("t", "b")).distinct()
                    .withColumn("cluster", F.col("node")))
    while True:
        best = F.min(F.struct("d", "a", "b")).alias("m")
        nearest = (e.select("t", F.explode(F.array("a", "b")).alias("c"), "d", "a", "b").groupBy("t", "c").agg(best))
        merges = (nearest.groupBy("t", F.col("m.a").alias("into"), F.col("m.b").alias("gone"))
                  .agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") == 2).drop("votes"))
        merges = durable(merges)
        if merges.isEmpty():
            return nodes.select(F.col("t").alias("threshold"), "node", "cluster")
        to = {c: merges.select("t", F.col("gone").alias(c), F.col("into").alias(f"{c}_into")) for c in ("a", "b", "cluster")}
        nodes = durable(nodes.join(to["cluster"], ["t", "cluster"], "left")
                        .select("t", "node", F.coalesce("cluster_into", "cluster").alias("cluster")))
        size = nodes.groupBy("t", "cluster").agg(F.count(F.lit(1)).alias("size"))
        moved = (e.join(to["a"], ["t", "a"], "left").join(to["b"], ["t", "b"], "left")
                 .select("t", F.coalesce("a_into", "a").alias("x"), F.coalesce("b_into", "b").alias("y"), "d", "cnt")
                 .where(F.col("x") != F.col("y"))
                 .groupBy("t", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                 .agg(F.max("d").alias("d"), F.sum("cnt").alias("cnt")))
        e = durable(moved.join(size.select("t", F.col("cluster").alias("a"), F.col("size").alias("na")), ["t", "a"])
                    .join(size.select("t", F.col("cluster").alias("b"), F.col("size").alias("nb")), ["t", "b"])
                    .where(F.col("cnt") == F.col("na") * F.col("nb")).select("t", "a", "b", "d", "cnt"))


def te_clusters(returns: DataFrame, instruments: DataFrame, thresholds: tuple[float, ...] | None = None,
                p: Params = DEFAULTS) -> DataFrame:
    """(threshold, asset, cluster) for all instruments; those without prices or neighbours stay alone.

    Identical return series are paired only once: copies take the label of the first of them, so a large
    group of copies costs one vector instead of a square of edges."""
    thresholds = thresholds or (p.te_threshold,)
    # a copy needs min_overlap common periods to count as the same instrument
    vec = vectors(returns).withColumn("n", F.size(F.filter("v", lambda x: ~F.isnan(x))))
    key = F.when(F.col("n") >= p.min_overlap, F.sha2(F.to_json(F.struct("v")), 256)).otherwise(F.concat(F.lit("own "), "asset"))
    copies = durable(vec.select("asset", key.alias("key")))
    first = copies.groupBy("key").agg(F.min("asset").alias("first"))
    lead = durable(copies.join(first, "key").select("asset", "first"))
    distinct = returns.join(lead.where(F.col("asset") == F.col("first")).select("asset"), "asset", "left_semi")
    # pairs up to the largest threshold; only those under the prefilter are refined
    pairs = te_pairs(distinct, max_te=max(p.robust_prefilter_te, *thresholds), p=p)
    pairs = pairs.withColumn("robust", F.when(F.col("te") < p.robust_prefilter_te, F.col("robust")))
    labels = complete_linkage(te_edges(pairs, p), thresholds)
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    every = instruments.select("asset").join(lead, "asset", "left").select("asset", F.coalesce("first", "asset").alias("node"), t)
    return (every.join(labels, ["threshold", "node"], "left")
            .select("threshold", "asset", F.coalesce("cluster", "node").alias("cluster")))


def renumber_clusters(members: DataFrame) -> DataFrame:
    """Cluster numbers from 1: largest first, then by smallest member."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"), F.min("asset").alias("_first"))
    ranked = with_global_rank(sizes, [F.col("cluster_size").desc(), F.col("_first")], "cluster_id")
    return members.join(ranked.drop("_first"), "cluster").select("asset", "cluster_id", "cluster_size")


def cluster_stats(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Size and largest distance inside each cluster."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    inside = (edges.join(members.select(F.col("asset").alias("a"), F.col("cluster").alias("ca")), "a")
              .join(members.select(F.col("asset").alias("b"), F.col("cluster").alias("cb")), "b")
              .where(F.col("ca") == F.col("cb")).groupBy(F.col("ca").alias("cluster")).agg(F.max("d").alias("max_te")))
    return sizes.join(inside, "cluster", "left").select("cluster", "cluster_size", F.coalesce("max_te", F.lit(0.0)).alias("max_te"))


def threshold_sensitivity(labels: DataFrame, eligible: DataFrame) -> DataFrame:
    """Per threshold: clusters, clusters with an eligible member, clusters with several members."""
    per = (labels.join(eligible, "asset", "left").groupBy("threshold", "cluster")
           .agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("eligible", F.lit(False))).alias("el")))
    return per.groupBy("threshold").agg(F.count(F.lit(1)).alias("clusters"), F.count_if("el").alias("clusters_with_eligible"),
                                        F.count_if(F.col("n") > 1).alias("multi_member_clusters"))
