"""Merkle manifest of a dataset: a leaf per row, a tree per group, one tree over the groups, and a proof for every leaf.

The leaves of a group are ranked by key and cut into aligned blocks of ``fanout ** levels``. A block hashes its own subtree.
Then the blocks exchange roots in a butterfly: in each round a block sends the root of its subtree to its counterparts in the
sibling subtrees of its run, receives theirs, and hashes their common parent itself. Every block hashes its own ancestors (so
an ancestor is hashed once in each block below it) and after the last round holds the siblings at all levels, up to the root;
nothing is sent back down. In an incomplete run the counterpart is found modulo the sibling's size, so a block receives at
most ``fanout`` short rows in a round whatever the tree looks like. After the rounds inside a group, rounds over the groups
follow in the same way.

H is the lower-case hex sha256 of its inputs, concatenated, digests as hex text. A leaf is H of its fields, each ``-`` if null,
else UTF-8 byte count, ``:``, value. While a level has more than one node, every ``fanout`` consecutive ones (the last run may
be shorter, even one node) become their H.

A null group is a group of its own, before all others; groups go by their UTF-8 bytes. Null keys come first; rows of equal key
go by their leaf, so equal rows are told apart by place only and the tree doesn't depend on how the rows are stored. Null and
empty texts differ in the leaf. An empty table has no leaves and no root: no rows. Columns of any names may be fields; only
fields, group and key are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.llm import sql
from lodestar.session import stored

FANOUT, LEVELS = 8, 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SIBLINGS = "array<struct<before:array<string>,after:array<string>>>"


def digest(*parts: Column) -> Column:
    """H of columns that hold text."""
    return F.sha2(F.concat(*parts), 256)


def digest_all(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return digest(*[field(v) for v in values])


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings at each level give."""
    return F.aggregate(proof, start, lambda node, s: digest_all(F.concat(s["before"], F.array(node), s["after"])))


def proof_digest(proof: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: F.concat(s["before"], s["after"]))), ""), 256)


def leaves(rows: DataFrame, fields: list[str], group: str, key: str, carried: dict[str, Column]) -> DataFrame:
    """``grp``, ``key``, ``hash`` and the carried columns: short rows, the only thing that is sorted and shuffled."""
    return rows.select(F.col(f"`{group}`").cast("string").alias("grp"), F.col(f"`{key}`").alias("key"),
                       leaf([F.col(f"`{c}`") for c in fields]).alias("hash"), *[v.alias(k) for k, v in carried.items()])


def ranked(rows: DataFrame) -> DataFrame:
    """``rank`` from 0 within the group, by key, then hash: rows are range-partitioned on the full order and written; places in a
    partition are shifted by the group's rows in the partitions before it. That table has a row per partition and group in it."""
    order = [F.asc_nulls_first("grp"), F.asc_nulls_first("key"), F.asc("hash")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stored(sorted_rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_pid", F.spark_partition_id()))
    before = W.partitionBy("grp").orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    shift = parts.groupBy("grp", "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    shift = shift.select(F.col("grp").alias("_grp"), F.col("_pid").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = parts.join(shift, (F.col("_pid") == F.col("_p")) & F.col("grp").eqNullSafe(F.col("_grp")))
    return joined.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_pid", "_grp", "_p", "_shift")


def _runs(nodes: Column, fanout: int) -> Column:
    """The nodes as an array of runs."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int")), lambda i: F.slice(nodes, i * fanout + 1, F.lit(fanout)))


def blocks(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """One row per block: ``leaves`` in order (at most fanout ** levels), the runs of each level below the block's root
    (``runs0`` of leaves, ``runs1``, ...) and ``root``. A group of one block climbs only while it has more than one node."""
    size = fanout ** levels
    sized = rows.withColumn("block", F.floor(F.col("rank") / size).cast("long"))
    item = F.struct("rank", *[c for c in rows.columns if c not in ("grp", "rank")])
    out = sized.groupBy("grp", "block").agg(F.sort_array(F.collect_list(item)).alias("leaves"))
    counts = out.groupBy("grp").agg(F.count(F.lit(1)).alias("blocks"))
    out = out.join(counts.withColumnRenamed("grp", "_g"), F.col("grp").eqNullSafe(F.col("_g"))).drop("_g")
    nodes = F.transform("leaves", lambda x: x["hash"])
    for k in range(levels):
        climb = (F.col("blocks") > 1) | (F.size("_nodes") > 1)
        out = out.withColumn("_nodes", nodes).withColumn(f"runs{k}", F.when(climb, _runs(F.col("_nodes"), fanout)))
        nodes = F.coalesce(F.transform(f"runs{k}", digest_all), F.col("_nodes"))
    return out.withColumn("_nodes", nodes).withColumn("root", F.col("_nodes")[0]).drop("_nodes")


def _swap(states: DataFrame, spans: Column, own: Column) -> DataFrame:
    """One round. ``spans``: (first, size) in ``unit`` of the subtrees that are to have one parent, in order, this block's own
    included, null if there is nothing left to join; ``own``: the place of its own. Each block sends ``top`` to its counterparts
    and itself; each receives one top per subtree and becomes a holder of their parent."""
    marked = states.withColumn("_spans", spans).withColumn("_own", own)
    mine = F.col("_spans")[F.col("_own")]
    place = F.col("unit") - mine["first"]
    # block `place` of its subtree serves the places place, place + size, ... of every sibling
    served = F.flatten(F.transform("_spans", lambda s, i: F.when(
        i == F.col("_own"), F.array(F.col("unit"))).when(
        place < s["size"], F.transform(F.sequence(place, s["size"] - 1, mine["size"]), lambda p: s["first"] + p)).otherwise(F.array().cast("array<bigint>"))))
    targets = F.when(F.col("_spans").isNotNull(), served).otherwise(F.array(F.col("unit")))
    sent = marked.withColumn("_to", F.explode(targets))
    state = F.when(F.col("_to") == F.col("unit"), F.struct(*[F.col(c) for c in states.columns], F.col("_spans").isNotNull().alias("_climbs"), F.col("_own").alias("_own")))
    got = sent.groupBy("_to").agg(F.first(state, ignorenulls=True).alias("s"), F.sort_array(F.collect_list(F.struct(F.coalesce("_own", F.lit(0)).alias("k"), "top"))).alias("_in"))
    tops = F.transform("_in", lambda x: x["top"])
    at = F.col("s")["_own"]
    level = F.struct(F.slice("_tops", F.lit(1), at).alias("before"), F.slice("_tops", at + 2, F.size("_tops")).alias("after"))
    out = got.select("s", tops.alias("_tops"))
    kept = [F.col("s")[c].alias(c) for c in states.columns if c not in ("top", "path")]
    return out.select(*kept, F.when(F.col("s")["_climbs"], digest_all(F.col("_tops"))).otherwise(F.col("s")["top"]).alias("top"),
                      F.when(F.col("s")["_climbs"], F.concat(F.col("s")["path"], F.array(level))).otherwise(F.col("s")["path"]).alias("path"))


def _span(first: Column, size: Column) -> Column:
    return F.struct(first.cast("long").alias("first"), size.cast("long").alias("size"))


def exchange(roots: DataFrame, fanout: int) -> DataFrame:
    """``grp``, ``block``, ``subroot``, ``root`` and ``path`` (siblings above the block, lowest first) from ``grp``, ``block``, ``root``.
    Blocks are numbered over all groups (``unit``); only the largest number of blocks and of groups reaches the driver."""
    counts = roots.groupBy("grp").agg(F.count(F.lit(1)).alias("blocks"))
    groups = stored(_numbered(counts))
    top = groups.agg(F.max("blocks").alias("b"), F.count(F.lit(1)).alias("g")).first()
    if not top["g"]:
        return roots.select("grp", "block", F.col("root").alias("subroot"), "root", F.array().cast(SIBLINGS).alias("path"))
    g = groups.withColumnRenamed("grp", "_g")
    states = roots.join(g, F.col("grp").eqNullSafe(F.col("_g"))).select(
        "grp", "block", "blocks", "place", "start", (F.col("start") + F.col("block")).alias("unit"), F.col("root").alias("top"), F.array().cast(SIBLINGS).alias("path"))
    width = 1
    while width < top["b"]:
        run = F.floor(F.col("block") / (width * fanout)) * (width * fanout)
        last = F.least(F.lit(fanout), F.ceil((F.col("blocks") - run) / width)).cast("int")
        spans = F.transform(F.sequence(F.lit(0), last - 1), lambda i: _span(F.col("start") + run + i * width, F.least(F.lit(width), F.col("blocks") - run - i * width)))
        states = stored(_swap(states, F.when(F.col("blocks") > width, spans), F.floor((F.col("block") - run) / width).cast("int")))
        width *= fanout
    states = states.withColumn("subroot", F.col("top"))
    width = 1
    while width < top["g"]:
        sub = groups.groupBy(F.floor(F.col("place") / width).alias("sub")).agg(F.min("start").alias("first"), F.sum("blocks").alias("size"))
        runs = sub.groupBy(F.floor(F.col("sub") / fanout).alias("_run")).agg(F.sort_array(F.collect_list(F.struct("first", "size"))).alias("_of"))
        joined = states.withColumn("_r", F.floor(F.floor(F.col("place") / width) / fanout)).join(runs, F.col("_r") == F.col("_run"))
        joined = joined.withColumn("_k", (F.floor(F.col("place") / width) % fanout).cast("int")).drop("_r", "_run")
        swapped = _swap(joined, F.col("_of"), F.col("_k"))
        states = stored(swapped.drop("_of", "_k"))
        width *= fanout
    return states.select("grp", "block", "subroot", F.col("top").alias("root"), "path")


def _numbered(counts: DataFrame) -> DataFrame:
    """Groups in order with ``place`` and ``start`` (blocks of the groups before): range partitions and sums, not one task."""
    order = F.asc_nulls_first("grp")
    parts = stored(counts.repartitionByRange(order).sortWithinPartitions(order).withColumn("_pid", F.spark_partition_id()))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)          # one row per partition
    shift = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.sum("blocks").alias("_b")).select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b"))
    own = W.partitionBy("_pid").orderBy(order)
    return parts.join(shift, "_pid").select("grp", "blocks", (F.row_number().over(own) - 1 + F.col("_n")).cast("long").alias("place"),
                                            (F.sum("blocks").over(own) - F.col("blocks") + F.col("_b")).cast("long").alias("start"))


def manifest(rows: DataFrame, fields: list[str] | None = None, group: str = "lang", key: str = "doc_id", fanout: int = FANOUT, levels: int = LEVELS,
             carried: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``rows``: ``key``, ``leaf``, ``subroot``, ``root`` and ``proof``, the siblings at each level as
    struct(before, after), lowest first; ``fold(leaf, proof)`` gives the root. ``carried``: more columns of short values."""
    carried = carried or {}
    # written first: sorting samples them, and the texts are read and hashed once
    short = stored(leaves(rows, fields or FIELDS, group, key, carried))
    own = stored(blocks(ranked(short), fanout, levels))
    above = exchange(own.select("grp", "block", "root"), fanout)
    above = above.select(F.col("grp").alias("_g"), F.col("block").alias("_b"), "subroot", F.col("root").alias("_root"), "path")
    joined = own.join(above, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")))

    def level(k: int, i: Column) -> Column:
        at = F.floor(i / fanout ** k).cast("int")
        run = F.col(f"runs{k}")[F.floor(at / fanout).cast("int")]
        place = at % fanout
        return F.when(F.col(f"runs{k}").isNotNull(), F.array(F.struct(F.slice(run, F.lit(1), place).alias("before"), F.slice(run, place + 2, F.lit(fanout)).alias("after")))
                      ).otherwise(F.array().cast(SIBLINGS))

    proofs = F.transform("leaves", lambda x, i: F.struct(
        x["key"].alias("key"), x["hash"].alias("leaf"), *[x[c].alias(c) for c in carried], F.concat(*[level(k, i) for k in range(levels)], F.col("path")).alias("proof")))
    return joined.select("subroot", F.col("_root").alias("root"), F.explode(proofs).alias("x")).select(
        "x.key", "x.leaf", *[f"x.{c}" for c in carried], "subroot", "root", "x.proof")


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    tampered = F.when(picked & F.col("text").isNotNull(), leaf([lowered(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]))
    out = manifest(docs, carried={"_tampered": tampered}).withColumn("folded_root", fold(F.coalesce("_tampered", "leaf"), F.col("proof")))
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def _climb(name: str, nodes: str, paths: str, levels: int, fanout: int = FANOUT) -> str:
    """SQL of the levels of trees. ``nodes``: g, idx, h, m (nodes of the tree); ``paths``: d, g, pos, proof, f. Ends in ``{name}{levels}`` and ``{name}p{levels}``."""
    out = [f"{name}0 AS ({nodes})", f"{name}p0 AS ({paths})"]
    for k in range(levels):
        out.append(f"{name}r{k} AS (SELECT g, idx // {fanout} AS run, list(h ORDER BY idx) AS hs, any_value(m) AS m FROM {name}{k} GROUP BY ALL)")
        out.append(f"{name}{k + 1} AS (SELECT g, run AS idx, CASE WHEN m > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, (m + {fanout - 1}) // {fanout} AS m FROM {name}r{k})")
        place = f"(pos // {fanout ** k} % {fanout})::INT"
        out.append(f"{name}p{k + 1} AS (SELECT d, p.g, pos, CASE WHEN m > 1 THEN proof || array_to_string(hs[:{place}] || hs[{place} + 2:], '') ELSE proof END AS proof, "
                   f"CASE WHEN m > 1 THEN sha256(array_to_string(hs[:{place}] || [f] || hs[{place} + 2:], '')) ELSE f END AS f "
                   f"FROM {name}p{k} p JOIN {name}r{k} r ON p.g = r.g AND p.pos // {fanout ** (k + 1)} = r.run)")
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ["doc_id", "source", "lang", "n_chars", text]) + ")"


#: Levels one by one, for up to 8 ** 9 rows a group and 8 ** 4 groups.
ORACLE = f"""
WITH {sql.BITS},
keyed AS (SELECT *, doc_id::VARCHAR AS key, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
leafs AS (SELECT doc_id, lang, {_leaf_sql("text")} AS leaf, CASE WHEN {sql.crc32("key")} % 3 = 0 AND text IS NOT NULL THEN {_leaf_sql("low")} END AS tampered FROM keyed, bits),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang COLLATE "C" NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents)),
d AS (SELECT doc_id, leaf, tampered, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS m,
             row_number() OVER () AS id FROM leafs l JOIN langs s ON l.lang IS NOT DISTINCT FROM s.lang),
{_climb("n", "SELECT g, pos AS idx, leaf AS h, m FROM d", "SELECT id AS d, g, pos, '' AS proof, coalesce(tampered, leaf) AS f FROM d", 9)},
{_climb("t", "SELECT 0 AS g, g AS idx, h, (SELECT count(*) FROM langs) AS m FROM n9", "SELECT d, 0 AS g, g AS pos, proof, f FROM np9", 4)}
SELECT doc_id, leaf, n9.h AS subroot, t4.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t4.h AS verified
FROM d JOIN n9 ON n9.g = d.g JOIN tp4 ON tp4.d = d.id, t4
"""
