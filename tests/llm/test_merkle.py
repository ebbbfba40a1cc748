"""Merkle manifest against a plain tree, in all shapes of runs; verification of changed rows; odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import merkle


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """Root and, for each node, its siblings per level as (before, after)."""
    proofs = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for a in range(0, len(nodes), fanout):
            run = nodes[a:a + fanout]
            for k in range(len(run)):
                for i in under[a + k]:
                    proofs[i].append((run[:k], run[k + 1:]))
            above.append(h("".join(run)))
            held.append([i for u in under[a:a + fanout] for i in u])
        nodes, under = above, held
    return nodes[0], proofs


def plain(rows, fanout=8, of=None):
    """rows: (key, group, all values) -> per row, in tree order: key, leaf, subroot, root, proof."""
    groups = defaultdict(list)
    for key, group, values in rows:
        groups[group].append((key is not None, key or 0, leaf(values), key))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, inner = [], []
    for g in order:
        groups[g].sort()
        root, proofs = tree([x[2] for x in groups[g]], fanout)
        subs.append(root)
        inner.append(proofs)
    root, outer = tree(subs, fanout)
    return [(x[3], x[2], subs[k], root, inner[k][i] + outer[k]) for k, g in enumerate(order) for i, x in enumerate(groups[g])]


def folded(start, proof):
    for before, after in proof:
        start = h("".join([*before, start, *after]))
    return start


def check(spark, rows, fanout, levels):
    df = spark.createDataFrame([(k, g, *v[2:]) for k, g, v in rows], "doc_id long, lang string, text string")
    out = merkle.manifest(df, ["doc_id", "lang", "text"], fanout=fanout, levels=levels)
    got = [(r.key, r.leaf, r.subroot, r.root, [(list(s.before), list(s.after)) for s in r.proof])
           for r in out.withColumn("again", merkle.fold(F.col("leaf"), F.col("proof"))).where("again = root").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows, fanout)))


@pytest.mark.parametrize("fanout,levels,sizes", [
    (2, 1, [1, 2, 3, 4, 5, 7, 8, 9, 13]), (2, 2, [37, 1, 64, 6]), (3, 1, [28, 1, 2, 82]), (8, 1, [520, 8, 9, 1, 65, 2, 3, 4, 5, 70]), (8, 3, [600])])
def test_tree_and_proofs_match_a_plain_tree(spark, fanout, levels, sizes):
    r = random.Random(len(sizes))
    names = [None, "", "é", "z", "en", "de", "a b", "Z", "fr", "-"]
    rows = []
    for n, g in zip(sizes, names):
        for k in r.sample(range(10_000), n):
            text = r.choice([None, "", "x", f"text {k}", "ÄÖ"])
            rows.append((k, g, (k, g, text)))
    check(spark, rows, fanout, levels)


def test_equal_rows_null_keys_and_empty_tables(spark):
    rows = [(1, "a", (1, "a", "x"))] * 5 + [(1, "a", (1, "a", "y")), (None, "a", (None, "a", "x")), (None, None, (None, None, None))] * 3
    check(spark, rows, 2, 1)
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert merkle.manifest(none, ["doc_id", "lang", "text"]).collect() == []


def test_extra_columns_do_not_matter(spark):
    a = spark.createDataFrame([(i, "a", "x", 5, 6, "k") for i in range(20)], "doc_id long, lang string, text string, root int, grp int, `key` string")
    b = a.select("doc_id", "lang", "text")
    fields = ["doc_id", "lang", "text"]
    assert merkle.manifest(a, fields, fanout=2, levels=1).first()["root"] == merkle.manifest(b, fields, fanout=2, levels=1).first()["root"]


def test_long_texts_and_lone_leaves(spark):
    text = "Wort " * 400_000
    df = spark.createDataFrame([(7, "de", text)], "doc_id long, lang string, text string")
    r = merkle.manifest(df, ["doc_id", "lang", "text"]).first()
    assert r.leaf == r.subroot == r.root == leaf((7, "de", text)) and r.proof == []


def test_query_matches_a_plain_tree(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    values = {d.doc_id: (d.doc_id, d.source, d.lang, d.n_chars, d.text) for d in docs}
    want = {k: (lf, sub, root, proof) for k, lf, sub, root, proof in plain([(d.doc_id, d.lang, values[d.doc_id]) for d in docs])}
    rows = merkle.op12(spark, sf).collect()
    assert len(rows) == len(docs)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in rows:
        lf, sub, root, proof = want[r.doc_id]
        assert (r.leaf, r.subroot, r.root) == (lf, sub, root)
        assert r.proof_sha256 == h("".join(x for a, b in proof for x in [*a, *b]))
        v = values[r.doc_id]
        tampered = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and v[4] is not None
        start = leaf((*v[:4], v[4].translate(low))) if tampered else lf
        assert r.folded_root == folded(start, proof) and r.verified == (r.folded_root == root)
        assert tampered or r.verified
    assert not all(r.verified for r in rows)
