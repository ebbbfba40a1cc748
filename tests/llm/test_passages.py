"""Decontamination, line dedup, shards and the pipeline against brute force on small data."""

import collections
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np

from lodestar.llm import decontaminate as dc, lines, sharding as sh

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def bare(t):
    return re.findall(r"[^\s!-/:-@\[-`{-~]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def within(item, text):
    best = [0] * (len(text) + 1)
    for x in item:
        now = [best[0] + 1]
        for j, y in enumerate(text):
            now.append(min(best[j] + (x != y), best[j + 1] + 1, now[j] + 1))
        best = now
    return min(best)


def planted(spark, edits, seed):
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in "abcdefgh" for b in range(60)]
    items = [(k, " ".join(r.choices(vocab, k=r.randrange(12, 60)))) for k in range(40)] + [(90, None), (91, " "), (92, "solo"), (93, "two words"), (94, "a short three-word item")]
    rows = []
    for k in range(200):
        i, t = items[r.randrange(40)]
        w = t.split()
        for _ in range(int(len(w) * edits)):
            p, op = r.randrange(len(w)), r.choice("sid")
            if op == "s":
                w[p] = r.choice(vocab)
            elif op == "d":
                del w[p]
            else:
                w.insert(p, r.choice(vocab))
        rows.append((k, " ".join([*r.choices(vocab, k=r.randrange(80)), *w, *r.choices(vocab, k=r.randrange(80))])))
    rows += [(1000 + k, " ".join(r.choices(vocab, k=150))) for k in range(100)] + [(2000, None), (2001, ""), (2002, "Two, WORDS!"), (2003, "x solo"), (2004, "two-words")]
    return rows, items, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_leaks_match_exact_edit_distances(spark):
    for edits, seed in ((0.0, 1), (0.1, 2), (0.2, 3)):
        rows, items, docs, bench = planted(spark, edits, seed)
        want = set()
        for d, t in rows:
            for i, x in items:
                if bare(x) and within(bare(x), bare(t)) <= int(len(bare(x)) * 0.2 + 1e-9):
                    want.add((d, i))
        got = {(r.doc_id, r.item_id): r for r in dc.find_leaks(docs, bench).collect()}
        assert not set(got) - want and len(set(got) & want) >= 0.97 * len(want)
        text, item = dict(rows), dict(items)
        for (d, i), r in got.items():
            assert r.distance == within(bare(item[i]), bare(text[d])[r.start:r.start + r.length])


def test_recall_of_long_items_with_edits_of_one_kind(spark):
    r = random.Random(7)
    vocab = [f"{a}{b}" for a in "abcdefgh" for b in range(400)]
    sizes, kinds, trials = (30, 60, 100, 200, 400), "sidm", 20
    items, rows = [], []
    for size in sizes:
        for kind in kinds:
            for _ in range(trials):
                w = [r.choice(vocab) for _ in range(size)]
                items.append((len(items), " ".join(w)))
                d = size // 5
                if kind == "m":
                    for _ in range(d):
                        p, op = r.randrange(len(w)), r.choice("sid")
                        w[p:p + 1] = [] if op == "d" else [r.choice(vocab)] if op == "s" else [w[p], r.choice(vocab)]
                else:
                    for p in sorted(r.sample(range(1, size - 1), d), reverse=True):
                        w[p:p + 1] = [] if kind == "d" else [r.choice(vocab)] if kind == "s" else [r.choice(vocab), w[p]]
                rows.append((len(rows), " ".join([*r.choices(vocab, k=r.randrange(40)), *w, *r.choices(vocab, k=r.randrange(40))])))
    got = {(x.doc_id, x.item_id): x for x in dc.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(d == i for d, i in got)
    for k in range(len(sizes) * len(kinds)):
        found = [got[i, i] for i in range(k * trials, (k + 1) * trials) if (i, i) in got]
        assert len(found) >= 0.95 * trials, (sizes[k // len(kinds)], kinds[k % len(kinds)], len(found))
        for x in found[:2]:
            assert x.distance == within(bare(items[x.item_id][1]), bare(rows[x.doc_id][1])[x.start:x.start + x.length])


def test_embedding_keeps_close_sequences_close():
    r = np.random.default_rng(1)
    a = r.integers(1, 1 << 62, (200, 40)).astype(np.uint64)
    b = a.copy()
    b[np.arange(200), r.integers(0, 40, 200)] = 5
    leak = dc.Leak()
    near = (dc.embed(a, leak, 10) == dc.embed(b, leak, 10)).mean()
    far = (dc.embed(a, leak, 10) == dc.embed(a[::-1], leak, 10)).mean()
    assert near > 0.4 and far < 0.01


def test_remove_leaks_keeps_the_rest(spark):
    rows, _, docs, bench = planted(spark, 0.0, 4)
    wide = docs.selectExpr("*", "1 as _leaked", "'x' as item_id")
    got = dc.remove_leaks(wide, bench)
    ids = {r.doc_id for r in got.collect()}
    assert got.columns == wide.columns and not ids & set(range(200)) and {2000, 2001} <= ids and not ids & {2002, 2003, 2004}
    assert dc.find_leaks(docs.where("false"), bench).count() == 0
    assert dc.find_leaks(docs, bench.where("false")).count() == 0


def test_rows_with_equal_ids_are_told_apart(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (1, "clean"), (None, "so one two three four five six seven"), (None, "clean")], "doc_id long, text string")
    assert sorted(map(tuple, dc.remove_leaks(docs, bench).collect()), key=repr) == [(1, "clean"), (None, "clean")]


def line_words(t):
    return [(n, tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x)))) for n, x in enumerate((t or "").split("\n"))]


def blocks(ls, least):
    for p in range(len(ls)):
        n = 0
        for q in range(p, len(ls)):
            n += len(ls[q][1])
            if n >= least:
                yield p, q, tuple(x[1] for x in ls[p:q + 1])
                break


def brute_lines(rows, least):
    first, kept = {}, {}
    for d, t in sorted(rows):
        kept[d] = [x for x in line_words(t) if x[1]]
        for p, _, c in blocks(kept[d], least):
            first.setdefault(c, (d, p))
    out = {}
    for d, t in rows:
        a, gone = kept[d], set()
        for p, q, c in blocks(a, least):
            f, o = first[c]
            if (f, o) == (d, p):
                continue
            b, shift, lo, hi = kept[f], o - p, p, q
            floor = o + q - p if f == d else -1
            while lo > max(0, floor + 1) and lo + shift > 0 and a[lo - 1][1] == b[lo + shift - 1][1]:
                lo -= 1
            while hi + 1 < len(a) and hi + shift + 1 < len(b) and a[hi + 1][1] == b[hi + shift + 1][1]:
                hi += 1
            gone |= {a[k][0] for k in range(lo, hi + 1)}
        out[d] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone) if t is not None else None
    return out


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(8)
    pool = [" ".join(r.choices("abcdefg", k=r.randrange(1, 9))) for _ in range(25)] + ["", "  "]
    rows = []
    for k in range(150):
        x = [r.choice(pool) for _ in range(r.randrange(0, 30))]
        if rows and k % 2:
            other = (rows[r.randrange(len(rows))][1] or "").split("\n")
            at = r.randrange(len(other))
            x[len(x) // 2:len(x) // 2] = other[at:at + 12]
        rows.append((k, "\n".join(x)))
    rows += [(500, None), (501, ""), (502, "A b\n" * 40), (503, "one long line " * 30), (504, "ONE long line " * 30)]
    for least in (12, 50):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {x.doc_id: x.text for x in lines.dedup_lines(df, repeat=lines.Repeat(least)).collect()}
        assert got == brute_lines(rows, least)


def test_line_dedup_of_repeated_rows_and_odd_columns(spark):
    long = "\n".join(f"line {k} of a passage that is long enough" for k in range(10))
    df = spark.createDataFrame([(1, long, 1), (1, long, 1), (2, "start\n" + long + "\nend", 2), (None, long, 3)], "doc_id long, text string, _text int")
    got = sorted(((r.doc_id, r.text, r["_text"]) for r in lines.dedup_lines(df).collect()), key=repr)
    # a null id is the smallest
    assert got == sorted([(None, long, 3), (1, "", 1), (1, "", 1), (2, "start\nend", 2)], key=repr)
    assert lines.dedup_lines(df.where("false")).count() == 0


def test_shards_follow_weights_and_grow_into_themselves(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "if(id % 9 = 0, null, repeat('é', cast(id % 40 as int))) as text", "'a' as shard")
    t = sh.tree(2, 2, 2)
    t["g1"]["r0"][0] = 3.0
    t["g0"]["r1"][1] = 0.0
    n = collections.Counter(r.shard for r in sh.assign(df, t).collect())
    weights = [w for racks in t.values() for s in racks.values() for w in s]
    for k, w in enumerate(weights):
        assert abs(n[k] / 20000 - w / sum(weights)) < 0.012
    rows = sh.assign(sh.assign(df, t), sh.grow(t), name="grown").where("grown <> shard").collect()
    assert rows and {r.grown for r in rows} == {8}


def test_changed_weight_moves_rows_of_its_subtrees_only(spark):
    df = spark.range(5000).selectExpr("id as doc_id")
    t = sh.tree(3, 2, 2)
    u = sh.tree(3, 2, 2)
    u["g1"]["r1"] = [1.0, 2.0]
    moved = sh.assign(sh.assign(df, t), u, name="now").where("now <> shard").collect()
    assert moved and all(r.now in range(4, 8) for r in moved)


def test_slots_are_gapless(spark):
    df = spark.createDataFrame([(k % 700, "t") for k in range(3000)] + [(None, None)] * 50, "doc_id long, text string").repartition(7)
    rows = sh.number(sh.assign(df, sh.tree(1, 2, 2))).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == 3050 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sh.number(sh.assign(df.where("false"))).count() == 0


def test_shard_query(spark):
    rows = sh.op9(spark, SF).collect()
    text = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(text) and all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    assert all(r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24 and r.law == "key" for r in rows)


def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "jaccard_join", "decontaminate", "source_mix", "shards"]
    raw = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as _row", "2 as copy")
    kept = corpus_pipeline.quality_rules(spark, raw, SF)
    assert kept.columns == raw.columns
    one = corpus_pipeline.near_duplicates(spark, kept, SF)
    clean = corpus_pipeline.leaks(spark, one, SF)
    ids = {r.doc_id for r in clean.collect()}
    items = [bare(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in one.collect():
        w = " ".join(bare(r.text))
        assert (r.doc_id in ids) or any(within(x, w.split()) <= int(len(x) * 0.2 + 1e-9) for x in items)
        assert not (r.doc_id in ids and any(" ".join(x) in w for x in items))
    mixed = corpus_pipeline.source_mix(spark, clean, SF)
    assert mixed.columns == raw.columns and {r.doc_id for r in mixed.collect()} <= ids
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.collect()} <= ids and out.columns == [*raw.columns[:5], "shard", "size"]
    empty = corpus_pipeline.shards(spark, corpus_pipeline.source_mix(spark, corpus_pipeline.leaks(spark, corpus_pipeline.near_duplicates(
        spark, corpus_pipeline.quality_rules(spark, raw.where("false"), SF), SF), SF), SF), SF)
    assert empty.count() == 0
