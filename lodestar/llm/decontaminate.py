"""Benchmark decontamination by the CGK embedding.

Items and windows are sequences of words (A-Z lower-cased, ASCII punctuation left out). An item is cut into pieces of at most
``piece`` words of nearly equal sizes: where a text is within d edits of the item, some piece is within its own share of them, so
that piece alone finds the place, and walks never get long enough to drift apart. A window of a piece's size begins at
every word of every text. The CGK embedding walks along a sequence: step j emits the current word and moves on if a random
bit of (j, word) says so; sequences at a small edit distance emit the same words at most steps. Each walk
gives ``samples`` keys from ``bits`` sampled steps each; a window and a piece with an equal key are a candidate. ``walks`` is the number of
walks that reach ``recall`` on random sequences of that size with as many edits as allowed, be they replacements, deletions or
insertions. The exact edit distance decides: the whole item is compared with the text around the window, its beginning free within d
words or more, and leaks where some part of the text is within ``max_edits`` of its words.

Windows that cannot qualify are left out first, without loss: a piece within d edits of a text keeps all but 2d of its
different neighbouring word pairs. Two fixed-size bit tables of the benchmark's pairs and words (all, and
pairs by piece size) test that.

Items without a word are ignored; null and empty texts have no window; no item means no leak. A very long text is read whole, window by
window; a window carries at most about 2.8 times the words of the longest item that has a piece of its size. Texts with equal doc_id and
text share one key, rows with equal doc_id and other texts are told apart. All columns stay with ``remove_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.rows import packed, unpacked
from lodestar.llm.text import MARKS, map_arrow, mix, slices, words
from lodestar.session import stored


@dataclass(frozen=True)
class Leak:
    max_edits: float = 0.2     # part of an item's words
    piece: int = 30            # most words of a piece of an item
    recall: float = 0.97       # of a piece's places with the most edits allowed, of any one kind
    most_walks: int = 20       # independent walks, at most
    samples: int = 4           # keys from each
    bits: int = 2              # sampled steps of each key
    table: int = 1 << 22       # bits of each pair table


def _allowed(n: np.ndarray | int, leak: Leak):
    return np.floor(np.asarray(n) * leak.max_edits + 1e-9).astype(np.int64)


def _pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(3) + mix(h[1:])) if len(h) > 1 else h[:0]


def embed(rows: np.ndarray, leak: Leak, walks: int) -> np.ndarray:
    """Keys (rows, walks x samples) of sequences of one length n: ``rows`` is (rows, n) word hashes."""
    count, n = rows.shape
    padded = np.concatenate([rows, np.zeros((count, 1), np.uint64)], 1).ravel()
    r = np.random.default_rng(977 * n + 13)
    steps = np.sort(r.integers(0, 2 * n, (leak.most_walks, leak.samples, leak.bits)), 2)
    seeds = r.integers(1, 1 << 62, (leak.most_walks, 2 * n + 1)).astype(np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    keys = np.empty((walks * leak.samples, count), np.uint64)
    keys[:] = (np.arange(walks * leak.samples, dtype=np.uint64) * np.uint64(100_003) + np.uint64(n))[:, None]
    line = np.arange(count) * (n + 1)
    for k in range(walks):
        at = line.copy()
        for j in range(int(steps[k].max()) + 1):
            word = padded[at]
            for i in np.flatnonzero((steps[k] == j).any(1)):
                keys[k * leak.samples + i] = mix(keys[k * leak.samples + i] ^ word)
            # words are well mixed already: one product gives a random bit
            at = np.minimum(at + ((word ^ seeds[k, j]) * odd >> np.uint64(63)).astype(np.int64), line + n)
    return keys.T.copy()


@lru_cache(None)
def walks(n: int, leak: Leak) -> int:
    """Walks for sequences of n words: the fewest that find ``recall`` of 250 random ones for each kind of edit, as many as allowed."""
    d, trials = int(_allowed(n, leak)), 250
    if d == 0:
        return 1
    r = np.random.default_rng(31 * n + 7)
    whole = r.integers(1, 1 << 62, (trials, n + d)).astype(np.uint64)
    other = r.integers(1, 1 << 62, (trials, n + d)).astype(np.uint64)
    known = embed(whole[:, :n], leak, leak.most_walks)
    found = []
    for kind in ("replace", "delete", "insert"):
        edited = np.empty((trials, n), np.uint64)
        for t in range(trials):
            at = np.sort(r.choice(np.arange(1, n), min(d, n - 1), replace=False))
            if kind == "replace":
                edited[t] = whole[t, :n]
                edited[t, at] = other[t, at]
            elif kind == "delete":
                edited[t] = np.delete(np.concatenate([whole[t, :n], other[t, :len(at)]]), at)
            else:
                edited[t] = np.insert(whole[t, :n], at, other[t, :len(at)])[:n]
        hit = (known == embed(edited, leak, leak.most_walks)).reshape(trials, leak.most_walks, leak.samples).any(2)
        found.append(np.logical_or.accumulate(hit, 1).mean(0))
    enough = np.flatnonzero(np.min(found, 0) >= leak.recall)
    return int(enough[0]) + 1 if len(enough) else leak.most_walks


def distances(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edit distance of each item (rows, n) to the nearest part of its text (rows, m; 0 pads the end), and where that part begins and ends."""
    m, one = texts.shape[1], np.int64(1 << 32)
    place = np.arange(m + 1) * one
    best = np.tile(np.arange(m + 1, dtype=np.int64), (len(items), 1))          # edits x one + beginning
    for i in range(items.shape[1]):
        swap = best[:, :-1] + (texts != items[:, i:i + 1]) * one
        now = np.concatenate([best[:, :1] + one, np.minimum(swap, best[:, 1:] + one)], 1)
        best = np.minimum.accumulate(now - place, 1) + place
    best = np.where(np.concatenate([np.zeros((len(items), 1), bool), texts == 0], 1), np.int64(1 << 62), best)
    end = best.argmin(1)
    least = best[np.arange(len(items)), end]
    return least >> 32, least & (one - 1), end


def item_words(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id``, ``size`` and ``whole`` (word hashes as bytes) of the items with words."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            w = words(data, offsets, MARKS)
            blobs = [w.hash[a:b].tobytes() for a, b in zip(w.of[:-1], w.of[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(np.diff(w.of)), pa.array(blobs, pa.binary())], ["item_id", "size", "whole"])

    kind = benchmark.schema[item_id].dataType.simpleString()
    return map_arrow(benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")), each, f"item_id {kind}, size long, whole binary").where("size > 0")


def item_pieces(items: DataFrame, leak: Leak) -> DataFrame:
    """``item_id``, ``size`` (words of the item), ``offset``, ``n`` (words of the piece), ``pairs`` (its different neighbouring pairs), ``item`` (its words)."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, blob in enumerate(batch.column("whole").to_pylist()):
                h = np.frombuffer(blob, np.uint64)
                cut = np.linspace(0, len(h), -(-len(h) // leak.piece) + 1).astype(np.int64)
                parts = [h[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                same = pa.array(np.full(len(parts), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").take(same), pa.array(np.full(len(parts), len(h))), pa.array(cut[:-1]), pa.array(np.diff(cut)),
                     pa.array([len(np.unique(_pairs(x))) for x in parts], pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())],
                    ["item_id", "size", "offset", "n", "pairs", "item"])

    kind = items.schema["item_id"].dataType.simpleString()
    return map_arrow(items, each, f"item_id {kind}, size long, offset long, n long, pairs long, item binary")


def _kept(item: np.ndarray, text: np.ndarray) -> int:
    """Different pairs of the item that the text holds, less all of them."""
    own = np.unique(_pairs(item))
    return int(np.isin(own, _pairs(text)).sum()) - len(own)


def _tables(items: DataFrame, leak: Leak) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit tables of all pairs and of (pair, size), the piece sizes and the fewest pairs of a piece of each.
    The driver gets at most two tables of ``leak.table`` bits and one row for each of at most ``leak.piece`` sizes."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, blob in zip(batch.column("n").to_pylist(), batch.column("item").to_pylist(), strict=True):
                h = np.frombuffer(blob, np.uint64)
                p = _pairs(h)
                where = np.concatenate([p, mix(p ^ np.uint64(n)), mix(h)]) % np.uint64(leak.table)
                kind = np.concatenate([np.zeros(len(p)), np.ones(len(p)), np.zeros(len(where) - 2 * len(p))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array((where >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (where & np.uint64(63))).view(np.int64))], ["kind", "w", "m"])

    got = map_arrow(items, each, "kind int, w long, m long").groupBy("kind", "w").agg(F.bit_or("m").alias("m")).toPandas()
    tables = np.zeros((2, leak.table // 64), np.uint64)
    tables[got["kind"].to_numpy(np.int64), got["w"].to_numpy(np.int64)] = got["m"].to_numpy(np.int64).view(np.uint64)
    sizes = np.array(sorted((r["n"], r["p"]) for r in items.groupBy("n").agg(F.min("pairs").alias("p")).collect()), np.int64).reshape(-1, 2)
    return tables[0], tables[1], sizes[:, 0], sizes[:, 1]


def _in(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    p = h & np.uint64(len(table) * 64 - 1)
    return (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)


def _different(pair: np.ndarray, hit: np.ndarray, by_size: np.ndarray, start: np.ndarray, last: np.ndarray, n: int, reach: int) -> np.ndarray:
    """Different pairs of pieces of size n in the window of each start."""
    grid = start[:, None] + np.arange(reach)
    inside = grid < last[:, None]
    grid = np.minimum(grid, len(pair) - 1)
    value = np.where(inside & hit[grid], pair[grid], np.uint64(0))
    value[~_in(by_size, mix(value ^ np.uint64(n)))] = 0
    value.sort(1)
    return (value[:, 0] != 0) + ((value[:, 1:] != value[:, :-1]) & (value[:, 1:] != 0)).sum(1)


def _survivors(h: np.ndarray, of: np.ndarray, known: np.ndarray, by_size: np.ndarray, sizes: np.ndarray, fewest: np.ndarray, leak: Leak) -> Iterator[tuple[int, np.ndarray]]:
    """(size, starts) of the windows that may hold a piece of that size."""
    if not len(h) or not len(sizes):
        return
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    pair = np.zeros(len(h), np.uint64)
    pair[:-1] = _pairs(h)
    joined = np.zeros(len(h), bool)
    joined[:-1] = doc[1:] == doc[:-1]
    hit = joined & _in(known, pair)
    sums = np.zeros(len(h) + 1, np.int64)
    np.cumsum(hit, out=sums[1:])
    last = of[1:][doc]
    begins = _in(known, mix(h))
    start = np.flatnonzero(begins)                 # a best match can be taken to begin with a word of the item
    all_least = fewest - 2 * _allowed(sizes, leak)
    if all_least.min() > 0:                        # what any size needs, before each size is tried
        reach = int((sizes + _allowed(sizes, leak)).max())
        start = start[sums[np.minimum(start + reach - 1, len(h))] - sums[start] >= all_least.min()]
    for n, d, least in zip(sizes, _allowed(sizes, leak), all_least, strict=True):
        if least <= 0:
            some = start
        else:
            some = start[sums[np.minimum(start + n + d - 1, len(h))] - sums[start] >= least]
        some = some[some + n - d <= last[some]]
        if least > 0 and len(some):
            parts = [some[k:k + 20_000] for k in range(0, len(some), 20_000)]
            some = np.concatenate([p[_different(pair, hit, by_size, p, last[p], int(n), int(n + d - 1)) >= least] for p in parts])
        if len(some):
            yield int(n), some


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", leak: Leak = Leak()) -> DataFrame:
    """``doc_id``, ``doc_key`` (hash of id and text), ``item_id``, ``start`` and ``length`` (words), ``distance``, ``item_words``:
    the nearest place of each item that leaks into a text."""
    items = stored(item_words(benchmark))
    pieces = stored(item_pieces(items, leak))
    edits = lambda n: F.floor(n * leak.max_edits + 1e-9)
    # the words before and after a window's start that its items reach, by piece size: at most leak.piece rows
    around = {r["n"]: (r["lead"], r["tail"]) for r in pieces.groupBy("n").agg(
        F.max(F.col("offset") + 2 * edits(F.col("size"))).alias("lead"), F.max(F.col("size") - F.col("offset") + 3 * edits(F.col("size"))).alias("tail")).collect()}
    shipped = docs.sparkSession.sparkContext.broadcast((_tables(pieces, leak), around, {n: walks(n, leak) for n in around}))     # 2 x leak.table bits

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        serial = (task.partitionId() if task else 0) << 40
        tables, reach, times = shipped.value
        for batch, data, offsets in slices(batches):
            w = words(data, offsets, MARKS)
            for n, at in _survivors(w.hash, w.of, *tables, leak):
                doc = np.searchsorted(w.of, at, "right") - 1
                before, after = reach[n]
                some = max(1, min(50_000, 2_000_000 // (before + after)))
                for k in range(0, len(at), some):
                    p, d = at[k:k + some], doc[k:k + some]
                    grid = p[:, None] + np.arange(n)
                    keys = embed(np.where(grid < w.of[d + 1][:, None], w.hash[np.minimum(grid, len(w.hash) - 1)], np.uint64(0)), leak, times[n])
                    first, last = np.maximum(p - before, w.of[d]), np.minimum(p + after, w.of[d + 1])
                    ids = serial + np.arange(len(p))
                    serial += len(p)
                    keyed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids), batch.column("doc_id").take(pa.array(d)), batch.column("doc_key").take(pa.array(d)), pa.array(p - w.of[d]), pa.array(first - w.of[d]),
                         keyed, pa.array([w.hash[x:y].tobytes() for x, y in zip(first, last, strict=True)], pa.binary())],
                        ["window", "doc_id", "doc_key", "start", "first", "keys", "words"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("doc_key"), F.col(text).alias("text"))
    found = stored(map_arrow(rows, windows, f"window long, doc_id {kind}, doc_key long, start long, first long, keys array<long>, words binary"))

    def key_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece = [np.frombuffer(b, np.uint64) for b in batch.column("item").to_pylist()]
            size = np.array([len(x) for x in piece])
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                keys = embed(np.stack([piece[i] for i in at]), leak, shipped.value[2][int(n)])
                whose = pa.array(np.repeat(at, keys.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(whose), batch.column("offset").take(whose), pa.array(keys.ravel().view(np.int64))], ["item_id", "offset", "key"])

    item_kind = items.schema["item_id"].dataType.simpleString()
    keyed = map_arrow(pieces, key_pieces, f"item_id {item_kind}, offset long, key long")
    near = found.select("window", F.explode("keys").alias("key")).join(keyed, "key").select("window", "item_id", "offset").distinct()
    # one comparison for each d + 1 places where the item would begin, whichever pieces found them
    near = near.join(found.select("window", "doc_key", "start"), "window").join(items.select("item_id", "size"), "item_id")
    step = edits(F.col("size")) + 1
    places = near.withColumn("at", F.floor((F.col("start") - F.col("offset")) / step) * step)
    places = places.groupBy("doc_key", "item_id", "at").agg(F.min("window").alias("window")).select("window", "item_id", "at")
    pairs = places.join(found.select("window", "doc_id", "doc_key", "first", "words"), "window").join(items, "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at, first = (batch.column(c).to_numpy(False) for c in ("size", "at", "first"))
            dist, start, length = np.full(len(n), 1 << 30, np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            texts, item = batch.column("words"), batch.column("whole")
            for size in np.unique(n):
                same = np.flatnonzero(n == size)
                d = int(_allowed(size, leak))
                width = int(size) + 4 * d
                some = max(1, 500_000 // width)
                for k in range(0, len(same), some):
                    these = same[k:k + some]
                    a = np.stack([np.frombuffer(item[int(i)].as_buffer(), np.uint64) for i in these])
                    b = np.zeros((len(these), width), np.uint64)
                    begin = np.maximum(at[these] - d - first[these], 0)
                    for j, i in enumerate(these):
                        part = np.frombuffer(texts[int(i)].as_buffer(), np.uint64)[begin[j]:max(0, at[i] - first[i] + int(size) + 3 * d)]
                        b[j, :len(part)] = part
                    if size > leak.piece:             # one piece is alike: does the rest keep enough pairs?
                        fit = np.array([_kept(x, y) >= -2 * d for x, y in zip(a, b, strict=True)])
                        these, a, b, begin = these[fit], a[fit], b[fit], begin[fit]
                    if len(these):
                        dist[these], low, high = distances(a, b)
                        start[these], length[these] = first[these] + begin + low, high - low
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "doc_key", "item_id")], pa.array(start), batch.column("size"), pa.array(length), pa.array(dist)],
                                             ["doc_id", "doc_key", "item_id", "start", "n", "length", "distance"])

    checked = map_arrow(pairs.select("doc_id", "doc_key", "item_id", "at", "first", "size", "words", "whole"), verify,
                        f"doc_id {kind}, doc_key long, item_id {item_kind}, start long, n long, length long, distance long")
    good = checked.where(F.col("distance") <= F.floor(F.col("n") * leak.max_edits + 1e-9))
    best = good.groupBy("doc_id", "doc_key", "item_id").agg(F.min(F.struct("distance", "start", "length", "n")).alias("b"))
    return best.select("doc_id", "doc_key", "item_id", "b.start", "b.length", "b.distance", F.col("b.n").alias("item_words"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows without any leak, with the columns they came with."""
    keys = stored(find_leaks(docs, benchmark, **options).select(F.col("doc_key").alias("_leaked")).distinct())
    rows = packed(docs, _key=F.xxhash64("doc_id", "text"))
    return unpacked(rows.join(keys, F.col("_key") == F.col("_leaked"), "left_anti"), docs)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return find_leaks(docs, benchmark).select("doc_id", "item_id", "start", "length", "distance", "item_words")
