"""Line dedup by winnowing over line hashes.

Lines are split at ``\\n``; blank lines are passed over. A block begins at every line and holds the fewest following lines with
``min_words`` words together. Winnowing selects in each block the smallest line hash (the last one of equal ones), so equal
blocks select the same line: its hash is a fingerprint that both are sure to share. Blocks whose fingerprint occurs twice are
joined by their content; all but the first (by doc_id, text hash, line) are later repeats. A match is then extended line by
line both ways against the document of the first occurrence, and the later run is deleted.

A null text stays null, an empty one empty. Rows with equal doc_id and text count as one document and get equal results. An
empty table gives an empty result. Columns of other names stay with ``dedup_lines``, its own names replace theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.rows import unpacked
from lodestar.llm.text import map_arrow, mix, slices, words
from lodestar.session import stored


@dataclass(frozen=True)
class Repeat:
    min_words: int = 50      # of a repeated run


def _line_table(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """One row per text: hashes and word counts of its lines that are not blank, and their numbers."""
    w = words(data, offsets)
    n = len(offsets) - 1
    stop = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=stop[1:])
    line = stop[w.start]                                             # newlines before the word
    doc = np.repeat(np.arange(n), np.diff(w.of))
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    place = (np.arange(len(line)) - first[which]).astype(np.uint64) if len(line) else np.zeros(0, np.uint64)
    h = np.zeros(len(first), np.uint64)
    np.add.at(h, which, mix(w.hash + place * np.uint64(0x9E3779B97F4A7C15)))
    at = np.searchsorted(first, w.of)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x))
    size = np.diff(np.append(first, len(line)))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc_key"), lists(mix(h).view(np.int64)), lists(size.astype(np.int32)),
                                       lists((line[first] - stop[offsets[doc[first]]]).astype(np.int32))], ["doc_id", "doc_key", "hashes", "sizes", "numbers"])


def _blocks(hashes: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First line, last line, fingerprint and content hash of each block of one text."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    end = np.searchsorted(total, total[:-1] + least)                 # lines p..end-1 have at least ``least`` words
    start = np.flatnonzero(end < len(total))
    end = end[start]
    print_, content = hashes[start].copy(), mix(hashes[start])
    for k in range(1, int((end - start).max()) if len(start) else 0):
        more = start + k < end
        h = hashes[np.minimum(start + k, len(hashes) - 1)]
        print_ = np.where(more & (h <= print_), h, print_)
        content = np.where(more, mix(content ^ h) + np.uint64(k), content)
    return start, end - 1, print_, content


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repeat: Repeat = Repeat()) -> DataFrame:
    """``doc_key`` (hash of id and text), ``line`` numbers (array, from 0) to delete, ``runs``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("doc_key"), F.col(text).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            yield _line_table(batch, data, offsets)

    fields = f"doc_id {kind}, doc_key long, hashes array<long>, sizes array<int>, numbers array<int>"
    table = stored(map_arrow(rows, split, fields).dropDuplicates(["doc_key"]))       # the lines' hashes, not their text

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, s = batch.column("hashes"), batch.column("sizes")
            at, hv, sv = h.offsets.to_numpy(), h.values.to_numpy(False).view(np.uint64), s.values.to_numpy(False)
            out = [[], [], [], [], []]
            for i in range(batch.num_rows):
                got = _blocks(hv[at[i]:at[i + 1]], sv[at[i]:at[i + 1]], repeat.min_words)
                for k, x in enumerate((np.full(len(got[0]), i), *got)):
                    out[k].append(x)
            i, start, last, mark, content = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            i = i.astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(i)), batch.column("doc_key").take(pa.array(i)), pa.array(start.astype(np.int32)),
                                              pa.array(last.astype(np.int32)), pa.array(mark.astype(np.uint64).view(np.int64)), pa.array(content.astype(np.uint64).view(np.int64))],
                                             ["doc_id", "doc_key", "p", "q", "mark", "content"])

    blocks = map_arrow(table.select("doc_id", "doc_key", "hashes", "sizes"), block, f"doc_id {kind}, doc_key long, p int, q int, mark long, content long")
    marks = blocks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
    shared = stored(blocks.join(marks, "mark", "left_semi").drop("mark"))
    place = F.struct("doc_id", "doc_key", "p")
    first = shared.groupBy("content").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("content", "first")
    later = (shared.join(first, "content").where((F.col("first.doc_key") != F.col("doc_key")) | (F.col("first.p") != F.col("p")))
             .select("doc_key", "p", "q", F.col("first.doc_key").alias("from"), F.col("first.p").alias("o")))
    lines = table.select("doc_key", "hashes", "sizes")
    theirs = lines.select(F.col("doc_key").alias("from"), F.col("hashes").alias("others"))
    pairs = later.join(lines, "doc_key").join(theirs, "from")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = batch.column("hashes"), batch.column("others")
            a_at, a, b_at, b = own.offsets.to_numpy(), own.values.to_numpy(False), other.offsets.to_numpy(), other.values.to_numpy(False)
            low, high = [], []
            key, source = batch.column("doc_key").to_numpy(False), batch.column("from").to_numpy(False)
            for i, (p, q, o) in enumerate(zip(batch.column("p").to_numpy(False), batch.column("q").to_numpy(False), batch.column("o").to_numpy(False), strict=True)):
                x, y = a[a_at[i]:a_at[i + 1]], b[b_at[i]:b_at[i + 1]]
                shift, floor = o - p, -1
                if key[i] == source[i]:                # inside one text the later run must not grow into the first
                    floor = o + (q - p)
                lo, hi = p, q
                while lo > max(0, floor + 1) and lo + shift > 0 and x[lo - 1] == y[lo + shift - 1]:
                    lo -= 1
                while hi + 1 < len(x) and hi + shift + 1 < len(y) and x[hi + 1] == y[hi + shift + 1]:
                    hi += 1
                low.append(lo)
                high.append(hi)
            yield pa.RecordBatch.from_arrays([batch.column("doc_key"), pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["doc_key", "lo", "hi"])

    spans = map_arrow(pairs.select("doc_key", "p", "q", "from", "o", "hashes", "others"), extend, "doc_key long, lo int, hi int").distinct()
    # at most one span per line of a text
    gone = spans.groupBy("doc_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("lo", "hi"))))).alias("lines"))
    runs = F.size(F.filter("lines", lambda i: ~F.array_contains("lines", i - 1)))
    named = gone.withColumn("runs", runs).join(table.select("doc_key", "numbers", "sizes"), "doc_key")
    words_gone = F.aggregate(F.transform("lines", lambda i: F.col("sizes")[i]), F.lit(0), lambda x, y: x + y)
    return named.select("doc_key", F.transform("lines", lambda i: F.col("numbers")[i]).alias("lines"), "runs", words_gone.alias("words"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repeat: Repeat = Repeat()) -> DataFrame:
    """All rows and columns; the text without later repeated runs, with ``removed_lines removed_words removed_runs``."""
    gone = stored(repeated_runs(docs, doc_id, text, repeat)).select(F.col("doc_key").alias("_key"), F.col("lines").alias("_lines"), F.col("runs").alias("_runs"), F.col("words").alias("_words"))
    others = docs.drop(text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others.columns]).alias("_row"), F.col(text).alias("_text"), F.xxhash64(doc_id, text).alias("_of"))
    # the runs grow with the texts: the same shuffled join at every size, no broadcast of them
    out = rows.join(gone.hint("merge"), F.col("_of") == F.col("_key"), "left")
    kept = F.filter(F.split("_text", "\n"), lambda x, i: ~F.array_contains("_lines", i))
    out = out.withColumn(text, F.when(F.col("_lines").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = out.withColumns({"removed_lines": F.coalesce("_lines", F.array().cast("array<int>")), "removed_words": zero(F.col("_words")), "removed_runs": zero(F.col("_runs"))})
    return unpacked(out, others, text, "removed_lines", "removed_words", "removed_runs")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "removed_runs", "removed_words", F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"))
