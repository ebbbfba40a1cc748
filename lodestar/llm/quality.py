"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of the whole text are transformed (logarithms and log-odds), standardised, and scored by two Gaussians, one per
label, whose covariances are shrunk towards the pooled one and towards a scaled identity. The model caches the Cholesky
factors; a score is the logistic of the difference of Mahalanobis log densities plus the log prior odds.

Means and covariances come from sums over all labelled rows: tasks add up, the driver gets 2 x (d + d(d + 1) / 2) numbers.

A null or empty text has the statistics of no words and gets a score too. A label without a document is ignored; a document
with several labels counts once for each. With fewer than two labelled classes the score is the share of label 1 (0.5 if
there is no label at all). Columns of other names stay with ``score_quality``, its
own names replace theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.language import fold
from lodestar.llm.rows import rest
from lodestar.llm.text import map_arrow, slices, words
from lodestar.session import stored

NAMES = ("words", "bytes_per_word", "upper", "digits", "stops", "symbols", "marks", "wide", "lines", "repeated_lines", "distinct_words", "repeated_triples",
         "one_letter", "long_words", "line_spread")
D = len(NAMES)
_CLASS = np.zeros(256, np.int64)          # 0 lower, 1 upper, 2 digit, 3 stop, 4 symbol, 5 other marks, 6 beyond ASCII, 7 space
_CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 6
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = 3 if chr(_c) in ".,;:'\"()-?" else 4 if chr(_c) in "#*$%&|<>" else 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 7


@dataclass(frozen=True)
class Shrink:
    pooled: float = 0.1       # part of the pooled covariance in a class's
    identity: float = 0.02    # part of the scaled identity in the result
    clip: float = 8.0         # standardised statistics are cut here, so that one odd statistic doesn't decide alone


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray         # (2, D)
    factors: np.ndarray       # (2, D, D): Cholesky factors of the covariances
    prior: float              # log odds of label 1
    flat: float | None = None  # the score if there are no two classes


def _odds(part: np.ndarray) -> np.ndarray:
    p = np.clip(part, 0, 1) * 0.998 + 0.001
    return np.log(p / (1 - p))


def _sums(of: np.ndarray, x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1)
    np.cumsum(x, out=total[1:])
    return total[of[1:]] - total[of[:-1]]


def _distinct(at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Number of different hashes in each text."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=len(at) - 1).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, D) transformed statistics."""
    raw, n = data, len(offsets) - 1
    w = words(data, offsets)
    count = np.diff(w.of).astype(float)
    some = np.maximum(count, 1)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    kind = _CLASS[raw]
    share = [_sums(offsets, kind == k) / size for k in (1, 2, 3, 4, 5, 6)]
    length = (w.end - w.start).astype(float)
    h = w.hash
    triple_rows = np.maximum(np.diff(w.of) - 2, 0)
    if len(h) >= 3:
        doc = np.repeat(np.arange(n), np.diff(w.of))
        triple = h[:-2] * np.uint64(3) ^ (h[1:-1] * np.uint64(5) << np.uint64(1)) ^ h[2:] * np.uint64(7)
        triple = triple[doc[:-2] == doc[2:]]
    else:
        triple = h[:0]
    triple_at = np.concatenate([[0], np.cumsum(triple_rows)])
    # lines: split at \n, empty ones left out
    breaks = np.zeros(len(raw) + 1, bool)
    breaks[offsets] = True
    newline = raw == 10
    solid = ~newline
    first = solid.copy()
    first[1:] &= newline[:-1] | breaks[1:len(raw)]
    starts = np.flatnonzero(first)
    line_of = np.searchsorted(starts, offsets)
    lines = np.maximum(np.diff(line_of), 1).astype(float)
    word_line = np.searchsorted(starts, w.start, "right") - 1
    line_hash = np.zeros(len(starts), np.uint64)
    place = np.arange(len(h), dtype=np.uint64)
    if len(h):
        begin = np.searchsorted(w.start, starts)
        np.add.at(line_hash, word_line, h * (place - begin[word_line].astype(np.uint64) + np.uint64(1)))
    line_words = np.bincount(word_line, minlength=len(starts)).astype(float) if len(h) else np.zeros(len(starts))
    mean_line = _sums(line_of, line_words) / lines
    spread = np.sqrt(np.maximum(0, _sums(line_of, line_words ** 2) / lines - mean_line ** 2))
    x = [np.log1p(count), np.log1p(_sums(w.of, length) / some), *map(_odds, share), np.log1p(lines),
         _odds(1 - _distinct(line_of, line_hash) / lines), _odds(_distinct(w.of, h) / some),
         _odds(1 - _distinct(triple_at, triple) / np.maximum(triple_rows, 1)) if len(triple) else _odds(np.zeros(n)),
         _odds(_sums(w.of, length == 1) / some), _odds(_sums(w.of, length > 15) / some), np.log1p(spread)]
    return np.stack(x, 1)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns of ``docs`` but the text, with ``stats`` (array of D doubles)."""
    others = rest(docs, text, "stats")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, text):
            x = statistics(data, offsets)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, D), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in others], values], [*others, "stats"])

    fields = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others], "stats array<double>"])
    return map_arrow(docs.select(*others, text), each, fields)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(False).reshape(-1, D)


def learn(rows: DataFrame, shrink: Shrink = Shrink()) -> Model:
    """``rows``: ``stats`` and ``label`` (0 or 1; others are ignored), one row per label."""
    rows = rows.where(F.col("label").isin(0, 1)).select("stats", F.col("label").cast("int").alias("label"))
    width = 1 + D + D * D

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for batch in batches:
            x, y = _matrix(batch.column("stats")), batch.column("label").to_numpy(False)
            for k in (0, 1):
                v = x[y == k]
                total[k] += np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()])
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width, k, np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array(total[k])], ["label", "i", "v"])

    sums = np.zeros((2, width))
    for r in map_arrow(rows, add, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect():
        sums[r["label"], r["i"]] = r["v"]
    n = sums[:, 0]
    if n.min() < 2:
        return Model(np.zeros(D), np.ones(D), np.zeros((2, D)), np.stack([np.eye(D)] * 2), 0.0, float(n[1] / n.sum()) if n.sum() else 0.5)
    means = sums[:, 1:1 + D] / n[:, None]
    scatter = sums[:, 1 + D:].reshape(2, D, D) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    centre = sums[:, 1:1 + D].sum(0) / n.sum()
    second = np.diagonal(sums[:, 1 + D:].reshape(2, D, D).sum(0)) / n.sum() - centre ** 2
    scale = np.sqrt(np.maximum(second, 1e-6))
    scatter = scatter / scale[:, None] / scale[None, :]
    pooled = scatter.sum(0) / n.sum()
    factors = []
    for k in (0, 1):
        c = (1 - shrink.pooled) * scatter[k] / n[k] + shrink.pooled * pooled
        c = (1 - shrink.identity) * c + shrink.identity * max(np.trace(c) / D, 1e-3) * np.eye(D)
        factors.append(np.linalg.cholesky((c + c.T) / 2 + 1e-6 * np.eye(D)))
    return Model(centre, scale, (means - centre) / scale, np.stack(factors), float(np.log(n[1] / n[0])))


def score_rows(model: Model, stats: np.ndarray, shrink: Shrink = Shrink()) -> np.ndarray:
    if model.flat is not None:
        return np.full(len(stats), model.flat)
    z = np.clip((stats - model.centre) / model.scale, -shrink.clip, shrink.clip)
    logs = []
    for k in (0, 1):
        y = np.linalg.solve(model.factors[k], (z - model.means[k]).T)
        logs.append(-0.5 * (y * y).sum(0) - np.log(np.diagonal(model.factors[k])).sum())
    return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + model.prior, -500, 500)))


def score_quality(rows: DataFrame, model: Model) -> DataFrame:
    """Columns of ``rows`` but ``stats``, with ``score``."""
    others = rest(rows, "stats", "score")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = score_rows(model, _matrix(batch.column("stats")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(value)], [*others, "score"])

    fields = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others], "score double"])
    return map_arrow(rows.select(*others, "stats"), each, fields)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    held = fold(F.col("doc_id"), 3) == 1
    rows = stored(with_statistics(docs.select("doc_id", held.alias("held_out"), "text")))      # a row of D numbers each
    model = learn(rows.where(~F.col("held_out")).join(labels, "doc_id").select("stats", "label"))
    return score_quality(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
