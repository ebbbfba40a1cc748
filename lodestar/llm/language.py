"""Language identification with bit-sliced Bloom filters over character n-grams.

One table of bit masks holds a Bloom filter per language: a probe ANDs the masks at an n-gram's positions and so returns all
languages that contain it. A text's hits are counted per language, corrected for the filter's false positives, and the
language with the largest corrected share of the text's n-grams wins.

The filters are fitted on a bounded sample of labelled rows (``Fit.rows`` per language in expectation, chosen by a hash of the
text); an n-gram enters the filter of a language if it is frequent there and typical of it. Every row's whole text is scored.

A null text, a text without a letter, and any text when no row is labelled get ``und`` with score 0. Equal texts get equal
results; columns of other names stay with ``identify``, its own names replace theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestar.llm.rows import rest
from lodestar.llm.text import map_arrow, mix, slices

UNKNOWN = "und"
GRAM = 4
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)


@dataclass(frozen=True)
class Fit:
    rows: int = 2000            # labelled rows of each language, in expectation
    min_rate: float = 2e-6      # least share of an n-gram among a language's
    min_part: float = 0.15      # least part of the n-gram's rates, summed over languages, that falls to the language
    bits: int = 1 << 21         # places of the table
    hashes: int = 2


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray           # (words of 64 languages, bits): masks
    false_rate: np.ndarray      # by language
    hashes: int


@lru_cache(1)
def _letters() -> np.ndarray:
    """By code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text and their offsets. Case is folded; runs of non-letters are one space, at both ends too."""
    texts = [bytes(data[a:b]).decode("utf-8", "replace").lower() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    codes = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])      # each text with the separator after it
    codes, letter = codes[1:], letter[1:]
    first = np.ones(len(codes), bool)
    first[1:] = doc[1:] != doc[:-1]
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~first[1:]                                     # the first non-letter after a letter
    codes = np.where(letter, codes, 32)[keep].astype(np.uint64)
    doc = doc[keep]
    n = len(codes)
    if n < GRAM:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        h = (h << np.uint64(16)) ^ (h >> np.uint64(48)) ^ codes[k:n - GRAM + 1 + k] * np.uint64(0x9E3779B97F4A7C15 if k % 2 else 0xC2B2AE3D27D4EB4F)
    same = doc[:n - GRAM + 1] == doc[GRAM - 1:]
    return mix(h[same]), np.searchsorted(doc[:n - GRAM + 1][same], np.arange(len(texts) + 1))


def _places(h: np.ndarray, bits: int, hashes: int) -> Iterator[np.ndarray]:
    for seed in _SEEDS[:hashes]:
        yield (mix(h ^ seed) % np.uint64(bits)).astype(np.int64)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", fit: Fit = Fit()) -> Model:
    """``docs``: labelled rows only (others are ignored). What reaches the driver is bounded by the table's places."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((1, fit.bits), np.uint64), np.zeros(0), fit.hashes)
    part = F.lit(0.0)
    for name, n in counts.items():
        part = F.when(F.col("lang") == name, F.lit(min(1.0, fit.rows / n))).otherwise(part)
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(chance < part).dropDuplicates(["lang", "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            h, at = grams(data, offsets)
            names = batch.column("lang").to_pylist()
            for name in sorted(set(names)):
                mine = np.concatenate([h[at[i]:at[i + 1]] for i, x in enumerate(names) if x == name])
                value, n = np.unique(mine, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "h", "n"])

    per = map_arrow(sample, count, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    total = per.groupBy("lang").agg(F.sum("n").alias("all"))
    rate = per.join(total, "lang").select("lang", "h", (F.col("n") / F.col("all")).alias("rate"))
    both = rate.groupBy("h").agg(F.sum("rate").alias("sum"), F.collect_list(F.struct("lang", "rate")).alias("of"))   # at most one entry per language
    names = sorted(counts)
    kept = both.select("h", "sum", F.explode("of").alias("x")).where((F.col("x.rate") >= fit.min_rate) & (F.col("x.rate") >= fit.min_part * F.col("sum")))
    index = F.array_position(F.lit(names), F.col("x.lang")).cast("int") - 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, k = batch.column("h").to_numpy(False).view(np.uint64), batch.column("k").to_numpy(False)
            for p in _places(h, fit.bits, fit.hashes):
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(k // 64), pa.array((np.uint64(1) << (k % 64).astype(np.uint64)).view(np.int64))], ["p", "w", "m"])

    masks = map_arrow(kept.select("h", index.alias("k")), place, "p long, w int, m long").groupBy("p", "w").agg(F.bit_or("m").alias("m")).toPandas()
    table = np.zeros((-(-len(names) // 64), fit.bits), np.uint64)
    table[masks["w"].to_numpy(np.int64), masks["p"].to_numpy(np.int64)] = masks["m"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([np.count_nonzero(table[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / fit.bits for k in range(len(names))])
    return Model(names, table, fill ** fit.hashes, fit.hashes)


def score_texts(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. The score is the winner's part of all languages' corrected hits."""
    n = len(offsets) - 1
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n)
    h, at = grams(data, offsets)
    doc = np.repeat(np.arange(n), np.diff(at))
    masks = None
    for p in _places(h, model.table.shape[1], model.hashes):
        hit = model.table[:, p]
        masks = hit if masks is None else masks & hit
    total = np.diff(at).astype(float)
    share = np.zeros((len(model.languages), n))
    for k, wrong in enumerate(model.false_rate):
        hits = np.bincount(doc, weights=(masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(float), minlength=n) if len(doc) else np.zeros(n)
        share[k] = np.maximum(0.0, (hits - wrong * total) / max(1e-9, 1 - wrong))
    best, sums = share.argmax(0), share.sum(0)
    score = np.where(sums > 0, share.max(0) / np.where(sums > 0, sums, 1), 1.0 / len(model.languages))
    some = _has_letter(data, offsets)
    return [model.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> list[bool]:
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ascii_letter[data], out=sums[1:])
    quick = sums[offsets[1:]] > sums[offsets[:-1]]
    return [bool(q) or any(c.isalpha() for c in bytes(data[a:b]).decode("utf-8", "replace")) for q, a, b in zip(quick, offsets[:-1], offsets[1:], strict=True)]


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Columns of ``docs`` but the text, with ``lang_pred`` and ``score``."""
    others = rest(docs, text, "lang_pred", "score")
    shipped = docs.sparkSession.sparkContext.broadcast(model)     # bounded by Fit.bits x 8 bytes for every 64 languages

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, text):
            lang, value = score_texts(shipped.value, data, offsets)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in others], pa.array(lang, pa.string()), pa.array(value)], [*others, "lang_pred", "score"])

    fields = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others], "lang_pred string", "score double"])
    return map_arrow(docs.select(*others, text), score, fields)


def fold(doc_id: Column, n: int) -> Column:
    """Which of ``n`` folds a row is in: crc32 of its id as text (a null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 3) == 1
    model = learn(docs.where(~held))
    out = identify(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
