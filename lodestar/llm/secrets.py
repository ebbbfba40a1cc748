"""Secret scan with character Markov models (DataFrame functions only).

Base patterns find assignments of secrets, access keys and hexadecimal strings. The method adds ``random`` spans: maximal
runs of ``[A-Za-z0-9+/_=-]`` that overlap no base span and that a Markov model of random strings explains better than one of
ordinary identifiers. Both models count pairs of neighbouring characters: the first in the values of base spans (plus an even
prior: a random string may hold any character), the second in runs shaped as words of a bounded sample of documents, outside base spans.

Positions are code points, ends exclusive. A null or empty text has no span; a table without base spans or identifiers still
gives both models their priors; rows are independent, so ties and repeated rows repeat; other columns stay with ``find_secrets``, its own names replace theirs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.llm.rows import packed, settled, unpacked

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: A run of 16+ is a maximal run of ``HEX`` that is long enough; likewise for access keys.
LONG_HEX, LONG_ACCESS = r"[0-9a-f]{16,}", r"AKIA[A-Z0-9]{14,}"
RUN = r"[A-Za-z0-9+/_=-]"
#: Runs that may teach what is ordinary: words in lower, upper or title case, joined or not.
ORDINARY = r"^(?:(?:[A-Z]?[a-z]{2,}[_-]?)+|(?:[A-Z]{2,}[_-]?)+)$"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1


@dataclass(frozen=True)
class Scan:
    min_length: int = 20        # of a random span
    min_ratio: float = 1.0      # mean log-likelihood ratio of a pair of characters, in nats
    min_identifier: int = 8     # of an ordinary run that the second model learns from
    fit_docs: int = 20_000      # documents whose runs the second model learns from, chosen by a hash of the text


def _pieces(text: Column, pattern: str, needed: Column) -> tuple[Column, Column]:
    """Matches and the text between them, only where they are needed."""
    none = F.array().cast("array<string>")
    return (F.when(needed, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
            F.when(needed, F.split(text, pattern, -1)).otherwise(none))


def _located(matches: Column, gaps: Column) -> Column:
    """Array of struct(start, end, value): each match stands after the gaps and matches before it."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found"))

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(gaps[i])
        end = start + F.length(matches[i])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), matches[i].alias("value")))).alias("found"))

    found = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, step, lambda a: a["found"])
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _scan(docs: DataFrame, text: Column, pattern: str, needed: Column, name: str) -> DataFrame:
    m, g = _pieces(text, pattern, needed)
    out = docs.withColumns({"_m": m, "_g": g})
    return out.withColumn(name, _located(F.col("_m"), F.col("_g"))).drop("_m", "_g")


def _tagged(found: Column, k: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_base``: struct(start, kind, end, value) of the base spans, ordered by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    named = F.contains(low, F.lit(WORDS[0]))
    for w in WORDS[1:]:
        named = named | F.contains(low, F.lit(w))
    out = _scan(docs, t, ASSIGN, named, "_assign")
    value = lambda s: F.regexp_extract(s["value"], ASSIGN, 1)
    out = out.withColumn("_assign", F.filter("_assign", lambda s: F.length(value(s)) >= 12))
    out = _scan(out, t, LONG_ACCESS, F.contains(t, F.lit("AKIA")), "_access")
    out = _scan(out, t, LONG_HEX, t.rlike(LONG_HEX), "_hex")
    spans = [_tagged(F.transform("_assign", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), value(s).alias("value"))), 0),
             _tagged(F.col("_access"), 1), _tagged(F.col("_hex"), 2)]
    return out.withColumn("_base", F.sort_array(F.concat(*spans))).drop("_assign", "_access", "_hex")


def _code(c: Column) -> Column:
    """1-based place in the alphabet, 0 for any other character."""
    return F.position(c, F.lit(ALPHABET))


def _pair_counts(values: DataFrame) -> dict[int, int]:
    """Counts of neighbouring characters in column ``value``: at most SIZE x SIZE rows reach the driver."""
    chars = values.select(F.transform(F.split("value", ""), _code).alias("c")).where(F.size("c") > 1)
    pairs = chars.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.col("c")[i] * SIZE + F.col("c")[i + 1])).alias("p"))
    return {r["p"]: r["n"] for r in pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}


def _log_probabilities(counts: dict[int, int], prior: float) -> list[float]:
    rows = [sum(counts.get(a * SIZE + b, 0) for b in range(SIZE)) + prior * SIZE for a in range(SIZE)]
    return [math.log((counts.get(a * SIZE + b, 0) + prior) / rows[a]) for a in range(SIZE) for b in range(SIZE)]


def learn_ratio(docs: DataFrame, text: str = "text", scan: Scan = Scan()) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random against ordinary."""
    t = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = base_spans(t).withColumn("_some", settled(F.size("_base") > 0)).where("_some")
    random = spans.select(F.explode("_base").alias("s")).select(F.col("s.value").alias("value"))
    n = docs.count()
    keep = max(1, -(-n // scan.fit_docs))
    some = t.where(F.pmod(F.xxhash64("text"), F.lit(keep)) == 0).distinct()
    run = f"{RUN}{{{scan.min_identifier},}}"
    runs = base_spans(some).select("_base", F.explode(F.regexp_extract_all("text", F.lit(run), F.lit(0))).alias("value"))
    ordinary = runs.where(F.col("value").rlike(ORDINARY) & ~F.exists("_base", lambda s: F.contains(s["value"], F.col("value")) | F.contains(F.col("value"), s["value"]))).select("value")
    up, down = _log_probabilities(_pair_counts(random), 2.0), _log_probabilities(_pair_counts(ordinary), 0.1)
    return [a - b for a, b in zip(up, down, strict=True)]


def ratio_of(value: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio over the pairs of a string of two characters or more."""
    codes, lit = F.transform(F.split(value, ""), _code), F.lit(table)
    total = F.transform(F.array(codes), lambda c: F.aggregate(F.sequence(F.lit(0), F.size(c) - 2), F.lit(0.0), lambda a, i: a + lit[c[i] * SIZE + c[i + 1]]))[0]
    return total / (F.length(value) - 1)


def find_secrets(docs: DataFrame, text: str = "text", scan: Scan = Scan(), table: list[float] | None = None) -> DataFrame:
    """All rows and columns, with ``base`` and ``secrets``: arrays of struct(kind, start, end), ordered by start, then kind."""
    table = learn_ratio(docs, text, scan) if table is None else table
    return unpacked(_found(packed(docs, text=F.col(text)), scan, table), docs, "base", "secrets")


def _found(docs: DataFrame, scan: Scan, table: list[float]) -> DataFrame:
    text = "text"
    t = F.coalesce(F.col(text), F.lit(""))
    run = f"{RUN}{{{scan.min_length},}}"
    out = _scan(base_spans(docs, text), t, run, t.rlike(run), "_runs")
    clear = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter("_runs", lambda s: clear(s) & (ratio_of(s["value"], table) >= scan.min_ratio))
    named = lambda spans: F.transform(spans, lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = out.withColumn("_all", F.sort_array(F.concat("_base", _tagged(added, 3))))
    return out.withColumns({"base": named(F.col("_base")), "secrets": named(F.col("_all"))})


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
