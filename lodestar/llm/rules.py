"""Quality rules by distribution divergence (DataFrame functions only, one scan without a shuffle).

Base rules reject texts that are too short or repeat themselves. The method then compares two histograms of a text with
references of each language: character classes, and common words (all other words are one more bin). The distance is
Jensen-Shannon's, in [0, 1]; a text is kept if for some language both distances are under the limits. References are
counts over all documents with a language.

Empty cases: a null or empty text has no word and fails; without any reference (no row with a language) only the base rules
hold; rows are independent, so ties and repeated rows give repeated results; extra columns stay, but for those with the names of
the operator's own columns, which ``judge`` replaces (``filter_rules`` keeps all).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.llm.rows import packed, settled, unpacked

#: Character classes as the inside of a regular expression's brackets.
SPACE, SYMBOLS, UPPER, DIGITS, STOPS = r"\x20\x09-\x0D", r"#*$%&|<>", "A-Z", "0-9", r".,;:!?'\"()\-"


OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    common: int = 24             # common words of each language
    common_length: int = 4       # common words are short: at most so many characters
    min_chars: int = 200         # shorter texts are not compared by character class
    min_compared_words: int = 50  # shorter texts are not compared by words
    max_class: float = 0.30
    max_word: float = 0.42


@dataclass(frozen=True)
class References:
    """Character-class and common-word shares of each language; ``slots`` places a word's hash in a table without collisions."""

    languages: list[str] = field(default_factory=list)
    classes: list[list[float]] = field(default_factory=list)
    words: list[list[float]] = field(default_factory=list)   # by language: share of each slot, the last is all other words
    slots: list[int] = field(default_factory=list)           # word hash in each slot, or the slot's own number if it is free


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def with_counts(docs: DataFrame, text: Column) -> DataFrame:
    """Adds ``_chars`` and ``_counts``: lower-case, upper-case, digits, stops, symbols, space, outside ASCII, all others.

    The lower-case letters are removed first; the other classes are counted on the short rest.
    """
    out = docs.withColumn("_chars", F.length(text)).withColumn("_rest", F.regexp_replace(text, "[a-z]+", ""))
    rest = F.col("_rest")
    some = [_count(rest, c) for c in (UPPER, DIGITS, STOPS, SYMBOLS, SPACE)] + [F.length(F.regexp_replace(rest, r"[\x00-\x7F]+", ""))]
    out = out.withColumn("_some", F.array(F.col("_chars") - F.length(rest), *some))
    others = F.col("_chars") - F.aggregate("_some", F.lit(0), lambda a, b: a + b)
    return out.withColumn("_counts", F.concat("_some", F.array(others))).drop("_rest", "_some")


def _repeat_words(grams: Column, twice: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    n, m = F.size(grams), F.size(twice)
    # few repeated windows are looked up in a short list, many by sorting; both find the same
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def by_sorting(p: Column) -> Column:
        same = lambda a, b: p[a]["h"] == p[b]["h"]
        hit = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.when(k > 0, same(k, k - 1)).otherwise(False) | F.when(k < n - 1, same(k, k + 1)).otherwise(False))
        return F.sort_array(F.transform(hit, lambda k: p[k]["i"]))

    def covered(q: Column) -> Column:
        step = F.transform(q, lambda x, k: F.when(k < F.size(q) - 1, F.least(F.lit(3), q[k + 1] - x)).otherwise(3))
        return F.aggregate(step, F.lit(0), lambda a, b: a + b)

    # a one-element transform binds a value that the lambda uses many times
    bind = lambda value, f: F.transform(F.array(value), f)[0]
    listed = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains(twice, grams[i]))
    return F.when(m == 0, 0).when(m <= 16, bind(listed, covered)).otherwise(bind(bind(pairs, by_sorting), covered)).cast("long")


def base_columns(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Adds ``_words _hashes _chars _counts n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    out = with_counts(docs, t).withColumn("_words", word_array(F.col(text)))
    out = out.withColumns({
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        "n_words": F.size("_words").cast("long"),
        "word_chars": (F.col("_chars") - F.col("_counts")[5]).cast("long"),
        "n_symbols": F.col("_counts")[4].cast("long"),
        "_lines": lines,
    })
    h = F.col("_hashes")
    grams = F.when(F.size(h) >= 3, F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumns({"n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_grams": grams})
    out = out.withColumn("_ordered", F.sort_array("_grams"))
    o = F.col("_ordered")
    again = F.filter(F.sequence(F.lit(1), F.size(o) - 1), lambda i: o[i] == o[i - 1])
    out = out.withColumn("_again", F.when(F.size(o) >= 2, again).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("_twice", F.array_distinct(F.transform("_again", lambda i: o[i])))
    out = out.withColumn("n_repeat_words", _repeat_words(F.col("_grams"), F.col("_twice")))
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_lines", "_grams", "_ordered", "_again", "_twice")


def learn_references(docs: DataFrame, text: str = "text", lang: str = "lang", limits: Limits = Limits()) -> References:
    """Counts over all documents with a language. The driver gets ``common`` words and seven shares per language."""
    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    classes = with_counts(labelled, F.col("text")).groupBy("lang").agg(*[F.sum(F.col("_counts")[k].cast("long")).alias(f"c{k}") for k in range(8)])
    by_lang = {r[0]: [float(x) for x in r[1:]] for r in classes.collect() if sum(r[1:])}
    if not by_lang:
        return References()
    word = labelled.select("lang", F.explode(word_array(F.col("text"))).alias("w"))
    word = word.groupBy("lang", F.when(F.length("w") <= limits.common_length, F.col("w")).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    top = (word.where("w IS NOT NULL").withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "w")))
           .where(F.col("place") <= limits.common).select("w").distinct())
    totals = {r[0]: r[1] for r in word.groupBy("lang").agg(F.sum("n")).collect()}
    counted = word.join(top, "w").select("lang", F.xxhash64("w").alias("h"), "n").collect()
    hashes = sorted({r["h"] for r in counted})
    size = max(64, 1 << (4 * len(hashes)).bit_length())
    while len({h % size for h in hashes}) < len(hashes):
        size += 1
    slots = [(k + 1) % size for k in range(size)]    # a free slot holds a number of another slot: no hash matches it
    for h in hashes:
        slots[h % size] = h
    languages = sorted(by_lang)
    words = [[0.0] * (size + 1) for _ in languages]
    for r in counted:
        words[languages.index(r["lang"])][r["h"] % size] = r["n"] / totals[r["lang"]]
    for row in words:
        row[size] = max(0.0, 1.0 - sum(row))
    return References(languages, [[x / sum(by_lang[g]) for x in by_lang[g]] for g in languages], words, slots)


def _term(p: Column, q: Column) -> Column:
    """p and q's part of the divergence, in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def add_distances(out: DataFrame, refs: References, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Adds ``class_distances`` and ``word_distances``, by language."""
    size = len(refs.slots)
    out = out.withColumn("_classes", F.transform("_counts", lambda c: c / F.greatest(F.col("_chars"), F.lit(1)).cast("double")))
    slots = F.lit(refs.slots)
    known = F.filter("_hashes", lambda h: slots[F.pmod(h, F.lit(size)).cast("int")] == h)
    out = out.withColumn("_known", F.sort_array(F.transform(known, lambda h: F.pmod(h, F.lit(size)).cast("int"))))
    k = F.col("_known")
    n = F.size(k)
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.when(i > 0, k[i] != k[i - 1]).otherwise(True))
    out = out.withColumn("_first", F.when(n > 0, first).otherwise(F.array().cast("array<int>")))
    s, words = F.col("_first"), F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    runs = F.transform(s, lambda i, j: F.struct(k[i].alias("slot"), ((F.when(j < F.size(s) - 1, s[j + 1]).otherwise(n) - i) / words).alias("p")))
    out = out.withColumn("_runs", F.concat(runs, F.array(F.struct(F.lit(size).alias("slot"), (1 - n / words).alias("p")))))
    zero = F.lit(0.0)
    p_part = F.aggregate("_runs", F.lit(0.5), lambda a, r: a + F.when(r["p"] > 0, r["p"] * F.log2(r["p"]) / 2).otherwise(0.0))
    out = out.withColumn("_p", p_part)
    # bins that the text lacks have half of their share each, in all 1/2 less what is taken back here for the bins it has
    q_part = F.lit([[x * math.log2(x) / 2 - x / 2 if x else 0.0 for x in row] for row in refs.words])

    def class_distance(q: Column) -> Column:
        parts = F.zip_with(F.col("_classes"), q, _term)
        return F.sqrt(F.greatest(zero, F.aggregate(parts, zero, lambda a, b: a + b)))

    def word_distance(q: Column, k: Column) -> Column:
        def part(a: Column, r: Column) -> Column:
            both = r["p"] + q[r["slot"]]
            return a + F.when(both > 0, q_part[k][r["slot"]] - both / 2 * (F.log2(both) - 1)).otherwise(0.0)

        return F.sqrt(F.greatest(zero, F.aggregate("_runs", F.col("_p"), part)))

    return out.withColumns({"class_distances": F.transform(F.lit(refs.classes), class_distance), "word_distances": F.transform(F.lit(refs.words), word_distance)})


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", limits: Limits = Limits(), refs: References | None = None) -> DataFrame:
    """All rows and columns, with the base columns, ``class_distance word_distance`` of the nearest language and ``kept``."""
    refs = learn_references(docs, text, lang, limits) if refs is None else refs
    return unpacked(_judged(packed(docs, text=F.col(text)), refs, limits), docs, *OWN)


def _judged(docs: DataFrame, refs: References, limits: Limits) -> DataFrame:
    text = "text"
    out = base_columns(docs, text, limits)
    if not refs.languages:
        return out.withColumns({"class_distance": F.lit(None).cast("double"), "word_distance": F.lit(None).cast("double"), "kept": ~F.col("base_failed")})
    out = add_distances(out, refs, text, limits)
    worst = F.zip_with("class_distances", "word_distances", lambda a, b: F.struct(F.greatest(a / limits.max_class, b / limits.max_word).alias("x"), a.alias("a"), b.alias("b")))
    out = out.withColumn("_near", F.array_min(worst))
    by_class = (F.col("_chars") < limits.min_chars) | (F.col("_near.a") <= limits.max_class)
    by_word = (F.col("n_words") < limits.min_compared_words) | (F.col("_near.b") <= limits.max_word)
    out = out.withColumns({"class_distance": F.col("_near.a"), "word_distance": F.col("_near.b"), "kept": ~F.col("base_failed") & by_class & by_word})
    return out


def filter_rules(docs: DataFrame, **options) -> DataFrame:
    """The kept rows, with the columns they came with."""
    bare = packed(docs, text=F.col(options.pop("text", "text")), lang=F.col(options.pop("lang", "lang")))
    return unpacked(judge(bare, **options).withColumn("_kept", settled(F.col("kept"))).where("_kept"), docs)


def js_distance(p: list[float], q: list[float]) -> float:
    """Plain form of the distance, for tests and small data."""
    total = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        total += sum(x * math.log2(x / m) for x in (a, b) if x > 0) / 2
    return math.sqrt(max(0.0, total))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                              F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))
