"""Byte-pair encoding by forced-boundary splitting, and decoding.

A vocabulary token is a run of bytes; two neighbouring bytes that no token holds side by side can never be merged, so between
them lies a certain cut. Each word is cut at all such places, the fragments are encoded on their own and their ids are
concatenated: merges never reach across a cut, so the ids are those of the whole word.

The vocabulary is a file of the ``tokenizers`` library (byte-level BPE whose words end in a suffix). The driver reads it by
its path and sends its bytes, a few MB whatever the data, to the executors. Text is prepared as the file says: its special
tokens are found first, then NFC, lower case, and words by the file's pattern; white space is dropped.

A null or empty text has no ids. Equal texts get equal ids. Long texts are encoded in pieces cut at white space, so a piece,
not the text, bounds the memory besides the ids; a long word is merged with a heap. Decoding joins the tokens with spaces, as
the library does for a file without a decoder; ids outside the vocabulary are left out and a null list is an empty text.
Columns of other names stay, the operator's own names replace theirs.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.rows import rest
from lodestar.llm.text import map_arrow, slices

#: Characters of a text encoded at once, ids of a batch decoded at once.
PIECE = 1 << 20
#: Words kept with their ids in a task (two tables of this size at most), and the longest of them.
KEPT_WORDS, KEPT_LENGTH = 1 << 18, 64
SPACE = regex.compile(r"\s")

# Code points that Unicode made letters or digits after version 16, the one the tokenizer's pattern knows.
LATER = regex.compile(
    "[՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    "\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    "\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]")
# Capital letters since Unicode 16 with their small ones (this Python's tables may lack them).
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
RECENT = regex.compile("[" + "".join(map(chr, SMALL)) + "]")
#: All of those lie here.
HIGH = re.compile("[\u0558-\U0010ffff]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable bytes as they are, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class _Kept(dict):
    """Ids of words met before; when it is full, the words not met since the last time go."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    """One vocabulary in a Python process. ``inside[a, b]``: some token holds byte a right before byte b (b + 256: last byte of a word)."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, prepare, split = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        steps = [s["type"] for s in prepare["normalizers"]]
        if (model["type"], steps, [s["type"] for s in split["pretokenizers"]]) != ("BPE", ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError("not a lower-case byte-level BPE file")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens with rules of their own")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = regex.compile(split["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        letters = byte_letters()
        self.single = [self.vocabulary[x] for x in letters] + [self.vocabulary[x + self.suffix] for x in letters]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = self.vocabulary
        self.rank = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        byte = {x: b for b, x in enumerate(letters)}
        self.inside = np.zeros((256, 512), bool)
        for token in ids:
            ends = token.endswith(self.suffix)
            codes = [byte[x] for x in (token.removesuffix(self.suffix) if ends else token)]
            if ends:
                codes[-1] += 256
            self.inside[[c % 256 for c in codes[:-1]], codes[1:]] = True
        self._inside = [bytes(row) for row in self.inside]
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, k in (ids | self.special).items():
            self.tokens[k] = token
        self.known = np.zeros(len(self.tokens), bool)
        self.known[[*ids.values(), *self.special.values()]] = True
        self.kept = _Kept(self.word)

    def fragments(self, word: bytes) -> list[tuple[int, ...]]:
        """The word's bytes (the last one + 256), cut where no token can reach across."""
        codes = (*word[:-1], word[-1] + 256)
        inside = self._inside
        cuts = [i for i, (a, b) in enumerate(zip(word, codes[1:]), 1) if not inside[a][b]]
        return [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True)] if cuts else [codes]

    def merge(self, codes: tuple[int, ...]) -> bytes:
        """Ids (32 bit) of one fragment: the pair of lowest rank is merged first, the leftmost among equals."""
        at = [self.single[c] for c in codes]
        if len(at) > KEPT_LENGTH:
            return array("i", self.merge_long(at)).tobytes()
        get, made, last = self.rank.get, self.made, len(self.made)
        ranks = [get(a << 32 | b, last) for a, b in zip(at, at[1:])]
        while ranks and (rank := min(ranks)) < last:
            i = ranks.index(rank)
            at[i] = new = made[rank]
            del at[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(at[i - 1] << 32 | new, last)
            if i < len(ranks):
                ranks[i] = get(new << 32 | at[i + 1], last)
        return array("i", at).tobytes()

    def merge_long(self, at: list[int]) -> list[int]:
        """The same with a heap, n log n in the fragment's length."""
        n = len(at)
        follow, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := self.rank.get(at[i] << 32 | at[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = follow[i] if at[i] >= 0 else n
            if j >= n or self.rank.get(at[i] << 32 | at[j]) != rank:
                continue                                                     # one of the two was merged meanwhile
            at[i], at[j], follow[i] = self.made[rank], -1, follow[j]
            for a, b in ((before[i], i), (i, follow[i])):
                if a >= 0 and b < n:
                    before[b] = a
                    if (r := self.rank.get(at[a] << 32 | at[b])) is not None:
                        heapq.heappush(heap, (r, a))
        return [x for x in at if x >= 0]

    def word(self, word: str) -> bytes:
        return b"".join([self.merge(f) for f in self.fragments(word.encode("utf-8", "replace"))])

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if text.isascii():
            return b"".join(map(self.kept.__getitem__, self.words.findall(text.lower())))
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")          # no final form of sigma: case goes letter by letter
        far = HIGH.search(text) is not None
        text = (text.translate(SMALL) if far and RECENT.search(text) else text).lower()
        if far and LATER.search(text):
            seen = LATER.sub("�", text)                                 # neither letter nor digit to the pattern
            return b"".join([self.kept[text[m.start():m.end()]] for m in self.words.finditer(seen)])
        return b"".join(map(self.kept.__getitem__, self.words.findall(text)))

    def encode(self, text: str) -> bytes:
        out = []
        for piece in pieces(text):
            for part in self.cut.split(piece) if self.cut else [piece]:
                if part:
                    out.append(np.int32(self.special[part]).tobytes() if part in self.special else self.plain(part))
        return b"".join(out)


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """The text in pieces that begin and end at white space, of ``limit`` characters and the rest of a word."""
    i = 0
    while i < len(text):
        found = SPACE.search(text, i + limit)
        j = found.end() if found else len(text)
        yield text[i:j]
        i = j


@lru_cache(2)
def _model(data: bytes) -> Bpe:
    return Bpe(data)


def _numbered(df: DataFrame) -> DataFrame:
    """Columns ``_0``, ``_1``, ...: Arrow functions of Spark stumble over names with dots."""
    return df.toDF(*[f"_{k}" for k in range(len(df.columns))])


def _fields(df: DataFrame, added: str) -> str:
    return ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in df.schema], f"_{len(df.columns)} {added}"])


def _with(batch: pa.RecordBatch, added: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, added], names=[*batch.schema.names, f"_{batch.num_columns}"])


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """The rows with ``ids`` (array of int) of the whole text. No shuffle; one pass."""
    file = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    others = rest(docs, text, name)
    source = _numbered(docs.select(F.col(f"`{text}`").cast("string").alias("_"), *[F.col(f"`{c}`") for c in others]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(file.value)
        for batch, data, at in slices(batches, "_0"):
            raw = data.tobytes()
            ids = [bpe.encode(raw[a:b].decode("utf-8", "replace")) for a, b in zip(at[:-1], at[1:], strict=True)]
            ends = np.zeros(len(ids) + 1, np.int32)
            ends[1:] = np.cumsum([len(x) >> 2 for x in ids])
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield _with(batch, pa.ListArray.from_arrays(pa.array(ends), values))

    out = map_arrow(source, run, _fields(source, "array<int>")).toDF(text, *others, "_ids" if text == name else name)
    return out.select(*[F.col(f"`{c}`") for c in others], F.col("_ids").alias(name)) if text == name else out


def decode(rows: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The rows with ``decoded``: the tokens of ``ids`` joined with spaces, special ones too."""
    file = rows.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    others = rest(rows, ids, name)
    source = _numbered(rows.select(F.col(f"`{ids}`").alias("_"), *[F.col(f"`{c}`") for c in others]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(file.value)
        tokens = pa.array(bpe.tokens)
        for batch in batches:
            lists = batch.column(0)
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + PIECE, "right")))
                part = lists.slice(i, j - i)
                flat = pc.fill_null(part.flatten(), -1).to_numpy()
                good = (flat >= 0) & (flat < len(bpe.tokens))
                good[good] = bpe.known[flat[good]]
                length = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(length)])
                ends = np.concatenate([[0], np.cumsum(good)])[ends].astype(np.int32)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), tokens.take(pa.array(flat[good]))), " ")
                yield _with(batch.slice(i, j - i), joined)
                i = j

    out = map_arrow(source, run, _fields(source, "string")).toDF(ids, *others, "_text" if ids == name else name)
    return out.select(*[F.col(f"`{c}`") for c in others], F.col("_text").alias(name)) if ids == name else out


def op11(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
    coded = coded.withColumn("ids_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256))
    return decode(coded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
