"""Byte pairs: ids against the tokenizers library, cuts against the vocabulary, odd tables."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return bpe.Bpe(f.read())


def ids(model, text):
    return np.frombuffer(model.encode(text), np.int32).tolist()


def odd_texts():
    r = random.Random(3)
    signs = [chr(c) for c in [*range(0x250), *range(0x370, 0x530), 0x558, 0x1C89, 0x1C8A, 0xA7CB, 0x10D50, 0x16EA0, 0x3000, 0x300, 0x301, 0x327, 0x1100, 0x1161,
                              0x11A8, 0xAC00, 0x1F600, 0x130, 0xFB00, 0x2B740, 0x323B0, 0x85, 0x200B]]
    signs += ["<|endoftext|>", "<|startoftext|>", "<|endoftext", "'s", "'LL", " ", "a", "e", "é", "Σ"]
    yield from ["", " \n", "<|endoftext|>", "ΣΑΣ ΟΔΟΣ", "İstanbul", "don't <|startoftext|>x", "ȩ́ ́", "힣!!", "x" * 500, "qzxj" * 300]
    for _ in range(1500):
        yield "".join(r.choices(signs, k=r.randint(0, 30)))


def test_ids_match_the_library(library, model):
    for text in odd_texts():
        assert ids(model, text) == library.encode(text, add_special_tokens=False).ids, text


def test_long_words_and_texts_in_pieces(library, model, monkeypatch):
    r = random.Random(4)
    words = "".join(r.choices("abcdefgh", k=50_000))
    assert ids(model, words) == library.encode(words, add_special_tokens=False).ids
    text = " ".join("".join(r.choices("abcé'.Σ1", k=r.randint(1, 9))) for _ in range(4000))
    monkeypatch.setattr(bpe.pieces, "__defaults__", (1000,))
    assert len(list(bpe.pieces(text))) > 10 and "".join(bpe.pieces(text)) == text
    assert ids(model, text) == library.encode(text, add_special_tokens=False).ids


def test_no_token_reaches_across_a_cut(model):
    """A fragment's ids on their own are the ids of the word, and every cut is a pair that no token holds."""
    letters = {x: b for b, x in enumerate(bpe.byte_letters())}
    held = set()
    for token in model.vocabulary:
        ends = token.endswith("</w>")
        codes = [letters[x] for x in token.removesuffix("</w>")]
        codes[-1] += 256 * ends
        held |= set(zip(codes, codes[1:]))
    r, cuts = random.Random(5), 0
    for _ in range(300):
        word = bytes(r.choices(b"aeqxzj\xc3\xa9", k=r.randint(1, 20)))
        parts = model.fragments(word)
        codes = [*word[:-1], word[-1] + 256]
        assert [c for p in parts for c in p] == codes
        ends = set(np.cumsum([len(p) for p in parts])[:-1].tolist())
        assert ends == {i for i in range(1, len(codes)) if (codes[i - 1], codes[i]) not in held}
        cuts += len(ends)
        whole = [model.single[c] for c in codes]
        assert np.frombuffer(b"".join(model.merge(p) for p in parts), np.int32).tolist() == model.merge_long(whole)
    assert cuts > 300


def test_kept_words_are_bounded(model, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    kept = bpe._Kept(model.word)
    for _ in range(2):
        for i in range(500):
            assert kept[f"word{i}"] == model.word(f"word{i}")
            assert len(kept) <= 50 and len(kept.older) <= 50
    kept["y" * 100]
    assert "y" * 100 not in kept


def test_encoding_and_decoding_as_jobs(spark, library):
    texts = [None, "", "Hello wörld's 12 !! <|endoftext|> x", "same", "same", "word " * 30_000]
    df = spark.createDataFrame([(i, t, 7, "k") for i, t in enumerate(texts)], "doc_id long, text string, ids int, x string").withColumnRenamed("x", "a.b")
    coded = bpe.encode(df, PATH)
    assert coded.columns == ["text", "doc_id", "a.b", "ids"]
    out = {r.doc_id: r for r in bpe.decode(coded, PATH).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert out[i].ids == want and out[i].decoded == library.decode(want, skip_special_tokens=False) and out[i].text == t
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none, PATH), PATH).collect() == []
    strange = spark.createDataFrame([(1, None), (2, []), (3, [-1, 320, 10 ** 6, None, 49407])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(strange, PATH).orderBy("doc_id").collect()] == ["", "", library.decode([320, 49407], skip_special_tokens=False)]


def test_query_matches_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in bpe.op11(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(docs) == len(out)
    for r in docs:
        want = library.encode(r.text, add_special_tokens=False).ids
        assert out[r.doc_id].n_tokens == len(want)
        assert out[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert out[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
