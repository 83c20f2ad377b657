"""Operators 3 and 8 against the tokenizer on whole texts, and exact round trips."""

import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from conftest import FOLDER
from curbwatch.llm import common, rans, token_scan, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["don't stop   áé ΑΣ ΣΑΣ x", "<|endoftext|> a<|startoftext|>b", "##foo #foo\x1c\x1dx ++", "́ lone mark", "日本語テキスト 123 4.5", "word" * 400]


@lru_cache
def library(plain):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = plain
    return t


def whole(text, plain=False):
    return library(plain).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def hard(spark, odd):
    return odd.select("doc_id", "text").union(spark.createDataFrame([(20 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string"))


def ids_of(encoder, texts):
    flat, n = encoder.encode(pa.array(texts, pa.string()))
    at = np.concatenate([[0], np.cumsum(n)])
    return [flat[i:j].tolist() for i, j in zip(at, at[1:])]


def test_words_apart_give_the_ids_of_the_text(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()
    texts = [r.text for r in rows[:60]] + HARD + [None, ""]
    for plain in (False, True):
        for t, got in zip(texts, ids_of(tokens.Encoder(PATH, plain), texts)):
            assert got == whole(t, plain), t[:50]


def test_words_of_random_strings():
    rng = random.Random(3)
    pool = [chr(i) for i in (*range(0x250), *range(0x300, 0x330), 0x3A3, 0x3C2, 0x130, 0x2002, 0x3000, 0x200B, 0xAC00, 0x1F600, 0x4E2D, 0xFB01, 0x212B, 0x1E9E, 0x2028)]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(8000)]
    texts += ["".join(rng.choices("abc'stdmrevl<|endoftext> \n\tÉßA1²", k=rng.randint(0, 30))) for _ in range(8000)]
    for plain in (False, True):
        for t, got in zip(texts, ids_of(tokens.Encoder(PATH, plain), texts)):
            assert got == whole(t, plain), repr(t)


def test_evicting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 5)
    encoder = tokens.Encoder(PATH, False)
    for t in ["a b c d e f g a", "h i j", "a b h " + "long" * 40, "a b c d e f g h i"] * 2:
        assert ids_of(encoder, [t]) == [whole(t)]


def test_blocks_round_trip(monkeypatch):
    monkeypatch.setattr(rans, "DEPTH", 3)
    monkeypatch.setattr(rans, "LANES", 4)
    rng = np.random.default_rng(1)
    for n in (1, 11, 12, 13, 500):
        ids = np.minimum(rng.geometric(0.2, n), 900)
        table = rans.Table(rans.quantized(np.bincount(ids, minlength=1000)))
        block = rans.pack(table, np.arange(2), np.array([True, False]), np.array([n - 1, 1]), ids) + rans.END
        used, docs, known, lengths, back = rans.unpack(table, memoryview(block + b"next"))
        assert used == len(block) and back.tolist() == ids.tolist() and lengths.tolist() == [n - 1, 1] and known.tolist() == [True, False]
        bad = bytearray(block)
        bad[len(block) // 2] ^= 1
        with pytest.raises(ValueError):
            rans.unpack(table, memoryview(bytes(bad)))
    many = rans.quantized(np.concatenate([np.ones(70_000), [10**9]]))
    assert many.sum() == 1 << rans.SCALE and many.min() == 1


def check_files(df):
    rows = df.select("doc_id", "text").collect()
    want, start = [], 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = whole(r.text) + [2]
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = [tuple(r) for r in rans.round_trip(df, PATH).select("doc_id", "n_tokens", "ids_crc32", "start").collect()]
    assert sorted(map(str, (g[:3] for g in got))) == sorted(map(str, want))
    for g in sorted(got, key=lambda g: g[3]):
        assert g[3] == start
        start += g[1]
    ordered = [g[0] for g in sorted(got, key=lambda g: g[3])]
    assert ordered == sorted(ordered, key=lambda d: (d is not None, d or 0))


def test_token_files(spark, hard, none):
    check_files(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    check_files(hard)
    assert rans.round_trip(none.select("doc_id", "text"), PATH).count() == 0


def test_counts_of_flat_files(spark, hard, none):
    got = token_scan.count_tokens(hard, PATH, 49_407).collect()
    want = [(r.doc_id, len(whole(r.text, True))) for r in hard.collect()]
    assert sorted(map(str, ((r.doc_id, r.n_tokens) for r in got))) == sorted(map(str, want))
    assert token_scan.count_tokens(none, PATH, 49_407).count() == 0


def test_documents_over_many_blocks(spark):
    folder = common.new_folder(spark, "flat")
    ids = np.array([7] * 10 + [9] + [9] + [5] * 3 + [9] + [1] * 4, "<u2")
    tokens.write_binary(spark.createDataFrame([(ids.tobytes(),)], "ids binary").coalesce(1), "ids", np.array([3], "<u2").tobytes(), folder)
    for block in (1, 2, 3, 4, 100):
        got = [tuple(r)[1:] for r in token_scan.scan(spark, folder, 9, 2, block).orderBy("doc_no").collect()]
        assert got == [(0, 0, 10, True), (1, 11, 0, True), (2, 12, 3, True), (3, 16, 5, False)]
