"""Operators 11 and 12: spelling variants and BPE against brute force and the tokenizers library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from compare import compare, connect
from conftest import FOLDER
from curbwatch.llm import bpe, queries, spelling


def brute(rows, shortest=7, least=2, one_in=31, ratio=10):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % one_in else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1:]].add(w)
    for (_, rest), group in holes.items():
        for w in group:
            near[w] |= group - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w in words:
        best = min(((-words[o], o) for o in near[w]), default=(0, None))
        form[w] = best[1] if -best[0] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def found(df):
    rows = df.collect()
    out = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_of_all_documents(spark):
    for folder in (FOLDER, "/root/testdata/sf0.01"):
        df = spark.read.parquet(f"{folder}/documents.parquet")
        assert found(queries.PLANS["op11_spelling_variants"](spark, folder)) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    ok, note = compare(queries.PLANS["op11_spelling_variants"](spark, FOLDER), connect(FOLDER), queries.SQL["op11_spelling_variants"])
    assert ok, note


def test_spelling_of_crowded_chunks(spark, monkeypatch):
    """Words that nearly all share their halves, long ones and repeated letters, with chunks made longer at every size."""
    random.seed(3)
    words = {"".join(random.choices("ab", k=random.randint(7, 10))) for _ in range(900)}
    words |= {"commonstart" + "".join(random.choices("xyz", k=4)) for _ in range(60)} | {"".join(random.choices("éÿ×a", k=4)) + "commonend" for _ in range(100)}
    words |= {"a" * k for k in (7, 8, 9, 400, 401)} | {"ab" * 100, "ab" * 50 + "b" + "ab" * 50, "ab" * 99 + "aa", "ab" * 99 + "a"}
    rows = [(w, random.choice([2, 3, 20, 300, 4000])) for w in sorted(words)]
    df = spark.createDataFrame(rows, "word string, n long")
    want = brute([(None, " ".join([w] * c)) for w, c in rows], one_in=10 ** 12)
    for most in (4096, 30):
        monkeypatch.setattr(spelling, "MOST_PAIRS", most)
        assert found(spelling.variants(df)) == want
    assert len({r[2] for r in want}) < len(want)


def test_spelling_of_odd_rows(spark, odd, none):
    more = spark.createDataFrame([(None, "Straßenbahn straßenbahn Straenbahn"), (3, "tokenised tokenized tokenized"), (3, "tokenised tokenized tokenized"), (5, " ".join(["x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499] * 2))], "doc_id long, text string")
    df = odd.select("doc_id", "text").unionByName(more)
    want = brute([(r.doc_id, r.text) for r in df.collect()], one_in=2)
    assert found(spelling.spelling_variants(df.withColumn("word", df.text).withColumn("n", df.doc_id), one_in=2)) == want
    assert spelling.spelling_variants(none).count() == 0


def test_spelling_of_very_long_words(spark):
    rows = [("x" * 100_000, 50), ("x" * 99_999, 2), ("x" * 50_000 + "y" + "x" * 49_999, 3), ("z" * 100_000, 9)]
    got = {(r.word, r.form, r.n_near) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    long, short, odd, alone = (w for w, _ in rows)
    assert got == {(long, None, 2), (short, long, 2), (odd, long, 2), (alone, None, 0)}


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer()


def library(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def digests(path, texts):
    t = library(path)
    for text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        yield len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_all_documents(spark, path):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = queries.PLANS["op12_bpe"](spark, "/root/testdata/sf0.01").collect()
    docs = df.collect()
    want = sorted((r.doc_id, *d) for r, d in zip(docs, digests(path, [r.text for r in docs])))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def test_bpe_of_random_strings(path):
    random.seed(5)
    pool = [chr(i) for i in (*range(0x250), *range(0x300, 0x370), 0x3A3, 0x3C2, 0x130, 0x2002, 0x2003, 0x3000, 0x200B, 0xAC00, 0x1100, 0x1161, 0x1F600, 0x4E2D, 0xFB01, 0x212B, 0x1E9E, 0x2028)]
    texts = ["".join(random.choices(pool, k=random.randint(0, 40))) for _ in range(20_000)]
    texts += ["".join(random.choices("abc'stdmrevl<|endoftext>  ΣΑ", k=random.randint(0, 40))) for _ in range(20_000)]
    texts += ["", " ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "a" * 5000, "ab" * 999, "!" * 777, "aaab" * 300, "<|endoftext|"]
    flat, n = bpe.vocabulary(path).encode(pa.array(texts))
    at, t = np.concatenate([[0], np.cumsum(n)]), library(path)
    for i, text in enumerate(texts):
        assert flat[at[i]:at[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_bpe_of_odd_rows(spark, odd, none, path):
    df = odd.withColumn("ids", odd.doc_id)
    out = bpe.encode(df, path)
    assert set(out.columns) == set(odd.columns) - {"text"} | {"ids"}
    rows = out.select("doc_id", "lang", "ids", bpe.decode(out.ids, path).alias("back")).collect()
    t = library(path)
    want = sorted(str((r.doc_id, r.lang, ids, t.decode(ids, skip_special_tokens=False))) for r in odd.collect() for ids in [t.encode(r.text or "", add_special_tokens=False).ids])
    assert sorted(str((r.doc_id, r.lang, np.frombuffer(r.ids, "<u4").tolist(), r.back)) for r in rows) == want
    assert bpe.encode(none, path).count() == 0


def test_early_merges_go_one_by_one(path):
    """A vocabulary whose merge gives a token that a merge of lower rank joins on."""
    held = bpe.Vocabulary(path)
    spelled = {c: i for i, c in enumerate("abcd")}
    merges = [("ab", "a"), ("a", "b"), ("ab", "ab"), ("b", "c")]
    ids = {t: i for i, t in enumerate(dict.fromkeys([*"abcd", *("".join(m) for m in merges)]))}
    held.width = len(ids)
    held.left, held.right, held.made = (np.array(x) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in merges)))
    code = held.left * held.width + held.right
    held.order = np.argsort(code)
    held.codes = code[held.order]
    held.early = np.array([False, True, False, False])
    rank = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(merges)}
    random.seed(11)
    words = ["".join(random.choices("abcd", k=random.randint(1, 14))) for _ in range(400)]
    got, n = held.merge(np.array([spelled[c] for w in words for c in w], np.int32), np.cumsum([0, *map(len, words[:-1])]))
    want = []
    for w in words:
        s = [spelled[c] for c in w]
        while best := min(((*rank[p], i) for i, p in enumerate(zip(s, s[1:])) if p in rank), key=lambda x: (x[0], x[2]), default=None):
            s[best[2]:best[2] + 2] = [best[1]]
        want.append(s)
    at = np.concatenate([[0], np.cumsum(n)])
    assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == want
