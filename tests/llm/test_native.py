"""Operators 4, 5 and 6 against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import xxhash

from conftest import FOLDER
from compare import compare, connect
from curbwatch.llm import mix, queries, sharding, simhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(rows):
    """{doc_id: component} by comparing every pair."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3:
                parent[root(i)] = root(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)].append(d)
    return [(d, f, min(low[root(i)], default=None)) for i, (d, f) in enumerate(rows)], len({root(i) for i in range(len(rows))})


def check_simhash(df):
    want, n = groups([(r.doc_id, fingerprint(r.text)) for r in df.select("doc_id", "text").collect()])
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash(df).collect()]
    assert Counter(got) == Counter(want)
    return n


def test_simhash(spark, odd, none):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    check_simhash(docs)
    n = check_simhash(odd)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == n
    assert simhash.keep_one(none).count() == 0 and simhash.simhash(none).count() == 0


def test_crowded_cells_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(0, 40, 3) for b in range(1, 40, 7)} | {base ^ (7 << i) << 3 for i in range(0, 60, 9)} | {0, 1, (1 << 63), 5 << 60})
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.fp % (1 << 64): r.component_id for r in simhash.near_groups(df).collect()}
    assert got == {f: c for _, f, c in groups(list(enumerate(fps)))[0]}


def check_shards(df, n, slack):
    out = sharding.shard(df, n)
    rows = out.collect()
    assert len(rows) == df.count()
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len((r.text or "").encode()) + 1
        by[r.shard].append(r)
    total = sum(r["size"] for r in rows)
    for s, part in by.items():
        assert 0 <= s < n and sorted(r.slot for r in part) == list(range(len(part)))
    for s in range(n):
        assert abs(sum(r["size"] for r in by[s]) - total / n) <= slack(rows) + 0.002 * total / n
    return rows


def test_shards(spark, odd, none):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    largest = lambda rows: max(r["size"] for r in rows)
    check_shards(docs, 8, largest)
    check_shards(odd, 3, largest)
    one = spark.createDataFrame([(7, "same text")] * 800, "doc_id long, text string")
    check_shards(one, 8, largest)
    assert sharding.shard(none).count() == 0


def test_shard_query_covers_the_table(spark):
    rows = queries.PLANS["op4_sharding"](spark, FOLDER).collect()
    texts = dict(duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall())
    assert len(rows) == len(texts)
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None for r in rows)


def test_mix(spark, odd, none):
    ok, note = compare(queries.PLANS["op6_mixing_sources"](spark, FOLDER), connect(FOLDER), queries.SQL["op6_mixing_sources"])
    assert ok, note
    rows = mix.planned(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.copies <= 2 and r.target <= 2 * r.source_size for r in rows)
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * sum({r.source: r.source_size for r in rows}.values())) < 1e-6
    copies = mix.mix(odd)
    assert copies.columns == odd.columns and copies.count() == sum(r.copies for r in rows)
    assert sorted(map(str, copies.collect())) == sorted(map(str, mix.mix(odd).collect()))
    assert mix.mix(none).count() == 0 and mix.planned(none).count() == 0
