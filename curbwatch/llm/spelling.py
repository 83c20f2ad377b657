"""Spelling variants of words by asymmetric chunks: words one edit apart, and the common form of each (operator 11)."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage
from .words import LOWER

_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = LOWER.tobytes()
#: Different words a task counts before it sends its counts on.
HELD_WORDS = 200_000
#: Longest word that Levenshtein's distance is taken of; it goes over a word as often as the word has letters.
LEVENSHTEIN = 64
#: Pairs of a chunk's words and grams that are compared at once; chunks with more are made longer first.
MOST_PAIRS = 4096


def slipped(run: str, doc_id, one_in: int) -> str:
    """The run without one code point where `one_in` divides the crc32 of `<doc_id>:<run>` (a null id: `null`), else the run."""
    h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(df: DataFrame, shortest: int = 7, least: int = 2, one_in: int = 31) -> DataFrame:
    """word and n: runs of Latin letters in whole texts, A-Z lower-cased, a slip made in some; words of `shortest` code points that occur `least` times.

    A task adds up its own counts, HELD_WORDS different words at a time, before
    they are shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = defaultdict(int)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
                here: dict[str, int] = defaultdict(int)
                for w in _RUN.finditer(bytes(text.as_buffer()).translate(_LOWER).decode()):
                    here[w[0]] += 1
                for w, n in here.items():
                    if len(w) < shortest:
                        continue
                    h = zlib.crc32(w.encode(), start)
                    if not h % one_in:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < shortest:
                            continue
                    held[w] += n
                if len(held) >= HELD_WORDS:
                    yield flush()
        yield flush()

    return df.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _outside(extra: Column | int) -> Column:
    """What stands outside the open stretch: the first `a` code points and those from `b` on, moved by the difference in length."""
    word = F.col("word")
    tail = F.col("b") + F.lit(1) + extra
    return F.concat(word.substr(F.lit(1), F.col("a")), F.lit("\n"), word.substr(tail, F.greatest(F.length(word) - tail + 1, F.lit(0))))


def _one_edit() -> Column:
    """Whether `left` becomes `right` by one replacement or, where `less` is 1, by one deletion."""
    letters = lambda c: F.split(c, "")
    at = F.array_position(F.zip_with(letters("left"), letters("right"), lambda x, y: ~x.eqNullSafe(y)), F.lit(True)).cast("int")
    rest = lambda c, start: F.col(c).substr(start, F.length(c))
    long = (at > 0) & (rest("left", at + 1) == rest("right", at + 1 - F.col("less")))
    return F.when((F.col("less") == 0) & (F.col("left") >= F.col("right")), F.lit(False)).when(F.col("_l") > LEVENSHTEIN, long).otherwise(F.levenshtein("left", "right", 1) == 1)


def _halves() -> Column:
    """The two halves of an open stretch."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    return F.explode(F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b"))))


def _opened(rows: DataFrame) -> DataFrame:
    return rows.select("word", "n", "length", "less", _halves().alias("_h")).select("word", "n", "length", "less", "_h.a", "_h.b").withColumn(
        "key", F.xxhash64("length", "a", "b", _outside(-F.col("less"))))


def near_pairs(words: DataFrame) -> DataFrame:
    """left, left_n, right, right_n: every pair of words of `words` (word, n) one insertion, deletion or replacement apart, once.

    A word of length L, cut in two chunks, keeps one of them in a word one edit
    away: the first at its place, the second moved by the difference in length. So
    a word gives its two chunks, and as the other side its grams at these places
    for partners of its own length and one longer. Equal chunks and grams meet by
    hash, and whole words are compared. A chunk that more than MOST_PAIRS
    pairs share is not joined: what it leaves open is cut in two again and one half
    joins the chunk, and so on. With one code point open, words that meet differ in
    that one alone, so a group is bounded by the alphabet's square, however many
    words share a chunk; no pair is dropped and no group compared as a whole.
    """
    sized = words.select("word", "n", F.length("word").alias("length"))
    whole = lambda df: df.withColumns({"a": F.lit(0), "b": F.col("length")})
    chunks = _opened(whole(sized.withColumn("less", F.lit(0))))
    grams = _opened(whole(sized.select("word", "n", F.explode(F.array(F.struct(F.col("length").alias("length"), F.lit(0).alias("less")),
                                                                     F.struct((F.col("length") + 1).alias("length"), F.lit(1).alias("less")))).alias("_p"))
                          .select("word", "n", "_p.length", "_p.less")))
    found, old = None, []
    while True:
        sides = stage(chunks.withColumn("chunk", F.lit(True)).unionByName(grams.withColumn("chunk", F.lit(False))), "chunks")
        pairs = F.sum(F.col("chunk").cast("long")) * F.sum((~F.col("chunk")).cast("long"))
        sizes = stage(sides.groupBy("key", (F.col("b") - F.col("a")).alias("open")).agg(pairs.alias("pairs")).filter("pairs > 0").withColumn(
            "hot", (F.col("pairs") > MOST_PAIRS) & (F.col("open") > 1)).drop("open"), "chunk-sizes")
        kept = sides.join(sizes, "key")
        cold = kept.filter("not hot")
        one = cold.filter("chunk").select("key", F.col("word").alias("left"), F.col("n").alias("left_n"), F.col("length").alias("_l"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        two = cold.filter("not chunk").select("key", F.col("word").alias("right"), F.col("n").alias("right_n"), F.col("length").alias("_rl"), F.col("a").alias("_ra"), F.col("b").alias("_rb"), "less")
        met = one.join(two, "key").filter("_l = _rl and _a = _ra and _b = _rb").filter(_one_edit())
        links = stage(met.select("left", "left_n", "right", "right_n").distinct(), "near-words")
        found = links if found is None else found.unionByName(links)
        old += [sides, sizes]
        hot = kept.filter("hot")
        if not sizes.filter("hot").limit(1).count():
            break
        chunks, grams = _opened(hot.filter("chunk")), _opened(hot.filter("not chunk"))
    out = stage(found.distinct(), "near-words") if len(old) > 2 else found
    for t in old:
        drop_staged(t)
    return out


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of `words` (word, n; words are distinct).

    form is the near word of largest n (ties: the smallest in code-point order) if
    that n is at least `ratio` times the word's, else null. root follows forms to
    the last; it is found by doubling steps, so in as many rounds as the logarithm
    of the longest chain, and n grows by `ratio` with each step of a chain.
    """
    words = stage(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("left").alias("word"), F.col("right").alias("near"), F.col("right_n").alias("near_n")).unionByName(
        pairs.select(F.col("right").alias("word"), F.col("left").alias("near"), F.col("left_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("_best"))
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(-F.col("_best.m") >= F.col("n") * ratio, F.col("_best")).alias("_best"))
    told = stage(told.select("word", F.col("_best.near").alias("form"), "n", "n_near", (-F.col("_best.m")).alias("form_n")), "forms")
    step = stage(told.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = stage(step.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        drop_staged(step)
        step = after.select("word", "root")
        if not after.filter("_moved").limit(1).count():
            break
        step = after.drop("_moved")
    return told.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, shortest: int = 7, least: int = 2, one_in: int = 31, ratio: int = 10) -> DataFrame:
    """variants() of the words of `df` (doc_id, text). Null and empty texts have no words, repeated rows count each, an empty table has no rows;
    a null doc_id counts as the text `null`. Other columns are not read."""
    return variants(word_counts(df, shortest, least, one_in), ratio)
