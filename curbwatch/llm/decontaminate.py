"""Benchmark passages in documents, by latent semantic retrieval and longest common subsequences (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from .common import pieces
from .words import LOWER, PLAIN, hashes, spans

#: Places of hashed words, and dimensions of the latent space.
PLACES_BITS, RANK = 15, 64
PLACES = 1 << PLACES_BITS
#: Words between the starts of two passages; a passage holds two steps.
STEP = 16
#: Weight of the benchmark's part of the decomposed matrix against that of all documents, whatever their number:
#: the space must hold what is looked for.
BENCHMARK_SHARE = 1.0
#: A passage this close to one of an item is a candidate.
COSINE = 0.6
#: Words of a text, for each word of an item, in which nothing the shares below call a leak is missed.
STRETCH = 2
#: Share of an item's words, in order, that makes a leak; from PARTIAL on the answer decides.
OVERLAP, PARTIAL = 0.8, 0.6
#: Items searched for in one pass over the documents.
ITEMS = 4096
SEED = 42
BLOCK = 64
#: Bytes of text worked on at once; the tables of a piece then stay in cache.
PIECE = 1 << 17


@dataclass
class Words:
    """Words of consecutive texts, in order, with the place of each and the step of its text it stands in (steps numbered over all texts)."""
    word: np.ndarray
    text: np.ndarray
    place: np.ndarray
    step: np.ndarray
    first: np.ndarray
    length: np.ndarray
    steps: np.ndarray
    first_step: np.ndarray


def words_of(offsets: np.ndarray, data: np.ndarray) -> Words:
    data = LOWER[data]
    start, end, text = spans(offsets, data, PLAIN)
    word = hashes(data, start, end)
    length = np.bincount(text, minlength=len(offsets) - 1)
    first = np.cumsum(length) - length
    steps = -(-length // STEP)
    first_step = np.cumsum(steps) - steps
    step = first_step[text] + (np.arange(len(word)) - first[text]) // STEP
    return Words(word, text, (word >> np.uint64(64 - PLACES_BITS)).astype(np.int64), step, first, length, steps, first_step)


def weighted(idf: np.ndarray) -> np.ndarray:
    """Weight of a word: its inverse frequency counts twice, so common words say little."""
    return (idf * idf).astype(np.float32)


def summed(run: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of rows over runs of equal numbers, which ascend without gaps."""
    return np.add.reduceat(values, np.flatnonzero(np.append(True, run[1:] != run[:-1])))


def passages(w: Words, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and latent position of every passage, unit length: two steps, one step apart; a text of one step is one passage.

    `scaled` is the basis times the words' weights. Positions of steps add up to
    those of passages, so every word is looked up once.
    """
    per_text = np.where(w.steps > 0, np.maximum(1, w.steps - 1), 0)
    text = np.repeat(np.arange(len(per_text)), per_text)
    at = np.arange(len(text)) - (np.cumsum(per_text) - per_text)[text]
    if not len(text):
        return text, at, np.zeros((0, scaled.shape[1]), np.float32)
    sums = np.append(summed(w.step, np.take(scaled, w.place, axis=0, mode="clip")), np.zeros((1, scaled.shape[1]), np.float32), axis=0)
    here = w.first_step[text] + at
    out = sums[here] + sums[np.where(w.steps[text] > 1, here + 1, -1)]
    return text, at * STEP, out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def multiplied(w: Words, weight: np.ndarray, scaled: np.ndarray, total: np.ndarray) -> None:
    """Add (transposed TF-IDF) x (TF-IDF) x basis to `total`; rows are the texts' passages side by side, of length 1."""
    if not len(w.word):
        return
    rows = (w.steps + 1) // 2
    row = (np.cumsum(rows) - rows)[w.text] + (w.step - w.first_step[w.text]) // 2
    each = weight[w.place]
    square = np.maximum(summed(row, each * each), 1e-12)
    dense = summed(row, np.take(scaled, w.place, axis=0, mode="clip")) * (1 / square)[:, None]
    order = np.argsort(w.place.astype(np.uint16), kind="stable")  # sixteen bits are sorted by counting
    place, row = w.place[order], row[order]
    heads = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    times = np.diff(heads, append=len(place))
    alone = heads[times == 1]  # most places of a piece occur once and need no sum
    total[place[alone]] += np.take(dense, row[alone], axis=0, mode="clip") * weight[place[alone]][:, None]
    heads, often, times = heads[times > 1], np.repeat(times > 1, times), times[times > 1]
    if len(heads):
        total[place[heads]] += np.add.reduceat(np.take(dense, row[often], axis=0, mode="clip"), np.cumsum(times) - times) * weight[place[heads]][:, None]


def random_basis() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((PLACES, RANK)).astype(np.float32)


def inverse_frequencies(df: DataFrame) -> np.ndarray:
    """From the steps of all documents; one row per place comes to the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES + 1, np.int64)
        for b in batches:
            for _, _, offsets, data in pieces(pc.utf8_lower(b.column(0)), PIECE):
                w = words_of(offsets, data)
                key = w.step * PLACES + w.place
                key = key.astype(np.uint32) if not len(key) or key[-1] < 2 ** 31 else key  # steps ascend
                total[:PLACES] += np.bincount((np.unique(key) & (PLACES - 1)).astype(np.int64), minlength=PLACES)
                total[PLACES] += int(w.steps.sum())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["place", "n"])

    total = np.zeros(PLACES + 1)
    for r in df.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        total[r.place] = r.n
    return np.log((total[PLACES] + 1) / (total[:PLACES] + 1)) + 1


def basis(df: DataFrame, items: Sequence[str], idf: np.ndarray) -> np.ndarray:
    """Orthonormal right singular directions of the TF-IDF matrix of all passages, found by a randomised range finder.

    Every task multiplies its passages with the random basis and back; the sums of
    the tasks, of the fixed size places x rank, meet by blocks of places. Rows are
    passages side by side, so each word counts once. Benchmark passages are rows of
    the same matrix with a share of their own.
    """
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = weighted(idf), np.zeros((PLACES, RANK), np.float32)
        scaled = random_basis() * weight[:, None]
        for b in batches:
            for _, _, offsets, data in pieces(pc.utf8_lower(b.column(0)), PIECE):
                multiplied(words_of(offsets, data), weight, scaled, total)
        yield from blocks(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PLACES, RANK), np.float32)
        for b in batches:
            for block, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[block * BLOCK:(block + 1) * BLOCK] += np.frombuffer(part, np.float32).reshape(BLOCK, RANK)
        yield from blocks(total)

    def blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = total.reshape(-1, BLOCK * RANK)
        seen = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array([parts[i].tobytes() for i in seen], pa.binary())], ["block", "part"])

    sums = df.select("text").mapInArrow(multiply, "block long, part binary").repartition("block").mapInArrow(add, "block long, part binary")
    total = np.zeros((PLACES, RANK), np.float32)
    for r in sums.collect():  # places x rank numbers, whatever the documents
        total[r.block * BLOCK:(r.block + 1) * BLOCK] += np.frombuffer(r.part, np.float32).reshape(BLOCK, RANK)
    weight = weighted(idf)
    asked = np.zeros_like(total)
    multiplied(_items(items), weight, random_basis() * weight[:, None], asked)
    parts = [x / max(float(np.linalg.norm(x)), 1e-12) for x in (total, asked)]
    return np.linalg.qr(parts[0] + BENCHMARK_SHARE * parts[1])[0].astype(np.float32)


def _items(texts: Sequence[str]) -> Words:
    encoded = [t.lower().encode() for t in texts]
    return words_of(np.cumsum([0, *map(len, encoded)]), np.frombuffer(b"".join(encoded), np.uint8))


def common_length(masks: dict[int, int], size: int, words: list[int]) -> tuple[int, int, int]:
    """Length of the longest common subsequence with an item, and the first and last matched place, by bit vectors."""
    full = (1 << size) - 1
    row, first, last, best = full, -1, -1, 0
    for i, word in enumerate(words):
        hit = masks.get(word)
        if hit:
            u = row & hit
            row = ((row + u) | (row - u)) & full
            n = size - row.bit_count()
            if n > best:
                first, last, best = (i if first < 0 else first), i, n
    return best, first, last


LEAKS = ArrayType(StructType([StructField("item_id", LongType()), StructField("start", LongType()), StructField("end", LongType()),
                              StructField("cosine", DoubleType()), StructField("overlap", DoubleType()), StructField("answered", BooleanType())]))


class Search:
    """Finds the items of one block in texts; holds numbers for the block's items only, and the shared space."""

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray, space: np.ndarray):
        self.ids, self.scaled = [i for i, _ in items], space * weighted(idf)[:, None]
        p = _items([t for _, t in items])
        self.item, _, self.passages = passages(p, self.scaled)
        self.words = [p.word[f:f + n].tolist() for f, n in zip(p.first, p.length)]
        self.masks = [self._masks(w) for w in self.words]
        self.answers = [w[-max(3, len(w) // 4):] for w in self.words]
        self._index(idf[p.place], p)

    def _index(self, rarity: np.ndarray, p: Words) -> None:
        """Postings of each item's rarest words, so many that every leak holds a stated number of them.

        A leak misses size - least words at most, `least` being PARTIAL of them. Of the
        size - least + sure rarest it so holds `sure` at least, wherever the space puts it.
        """
        size = p.length
        least = np.ceil(PARTIAL * size).astype(np.int64)
        self.sure = np.maximum(1, (least + 1) // 2)
        self.step = np.maximum(1, size // 4)
        self.stretch = STRETCH * size + self.step
        order = np.lexsort((p.word, -rarity, p.text))
        rank = np.arange(len(order)) - p.first[p.text]
        order = order[rank < (size - least + self.sure)[p.text]]
        words, item = p.word[order], p.text[order]
        self.vocabulary, number = np.unique(words, return_inverse=True)
        pair, self.times = np.unique(number * len(size) + item, return_counts=True)
        self.posted = pair % len(size)
        self.postings = np.bincount(pair // len(size), minlength=len(self.vocabulary))
        self.first_posting = np.cumsum(self.postings) - self.postings
        self.asked = np.zeros(PLACES, bool)
        self.asked[p.place[order]] = True

    def sure_places(self, p: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and first word of all pairs of neighbouring blocks, as long as the item's stretch, that can hold a leak.

        Whatever fits into a stretch lies in two neighbouring blocks.
        """
        at = np.flatnonzero(self.asked[p.place])
        number = np.minimum(np.searchsorted(self.vocabulary, p.word[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[number] == p.word[at]
        at, number = at[same], number[same]
        n = self.postings[number]
        at, posting = np.repeat(at, n), np.repeat(self.first_posting[number] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, first = self.posted[posting], p.first[p.text[at]]
        begin = first + (at - first) // self.stretch[item] * self.stretch[item]
        _, kept = np.unique((begin * len(self.ids) + item) * len(self.vocabulary) + np.repeat(number, n), return_index=True)
        if not len(kept):
            return kept, kept, kept
        key, times = (begin * len(self.ids) + item)[kept], self.times[posting[kept]]
        held, key = summed(key, times), key[np.append(True, key[1:] != key[:-1])]
        # A pair may begin with a block that holds none of the words itself.
        text, apart = p.text[key // len(self.ids)], self.stretch[key % len(self.ids)]
        lead = np.flatnonzero(key // len(self.ids) - apart >= p.first[text])
        key = np.append(key, key[lead] - apart[lead] * len(self.ids))
        key, at = np.unique(key, return_index=True)
        held = np.append(held, np.zeros(len(lead), held.dtype))[at]
        item = key % len(self.ids)
        after = key + self.stretch[item] * len(self.ids)
        there = np.minimum(np.searchsorted(key, after), len(key) - 1)
        good = held + np.where(key[there] == after, held[there], 0) >= self.sure[item]
        begin, item = key[good] // len(self.ids), item[good]
        return p.text[begin], item, begin - p.first[p.text[begin]]

    def stretches(self, item: int, words: list[int]) -> list[tuple[int, int]]:
        """Parts of a pair of blocks, one stretch and a step long, that can hold a leak."""
        masks, size, step, stretch = self.masks[item], len(self.words[item]), int(self.step[item]), int(self.stretch[item])
        if sum(masks[w].bit_count() for w in masks.keys() & set(words)) < PARTIAL * size or common_length(masks, size, words)[0] < PARTIAL * size:
            return []
        return [(low, low + stretch) for low in range(0, max(1, min(stretch, len(words))), step)]

    @staticmethod
    def _masks(words: list[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(words):
            out[w] = out.get(w, 0) | 1 << i
        return out

    def piece(self, offsets: np.ndarray, data: np.ndarray) -> list[list[dict]]:
        p = words_of(offsets, data)
        found: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        owner, begin, position = passages(p, self.scaled)
        near = position @ self.passages.T
        row, column = np.nonzero(near >= COSINE)
        regions: dict[tuple[int, int], list[list]] = {}
        for text, item, start, cosine in zip(owner[row].tolist(), self.item[column].tolist(), begin[row].tolist(), near[row, column].tolist()):
            size = len(self.words[item])
            held = regions.setdefault((text, item), [])
            if held and start - size <= held[-1][1]:
                held[-1][1], held[-1][2] = max(held[-1][1], start + 2 * STEP + size), max(held[-1][2], cosine)
            else:
                held.append([start - size, start + 2 * STEP + size, cosine])
        bounds = np.searchsorted(owner, np.arange(len(offsets)))
        for text, item, start in zip(*(x.tolist() for x in self.sure_places(p))):
            low, high = int(p.first[text]) + start, int(p.first[text]) + min(start + 2 * int(self.stretch[item]), int(p.length[text]))
            parts = self.stretches(item, p.word[low:high].tolist())
            if parts:
                mine = np.flatnonzero(np.abs(begin[bounds[text]:bounds[text + 1]] - start) <= 2 * self.stretch[item] + 2 * STEP) + bounds[text]
                cosine = float(near[mine][:, self.item == item].max())
                regions.setdefault((text, item), []).extend([start + a, start + b, cosine] for a, b in parts)
        for (text, item), held in regions.items():
            size, best = len(self.words[item]), None
            for low, high, cosine in held:
                low, high = max(0, low), min(high, int(p.length[text]))
                words = p.word[p.first[text] + low:p.first[text] + high].tolist()
                if sum(map(self.masks[item].__contains__, words)) < PARTIAL * size:
                    continue
                n, first, last = common_length(self.masks[item], size, words)
                if n < PARTIAL * size or best and n <= best["overlap"] * size:
                    continue
                answer = self.answers[item]
                answered = common_length(self._masks(answer), len(answer), words[max(0, first):last + 1])[0] >= OVERLAP * len(answer)
                if n >= OVERLAP * size or answered:
                    best = {"item_id": self.ids[item], "start": low + first, "end": low + last + 1, "cosine": min(1.0, cosine), "overlap": n / size, "answered": answered}
            if best:
                found[text].append(best)
        return found


def finder(df: DataFrame, benchmark: DataFrame):
    """A column function of the text: its leaks (item_id, start, end in words, cosine, overlap, answered), one per item.

    Space and frequencies come from all rows of `df`. Benchmark rows without an id
    or words are left out. An item leaks into a text that holds OVERLAP of its words
    in order near a passage alike in the latent space, or PARTIAL of them with the
    answer (its last quarter, three words at least). Where they stand within STRETCH
    times its words, the item is found whatever the space says: its rarest words lead
    to it as well. The benchmark is the stated
    query set; its items are searched for in blocks, each text against one block at
    a time. Null and empty texts have no leaks.
    """
    items = sorted((r.item_id, r.text) for r in benchmark.select("item_id", "text").filter("item_id is not null and text is not null").collect())
    items = [x for x in items if _items([x[1]]).length[0]]
    idf = inverse_frequencies(df)
    space = basis(df, [t for _, t in items], idf) if items else np.zeros((PLACES, RANK), np.float32)
    shared = df.sparkSession.sparkContext.broadcast((items, idf, space))
    made: list[Search] = []

    def leaks(column: pa.Array) -> pa.Array:
        if not made:
            items, idf, space = shared.value
            made.extend(Search(items[i:i + ITEMS], idf, space) for i in range(0, len(items), ITEMS))
        out: list[list[dict]] = []
        for _, _, offsets, data in pieces(pc.utf8_lower(column), PIECE):
            per_block = [s.piece(offsets, data) for s in made]
            out += [sum(x, []) for x in zip(*per_block)] if per_block else [[] for _ in range(len(offsets) - 1)]
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("cosine", pa.float64()), ("overlap", pa.float64()), ("answered", pa.bool_())]))
        return pa.array(out, kind)

    leaks.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(leaks, LEAKS)


def find_leaks(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and the leak's columns, a row for each text of `df` and item found in it."""
    got = finder(df, benchmark)(F.col("text"))
    return df.select("doc_id", F.inline(got))


def keep_clean(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `df` without a leak; all columns pass through unchanged."""
    return df.withColumn("_leaks", finder(df, benchmark)(F.col("text"))).filter(F.size("_leaks") == 0).select(*df.columns)
