"""Byte-level BPE by an index of pair occurrences, and decoding (operator 12)."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import pieces as row_pieces

#: Bytes of text whose pairs are indexed together; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Words of visible ASCII, which need no normalizer; \n parts them.
_VISIBLE = re.compile("[!-~]+")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\n]+|\n")
#: The splitter and normalizer of the file that the short way for visible ASCII stands for.
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KNOWN_NORMAL = ["NFC", "Replace", "Lowercase"]


def runs(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start[0]:start[0]+length[0]], flat[start[1]:...], ... one after another."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    kind = np.int32 if max(ends[-1], len(flat)) < 2 ** 31 else np.int64
    return flat[np.repeat((start - ends + length).astype(kind), length) + np.arange(ends[-1], dtype=kind)]


class Vocabulary:
    """Merges, symbols and tokens of a tokenizer file with a byte-level BPE model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, ids = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("not a plain byte-level BPE file")
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if split != _KNOWN_SPLIT or normal != _KNOWN_NORMAL:
            raise ValueError("the file's splitter may join what white space parts")
        suffix = model.get("end_of_word_suffix") or ""
        shown = sorted({c for c in ids if len(c) == 1})
        self.first = np.full(max(map(ord, shown)) + 1, -1, np.int32)
        self.last = self.first.copy()
        for c in shown:
            self.first[ord(c)], self.last[ord(c)] = ids[c], ids.get(c + suffix, -1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.width = max(ids.values()) + 1
        code = self.left * self.width + self.right
        self.order = np.argsort(code, kind="stable")
        self.codes = code[self.order]
        # A merge is early if its token is part of a pair of lower rank: its places are then merged one by one.
        lowest = np.full(self.width, len(pairs), np.int64)
        np.minimum.at(lowest, self.left, np.arange(len(pairs)))
        np.minimum.at(lowest, self.right, np.arange(len(pairs)))
        self.early = lowest[self.made] < np.arange(len(pairs))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            raise ValueError("added tokens that look at what stands beside them")
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        tokens = [""] * max([self.width, *(i + 1 for i in special.values())])
        for t, i in [*ids.items(), *special.items()]:
            tokens[i] = t
        self.tokens = pa.array(tokens, pa.string())

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of every pair of symbols, -1 where no merge joins them."""
        code = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (a >= 0) & (b >= 0), self.order[at], -1)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Base symbols of pieces written in byte characters, and the place where each piece begins."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        symbol = self.first[code]
        symbol[begin + size - 1] = self.last[code[begin + size - 1]]
        if (symbol < 0).any():
            raise ValueError("a byte without a symbol in the vocabulary")
        return symbol, begin

    def merge(self, symbol: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and how many each has.

        `places` maps a rank to the places of its pair in all pieces. The lowest
        rank that has places is taken off, applied to all of them, and the pairs
        that arise left and right of a new symbol are put under their own ranks.
        Places whose pair is gone by then are passed over.
        """
        n = len(symbol)
        last = np.zeros(n, bool)
        last[begin[1:] - 1] = True
        last[n - 1:] = True
        kind = np.int32 if n < 2 ** 31 else np.int64
        following = np.arange(1, n + 1, dtype=kind)
        following[last] = -1
        before = np.arange(-1, n - 1, dtype=kind)
        before[begin] = -1
        piece = np.repeat(np.arange(len(begin), dtype=kind), np.diff(begin, append=n))
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def put(at: np.ndarray, rank: np.ndarray) -> None:
            known = rank >= 0
            at, rank = at[known], rank[known]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            lows = [0, *cuts.tolist()]
            for r, i, j in zip(rank[lows].tolist(), lows, [*lows[1:], len(at)]):
                held = places.get(r)
                if held is None:
                    places[r] = [at[i:j]]
                    heapq.heappush(active, r)
                else:
                    held.append(at[i:j])

        at = np.flatnonzero(~last).astype(kind)
        put(at, self.rank(symbol[at], symbol[at + 1]))
        while active:
            r = heapq.heappop(active)
            held = places.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            a, b = self.left[r], self.right[r]
            next_ = following[at]
            there = (symbol[at] == a) & (next_ >= 0) & (symbol[next_] == b)
            at, next_ = at[there], next_[there]
            if not len(at):
                continue
            if a == b:  # of a run of overlapping places every second one holds, from the left
                joined = np.flatnonzero(np.concatenate([[True], next_[:-1] != at[1:]]))
                odd = (np.arange(len(at)) - np.repeat(joined, np.diff(joined, append=len(at)))) % 2 == 1
                at, next_ = at[~odd], next_[~odd]
            if self.early[r]:
                first = np.concatenate([[True], piece[at[1:]] != piece[at[:-1]]])
                rest, at, next_ = at[~first], at[first], next_[first]
                put(rest, np.full(len(rest), r))
            after = following[next_]
            symbol[at], symbol[next_] = self.made[r], -1
            following[at] = after
            inner = after >= 0
            before[after[inner]] = at[inner]
            left = before[at]
            inside = left >= 0
            left, right, end = left[inside], at[inner], after[inner]
            put(np.concatenate([left, right]), self.rank(np.concatenate([symbol[left], symbol[right]]), np.concatenate([symbol[at[inside]], symbol[end]])))
        alive = symbol >= 0
        return symbol[alive], np.bincount(piece[alive], minlength=len(begin))

    def cut_words(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """Pieces in byte characters of all words, and the word each belongs to. A piece that is a special token keeps its text."""
        out: list[str] = []
        owner: list[np.ndarray] = []
        plain, odd = [], []
        for i, w in enumerate(words):
            if self.cut is not None and self.cut.search(w):
                odd.append(i)
            elif w:
                plain.append(i)
        easy = [i for i in plain if _VISIBLE.fullmatch(words[i])]
        easy_set = set(easy)
        hard = [i for i in plain if i not in easy_set]
        if easy:
            found = _SPLIT.findall("\n".join([words[i] for i in easy]).lower())
            breaks = np.fromiter((p == "\n" for p in found), bool, len(found))
            own = np.array(easy)[np.cumsum(breaks) - breaks]
            out += [p for p in found if p != "\n"]
            owner.append(own[~breaks])
        normal, split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        even, single = [], [(i, p) for i in odd for p in self.cut.split(words[i]) if p]
        for i in hard:
            text = normal(words[i])
            if " " in text:
                single.append((i, words[i]))
            elif text:
                even.append((i, text))
        if even:
            starts = np.cumsum([0, *[len(t) + 1 for _, t in even[:-1]]])
            found = split(" ".join([t for _, t in even]))
            out += [p for p, _ in found]
            at = np.fromiter((s for _, (s, _) in found), np.int64, len(found))
            owner.append(np.array([i for i, _ in even])[np.searchsorted(starts, at, "right") - 1])
        for i, part in single:
            found = [part] if part in self.special else [p for p, _ in split(normal(part))]
            out += found
            owner.append(np.full(len(found), i))
        return out, np.concatenate(owner).astype(np.int64) if owner else np.zeros(0, np.int64)

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after another, and how many each has."""
        found, owner = self.cut_words(words)
        if not found:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        order = np.argsort(owner, kind="stable")
        coded = pa.array(found, pa.large_string()).dictionary_encode()
        distinct, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()[order].astype(np.int64)
        special = np.array([self.special.get(p, -1) for p in distinct]) if self.special else np.full(len(distinct), -1)
        plain = np.flatnonzero(special < 0)
        n = np.ones(len(distinct), np.int64)
        if len(plain):
            merged, counts = self.merge(*self.symbols([distinct[i] for i in plain]))
            n[plain] = counts
        flat = np.empty(int(n.sum()), np.int32)
        begin = np.cumsum(n) - n
        inside = np.repeat(special < 0, n)
        if len(plain):
            flat[inside] = merged
        flat[~inside] = special[special >= 0]
        count = np.bincount(owner, np.asarray(n)[which][np.argsort(order, kind="stable")], minlength=len(words)).astype(np.int64)
        return runs(flat, begin[which], n[which]), count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after another, and the count of each text."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        offsets = split.offsets.to_numpy().astype(np.int64)
        words = split.values.dictionary_encode()
        ids, n = self.ids_of(words.dictionary.to_pylist())
        which = words.indices.to_numpy().astype(np.int64)[offsets[0]:offsets[-1]]
        begin = np.cumsum(n) - n
        size = n[which]
        total = np.concatenate([[0], np.cumsum(size)])
        at = offsets - offsets[0]
        return runs(ids, begin[which], size), total[at[1:]] - total[at[:-1]]


    def decode(self, column: pa.Array) -> pa.Array:
        """Tokens of the ids in a binary column, parted by a space."""
        out = []
        for _, _, at, part in row_pieces(column, CHUNK_BYTES):
            named = self.tokens.take(pa.array(np.frombuffer(part.tobytes(), "<u4").astype(np.int32)))
            out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array((at // 4).astype(np.int32)), named), " "))
        whole = pa.concat_arrays(out) if out else pa.array([], pa.string())
        return pc.if_else(column.is_valid(), whole, pa.scalar(None, pa.string())) if column.null_count else whole


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """`df` without its text column and with a binary column of the ids of every whole text, 4 little-endian bytes an id.

    Words are cut at white space, which neither the file's normalizer nor its
    splitter joins anything across; a chunk of at most CHUNK_BYTES of text (or one
    longer text) is encoded at once: its distinct words, of these the distinct
    pieces, and all of those by one index of pair occurrences. With `decoded`, a
    column of that name holds what the ids decode to. Strings of special tokens in
    a text become their ids, as the library does unless told otherwise. Null and
    empty texts have no ids; equal rows each keep theirs; other columns stay as
    they are, and columns already called as the new ones are replaced.
    """
    new = [ids] if decoded is None else [ids, decoded]
    carried = [c for c in df.columns if c not in (text, *new)]
    schema = df.select(*carried).schema.add(ids, "binary")
    if decoded is not None:
        schema = schema.add(decoded, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary(path)
        for b in batches:
            column = b.column(len(carried))
            for row, end, _, _ in row_pieces(column, CHUNK_BYTES):
                flat, n = held.encode(pc.fill_null(column.slice(row, end - row), ""))
                offsets = np.concatenate([[0], np.cumsum(4 * n)])
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat.astype("<u4"))]).cast(pa.binary())
                out = [data] if decoded is None else [data, held.decode(data)]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(row, end - row) for i in range(len(carried))), *out], [*carried, *new])
                del flat, data, out
                pa.default_memory_pool().release_unused()

    return df.select(*carried, text).mapInArrow(run, schema)


def decode(ids: Column, path: str) -> Column:
    """The text the library's decode(ids, skip_special_tokens=False) gives for a file without a decoder: tokens parted by a space. Null stays null."""
    def run(column: pa.Array) -> pa.Array:
        return vocabulary(path).decode(column)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, StringType())(ids)
