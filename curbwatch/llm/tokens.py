"""Token ids of whole texts with a public tokenizer, and binary files written through Spark."""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .bpe import runs
from .common import pieces

#: Words whose ids a worker keeps, and the longest word it keeps.
KEPT_WORDS, KEPT_BYTES = 400_000, 64
#: Bytes of text whose distinct words are looked up together; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Characters below U+0180 other than white space and controls, by Unicode category.
_CHARS = [c for c in map(chr, range(0x180)) if len(c.lower()) == 1 and not c.isspace() and unicodedata.category(c) not in ("Cc", "Cf", "Zs")]
_CLASS = {k: "".join(re.escape(c) for c in _CHARS if (unicodedata.category(c)[0] == k)) for k in "LN"}
_LATIN = re.compile("[" + "".join(map(re.escape, _CHARS)) + "]*")
#: The pieces of lower-cased words that the file's splitter pattern gives, for these characters.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_CLASS['L']}]+|[{_CLASS['N']}]|[^{_CLASS['L']}{_CLASS['N']}\n]+|\n")
#: The character that stands for each byte in byte-level vocabularies: itself where it is visible, else one from U+0100 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = [chr(b) if b in _VISIBLE else chr(256 + sum(x not in _VISIBLE for x in range(b))) for b in range(256)]


class Kept:
    """Bytes of strings used of late: when KEPT_WORDS are held, those not used since the last time go."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        found = self.now.get(key)
        if found is None and (found := self.before.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(key) > KEPT_BYTES:
            return
        if 2 * len(self.now) >= KEPT_WORDS:
            self.now, self.before = {}, self.now
        self.now[key] = value


class Encoder:
    """Ids of texts as little-endian integers.

    The tokenizer's normalizer and splitter never join or change anything across
    white space, so a text's ids are those of its words in turn. The distinct words
    of a chunk of texts are looked up, the ids of frequent ones are kept, and only
    what is new is cut and encoded; the ids of the texts are then laid out by array.
    """

    def __init__(self, path: str, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 65_536 else "<u4")
        self.model = self.tokenizer.model
        self.kept, self.pieces = Kept(), Kept()
        sample = "it's A1² ß, Éa's x_y '' don'T"
        self.cuts = True
        self.cuts = b"".join(self._many(sample.split())) == self._whole(sample)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(_SHOWN.__getitem__, piece.encode()))
        ids = array(self.kind.char, [t.id for t in self.model.tokenize(shown)])
        if sys.byteorder == "big":
            ids.byteswap()
        self.pieces.put(piece, out := ids.tobytes())
        return out

    def _many(self, words: list[str]) -> list[bytes]:
        """Ids of words. Those of Latin characters are cut into pieces here, all at once, as the tokenizer does, since pieces recur more often than words."""
        latin = [bool(self.cuts and _LATIN.fullmatch(w) and "<|" not in w) for w in words]
        cut, held, get = [], [], self.pieces.get
        for piece in _PIECES.findall("\n".join(w for w, easy in zip(words, latin) if easy).lower()):
            if piece == "\n":
                cut.append(b"".join(held))
                held = []
            else:
                held.append(get(piece) or self._piece(piece))
        cut.append(b"".join(held))
        ids = iter(cut)
        return [next(ids) if easy else self._whole(w) for w, easy in zip(words, latin)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and how many each has; null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        at = split.offsets.to_numpy().astype(np.int64)
        words = split.values.dictionary_encode()
        distinct = [w.decode("utf-8", "replace") for w in words.dictionary.cast(pa.large_binary()).to_pylist()]
        ids = [self.kept.get(w) for w in distinct]
        missing = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(missing, self._many([distinct[i] for i in missing])):
            ids[i] = x
            self.kept.put(distinct[i], x)
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        which = words.indices.to_numpy().astype(np.int64)[at[0]:at[-1]]
        total = np.concatenate([[0], np.cumsum(n[which])])
        at -= at[0]
        return runs(np.frombuffer(b"".join(ids), self.kind), (np.cumsum(n) - n)[which], n[which]), total[at[1:]] - total[at[:-1]]


@lru_cache(maxsize=4)
def encoder(path: str, plain: bool) -> Encoder:
    """One per worker process."""
    return Encoder(path, plain)


def token_ids(text: Column, path: str, plain: bool = False) -> Column:
    """Binary column of the ids of every whole text, 2 bytes an id for vocabularies under 65,536, else 4; null is empty.

    `plain`: the strings of special tokens in a text are ordinary text.
    """
    def encode(column: pa.Array) -> pa.Array:
        held, out = encoder(path, plain), []
        for row, end, _, _ in pieces(column, CHUNK_BYTES):
            flat, n = held.encode(column.slice(row, end - row))
            offsets = np.concatenate([[0], np.cumsum(n * held.kind.itemsize)]).astype(np.int64)
            out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).cast(pa.binary()))
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    encode.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(encode, BinaryType())(text)


def text_options(writer, end: bytes):
    """Options of Spark's text sink that write a string column's bytes as they are, `end` after each row."""
    return writer.option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).option("compression", "none")


def write_binary(df: DataFrame, column: str, end: bytes, folder: str) -> None:
    """Write a binary column as raw bytes, `end` after each row, one file a task."""
    text_options(df.select(F.col(column).cast("string").alias("value")).write, end).text(folder)


def read_binary(spark, folder: str) -> DataFrame:
    """path and content of the files that write_binary() wrote; a file must stay under 2 GB."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
            .select("path", "content"))
