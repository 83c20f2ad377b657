"""Token ids in files of interleaved range asymmetric numeral systems with shared frequencies (operator 8)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, stage, text_buffer
from .tokens import read_binary, token_ids, write_binary

#: Bits of the frequency table; states stay in [2**31, 2**63) and move 32 bits at a time.
SCALE = 20
FLOOR = 1 << 31
#: Interleaved states of a segment, and ids of one state in it. A segment starts at a checkpoint.
LANES, DEPTH = 256, 128
#: Ids after which a block ends, at the next end of a document.
BLOCK = 1 << 18
#: Bytes of a file aimed at.
FILE_BYTES = 64 << 20

HEADER = struct.Struct("<4sIIII")
MAGIC, END = b"rANS", b"\nend"


def quantized(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**SCALE, at least 1 for every id that occurs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.uint64)
    if np.count_nonzero(counts) > 1 << SCALE:
        raise ValueError("more ids than the frequency table has places")
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * ((1 << SCALE) / total))), 0).astype(np.int64)
    spare = (1 << SCALE) - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    while spare:
        share = np.minimum(freq[order] - 1, -spare) if spare < 0 else np.full(1, spare)
        if spare > 0:
            freq[order[0]] += spare
            break
        taken = np.minimum(np.cumsum(share), -spare)
        freq[order] -= np.diff(taken, prepend=0)
        spare = 0
    return freq.astype(np.uint64)


class Table:
    """What coding needs of the frequencies."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """States (segments x lanes) and the 32-bit words of every segment."""
        segments = max(1, -(-len(ids) // (LANES * DEPTH)))
        grid = np.zeros(segments * LANES * DEPTH, np.int64)
        grid[:len(ids)] = ids
        grid = grid.reshape(segments, DEPTH, LANES)
        there = (np.arange(segments * LANES * DEPTH) < len(ids)).reshape(segments, DEPTH, LANES)
        x = np.full((segments, LANES), FLOOR, np.uint64)
        words, owners = [], []
        shift, low = np.uint64(32), np.uint64(0xFFFFFFFF)
        for r in range(DEPTH - 1, -1, -1):
            use = there[:, r]
            if not use.any():
                continue
            f = np.where(use, self.freq[grid[:, r]], np.uint64(1))
            full = use & (x >= f << np.uint64(63 - SCALE))
            words.append((x[full] & low).astype(np.uint32))
            owners.append(np.nonzero(full)[0])
            x = np.where(full, x >> shift, x)
            whole = x // f
            x = np.where(use, (whole << np.uint64(SCALE)) + (x - whole * f) + self.start[grid[:, r]], x)
        words, owners = words[::-1], owners[::-1]
        flat = np.concatenate(words) if words else np.zeros(0, np.uint32)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        cuts = np.cumsum(np.bincount(owner, minlength=segments))[:-1]
        return x, np.split(flat[order], cuts)

    def decode(self, n: int, x: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        """All segments side by side, each from its checkpoint."""
        segments = len(words)
        out = np.zeros((segments, DEPTH, LANES), np.uint32)
        there = (np.arange(segments * LANES * DEPTH) < n).reshape(segments, DEPTH, LANES)
        flat = np.append(np.concatenate(words), np.uint32(0)).astype(np.uint64)
        at = np.cumsum([0, *[len(w) for w in words[:-1]]])
        mask = np.uint64((1 << SCALE) - 1)
        for r in range(DEPTH):
            use = there[:, r]
            if not use.any():
                break
            slot = x & mask
            s = self.symbol[slot]
            out[:, r] = s
            next_ = self.freq[s] * (x >> np.uint64(SCALE)) + slot - self.start[s]
            x = np.where(use, next_, x)
            short = use & (x < np.uint64(FLOOR))
            if short.any():
                place = at[:, None] + np.cumsum(short, axis=1) - 1
                x[short] = x[short] << np.uint64(32) | flat[place[short]]
                at = at + short.sum(axis=1)
        return out.reshape(-1)[:n]


def pack(table: Table, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A block: header, documents, checkpoints (words so far, checksum, states), words, and a checksum of it all."""
    states, words = table.encode(ids)
    sizes = np.array([len(w) for w in words], "<u4")
    sums = np.array([zlib.crc32(ids[i * LANES * DEPTH:(i + 1) * LANES * DEPTH].astype("<u4").tobytes()) for i in range(len(words))], "<u4")
    body = b"".join([HEADER.pack(MAGIC, len(doc_ids), len(ids), len(words), int(sizes.sum())), doc_ids.astype("<i8").tobytes(), known.astype("u1").tobytes(),
                     lengths.astype("<u4").tobytes(), sizes.tobytes(), sums.tobytes(), states.astype("<u8").tobytes(), np.concatenate(words).astype("<u4").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(table: Table, data: memoryview) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the first block of `data`, its documents' ids, whether they are known, their lengths, and the token ids."""
    magic, docs, n, segments, count = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = HEADER.size

    def take(kind: str, size: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, size, at)
        at += out.nbytes
        return out

    doc_ids, known, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    sizes, sums, states = take("<u4", segments), take("<u4", segments), take("<u8", segments * LANES)
    words = np.split(take("<u4", count), np.cumsum(sizes)[:-1])
    if zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("a block of token ids is damaged")
    ids = table.decode(n, states.reshape(segments, LANES).copy(), words)
    for i in range(segments):
        if zlib.crc32(ids[i * LANES * DEPTH:(i + 1) * LANES * DEPTH].astype("<u4").tobytes()) != sums[i]:
            raise ValueError("a segment of token ids is damaged")
    return at + 4 + len(END), doc_ids, known.astype(bool), lengths, ids


def _id_type(path_bytes: int) -> str:
    return "<u2" if path_bytes == 2 else "<u4"


def count_ids(tokens: DataFrame, width: int, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents; each task sends one row per id it has seen."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            _, data = text_buffer(b.column(0))
            total += np.bincount(np.frombuffer(data.tobytes(), _id_type(width)), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    out = np.zeros(vocabulary, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int) -> None:
    """Write the ids of all texts of `df` (doc_id, text) to `folder`, in ascending doc_id order over files and in each.

    Every document ends with `end_id`. A null text is empty; a null doc_id stands
    first; rows of one doc_id stand in an order of their text's hash. Texts are
    tokenized once, into a table that the frequency count, the range exchange and
    the encoder read.
    """
    spark = df.sparkSession
    from tokenizers import Tokenizer
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    width = 2 if vocabulary < 65_536 else 4
    end = np.array([end_id], _id_type(width)).tobytes()
    tokens = stage(df.select("doc_id", F.xxhash64("text").alias("tie"), F.concat(token_ids(F.col("text"), tokenizer), F.lit(end)).alias("ids")), "tokens")
    freq = quantized(count_ids(tokens, width, vocabulary))
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq) if f], "id int, freq long").coalesce(1).write.parquet(f"{folder}/table")
    total = tokens.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = Table(freq), [], 0

        def block() -> pa.RecordBatch:
            doc_ids, lengths = [d for d, _ in held], np.array([len(x) for _, x in held])
            known = np.array([d is not None for d in doc_ids])
            packed = pack(table, np.array([d or 0 for d in doc_ids], np.int64), known, lengths, np.concatenate([x for _, x in held]))
            return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["block"])

        for b in batches:
            offsets, data = text_buffer(b.column(1))
            flat = np.frombuffer(data[offsets[0]:offsets[-1]].tobytes(), _id_type(width))
            at = ((offsets - offsets[0]) // width).tolist()
            for d, s, e in zip(b.column(0).to_pylist(), at[:-1], at[1:]):
                held.append((d, flat[s:e]))
                size += e - s
                if size >= BLOCK:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    ordered = tokens.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    write_binary(ordered.select("doc_id", "ids").mapInArrow(blocks, "block binary"), "block", END, f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Decode the files of a folder: doc_id, start, n_tokens and ids_crc32 of every document, checksums verified.

    Files are decoded apart; a document's start is its place in its file plus the
    ids of all files before it, of which there are as many as files.
    """
    size = spark.read.parquet(f"{folder}/table")
    rows = size.collect()  # at most the vocabulary
    freq = np.zeros(max([r.id for r in rows], default=0) + 1, np.uint64)
    for r in rows:
        freq[r.id] = r.freq

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                number, data, at, start = int(path.rsplit("part-", 1)[1].split("-", 1)[0]), memoryview(content.as_buffer()), 0, 0
                while at < len(data):
                    used, doc_ids, known, lengths, ids = unpack(table, data[at:])
                    at += used
                    flat = memoryview(ids.astype("<u4").tobytes())
                    ends = np.cumsum(lengths.astype(np.int64))
                    begins = ends - lengths
                    sums = [zlib.crc32(flat[4 * s:4 * e]) for s, e in zip(begins.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc_ids), number)), pa.array(doc_ids, mask=~known), pa.array(begins + start),
                                                      pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())], ["file", "doc_id", "begin", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])

    decoded = stage(read_binary(spark, f"{folder}/blocks").mapInArrow(decode, "file long, doc_id long, begin long, n_tokens long, ids_crc32 long"), "decoded")
    totals = decoded.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return decoded.join(F.broadcast(totals), "file").select("doc_id", (F.col("begin") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(df: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    folder = new_folder(df.sparkSession, "token-files")
    write(df, folder, tokenizer, end_id)
    return read(df.sparkSession, folder)
