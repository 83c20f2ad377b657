"""Token counts of flat token files without an index (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, there
from .tokens import read_binary, text_options, token_ids, write_binary

#: Ids of a block.
BLOCK = 1 << 18


def scan(spark: SparkSession, folder: str, end_id: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Documents of flat little-endian token files: path, doc_no, start, n_tokens and ended.

    Every block of a file is searched for `end_id` on its own. A prefix scan over
    the blocks of each file then gives a block the documents ended and the last end
    before it, so a document that begins blocks earlier gets its whole length. Ids
    after a file's last end are a document with ended = false; an empty file has
    none. start and doc_no count from 0 in each file; n_tokens leaves out the end.
    Bytes beyond the last whole id raise an error.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = np.frombuffer(content.as_buffer(), f"<u{width}")
                for number, at in enumerate(range(0, len(data), block)):
                    part = data[at:at + block]
                    ends = np.flatnonzero(part == end_id) + at
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([number], pa.int64()), pa.array([at + len(part)], pa.int64()), pa.array([at + len(part) == len(data)]),
                         pa.array([ends.tolist()], pa.list_(pa.int64()))], ["path", "block", "upto", "final", "ends"])

    found = read_binary(spark, folder).mapInArrow(search, "path string, block long, upto long, final boolean, ends array<long>")
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.withColumns({
        "_docs": F.coalesce(F.sum(F.size("ends").cast("bigint")).over(earlier), F.lit(0)),
        "_last": F.coalesce(F.max(F.array_max("ends")).over(earlier), F.lit(-1)).cast("bigint"),
    })
    all_ends = F.when(F.col("final") & (F.coalesce(F.array_max("ends"), "_last") < F.col("upto") - 1), F.concat("ends", F.array("upto"))).otherwise(F.col("ends"))
    one = stitched.withColumn("_ends", all_ends).select("path", "_docs", "_last", "upto", "final", F.size("ends").alias("_n"), "_ends", F.posexplode("_ends").alias("_i", "_end"))
    start = F.when(F.col("_i") == 0, F.col("_last") + 1).otherwise(F.try_element_at("_ends", F.greatest(F.col("_i"), F.lit(1))) + 1)
    return one.select("path", (F.col("_docs") + F.col("_i")).alias("doc_no"), start.alias("start"), (F.col("_end") - start).alias("n_tokens"), (F.col("_i") < F.col("_n")).alias("ended"))


def write_flat(df: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write the ids of all texts (null: none) to flat files of 2-byte ids below `folder`/kind=tokens, `end_id` after each; they hold no index.

    A task writes the rows of its partition to one file, in order, without a
    shuffle, so rows of any id spread as the input does. The same task writes their
    doc_ids in the same order to a file of its own number below kind=rows, so
    however the input is split, or read again, the two belong together. Returns
    doc_id, part and doc_no of every row, from these: the number of its file, and
    which document of it the row is. A null doc_id stays null.
    """
    end = np.array([end_id], "<u2").tobytes()
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("string").alias("_doc"), token_ids(F.col("text"), tokenizer, plain=True).cast("string").alias("_ids"))
    both = F.explode(F.array(F.struct(F.lit("tokens").alias("kind"), F.col("_ids").alias("value")), F.struct(F.lit("rows").alias("kind"), F.coalesce("_doc", F.lit("")).alias("value"))))
    sorted_ = rows.select("_row", both.alias("_x")).select("_row", "_x.kind", "_x.value").sortWithinPartitions("kind", "_row").select("kind", "value")
    text_options(sorted_.write.partitionBy("kind"), end).text(folder)
    if not there(df.sparkSession, f"{folder}/kind=tokens"):  # no rows, no files
        for kind in ("tokens", "rows"):
            write_binary(df.select(F.lit(b"").alias("ids")).limit(0), "ids", end, f"{folder}/kind={kind}")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                ids = content.as_py().split(end)[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([int(i) if i else None for i in ids], pa.int64()), pa.array(np.full(len(ids), part_number(path), np.int32)),
                                                  pa.array(np.arange(len(ids)))], ["doc_id", "part", "doc_no"])

    return read_binary(df.sparkSession, f"{folder}/kind=rows").mapInArrow(names, "doc_id long, part int, doc_no long")


def part_number(path: str) -> int:
    return int(path.rsplit("part-", 1)[1].split("-", 1)[0])


def count_tokens(df: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, part, doc_no, start and n_tokens of every row of `df`, read off the flat files."""
    folder = new_folder(df.sparkSession, "flat")
    names = write_flat(df, folder, tokenizer, end_id)
    found = scan(df.sparkSession, f"{folder}/kind=tokens", end_id)
    found = found.withColumn("part", F.regexp_extract("path", "part-(\\d+)", 1).cast("int")).select("part", "doc_no", "start", "n_tokens")
    return names.join(found, ["part", "doc_no"]).select("doc_id", "part", "doc_no", "start", "n_tokens")
