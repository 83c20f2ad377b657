"""Building blocks that keep one hot key from landing in one task.

A plain window over (camera) or (region) puts all rows of that key into a single
task. The helpers here cut a key's rows into ordered chunks, summarise each
chunk with a partial aggregate, run the window over the few chunk summaries, and
finish inside the chunks, so that the work of a hot key spreads over its chunks.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_S = 7 * 86400.0


def time_chunk(at: str | Column, seconds: float = CHUNK_S) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return F.floor(at / seconds)


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of every key. Spark keeps at most k rows per key and map task before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def running(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], inclusive: bool = True,
            **values: tuple[str, Column]) -> DataFrame:
    """Running sum, max or min per key in row order, by two passes.

    `values` maps a new column to (aggregate, expression). With inclusive=False the
    row itself is left out. Rows are unique under `order` within a key.
    """
    agg = {"sum": F.sum, "max": F.max, "min": F.min}
    work = df.withColumns({f"_v_{n}": e for n, (_, e) in values.items()})
    parts = work.groupBy(*keys, chunk).agg(*[agg[a](f"_v_{n}").alias(f"_c_{n}") for n, (a, _) in values.items()])
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, chunk, *[agg[a](f"_c_{n}").over(before).alias(f"_p_{n}") for n, (a, _) in values.items()])
    inside = (Window.partitionBy(*keys, chunk).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    joined = work.join(parts, [*keys, chunk], "left")
    out = {}
    for n, (a, _) in values.items():
        here, earlier = agg[a](f"_v_{n}").over(inside), F.col(f"_p_{n}")
        if a == "sum":
            out[n] = F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0))
        else:
            out[n] = (F.greatest if a == "max" else F.least)(here, earlier)
    temporary = [f"_v_{n}" for n in values] + [f"_p_{n}" for n in values]
    return joined.withColumns(out).drop(*temporary)


def with_halo(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], k: int) -> DataFrame:
    """Add to every chunk the k rows that precede it, marked `_halo`.

    A window of up to k preceding rows can then be partitioned by (keys, chunk).
    k chunks of k rows bound the array held per chunk, however many rows a key has.
    """
    payload = [c for c in df.columns if c not in (*keys, chunk)]
    tail = top_per(df, [*keys, chunk], [F.col(c).desc() for c in order], k)
    row = F.struct(*order, *[c for c in payload if c not in order])
    tails = tail.groupBy(*keys, chunk).agg(F.array_sort(F.collect_list(row)).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(-k, -1)
    lead_in = F.flatten(F.collect_list("_tail").over(earlier))
    carried = (tails.select(*keys, chunk, F.slice(F.reverse(lead_in), 1, k).alias("_rows"))
               .select(*keys, chunk, F.inline("_rows"))
               .select(*df.columns, F.lit(True).alias("_halo")))
    return df.withColumn("_halo", F.lit(False)).unionByName(carried)


def chunk_rank(df: DataFrame, keys: Sequence[str], coarse: Sequence[tuple[str, Column, bool]], order: Sequence[Column],
               rank: str = "rank") -> DataFrame:
    """Exact 1-based rank within keys without sorting a whole key in one task.

    `coarse` lists (name, expression, descending) that agree with `order` but take
    few values; rows are counted per coarse value first and only ranked inside it.
    """
    work = df.withColumns({n: e for n, e, _ in coarse})
    names = [n for n, _, _ in coarse]
    sizes = work.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    by = [F.col(n).desc() if d else F.col(n).asc() for n, _, d in coarse]
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ahead = F.coalesce(F.sum("_n").over(part.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, *names, ahead.alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order))
    return (work.join(sizes, [*keys, *names])
            .withColumn(rank, (F.col("_ahead") + inside).cast("bigint"))
            .drop("_ahead", *names))


def group_median(df: DataFrame, keys: Sequence[str], value: str, name: str, bin_width: float) -> DataFrame:
    """Exact median per key, for keys of any size.

    Equal values are counted together first. A histogram of `bin_width` finds the
    one or two bins that hold the middle ranks, and only those bins are ordered.
    """
    counted = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
               .withColumn("_bin", F.floor(F.col(value) / bin_width)))
    bins = counted.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_b"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    bins = bins.withColumns({
        "_total": F.sum("_b").over(part),
        "_before": F.coalesce(F.sum("_b").over(part.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    low = F.floor((F.col("_total") - 1) / 2)
    high = F.floor(F.col("_total") / 2)
    # Zero-based middle ranks; a bin is kept when it covers either.
    covers = ((F.col("_before") <= low) & (low < F.col("_before") + F.col("_b"))) | (
        (F.col("_before") <= high) & (high < F.col("_before") + F.col("_b")))
    middle = bins.filter(covers).select(*keys, "_bin", "_total", "_before")
    inside = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = (counted.join(middle, [*keys, "_bin"])
              .withColumn("_start", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0))))
    hit = lambda r: (F.col("_start") <= r) & (r < F.col("_start") + F.col("_c"))
    agg = placed.groupBy(*keys).agg(F.max(F.when(hit(low), F.col(value))).alias("_lo"),
                                    F.max(F.when(hit(high), F.col(value))).alias("_hi"),
                                    F.max("_total").alias(f"{name}_n"))
    return agg.withColumn(name, (F.col("_lo") + F.col("_hi")) / 2.0).drop("_lo", "_hi")


def shared_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names. Without one, a local session (as in tests) gets a temporary folder; on a cluster it is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's output or checkpoint, below the shared one."""
    return f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a table in a folder, in whatever store, was written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
