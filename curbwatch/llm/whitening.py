"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation (operator 13)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Rows multiplied at once in a task.
ROWS = 4096
#: Entries are cut to this step and moved to stay positive.
GRID, SHIFT = 64, 1_000_000
#: A norm this small beside the largest ends a sweep; a residual this small counts as converged.
NOTHING, CONVERGED = 1e-12, 1e-15
#: Least steps of a sweep that looks for directions the sweeps before it missed.
SWEEP = 12


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums per dimension; components as columns, by falling eigenvalue; a component's share of the variance."""
    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part and n-fold rest of the mean, so that a centred entry rounds once."""
        whole = np.array([int(s) // self.n for s in self.sums], np.int64)
        return whole, np.array([int(s) - self.n * int(q) for s, q in zip(self.sums, whole)], np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls whose lists all have one length."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(df: DataFrame, vector: str) -> DataFrame:
    """`df` without rows whose vector is null, empty or holds null or non-finite entries, or whose length is not the commonest (ties: the longest)."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    df = df.filter(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))
    sizes = df.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return df.filter(F.size(v) == (sizes.d if sizes else 0))


def on_grid(vector: str):
    return F.transform(F.col(vector), lambda c: (F.floor(c.cast("double") * GRID) + SHIFT).cast("bigint"))


def sums_over(points: DataFrame, size: int, part: Callable[[np.ndarray], np.ndarray], centre: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Sum over all points of what `part` gives for blocks of centred rows; a task sends one row per entry, added up before the driver sees them."""
    whole, rest = centre

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            x = matrix(b.column(0))
            for at in range(0, len(x), ROWS):
                total += part((x[at:at + ROWS] - whole) - rest / n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "value"])

    rows = points.select("x").mapInArrow(run, "i long, value double").groupBy("i").agg(F.sum("value").alias("value")).collect()  # `size` rows
    out = np.zeros(size)
    for r in rows:
        out[r.i] = r.value
    return out


def bidiagonalise(points: DataFrame, dims: int, centre: tuple[np.ndarray, np.ndarray], n: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest singular values of the centred rows X, and their right vectors as columns.

    Every step makes one pass over the rows: with u = Xv less beta times the left
    vector before, tasks return the products of u with all left vectors, its square
    and X'u. A left vector is X p for a p of `dims` numbers, so left vectors are
    computed where they are used and never stored; taking their products out of u
    is a change of p. Where that cancels most of u the pass is made again. Right
    vectors are orthogonalised twice against all before. A norm that vanishes ends
    a sweep, as do converged triplets; the next starts from a random direction
    orthogonal to all right vectors, so that repeated singular values come with all
    their vectors. It ends when a sweep leaves the wanted values as they were or
    all dimensions are used. The bidiagonal matrix is at most dims x dims.
    """
    random = np.random.default_rng(seed)
    V, P, B = np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros((dims + 1, dims + 1))

    def fresh() -> np.ndarray:
        v = random.standard_normal(dims)
        for _ in range(3):
            v = v - V @ (V.T @ v)
            v /= np.linalg.norm(v)
        return v

    def step(p: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        held, k = P, P.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            u = x @ p
            return np.concatenate([(x @ held).T @ u, [u @ u], x.T @ u])

        got = sums_over(points, k + 1 + dims, part, centre, n)
        return got[:k], got[k], got[k + 1:]

    v, beta, largest, before, since, transposed = fresh(), 0.0, 0.0, None, 0, np.zeros((dims, 0))
    while True:
        k = V.shape[1]
        p = v.copy()
        if beta:
            p -= beta * P[:, -1]
        V = np.column_stack([V, v])
        for _ in range(3):
            along, square, back = step(p)
            p, back = p - P @ along, back - transposed @ along
            norm = np.sqrt(max(square - along @ along, 0.0))
            if along @ along <= 0.5 * square or square <= (NOTHING * largest) ** 2:
                break
        largest = max(largest, norm)
        alpha = norm if norm > NOTHING * largest and norm > 0 else 0.0
        P = np.column_stack([P, p / alpha if alpha else np.zeros(dims)])
        transposed = np.column_stack([transposed, back / alpha if alpha else np.zeros(dims)])
        B[k, k] = alpha
        since += 1
        v = transposed[:, -1]
        for _ in range(2):
            v = v - V @ (V.T @ v)
        beta = float(np.linalg.norm(v))
        largest = max(largest, beta)
        left, values, right = np.linalg.svd(B[:k + 1, :k + 1])
        top = values[:wanted]
        ended = beta <= NOTHING * largest
        if k + 1 == dims or (k + 1 >= wanted and (ended or (since >= SWEEP and np.all(beta * np.abs(left[-1, :wanted]) <= CONVERGED * max(values[0], 1e-300))))):
            if k + 1 == dims or (before is not None and np.allclose(before, top, rtol=1e-12, atol=0)):
                return top, V @ right.T[:, :wanted]
            before, ended = top, True
        if ended:
            v, beta, since = fresh(), 0.0, 0
        else:
            v /= beta
            B[k, k + 1] = beta


def fit(df: DataFrame, vector: str = "embedding", components: int = 16) -> tuple[Whitening, DataFrame] | None:
    """The whitening of the distinct grid vectors of `df`, and its usable rows with them as column `_x`; None without usable rows.

    Components whose eigenvalue is zero to rounding are left out, so there are
    fewer than `components` where the vectors span fewer dimensions.
    """
    rows = usable(df, vector).withColumn("_x", on_grid(vector))
    points = stage(rows.select(F.col("_x").alias("x")).distinct(), "grid-points")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            x = matrix(b.column(0))
            n, total = n + len(x), x.sum(axis=0) if total is None else total + x.sum(axis=0)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.concatenate([[n], total]))], ["i", "value"])

    sums = {r.i: int(r.value) for r in points.mapInArrow(add, "i long, value long").groupBy("i").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    if not sums:
        return None
    n, sums = sums.pop(-1), np.array([sums[i] for i in range(len(sums))], object)
    dims, empty = len(sums), np.zeros((0, 0))
    bare = Whitening(n, sums, empty, np.zeros(0), np.zeros(0), 0.0)
    trace = float(sums_over(points, 1, lambda x: np.array([np.sum(x * x)]), bare.centre, n)[0]) / n
    if trace == 0:
        return Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), np.zeros(0), 0.0), rows
    singular, right = bidiagonalise(points, dims, bare.centre, n, min(components, dims))
    there = singular > 1e-9 * singular[0]
    singular, right = singular[there], right[:, there]
    values, m = singular ** 2 / n, len(singular)
    scaled = right / np.sqrt(values)
    square = sums_over(points, m + m * m, lambda x: np.concatenate([(w := x @ scaled).sum(axis=0), (w.T @ w).ravel()]), bare.centre, n) / n
    error = np.abs(square[m:].reshape(m, m) - np.outer(square[:m], square[:m]) - np.eye(m)).max()
    return Whitening(n, sums, right, values, values / trace, float(error)), rows


def whiten(df: DataFrame, vector: str = "embedding", carry: tuple[str, ...] = ("vec_id",), components: int = 16) -> DataFrame:
    """A row per usable row of `df` and component: the carried columns, component (from 1), n, deviation, whitened, explained and identity_error.

    Entries become floor(64 c) + 1,000,000. The model is fitted on the distinct
    vectors; every usable row gets its coordinates, equal vectors the same ones.
    deviation is exact as a decimal of 38 digits. Rows whose vector is null, empty,
    holds null or non-finite entries or is of an uncommon length are left out;
    a null vec_id stays. Without two different vectors there is no component and
    so no row.
    """
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.select(*carry).schema)}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    found = fit(df, vector, components)
    if found is None or not len(found[0].values):
        return df.sparkSession.createDataFrame([], out)
    model, rows = found
    whole, rest = model.centre
    scaled, m = model.components / np.sqrt(model.values), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                moved = matrix(part.column(len(carry))) - whole
                if float(np.abs(moved).max()) * model.n + model.n < 2.0 ** 31 / np.sqrt(len(whole)):
                    deviation = pa.array(((moved * model.n - rest) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:  # beyond 64 bits
                    deviation = pa.array([sum((int(c) * model.n - int(r)) ** 2 for c, r in zip(row, rest)) for row in moved], pa.decimal128(38, 0))
                white = (moved - rest / model.n) @ scaled
                each = pa.array(np.repeat(np.arange(part.num_rows), m))
                yield pa.RecordBatch.from_arrays(
                    [*(pc.take(part.column(i), each) for i in range(len(carry))), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), part.num_rows)),
                     pa.array(np.full(len(each), model.n)), pc.take(deviation, each), pa.array(white.ravel()), pa.array(np.tile(model.explained, part.num_rows)),
                     pa.array(np.full(len(each), model.identity_error))], [*carry, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(*carry, "_x").mapInArrow(run, out)
