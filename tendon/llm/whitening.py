"""Whitening of embeddings by shifted Cholesky QR.

Entries become whole numbers, so counts and sums are exact. The centred rows are A = Q R, found in passes over the
table: each pass takes the Gram matrix of the rows after triangular solves with the factors so far, its Cholesky factor
is the next one, and a shift on the first pass (and on later ones that need it) keeps the factorisation going for rows
of any condition. R is the product of the factors; its singular values and right vectors are those of A and give the
components. Only matrices of the width of a vector reach the driver; tasks hold one Arrow batch and one Gram matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Passes at most, and how far from the identity the last Gram matrix may be for another pass to be left out.
PASSES, ORTHONORMAL = 4, 1e-13
#: Components whose singular value is below this share of the largest one are rounding, not directions of the data.
RANK = 1e-10
#: An entry of which 64 times doesn't fit a double exactly counts as non-finite.
LARGEST = float(1 << 52)
BLOCK = 32
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Whitening:
    """The fit: n vectors, exact sums of ``floor(64 c)`` by dimension, unit components as columns, their eigenvalues and shares."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _whole(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the vectors that remain, their lengths, and their entries as ``floor(64 c)``, one after the other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        values = np.floor(values * SCALE)
        bad = ~(np.abs(values) < LARGEST)
    ends = np.cumsum(lengths)
    spoilt = np.concatenate([[0], np.cumsum(bad)])
    keep = column.is_valid().to_numpy(zero_copy_only=False) & (spoilt[ends] == spoilt[ends - lengths]) & (lengths > 0)
    if width is not None:
        keep &= lengths == width
    return np.flatnonzero(keep), lengths[keep], values[np.repeat(keep, lengths)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums by length of vector and dimension."""
    total: dict[int, list] = {}
    for batch in batches:
        _, lengths, values = _whole(batch.column(0))
        for width in np.unique(lengths).tolist():
            x = values[np.repeat(lengths == width, lengths)].reshape(-1, width)
            small = np.abs(x).max() * len(x) < LARGEST
            s = [int(v) for v in x.sum(axis=0)] if small else [sum(int(v) for v in c) for c in x.T]
            n, old = total.get(width, (0, [0] * width))
            total[width] = (n + len(x), [a + b for a, b in zip(old, s)])
    for width, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))],
            ["width", "dim", "n", "s"],
        )


def _solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangular matrix, by substitution from the first column on."""
    out = np.array(rows, order="F")
    for lo in range(0, out.shape[1], BLOCK):
        hi = min(lo + BLOCK, out.shape[1])
        if lo:
            out[:, lo:hi] -= out[:, :lo] @ upper[:lo, lo:hi]
        for j in range(lo, hi):
            if j > lo:
                out[:, j] -= out[:, lo:j] @ upper[lo:j, j]
            out[:, j] /= upper[j, j]
    return out


def _grams(width: int, of: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``(i, row)`` of the Gram matrix of ``of(entries)`` over the vectors of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = None
        for batch in batches:
            _, _, values = _whole(batch.column(0), width)
            if len(values):
                y = of(values.reshape(-1, width))
                gram = y.T @ y if gram is None else gram + y.T @ y
        if gram is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(gram)), pa.int32()), pa.array(list(gram), pa.list_(pa.float64()))], ["i", "row"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the rows with the same number, one by one."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column("i").to_pylist(), batch.column("row")):
            v = np.asarray(row.values, dtype=np.float64)
            total[i] = total[i] + v if i in total else v
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "row"])


def _gram(vectors: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The whole Gram matrix: a row per dimension and task is shuffled by dimension, then added; the driver gets one row per dimension."""
    shape = "i int, row array<double>"
    rows = vectors.mapInArrow(_grams(width, of), shape).repartition("i").mapInArrow(_added, shape).collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])


def _factor(gram: np.ndarray, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor; with a shift of the size of rounding where asked, and a larger one where it takes that."""
    width = len(gram)
    shift = 11.0 * width * (width + 1) * EPS * float(np.linalg.norm(gram, 2))
    tries = ([] if shifted else [0.0]) + [shift * 100.0**k for k in range(8)]
    for s in tries:
        try:
            factor = np.linalg.cholesky(gram + s * np.eye(width)).T
        except np.linalg.LinAlgError:
            continue
        if (np.diag(factor) > 0).all():
            return factor
    raise np.linalg.LinAlgError("no shift makes the Gram matrix positive")


def _vectors(table: DataFrame, vector: str) -> DataFrame:
    return table.select(F.col(f"`{vector}`").cast("array<double>").alias("vector"))


def fitted(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Components of ``x = floor(64 c) + 1000000`` over all vectors that hold finite numbers alone.

    The fit list has the vectors of the commonest length (of several, the longest); others can't be projected and are
    left out, as are empty ones. Directions in which the vectors don't vary are no components. Equal rows count one by
    one. None if there is no vector.
    """
    vectors = _vectors(table, vector)
    sums = vectors.mapInArrow(_sums, "width int, dim int, n long, s decimal(38,0)").groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = sums.where("dim = 0").orderBy(F.col("n").desc(), F.col("width").desc()).first()
    if best is None:
        return None
    width, n = best["width"], best["n"]
    # one row per dimension
    s = [int(r["s"]) for r in sorted(sums.where(F.col("width") == width).collect(), key=lambda r: r["dim"])]
    centre = np.array([v / n for v in s])
    factors: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        y = x - centre
        for r in factors:
            y = _solved(y, r)
        return y

    for k in range(PASSES):
        gram = _gram(vectors, width, orthogonal)
        if not gram.any():
            return Whitening(n, tuple(s), np.zeros((width, 0)), np.zeros(0), np.zeros(0))
        if k and np.abs(gram - np.eye(width)).max() <= ORTHONORMAL * width:
            break
        factors = [*factors, _factor(gram, shifted=k == 0)]
    whole = factors[0]
    for r in factors[1:]:
        whole = r @ whole
    _, sigma, axes = np.linalg.svd(whole)
    some = sigma > sigma[0] * RANK
    axes, shares = axes[some][:components], (sigma[some] ** 2 / (sigma**2).sum())[:components]
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return Whitening(n, tuple(s), axes.T, (sigma[some] ** 2 / n)[:components], shares)


def identity_error(table: DataFrame, fit: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity; 0 without components."""
    size = len(fit.variances)
    if not size:
        return 0.0
    centre, project = fit.centre, fit.components / np.sqrt(fit.variances)
    gram = _gram(_vectors(table, vector), len(fit.sums), lambda x: np.column_stack([np.ones(len(x)), (x - centre) @ project]))
    mean = gram[0, 1:] / fit.n
    return float(np.abs(gram[1:, 1:] / fit.n - np.outer(mean, mean) - np.eye(size)).max())


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sums over dimensions of ``(n x - S)^2``, exactly; None where a long can't hold it."""
    most = n * float(np.abs(x).max()) + max(map(abs, sums))
    if most * most * len(sums) < float(1 << 62):
        d = x.astype(np.int64) * n - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = (sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x)
    return [d if d < 1 << 63 else None for d in exact]


def whitened(table: DataFrame, fit: Whitening | None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained)`` for each vector of the fit's length and each component from 1 on.

    A vector that is null or holds null or non-finite entries has no rows; a null or repeated id is a row like any
    other. ``deviation`` is null where it doesn't fit a long. Without a fit or components the result is empty.
    """
    rows = table.select(F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.col(f"`{id_col}`").alias("id"))
    kind = dict(rows.dtypes)["id"]
    shape = f"id {kind}, component int, n long, deviation long, whitened double, explained double"
    if fit is None or not len(fit.variances):
        return rows.sparkSession.createDataFrame([], shape).withColumnRenamed("id", id_col)
    width, size, n, sums = len(fit.sums), len(fit.variances), fit.n, fit.sums
    centre, project, shares = fit.centre, fit.components / np.sqrt(fit.variances), fit.explained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _, values = _whole(batch.column("vector"), width)
            if not len(at):
                continue
            x = values.reshape(-1, width)
            places = np.repeat(np.arange(len(at)), size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(at[places])), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(at))), pa.array(np.full(len(places), n, np.int64)),
                    pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(places)), pa.array(((x - centre) @ project).ravel()), pa.array(np.tile(shares, len(at))),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained"],
            )

    return rows.mapInArrow(run, shape).withColumnRenamed("id", id_col)
