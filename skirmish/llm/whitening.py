"""Operator 12: whitening of embeddings by Chebyshev-filtered subspace iteration.

A vector's entries c become integers x = floor(64 c) + 1000000. The components are the leading unit eigenvectors of
x's covariance V (divisor n). V is never built: every step multiplies it with a block Q of ``components`` +
``guard`` columns by one distributed pass, the sum of Xᵀ(XQ)/n over the rows, X centred before multiplying. A pass
reads the written integer vectors in Arrow batches; each task adds up one matrix, Spark sums the tasks' matrices
cell by cell, and only the d x block sum (bounded by ``CELLS``) reaches the driver.

1. A few Lanczos steps from a seeded random vector bound the spectrum from both sides.
2. A polynomial in V of degree ``DEGREE`` (less if it would lift the top by a factor over e**``LIFT`` above the last wanted value), by the three-term Chebyshev recurrence, one pass a term, damps the
   interval below the block's last Ritz value and lifts what lies above it.
3. QR of the filtered block and Rayleigh-Ritz (one more pass) give Ritz pairs and their residuals. This ends when every wanted
   residual is at the rounding level of V (``TIGHT`` x the largest eigenvalue) or stops falling there; it raises an
   error if they are not below ``LOOSE`` after ``ROUNDS`` rounds. Guard columns start at random, so none of the wanted
   components can be missed but with probability zero. With a block of d columns the first Rayleigh-Ritz is exact.

Sums of x and of its squares are integers of any size, so S, n, deviation and the trace are exact. ``deviation`` is null
where it does not fit a long. The whitened rows' covariance is measured by another pass (``identity_error``).

Rows whose vector is null, empty, or holds null or non-finite entries or one beyond a long are dropped. Vectors of
another length than the most frequent one (ties: the longer) have no place in the space and are dropped too.
Components whose eigenvalue is below ``RANK`` of the trace carry no variance: they have no rows; a single vector or
equal vectors have none at all. Repeated rows count as often as they occur; a null vec_id stays; other columns
are ignored; an empty table gives no rows. Equal eigenvalues may come in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.sources.staging import cut

COMPONENTS = 32
GUARD = 16
DEGREE = 10
LANCZOS = 12
ROUNDS = 40
LIFT = 27.0
TIGHT = 1e-14
LOOSE = 1e-8
RANK = 1e-12
#: Numbers in a block that the driver holds.
CELLS = 1 << 25
LIMIT = 1 << 62
#: Bytes of a block of vectors before they are narrowed.
BLOCK_BYTES = 1 << 20
WIDTHS = (np.int8, np.int16, np.int32, np.int64)
FITS = np.array([(1 << 7) - 1, (1 << 15) - 1, (1 << 31) - 1])
BLOCKS = "size int, vectors int, width int, ids array<bigint>, x binary"


def _clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sound vectors as integers floor(64 c), in blocks of one length, each as the bytes of the narrowest integers that hold it.

    Every pass reads them again, so a block is one value that goes from the file to numpy as it is.
    """
    for batch in batches:
        vectors = batch.column("vector")
        flat = pc.list_flatten(vectors)
        owner = np.asarray(pc.list_parent_indices(vectors))
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = np.floor(64 * values)
            bad = ~(np.abs(scaled) < LIMIT)  # also not a number, which a null has become
        size = np.bincount(owner, minlength=len(batch)) if len(owner) else np.zeros(len(batch), int)
        good = (size > 0) & (np.bincount(owner, bad, minlength=len(batch)) == 0 if len(owner) else False)
        kept = scaled[good[owner]].astype(np.int64) if len(owner) else np.zeros(0, np.int64)
        size, ids = size[good], batch.column("vec_id").filter(pa.array(good))
        starts = np.cumsum(size) - size
        for d in np.unique(size).tolist():
            rows = np.flatnonzero(size == d)
            step = max(1, BLOCK_BYTES // (8 * d))
            blocks, names = [], []
            for low in range(0, len(rows), step):
                mine = rows[low : low + step]
                x = kept[(starts[mine][:, None] + np.arange(d)).ravel()]
                blocks.append(x.astype(WIDTHS[int(np.searchsorted(FITS, np.abs(x).max()))]))
                names.append(ids.take(pa.array(mine)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d] * len(blocks), pa.int32()), pa.array([len(n) for n in names], pa.int32()), pa.array([b.itemsize for b in blocks], pa.int32()),
                    pa.array(names, pa.list_(pa.int64())), pa.array([b.tobytes() for b in blocks], pa.binary()),
                ],
                ["size", "vectors", "width", "ids", "x"],
            )


def matrices(batch: pa.RecordBatch, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the batch, its vectors as integers)."""
    for i, (width, x) in enumerate(zip(batch.column("width").to_pylist(), batch.column("x"), strict=True)):
        yield i, np.frombuffer(x.as_buffer(), f"i{width}").reshape(-1, d).astype(np.int64)


def _sums(d: int):
    """Exact sums of entries and squares by dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, [0] * d, [0] * d
        for batch in batches:
            for _, x in matrices(batch, d):
                n += len(x)
                if int(np.abs(x).max()) ** 2 * len(x) >= LIMIT:
                    x = x.astype(object)
                one = [a + int(b) for a, b in zip(one, x.sum(axis=0), strict=True)]
                two = [a + int(b) for a, b in zip(two, (x * x).sum(axis=0), strict=True)]
        if n:
            text = [pa.array([str(v) for v in side], pa.string()) for side in (one, two)]
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), *text], ["dim", "n", "one", "two"])

    return run


@dataclass
class Space:
    """The fit list: its rows as integers and their exact moments."""

    rows: DataFrame
    d: int
    n: int
    sums: list[int]
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Decimal(s) / Decimal(self.n)) for s in self.sums])

    def times(self, q: np.ndarray) -> np.ndarray:
        """VQ by one pass."""
        mean = self.mean

        def part(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ q)

        return self.total(part, q.shape) / self.n

    def total(self, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all rows of a function of a block of rows, added up by task and then cell by cell."""
        d = self.d

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape)
            for batch in batches:
                for _, x in matrices(batch, d):
                    out += part(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], ["cell", "value"])

        cells = self.rows.select("width", "x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        out = np.zeros(int(np.prod(shape)))
        got = cells.toArrow()
        out[got.column("cell").to_numpy()] = got.column("value").to_numpy()
        return out.reshape(shape)


def space(table: DataFrame, block: int = COMPONENTS + GUARD) -> Space | None:
    """The sound vectors of ``table`` (vec_id, embedding) with their moments; None if there are none."""
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = cut(vectors.where("vector IS NOT NULL").mapInArrow(_clean, BLOCKS), "vectors")
    lengths = rows.groupBy("size").agg(F.sum("vectors").alias("count")).orderBy(F.desc("count"), F.desc("size")).head(1)
    if not lengths:
        return None
    d = int(lengths[0]["size"])
    if d * min(d, block) > CELLS:
        raise ValueError(f"vectors of {d} entries: a block has over {CELLS} numbers")
    rows = rows.where(F.col("size") == d).select("width", "ids", "x")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("one", "two")]
    told = rows.select("width", "x").mapInArrow(_sums(d), "dim int, n long, one string, two string").groupBy("dim").agg(F.sum("n").alias("n"), *wide).collect()
    told.sort(key=lambda r: r.dim)
    n, one, two = int(told[0].n), [int(r.one) for r in told], [int(r.two) for r in told]
    trace = sum(n * b - a * a for a, b in zip(one, two, strict=True))
    return Space(rows, d, n, one, float(Decimal(trace) / Decimal(n) / Decimal(n)))


def bounds(times: Callable[[np.ndarray], np.ndarray], d: int, steps: int, rnd: np.random.Generator) -> tuple[float, float]:
    """Lower and upper bound of the spectrum by Lanczos steps with full orthogonalisation."""
    q = rnd.standard_normal(d)
    basis, diag, side = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, d)):
        w = times(basis[-1][:, None])[:, 0]
        diag.append(float(basis[-1] @ w))
        for _ in range(2):
            for b in basis:
                w = w - (b @ w) * b
        side.append(float(np.linalg.norm(w)))
        if side[-1] <= 1e-12 * max(abs(x) for x in diag):
            break
        basis.append(w / side[-1])
    ritz = np.linalg.eigvalsh(np.diag(diag) + np.diag(side[: len(diag) - 1], 1) + np.diag(side[: len(diag) - 1], -1))
    return max(0.0, float(ritz[0]) - side[-1]), float(ritz[-1]) + side[-1]


def chebyshev(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of V on ``q``: small on low..high, one at ``top``."""
    half, middle = (high - low) / 2, (high + low) / 2
    scale = half / (top - middle)
    first = scale
    before, now = q, (times(q) - middle * q) * (scale / half)
    for _ in range(2, degree + 1):
        following = 1 / (2 / first - scale)
        after = (times(now) - middle * now) * (2 * following / half) - scale * following * before
        before, now, scale = now, after, following
    return now


def stable(degree: int, low: float, high: float, wanted: float, top: float) -> int:
    """The degree at which the top is not lifted so far above the last wanted value that rounding drowns the latter."""
    half, middle = (high - low) / 2, (high + low) / 2
    gain = np.arccosh(max((top - middle) / half, 1.0)) - np.arccosh(max((wanted - middle) / half, 1.0))
    return max(2, min(degree, int(LIFT / max(gain, 1e-9))))


@dataclass
class Fit:
    """Eigenvalues from the largest, unit eigenvectors as columns, their relative residuals, and the work done."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    rounds: int
    passes: int


def subspace(multiply: Callable[[np.ndarray], np.ndarray], d: int, components: int, guard: int, degree: int = DEGREE, seed: int = 1) -> Fit:
    """The ``components`` leading eigenpairs of the symmetric positive matrix that ``multiply`` applies."""
    rnd, passes = np.random.default_rng(seed), 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return multiply(q)

    block, want = min(d, components + guard), min(d, components)
    if want < 1 or (block == want < d):
        raise ValueError("components and guard must be at least 1: the last guard column bounds what is damped")
    q = np.linalg.qr(rnd.standard_normal((d, block)))[0]
    low = top = 0.0
    last = np.inf
    for done in range(ROUNDS + 1):
        image = times(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        residuals = np.linalg.norm(image - q * values, axis=0)[:want] / max(values[0], 1e-300)
        worst = float(residuals.max())
        if block == d or worst <= TIGHT or (worst <= 1e-12 and worst > 0.3 * last):
            break
        last = worst
        if not done:
            low, top = bounds(times, d, LANCZOS, rnd)
        high = float(values[-1])
        floor = low if low < 0.999 * high else 0.0
        if high <= RANK * values[0]:  # no variance beyond the block: VQ spans all of it
            q = np.linalg.qr(image)[0]
            continue
        top = max(top, float(values[0]))
        q = np.linalg.qr(chebyshev(times, q, stable(degree, floor, high, float(values[want - 1]), top), floor, high, top))[0]
    if worst > LOOSE:
        raise ArithmeticError(f"not certified after {done} rounds: residual {worst:.1e}")
    return Fit(values[:want], q[:, :want], residuals, done, passes)


def _rows(d: int, n: int, sums: list[int], mean: np.ndarray, project: np.ndarray, explained: np.ndarray, error: float):
    """A row for each vector and component."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = project.shape[1]
        own = np.array(sums, object)
        for batch in batches:
            for i, x in matrices(batch, d):
                m, ids = len(x), batch.column("ids")[i].values
                far = (n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in sums)) ** 2 * d
                if far < LIMIT:
                    deviation = pa.array((((n * x - own.astype(np.int64)) ** 2).sum(axis=1)))
                else:
                    exact = ((n * x.astype(object) - own) ** 2).sum(axis=1)
                    deviation = pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)), deviation.take(pa.array(each)),
                        pa.array(((x - mean) @ project).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE) -> DataFrame:
    """One row for each sound vector and component; the query's columns."""
    fitted = space(table, components + guard)
    nothing = table.sparkSession.createDataFrame([], SCHEMA)
    if fitted is None or fitted.trace <= 0:
        return nothing
    fit = subspace(fitted.times, fitted.d, components, guard, degree)
    held = fit.values > RANK * fitted.trace
    mean, project = fitted.mean, fit.vectors[:, held] / np.sqrt(fit.values[held])
    k = project.shape[1]
    if not k:
        return nothing

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.column_stack([(x - mean) @ project, np.ones(len(x))])
        return w.T @ w

    both = fitted.total(moments, (k + 1, k + 1)) / fitted.n
    covariance = both[:k, :k] - np.outer(both[:k, k], both[:k, k])
    error = float(np.abs(covariance - np.eye(k)).max())
    made = _rows(fitted.d, fitted.n, fitted.sums, mean, project, fit.values[held] / fitted.trace, error)
    return fitted.rows.mapInArrow(made, SCHEMA)
