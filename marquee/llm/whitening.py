"""Whitening of embeddings by an incremental eigendecomposition.

Each component c becomes the integer x = floor(64 c) + 1000000. The fit runs over all vectors:

1. A task holds the spectrum (count, mean, eigenvalues, eigenvectors) of the scatter it has seen. A
   block of rows is centred on its own mean and reduced by QR to at most one row per dimension
   with the same scatter; each of these rows is a rank-one update, and so is the shift between the
   block's mean and the running one. An update solves the secular equation for the new
   eigenvalues, after deflation, and takes eigenvectors from the Loewner formula, which keeps
   them orthogonal whatever the eigenvalues' last digits.
2. Spectra of tasks meet in a tree of groups of FAN_IN; each eigenpair of one is a rank-one update
   of the other, and the shift of means one more.
3. Rayleigh-Ritz: all rows, centred on the exact mean, are projected on the basis found, their
   scatter there is summed by the same tree, and its small eigenproblem gives the components.
4. A last pass measures the covariance of the whitened vectors.

What reaches the driver is one spectrum: width squared numbers. Sums are sums of integers and
exact; the offset of a million cancels before anything is multiplied.

Vectors that are null or hold a null or non-finite entry, or one of 2**LARGEST or more, whose x
would not have exact sums, are dropped. Vectors shorter than the longest one count as ending in
zeros. Zero, equal and repeated vectors, and null or repeated ids, are rows like others. Components
number at most the width. A direction in which all vectors agree (variance zero to double
precision, as with a single vector) whitens to 0 and stays out of the identity error, and if there
is no variance at all, `explained` is 0. `deviation` is null where it exceeds a long. An empty table
gives an empty result. Only the two named columns are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.plans.lineage import materialize

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
LARGEST = 30
# Rows that one QR reduces, at least, and at most this many times the width.
BLOCK_ROWS = 4_096
# Spectra or sums that one task of the tree combines.
FAN_IN = 16
# Rows whose whitened components leave a task at a time.
OUT_ROWS = 2_048

OUTPUT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double,"
    " identity_error double"
)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector of double) of the rows that take part."""
    vector = F.transform("embedding", lambda c: c.cast("double"))
    broken = F.exists(
        vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(2.0**LARGEST))
    )
    return embeddings.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("vector")
    ).where(F.col("vector").isNotNull() & ~F.coalesce(broken, F.lit(True)))


def lattice(column: pa.Array, width: int) -> np.ndarray:
    """floor(64 c) of every entry, without the offset; short vectors end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    places = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, places] = np.floor(SCALE * flat).astype(np.int64)
    return out


def _secular(poles: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (poles - x)) for ascending poles, one right of each.

    A root is given as (pole it is measured from, distance), so that differences to poles keep
    their digits. Bisection on the distance, for all roots at once.
    """
    k = len(poles)
    upper = np.append(poles[1:], poles[-1] + z2.sum())
    middle = (poles + upper) / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        value = 1 + (z2 / (poles - middle[:, None])).sum(axis=1)
        # right of the middle where the function is still negative there
        right = (value < 0) & (np.arange(k) < k - 1)
        origin = np.where(right, np.arange(k) + 1, np.arange(k)).clip(max=k - 1)
        gaps = poles - poles[origin][:, None]
        low = np.where(right, (poles - upper) / 2, 0.0)
        high = np.where(right, 0.0, (upper - poles) / np.where(np.arange(k) < k - 1, 2, 1))
        terms = np.empty_like(gaps)
        for _ in range(52):
            at = (low + high) / 2
            np.subtract(gaps, at[:, None], out=terms)
            np.divide(z2, terms, out=terms)
            below = terms.sum(axis=1) < -1
            np.copyto(low, at, where=below)
            np.copyto(high, at, where=~below)
    return origin, (low + high) / 2


def rank_one(
    values: np.ndarray, vectors: np.ndarray, row: np.ndarray, weight: float = 1.0
) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors (columns) of a matrix plus weight * row row^T."""
    length = float(np.sqrt(row @ row))
    if weight <= 0 or length == 0:
        return values, vectors
    z = vectors.T @ (row / length)
    rho = weight * length * length
    order = np.argsort(values, kind="stable")
    values, vectors, z = values[order].copy(), vectors[:, order].copy(), z[order]
    tolerance = 8 * np.finfo(float).eps * max(abs(values[-1]), abs(values[0]), rho)
    # deflation: a direction that the row doesn't touch keeps its pair, and of two nearly equal
    # eigenvalues a rotation takes the row out of one
    live: list[int] = []
    for j in range(len(z)):
        if rho * abs(z[j]) <= tolerance:
            z[j] = 0.0
            continue
        if live:
            i = live[-1]
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            if abs((values[j] - values[i]) * c * s) <= tolerance:
                a, b = vectors[:, i].copy(), vectors[:, j].copy()
                vectors[:, i], vectors[:, j] = c * a - s * b, s * a + c * b
                low, high = values[i], values[j]
                values[i] = low * c * c + high * s * s
                values[j] = low * s * s + high * c * c
                z[i], z[j] = 0.0, r
                live.pop()
        live.append(j)
    if live:
        at = np.array(live)
        poles, part = values[at], z[at]
        if len(at) == 1:
            values[at] = poles + rho * part * part
        else:
            keep = np.argsort(poles, kind="stable")
            at, poles, part = at[keep], poles[keep], part[keep]
            origin, distance = _secular(poles, rho * part * part)
            # root i minus pole j, from the pole that root i is measured from
            apart = (poles[origin][:, None] - poles) + distance[:, None]
            between = poles[:, None] - poles
            np.fill_diagonal(between, 1.0)
            # the row for which these roots are exact, by the Loewner formula
            ratios = apart / between.T
            exact = np.sqrt(np.abs(np.prod(ratios, axis=0))) * np.sign(part)
            with np.errstate(divide="ignore", invalid="ignore"):
                turned = exact / -apart
            turned[~np.isfinite(turned)] = 0.0
            turned /= np.sqrt((turned * turned).sum(axis=1, keepdims=True))
            vectors[:, at] = vectors[:, at] @ turned.T
            values[at] = poles[origin] + distance
    order = np.argsort(values, kind="stable")
    return np.maximum(values[order], 0.0), vectors[:, order]


class Spectrum:
    """Count, mean, and eigenpairs of the centred scatter of the rows seen so far."""

    def __init__(self, width: int):
        self.n = 0
        self.mean = np.zeros(width)
        self.values = np.zeros(width)
        self.vectors = np.eye(width)

    def _shift(self, n: int, mean: np.ndarray) -> None:
        """Join rows of another mean, whose scatter is in already."""
        total = self.n + n
        apart = mean - self.mean
        self.values, self.vectors = rank_one(
            self.values, self.vectors, apart, self.n * n / total if self.n else 0.0
        )
        self.mean = self.mean + apart * (n / total)
        self.n = total

    def add(self, rows: np.ndarray) -> None:
        mean = rows.mean(axis=0)
        for row in np.linalg.qr(rows - mean, mode="r"):
            self.values, self.vectors = rank_one(self.values, self.vectors, row)
        self._shift(len(rows), mean)

    def join(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T):
            self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        self._shift(other.n, other.mean)


# One row of the tree: exact count and sums, and the numbers of a spectrum or of a sum.
PART = "part bigint, n bigint, sums array<bigint>, numbers array<double>"


def _part(part: int, n: int, sums: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "part": pa.array([part], pa.int64()),
            "n": pa.array([n], pa.int64()),
            "sums": pa.array([sums.tolist()], pa.list_(pa.int64())),
            "numbers": pa.array([numbers.ravel()], pa.list_(pa.float64())),
        }
    )


def _pack(spectrum: Spectrum) -> np.ndarray:
    return np.concatenate([spectrum.mean, spectrum.values, spectrum.vectors.ravel()])


def _unpack(n: int, numbers: np.ndarray, width: int) -> Spectrum:
    out = Spectrum(width)
    out.n, out.mean, out.values = n, numbers[:width].copy(), numbers[width : 2 * width].copy()
    out.vectors = numbers[2 * width :].reshape(width, width).copy()
    return out


def _fit(width: int) -> Callable:
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, sums = Spectrum(width), np.zeros(width, np.int64)
        size = max(BLOCK_ROWS, 4 * width)
        held: list[np.ndarray] = []

        def take(rows: np.ndarray) -> None:
            spectrum.add(rows.astype(np.float64))

        for batch in batches:
            rows = lattice(batch.column("vector"), width)
            sums += rows.sum(axis=0)
            held.append(rows)
            if sum(map(len, held)) >= size:
                take(np.concatenate(held))
                held = []
        if held and sum(map(len, held)):
            take(np.concatenate(held))
        if spectrum.n:
            yield _part(_task(), spectrum.n, sums, _pack(spectrum))

    return fit


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _joined(rows: pa.Table, width: int) -> np.ndarray:
    spectra = [
        _unpack(n, np.asarray(numbers.values), width)
        for n, numbers in zip(rows.column("n").to_pylist(), rows.column("numbers"))
    ]
    first = spectra[0]
    for other in spectra[1:]:
        first.join(other)
    return _pack(first)


def _summed(rows: pa.Table, width: int) -> np.ndarray:
    return np.sum([np.asarray(numbers.values) for numbers in rows.column("numbers")], axis=0)


def _tree(parts: DataFrame, width: int, combine: Callable) -> tuple[int, list[int], np.ndarray] | None:
    """Combine rows of PART, FAN_IN at a time, to one, which the driver reads."""

    def combined(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("part").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        sums = np.sum([s.as_py() for s in rows.column("sums")], axis=0, dtype=np.int64)
        n = int(np.sum(rows.column("n").to_numpy()))
        part = rows.column("part")[0].as_py() // FAN_IN
        return pa.Table.from_batches([_part(part, n, sums, combine(rows, width))])

    parts = materialize(parts, "parts")
    most = parts.agg(F.max("part")).first()[0]
    if most is None:
        return None
    while True:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(combined, PART)
        most //= FAN_IN
        if most == 0:
            break
    row = parts.first()
    return row["n"], list(row["sums"]), np.array(row["numbers"])


class Model:
    """What whitens a vector: exact count and sums, components, and their variances."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray):
        self.n, self.sums = n, sums
        self.mean = np.array([s / n for s in sums])
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
        # either sign will do; this one makes reruns agree
        largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
        vectors = vectors * np.where(largest < 0, -1.0, 1.0)
        trace = values.sum()
        top = min(COMPONENTS, len(values))
        self.values, self.vectors = values[:top], vectors[:, :top]
        self.explained = self.values / trace if trace > 0 else np.zeros(top)
        floor = len(values) * np.finfo(float).eps * (values[0] if len(values) else 0.0)
        self.varies = self.values > floor

    def whiten(self, rows: np.ndarray) -> np.ndarray:
        root = np.sqrt(np.where(self.varies, self.values, 1.0))
        return np.where(self.varies, ((rows - self.mean) @ self.vectors) / root, 0.0)

    def deviations(self, rows: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)^2, in integers."""
        if not len(rows) or not rows.shape[1]:
            return pa.array([0] * len(rows), pa.int64())
        most = self.n * int(np.abs(rows).max()) + max(map(abs, self.sums))
        if most * most * rows.shape[1] < 2**63:
            apart = self.n * rows - np.array(self.sums, np.int64)
            return pa.array((apart * apart).sum(axis=1), pa.int64())
        exact = [
            sum((self.n * x - s) ** 2 for x, s in zip(row, self.sums)) for row in rows.tolist()
        ]
        return pa.array([e if e < 2**63 else None for e in exact], pa.int64())


def _scatter(width: int, project: Callable[[np.ndarray], np.ndarray], size: int) -> Callable:
    """Sums, and sums of products, of projected rows."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            rows = project(lattice(batch.column("vector"), width).astype(np.float64))
            n += len(rows)
            total += rows.sum(axis=0)
            products += rows.T @ rows
        if n:
            yield _part(
                _task(), n, np.zeros(0, np.int64), np.concatenate([total, products.ravel()])
            )

    return scatter


def _covariance(vectors: DataFrame, width: int, project: Callable, size: int) -> np.ndarray:
    n, _, numbers = _tree(vectors.mapInArrow(_scatter(width, project, size), PART), width, _summed)
    mean = numbers[:size] / n
    return numbers[size:].reshape(size, size) / n - np.outer(mean, mean)


def fit(vectors: DataFrame, width: int) -> Model | None:
    """Components of all vectors, refined over all of them; None without vectors."""
    only = vectors.select("vector")
    found = _tree(only.mapInArrow(_fit(width), PART), width, _joined)
    if found is None:
        return None
    n, sums, numbers = found
    basis, _ = np.linalg.qr(_unpack(n, numbers, width).vectors)
    mean = np.array([s / n for s in sums])
    ritz = _covariance(only, width, lambda rows: (rows - mean) @ basis, width)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    return Model(n, sums, basis @ turn, np.maximum(values, 0.0))


def identity_error(vectors: DataFrame, width: int, model: Model) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity."""
    size = len(model.values)
    found = _covariance(vectors.select("vector"), width, model.whiten, size)
    wanted = np.diag(model.varies.astype(float))
    return float(np.abs(found - wanted).max()) if size else 0.0


def whiten(embeddings: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector."""
    vectors = usable(embeddings)
    width = vectors.agg(F.max(F.size("vector"))).first()[0]
    model = fit(vectors, width) if width else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUTPUT)
    error = identity_error(vectors, width, model)
    top = len(model.values)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                rows = lattice(batch.column("vector"), width)
                each = np.repeat(np.arange(len(rows)), top)
                yield pa.record_batch(
                    {
                        "vec_id": batch.column("vec_id").take(pa.array(each)),
                        "component": pa.array(
                            np.tile(np.arange(1, top + 1, dtype=np.int32), len(rows))
                        ),
                        "n": pa.array(np.full(len(each), model.n)),
                        "deviation": model.deviations(rows).take(pa.array(each)),
                        "whitened": pa.array(model.whiten(rows).ravel()),
                        "explained": pa.array(np.tile(model.explained, len(rows))),
                        "identity_error": pa.array(np.full(len(each), error)),
                    }
                )

    return vectors.mapInArrow(emit, OUTPUT)
