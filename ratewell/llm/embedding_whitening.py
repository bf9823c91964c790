"""Embedding whitening by an incremental eigendecomposition.

Each task keeps the spectrum of what it has seen, a mean, eigenvalues and eigenvectors, and takes every vector in by a
rank-one update, centred on the mean so far: the eigenvalues are the roots of a secular equation, after deflation of
those that the update leaves as they are. Two spectra are combined by successive rank-one updates too, one for each
eigenvector of the second and one for the distance of the means; a few at a time meet in a task. The basis that results
is refined by a Rayleigh-Ritz step over all vectors, which gives eigenvectors of the covariance to double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell.llm.common import gathered, settle

#: Fixed values of the grid on which vectors are compared: steps in a unit, and the shift.
STEPS, SHIFT = 64, 1_000_000
#: Entries that have a place on the grid.
MOST = 2.0**56
#: Roots of the secular equation are sought until they move no more, at most so many times.
ROUNDS = 80
#: Eigenvalues under this part of the largest count as zero: no component has them.
ZERO = 1e-12
_EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 = sum of z^2 / (x - d), d rising and apart and no z zero, each as (place of its nearest pole, distance from it).

    Root i lies between d[i] and d[i + 1], the last within the sum of z^2 above the last pole. Each is sought by a
    rational step through its two poles, and by halving where that leaves the bracket.
    """
    n, w = len(d), z * z
    upper = np.append(d[1:], d[-1] + w.sum() * (1 + 1e-9))
    gap = upper - d
    at = np.arange(n)
    # the sign in the middle tells the nearer pole
    middle = 1 + (w / (d[None, :] - (d + gap / 2)[:, None])).sum(1)
    near = np.where((middle < 0) & (at < n - 1), at + 1, at)
    offset = d[None, :] - d[near][:, None]
    low = np.where(near == at, 0.0, -gap / 2)
    high = np.where(near == at, np.where(middle < 0, gap, gap / 2), 0.0)
    x = (low + high) / 2
    left = at[None, :] <= at[:, None]
    for _ in range(ROUNDS):
        apart = offset - x[:, None]
        apart[apart == 0] = 1e-300
        term = w / apart
        slope = term / apart
        f = 1 + term.sum(1)
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        own = apart[at, at]
        other = np.where(at < n - 1, apart[at, np.minimum(at + 1, n - 1)], gap + own)
        whole, rising = slope.sum(1), (slope * left).sum(1)
        a = (own + other) * f - own * other * whole
        b = own * other * f
        c = f - own * rising - other * (whole - rising)
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        new = np.where(np.isfinite(new) & (new > low) & (new < high), new, (low + high) / 2)
        done = (np.abs(f) <= 64 * n * _EPS * (1 + np.abs(term).sum(1))) | (np.abs(new - x) <= 16 * _EPS * np.abs(x))
        x = np.where(done, x, new)
        if done.all():
            break
    return near, x


class Spectrum:
    """Vectors seen (n), their mean, and the eigenvalues, rising, and eigenvectors (columns) of their scatter."""

    def __init__(self, size: int) -> None:
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(size), np.zeros(size), np.eye(size)

    def _raise(self, v: np.ndarray) -> None:
        """The spectrum of the scatter plus v v'."""
        d, u = self.values, self.vectors
        z = u.T @ v
        norm = z @ z
        if norm == 0:
            return
        tiny = 8 * _EPS * max(d[-1], norm)
        # eigenvectors of values that are equal so far are turned until one of each group meets v
        new = np.append(True, np.diff(d) > tiny)
        if not new.all():
            starts = np.flatnonzero(new)
            for a, b in zip(starts, np.append(starts[1:], len(d)), strict=True):
                length = np.linalg.norm(z[a:b])
                if b - a > 1 and length:
                    turn = z[a:b].copy()
                    turn[-1] += np.copysign(length, turn[-1])
                    turn /= np.linalg.norm(turn)
                    u[:, a:b] -= 2 * np.outer(u[:, a:b] @ turn, turn)
                    last = -np.copysign(length, z[b - 1])
                    z[a:b] = 0
                    z[b - 1] = last
        # a value whose eigenvector hardly meets v stays
        moved = np.flatnonzero(np.abs(z) > 8 * _EPS * np.sqrt(norm))
        dm, zm = d[moved], z[moved]
        near, x = secular_roots(dm, zm)
        values = dm[near] + x
        # root j less pole i, and the z for which these roots are exact, so that the eigenvectors are orthogonal
        apart = (dm[near][:, None] - dm[None, :]) + x[:, None]
        poles = dm[:, None] - dm[None, :]
        np.fill_diagonal(poles, 1)
        ratio = apart / poles
        np.fill_diagonal(ratio, apart.diagonal())
        with np.errstate(divide="ignore", invalid="ignore"):
            turn = np.copysign(np.sqrt(np.abs(ratio.prod(0))), zm)[None, :] / apart
        turn = np.where(np.isfinite(turn), turn, 0)
        turn /= np.linalg.norm(turn, axis=1)[:, None]
        u[:, moved] = u[:, moved] @ turn.T
        d[moved] = values
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], u[:, order]

    def add(self, v: np.ndarray) -> None:
        """Takes one vector in."""
        away = v - self.mean
        self.n += 1
        self.mean = self.mean + away / self.n
        self._raise(away * np.sqrt((self.n - 1) / self.n))

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        away, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self._raise(vector * np.sqrt(value))
        self._raise(away * np.sqrt(self.n * other.n / n))
        self.mean, self.n = self.mean + away * (other.n / n), n

    def packed(self, part: int) -> pa.Table:
        raw = [np.ascontiguousarray(x).tobytes() for x in (self.mean, self.values, self.vectors)]
        return pa.table([[part], [self.n], *[[x] for x in raw]], schema=_SPECTRUM)


_SPECTRUM = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("mean", pa.binary()), ("eigenvalues", pa.binary()), ("vectors", pa.binary())])
_SPECTRUM_DDL = "part int, n long, mean binary, eigenvalues binary, vectors binary"


def _unpacked(n: int, mean: bytes, values: bytes, vectors: bytes) -> Spectrum:
    out = Spectrum(0)
    out.n, out.mean, out.values = n, np.frombuffer(mean), np.frombuffer(values).copy()
    out.vectors = np.frombuffer(vectors).reshape(len(out.mean), -1).copy()
    return out


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The grid vectors of a batch, a row each."""
    column = batch["x"]
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _updated(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Spectrum(size)
        for batch in batches:
            for row in _matrix(batch, size).astype(float):
                seen.add(row)
        yield from seen.packed(TaskContext.get().partitionId()).to_batches()

    return run


def _combined(table: pa.Table) -> pa.Table:
    rows = [_unpacked(*row) for row in zip(*(table[c].to_pylist() for c in _SPECTRUM.names[1:]), strict=True)]
    for other in rows[1:]:
        rows[0].merge(other)
    return rows[0].packed(table["part"][0].as_py())


_LOW = (1 << 28) - 1


def _summed(size: int):
    """Sums by place of the vectors' entries, as upper and lower parts, so that they are exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            x = _matrix(batch, size)
            n, high, low = n + len(x), high + (x >> 28).sum(0), low + (x & _LOW).sum(0)
        yield pa.RecordBatch.from_pydict({"place": np.arange(size, dtype=np.int32), "n": np.full(size, n, np.int64), "high": high, "low": low})

    return run


def _products(centre: np.ndarray, basis: np.ndarray):
    """Sums, over the task's vectors, of the centred vectors in the basis and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = basis.shape[1]
        total, pairs = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = (_matrix(batch, len(centre)) - centre) @ basis
            total, pairs = total + y.sum(0), pairs + y.T @ y
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "total": [total.tobytes()], "pairs": [pairs.tobytes()]})

    return run


_PRODUCTS_DDL = "part int, total binary, pairs binary"


def _added(table: pa.Table) -> pa.Table:
    sums = [sum(np.frombuffer(x) for x in table[c].to_pylist()).tobytes() for c in ("total", "pairs")]
    return pa.table({"part": table["part"].slice(0, 1), "total": [sums[0]], "pairs": [sums[1]]})


def _covariance(fit: DataFrame, n: int, centre: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The covariance of the fit vectors in a basis: divisor n, centred before multiplying."""
    sums = settle(fit.mapInArrow(_products(centre, basis), _PRODUCTS_DDL), "products")
    last = gathered(sums, _added, _PRODUCTS_DDL).first()
    mean = np.frombuffer(last["total"]) / n
    return np.frombuffer(last["pairs"]).reshape(basis.shape[1], -1) / n - np.outer(mean, mean)


def grid(vector: str = "embedding") -> Column:
    """A vector's entries as whole numbers; null for vectors that are null, empty, or hold what has no place on the grid."""
    entry = lambda c: F.floor(c.cast("double") * STEPS).cast("long")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * STEPS < MOST)
    return F.when((F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(fine(c), F.lit(False))), F.transform(vector, entry))


def _projected(size: int, n: int, sums: list[int], basis: np.ndarray):
    """For every vector its exact deviation and its components."""
    centre = np.array([s / n for s in sums])

    def deviations(x: np.ndarray) -> list[int | None]:
        whole = np.array(sums, object)
        far = max(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n, max(map(abs, sums), default=0)) * 2
        if far * far * size < 1 << 63:
            away = x * n - whole.astype(np.int64)
            return (away * away).sum(1).tolist()
        found = (((x.astype(object) * n - whole) ** 2).sum(1)).tolist()
        return [v if v < 1 << 63 else None for v in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = basis.shape[1]
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                x = _matrix(batch, size)
                y = (x - centre) @ basis
                rows = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch["vec_id"].take(pa.array(rows)), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                    "deviation": pa.array(deviations(x), pa.int64()).take(pa.array(rows)), "whitened": y.ravel(),
                })

    return run


_WHITE = "vec_id long, component int, deviation long, whitened double"


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained and identity_error.

    Entries become x = floor(64 c) + 1000000; a vector that is null or empty or holds null, NaN, infinite or entries
    beyond 2^50 is left out. Of vectors of several lengths those of the most frequent one count, the longer of two as frequent;
    the others are left out. The fit is over the different x vectors, once each; every row is whitened, repeated and null
    vec_ids as well. Components whose variance is zero within rounding are left out: there are none for a single
    different vector. deviation is exact, and null where it is beyond a long. An empty table gives no rows. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = settle(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), grid().alias("x")).where("x IS NOT NULL"), "grid")
    told = "n long, explained double, identity_error double"
    none = spark.createDataFrame([], f"{_WHITE}, {told}").select(*_names())
    # one row a length
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return none
    size = lengths["size"]
    rows = rows.where(F.size("x") == size)
    fit = settle(rows.select("x").distinct(), "fit")
    sums = fit.mapInArrow(_summed(size), "place int, n long, high long, low long").groupBy("place").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")])
    sums = sorted(sums.collect())  # a row a dimension
    n, total = int(sums[0]["n"]), [(int(r["high"]) << 28) + int(r["low"]) for r in sums]
    centre = np.array([s / n for s in total])

    spectra = settle(fit.mapInArrow(_updated(size), _SPECTRUM_DDL), "spectra")
    last = gathered(spectra, _combined, _SPECTRUM_DDL).first()
    found = _unpacked(last["n"], last["mean"], last["eigenvalues"], last["vectors"])
    basis, _ = np.linalg.qr(found.vectors[:, ::-1])
    ritz = _covariance(fit, n, centre, basis)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, basis = values[::-1], basis @ turn[:, ::-1]
    trace = float(values.sum())
    k = min(components, int((values > max(values[0], 0) * ZERO).sum())) if values[0] > 0 else 0
    if not k:
        return none
    white = basis[:, :k] / np.sqrt(values[:k])
    error = float(np.abs(_covariance(fit, n, centre, white) - np.eye(k)).max())
    share = F.element_at(F.array(*[F.lit(float(v / trace)) for v in values[:k]]), F.col("component"))
    out = rows.mapInArrow(_projected(size, n, total, white), _WHITE)
    return out.withColumns({"n": F.lit(n).cast("long"), "explained": share, "identity_error": F.lit(error)}).select(*_names())


def _names() -> list[str]:
    return ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
