"""Embedding whitening: principal components by QDWH spectral divide and conquer, then a broadcast projection.

Entries become integers, x = floor(256 c), so that equal vectors are equal exactly. Statistics are over the distinct vectors (the fit
list): their number and sums are exact integers, their covariance is summed from centred vectors, task by task, and the tasks' matrices
are added in a tree of groups of FAN. Only matrices of the vectors' dimension reach the driver. There, the polar
factor of the covariance less a shift, by the QR form of the dynamically weighted Halley iteration (QDWH), is the matrix
sign function, and half of it plus the identity is the projector on all components above the shift. Its range and the complement are
invariant, so each is split again until it is a single component. The first components are broadcast and all rows projected.

Defined cases: rows whose vector is null, empty, or has a null or non-finite entry are dropped, and so are those of another length than the
most frequent one (the shorter of two equally frequent). Repeated rows and ids are rows of their own; ids may be null and of any type. Integers beyond
64 bits are held at its ends. With fewer dimensions than components asked for, there are fewer components. A component without
variance, as of a single vector, has a null whitened value; without any variance ``explained`` is null too. ``deviation`` is exact, and null
where it is no 64-bit number. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleevenotes.sources.work import shared_folder, written

SCALE = 256
COMPONENTS = 4
#: Matrices that one task adds at most, and that the driver adds at the end.
FAN = 64
#: Numbers that are worked on at once within a batch.
AT_ONCE = 1 << 20
LOW_BITS = 31
EPS = np.finfo(np.float64).eps


# -- spectral divide and conquer -------------------------------------------------------------------------------------


def polar_factor(a: np.ndarray, most: int = 24) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix: its matrix sign, unless it is singular."""
    m = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.eye(m)
    x, low, eye = a / norm, EPS, np.eye(m)
    for _ in range(most):
        s = low * low
        d = np.cbrt(4 * (1 - s) / (s * s)) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - s) / (s * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.concatenate([np.sqrt(wc) * x, eye]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:m] @ q[m:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * s) / (1 + wc * s))
        change = np.linalg.norm(new - x)
        x = new
        if change <= np.cbrt(EPS) and 1 - low <= 10 * EPS:  # the iteration is cubic
            break
    return x


def shifts(a: np.ndarray) -> Iterator[float]:
    """Numbers within the spectrum: the middle of the diagonal, its mean, and points around the mean."""
    diagonal = np.diag(a)
    mean = float(diagonal.mean())
    spread = float(np.linalg.norm(a - mean * np.eye(len(a)))) / np.sqrt(len(a))
    yield float(np.median(diagonal))
    yield mean
    for k in range(1, 20):
        yield mean + spread * k / 20
        yield mean - spread * k / 20


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces, the one of the larger eigenvalues first; none if there is no split."""
    m, norm = len(a), np.linalg.norm(a)
    random = np.random.default_rng(m)
    for shift in shifts(a):
        projector = (polar_factor(a - shift * np.eye(m)) + np.eye(m)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < m or np.linalg.norm(projector @ projector - projector) > 1e-8 * np.sqrt(m):
            continue  # all on one side, or an eigenvalue at the shift
        basis, _ = np.linalg.qr(projector @ random.standard_normal((m, rank)))
        basis, _ = np.linalg.qr(projector @ basis, mode="complete")
        upper, lower = basis[:, :rank], basis[:, rank:]
        if np.linalg.norm(lower.T @ a @ upper) <= 1e-11 * norm:
            return upper, lower
    return None


def spectral_components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    v = (v + v.T) / 2
    least = len(v) * EPS * np.linalg.norm(v)
    todo, vectors = [(v, np.eye(len(v)))], []
    while todo:
        a, basis = todo.pop()
        halves = None
        if len(a) > 1 and np.linalg.norm(a - np.diag(np.diag(a))) > least:
            halves = split(a)
        if halves is None:  # one component, or several that are the same to double precision
            vectors.append(basis)
            continue
        for part in halves:
            b = part.T @ a @ part
            todo.append(((b + b.T) / 2, basis @ part))
    u = np.concatenate(vectors, axis=1) if vectors else np.zeros((0, 0))
    u = u / np.linalg.norm(u, axis=0) if len(u) else u
    values = np.einsum("ij,ik,kj->j", u, v, u)
    order = np.argsort(-values, kind="stable")
    return values[order], u[:, order]


# -- vectors ---------------------------------------------------------------------------------------------------------


def complete(vector: Column) -> Column:
    """Not null, not empty, all entries finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def remaining(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows that take part, and the length of their vectors (0 if there are none)."""
    whole = rows.filter(complete(F.col(vector)))
    lengths = whole.groupBy(F.size(vector).alias("d")).count()
    most = lengths.orderBy(F.desc("count"), "d").first()
    d = most.d if most else 0
    return whole.filter(F.size(vector) == d), d


def integers(vectors: pa.Array, d: int) -> np.ndarray:
    """floor(SCALE c) of lists of d numbers, as rows."""
    c = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(SCALE * c)
    ends = np.iinfo(np.int64)
    safe = np.where(np.abs(x) < 2.0**63, x, 0.0).astype(np.int64)
    return np.where(x >= 2.0**63, ends.max, np.where(x < -(2.0**63), ends.min, safe)).reshape(-1, d)


def slices(batch: pa.RecordBatch, d: int) -> Iterator[pa.RecordBatch]:
    step = max(1, AT_ONCE // d)
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def fit_list(rows: DataFrame, vector: str, d: int, folder: str) -> DataFrame:
    """Each distinct integer vector once, as the bytes of its 64-bit numbers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, d):
                x = integers(part.column(0), d)
                yield pa.RecordBatch.from_pydict({"x": pa.array([r.tobytes() for r in x], pa.binary())})

    return written(rows.select(vector).mapInArrow(encode, "x binary").distinct(), folder)


def summed(fit: DataFrame, d: int, folder: str, measure: object, kind: np.dtype) -> np.ndarray:
    """The sum of ``measure`` (integer rows to an array) over the fit list. No task adds more than FAN arrays."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in slices(batch, d):
                own = measure(np.frombuffer(b"".join(part.column(0).to_pylist()), np.int64).reshape(-1, d))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict(
                {"task": pa.array([TaskContext.get().partitionId()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())}
            )

    def add(arrays: list[bytes]) -> np.ndarray:
        return np.sum([np.frombuffer(s, kind) for s in arrays], axis=0, dtype=kind)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        in_order = table.sort_by("task").column("sums").to_pylist()
        return pa.table({"task": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([add(in_order).tobytes()], pa.binary())})

    sums = written(fit.mapInArrow(partial, "task long, sums binary"), folder)
    while sums.count() > FAN:
        sums = written(sums.groupBy(F.floor(F.col("task") / FAN).alias("group")).applyInArrow(merge, "task long, sums binary"), folder)
    return add([r.sums for r in sums.orderBy("task").collect()])


# -- fitting and applying --------------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """Of vectors of length d: number and sums of the fit list, first components (columns), their eigenvalues, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def varied(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > len(self.sums) * EPS * max(self.trace, 0.0)

    @property
    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.values]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of integer rows; NaN for components without variance."""
        mean = np.array([s / self.n for s in self.sums])
        scale = np.where(self.varied, np.sqrt(np.where(self.varied, self.values, 1.0)), np.nan)
        return (x - mean) @ self.components / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n x - S)^2) of integer rows, exactly; None beyond 64 bits."""
        reach = max((max(abs(self.n * int(v) - s) for v in ends) for s, ends in zip(self.sums, np.stack([x.min(0), x.max(0)]).T)), default=0)
        if self.n * int(np.abs(x).max(initial=0)) < 1 << 62 and len(self.sums) * reach * reach < 1 << 63:
            return ((self.n * x - np.array(self.sums)) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the rows' vectors; none if no row takes part."""
    rows, d = remaining(rows, vector)
    if not d:
        return None
    folder = shared_folder(rows.sparkSession)
    listed = fit_list(rows, vector, d, folder)
    n = listed.count()

    def number_sums(x: np.ndarray) -> np.ndarray:
        return np.stack([(x >> LOW_BITS).sum(0), (x & ((1 << LOW_BITS) - 1)).sum(0)])

    high, low = summed(listed, d, folder, number_sums, np.int64).reshape(2, d).tolist()
    sums = [(h << LOW_BITS) + s for h, s in zip(high, low, strict=True)]
    mean = np.array([s / n for s in sums])

    def products(x: np.ndarray) -> np.ndarray:
        return (centred := x - mean).T @ centred

    covariance = summed(listed, d, folder, products, np.float64).reshape(d, d) / n
    values, vectors = spectral_components(covariance)
    k = min(components, d)
    found = Whitening(n, sums, vectors[:, :k], values[:k], float(np.trace(covariance)), 0.0)
    varied = found.varied

    def whitened_products(x: np.ndarray) -> np.ndarray:
        z = found.project(x)[:, varied]
        return z.T @ z

    if varied.any():
        again = summed(listed, d, folder, whitened_products, np.float64).reshape(varied.sum(), -1) / n
        found.identity_error = float(np.abs(again - np.eye(len(again))).max())
    return found


COLUMNS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component: the key and COLUMNS."""
    spark, name = rows.sparkSession, f"`{key}`"
    keyed = rows.select(F.col(name).alias("_key"), F.col(f"`{vector}`").alias("_vector"))
    schema = f"{name} {keyed.schema['_key'].dataType.simpleString()}, {COLUMNS}"
    found = fit(keyed, "_vector", components)
    if found is None:
        return spark.createDataFrame([], schema)
    model, d, k = spark.sparkContext.broadcast(found), len(found.sums), len(found.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            for part in slices(batch, d):
                x = integers(part.column(1), d)
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, w.n, np.int64)),
                        pa.array(w.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(w.project(x).ravel(), from_pandas=True),
                        pa.array(w.explained * m, pa.float64()),
                        pa.array(np.full(m * k, w.identity_error)),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    whole = keyed.filter(complete(F.col("_vector")) & (F.size("_vector") == d))
    return whole.mapInArrow(project, schema)
