"""Whitening of embeddings by their leading principal components, found by a block Jacobi-Davidson method over distributed products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored

__all__ = ["Components", "components", "jacobi_davidson", "minres", "op11_whitening", "prepared", "whiten"]

#: Components wanted, and further directions that the first subspace has.
COMPONENTS, SPARE = 32, 8
#: Steps of the inner solver, each a pass over the data, and rounds of corrections at most.
INNER_STEPS, MAX_ROUNDS = 3, 200
#: Entries become integers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Partial matrices reach the driver in so many sums.
SUMS = 16
#: Entries of a block of rows that is turned into numbers at once.
BLOCK_ENTRIES = 1 << 20

Apply = Callable[[np.ndarray], np.ndarray]


def prepared(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors without null or non-finite entries as integers, written to the shared folder.

    Vectors shorter than the longest are filled up as if with zeros. Null and repeated ids stay rows of their own.
    """
    v = F.col(vector_column).cast("array<double>")
    fits = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    size = fits.agg(F.max(F.size("v"))).first()[0] or 0
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    return stored(fits.select("vec_id", F.concat(x, F.array_repeat(F.lit(SHIFT).cast("long"), size - F.size("v"))).alias("x")), "vectors")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integer matrix) of a batch's vectors."""
    column = batch.column("x")
    if not len(column):
        return
    size = len(column[0])
    step = max(1, BLOCK_ENTRIES // max(1, size))
    for start in range(0, len(column), step):
        part = column.slice(start, step)
        yield start, part.flatten().to_numpy().reshape(len(part), size)


def _summed(data: DataFrame, each: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: type) -> np.ndarray:
    """The sum of each(block of rows) over all rows: within tasks, then of the tasks' sums in a few, then of those. Always in the same order."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=kind)
        for batch in batches:
            for _, x in _blocks(batch):
                total += each(x)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((p, t) for b in batches for p, t in zip(b.column("part").to_pylist(), b.column("total").to_pylist(), strict=True))
        if found:
            total = np.zeros(shape, dtype=kind)
            for _, t in found:
                total += np.frombuffer(t, dtype=kind).reshape(shape)
            yield pa.RecordBatch.from_arrays([pa.array([found[0][0]], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    schema = "part long, total binary"
    rows = data.select("x").mapInArrow(part, schema).repartition(SUMS, F.col("part") % SUMS).mapInArrow(fold, schema).collect()
    return sum((np.frombuffer(r["total"], dtype=kind).reshape(shape) for r in sorted(rows)), np.zeros(shape, dtype=kind))


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x minus the mean, from exact integers, so that nothing is lost to the shift."""
    return (x * n - sums) / n


def _orthogonal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Unit columns that span what `new` adds to the columns of `against`; directions that add nothing go."""
    for _ in range(2):
        for q in against:
            new = new - q @ (q.T @ new)
        norms = np.linalg.norm(new, axis=0)
        new = new[:, norms > 0] / norms[norms > 0]
    if not new.shape[1]:
        return new
    u, s, _ = np.linalg.svd(new, full_matrices=False)
    room = max(0, new.shape[0] - sum(q.shape[1] for q in against))
    u = u[:, s > 1e-10 * s[0]][:, :room]
    for q in against:
        u = u - q @ (q.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def minres(apply: Apply, b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of apply(x) = b for a symmetric operator, each column for itself, with the least residual over `steps` Krylov directions."""
    tiny = np.finfo(float).tiny
    beta = np.linalg.norm(b, axis=0)
    v, v_before = b / np.maximum(beta, tiny), np.zeros_like(b)
    w, w_before, x = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    eta, off = beta.copy(), np.zeros_like(beta)
    c = c_before = np.ones_like(beta)
    s = s_before = np.zeros_like(beta)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - off * v_before
        ahead = np.linalg.norm(p, axis=0)
        bar = c * alpha - c_before * s * off
        rho = np.maximum(np.hypot(bar, ahead), tiny)
        w, w_before = (v - s_before * off * w_before - (s * alpha + c_before * c * off) * w) / rho, w
        c_before, s_before, c, s = c, s, bar / rho, ahead / rho
        x = x + np.where(eta == 0, 0.0, c * eta) * w
        eta = -s * eta
        v, v_before, off = np.where(ahead > 1e-14 * np.abs(beta), p / np.maximum(ahead, tiny), 0.0), v, ahead
    return np.where(np.isfinite(x), x, 0.0)


def jacobi_davidson(apply: Apply, size: int, wanted: int, seed: int = 11, inner: int = INNER_STEPS, spare: int = SPARE, rounds: int = MAX_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors by column) of the `wanted` largest eigenpairs of a symmetric operator known by its products with blocks.

    Each round finds the Ritz pairs of the subspace, locks the leading ones whose residuals are at double precision (a few
    units of rounding of the largest value) and enlarges the subspace by corrections: approximate solutions of
    (I - QQ')(A - value)(I - QQ') t = -residual for all pairs not locked at once, Q holding the locked and the wanted vectors, so that
    each inner step is one product with a block. A subspace that has grown large starts again from its best Ritz vectors.
    """
    wanted = min(wanted, size)
    locked, values = np.zeros((size, 0)), np.zeros(0)
    if not wanted:
        return values, locked
    largest = min(size, 3 * (wanted + spare))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, min(size, wanted + spare))))[0]
    image, scale = apply(basis), 0.0
    for _ in range(rounds):
        h = basis.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        basis, image = basis @ y, image @ y
        scale = max(scale, abs(float(theta[0])) if theta.size else 0.0)
        left = wanted - values.size
        away = image[:, :left] - basis[:, :left] * theta[:left]
        away -= locked @ (locked.T @ away)
        right = np.linalg.norm(away, axis=0) <= np.finfo(float).eps * max(64, size) * scale
        done = left if right.all() else int(right.argmin())
        locked, values = np.hstack([locked, basis[:, :done]]), np.concatenate([values, theta[:done]])
        if values.size == wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        basis, image, theta, away, left = basis[:, done:], image[:, done:], theta[done:], away[:, done:], left - done
        if basis.shape[1] + left > largest - values.size and basis.shape[1] > left + spare and largest < size:
            basis, image = basis[:, : left + spare], image[:, : left + spare]
        q, shift = np.hstack([locked, basis[:, :left]]), theta[:left]

        def shifted(t: np.ndarray, q: np.ndarray = q, shift: np.ndarray = shift) -> np.ndarray:
            t = t - q @ (q.T @ t)
            t = apply(t) - t * shift
            return t - q @ (q.T @ t)

        new = _orthogonal(minres(shifted, -(away - q @ (q.T @ away)), inner), locked, basis)
        if not new.shape[1]:  # corrections too small to tell from rounding: other directions
            new = _orthogonal(np.random.default_rng(seed + 1 + values.size).standard_normal((size, left)), locked, basis)
        if new.shape[1]:
            basis, image = np.hstack([basis, new]), np.hstack([image, apply(new)])
            image -= locked @ (locked.T @ image)
        else:
            image = apply(basis)  # nothing is left outside: rounding in the images is all that residuals hold
    raise ArithmeticError(f"{values.size} of {wanted} eigenpairs after {rounds} rounds")


@dataclass
class Components:
    """n rows and their sums, eigenvalues (falling), unit eigenvectors by column, the trace of the covariance, and how far the whitened rows' covariance is from the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def components(data: DataFrame, wanted: int = COMPONENTS) -> Components:
    """The leading components of prepared() rows. The covariance is never formed: passes over the rows give its products with blocks of vectors.

    Directions without variance (a value below 1e-12 of the largest) are no components. Only matrices of the dimensions by
    the block's width reach the driver, whatever the number of rows.
    """
    first = data.select("x").first()
    size = len(first[0]) if first else 0
    counted = _summed(data, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), (size + 1,), np.int64)
    n, sums = int(counted[0]), counted[1:]
    if not n or not size:
        return Components(n, sums, np.zeros(0), np.zeros((size, 0)), 0.0, 0.0)
    if n * max(SHIFT, int(np.abs(sums).max()) // n + 1) >= 1 << 62:
        raise OverflowError("n times an entry must fit 63 bits")

    def apply(block: np.ndarray) -> np.ndarray:
        def each(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ block)

        return _summed(data, each, block.shape, np.float64) / n

    values, vectors = jacobi_davidson(apply, size, wanted)
    some = values > 1e-12 * max(float(values[0]), 0.0)
    values, vectors = values[some], vectors[:, some]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)
    project, k = vectors / np.sqrt(values), values.size

    def moments(x: np.ndarray) -> np.ndarray:
        c = _centred(x, n, sums)
        w = c @ project
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0), [float((c * c).sum())]])

    got = _summed(data, moments, (k * k + k + 1,), np.float64) / n
    covariance = got[: k * k].reshape(k, k) - np.outer(got[k * k : -1], got[k * k : -1])
    return Components(n, sums, values, vectors, float(got[-1]), float(np.abs(covariance - np.eye(k)).max()) if k else 0.0)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int] | np.ndarray:
    """Exact sums over dimensions of (n * x - sums) squared."""
    off = x * n - sums
    most = int(np.abs(off).max(initial=0))
    if most * most * max(1, x.shape[1]) < 1 << 63:
        return (off * off).sum(axis=1)
    return [sum(v * v for v in row) for row in off.tolist()]


def whiten(data: DataFrame, found: Components) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue) for each row of prepared() and each component.

    A deviation beyond 63 bits raises an error. Without rows, or where no direction varies, there are no rows.
    """
    shared = data.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Components = shared.value
        k = f.values.size
        project = f.vectors / np.sqrt(f.values)
        for batch in batches:
            ids = batch.column("vec_id")
            for start, x in _blocks(batch) if k else ():
                m = len(x)
                rows = pa.array(np.repeat(np.arange(start, start + m), k))
                deviation = pa.array(_deviations(x, f.n, f.sums), pa.int64())
                columns = [
                    ids.take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n)), deviation.take(pa.array(np.repeat(np.arange(m), k))), pa.array((_centred(x, f.n, f.sums) @ project).ravel()),
                    pa.array(np.tile(f.values / f.trace, m)), pa.array(np.full(m * k, f.identity_error)), pa.array(np.tile(f.values, m)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"])

    return data.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened by the components of all."""
    data = prepared(read_table(spark, sf_dir, "embeddings"))
    return whiten(data, components(data))
