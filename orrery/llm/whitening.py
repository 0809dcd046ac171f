"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance is never formed. A pass over the centred rows Y gives Yᵀ(YQ) / n
for a block Q of a few more directions than components asked for: each task
multiplies its rows in Arrow batches and hands on one row for each direction, which
are summed by direction. The driver holds the block alone, dimensions x directions
numbers, orthonormalises it (QR) and rotates it to the block's Ritz vectors. All
components are done when each residual ||V q - e q|| is below ``TOLERANCE`` of the
largest eigenvalue; a component whose neighbour in the spectrum is near is then as
exact as doubles allow. Where the residuals fall too slowly, as they do for a flat
spectrum, the block is doubled with fresh directions, at most to all dimensions,
where one more pass is exact.

Rows are held as long values x = floor(64 c) + 1000000 and centred before they are
multiplied, exactly: n x - S is an integer, and only its quotient by n is rounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The contract's scale and shift of an entry.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this are held at it, so that x stays an exact double.
LARGEST = float(2**45)
COMPONENTS = 32
#: Directions beyond the components that the first block has.
SPARE = 8
#: Residual, as a share of the largest eigenvalue, at which a component is certified.
TOLERANCE = 1e-13
#: Passes that the residuals seen so far may still call for before the block is doubled.
PATIENCE = 4
#: Variance below this share of the largest counts as none.
NOTHING = 1e-12
SEED = 12


def integer_rows(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector has finite entries alone."""
    c = F.col("c")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    held = lambda v: F.greatest(F.least(v.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("c")).filter(c.isNotNull() & (F.size(c) > 0) & finite)
    return rows.select("vec_id", F.transform(c, lambda v: F.floor(held(v) * SCALE) + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch's vectors as rows of longs; all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1)


class Fit:
    """Number of rows n and exact sums S of the fit list, which fix the centring."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def shifted(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: as longs where these can't overflow, else as Python's integers."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most < 2**63:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.shifted(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        y = self.shifted(x)
        if y.dtype == object or float(np.abs(y).max(initial=0)) ** 2 * x.shape[1] >= 2**62:
            y = y.astype(object)
        return [min(int(v), 2**63 - 1) for v in (y * y).sum(1)]


def fitted(x: DataFrame) -> Fit:
    """One pass of exact sums: a task's longs are added in halves that can't overflow."""

    def run(batches):
        n, total = 0, None
        for b in batches:
            m = _matrix(b["x"])
            n += len(m)
            high, low = (m >> 24).sum(0), (m & 0xFFFFFF).sum(0)
            got = [(int(h) << 24) + int(s) for h, s in zip(high, low, strict=True)]
            total = got if total is None else [a + c for a, c in zip(total, got, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([str(t) for t in total])], ["i", "n", "s"])

    got = x.mapInArrow(common.trimmed(run), "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return Fit(got[0].n, [int(r.s) for r in got]) if got else Fit(0, [])


_BLOCK = "j int, part int, v binary"


def _summed(key: tuple, parts: pa.Table) -> pa.Table:
    """A direction's sum over tasks, in the tasks' order."""
    rows = sorted(zip(parts["part"].to_pylist(), parts["v"].to_pylist(), strict=True))
    total = np.zeros(len(rows[0][1]) // 8)
    for _, v in rows:
        total += np.frombuffer(v)
    return pa.Table.from_arrays([parts["j"].slice(0, 1), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["j", "part", "v"])


def _reduced(x: DataFrame, task) -> np.ndarray:
    """Column sums over all tasks: task gives a matrix, whose columns are summed apart."""

    def run(batches):
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                got = task(_matrix(b["x"]))
                total = got if total is None else total + got
        if total is not None:
            m = total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(range(m), pa.int32()), pa.array([TaskContext.get().partitionId()] * m, pa.int32()), pa.array([np.ascontiguousarray(total[:, j]).tobytes() for j in range(m)], pa.binary())], ["j", "part", "v"])

    got = x.mapInArrow(common.trimmed(run), _BLOCK).groupBy("j").applyInArrow(_summed, _BLOCK).collect()
    return np.stack([np.frombuffer(r.v) for r in sorted(got, key=lambda r: r.j)], 1)


def times_covariance(x: DataFrame, fit: Fit, q: np.ndarray) -> np.ndarray:
    """V q in one pass, V never formed: Yᵀ(Y q) / n over the centred rows Y."""

    def task(rows: np.ndarray) -> np.ndarray:
        y = fit.centred(rows)
        return y.T @ (y @ q)

    return _reduced(x, task) / fit.n


def subspace(times, d: int, k: int, tell=None) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their unit eigenvectors (as columns) of a
    symmetric d x d matrix V known by times(q) = V q alone."""
    k, rng = min(k, d), np.random.default_rng(SEED)
    q = np.linalg.qr(rng.standard_normal((d, min(d, k + SPARE))))[0]
    before, passes = None, 0
    while True:
        z = times(q)
        passes += 1
        small = q.T @ z
        e, u = np.linalg.eigh((small + small.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        ritz, image = q @ u, z @ u
        worst = float(np.linalg.norm(image[:, :k] - ritz[:, :k] * e[:k], axis=0).max())
        limit = TOLERANCE * max(float(e[0]), 0.0)
        if tell:
            tell(passes, q.shape[1], worst)
        full = q.shape[1] == d
        if worst <= limit or full and before is not None and worst >= before / 2:  # a full block is exact to rounding
            return e[:k], ritz[:, :k]
        q = ritz if full else np.linalg.qr(image)[0]
        fall = np.log(before / worst) if before and worst < before else 0.0
        if not full and passes > 1 and fall * PATIENCE < np.log(worst / limit):  # too slow: more directions
            fresh = rng.standard_normal((d, min(d, 2 * q.shape[1]) - q.shape[1]))
            fresh -= q @ (q.T @ fresh)
            q = np.linalg.qr(np.concatenate([q, fresh], 1))[0]
            before = None
        else:
            before = worst


def whitened(df: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding", tell=None) -> DataFrame:
    """A row for each row of df with a usable vector and each component: its id,
    component (from 1, by falling variance), n, deviation, whitened, explained and
    identity_error (see ``op12_whitening``).

    Rows with a null vector, an empty one, or one with a null or non-finite entry
    are left out. So are rows whose vector is not as long as most are (ties: the
    longer). Ids may be null or repeat: each row is a row of the fit. Entries beyond
    ``LARGEST`` are held at it. Directions without variance (equal rows, fewer rows
    than dimensions) are no components; an empty table has none. A deviation over
    the largest long is given as that."""
    spark = df.sparkSession
    x = common.written(integer_rows(df, key, vector), "whitening-x")
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = f"{key} {dict(df.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], schema)
    d = lengths[0].d
    x = x.filter(F.size("x") == d)
    fit = fitted(x)
    e, q = subspace(lambda b: times_covariance(x, fit, b), d, components, tell)
    kept = e > NOTHING * max(float(e[0]), np.finfo(float).tiny)
    e, q = e[kept], q[:, kept]
    k = len(e)
    if not k:
        return spark.createDataFrame([], schema)
    w = q / np.sqrt(e)

    def measured(rows: np.ndarray) -> np.ndarray:
        """Sums of the whitened values, their products, and the trace's share of each dimension."""
        y = fit.centred(rows)
        z = y @ w
        out = np.zeros((max(d, k), k + 2))
        out[:k, :k], out[:k, k], out[:d, k + 1] = z.T @ z, z.sum(0), (y * y).sum(0)
        return out

    got = _reduced(x, measured) / fit.n
    mean = got[:k, k]
    error = float(np.abs(got[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())
    share = e / got[:d, k + 1].sum()

    def run(batches):
        for b in batches:
            rows = _matrix(b["x"])
            m = len(rows)
            each = lambda v: np.tile(v, m)
            cols = [b["vec_id"].take(pa.array(np.repeat(np.arange(m), k))), pa.array(each(np.arange(1, k + 1, dtype=np.int32))), pa.array(np.full(m * k, fit.n, np.int64)), pa.array(np.repeat(np.array(fit.deviation(rows), np.int64), k)), pa.array((fit.centred(rows) @ w).ravel()), pa.array(each(share)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(cols, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(common.trimmed(run), schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable row of ``embeddings`` whitened on up to 32 components."""
    return whitened(common.table(spark, sf_dir, "embeddings"))
