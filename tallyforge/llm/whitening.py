"""Operator 12: whitening of embeddings by shifted Cholesky QR.

Vectors are fixed-point numbers x = floor(256 c).  The fit list F holds each distinct vector once; n is its length, S its sum,
A = F - S / n its centred rows.  A = Q R is built without ever orthogonalising rows against each other:

1. A pass over the fit list sums the Gram matrix of each task's block of rows; the sums meet in one small matrix.
2. The driver factorises it by Cholesky.  The first time a small multiple of the identity is added, which keeps the factor
   alive whatever the condition; later ones are shifted only if they break down.
3. The next pass solves its rows against all factors found so far (forward substitution, a column at a time, for
   all rows of a block) and sums their Gram matrix.  Passes go on until that is the identity, or ``passes`` are spent.
4. R is the product of the factors, and what is left of the last Gram matrix is folded into it by its square root, so that
   linearly dependent dimensions, whose columns of Q are null, do no harm.  The singular vectors of R are the components, its
   squared singular values over n the eigenvalues.

Only matrices of the width of a vector reach the driver; they do not grow with the rows.

Defined results: vectors that are null, empty, or hold null or non-finite entries (or ones of 2^54 and more, whose x would
not fit a long) are left out, and so are those that are not as long as most (of lengths that are equally frequent, the largest
counts).  Repeated vectors count once in the fit and each have their result.  Where the distinct vectors do not vary in a component's direction (eigenvalue 0),
``whitened`` is null; it is left out of identity_error, which is null if no component is left.  ``deviation`` is null if it does not
fit a long.  Extra columns are ignored; null and repeated vec_ids are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import durable

#: Rows that are multiplied at once.
BLOCK = 4096
EPS = float(np.finfo(np.float64).eps)
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def fixed_point(embeddings: DataFrame) -> DataFrame:
    """vec_id and x of the rows whose vectors are whole."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float(1 << 54)), F.lit(False)))
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * 256))
    rows = embeddings.filter(ok & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long"), x.alias("x"))
    # the length is one of a few numbers a table; the commonest is taken without a shuffle of vectors
    common = rows.groupBy(F.size("x").alias("d")).count().agg(F.max_by("d", F.struct("count", "d")).alias("d"))
    return rows.join(F.broadcast(common), F.size("x") == F.col("d")).select("vec_id", "x")


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    """The vectors of a batch as matrices of at most BLOCK rows."""
    for at in range(0, batch.num_rows, BLOCK):
        lists = batch.column(column).slice(at, BLOCK)
        yield lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _summed(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], dtype: type) -> np.ndarray | None:
    """The sum of ``of`` (a matrix) over all blocks of fit: a task sends one matrix, row by row; rows meet in different tasks."""
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in _blocks(batch, 0):
                one = of(block)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([np.ascontiguousarray(r).tobytes() for r in total], pa.binary())], ["row", "data"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype) for x in table.column("data"))
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    rows = fit.mapInArrow(own, "row int, data binary").groupBy("row").applyInArrow(add, "row int, data binary").collect()
    return np.stack([np.frombuffer(r["data"], dtype) for r in sorted(rows, key=lambda r: r["row"])]) if rows else None


def solve_rows(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Y with Y R = A for an upper triangular R, by forward substitution over all rows at once."""
    y = np.empty_like(a)
    for j in range(a.shape[1]):
        y[:, j] = (a[:, j] - y[:, :j] @ r[:j, j]) / r[j, j]
    return y


def shifted_cholesky(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular R with R'R = G + shift I; the shift grows until the factor exists."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(shift * 10, EPS * float(np.trace(g)) or 1.0)


class Whitening:
    """n, S, eigenvalues (falling) and components (rows) of a fit list."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, components: np.ndarray, trace: float) -> None:
        self.n, self.sums, self.values, self.components, self.trace = n, sums, values, components, trace
        self.mean = np.array([int(s) / n for s in sums])
        #: Components in whose direction the vectors vary.
        self.varies = values > float(values[0]) * (8 * len(sums) * EPS) ** 2

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - self.mean

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first k components of each row; not a number where the vectors do not vary."""
        scale = np.where(self.varies[:k], np.sqrt(np.where(self.varies[:k], self.values[:k], 1.0)), np.nan)
        return self.centred(x) @ self.components[:k].T / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2."""
        far = self.n * x.astype(np.float64) - self.sums.astype(np.float64)
        if float(np.abs(far).max(initial=0.0)) < 2**31 and float((far * far).sum(axis=1).max(initial=0.0)) < 2**62:
            exact = self.n * x - self.sums.astype(np.int64)
            return (exact * exact).sum(axis=1).tolist()
        totals = [sum((self.n * int(e) - int(s)) ** 2 for e, s in zip(row, self.sums)) for row in x]
        return [t if t < 1 << 63 else None for t in totals]


def fit_whitening(fit: DataFrame, passes: int = 6) -> Whitening | None:
    """The whitening of fit (x, distinct vectors of one length): None for an empty table."""
    if passes < 3:
        raise ValueError("a shifted pass and two more are needed")
    # sums of halves, so that no task's sums leave a long
    halves = lambda x: np.stack([np.full(x.shape[1], len(x)), (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)])
    counted = _summed(fit, halves, np.int64)
    if counted is None:
        return None
    n = int(counted[0, 0])
    sums = np.array([(int(h) << 31) + int(low) for h, low in zip(counted[1], counted[2])], dtype=object)
    mean = np.array([int(s) / n for s in sums])
    d, factors, gram, trace = len(sums), [], None, 0.0

    def gram_of(x: np.ndarray) -> np.ndarray:
        q = x - mean
        for r in factors:
            q = solve_rows(q, r)
        return q.T @ q

    for k in range(passes):
        gram = _summed(fit, gram_of, np.float64)
        if k == 0:
            trace = float(np.trace(gram)) / n
            if trace == 0:
                return Whitening(n, sums, np.zeros(d), np.eye(d), 0.0)
            shift = 11 * (n * d + d * (d + 1)) * EPS / 2 * float(np.linalg.norm(gram, 2))
        elif float(np.abs(gram - np.eye(d)).max()) < 8 * d * EPS:
            break
        elif k == passes - 1:
            break
        factors.append(shifted_cholesky(gram, shift if k == 0 else 0.0))
    total = np.eye(d)
    for r in factors:
        total = r @ total
    # what the last pass found of Q'Q beside the identity
    own, at = np.linalg.eigh((gram + gram.T) / 2)
    root = at * np.sqrt(np.maximum(own, 0.0)) @ at.T
    _, singular, components = np.linalg.svd(root @ total)
    return Whitening(n, sums, singular**2 / n, components, trace)


def whiten(embeddings: DataFrame, components: int = 4, passes: int = 6) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each whole row of ``embeddings`` (vec_id, embedding, ...)."""
    rows = fixed_point(embeddings)
    fit = durable(rows.select("x").distinct(), "whitening-fit")
    found = fit_whitening(fit, passes)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    k = min(components, len(found.sums))
    used = np.flatnonzero(found.varies[:k])
    error = None
    if len(used):
        # centred before multiplying, though the mean of whitened rows is nought up to rounding
        mean = _summed(fit, lambda x: found.whitened(x, k)[:, used].sum(axis=0)[None], np.float64)[0] / found.n
        z = lambda x: found.whitened(x, k)[:, used] - mean
        error = float(np.abs(_summed(fit, lambda x: z(x).T @ z(x), np.float64) / found.n - np.eye(len(used))).max())
    explained = [float(v) / found.trace if found.trace else 0.0 for v in found.values[:k]]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks(batch, 1):
                m = len(x)
                ids = batch.column(0).slice(at, m).take(pa.array(np.repeat(np.arange(m), k)))
                at += m
                white = found.whitened(x, k).ravel()
                deviation = pa.array(found.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, found.n), pa.int64()), deviation, pa.array(white, mask=np.isnan(white)), pa.array(np.tile(explained, m), pa.float64()), pa.array([error] * (m * k), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(apply, SCHEMA)
