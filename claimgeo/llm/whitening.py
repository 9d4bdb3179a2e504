"""Embedding whitening: principal components of a table of vectors.

Vectors are scaled to whole numbers, so equal vectors are equal values. The
fit list (each distinct vector once) is made by a map-side combined
aggregate and materialised; two passes over it give, from partial sums per
task, its moments and its centred scatter. What reaches the driver is one
``d x d`` matrix (d: the vectors' length), whatever the number of rows. There the
scatter is factored by pivoted Cholesky and the triangular factor's rows are
rotated by one-sided Jacobi; the rotated norms and directions are the
components. Every row is then projected inside the tasks.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut

SCALE = 256
COMPONENTS = 4
LONG = 2.0 ** 63


def pivoted_cholesky(a: np.ndarray, tol: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(l, order)`` with ``a[order][:, order] == l @ l.T``: ``l`` is lower
    trapezoidal with as many columns as ``a`` (symmetric, positive
    semidefinite) has rank. Each step takes the greatest diagonal entry left;
    it stops when that is not above ``tol`` (default: rounding of the
    greatest one)."""
    a = np.array(a, dtype=np.float64)
    d = len(a)
    order = np.arange(d)
    l = np.zeros((d, d))
    left = a.diagonal().copy()
    if tol is None:
        tol = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(left[order[k:]]))
        order[[k, p]] = order[[p, k]]
        l[[k, p], :k] = l[[p, k], :k]
        top = left[order[k]]
        if not top > tol:
            return l[:, :k], order
        l[k, k] = np.sqrt(top)
        rest = order[k + 1:]
        l[k + 1:, k] = (a[rest, order[k]] - l[k + 1:, :k] @ l[k, :k]) / l[k, k]
        left[rest] -= l[k + 1:, k] ** 2
    return l, order


def one_sided_jacobi(l: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``l`` with its columns rotated in pairs until all are orthogonal, so
    that ``l @ l.T`` stays the same. Disjoint pairs (round-robin) are rotated
    at once; stops when a sweep finds no pair above rounding, raises if
    ``sweeps`` do not do."""
    g = np.array(l, dtype=np.float64)
    r = g.shape[1]
    if r < 2:
        return g
    seats = list(range(r)) + [-1] * (r % 2)              # -1: sits out
    eps = np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            pairs = [(p, q) for p, q in zip(seats[:len(seats) // 2], reversed(seats[len(seats) // 2:])) if p >= 0 <= q]
            seats = seats[:1] + seats[-1:] + seats[1:-1]
            p, q = (np.array(x) for x in zip(*pairs))
            x, y = g[:, p], g[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            do = np.abs(gamma) > eps * np.sqrt(alpha * beta)
            if not do.any():
                continue
            turned = True
            x, y, p, q = x[:, do], y[:, do], p[do], q[do]
            zeta = (beta[do] - alpha[do]) / (2 * gamma[do])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            g[:, p], g[:, q] = c * (x - t * y), c * (t * x + y)
        if not turned:
            return g
    raise RuntimeError(f"columns are not orthogonal after {sweeps} sweeps")


def components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling, only those above rounding) and unit eigenvectors
    (one a column) of a scatter matrix."""
    l, order = pivoted_cholesky(scatter)
    g = one_sided_jacobi(l)
    norm = np.sqrt((g * g).sum(0))
    by = np.argsort(-norm, kind="stable")
    by = by[norm[by] > 0]
    u = np.empty((len(scatter), len(by)))
    u[order] = g[:, by] / norm[by]
    return norm[by] ** 2, u


def whole(values: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow list column the rows that are kept (positions), their
    lengths, and ``floor(scale * entry)`` of their entries, one after the other."""
    n = len(values)
    lengths = np.diff(values.offsets.to_numpy()) if n else np.zeros(0, dtype=np.int64)
    flat = values.flatten()
    # flatten() leaves null lists out; their stretch of the offsets may be anything.
    present = np.asarray(values.is_valid())
    lengths = np.where(present, lengths, 0).astype(np.int64)
    entries = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)       # null entries become NaN
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(scale * entries)
        good = np.abs(x) < LONG                                            # False for NaN and infinities, too
    row = np.repeat(np.arange(n), lengths)
    bad = np.bincount(row[~good], minlength=n)
    kept = present & (bad == 0)
    return np.flatnonzero(kept), lengths[kept], x[kept[row]].astype(np.int64)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in the least of four widths that holds them all: equal
    vectors have equal bytes. The first byte is the width."""
    lo, hi = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    for width in (1, 2, 4, 8):
        if -(1 << (8 * width - 1)) <= lo and hi < 1 << (8 * width - 1):
            return bytes([width]) + x.astype(f"<i{width}").tobytes()
    raise OverflowError("not a long")


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<i{raw[0]}", offset=1).astype(np.int64)


def fit_list(vectors: DataFrame, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``(x, d)``: each distinct packed vector once, and its length."""
    schema = pa.schema([("x", pa.binary()), ("d", pa.int32())])

    def run(batches):
        for b in batches:
            _, lengths, flat = whole(b.column(0), scale)
            ends = np.cumsum(lengths)
            yield batch({"x": [pack(flat[e - k:e]) for e, k in zip(ends, lengths)],
                         "d": pa.array(lengths.astype(np.int32))}, schema)

    packed = vectors.select(F.col(f"`{vec_col}`").cast("array<double>").alias("v")).mapInArrow(run, "x binary, d int")
    return packed.groupBy("x").agg(F.min("d").alias("d"))


def _add_up(df: DataFrame, names: list[str]) -> dict[str, np.ndarray]:
    """Sums by position of arrays emitted by every task as ``(name, at,
    value)`` rows; as many rows come back as the arrays have entries."""
    out: dict[str, dict[int, float]] = {n: {} for n in names}
    for r in df.groupBy("name", "at").agg(F.sum("value").alias("value")).collect():
        out[r["name"]][r["at"]] = r["value"]
    return {n: np.array([v[i] for i in sorted(v)]) for n, v in out.items()}


def _rows(schema: pa.Schema, **arrays: np.ndarray) -> pa.RecordBatch:
    names = [n for n, a in arrays.items() for _ in range(a.size)]
    at = np.concatenate([np.arange(a.size, dtype=np.int32) for a in arrays.values()])
    return batch({"name": names, "at": pa.array(at),
                  "value": pa.array(np.concatenate([a.ravel() for a in arrays.values()]).astype(np.float64))}, schema)


SUMS = pa.schema([("name", pa.string()), ("at", pa.int32()), ("value", pa.float64())])
SUMS_DDL = "name string, at int, value double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", n_components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """``(<id_col>, component, n, deviation, whitened, explained,
    identity_error)`` per kept row and component.

    Entries become ``x = floor(scale * entry)``; the covariance V is that of
    the n distinct x-vectors (divisor n, centred before multiplying).
    ``component`` counts V's unit eigenvectors from 1 by falling eigenvalue e;
    ``deviation`` is the exact sum over dimensions of ``(n*x - S)**2`` (S: the
    sums over the fit list; null where it does not fit a long);
    ``whitened`` the projection of ``x - S/n`` over ``sqrt(e)``; ``explained``
    ``e / trace(V)``; ``identity_error`` the largest absolute entry of the
    whitened fit list's covariance minus the identity.

    Nulls: rows whose vector is null, or holds a null or an entry that is not
    finite (or whose x does not fit a long), are dropped; a null id is kept.
    Vectors of another length than the commonest one of the fit list (ties:
    the longest) are dropped, empty ones too. Repeated rows count once in the
    fit and each get their rows. A component of eigenvalue zero (fewer
    directions than asked, equal vectors only) has no rows; so has an empty
    table. Tied eigenvalues have any basis of their plane, the same one for
    all rows. Other columns, whatever their names, are ignored. Long vectors:
    a task holds a batch of rows and one ``d x d`` matrix.
    """
    spark = vectors.sparkSession
    out_ddl = (f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, "
               "identity_error double")
    fit = cut(fit_list(vectors, vec_col, scale))
    dims = fit.filter("d > 0").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if dims is None:
        return spark.createDataFrame([], out_ddl)
    d, n = int(dims["d"]), int(dims["count"])
    fit = fit.filter(F.col("d") == d).select("x")

    # Exact sums: a task's are Python whole numbers, spelled as decimals.
    sums_schema = pa.schema([("at", pa.int32()), ("value", pa.decimal128(38))])

    def add(batches):
        total = np.zeros(d, dtype=object)
        for b in batches:
            if b.num_rows:
                x = np.array([unpack(r) for r in b.column(0).to_pylist()])
                high, low = x >> 32, x & 0xFFFFFFFF          # so that a batch's sums cannot overflow
                total = total + high.sum(0).astype(object) * (1 << 32) + low.sum(0).astype(object)
        yield batch({"at": pa.array(np.arange(d, dtype=np.int32)), "value": [Decimal(int(t)) for t in total]}, sums_schema)

    got = fit.mapInArrow(add, "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value")).collect()
    s = [0] * d
    for r in got:
        s[r["at"]] = int(r["value"])
    mean = np.array([v / n for v in s])

    def scatter(batches):
        total = np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                y = np.array([unpack(r) for r in b.column(0).to_pylist()], dtype=np.float64) - mean
                total += y.T @ y
        yield _rows(SUMS, scatter=total)

    parts = _add_up(fit.mapInArrow(scatter, SUMS_DDL), ["scatter"])
    v = parts["scatter"].reshape(d, d) / n
    e, u = components((v + v.T) / 2)
    share = e / v.trace() if len(e) else e
    e, u, share = e[:n_components], u[:, :n_components], share[:n_components]
    k = len(e)
    if not k:
        return spark.createDataFrame([], out_ddl)
    project = u / np.sqrt(e)

    def moments(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                w = (np.array([unpack(r) for r in b.column(0).to_pylist()], dtype=np.float64) - mean) @ project
                first += w.sum(0)
                second += w.T @ w
        yield _rows(SUMS, first=first, second=second)

    m = _add_up(fit.mapInArrow(moments, SUMS_DDL), ["first", "second"])
    off = m["second"].reshape(k, k) / n - np.outer(m["first"], m["first"]) / n ** 2 - np.eye(k)
    error = float(np.abs(off).max())
    schema = pa.schema([("id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def rows(batches):
        for b in batches:
            kept, lengths, flat = whole(b.column(1), scale)
            of_d = np.repeat(lengths == d, lengths)
            x = flat[of_d].reshape(-1, d)
            ids = b.column(0).take(pa.array(kept[lengths == d]))
            w = (x - mean) @ project
            far = _deviations(x, n, s)
            at = np.repeat(np.arange(len(x)), k)
            comp = np.tile(np.arange(k), len(x))
            yield batch({"id": ids.take(pa.array(at)), "component": pa.array((comp + 1).astype(np.int32)),
                         "n": pa.array(np.full(len(at), n)), "deviation": [far[i] for i in at],
                         "whitened": pa.array(w[at, comp]), "explained": pa.array(share[comp]),
                         "identity_error": pa.array(np.full(len(at), error))}, schema)

    out = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                         F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    return out.mapInArrow(rows, out_ddl.replace(f"`{id_col}`", "id")).withColumnRenamed("id", id_col)


def _deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Exact ``sum((n*x - s)**2)`` per row: in longs where it surely fits,
    else in Python whole numbers."""
    if not len(x):
        return []
    far = np.abs(n * x.astype(np.float64) - np.array(s, dtype=np.float64))
    if ((far ** 2).sum(1) < 2.0 ** 62).all() and float(n) * float(np.abs(x).max()) < 2.0 ** 62 > max(map(abs, s)):
        y = n * x - np.array(s, dtype=np.int64)
        return (y * y).sum(1).tolist()
    exact = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]
