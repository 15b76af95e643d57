"""Embedding whitening by a block Jacobi-Davidson solver.

The principal components of a table of vectors are the leading eigenvectors of their covariance V. V is never built: a
Spark job multiplies it by a few columns at once, each task centring its vectors before it multiplies, and partial products
are summed by Spark. Outside the jobs only matrices of the vectors' width and a few dozen columns exist.

Each outer step takes the Ritz pairs of the current subspace, locks those whose residual is down to rounding, and solves
the others' correction equations (I - QQ')(V - theta I)(I - QQ') t = -r, Q being the locked and current Ritz vectors, by a
few MINRES steps, all pairs side by side, so one job serves a step of every pair. The solutions extend the subspace;
past ``max_basis`` columns it restarts from its best Ritz vectors. A last Rayleigh-Ritz step over the locked vectors gives
the components.

Entries are turned into whole numbers x = floor(scale * c) + offset, and centred as (n * x - S) / n with exact n * x - S,
where the n distinct x vectors are the fit list and S its sums per dimension.

Defined results: rows whose vector is null or empty or holds null or non-finite entries are dropped; equal vectors count
once in the fit list, and every row of theirs gets the same values; rows that repeat a key, or with a null one, are
projected each; components whose variance is zero up to rounding are left out, so fewer than ``components`` may come back;
equal variances give some orthogonal basis of their space; vectors of several widths raise ValueError; a deviation beyond a
long is null; further columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.llm.common import durable, list_array

EPS = np.finfo(float).eps
#: Entries of vectors that a task centres at once.
BLOCK = 1 << 20
#: Residuals at most this times the largest eigenvalue are rounding.
TOLERANCE = 16 * EPS


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  # exact, per dimension
    axes: np.ndarray  # width x components
    variances: np.ndarray  # falling
    trace: float
    residual: float  # largest, relative to the largest variance
    identity_error: float  # of the whitened fit list

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.trace


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: int, offset: int) -> DataFrame:
    """``vec_id, x`` of the rows that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))).select(
        F.col(key).alias("vec_id"), F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(offset)).alias("x"))


def _blocks(batches, width: int):
    """Blocks of x vectors as int64 matrices."""
    for batch in batches:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        step = max(1, BLOCK // width)
        for i in range(0, len(x), step):
            yield x[i:i + step]


def _summed(fit: DataFrame, width: int, size: int, part: Callable) -> np.ndarray:
    """The sum of ``part(block)`` (flat, ``size`` long) over all blocks of the fit list: within tasks first, then by Spark."""

    def run(batches):
        total = None
        for x in _blocks(batches, width):
            one = part(x)
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["pos", "v"])

    kind = "long" if size < 0 else "double"
    rows = fit.mapInArrow(run, f"pos int, v {kind}").groupBy("pos").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(abs(size), np.int64 if size < 0 else float)
    for r in rows:
        out[r.pos] = r.v
    return out


def _orthonormal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``t`` add to ``against``."""
    t = t / np.maximum(np.linalg.norm(t, axis=0), 1e-300)
    for _ in range(3):
        for q in against:
            t = t - q @ (q.T @ t)
    u, s, _ = np.linalg.svd(t, full_matrices=False)
    t = u[:, s > 1e-8 * max(1.0, s[0] if len(s) else 0.0)]
    for q in against:
        t = t - q @ (q.T @ t)
    return np.linalg.qr(t)[0] if t.shape[1] else t


def minres(times: Callable, theta: np.ndarray, rhs: np.ndarray, away: np.ndarray, steps: int) -> np.ndarray:
    """``steps`` MINRES steps of every column's own system (I - QQ')(V - theta_j)(I - QQ') t_j = rhs_j, Q = ``away``; one
    product with V a step for all of them. A column whose Krylov space ends stays as it is."""
    def project(y):
        return y - away @ (away.T @ y)

    v = project(rhs)
    beta = np.linalg.norm(v, axis=0)
    live = beta > 1e-300
    floor = 1e-14 * np.where(live, beta, 1.0)
    x = np.zeros_like(v)
    v = v / np.where(live, beta, 1.0)
    old_v = np.zeros_like(v)
    w, old_w = np.zeros_like(v), np.zeros_like(v)
    eta = beta.copy()
    c = old_c = np.ones_like(beta)
    s = old_s = np.zeros_like(beta)
    last = np.zeros_like(beta)
    scale = np.abs(theta).max() if len(theta) else 1.0
    for _ in range(steps):
        if not live.any():
            break
        p = project(times(v) - v * theta)
        alpha = (v * p).sum(0)
        p = p - v * alpha - old_v * last
        new = np.linalg.norm(p, axis=0)
        # QR of the Lanczos tridiagonal by Givens rotations
        delta, rho3 = c * alpha - old_c * s * last, old_s * last
        rho2 = s * alpha + old_c * c * last
        rho1 = np.hypot(delta, new)
        ok = live & (rho1 > 1e-14 * scale)
        safe = np.where(ok, rho1, 1.0)
        old_c, old_s = c, s
        c, s = np.where(ok, delta / safe, 1.0), np.where(ok, new / safe, 0.0)
        step = (v - w * rho2 - old_w * rho3) / safe
        old_w, w = w, step
        x = x + np.where(ok, c * eta, 0.0) * step
        eta = -s * eta
        live = ok & (new > 1e-13 * scale) & (np.abs(eta) > floor)
        old_v, v, last = v, np.where(live, p / np.where(new > 0, new, 1.0), 0.0), new
    return x


def jacobi_davidson(times: Callable, width: int, want: int, inner: int = 3, spare: int = 4, max_basis: int | None = None,
                    rounds: int = 200, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, falling; eigenvectors; largest residual over the largest eigenvalue) of the ``want`` leading pairs of the symmetric
    operator ``times`` (a width x m matrix to V times it). Raises ArithmeticError if residuals don't come down to
    rounding within ``rounds`` outer steps."""
    want = min(want, width)
    max_basis = min(width, max_basis or max(4 * want, want + 8))
    rng = np.random.default_rng(seed)
    locked = np.zeros((width, 0))
    w = _orthonormal(rng.standard_normal((width, min(width, want + spare))))
    aw = times(w)
    top = 0.0
    for _ in range(rounds):
        theta, y = np.linalg.eigh((w.T @ aw + aw.T @ w) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        u, au = w @ y, aw @ y
        top = max(top, float(theta[0]) if len(theta) else 0.0)
        r = au - u * theta
        r -= locked @ (locked.T @ r)
        # locking goes from the largest on, so the order of the pairs is that of their values
        need = want - locked.shape[1]
        size = np.linalg.norm(r[:, :need], axis=0)
        done = int(np.argmax(np.r_[size > TOLERANCE * top * np.sqrt(width), True]))
        if done:
            locked = np.c_[locked, u[:, :done]]
            u, au, theta, r = u[:, done:], au[:, done:], theta[done:], r[:, done:]
            need -= done
        if not need:
            break
        away = np.c_[locked, u[:, :need]]
        t = minres(times, theta[:need], -r[:, :need], away, min(inner, max(1, width - away.shape[1])))
        if u.shape[1] + need > max_basis - locked.shape[1]:
            keep = min(u.shape[1], max(need + spare, max_basis - locked.shape[1] - need))
            if u.shape[1] + locked.shape[1] < width:  # a full basis has nothing to gain from a restart
                u, au = u[:, :keep], au[:, :keep]
        new = _orthonormal(t, locked, u)
        if not new.shape[1] and u.shape[1] + locked.shape[1] < width:
            new = _orthonormal(rng.standard_normal((width, min(need, width - u.shape[1] - locked.shape[1]))), locked, u)
        if new.shape[1]:
            w, aw = np.c_[u, new], np.c_[au, times(new)]
        else:  # the basis is full: products anew, with an orthonormal basis
            w = _orthonormal(u, locked)
            aw = times(w)
    else:
        raise ArithmeticError(f"residuals {size} of a largest eigenvalue {top} after {rounds} steps")
    locked = np.linalg.qr(locked)[0]
    av = times(locked)
    theta, y = np.linalg.eigh((locked.T @ av + av.T @ locked) / 2)
    theta, y = theta[::-1], y[:, ::-1]
    q = locked @ y
    residual = np.linalg.norm(av @ y - q * theta, axis=0)
    return theta, q, float(residual.max() / top) if top > 0 else 0.0


def fit_whitening(vectors: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding",
                  scale: int = 64, offset: int = 1_000_000) -> Whitening | None:
    """The whitening of the distinct vectors of ``vectors``; None where there is none."""
    fit = durable(whole_numbers(vectors, key, vector, scale, offset).select("x").distinct(), "fit-list")
    n, low, high = fit.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        return None
    if low != high:
        raise ValueError(f"vectors of {low} to {high} entries")
    width = low
    sums = _summed(fit, width, -width, lambda x: x.sum(0))

    def centred(x):
        return (n * x - sums) / n

    trace = float(_summed(fit, width, 1, lambda x: np.array([(centred(x) ** 2).sum()]))[0]) / n

    def times(block):
        def part(x):
            c = centred(x)
            return (c.T @ (c @ block)).ravel()
        return _summed(fit, width, block.size, part).reshape(block.shape) / n

    if trace == 0:
        return Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0, 0.0)
    e, q, residual = jacobi_davidson(times, width, components)
    keep = e > width * EPS * e[0]
    e, q = e[keep], q[:, keep]
    m = len(e)
    root = np.sqrt(e)

    def moments(x):
        z = centred(x) @ q / root
        return np.r_[z.sum(0), (z.T @ z).ravel()]

    s = _summed(fit, width, m + m * m, moments) / n
    error = np.abs(s[m:].reshape(m, m) - np.outer(s[:m], s[:m]) - np.eye(m)).max()
    return Whitening(n, sums, q, e, trace, residual, float(error))


def whiten(vectors: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding",
           scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``vec_id, deviation, whitened array<double>`` of each row that takes part: the exact sum over dimensions of
    (n * x - S)^2, and the components with unit variance over the fit list."""
    rows = whole_numbers(vectors, key, vector, scale, offset)
    schema = f"vec_id {vectors.schema[key].dataType.simpleString()}, deviation long, whitened array<double>"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, q, root = model.n, model.sums, model.axes, np.sqrt(model.variances)
    width, m = len(sums), len(root)

    def run(batches):
        for batch in batches:
            done = 0
            for x in _blocks([batch], width):
                d = n * x - sums
                if np.abs(d).max(initial=0).astype(float) ** 2 * width < 2.0 ** 62:
                    deviation = pa.array((d * d).sum(1))
                else:
                    exact = (d.astype(object) ** 2).sum(1)
                    deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                z = (d / n) @ q / root
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").slice(done, len(x)), deviation, list_array(z.ravel(), np.full(len(x), m))],
                    ["vec_id", "deviation", "whitened"])
                done += len(x)

    return rows.mapInArrow(run, schema)
