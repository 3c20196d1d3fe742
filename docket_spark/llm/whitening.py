"""Embedding whitening by a bidiagonal qd solver.

Rows are centred exactly and reduced to a triangle R block by block (QR of each task's rows, then of groups of triangles),
so no sums of squares are formed.  R, of the vectors' width only, is brought to bidiagonal form by Householder reflections;
dqds finds its singular values to high relative accuracy, and twisted factorisations of the shifted products give the
whitening directions; values that lie close together are told apart in shifted representations of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import discard, map_batches, ship, stored

EPS = float(np.finfo(float).eps)
FAN = 16  # triangles that one task joins
SAFE = 1 << 62  # whole numbers below it are held in 64 bits
LAST = 9223372036854775807


# ---- the solver: one square of the vectors' width


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and right factor v with r = u bidiagonal(a, b) v', by Householder reflections."""

    def reflection(x):
        size = np.linalg.norm(x)
        if size == 0:
            return x * 0, 0.0
        u = x.copy()
        u[0] += np.copysign(size, x[0])
        return u, 2.0 / (u @ u)

    m = r.astype(float).copy()
    d = m.shape[1]
    v = np.eye(d)
    for k in range(d):
        u, w = reflection(m[k:, k])
        m[k:, k:] -= np.outer(w * u, u @ m[k:, k:])
        if k < d - 2:
            u, w = reflection(m[k, k + 1 :])
            m[k:, k + 1 :] -= np.outer(m[k:, k + 1 :] @ u, w * u)
            v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ u, w * u)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _qd_step(q: list[float], e: list[float], shift: float):
    """One dqds transform; None if the shift is above the smallest eigenvalue."""
    qq, ee, d = [], [], q[0] - shift
    if d < 0:
        return None
    for i, x in enumerate(e):
        t = d + x
        if t == 0:
            qq.append(0.0), ee.append(0.0)
            d = q[i + 1] - shift
        else:
            ratio = q[i + 1] / t
            qq.append(t), ee.append(x * ratio)
            d = d * ratio - shift
        if d < 0:
            return None
    return [*qq, d], ee


def _low_end(q: list[float], e: list[float]) -> float:
    """An estimate of the smallest eigenvalue, most often from below."""
    top = q[-2] + (e[-2] if len(e) > 1 else 0.0)
    low, off = q[-1] + e[-1], (q[-2] * e[-1]) ** 0.5
    mean, half = (top + low) / 2, (top - low) / 2
    root = (half * half + off * off) ** 0.5
    found = (top * low - off * off) / (mean + root) if mean + root > 0 else 0.0
    first = off / ((off * off + (found - top) ** 2) ** 0.5 or 1.0) if off else 0.0
    return found - abs(first) * (q[-3] * e[-2]) ** 0.5 if len(q) > 2 else found * (1 - 4 * EPS)


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (a, b), falling."""
    found: list[float] = []
    work = [((a * a).tolist(), (b * b).tolist(), 0.0)]
    small = (10 * EPS) ** 2
    while work:
        q, e, shift = work.pop()
        failures = 0
        while q:
            if len(q) == 1 or e[-1] <= small * (shift + q[-1]) or e[-1] <= small * shift:
                found.append(q.pop() + shift)
                if e:
                    e.pop()
                failures = 0
                continue
            cut = next((i for i in range(len(e) - 2, -1, -1) if e[i] <= small * shift or e[i] <= small * min(q[i], q[i + 1])), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], shift))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:  # small values belong at the end
                q, e = q[::-1], e[::-1]
            s = max(0.0, _low_end(q, e)) * 0.5**failures if failures < 4 else 0.0
            step = _qd_step(q, e, s) if shift + s > shift else _qd_step(q, e, s := 0.0)
            if step is None:
                failures += 1
                continue
            (q, e), shift, failures = step, shift + s, 0
    return np.sort(np.array(found))[::-1]


@dataclass
class _Rep:
    """L D L' (+ what has been taken off): d, products l d of neighbours (unchanged by shifts), l l d."""

    d: np.ndarray
    ld: np.ndarray
    lld: np.ndarray

    @property
    def size(self) -> float:
        return float(max(np.abs(self.d).max(), np.abs(self.lld).max(initial=0.0)))

    def stationary(self, x: float):
        """Pivots from the top of L D L' - x and what is added to d in each."""
        floor = 1e-140 * self.size or 1e-300
        d, lld = self.d.tolist(), self.lld.tolist()
        s, pivots, added = -x, [], []
        for i in range(len(d)):
            p = d[i] + s
            if abs(p) < floor:
                p = -floor
            pivots.append(p), added.append(s)
            if i < len(lld):
                s = lld[i] * (s / p) - x
        return np.array(pivots), np.array(added)

    def below(self, x: float) -> int:
        """How many eigenvalues are smaller than x."""
        return int((self.stationary(x)[0] < 0).sum())

    def progressive(self, x: float):
        floor = 1e-140 * self.size or 1e-300
        d, lld = self.d.tolist(), self.lld.tolist()
        n = len(d)
        p, pivots, rest = d[-1] - x, [0.0] * n, [0.0] * n
        rest[-1] = p
        for i in range(n - 2, -1, -1):
            t = lld[i] + p
            if abs(t) < floor:
                t = -floor
            pivots[i + 1] = t
            p = p * (d[i] / t) - x
            rest[i] = p
        return np.array(pivots), np.array(rest)

    def shifted(self, x: float) -> "_Rep":
        pivots, _ = self.stationary(x)
        return _Rep(pivots, self.ld, self.ld * self.ld / pivots[:-1])

    def vector(self, x: float, at: int | None = None):
        """The twisted factorisation's vector for eigenvalue x, that index or the best, and x corrected by its quotient."""
        up, s = self.stationary(x)
        down, p = self.progressive(x)
        gamma = s + p + x
        k = int(np.argmin(np.abs(gamma))) if at is None else at
        z = np.zeros(len(self.d))
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -(self.ld[i] / up[i]) * z[i + 1]
        for i in range(k, len(z) - 1):
            z[i + 1] = -(self.ld[i] / down[i + 1]) * z[i]
        size = float(z @ z)
        return z / size**0.5, x + gamma[k] / size, np.abs(gamma)


def _bisected(rep: _Rep, index: int, about: float, width: float) -> float:
    """The eigenvalue that has ``index`` smaller ones, near ``about``."""
    low, high = about - width, about + width
    while rep.below(low) > index:
        low -= (width := width * 2)
    while rep.below(high) <= index:
        high += (width := width * 2)
    while high - low > 2 * EPS * max(abs(low), abs(high)) and high - low > 1e-300:
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if rep.below(mid) > index:
            high = mid
        else:
            low = mid
    return (low + high) / 2


def _vectors(rep: _Rep, values: list[float], indices: list[int], depth: int = 0) -> list[np.ndarray]:
    """Orthonormal vectors for some eigenvalues (falling) of a representation; indices: how many are smaller."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(values):
        j = i + 1
        while j < len(values) and values[j - 1] - values[j] < 1e-3 * max(abs(values[j - 1]), abs(values[j])):
            j += 1
        if j == i + 1:
            x = values[i]
            for _ in range(4):
                z, better, _ = rep.vector(x)
                if abs(better - x) <= 2 * EPS * abs(x):
                    break
                x = better
            out.append(z)
        elif depth >= 6 or values[i] - values[j - 1] <= 8 * EPS * max(abs(values[i]), 1e-300):
            # equal as far as numbers go: vectors of the places where the factorisations meet best, made orthogonal
            gamma = rep.vector(values[i])[2]
            places = np.argsort(gamma)[: j - i]
            out += list(np.linalg.qr(np.array([rep.vector(values[i + t], int(k))[0] for t, k in enumerate(places)]).T)[0].T)
        else:
            room = 1e-3 * (values[i] - values[j - 1])
            off, best = min(((x, rep.shifted(x)) for x in (values[j - 1] - room, values[i] + room)), key=lambda p: p[1].size)
            new = [_bisected(best, indices[t], values[t] - off, max(abs(values[t]) * 8 * EPS, 1e-300)) for t in range(i, j)]
            out += _vectors(best, new, indices[i:j], depth + 1)
        i = j
    return out


def eigen(r: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of r'r, falling, and unit vectors in columns."""
    scale = float(np.abs(r).max(initial=0.0))
    if scale == 0:
        return np.zeros(min(wanted, r.shape[1])), np.eye(r.shape[1])[:, :wanted]
    a, b, v = bidiagonal(r / scale)
    d = len(a)
    cuts = [0, *(np.flatnonzero(np.abs(b) <= EPS * np.minimum(np.abs(a[:-1]), np.abs(a[1:]))) + 1).tolist(), d]
    pairs = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        aa, bb = a[lo:hi], b[lo : hi - 1]
        values = dqds(aa, bb)
        rep = _Rep(aa * aa, aa[:-1] * bb, bb * bb)
        n = hi - lo
        most = min(n, wanted)
        while most < n and values[most - 1] - values[most] < 1e-3 * values[most - 1]:
            most += 1  # a group of close values is taken whole
        found = _vectors(rep, values[:most].tolist(), [n - 1 - t for t in range(most)])
        pairs += [(values[t], lo, hi, z) for t, z in enumerate(found)]
    pairs.sort(key=lambda p: -p[0])
    out = np.zeros((d, min(wanted, len(pairs))))
    for t, (_, lo, hi, z) in enumerate(pairs[: out.shape[1]]):
        out[:, t] = v[:, lo:hi] @ z
    return np.array([p[0] for p in pairs[: out.shape[1]]]) * scale * scale, out / np.linalg.norm(out, axis=0)


# ---- the rows


@dataclass(frozen=True)
class Whitening:
    """n vectors of the fit list with sums per dimension, directions in columns, their eigenvalues, trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n x - sums, exactly: 64-bit numbers where they fit, else Python's."""
        most = max((abs(s) for s in self.sums), default=0)
        if self.n * int(np.abs(x).max(initial=0)) + most < SAFE:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def whitened(self, offsets: np.ndarray) -> np.ndarray:
        return (offsets.astype(float) / self.n) @ self.components / np.sqrt(self.values)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def whole_numbers(vectors: DataFrame, vec: str = "embedding", scale: int = 256) -> DataFrame:
    """Rows with a usable vector; adds __x: floor(scale * entry) as bigint."""
    usable = F.col(vec).isNotNull() & F.coalesce(F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False)) & (F.size(vec) > 0)
    return vectors.where(usable).withColumn("__x", F.transform(vec, lambda c: F.floor(c.cast("double") * scale).cast("bigint")))


def _sums(fit: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                big = int(np.abs(x).max()) >= SAFE // len(x)
                total = (x.astype(object) if big else x).sum(axis=0)
                yield pa.record_batch([pa.array(np.arange(-1, width, dtype=np.int32)), pa.array([str(len(x)), *map(str, total.tolist())])], names=["place", "total"])

    rows = map_batches(fit.select("__x"), run, "place int, total string").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {r["place"]: int(r["total"]) for r in rows}
    return found.get(-1, 0), tuple(found.get(i, 0) for i in range(width))


def _triangle(fit: DataFrame, centre: Whitening, width: int) -> np.ndarray:
    """R of the centred rows: of each task's, then of groups of FAN triangles, until one is left."""

    def rows(part, r):
        return pa.record_batch([pa.array(np.full(len(r), part, np.int64)), pa.array(list(r), pa.list_(pa.float64()))], names=["part", "row"])

    def run(batches):
        r = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                r = np.linalg.qr(np.vstack([r, centre.offsets(_matrix(batch.column(0))).astype(float) / centre.n]), mode="r")
        if len(r):
            yield rows(TaskContext.get().partitionId(), r)

    def joined(key, table):
        return pa.Table.from_batches([rows(key[0].as_py(), np.linalg.qr(_matrix(table.column("row").combine_chunks()), mode="r"))])

    schema = "part bigint, row array<double>"
    level = stored(map_batches(fit.select("__x"), run, schema))
    while level.agg(F.max("part")).first()[0] > 0:
        more = stored(level.select(F.floor(F.col("part") / FAN).alias("part"), "row").groupBy("part").applyInArrow(joined, schema))
        discard(level)
        level = more
    r = np.array([x["row"] for x in level.collect()])
    discard(level)
    return np.vstack([r, np.zeros((max(0, width - len(r)), width))])


def _identity_error(fit: DataFrame, found: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    k = found.components.shape[1]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                w = found.whitened(found.offsets(_matrix(batch.column(0))))
                total = np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
                yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "total"])

    rows = map_batches(fit.select("__x"), run, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
    total = np.zeros(k + k * k)
    for r in rows:
        total[r["place"]] = r["total"]
    mean = total[:k] / found.n
    return float(np.abs(total[k:].reshape(k, k) / found.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def fit_whitening(numbers: DataFrame, components: int = 4) -> tuple[Whitening | None, int]:
    """Fits on the distinct vectors of whole_numbers(); also returns their width.

    Vectors of the commonest width count (of equally common ones the largest).  Directions without variance, as far as
    numbers tell, are left out; None if the table has no usable vector.
    """
    widths = numbers.groupBy(F.size("__x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if widths is None:
        return None, 0
    width = widths["width"]
    ship(numbers.sparkSession)
    fit = stored(numbers.where(F.size("__x") == width).select("__x").distinct())
    n, sums = _sums(fit, width)
    centre = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    r = _triangle(fit, centre, width)
    values, vectors = eigen(r, components)
    keep = np.sqrt(values) > 8 * width * EPS * np.sqrt(values[0])
    found = Whitening(n, sums, vectors[:, keep], values[keep] / n, float((r * r).sum() / n))
    found = Whitening(n, sums, found.components, found.values, found.trace, _identity_error(fit, found))
    discard(fit)
    return found, width


def whiten(numbers: DataFrame, found: Whitening | None, width: int, vec_id: str = "vec_id") -> DataFrame:
    """A row for each vector of whole_numbers() and component.

    Returns vec_id, component int (from 1), n long, deviation long (sum of (n x - sums)^2, exact; null beyond 64 bits),
    whitened double, explained double (share of the trace), identity_error double.  Repeated rows stay, a null id too.
    """
    kind = numbers.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if found is None or not len(found.values):
        return numbers.sparkSession.createDataFrame([], schema)
    k = len(found.values)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets = found.offsets(_matrix(batch.column(1)))
            m = len(offsets)
            if offsets.dtype == object or int(np.abs(offsets).max()) ** 2 * width >= SAFE:
                square = [int(s) for s in (offsets.astype(object) ** 2).sum(axis=1)]
                deviation = pa.array([s if s <= LAST else None for s in square], pa.int64())
            else:
                deviation = pa.array((offsets * offsets).sum(axis=1))
            again = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, found.n, np.int64)), deviation.take(again),
                pa.array(found.whitened(offsets).ravel()), pa.array(np.tile(found.values / found.trace, m)), pa.array(np.full(m * k, found.identity_error)),
            ]
            yield pa.record_batch(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_batches(numbers.where(F.size("__x") == width).select(vec_id, "__x"), run, schema)


def whitened(vectors: DataFrame, components: int = 4, vec_id: str = "vec_id", vec: str = "embedding", scale: int = 256) -> DataFrame:
    """Whitened vectors: see whole_numbers, fit_whitening and whiten.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped; so are those of another width than
    the commonest, which have no place in one covariance.  An empty table, or vectors that are all equal, give no rows.
    """
    numbers = whole_numbers(vectors.select(vec_id, vec), vec, scale)
    found, width = fit_whitening(numbers, components)
    return whiten(numbers, found, width, vec_id)
