"""Embedding whitening by principal components that FEAST contour integration extracts.

Entries become whole numbers, so counts, sums and (while they stay below 2^53) sums of centred products are exact and do
not depend on the order of tasks. Tasks add up sums and then a matrix of centred products each, Spark adds those by entry,
and the driver holds one matrix of the vectors' dimension. There a Householder reduction gives inertia counts at any
shift (signs of the pivots of an LDL' factorisation, Sylvester's law); bisection by these counts puts the ends of
eigenvalue intervals into gaps. For each interval a Gauss-Legendre rule over a circle round it sums complex shifted
solves, which projects a random block onto the interval's eigenvectors (Polizzi, 2009); a Rayleigh-Ritz step extracts them,
and the inertia count of the interval says how many there must be. At last the rows are projected.

Vectors that are null or hold null or non-finite entries go, and so do entries of 2^30 or more in size, which whole-number
arithmetic can't hold, and vectors of another length than most rows have (at a tie the shorter). A component of less
than 1e-12 of all variance can't be scaled to one and is left out, so equal vectors, a single one, vectors without
entries and an empty table give no rows. Repeated rows and null vec_ids count as rows. Where eigenvalues are equal any
basis of their space is right. ``deviation`` is null where it exceeds a long. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import record, save, slices, table

COMPONENTS, SCALE, SHIFT = 8, 1024, 100000
LARGEST, LEAST_SHARE = 2.0**30, 1e-12
#: Eigenvalues in an interval, points on its half circle, and rounds before their number doubles.
GROUP, POINTS, ROUNDS = 4, 8, 12


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squares beside it of a tridiagonal matrix with the eigenvalues of the symmetric ``a``."""
    a = a.copy()
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        size = math.sqrt(float(v @ v))
        if not size:
            continue
        v[0] += math.copysign(size, v[0])
        v /= math.sqrt(float(v @ v))
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
    return a.diagonal().copy(), a.diagonal(1).copy() ** 2


def above(reduced: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues exceed each shift: positive pivots of the factorised, shifted matrix."""
    diagonal, beside = reduced
    shifts = np.atleast_1d(shifts).astype(float)
    tiny = 1e-300 + 1e-30 * np.abs(diagonal).max(initial=0)
    count, pivot = np.zeros(len(shifts), np.int64), np.ones(len(shifts))
    for k, x in enumerate(diagonal):
        pivot = x - shifts - (beside[k - 1] / pivot if k else 0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot > 0
    return count


def bisected(reduced: tuple[np.ndarray, np.ndarray], k: int, top: float) -> np.ndarray:
    """The k largest eigenvalues, falling, by inertia counts alone, to about rounding."""
    low, high, rank = np.full(k, -top), np.full(k, top), np.arange(1, k + 1)
    for _ in range(70):
        at = (low + high) / 2
        more = above(reduced, at) >= rank
        low, high = np.where(more, at, low), np.where(more, high, at)
    return (low + high) / 2


def intervals(values: np.ndarray, k: int, least: float, top: float) -> list[tuple[float, float]]:
    """Open intervals that cover the k largest of the falling ``values``, of about ``GROUP`` each; their ends lie in gaps wider than ``least`` where there are any."""
    gaps = values[:-1] - values[1:]
    ends, at = [], 0
    while at < k:
        near = np.arange(at + 1, min(at + GROUP, len(gaps)) + 1)  # cut after so many values
        if at + GROUP >= k:
            near = np.arange(k, len(gaps) + 1)  # the last: the first gap from k on
        wide = near[gaps[near - 1] > least]
        if at + GROUP < k and not len(wide):
            near = np.arange(at + 1, len(gaps) + 1)
            wide = near[gaps[near - 1] > least][:1]
        if not len(wide):
            ends.append(-top)
            break
        cut = int(wide[0] if at + GROUP >= k else wide[gaps[wide - 1].argmax()])
        ends.append(float((values[cut - 1] + values[cut]) / 2))
        at = cut
    first = min(top, float(2 * values[0] - ends[0])) if ends[0] > -top else top  # a circle no wider than it need be
    return list(zip(ends, [first, *ends[:-1]]))


def feast(a: np.ndarray, low: float, high: float, wanted: int, seed: int = 0) -> np.ndarray:
    """Unit eigenvectors, as columns, of the ``wanted`` eigenvalues of symmetric ``a`` between low and high."""
    size, points = len(a), POINTS
    good = 64 * np.finfo(float).eps * np.abs(a).sum(axis=1).max()
    block = np.random.default_rng(seed).normal(size=(size, min(size, max(2 * wanted, wanted + 8))))
    for k in range(6 * ROUNDS):
        if k and k % ROUNDS == 0:
            points *= 2
        nodes, weights = np.polynomial.legendre.leggauss(points)
        turn = (high - low) / 2 * np.exp(0.5j * np.pi * (1 + nodes))
        ahead = np.zeros_like(block)
        for t, w in zip(turn, weights):
            shifted = -a.astype(complex)
            shifted[np.diag_indices(size)] += (low + high) / 2 + t
            ahead += w / 2 * (t * np.linalg.solve(shifted, block)).real
        basis, share, _ = np.linalg.svd(ahead, full_matrices=False)
        basis = basis[:, share > 1e-14 * share[0]]
        ritz, inner = np.linalg.eigh(basis.T @ a @ basis)
        block = basis @ inner
        inside = (ritz > low) & (ritz < high)
        off = np.linalg.norm(a @ block[:, inside] - block[:, inside] * ritz[inside], axis=0)
        if inside.sum() == wanted and (off <= good).all():
            return block[:, inside]
    raise ArithmeticError(f"{wanted} eigenvalues between {low} and {high}: the contour found {int(inside.sum())}")


def components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to k largest eigenvalues, falling, of a covariance, and their unit eigenvectors as columns; those of no variance are left out."""
    trace = float(np.trace(a))
    if not len(a) or not trace > 0:
        return np.zeros(0), np.zeros((len(a), 0))
    a = a / trace
    reduced = tridiagonal(a)
    k = min(k, int(above(reduced, LEAST_SHARE)[0]))
    top = 1.0 + np.abs(a).sum(axis=1).max()
    values = bisected(reduced, len(a), top)
    found = []
    for low, high in intervals(values, k, 1e-10 * values[0], top):
        many = above(reduced, np.array([low, high]))
        found.append(feast(a, low, high, int(many[0] - many[1])))
    basis, _ = np.linalg.qr(np.concatenate(found, axis=1))
    ritz, inner = np.linalg.eigh(basis.T @ a @ basis)
    order = np.argsort(-ritz)[:k]
    return ritz[order] * trace, basis @ inner[:, order]


def _whole(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The entries of a batch of vectors of one length, as x."""
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.floor(SCALE * v).astype(np.int64) + SHIFT


def _sums(rows: DataFrame) -> tuple[int, int, list[int]]:
    """The length that most rows have, how many do, and the sums of x by dimension."""
    schema = pa.schema([("dim", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("s", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for b in slices(batches, 4096):
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                x = _whole(b.filter(pa.array(dims == d)), d)
                n, s = held.get(d, (0, 0))
                held[d] = (n + len(x), s + x.sum(axis=0))
        for d, (n, s) in held.items():
            yield record(schema, np.full(d, d, np.int32), np.arange(d, dtype=np.int32), np.full(d, n), s)

    parts = rows.mapInArrow(run, "dim int, at int, n long, s long")
    sums = save(parts.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s")), "sums")
    first = sums.where("at = 0").orderBy(F.desc("n"), "dim").first()
    if first is None:
        return 0, 0, []
    return first["dim"], first["n"], [int(r["s"]) for r in sums.where(F.col("dim") == first["dim"]).orderBy("at").collect()]


def _products(rows: DataFrame, dim: int, near: np.ndarray) -> np.ndarray:
    """Sums of products of entries less ``near``. Whole numbers: exact in any order while below 2^53."""
    i, j = np.triu_indices(dim)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in slices(batches, 4096):
            y = (_whole(b, dim) - near).astype(np.float64)
            total += y.T @ y
        yield record(schema, i.astype(np.int32), j.astype(np.int32), total[i, j])

    out = np.zeros((dim, dim))
    for r in rows.mapInArrow(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).toLocalIterator():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["p"]
    return out


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """(vec_id, embedding) to a row for each remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim")).where(v.isNotNull() & sound & (F.size(v) > 0))
    dim, n, sums = _sums(rows)
    near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # the nearest whole number to each mean
    rest = [s - n * int(m) for s, m in zip(sums, near)]
    mean = np.array([r / n for r in rest])
    rows = rows.where(F.col("dim") == dim)
    spread = _products(rows, dim, near) / n - np.outer(mean, mean) if n else np.zeros((0, 0))
    values, axes = components(spread, k)
    scaled = axes / np.sqrt(values)
    schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("w", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            y = _whole(b, dim) - near
            about = n * y.astype(np.float64) - np.array(rest, np.float64)
            fits = (about * about).sum(axis=1) < 2.0**62
            off = n * np.where(fits[:, None], y, 0) - np.array(rest, np.int64)
            sized = [int(s) if f else _deviation(n, r, rest) for s, f, r in zip((off * off).sum(axis=1), fits, y)]
            w = (y - mean) @ scaled
            lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), w.ravel()) if w.size else pa.array([[]] * len(w), pa.list_(pa.float64()))
            yield record(schema, b.column("vec_id"), sized, lists)

    found = save(rows.select("vec_id", "v").mapInArrow(run, "vec_id long, deviation long, w array<double>"), "whitened")
    pairs = [(a, b) for a in range(len(values)) for b in range(a, len(values))]
    error = 0.0
    if pairs:
        got = found.agg(*[F.covar_pop(F.col("w")[a], F.col("w")[b]) for a, b in pairs]).first()
        error = max(abs(c - (a == b)) for c, (a, b) in zip(got, pairs))
    shares = F.array(*[F.lit(float(e / np.trace(spread))) for e in values]).cast("array<double>")
    parts = found.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return parts.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )


def _deviation(n: int, y: np.ndarray, rest: list[int]) -> int | None:
    """In Python's whole numbers; None where no long holds it."""
    size = sum((n * int(a) - r) ** 2 for a, r in zip(y, rest))
    return size if size < 2**63 else None


def op11_feast_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
