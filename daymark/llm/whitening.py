"""Whitening of embeddings on exact covariances, by a bit-sliced scatter.

A component c becomes the integer x = floor(64 * c) + 1000000. The fit list holds each distinct x vector once. Its covariance is exact until
the eigenvectors are taken:

1. A task packs its vectors into bit planes, in blocks of ``PLANE_BYTES``: a block shifts each dimension by its least value, and each
   bit of the shifted values is a plane of 64 rows a word.
2. The sum over rows of y_i * y_j is the sum over bits a of i and b of j of 2**(a + b) * popcount(plane_ia & plane_jb). The shifts are
   added back in integers, and a task sends one number for each pair of dimensions.
3. n * sum(x_i * x_j) - S_i * S_j is n squared times the covariance, centred as integers. It is divided once, correctly rounded, and
   eigh gives the components.

``identity_error`` is measured, not derived: a pass over the fit list sums the outer products of the whitened vectors.

Scale: two passes over the distinct vectors and one over the rows. Tasks send dims * dims / 2 numbers; the driver holds sums and
components of each vector length, never rows. Equal vectors meet by a hash of themselves with partial aggregation, so a
vector that very many rows hold is no heavier than another. Vectors of different lengths are fitted apart; lengths are taken to be few.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry are left out, other rows stay, repeated ones and those without an
id included. A length below 16 has as many components. A component whose eigenvalue is zero to double precision has a null ``whitened``
(a single distinct vector, constant dimensions) and no part in ``identity_error``. Without variance ``explained`` is zero.
``deviation`` is null where it exceeds a long. An entry whose integer exceeds 2**46 is refused. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.llm.common import map_arrow, table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
PLANE_BYTES, BLOCK_ROWS = 1 << 24, 1 << 16
LARGEST = 1 << 46
NUMBER = pa.decimal128(38, 0)


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, z): z is the integer vector without its constant offset, so its entries are small."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    out = vectors.select(F.col("vec_id").cast("long"), x.alias("v")).where("v is not null").where(fine)
    small = F.when(F.forall("v", lambda c: F.abs(c) * SCALE <= LARGEST), F.transform("v", lambda c: F.floor(c * SCALE).cast("long")))
    return out.select("vec_id", F.coalesce(small, F.raise_error(F.lit("a component is too large for exact sums")).cast("array<bigint>")).alias("z"))


def matrix(column: pa.ListArray) -> list[np.ndarray]:
    """The vectors of an Arrow list column as integer matrices, one for each length, with their row numbers."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, flat[starts[rows][:, None] + np.arange(size)[None, :]].astype(np.int64)))
    return out


def planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words [plane, word], dimension of each plane, bit of each plane) of non-negative integers [row, dimension]."""
    rows, dims = shifted.shape
    bits = [int(v).bit_length() for v in shifted.max(axis=0, initial=0)]
    which = np.repeat(np.arange(dims), bits)
    bit = np.concatenate([np.arange(b) for b in bits]).astype(np.int64) if which.size else np.zeros(0, np.int64)
    words = np.zeros((len(which), -(-rows // 64) * 8), np.uint8)
    for at, (d, b) in enumerate(zip(which, bit)):
        packed = np.packbits((shifted[:, d] >> b & 1).astype(np.uint8))
        words[at, : len(packed)] = packed
    return words.view(np.uint64), which, bit


def cross_products(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, cross) of integers [row, dimension] as Python integers: sums over rows of z_i and of z_i * z_j."""
    rows, dims = z.shape
    shift = z.min(axis=0) if rows else np.zeros(dims, np.int64)
    words, which, bit = planes(z - shift)
    power = np.array([1 << int(b) for b in bit], object)
    count = len(which)
    both = np.zeros((dims, dims), object)
    alone = np.zeros(dims, object)
    for p in range(count):
        shared = np.bitwise_count(words[p] & words[p:]).sum(axis=1, dtype=np.int64)
        alone[which[p]] += power[p] * int(shared[0])
        weighted = power[p] * power[p:] * shared.astype(object)
        weighted[1:] *= 2 - (which[p + 1 :] != which[p]).astype(object)  # two planes of one dimension meet twice
        first = np.flatnonzero(np.r_[True, np.diff(which[p:]) > 0])
        both[which[p], which[p:][first]] += np.add.reduceat(weighted, first)
    both = np.triu(both) + np.triu(both, 1).T
    m = np.array([int(v) for v in shift], object)
    cross = both + np.outer(m, alone) + np.outer(alone, m) + rows * np.outer(m, m)
    return alone + rows * m, cross


def scatter(distinct: DataFrame) -> DataFrame:
    """(size, i, j, value) summed over the vectors z: i = j = -1 the rows, j = -1 the sums, i <= j the cross-products."""

    def work(batches):
        waiting: dict[int, list[np.ndarray]] = {}
        totals: dict[int, list] = {}

        def fold(size: int):
            z = np.concatenate(waiting.pop(size))
            sums, cross = cross_products(z)
            total = totals.setdefault(size, [0, 0, 0])
            for i, value in enumerate((len(z), sums, cross)):
                total[i] = total[i] + value

        for batch in batches:
            for _, z in matrix(batch.column(0)):
                size = z.shape[1]
                waiting.setdefault(size, []).append(z)
                # Bits are not known before the shift; sixteen a dimension are allowed for.
                if sum(map(len, waiting[size])) >= min(BLOCK_ROWS, max(512, PLANE_BYTES // max(1, 2 * size))):
                    fold(size)
        for size in list(waiting):
            fold(size)
        for size, (rows, sums, cross) in totals.items():
            i, j = np.triu_indices(size)
            left = [-1] + [-1] * size + i.tolist()
            right = [-1] + list(range(size)) + j.tolist()
            values = [rows, *sums, *cross[i, j]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * len(left), pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array([Decimal(int(v)) for v in values], NUMBER)],
                ["size", "i", "j", "value"])

    made = map_arrow(distinct.select("z"), work, "size int, i int, j int, value decimal(38,0)")
    return made.groupBy("size", "i", "j").agg(F.sum("value").cast("decimal(38,0)").alias("value"))


class Fit:
    """Sums and components of one vector length."""

    def __init__(self, size: int, values: dict[tuple[int, int], int]):
        self.n = values[-1, -1]
        self.sums = [values[-1, j] for j in range(size)]  # of z: x without its offset
        covariance = np.array([[(self.n * values[min(i, j), max(i, j)] - self.sums[i] * self.sums[j]) / self.n**2 for j in range(size)] for i in range(size)], np.float64).reshape(size, size)
        found, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-found, kind="stable")[:COMPONENTS]
        trace = float(np.trace(covariance))
        self.values = np.maximum(found[order], 0.0)
        self.vectors = vectors[:, order]
        self.explained = self.values / trace if trace > 0 else np.zeros(len(order))
        self.real = self.values > trace * max(size, 1) * np.finfo(np.float64).eps
        self.error = 0.0

    def centred(self, z: np.ndarray) -> np.ndarray:
        """n * x - S as integers; int64 where that is large enough."""
        bound = (int(np.abs(z).max(initial=0)) * self.n + max(map(abs, self.sums), default=0))
        kind = np.int64 if bound < 2**62 else object
        return z.astype(kind) * kind(self.n) - np.array(self.sums, kind) if kind is np.int64 else z.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, off: np.ndarray) -> np.ndarray:
        """Projection of (x - S / n) on the components over the square root of their eigenvalues; NaN where that is zero."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (off.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)
        out[:, ~self.real] = np.nan
        return out


def deviations(off: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None beyond a long."""
    if not off.size:
        return [0] * len(off)
    if off.dtype == np.int64 and float(np.abs(off).max()) ** 2 * off.shape[1] < 2**62:
        return (off * off).sum(axis=1).tolist()
    return [v if (v := sum(int(c) ** 2 for c in row)) < 2**63 else None for row in off]


def fitted(distinct: DataFrame) -> dict[int, Fit]:
    """The fits of all vector lengths, with the measured error of their whitened vectors."""
    sums: dict[int, dict] = {}
    for r in scatter(distinct).collect():  # dims * dims / 2 numbers a length
        sums.setdefault(r["size"], {})[r["i"], r["j"]] = int(r["value"])
    fits = {size: Fit(size, values) for size, values in sums.items()}
    sent = distinct.sparkSession.sparkContext.broadcast(fits)

    def outer(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, z in matrix(batch.column(0)):
                fit = sent.value[z.shape[1]]
                w = np.nan_to_num(fit.whitened(fit.centred(z)))
                w = np.column_stack([w, np.ones(len(w))])  # the last row and column are the sums
                total[z.shape[1]] = total.get(z.shape[1], 0.0) + w.T @ w
        for size, value in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * value.size, pa.int32()), pa.array(range(value.size), pa.int32()), pa.array(value.ravel())], ["size", "cell", "value"])

    for r in map_arrow(distinct.select("z"), outer, "size int, cell int, value double").groupBy("size", "cell").agg(F.sum("value").alias("value")).collect():
        fit = fits[r["size"]]
        width = len(fit.values) + 1
        sums.setdefault(("w", r["size"]), np.zeros((width, width)))[divmod(r["cell"], width)] = r["value"]
    for size, fit in fits.items():
        moment = sums.get(("w", size))
        if moment is not None and fit.real.any():
            mean = moment[:-1, -1] / fit.n
            off = moment[:-1, :-1] / fit.n - np.outer(mean, mean) - np.eye(len(mean))
            fit.error = float(np.abs(off[np.ix_(fit.real, fit.real)]).max())
    return fits


def whiten(vectors: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row for each remaining row of
    ``vectors`` (vec_id, embedding) and component, from 1 by falling eigenvalue."""
    rows = table(integers(vectors), "integer-vectors")
    distinct = table(rows.select("z").distinct(), "fit-list")
    sent = vectors.sparkSession.sparkContext.broadcast(fitted(distinct))
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches):
        for batch in batches:
            for at, z in matrix(batch.column(1)):
                fit, k = sent.value[z.shape[1]], len(sent.value[z.shape[1]].values)
                off, ids = fit.centred(z), batch.column(0).take(pa.array(at))
                each = np.repeat(np.arange(len(z)), k)
                white = fit.whitened(off).ravel()
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))), pa.array([fit.n] * len(each), pa.int64()),
                    pa.array(deviations(off), pa.int64()).take(pa.array(each)), pa.array(white, mask=np.isnan(white)),
                    pa.array(np.tile(fit.explained, len(z))), pa.array([fit.error] * len(each), pa.float64())], names)

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return map_arrow(rows.select("vec_id", "z"), project, schema)
