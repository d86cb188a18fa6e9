"""Embedding whitening by bit-sliced scatter.

Entries become integers x = floor(256 c). The fit list holds every distinct integer vector once. Tasks take it in
blocks of BLOCK rows, shift each dimension by its least value in the block, and pack every bit plane of every
dimension across rows into 64-bit words. The popcount of the AND of two planes, weighted by 2 to the sum of their
places, adds up to the exact cross-products of the shifted values; the shift is then undone in integers. A block has
its own shift and its own number of planes, so one pass over the fit list is enough. Spark adds the cross-products of
all tasks as decimal(38, 0); d (d + 1) / 2 of them, whatever the number of rows, reach the driver, which centres them
as integers, n (n G - S S'), and only then goes to doubles for the eigenvectors.

Rows without a vector, or with null or non-finite entries, are dropped; a shorter vector counts as one with zeros
behind it. Null and repeated ids are rows like others. A component without variance is left out, so one distinct
vector, or none, gives no rows. Only the id and the vector are read; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near import kept_table

BLOCK = 4096
SCALE = 256


def quantised(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and x, the integer vector, of rows whose entries are all finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & ~bad).select(
        F.col(vec_id).alias("vec_id"), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))


def matrix(column: pa.ListArray, d: int | None = None) -> np.ndarray:
    """Rows of an integer list column, with zeros behind shorter ones."""
    sizes = np.diff(column.offsets.to_numpy())
    d = int(sizes.max(initial=0)) if d is None else d
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == d).all():
        return flat.reshape(len(sizes), d)
    out = np.zeros((len(sizes), d), dtype=np.int64)
    out[np.arange(d) < sizes[:, None]] = flat
    return out


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (plane, word), and the dimension and place of each plane, of unsigned values (row, dimension)."""
    n, d = y.shape
    y = np.concatenate([y, np.zeros((-n % 64, d), dtype=np.uint64)])
    top = [int(v).bit_length() for v in y.max(axis=0, initial=0)]
    words, dims, places = [], [], []
    for place in range(max(top, default=0)):
        at = np.array([i for i in range(d) if top[i] > place])
        bits = ((y[:, at] >> np.uint64(place)) & np.uint64(1)).astype(np.uint8)
        words.append(np.ascontiguousarray(np.packbits(bits, axis=0).T).view(np.uint64))
        dims.append(at)
        places.append(np.full(len(at), place))
    if not words:
        return np.zeros((0, len(y) // 64), dtype=np.uint64), np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    return np.concatenate(words), np.concatenate(dims), np.concatenate(places)


def weighted_counts(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of products (d, d) and sums (d) of unsigned values, by popcounts of planes."""
    words, dims, places = bit_planes(y)
    pairs = np.zeros((len(words), len(words)), dtype=np.int64)
    for p in range(len(words)):
        pairs[p, p:] = pairs[p:, p] = np.bitwise_count(words[p] & words[p:]).sum(axis=1, dtype=np.int64)
    # products stay below 2 to the number of bits here; Python integers where 63 bits might not do
    wide = 2 * int(places.max(initial=0)) + 2 + len(y).bit_length() > 62
    weights = np.zeros((len(words), y.shape[1]), dtype=object if wide else np.int64)
    for p, (i, place) in enumerate(zip(dims, places)):
        weights[p, i] = 1 << int(place)
    pairs = pairs.astype(weights.dtype)
    return weights.T @ pairs @ weights, weights.T @ np.diag(pairs)


def block_moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact cross-products and sums of signed values, as Python integers."""
    low = x.min(axis=0)
    # the difference of two 64-bit values is right modulo 2 to the 64
    product, total = (v.astype(object) for v in weighted_counts((x - low).view(np.uint64)))
    low, n = low.astype(object), len(x)
    cross = np.multiply.outer(total, low)
    return product + cross + cross.T + n * np.multiply.outer(low, low), total + n * low


def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, v): cross-products for i <= j, sums as (i, -1), rows as (-1, -1)."""
    n, product, total = 0, np.zeros((0, 0), dtype=object), np.zeros(0, dtype=object)
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            x = matrix(batch.column("x").slice(at, BLOCK))
            n += len(x)
            if not x.shape[1]:
                continue
            g, s = block_moments(x)
            more = len(s) - len(total)
            if more > 0:
                product, total = np.pad(product, (0, more), constant_values=0), np.pad(total, (0, more), constant_values=0)
            product[:len(s), :len(s)] += g
            total[:len(s)] += s
    i, j = np.triu_indices(len(total))
    d = np.arange(len(total))
    v = [n, *total, *product[i, j]]
    yield pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([[-1], d, i]), pa.int32()), pa.array(np.concatenate([[-1], np.full(len(d), -1), j]), pa.int32()),
        pa.array([Decimal(int(c)) for c in v], pa.decimal128(38, 0))], names=["i", "j", "v"])


@dataclass(frozen=True)
class Whitening:
    """n rows with integer sums; one column of `weights` per component, scaled to variance 1; explained shares."""

    n: int
    sums: tuple[int, ...]
    weights: np.ndarray
    explained: tuple[float, ...]

    def project(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Exact sums of squares of n x - S, and the whitened values."""
        most = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 1 << 62 else object
        centred = self.n * x.astype(kind) - np.array(self.sums, dtype=kind)
        exact = centred if most * most * max(1, x.shape[1]) < 1 << 62 else centred.astype(object)
        return [int(v) for v in (exact * exact).sum(axis=1)], (centred / self.n).astype(np.float64) @ self.weights


def fit(vectors: DataFrame, components: int = 4) -> Whitening:
    """Whitening of the distinct integer vectors (x): exact moments on Spark, eigenvectors of a d x d matrix here."""
    got = vectors.select("x").mapInArrow(moments, "i int, j int, v decimal(38, 0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    value = {(r.i, r.j): int(r.v) for r in got}
    n, d = value.get((-1, -1), 0), 1 + max((i for i, _ in value), default=-1)
    sums = [value[i, -1] for i in range(d)]
    # n^2 times the covariance, exactly; each quotient is rounded once
    scatter = [[n * value[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    if not any(scatter[i][i] for i in range(d)):
        return Whitening(n, tuple(sums), np.zeros((d, 0)), ())
    cov = np.array([[v / (n * n) for v in row] for row in scatter])
    trace = sum(scatter[i][i] for i in range(d)) / (n * n)
    e, u = np.linalg.eigh(cov)
    order = [i for i in np.argsort(-e, kind="stable")[:components] if e[i] > d * trace * 1e-14]
    u = u[:, order]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return Whitening(n, tuple(sums), u / np.sqrt(e[order]), tuple(float(v / trace) for v in e[order]))


def projected(rows: DataFrame, model: Whitening) -> DataFrame:
    """x of each row is replaced by deviation decimal(38, 0) and w array<double>."""
    rest = [c for c in rows.columns if c != "x"]

    def run(batches):
        for b in batches:
            deviation, w = model.project(matrix(b.column("x"), len(model.sums)))
            w = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0)), w],
                                             names=[*rest, "deviation", "w"])

    schema = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest]
    return rows.mapInArrow(run, ", ".join([*schema, "deviation decimal(38, 0)", "w array<double>"]))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = len(model.explained)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    if not pairs:
        return 0.0
    got = projected(vectors.select("x"), model).agg(*[F.covar_pop(F.col("w")[a], F.col("w")[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(got[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """One row for each remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    x = quantised(rows, vec_id, vector)
    distinct = kept_table(x.select("x").distinct())
    model = fit(distinct, components)
    error = identity_error(distinct, model)
    out = projected(x, model).select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    share = F.array(*[F.lit(v) for v in model.explained]).cast("array<double>")
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
                      F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
