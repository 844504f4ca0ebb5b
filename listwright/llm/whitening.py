"""Whitening of vectors: a bit-sliced scatter matrix, exact in integers, and its eigenvectors.

Components become whole numbers. Shifted by the least value of its dimension, each number is a
few bits; a plane holds one bit of one dimension for 64 rows a word. The cross-product of two
dimensions is then the number of ones in the AND of each two of their planes, weighted by the
powers of two. Counts are whole numbers, so sums over tasks are exact in any order, and the
centred matrix n * sum(xy) - sum(x) * sum(y) is worked out in whole numbers before a single
division per entry and the eigenvectors.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from listwright.llm.frames import shipped, staged
from listwright.llm.vectors import integers

CHUNK = 8192
# Counts of planes whose weights lie within so many powers of two go into one sum: a long
# holds it for 2**36 rows.
SPAN = 20
_LONG = np.iinfo(np.int64)


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    components: int = 4


@dataclass(frozen=True)
class Model:
    """What whitens vectors of one length: ``axes`` has a row per component."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variance: np.ndarray
    explained: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) - self.mean) @ self.axes.T / np.sqrt(self.variance)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)**2, exact; None where a long does not hold it."""
        far = max((abs(self.n * int(v) - s) for col, s in zip(x.T, self.sums, strict=True) for v in (col.min(), col.max())), default=0)
        if far * far * x.shape[1] <= _LONG.max:
            d = self.n * x - np.array(self.sums, np.int64)
            return np.einsum("ij,ij->i", d, d).tolist()
        d = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v <= _LONG.max else None for v in (d * d).sum(axis=1)]


def whole_vectors(vectors: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``(vec_id, x)``: rows whose vector is not null and finite throughout, as whole numbers."""
    real = F.col("embedding").cast("array<double>")
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select("vec_id", real.alias("v")).filter(F.coalesce(F.col("v").isNotNull() & whole, F.lit(False)))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * cfg.scale).cast("long")).alias("x"))


def _ranges(fit: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Least and greatest value of each dimension, by vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for _, x in integers(batch.column(0)):
                low, high = x.min(axis=0), x.max(axis=0)
                if x.shape[1] in held:
                    low, high = np.minimum(low, held[x.shape[1]][0]), np.maximum(high, held[x.shape[1]][1])
                held[x.shape[1]] = low, high
        for dim, (low, high) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(dim, dim)), pa.array(np.arange(dim)), pa.array(low), pa.array(high)],
                ["dim", "i", "low", "high"])

    part = fit.select("x").transform(shipped).mapInArrow(run, "dim long, i long, low long, high long")
    found = part.groupBy("dim", "i").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in found:
        low, high = out.setdefault(r["dim"], (np.zeros(r["dim"], np.int64), np.zeros(r["dim"], np.int64)))
        low[r["i"]], high[r["i"]] = r["low"], r["high"]
    return out


def planes(x: np.ndarray, low: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bit planes of shifted rows, dimension after dimension, low bit first: 64 rows a word."""
    n = len(x)
    shifted = np.ascontiguousarray(x.T).view(np.uint64) - low.view(np.uint64)[:, None]
    out = np.zeros((int(bits.sum()), (n + 63) // 64 * 8), np.uint8)
    first = np.cumsum(bits) - bits
    for a in range(int(bits.max(initial=0))):
        having = np.flatnonzero(bits > a)
        ones = ((shifted[having] >> np.uint64(a)) & np.uint64(1)).astype(np.uint8)
        out[first[having] + a, : (n + 7) // 8] = np.packbits(ones, axis=1)
    return out.view(np.uint64)


class Scatter:
    """Sums over the rows of one length: ``sums[part][i]`` and ``products[part][i, j]`` for j >= i.

    The value of a part counts 2**(SPAN * part).
    """

    def __init__(self, low: np.ndarray, high: np.ndarray):
        spread = high.view(np.uint64) - low.view(np.uint64)
        self.low = low
        self.bits = np.array([max(1, int(s).bit_length()) for s in spread], np.int64)
        self.first = np.cumsum(self.bits) - self.bits
        self.level = np.concatenate([np.arange(b) for b in self.bits])
        dim, parts = len(low), (2 * int(self.bits.max()) - 2) // SPAN + 1
        self.rows = 0
        self.sums = np.zeros((parts, dim), np.int64)
        self.products = np.zeros((parts, dim, dim), np.int64)

    def add(self, x: np.ndarray) -> None:
        for lo in range(0, len(x), CHUNK):
            self._add(planes(x[lo : lo + CHUNK], self.low, self.bits), len(x[lo : lo + CHUNK]))

    def _add(self, plane: np.ndarray, rows: int) -> None:
        self.rows += rows
        ones = np.bitwise_count(plane).sum(axis=1, dtype=np.int64)
        for part, at in self._parts(self.level):
            np.add.at(self.sums[part], np.searchsorted(self.first, at, "right") - 1, ones[at] << (self.level[at] - part * SPAN))
        for i, begin in enumerate(self.first.tolist()):
            beyond, cuts = self.level[begin:], self.first[i:] - begin
            for a in range(int(self.bits[i])):
                both = np.bitwise_count(plane[begin + a] & plane[begin:]).sum(axis=1, dtype=np.int64)
                for part, at in self._parts(beyond + a):
                    weighed = np.zeros(len(both), np.int64)
                    weighed[at] = both[at] << (beyond[at] + a - part * SPAN)
                    self.products[part, i, i:] += np.add.reduceat(weighed, cuts)

    @staticmethod
    def _parts(power: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        part = power // SPAN
        for p in range(int(part.min()), int(part.max()) + 1):
            yield p, np.flatnonzero(part == p)

    def batch(self) -> pa.RecordBatch:
        dim = len(self.low)
        i, j = np.triu_indices(dim)
        rows = [(np.array([-1]), np.array([-1]), 0, np.array([self.rows]))]
        for part in range(len(self.products)):
            rows.append((np.arange(dim), np.full(dim, -1), part, self.sums[part]))
            rows.append((i, j, part, self.products[part][i, j]))
        put = lambda k: pa.array(np.concatenate([r[k] for r in rows]).astype(np.int64))
        parts = np.concatenate([np.full(len(r[0]), r[2], np.int64) for r in rows])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(parts), dim, np.int64)), put(0), put(1), pa.array(parts), put(3)],
            ["dim", "i", "j", "part", "value"])


def _scatter(fit: DataFrame, ranges: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """``n``, sums and sums of products of the shifted numbers, by vector length, as Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Scatter] = {}
        for batch in batches:
            for _, x in integers(batch.column(0)):
                dim = x.shape[1]
                if dim not in held:
                    held[dim] = Scatter(*ranges[dim])
                held[dim].add(x)
        for own in held.values():
            yield own.batch()

    part = fit.select("x").transform(shipped).mapInArrow(run, "dim long, i long, j long, part long, value long")
    summed = part.groupBy("dim", "i", "j", "part").agg(F.sum("value").alias("value"))
    count: dict[int, int] = {}
    sums: dict[int, list[int]] = defaultdict(list)
    products: dict[int, list[list[int]]] = defaultdict(list)
    for dim in ranges:
        sums[dim], products[dim] = [0] * dim, [[0] * dim for _ in range(dim)]
    for r in summed.collect():
        dim, i, j, value = r["dim"], r["i"], r["j"], r["value"] << (SPAN * r["part"])
        if i < 0:
            count[dim] = value
        elif j < 0:
            sums[dim][i] += value
        else:
            products[dim][i][j] += value
    return {dim: (count[dim], sums[dim], products[dim]) for dim in ranges}


def solved(n: int, low: list[int], sums: list[int], products: list[list[int]], most: int) -> Model:
    """The model of one length, from sums of numbers shifted by ``low``."""
    dim = len(sums)
    cov = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            cov[i, j] = cov[j, i] = (n * products[i][j] - sums[i] * sums[j]) / (n * n)
    trace = sum(n * products[i][i] - sums[i] * sums[i] for i in range(dim)) / (n * n)
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value, kind="stable")[:most]
    order = order[value[order] > trace * dim * np.finfo(float).eps]
    axes = vector[:, order].T
    # Of the two signs, the one in which the entry of largest size is positive.
    if len(axes):
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    shifted = [s + n * m for s, m in zip(sums, low, strict=True)]
    return Model(n, shifted, axes, value[order], value[order] / trace if trace else value[order])


def fitted(fit: DataFrame, cfg: Settings = Settings()) -> dict[int, Model]:
    """A model for each vector length of ``fit(x)``, each of whose rows counts once.

    What comes back to the driver is a row per pair of dimensions, however many rows there are.
    """
    ranges = _ranges(fit)
    return {
        dim: solved(n, ranges[dim][0].tolist(), sums, products, cfg.components)
        for dim, (n, sums, products) in _scatter(fit, ranges).items()
    }


def identity_errors(fit: DataFrame, models: dict[int, Model], cfg: Settings = Settings()) -> dict[int, float]:
    """Largest entry of the whitened vectors' covariance minus the identity, by vector length.

    Spark's ``covar_pop`` centres before it multiplies.
    """
    k = cfg.components
    names = [f"w{c}" for c in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in integers(batch.column(0)):
                own = models[x.shape[1]].whitened(x)
                out = np.zeros((len(rows), k))
                out[:, : own.shape[1]] = own
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), x.shape[1])), *(pa.array(out[:, c]) for c in range(k))], ["dim", *names])

    white = fit.select("x").transform(shipped).mapInArrow(run, "dim long, " + ", ".join(f"{c} double" for c in names))
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    found = white.groupBy("dim").agg(*(F.covar_pop(names[a], names[b]).alias(f"c{a}_{b}") for a, b in pairs)).collect()
    return {
        r["dim"]: max((abs(r[f"c{a}_{b}"] - (a == b)) for a, b in pairs if b < len(models[r["dim"]].variance)), default=0.0)
        for r in found
    }


def whitened(vectors: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row per vector and component.

    Rows of ``vectors(vec_id, embedding)`` whose vector is null or holds null or non-finite
    entries are dropped; an entry c becomes floor(scale * c). The covariance is that of the
    distinct whole-number vectors, so a vector counts once however often it stands, and equal
    rows, or rows that repeat a vec_id or lack one, come back one by one. Vectors of different
    lengths are fitted apart. Directions without variance (one distinct vector, fewer dimensions
    than components) have no rows, so an empty table gives none. ``deviation`` is null where a
    long does not hold it. Other columns are not looked at. Entries of 2**63 / scale and more
    count as the greatest long.
    """
    rows = whole_vectors(vectors, cfg)
    fit = staged(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "whole-vectors")
    models = fitted(fit, cfg)
    errors = identity_errors(fit, models, cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in integers(batch.column(1)):
                model = models[x.shape[1]]
                k = len(model.variance)
                if not k:
                    continue
                each = np.repeat(at, k)
                tiled = lambda v: np.tile(v, len(at))
                own = pa.array(model.deviation(x), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(each)), pa.array(tiled(np.arange(1, k + 1, dtype=np.int32))),
                     pa.array(np.full(len(each), model.n)), own.take(pa.array(np.repeat(np.arange(len(at)), k))),
                     pa.array(model.whitened(x).ravel()), pa.array(tiled(model.explained)),
                     pa.array(np.full(len(each), errors[x.shape[1]]))], out.names)

    out = StructType([
        StructField("vec_id", rows.schema["vec_id"].dataType), StructField("component", IntegerType()),
        StructField("n", LongType()), StructField("deviation", LongType()), StructField("whitened", DoubleType()),
        StructField("explained", DoubleType()), StructField("identity_error", DoubleType())])
    return rows.transform(shipped).mapInArrow(run, out)
