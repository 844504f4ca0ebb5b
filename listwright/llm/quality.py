"""Quality classifier: kernel ridge over document statistics by random Fourier features.

A text becomes a few statistics, and cosines of random projections of them stand for a
Gaussian kernel. Each partition sums its part of the normal equations, the sums are added up in
two steps, and one small system gives the ridge weights. Isotonic regression over a bounded
table of score bins turns scores into chances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from listwright.llm.bytescan import LOWER, Words, texts
from listwright.llm.frames import shipped, staged

STATISTICS = (
    "log_words", "word_bytes", "upper", "digits", "marks", "shouts", "bars", "symbols", "other_bytes",
    "marked_words", "bare_marks", "repeats", "near_repeats", "distinct", "log_lines", "stops",
)


@dataclass(frozen=True)
class Settings:
    """``width`` is the kernel's width over standardised statistics, ``bins`` the number of score bins."""

    features: int = 256
    width: float = 3.0
    ridge: float = 1e-3
    bins: int = 2000
    groups: int = 16
    seed: int = 10


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray
    chances: np.ndarray


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set("0123456789")
_MARK = _set("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
_SYMBOL, _SHOUT, _BAR, _LINE, _STOP = _set("#$%&*@^~<>{}[]\\=+_"), _set("!"), _set("|"), _set("\n"), _set(".?!")


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, statistics); an empty text has zeros."""
    w = Words(data, off)
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    words = np.diff(w.bound)
    safe = np.maximum(words, 1)

    def bytes_in(kind: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(kind[data])])[off])

    def words_in(flag: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag)])[w.bound])

    stop = w.stop.copy()
    for _ in range(4):
        some = (stop > w.start) & _MARK[data[stop - 1]]
        stop[some] -= 1
    ends = w.stop - stop
    plain = Words(LOWER[data], off).hashes(w.start, stop)
    again, again2 = np.zeros(len(plain), bool), np.zeros(len(plain), bool)
    again[1:] = plain[1:] == plain[:-1]
    again2[2:] = plain[2:] == plain[:-2]
    first = w.bound[:-1][words > 0]
    again[first] = False
    again2[first] = False
    distinct = np.array([len(np.unique(plain[a:b])) for a, b in zip(w.bound[:-1], w.bound[1:], strict=True)], np.float64)
    high = np.zeros(256, bool)
    high[128:] = True
    out = np.stack([
        np.log1p(words), np.bincount(np.repeat(np.arange(n), words), (w.stop - w.start).astype(float), n) / safe,
        bytes_in(_UPPER) / size, bytes_in(_DIGIT) / size, bytes_in(_MARK) / size, bytes_in(_SHOUT) / safe,
        bytes_in(_BAR) / safe, bytes_in(_SYMBOL) / size, bytes_in(high) / size, words_in(ends >= 2) / safe,
        words_in(stop == w.start) / safe, words_in(again) / safe, words_in(again2) / safe,
        distinct / safe**0.8, np.log1p(bytes_in(_LINE)), bytes_in(_STOP) / safe,
    ], axis=1)
    out[words == 0] = 0
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, stats)`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, data, off in texts(batch.column(1)):
                values = statistics(data, off)
                bounds = (np.arange(len(values) + 1) * len(STATISTICS)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(values)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.ravel()))],
                    ["doc_id", "stats"])
                at += len(values)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).transform(shipped).mapInArrow(run, "doc_id long, stats array<double>")


def _fourier(cfg: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(cfg.seed))
    return rng.standard_normal((len(STATISTICS), cfg.features)) / cfg.width, rng.random(cfg.features) * 2 * np.pi


def fourier_features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, cfg: Settings) -> np.ndarray:
    """Cosines and a constant; statistics far out are held at eight deviations."""
    normal, phase = _fourier(cfg)
    z = np.clip((stats - mean) / scale, -8, 8)
    return np.concatenate([np.sqrt(2 / cfg.features) * np.cos(z @ normal + phase), np.ones((len(z), 1))], axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pool neighbours until means do not fall; no mean is nearer to 0 or 1 than half a document."""
    blocks: list[list[float]] = []
    for total, count in zip(y, n, strict=True):
        blocks.append([total, count, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, c, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + c, blocks[-1][2] + k]
    least = 0.5 / (1 + np.sum(n))
    return np.concatenate([np.full(int(k), np.clip(t / c, least, 1 - least)) for t, c, k in blocks])


def train(stats: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> Model:
    """A model from ``document_statistics`` and ``labels(doc_id, quality)``.

    All labelled rows take part, as sums. To the driver come ``groups`` sums of
    (features + 1) squared numbers and ``bins`` counts, whatever the input. Rows without a label
    are left out; of several labels of a doc_id the smallest counts. Without any label every
    chance is 1.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.min("y").alias("y")))
    rows = staged(stats.join(known, "doc_id").select("stats", "y"), "quality-rows")
    width = len(STATISTICS)
    spread = rows.agg(*(
        x for i in range(width) for x in (F.avg(F.col("stats")[i]), F.stddev_pop(F.col("stats")[i])))).first()
    if spread[0] is None:
        return Model(np.zeros(width), np.ones(width), np.zeros(cfg.features + 1), np.zeros(0), np.ones(1))
    mean = np.array(spread[0::2], float)
    scale = np.maximum(np.array(spread[1::2], float), 1e-6)
    size = cfg.features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            z = fourier_features(_matrix(batch.column(0), width), mean, scale, cfg)
            z = np.concatenate([z, batch.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]], axis=1)
            total += z.T @ z
        yield _sum_row(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_py()).reshape(total.shape)
        yield _sum_row(total)

    parts = rows.transform(shipped).mapInArrow(sums, "total binary").repartition(cfg.groups).mapInArrow(add, "total binary")
    total = sum(np.frombuffer(r.total).reshape(size + 1, size + 1) for r in parts.collect())
    n = total[size - 1, size - 1]
    weights = np.linalg.solve(total[:size, :size] + cfg.ridge * max(n, 1) * np.eye(size) / size, total[:size, size])
    raw = Model(mean, scale, weights, np.zeros(0), np.ones(1))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _raw_scores(_matrix(batch.column(0), width), raw, cfg)
            at = np.round((s + 0.5) / 2 * cfg.bins).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["bin", "y"])

    table = sorted(rows.transform(shipped).mapInArrow(binned, "bin long, y int").groupBy("bin").agg(
        F.sum("y").alias("good"), F.count("*").alias("n")).collect())
    bins = np.array([r.bin for r in table], float)
    chances = _isotonic(np.array([r.good for r in table], float), np.array([r.n for r in table], float))
    return Model(mean, scale, weights, bins / cfg.bins * 2 - 0.5, chances)


def _sum_row(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])


def _raw_scores(stats: np.ndarray, model: Model, cfg: Settings) -> np.ndarray:
    return np.clip(fourier_features(stats, model.mean, model.scale, cfg) @ model.weights, -0.5, 1.5)


def chances(stats: np.ndarray, model: Model, cfg: Settings) -> np.ndarray:
    """Calibrated chances of the label 1, rising with the ridge score between the bins."""
    if not len(model.bounds):
        return np.full(len(stats), float(model.chances[0]))
    return np.clip(np.interp(_raw_scores(stats, model, cfg), model.bounds, model.chances), 0.0, 1.0)


def scored_statistics(stats: DataFrame, model: Model, cfg: Settings = Settings()) -> DataFrame:
    """``(doc_id, score)`` for each row of ``document_statistics``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = chances(_matrix(batch.column(1), len(STATISTICS)), model, cfg)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "score"])

    return stats.select("doc_id", "stats").transform(shipped).mapInArrow(run, "doc_id long, score double")


def _scored(docs: DataFrame, model: Model, cfg: Settings) -> DataFrame:
    """``(_row, quality_score)``, the given row whole, so that its columns may have any names."""
    kept = docs.select(F.col("text").cast("string").alias("_text"), F.struct("*").alias("_row"))
    out = StructType([StructField("_row", kept.schema["_row"].dataType), StructField("quality_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, data, off in texts(batch.column(0)):
                values = chances(statistics(data, off), model, cfg)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(values)), pa.array(values)], ["_row", "quality_score"])
                at += len(values)

    return kept.transform(shipped).mapInArrow(run, out)


def scored(docs: DataFrame, model: Model, cfg: Settings = Settings()) -> DataFrame:
    """The rows with ``quality_score double``, without a join: texts are read where they are.

    Null and empty texts have all statistics 0 and are scored like any other. Rows are scored
    one by one, so rows that repeat a text or a doc_id score alike and no rows give none; a text
    of any length is scored whole, some 50 bytes a byte of it while it lasts. A column of that
    name is replaced; all others pass through.
    """
    rest = [F.col("_row").getField(c).alias(c) for c in docs.columns if c != "quality_score"]
    return _scored(docs, model, cfg).select(*rest, "quality_score")


def good(docs: DataFrame, model: Model, least: float, cfg: Settings = Settings()) -> DataFrame:
    """The rows whose score reaches ``least``, as they are."""
    return _scored(docs, model, cfg).filter(F.col("quality_score") >= least).select("_row.*")
