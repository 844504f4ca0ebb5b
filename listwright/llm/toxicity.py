"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's chance p is a logistic function of its words and their beginnings; a document is
toxic unless all its sentences are fine, so its chance is the noisy-or 1 - prod(1 - p).
Document labels train the sentence weights through that formula, and the same weights then
say which sentences offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from listwright.llm.bytescan import LOWER, Words, texts
from listwright.llm.frames import shipped, staged

_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 128) if not chr(c).isalnum()]] = True


@dataclass(frozen=True)
class Settings:
    """At most ``sample`` labelled documents of each class train the model, those with the
    smallest hashes of their doc_id; ``features`` weights are kept, those that tell the classes
    apart best and stand in at least ``least`` documents of the sample."""

    sample: int = 2500
    features: int = 6000
    least: int = 5
    prefixes: tuple[int, ...] = (4, 5, 6)
    rounds: int = 250
    rate: float = 0.15
    decay: float = 1e-4
    offends: float = 0.5


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights, and the score of a sentence without any."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -30.0


def _features(data: np.ndarray, off: np.ndarray, cfg: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes, each one's sentence, each sentence's text, and where sentences begin and end."""
    low = LOWER[data]
    w = Words(low, off)
    start, stop = w.start.copy(), w.stop.copy()
    for _ in range(4):
        some = (stop > start) & _MARK[low[stop - 1]]
        stop[some] -= 1
        some = (stop > start) & _MARK[low[np.minimum(start, len(low) - 1)]]
        start[some] += 1
    # A sentence ends with a word that holds an end mark behind its letters, or with its text.
    marks = np.concatenate([[0], np.cumsum(_END[data])])
    after = np.append(w.start[1:], len(data))[: len(w.stop)]
    closes = marks[after] > marks[stop]
    new = np.zeros(len(start), np.int64)
    if len(start):
        new[1:] = closes[:-1]
        firsts = w.bound[:-1][w.bound[1:] > w.bound[:-1]]
        new[firsts] = 1
    sentence = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    doc = np.searchsorted(w.bound, heads, "right") - 1
    tails = np.append(heads[1:], len(start)) - 1 if len(heads) else heads
    found = [w.hashes(start, stop)]
    owner = [sentence]
    for k in cfg.prefixes:
        long = np.flatnonzero(stop - start > k)
        found.append(w.hashes(start[long], start[long] + k) + np.uint64(k))
        owner.append(sentence[long])
    return np.concatenate(found), np.concatenate(owner), doc, w.start[heads], w.stop[tails]


def _sentence_scores(model: Model, hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    z = np.full(n, model.bias)
    if len(model.hashes) and len(hashes):
        at = np.minimum(np.searchsorted(model.hashes, hashes), len(model.hashes) - 1)
        hit = np.flatnonzero(model.hashes[at] == hashes)
        sentence, feature = _once(owner[hit], at[hit], len(model.hashes))
        z += np.bincount(sentence, model.weights[feature], n)
    return z


def _once(owner: np.ndarray, feature: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """A feature counts once in a sentence, however often it is repeated."""
    pair = np.unique(owner * features + feature)
    return pair // max(features, 1), pair % max(features, 1)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], labels: np.ndarray, cfg: Settings) -> Model:
    """Weights from ``(hashes, sentence, sentences)`` of the sampled documents."""
    if not len(labels) or labels.min() == labels.max():
        return Model(bias=-30.0 if not len(labels) or labels.max() == 0 else 30.0)
    per = [np.unique(h) for h, _, _ in docs]
    y = np.repeat(labels, list(map(len, per)))
    names, at = np.unique(np.concatenate(per), return_inverse=True)
    bad, good = np.bincount(at, y, len(names)), np.bincount(at, 1 - y, len(names))
    n_bad, n_good = labels.sum(), (1 - labels).sum()
    rate_bad, rate_good = (bad + 0.5) / (n_bad + 1), (good + 0.5) / (n_good + 1)
    spread = np.sqrt(rate_bad * (1 - rate_bad) / n_bad + rate_good * (1 - rate_good) / n_good)
    telling = np.where(bad + good >= cfg.least, np.abs(rate_bad - rate_good) / spread, 0)
    best = np.argsort(-telling, kind="stable")[: cfg.features]
    kept = np.sort(names[best[telling[best] > 2.5]])
    sizes = np.array([s for _, _, s in docs])
    shift = np.cumsum(sizes) - sizes
    hashes = np.concatenate([h for h, _, _ in docs])
    owner = np.concatenate([o + s for (_, o, _), s in zip(docs, shift, strict=True)])
    model = Model(kept, np.zeros(len(kept)), 0.0)
    at = np.minimum(np.searchsorted(kept, hashes), max(0, len(kept) - 1)) if len(kept) else np.zeros(0, np.int64)
    hit = np.flatnonzero(kept[at] == hashes) if len(kept) else np.zeros(0, np.int64)
    owner, feature = _once(owner[hit], at[hit], len(kept))
    total = int(sizes.sum())
    doc = np.repeat(np.arange(len(docs)), sizes)
    weights, bias = np.zeros(len(kept)), -np.log(max(2.0, total / len(docs)))
    moment, square, step = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), 0
    for step in range(1, cfg.rounds + 1):
        z = bias + np.bincount(owner, weights[feature], total)
        fine = -np.bincount(doc, _softplus(z), len(docs))
        chance = -np.expm1(np.minimum(fine, -1e-12))
        ratio = np.where(labels == 1, np.exp(fine) / chance, -1.0)
        pull = ratio[doc] / (1 + np.exp(-z))
        slope = np.append(np.bincount(feature, pull[owner], len(kept)), pull.sum()) / len(docs)
        slope[:-1] -= cfg.decay * weights
        moment = 0.9 * moment + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        move = cfg.rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        weights, bias = weights + move[:-1], bias + move[-1]
    return Model(model.hashes, weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; other columns are unused.

    The sample is bounded, so it is fitted in one task; what comes back is at most ``features``
    weights. Rows without a label or doc_id are left out; of several labels of a doc_id the
    largest counts. With labels of one kind only every document gets that kind, without any
    none is toxic.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    order = F.xxhash64("doc_id")
    drawn = [known.filter(F.col("toxic") == v).orderBy(order, "doc_id").limit(cfg.sample) for v in (1, 0)]
    chosen = staged(drawn[0].unionByName(drawn[1]), "toxic-sample")
    # The sample's size is a parameter.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, y, ids = [], [], []
        for batch in batches:
            at = 0
            for _, data, off in texts(batch.column(1)):
                hashes, owner, doc, _, _ = _features(data, off, cfg)
                per = np.searchsorted(doc, np.arange(len(off)))
                by = np.argsort(owner, kind="stable")
                hashes, owner = hashes[by], owner[by]
                cut = np.searchsorted(owner, per)
                for d in range(len(off) - 1):
                    parts.append((hashes[cut[d] : cut[d + 1]], owner[cut[d] : cut[d + 1]] - per[d], int(per[d + 1] - per[d])))
                y += batch.column(2).slice(at, len(off) - 1).to_pylist()
                ids += batch.column(0).slice(at, len(off) - 1).to_pylist()
                at += len(off) - 1
        by = sorted(range(len(y)), key=lambda i: (ids[i], len(parts[i][0])))
        model = fit([parts[i] for i in by], np.array([y[i] for i in by], np.int64), cfg)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(model.hashes, np.uint64(0)).view(np.int64)), pa.array(np.append(model.weights, model.bias)),
             pa.array([False] * len(model.hashes) + [True])], ["hash", "weight", "is_bias"])

    found = rows.select("doc_id", "text", "toxic").repartition(1).transform(shipped).mapInArrow(
        run, "hash long, weight double, is_bias boolean").collect()
    bias = [r.weight for r in found if r.is_bias]
    rest = [r for r in found if not r.is_bias]
    return Model(
        np.array([r.hash for r in rest], np.int64).view(np.uint64), np.array([r.weight for r in rest], np.float64),
        bias[0] if bias else -30.0)


def _scored(docs: DataFrame, model: Model, cfg: Settings) -> DataFrame:
    """``(_row, toxic_score, offending)``, the given row whole, so that its columns may have any names."""
    kept = docs.select(F.col("text").cast("string").alias("_text"), F.struct("*").alias("_row"))
    span = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])
    out = StructType([
        StructField("_row", kept.schema["_row"].dataType), StructField("toxic_score", DoubleType()),
        StructField("offending", ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, data, off in texts(batch.column(0)):
                n = len(off) - 1
                hashes, owner, doc, begin, end = _features(data, off, cfg)
                z = _sentence_scores(model, hashes, owner, len(doc))
                score = -np.expm1(-np.bincount(doc, _softplus(z), n))
                chance = 1 / (1 + np.exp(-z))
                hit = np.flatnonzero(chance >= cfg.offends)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if len(hit) else np.zeros(1, np.int64)
                origin = chars[off[doc[hit]]] if len(hit) else np.zeros(0, np.int64)
                spans = pa.StructArray.from_arrays(
                    [pa.array((chars[begin[hit]] - origin).astype(np.int64)), pa.array((chars[end[hit]] - origin).astype(np.int64)),
                     pa.array(chance[hit])], ["start", "end", "score"])
                bounds = np.searchsorted(doc[hit], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(at, n), pa.array(score), pa.ListArray.from_arrays(pa.array(bounds), spans)],
                    ["_row", "toxic_score", "offending"])
                at += n

    return kept.transform(shipped).mapInArrow(run, out)


def scored(docs: DataFrame, model: Model, cfg: Settings = Settings()) -> DataFrame:
    """The rows with ``toxic_score double`` and ``offending array<struct<start, end, score>>``.

    Scores are chances of the label 1; offending sentences are spans of characters whose own
    chance reaches ``offends``. Null and empty texts have no sentence and score 0. Rows are
    scored one by one, so rows that repeat a text or a doc_id score alike and no rows give none;
    a text of any length is scored whole, some 50 bytes a byte of it while it lasts. Columns of
    these two names are replaced; all others pass through as they are.
    """
    found = _scored(docs, model, cfg)
    rest = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("toxic_score", "offending")]
    return found.select(*rest, "toxic_score", "offending")


def clean(docs: DataFrame, model: Model, most: float, cfg: Settings = Settings()) -> DataFrame:
    """The rows whose score is below ``most``, as they are."""
    return _scored(docs, model, cfg).filter(F.col("toxic_score") < most).select("_row.*")
