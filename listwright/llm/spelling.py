"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols, so words one edit apart have reduced words at most one edit
apart. Every reduced word generates its full neighbourhood of one edit, all symbols in all
places, as 64-bit keys; keys are joined to the reduced vocabulary, and what meets is verified on
the original strings inside the join, so that no unverified pair is written anywhere.

Most generated keys belong to no word. A bit array of fixed size tells most of those before
they are shuffled; how many it tells depends on the vocabulary, the result does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from listwright.llm.bytescan import mixed
from listwright.llm.frames import shipped, staged

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0xD1342543DE82EF95
_KEYS = 1 << 21


@dataclass(frozen=True)
class Settings:
    """Words of at least ``least_length`` code points that occur ``least_count`` times; a form
    occurs ``ratio`` times as often. One run in ``spoiled`` loses a letter before it is counted
    (0: none). ``bits`` is the base-2 logarithm of the size of the bit array."""

    symbols: int = 16
    least_length: int = 7
    least_count: int = 2
    ratio: int = 10
    spoiled: int = 31
    bits: int = 26


def spoiled(doc_id: Column, run: Column, one_in: int) -> Column:
    """The run, or the run less one letter where ``one_in`` divides the crc32 of ``<doc_id>:<run>``.

    A missing doc_id stands for nothing in front of the colon.
    """
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    less = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % one_in == 0, less).otherwise(run) if one_in else run


def vocabulary(docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``(word, n)`` of whole texts; counted within tasks first, so a frequent word costs no more."""
    long_runs = F.regexp_extract_all(F.col("text"), F.lit(f"{RUN}{{{cfg.least_length},}}+"), F.lit(0))
    runs = docs.select("doc_id", F.explode(long_runs).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    words = runs.select(spoiled(F.col("doc_id"), F.col("run"), cfg.spoiled).alias("word"))
    counted = words.filter(F.length("word") >= cfg.least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= cfg.least_count)


def by_length(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Reduced words of one length at a time: (which, a matrix of symbols from 1)."""
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    reduced = (mixed(chars.astype(np.uint64)) >> np.uint64(32)) % np.uint64(symbols) + np.uint64(1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size) - size
    for length in np.unique(size):
        own = np.flatnonzero(size == length)
        yield own, reduced[first[own][:, None] + np.arange(length)]


def _power(n: int) -> np.ndarray:
    p = np.full(n + 1, _BASE, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _finished(value: np.ndarray, length: int) -> np.ndarray:
    return mixed(value + mixed(np.array([length + 1], np.uint64)))


def keys(reduced: np.ndarray) -> np.ndarray:
    """A key for each reduced word; equal keys of different ones only cost a verification."""
    n = reduced.shape[1]
    return _finished((reduced * _power(n)[:n]).sum(axis=1, dtype=np.uint64), n)


def neighbour_keys(reduced: np.ndarray, symbols: int, most: int = _KEYS) -> Iterator[np.ndarray]:
    """Keys of each reduced word itself and of all words one edit from it, a row each; some stand twice.

    They come in pieces of some ``most`` keys, a stretch of places each.
    """
    m, n = reduced.shape
    power, inverse = _power(n + 1), np.uint64(pow(_BASE, -1, 2**64))
    upto = np.zeros((m, n + 1), np.uint64)
    np.cumsum(reduced * power[:n], axis=1, out=upto[:, 1:])
    whole, every = upto[:, -1:], np.arange(1, symbols + 1, dtype=np.uint64)
    step = max(1, most // (2 * symbols * m))
    for lo in range(0, n + 1, step):
        at, on = slice(lo, lo + step), slice(lo, min(lo + step, n))
        changed = whole[:, :, None] + (every - reduced[:, on, None]) * power[on, None]
        shorter = upto[:, on] + (whole - upto[:, 1:][:, on]) * inverse
        longer = upto[:, at, None] + every * power[: n + 1][at, None] + ((whole - upto[:, at]) * np.uint64(_BASE))[:, :, None]
        yield np.concatenate([
            _finished(changed.reshape(m, -1), n), _finished(shorter, n - 1), _finished(longer.reshape(m, -1), n + 1)], axis=1)


def one_edit(a: Column, b: Column) -> Column:
    """Whether strings differ by exactly one inserted, deleted or replaced code point.

    Spark's bounded edit distance takes the square of the length, so long strings are compared
    behind the first place where they differ.
    """
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differ, True).cast("int")
    tail = lambda c, other: F.substr(c, at + F.when(F.length(c) >= F.length(other), F.lit(1)).otherwise(F.lit(0)))
    close = F.abs(F.length(a) - F.length(b)) <= 1
    return (a != b) & close & F.when(F.length(a) <= 200, F.levenshtein(a, b, 1) == 1).otherwise(tail(a, b) == tail(b, a))


def _keyed(words: DataFrame, cfg: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for own, reduced in by_length(batch.column(0).to_pylist(), cfg.symbols):
                out[own] = keys(reduced)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], ["word", "n", "key"])

    return words.transform(shipped).mapInArrow(run, "word string, n long, key long")


def _seen(words: DataFrame, bits: int) -> np.ndarray:
    """The bit array of the vocabulary's keys: 2**bits bits, whatever the vocabulary."""
    slot = F.shiftrightunsigned("key", 64 - bits)
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    found = words.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(one).alias("ones")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("at").to_numpy()] = found.column("ones").to_numpy()
    return out.view(np.uint64)


def _generated(words: DataFrame, cfg: Settings) -> DataFrame:
    """``(word, n, key)``: a row per word and key of its neighbourhood that the bit array has."""
    seen, shift = _seen(words, cfg.bits), np.uint64(64 - cfg.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, reduced in by_length(batch.column(0).to_pylist(), cfg.symbols):
                step = max(1, _KEYS // ((2 * reduced.shape[1] + 2) * cfg.symbols))
                for lo in range(0, len(own), step):
                    hits = []
                    for made in neighbour_keys(reduced[lo : lo + step], cfg.symbols):
                        slot = made >> shift
                        hit = np.flatnonzero((seen[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
                        hits.append((hit // made.shape[1], made.ravel()[hit]))
                    who, key = (np.concatenate(x) for x in zip(*hits, strict=True))
                    order = np.lexsort((key, who))
                    who, key = who[order], key[order]
                    new = np.append(True, (np.diff(who) != 0) | (key[1:] != key[:-1]))
                    at = pa.array(own[lo + who[new]])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), pa.array(key[new].view(np.int64))],
                        ["word", "n", "key"])

    return words.select("word", "n").transform(shipped).mapInArrow(run, "word string, n long, key long")


def near_pairs(words: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``(word, n, near, near_n)`` for every word of ``words(word, n, key)`` and each word one edit from it."""
    known = words.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = _generated(words, cfg).join(known, "key")
    return met.filter(one_edit(F.col("word"), F.col("near"))).select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for each row of ``forms(word, form)``: the end of its chain of forms.

    Each round doubles the length of the chain behind a word. Every form is more frequent than
    its word, so chains end, and a few rounds do.
    """
    at = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = staged(at.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each word of ``docs(doc_id, text)``.

    Words are runs of Latin letters of whole texts, lower-cased in A to Z only, of which one in
    ``spoiled`` has lost a letter; a text of any length is one row of its long runs. ``form`` is
    the near word of largest count, of equal ones the smallest in code-point order, if that is
    ``ratio`` times the word's own; else null. ``root`` follows forms to the last. Null, empty
    and wordless texts give no words, no documents no rows. Rows that repeat a text under one
    doc_id lose the same letters and count as often as they stand; rows without a doc_id count
    alike. Other columns are not looked at.
    """
    words = staged(_keyed(vocabulary(docs, cfg), cfg), "vocabulary")
    best = near_pairs(words, cfg).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    some = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    enough = F.col("near_n") >= cfg.ratio * F.col("n")
    forms = staged(words.join(some, "word", "left").select(
        "word", F.when(enough, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("near_n")).alias("form_n")), "forms")
    found = forms.join(roots(forms.filter("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
