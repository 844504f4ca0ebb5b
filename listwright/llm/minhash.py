"""Near-duplicate texts: circulant MinHash, banding, exact Jaccard verification.

Circulant MinHash needs two permutations instead of one per coordinate. The first scatters
shingles over a circle of ``CIRCLE`` places; the second is a table of ranks, and coordinate
k reads it shifted by k places. All coordinates of a shingle are thus one window of the table.

Work after the sketches follows the groups, not their pairs:

1. equal sets are one class, and only a class's smallest document goes on;
2. each band bucket links its members to its smallest member, after exact verification;
3. buckets that still hold more than one component are compared in tiles of bounded size:
   what lies outside a bucket's main component against the bucket, once per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from listwright.llm.bytescan import mixed, shingle_sets, texts
from listwright.llm.frames import shipped, staged
from listwright.llm.graph import components

CIRCLE = 1 << 20
_tables: dict[tuple[int, int], np.ndarray] = {}


@dataclass(frozen=True)
class Settings:
    """``percent`` is the least Jaccard similarity of a link, in hundredths.

    With 36 bands of 5 a pair at 0.8 shares no band with probability below one in a million.
    Pairs whose sketches agree in less than ``percent - slack`` of all coordinates, five
    standard deviations below, are not verified.
    """

    width: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 5
    seed: int = 11
    slack: int = 15
    block: int = 256

    @property
    def size(self) -> int:
        return self.bands * self.rows


def _windows(size: int, seed: int) -> np.ndarray:
    """Row p holds the ranks a shingle at place p gives to all coordinates."""
    if (size, seed) not in _tables:
        rank = np.random.Generator(np.random.PCG64(seed)).permutation(CIRCLE).astype(np.uint32)
        circle = np.concatenate([rank, rank[:size]])
        _tables[size, seed] = np.lib.stride_tricks.sliding_window_view(circle, size)[:CIRCLE]
    return _tables[size, seed]


def signature(shingles: np.ndarray, size: int, seed: int) -> np.ndarray:
    """All coordinates of a set of 64-bit shingle hashes."""
    windows = _windows(size, seed)
    place = (mixed(shingles ^ np.uint64(seed)) >> np.uint64(44)).astype(np.int64)
    best = np.full(size, CIRCLE, np.uint32)
    for i in range(0, len(place), 2048):
        np.minimum(best, windows[place[i : i + 2048]].min(axis=0), out=best)
    return best


SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sig binary"


def sketches(docs: DataFrame, cfg: Settings) -> DataFrame:
    """One narrow row per document: set size, 128-bit set hash, band keys, coordinates mod 256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mixed(np.arange(1, cfg.rows + 1, dtype=np.uint64))
        salt = mixed(np.arange(cfg.bands, dtype=np.uint64) + np.uint64(1 << 32))
        for batch in batches:
            column, at = batch.column(1), 0
            for _, data, off in texts(column):
                n, a, b, sigs = [], [], [], np.zeros((len(off) - 1, cfg.size), np.uint32)
                for i, s in enumerate(shingle_sets(data, off, cfg.width)):
                    n.append(len(s))
                    a.append(np.add.reduce(s))
                    b.append(np.add.reduce(mixed(s)))
                    if len(s):
                        sigs[i] = signature(s, cfg.size, cfg.seed)
                keyed = sigs.reshape(len(n), cfg.bands, cfg.rows).astype(np.uint64)
                keys = mixed((keyed * weights).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)
                bounds = np.arange(len(n) + 1) * cfg.bands
                low = (sigs & 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(n)),
                        pa.array(n, pa.int64()),
                        pa.array(np.array(a, np.uint64).view(np.int64)),
                        pa.array(np.array(b, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(keys.ravel())),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sig"],
                )
                at += len(n)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(shipped).mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, wanted: DataFrame, cfg: Settings) -> DataFrame:
    """``(doc_id, shingles)`` of the wanted documents: sorted 64-bit hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, data, off in texts(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(data, off, cfg.width)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sets)), pa.array(sets, pa.binary())], ["doc_id", "shingles"]
                )
                at += len(sets)

    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        # At size neither side is small; the same plan at every size keeps growth even.
        .join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
        .transform(shipped).mapInArrow(run, "doc_id long, shingles binary")
    )


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: 100 * intersection >= percent * union of two sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common) and common > 0


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _alike(pairs: DataFrame, cfg: Settings) -> DataFrame:
    """Pairs whose sketches agree well enough to be verified."""
    least = cfg.size * (cfg.percent - cfg.slack) / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, cfg.size) for i in (2, 3)
            )
            keep = pa.array((a == b).sum(axis=1) >= least)
            yield batch.select([0, 1]).filter(keep)

    return pairs.select("a", "b", "sig_a", "sig_b").transform(shipped).mapInArrow(run, "a long, b long")


def _verified_stars(pairs: DataFrame, sets: DataFrame, cfg: Settings) -> DataFrame:
    """Pairs ``(a, b)`` that hold on full sets; b, the smaller, may stand in very many.

    The set of b is sent once to each part of its partners, and parts hold ``block`` of them.
    """
    spread = pairs.groupBy("b").agg(F.count("*").alias("n")).select(
        "b", F.ceil(F.col("n") / cfg.block).cast("int").alias("parts"))
    spokes = pairs.join(spread, "b").join(sets.withColumnRenamed("doc_id", "a"), "a").select(
        "b", F.pmod(F.hash("a"), "parts").alias("part"), "a", "shingles")
    hubs = spread.join(sets.withColumnRenamed("doc_id", "b"), "b").select(
        "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(None).cast("long").alias("a"), "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            found_a, found_b = [], []
            for a, b, part, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                values = np.frombuffer(raw, np.uint64)
                if a is None:
                    hub, hub_set = (b, part), values
                elif (b, part) == hub and similar(values, hub_set, cfg.percent):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return (
        spokes.unionByName(hubs).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
        .select("a", "b", "part", "shingles").transform(shipped).mapInArrow(run, "a long, b long")
    )


def _rest_links(buckets: DataFrame, reps: DataFrame, label: DataFrame, sets: DataFrame, cfg: Settings) -> DataFrame:
    """Links between components that meet in a bucket, by tiles of bounded size.

    A bucket's main component is the one with most members. Members outside it (minor) meet
    all members, in tiles of ``block`` by ``block``; a pair counts in the first band it shares only.
    """
    here = staged(
        buckets.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")), "bucket-labels")
    per = here.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top"))
    blocks = lambda n: F.ceil(n / cfg.block).cast("int")
    live = per.filter(F.col("all") > F.col("top.n")).select(
        "key", F.col("top.component").alias("main"), blocks(F.col("all")).alias("all_blocks"),
        blocks(F.col("all") - F.col("top.n")).alias("minor_blocks"))
    rows = here.join(live, "key").withColumn("minor", F.col("component") != F.col("main"))
    place = F.hash("doc_id")
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = rows.filter("minor").withColumn("i", F.pmod(place, "minor_blocks")).withColumn("j", F.explode(count("all_blocks")))
    right = rows.withColumn("j", F.pmod(place, "all_blocks")).withColumn("i", F.explode(count("minor_blocks")))
    cols = ["key", "i", "j", "doc_id", "component", "minor"]
    tiles = left.select(*cols, F.lit(True).alias("is_left")).unionByName(
        right.select(*cols, F.lit(False).alias("is_left")))
    full = tiles.join(reps.select("doc_id", "n_shingles", "bands", "sig"), "doc_id")
    least = cfg.size * (cfg.percent - cfg.slack) / 100

    def propose(key: tuple, rows: pa.Table) -> pa.Table:
        own = rows.to_pydict()
        left_side = np.array(own["is_left"], bool)
        ids, comp = np.array(own["doc_id"]), np.array(own["component"])
        n, minor = np.array(own["n_shingles"]), np.array(own["minor"], bool)
        sig = np.frombuffer(b"".join(own["sig"]), np.uint8).reshape(-1, cfg.size)
        bands = np.array(own["bands"], np.int64).reshape(-1, cfg.bands)
        right_at = np.flatnonzero(~left_side)
        asked, partners, used = [], [], set()
        for x in np.flatnonzero(left_side):
            ok = (comp[right_at] != comp[x]) & ~(minor[right_at] & (ids[right_at] < ids[x]))
            small, large = np.minimum(n[right_at], n[x]), np.maximum(n[right_at], n[x])
            near = right_at[ok & (100 * small >= cfg.percent * large)]
            near = near[(sig[near] == sig[x]).sum(axis=1) >= least]
            if len(near):
                near = near[bands[x][(bands[near] == bands[x]).argmax(axis=1)] == key[0].as_py()]
            if len(near):
                asked.append(ids[x])
                partners.append(ids[near].tolist())
                used.update(ids[near].tolist())
        used -= set(asked)
        out = asked + sorted(used)
        m = len(out)
        return pa.table(
            {
                **{k: pa.array([v.as_py()] * m, t) for k, v, t in zip(("key", "i", "j"), key, (pa.int64(), pa.int32(), pa.int32()), strict=True)},
                "doc_id": pa.array(out, pa.int64()),
                "partners": pa.array(partners + [[]] * len(used), pa.list_(pa.int64())),
                "component": pa.array([int(comp[np.flatnonzero(ids == d)[0]]) for d in out], pa.int64()),
            }
        )

    proposed = staged(
        full.groupBy("key", "i", "j").applyInArrow(
            propose, "key long, i int, j int, doc_id long, partners array<long>, component long"), "proposed")

    def verify(rows: pa.Table) -> pa.Table:
        own = rows.select(["doc_id", "partners", "component", "shingles"]).to_pydict()
        sets = {d: np.frombuffer(s, np.uint64) for d, s in zip(own["doc_id"], own["shingles"], strict=True)}
        up = {c: c for c in own["component"]}

        def top(c):
            while up[c] != c:
                up[c] = c = up[up[c]]
            return c

        comp = dict(zip(own["doc_id"], own["component"], strict=True))
        a, b = [], []
        for d, partners in zip(own["doc_id"], own["partners"], strict=True):
            for p in partners:
                if top(comp[d]) != top(comp[p]) and similar(sets[d], sets[p], cfg.percent):
                    up[top(comp[d])] = top(comp[p])
                    a.append(comp[d])
                    b.append(comp[p])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return proposed.join(sets, "doc_id").groupBy("key", "i", "j").applyInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs(doc_id, text, ...)``.

    Words are lower-cased (A to Z) runs without ASCII white space; a set holds the distinct
    windows of ``width`` words, or the whole sequence if there are fewer. Documents whose sets
    reach ``percent`` are linked, and a component is named by its smallest doc_id. Null and
    empty texts have an empty set and link with nothing. Rows that repeat a doc_id with the
    same text share a component; rows without a doc_id link with nothing, have no component
    and are kept. Other columns are not looked at. An empty table gives an empty result.
    """
    sketched = staged(sketches(docs, cfg), "sketches")
    same = ["set_a", "set_b", "n_shingles"]
    usable = sketched.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    keyed = F.struct("doc_id", "n_shingles", "bands", "sig")
    reps = staged(usable.groupBy(*same).agg(F.min(keyed).alias("r")).select("set_a", "set_b", "r.*"), "reps")
    classes = reps.select(*same, F.col("doc_id").alias("rep"))
    members = staged(
        sketched.filter(F.col("doc_id").isNotNull()).join(classes, same, "left")
        .select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")
    exploded = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    buckets = staged(exploded.join(shared.select("key", "hub"), "key"), "buckets")

    star = buckets.filter("doc_id != hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    pairs = star.join(side("a"), "a").join(side("b"), "b").filter(_sizes_allow(F.col("n_a"), F.col("n_b"), cfg.percent))
    pairs = staged(_alike(pairs, cfg), "star-pairs")
    # Texts are read again for members of shared buckets only, once for both ways to link.
    sets = staged(full_sets(docs, buckets, cfg), "sets")
    links = _verified_stars(pairs, sets, cfg)
    first = components(links)
    second = components(_rest_links(buckets.select("key", "doc_id"), reps, first, sets, cfg))
    merged = second.select(F.col("node").alias("component"), F.col("component").alias("further"))
    by_rep = first.join(merged, "component", "full").select(
        F.coalesce("node", "component").alias("rep"), F.coalesce("further", "component").alias("component"))
    # A component that is only met in the second step is its own smallest member.
    named = by_rep.groupBy("rep").agg(F.min("component").alias("component"))
    named_rows = members.join(named, "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"),
        (F.col("doc_id") == F.coalesce("component", "rep")).alias("kept"))
    nameless = sketched.filter(F.col("doc_id").isNull()).select(
        "doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return named_rows.unionByName(nameless)
