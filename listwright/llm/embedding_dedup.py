"""Near-duplicate vectors: Euclidean p-stable hashing and exact cosine checks.

A table's key for a normalised vector is a row of quantised random projections. Vectors that
share a key in some table are compared exactly, in tiles of bounded size. A pair counts in
the first table that it shares only, so sums over tiles count each link once, and no tile
writes its pairs out: it writes sums and enough edges to keep what hangs together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from listwright.llm.bytescan import mixed
from listwright.llm.frames import partitions, shipped, staged
from listwright.llm.graph import components
from listwright.llm.vectors import as_given, matrices, unit, usable


@dataclass(frozen=True)
class Settings:
    """A pair at exactly ``cosine`` 0.93 shares none of 96 tables with probability 0.0005, one
    at 0.97 practically never; unrelated vectors share one table in about a thousand pairs."""

    cosine: float = 0.93
    tables: int = 96
    projections: int = 16
    step: float = 2.0
    seed: int = 7
    block: int = 512
    small: int = 24


def _hashes(cfg: Settings, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([cfg.seed, dim]))
    n = cfg.tables * cfg.projections
    return rng.standard_normal((dim, n)), rng.random(n) * cfg.step


def table_keys(matrix: np.ndarray, cfg: Settings) -> np.ndarray:
    """(rows, tables) 64-bit keys of the rows' directions."""
    normal, shift = _hashes(cfg, matrix.shape[1])
    weight = mixed(np.arange(1, cfg.projections + 1, dtype=np.uint64) + np.uint64(matrix.shape[1] << 20))
    salt = mixed(np.arange(cfg.tables, dtype=np.uint64) + np.uint64(1 << 40))
    out = np.empty((len(matrix), cfg.tables), np.uint64)
    for i in range(0, len(matrix), 4096):
        cells = np.floor((unit(matrix[i : i + 4096]) @ normal + shift) / cfg.step).astype(np.int64).view(np.uint64)
        cells = cells.reshape(-1, cfg.tables, cfg.projections)
        out[i : i + 4096] = mixed((cells * weight).sum(axis=2, dtype=np.uint64) + salt)
    return out


def _wide(vectors: DataFrame) -> str:
    """How a vector's components are written as bytes."""
    return "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"


def _keyed(classes: DataFrame, cfg: Settings) -> DataFrame:
    wide = _wide(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = mixed(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            for rows, matrix in matrices(batch.column(3)):
                keys = mixed(table_keys(matrix, cfg) ^ labels[rows][:, None])
                bounds = pa.array((np.arange(len(rows) + 1) * cfg.tables).astype(np.int32))
                own = batch.take(pa.array(rows))
                short = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(2), pa.ListArray.from_arrays(bounds, pa.array(keys.view(np.int64).ravel())),
                     pa.array([x.tobytes() for x in short], pa.binary()),
                     pa.array([x.tobytes() for x in matrix.astype(wide)], pa.binary())],
                    ["class_id", "copies", "keys", "short", "vector"])

    return classes.select("class_id", F.xxhash64("label").alias("label"), "copies", "embedding").transform(shipped).mapInArrow(
        run, "class_id long, copies long, keys array<long>, short binary, vector binary")


def _first_shared(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the key is in the first table in which rows of a and b agree."""
    same = a == b
    at = same.argmax(axis=1)
    return same.any(axis=1) & (a[np.arange(len(a)), at] == key)


def _compare(rows: dict[str, np.ndarray], cfg: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(class, links, peer) found in whole tiles, given sorted by tile."""
    begin = rows["begin"]
    size = np.diff(np.append(begin, len(rows["id"])))
    tile = np.repeat(np.arange(len(begin)), size)
    units, short, copies, ids, key = rows["unit"], rows["short"], rows["copies"], rows["id"], rows["key"]
    # Small tiles together: each row against the one s places further, while the tile lasts.
    small = size[tile] <= cfg.small
    for s in range(1, int(size[size <= cfg.small].max(initial=0))):
        x = np.flatnonzero(small[:-s] & (tile[:-s] == tile[s:]))
        if not len(x):
            continue
        x = x[(rows["block"][x] == rows["i"][x]) & (rows["block"][x + s] == rows["j"][x])
              | (rows["block"][x] == rows["j"][x]) & (rows["block"][x + s] == rows["i"][x])]
        y = x + s
        ok = np.einsum("ij,ij->i", units[x], units[y]) >= cfg.cosine
        x, y = x[ok], y[ok]
        ok = _first_shared(short[x], short[y], key[x])
        x, y = x[ok], y[ok]
        yield ids[x], copies[y], ids[y]
        yield ids[y], copies[x], ids[x]
    for t in np.flatnonzero(size > cfg.small):
        at = np.arange(begin[t], begin[t] + size[t])
        block = rows["block"][at]
        i, j = rows["i"][at[0]], rows["j"][at[0]]
        left, right = at[block == i], at[block == j]
        close = units[left] @ units[right].T >= cfg.cosine
        if i == j:
            close = np.triu(close, 1)
        x, y = (side[k] for side, k in zip((left, right), np.nonzero(close), strict=True))
        for lo in range(0, len(x), 1 << 16):
            ok = _first_shared(short[x[lo : lo + (1 << 16)]], short[y[lo : lo + (1 << 16)]], key[x[lo : lo + (1 << 16)]])
            a, b = x[lo : lo + (1 << 16)][ok], y[lo : lo + (1 << 16)][ok]
            if not len(a):
                continue
            base, n = at[0], len(at)
            links = np.bincount(a - base, copies[b], n) + np.bincount(b - base, copies[a], n)
            root = np.arange(n)
            while True:
                low = np.minimum(root[a - base], root[b - base])
                new = root.copy()
                np.minimum.at(new, a - base, low)
                np.minimum.at(new, b - base, low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            hit = np.flatnonzero(links)
            yield ids[base + hit], links[hit].astype(np.int64), ids[base + root[hit]]


def _tile_links(tiles: DataFrame, wide: str, cfg: Settings) -> DataFrame:
    each = np.dtype(wide).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not table.num_rows:
                return
            col = {n: table.column(n).to_numpy() for n in ("key", "i", "j", "block", "class_id", "copies")}
            vectors = table.column("vector").to_pylist()
            change = np.flatnonzero(
                (np.diff(col["key"]) != 0) | (np.diff(col["i"]) != 0) | (np.diff(col["j"]) != 0)) + 1
            width = max(map(len, vectors)) // each
            flat = np.zeros((len(vectors), width))
            for n, v in enumerate(vectors):
                flat[n, : len(v) // each] = np.frombuffer(v, wide)
            short = np.frombuffer(b"".join(table.column("short").to_pylist()), "<u4").reshape(-1, cfg.tables)
            rows = {
                "begin": np.concatenate([[0], change]), "id": col["class_id"], "copies": col["copies"], "i": col["i"],
                "j": col["j"], "block": col["block"], "unit": unit(flat), "short": short,
                "key": (col["key"].view(np.uint64) & np.uint64(0xFFFFFFFF)).astype("<u4"),
            }
            for c, n, p in _compare(rows, cfg):
                if len(c):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(p, pa.int64())],
                        ["class_id", "links", "peer"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            table = table.combine_chunks()
            last = {n: table.column(n)[table.num_rows - 1].as_py() for n in ("key", "i", "j")}
            same = np.logical_and.reduce([table.column(n).to_numpy() == v for n, v in last.items()])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            yield from found(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield from found(held)

    spark = tiles.sparkSession
    return (
        tiles.repartition(4 * partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "class_id")
        .select("key", "i", "j", "block", "class_id", "copies", "short", "vector")
        .transform(shipped).mapInArrow(run, "class_id long, links long, peer long")
    )


def near_duplicate_vectors(vectors: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors(vec_id, embedding, label)``.

    Rows with equal labels, of any type, and a cosine of at least ``cosine`` in double precision
    are linked; vectors of doubles are not narrowed. Equal vectors are compared once and count as
    often as they stand; vectors of different lengths have no cosine. A null label, and a vector
    that is null, zero or holds null or non-finite components, links with nothing. A row without
    a vec_id takes no part, has no component and is kept. Rows that repeat a vec_id are vectors
    of their own under one name, and come back one by one. No rows give none; other columns are
    not looked at.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        as_given(F.col("embedding"), vectors.schema["embedding"].dataType).alias("embedding"), F.col("label"))
    part = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("part", part)
    # A class has a number of its own, as its smallest vec_id may stand in several.
    classes = staged(
        rows.filter("part").groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("class_id", F.monotonically_increasing_id()), "vector-classes")
    keyed = staged(_keyed(classes, cfg), "vector-keys")
    exploded = keyed.select("class_id", F.explode("keys").alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(
        "key", F.ceil(F.col("n") / cfg.block).cast("int").alias("blocks"))
    member = exploded.join(shared, "key").withColumn("block", F.pmod(F.hash("class_id"), "blocks")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = member.select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class_id"
    ).join(keyed.select("class_id", "copies", "short", "vector"), "class_id")
    found = staged(_tile_links(tiles, _wide(classes), cfg), "vector-links")
    counted = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("class_id").alias("a"), F.col("peer").alias("b")))
    named = named.withColumnRenamed("node", "class_id")
    least = classes.select("class_id", "least").join(named, "class_id").groupBy("component").agg(F.min("least").alias("first"))
    per_class = (
        classes.join(counted, "class_id", "left").join(named, "class_id", "left").join(least, "component", "left")
        .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
                F.coalesce("first", "least").alias("component")))
    out = rows.filter("part").join(per_class, ["label", "embedding"]).select(
        "vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"),
        (F.col("vec_id") == F.col("component")).alias("kept"))
    apart = rows.filter("not part").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(apart)
