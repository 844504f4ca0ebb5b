"""Approximate nearest neighbours by cosine: robust-pruned directed graphs over shards.

Distinct vectors are dealt to shards of bounded size by a hash. In a shard, each vector is
searched for greedily from a central one; what the search met are its candidates, and relaxed
distance pruning keeps near ones that are not much nearer to each other than to it. Queries
then walk every shard's graph with a beam, and the best of all shards are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from listwright.llm.frames import shipped, staged
from listwright.llm.vectors import as_given, held, unit, usable


@dataclass(frozen=True)
class Settings:
    """``shard`` distinct vectors to a graph on average, ``degree`` edges kept per vector,
    ``build_beam`` and ``beam`` places held in a search, ``relax`` the pruning's tolerance,
    ``block`` queries on average that a task takes to a shard's graph."""

    shard: int = 4096
    degree: int = 28
    build_beam: int = 48
    beam: int = 128
    relax: float = 1.2
    batch: int = 256
    block: int = 4096
    seed: int = 3


def beam_search(
    vectors: np.ndarray, edges: np.ndarray, queries: np.ndarray, start: int, beam: int, expand: int = 4
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest places and similarities found for many queries at once; -1 fills edges and results.

    Each round opens the ``expand`` best unopened places of every query; a search ends when all
    that its beam holds are open.
    """
    q, n = len(queries), len(vectors)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    place = np.full((q, beam), -1, np.int64)
    score = np.full((q, beam), -np.inf, vectors.dtype)
    is_open = np.ones((q, beam), bool)
    place[:, 0], score[:, 0], is_open[:, 0] = start, queries @ vectors[start], False
    seen[:, start] = True
    active = np.arange(q)
    while len(active):
        waiting = np.where(is_open[active], -np.inf, score[active])
        top = np.argpartition(-waiting, min(expand, beam) - 1, axis=1)[:, :expand]
        rows = np.arange(len(active))[:, None]
        chosen = np.isfinite(waiting[rows, top])
        going = chosen.any(axis=1)
        active, top, chosen = active[going], top[going], chosen[going]
        if not len(active):
            break
        rows = np.arange(len(active))[:, None]
        block = is_open[active]
        block[rows, top] |= chosen
        is_open[active] = block
        at = np.where(chosen, place[active[:, None], top], -1)
        near = np.where(at[:, :, None] >= 0, edges[at], -1).reshape(len(active), -1)
        near[near < 0] = n
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[active[:, None], near]] = n
        seen[active[:, None], near] = True
        r, c = np.nonzero(near < n)
        fresh = np.full(near.shape, -np.inf, vectors.dtype)
        for i in range(0, len(r), 1 << 15):
            a, b = r[i : i + (1 << 15)], c[i : i + (1 << 15)]
            fresh[a, b] = np.einsum("ij,ij->i", vectors[near[a, b]], queries[active[a]])
        all_score = np.concatenate([score[active], fresh], axis=1)
        all_place = np.concatenate([place[active], np.where(near < n, near, -1)], axis=1)
        all_open = np.concatenate([is_open[active], near == n], axis=1)
        best = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        score[active], place[active], is_open[active] = all_score[rows, best], all_place[rows, best], all_open[rows, best]
        is_open[active] |= ~np.isfinite(score[active])
    order = np.argsort(-score, axis=1, kind="stable")
    rows = np.arange(q)[:, None]
    return place[rows, order], score[rows, order]


def robust_prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each point up to ``degree`` of its candidates (-1 fills), nearest first and diverse.

    A candidate falls once a kept one is ``relax`` times nearer to it than the point is.
    """
    own = vectors[points]
    near = np.where((candidates == points[:, None]) | (candidates < 0), -1, candidates)
    near = np.sort(near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    theirs = vectors[near]
    distance = np.maximum(0, 2 - 2 * (theirs @ own[:, :, None])[:, :, 0])
    distance[near < 0] = np.inf
    order = np.argsort(distance, axis=1)[:, : 3 * degree]
    rows = np.arange(len(points))[:, None]
    near, distance, theirs = near[rows, order], distance[rows, order], theirs[rows, order]
    between = np.maximum(0, 2 - 2 * (theirs @ theirs.transpose(0, 2, 1)))
    alive = np.isfinite(distance)
    kept = np.full((len(points), degree), -1, np.int64)
    all_rows = np.arange(len(points))
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        kept[some, k] = near[all_rows, first][some]
        # Squared distances, so the tolerance is squared too.
        alive &= relax * relax * between[all_rows, first] > distance
        alive[all_rows, first] = False
    return kept


def build_graph(vectors: np.ndarray, cfg: Settings) -> tuple[np.ndarray, int]:
    """Edges and the starting place of the graph over unit vectors."""
    n = len(vectors)
    rng = np.random.Generator(np.random.PCG64(cfg.seed))
    degree = min(cfg.degree, max(1, n - 1))
    start = int(np.argmax(vectors @ vectors.mean(axis=0)))
    if n == 1:
        return np.full((1, 1), -1, np.int64), 0
    edges = rng.integers(0, n, (n, degree))
    order = rng.permutation(n)
    beam = min(n, cfg.build_beam)
    for lo in range(0, n, cfg.batch):
        points = order[lo : lo + cfg.batch]
        met, _ = beam_search(vectors, edges, vectors[points], start, beam)
        edges[points] = robust_prune(vectors, points, np.concatenate([met, edges[points]], axis=1), degree, cfg.relax)
        # Edges back; a vector that gets too many prunes them anew.
        a = np.repeat(points, degree)
        b = edges[points].ravel()
        a, b = a[b >= 0], b[b >= 0]
        by = np.argsort(b, kind="stable")
        a, b = a[by], b[by]
        target, first, count = np.unique(b, return_index=True, return_counts=True)
        extra = np.full((len(target), int(count.max())), -1, np.int64)
        slot = np.arange(len(b)) - np.repeat(first, count)
        extra[np.repeat(np.arange(len(target)), count), slot] = a
        for i in range(0, len(target), 256):
            t = target[i : i + 256]
            edges[t] = robust_prune(vectors, t, np.concatenate([edges[t], extra[i : i + 256]], axis=1), degree, cfg.relax)
    return edges, start


def _matrix(table: pa.Table, width: int | None, name: str = "embedding") -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, width or -1)


def _units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, computed in double precision a few at a time."""
    out = np.empty(vectors.shape, np.float32)
    for lo in range(0, len(vectors), 1024):
        out[lo : lo + 1024] = unit(vectors[lo : lo + 1024].astype(np.float64))
    return out


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, cfg: Settings = Settings()
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows found for each query, by cosine.

    ``vectors`` and ``queries`` have ``(vec_id, embedding)``; a query's own vec_id is no
    candidate. Ties go to the smaller vec_id. Every usable row is indexed: equal vectors are one
    place of a graph that stands for their k + 1 smallest vec_ids, which is all that can be
    among the nearest. Vectors that are null, zero, or hold null or non-finite components take
    no part, nor do rows without a vec_id; vectors are searched among those of their length.
    Vectors of doubles are not narrowed. Equal rows count once. Different vectors under one
    vec_id are candidates of their own, and queries of their own, with ranks from 1 each. No
    vectors or no queries give no rows; other columns are not looked at.
    Each shard's graph is written once; queries go to every graph in blocks of bounded size.
    """
    given = as_given(F.col("embedding"), vectors.schema["embedding"].dataType)

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), given.alias("embedding"))
        return df.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("embedding"))

    rows = clean(vectors).distinct()
    order = Window.partitionBy("embedding").orderBy("vec_id")
    places = staged(
        rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
        .groupBy("dim", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vector-places")
    per_dim = places.groupBy("dim").agg(F.ceil(F.count("*") / cfg.shard).cast("int").alias("shards"))
    asked = staged(clean(queries).distinct(), "vector-queries")
    per_block = asked.groupBy("dim").agg(F.ceil(F.count("*") / cfg.block).cast("int").alias("blocks"))
    # One row per vector length.
    per_dim = F.broadcast(per_dim.join(per_block, "dim"))
    dealt = places.join(per_dim, "dim").withColumn("shard", F.pmod(F.hash("embedding"), "shards"))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        edges, start = build_graph(_units(_matrix(table, key[0].as_py())), cfg)
        n, width = edges.shape
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(edges.ravel(), pa.int32()))
        return table.select(["dim", "shard", "embedding", "ids"]).append_column(
            "place", pa.array(np.arange(n), pa.int32())).append_column(
            "start", pa.array(np.full(n, start), pa.int32())).append_column("edges", lists)

    graphs = staged(
        dealt.select("dim", "shard", "embedding", "ids").transform(shipped).groupBy("dim", "shard").applyInArrow(
            build, f"dim int, shard int, embedding {places.schema['embedding'].dataType.simpleString()}, "
            "ids array<long>, place int, start int, edges array<int>"),
        "vector-graphs")
    shown = graphs.join(per_dim, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = (
        asked.join(per_dim, "dim").withColumn("block", F.pmod(F.hash("vec_id", "embedding"), "blocks"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))))

    def search(key: tuple, graph: pa.Table, asks: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        q, v_of, p, s = [], [], [], []
        if graph.num_rows and asks.num_rows:
            graph = graph.take(pa.array(np.argsort(graph.column("place").to_numpy())))
            own, theirs = _matrix(graph, dim), _matrix(asks, dim)
            base, edges = _units(own), _matrix(graph, None, "edges")
            start = graph.column("start")[0].as_py()
            ids, query_ids = graph.column("ids").to_pylist(), asks.column("vec_id").to_pylist()
            vector_of = asks.column("vector").to_pylist()
            beam = min(len(own), cfg.beam)
            for lo in range(0, len(theirs), cfg.batch):
                wide = held(theirs[lo : lo + cfg.batch].astype(np.float64))
                met, _ = beam_search(base, edges, _units(wide), start, beam)
                for x, places_met in enumerate(met):
                    at = places_met[places_met >= 0]
                    v, near = wide[x], held(own[at].astype(np.float64))
                    exact = (near @ v) / (np.linalg.norm(near, axis=1) * np.linalg.norm(v))
                    best = np.lexsort((np.array([ids[a][0] for a in at]), -exact))[: k + 1]
                    for b in best:
                        for i in ids[at[b]]:
                            if i != query_ids[lo + x]:
                                q.append(query_ids[lo + x])
                                v_of.append(vector_of[lo + x])
                                p.append(i)
                                s.append(float(exact[b]))
        return pa.table({"query_id": pa.array(q, pa.int64()), "vector": pa.array(v_of, pa.int64()), "vec_id": pa.array(p, pa.int64()), "score": pa.array(s, pa.float64())})

    by = ("dim", "shard", "block")
    found = shown.select(*by, "embedding", "ids", "place", "start", "edges").groupBy(*by).cogroup(
        sent.select(*by, "vec_id", "embedding", F.xxhash64("embedding").alias("vector")).groupBy(*by)).applyInArrow(
            search, "query_id long, vector long, vec_id long, score double")
    rank = Window.partitionBy("query_id", "vector").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
