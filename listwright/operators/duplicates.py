"""Listings of different feeds that may be one business: equal references, or nearly equal titles.

Nothing is merged. Titles are compared as sets of letter triples of their words, so neither the
order of words nor a misspelt one hides a likeness. Candidates come from a prefix filter: with
every set ordered by how rare its triples are, two sets as similar as asked for share one among
their first few. That index lies within blocks of place and numbers in the title. Equal titles
are compared once, and of their prices only the chains that neighbours make; where an index entry
has many titles, price bands divide it.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from listwright.functions.groups import linked_groups
from listwright.operators.changes import normal_words
from listwright.session import ship, written


@dataclass(frozen=True)
class Likeness:
    """Titles are alike with ``alike`` of 100 triples in common, prices within ``apart`` of 100.

    ``tile`` is how many titles of one index entry are compared at once, and ``few`` up to how
    many the comparison is a plain join; neither changes what is found.
    """

    alike: int = 70
    apart: int = 5
    tile: int = 512
    few: int = 64


def title_triples(title: Column) -> Column:
    """Letter triples of the title's words that hold no digit, with marks at both ends of a word."""
    words = F.filter(F.split(normal_words(title), " "), lambda w: (w != "") & ~w.rlike("[0-9]"))
    marked = F.transform(words, lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    triples = F.transform(marked, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(triples))


def title_numbers(title: Column) -> Column:
    """The title's words with a digit, in order; titles of different numbers are not alike."""
    words = F.filter(F.split(normal_words(title), " "), lambda w: w.rlike("[0-9]"))
    return F.array_join(F.array_sort(words), " ")


def price_band(price: Column, cfg: Likeness, part: float = 1.1) -> Column:
    """Prices as near as asked for lie in the same band or the next one; prices in a band of half
    that width or less (``part``) are all as near."""
    width = -log(1 - cfg.apart / 100) * part
    return F.when(price < 1, F.lit(-1)).otherwise(F.floor(F.log(price.cast("double")) / width)).cast("long")


def _near(low: Column, high: Column, other_low: Column, other_high: Column, cfg: Likeness) -> Column:
    """Whether two chains of prices have prices as near as asked for; chains that overlap do."""
    p, q = F.least(high, other_high), F.greatest(low, other_low)
    return 100 * (q - p) <= cfg.apart * q


def _classes(listings: DataFrame, cfg: Likeness) -> tuple[DataFrame, DataFrame]:
    """Rows ``(id, source, sign, cell)``, and classes ``(sign, block, triples, low, high, runs, cells)``.

    Listings with equal triples, numbers and place are one class, however many they are. Sorted
    by price, those of a class hang together in chains whose neighbours are as near as asked for.
    Each of its ``runs(class_id, low, high)`` is such a chain, and two chains are near where they
    overlap or their nearest ends are near. Chains stand so far apart that a class has a bounded
    number. They are put together from ``cells(cell, class_id)`` of prices that are all near.
    """
    price = F.col("asking_price").cast("long")
    rows = listings.select(
        "id", "source", F.array_sort(title_triples(F.col("title"))).alias("triples"),
        F.concat_ws("|", "location_state", title_numbers(F.col("title"))).alias("block"), price.alias("price"),
    ).filter(F.col("location_state").isNotNull() & (F.col("price") >= 0) & (F.size("triples") > 0))
    sign = F.unhex(F.sha2(F.concat_ws("|", "block", F.array_join("triples", " ")), 256))
    rows = written(rows.withColumns({"sign": sign, "cell": price_band(F.col("price"), cfg, 0.5)}), "title-rows")
    cells = rows.groupBy("sign", "cell").agg(F.min("id").alias("id"), F.min("price").alias("low"), F.max("price").alias("high"))
    # A class has at most so many cells as there are half bands up to the largest price.
    line = Window.partitionBy("sign").orderBy("cell")
    before = F.lag("high").over(line)
    starts = F.when(before.isNotNull() & _near(F.col("low"), F.col("high"), before, before, cfg), 0).otherwise(1)
    runs = cells.withColumn("starts", starts).withColumn("run", F.sum("starts").over(line)).groupBy("sign", "run").agg(
        F.min("id").alias("class_id"), F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("cell").alias("cells"))
    chains = runs.groupBy("sign").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list(F.struct("class_id", "low", "high")).alias("runs"),
        F.flatten(F.collect_list(F.transform("cells", lambda c: F.struct(c.alias("cell"), F.col("class_id"))))).alias("cells"))
    titles = rows.groupBy("sign").agg(F.any_value("block").alias("block"), F.any_value("triples").alias("triples"))
    return rows.select("id", "source", "sign", "cell"), titles.join(chains, "sign")


def _by_rarity(classes: DataFrame) -> DataFrame:
    """Classes with their triples ordered from the rarest on."""
    each = classes.select("sign", F.explode("triples").alias("triple"))
    often = each.groupBy("triple").agg(F.count("*").alias("often"))
    ordered = each.join(often, "triple").groupBy("sign").agg(
        F.array_sort(F.collect_list(F.struct("often", "triple"))).alias("ordered"))
    kept = classes.select("sign", "block", "low", "high", "runs")
    return kept.join(ordered, "sign").withColumn("triples", F.col("ordered.triple")).drop("ordered")


def _entries(classes: DataFrame, cfg: Likeness) -> DataFrame:
    """Index entries: a class under each of its first triples."""
    size = F.size("triples")
    # As many in front that no set as similar can avoid them all.
    front = size - F.ceil(size * cfg.alike / F.lit(100.0)).cast("int") + 1
    return classes.select("*", F.explode(F.slice("triples", F.lit(1), front)).alias("triple"))


def _alike(cfg: Likeness) -> Column:
    """Whether a and b of one entry are alike, and the entry is the one that tells."""
    common = F.array_intersect("a.triples", "b.triples")
    both = F.size(common)
    alike = 100 * both >= cfg.alike * (F.size("a.triples") + F.size("b.triples") - both)
    # The rarest triple in common stands in front of both.
    return (F.get(common, F.lit(0)) == F.col("a.triple")) & alike


def _title_links(entries: DataFrame, classes: DataFrame, cfg: Likeness) -> DataFrame:
    """Links among the few classes of an entry: alike titles once, then their runs side by side."""
    a, b = entries.alias("a"), entries.alias("b")
    pair = (F.col("a.block") == F.col("b.block")) & (F.col("a.triple") == F.col("b.triple")) & (F.col("a.sign") < F.col("b.sign"))
    near = _near(F.col("a.low"), F.col("a.high"), F.col("b.low"), F.col("b.high"), cfg)
    pairs = a.join(b, pair & near & _alike(cfg)).select(F.col("a.sign").alias("x"), F.col("b.sign").alias("y"))
    sides = pairs.select("x", "y", F.explode(F.array("x", "y")).alias("sign"))
    runs = classes.select("sign", F.explode("runs").alias("run")).select("sign", "run.*")
    # By their lower ends, a run can only be near the last one of the other title before it.
    line = Window.partitionBy("x", "y").orderBy("low")
    first, here = F.col("sign") == F.col("x"), F.struct("class_id", "low", "high")
    last = [F.last(F.when(side, here), ignorenulls=True).over(line) for side in (~first, first)]
    met = sides.join(runs, "sign").withColumn("other", F.when(first, last[0]).otherwise(last[1]))
    return met.filter(F.col("other").isNotNull() & _near(F.col("low"), F.col("high"), F.col("other.low"), F.col("other.high"), cfg)).select(
        F.col("class_id").alias("a"), F.col("other.class_id").alias("b"))


def _on_shelves(entries: DataFrame, classes: DataFrame, cfg: Likeness) -> DataFrame:
    """Runs of the classes under each entry, on the shelves of their price bands and the next one."""
    bands = F.sequence(price_band(F.col("run.low"), cfg), price_band(F.col("run.high"), cfg) + 1)
    runs = classes.select("sign", F.explode("runs").alias("run")).select(
        "sign", "run.*", price_band(F.col("run.low"), cfg).alias("band"), F.explode(bands).alias("shelf"))
    return entries.select("sign", "block", "triple", "triples").join(runs, "sign")


def _plain_links(entries: DataFrame, cfg: Likeness) -> DataFrame:
    """Links among the few runs of a shelf, each found on one shelf only."""
    a, b = entries.alias("a"), entries.alias("b")
    key = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("block", "triple", "shelf")]
    # The higher band is on both shelves.
    once = F.col("a.shelf") == F.greatest("a.band", "b.band")
    near = _near(F.col("a.low"), F.col("a.high"), F.col("b.low"), F.col("b.high"), cfg)
    pair = (F.col("a.class_id") < F.col("b.class_id")) & once & near & _alike(cfg)
    for k in key:
        pair = k & pair
    return a.join(b, pair).select(F.col("a.class_id").alias("a"), F.col("b.class_id").alias("b"))


def _forest(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that hold together what the pairs of places x, y hold together."""
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def tile_links(table: pa.Table, cfg: Likeness) -> pa.Table:
    """Links that hold together the alike classes of one tile: at most one per class."""
    table = table.combine_chunks()
    lists = table.column("triples").combine_chunks()
    names, which = np.unique(lists.flatten().to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    size = np.diff(lists.offsets.to_numpy())
    own = np.zeros((len(size), len(names)), np.float32)
    own[np.repeat(np.arange(len(size)), size), which] = 1
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    side = table.column("part").to_numpy()
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    both = (own[left] @ own[right].T).astype(np.int64)
    low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
    p, q = np.minimum(high[left][:, None], high[right][None, :]), np.maximum(low[left][:, None], low[right][None, :])
    near = (100 * both >= cfg.alike * (size[left][:, None] + size[right][None, :] - both)) & (
        100 * (q - p) <= cfg.apart * q)
    x, y = np.nonzero(near)
    ids = table.column("class_id").to_numpy(zero_copy_only=False)
    a, b = _forest(ids, left[x], right[y])
    return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})


def _tiled_links(entries: DataFrame, cfg: Likeness) -> DataFrame:
    """Links among the many classes of an entry, tile by tile; a tile writes at most a link per class."""
    parts = F.ceil(F.col("members") / cfg.tile).cast("int")
    dealt = entries.withColumn("parts", parts).withColumn("part", F.pmod(F.hash("class_id"), "parts"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = other.select(
        "block", "triple", "shelf", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        "part", "class_id", "low", "high", "triples")

    def run(tile: pa.Table) -> pa.Table:
        return tile_links(tile, cfg)

    ship(entries.sparkSession)
    return tiles.groupBy("block", "triple", "shelf", "i", "j").applyInArrow(run, "a string, b string")


def alike_links(classes: DataFrame, cfg: Likeness = Likeness()) -> DataFrame:
    """``(a, b)``: links of runs of alike classes, all or enough to hold together what all would."""
    key = ["block", "triple"]
    entries = _entries(classes.drop("runs"), cfg)
    count = entries.groupBy(*key).agg(F.count("*").alias("members")).filter("members > 1")
    entries = written(entries.join(count, key), "title-entries")
    links = _title_links(entries.filter(F.col("members") <= cfg.few), classes, cfg)
    # Where an entry has many titles, prices keep them apart.
    shelves = _on_shelves(entries.filter(F.col("members") > cfg.few), classes, cfg)
    count = shelves.groupBy(*key, "shelf").agg(F.count("*").alias("members")).filter("members > 1")
    shelves = written(shelves.join(count, [*key, "shelf"]), "title-shelves")
    few = shelves.filter(F.col("members") <= cfg.few)
    return links.unionByName(_plain_links(few, cfg)).unionByName(_tiled_links(shelves.filter(F.col("members") > cfg.few), cfg))


def likely_duplicates(listings: DataFrame, cfg: Likeness = Likeness()) -> DataFrame:
    """``(id, source, kind, group_id, n_listings)`` for listings of a group that spans feeds.

    A ``strong`` group shares a broker reference. A ``possible`` one hangs together by listings
    with nearly equal titles and prices and the same state and numbers, and is only a flag.
    ``listings(id, source, broker_ref, title, location_state, asking_price)``; one without
    title words, place or price joins no possible group. A group is named by its smallest id.
    """
    ref = F.nullif(normal_words(F.col("broker_ref")), F.lit(""))
    named = listings.select("id", "source", ref.alias("key")).filter(F.col("key").isNotNull())
    rows, classes = _classes(listings, cfg)
    classes = written(classes, "title-classes")
    groups = linked_groups(alike_links(written(_by_rarity(classes), "title-sets"), cfg))
    cells = classes.select("sign", F.explode("cells").alias("at")).select("sign", "at.*")
    of_cell = cells.join(groups.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "sign", "cell", F.coalesce("group_id", "class_id").alias("key"))
    alike = rows.join(of_cell, ["sign", "cell"]).select("id", "source", "key")
    return _across_feeds(named, "strong").unionByName(_across_feeds(alike, "possible"))


def _across_feeds(rows: DataFrame, kind: str) -> DataFrame:
    groups = rows.groupBy("key").agg(
        F.min("id").alias("group_id"), F.count("*").alias("n_listings"), (F.min("source") != F.max("source")).alias("spans"))
    return rows.join(groups.filter("spans").drop("spans"), "key").select(
        "id", "source", F.lit(kind).alias("kind"), "group_id", "n_listings")
