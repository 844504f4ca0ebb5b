"""Mixing sources to target weights by repeating and drawing documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``sized(source, size)``; one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share the size of
    everything. None gets more than ``most`` times its own size: what is over goes to the
    others by weight until none is above. Sources that fill up do so in the order of
    limit / weight, so the level at which the rest stands follows from running sums.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.get(F.array(*map(F.lit, weights)), turn.cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    per = per.withColumn("level", left / F.sum("weight").over(after))
    full = F.col("limit") < F.col("level") * F.col("weight")
    per = per.withColumn("level", F.max(F.when(~full, F.col("level"))).over(everything))
    return per.select(
        "source", "source_size",
        F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit").cast("double"))).alias("target"))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def planned(docs: DataFrame, seed: int = 5, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(doc_id, size, source_size, target, copies, row)``: how often the mix takes each document.

    A source's repetition rate is target / size. Each document stands floor(rate) times, and
    once more if the draw of its doc_id falls below the fraction, so reruns agree and rows that
    repeat a doc_id are drawn alike. Null and empty texts have size 0; null is a source of its
    own, and rows without a doc_id share one draw. No documents give no rows. Texts are counted
    where they are, whatever their length. ``row`` holds the given row, so that its columns may
    have any names. Sizes are summed before the shuffle, so one large source costs no more;
    per-source rows are as many as there are sources.
    """
    # Nulls are told apart so that the key can be joined on.
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    sized = docs.select(
        "doc_id", key("source").alias("source_key"), "source", word_count(F.col("text")).alias("size"), F.struct("*").alias("row"))
    targets = source_targets(sized.select("source", "size"), weights, most)
    rates = targets.select(key("source").alias("source_key"), "source_size", "target")
    mixed = sized.join(rates, "source_key", "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    copies = F.least(F.floor(rate) + extra, F.lit(most).cast("long"))
    return mixed.select("doc_id", "size", "source_size", "target", copies.alias("copies"), "row")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, in its own columns."""
    plan = planned(docs, **settings).filter("copies > 0")
    copies = F.array_repeat(F.lit(0), F.col("copies").cast("int"))
    return plan.select("row", F.explode(copies)).select("row.*")
