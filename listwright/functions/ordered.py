"""Running values over long, uneven ordered logs.

A window over a key puts all rows of the key into one task. Here the order axis is cut
at sampled split points first, each (key, slice) is scanned on its own, and what a slice
passes on to the next is worked out on the few slice summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_SLICE = 1_000_000
FIRST_CUTS = 1024


def split_points(df: DataFrame, *values: Column, slices: int | None = None) -> list[list]:
    """Cut values of numeric columns.

    One pass counts the rows and finds ``FIRST_CUTS`` shares, from which fewer are taken; a
    log that needs more slices than that is passed once more. What comes to the driver is one
    row with a number per slice and column.
    """
    def found(parts: int) -> list:
        shares = [i / parts for i in range(1, parts)]
        return list(df.agg(F.count("*"), *(F.percentile_approx(v, shares, 10 * parts) for v in values)).first())

    n, *cuts = found(FIRST_CUTS)
    wanted, parts = slices or max(2, n // ROWS_PER_SLICE), FIRST_CUTS
    if wanted > parts:
        parts, cuts = wanted, found(wanted)[1:]
    at = [round(i * parts / wanted) - 1 for i in range(1, wanted)]
    return [sorted({c[i] for i in at}) if c else [] for c in cuts]


def _place(column: str, cuts: list) -> Column:
    """2i for a value between cuts i-1 and i, 2i+1 for cut i itself, by halving one literal array."""
    if not cuts:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    value = F.col(column)
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))))
    search = lambda i, step: F.when(F.get(held, i + step - 1) <= value, i + step).otherwise(i)
    is_cut = lambda i: F.coalesce(F.get(held, i - 1) == value, F.lit(False)).cast("int")
    return F.aggregate(steps, F.lit(0), search, lambda i: 2 * i - is_cut(i))


def slice_of(value: str, tie: str, cuts: list, tie_cuts: list) -> Column:
    """Slice label of two named bigint columns that grows with (value, tie).

    Values strictly between cuts share a slice. A value equal to a cut, which is what a
    very frequent value becomes, has slices of its own that are cut again by the tie. A
    label is found by halving, so many cuts cost a row few comparisons.
    """
    base = _place(value, cuts).cast("bigint")
    finer = _place(tie, tie_cuts)
    return base * (2 * len(tie_cuts) + 1) + F.when(base % 2 == 1, finer).otherwise(0)


def failure_streak(
    runs: DataFrame, key: str, ts: str, seq: str, ok: str, start: str | None = None,
    out: str = "streak", slices: int | None = None,
) -> DataFrame:
    """Failures in a row up to and including each run of a key.

    ``start`` may name a column with the streak each key had before the first run.
    """
    stamped = runs.withColumn("_at", F.unix_micros(ts))
    cuts, tie_cuts = split_points(stamped, F.col("_at"), F.col(seq), slices=slices)
    sliced = stamped.withColumn("_slice", slice_of("_at", seq, cuts, tie_cuts)).drop("_at")

    # Inside a slice, in one sorted pass: rows since the last success, which all failed.
    rows = Window.partitionBy(key, "_slice").orderBy(ts, seq)
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last_win = F.max(F.when(F.col(ok), F.col("_n"))).over(upto)
    scanned = (
        sliced.withColumn("_n", F.row_number().over(rows))
        .withColumn("_win", last_win)
        .withColumn("_run", F.col("_n") - F.coalesce("_win", F.lit(0)))
    )

    # One row per (key, slice): any success, and the length of the failing tail.
    last_row = F.max(F.struct("_n", "_win", "_run"))
    ends = scanned.groupBy(key, "_slice").agg(last_row.alias("_end"))
    by_slice = Window.partitionBy(key).orderBy("_slice")
    so_far = by_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    won = F.col("_end._win").isNotNull().cast("int")
    carried = (
        ends.withColumn("_group", F.sum(won).over(so_far))
        .withColumn(
            "_open",
            F.sum("_end._run").over(
                Window.partitionBy(key, "_group")
                .orderBy("_slice")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .select(
            key,
            "_slice",
            F.lag("_open", 1, 0).over(by_slice).alias("_carry"),
            (F.lag("_group", 1, 0).over(by_slice) == 0).alias("_first"),
        )
    )
    fresh = F.col("_win").isNull()
    value = F.col("_run") + F.when(fresh, F.col("_carry")).otherwise(0)
    if start is not None:
        value = value + F.when(fresh & F.col("_first"), F.coalesce(F.col(start), F.lit(0))).otherwise(0)
    return (
        scanned.join(carried, [key, "_slice"])
        .withColumn(out, value.cast("bigint"))
        .drop("_slice", "_n", "_win", "_run", "_carry", "_first")
    )
