"""Sliced streaks against a plain loop, on uneven logs."""

import random
from bisect import bisect_left
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from listwright.functions.ordered import failure_streak, slice_of, split_points

START = datetime(2024, 1, 1)


def loop(rows, before=None):
    streak, out = dict(before or {}), {}
    for key, ts, seq, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        streak[key] = 0 if ok else streak.get(key, 0) + 1
        out[seq] = streak[key]
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("slices", [2, 7, 40])
def test_streak(spark, seed, slices):
    rnd = random.Random(seed)
    rows = []
    for seq in range(300):
        key = "hot" if rnd.random() < 0.5 else rnd.choice("abcd")
        # Half of the log shares one instant, so that order falls to the sequence number.
        at = START if rnd.random() < 0.5 else START + timedelta(minutes=rnd.randrange(50))
        rows.append((key, at, seq, rnd.random() < (0.02 if key == "hot" else 0.4)))
    df = spark.createDataFrame(rows, "source string, ts timestamp, seq bigint, ok boolean")
    got = {r.seq: r.streak for r in failure_streak(df, "source", "ts", "seq", "ok", slices=slices).collect()}
    assert got == loop(rows)


def test_streak_goes_on_from_before(spark):
    rows = [("a", START, 1, False), ("a", START, 2, False), ("a", START, 3, True), ("b", START, 4, False), ("a", START, 5, False)]
    df = spark.createDataFrame([(*r, {"a": 4, "b": 1}[r[0]]) for r in rows], "source string, ts timestamp, seq bigint, ok boolean, b bigint")
    got = {r.seq: r.streak for r in failure_streak(df, "source", "ts", "seq", "ok", start="b", slices=3).collect()}
    assert got == loop(rows, {"a": 4, "b": 1})


def test_slices_have_no_ceiling(spark):
    df = spark.range(20_000)
    (cuts,) = split_points(df, F.col("id"), slices=3000)
    assert len(cuts) == 2999
    got = df.select("id", slice_of("id", "id", cuts, [5, 9]).alias("s")).collect()
    place = lambda x, at: 2 * bisect_left(at, x) + (x in at)
    held = set(cuts)
    for r in got:
        base = 2 * bisect_left(cuts, r.id) + (r.id in held)
        assert r.s == base * 5 + (place(r.id, [5, 9]) if base % 2 else 0)
    sizes = df.groupBy(slice_of("id", "id", cuts, [])).count().agg(F.max("count")).first()[0]
    assert sizes < 20
