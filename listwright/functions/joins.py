"""Joins on keys that may be very uneven or missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def spread(key: Column, *by) -> Column:
    """A join key whose nulls are told apart, so that rows without a key, which match
    nothing, do not all gather in one partition of an outer join."""
    return F.coalesce(key, F.concat(F.lit("\x00"), F.xxhash64(*by).cast("string")))


def joined(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """A left join that does not move rows without a key, as they match nothing."""
    lone = rows.filter(F.col(key).isNull())
    return rows.filter(F.col(key).isNotNull()).join(known, key, "left").unionByName(lone, allowMissingColumns=True)
