"""Listings by id and by URL, laid out so that a batch of requests opens few folders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from listwright.schemas import LISTINGS, conform
from listwright.sources.keyed import KeyedTable

_STORED = T.StructType([*LISTINGS.fields, T.StructField("version", T.LongType())])
_NAMED = T.StructType([T.StructField("canonical_url", T.StringType()), T.StructField("id", T.StringType())])


def _newest(rows: DataFrame) -> DataFrame:
    rest = [c for c in _STORED.names if c != "id"]
    last = rows.groupBy("id").agg(F.max_by(F.struct(*rest), "version").alias("last"))
    return last.select("id", "last.*").select(*_STORED.names)


@dataclass(frozen=True)
class ListingIndex:
    """The newest row of every listing by id, and which ids have stood under a URL."""

    root: str
    buckets: int = 16
    fanout: int = 4

    @property
    def by_id(self) -> KeyedTable:
        return KeyedTable(f"{self.root}/by_id", _STORED, ("id",), _newest, self.buckets, self.fanout)

    @property
    def by_url(self) -> KeyedTable:
        return KeyedTable(f"{self.root}/by_url", _NAMED, ("canonical_url",), lambda rows: rows.distinct(), self.buckets, self.fanout)

    def add(self, listings: DataFrame, version: int) -> None:
        """Add rows that are new or have changed; versions are 0, 1, 2, ... without gaps."""
        rows = conform(listings, LISTINGS)
        self.by_id.append(rows.withColumn("version", F.lit(version).cast("long")), version)
        self.by_url.append(rows.filter("canonical_url is not null").select(*_NAMED.names), version)

    def of_ids(self, ids: DataFrame) -> DataFrame:
        """The rows of ``ids(id)``."""
        return self.by_id.lookup(ids).drop("version")

    def wanted(self, asked: DataFrame) -> DataFrame:
        """The rows that requests ``asked(listing_id, url)`` can name, by id or by their present URL.

        A URL that a listing has left behind still leads to its row, which no longer bears it, so
        whoever matches rows by URL goes by what they say now.
        """
        urls = asked.filter("url is not null").select(F.col("url").alias("canonical_url"))
        under = self.by_url.lookup(urls).select("id")
        named = asked.filter("listing_id is not null").select(F.col("listing_id").alias("id"))
        return self.of_ids(named.unionByName(under).distinct())
