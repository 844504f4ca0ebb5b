"""Feed adapters: DataFrame of landed pages in, stubs or detail fields out.

An adapter is an object with ``kinds``, ``by_state``, ``discover`` and ``detail``; nothing is
called per row. ``discover`` takes search pages, ``detail`` takes detail pages with an ``id``.
A feed names its adapter in the configuration, so several feeds may share one.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from listwright import config as C
from listwright.operators import detail, discovery
from listwright.schemas import STUBS


class Adapter(Protocol):
    kinds: tuple[str, ...]
    by_state: bool

    def discover(self, pages: DataFrame) -> DataFrame: ...

    def detail(self, pages: DataFrame) -> DataFrame: ...


def _ok(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("http_status") == 200)


class CardFeed:
    """Page-numbered search results made of cards."""

    kinds = ("cards", C.CARD_FEED)
    by_state = False

    def discover(self, pages: DataFrame) -> DataFrame:
        return discovery.cards(_ok(pages))

    def detail(self, pages: DataFrame) -> DataFrame:
        return detail.card_details(_ok(pages))


class ItemListFeed:
    """Search results per state that carry a JSON-LD item list."""

    kinds = ("item_list", C.ITEM_FEED)
    by_state = True

    def discover(self, pages: DataFrame) -> DataFrame:
        return discovery.item_lists(_ok(pages))

    def detail(self, pages: DataFrame) -> DataFrame:
        return detail.item_details(_ok(pages))


ADAPTERS: tuple[Adapter, ...] = (CardFeed(), ItemListFeed())


def with_adapter(pages: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Add the ``adapter`` of each page's feed; a feed not configured is looked up by its name."""
    if config is None:
        return pages.withColumn("adapter", F.col("source"))
    named = config.select(F.col("name").alias("source"), F.col("adapter").alias("_adapter"))
    return pages.join(named, "source", "left").withColumn("adapter", F.coalesce("_adapter", "source")).drop("_adapter")


def read_by(adapter: Adapter) -> Column:
    return F.col("adapter").isin(*adapter.kinds)


def as_stubs(found: DataFrame) -> DataFrame:
    """Stub rows of one adapter's discovery, ordered by page and place for the upsert."""
    have = set(found.columns)
    stamped = found.withColumn("seen_at", F.col("fetched_at")).withColumn(
        "seq", F.col("page_no").cast("bigint") * 1_000_000 + F.col("pos")
    )
    return stamped.select(
        *(
            (F.col(f.name) if f.name in have | {"seen_at", "seq"} else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in STUBS.fields
        )
    )


def union_feeds(
    pages: DataFrame, adapters: Iterable[Adapter] = ADAPTERS, config: DataFrame | None = None
) -> DataFrame:
    """Stubs of all feeds; each adapter reads the pages of its own feeds only."""
    landed, out = with_adapter(pages, config), None
    for a in adapters:
        part = as_stubs(a.discover(landed.filter(read_by(a))))
        out = part if out is None else out.unionByName(part)
    return out


def union_details(
    pages: DataFrame, adapters: Iterable[Adapter] = ADAPTERS, config: DataFrame | None = None
) -> DataFrame:
    """Detail fields of all feeds, keyed by listing id."""
    landed, out = with_adapter(pages, config), None
    for a in adapters:
        part = a.detail(landed.filter(read_by(a))).select("id", *detail.FIELDS)
        out = part if out is None else out.unionByName(part)
    return out
