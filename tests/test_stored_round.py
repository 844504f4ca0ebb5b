"""Rounds over stored tables, and moves over stored versions."""

import json
import os
import shutil
from datetime import timedelta


from listwright import config as C
from listwright.operators import changes, cycle
from listwright.schemas import PAGES
from listwright.sources import snapshots
from tests.test_round import CARD, GOOD, T0, now

DETAILS = "id string, source string, http_status int, html string"


def test_stored_rounds(spark, tmp_path):
    root, feeds = str(tmp_path / "store"), str(tmp_path / "feeds.json")
    with open(feeds, "w") as out:
        json.dump({"sources": [{"name": C.CARD_FEED, "adapter": "cards", "baseUrl": C.CARD_BASE, "searchUrl": C.CARD_SEARCH, "pollIntervalMinutes": 60, "maxPages": 5, "enabled": True}]}, out)
    pages = spark.createDataFrame([(C.CARD_FEED, None, 1, "u", T0, 200, CARD.format(1) + CARD.format(2))], PAGES)
    details = spark.createDataFrame([(f"{C.CARD_FEED}:1", C.CARD_FEED, 200, GOOD)], DETAILS)
    empty = cycle.stored_tables(spark, root)
    assert {t: df.count() for t, df in empty.items()} == {"listings": 0, "sources": 0, "outbox": 0, "activity": 0}
    assert cycle.stored_round(spark, root, feeds, pages, details, now(T0), "2024-05-02") == 0
    one = cycle.stored_tables(spark, root)
    assert {r.id: r.processing_state for r in one["listings"].collect()} == {f"{C.CARD_FEED}:1": "done", f"{C.CARD_FEED}:2": "retry"}
    assert {r.name: r.consecutive_failures for r in one["sources"].collect()} == {C.CARD_FEED: 0}
    assert {(r.listing_id, r.delivery_state) for r in one["activity"].collect()} == {(f"{C.CARD_FEED}:1", "confirmed")}
    assert one["outbox"].filter("kind = 'digest'").count() == 1
    # The next round goes on from there: nothing is sent again, the log keeps its row.
    assert cycle.stored_round(spark, root, feeds, pages, details, now(T0 + timedelta(hours=4)), "2024-05-02") == 1
    two = cycle.stored_tables(spark, root)
    assert two["activity"].count() == 1 and "No new candidates" in two["outbox"].filter("kind = 'digest'").first().text
    # A round that broke off before its mark does not count, and is written again.
    shutil.move(os.path.join(root, "rounds", "v=1", "_SUCCESS"), str(tmp_path / "mark"))
    assert cycle.stored_tables(spark, root)["outbox"].filter("kind = 'digest'").first().text == one["outbox"].filter("kind = 'digest'").first().text
    assert cycle.stored_round(spark, root, feeds, pages, details, now(T0 + timedelta(hours=4)), "2024-05-02") == 1
    assert {r.id for r in cycle.stored_tables(spark, root)["listings"].collect()} == {f"{C.CARD_FEED}:1", f"{C.CARD_FEED}:2"}


def test_moves_over_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    said = [{"a": 1, "b": 5}, {"a": 2}, {"a": 2, "b": 5, "c": 9}, {"a": 1, "b": None, "c": 9}]
    for v, prices in enumerate(said):
        df = spark.createDataFrame(list(prices.items()), "id string, asking_price long")
        snapshots.write_version(df, root, v)
    kind = df.schema
    got = {tuple(r) for r in changes.change_history(snapshots.read_history(spark, root, kind), ("asking_price",)).collect()}
    assert got == {("a", 1, "asking_price", "1", "2"), ("a", 3, "asking_price", "2", "1"), ("b", 3, "asking_price", "5", None)}
    late = changes.change_history(snapshots.read_history(spark, root, kind, after=1, upto=3), ("asking_price",))
    assert {(r.id, r.version) for r in late.collect()} == {("a", 3), ("b", 3)}
    assert snapshots.read_history(spark, str(tmp_path / "none"), kind).count() == 0
