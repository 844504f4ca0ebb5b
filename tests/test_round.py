"""Whole rounds over crafted pages."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from listwright import config as C
from listwright.operators import cycle
from listwright.schemas import ACTIVITY, LISTINGS, PAGES, SOURCES
from listwright.sources.feeds import default_feeds

T0 = datetime(2024, 5, 1, 21)
CARD = '<i data-listing-id="{0}"><a href="/businesses-details/shop-{0}.php" aria-label="Shop {0}">x</a></i>'
ITEMS = '<script type="application/ld+json">{{"@type":"ItemList","itemListElement":[{}]}}</script>'
GOOD = (
    "<h1>Pest round</h1><p>Asking Price: $900,000</p><p>Pest control. Turnover: $1.5m. EBITDA: $300k. Licensed, with service agreements.</p>"
    "<p>Location: Hill, Victoria 3000</p>"
)


def items(*ids):
    return ITEMS.format(",".join(f'{{"url":"https://bsale.com.au/listing/cafe-{i}"}}' for i in ids))


def now(at):
    return F.lit(at).cast("timestamp")


def digest_of(one):
    return one.outbox.filter("kind = 'digest'").first().text


def test_rounds(spark):
    pages = spark.createDataFrame(
        [
            (C.CARD_FEED, None, 1, "u", T0, 200, CARD.format(1) + CARD.format(2)),
            (C.CARD_FEED, None, 2, "u", T0, 200, CARD.format(2)),
            (C.CARD_FEED, None, 3, "u", T0, 200, CARD.format(9)),
            (C.ITEM_FEED, "vic", 1, "u", T0, 200, items(5)),
            (C.ITEM_FEED, "vic", 2, "u", T0, 404, ""),
            (C.ITEM_FEED, "nsw", 1, "u", T0, 500, ""),
        ],
        PAGES,
    )
    details = spark.createDataFrame(
        [(f"{C.CARD_FEED}:1", C.CARD_FEED, 200, GOOD), (f"{C.ITEM_FEED}:5", C.ITEM_FEED, 200, "<h1>Cafe</h1><p>A cafe.</p>"), (f"{C.CARD_FEED}:2", C.CARD_FEED, 500, "")],
        "id string, source string, http_status int, html string",
    )
    none = [spark.createDataFrame([], s) for s in (LISTINGS, SOURCES, ACTIVITY)]
    config = default_feeds(spark)
    one = cycle.run_round(*none, config, pages, details, now(T0), "2024-05-02")
    rows = {r.id: r for r in one.listings.collect()}
    assert set(rows) == {f"{C.CARD_FEED}:1", f"{C.CARD_FEED}:2", f"{C.ITEM_FEED}:5"}
    best = rows[f"{C.CARD_FEED}:1"]
    assert (best.fit_outcome, best.title, best.location_state, best.asking_price) == ("promising", "Pest round", "VIC", 900_000)
    assert rows[f"{C.CARD_FEED}:2"].processing_state == "retry"
    assert rows[f"{C.ITEM_FEED}:5"].fit_outcome == "excluded"
    feeds = {r.name: r for r in one.sources.collect()}
    assert feeds[C.CARD_FEED].coverage_complete and feeds[C.CARD_FEED].discovered_count == 2
    assert not feeds[C.ITEM_FEED].coverage_complete and feeds[C.ITEM_FEED].consecutive_failures == 0
    sent = {(r.listing_id, r.delivery_state) for r in one.activity.collect()}
    assert sent == {(best.id, "confirmed")}
    text = one.outbox.filter("kind = 'digest'").first().text
    assert "*Pest round · Hill, VIC · Asking $900k*" in text and f"{C.ITEM_FEED} ✓ (1 checked, 1 new ⚠️ partial)" in text

    # The next round finds both feeds down twice over: known rows stay, nothing is sent again.
    down = pages.withColumn("http_status", F.lit(500))
    two = cycle.run_round(one.listings, one.sources, one.activity, config, down, details, now(T0 + timedelta(hours=4)), "2024-05-02")
    three = cycle.run_round(two.listings, two.sources, two.activity, config, down, details, now(T0 + timedelta(hours=8)), "2024-05-02")
    assert {r.id for r in three.listings.collect()} == set(rows)
    assert {r.name: r.consecutive_failures for r in three.sources.collect()} == {C.CARD_FEED: 2, C.ITEM_FEED: 2}
    assert two.outbox.filter("kind = 'alert'").count() == 0 and three.outbox.filter("kind = 'alert'").count() == 2
    assert three.activity.count() == 1
    assert digest_of(three).endswith("_No new candidates yet; listings are still being processed._")
    done = one.listings.filter(F.col("processing_state") == "done")
    bare = cycle.run_round(done, one.sources, one.activity, config, down, details, now(T0 + timedelta(hours=4)), "2024-05-02")
    assert digest_of(bare).endswith("_No new candidates found; source coverage was incomplete._")

    # Too early: no feed is due, so none is tried.
    four = cycle.run_round(three.listings, three.sources, three.activity, config, down, details, now(T0 + timedelta(hours=9)), "x")
    assert {r.consecutive_failures for r in four.sources.collect()} == {2}


def test_recheck_and_shared_adapter(spark):
    other = "second_market"
    pages = spark.createDataFrame(
        [(name, None, page, "u", T0, 200, CARD.format(i) if page == 1 else "") for name, i in ((C.CARD_FEED, 1), (other, 7)) for page in (1, 2)],
        PAGES,
    )
    schema = "id string, source string, http_status int, html string"
    first = [(f"{C.CARD_FEED}:1", C.CARD_FEED, 200, GOOD), (f"{other}:7", other, 200, GOOD)]
    cards = default_feeds(spark).filter(F.col("name") == C.CARD_FEED)
    config = cards.unionByName(cards.withColumn("name", F.lit(other)))
    none = [spark.createDataFrame([], s) for s in (LISTINGS, SOURCES, ACTIVITY)]
    one = cycle.run_round(*none, config, pages, spark.createDataFrame(first, schema), now(T0), "2024-05-02")
    assert {r.id: r.asking_price for r in one.listings.collect()} == {f"{C.CARD_FEED}:1": 900_000, f"{other}:7": 900_000}
    assert {r.name for r in one.sources.filter("consecutive_failures = 0 and coverage_complete").collect()} == {C.CARD_FEED, other}

    # A week later one page states another price; the other came back as it was.
    later = T0 + timedelta(days=7)
    second = [(first[0][0], C.CARD_FEED, 200, GOOD.replace("900,000", "800,000")), first[1]]
    args = (config, pages, spark.createDataFrame(second, schema), now(later), "2024-05-09")
    two = cycle.run_round(one.listings, one.sources, one.activity, *args)
    got = {r.id: r for r in two.listings.collect()}
    assert {i: (r.asking_price, r.last_fetched, r.processing_state) for i, r in got.items()} == {
        f"{C.CARD_FEED}:1": (800_000, later, "done"), f"{other}:7": (900_000, later, "done")}
    moved = two.activity.filter("event_type = 'material_change'").collect()
    assert [(r.listing_id, r.value, r.reason, r.created_at) for r in moved] == [(f"{C.CARD_FEED}:1", "asking_price", "900000 -> 800000", later)]
    assert [r.text for r in two.outbox.filter("kind = 'change'").collect()] == [f"{C.CARD_FEED}:1 · asking_price: 900000 -> 800000"]

    # The same round again adds nothing to the log; before the recheck is due nothing is read.
    again = cycle.run_round(one.listings, one.sources, two.activity, *args)
    assert again.activity.count() == two.activity.count()
    early = cycle.run_round(one.listings, one.sources, one.activity, *args[:3], now(T0 + timedelta(days=6)), "x")
    assert {r.asking_price for r in early.listings.collect()} == {900_000}
