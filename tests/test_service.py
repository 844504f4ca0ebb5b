"""Request batches from arrival to answers, listings, cards and the next digest."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from listwright import config as C
from listwright.operators import digest, service
from listwright.plans import views
from listwright.schemas import ACTIVITY, LISTINGS

T0 = datetime(2024, 5, 1)
NOW = "2024-05-02 00:00:00"
ASKED = "request_id long, listing_id string, url string, requested_at timestamp"
PAGES = "id string, source string, http_status int, html string"


def listings(spark, *rows):
    base = {"source": C.CARD_FEED, "title": "Old title", "processing_attempts": 0, "review_state": "new", "claimed_recurring": False, "evidenced_recurring": False,
            "first_seen": T0, "last_seen": T0}
    full = [base | {"source_listing_id": r["id"], "canonical_url": f"https://www.business2sell.com.au/businesses-details/x-{r['id']}.php"} | r for r in rows]
    return spark.createDataFrame([tuple(r.get(f.name) for f in LISTINGS.fields) for r in full], LISTINGS)


def test_look_ups_are_answered_and_worked_on(spark):
    stored = listings(
        spark, {"id": "done", "processing_state": "done", "last_fetched": T0, "fit_outcome": "promising"}, {"id": "busy", "processing_state": "processing"},
        {"id": "new", "processing_state": "new"}, {"id": "lost", "processing_state": "retry", "processing_attempts": 1}, {"id": "idle", "processing_state": "new"})
    url = "https://www.business2sell.com.au/businesses-details/cafe-77.php"
    at = [T0 + timedelta(minutes=i) for i in range(12)]
    asked = [
        (0, "done", None, at[0]), (1, "busy", None, at[1]), (2, "new", None, at[2]), (3, "new", "ignored", at[3]), (4, "lost", None, at[4]), (5, None, url, at[5]),
        (6, None, url, at[6]), (7, "nobody", None, at[7]), (8, None, None, at[8]), (9, "", "no url", at[9]), (10, None, "https://example.org/x-1", at[10])]
    html = "<html><body><h1>Fire Safety Services</h1><p>Fire safety testing. Established 20 years. Annual turnover of $900,000.</p></body></html>"
    new_id = f"{C.CARD_FEED}:77"
    pages = spark.createDataFrame([("new", C.CARD_FEED, 200, html), ("lost", C.CARD_FEED, 500, html), (new_id, C.CARD_FEED, 200, html), ("idle", C.CARD_FEED, 200, html)], PAGES)
    out = service.inspect_batch(spark.createDataFrame(asked, ASKED), stored, pages, F.lit(NOW).cast("timestamp"))
    answers = {r.request_id: r for r in out.answers.collect()}
    assert [answers[i].status for i in range(11)] == [
        "found", "processing", "queued", "queued", "queued", "created", "created", "not_found", "invalid", "invalid", "invalid"]
    assert [answers[i].message for i in (8, 9, 10)] == [C.ANSWERS["nothing_asked"], C.ANSWERS["bad_url"], C.ANSWERS["unsupported"]]
    assert {answers[i].answer_id for i in (5, 6)} == {new_id} and answers[0].card.startswith("*Inspection: Old title*") and answers[2].card is None
    after = {r.id: r for r in out.listings.collect()}
    assert set(after) == {"done", "busy", "new", "lost", "idle", new_id}
    assert {k: (v.processing_state, v.processing_attempts) for k, v in after.items()} == {
        "done": ("done", 0), "busy": ("processing", 0), "new": ("done", 1), "lost": ("retry", 2), "idle": ("new", 0), new_id: ("done", 1)}
    assert after[new_id].title == after["new"].title == "Fire Safety Services" and after["new"].content_hash and after["new"].fit_outcome
    sent = {r.event_key: r for r in out.outbox.collect()}
    assert set(sent) == {f"inspection:{i}:{after[i].content_hash}" for i in ("new", new_id)} and {r.kind for r in sent.values()} == {"inspection"}
    # Asked again, what was read is found, and nothing is done twice.
    again = service.inspect_batch(spark.createDataFrame(asked[2:7], ASKED), out.listings, pages, F.lit(NOW).cast("timestamp"))
    assert [r.status for r in again.answers.orderBy("request_id").collect()] == ["found", "found", "queued", "found", "found"]
    assert again.outbox.count() == 0
    nothing = service.inspect_batch(spark.createDataFrame([], ASKED), stored, pages, F.lit(NOW).cast("timestamp"))
    assert nothing.answers.count() == 0 and nothing.listings.count() == 5


def test_a_batch_moves_the_rows_it_names(spark, monkeypatch):
    """Of a large store only what is asked for, or what a new URL turns out to be, is written again."""
    kept = {}

    def spy(df, purpose, write=service.written):
        kept[purpose] = write(df, purpose)
        return kept[purpose]

    monkeypatch.setattr(service, "written", spy)
    stored = listings(
        spark, *({"id": f"l{i}", "processing_state": ("done", "new")[i % 2], "last_fetched": T0} for i in range(200)),
        {"id": "old", "source_listing_id": "77", "processing_state": "done", "fit_outcome": "promising"})
    asked = [(0, "l0", None, T0), (1, "l1", None, T0), (2, None, "https://www.business2sell.com.au/businesses-details/cafe-77.php", T0), (3, "nobody", None, T0)]
    out = service.inspect_batch(spark.createDataFrame(asked, ASKED), stored, spark.createDataFrame([], PAGES), F.lit(NOW).cast("timestamp"))
    assert {p: df.count() for p, df in kept.items() if p.startswith("inspect") and p not in ("inspect-listings", "inspections")} == {
        "inspect-stubs": 1, "inspect-named": 4, "inspect-mine": 3, "inspected": 2, "inspect-work": 1, "inspect-pages": 0, "inspect-results": 0, "inspect-changed": 2}
    after = {r.id: r for r in out.listings.collect()}
    assert len(after) == out.listings.count() == 201
    assert after["l1"].processing_state == "retry" and after["l3"].processing_state == "new" and after["l0"].processing_state == "done"
    assert after["old"].title == "On-demand inspection" and after["old"].canonical_url.endswith("cafe-77.php")
    assert [r.card is not None for r in out.answers.orderBy("request_id").collect()] == [True, False, False, False]


def test_reviews_leave_the_next_digest(spark):
    stored = listings(spark, *({"id": i, "processing_state": "done", "fit_outcome": "promising"} for i in "abcd"))
    activity = spark.createDataFrame([], ACTIVITY)
    rows = [(1, "a", "pass", "p", "price", T0), (2, "b", "watch", "p", None, T0), (3, "b", "archive", "p", None, T0), (4, "z", "pass", "p", None, T0),
            (5, "c", "pass", "", None, T0), (6, "a", "pursue", "q", None, T0 + timedelta(hours=1))]
    reviews = spark.createDataFrame(rows, "seq long, listing_id string, action string, actor string, reason string, decided_at timestamp")
    out = service.review_batch(reviews, stored, activity)
    answers = {r.seq: (r.verdict, r.message) for r in out.answers.collect()}
    assert answers[1] == ("accepted", "Listing marked as pass by p") and answers[3] == ("bad_action", C.ANSWERS["bad_action"])
    assert answers[4] == ("not_found", C.ANSWERS["not_found"]) and answers[5] == ("missing_fields", C.ANSWERS["missing_fields"])
    assert {r.id for r in digest.pending(out.listings, out.activity).collect()} == {"c", "d"}
    assert {r.id: r.review_state for r in out.listings.collect()} == {"a": "pursue", "b": "watch", "c": "new", "d": "new"}
    replay = service.review_batch(reviews, out.listings, out.activity)
    assert out.activity.count() == replay.activity.count() == 3


def test_stored_listings_join_facts_before_texts_are_made(spark, tmp_path):
    for name in ("orders", "customer", "lineitem", "part"):
        spark.createDataFrame([], views.SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = views.full_listings(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.index("https://bsale") < plan.index("Join") and rows.count() == 0
