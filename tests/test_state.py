"""State machine of listings, feeds and activity."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from listwright.operators import changes, digest, feeds, requests, state
from listwright.schemas import ACTIVITY, LISTINGS, SOURCES, STUBS, conform

T0 = datetime(2024, 5, 1, 12)


def now():
    return F.lit(T0).cast("timestamp")


def stub(number, at, seq=0, **kw):
    row = dict.fromkeys(f.name for f in STUBS.fields)
    return {**row, "source": "s", "source_listing_id": number, "canonical_url": f"u{seq}", "seen_at": at, "seq": seq, **kw}


def stubs(spark, *rows):
    return spark.createDataFrame([tuple(r[f.name] for f in STUBS.fields) for r in rows], STUBS)


def stored(spark, **by_id):
    base = {"processing_state": "new", "processing_attempts": 0, "review_state": "new", "first_seen": T0, "last_seen": T0}
    rows = []
    for id_, kw in by_id.items():
        row = dict.fromkeys(f.name for f in LISTINGS.fields) | base | {"id": id_, "source": "s", "source_listing_id": id_, "canonical_url": id_} | kw
        rows.append(tuple(row[f.name] for f in LISTINGS.fields))
    return spark.createDataFrame(rows, LISTINGS)


def by_id(df, key="id"):
    return {r[key]: r for r in df.collect()}


def test_upsert_inserts_then_refreshes(spark):
    empty = spark.createDataFrame([], LISTINGS)
    first = state.upsert_stubs(empty, stubs(
        spark, stub("1", T0, 1, title="A", asking_price=5, advertised_status="new"),
        stub("1", T0 + timedelta(hours=1), 2, title=None, broker_name="B", advertised_status="sold")))
    row = first.first()
    assert (row.id, row.title, row.broker_name, row.asking_price, row.advertised_status) == ("s:1", "A", "B", 5, "new")
    assert (row.processing_state, row.review_state, row.processing_attempts, row.canonical_url) == ("new", "new", 0, "u2")
    worked = first.withColumns({"review_state": F.lit("pursue"), "revenue": F.lit(7).cast("bigint"), "processing_state": F.lit("done")})
    later = T0 + timedelta(days=1)
    again = state.upsert_stubs(worked, stubs(spark, stub("1", later, 3, asking_price=9, advertised_status="x"), stub("2", later, 4)))
    rows = by_id(again)
    assert len(rows) == 2 and rows["s:2"].processing_state == "new"
    one = rows["s:1"]
    assert (one.title, one.asking_price, one.advertised_status, one.revenue) == ("A", 9, "new", 7)
    assert (one.review_state, one.processing_state, one.first_seen, one.last_seen) == ("pursue", "done", T0, later)


def test_upsert_replay_changes_nothing(spark):
    batch = stubs(spark, stub("1", T0, 1, title="A"), stub("2", T0, 2))
    once = state.upsert_stubs(spark.createDataFrame([], LISTINGS), batch)
    assert sorted(map(str, state.upsert_stubs(once, batch).collect())) == sorted(map(str, once.collect()))


def test_claim_order_and_lease(spark):
    past, soon = T0 - timedelta(minutes=1), T0 + timedelta(minutes=1)
    df = stored(
        spark, old_retry={"processing_state": "retry", "first_seen": T0 - timedelta(days=9), "next_retry": T0},
        young={"first_seen": T0}, older={"first_seen": past}, waiting={"processing_state": "retry", "next_retry": soon},
        stale={"processing_state": "processing", "lease_claimed_at": T0 - timedelta(hours=2)}, done={"processing_state": "done"},
    )
    assert [r.id for r in state.select_claims(df, now(), 3).collect()] == ["older", "young", "old_retry"]
    assert {r.id for r in state.select_claims(df, now(), 9, lease_minutes=60).collect()} == {"older", "young", "old_retry", "stale"}
    got = by_id(state.claim_batch(df, now(), 2))
    assert {i for i, r in got.items() if r.processing_state == "processing"} == {"older", "young", "stale"}
    assert got["older"].lease_claimed_at == T0 and len(got) == 6


def test_failures_back_off_and_end(spark):
    df = stored(spark, **{f"a{n}": {"processing_state": "processing", "processing_attempts": n, "lease_claimed_at": T0} for n in range(9)})
    got = by_id(state.mark_failed(df, df.filter("id <> 'a1'"), now()))
    assert got["a1"].processing_state == "processing" and got["a1"].next_retry is None and got["a1"].lease_claimed_at == T0
    for n in (0, 2, 3, 4, 5, 6, 7, 8):
        row = got[f"a{n}"]
        assert row.processing_state == ("failed" if n >= 5 else "retry")
        assert row.next_retry - T0 == timedelta(minutes=min((n + 1) * 30, 240))
        assert row.processing_attempts == n + 1 and row.lease_claimed_at is None


def test_extraction_overwrites_facts_but_keeps_status(spark):
    df = stored(spark, a={"revenue": 5, "advertised_status": "sold", "title": "T", "evidenced_recurring": True}, b={"revenue": 6})
    results = spark.createDataFrame(
        [("a", None, "x", "excluded", ["r"], [], None)],
        "id string, revenue bigint, title string, outcome string, matched_rules array<string>, missing_facts array<string>, advertised_status string")
    got = by_id(state.mark_extracted(df, results, now()))
    a = got["a"]
    assert (a.revenue, a.advertised_status, a.title, a.fit_outcome, a.fit_reasons) == (None, "sold", "x", "excluded", ["r"])
    assert (a.processing_state, a.processing_attempts, a.evidenced_recurring, a.last_fetched) == ("done", 1, False, T0)
    assert got["b"].revenue == 6 and got["b"].processing_state == "new"


def test_unchanged_page_keeps_facts(spark):
    df = stored(spark, a={"processing_state": "done", "content_hash": "h", "revenue": 5}, b={"processing_state": "retry", "content_hash": "h"})
    fetched = spark.createDataFrame([("a", "h"), ("b", "h")], "id string, content_hash string")
    assert [r.id for r in state.changed_pages(df, fetched).collect()] == ["b"]
    got = by_id(state.refresh_unchanged(df, fetched, now()))
    assert got["a"].last_fetched == T0 and got["a"].revenue == 5 and got["b"].last_fetched is None


def test_delivery_is_keyed(spark):
    log = spark.createDataFrame([], ACTIVITY)
    entries = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    once = state.record_pending(log, entries, now())
    assert once.count() == 2 and state.record_pending(once, entries, now()).count() == 2
    key = once.filter("listing_id = 'a'").first().event_key
    assert key == "digest:2024-05-01:a"
    sent = state.confirm_delivery(once, spark.createDataFrame([(key, "ref")], "event_key string, message_ref string"))
    assert {(r.listing_id, r.delivery_state, r.message_ref) for r in sent.collect()} == {("a", "confirmed", "ref"), ("b", "pending", None)}
    ready = {"processing_state": "done", "fit_outcome": "promising"}
    queue = digest.pending(stored(spark, a=ready, b=ready, c=ready | {"fit_outcome": "excluded"}, d=ready | {"review_state": "pass"}), sent)
    assert {r.id for r in queue.collect()} == {"b"}


def test_reviews(spark):
    df = stored(spark, a={}, b={})
    asked = spark.createDataFrame(
        [("a", "watch", "p", None, T0, 1), ("a", "pass", "q", "price", T0 + timedelta(seconds=1), 2), ("b", "buy", "p", None, T0, 3),
         ("zz", "pass", "p", None, T0, 4), ("b", "pass", "", None, T0, 5), (None, "pass", "p", None, T0, 6)],
        "listing_id string, action string, actor string, reason string, decided_at timestamp, seq bigint")
    routed = requests.route_reviews(asked, df)
    assert {r.seq: r.verdict for r in routed.collect()} == {1: "accepted", 2: "accepted", 3: "bad_action", 4: "not_found", 5: "missing_fields", 6: "missing_fields"}
    good = routed.filter("verdict = 'accepted'")
    log = spark.createDataFrame([], ACTIVITY)
    current, log = state.record_reviews(df, log, good)
    assert {r.id: r.review_state for r in current.collect()} == {"a": "pass", "b": "new"}
    _, again = state.record_reviews(df, log, good)
    assert log.count() == again.count() == 2
    # A later sighting leaves the decision alone.
    seen = state.upsert_stubs(conform(current, LISTINGS), stubs(spark, stub("a", T0)))
    assert by_id(seen)["a"].review_state == "pass"


def test_requests(spark):
    df = stored(
        spark, done={"processing_state": "done", "canonical_url": "https://x.com/a-1", "last_fetched": T0}, busy={"processing_state": "processing"},
        new={"canonical_url": "https://x.com/b-2"}, twin={"canonical_url": "https://x.com/b-2", "processing_state": "done"})
    rows = [
        (1, "done", None), (2, "busy", None), (3, None, "https://x.com/b-2"), (4, None, "https://bsale.com.au/listing/c-77"),
        (5, None, "https://x.com/nothing"), (6, None, "https://x.org/a"), (7, "gone", None), (8, "", ""), (9, "gone", "https://x.com/a-1"),
    ]
    asked = spark.createDataFrame([(*r, T0) for r in rows], "request_id int, listing_id string, url string, requested_at timestamp")
    got = {r.request_id: (r.status, r.answer_id) for r in requests.route_inspections(asked, df).collect()}
    ms = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert got[1] == ("found", "done") and got[2] == ("processing", "busy") and got[3] == ("queued", "new")
    assert got[4] == ("created", "bsale:77") and got[5] == ("created", f"business2sell:manual:{ms}")
    assert got[6][0] == "invalid" and got[8][0] == "invalid"
    # A request that names an unknown id and a URL is served by the URL's listing never, but may be created.
    assert got[7][0] == "not_found"


def source(spark, **by_name):
    rows = []
    for name, kw in by_name.items():
        row = dict.fromkeys(f.name for f in SOURCES.fields) | {"name": name, "poll_interval_minutes": 240, "consecutive_failures": 0, "discovered_count": 0, "coverage_complete": False} | kw
        rows.append(tuple(row[f.name] for f in SOURCES.fields))
    return spark.createDataFrame(rows, SOURCES)


RUNS = "source string, ts timestamp, seq bigint, ok boolean, discovered bigint, checkpoint string, coverage_complete boolean"


def test_due_is_inclusive(spark):
    df = source(spark, never={}, exact={"last_attempt": T0 - timedelta(minutes=240)}, soon={"last_attempt": T0 - timedelta(minutes=239, seconds=59)})
    assert {r.name for r in feeds.due_sources(df, now()).collect()} == {"never", "exact"}


def test_runs_fold_into_sources(spark):
    df = source(spark, a={"consecutive_failures": 1, "last_success": T0}, b={"consecutive_failures": 3}, c={"error_status": "kept"})
    at = [T0 + timedelta(hours=i) for i in range(4)]
    runs = spark.createDataFrame(
        [("a", at[0], 1, False, 0, "2", False), ("a", at[1], 2, False, 0, "3", False), ("b", at[0], 3, True, 9, None, True), ("b", at[1], 4, False, 0, "5", False)], RUNS)
    got = by_id(feeds.apply_runs(df, runs), "name")
    assert (got["a"].consecutive_failures, got["a"].last_success, got["a"].last_attempt, got["a"].error_status) == (3, T0, at[1], "fetch_failed")
    assert (got["b"].consecutive_failures, got["b"].last_success, got["b"].pagination_checkpoint) == (1, at[0], None)
    assert got["c"].error_status == "kept" and got["c"].last_attempt is None
    # One run after another gives the same.
    step = df
    for i in range(1, 5):
        step = feeds.apply_runs(step, runs.filter(F.col("seq") == i))
    assert sorted(map(str, step.collect())) == sorted(map(str, feeds.apply_runs(df, runs).collect()))
    late = feeds.alerts(feeds.run_streaks(runs, df)).collect()
    assert {(r.source, r.seq, r.streak) for r in late} == {("a", 1, 2), ("a", 2, 3)}


def test_seed_never_overwrites(spark):
    config = spark.createDataFrame([("a", "x", "u", None, True), ("n", "x", "u", 60, True), ("off", "x", "u", 60, False)], "name string, adapter string, base_url string, poll_interval_minutes int, enabled boolean")
    got = by_id(feeds.seed_sources(source(spark, a={"consecutive_failures": 5}), config), "name")
    assert set(got) == {"a", "n"} and got["a"].consecutive_failures == 5 and got["n"].poll_interval_minutes == 60


def test_material_changes(spark):
    before = stored(spark, a={"asking_price": 1}, b={"revenue": 2}, c={})
    after = stored(spark, a={"asking_price": 2}, b={"revenue": None}, c={}, d={"revenue": 1})
    got = {(r.id, r.field, r.old_value, r.new_value) for r in changes.material_changes(before, after).collect()}
    assert got == {("a", "asking_price", "1", "2"), ("b", "revenue", "2", None)}


def test_duplicates_are_flagged_across_feeds_only(spark):
    rows = [("1", "x", "Ref 7", "Cafe", "VIC", 10), ("2", "y", "ref-7", "Bar", "VIC", 11), ("3", "x", None, "CAFE!", "VIC", 10), ("4", "y", None, "cafe", "VIC", 10), ("5", "y", None, "cafe", None, 10), ("6", "x", "9", "p", "SA", 1), ("7", "x", "9", "p", "SA", 1)]
    df = spark.createDataFrame(rows, "id string, source string, broker_ref string, title string, location_state string, asking_price bigint")
    got = {(r.id, r.kind, r.group_id, r.n_listings) for r in changes.duplicate_groups(df).collect()}
    assert got == {("1", "strong", "1", 2), ("2", "strong", "1", 2), ("1", "possible", "1", 3), ("3", "possible", "1", 3), ("4", "possible", "1", 3)}
