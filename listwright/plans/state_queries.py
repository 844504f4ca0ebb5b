"""Keyed state, feeds and activity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import text as X
from listwright.operators import changes, digest, discovery, duplicates, feeds, requests, state
from listwright.plans import views as V
from listwright.plans.registry import ORACLE, query
from listwright.plans.views import NOW, with_views
from listwright.schemas import LISTINGS, SOURCES, conform, duplicate_keys, orphans
from listwright.session import work_dir
from listwright.sources import snapshots
from listwright.sources.lookup import ListingIndex

_TS = f"TIMESTAMP '{NOW}'"


def _iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(floor((epoch_us({column}) % 1000000) / 1000) AS BIGINT) AS VARCHAR), 3, '0') || 'Z'"


def _last(field: str, view: str = "v_sightings") -> str:
    return f"max_by({field}, struct_pack(a := seen_at, b := seq)) FILTER (WHERE {field} IS NOT NULL) AS {field}"


_FOLD = f"""SELECT source, source_listing_id, min(seen_at) AS first_seen, max(seen_at) AS last_seen,
  max_by(canonical_url, struct_pack(a := seen_at, b := seq)) AS canonical_url,
  {_last('title')}, {_last('location_state')}, {_last('location_suburb')}, {_last('sector_raw')}, {_last('broker_name')}, {_last('asking_price')}"""
_STATUS = "arg_min_null(advertised_status, struct_pack(a := seen_at, b := seq)) AS advertised_status"
_SHOWN = ("title", "location_state", "location_suburb", "sector_raw", "broker_name", "asking_price")


def _fold_cols():
    return ["source", "source_listing_id", X.iso_instant(F.col("first_seen")).alias("first_seen"),
            X.iso_instant(F.col("last_seen")).alias("last_seen"), "canonical_url", *_SHOWN, "advertised_status"]


_FOLD_OUT = f"""SELECT source, source_listing_id, {_iso('first_seen')} AS first_seen, {_iso('last_seen')} AS last_seen, canonical_url,
  {', '.join(_SHOWN)}, advertised_status"""
FOLD_SQL = with_views(f"{_FOLD_OUT} FROM ({_FOLD}, {_STATUS} FROM v_sightings GROUP BY 1, 2)", "v_sightings")


@query("upsert_fold", FOLD_SQL)
def upsert_fold(spark, folder):
    return state.fold_sightings(V.sightings(spark, folder)).select(*_fold_cols())


_CUT = "TIMESTAMP '2024-01-10 00:00:00'"


def _two_batches(spark, folder):
    """Stored state from the sightings of the first days, and the sightings after them."""
    seen = V.sightings(spark, folder)
    cut = F.lit("2024-01-10 00:00:00").cast("timestamp")
    empty = spark.createDataFrame([], LISTINGS)
    stored = state.upsert_stubs(empty, seen.filter(F.col("seen_at") < cut))
    return stored, seen.filter(F.col("seen_at") >= cut)


@query("upsert_snapshot", with_views(f"""
WITH a AS ({_FOLD}, {_STATUS} FROM v_sightings WHERE seen_at < {_CUT} GROUP BY 1, 2),
b AS ({_FOLD}, {_STATUS} FROM v_sightings WHERE seen_at >= {_CUT} GROUP BY 1, 2)
SELECT coalesce(a.source, b.source) || ':' || coalesce(a.source_listing_id, b.source_listing_id) AS id,
  strftime(coalesce(a.first_seen, b.first_seen), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(coalesce(b.last_seen, a.last_seen), '%Y-%m-%d %H:%M:%S') AS last_seen,
  coalesce(b.canonical_url, a.canonical_url) AS canonical_url, {', '.join(f'coalesce(b.{c}, a.{c}) AS {c}' for c in _SHOWN)},
  CASE WHEN a.source IS NULL THEN b.advertised_status ELSE a.advertised_status END AS advertised_status,
  'new' AS processing_state, 'new' AS review_state, CAST(0 AS INTEGER) AS processing_attempts
FROM a FULL JOIN b ON a.source = b.source AND a.source_listing_id = b.source_listing_id""", "v_sightings"))
def upsert_snapshot(spark, folder):
    stored, batch = _two_batches(spark, folder)
    return state.upsert_stubs(stored, batch).select(
        "id", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
        F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "canonical_url", *_SHOWN,
        "advertised_status", "processing_state", "review_state", "processing_attempts",
    )


@query("dq_keys", with_views("""
SELECT 'duplicate_listing' AS rule, count(*) AS n FROM (SELECT id FROM v_listings GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'repeated_sighting', count(*) FROM (SELECT source, source_listing_id FROM v_sightings GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'orphan_activity', count(*) FROM v_activity a WHERE NOT EXISTS (SELECT 1 FROM v_listings l WHERE l.id = a.listing_id)
UNION ALL SELECT 'bad_state', count(*) FROM v_listings WHERE processing_state NOT IN ('new','processing','done','retry','failed')""",
    "v_listings", "v_sightings", "v_activity"))
def dq_keys(spark, folder):
    from listwright.schemas import outside_domain

    stored = V.listings(spark, folder)

    def counted(rule, rows):
        return rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")

    return (
        counted("duplicate_listing", duplicate_keys(stored, "id"))
        .unionByName(counted("repeated_sighting", duplicate_keys(V.sightings(spark, folder), "source", "source_listing_id")))
        .unionByName(counted("orphan_activity", orphans(V.activity(spark, folder), stored)))
        .unionByName(counted("bad_state", outside_domain(stored, "processing_state")))
    )


_DUE = f"(processing_state IN ('new','retry') AND (next_retry IS NULL OR next_retry <= {_TS}))"
_PICK = "ORDER BY CASE processing_state WHEN 'new' THEN 0 ELSE 1 END, first_seen, id LIMIT 20"


@query("claim_batch", with_views(f"""
SELECT id, CASE WHEN mine THEN 'processing' ELSE processing_state END AS processing_state,
  strftime(CASE WHEN mine THEN {_TS} ELSE lease_claimed_at END, '%Y-%m-%d %H:%M:%S') AS lease_claimed_at
FROM (SELECT *, id IN (SELECT id FROM v_listings WHERE {_DUE} {_PICK}) AS mine FROM v_listings)""", "v_listings"))
def claim_batch(spark, folder):
    return state.claim_batch(V.listings(spark, folder), V.now()).select(
        "id", "processing_state", F.date_format("lease_claimed_at", "yyyy-MM-dd HH:mm:ss").alias("lease_claimed_at")
    )


@query("lease_reclaim", with_views(f"""
SELECT id, processing_state FROM v_listings
WHERE {_DUE} OR (processing_state = 'processing' AND lease_claimed_at <= {_TS} - INTERVAL 60 MINUTE)""", "v_listings"))
def lease_reclaim(spark, folder):
    return V.listings(spark, folder).filter(state.claimable(V.now(), lease_minutes=60)).select("id", "processing_state")


@query("claim_order", with_views(f"""
SELECT id, processing_state FROM v_listings WHERE {_DUE} {_PICK}""", "v_listings"))
def claim_order(spark, folder):
    return state.select_claims(V.listings(spark, folder), V.now()).select("id", "processing_state")


@query("mark_extracted", with_views(f"""
SELECT id, CASE WHEN hit THEN 'done' ELSE processing_state END AS processing_state,
  CAST(CASE WHEN hit THEN processing_attempts + 1 ELSE processing_attempts END AS INTEGER) AS processing_attempts,
  CASE WHEN hit THEN revenue END AS revenue, advertised_status, CASE WHEN hit THEN 'needs_information' ELSE fit_outcome END AS fit_outcome,
  strftime(CASE WHEN hit THEN {_TS} ELSE last_fetched END, '%Y-%m-%d %H:%M:%S') AS last_fetched,
  CASE WHEN hit THEN sector END AS sector_code, CASE WHEN hit THEN 'a; b' END AS reasons,
  strftime(CASE WHEN NOT hit THEN lease_claimed_at END, '%Y-%m-%d %H:%M:%S') AS lease_claimed_at
FROM (SELECT l.*, f.revenue, f.sector, l.processing_state = 'processing' AND f.k IS NOT NULL AS hit FROM v_listings l LEFT JOIN v_facts f USING (k))""",
    "v_listings", "v_facts"))
def mark_extracted(spark, folder):
    stored = V.listings(spark, folder)
    results = (
        stored.filter(F.col("processing_state") == "processing").select("k", "id")
        .join(V.facts(spark, folder), "k")
        .select(
            "id", "revenue", "ebitda", "claimed_recurring", "years_established", "customer_type", "reason_for_sale",
            F.col("sector").alias("sector_code"), F.lit("needs_information").alias("outcome"),
            F.array(F.lit("a"), F.lit("b")).alias("matched_rules"), F.array(F.lit("c")).alias("missing_facts"),
            F.lit("0.2").alias("criteria_version"), F.lit("h").alias("content_hash"),
        )
    )
    return state.mark_extracted(conform(stored, LISTINGS), results, V.now()).select(
        "id", "processing_state", "processing_attempts", "revenue", "advertised_status", "fit_outcome",
        F.date_format("last_fetched", "yyyy-MM-dd HH:mm:ss").alias("last_fetched"), "sector_code",
        F.array_join("fit_reasons", "; ").alias("reasons"),
        F.date_format("lease_claimed_at", "yyyy-MM-dd HH:mm:ss").alias("lease_claimed_at"),
    )


@query("mark_failed_backoff", with_views(f"""
SELECT id, CASE WHEN hit THEN CASE WHEN processing_attempts >= 5 THEN 'failed' ELSE 'retry' END ELSE processing_state END AS processing_state,
  CAST(CASE WHEN hit THEN processing_attempts + 1 ELSE processing_attempts END AS INTEGER) AS processing_attempts,
  strftime(CASE WHEN hit THEN {_TS} + to_minutes(CAST(least((processing_attempts + 1) * 30, 240) AS BIGINT)) ELSE next_retry END, '%Y-%m-%d %H:%M:%S') AS next_retry
FROM (SELECT *, processing_state = 'processing' AS hit FROM v_listings)""", "v_listings"))
def mark_failed_backoff(spark, folder):
    stored = V.listings(spark, folder)
    bad = stored.filter(F.col("processing_state") == "processing")
    return state.mark_failed(stored, bad, V.now()).select(
        "id", "processing_state", "processing_attempts", F.date_format("next_retry", "yyyy-MM-dd HH:mm:ss").alias("next_retry")
    )


def _fetched(spark, folder):
    """Every order's page fetched again; about half with the same content as before."""
    k = F.col("o_orderkey")
    same = F.sha2((k % 1000).cast("string"), 256)
    return V.table(spark, folder, "orders").select(
        F.concat_ws(":", "o_orderpriority", k.cast("string")).alias("id"),
        F.when(V.tens(k, 4) % 2 == 0, same).otherwise(F.sha2(k.cast("string"), 256)).alias("content_hash"),
    )


_FETCHED = """SELECT o_orderpriority || ':' || o_orderkey AS id,
  CASE WHEN (o_orderkey // 4) % 2 = 0 THEN sha256(CAST(o_orderkey % 1000 AS VARCHAR)) ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS content_hash FROM orders"""


@query("skip_unchanged", with_views(f"""
SELECT f.id FROM ({_FETCHED}) f WHERE NOT EXISTS (SELECT 1 FROM v_listings l WHERE l.id = f.id AND l.content_hash = f.content_hash AND l.processing_state = 'done')""", "v_listings"))
def skip_unchanged(spark, folder):
    return state.changed_pages(V.listings(spark, folder), _fetched(spark, folder)).select("id")


@query("refresh_unchanged", with_views(f"""
SELECT l.id, strftime(CASE WHEN f.id IS NOT NULL THEN {_TS} ELSE last_fetched END, '%Y-%m-%d %H:%M:%S') AS last_fetched, fit_outcome
FROM v_listings l LEFT JOIN ({_FETCHED}) f ON f.id = l.id AND f.content_hash = l.content_hash AND l.processing_state = 'done'""", "v_listings"))
def refresh_unchanged(spark, folder):
    rows = state.refresh_unchanged(V.listings(spark, folder), _fetched(spark, folder), V.now())
    return rows.select("id", F.date_format("last_fetched", "yyyy-MM-dd HH:mm:ss").alias("last_fetched"), "fit_outcome")


_QUEUE = """SELECT * FROM v_full l WHERE processing_state = 'done' AND fit_outcome IN ('promising','needs_information') AND review_state = 'new'
  AND NOT EXISTS (SELECT 1 FROM v_activity a WHERE a.listing_id = l.id AND a.event_type = 'digest_delivery' AND a.delivery_state = 'confirmed')"""
QUEUE_ORDER = "ORDER BY CASE fit_outcome WHEN 'promising' THEN 0 ELSE 1 END, first_seen DESC, id"


@query("delivery_pending_insert", with_views(f"""
WITH q AS ({_QUEUE}),
n AS (SELECT 'digest:1999-07-01:' || id AS event_key, id AS listing_id FROM q)
SELECT event_key, listing_id, 'digest_delivery' AS event_type, delivery_state FROM v_activity WHERE event_type = 'digest_delivery'
UNION ALL SELECT event_key, listing_id, 'digest_delivery', 'pending' FROM n WHERE NOT EXISTS (SELECT 1 FROM v_activity a WHERE a.event_key = n.event_key)""",
    "v_full", "v_activity"))
def delivery_pending_insert(spark, folder):
    log = V.activity(spark, folder)
    queue = digest.pending(V.listings(spark, folder), log)
    after = state.record_pending(log, queue, V.now())
    return after.filter(F.col("event_type") == "digest_delivery").select("event_key", "listing_id", "event_type", "delivery_state")


@query("delivery_confirm", with_views("""
SELECT event_key, CASE WHEN event_type = 'digest_delivery' AND length(event_key) % 2 = 0 THEN 'confirmed' ELSE delivery_state END AS delivery_state,
  CASE WHEN event_type = 'digest_delivery' AND length(event_key) % 2 = 0 THEN 'ref-' || length(event_key) ELSE message_ref END AS message_ref
FROM v_activity""", "v_activity"))
def delivery_confirm(spark, folder):
    log = V.activity(spark, folder)
    size = F.length("event_key")
    sent = log.filter((F.col("event_type") == "digest_delivery") & (size % 2 == 0)).select(
        "event_key", F.concat(F.lit("ref-"), size.cast("string")).alias("message_ref")
    )
    return state.confirm_delivery(log, sent).select("event_key", "delivery_state", "message_ref")


_VERDICT = """SELECT r.*, CASE WHEN coalesce(r.listing_id, '') = '' OR coalesce(action, '') = '' OR coalesce(actor, '') = '' THEN 'missing_fields'
  WHEN action NOT IN ('watch','pursue','pass') THEN 'bad_action' WHEN l.id IS NULL THEN 'not_found' ELSE 'accepted' END AS verdict
  FROM v_reviews r LEFT JOIN v_listings l ON l.id = r.listing_id"""
_LATEST = f"""SELECT listing_id, arg_max_null(action, struct_pack(a := decided_at, b := seq)) AS action, arg_max_null(actor, struct_pack(a := decided_at, b := seq)) AS actor,
  arg_max_null(reason, struct_pack(a := decided_at, b := seq)) AS reason, count(*) AS n_reviews FROM ({_VERDICT}) WHERE verdict = 'accepted' GROUP BY 1"""


def _accepted(spark, folder):
    routed = requests.route_reviews(V.reviews(spark, folder), V.listings(spark, folder))
    return routed.filter(F.col("verdict") == "accepted")


@query("review_route", with_views(f"SELECT seq, listing_id, verdict FROM ({_VERDICT})", "v_reviews", "v_listings"))
def review_route(spark, folder):
    return requests.route_reviews(V.reviews(spark, folder), V.listings(spark, folder)).select("seq", "listing_id", "verdict")


@query("review_latest", with_views(_LATEST, "v_reviews", "v_listings"))
def review_latest(spark, folder):
    return state.latest_reviews(_accepted(spark, folder)).drop("decided_at")


@query("review_state", with_views(f"""
SELECT l.id, coalesce(r.action, l.review_state) AS review_state FROM v_listings l LEFT JOIN ({_LATEST}) r ON r.listing_id = l.id""", "v_reviews", "v_listings"))
def review_state(spark, folder):
    current, _log = state.record_reviews(V.listings(spark, folder), V.activity(spark, folder), _accepted(spark, folder))
    return current.select("id", "review_state")


@query("review_log", with_views(f"""
SELECT listing_id, action AS value, actor, count(*) AS n_rows FROM (
  SELECT DISTINCT listing_id, epoch_ms(decided_at) AS at, first_value(action) OVER w AS action, first_value(actor) OVER w AS actor
  FROM ({_VERDICT}) WHERE verdict = 'accepted' WINDOW w AS (PARTITION BY listing_id, epoch_ms(decided_at) ORDER BY seq)) GROUP BY 1, 2, 3""", "v_reviews", "v_listings"))
def review_log(spark, folder):
    _current, log = state.record_reviews(V.listings(spark, folder), V.activity(spark, folder), _accepted(spark, folder))
    rows = log.filter((F.col("event_type") == "review_decision") & F.startswith("event_key", F.lit("review:")))
    return rows.groupBy("listing_id", "value", "actor").agg(F.count("*").alias("n_rows"))


@query("pass_reasons", with_views(f"""
SELECT coalesce(fit_reasons[1], 'none') AS fit_reason, coalesce(r.reason, 'none') AS pass_reason, count(*) AS n_passed
FROM v_full l JOIN ({_LATEST}) r ON r.listing_id = l.id WHERE r.action = 'pass' GROUP BY 1, 2""", "v_full", "v_reviews"))
def pass_reasons(spark, folder):
    return changes.pass_reasons(V.full_listings(spark, folder), state.latest_reviews(_accepted(spark, folder)))


# --------------------------------------------------------------------------- feeds
@query("source_seed", with_views("""
SELECT name, adapter, base_url, poll_interval_minutes, discovered_count, consecutive_failures, coverage_complete FROM v_sources
UNION ALL SELECT name, adapter, base_url, coalesce(poll_interval_minutes, 240), 0, 0, false FROM v_feeds
WHERE enabled AND name NOT IN (SELECT name FROM v_sources)""", "v_sources", "v_feeds"))
def source_seed(spark, folder):
    return feeds.seed_sources(V.stored_sources(spark, folder), V.feed_config(spark, folder)).select(
        "name", "adapter", "base_url", "poll_interval_minutes", "discovered_count", "consecutive_failures", "coverage_complete"
    )


@query("source_due", with_views("""
SELECT name FROM v_sources WHERE last_attempt IS NULL OR last_attempt + to_minutes(CAST(poll_interval_minutes AS BIGINT)) <= TIMESTAMP '2001-08-03 00:00:00'""", "v_sources"))
def source_due(spark, folder):
    return feeds.due_sources(V.stored_sources(spark, folder), F.lit("2001-08-03 00:00:00").cast("timestamp")).select("name")


_STREAK = """SELECT source, ts, seq, ok, CAST(count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY source, wins ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak
  FROM (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY source ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS wins FROM v_runs)"""


@query("source_streak", with_views(f"SELECT source, seq, ok, streak FROM ({_STREAK})", "v_runs"))
def source_streak(spark, folder):
    return feeds.run_streaks(V.runs(spark, folder)).select("source", "seq", "ok", "streak")


@query("source_alerts", with_views(f"""
SELECT source, seq, 'Source _' || source || '_ has failed ' || streak || ' consecutive times. Manual check required.' AS text FROM ({_STREAK}) WHERE streak >= 2""", "v_runs"))
def source_alerts(spark, folder):
    return feeds.alerts(feeds.run_streaks(V.runs(spark, folder))).select("source", "seq", "text")


def _event_sources(spark, folder):
    """Event types as stored feeds that have not run yet."""
    names = V.feed_config(spark, folder)
    return feeds.seed_sources(spark.createDataFrame([], SOURCES), names.withColumn("enabled", F.lit(True)))


_APPLIED = f"""SELECT name, max(ts) AS last_attempt, max(ts) FILTER (WHERE ok) AS last_success,
  arg_max(streak, struct_pack(a := ts, b := seq)) AS consecutive_failures, arg_max_null(checkpoint, struct_pack(a := ts, b := seq)) AS pagination_checkpoint,
  coalesce(arg_max(discovered, struct_pack(a := ts, b := seq)), 0) AS discovered_count,
  CASE WHEN arg_max(ok, struct_pack(a := ts, b := seq)) = false THEN 'fetch_failed' END AS error_status,
  coalesce(arg_max(coverage_complete, struct_pack(a := ts, b := seq)), false) AS coverage_complete
  FROM (SELECT DISTINCT name FROM v_feeds) n LEFT JOIN (SELECT r.*, s.streak FROM v_runs r JOIN ({_STREAK}) s USING (source, seq)) x ON x.source = n.name GROUP BY 1"""
STATUS_SQL = with_views(f"""
SELECT name, {_iso('last_attempt')} AS last_attempt, {_iso('last_success')} AS last_success, coalesce(consecutive_failures, 0) AS consecutive_failures,
  error_status, coverage_complete, discovered_count FROM ({_APPLIED})""", "v_feeds", "v_runs")


@query("source_status", STATUS_SQL)
def source_status(spark, folder):
    return feeds.status_view(feeds.apply_runs(_event_sources(spark, folder), V.runs(spark, folder)))


_STATS = """SELECT s.name, CASE WHEN won THEN coalesce(checked, 0) ELSE 0 END AS checked, CASE WHEN won THEN coalesce(new_listings, 0) ELSE 0 END AS new_listings,
  won AS healthy, won AND coalesce(coverage_complete, false) AS coverage_complete,
  CASE WHEN NOT enabled THEN 'disabled' WHEN NOT won THEN 'discovery_failed' END AS error_status
  FROM (SELECT e.source AS name, c.enabled AS enabled, c.enabled AND e.v >= 1 AS won, e.v % 2 = 0 AS coverage_complete FROM
    (SELECT event_type AS source, count(*) FILTER (WHERE value > 200) AS v FROM events GROUP BY 1) e JOIN v_feeds c ON c.name = e.source) s
  LEFT JOIN (SELECT d.source, count(*) AS checked, count(*) FILTER (WHERE l.k IS NULL) AS new_listings FROM
    (SELECT DISTINCT source, source_listing_id FROM v_sightings) d LEFT JOIN v_listings l ON l.id = d.source || ':' || d.source_listing_id GROUP BY 1) n ON n.source = s.name"""


def _stats(spark, folder):
    e = V.table(spark, folder, "events")
    cover = e.groupBy(F.col("event_type").alias("source")).agg(F.count_if(F.col("value") > 200).alias("v")).select(
        "source", (F.col("v") >= 1).alias("success"), (F.col("v") % 2 == 0).alias("coverage_complete")
    )
    stubs = V.sightings(spark, folder).select("source", "source_listing_id").distinct()
    counts = discovery.run_counts(stubs, V.listings(spark, folder))
    due = cover.select(F.col("source").alias("name"))
    return feeds.run_stats(due, V.feed_config(spark, folder), counts, cover)


@query("run_stats", with_views(_STATS, "v_feeds", "v_sightings", "v_listings"))
def run_stats(spark, folder):
    return _stats(spark, folder)


_HEALTH = f"""SELECT f.name, CASE WHEN t.name IS NOT NULL THEN t.checked ELSE 0 END AS checked, CASE WHEN t.name IS NOT NULL THEN t.new_listings ELSE 0 END AS new_listings,
  CASE WHEN t.name IS NOT NULL THEN t.healthy WHEN s.name IS NOT NULL THEN s.consecutive_failures = 0 ELSE false END AS healthy,
  CASE WHEN t.name IS NOT NULL THEN t.coverage_complete WHEN s.name IS NOT NULL THEN s.coverage_complete ELSE false END AS coverage_complete,
  CASE WHEN t.name IS NOT NULL THEN t.error_status ELSE s.error_status END AS error_status
  FROM v_feeds f LEFT JOIN ({_STATS}) t ON t.name = f.name LEFT JOIN v_sources s ON s.name = f.name WHERE f.enabled"""
HEALTH_PART = "name || ' ' || CASE WHEN healthy THEN '✓' ELSE '✗' END || ' (' || checked || ' checked, ' || new_listings || ' new' || CASE WHEN coverage_complete THEN '' ELSE ' ⚠️ partial' END || ')'"
_HEALTH_VIEWS = ("v_feeds", "v_sources", "v_sightings", "v_listings")


def merged_health(spark, folder):
    return feeds.merge_health(V.feed_config(spark, folder), _stats(spark, folder), V.stored_sources(spark, folder))


@query("health_merge", with_views(_HEALTH, *_HEALTH_VIEWS))
def health_merge(spark, folder):
    return merged_health(spark, folder)


@query("health_line", with_views(f"SELECT 'Sources: ' || string_agg({HEALTH_PART}, ' · ' ORDER BY name) AS line FROM ({_HEALTH})", *_HEALTH_VIEWS))
def health_line(spark, folder):
    return feeds.health_line(merged_health(spark, folder))


# ------------------------------------------------------------------ change and recheck
@query("material_changes", with_views(f"""
WITH a AS (SELECT source || ':' || source_listing_id AS id, {_last('asking_price')}, {_last('title')} FROM v_sightings WHERE seen_at < {_CUT} GROUP BY 1),
b AS (SELECT source || ':' || source_listing_id AS id, {_last('asking_price')}, {_last('title')} FROM v_sightings GROUP BY 1)
SELECT a.id, 'asking_price' AS field, CAST(a.asking_price AS VARCHAR) AS old_value, CAST(b.asking_price AS VARCHAR) AS new_value
FROM a JOIN b USING (id) WHERE a.asking_price IS DISTINCT FROM b.asking_price
UNION ALL SELECT a.id, 'title', a.title, b.title FROM a JOIN b USING (id) WHERE a.title IS DISTINCT FROM b.title""", "v_sightings"))
def material_changes(spark, folder):
    stored, batch = _two_batches(spark, folder)
    after = state.upsert_stubs(stored, batch)
    return changes.material_changes(stored, after, tracked=("asking_price", "title"))


@query("change_history", with_views("""
WITH h AS (
  SELECT id, v AS version, CAST(CASE WHEN k % 5 = 0 THEN asking_price + 1000 * (v % 2) WHEN k % 7 = v THEN NULL ELSE asking_price END AS VARCHAR) AS price,
    CASE WHEN k % 3 = 0 AND v >= 2 THEN 'sold' ELSE advertised_status END AS status
  FROM v_listings, (SELECT unnest([0, 1, 2, 3]) AS v) WHERE k % 11 <> v),
l AS (SELECT *, row_number() OVER w AS n, lag(price) OVER w AS price_was, lag(status) OVER w AS status_was FROM h WINDOW w AS (PARTITION BY id ORDER BY version))
SELECT id, CAST(version AS BIGINT) AS version, 'asking_price' AS field, price_was AS old_value, price AS new_value FROM l WHERE n > 1 AND price IS DISTINCT FROM price_was
UNION ALL SELECT id, CAST(version AS BIGINT), 'advertised_status', status_was, status FROM l WHERE n > 1 AND status IS DISTINCT FROM status_was""", "v_listings"))
def change_history(spark, folder):
    """Moves over four stored versions, of which each lacks some listings and some prices move back."""
    root, k, price = work_dir(spark, "versions"), F.col("k"), F.col("asking_price")
    for v in range(4):
        rows = V.listings(spark, folder).filter(k % 11 != v).withColumns({
            "asking_price": F.when(k % 5 == 0, price + 1000 * (v % 2)).when(k % 7 != v, price),
            "advertised_status": F.when((k % 3 == 0) & F.lit(v >= 2), "sold").otherwise(F.col("advertised_status")),
        })
        snapshots.write_version(conform(rows, LISTINGS), root, v)
    return changes.change_history(snapshots.read_history(spark, root, LISTINGS), ("asking_price", "advertised_status"))


_PRICES = f"""SELECT a.id, CAST(a.asking_price AS VARCHAR) AS o, CAST(b.asking_price AS VARCHAR) AS n FROM
  (SELECT source || ':' || source_listing_id AS id, {_last('asking_price')} FROM v_sightings WHERE seen_at < {_CUT} GROUP BY 1) a JOIN
  (SELECT source || ':' || source_listing_id AS id, {_last('asking_price')} FROM v_sightings GROUP BY 1) b USING (id) WHERE a.asking_price IS DISTINCT FROM b.asking_price"""


@query("change_events", with_views(f"""
SELECT 'change:r1:' || id || ':asking_price' AS event_key, id AS listing_id, coalesce(o, 'none') || ' -> ' || coalesce(n, 'none') AS reason FROM ({_PRICES})""", "v_sightings"))
def change_events(spark, folder):
    stored, batch = _two_batches(spark, folder)
    moved = changes.material_changes(stored, state.upsert_stubs(stored, batch), tracked=("asking_price",))
    return changes.change_events(moved, "r1").select("event_key", "listing_id", "reason")


@query("recheck_due", with_views(f"""
SELECT id, review_state FROM v_listings WHERE review_state <> 'pass' AND processing_state = 'done' AND coalesce(advertised_status NOT IN ('sold','off market'), true)
  AND last_fetched + CASE WHEN review_state IN ('watch','pursue') THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END <= {_TS}""", "v_listings"))
def recheck_due(spark, folder):
    return changes.recheck_due(V.listings(spark, folder), V.now()).select("id", "review_state")


_KEYED = """SELECT id, source, 'strong' AS kind, nullif(trim(regexp_replace(lower(ref), '[^a-z0-9]+', ' ', 'g')), '') AS match_key FROM d
  UNION ALL SELECT id, source, 'possible', nullif(array_to_string(list_sort(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' ')), ' '), '') || '|' || location_state || '|' || asking_price FROM d"""


@query("duplicate_flags", with_views(f"""
WITH d AS (SELECT id, source, 'Ref-' || (k // 3) AS ref, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 3 = 0 THEN (k % 50) || ' - Shop' ELSE 'Shop ' || (k % 50) END AS title, location_state,
    CASE WHEN asking_price IS NOT NULL THEN asking_price // 200000 END AS asking_price FROM v_listings),
m AS ({_KEYED}),
g AS (SELECT kind, match_key, min(id) AS group_id, count(*) AS n_listings FROM m WHERE match_key IS NOT NULL GROUP BY 1, 2 HAVING min(source) <> max(source))
SELECT m.id, m.source, m.kind, g.group_id, g.n_listings FROM m JOIN g USING (kind, match_key)""", "v_listings"))
def duplicate_flags(spark, folder):
    k = F.col("k")
    rows = V.listings(spark, folder).select(
        "id", "source", F.concat(F.lit("Ref-"), V.tens(k, 3).cast("string")).alias("broker_ref"),
        F.when(k % 17 == 0, None).when(k % 3 == 0, F.concat((k % 50).cast("string"), F.lit(" - Shop")))
        .otherwise(F.concat(F.lit("Shop "), (k % 50).cast("string"))).alias("title"), "location_state",
        F.floor(F.col("asking_price") / 200_000).cast("bigint").alias("asking_price"),
    )
    return changes.duplicate_groups(rows)


def _misspelt(spark, folder):
    """Listings whose titles are a sector's name, edited here and there, and a number."""
    k, at = F.col("k"), (F.col("k") % 7).cast("int")
    name = F.translate(V.pick(V.SECTORS, V.tens(k, 3)), "_", " ")
    spelt = (
        F.when(k % 4 == 1, F.concat(F.substr(name, F.lit(1), at), F.substr(name, at + 2)))
        .when(k % 4 == 2, F.upper(name))
        .when(k % 4 == 3, F.concat(F.substr(name, F.lit(1), at), F.lit("x"), F.substr(name, at + 1)))
        .otherwise(name)
    )
    rows = V.listings(spark, folder).withColumns({
        "title": F.when(k % 17 != 0, F.concat(spelt, F.lit(", no. "), (k % 5).cast("string"))),
        "broker_ref": F.when(k % 3 != 2, F.concat(F.lit("Ref-"), V.tens(k, 6).cast("string"))),
    })
    return conform(rows, LISTINGS)


_NAME = f"replace({V.sql_pick(V.SECTORS, 'k // 3')}, '_', ' ')"


@query("likely_duplicates", with_views(f"""
WITH d AS (
  SELECT id, source, location_state, asking_price AS price, CASE WHEN k % 3 <> 2 THEN 'ref ' || (k // 6) END AS ref,
    CASE WHEN k % 17 <> 0 THEN (CASE k % 4 WHEN 1 THEN {_NAME}[:k % 7] || {_NAME}[k % 7 + 2:] WHEN 2 THEN upper({_NAME})
      WHEN 3 THEN {_NAME}[:k % 7] || 'x' || {_NAME}[k % 7 + 1:] ELSE {_NAME} END) || ', no. ' || (k % 5) END AS title
  FROM v_listings),
split AS (SELECT *, string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM d WHERE title IS NOT NULL AND price >= 0 AND location_state IS NOT NULL),
sets AS (
  SELECT id, source, price, location_state || '|' || array_to_string(list_sort(list_filter(ws, lambda w: regexp_matches(w, '[0-9]'))), ' ') AS block,
    list_distinct(flatten(list_transform(list_filter(ws, lambda w: w <> '' AND NOT regexp_matches(w, '[0-9]')),
      lambda w: list_transform(range(1, len(w) + 1), lambda i: substr('^' || w || '$', i, 3))))) AS s
  FROM split),
links AS (
  SELECT a.id AS a, b.id AS b FROM sets a JOIN sets b ON a.block = b.block AND 100 * abs(a.price - b.price) <= 5 * greatest(a.price, b.price)
  WHERE 100 * len(list_intersect(a.s, b.s)) >= 70 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
reach(a, b) AS (SELECT id, id FROM sets WHERE len(s) > 0 UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
keyed AS (
  SELECT id, source, 'strong' AS kind, ref AS key FROM d WHERE ref IS NOT NULL
  UNION ALL SELECT a, any_value(source), 'possible', min(b) FROM reach JOIN sets ON sets.id = a GROUP BY a),
g AS (SELECT kind, key, min(id) AS group_id, count(*) AS n_listings FROM keyed GROUP BY ALL HAVING min(source) <> max(source))
SELECT id, source, kind, group_id, n_listings FROM keyed JOIN g USING (kind, key)""", "v_listings").replace("WITH ", "WITH RECURSIVE ", 1))
def likely_duplicates(spark, folder):
    return duplicates.likely_duplicates(_misspelt(spark, folder))


@query("baseline_flag", with_views("""
SELECT l.source || ':' || l.source_listing_id AS id, first_seen <= run AS is_baseline
FROM (SELECT source, source_listing_id, min(seen_at) AS first_seen FROM v_sightings GROUP BY 1, 2) l
JOIN (SELECT source, min(ts) + INTERVAL 2 DAY AS run FROM v_runs GROUP BY 1) r USING (source)""", "v_sightings", "v_runs"))
def baseline_flag(spark, folder):
    first = V.runs(spark, folder).groupBy("source").agg((F.min("ts") + F.make_dt_interval(days=F.lit(2))).alias("first_run"))
    seen = state.fold_sightings(V.sightings(spark, folder)).select("source", "source_listing_id", "first_seen")
    return changes.mark_baseline(seen, first).select(discovery.listing_id().alias("id"), "is_baseline")


@query("empty_reason", with_views("""
SELECT r.source, CASE WHEN q > 0 THEN NULL WHEN w > 0 THEN 'pending_processing' WHEN NOT covered THEN 'incomplete_coverage' ELSE 'no_matches' END AS reason
FROM (SELECT source, arg_max(coverage_complete, struct_pack(a := ts, b := seq)) AS covered, count(*) FILTER (WHERE discovered = 99) AS w, count(*) FILTER (WHERE seq = 0) AS q FROM v_runs GROUP BY 1) r""", "v_runs"))
def empty_reason(spark, folder):
    per = V.runs(spark, folder).groupBy("source").agg(
        F.max(F.struct("ts", "seq", "coverage_complete"))["coverage_complete"].alias("covered"),
        F.count_if(F.col("discovered") == 99).alias("w"), F.count_if(F.col("seq") == 0).alias("q"),
    )
    return per.select("source", digest.empty_reason(F.col("q"), F.col("w"), F.col("covered")).alias("reason"))


_HOST = "regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1)"


@query("inspect_route", with_views(f"""
WITH u AS (SELECT canonical_url AS url, min(id) AS id FROM v_listings GROUP BY 1),
j AS (SELECT q.*, i.id AS i_id, i.processing_state AS i_state, i.last_fetched AS i_f, ul.id AS u_id, ul.processing_state AS u_state, ul.last_fetched AS u_f
  FROM v_inspect q LEFT JOIN v_listings i ON i.id = q.listing_id LEFT JOIN u ON u.url = q.url LEFT JOIN v_listings ul ON ul.id = u.id),
s AS (SELECT *, CASE WHEN listing_id IS NOT NULL THEN i_state ELSE u_state END AS st FROM j),
t AS (SELECT *, CASE WHEN listing_id IS NULL AND (url IS NULL OR NOT ({_HOST} LIKE '%.com' OR {_HOST} LIKE '%.com.au')) THEN 'invalid'
  WHEN st = 'done' THEN 'found' WHEN st = 'processing' THEN 'processing' WHEN st IS NOT NULL THEN 'queued' WHEN url IS NOT NULL THEN 'created' ELSE 'not_found' END AS status FROM s)
SELECT request_id, status, CASE WHEN status = 'created' THEN CASE WHEN contains(url, 'bsale.com.au') THEN 'bsale' ELSE 'business2sell' END || ':' ||
    coalesce(nullif(regexp_extract(url, '-([0-9]+)(?:\\.php)?$', 1), ''), 'manual:' || CAST(floor(epoch_us(min(requested_at) OVER (PARTITION BY url)) / 1000) AS BIGINT))
  WHEN status IN ('found','processing','queued') THEN CASE WHEN listing_id IS NOT NULL THEN i_id ELSE u_id END END AS answer_id,
  CASE WHEN status = 'found' THEN strftime(CASE WHEN listing_id IS NOT NULL THEN i_f ELSE u_f END, '%Y-%m-%dT%H:%M:%S.000Z') END AS last_checked
FROM t""", "v_inspect", "v_listings"))
def inspect_route(spark, folder):
    return requests.route_inspections(V.inspections(spark, folder), V.listings(spark, folder)).select(
        "request_id", "status", "answer_id", "last_checked"
    )


@query("inspect_lookup", ORACLE["inspect_route"])
def inspect_lookup(spark, folder):
    """The same answers from an index of listings by id and by URL, written in two versions."""
    stored, asked = V.listings(spark, folder), V.inspections(spark, folder)
    index = ListingIndex(work_dir(spark, "listing-index"))
    # Every third listing changes in the second version.
    index.add(stored.withColumn("processing_state", F.when(F.col("k") % 3 == 0, "new").otherwise(F.col("processing_state"))), 0)
    index.add(stored.filter(F.col("k") % 3 == 0), 1)
    return requests.route_inspections(asked, index.wanted(asked)).select("request_id", "status", "answer_id", "last_checked")


@query("unknown_url_stubs", with_views("""
SELECT CASE WHEN contains(url, 'bsale.com.au') THEN 'bsale' ELSE 'business2sell' END AS source,
  coalesce(nullif(regexp_extract(url, '-([0-9]+)(?:\\.php)?$', 1), ''), 'manual:' || CAST(floor(epoch_us(min(requested_at)) / 1000) AS BIGINT)) AS source_listing_id,
  url AS canonical_url, 'On-demand inspection' AS title
FROM v_inspect q WHERE (url LIKE 'https://bsale.com.au/%' OR url LIKE 'https://www.business2sell.com.au/%')
  AND NOT EXISTS (SELECT 1 FROM v_listings l WHERE l.canonical_url = q.url) GROUP BY url""", "v_inspect", "v_listings"))
def unknown_url_stubs(spark, folder):
    asked = V.inspections(spark, folder).filter(F.col("url").isNotNull()).withColumnRenamed("request_id", "seq")
    known = V.listings(spark, folder).select(F.col("canonical_url").alias("url"))
    stubs = state.unknown_url_stubs(asked.join(known, "url", "left_anti"))
    return stubs.select("source", "source_listing_id", "canonical_url", "title")


@query("url_lookup", with_views("""
SELECT canonical_url AS url, min(id) AS id FROM v_listings GROUP BY 1""", "v_listings"))
def url_lookup(spark, folder):
    return requests.by_url(V.listings(spark, folder)).select("url", F.col("u_id").alias("id"))


QUEUE_SQL = _QUEUE
