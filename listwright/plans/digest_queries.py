"""Digest, card and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright import config as C
from listwright.functions import text as X
from listwright.operators import digest, feeds, service
from listwright.plans import page_queries as P
from listwright.plans import state_queries as S
from listwright.plans import views as V
from listwright.plans.registry import ORACLE, query
from listwright.plans.rules_queries import _q
from listwright.plans.views import with_views
from listwright.schemas import LISTINGS, conform
from listwright.session import prepare, settle, work_dir
from listwright.sources import adapters
from listwright.streaming import jobs

_VIEWS = ("v_full", "v_activity")


def _queue(spark, folder):
    return digest.pending(V.listings(spark, folder), V.activity(spark, folder))


def _day(column):
    return F.date_format(column, "yyyy-MM-dd").alias("first_seen")


@query("digest_top5", with_views(f"""
SELECT id, fit_outcome, strftime(first_seen, '%Y-%m-%d') AS first_seen, title FROM ({S.QUEUE_SQL}) {S.QUEUE_ORDER} LIMIT 5""", *_VIEWS))
def digest_top5(spark, folder):
    return digest.top_entries(_queue(spark, folder)).select("id", "fit_outcome", _day("first_seen"), "title")


@query("digest_backlog", with_views(f"""
SELECT id, fit_outcome FROM (SELECT *, row_number() OVER ({S.QUEUE_ORDER}) AS r FROM ({S.QUEUE_SQL})) WHERE r > 5""", *_VIEWS))
def digest_backlog(spark, folder):
    return digest.backlog(_queue(spark, folder)).select("id", "fit_outcome")


@query("digest_counts", with_views(f"""
SELECT count(*) AS total_pending, greatest(count(*) - 5, 0) AS backlog FROM ({S.QUEUE_SQL})""", *_VIEWS))
def digest_counts(spark, folder):
    return digest.backlog_size(_queue(spark, folder))


@query("digest_sections", with_views(f"""
SELECT id, CASE WHEN fit_outcome = 'promising' THEN 'promising' ELSE 'needs_information' END AS section, CAST(row_number() OVER ({S.QUEUE_ORDER}) AS INTEGER) AS place
FROM (SELECT * FROM ({S.QUEUE_SQL}) {S.QUEUE_ORDER} LIMIT 5)""", *_VIEWS))
def digest_sections(spark, folder):
    return digest.ranked(digest.top_entries(_queue(spark, folder))).select("id", "section", "place")


@query("state_preference", with_views(f"""
SELECT id, location_state FROM ({S.QUEUE_SQL}) ORDER BY CASE fit_outcome WHEN 'promising' THEN 0 ELSE 1 END,
  CASE WHEN location_state IN ('VIC','NSW','QLD') THEN 0 ELSE 1 END, first_seen DESC, id LIMIT 5""", *_VIEWS))
def state_preference(spark, folder):
    return digest.top_entries(_queue(spark, folder), prefer_states=True).select("id", "location_state")


SHORT = """CASE WHEN coalesce(asking_price, 0) <> 0 THEN CASE WHEN asking_price >= 1000000 THEN CAST(CAST(floor(asking_price / 100000.0 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' ||
  (CAST(floor(asking_price / 100000.0 + 0.5) AS BIGINT) % 10) || 'm' ELSE CAST(floor(asking_price / 1000.0 + 0.5) AS BIGINT) || 'k' END END"""
PLACE = "coalesce(nullif(concat_ws(', ', nullif(location_suburb, ''), nullif(location_state, '')), ''), '{}')".format
_X = "regexp_replace(CAST(CAST(asking_multiple AS DECIMAL(20,4)) AS VARCHAR), '[.]?0+$', '')"
FINANCE = f"""'Revenue: ' || coalesce(revenue_raw, 'not disclosed') || ' | EBITDA: ' || coalesce(ebitda_raw, 'not disclosed') || ' | '
  || CASE WHEN coalesce(asking_multiple, 0) <> 0 THEN 'Multiple: ' || {_X} || 'x (advertised)' ELSE 'Multiple: n/a' END"""
_SECTOR = "lower(coalesce(sector_code, sector_raw, ''))"
NEXT = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains({_SECTOR}, '{w}')" for w in words) + f" THEN {_q(advice)}" for words, advice in C.NEXT_STEPS
) + f" ELSE {_q(C.NEXT_STEP_DEFAULT)} END"


@query("short_money", with_views(f"SELECT id, {SHORT} AS price FROM v_listings", "v_listings"))
def short_money(spark, folder):
    return V.listings(spark, folder).select("id", X.short_money(F.col("asking_price")).alias("price"))


@query("location_label", with_views(f"SELECT id, {PLACE('Location unknown')} AS place FROM v_listings", "v_listings"))
def location_label(spark, folder):
    place = X.location_label(F.col("location_suburb"), F.col("location_state"), "Location unknown")
    return V.listings(spark, folder).select("id", place.alias("place"))


@query("financial_line", with_views(f"SELECT id, {FINANCE} AS line FROM v_full", "v_full"))
def financial_line(spark, folder):
    return V.full_listings(spark, folder).select("id", digest.financial_line().alias("line"))


@query("next_step", with_views(f"SELECT id, {NEXT} AS step FROM v_full", "v_full"))
def next_step(spark, folder):
    return V.full_listings(spark, folder).select("id", digest.next_step().alias("step"))


@query("reason_split", with_views("""
SELECT id, coalesce(array_to_string(list_filter(fit_reasons, lambda r: NOT (starts_with(r, 'NDIS:'))), ' | '), '') AS reasons,
  coalesce(array_to_string(list_filter(fit_reasons, lambda r: starts_with(r, 'NDIS:')), ' | '), '') AS missing,
  coalesce(array_to_string(fit_reasons, '~'), '') AS round_trip FROM v_full""", "v_full"))
def reason_split(spark, folder):
    text = V.full_listings(spark, folder).select("id", X.encode_list(F.col("fit_reasons")).alias("text"))
    stored = text.select("id", X.decode_list(F.col("text")).alias("stored"))
    reasons, missing = X.split_reasons(F.col("stored"))
    return stored.select(
        "id", F.array_join(reasons, " | ").alias("reasons"), F.array_join(missing, " | ").alias("missing"),
        F.array_join("stored", "~").alias("round_trip"),
    )


ENTRY = f"""chr(10) || '*' || coalesce(title, 'Untitled listing') || ' · ' || {PLACE('Location unknown')} || ' · ' || coalesce('Asking $' || {SHORT}, 'Price undisclosed') || '*' || chr(10)
  || {FINANCE} || coalesce(chr(10) || '*Why look:* ' || array_to_string(fit_reasons[1:3], '; '), '') || coalesce(chr(10) || '*Check:* ' || array_to_string(missing_facts[1:2], '; '), '')
  || chr(10) || '*Next:* ' || {NEXT} || chr(10) || '<' || canonical_url || '|View listing>'"""


@query("digest_entries", with_views(f"SELECT id, {ENTRY} AS text FROM v_full", "v_full"))
def digest_entries(spark, folder):
    return V.full_listings(spark, folder).select("id", digest.entry_text().alias("text"))


@query("digest_text", with_views(f"""
WITH q AS ({S.QUEUE_SQL}), e AS (SELECT *, row_number() OVER ({S.QUEUE_ORDER}) AS r FROM q),
h AS (SELECT 'Sources: ' || string_agg({S.HEALTH_PART}, ' · ' ORDER BY name) AS line FROM ({S._HEALTH})),
n AS (SELECT count(*) AS total FROM q)
SELECT '*Listing digest — 1999-07-01*' || chr(10) || h.line || chr(10) || chr(10) || coalesce(
    nullif(concat_ws(chr(10), '*🟢 Promising*' || chr(10) || (SELECT string_agg({ENTRY}, chr(10) ORDER BY r) FROM e WHERE r <= 5 AND fit_outcome = 'promising'),
      '*🟡 Needs information*' || chr(10) || (SELECT string_agg({ENTRY}, chr(10) ORDER BY r) FROM e WHERE r <= 5 AND fit_outcome <> 'promising')), ''),
    '_No new candidates meeting criteria today._')
  || CASE WHEN total > 5 THEN chr(10) || chr(10) || '_' || (total - 5) || CASE WHEN total = 6 THEN ' additional listing' ELSE ' additional listings' END || ' pending. Ask to show all._' ELSE '' END AS text
FROM h, n""", *_VIEWS, "v_feeds", "v_sources", "v_sightings", "v_listings"))
def digest_text(spark, folder):
    label = spark.range(1).select(X.local_date(V.now()).alias("d")).first()["d"]
    queue = _queue(spark, folder)
    top = settle(digest.top_entries(queue))
    entries = V.with_facts(top, V.facts(spark, folder, keys=top.select("k")))
    return digest.digest_text(entries, digest.backlog_size(queue), S.merged_health(spark, folder), label)


def _line(label: str, value: str) -> str:
    return f"'*{label}:* ' || {value}"


_M = "CASE WHEN coalesce({0}, 0) <> 0 THEN '$' || format('{{:,}}', {0}) END".format
_MELB = "timezone('Australia/Melbourne', timezone('UTC', last_fetched))"


@query("inspection_card", with_views(f"""
SELECT id, concat_ws(chr(10), '*Inspection: ' || coalesce(title, 'Unnamed listing') || '*',
  CASE fit_outcome WHEN 'promising' THEN '🟢' WHEN 'needs_information' THEN '🟡' WHEN 'excluded' THEN '🔴' ELSE '⚪' END || ' ' ||
    CASE fit_outcome WHEN 'promising' THEN 'PROMISING' WHEN 'needs_information' THEN 'NEEDS INFORMATION' WHEN 'excluded' THEN 'EXCLUDED' ELSE 'UNCLASSIFIED' END,
  '', '*Source:* ' || source || ' | *ID:* ' || source_listing_id, {_line('Location', PLACE('Unknown'))}, {_line('Sector', "coalesce(sector_code, sector_raw, 'Unknown')")},
  {_line('Broker', "coalesce(broker_name, 'Unknown')")}, '', {_line('Asking price', f"coalesce({_M('asking_price')}, 'Not disclosed')")},
  {_line('Revenue', f"coalesce(revenue_raw, {_M('revenue')}, 'Not disclosed')")}, {_line('EBITDA', f"coalesce(ebitda_raw, {_M('ebitda')}, 'Not disclosed')")},
  CASE WHEN coalesce(asking_multiple, 0) <> 0 THEN '*Advertised multiple:* ' || {_X} || 'x (based on stated EBITDA — not verified)' END, '',
  CASE WHEN fit_reasons IS NOT NULL THEN chr(10) || '*Rules matched:* ' || array_to_string(fit_reasons[1:4], '; ') END, '',
  {_line('Review state', 'review_state')}, {_line('First seen', "strftime(first_seen, '%d/%m/%Y')")},
  {_line('Last checked', f"strftime({_MELB}, '%d/%m/%Y, ') || CAST((hour({_MELB}) + 11) % 12 + 1 AS VARCHAR) || strftime({_MELB}, ':%M:%S %p')")},
  '*Criteria version:* 0.2', '*Extraction model:* unknown', '', '<' || canonical_url || '|View original listing>') AS text
FROM v_full""", "v_full"))
def inspection_card(spark, folder):
    rows = V.full_listings(spark, folder).withColumns(
        {
            "profit_unspecified_raw": F.lit(None).cast("string"), "description_summary": F.lit(None).cast("string"),
            "criteria_version": F.lit(C.CRITERIA_VERSION), "extraction_version": F.lit(None).cast("string"),
        }
    )
    return rows.select("id", digest.inspection_text().alias("text"))


def _carded(spark, folder):
    """Stored listings with all columns of the package's table."""
    rows = V.full_listings(spark, folder).withColumn("criteria_version", F.lit(C.CRITERIA_VERSION))
    return conform(rows, LISTINGS)


def _landed_details(spark, folder):
    """A detail page for every second listing."""
    rows = V.listings(spark, folder).filter(F.col("k") % 2 == 0)
    html = F.concat(F.lit("<html><body><h1>"), F.coalesce("title", F.lit("Shop")), F.lit("</h1><p>Established 12 years. Turnover: $900,000</p></body></html>"))
    return rows.select("id", "source", F.lit(200).alias("http_status"), html.alias("html"))


def _inspected(spark, folder):
    return service.inspect_batch(V.inspections(spark, folder), _carded(spark, folder), _landed_details(spark, folder), V.now())


@query("inspect_batch", f"""
SELECT r.request_id, r.status, r.answer_id, c.text AS card, CASE WHEN r.status = 'processing' THEN 'Extraction in progress — check back in 30 seconds'
  WHEN r.status IN ('queued','created') THEN 'Inspection queued — check back in 30 seconds' WHEN r.status = 'not_found' THEN 'Listing not found'
  WHEN r.status = 'invalid' THEN CASE WHEN r.request_id % 8 = 6 THEN 'URL must be a supported marketplace URL' ELSE 'Provide url or listingId' END END AS message
FROM ({ORACLE['inspect_route']}) r LEFT JOIN ({ORACLE['inspection_card']}) c ON r.status = 'found' AND c.id = r.answer_id""")
def inspect_batch(spark, folder):
    """Look-up requests with their answers and cards."""
    return _inspected(spark, folder).answers.drop("last_checked")


@query("inspect_state", with_views(f"""
WITH n AS (SELECT answer_id AS id, min(status) AS status FROM ({ORACLE['inspect_route']}) WHERE status IN ('queued','created') GROUP BY 1)
SELECT l.id, CASE WHEN n.id IS NULL THEN processing_state WHEN k % 2 = 0 THEN 'done' WHEN processing_attempts >= {C.MAX_ATTEMPTS} THEN 'failed' ELSE 'retry' END AS processing_state,
  CAST(processing_attempts + CASE WHEN n.id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS processing_attempts
FROM v_listings l LEFT JOIN n ON n.id = l.id
UNION ALL SELECT id, 'retry', 1 FROM n WHERE status = 'created'""", "v_listings"))
def inspect_state(spark, folder):
    """The listings behind a batch of look-up requests: new ones, read ones, and those to try again."""
    return _inspected(spark, folder).listings.select("id", "processing_state", "processing_attempts")


@query("review_batch", with_views(f"""
SELECT seq, listing_id, verdict, CASE verdict WHEN 'accepted' THEN 'Listing marked as ' || action || ' by ' || actor WHEN 'missing_fields' THEN 'listingId, action, and actor are required'
  WHEN 'bad_action' THEN 'action must be watch, pursue, or pass' ELSE 'Listing not found' END AS message,
  CASE WHEN verdict = 'accepted' THEN {S._iso('decided_at')} END AS timestamp
FROM ({S._VERDICT})""", "v_reviews", "v_listings"))
def review_batch(spark, folder):
    """Review requests with their answers."""
    return service.review_batch(V.reviews(spark, folder), V.listings(spark, folder), V.activity(spark, folder)).answers


@query("review_queue", with_views(f"""
WITH r AS ({S._LATEST})
SELECT l.id, coalesce(l.fit_outcome, '') AS fit_outcome FROM v_listings l LEFT JOIN r ON r.listing_id = l.id
WHERE processing_state = 'done' AND fit_outcome IN ('promising','needs_information') AND coalesce(r.action, review_state) = 'new'
  AND NOT EXISTS (SELECT 1 FROM v_activity a WHERE a.listing_id = l.id AND a.event_type = 'digest_delivery' AND a.delivery_state = 'confirmed')""",
    "v_reviews", "v_listings", "v_activity"))
def review_queue(spark, folder):
    """What the next digest would carry behind a batch of reviews."""
    after = service.review_batch(V.reviews(spark, folder), V.listings(spark, folder), V.activity(spark, folder))
    return digest.pending(after.listings, after.activity).select("id", "fit_outcome")


@query("digest_outbox", with_views(f"""
SELECT 'digest:1999-07-01:' || id AS event_key, 'digest' AS kind, {ENTRY} AS text FROM ({S.QUEUE_SQL})""", *_VIEWS))
def digest_outbox(spark, folder):
    from listwright.operators.state import delivery_key

    queue = digest.pending(V.full_listings(spark, folder), V.activity(spark, folder))
    return digest.outbox(queue, "digest", delivery_key(F.col("id"), V.now()), digest.entry_text())


@query("local_dates", """
SELECT event_id, strftime(timezone('Australia/Melbourne', timezone('UTC', ts)), '%Y-%m-%d') AS local_date,
  CAST(hour(timezone('Australia/Melbourne', timezone('UTC', ts))) AS INTEGER) AS local_hour,
  hour(timezone('Australia/Melbourne', timezone('UTC', ts))) = 7 AS is_digest_hour FROM events""")
def local_dates(spark, folder):
    ts = F.col("ts").cast("timestamp")
    return V.table(spark, folder, "events").select(
        "event_id", X.local_date(ts).alias("local_date"), F.hour(X.local_time(ts)).alias("local_hour"),
        digest.is_digest_hour(ts).alias("is_digest_hour"),
    )


# -------------------------------------------------------------------------- streams
# A table may be one file or a folder of part files; a pattern takes either.
def _events_stream(spark, folder):
    schema = V.table(spark, folder, "events").schema
    return prepare(spark).readStream.schema(schema).parquet(f"{folder}/events.parque[t]")


@query("stream_upsert", S.FOLD_SQL)
def stream_upsert(spark, folder):
    """The upsert fold, run as a stream over the landed events."""
    work = work_dir(spark, "upsert")
    table = jobs.sightings_table(f"{work}/state")
    out = jobs.upsert_keyed_stream(V.as_sightings(_events_stream(spark, folder)), table, f"{work}/marks")
    return out.select(*S._fold_cols())


@query("stream_streaks", S.STATUS_SQL)
def stream_streaks(spark, folder):
    """Feed status, folded from a stream of runs."""
    work = work_dir(spark, "runs")
    stored = S._event_sources(spark, folder)
    out = jobs.run_log_stream(V.as_runs(_events_stream(spark, folder)), stored, f"{work}/state", f"{work}/marks")
    return feeds.status_view(out)


@query("stream_discovery", """
SELECT page_id, unnest(generate_series(0, len(h) - 1)) AS pos, unnest(h) AS path
FROM (SELECT page_id, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS h FROM pages) WHERE len(h) > 0""")
def stream_discovery(spark, folder):
    """Links of newly landed pages, exploded batch by batch."""
    work = work_dir(spark, "pages")
    schema = V.table(spark, folder, "pages").schema
    pages = prepare(spark).readStream.schema(schema).parquet(f"{folder}/pages.parque[t]")

    def links(batch):
        found = F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))
        rows = batch.select("page_id", F.posexplode(found).alias("pos", "path"))
        return rows.withColumn("pos", F.col("pos").cast("bigint"))

    return jobs.discovery_stream(pages, links, f"{work}/stubs", f"{work}/marks")


@query("stream_feed_union", ORACLE["feed_union"])
def stream_feed_union(spark, folder):
    """Stubs of newly landed pages of all feeds, read by their adapters batch by batch."""
    work = work_dir(spark, "feeds")
    schema = V.table(spark, folder, "pages").schema
    pages = prepare(spark).readStream.schema(schema).parquet(f"{folder}/pages.parque[t]")
    out = jobs.discovery_stream(P._landed(spark, folder, pages), adapters.union_feeds, f"{work}/stubs", f"{work}/marks")
    return out.select("source", "source_listing_id", "canonical_url")


@query("stream_digest", """
SELECT 'digest:1999-07-01:' || o_orderpriority || ':' || o_orderkey AS event_key, 'confirmed' AS delivery_state, 'outbox' AS message_ref FROM orders""")
def stream_digest(spark, folder):
    """Delivery of a stream of entries: pending, outbox, confirmed."""
    work = work_dir(spark, "digest")
    schema = V.table(spark, folder, "orders").schema
    orders = prepare(spark).readStream.schema(schema).parquet(f"{folder}/orders.parque[t]")
    entries = orders.select(
        F.concat_ws(":", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("https://bsale.com.au/listing/business-"), F.col("o_orderkey").cast("string")).alias("canonical_url"),
    )
    table = jobs.deliveries_table(f"{work}/activity")
    log = jobs.delivery_keyed_stream(entries, table, f"{work}/outbox", f"{work}/marks", V.now())
    return log.select("event_key", "delivery_state", "message_ref")
