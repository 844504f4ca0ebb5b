"""Keyed state of listings and activity: old snapshot plus batch gives the new snapshot.

Nothing is updated in place. Each function takes the current snapshot and a batch and
returns the next snapshot, so running it again over the same inputs gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright import config as C
from listwright.functions import text as X
from listwright.schemas import ACTIVITY, LISTINGS, conform

LATEST = ("title", "location_state", "location_suburb", "sector_raw", "broker_name", "asking_price")
KEY = ("source", "source_listing_id")
ORDER = ("seen_at", "seq")

# Facts that an extraction overwrites, silence included.
OVERWRITTEN = (
    "revenue", "revenue_raw", "ebitda", "ebitda_raw", "profit_unspecified_raw", "asking_multiple",
    "lease_years", "staff_count", "reason_for_sale", "years_established", "customer_type",
    "description_summary",
)


def latest_known(value: str, order=ORDER) -> Column:
    """The last value that was stated at all, with its place in the order."""
    return F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("value"))))


def fold_sightings(stubs: DataFrame, key=KEY) -> DataFrame:
    """All sightings of a listing as one row; combined before the shuffle."""
    return stubs.groupBy(*key).agg(
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
        F.max(F.struct(*ORDER, F.col("canonical_url").alias("value")))["value"].alias("canonical_url"),
        F.min(F.struct(*ORDER, F.col("advertised_status").alias("value")))["value"].alias("advertised_status"),
        *(latest_known(c)["value"].alias(c) for c in LATEST),
    )


def upsert_stubs(listings: DataFrame, stubs: DataFrame) -> DataFrame:
    """Insert unseen listings, refresh seen ones.

    A refresh moves last_seen and the URL and fills in what the sighting states; the first
    sighting's status, first_seen, facts, processing and review state stay untouched.
    """
    batch = fold_sightings(stubs)
    old, new = listings.alias("o"), batch.alias("n")
    same = (F.col("o.source") == F.col("n.source")) & (
        F.col("o.source_listing_id") == F.col("n.source_listing_id")
    )
    both = old.join(new, same, "full_outer")
    is_new = F.col("o.id").isNull()
    refreshed = set(LATEST) | {"canonical_url"}
    fresh = {
        "first_seen": F.col("n.first_seen"),
        "advertised_status": F.col("n.advertised_status"),
        "source": F.col("n.source"),
        "source_listing_id": F.col("n.source_listing_id"),
        "id": F.concat_ws(":", F.col("n.source"), F.col("n.source_listing_id")),
        "processing_state": F.lit("new"),
        "processing_attempts": F.lit(0),
        "review_state": F.lit("new"),
        "claimed_recurring": F.lit(False),
        "evidenced_recurring": F.lit(False),
    }

    def column(name: str) -> Column:
        stored = F.col(f"o.{name}")
        if name == "last_seen":
            return F.coalesce(F.col("n.last_seen"), stored)
        if name in refreshed:
            return F.coalesce(F.col(f"n.{name}"), stored)
        if name in fresh:
            return F.when(is_new, fresh[name]).otherwise(stored)
        return stored

    return both.select(*(column(f.name).cast(f.dataType).alias(f.name) for f in LISTINGS.fields))


def claimable(now: Column, lease_minutes: int | None = None) -> Column:
    due = F.col("next_retry").isNull() | (F.col("next_retry") <= now)
    waiting = F.col("processing_state").isin("new", "retry") & due
    if lease_minutes is None:
        return waiting
    stale = (F.col("processing_state") == "processing") & (
        F.col("lease_claimed_at") <= now - X.minutes(F.lit(lease_minutes))
    )
    return waiting | F.coalesce(stale, F.lit(False))


def claim_order() -> list[Column]:
    rank = F.when(F.col("processing_state") == "new", 0).otherwise(1)
    return [rank.asc(), F.col("first_seen").asc(), F.col("id").asc()]


def select_claims(
    listings: DataFrame, now: Column, limit: int = C.CLAIM_BATCH, lease_minutes: int | None = None
) -> DataFrame:
    """The next batch to work on: new before retry, oldest first.

    With ``lease_minutes`` rows whose lease ran out are taken up again as well.
    """
    return listings.filter(claimable(now, lease_minutes)).orderBy(*claim_order()).limit(limit)


def claim_batch(
    listings: DataFrame, now: Column, limit: int = C.CLAIM_BATCH, lease_minutes: int | None = None
) -> DataFrame:
    """Snapshot in which the next batch is marked as being processed."""
    picked = select_claims(listings, now, limit, lease_minutes).select("id", F.lit(True).alias("_mine"))
    mine = F.coalesce("_mine", F.lit(False))
    return (
        listings.join(picked, "id", "left")
        .withColumns(
            {
                "processing_state": F.when(mine, "processing").otherwise(F.col("processing_state")),
                "lease_claimed_at": F.when(mine, now).otherwise(F.col("lease_claimed_at")),
            }
        )
        .drop("_mine")
        .select(*listings.columns)
    )


def mark_extracted(listings: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Write extraction and rule results back.

    ``results`` has one row per id: the facts, outcome, matched_rules, missing_facts,
    sector_code, criteria_version, content_hash and, from the detail page, the overlaid
    columns. Facts are overwritten even by null; an unstated status keeps the stored one.
    """
    have = set(results.columns)
    said = results.select("id", *(F.col(c).alias(f"_{c}") for c in results.columns if c != "id"), F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False))

    def new(name):
        return F.col(f"_{name}") if name in have else F.lit(None)

    values = {c: new(c) for c in OVERWRITTEN}
    values |= {
        "last_fetched": now,
        "advertised_status": F.coalesce(new("advertised_status"), F.col("advertised_status")),
        "claimed_recurring": F.coalesce(new("claimed_recurring"), F.lit(False)),
        "evidenced_recurring": F.lit(False),
        "sector_code": new("sector_code"),
        "fit_outcome": new("outcome"),
        "fit_reasons": new("matched_rules"),
        "missing_facts": new("missing_facts"),
        "criteria_version": new("criteria_version"),
        "content_hash": new("content_hash"),
        "extraction_version": F.lit(C.EXTRACTION_VERSION),
        "processing_state": F.lit("done"),
        "processing_attempts": F.col("processing_attempts") + 1,
        "lease_claimed_at": F.lit(None),
    }
    # What the detail page adds is kept, too, where it says anything.
    values |= {c: F.coalesce(new(c), F.col(c)) for c in (*LATEST, "broker_ref") if c in have}
    kinds = {f.name: f.dataType for f in listings.schema.fields}
    updates = {
        c: F.when(hit, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items() if c in kinds
    }
    return listings.join(said, "id", "left").withColumns(updates).select(*listings.columns)


def mark_failed(listings: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Schedule failed ids for another try, with growing delay, until attempts run out."""
    bad = failures.select("id", F.lit(True).alias("_bad")).distinct()
    tries = F.col("processing_attempts")
    delay = F.least((tries + 1) * C.RETRY_STEP_MINUTES, F.lit(C.RETRY_CAP_MINUTES))
    hit = F.coalesce("_bad", F.lit(False))
    state = F.when(tries >= C.MAX_ATTEMPTS, "failed").otherwise("retry")
    return (
        listings.join(bad, "id", "left")
        .withColumns(
            {
                "processing_state": F.when(hit, state).otherwise(F.col("processing_state")),
                "next_retry": F.when(hit, now + X.minutes(delay)).otherwise(F.col("next_retry")),
                "lease_claimed_at": F.when(~hit, F.col("lease_claimed_at")),
                "processing_attempts": F.when(hit, tries + 1).otherwise(tries),
            }
        )
        .select(*listings.columns)
    )


def changed_pages(listings: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched pages whose listing is not done yet or whose content differs."""
    done = listings.filter((F.col("processing_state") == "done") & F.col("content_hash").isNotNull())
    return fetched.join(done.select("id", "content_hash"), ["id", "content_hash"], "left_anti")


def refresh_unchanged(listings: DataFrame, fetched: DataFrame, now: Column) -> DataFrame:
    """Move the fetch time of done listings whose page came back unchanged; keep their facts."""
    same = fetched.select("id", "content_hash", F.lit(True).alias("_same")).distinct()
    hit = F.coalesce(F.col("_same") & (F.col("processing_state") == "done"), F.lit(False))
    return (
        listings.join(same, ["id", "content_hash"], "left")
        .withColumn("last_fetched", F.when(hit, now).otherwise(F.col("last_fetched")))
        .select(*listings.columns)
    )


def stable_id(event_key: Column) -> Column:
    return F.sha2(event_key, 256)


def delivery_key(listing: Column, now: Column) -> Column:
    return F.concat_ws(":", F.lit("digest"), X.local_date(now), listing)


def unlogged(activity: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose event key is not in the log yet, so that a replay adds nothing."""
    return rows.join(activity.select("event_key").distinct(), "event_key", "left_anti").select(*rows.columns)


def pending_rows(activity: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """A pending delivery per entry whose key is not in the log yet."""
    rows = (
        entries.select(F.col("id").alias("listing_id"))
        .distinct()
        .withColumn("event_key", delivery_key(F.col("listing_id"), now))
        .withColumns(
            {
                "event_type": F.lit("digest_delivery"),
                "delivery_state": F.lit("pending"),
                "created_at": now,
                "id": stable_id(F.col("event_key")),
            }
        )
    )
    return conform(unlogged(activity, rows), ACTIVITY)


def record_pending(activity: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    return conform(activity, ACTIVITY).unionByName(pending_rows(activity, entries, now))


def confirm_delivery(activity: DataFrame, sent: DataFrame) -> DataFrame:
    """Mark deliveries as confirmed by key; ``sent(event_key, message_ref)``."""
    refs = sent.groupBy("event_key").agg(F.max("message_ref").alias("_ref"), F.lit(True).alias("_sent"))
    hit = F.coalesce("_sent", F.lit(False))
    return (
        activity.join(refs, "event_key", "left")
        .withColumns(
            {
                "delivery_state": F.when(hit, "confirmed").otherwise(F.col("delivery_state")),
                "message_ref": F.when(hit, F.col("_ref")).otherwise(F.col("message_ref")),
            }
        )
        .select(*activity.columns)
    )


def review_key(listing: Column, at: Column) -> Column:
    return F.concat_ws(":", F.lit("review"), listing, F.unix_millis(at).cast("string"))


def latest_reviews(reviews: DataFrame, key: str = "listing_id", seq: str = "seq") -> DataFrame:
    """The decision in force per listing: the last one."""
    last = F.max(F.struct("decided_at", seq, "action", "actor", "reason")).alias("_last")
    return reviews.groupBy(key).agg(last, F.count("*").alias("n_reviews")).select(
        key, "_last.action", "_last.actor", "_last.reason", "_last.decided_at", "n_reviews"
    )


def record_reviews(
    listings: DataFrame, activity: DataFrame, reviews: DataFrame, seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """Append decisions and set the review state; ``reviews`` are routed as accepted already."""
    rows = reviews.withColumn("event_key", review_key(F.col("listing_id"), F.col("decided_at")))
    # Of several decisions in one millisecond the first one is the one that a replay keeps too.
    rest = [c for c in rows.columns if c not in ("event_key", seq)]
    first = rows.groupBy("event_key").agg(F.min(F.struct(seq, *rest)).alias("_first")).select("event_key", "_first.*")
    rows = first.withColumns(
        {
            "event_type": F.lit("review_decision"),
            "value": F.col("action"),
            "created_at": F.col("decided_at"),
            "id": stable_id(F.col("event_key")),
        }
    )
    absent = rows.join(activity.select("event_key").distinct(), "event_key", "left_anti")
    log = conform(activity, ACTIVITY).unionByName(conform(absent, ACTIVITY))
    now = latest_reviews(reviews, seq=seq).select(F.col("listing_id").alias("id"), F.col("action").alias("_action"))
    state = F.coalesce("_action", "review_state")
    current = listings.join(now, "id", "left").withColumn("review_state", state)
    return current.select(*listings.columns), log


def unknown_url_stubs(requests: DataFrame) -> DataFrame:
    """Stub for a requested URL nobody has listed yet; ``requests(url, requested_at, seq)``.

    A URL asked for more than once gets the stub of its first request, and only URLs of a
    supported market get one.
    """
    url = F.col("url")
    asked = requests.filter(url.isNotNull() & X.is_market_url(url))
    first = F.min(F.struct("requested_at", "seq")).alias("_first")
    requests = asked.groupBy("url").agg(first).select("url", "_first.requested_at", "_first.seq")
    number = F.coalesce(
        X.url_number(url, php=True),
        F.concat(F.lit("manual:"), F.unix_millis("requested_at").cast("string")),
    )
    return requests.select(
        X.feed_of_url(url).alias("source"),
        number.alias("source_listing_id"),
        url.alias("canonical_url"),
        F.lit("On-demand inspection").alias("title"),
        F.lit(None).cast("bigint").alias("asking_price"),
        *(F.lit(None).cast("string").alias(c) for c in ("location_state", "location_suburb", "sector_raw", "broker_name", "advertised_status")),
        F.col("requested_at").alias("seen_at"),
        F.col("seq"),
    )


