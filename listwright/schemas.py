"""Table schemas, value domains and key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_KINDS = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()),
}


def _schema(text: str) -> T.StructType:
    pairs = (item.split() for item in text.split(",") if item.strip())
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


LISTINGS = _schema(
    """
    id string, source string, source_listing_id string, canonical_url string,
    first_seen timestamp, last_seen timestamp, last_fetched timestamp,
    advertised_status string, title string, location_state string, location_suburb string,
    sector_raw string, broker_name string, asking_price bigint,
    revenue bigint, revenue_raw string, ebitda bigint, ebitda_raw string,
    profit_unspecified_raw string, asking_multiple double, lease_years int, staff_count int,
    reason_for_sale string, years_established int, customer_type string,
    claimed_recurring boolean, evidenced_recurring boolean, description_summary string,
    sector_code string, fit_outcome string, fit_reasons strings, missing_facts strings,
    criteria_version string, content_hash string, extraction_version string,
    processing_state string, processing_attempts int, next_retry timestamp,
    lease_claimed_at timestamp, review_state string, broker_ref string
    """
)

SOURCES = _schema(
    """
    name string, adapter string, base_url string, poll_interval_minutes int,
    last_attempt timestamp, last_success timestamp, pagination_checkpoint string,
    discovered_count bigint, consecutive_failures bigint, error_status string,
    coverage_complete boolean
    """
)

ACTIVITY = _schema(
    """
    id string, listing_id string, event_type string, actor string, value string,
    reason string, delivery_state string, message_ref string, event_key string,
    created_at timestamp
    """
)

OUTBOX = _schema("event_key string, kind string, text string")

STUBS = _schema(
    """
    source string, source_listing_id string, canonical_url string, title string,
    asking_price bigint, location_state string, location_suburb string, sector_raw string,
    broker_name string, advertised_status string, seen_at timestamp, seq bigint
    """
)

FACTS = _schema(
    """
    revenue bigint, revenue_raw string, ebitda bigint, ebitda_raw string,
    profit_unspecified_raw string, asking_multiple double, lease_years int, staff_count int,
    reason_for_sale string, years_established int, customer_type string,
    claimed_recurring boolean, description_summary string, sector_classification string,
    advertised_status string
    """
)

PAGES = _schema(
    """
    source string, state string, page_no int, url string, fetched_at timestamp,
    http_status int, html string
    """
)

DOMAINS = {
    "processing_state": ("new", "processing", "done", "retry", "failed"),
    "review_state": ("new", "watch", "pursue", "pass"),
    "fit_outcome": ("promising", "needs_information", "excluded"),
    "customer_type": ("B2B", "B2C", "mixed"),
    "event_type": ("review_decision", "material_change", "digest_delivery"),
    "delivery_state": ("pending", "confirmed", "failed"),
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a schema: missing columns become null, extra ones are dropped."""
    have = set(df.columns)
    return df.select(
        *(
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        )
    )


def outside_domain(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is set but not in the column's declared domain."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*DOMAINS[column]))


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys held by more than one row; empty for a sound snapshot."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def orphans(activity: DataFrame, listings: DataFrame) -> DataFrame:
    """Activity rows whose listing does not exist."""
    return activity.join(
        listings.select(F.col("id").alias("listing_id")), "listing_id", "left_anti"
    )
