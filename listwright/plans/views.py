"""The given tables seen as this package's tables, in Spark and, for checking, in SQL.

Every view keeps all rows of the table it is made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listwright import config as C
from listwright.functions.text import one_of
from listwright.session import prepare

NOW = "1999-06-30 20:00:00"
SECTORS = (
    "fire_safety", "hvac_maintenance", "electrical_maintenance", "vehicle_inspection",
    "insurance_broking", "mortgage_broking", "allied_health", "home_care",
    "building_maintenance_strata", "bookkeeping_accounting", "physiotherapy", "swim_school",
    "commercial_cleaning", "preventive_health", "ndis_services", "childcare",
    "vocational_training", "dentistry", "hospitality", "retail", "franchise", "gym_fitness",
    "professional_services", "Unknown", "building_pest_inspection",
)
PROCESSING = ("done", "done", "done", "done", "new", "retry", "processing", "failed", "done", "done")
REVIEWS = ("new", "new", "new", "new", "new", "new", "new", "watch", "pursue", "pass")
REASONS = ("Owner retirement", "Relocating overseas", "Family reasons", "Other interests", "Health")
PASS_REASONS = ("too small", "price", "sector")
PHRASES = (
    "Well kept premises.", "A licensed and accredited operator.", "Serving government and corporate accounts.",
    "Established for 12 years of operation.", "Runs service contracts with heavy machinery on site.",
    "Needs heavy machinery and a fleet of vehicles.", "Friendly team.", "Sole client is a mine.",
    "Operating under a franchise agreement.", "Closing down sale.", "New Zealand only.", "Good location.",
    "Trade customers across the region.", "Founded in a garage, 3 years old.", "AFSL holder, 45% of revenue from one group.",
    "Easy to run.", "QBCC registration held.", "100% of revenue from tourism.", "Institutional buyers.", "Parking at the rear.",
)
TITLES = ("Business", "Franchise outlet", "Firm", "Practice", "Company", "Service", "Agency", "Trade business")


# Column types of the given tables, so that no file has to be opened to plan a query.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values, index: Column) -> Column:
    return F.element_at(one_of(values), (index % len(values)).cast("int") + 1)


def sql_pick(values, index: str) -> str:
    return f"({_sql_list(values)})[({index}) % {len(values)} + 1]"


def tens(k: Column, by: int) -> Column:
    return F.floor(k / by).cast("bigint")


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as stored listings."""
    return _as_listings(_brokered(spark, folder))


def _brokered(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("broker_name"))
    return table(spark, folder, "orders").join(names, "o_custkey", "left")


def _as_listings(orders: DataFrame, *more: str) -> DataFrame:
    k = F.col("o_orderkey")
    seen = F.col("o_orderdate").cast("timestamp")
    stage = pick(PROCESSING, k)
    done = stage == "done"
    outcome = F.when(F.col("o_orderstatus") == "P", "promising").when(F.col("o_orderstatus") == "O", "needs_information").otherwise("excluded")
    return orders.select(
        k.alias("k"),
        F.concat_ws(":", "o_orderpriority", k.cast("string")).alias("id"),
        F.col("o_orderpriority").alias("source"),
        k.cast("string").alias("source_listing_id"),
        F.concat(F.lit("https://bsale.com.au/listing/business-"), (k - F.when(k % 10 == 9, 1).otherwise(0)).cast("string")).alias("canonical_url"),
        seen.alias("first_seen"),
        seen.alias("last_seen"),
        F.when(done, seen + F.make_dt_interval(days=(k % 20).cast("int"))).alias("last_fetched"),
        F.when(k % 23 == 0, "sold").alias("advertised_status"),
        F.when(k % 17 != 0, F.concat_ws(" ", pick(TITLES, tens(k, 3)), k.cast("string"))).alias("title"),
        F.when(k % 11 != 0, pick(C.SLUG_STATES, k)).alias("location_state"),
        F.when(k % 5 != 0, F.concat(F.lit("Suburb "), (k % 40).cast("string"))).alias("location_suburb"),
        pick(SECTORS, tens(k, 2)).alias("sector_raw"),
        "broker_name",
        F.when(k % 97 == 0, F.lit(0).cast("bigint")).when(k % 13 != 0, F.floor(F.col("o_totalprice") * 20).cast("bigint")).alias("asking_price"),
        F.when(done, outcome).alias("fit_outcome"),
        F.when(done, F.sha2((k % 1000).cast("string"), 256)).alias("content_hash"),
        stage.alias("processing_state"),
        (k % 7).cast("int").alias("processing_attempts"),
        F.when(stage == "retry", seen + F.make_dt_interval(hours=(k % 50).cast("int"))).alias("next_retry"),
        F.when(stage == "processing", seen + F.make_dt_interval(hours=(k % 48).cast("int"))).alias("lease_claimed_at"),
        pick(REVIEWS, tens(k, 10)).alias("review_state"),
        *more,
    )


_SQL: dict[str, tuple[tuple[str, ...], str]] = {}

_SQL["v_listings"] = ((), f"""
  SELECT o_orderkey AS k, o_orderpriority || ':' || o_orderkey AS id, o_orderpriority AS source,
    CAST(o_orderkey AS VARCHAR) AS source_listing_id,
    'https://bsale.com.au/listing/business-' || (o_orderkey - CASE WHEN o_orderkey % 10 = 9 THEN 1 ELSE 0 END) AS canonical_url,
    o_orderdate AS first_seen, o_orderdate AS last_seen,
    CASE WHEN {sql_pick(PROCESSING, 'o_orderkey')} = 'done' THEN o_orderdate + to_days(CAST(o_orderkey % 20 AS INTEGER)) END AS last_fetched,
    CASE WHEN o_orderkey % 23 = 0 THEN 'sold' END AS advertised_status,
    CASE WHEN o_orderkey % 17 <> 0 THEN {sql_pick(TITLES, 'o_orderkey // 3')} || ' ' || o_orderkey END AS title,
    CASE WHEN o_orderkey % 11 <> 0 THEN {sql_pick(C.SLUG_STATES, 'o_orderkey')} END AS location_state,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'Suburb ' || (o_orderkey % 40) END AS location_suburb,
    {sql_pick(SECTORS, 'o_orderkey // 2')} AS sector_raw,
    c_name AS broker_name,
    CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderkey % 13 <> 0 THEN CAST(floor(o_totalprice * 20) AS BIGINT) END AS asking_price,
    CASE WHEN {sql_pick(PROCESSING, 'o_orderkey')} = 'done' THEN
      CASE o_orderstatus WHEN 'P' THEN 'promising' WHEN 'O' THEN 'needs_information' ELSE 'excluded' END END AS fit_outcome,
    CASE WHEN {sql_pick(PROCESSING, 'o_orderkey')} = 'done' THEN sha256(CAST(o_orderkey % 1000 AS VARCHAR)) END AS content_hash,
    {sql_pick(PROCESSING, 'o_orderkey')} AS processing_state,
    CAST(o_orderkey % 7 AS INTEGER) AS processing_attempts,
    CASE WHEN {sql_pick(PROCESSING, 'o_orderkey')} = 'retry' THEN o_orderdate + to_hours(o_orderkey % 50) END AS next_retry,
    CASE WHEN {sql_pick(PROCESSING, 'o_orderkey')} = 'processing' THEN o_orderdate + to_hours(o_orderkey % 48) END AS lease_claimed_at,
    {sql_pick(REVIEWS, 'o_orderkey // 10')} AS review_state
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")


def facts(spark: SparkSession, folder: str, keys: DataFrame | None = None) -> DataFrame:
    """Line items per order as extracted facts; an order without lines has none.

    ``keys(k)``, a few rows, limits the work to the orders a report shows.
    """
    li = table(spark, folder, "lineitem")
    if keys is not None:
        li = li.join(F.broadcast(keys.withColumnRenamed("k", "l_orderkey")), "l_orderkey", "left_semi")
    money = "decimal(18,2)"
    per = li.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.sum(F.col("l_extendedprice").cast(money)).alias("s"),
        F.sum(F.col("l_discount").cast(money)).cast("double").alias("d"),
        F.count("*").alias("n"),
        F.max("l_partkey").alias("p_partkey"),
    )
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    part = table(spark, folder, "part").select("p_partkey", pick(SECTORS, brand).alias("sector"))
    k = F.col("k")
    revenue = F.floor(F.col("s") * 40).cast("bigint")
    ebitda = F.floor(revenue.cast("double") * (F.col("d") / F.col("n") - 0.02) * 4).cast("bigint")
    return per.join(part, "p_partkey", "left").select(
        "k",
        F.when(k % 7 != 0, revenue).alias("revenue"),
        F.when(k % 3 != 0, ebitda).alias("ebitda"),
        (k % 4 == 1).alias("claimed_recurring"),
        F.when(k % 2 != 0, F.col("n").cast("int")).alias("years_established"),
        F.when(k % 5 == 0, "B2B").when(k % 5 == 1, "B2C").when(k % 5 == 2, "mixed").alias("customer_type"),
        F.when(k % 6 != 0, pick(REASONS, k)).alias("reason_for_sale"),
        "sector",
    )


_SQL["v_facts"] = ((), f"""
  SELECT k, CASE WHEN k % 7 <> 0 THEN revenue END AS revenue,
    CASE WHEN k % 3 <> 0 THEN CAST(floor(CAST(revenue AS DOUBLE) * (d / n - CAST(0.02 AS DOUBLE)) * 4) AS BIGINT) END AS ebitda,
    k % 4 = 1 AS claimed_recurring,
    CASE WHEN k % 2 <> 0 THEN CAST(n AS INTEGER) END AS years_established,
    CASE k % 5 WHEN 0 THEN 'B2B' WHEN 1 THEN 'B2C' WHEN 2 THEN 'mixed' END AS customer_type,
    CASE WHEN k % 6 <> 0 THEN {sql_pick(REASONS, 'k')} END AS reason_for_sale,
    {sql_pick(SECTORS, "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER)")} AS sector
  FROM (SELECT l_orderkey AS k, CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18,2))) * 40) AS BIGINT) AS revenue,
      CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS d, count(*) AS n, max(l_partkey) AS pk
    FROM lineitem GROUP BY 1) LEFT JOIN part ON p_partkey = pk""")


def descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """A text per order: the whole document of the same number, where there is one, and two phrases."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("k"), "text")
    k = F.col("k")
    phrases = F.concat_ws(" ", pick(PHRASES, k), pick(PHRASES, tens(k, len(PHRASES))))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"))
    return orders.join(docs, "k", "left").select("k", F.concat_ws(" ", "text", phrases).alias("description"))


_SQL["v_desc"] = ((), f"""
  SELECT o_orderkey AS k, concat_ws(' ', text, {sql_pick(PHRASES, 'o_orderkey')}, {sql_pick(PHRASES, f'o_orderkey // {len(PHRASES)}')}) AS description
  FROM orders LEFT JOIN documents ON doc_id = o_orderkey""")


def rule_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rule inputs: listing, facts and text of every order."""
    base = listings(spark, folder).select("k", "id", "title", "location_state", "asking_price", "first_seen")
    return (
        base.join(facts(spark, folder), "k", "left")
        .join(descriptions(spark, folder), "k")
        .withColumn("claimed_recurring", F.coalesce("claimed_recurring", F.lit(False)))
    )


_SQL["v_rules"] = (("v_listings", "v_facts", "v_desc"), """
  SELECT l.k, l.id, l.title, l.location_state, l.asking_price, l.first_seen, f.revenue, f.ebitda,
    coalesce(f.claimed_recurring, false) AS claimed_recurring, f.years_established, f.customer_type,
    f.reason_for_sale, f.sector, t.description
  FROM v_listings l LEFT JOIN v_facts f USING (k) JOIN v_desc t USING (k)""")


def full_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Stored listings with facts, as after extraction.

    Facts join the bare orders, so that no text made of them goes through a shuffle.
    """
    known = facts(spark, folder).withColumnsRenamed({"sector": "sector_code", "k": "o_orderkey"})
    rows = _brokered(spark, folder).join(known, "o_orderkey", "left")
    return _with_statements(_as_listings(rows, *(c for c in known.columns if c != "o_orderkey")))


def with_facts(stored: DataFrame, known: DataFrame) -> DataFrame:
    return _with_statements(stored.join(known.withColumnRenamed("sector", "sector_code"), "k", "left"))


def _with_statements(rows: DataFrame) -> DataFrame:
    price, ebitda = F.col("asking_price"), F.col("ebitda")
    ratio = F.when((price > 0) & (ebitda > 0), F.floor(F.try_divide(price.cast("double"), ebitda.cast("double")) * 10 + 0.5) / 10)
    return rows.withColumns(
        {
            "revenue_raw": F.when(F.col("revenue").isNotNull() & (F.col("k") % 8 != 0), F.concat(F.lit("$"), F.col("revenue").cast("string"), F.lit(" p.a."))),
            "ebitda_raw": F.when(F.col("ebitda").isNotNull() & (F.col("k") % 8 == 1), F.concat(F.lit("EBITDA $"), F.col("ebitda").cast("string"))),
            "asking_multiple": ratio,
            "fit_reasons": F.when(F.col("k") % 9 != 0, F.array(F.lit("Tier 1 sector"), F.concat(F.lit("Signal "), (F.col("k") % 3).cast("string")), F.lit("NDIS: caution"), F.lit("Licensed"), F.lit("Tenure"))),
            "missing_facts": F.when(F.col("k") % 4 != 0, F.array(F.lit("EBITDA not disclosed"), F.lit("Location not identified"), F.lit("Revenue not disclosed"))),
        }
    )


_SQL["v_full"] = (("v_listings", "v_facts"), """
  SELECT l.*, f.revenue, f.ebitda, f.claimed_recurring, f.years_established, f.customer_type, f.reason_for_sale,
    f.sector AS sector_code,
    CASE WHEN f.revenue IS NOT NULL AND l.k % 8 <> 0 THEN '$' || f.revenue || ' p.a.' END AS revenue_raw,
    CASE WHEN f.ebitda IS NOT NULL AND l.k % 8 = 1 THEN 'EBITDA $' || f.ebitda END AS ebitda_raw,
    CASE WHEN l.asking_price > 0 AND f.ebitda > 0 THEN floor(CAST(l.asking_price AS DOUBLE) / CAST(f.ebitda AS DOUBLE) * 10 + CAST(0.5 AS DOUBLE)) / 10 END AS asking_multiple,
    CASE WHEN l.k % 9 <> 0 THEN ['Tier 1 sector', 'Signal ' || (l.k % 3), 'NDIS: caution', 'Licensed', 'Tenure'] END AS fit_reasons,
    CASE WHEN l.k % 4 <> 0 THEN ['EBITDA not disclosed', 'Location not identified', 'Revenue not disclosed'] END AS missing_facts
  FROM v_listings l LEFT JOIN v_facts f USING (k)""")


def sightings(spark: SparkSession, folder: str) -> DataFrame:
    """Events as sightings of listings: some state a field, some do not."""
    return as_sightings(table(spark, folder, "events"))


def as_sightings(e: DataFrame) -> DataFrame:
    n, v = F.col("event_id"), F.col("value")
    number = F.col("user_id").cast("string")
    return e.select(
        F.col("event_type").alias("source"),
        number.alias("source_listing_id"),
        F.concat(F.lit("https://bsale.com.au/listing/item-"), (n % 3).cast("string"), F.lit("-"), number).alias("canonical_url"),
        F.when(n % 4 != 0, F.concat(F.lit("Title "), (n % 50).cast("string"))).alias("title"),
        F.when(v >= 20, F.floor(v * 1000).cast("bigint")).alias("asking_price"),
        F.when(n % 6 == 0, pick(C.SLUG_STATES, tens(n, 6))).alias("location_state"),
        F.when(n % 9 == 0, F.concat(F.lit("Suburb "), (n % 12).cast("string"))).alias("location_suburb"),
        F.when(n % 5 == 0, pick(SECTORS, n)).alias("sector_raw"),
        F.when(n % 7 == 0, F.concat(F.lit("Broker "), (n % 20).cast("string"))).alias("broker_name"),
        F.when(n % 10 == 0, "under contract").alias("advertised_status"),
        F.col("ts").cast("timestamp").alias("seen_at"),
        n.alias("seq"),
    )


_SQL["v_sightings"] = ((), f"""
  SELECT event_type AS source, CAST(user_id AS VARCHAR) AS source_listing_id,
    'https://bsale.com.au/listing/item-' || (event_id % 3) || '-' || user_id AS canonical_url,
    CASE WHEN event_id % 4 <> 0 THEN 'Title ' || (event_id % 50) END AS title,
    CASE WHEN value >= 20 THEN CAST(floor(value * 1000) AS BIGINT) END AS asking_price,
    CASE WHEN event_id % 6 = 0 THEN {sql_pick(C.SLUG_STATES, 'event_id // 6')} END AS location_state,
    CASE WHEN event_id % 9 = 0 THEN 'Suburb ' || (event_id % 12) END AS location_suburb,
    CASE WHEN event_id % 5 = 0 THEN {sql_pick(SECTORS, 'event_id')} END AS sector_raw,
    CASE WHEN event_id % 7 = 0 THEN 'Broker ' || (event_id % 20) END AS broker_name,
    CASE WHEN event_id % 10 = 0 THEN 'under contract' END AS advertised_status,
    ts AS seen_at, event_id AS seq
  FROM events""")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as feed runs; a low value is a failed run."""
    return as_runs(table(spark, folder, "events"))


def as_runs(e: DataFrame) -> DataFrame:
    n = F.col("event_id")
    ok = F.col("value") >= 20
    return e.select(
        F.col("event_type").alias("source"),
        F.col("ts").cast("timestamp").alias("ts"),
        n.alias("seq"),
        ok.alias("ok"),
        F.when(ok, n % 100).otherwise(0).alias("discovered"),
        F.when(n % 3 == 0, (n % 30).cast("string")).alias("checkpoint"),
        (ok & (n % 4 != 0)).alias("coverage_complete"),
    )


_SQL["v_runs"] = ((), """
  SELECT event_type AS source, ts, event_id AS seq, value >= 20 AS ok,
    CASE WHEN value >= 20 THEN event_id % 100 ELSE 0 END AS discovered,
    CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 30 AS VARCHAR) END AS checkpoint,
    value >= 20 AND event_id % 4 <> 0 AS coverage_complete
  FROM events""")

POLL = (60, 240, 1440, 10_000, 525_600)


def stored_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Order priorities as stored feeds; the time of the last order is the last attempt."""
    o = table(spark, folder, "orders")
    per = o.groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.max(F.col("o_orderdate").cast("timestamp")).alias("last_attempt"),
        F.max(F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate").cast("timestamp"))).alias("last_success"),
        F.count("*").alias("n"),
    )
    rank = F.left("name", F.lit(1)).cast("int")
    return per.select(
        "name",
        F.when(rank % 2 == 0, "cards").otherwise("item_list").alias("adapter"),
        F.concat(F.lit("https://feed-"), rank.cast("string"), F.lit(".com.au")).alias("base_url"),
        F.element_at(F.array(*(F.lit(p) for p in POLL)), rank).alias("poll_interval_minutes"),
        F.when(rank != 3, F.col("last_attempt")).alias("last_attempt"),
        "last_success",
        F.lit(None).cast("string").alias("pagination_checkpoint"),
        F.col("n").alias("discovered_count"),
        (F.col("n") % 3).cast("bigint").alias("consecutive_failures"),
        F.when(F.col("n") % 3 != 0, "fetch_failed").alias("error_status"),
        (F.col("n") % 2 == 0).alias("coverage_complete"),
    )


_SQL["v_sources"] = ((), f"""
  SELECT name, CASE WHEN r % 2 = 0 THEN 'cards' ELSE 'item_list' END AS adapter,
    'https://feed-' || r || '.com.au' AS base_url, ({list(POLL)})[r] AS poll_interval_minutes,
    CASE WHEN r <> 3 THEN la END AS last_attempt, ls AS last_success, CAST(NULL AS VARCHAR) AS pagination_checkpoint,
    n AS discovered_count, n % 3 AS consecutive_failures,
    CASE WHEN n % 3 <> 0 THEN 'fetch_failed' END AS error_status, n % 2 = 0 AS coverage_complete
  FROM (SELECT o_orderpriority AS name, CAST(left(o_orderpriority, 1) AS INTEGER) AS r, max(o_orderdate) AS la,
      max(CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END) AS ls, count(*) AS n FROM orders GROUP BY 1, 2)""")


def feed_config(spark: SparkSession, folder: str) -> DataFrame:
    """Feeds as configured: order priorities and event types, one of each switched off."""
    names = (
        table(spark, folder, "orders").select(F.col("o_orderpriority").alias("name"))
        .unionByName(table(spark, folder, "events").select(F.col("event_type").alias("name")))
        .distinct()
    )
    return names.select(
        "name",
        F.lit("cards").alias("adapter"),
        F.concat(F.lit("https://"), F.lower(F.regexp_replace("name", "[^A-Za-z]+", "-")), F.lit(".com.au")).alias("base_url"),
        F.concat(F.lit("https://"), F.lower(F.regexp_replace("name", "[^A-Za-z]+", "-")), F.lit(".com.au/sale")).alias("search_url"),
        F.length("name").alias("max_pages"),
        F.when(F.length("name") > 5, 120).cast("int").alias("poll_interval_minutes"),
        (~F.col("name").isin("5-LOW", "view")).alias("enabled"),
    )


_SQL["v_feeds"] = ((), """
  SELECT name, 'cards' AS adapter, 'https://' || lower(regexp_replace(name, '[^A-Za-z]+', '-', 'g')) || '.com.au' AS base_url,
    'https://' || lower(regexp_replace(name, '[^A-Za-z]+', '-', 'g')) || '.com.au/sale' AS search_url,
    CAST(length(name) AS INTEGER) AS max_pages, CASE WHEN length(name) > 5 THEN 120 END AS poll_interval_minutes,
    name NOT IN ('5-LOW', 'view') AS enabled
  FROM (SELECT o_orderpriority AS name FROM orders UNION SELECT event_type FROM events)""")


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the activity log of the listings made from orders.

    Event n is about the order of the same number, so most listings have one entry.
    """
    e = table(spark, folder, "events").withColumnRenamed("event_id", "k")
    ids = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"), F.concat_ws(":", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("listing_id")
    )
    kind = F.col("event_type")
    delivery = kind.isin("purchase", "click")
    at = F.col("ts").cast("timestamp")
    key = F.when(delivery, F.concat_ws(":", F.lit("digest"), F.date_format(at, "yyyy-MM-dd"), "listing_id")).otherwise(
        F.concat_ws(":", kind, "listing_id")
    )
    return e.join(ids, "k", "left").select(
        F.sha2(key, 256).alias("id"),
        "listing_id",
        F.when(delivery, "digest_delivery").when(kind == "signup", "review_decision").otherwise("material_change").alias("event_type"),
        F.when(kind == "signup", F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("actor"),
        F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("string").alias("reason"),
        F.when(kind == "purchase", "confirmed").when(kind == "click", "pending").alias("delivery_state"),
        F.when(kind == "purchase", "outbox").alias("message_ref"),
        key.alias("event_key"),
        at.alias("created_at"),
    )


_SQL["v_activity"] = ((), """
  SELECT sha256(event_key) AS id, * FROM (
    SELECT o_orderpriority || ':' || o_orderkey AS listing_id,
      CASE WHEN event_type IN ('purchase','click') THEN 'digest_delivery' WHEN event_type = 'signup' THEN 'review_decision' ELSE 'material_change' END AS event_type,
      CASE WHEN event_type = 'signup' THEN 'user ' || user_id END AS actor,
      CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'click' THEN 'pending' END AS delivery_state,
      CASE WHEN event_type = 'purchase' THEN 'outbox' END AS message_ref,
      CASE WHEN event_type IN ('purchase','click') THEN concat_ws(':', 'digest', strftime(ts, '%Y-%m-%d'), o_orderpriority || ':' || o_orderkey)
        ELSE concat_ws(':', event_type, o_orderpriority || ':' || o_orderkey) END AS event_key,
      ts AS created_at
    FROM events LEFT JOIN orders ON o_orderkey = event_id)""")


ACTIONS = ("watch", "pursue", "pass", "pass", "archive")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Events as review requests by customers' user number; some are faulty."""
    e = table(spark, folder, "events")
    ids = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("user_id"), F.concat_ws(":", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("id")
    )
    n = F.col("event_id")
    return e.join(ids, "user_id", "left").select(
        F.when(n % 40 == 0, F.concat(F.lit("gone:"), n.cast("string"))).otherwise(F.col("id")).alias("listing_id"),
        pick(ACTIONS, tens(n, 2)).alias("action"),
        F.when(n % 25 != 0, F.concat(F.lit("partner "), (n % 4).cast("string"))).alias("actor"),
        F.when(n % 2 == 0, pick(PASS_REASONS, tens(n, 4))).alias("reason"),
        F.col("ts").cast("timestamp").alias("decided_at"),
        n.alias("seq"),
    )


_SQL["v_reviews"] = ((), f"""
  SELECT CASE WHEN event_id % 40 = 0 THEN 'gone:' || event_id ELSE o_orderpriority || ':' || o_orderkey END AS listing_id,
    {sql_pick(ACTIONS, 'event_id // 2')} AS action,
    CASE WHEN event_id % 25 <> 0 THEN 'partner ' || (event_id % 4) END AS actor,
    CASE WHEN event_id % 2 = 0 THEN {sql_pick(PASS_REASONS, 'event_id // 4')} END AS reason,
    ts AS decided_at, event_id AS seq
  FROM events LEFT JOIN orders ON o_orderkey = user_id""")


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Events as extractor replies: plain JSON, wrapped in prose, broken, or no JSON at all."""
    e = table(spark, folder, "events")
    n, v = F.col("event_id"), F.col("value")
    whole = F.floor(v * 10_000).cast("bigint")

    body = F.concat(
        F.lit('{"revenue": '), F.when(n % 5 == 0, F.lit("null")).when(n % 5 == 1, F.concat(F.lit('"'), whole.cast("string"), F.lit(' approx"'))).when(n % 5 == 2, F.lit('"1,200"')).otherwise(whole.cast("string")),
        F.lit(', "revenue_raw": '), F.when(n % 4 == 0, F.lit('"null"')).otherwise(F.concat(F.lit('" about $'), whole.cast("string"), F.lit(' "'))),
        F.lit(', "ebitda": '), F.when(n % 6 == 0, F.lit("0")).when(n % 6 == 1, F.lit('"-3.9"')).otherwise((F.floor(v * 1000).cast("bigint") + 1).cast("string")),
        F.lit(', "asking_multiple": '), F.when(n % 3 == 0, F.lit("null")).when(n % 3 == 1, F.lit("10.5")).otherwise(F.lit('"9.8x"')),
        F.lit(', "lease_years": '), F.when(n % 7 == 0, F.lit('"5 years"')).otherwise(F.lit("3")),
        F.lit(', "reason_for_sale": '), F.when(n % 8 == 0, F.lit('"  "')).otherwise(F.lit('" retirement "')),
        F.lit(', "customer_type": '), F.when(n % 4 == 1, F.lit('"b2b"')).when(n % 4 == 2, F.lit('"mixed"')).otherwise(F.lit('"B2B"')),
        F.lit(', "claimed_recurring": '), F.when(n % 3 == 0, F.lit("true")).when(n % 3 == 1, F.lit('"true"')).otherwise(F.lit("false")),
        F.when(n % 9 == 0, F.lit("")).otherwise(F.lit(', "sector_classification": "pest_control"')),
        F.lit(', "props": '), F.col("props"), F.lit("}"),
    )
    reply = (
        F.when(n % 11 == 0, F.lit("I could not read this."))
        .when(n % 11 == 1, F.concat(body, F.lit(" }")))
        .when(n % 11 == 2, F.concat(F.lit("Sure, here it is:\n"), body, F.lit("\nAnything else?")))
        .otherwise(body)
    )
    price = F.when(n % 10 != 0, F.floor(v * 10_000).cast("bigint"))
    return e.select(n.alias("n"), price.alias("asking_price"), reply.alias("response"))


_SQL["v_responses"] = ((), """
  SELECT n, CASE WHEN n % 10 <> 0 THEN w END AS asking_price,
    CASE n % 11 WHEN 0 THEN 'I could not read this.' WHEN 1 THEN body || ' }'
      WHEN 2 THEN 'Sure, here it is:' || chr(10) || body || chr(10) || 'Anything else?' ELSE body END AS response
  FROM (SELECT *, '{"revenue": ' || CASE n % 5 WHEN 0 THEN 'null' WHEN 1 THEN '"' || w || ' approx"' WHEN 2 THEN '"1,200"' ELSE CAST(w AS VARCHAR) END
      || ', "revenue_raw": ' || CASE WHEN n % 4 = 0 THEN '"null"' ELSE '" about $' || w || ' "' END
      || ', "ebitda": ' || CASE n % 6 WHEN 0 THEN '0' WHEN 1 THEN '"-3.9"' ELSE CAST(e + 1 AS VARCHAR) END
      || ', "asking_multiple": ' || CASE n % 3 WHEN 0 THEN 'null' WHEN 1 THEN '10.5' ELSE '"9.8x"' END
      || ', "lease_years": ' || CASE WHEN n % 7 = 0 THEN '"5 years"' ELSE '3' END
      || ', "reason_for_sale": ' || CASE WHEN n % 8 = 0 THEN '"  "' ELSE '" retirement "' END
      || ', "customer_type": ' || CASE n % 4 WHEN 1 THEN '"b2b"' WHEN 2 THEN '"mixed"' ELSE '"B2B"' END
      || ', "claimed_recurring": ' || CASE n % 3 WHEN 0 THEN 'true' WHEN 1 THEN '"true"' ELSE 'false' END
      || CASE WHEN n % 9 = 0 THEN '' ELSE ', "sector_classification": "pest_control"' END
      || ', "props": ' || props || '}' AS body
    FROM (SELECT event_id AS n, CAST(floor(value * 10000) AS BIGINT) AS w, CAST(floor(value * 1000) AS BIGINT) AS e, props FROM events))""")


CARDS_PER_PAGE = 6


def card_pages(spark: SparkSession, folder: str, pages: DataFrame | None = None) -> DataFrame:
    """Pages, the given table's or a stream's, with result cards added behind their whole markup."""
    p = table(spark, folder, "pages") if pages is None else pages
    n = F.col("page_id")

    def card(i: Column) -> Column:
        number = (n * 5 + i).cast("string")
        link = F.when(i == 3, F.lit("<span>no link</span>")).otherwise(
            F.concat(F.lit('<a href="/businesses-details/shop-'), (n % 7).cast("string"), F.lit("-"), number, F.lit('.php"'),
                     F.when(i % 2 == 0, F.concat(F.lit(' aria-label="Shop  '), number, F.lit(' for sale"'))).otherwise(F.lit("")), F.lit(">more</a>"))
        )
        price = F.when(i % 3 == 1, F.concat(F.lit("<b>Asking Price: $"), F.format_number(n * 1000 + i, 0), F.lit("</b>"))).otherwise(F.lit(""))
        # Some cards hold a long inline image before their link and price.
        image = F.when(i % 4 < 2, F.concat(F.lit('<img src="data:image/png;base64,'), F.repeat(F.lit("iVBOR"), 400), F.lit('">'))).otherwise(F.lit(""))
        return F.concat(F.lit('<article data-listing-id="'), number, F.lit('">'), image, link, price, F.lit("</article>"), F.repeat(F.lit(" "), 600))

    cards = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(CARDS_PER_PAGE)), card), "")
    return p.select("page_id", F.concat("html", cards).alias("html"))


_SQL["v_cards"] = ((), f"""
  SELECT page_id, i, number, CASE WHEN i <> 3 THEN '/businesses-details/shop-' || (page_id % 7) || '-' || number || '.php' END AS path,
    CASE WHEN i % 2 = 0 AND i <> 3 THEN 'Shop ' || number || ' for sale' END AS label,
    CASE WHEN i % 3 = 1 THEN page_id * 1000 + i END AS price
  FROM (SELECT page_id, i, page_id * 5 + i AS number FROM pages, range(1, {CARDS_PER_PAGE + 1}) t(i))""")


def ld_pages(spark: SparkSession, folder: str, pages: DataFrame | None = None) -> DataFrame:
    """Pages with JSON-LD blocks built from their own links: a good list, another type, a broken one."""
    p = table(spark, folder, "pages") if pages is None else pages
    links = F.regexp_extract_all("html", F.lit('<li><a href="/([^"]*)"'), F.lit(1))
    plain = F.transform(links, lambda x: F.regexp_replace(x, "[^A-Za-z]+", ""))
    n = F.col("page_id")

    def item(x: Column, i: Column) -> Column:
        place = F.element_at(F.array(*(F.lit(s) for s in ("-vic-", "-nsw-", "-", "-nt-"))), ((n + i) % 4 + 1).cast("int"))
        url = F.when(i % 5 == 4, F.concat(F.lit("https://bsale.com.au/about/"), x)).when(
            i % 5 == 3, F.concat(F.lit("https://bsale.com.au/listing/"), x)
        ).otherwise(F.concat(F.lit("https://bsale.com.au/listing/"), x, F.lit("'s-shop"), place, (n * 10 + i).cast("string"), F.when(i % 2 == 1, "/").otherwise("")))
        return F.concat(F.lit('{"@type":"ListItem","position":'), (i + 1).cast("string"), F.lit(',"url":"'), url, F.lit('"}'))

    items = F.array_join(F.transform(plain, item), ",")
    script = '<script type="application/ld+json">'
    blocks = F.concat(
        F.lit(script + '{"@type":"Organization","name":"x"}</script>' + script + '{"@type":"ItemList", broken</script>' + script + '{"@context":"https://schema.org","@type":"ItemList","itemListElement":['),
        items, F.lit("]}</script>"),
    )
    return p.select("page_id", pick(C.FEED_STATES, n).alias("state"), F.concat("html", blocks).alias("html"))


_SQL["v_items"] = ((), f"""
  SELECT page_id, state, i AS pos, CASE WHEN i % 5 = 4 THEN 'https://bsale.com.au/about/' || x WHEN i % 5 = 3 THEN 'https://bsale.com.au/listing/' || x
      ELSE 'https://bsale.com.au/listing/' || x || '''s-shop' || (['-vic-', '-nsw-', '-', '-nt-'])[(page_id + i) % 4 + 1] || (page_id * 10 + i) || CASE WHEN i % 2 = 1 THEN '/' ELSE '' END END AS url, x
  FROM (SELECT page_id, {sql_pick(C.FEED_STATES, 'page_id')} AS state, unnest(generate_series(0, len(links) - 1)) AS i,
      regexp_replace(unnest(links), '[^A-Za-z]+', '', 'g') AS x
    FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="/([^"]*)"', 1) AS links FROM pages) WHERE len(links) > 0)""")


def detail_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with labelled listing facts put in front of their whole markup."""
    p = table(spark, folder, "pages")
    n = F.col("page_id")
    state = pick(C.STATE_NAMES, n)
    head = F.concat(
        F.lit("<h1>Shop &amp; caf&#233; "), n.cast("string"), F.lit("</h1><p>Asking Price: $"), F.format_number(n * 2500 + 90000, 0),
        F.lit("</p><div>Sales revenue : $"), F.format_number(n * 10_000, 0), F.lit(" p.a.</div>"),
        F.lit("<div>Net profit: Undisclosed</div><dl><dt>Turnover:</dt><dd>"),
        F.when(n % 3 == 0, F.lit("Not disclosed")).otherwise(F.concat(F.lit("$"), F.format_number(n * 7000, 0))),
        F.lit("</dd><dt>Net Profit:</dt><dd>"), F.when(n % 4 == 0, F.lit("Not disclosed")).otherwise(F.lit("$1,000 weekly")),
        F.lit("</dd></dl><p>Business Category <b>Pest Control</b></p><p>Location: North Town, "), state, F.lit(" "), (n % 9000 + 1000).cast("string"),
        F.lit("</p>"),
        F.when(n % 5 == 0, F.lit("<p>Private Seller</p>")).when(n % 5 == 1, F.lit("<p>Broker: Jane Citizen Phone 123</p>")).otherwise(F.lit("<p>Listed by Sam Smith</p>")),
        F.when(n % 6 == 0, F.lit("<p>UNDER CONTRACT</p>")).otherwise(F.lit("")),
    )
    return p.select("page_id", F.concat(F.lit("p:"), n.cast("string")).alias("id"), "url", F.concat(head, F.col("html")).alias("html"))


_SQL["v_details"] = ((), f"""
  SELECT page_id, 'p:' || page_id AS id, url, '<h1>Shop &amp; caf&#233; ' || page_id || '</h1><p>Asking Price: $' || format('{{:,}}', page_id * 2500 + 90000)
    || '</p><div>Sales revenue : $' || format('{{:,}}', page_id * 10000) || ' p.a.</div>'
    || '<div>Net profit: Undisclosed</div><dl><dt>Turnover:</dt><dd>' || CASE WHEN page_id % 3 = 0 THEN 'Not disclosed' ELSE '$' || format('{{:,}}', page_id * 7000) END
    || '</dd><dt>Net Profit:</dt><dd>' || CASE WHEN page_id % 4 = 0 THEN 'Not disclosed' ELSE '$1,000 weekly' END
    || '</dd></dl><p>Business Category <b>Pest Control</b></p><p>Location: North Town, ' || {sql_pick(C.STATE_NAMES, 'page_id')} || ' ' || (page_id % 9000 + 1000) || '</p>'
    || CASE page_id % 5 WHEN 0 THEN '<p>Private Seller</p>' WHEN 1 THEN '<p>Broker: Jane Citizen Phone 123</p>' ELSE '<p>Listed by Sam Smith</p>' END
    || CASE WHEN page_id % 6 = 0 THEN '<p>UNDER CONTRACT</p>' ELSE '' END || html AS html
  FROM pages""")


PAGE_ROWS = 10


def feed_stubs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as search results: per feed in time order, ten to a page."""
    e = table(spark, folder, "events")
    # Event numbers grow with time, so page and place follow from the number itself.
    n = F.col("event_id")
    return e.select(
        F.col("event_type").alias("source"),
        F.col("user_id").cast("string").alias("source_listing_id"),
        (tens(n, PAGE_ROWS) + 1).cast("int").alias("page_no"),
        (n % PAGE_ROWS).cast("int").alias("pos"),
        F.floor(F.col("value") * 100).cast("bigint").alias("asking_price"),
    )


_SQL["v_stubs"] = ((), f"""
  SELECT event_type AS source, CAST(user_id AS VARCHAR) AS source_listing_id, CAST(event_id // {PAGE_ROWS} + 1 AS INTEGER) AS page_no,
    CAST(event_id % {PAGE_ROWS} AS INTEGER) AS pos, CAST(floor(value * 100) AS BIGINT) AS asking_price FROM events""")


def feed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages those results came from; every feed asked for every page up to its limit."""
    e = table(spark, folder, "events")
    n = F.col("event_id")
    page = (tens(n, PAGE_ROWS) + 1).cast("int")
    return e.groupBy(F.col("event_type").alias("source"), page.alias("page_no")).agg(
        F.max("value").alias("v")
    ).select(
        "source", "page_no",
        F.when(F.col("v") < 0.5, 500).when(F.col("v") < 1.0, 404).otherwise(200).alias("http_status"),
        (F.lit(40) + F.length("source") * 10).alias("limit_page"),
    ).withColumn("ok", F.col("http_status") == 200)


_SQL["v_fpages"] = ((), f"""
  SELECT source, page_no, http_status, limit_page, http_status = 200 AS ok FROM (
    SELECT event_type AS source, CAST(event_id // {PAGE_ROWS} + 1 AS INTEGER) AS page_no,
      CASE WHEN max(value) < 0.5 THEN 500 WHEN max(value) < 1.0 THEN 404 ELSE 200 END AS http_status,
      CAST(40 + length(event_type) * 10 AS INTEGER) AS limit_page
    FROM events GROUP BY event_type, event_id // {PAGE_ROWS})""")


def ad_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as advertisement texts: the whole text and a sentence of stated facts."""
    d = table(spark, folder, "documents")
    n = F.col("doc_id")
    stated = F.concat(
        F.lit(" Annual turnover of $"), F.format_number(n * 1500 + 400_000, 0), F.lit(". "),
        F.when(n % 3 == 0, F.concat(F.lit("EBITDA: $"), (n % 900 + 100).cast("string"), F.lit("k. "))).when(n % 3 == 1, F.lit("Net profit is $1.25m. ")).otherwise(F.lit("")),
        F.when(n % 4 == 0, F.lit("5 year lease, 12 full-time staff. ")).when(n % 4 == 2, F.lit("125 year lease, 12,500 employees. ")).otherwise(F.lit("")),
        F.when(n % 5 == 0, F.lit("Reason for sale: owner retirement. ")).otherwise(F.lit("")),
        F.when(n % 6 == 0, F.lit("Long service agreements in place. ")).otherwise(F.lit("")),
        pick(tuple(w[1][0] for w in C.SECTOR_WORDS), n), F.lit(" "), pick(PHRASES, n),
    )
    return d.select(
        F.concat(F.lit("d:"), n.cast("string")).alias("id"),
        F.concat("text", stated).alias("text"),
        F.when(n % 7 != 0, n * 3000 + 100_000).alias("asking_price"),
        "source",
    )


_SQL["v_ads"] = ((), f"""
  SELECT 'd:' || doc_id AS id, text || ' Annual turnover of $' || format('{{:,}}', doc_id * 1500 + 400000) || '. '
    || CASE doc_id % 3 WHEN 0 THEN 'EBITDA: $' || (doc_id % 900 + 100) || 'k. ' WHEN 1 THEN 'Net profit is $1.25m. ' ELSE '' END
    || CASE doc_id % 4 WHEN 0 THEN '5 year lease, 12 full-time staff. ' WHEN 2 THEN '125 year lease, 12,500 employees. ' ELSE '' END
    || CASE WHEN doc_id % 5 = 0 THEN 'Reason for sale: owner retirement. ' ELSE '' END
    || CASE WHEN doc_id % 6 = 0 THEN 'Long service agreements in place. ' ELSE '' END
    || {sql_pick(tuple(w[1][0] for w in C.SECTOR_WORDS), 'doc_id')} || ' ' || {sql_pick(PHRASES, 'doc_id')} AS text,
    CASE WHEN doc_id % 7 <> 0 THEN doc_id * 3000 + 100000 END AS asking_price, source
  FROM documents""")


def inspections(spark: SparkSession, folder: str) -> DataFrame:
    """Events as look-up requests: by id, by URL known or new, unsupported, or empty."""
    e = table(spark, folder, "events")
    n = F.col("event_id")
    num = n.cast("string")
    ids = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.concat_ws(":", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("id")
    )
    way = n % 8
    url = (
        F.when(way.isin(2, 3), F.concat(F.lit("https://bsale.com.au/listing/business-"), num))
        .when(way == 4, F.concat(F.lit("https://www.business2sell.com.au/businesses-details/new-"), num, F.lit(".php")))
        .when(way == 5, F.lit("https://bsale.com.au/listing/without-number"))
        .when(way == 6, F.concat(F.lit("https://example.org/x-"), num))
    )
    return e.join(ids, "event_id", "left").select(
        n.alias("request_id"),
        F.when(way == 0, F.col("id")).when(way == 1, F.concat(F.lit("none:"), num)).alias("listing_id"),
        url.alias("url"),
        F.col("ts").cast("timestamp").alias("requested_at"),
    )


_SQL["v_inspect"] = ((), """
  SELECT event_id AS request_id, CASE event_id % 8 WHEN 0 THEN o_orderpriority || ':' || o_orderkey WHEN 1 THEN 'none:' || event_id END AS listing_id,
    CASE event_id % 8 WHEN 2 THEN 'https://bsale.com.au/listing/business-' || event_id WHEN 3 THEN 'https://bsale.com.au/listing/business-' || event_id
      WHEN 4 THEN 'https://www.business2sell.com.au/businesses-details/new-' || event_id || '.php'
      WHEN 5 THEN 'https://bsale.com.au/listing/without-number' WHEN 6 THEN 'https://example.org/x-' || event_id END AS url,
    ts AS requested_at
  FROM events LEFT JOIN orders ON o_orderkey = event_id""")


def with_views(body: str, *names: str) -> str:
    """SQL with the named views, and those they build on, in front of it."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in _SQL[name][0]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    views = ",\n".join(f"{name} AS ({_SQL[name][1]})" for name in ordered)
    text = body.strip()
    return f"WITH {views},\n{text[5:]}" if text.upper().startswith("WITH ") else f"WITH {views}\n{text}"


def sql_any(column: str, words) -> str:
    """Case-blind any-of-these-words test; null text holds none."""
    tests = " OR ".join(f"contains(lower({column}), '{w.lower()}')" for w in words)
    return f"coalesce({tests}, false)"


