"""Batches of look-up and review requests against the listing snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listwright import config as C
from listwright.functions import text as X
from listwright.functions.joins import joined, spread
from listwright.session import written


def by_url(listings: DataFrame) -> DataFrame:
    """One listing per canonical URL (URLs are not unique): the smallest id."""
    return listings.groupBy("canonical_url").agg(
        F.min(F.struct("id", "processing_state", "last_fetched")).alias("hit")
    ).select(F.col("canonical_url").alias("url"), F.col("hit.id").alias("u_id"),
             F.col("hit.processing_state").alias("u_state"), F.col("hit.last_fetched").alias("u_fetched"))


def route_inspections(requests: DataFrame, listings: DataFrame) -> DataFrame:
    """Answer per request: found, processing, queued, created, not_found or invalid.

    A request names an id or, failing that, a URL on a supported market. A URL nobody has
    listed yet is answered with the id its stub will get.
    """
    named = F.nullif(F.col("listing_id"), F.lit(""))
    url = F.nullif(F.col("url"), F.lit(""))
    asked = requests.withColumns({"listing_id": named, "url": url}).withColumns({"_id": F.col("listing_id"), "_url": F.col("url")})
    # Read several times: a request moves once for each key it has, and not at all without one.
    asked = written(asked, "asked")
    ids = listings.select(
        F.col("id").alias("_id"), F.col("id").alias("i_id"),
        F.col("processing_state").alias("i_state"), F.col("last_fetched").alias("i_fetched"),
    )
    # All requests of a batch for one new URL are answered with the stub of the first one.
    firsts = asked.filter(F.col("url").isNotNull()).groupBy("_url").agg(F.min("requested_at").alias("_first_at"))
    # Only the URLs asked for are grouped; a small batch costs the store no shuffle.
    wanted = firsts.select(F.col("_url").alias("canonical_url"))
    urls = by_url(listings.join(wanted, "canonical_url", "left_semi")).withColumnRenamed("url", "_url")
    at_url = firsts.join(urls, "_url", "left")
    found = joined(joined(asked, ids, "_id"), at_url, "_url")
    with_id = F.col("listing_id").isNotNull()
    bad = ~with_id & (F.col("url").isNull() | ~X.is_market_url(F.col("url")))
    state = F.when(with_id, F.col("i_state")).otherwise(F.col("u_state"))
    number = F.coalesce(
        X.url_number(F.col("url"), php=True),
        F.concat(F.lit("manual:"), F.unix_millis("_first_at").cast("string")),
    )
    made = F.concat_ws(":", X.feed_of_url(F.col("url")), number)
    status = (
        F.when(bad, "invalid")
        .when(state == "done", "found")
        .when(state == "processing", "processing")
        .when(state.isNotNull(), "queued")
        .when(F.col("url").isNotNull(), "created")
        .otherwise("not_found")
    )
    hit = F.when(with_id, F.col("i_id")).otherwise(F.col("u_id"))
    checked = F.when(with_id, F.col("i_fetched")).otherwise(F.col("u_fetched"))
    return found.withColumn("status", status).select(
        *requests.columns,
        "status",
        F.when(F.col("status") == "created", made)
        .when(F.col("status").isin("found", "processing", "queued"), hit)
        .alias("answer_id"),
        F.when(F.col("status") == "found", X.iso_instant(checked)).alias("last_checked"),
    )


def route_reviews(reviews: DataFrame, listings: DataFrame) -> DataFrame:
    """Each review request with ``verdict``: accepted, missing_fields, bad_action or not_found."""
    known = listings.select(F.col("id").alias("_id"), F.lit(True).alias("_known"))
    asked = reviews.withColumn("_id", spread(F.col("listing_id"), "actor", "decided_at"))
    lacking = F.lit(False)
    for c in ("listing_id", "action", "actor"):
        lacking = lacking | (F.coalesce(F.col(c), F.lit("")) == "")
    verdict = (
        F.when(lacking, "missing_fields")
        .when(~F.col("action").isin(*C.REVIEW_ACTIONS), "bad_action")
        .when(F.col("_known").isNull(), "not_found")
        .otherwise("accepted")
    )
    return asked.join(known, "_id", "left").withColumn("verdict", verdict).drop("_known", "_id")


def listing_by_id(listings: DataFrame, listing_id: str) -> DataFrame:
    return listings.filter(F.col("id") == listing_id)


def listing_by_url(listings: DataFrame, url: str) -> DataFrame:
    return listings.filter(F.col("canonical_url") == url).orderBy("id").limit(1)
