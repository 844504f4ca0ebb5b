"""Batches of look-up and review requests from their arrival to their answers and effects."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from listwright import config as C
from listwright.config import RuleConfig
from listwright.functions import text as X
from listwright.functions.joins import joined
from listwright.operators import cycle, digest, requests, state
from listwright.schemas import LISTINGS, conform
from listwright.session import written
from listwright.sources import adapters


@dataclass(frozen=True)
class Inspected:
    """Answers as of the request, the listings after the work the requests caused, and cards to send."""

    answers: DataFrame
    listings: DataFrame
    outbox: DataFrame


def inspection_message(status: Column, listing_id: Column, url: Column) -> Column:
    """What a requester is told; a found listing answers with its card instead."""
    named = F.coalesce(listing_id, F.lit("")) != ""
    asked = F.coalesce(url, F.lit("")) != ""
    faulty = (
        F.when(~named & ~asked, C.ANSWERS["nothing_asked"])
        .when(~F.coalesce(url.rlike(r"(?i)^[a-z]+://[^/:?#]"), F.lit(False)), C.ANSWERS["bad_url"])
        .otherwise(C.ANSWERS["unsupported"])
    )
    return (
        F.when(status == "processing", C.ANSWERS["processing"])
        .when(status.isin("queued", "created"), C.ANSWERS["queued"])
        .when(status == "not_found", C.ANSWERS["not_found"])
        .when(status == "invalid", faulty)
    )


def inspect_batch(
    asked: DataFrame, listings: DataFrame, pages: DataFrame, now: Column, cfg: RuleConfig = RuleConfig(),
    replies: Callable[[DataFrame], DataFrame] | None = None,
    readers: Sequence[adapters.Adapter] = adapters.ADAPTERS, config: DataFrame | None = None,
) -> Inspected:
    """Answer look-up requests and do the work they ask for.

    ``asked(request_id, listing_id, url, requested_at)``. A finished listing is answered with its
    card. An unknown URL on a supported market becomes a listing; that and listings that wait
    are read from ``pages(id, source, http_status, html)``, classified and written back, or
    scheduled for another try where no page arrived. Each listing is worked on once however
    many requests name it. Cards of listings finished by this batch go to the outbox under a
    key of listing and content, so a replay sends nothing new.
    """
    stored = written(conform(listings, LISTINGS), "inspect-listings")
    routed = written(requests.route_inspections(asked, stored), "inspections")
    new = routed.filter("status = 'created'").select("url", "requested_at", F.col("request_id").cast("long").alias("seq"))
    stubs = written(state.unknown_url_stubs(new), "inspect-stubs")
    waiting, found = (routed.filter(F.col("status").isin(*s)).select(F.col("answer_id").alias("id")).distinct()
                      for s in (("queued", "created"), ("found",)))
    # Rows that the batch may change or show are parted from the others once; nothing moves those again.
    seen = stored.join(stubs.select(*state.KEY).distinct(), list(state.KEY), "left_semi").select("id")
    named = waiting.unionByName(seen).withColumn("moving", F.lit(True)).unionByName(found.withColumn("moving", F.lit(False)))
    named = written(named.filter("id IS NOT NULL").groupBy("id").agg(F.max("moving").alias("moving")), "inspect-named")
    others = stored.filter("id IS NOT NULL").join(named, "id", "left_anti")
    mine = written(stored.join(named, "id").unionByName(stored.filter("id IS NULL").withColumn("moving", F.lit(True))), "inspect-mine")
    shown = mine.filter("NOT moving").drop("moving")
    moving = written(state.upsert_stubs(mine.filter("moving").drop("moving"), stubs), "inspected")
    work = written(moving.join(waiting, "id", "left_semi"), "inspect-work")
    fetched = written(pages.filter(F.col("http_status") == 200).join(work.select("id"), "id", "left_semi"), "inspect-pages")
    details = adapters.union_details(fetched, readers, config)
    results = written(cycle.extract_and_classify(work, fetched, details, cfg, replies), "inspect-results")
    changed = written(cycle.apply_results(moving, work, results, now), "inspect-changed")

    carded = shown.unionByName(moving.join(found, "id", "left_semi"))
    cards = carded.select(F.col("id").alias("_id"), digest.inspection_text().alias("card"))
    keyed = routed.withColumn("_id", F.when(F.col("status") == "found", F.col("answer_id")))
    answers = joined(keyed, cards, "_id").select(
        "request_id", "status", "answer_id", "last_checked",
        inspection_message(F.col("status"), F.col("listing_id"), F.col("url")).alias("message"), "card")
    done = changed.join(results.filter("not parse_failed").select("id"), "id", "left_semi")
    key = F.concat_ws(":", F.lit("inspection"), "id", "content_hash")
    return Inspected(answers, others.unionByName(shown).unionByName(changed), digest.outbox(done, "inspection", key, digest.inspection_text()))


@dataclass(frozen=True)
class Reviewed:
    """Answers to review requests, and the tables they leave."""

    answers: DataFrame
    listings: DataFrame
    activity: DataFrame


def review_batch(reviews: DataFrame, listings: DataFrame, activity: DataFrame) -> Reviewed:
    """Answer review requests, append the accepted ones to the log and set the listings' review state.

    ``reviews(seq, listing_id, action, actor, reason, decided_at)``. The next digest of the tables
    returned leaves decided listings out.
    """
    routed = written(requests.route_reviews(reviews, listings), "reviews")
    accepted = routed.filter("verdict = 'accepted'").drop("verdict")
    current, log = state.record_reviews(listings, activity, accepted)
    said = F.concat(F.lit(C.ANSWERS["marked"]), F.col("action"), F.lit(" by "), F.col("actor"))
    message = F.when(F.col("verdict") == "accepted", said)
    for verdict in ("missing_fields", "bad_action", "not_found"):
        message = message.when(F.col("verdict") == verdict, C.ANSWERS[verdict])
    stamp = F.when(F.col("verdict") == "accepted", X.iso_instant(F.col("decided_at")))
    return Reviewed(routed.select("seq", "listing_id", "verdict", message.alias("message"), stamp.alias("timestamp")), current, log)
