"""One round over landed data: discover, upsert, extract, classify, write back, report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listwright import config as C
from listwright.config import RuleConfig
from listwright.functions import text as X
from listwright.operators import changes, detail, digest, discovery, facts, feeds, rules, state
from listwright.schemas import ACTIVITY, LISTINGS, OUTBOX, SOURCES, STUBS, conform
from listwright.session import settle
from listwright.sources import adapters, snapshots
from listwright.sources.feeds import read_feeds
from listwright.sources.keyed import KeyedTable


def extract_and_classify(
    claimed: DataFrame, pages: DataFrame, details: DataFrame, cfg: RuleConfig = RuleConfig(),
    replies: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Result rows for the claimed listings that have a fetched page.

    ``pages(id, html)`` are detail pages and ``details`` their fields. Facts are read by
    native patterns unless ``replies`` turns prompts into extractor responses.
    """
    merged = detail.overlay(claimed, details)
    work = merged.join(pages.select("id", "html"), "id").select(
        "id", *detail.OVERLAID,
        X.content_hash(F.col("html")).alias("content_hash"),
        X.ad_lines(F.col("html")).alias("text"),
    )
    if replies is None:
        known = facts.text_facts(work).withColumn("parse_failed", F.lit(False)).drop("text")
    else:
        asked = work.withColumn(
            "prompt", facts.render_prompt(F.col("title"), F.col("asking_price"), F.col("text"))
        ).drop("text")
        known = facts.parse_responses(replies(asked)).drop("response")
    said = details.select("id", F.col("revenue_raw").alias("d_revenue"), F.col("advertised_status").alias("d_status"))
    flat = known.select("*", "facts.*").drop("facts").join(said, "id", "left")
    flat = flat.withColumns(
        {
            "revenue_raw": F.coalesce("revenue_raw", "d_revenue"),
            "advertised_status": F.coalesce("advertised_status", "d_status"),
            "sector": F.col("sector_classification"),
            "description": F.col("description_summary"),
        }
    ).drop("d_revenue", "d_status")
    return flat.transform(rules.apply_rules(cfg))


def apply_results(listings: DataFrame, claimed: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Write good results back; claimed rows without one, or with an unreadable reply, retry."""
    good = results.filter(~F.col("parse_failed"))
    bad = claimed.select("id").join(good.select("id"), "id", "left_anti")
    return state.mark_failed(state.mark_extracted(listings, good, now), bad, now)


@dataclass(frozen=True)
class Round:
    """What a round leaves behind; the snapshots are the next round's input."""

    listings: DataFrame
    sources: DataFrame
    activity: DataFrame
    outbox: DataFrame


def discover_round(
    pages: DataFrame, due: DataFrame, config: DataFrame, readers: Sequence[adapters.Adapter] = adapters.ADAPTERS
) -> tuple[DataFrame, DataFrame]:
    """Stubs of the due feeds as a crawl would have kept them, and each feed's coverage.

    ``pages`` are landed search pages, read by the adapter that the configuration names for
    their feed; a feed that pages by state is folded state by state.
    """
    by_states = F.col("adapter").isin(*(kind for reader in readers if reader.by_state for kind in reader.kinds))
    # A resumed feed goes on for its number of pages from where it stopped; states start anew.
    live = config.filter("enabled").join(due.select("name", "pagination_checkpoint"), "name")
    resumed = F.coalesce(X.leading_int(F.when(~by_states, F.col("pagination_checkpoint")), "int"), F.lit(1))
    limits = live.select(F.col("name").alias("source"), "adapter", (resumed + F.col("max_pages") - 1).alias("limit_page"))
    landed = pages.join(limits, "source").withColumn("ok", F.col("http_status") == 200)
    listed = landed.select("source", "state", "page_no", "http_status", "limit_page", "ok", "adapter")
    kept_all, cover_all = None, None
    for reader in readers:
        here, by_state = adapters.read_by(reader), reader.by_state
        found, mine = reader.discover(landed.filter(here)), listed.filter(here)
        walk = discovery.discovered_by_state if by_state else discovery.discovered
        kept = settle(walk(found, mine))
        # A walk ends at the first page asked for that failed or brought nothing.
        part = F.concat("source", F.lit("|"), F.coalesce("state", F.lit("")))
        brought = kept.groupBy(part.alias("source"), "page_no").agg(F.count("*").alias("n_new"))
        asked = mine.withColumn("source", part)
        ends = ~F.col("ok") | F.col("n_new").isNull()
        cuts = asked.join(brought, ["source", "page_no"], "left").groupBy("source").agg(
            F.min(F.when(ends, F.col("page_no"))).alias("cut"))
        cover = (
            discovery.coverage(asked, cuts, missing_page_ends=by_state)
            .groupBy(F.regexp_replace("source", r"\|[^|]*$", "").alias("source"))
            .agg(
                F.min("coverage_complete").alias("coverage_complete"),
                F.max("success").alias("success"),
                (F.lit(None).cast("string") if by_state else F.max("next_checkpoint")).alias("next_checkpoint"),
            )
        )
        stubs = adapters.as_stubs(kept)
        kept_all = stubs if kept_all is None else kept_all.unionByName(stubs)
        cover_all = cover if cover_all is None else cover_all.unionByName(cover)
    return kept_all, cover_all


def run_round(
    listings: DataFrame, sources: DataFrame, activity: DataFrame, config: DataFrame,
    search_pages: DataFrame, detail_pages: DataFrame, now: Column, date_label: str,
    cfg: RuleConfig = RuleConfig(), batch: int = C.CLAIM_BATCH, replies=None,
    readers: Sequence[adapters.Adapter] = adapters.ADAPTERS,
) -> Round:
    """A whole scheduled round.

    ``detail_pages(id, source, http_status, html)`` hold what was fetched for listings; a
    claimed listing without a page goes to retry. A finished listing whose recheck is due is
    read again where its page came back different; an unchanged page moves its fetch time
    only, and a missing one leaves it as it is. What moved on a listing goes to the activity
    log and, if a digest has carried the listing, to the outbox as a reply. Each stage is
    written out before the next reads it, so no stage is computed twice.
    """
    seeded = feeds.seed_sources(sources, config)
    due = settle(feeds.due_sources(seeded, now))
    found, cover = discover_round(search_pages, due, config, readers)
    stubs, cover = settle(found), settle(cover)
    counts = discovery.run_counts(stubs, listings)
    stats = settle(feeds.run_stats(due, config, counts, cover))
    runs = stats.join(cover.withColumnRenamed("source", "name").select("name", "next_checkpoint"), "name", "left").select(
        F.col("name").alias("source"), now.alias("ts"), F.lit(0).cast("bigint").alias("seq"), F.col("healthy").alias("ok"),
        F.col("checked").alias("discovered"), F.col("next_checkpoint").alias("checkpoint"), "coverage_complete",
    )
    # A feed switched off in the configuration has not run.
    ran = runs.join(stats.filter(~F.col("error_status").eqNullSafe("disabled")).select(F.col("name").alias("source")), "source", "left_semi")
    status = settle(feeds.apply_runs(seeded, ran))
    alerts = feeds.alerts(
        status.filter(F.col("last_attempt") == now).select(
            F.col("name").alias("source"), F.col("consecutive_failures").alias("streak"))
    )

    stored = settle(state.upsert_stubs(listings, conform(stubs, STUBS)))
    claimed = settle(state.select_claims(stored, now, batch))
    arrived = detail_pages.filter(F.col("http_status") == 200)
    again = changes.recheck_due(stored, now)
    seen = arrived.join(again.select("id"), "id", "left_semi")
    looked = settle(seen.select("id", X.content_hash(F.col("html")).alias("content_hash")))
    differs = state.changed_pages(again, looked).select("id")
    work = settle(claimed.unionByName(again.join(differs, "id", "left_semi")))
    fetched = arrived.join(work.select("id"), "id", "left_semi")
    details = adapters.union_details(fetched, readers, config)
    results = settle(extract_and_classify(work, fetched, details, cfg, replies))
    kept = state.refresh_unchanged(stored, looked, now)
    current = settle(apply_results(kept, work, results, now))
    moved = changes.material_changes(listings.filter(F.col("processing_state") == "done"), current)
    events = conform(changes.change_events(moved, X.iso_instant(now)).withColumn("created_at", now), ACTIVITY)
    events = settle(state.unlogged(activity, events))

    queue = digest.pending(current, activity)
    entries = settle(digest.top_entries(queue))
    health = settle(feeds.merge_health(config, stats, status))
    why = digest.why_empty(current, health)
    text = digest.digest_text(entries, digest.backlog_size(queue), health, date_label, why=why)
    pending = state.record_pending(activity, entries, now).unionByName(events)
    report_key = F.concat_ws(":", F.lit("report"), X.local_date(now))
    alert_key = F.concat_ws(":", F.lit("alert"), "source", X.local_date(now))
    outbox = digest.outbox(text, "digest", report_key, F.col("text")).unionByName(
        digest.outbox(alerts, "alert", alert_key, F.col("text"))
    )
    told = events.join(digest.confirmed_ids(activity).withColumnRenamed("id", "listing_id"), "listing_id", "left_semi")
    reply = F.concat(F.col("listing_id"), F.lit(" · "), F.col("value"), F.lit(": "), F.col("reason"))
    outbox = outbox.unionByName(digest.outbox(told, "change", F.col("event_key"), reply))
    # The text is in the outbox before any entry counts as delivered.
    outbox = settle(outbox)
    sent = entries.select(state.delivery_key(F.col("id"), now).alias("event_key"), report_key.alias("message_ref"))
    return Round(current, status, settle(state.confirm_delivery(pending, sent)), outbox)


TABLES = {"listings": LISTINGS, "sources": SOURCES, "outbox": OUTBOX}


def stored_round(
    spark: SparkSession, root: str, feeds_path: str, search_pages: DataFrame, detail_pages: DataFrame, now: Column,
    date_label: str, **settings,
) -> int:
    """Run a round over the tables stored under ``root``; returns the version it has written.

    Feeds come from a JSON document. The round reads the newest complete version and writes its
    listings, sources and outbox as the next, and to the activity log the rows it adds. A mark
    written last makes them count, so they appear together, and a round that broke off is
    written again under the same number. Older versions but one are removed.
    """
    done = snapshots.versions(spark, f"{root}/rounds")
    last, version = (done[-1] if done else -1), (done[-1] if done else -1) + 1
    held = {t: snapshots.read_range(spark, f"{root}/{t}", kind, last - 1, last) for t, kind in TABLES.items()}
    events = activity_table(root)
    log = events.rows(spark, before=last + 1)
    after = run_round(
        held["listings"], held["sources"], log, read_feeds(spark, feeds_path), search_pages, detail_pages, now, date_label, **settings)
    for t, rows in (("listings", after.listings), ("sources", after.sources), ("outbox", after.outbox)):
        snapshots.write_version(conform(rows, TABLES[t]), f"{root}/{t}", version)
    # What the round has added or moved on.
    known = log.select("event_key", "delivery_state")
    fresh = after.activity.join(known, (after.activity["event_key"] == known["event_key"]) & after.activity["delivery_state"].eqNullSafe(known["delivery_state"]), "left_anti")
    events.append(conform(fresh, ACTIVITY), version)
    snapshots.write_version(spark.range(1), f"{root}/rounds", version)
    for t in (*TABLES, "rounds"):
        snapshots.purge(spark, f"{root}/{t}")
    return version


def activity_table(root: str) -> KeyedTable:
    """The activity log by listing, one row per event key, in a bounded number of folders."""
    return KeyedTable(f"{root}/activity", ACTIVITY, ("listing_id",), last_events)


def last_events(rows: DataFrame) -> DataFrame:
    """One row per event key of the log; a confirmed delivery outranks a pending one."""
    rank = F.when(F.col("delivery_state") == "confirmed", 1).otherwise(0)
    rest = [c for c in ACTIVITY.names if c != "event_key"]
    last = rows.groupBy("event_key").agg(F.max_by(F.struct(*rest), rank).alias("last"))
    return last.select("event_key", "last.*").select(*ACTIVITY.names)


def stored_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Listings, sources, outbox and activity as the last complete round left them."""
    done = snapshots.versions(spark, f"{root}/rounds")
    last = done[-1] if done else -1
    out = {t: snapshots.read_range(spark, f"{root}/{t}", kind, last - 1, last) for t, kind in TABLES.items()}
    return out | {"activity": activity_table(root).rows(spark, before=last + 1)}
