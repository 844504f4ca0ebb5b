"""State of the feeds: seeding, due polls, run outcomes, failure streaks, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright import config as C
from listwright.functions import text as X
from listwright.functions.ordered import failure_streak
from listwright.schemas import SOURCES, conform
from listwright.session import settle


def seed_sources(sources: DataFrame, feeds: DataFrame) -> DataFrame:
    """Add enabled feeds that have no row yet; existing rows are never overwritten."""
    absent = feeds.filter("enabled").join(sources.select("name"), "name", "left_anti")
    rows = absent.select(
        "name",
        "adapter",
        "base_url",
        F.coalesce("poll_interval_minutes", F.lit(C.POLL_MINUTES)).alias("poll_interval_minutes"),
        F.lit(0).alias("discovered_count"),
        F.lit(0).alias("consecutive_failures"),
        F.lit(False).alias("coverage_complete"),
    )
    return conform(sources, SOURCES).unionByName(conform(rows, SOURCES))


def due_sources(sources: DataFrame, now: Column) -> DataFrame:
    """Feeds never tried, or whose poll interval has passed (to the millisecond, inclusive)."""
    next_try = F.col("last_attempt") + X.minutes(F.col("poll_interval_minutes"))
    return sources.filter(F.col("last_attempt").isNull() | (next_try <= now))


def source_by_name(sources: DataFrame, name: str) -> DataFrame:
    return sources.filter(F.col("name") == name)


def status_view(sources: DataFrame) -> DataFrame:
    return sources.select(
        "name",
        X.iso_instant(F.col("last_attempt")).alias("last_attempt"),
        X.iso_instant(F.col("last_success")).alias("last_success"),
        "consecutive_failures",
        "error_status",
        F.coalesce("coverage_complete", F.lit(False)).alias("coverage_complete"),
        "discovered_count",
    )


def run_streaks(runs: DataFrame, sources: DataFrame | None = None, slices: int | None = None) -> DataFrame:
    """Every run with the failures in a row it ends; ``runs(source, ts, seq, ok)``."""
    if sources is None:
        return failure_streak(runs, "source", "ts", "seq", "ok", slices=slices)
    before = sources.select(F.col("name").alias("source"), F.col("consecutive_failures").alias("_before"))
    known = runs.join(before, "source", "left")
    return failure_streak(known, "source", "ts", "seq", "ok", start="_before", slices=slices).drop("_before")


def alerts(streaks: DataFrame, after: int = C.ALERT_AFTER_FAILURES) -> DataFrame:
    text = F.format_string(
        "Source _%s_ has failed %s consecutive times. Manual check required.",
        F.col("source"), F.col("streak").cast("string"),
    )
    return streaks.filter(F.col("streak") >= after).withColumn("text", text)


def apply_runs(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Fold a log of runs into the feed rows, as if applied one after the other.

    ``runs(source, ts, seq, ok, discovered, checkpoint, coverage_complete)``. The streak is
    counted in two aggregates (last success, then failures after it), both combined before
    the shuffle, so a feed with very many runs is no burden. A failed run leaves the page
    checkpoint as it was.
    """
    at = F.struct("ts", "seq")
    last = settle(runs.groupBy("source").agg(
        F.max(F.struct("ts", "seq", "ok", "discovered", "checkpoint", "coverage_complete")).alias("_last"),
        F.max(F.when(F.col("ok"), at)).alias("_won"),
        F.max(F.when(F.col("ok"), F.struct("ts", "seq", "checkpoint"))).alias("_page"),
    ))
    after = (
        runs.filter(~F.col("ok")).join(last.select("source", "_won"), "source", "left")
        .filter(F.col("_won").isNull() | (at > F.col("_won")))
        .groupBy("source")
        .agg(F.count("*").alias("_tail"))
    )
    news = last.join(after, "source", "left").withColumnRenamed("source", "name")
    hit = F.col("_last").isNotNull()
    ok = F.col("_last.ok")
    before = F.when(F.col("_won").isNull(), F.coalesce("consecutive_failures", F.lit(0))).otherwise(0)

    def upd(new: Column, old: str) -> Column:
        return F.when(hit, new).otherwise(F.col(old))

    return (
        sources.join(news, "name", "left")
        .withColumns(
            {
                "last_attempt": upd(F.col("_last.ts"), "last_attempt"),
                "last_success": F.coalesce(F.col("_won.ts"), F.col("last_success")),
                "pagination_checkpoint": F.when(F.col("_page").isNotNull(), F.col("_page.checkpoint")).otherwise(F.col("pagination_checkpoint")),
                "discovered_count": upd(F.col("_last.discovered"), "discovered_count"),
                "consecutive_failures": upd(before + F.coalesce("_tail", F.lit(0)), "consecutive_failures"),
                "error_status": upd(F.when(~ok, "fetch_failed"), "error_status"),
                "coverage_complete": upd(F.col("_last.coverage_complete"), "coverage_complete"),
            }
        )
        .select(*sources.columns)
    )


def run_stats(due: DataFrame, feeds: DataFrame, counts: DataFrame, cover: DataFrame) -> DataFrame:
    """Health of this run per due source; one without an enabled feed counts as disabled."""
    enabled = feeds.filter("enabled").select("name", F.lit(True).alias("_on"))
    on = F.coalesce("_on", F.lit(False))
    won = on & F.coalesce("success", F.lit(False))
    return (
        due.select("name")
        .join(enabled, "name", "left")
        .join(counts.withColumnRenamed("source", "name"), "name", "left")
        .join(cover.withColumnRenamed("source", "name"), "name", "left")
        .select(
            "name",
            F.when(won, F.coalesce("checked", F.lit(0))).otherwise(0).alias("checked"),
            F.when(won, F.coalesce("new_listings", F.lit(0))).otherwise(0).alias("new_listings"),
            won.alias("healthy"),
            (won & F.coalesce("coverage_complete", F.lit(False))).alias("coverage_complete"),
            F.when(~on, "disabled").when(~won, "discovery_failed").alias("error_status"),
        )
    )


def merge_health(feeds: DataFrame, stats: DataFrame, sources: DataFrame) -> DataFrame:
    """Health per enabled feed: this run's, else the stored state, else unhealthy."""
    run = stats.select("name", F.struct("checked", "new_listings", "healthy", "coverage_complete", "error_status").alias("r"))
    kept = sources.select(
        "name",
        F.struct(
            F.lit(0).cast("bigint").alias("checked"),
            F.lit(0).cast("bigint").alias("new_listings"),
            (F.col("consecutive_failures") == 0).alias("healthy"),
            F.coalesce("coverage_complete", F.lit(False)).alias("coverage_complete"),
            "error_status",
        ).alias("s"),
    )
    joined = feeds.filter("enabled").join(run, "name", "left").join(kept, "name", "left")

    def pick(field: str, default) -> Column:
        return F.when(F.col("r").isNotNull(), F.col(f"r.{field}")).when(
            F.col("s").isNotNull(), F.col(f"s.{field}")
        ).otherwise(F.lit(default))

    return joined.select(
        "name",
        pick("checked", 0).alias("checked"),
        pick("new_listings", 0).alias("new_listings"),
        pick("healthy", False).alias("healthy"),
        pick("coverage_complete", False).alias("coverage_complete"),
        pick("error_status", None).alias("error_status"),
    )


def health_part() -> Column:
    return F.format_string(
        "%s %s (%s checked, %s new%s)",
        F.col("name"),
        F.when(F.col("healthy"), "✓").otherwise("✗"),
        F.col("checked").cast("string"),
        F.col("new_listings").cast("string"),
        F.when(F.col("coverage_complete"), "").otherwise(" ⚠️ partial"),
    )


def health_line(health: DataFrame) -> DataFrame:
    """One line over all feeds; a row per configured feed, which a person keeps by hand."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("name").alias("k"), health_part().alias("part"))))
    parts = F.transform(rows, lambda r: r["part"])
    return health.agg(F.concat(F.lit("Sources: "), F.array_join(parts, " · ")).alias("line"))
