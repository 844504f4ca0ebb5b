"""What moved between snapshots, what to look at again, and likely duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from listwright.functions import text as X

TRACKED = ("asking_price", "advertised_status", "revenue", "ebitda", "revenue_raw", "ebitda_raw")


def material_changes(before: DataFrame, after: DataFrame, tracked=TRACKED) -> DataFrame:
    """One row per tracked field whose value differs between two snapshots of a listing."""
    old = before.select("id", *(F.col(c).cast("string").alias(f"o_{c}") for c in tracked))
    new = after.select("id", *(F.col(c).cast("string").alias(f"n_{c}") for c in tracked))
    moved = F.filter(
        F.array(
            *(
                F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").alias("old_value"), F.col(f"n_{c}").alias("new_value"))
                for c in tracked
            )
        ),
        lambda m: ~m["old_value"].eqNullSafe(m["new_value"]),
    )
    return old.join(new, "id").select("id", F.explode(moved).alias("m")).select("id", "m.*")


def change_history(history: DataFrame, tracked=TRACKED) -> DataFrame:
    """``(id, version, field, old_value, new_value)``: every move of a tracked field between versions.

    ``history(id, version, ...)`` holds one row per listing and version, as snapshots do. A
    listing is compared with its last version before, also where versions in between lack it;
    a value that moves and moves back moves twice. Equal states in a row are dropped in the
    window itself, and only tracked fields are dealt out.
    """
    values = F.struct(*(F.col(c).cast("string").alias(c) for c in tracked))
    by = Window.partitionBy("id").orderBy("version")
    rows = history.select("id", "version", values.alias("now")).withColumn("was", F.lag("now").over(by))
    moved = F.filter(
        F.array(*(
            F.struct(F.lit(c).alias("field"), F.col(f"was.{c}").alias("old_value"), F.col(f"now.{c}").alias("new_value"))
            for c in tracked
        )),
        lambda m: ~m["old_value"].eqNullSafe(m["new_value"]),
    )
    changed = rows.filter(F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("now")))
    return changed.select("id", "version", F.explode(moved).alias("m")).select("id", "version", "m.*")


def change_events(changes: DataFrame, run_key: str | Column) -> DataFrame:
    """Material changes as activity rows with stable keys."""
    key = F.concat_ws(":", F.lit("change"), F.lit(run_key), F.col("id"), F.col("field"))
    return changes.select(
        F.sha2(key, 256).alias("id"),
        F.col("id").alias("listing_id"),
        F.lit("material_change").alias("event_type"),
        F.col("field").alias("value"),
        F.concat_ws(" -> ", F.coalesce("old_value", F.lit("none")), F.coalesce("new_value", F.lit("none"))).alias("reason"),
        key.alias("event_key"),
    )


def recheck_due(listings: DataFrame, now: Column) -> DataFrame:
    """Watched and pursued listings daily, other active ones weekly; passed or sold ones never."""
    hours = F.when(F.col("review_state").isin("watch", "pursue"), 24).otherwise(24 * 7)
    active = (F.col("review_state") != "pass") & (F.col("processing_state") == "done") & ~F.coalesce(
        F.col("advertised_status").isin("sold", "off market"), F.lit(False)
    )
    due = F.col("last_fetched") + F.make_dt_interval(hours=hours) <= now
    return listings.filter(active & due)


def normal_words(value: Column) -> Column:
    return X.squeeze(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def duplicate_groups(listings: DataFrame, broker_ref: str = "broker_ref") -> DataFrame:
    """Groups of listings from different feeds that may be one business; nothing is merged.

    A shared broker reference makes a strong group, where the listings have that column.
    Equal title words in any order, place and price make a weak one, which is only a flag.
    Each listing is labelled with its group instead of being paired with all others, so
    large groups cost no more than their rows.
    """
    known = F.col(broker_ref) if broker_ref in listings.columns else F.lit(None).cast("string")
    ref = F.nullif(normal_words(known), F.lit(""))
    words = F.array_sort(F.split(normal_words(F.col("title")), " "))
    title = F.nullif(F.array_join(words, " "), F.lit(""))
    weak = F.when(
        title.isNotNull() & F.col("location_state").isNotNull() & F.col("asking_price").isNotNull(),
        F.concat_ws("|", title, "location_state", F.col("asking_price").cast("string")),
    )
    keyed = listings.select(
        "id", "source", F.explode(F.array(
            F.struct(F.lit("strong").alias("kind"), ref.alias("match_key")),
            F.struct(F.lit("possible").alias("kind"), weak.alias("match_key")),
        )).alias("k"),
    ).select("id", "source", "k.*").filter(F.col("match_key").isNotNull())
    groups = (
        keyed.groupBy("kind", "match_key")
        .agg(
            F.min("id").alias("group_id"),
            F.count("*").alias("n_listings"),
            (F.min("source") != F.max("source")).alias("_crossed"),
        )
        .filter("_crossed")
        .drop("_crossed")
    )
    return keyed.join(groups, ["kind", "match_key"]).drop("match_key")


def mark_baseline(listings: DataFrame, first_runs: DataFrame) -> DataFrame:
    """Flag rows a feed's first run brought in; they are a baseline, not news.

    ``first_runs(source, first_run)``, one row per feed.
    """
    joined = listings.join(first_runs, "source", "left")
    return joined.withColumn(
        "is_baseline", F.coalesce(F.col("first_seen") <= F.col("first_run"), F.lit(False))
    ).drop("first_run")


def pass_reasons(listings: DataFrame, latest: DataFrame) -> DataFrame:
    """How often which reason was given for passing, by the listing's leading rule."""
    passed = latest.filter(F.col("action") == "pass").select(F.col("listing_id").alias("id"), "reason")
    lead = F.coalesce(F.get("fit_reasons", F.lit(0)), F.lit("none")).alias("fit_reason")
    return (
        listings.select("id", lead)
        .join(passed, "id")
        .groupBy("fit_reason", F.coalesce("reason", F.lit("none")).alias("pass_reason"))
        .agg(F.count("*").alias("n_passed"))
    )
