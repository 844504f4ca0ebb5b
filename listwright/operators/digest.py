"""Ranked digest, its text, and the inspection card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright import config as C
from listwright.functions import text as X
from listwright.operators.feeds import health_line


def confirmed_ids(activity: DataFrame) -> DataFrame:
    done = (F.col("event_type") == "digest_delivery") & (F.col("delivery_state") == "confirmed")
    # Distinct before the join: one listing may own a large part of the log.
    return activity.filter(done).select(F.col("listing_id").alias("id")).distinct()


def pending(listings: DataFrame, activity: DataFrame) -> DataFrame:
    """Assessed, unreviewed listings that no confirmed digest has carried yet."""
    ready = listings.filter(
        (F.col("processing_state") == "done")
        & F.col("fit_outcome").isin("promising", "needs_information")
        & (F.col("review_state") == "new")
    )
    return ready.join(confirmed_ids(activity), "id", "left_anti")


def state_rank() -> Column:
    """Preferred states first; an optional extra sort key, not a filter."""
    return F.when(F.col("location_state").isin(*C.PREFERRED_STATES), 0).otherwise(1)


def digest_order(prefer_states: bool = False) -> list[Column]:
    rank = F.when(F.col("fit_outcome") == "promising", 0).otherwise(1)
    extra = [state_rank().asc()] if prefer_states else []
    return [rank.asc(), *extra, F.col("first_seen").desc(), F.col("id").asc()]


def top_entries(queue: DataFrame, size: int = C.DIGEST_SIZE, prefer_states: bool = False) -> DataFrame:
    return queue.orderBy(*digest_order(prefer_states)).limit(size)


def backlog(queue: DataFrame, size: int = C.DIGEST_SIZE, prefer_states: bool = False) -> DataFrame:
    """Everything behind the digest, in digest order; no global rank is needed for it."""
    top = top_entries(queue, size, prefer_states).select("id")
    return queue.join(top, "id", "left_anti").orderBy(*digest_order(prefer_states))


def backlog_size(queue: DataFrame, size: int = C.DIGEST_SIZE) -> DataFrame:
    n = F.count("*")
    return queue.agg(n.alias("total_pending"), F.greatest(n - size, F.lit(0)).alias("backlog"))


def ranked(entries: DataFrame, size: int = C.DIGEST_SIZE, prefer_states: bool = False) -> DataFrame:
    """Digest entries with section and place; the input holds at most ``size`` rows.

    Promising entries come first, so the room left for the second section is what they
    leave of the digest size.
    """
    rows = F.array_sort(F.collect_list(F.struct(
        F.when(F.col("fit_outcome") == "promising", 0).otherwise(1).alias("rank"),
        (state_rank() if prefer_states else F.lit(0)).alias("state_rank"),
        (-F.unix_micros("first_seen")).alias("age"),
        F.col("id"),
        F.struct(*(c for c in entries.columns if c != "id")).alias("row"),
    )))
    bounded = entries.limit(size).agg(rows.alias("rows"))
    out = bounded.select(F.posexplode("rows").alias("pos", "r")).select(
        F.col("r.id").alias("id"), "r.row.*", (F.col("pos") + 1).alias("place"), F.col("r.rank").alias("section_no")
    )
    return out.withColumn(
        "section", F.when(F.col("section_no") == 0, "promising").otherwise("needs_information")
    ).drop("section_no")


def is_digest_hour(now: Column, hour: int = 7, zone: str = C.LOCAL_ZONE) -> Column:
    """Is it the hour of the digest where its readers are, daylight saving included?"""
    return F.hour(X.local_time(now, zone)) == hour


def price_label() -> Column:
    return F.coalesce(
        F.concat(F.lit("Asking $"), X.short_money(F.col("asking_price"))), F.lit("Price undisclosed")
    )


def financial_line() -> Column:
    def stated(label: str, column: str) -> Column:
        text = F.nullif(F.col(column), F.lit(""))
        return F.concat(F.lit(f"{label}: "), F.coalesce(text, F.lit("not disclosed")))

    multiple = F.when(
        F.coalesce(F.col("asking_multiple"), F.lit(0.0)) != 0,
        F.concat(F.lit("Multiple: "), X.plain_number(F.col("asking_multiple")), F.lit("x (advertised)")),
    ).otherwise("Multiple: n/a")
    return F.concat_ws(" | ", stated("Revenue", "revenue_raw"), stated("EBITDA", "ebitda_raw"), multiple)


def next_step() -> Column:
    """Suggestion by sector; the first matching entry of the list wins."""
    branches = " ".join(
        "WHEN {} THEN {}".format(" OR ".join(f"contains(s, '{w}')" for w in words), f"'{advice}'")
        for words, advice in C.NEXT_STEPS
    )
    sector = "lower(coalesce(sector_code, sector_raw, ''))"
    # transform() names the lower-cased sector once for all branches.
    return F.expr(
        f"element_at(transform(array({sector}), s -> CASE {branches} ELSE '{C.NEXT_STEP_DEFAULT}' END), 1)"
    )


def _first_of(values: Column, k: int, label: str) -> Column:
    some = F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0
    return F.when(some, F.concat(F.lit(label), F.array_join(F.slice(values, 1, k), "; ")))


def entry_text() -> Column:
    """The lines of one digest entry; parts without content leave no line."""
    head = F.concat(
        F.lit("*"),
        F.concat_ws(
            " · ",
            F.coalesce("title", F.lit("Untitled listing")),
            X.location_label(F.col("location_suburb"), F.col("location_state"), "Location unknown"),
            price_label(),
        ),
        F.lit("*"),
    )
    return F.concat_ws(
        "\n",
        F.lit(""),
        head,
        financial_line(),
        _first_of(F.col("fit_reasons"), C.REASONS_SHOWN, "*Why look:* "),
        _first_of(F.col("missing_facts"), C.MISSING_SHOWN, "*Check:* "),
        F.concat(F.lit("*Next:* "), next_step()),
        F.concat(F.lit("<"), F.col("canonical_url"), F.lit("|View listing>")),
    )


EMPTY_REASONS = {
    "no_matches": "_No new candidates meeting criteria today._",
    "incomplete_coverage": "_No new candidates found; source coverage was incomplete._",
    "pending_processing": "_No new candidates yet; listings are still being processed._",
}


def empty_reason(queue_size: Column, waiting: Column, covered: Column) -> Column:
    """Why a digest has no entries; these conditions are not the same."""
    return (
        F.when(queue_size > 0, F.lit(None))
        .when(waiting > 0, "pending_processing")
        .when(~F.coalesce(covered, F.lit(False)), "incomplete_coverage")
        .otherwise("no_matches")
    )


def why_empty(listings: DataFrame, health: DataFrame) -> DataFrame:
    """One row with the line of a digest that has no entries.

    ``health`` has one row per enabled feed; coverage counts only where the feed is healthy.
    """
    waiting = F.count_if(F.col("processing_state").isin("new", "processing", "retry"))
    covered = F.col("healthy") & F.col("coverage_complete")
    parts = listings.agg(waiting.alias("waiting")).select("waiting", F.lit(None).cast("boolean").alias("covered")).unionByName(
        health.select(F.lit(0).cast("bigint").alias("waiting"), F.coalesce(covered, F.lit(False)).alias("covered"))
    )
    reason = empty_reason(F.lit(0), F.sum("waiting"), F.min("covered"))
    return parts.agg(X.constant_map(EMPTY_REASONS)[reason].alias("text"))


def digest_text(
    entries: DataFrame, sizes: DataFrame, health: DataFrame, date_label: str,
    title: str = "Listing digest", size: int = C.DIGEST_SIZE,
    empty: str = EMPTY_REASONS["no_matches"], prefer_states: bool = False, why: DataFrame | None = None,
) -> DataFrame:
    """The digest as one text row.

    ``entries`` are the top rows of the queue with all their columns, ``sizes`` its
    ``backlog_size``. Only the entries and the per-feed health rows are gathered. A digest
    without entries says ``empty``, or what ``why_empty`` found.
    """
    placed = ranked(entries, size, prefer_states)
    lines = F.array_sort(F.collect_list(F.struct("place", "section", entry_text().alias("text"))))

    def section(name: str, label: str) -> Column:
        rows = F.filter(F.col("lines"), lambda x: x["section"] == name)
        return F.when(
            F.size(rows) > 0,
            F.concat_ws("\n", F.lit(label), F.transform(rows, lambda x: x["text"])),
        )

    body = placed.agg(lines.alias("lines")).select(
        F.lit("body").alias("part"),
        F.when(F.size("lines") > 0,
            F.concat_ws(
                "\n",
                section("promising", "*🟢 Promising*"),
                section("needs_information", "*🟡 Needs information*"),
            )
        ).alias("text"),
    )
    more = sizes.select(
        F.lit("more").alias("part"),
        F.when(
            F.col("backlog") > 0,
            F.concat(
                F.lit("\n_"),
                F.col("backlog").cast("string"),
                F.when(F.col("backlog") == 1, " additional listing").otherwise(" additional listings"),
                F.lit(" pending. Ask to show all._"),
            ),
        ).alias("text"),
    )
    line = health_line(health).select(F.lit("line").alias("part"), F.col("line").alias("text"))
    head = f"*{title} — {date_label}*"

    def part(name: str) -> Column:
        return F.max(F.when(F.col("part") == name, F.col("text")))

    # One-row parts become one text.
    parts = body.unionByName(more).unionByName(line)
    if why is not None:
        parts = parts.unionByName(why.select(F.lit("empty").alias("part"), "text"))
    shown = F.coalesce(part("body"), part("empty"), F.lit(empty))
    return parts.agg(
        F.concat_ws("\n", F.lit(head), part("line"), F.lit(""), shown, part("more")).alias("text")
    )


def inspection_text() -> Column:
    icon = (
        F.when(F.col("fit_outcome") == "promising", "🟢")
        .when(F.col("fit_outcome") == "needs_information", "🟡")
        .when(F.col("fit_outcome") == "excluded", "🔴")
        .otherwise("⚪")
    )

    def money(raw: str | None, amount: str) -> Column:
        value = F.nullif(F.col(amount), F.lit(0))
        said = F.concat(F.lit("$"), X.thousands(value))
        parts = ([F.col(raw)] if raw else []) + [said, F.lit("Not disclosed")]
        return F.coalesce(*parts)

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"*{label}:* "), value)

    def optional(label: str, column: str) -> Column:
        return line(label, F.nullif(F.col(column), F.lit("")))

    rules = _first_of(F.col("fit_reasons"), C.RULES_SHOWN, "\n*Rules matched:* ")
    multiple = F.when(
        F.coalesce(F.col("asking_multiple"), F.lit(0.0)) != 0,
        line(
            "Advertised multiple",
            F.concat(X.plain_number(F.col("asking_multiple")), F.lit("x (based on stated EBITDA — not verified)")),
        ),
    )
    place = X.location_label(F.col("location_suburb"), F.col("location_state"), "Unknown")
    checked = F.date_format(X.local_time(F.col("last_fetched")), "dd/MM/yyyy, h:mm:ss a")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("*Inspection: "), F.coalesce("title", F.lit("Unnamed listing")), F.lit("*")),
        F.concat_ws(" ", icon, X.outcome_label(F.col("fit_outcome"))),
        F.lit(""),
        F.concat_ws(" | ", line("Source", F.col("source")), line("ID", F.col("source_listing_id"))),
        line("Location", place),
        line("Sector", F.coalesce("sector_code", "sector_raw", F.lit("Unknown"))),
        line("Broker", F.coalesce("broker_name", F.lit("Unknown"))),
        F.lit(""),
        line("Asking price", money(None, "asking_price")),
        line("Revenue", money("revenue_raw", "revenue")),
        line("EBITDA", money("ebitda_raw", "ebitda")),
        optional("Profit (unspecified type)", "profit_unspecified_raw"),
        multiple,
        F.lit(""),
        optional("Summary", "description_summary"),
        rules,
        F.lit(""),
        line("Review state", F.col("review_state")),
        line("First seen", F.date_format("first_seen", "dd/MM/yyyy")),
        line("Last checked", checked),
        line("Criteria version", F.coalesce("criteria_version", F.lit("unknown"))),
        line("Extraction model", F.coalesce("extraction_version", F.lit("unknown"))),
        F.lit(""),
        F.concat(F.lit("<"), F.col("canonical_url"), F.lit("|View original listing>")),
    )


def outbox(rows: DataFrame, kind: str, event_key: Column, text: Column) -> DataFrame:
    """Report sink: what is to be sent, by stable key."""
    return rows.select(event_key.alias("event_key"), F.lit(kind).alias("kind"), text.alias("text"))
