"""Ordered rule chain that sorts listings into promising, needs_information and excluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright import config as C
from listwright.config import RuleConfig
from listwright.functions import text as X

INPUTS = (
    "sector", "customer_type", "reason_for_sale", "location_state", "title", "description",
    "revenue", "ebitda", "asking_price", "claimed_recurring", "years_established",
)


def _fill(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def _yes(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _texts(*maybe: Column) -> Column:
    return F.array_compact(F.array(*maybe))


def sector_tier(sector: Column, wide: bool = False) -> Column:
    """tier_1 / tier_2 / watchlist / excluded, or null."""
    out = C.EXCLUDED_SECTORS_WIDE if wide else C.EXCLUDED_SECTORS
    return (
        F.when(sector.isin(*out), "excluded")
        .when(sector.isin(*C.TIER_1), "tier_1")
        .when(sector.isin(*C.TIER_2), "tier_2")
        .when(sector.isin(*C.WATCHLIST), "watchlist")
    )


def sector_caution(sector: Column) -> Column:
    return F.try_element_at(X.constant_map(C.WATCHLIST), sector)


def _flags(df: DataFrame, cfg: RuleConfig) -> DataFrame:

    def holds(words):
        return X.holds_word("_text", words) if cfg.word_boundary else X.holds_any("_text", words)

    recurring = _yes(F.col("claimed_recurring"))
    stated = F.regexp_extract(F.coalesce(F.col("description"), F.lit("")), C.TENURE_PATTERN, 1).try_cast("bigint")
    years = F.col("years_established")
    return df.withColumn("_text", F.lower(F.coalesce("description", F.lit("")))).withColumns(
        {
            "_tier": sector_tier(F.col("sector"), cfg.wide_exclusions),
            "_recurring": recurring,
            "_decline": holds(C.DECLINE_WORDS),
            "_franchise": holds(C.FRANCHISE_WORDS),
            "_concentrated": holds(C.CONCENTRATION_WORDS),
            "_capital": holds(C.CAPITAL_WORDS) & ~(recurring | holds(C.SERVICE_TAIL_WORDS)),
            "_overseas": holds(C.OVERSEAS_WORDS),
            "_licensed": holds(C.LICENCE_WORDS),
            "_b2b": _yes(F.col("customer_type") == "B2B") | holds(C.B2B_WORDS),
            "_tenure": F.when(_yes(years >= C.MIN_TENURE_YEARS), _fill(C.S_TENURE, years.cast("string")))
            .when(holds(C.TENURE_TRIGGERS) & _yes(stated >= C.MIN_TENURE_YEARS),
                  _fill(C.S_TENURE_TEXT, stated.cast("string"))),
            "_transition": _yes(F.lower("reason_for_sale").rlike("|".join(C.TRANSITION_WORDS))),
        }
    )


def exclusion_reason() -> Column:
    """First exclusion that applies, or null; reads the flag columns."""
    revenue = F.col("revenue")
    return F.coalesce(
        F.when(X.has_any(F.col("title"), ("franchise",)), C.R_FRANCHISE_TITLE),
        F.when(F.col("_tier") == "excluded", _fill(C.R_SECTOR, F.col("sector"))),
        F.when(F.col("_decline"), C.R_DECLINE),
        F.when(F.col("_franchise"), C.R_FRANCHISE_TEXT),
        F.when(F.col("_concentrated"), C.R_CONCENTRATION),
        F.when(revenue < C.REVENUE_FLOOR, _fill(C.R_FLOOR, X.thousands(revenue))),
        F.when(F.col("_capital"), C.R_CAPITAL),
        F.when(F.col("_overseas"), C.R_OVERSEAS),
    )


def signals() -> Column:
    return _texts(
        F.when(F.col("_recurring"), C.S_RECURRING),
        F.when(F.col("_licensed"), C.S_LICENSED),
        F.when(F.col("_b2b"), C.S_B2B),
        F.col("_tenure"),
        F.when(F.col("_transition"), C.S_TRANSITION),
    )


def missing(cfg: RuleConfig) -> Column:
    revenue = F.col("revenue")
    facts = [
        F.when(revenue.isNull(), C.M_REVENUE)
        .when(revenue < C.REVENUE_MIN, _fill(C.M_REVENUE_LOW, X.thousands(revenue)))
        .when(revenue > C.REVENUE_MAX, _fill(C.M_REVENUE_HIGH, X.thousands(revenue))),
        F.when(F.col("ebitda").isNull(), C.M_EBITDA),
        F.when(~F.col("_recurring"), C.M_RECURRING),
        F.when(F.col("location_state").isNull(), C.M_LOCATION),
    ]
    if cfg.size_flags:
        facts += size_flags()
    # A watchlist caution leads the list.
    return _texts(sector_caution(F.col("sector")), *facts)


def size_flags() -> list[Column]:
    """Flags beyond the base chain: very high price, concentration, negative earnings."""
    share = F.regexp_extract(F.coalesce(F.col("description"), F.lit("")), C.CONCENTRATION_PATTERN, 1).try_cast("int")
    return [
        F.when(F.col("asking_price") > C.PRICE_FLAG, _fill(C.M_PRICE_HIGH, X.thousands(F.col("asking_price")))),
        F.when(share > C.CONCENTRATION_FLAG_PCT, _fill(C.M_CONCENTRATION, share.cast("string"))),
        F.when(F.col("ebitda") < 0, _fill(C.M_EBITDA_NEGATIVE, X.thousands(F.col("ebitda")))),
    ]


def apply_rules(cfg: RuleConfig = RuleConfig(), explain: bool = False):
    """Transform that adds outcome, matched_rules, missing_facts, criteria_version, sector_code.

    ``explain`` keeps exclusion_reason and signals as columns of their own.
    """

    def run(df: DataFrame) -> DataFrame:
        keep = df.columns
        base = _flags(df, cfg).withColumns(
            {"exclusion_reason": exclusion_reason(), "signals": signals(), "_missing": missing(cfg)}
        )
        sector = F.coalesce("sector", F.lit(C.UNKNOWN_SECTOR))
        tier, found, lacks = F.col("_tier"), F.col("signals"), F.col("_missing")
        n = F.size(found)
        out = F.col("exclusion_reason").isNotNull()
        in_range = _yes(F.col("revenue").between(C.REVENUE_MIN, C.REVENUE_MAX))
        good = ((tier == "tier_1") & (n >= 1) | (tier == "tier_2") & (n >= 2)) & in_range
        none = F.array().cast("array<string>")
        tier_label = F.when(tier == "tier_1", _fill(C.T_TIER_1, sector)).otherwise(_fill(C.T_TIER_2, sector))
        short = F.when(n >= 1, _fill(C.T_TIER_1_RANGE, sector)).otherwise(_fill(C.T_TIER_1_NONE, sector))
        matched = (
            F.when(out, F.array("exclusion_reason"))
            .when(_yes(good), F.concat(F.array(tier_label), found))
            .when(tier == "tier_1", F.array(tier_label, short))
            .when(tier == "tier_2", F.array(tier_label))
            .when(tier == "watchlist", F.array(_fill(C.T_WATCH, sector)))
            .otherwise(F.array(_fill(C.T_UNKNOWN, sector)))
        )
        unconfirmed = F.transform(found, lambda s: _fill(C.M_UNCONFIRMED, s))
        lacking = (
            F.when(out, none)
            .when(_yes(good) | (tier == "watchlist"), lacks)
            .when(tier == "tier_1", F.concat(lacks, unconfirmed))
            .when(tier == "tier_2", F.concat(lacks, F.array(_fill(C.M_TIER_2, sector, n.cast("string")))))
            .otherwise(F.concat(lacks, F.array(F.lit(C.M_SECTOR))))
        )
        result = {
            "outcome": F.when(out, "excluded").when(_yes(good), "promising").otherwise("needs_information"),
            "matched_rules": matched,
            "missing_facts": lacking,
            "criteria_version": F.lit(cfg.criteria_version),
            "sector_code": F.when(~out, F.nullif(F.col("sector"), F.lit(C.UNKNOWN_SECTOR))),
        }
        extra = ["exclusion_reason", "signals"] if explain else []
        return base.withColumns(result).select(*keep, *result, *extra)

    return run


def rules_input(listings: DataFrame, facts: DataFrame, on: str = "id") -> DataFrame:
    """Rule inputs of stored rows and their extracted facts."""
    left = listings.select(on, "title", "location_state", "asking_price")
    right = facts.select(
        on,
        F.col("sector_classification").alias("sector"),
        F.col("description_summary").alias("description"),
        "customer_type", "reason_for_sale", "revenue", "ebitda", "claimed_recurring", "years_established",
    )
    return left.join(right, on, "left")
