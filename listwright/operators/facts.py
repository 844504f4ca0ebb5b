"""Facts from listing text: extractor responses, their validation, and native rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from listwright import config as C
from listwright.functions import text as X
from listwright.schemas import FACTS

NUMBERS = {"revenue": "bigint", "ebitda": "bigint", "lease_years": "int", "staff_count": "int", "years_established": "int"}
STRINGS = ("revenue_raw", "ebitda_raw", "profit_unspecified_raw", "reason_for_sale", "advertised_status")


def render_prompt(title: Column, price: Column, text: Column, max_chars: int | None = None) -> Column:
    """Request text for an extractor; ``max_chars`` only for extractors with a size limit."""
    body = text if max_chars is None else F.left(text, F.lit(max_chars))
    asked = F.coalesce(F.concat(F.lit("AUD $"), X.thousands(price)), F.lit("not stated"))
    fields = ", ".join(f.name for f in FACTS.fields)
    return F.concat(
        F.lit("Read the business-for-sale advertisement and answer with one JSON object.\nTitle: "),
        F.coalesce(title, F.lit("Unknown business")),
        F.lit("\nPrice: "),
        asked,
        F.lit(f"\nFields: {fields}\nUse null for anything the text does not state.\nText:\n"),
        F.coalesce(body, F.lit("")),
    )


def json_island(response: Column) -> Column:
    """From the first opening to the last closing brace of a reply."""
    return X.found(response, r"(?s)(\{.*\})")


def as_string(value: Column) -> Column:
    trimmed = X.trim_ws(value)
    return F.nullif(F.nullif(trimmed, F.lit("")), F.lit("null"))


def round_tenth(value: Column) -> Column:
    return F.floor(value * 10 + 0.5) / 10


def computed_multiple(price: Column, ebitda: Column) -> Column:
    ratio = price.cast("double") / F.nullif(ebitda, F.lit(0)).cast("double")
    return F.when((price > 0) & (ebitda > 0), round_tenth(ratio))


def advertised_multiple(price: Column, ebitda: Column, supplied: Column) -> Column:
    """Own price / EBITDA ratio; a supplied one replaces it only when it is close."""
    own = computed_multiple(price, ebitda)
    off = F.try_divide(F.abs(supplied - own), own)
    return F.when(off < C.MULTIPLE_TOLERANCE, supplied).otherwise(own)


def parse_responses(df: DataFrame, response: str = "response", price: str = "asking_price") -> DataFrame:
    """Add a ``facts`` struct and ``parse_failed``; an unreadable reply gives the failure record.

    The steps are projections of their own, so each reply is parsed and each field is read
    once however often it is used.
    """
    # Read as the only element of an array: anything behind the object makes it unreadable.
    boxed = F.concat(F.lit("["), json_island(F.col(response)), F.lit("]"))
    parsed = df.withColumn("_json", F.try_parse_json(boxed))
    alone = F.try_variant_get("_json", "$[1]", "variant").isNull()
    parsed = parsed.withColumn("_json", F.when(alone, F.col("_json")))

    def raw(field: str) -> Column:
        return F.try_variant_get("_json", f"$[0].{field}", "string")

    flag = F.try_variant_get("_json", "$[0].claimed_recurring", "variant")
    strict = (F.schema_of_variant(flag) == "BOOLEAN") & F.try_variant_get(
        "_json", "$[0].claimed_recurring", "boolean"
    )
    texts = ("description_summary", "sector_classification", "customer_type", *STRINGS)
    read = {f"_{name}": X.leading_int(raw(name), kind) for name, kind in NUMBERS.items()}
    read |= {f"_{name}": as_string(raw(name)) for name in texts}
    read["_asking_multiple"] = X.leading_float(raw("asking_multiple"))
    read["_claimed_recurring"] = F.coalesce(strict, F.lit(False))
    read["parse_failed"] = F.col("_json").isNull()
    parsed = parsed.withColumns(read).drop("_json")

    values = {name[1:]: F.col(name) for name in read if name != "parse_failed"}
    values["asking_multiple"] = advertised_multiple(F.col(price), F.col("_ebitda"), F.col("_asking_multiple"))
    kind = F.col("_customer_type")
    values["customer_type"] = F.when(kind.isin("B2B", "B2C", "mixed"), kind)
    values["description_summary"] = F.when(F.col("parse_failed"), F.lit(C.SUMMARY_FAILED)).otherwise(
        F.coalesce("_description_summary", F.lit(C.SUMMARY_MISSING))
    )
    values["sector_classification"] = F.coalesce("_sector_classification", F.lit(C.UNKNOWN_SECTOR))
    facts = F.struct(*(values[f.name].cast(f.dataType).alias(f.name) for f in FACTS.fields))
    dropped = [name for name in read if name != "parse_failed"]
    return parsed.withColumn("facts", facts).drop(*dropped)


# A labelled dollar amount with an optional thousands/millions suffix.
LABELLED = r"(?i)\b(?:{label})(?: of| is|:)? *\n? *-?\$ ?\d[\d,]*(?:\.\d+)? ?(?:million|m|k)?\b"
REVENUE = "(?:annual |sales )?(?:revenue|turnover)"
EBITDA = "ebitda"
PROFIT = "(?:net )?profit"
RECURRING = r"(?i)\b(?:contracts?|service agreements?|retainers?|subscriptions?|recurring revenue)\b"
REASON = r"(?i)reason for (?:sale|selling)[: ]+([^.\n]+)"
WHOLE = r"(?:^|[^\d.,])(\d{1,3}(?:,\d{3})+|\d+)"
LEASE = rf"(?i){WHOLE}[ -]years? lease"
STAFF = rf"(?i){WHOLE} (?:full[- ]time |part[- ]time )?(?:staff|employees)"
STATUS = r"(?im)^ *(sold|under contract|off market) *$"
CONSUMER = ("retail customers", "consumers", "households", "walk-in", "B2C")


def _amount(wording: Column) -> Column:
    """Whole dollars of a short wording such as "Turnover of $1.2m"."""
    digits = F.replace(F.regexp_extract(wording, r"\$ ?(\d[\d,]*(?:\.\d+)?)", 1), F.lit(","), F.lit(""))
    unit = F.lower(F.regexp_extract(wording, r"(?i)(million|m|k)$", 1))
    scale = F.when(unit.isin("m", "million"), 1_000_000).when(unit == "k", 1_000).otherwise(1)
    sign = F.when(wording.rlike(r"-\$"), -1).otherwise(1)
    exact = F.when(digits != "", digits).try_cast("decimal(18,4)")
    return F.floor(exact * scale * sign).try_cast("bigint")


def _whole(wording: Column) -> Column:
    """A number with thousands commas; one too large for the field is not taken."""
    return F.replace(wording, F.lit(","), F.lit("")).try_cast("int")


def text_facts(df: DataFrame, text: str = "text", price: str = "asking_price") -> DataFrame:
    """Add a ``facts`` struct read off the text by native patterns, whole text, no Python.

    Only stated values are taken: EBITDA where it is called that, any other profit stays
    wording, and recurring income needs one of the explicit words. A pattern runs only on
    texts that hold one of its plain words, and each runs once: the wordings found are
    columns of a projection of their own, and numbers are read off those.
    """
    t = F.col(text)

    def gated(words, value: Column) -> Column:
        return F.when(X.holds_any("_low", words), value)

    def wording(label: str, *words: str) -> Column:
        return gated(words, F.regexp_extract(t, LABELLED.format(label=label), 0))

    found = {
        "_revenue": wording(REVENUE, "revenue", "turnover"),
        "_ebitda": wording(EBITDA, "ebitda"),
        "_profit": wording(PROFIT, "profit"),
        "_lease": gated(("lease",), F.regexp_extract(t, LEASE, 1)),
        "_staff": gated(("staff", "employees"), F.regexp_extract(t, STAFF, 1)),
        "_reason": gated(("reason for s",), F.regexp_extract(t, REASON, 1)),
        "_years": gated(("year",), F.regexp_extract(t, C.TENURE_PATTERN, 1)),
        "_status": gated(("sold", "under contract", "off market"), F.lower(F.regexp_extract(t, STATUS, 1))),
        "_recurring": gated(
            ("contract", "service agreement", "retainer", "subscription", "recurring revenue"),
            t.rlike(RECURRING),
        ),
        "_b2b": X.holds_any("_low", C.B2B_WORDS),
        "_b2c": X.holds_any("_low", CONSUMER),
        "_sector": F.coalesce(
            *(gated(words, F.lit(code)) for code, words in C.SECTOR_WORDS), F.lit(C.UNKNOWN_SECTOR)
        ),
    }
    read = df.withColumn("_low", F.lower(text)).withColumns(found).drop("_low")

    def said(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    read = read.withColumns({"_revenue_n": _amount(F.col("_revenue")), "_ebitda_n": _amount(F.col("_ebitda"))})
    b2b, b2c = F.col("_b2b"), F.col("_b2c")
    values = {
        "revenue": F.col("_revenue_n"),
        "revenue_raw": said("_revenue"),
        "ebitda": F.col("_ebitda_n"),
        "ebitda_raw": said("_ebitda"),
        "profit_unspecified_raw": said("_profit"),
        "asking_multiple": computed_multiple(F.col(price), F.col("_ebitda_n")),
        "lease_years": _whole(said("_lease")),
        "staff_count": _whole(said("_staff")),
        "reason_for_sale": X.trim_ws(said("_reason")),
        "years_established": said("_years").try_cast("int"),
        "customer_type": F.when(b2b & b2c, "mixed").when(b2b, "B2B").when(b2c, "B2C"),
        "claimed_recurring": F.coalesce("_recurring", F.lit(False)),
        "description_summary": F.coalesce(X.squeeze(t), F.lit(C.SUMMARY_MISSING)),
        "sector_classification": F.col("_sector"),
        "advertised_status": said("_status"),
    }
    facts = F.struct(*(values[f.name].cast(f.dataType).alias(f.name) for f in FACTS.fields))
    return read.withColumn("facts", facts).drop(*found, "_revenue_n", "_ebitda_n")


def extract_with(
    df: DataFrame, reply: Callable[[pd.Series], pd.Series], prompt: str = "prompt",
) -> DataFrame:
    """Hook for an outside extractor: Arrow batches of prompts in, replies out."""
    carried = [f for f in df.schema.fields if f.name != prompt]
    out = T.StructType([*carried, T.StructField("response", T.StringType())])
    names = [f.name for f in carried]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[names].assign(response=reply(batch[prompt]))

    return df.mapInPandas(run, out)


def stamp(df: DataFrame) -> DataFrame:
    """Versions of extractor and criteria, and the evidence flag only a person can set."""
    return df.withColumns(
        {
            "extraction_version": F.lit(C.EXTRACTION_VERSION),
            "criteria_version": F.lit(C.CRITERIA_VERSION),
            "evidenced_recurring": F.lit(False),
        }
    )
