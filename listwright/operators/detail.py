"""Detail pages to listing fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright import config as C
from listwright.functions import text as X

FIELDS = (
    "title", "location_state", "location_suburb", "sector_raw", "broker_name",
    "asking_price", "revenue_raw", "profit_raw", "advertised_status",
)
OVERLAID = ("title", "location_state", "location_suburb", "sector_raw", "broker_name", "asking_price")
# A banner stands on a line of its own; the same words in running text say nothing.
STATUS_WORDS = r"(?im)^ *(sold|under contract|off market) *$"


# A place is looked for at the start of a run of letters only; trying every letter of the
# run would cost its length squared.
_RUN = r"(?<![A-Za-z ])[A-Za-z ]++"
PLACE_LABELLED = r"(?:Location|State)[: \n]+[A-Za-z ]+, *[A-Za-z ]+"
PLACE_PLAIN = rf"{_RUN}, *(?:{'|'.join(C.STATE_NAMES)}) *\d{{4}}"
CATEGORY = r"Business Category\s+([^\n]+)"


def _read(pages: DataFrame, html: str, wordings: dict[str, Column]) -> DataFrame:
    """Pages with the wordings found in their text; each page is stripped once and each
    pattern run once, in projections of their own."""
    lined = pages.withColumn("_lines", X.text_lines(F.col(html)))
    return lined.withColumns(wordings).drop("_lines")


def _head(value: Column, chars: int | None) -> Column:
    return value if chars is None else F.left(value, F.lit(chars))


def _said(name: str) -> Column:
    trimmed = F.trim(F.col(name))
    return F.when(trimmed != "", trimmed)


def _disclosed(name: str) -> Column:
    return F.when(F.trim(F.col(name)) != "Not disclosed", _said(name))


def _suburb(place: Column) -> Column:
    named = F.trim(F.regexp_extract(place, r"(?:(?:Location|State)[: \n]+)?([A-Za-z ]+),", 1))
    return F.when(named != "", named)


def _state(place: Column) -> Column:
    named = F.trim(F.regexp_extract(place, r", *([A-Za-z ]+)", 1))
    return X.normalise_state(F.when(named != "", named))


def card_details(pages: DataFrame, html: str = "html") -> DataFrame:
    """Fields of a labelled detail page ("Asking Price:", "Sales revenue:", ...)."""
    t = F.col("_lines")
    wordings = {
        "_place": F.regexp_extract(t, PLACE_LABELLED, 0),
        "_sector": F.regexp_extract(t, CATEGORY, 1),
        "_broker": F.regexp_extract(
            t, r"(?:Broker|Agent|Listed by)(?: *:[ \n]*| +)([A-Za-z ]+?) *(?:\n|Email|Phone|Mobile|<|$)", 1
        ),
        "_price": F.regexp_extract(t, r"Asking Price:\s*\$?([\d,]+)", 1),
        "_revenue": F.regexp_extract(t, r"Sales revenue\s*:\s*([^\n]+)", 1),
        "_profit": F.regexp_extract(t, r"Net profit\s*:\s*([^\n]+)", 1),
    }
    fields = {
        "title": X.h1_plain(F.col(html)),
        "location_state": _state(F.col("_place")),
        "location_suburb": _suburb(F.col("_place")),
        "sector_raw": _said("_sector"),
        "broker_name": _said("_broker"),
        "asking_price": X.parse_money(F.col("_price")),
        "revenue_raw": _said("_revenue"),
        "profit_raw": _said("_profit"),
        "advertised_status": F.lit(None).cast("string"),
    }
    return _read(pages, html, wordings).withColumns(fields).drop(*wordings, html)


def item_details(
    pages: DataFrame, html: str = "html", price_chars: int | None = None, status_chars: int | None = None,
) -> DataFrame:
    """Fields of a detail page of the item-list feed.

    The whole text is searched; ``price_chars`` / ``status_chars`` limit the search for the
    first dollar amount and for a status banner to the head of the page.
    """
    t = F.col("_lines")
    broker = r"(?:(?:Business Broker|Broker)(?: *:[ \n]*| +)|Private Seller *:[ \n]*)([A-Za-z ]+?) *(?:\n|Phone|Email|Mobile|$)"
    wordings = {
        "_place": F.regexp_extract(t, PLACE_PLAIN, 0),
        "_sector": F.regexp_extract(t, CATEGORY, 1),
        "_broker": F.regexp_extract(t, broker, 1),
        "_private": F.contains(t, F.lit("Private Seller")),
        "_price": F.regexp_extract(_head(t, price_chars), r"\$([\d,]+)(?:\s|$|\+)", 1),
        "_revenue": F.regexp_extract(t, r"Turnover:\s*([^\n]+)", 1),
        "_profit": F.regexp_extract(t, r"Net Profit:\s*([^\n]+)", 1),
        "_status": F.regexp_extract(_head(t, status_chars), STATUS_WORDS, 1),
    }
    named = F.when(~F.contains("_broker", F.lit("Broker")), _said("_broker"))
    fields = {
        "title": X.h1_decoded(F.col(html)),
        "location_state": _state(F.col("_place")),
        "location_suburb": _suburb(F.col("_place")),
        "sector_raw": _said("_sector"),
        "broker_name": F.coalesce(named, F.when(F.col("_private"), F.lit("Private Seller"))),
        "asking_price": X.parse_money(F.col("_price")),
        "revenue_raw": _disclosed("_revenue"),
        "profit_raw": _disclosed("_profit"),
        "advertised_status": F.lower(_said("_status")),
    }
    return _read(pages, html, wordings).withColumns(fields).drop(*wordings, html)


def overlay(listings: DataFrame, details: DataFrame, on: str = "id") -> DataFrame:
    """Stored rows with what the detail page said on top; silence keeps the stored value."""
    said = details.select(on, *(F.col(c).alias(f"_{c}") for c in OVERLAID))
    merged = listings.join(said, on, "left")
    return merged.withColumns(
        {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in OVERLAID}
    ).drop(*(f"_{c}" for c in OVERLAID))
