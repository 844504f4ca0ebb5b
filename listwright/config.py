"""Rule and feed configuration.

Everything under "fixed values" has to equal the established rule set for the results
to be right; change a value only together with ``CRITERIA_VERSION``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------- fixed values
CRITERIA_VERSION = "0.2"
EXTRACTION_VERSION = "1.0.0"

TIER_1 = (
    "fire_safety", "hvac_maintenance", "electrical_maintenance", "vehicle_inspection",
    "building_pest_inspection", "pest_control", "insurance_broking", "mortgage_broking",
    "financial_planning", "allied_health", "home_care",
)
TIER_2 = (
    "building_maintenance_strata", "bookkeeping_accounting", "physiotherapy", "podiatry",
    "swim_school", "medical_billing", "commercial_cleaning", "preventive_health",
)
WATCHLIST = {
    "ndis_services": "NDIS: funding reform risk, thin margins, workforce challenges, compliance intensity — elevated scrutiny required before Promising classification",
    "childcare": "Childcare: highly regulated (NQF/ACECQA) but government subsidy-dependent (CCS) — regulatory risk is real",
    "vocational_training": "Vocational training (RTO): ASQA regulated but VET FEE-HELP history creates reputational and funding risk — watch, not pursue",
    "aged_care_residential": "Aged care (residential): complex compliance, CDC model disruption — prefer home care over residential",
    "dentistry": "Dentistry: active rollup already mature, entry multiples elevated — window may have closed",
}
EXCLUDED_SECTORS = ("hospitality", "retail", "franchise")
EXCLUDED_SECTORS_WIDE = (
    "hospitality", "retail", "franchise", "gym_fitness", "locksmith", "blinds_curtains",
    "gutter_cleaning", "handyman_franchise", "massage_spa", "tutoring_franchise",
    "driving_school", "photography_studio", "event_hire", "dtc_consumables",
    "recruitment_agency", "promotional_merchandise", "solar_installation", "pet_services",
    "residential_gardening", "office_supplies",
)
OTHER_SECTORS = ("professional_services", "trade_services", "other_services")
UNKNOWN_SECTOR = "Unknown"

REVENUE_FLOOR = 500_000
REVENUE_MIN = 1_000_000
REVENUE_MAX = 20_000_000
PRICE_FLAG = 10_000_000
CONCENTRATION_FLAG_PCT = 30
MIN_TENURE_YEARS = 5

DECLINE_WORDS = ("structural decline", "going out of business", "closing down")
FRANCHISE_WORDS = ("franchise agreement", "franchisor", "franchisee")
CONCENTRATION_WORDS = ("single customer", "one customer", "100% of revenue", "sole client")
CAPITAL_WORDS = (
    "heavy machinery", "fleet of vehicles", "manufacturing plant", "capital equipment",
    "significant plant", "property ownership",
)
SERVICE_TAIL_WORDS = ("service contracts", "maintenance agreements", "recurring service")
OVERSEAS_WORDS = ("new zealand only", "uk only", "united states only")
LICENCE_WORDS = (
    "licence", "licensed", "accredited", "registration", "AFSL", "ARC", "AHPRA", "FPAS",
    "QBCC", "certified", "authorised", "authorized",
)
B2B_WORDS = (
    "commercial clients", "business customers", "corporate", "government", "institutional",
    "B2B", "trade customers",
)
TENURE_TRIGGERS = ("established for", "years of operation", "years experience", "founded in")
TENURE_PATTERN = r"(?i)(\d+)\s*years?\s*(?:of\s*operation|established|experience|old)"
TRANSITION_WORDS = ("retirement", "succession", "lifestyle", "health", "family", "personal")

R_FRANCHISE_TITLE = "Hard exclusion: franchise (deal type)"
R_SECTOR = "Hard exclusion: sector (%s)"
R_DECLINE = "Hard exclusion: structural decline"
R_FRANCHISE_TEXT = "Hard exclusion: franchise arrangement detected"
R_CONCENTRATION = "Hard exclusion: single-customer concentration risk (>50%)"
R_FLOOR = "Hard exclusion: disclosed revenue $%s below $500K floor"
R_CAPITAL = "Hard exclusion: high capital intensity without recurring service tail"
R_OVERSEAS = "Hard exclusion: non-Australian business"

S_RECURRING = "Recurring/contract revenue mentioned (claimed — not verified)"
S_LICENSED = "Licensed/regulated operation mentioned"
S_B2B = "B2B customer base described"
S_TENURE = "Established tenure: %s years"
S_TENURE_TEXT = "Established tenure: %s years (from description)"
S_TRANSITION = "Owner-operator transition indicated (retirement/lifestyle/succession)"

M_REVENUE = "Revenue not disclosed"
M_REVENUE_LOW = "Revenue $%s below preferred minimum $1M — verify"
M_REVENUE_HIGH = "Revenue $%s above $20M — flag for partner review"
M_EBITDA = "EBITDA not disclosed"
M_RECURRING = "Recurring/contract revenue not confirmed in listing text"
M_LOCATION = "Location not identified"
M_UNCONFIRMED = "Unconfirmed signal: %s"
M_TIER_2 = "Tier 2 sector (%s) requires ≥2 positive signals for Promising — %s found"
M_SECTOR = "Sector classification required for further assessment"

T_TIER_1 = "Tier 1 sector: %s"
T_TIER_1_NONE = "Tier 1 sector (%s) but no confirmed positive signals"
T_TIER_2 = "Tier 2 sector: %s"
T_WATCH = "Watchlist sector: %s"
T_UNKNOWN = "Sector unknown or unclassified (%s)"

SUMMARY_MISSING = "No summary available."
SUMMARY_FAILED = "Extraction failed — manual review required."

# First hit wins; each entry is (any of these substrings of the sector, suggestion).
NEXT_STEPS = (
    (("fire", "safety"), "Request information memorandum; check FPAS accreditation status and contract book"),
    (("hvac", "electrical"), "Request P&L and maintenance contract schedule; verify ARC/electrical licence"),
    (("insurance", "financial_planning"), "Request AFSL details, trail book summary, and client retention data"),
    (("mortgage",), "Request trail book size, aggregator platform, and client loan-in-force data"),
    (("allied_health", "physiotherapy"), "Request NDIS/Medicare billing breakdown and AHPRA registration details"),
    (("building_pest", "pest_control"), "Request licence details, client list, and recurring contract schedule"),
    (("home_care", "aged_care"), "Request HCP/CHSP provider approval status and client caseload breakdown"),
    (("bookkeeping", "accounting"), "Request client list, average tenure, and recurring engagement schedule"),
)
NEXT_STEP_DEFAULT = "Request information memorandum and earnings breakdown from broker"

STATE_CODES = {
    "victoria": "VIC", "vic": "VIC",
    "new south wales": "NSW", "nsw": "NSW",
    "queensland": "QLD", "qld": "QLD",
    "south australia": "SA", "sa": "SA",
    "western australia": "WA", "wa": "WA",
    "tasmania": "TAS", "tas": "TAS",
    "northern territory": "NT", "nt": "NT",
    "australian capital territory": "ACT", "act": "ACT",
}
STATE_NAMES = (
    "Victoria", "New South Wales", "Queensland", "South Australia", "Western Australia",
    "Tasmania", "Northern Territory", "Australian Capital Territory",
)
SLUG_STATES = ("VIC", "NSW", "QLD", "SA", "WA", "TAS", "NT", "ACT")
FEED_STATES = ("vic", "nsw", "qld", "sa", "wa", "tas", "act", "nt")
PREFERRED_STATES = ("VIC", "NSW", "QLD")

CLAIM_BATCH = 20
DIGEST_SIZE = 5
REASONS_SHOWN = 3
MISSING_SHOWN = 2
RULES_SHOWN = 4
MAX_ATTEMPTS = 5
RETRY_STEP_MINUTES = 30
RETRY_CAP_MINUTES = 240
ALERT_AFTER_FAILURES = 2
POLL_MINUTES = 240
MULTIPLE_TOLERANCE = 0.2
LOCAL_ZONE = "Australia/Melbourne"
REVIEW_ACTIONS = ("watch", "pursue", "pass")
MARKET_SUFFIXES = (".com.au", ".com")

# Prefixes and phrases that mark an entry of a mixed reason list as a missing fact.
MISSING_PREFIXES = ("Missing:", "NDIS:", "Childcare:")
MISSING_PHRASES = ("not confirmed", "Not disclosed")

CARD_FEED = "business2sell"
CARD_BASE = "https://www.business2sell.com.au"
CARD_SEARCH = "https://www.business2sell.com.au/businesses/sale"
CARD_DETAIL_PATH = "/businesses-details/"
CARD_MAX_PAGES = 10
ITEM_FEED = "bsale"
ITEM_BASE = "https://bsale.com.au"
ITEM_SEARCH = "https://bsale.com.au/businesses-for-sale"
ITEM_DETAIL = "bsale.com.au/listing/"
ITEM_MAX_PAGES = 3
# ------------------------------------------------------------ end fixed values

T_TIER_1_RANGE = "Tier 1 sector (%s) but revenue not confirmed in preferred range"
M_PRICE_HIGH = "Asking price $%s above $10M — flag for partner review"
M_CONCENTRATION = "Customer concentration of %s%% indicated — verify"
M_EBITDA_NEGATIVE = "EBITDA $%s is negative — assess recoverability"
CONCENTRATION_PATTERN = r"(?i)(?:^|[^\d.,])(\d+)(?:\.\d+)?\s*% of (?:revenue|sales|turnover)"

# Sector wording for the built-in extractor: first hit wins, so specific labels come first.
SECTOR_WORDS = (
    ("franchise", ("franchise",)),
    ("building_pest_inspection", ("building and pest", "pre-purchase inspection", "building inspection")),
    ("pest_control", ("pest control", "termite")),
    ("fire_safety", ("fire safety", "fire protection", "fire equipment")),
    ("hvac_maintenance", ("hvac", "air conditioning", "refrigeration")),
    ("electrical_maintenance", ("electrical",)),
    ("vehicle_inspection", ("roadworthy", "vehicle inspection")),
    ("insurance_broking", ("insurance brok",)),
    ("mortgage_broking", ("mortgage brok", "mortgage business")),
    ("financial_planning", ("financial planning", "financial advice")),
    ("physiotherapy", ("physiotherap",)),
    ("podiatry", ("podiatr",)),
    ("dentistry", ("dental", "dentist", "optometr")),
    ("ndis_services", ("ndis",)),
    ("allied_health", ("allied health", "speech pathology", "occupational therapy")),
    ("home_care", ("home care", "in-home support")),
    ("aged_care_residential", ("aged care", "nursing home")),
    ("childcare", ("childcare", "child care", "early learning")),
    ("vocational_training", ("registered training", "vocational training")),
    ("building_maintenance_strata", ("strata", "building maintenance", "facilities management")),
    ("bookkeeping_accounting", ("bookkeeping", "accounting practice", "tax agent")),
    ("swim_school", ("swim school",)),
    ("medical_billing", ("medical billing", "practice management")),
    ("commercial_cleaning", ("commercial cleaning", "contract cleaning")),
    ("preventive_health", ("preventive health", "corporate wellness")),
    ("hospitality", ("restaurant", "cafe", "hotel", "takeaway")),
    ("retail", ("retail store", "gift shop", "boutique")),
    ("trade_services", ("plumbing", "carpentry", "landscaping")),
    ("professional_services", ("consultancy", "consulting")),
)


# What requests are answered.
ANSWERS = {
    "nothing_asked": "Provide url or listingId",
    "bad_url": "Invalid URL",
    "unsupported": "URL must be a supported marketplace URL",
    "processing": "Extraction in progress — check back in 30 seconds",
    "queued": "Inspection queued — check back in 30 seconds",
    "not_found": "Listing not found",
    "missing_fields": "listingId, action, and actor are required",
    "bad_action": "action must be watch, pursue, or pass",
    "marked": "Listing marked as ",
}


@dataclass(frozen=True)
class RuleConfig:
    """Switches of the rule chain; the defaults give the established behaviour."""

    word_boundary: bool = False       # match keywords as whole words instead of substrings
    wide_exclusions: bool = False     # also enforce the declared-only excluded sectors
    size_flags: bool = False          # add price / concentration / negative-EBITDA flags
    criteria_version: str = CRITERIA_VERSION


@dataclass(frozen=True)
class Feed:
    name: str
    adapter: str
    base_url: str
    search_url: str
    max_pages: int
    poll_minutes: int = POLL_MINUTES
    enabled: bool = True
    states: tuple[str, ...] = field(default=())


FEEDS = (
    Feed(CARD_FEED, "cards", CARD_BASE, CARD_SEARCH, CARD_MAX_PAGES),
    Feed(ITEM_FEED, "item_list", ITEM_BASE, ITEM_SEARCH, ITEM_MAX_PAGES, states=FEED_STATES),
)
