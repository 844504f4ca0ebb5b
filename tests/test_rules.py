"""Rule truth table: one row per branch, with the boundary values."""

import pytest

from listwright import config as C
from listwright.config import RuleConfig
from listwright.operators.rules import apply_rules

SCHEMA = (
    "case string, sector string, customer_type string, reason_for_sale string, location_state string, "
    "title string, description string, revenue bigint, ebitda bigint, asking_price bigint, "
    "claimed_recurring boolean, years_established int"
)
BASE = {
    "sector": "fire_safety", "customer_type": None, "reason_for_sale": None, "location_state": "VIC",
    "title": "Shop", "description": "", "revenue": 2_000_000, "ebitda": 1, "asking_price": 1,
    "claimed_recurring": True, "years_established": None,
}

CASES = {
    "title franchise": ({"title": "Big FRANCHISE"}, "excluded"),
    "sector excluded": ({"sector": "hospitality"}, "excluded"),
    "decline": ({"description": "It is Closing Down."}, "excluded"),
    "franchise text": ({"description": "a franchisor exists"}, "excluded"),
    "concentration": ({"description": "100% of revenue"}, "excluded"),
    "revenue 499999": ({"revenue": 499_999}, "excluded"),
    "revenue 500000": ({"revenue": 500_000}, "needs_information"),
    "capital, no tail": ({"description": "heavy machinery", "claimed_recurring": False}, "excluded"),
    "capital, recurring": ({"description": "heavy machinery"}, "promising"),
    "capital, tail words": (
        {"description": "heavy machinery, licensed, service contracts", "claimed_recurring": False}, "promising"),
    "overseas": ({"description": "UK only"}, "excluded"),
    "tier 1 at 1M": ({"revenue": 1_000_000}, "promising"),
    "tier 1 at 20M": ({"revenue": 20_000_000}, "promising"),
    "tier 1 below": ({"revenue": 999_999}, "needs_information"),
    "tier 1 above": ({"revenue": 20_000_001}, "needs_information"),
    "tier 1 unknown revenue": ({"revenue": None}, "needs_information"),
    "tier 1 no signal": ({"claimed_recurring": False}, "needs_information"),
    "tier 2 one signal": ({"sector": "podiatry"}, "needs_information"),
    "tier 2 two signals": ({"sector": "podiatry", "customer_type": "B2B"}, "promising"),
    "watchlist": (
        {"sector": "childcare", "customer_type": "B2B", "years_established": 9, "reason_for_sale": "Health",
         "description": "licensed"}, "needs_information"),
    "no sector": ({"sector": None}, "needs_information"),
    "other sector": ({"sector": "trade_services"}, "needs_information"),
    "all null": ({k: None for k in BASE}, "needs_information"),
}


@pytest.fixture(scope="module")
def ruled(spark):
    rows = [(name, *{**BASE, **change}.values()) for name, (change, _) in CASES.items()]
    out = spark.createDataFrame(rows, SCHEMA).transform(apply_rules(explain=True)).collect()
    return {r["case"]: r for r in out}


@pytest.mark.parametrize("case", CASES)
def test_outcome(ruled, case):
    assert ruled[case]["outcome"] == CASES[case][1]


def test_texts(ruled):
    floor = ruled["revenue 499999"]
    assert floor["matched_rules"] == ["Hard exclusion: disclosed revenue $499,999 below $500K floor"]
    assert floor["missing_facts"] == [] and floor["sector_code"] is None
    low = ruled["tier 1 below"]
    assert low["missing_facts"][0] == "Revenue $999,999 below preferred minimum $1M — verify"
    assert low["missing_facts"][-1].startswith("Unconfirmed signal: ")
    assert ruled["tier 1 no signal"]["matched_rules"][1] == C.T_TIER_1_NONE % "fire_safety"
    assert ruled["watchlist"]["missing_facts"][0] == C.WATCHLIST["childcare"]
    assert len(ruled["watchlist"]["signals"]) == 5
    assert ruled["tier 2 one signal"]["missing_facts"][-1] == C.M_TIER_2 % ("podiatry", 1)
    unknown = ruled["all null"]
    assert unknown["sector_code"] is None and unknown["matched_rules"] == [C.T_UNKNOWN % "Unknown"]
    assert unknown["missing_facts"] == [C.M_REVENUE, C.M_EBITDA, C.M_RECURRING, C.M_LOCATION, C.M_SECTOR]


def test_tenure(frame):
    texts = {
        "field": (6, "", C.S_TENURE % 6),
        "short field, text": (3, "12 years of operation", C.S_TENURE_TEXT % 12),
        "text needs a trigger": (None, "12 years old", None),
        "young": (None, "founded in town, 3 years old", None),
        "too long a number": (None, "99999999999999999999 years of operation", None),
    }
    rows = [
        (name, *{**BASE, "years_established": y, "description": d, "claimed_recurring": False}.values())
        for name, (y, d, _) in texts.items()
    ]
    got = {r["case"]: r["signals"] for r in frame(rows, SCHEMA).transform(apply_rules(explain=True)).collect()}
    for name, (_, _, want) in texts.items():
        assert got[name] == ([want] if want else []), name


def test_switches(frame):
    rows = [
        ("sub", *{**BASE, "claimed_recurring": False, "description": "search"}.values()),
        ("wide", *{**BASE, "sector": "locksmith"}.values()),
        ("flags", *{**BASE, "asking_price": 10_000_001, "ebitda": -5, "description": "45% of revenue"}.values()),
    ]
    df = frame(rows, SCHEMA)

    def run(cfg):
        return {r["case"]: r for r in df.transform(apply_rules(cfg, explain=True)).collect()}

    plain, strict = run(RuleConfig()), run(RuleConfig(word_boundary=True))
    assert plain["sub"]["signals"] == [C.S_LICENSED] and strict["sub"]["signals"] == []
    assert plain["wide"]["outcome"] == "needs_information"
    assert run(RuleConfig(wide_exclusions=True))["wide"]["outcome"] == "excluded"
    flags = run(RuleConfig(size_flags=True))["flags"]["missing_facts"]
    assert [f[:6] for f in flags] == ["Asking", "Custom", "EBITDA"]
