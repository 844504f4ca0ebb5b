import json

import pytest
from pyspark.sql import functions as F

from listwright import config as C
from listwright.config import RuleConfig
from listwright.functions import text as X
from listwright.operators import cycle, facts, state
from listwright.schemas import FACTS, LISTINGS

REPLY = {
    "revenue": 1_200_000, "revenue_raw": " $1.2m ", "ebitda": 300_000, "asking_multiple": None, "claimed_recurring": True,
    "customer_type": "B2B", "description_summary": "A shop.", "sector_classification": "pest_control",
}


def parse(spark, reply, price=1_000_000):
    text = reply if isinstance(reply, (str, type(None))) else json.dumps(reply)
    df = spark.createDataFrame([(text, price)], "response string, asking_price bigint")
    row = facts.parse_responses(df).first()
    return row.facts, row.parse_failed


def test_plain_and_wrapped(spark):
    for text in (json.dumps(REPLY), "Here:\n" + json.dumps(REPLY, indent=2) + "\nBye"):
        f, failed = parse(spark, text)
        assert not failed and (f.revenue, f.revenue_raw, f.ebitda, f.asking_multiple) == (1_200_000, "$1.2m", 300_000, 3.3)
        assert f.claimed_recurring and f.customer_type == "B2B" and f.staff_count is None


@pytest.mark.parametrize("text", [None, "", "no json", "{broken", '{"a": 1} }', '{"a": 1}, {"b": 2}', '{"a": 1,}', "{} and {}"])
def test_failures(spark, text):
    f, failed = parse(spark, text)
    assert failed and f.description_summary == C.SUMMARY_FAILED and f.sector_classification == "Unknown"
    assert f.claimed_recurring is False
    assert all(f[c.name] is None for c in FACTS.fields if c.name not in ("description_summary", "sector_classification", "claimed_recurring"))


@pytest.mark.parametrize(
    "change,field,want",
    [
        ({"claimed_recurring": "true"}, "claimed_recurring", False), ({"claimed_recurring": 1}, "claimed_recurring", False),
        ({"revenue": "1,200"}, "revenue", 1), ({"revenue": 3.9}, "revenue", 3), ({"revenue": "12abc"}, "revenue", 12),
        ({"revenue": "x"}, "revenue", None), ({"revenue": 1e6}, "revenue", 1_000_000), ({"revenue_raw": "null"}, "revenue_raw", None),
        ({"revenue_raw": "  "}, "revenue_raw", None), ({"customer_type": "b2b"}, "customer_type", None),
        ({"description_summary": None}, "description_summary", C.SUMMARY_MISSING), ({"sector_classification": ""}, "sector_classification", "Unknown"),
        ({"asking_multiple": 3.6}, "asking_multiple", 3.6), ({"asking_multiple": "3.0x"}, "asking_multiple", 3.0),
        ({"asking_multiple": 4.3}, "asking_multiple", 3.3), ({"ebitda": 0, "asking_multiple": 3}, "asking_multiple", None),
        ({"ebitda": -5}, "asking_multiple", None), ({"ebitda": 10**12, "asking_multiple": 3}, "asking_multiple", 0.0),
    ],
)
def test_coercion(spark, change, field, want):
    f, failed = parse(spark, REPLY | change)
    assert not failed and f[field] == want


TEXT = (
    "Pest Control round, licensed. Turnover: $1.25m. EBITDA of $300,000 and net profit is $90k. 5 year lease, 3 staff.\n"
    "Reason for sale: retirement. 12 years of operation with service agreements for government sites and households."
)


def test_native_facts(spark):
    df = spark.createDataFrame([("a", TEXT, 900_000), ("b", "Quiet. Profit $5. Built a service.", None), ("c", None, None)], "id string, text string, asking_price bigint")
    got = {r.id: r.facts for r in facts.text_facts(df).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.revenue, a.revenue_raw, a.ebitda, a.asking_multiple) == (1_250_000, "Turnover: $1.25m", 300_000, 3.0)
    assert (a.profit_unspecified_raw, a.lease_years, a.staff_count) == ("net profit is $90k", 5, 3)
    assert (a.reason_for_sale, a.years_established, a.customer_type) == ("retirement", 12, "mixed")
    assert a.claimed_recurring and a.sector_classification == "pest_control"
    assert b.ebitda is None and b.profit_unspecified_raw == "Profit $5" and not b.claimed_recurring
    assert b.sector_classification == "Unknown" and c.revenue is None and c.claimed_recurring is False


def test_whole_numbers(spark):
    rows = [
        ("12000 staff, 100 year lease.", 12000, 100, None), ("12,500 employees and a 125 year lease", 12500, 125, None),
        ("99999999999 staff", None, None, None), ("Revenue of $10,000,000,000,000 million", None, None, None), ("Turnover\n$5k\nsold 4 units", None, None, 5000)]
    df = spark.createDataFrame([(i, r[0], None) for i, r in enumerate(rows)], "id int, text string, asking_price bigint")
    got = {r.id: r.facts for r in facts.text_facts(df).collect()}
    assert [(got[i].staff_count, got[i].lease_years, got[i].revenue) for i in range(5)] == [r[1:] for r in rows]
    assert all(f.advertised_status is None for f in got.values())


def test_prompt_keeps_the_whole_text(spark):
    df = spark.createDataFrame([("x" * 20_000,)], "t string")
    whole = df.select(facts.render_prompt(F.lit("T"), F.lit(5000), F.col("t")).alias("p")).first().p
    assert whole.endswith("x" * 20_000) and "AUD $5,000" in whole
    cut = df.select(facts.render_prompt(F.lit("T"), F.lit(None).cast("bigint"), F.col("t"), 10).alias("p")).first().p
    assert cut.endswith("\n" + "x" * 10) and "not stated" in cut


# What a menu offers is not what the business is.
MENU = "<NAV class='top'><a>Home</a><a>Franchises for sale</a><a>Franchisee login</a></nav><ul><li>Franchise opportunities</li></ul>"


def test_menus_are_not_read(spark):
    html = MENU + "<nav-bar>kept</nav-bar><p>A franchise shop.</p><p>Franchises for sale</p>"
    assert spark.range(1).select(X.ad_lines(F.lit(html)).alias("t")).first().t == "kept\nA franchise shop."
    assert spark.range(1).select(X.ad_lines(F.lit("<nav>never closed")).alias("t")).first().t == "never closed"


def test_cycle(spark):
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    ids = ("good", "bad", "silent")
    base = {"source": "s", "processing_state": "processing", "processing_attempts": 0, "review_state": "new"}
    rows = [tuple((base | {"id": i, "source_listing_id": i, "title": "old"}).get(f.name) for f in LISTINGS.fields) for i in ids]
    stored = spark.createDataFrame(rows, LISTINGS)
    pages = spark.createDataFrame([("good", MENU + "<p>" + TEXT + "</p>"), ("bad", "<p>x</p>")], "id string, html string")
    cols = "id string, title string, location_state string, location_suburb string, sector_raw string, broker_name string, asking_price bigint, revenue_raw string, profit_raw string, advertised_status string"
    details = spark.createDataFrame([("good", "New title", "VIC", None, None, None, 900_000, "fallback", None, "sold")], cols)

    native = cycle.extract_and_classify(stored, pages, details)
    done = {r.id: r for r in cycle.apply_results(stored, stored, native, now).collect()}
    good = done["good"]
    assert (good.processing_state, good.fit_outcome, good.sector_code, good.title) == ("done", "promising", "pest_control", "New title")
    assert (good.advertised_status, good.asking_price, good.extraction_version) == ("sold", 900_000, C.EXTRACTION_VERSION)
    assert done["bad"].processing_state == "done" and done["bad"].fit_outcome == "needs_information"
    assert done["silent"].processing_state == "retry"

    def reply(prompts):
        return prompts.map(lambda p: json.dumps(REPLY) if "Pest" in p else "sorry")

    answered = cycle.extract_and_classify(stored, pages, details, RuleConfig(), lambda df: facts.extract_with(df, reply))
    done = {r.id: r for r in cycle.apply_results(stored, stored, answered, now).collect()}
    assert done["good"].revenue == 1_200_000 and done["good"].fit_outcome == "promising"
    # An unreadable reply is a processing problem, not a classification.
    assert done["bad"].processing_state == "retry" and done["bad"].fit_outcome is None
    assert state.changed_pages(spark.createDataFrame([tuple(done["good"])], LISTINGS), spark.createDataFrame([("good", done["good"].content_hash)], "id string, content_hash string")).count() == 0
