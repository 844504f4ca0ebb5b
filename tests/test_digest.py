from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from listwright.operators import digest, feeds

T0 = datetime(2024, 5, 1)
COLS = (
    "id string, fit_outcome string, first_seen timestamp, title string, location_suburb string, location_state string, "
    "asking_price bigint, revenue_raw string, ebitda_raw string, asking_multiple double, fit_reasons array<string>, "
    "missing_facts array<string>, sector_code string, sector_raw string, canonical_url string"
)
HEALTH = "name string, checked bigint, new_listings bigint, healthy boolean, coverage_complete boolean, error_status string"


def queue(spark, spec):
    rows = [
        (f"l{i}", "promising" if kind == "p" else "needs_information", T0 + timedelta(days=i), None if i == 0 else f"T{i}", "", "VIC" if i % 2 else None,
         1_250_000 if i else 0, "$1m" if i else "", None, 3.0 if i else None, ["a", "b", "c", "d"], [] if i else ["m1", "m2", "m3"], "fire_safety" if i else None, None, f"u{i}")
        for i, kind in enumerate(spec)
    ]
    return spark.createDataFrame(rows, COLS)


@pytest.fixture
def health(spark):
    return spark.createDataFrame([("b", 3, 1, True, True, None), ("a", 0, 0, False, False, "x")], HEALTH)


def text(spark, q, health, **kw):
    return digest.digest_text(digest.top_entries(q), digest.backlog_size(q), health, "2024-05-09", **kw).first().text


def test_full_digest(spark, health):
    q = queue(spark, "nnpppnn")
    lines = text(spark, q, health).split("\n")
    assert lines[0] == "*Listing digest — 2024-05-09*"
    assert lines[1] == "Sources: a ✗ (0 checked, 0 new ⚠️ partial) · b ✓ (3 checked, 1 new)"
    assert lines[2] == "" and lines[3] == "*🟢 Promising*"
    heads = [x for x in lines if " · " in x and x.startswith("*T")]
    assert [h.split(" ")[0] for h in heads] == ["*T4", "*T3", "*T2", "*T6", "*T5"]
    assert lines[5] == "*T4 · Location unknown · Asking $1.3m*"
    assert lines[6] == "Revenue: $1m | EBITDA: not disclosed | Multiple: 3x (advertised)"
    assert lines[7] == "*Why look:* a; b; c" and lines[8].startswith("*Next:* Request information memorandum; check FPAS")
    assert lines[9] == "<u4|View listing>"
    assert "*🟡 Needs information*" in lines and lines[-2:] == ["", "_2 additional listings pending. Ask to show all._"]


def test_sections_share_the_size(spark):
    rows = digest.ranked(digest.top_entries(queue(spark, "npnppnp"))).orderBy("place").collect()
    assert [(r.section, r.id) for r in rows] == [("promising", "l6"), ("promising", "l4"), ("promising", "l3"), ("promising", "l1"), ("needs_information", "l5")]


def test_single_and_empty(spark, health):
    one = text(spark, queue(spark, "n"), health)
    assert "*Untitled listing · Location unknown · Price undisclosed*" in one and "pending" not in one
    assert "*Check:* m1; m2" in one and "*🟢" not in one and "Multiple: n/a" in one
    none = text(spark, queue(spark, "n").limit(0), health)
    assert none.split("\n")[3] == "_No new candidates meeting criteria today._"
    six = text(spark, queue(spark, "nnnnnn"), health)
    assert six.endswith("_1 additional listing pending. Ask to show all._")


def test_backlog_is_the_rest(spark):
    q = queue(spark, "nnpppnn")
    top = {r.id for r in digest.top_entries(q).collect()}
    rest = [r.id for r in digest.backlog(q).collect()]
    assert rest == ["l1", "l0"] and not top & set(rest)
    assert tuple(digest.backlog_size(q).first()) == (7, 2)


def test_state_preference(spark):
    q = queue(spark, "ppp")
    assert [r.id for r in digest.top_entries(q, prefer_states=True).collect()] == ["l1", "l2", "l0"]


def test_empty_reasons(spark):
    rows = [(1, 0, True, None), (0, 2, True, "pending_processing"), (0, 0, False, "incomplete_coverage"), (0, 0, None, "incomplete_coverage"), (0, 0, True, "no_matches")]
    df = spark.createDataFrame(rows, "q int, w int, c boolean, want string")
    got = df.select(digest.empty_reason(F.col("q"), F.col("w"), F.col("c")).alias("r"), "want").collect()
    assert all(r.r == r.want for r in got)


def test_health_precedence(spark):
    config = spark.createDataFrame([("run", True), ("stored", True), ("neither", True), ("off", False)], "name string, enabled boolean")
    stats = spark.createDataFrame([("run", 5, 2, True, False, None)], HEALTH)
    sources = spark.createDataFrame([("run", 3, True, "x"), ("stored", 0, True, None)], "name string, consecutive_failures bigint, coverage_complete boolean, error_status string")
    got = {r.name: (r.checked, r.healthy, r.coverage_complete) for r in feeds.merge_health(config, stats, sources).collect()}
    assert got == {"run": (5, True, False), "stored": (0, True, True), "neither": (0, False, False)}


def test_inspection_card(spark):
    row = queue(spark, "nn").filter("id = 'l1'").selectExpr(
        "*", "'s' as source", "'1' as source_listing_id", "null as broker_name", "bigint(1234567) as revenue", "bigint(0) as ebitda",
        "'p' as profit_unspecified_raw", "'sum' as description_summary", "'new' as review_state", "timestamp'2024-01-01 20:00:05' as last_fetched",
        "null as criteria_version", "'1.0.0' as extraction_version")
    lines = row.select(digest.inspection_text().alias("t")).first().t.split("\n")
    assert lines[:3] == ["*Inspection: T1*", "🟡 NEEDS INFORMATION", ""]
    assert "*EBITDA:* Not disclosed" in lines and "*Asking price:* $1,250,000" in lines and "*Broker:* Unknown" in lines
    assert "*Profit (unspecified type):* p" in lines and "*Rules matched:* a; b; c; d" in lines
    assert "*Last checked:* 02/01/2024, 7:00:05 AM" in lines and "*Criteria version:* unknown" in lines
