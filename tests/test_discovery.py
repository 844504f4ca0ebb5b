"""Page explosion and pagination against plain loops."""

import json
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from listwright import config as C
from listwright.operators import detail, discovery
from listwright.schemas import PAGES
from listwright.sources import adapters, feeds

HREF = '<a href="/businesses-details/{s}-{n}.php" aria-label="{t}">'


def cards(spark, html):
    df = spark.createDataFrame([(1, html)], "page_no int, html string")
    return [(r.source_listing_id, r.canonical_url[len(C.CARD_BASE):], r.title, r.asking_price) for r in discovery.cards(df).orderBy("pos").collect()]


def test_cards(spark):
    html = (
        "<html><p>x</p>"
        '<div class="c" data-listing-id="11"><a href="/businesses-details/red-shop-11.php" aria-label="Red   shop">r</a> Asking Price: <b>$1,200</b></div>'
        '<div data-listing-id="12"><span>no link</span></div>' + " " * 600 +
        '<div data-listing-id="x9">decoy</div>'
        '<div data-listing-id="13"><a href="/businesses-details/blue-13.php">b</a></div>'
        '<div data-listing-id="11"><a href="/businesses-details/red-shop-11.php">again</a></div>'
    )
    got = cards(spark, html)
    assert [g[0] for g in got] == ["11", "13", "11"]
    assert got[0] == ("11", "/businesses-details/red-shop-11.php", "Red shop", 1200)
    assert got[1] == ("13", "/businesses-details/blue-13.php", "blue", None)


def test_card_inside_its_link(spark):
    html = "".join(HREF.format(s="shop", n=n, t=f"T{n}") + f'<i data-listing-id="{n}">x</i></a>' for n in (5, 6, 7))
    assert [(n, t) for n, _, t, _ in cards(spark, html)] == [("5", "T5"), ("6", "T6"), ("7", "T7")]


def test_page_opening_with_a_card(spark):
    html = '<i data-listing-id="1"><a href="/businesses-details/a-b-1.php">x</a></i>'
    assert cards(spark, html) == [("1", "/businesses-details/a-b-1.php", "a b", None)]


def test_cards_match_a_plain_search(spark):
    rnd = random.Random(3)
    html = "é" * 40
    for n in range(30):
        html += " " * rnd.randrange(700) + f'<i data-listing-id="{n}">' + "z" * rnd.randrange(1500) + (HREF.format(s="q", n=n, t="t") if n % 3 else "") + "</i>"
    want = []
    marks = [m.start() for m in re.finditer(r'<[^<>]*data-listing-id="\d+"', html)]
    for i, m in enumerate(re.finditer(r'data-listing-id="(\d+)"', html)):
        end = marks[i + 1] if i + 1 < len(marks) else len(html)
        lead = re.search(r"<[^<>]*>\s*$", html[(marks[i - 1] if i else 0): marks[i]])
        own = html[marks[i]: end]
        links = re.findall(r'href="(/businesses-details/[^"]+)"', (lead.group(0) if lead else "") + own)
        mine = [x for x in links if x.endswith(f"-{m.group(1)}.php")]
        inner = re.findall(r'href="(/businesses-details/[^"]+)"', own)
        pick = (mine or inner or [None])[0]
        if pick:
            want.append((m.group(1), pick))
    assert [(n, p) for n, p, _, _ in cards(spark, html)] == want


def test_long_cards(spark):
    image = '<img src="data:' + "A" * 1500 + '">'
    html = f'<i data-listing-id="4">{image}<a href="/businesses-details/a-4.php">x</a>{image}Asking Price: $5,000</i>'
    assert cards(spark, html) == [("4", "/businesses-details/a-4.php", "a", 5000)]


def test_links_some_tags_before_their_cards(spark):
    html = "".join(
        f'<h3><a href="/businesses-details/{s}.php"{label}>x</a></h3><p>Asking Price: ${p}</p><button data-listing-id="{n}">save</button>'
        for n, s, label, p in ((1, "a-1", "", "100"), (2, "b-2", ' aria-label="B"', "200"), (3, "c-d-3", "", "300")))
    assert cards(spark, html) == [
        ("1", "/businesses-details/a-1.php", "a", 100), ("2", "/businesses-details/b-2.php", "B", 200), ("3", "/businesses-details/c-d-3.php", "c d", 300)]


def test_links_apart_from_their_cards(spark):
    links = "".join(f'<a href="/businesses-details/s-{n}.php">x</a>' for n in (1, 2, 11)) + "-" * 3000
    html = links + "".join(f'<i data-listing-id="{n}">x</i>' for n in (1, 2, 11, 12)) + '<a href="/businesses-details/t-2.php">y</a>'
    assert [(n, p) for n, p, _, _ in cards(spark, html)] == [(n, f"/businesses-details/s-{n}.php") for n in ("1", "2", "11")]


def test_an_inner_link_without_a_number(spark):
    html = '<i data-listing-id="1"><a href="/businesses-details/b-2.php">next</a><a href="/businesses-details/own">x</a></i><i data-listing-id="2">'
    assert [(n, p) for n, p, _, _ in cards(spark, html)] == [("1", "/businesses-details/own"), ("2", "/businesses-details/b-2.php")]


def test_item_lists(spark):
    def block(x):
        return f'<script nonce="1" type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>'

    base = "https://bsale.com.au/listing/"
    good = {"@context": "c", "@type": "ItemList", "itemListElement": [
        {"position": 1, "url": base + "barber-vic-687990"}, {"url": base + "cafe-12/"}, {"url": base + "no-number"},
        {"url": "https://bsale.com.au/other/a-1"}, {"position": 9}]}
    html = block({"@type": "Organization"}) + block("{broken") + block(good) + block({"@type": "ItemList"})
    df = spark.createDataFrame([("wa", html)], "state string, html string")
    got = [(r.source_listing_id, r.title, r.location_state) for r in discovery.item_lists(df).orderBy("pos").collect()]
    assert got == [("687990", "Barber Vic", "VIC"), ("12", "Cafe", "WA")]


def crawl(pages, seen):
    """The page-by-page loop: stop at a failed page, an empty one, or one without news."""
    kept = []
    for no in sorted(pages):
        ok, ids = pages[no]
        fresh = [(no, pos, i) for pos, i in enumerate(ids) if i not in seen]
        new = []
        for no_, pos, i in fresh:
            if i not in seen:
                seen.add(i)
                new.append((no_, pos, i))
        if not ok or not new:
            break
        kept += new
    return kept


def random_feed(rnd, n_pages=12, ids=40):
    return {no: (rnd.random() > 0.07, [str(rnd.randrange(ids)) for _ in range(rnd.randrange(0, 7))]) for no in range(1, n_pages + 1)}


def as_frames(spark, feeds_):
    stubs = [(f, s, i, no, pos) for (f, s), pages in feeds_.items() for no, (ok, ids) in pages.items() if ok for pos, i in enumerate(ids)]
    listed = [(f, s, no, ok) for (f, s), pages in feeds_.items() for no, (ok, _) in pages.items()]
    return (
        spark.createDataFrame(stubs, "source string, state string, source_listing_id string, page_no int, pos int"),
        spark.createDataFrame(listed, "source string, state string, page_no int, ok boolean"),
    )


@pytest.mark.parametrize("seed", range(5))
def test_cut_off_equals_crawl(spark, seed):
    rnd = random.Random(seed)
    all_feeds = {(f, "-"): random_feed(rnd) for f in "abc"}
    # A failed page hides its rows from a crawl; keep failures at pages whose rows are absent.
    stubs, pages = as_frames(spark, all_feeds)
    got = {(r.source, r.page_no, r.pos, r.source_listing_id) for r in discovery.discovered(stubs, pages).collect()}
    want = {(f, *k) for (f, _), p in all_feeds.items() for k in crawl(p, set())}
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_states_share_seen_ids(spark, seed):
    rnd = random.Random(seed)
    all_feeds = {("x", s): random_feed(rnd, 6, 25) for s in C.FEED_STATES[:4]}
    seen, want = set(), set()
    for s in C.FEED_STATES[:4]:
        # Ids past a state's end stay unseen.
        mine = set(seen)
        kept = crawl(all_feeds[("x", s)], mine)
        want |= {(s, *k) for k in kept}
        seen |= {k[2] for k in kept}
    stubs, pages = as_frames(spark, all_feeds)
    got = {(r.state, r.page_no, r.pos, r.source_listing_id) for r in discovery.discovered_by_state(stubs, pages, C.FEED_STATES[:4]).collect()}
    assert got == want


def test_coverage(spark):
    rows = [("full", 1, 200), ("full", 2, 200), ("limit", 1, 200), ("limit", 2, 200), ("down", 1, 500), ("gone", 1, 200), ("gone", 2, 404)]
    pages = spark.createDataFrame([(*r, 2 if r[0] == "limit" else 9) for r in rows], "source string, page_no int, http_status int, limit_page int")
    cuts = spark.createDataFrame([("full", 2), ("limit", None), ("down", 1), ("gone", 2)], "source string, cut int")

    def run(**kw):
        return {r.source: (r.coverage_complete, r.success, r.next_checkpoint) for r in discovery.coverage(pages, cuts, **kw).collect()}

    got = run(missing_page_ends=True)
    assert got == {"full": (True, True, None), "limit": (False, True, "3"), "down": (False, False, "1"), "gone": (True, True, None)}
    assert run()["gone"] == (False, True, "2")


def test_frontier(spark):
    base = feeds.default_feeds(spark)
    points = spark.createDataFrame([(C.CARD_FEED, "11"), (C.ITEM_FEED, "6:2")], "name string, checkpoint string")
    rows = discovery.frontier(base.join(points, "name")).collect()
    assert sorted(r.page_no for r in rows if r.source == C.CARD_FEED) == [1, *range(11, 21)]
    items = sorted((r.state, r.page_no, r.url) for r in rows if r.source == C.ITEM_FEED)
    assert [i[:2] for i in items] == [("act", 2), ("act", 3), ("nt", 1), ("nt", 2), ("nt", 3)]
    assert items[0][2] == C.ITEM_SEARCH + "/act/page-2" and items[2][2] == C.ITEM_SEARCH + "/nt"


DETAIL_A = """<html><h1>Fish &amp; Chips</h1><table><tr><td>Asking Price:</td><td>$450,000</td></tr>
<tr><td>Sales revenue:</td><td>$1.2m p.a.</td></tr><tr><td>Net profit:</td><td>Undisclosed</td></tr></table>
<p>Business Category <span>Food</span></p><p>Location: North Bay, Queensland 4000</p><div>Broker: Ann Lee</div><p>Email us</p></html>"""
DETAIL_B = """<html><h1>Joe&#39;s &quot;Barber&quot;</h1><div>Sold</div><div>$40,000 + SAV</div><p>Parkdale, Victoria 3195</p>
<dl><dt>Turnover:</dt><dd>Not disclosed</dd><dt>Net Profit:</dt><dd>$2,000 pw</dd></dl><div>Private Seller</div></html>"""


def test_details(spark):
    landed = spark.createDataFrame(
        [("a", C.CARD_FEED, 200, DETAIL_A), ("b", C.ITEM_FEED, 200, DETAIL_B), ("c", C.ITEM_FEED, 404, DETAIL_B)],
        "id string, source string, http_status int, html string")
    got = {r.id: r for r in adapters.union_details(landed).collect()}
    a, b = got["a"], got["b"]
    assert set(got) == {"a", "b"}
    assert (a.title, a.location_suburb, a.location_state, a.sector_raw, a.broker_name) == ("Fish   Chips", "North Bay", "QLD", "Food", "Ann Lee")
    assert (a.asking_price, a.revenue_raw, a.profit_raw) == (450000, "$1.2m p.a.", "Undisclosed")
    assert (b.title, b.location_suburb, b.location_state, b.broker_name) == ("Joe's \"Barber\"", "Parkdale", "VIC", "Private Seller")
    assert (b.asking_price, b.revenue_raw, b.profit_raw, b.advertised_status) == (40000, None, "$2,000 pw", "sold")


def test_names_and_status_stay_on_their_line(spark):
    rows = [
        ("a", "<p>Private Seller</p><p>Contact this seller</p><p>We sold 40 units, unsold stock included.</p>"),
        ("b", "<p>Broker: Ann Lee</p><p>Under contract</p>"), ("c", "<p>Broker</p><p>Great views</p>"), ("d", "<p>Broker Bo Ek Phone 1</p>")]
    found = detail.item_details(spark.createDataFrame(rows, "id string, html string")).collect()
    got = {r.id: (r.broker_name, r.advertised_status) for r in found}
    assert got == {"a": ("Private Seller", None), "b": ("Ann Lee", "under contract"), "c": (None, None), "d": ("Bo Ek", None)}


def test_overlay_prefers_stated(spark):
    cols = "id string, title string, location_state string, location_suburb string, sector_raw string, broker_name string, asking_price bigint"
    old = spark.createDataFrame([("a", "old", "VIC", None, "s", "b", 1), ("z", "z", None, None, None, None, None)], cols)
    new = spark.createDataFrame([("a", "new", None, "sub", None, None, 2)], cols)
    got = {r.id: tuple(r)[1:] for r in detail.overlay(old, new).collect()}
    assert got == {"a": ("new", "VIC", "sub", "s", "b", 2), "z": ("z", None, None, None, None, None)}


def test_feeds_are_united(spark):
    card = '<i data-listing-id="1"><a href="/businesses-details/a-1.php">x</a></i>'
    item = '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"url":"https://bsale.com.au/listing/b-2"}]}</script>'
    at = datetime(2024, 1, 1)
    landed = spark.createDataFrame([(C.CARD_FEED, None, 1, "u", at, 200, card), (C.ITEM_FEED, "vic", 1, "u", at, 200, item), (C.ITEM_FEED, "vic", 2, "u", at, 500, item)], PAGES)
    got = {(r.source, r.source_listing_id, r.seen_at) for r in adapters.union_feeds(landed).collect()}
    assert got == {(C.CARD_FEED, "1", at), (C.ITEM_FEED, "2", at)}


def test_feed_config(spark, tmp_path):
    doc = {"sources": [{"name": "a", "adapter": "cards", "baseUrl": "b", "searchUrl": "s", "pollIntervalMinutes": 5, "maxPages": 2, "enabled": True}, {"name": "c", "enabled": False}], "sources_not_viable": [{"name": "z"}]}
    (tmp_path / "f.json").write_text(json.dumps(doc, indent=1))
    got = {r.name: r for r in feeds.read_feeds(spark, str(tmp_path / "f.json")).collect()}
    assert got["a"].poll_interval_minutes == 5 and got["c"].enabled is False and set(got) == {"a", "c"}
    assert feeds.default_feeds(spark).filter(F.col("enabled")).count() == 2
