"""Likely duplicates against comparing all pairs in plain Python."""

import random
import re

import pytest

from listwright.functions.groups import linked_groups
from listwright.operators import duplicates
from listwright.operators.duplicates import Likeness
from listwright.schemas import LISTINGS, conform

ROWS = "id string, source string, broker_ref string, title string, location_state string, asking_price bigint"
TITLES = ["Commercial Cleaning Contracts", "Fire Safety Services North", "Electrical Maintenance Group", "Cafe & Bakery", "Swim School 12", "Swim School 13"]


def parts(title):
    words = re.sub("[^a-z0-9]+", " ", (title or "").lower()).split()
    plain = [f"^{w}$" for w in words if not re.search("[0-9]", w)]
    return {w[i : i + 3] for w in plain for i in range(len(w) - 2)}, sorted(w for w in words if re.search("[0-9]", w))


def brute(rows, cfg):
    """Every listing of a possible group: (id, group, size)."""
    usable = [(r, *parts(r[3])) for r in rows if r[4] is not None and r[5] is not None and r[5] >= 0 and parts(r[3])[0]]
    low = [r[0] for r, *_ in usable]

    def linked(x, y):
        (a, s, n), (b, t, m) = x, y
        both = len(s & t)
        return a[4] == b[4] and n == m and 100 * abs(a[5] - b[5]) <= cfg.apart * max(a[5], b[5]) and 100 * both >= cfg.alike * (len(s) + len(t) - both)

    near = [[j for j, y in enumerate(usable) if linked(x, y)] for x in usable]
    while True:
        new = [min(low[j] for j in near[i]) for i in range(len(usable))]
        if new == low:
            break
        low = new
    out = set()
    for name in set(low):
        own = [r for (r, *_), g in zip(usable, low, strict=True) if g == name]
        if len({r[1] for r in own}) > 1:
            out |= {(r[0], name, len(own)) for r in own}
    return out


def edited(rnd, title):
    i = rnd.randrange(len(title))
    return rnd.choice([title, title[:i] + title[i + 1 :], title[:i] + rnd.choice("abcxyz") + title[i:], title.upper(), " ".join(reversed(title.split()))])


def made(seed, n, titles=TITLES, prices=40):
    rnd = random.Random(seed)
    return [
        (f"{i:04}", rnd.choice("abc"), None, rnd.choice([edited(rnd, rnd.choice(titles)), edited(rnd, edited(rnd, rnd.choice(titles)))]),
         rnd.choice(["VIC", "NSW", None]), rnd.choice([None, 0, 100_000 + 1_000 * rnd.randrange(prices)]))
        for i in range(n)
    ]


@pytest.mark.parametrize("cfg", [Likeness(), Likeness(alike=50, apart=20), Likeness(few=1, tile=3), Likeness(few=0, tile=1000)])
def test_possible_groups_against_all_pairs(spark, cfg):
    rows = made(5, 160)
    got = duplicates.likely_duplicates(spark.createDataFrame(rows, ROWS).repartition(4), cfg).collect()
    assert {r.kind for r in got} == {"possible"}
    assert {(r.id, r.group_id, r.n_listings) for r in got} == brute(rows, cfg) and len(got) == len({r.id for r in got})


def test_a_chain_of_edits_and_prices(spark):
    price = 100_000
    rows = [("r", "a", None, "harbour view motel", "SA", price)]
    for i in range(12):
        price = int(price * 1.045)
        rows.append((f"r{i:02}", "ab"[i % 2], None, "harbour view motel" + "x" * (i % 3), "SA", price))
    rows.append(("z", "b", None, "harbour view motel", "SA", 10 * price))
    got = {(r.id, r.group_id, r.n_listings) for r in duplicates.likely_duplicates(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == brute(rows, Likeness()) == {(r[0], "r", 13) for r in rows[:-1]}


def test_one_large_group_costs_links_as_its_titles(spark):
    """A third of all listings are one title, another hot block holds many near ones: no pairs are written."""
    rnd = random.Random(3)
    word = "consolidated industrial refrigeration maintenance contractors"
    rows = [(f"{i:05}", "ab"[i % 2], None, "Same Title Cafe", "VIC", 500) for i in range(2000)]
    rows += [(f"n{i:05}", "ab"[i % 2], None, edited(rnd, edited(rnd, edited(rnd, word))), "QLD", 500) for i in range(1200)]
    df = spark.createDataFrame(rows, ROWS)
    cfg = Likeness(few=16, tile=64)
    _, classes = duplicates._classes(df, cfg)
    n = classes.count()
    links = duplicates.alike_links(duplicates._by_rarity(classes), cfg).filter("a <> b").distinct().count()
    got = duplicates.likely_duplicates(df, cfg).groupBy("group_id", "n_listings").count().collect()
    assert n < 1500 and links < 40 * n
    assert sorted((r.group_id, r.n_listings, r["count"]) for r in got) == [("00000", 2000, 2000), ("n00000", 1200, 1200)]


@pytest.mark.parametrize("cfg", [Likeness(), Likeness(few=1, tile=8)])
def test_many_prices_of_alike_titles_cost_chains(spark, cfg):
    """Chains of prices of alike titles overlap, touch and stay apart; titles are compared once."""
    rnd = random.Random(11)
    titles = ["coastal bakery and catering", "coastal bakery and caterin", "coastal bakeryx and catering", "northern motel"]
    rows = [(f"{i:04}", rnd.choice("ab"), None, rnd.choice(titles), "VIC", int(1000 * 1.03 ** rnd.randrange(400))) for i in range(260)]
    rows += [(f"d{i:03}", rnd.choice("ab"), None, rnd.choice(titles), "SA", 1000 + 2 * i) for i in range(240)]
    rows += [("e1", "a", None, titles[0], "WA", 0), ("e2", "b", None, titles[1], "WA", 0), ("e3", "b", None, titles[1], "WA", 1)]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    _, classes = duplicates._classes(df, cfg)
    links = duplicates.alike_links(duplicates._by_rarity(classes.filter("block LIKE 'SA%'")), cfg).distinct().count()
    got = {(r.id, r.group_id, r.n_listings) for r in duplicates.likely_duplicates(df, cfg).collect()}
    assert classes.count() == 10 and links <= 3
    assert got == brute(rows, cfg)


def test_strong_groups_on_the_listing_table(spark):
    rows = [("1", "x", "Ref 7", "Cafe", "VIC", 10), ("2", "y", "ref-7", "Bar", "VIC", 11), ("3", "x", "", "p", "SA", 1), ("4", "y", " - ", "q", "SA", 1),
            ("5", "x", "9", "p", None, 1), ("6", "x", "9", "p", "SA", None)]
    table = conform(spark.createDataFrame(rows, ROWS), LISTINGS)
    got = duplicates.likely_duplicates(table).collect()
    assert {(r.id, r.kind, r.group_id, r.n_listings) for r in got} == {("1", "strong", "1", 2), ("2", "strong", "1", 2)}
    assert duplicates.likely_duplicates(table.limit(0)).count() == 0


def test_linked_groups(spark):
    links = [("c", "a"), ("c", "b"), ("i", "h"), ("h", "g"), ("g", "f"), ("z", "z")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)]
    got = {r.node: r.group_id for r in linked_groups(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {**dict.fromkeys("abc", "a"), **dict.fromkeys("fghi", "f"), **{f"n{i:03}": "n000" for i in range(41)}}
