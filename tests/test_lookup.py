"""Look-ups through the listing index equal those over the whole table, and open few folders."""

import re

from pyspark.sql import functions as F

from listwright.operators import requests
from listwright.sources.lookup import ListingIndex
from tests.test_service import ASKED, T0, listings


def answers(asked, rows):
    return sorted(map(str, requests.route_inspections(asked, rows).collect()))


def test_answers_through_the_index(spark, tmp_path):
    index = ListingIndex(str(tmp_path / "index"), buckets=8, fanout=2)
    url = "https://www.business2sell.com.au/businesses-details/{}".format
    first = listings(spark, *({"id": f"l{i}", "processing_state": "new", "canonical_url": url(i // 2)} for i in range(40)))
    index.add(first, 0)
    moved = listings(spark, {"id": "l4", "processing_state": "done", "canonical_url": url("moved"), "last_fetched": T0}, {"id": "l99", "processing_state": "new", "canonical_url": url(3)})
    index.add(moved, 1)
    now = first.filter("id <> 'l4'").unionByName(moved)
    rows = [(0, "l7", None), (1, None, url(2)), (2, None, url("moved")), (3, None, url(3)), (4, "none", None), (5, None, url("new")), (6, None, None), (7, "l4", None)]
    asked = spark.createDataFrame([(*r, T0) for r in rows], ASKED)
    assert answers(asked, index.wanted(asked)) == answers(asked, now)
    assert {r.id: r.processing_state for r in index.of_ids(now.select("id")).collect()} == {r.id: r.processing_state for r in now.collect()}


def test_a_look_up_reads_a_fraction_of_the_folders(spark, tmp_path):
    index = ListingIndex(str(tmp_path / "index"), buckets=32)
    index.add(listings(spark, *({"id": f"l{i}", "processing_state": "new"} for i in range(300))), 0)
    asked = spark.createDataFrame([("l5",), ("l6",)], "id string")
    found = index.of_ids(asked)
    read = [int(n) for n in re.findall(r"InMemoryFileIndex\((\d+) paths\)", found._jdf.queryExecution().executedPlan().toString())]
    assert sum(read) <= 2 < 32 == len(index.by_id.paths(spark)) and {r.id for r in found.collect()} == {"l5", "l6"}
    # Rows of a folder lie in key order, so that row groups can be skipped as well.
    part = spark.read.parquet(index.by_id.paths(spark)[0])
    ids = [r.id for r in part.select("id", F.monotonically_increasing_id().alias("n")).orderBy("n").collect()]
    assert ids == sorted(ids)
