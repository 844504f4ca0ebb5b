"""Streams give what one batch gives, however the input is cut, also when replayed."""

import os
import random
import shutil
from datetime import datetime, timedelta

import __spark_entry__ as entry
from pyspark.sql import functions as F

from listwright import config as C
from listwright.operators import feeds, state
from listwright.schemas import ACTIVITY, PAGES, SOURCES, STUBS
from listwright.sources import adapters, snapshots
from listwright.sources.feeds import stream_pages
from listwright.streaming import jobs

T0 = datetime(2024, 1, 1)


def rows(n=200, seed=1):
    rnd = random.Random(seed)
    out = []
    for seq in range(n):
        number = "hot" if rnd.random() < 0.4 else str(rnd.randrange(20))
        maybe = lambda v: v if rnd.random() < 0.5 else None
        out.append(("s", number, f"u{seq}", maybe(f"t{seq}"), maybe(seq), maybe("VIC"), maybe(f"x{seq}"), maybe("c"), maybe(f"b{seq}"), maybe("sold"), T0 + timedelta(minutes=rnd.randrange(30)), seq))
    return out


def land(spark, folder, data, schema, parts):
    # One file per part; file times decide the order in which a stream meets them.
    for i in range(parts):
        part = spark.createDataFrame(data[i::parts], schema).coalesce(1)
        part.write.mode("append").parquet(folder)


def as_set(df):
    return sorted(map(str, df.collect()))


def test_upsert_stream_equals_batch(spark, tmp_path):
    folder, root, marks = (str(tmp_path / x) for x in ("in", "state", "marks"))
    data = rows()
    land(spark, folder, data, STUBS, 4)
    stream = spark.readStream.schema(STUBS).option("maxFilesPerTrigger", 1).parquet(folder)
    out = jobs.upsert_stream(stream, root, marks, compact_every=2)
    want = state.fold_sightings(spark.createDataFrame(data, STUBS))
    assert as_set(out.select(sorted(out.columns))) == as_set(want.select(sorted(want.columns)))
    assert snapshots.versions(spark, root + "/delta") == [0, 1, 2, 3]
    assert snapshots.versions(spark, root + "/base") == [1, 3]
    # Forget the last commit, as after a crash between write and commit, and run again.
    for name in ("commits/3", "commits/.3.crc"):
        path = os.path.join(marks, name)
        if os.path.exists(path):
            os.rename(path, str(tmp_path / name.replace("/", "-")))
    again = jobs.upsert_stream(stream, root, marks, compact_every=2)
    assert as_set(again.select(sorted(again.columns))) == as_set(want.select(sorted(want.columns)))


def test_versions_need_success(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.range(3).select(F.col("id").cast("string").alias("name"))
    snapshots.write_version(df, root, 1)
    snapshots.write_version(df.limit(1), root, 2)
    shutil.move(os.path.join(root, "v=2", "_SUCCESS"), str(tmp_path / "mark"))
    assert snapshots.versions(spark, root) == [1]
    assert snapshots.read_latest(spark, root, df.schema).count() == 3
    assert snapshots.read_latest(spark, root, df.schema, before=1).count() == 0


def test_run_log_stream_equals_batch(spark, tmp_path):
    folder, root, marks = (str(tmp_path / x) for x in ("in", "state", "marks"))
    rnd = random.Random(2)
    schema = "source string, ts timestamp, seq bigint, ok boolean, discovered bigint, checkpoint string, coverage_complete boolean"
    data = [(rnd.choice("ab"), T0 + timedelta(minutes=i), i, rnd.random() < 0.3, i, None, True) for i in range(60)]
    for i in range(3):
        spark.createDataFrame(data[i * 20:(i + 1) * 20], schema).coalesce(1).write.mode("append").parquet(folder)
    base = [tuple({"name": n, "consecutive_failures": 2}.get(f.name) for f in SOURCES.fields) for n in "abc"]
    sources = spark.createDataFrame(base, SOURCES)
    frame = spark.createDataFrame(data, schema)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = jobs.run_log_stream(stream, sources, root, marks)
    assert as_set(out) == as_set(feeds.apply_runs(sources, frame))


def test_discovery_stream(spark, tmp_path):
    folder, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    card = '<i data-listing-id="{0}"><a href="/businesses-details/a-{0}.php">x</a></i>'
    data = [(C.CARD_FEED, None, n, "u", T0, 200, card.format(n) + card.format(n + 100)) for n in range(1, 7)]
    land(spark, folder, data, PAGES, 3)
    found = jobs.discovery_stream(stream_pages(spark, folder, 1), adapters.union_feeds, out, marks)
    assert {r.source_listing_id for r in found.collect()} == {str(n) for b in (0, 100) for n in range(b + 1, b + 7)}


def test_delivery_stream_sends_once(spark, tmp_path):
    folder, root, box, marks = (str(tmp_path / x) for x in ("in", "log", "box", "marks"))
    land(spark, folder, [("a", "u1"), ("b", "u2"), ("a", "u1"), ("c", "u3")], "id string, canonical_url string", 2)
    stream = spark.readStream.schema("id string, canonical_url string").option("maxFilesPerTrigger", 1).parquet(folder)
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    log = jobs.delivery_stream(stream, root, box, marks, now)
    assert {(r.event_key, r.delivery_state) for r in log.collect()} == {(f"digest:2024-05-01:{i}", "confirmed") for i in "abc"}
    sent = spark.read.option("basePath", box).parquet(box)
    assert sorted(r.event_key for r in sent.collect()) == [f"digest:2024-05-01:{i}" for i in "abc"]
    again = jobs.delivery_stream(stream, root, box, str(tmp_path / "marks2"), now)
    assert again.count() == 3


def test_activity_written_again(spark, tmp_path):
    path = str(tmp_path / "activity")
    assert snapshots.read_activity(spark, path).count() == 0

    def events(*keys):
        return spark.createDataFrame([tuple({"id": k, "event_key": k, "created_at": T0}.get(f.name) for f in ACTIVITY.fields) for k in keys], ACTIVITY)

    for run, keys in (("2024-01-01T00", "ab"), ("2024-01-01T04", "c"), ("2024-01-01T00", "ab")):
        snapshots.write_activity(events(*keys), path, run)
    got = snapshots.read_activity(spark, path)
    assert got.columns == ACTIVITY.fieldNames() and sorted(r.event_key for r in got.collect()) == ["a", "b", "c"]


def test_registered_stream_reads_pages_by_their_adapters(spark):
    found = entry.queries()["stream_feed_union"](spark, "/root/testdata/sf0.001")
    batch = entry.queries()["feed_union"](spark, "/root/testdata/sf0.001")
    assert as_set(found) == as_set(batch)
    assert {r.source for r in found.collect()} == {C.CARD_FEED, C.ITEM_FEED}
