"""The keyed table: same rows as one fold, bounded folders, replays, lookups that open few folders."""

import os
import random
import shutil

from pyspark.sql import functions as F

from listwright.operators import state
from listwright.schemas import STUBS
from listwright.sources import snapshots
from listwright.sources.keyed import KeyedTable
from listwright.streaming import jobs
from tests.test_streaming import T0, as_set, land, rows

SCHEMA = "k string, n long, last long"


def counted(df):
    return df.groupBy("k").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def table_at(spark, path, **layout):
    return KeyedTable(str(path), spark.createDataFrame([], SCHEMA).schema, ("k",), counted, **{"buckets": 4, "fanout": 3, "levels": 2} | layout)


def batch(spark, version, rnd, keys=30, size=12):
    data = [(f"k{rnd.randrange(keys)}", 1, version) for _ in range(size)]
    return data, spark.createDataFrame(data, SCHEMA).coalesce(1)


def folded(data):
    out = {}
    for k, n, last in data:
        m, before = out.get(k, (0, -1))
        out[k] = m + n, max(last, before)
    return sorted((k, *v) for k, v in out.items())


def held(path):
    return sum(name.endswith(".parquet") for _, _, names in os.walk(path) for name in names)


def test_many_batches_leave_few_folders(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    table, rnd, said, opened, kept = table_at(spark, tmp_path / "t"), random.Random(1), [], [], []
    for version in range(40):
        data, df = batch(spark, version, rnd)
        table.append(df, version)
        said += data
        opened.append(len(table.paths(spark)))
        kept.append(held(tmp_path / "t"))
        if version % 9 in (0, 7, 8):
            assert sorted(map(tuple, table.rows(spark).collect())) == folded(said)
    # A bound that does not know how many batches there were: the base and two levels of two runs each.
    assert max(opened) <= 4 * (1 + 2 + 2) and opened[39] <= opened[10] and max(kept[30:]) <= max(kept[20:30]) <= 4 * 12
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table, rnd, said = table_at(spark, tmp_path / "t", fanout=2), random.Random(2), []
    for version in range(9):
        data, df = batch(spark, version, rnd, keys=6)
        said += data
        table.append(df, version)
        first = sorted(map(tuple, table.rows(spark).collect()))
        if version == 5:
            # A crash behind a merge that was not finished: its mark is missing.
            shutil.rmtree(tmp_path / "t" / "L1" / "v=5" / "_SUCCESS", ignore_errors=True)
            os.replace(tmp_path / "t" / "L1" / "v=5" / "_SUCCESS", tmp_path / "mark")
        table.append(df, version)
        assert sorted(map(tuple, table.rows(spark).collect())) == first == folded(said)


def test_a_lookup_opens_the_folders_of_its_keys(spark, tmp_path):
    table = table_at(spark, tmp_path / "t", buckets=16, fanout=2, levels=1)
    for version in range(2):
        table.append(spark.createDataFrame([(f"k{i}", 1, version) for i in range(300)], SCHEMA), version)
    keys = spark.createDataFrame([("k7",), ("k7",), ("nobody",)], "k string")
    hit = table.touched(keys)
    assert len(table.paths(spark, hit)) == len(hit) <= 2 and len(table.paths(spark)) == 16
    assert [tuple(r) for r in table.lookup(keys).collect()] == [("k7", 2, 1)]
    read = table.rows(spark, hit)._jdf.queryExecution().executedPlan().toString()
    assert f"InMemoryFileIndex({len(hit)} paths)" in read
    assert table.lookup(keys.limit(0)).count() == 0 and table.lookup(keys, before=0).count() == 0


def test_keyed_upsert_equals_one_fold(spark, tmp_path):
    folder, marks = str(tmp_path / "in"), str(tmp_path / "marks")
    data = rows()
    land(spark, folder, data, STUBS, 7)
    table = jobs.sightings_table(str(tmp_path / "state"), buckets=3, fanout=2, levels=2)
    stream = spark.readStream.schema(STUBS).option("maxFilesPerTrigger", 1).parquet(folder)
    out = jobs.upsert_keyed_stream(stream, table, marks)
    want = state.fold_sightings(spark.createDataFrame(data, STUBS))
    assert as_set(out.select(sorted(out.columns))) == as_set(want.select(sorted(want.columns)))
    os.replace(os.path.join(marks, "commits", "6"), str(tmp_path / "commit"))
    if os.path.exists(os.path.join(marks, "commits", ".6.crc")):
        os.replace(os.path.join(marks, "commits", ".6.crc"), str(tmp_path / "crc"))
    again = jobs.upsert_keyed_stream(stream, table, marks)
    assert as_set(again.select(sorted(again.columns))) == as_set(want.select(sorted(want.columns)))


def test_keyed_deliveries_are_sent_once(spark, tmp_path):
    folder, box = str(tmp_path / "in"), str(tmp_path / "box")
    schema = "id string, canonical_url string"
    land(spark, folder, [("a", "u1"), ("b", "u2"), ("a", "u1"), ("c", "u3"), ("b", "u2"), ("d", "u4")], schema, 3)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    table = jobs.deliveries_table(str(tmp_path / "log"), buckets=2, fanout=2)
    log = jobs.delivery_keyed_stream(stream, table, box, str(tmp_path / "marks"), now)
    assert {(r.event_key, r.delivery_state) for r in log.collect()} == {(f"digest:2024-05-01:{i}", "confirmed") for i in "abcd"}
    sent = spark.read.option("basePath", box).parquet(box)
    assert sorted(r.event_key for r in sent.collect()) == [f"digest:2024-05-01:{i}" for i in "abcd"]


def test_purged_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    for v in range(5):
        snapshots.write_version(spark.range(v + 1), root, v)
        snapshots.purge(spark, root)
    assert snapshots.versions(spark, root) == [3, 4]
