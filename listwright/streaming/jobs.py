"""Incremental jobs: micro-batches folded into versioned snapshots.

Every job writes under its batch id and reads only what older batches wrote, so a batch
that is replayed after a lost executor or a restart replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from listwright.operators import digest, feeds, state
from listwright.schemas import ACTIVITY, SOURCES
from listwright.session import written
from listwright.sources import snapshots
from listwright.sources.keyed import KeyedTable

_KEYED = "struct<seen_at:timestamp,seq:bigint,value:{}>"
_KINDS = {c: "string" for c in state.LATEST} | {"asking_price": "bigint"}


def sighting_state_schema() -> T.StructType:
    kinds = {"first": _KEYED.format("string"), "url": _KEYED.format("string")}
    kinds |= {c: _KEYED.format(k) for c, k in _KINDS.items()}
    text = "source string, source_listing_id string, first_seen timestamp, last_seen timestamp, "
    return T.StructType.fromDDL(text + ", ".join(f"{c} {k}" for c, k in kinds.items()))


def _as_state(stubs: DataFrame) -> DataFrame:
    def keyed(column: str):
        return F.struct(*state.ORDER, F.col(column).alias("value"))

    return stubs.select(
        *state.KEY,
        F.col("seen_at").alias("first_seen"),
        F.col("seen_at").alias("last_seen"),
        keyed("advertised_status").alias("first"),
        keyed("canonical_url").alias("url"),
        *(F.when(F.col(c).isNotNull(), keyed(c)).alias(c) for c in state.LATEST),
    )


def merge_sightings(states: DataFrame) -> DataFrame:
    """Partial states to one row per listing. Values keep their place in the order, so the
    result does not depend on how sightings were cut into batches."""
    return states.groupBy(*state.KEY).agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min("first").alias("first"),
        F.max("url").alias("url"),
        *(F.max(c).alias(c) for c in state.LATEST),
    )


def sightings_view(st: DataFrame) -> DataFrame:
    return st.select(
        *state.KEY, "first_seen", "last_seen",
        F.col("url.value").alias("canonical_url"),
        F.col("first.value").alias("advertised_status"),
        *(F.col(f"{c}.value").alias(c) for c in state.LATEST),
    )


def _drain(stream: DataFrame, work, checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def upsert_stream(
    stubs: DataFrame, root: str, checkpoint: str, compact_every: int = 16
) -> DataFrame:
    """Fold a stream of stubs into listing sightings; returns the current view.

    A batch writes only its own partial state, so its cost follows the batch and not the
    store. Every ``compact_every`` batches the partial states are merged into a new base.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        snapshots.write_version(merge_sightings(_as_state(batch)), f"{root}/delta", batch_id)
        if (batch_id + 1) % compact_every == 0:
            merged = stored_sightings(spark, root, upto=batch_id)
            snapshots.write_version(merged, f"{root}/base", batch_id)

    _drain(stubs, work, checkpoint)
    return sightings_view(stored_sightings(stubs.sparkSession, root))


def stored_sightings(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """The newest base (one older than ``upto``) and the partial states written after it."""
    schema = sighting_state_schema()
    bases = [v for v in snapshots.versions(spark, f"{root}/base") if upto is None or v < upto]
    last = bases[-1] if bases else -1
    base = snapshots.read_range(spark, f"{root}/base", schema, last - 1, last)
    deltas = snapshots.read_range(spark, f"{root}/delta", schema, last, upto)
    return merge_sightings(base.unionByName(deltas))


def sightings_table(root: str, **layout) -> KeyedTable:
    """Sightings by listing, as a keyed table."""
    return KeyedTable(root, sighting_state_schema(), state.KEY, merge_sightings, **layout)


def upsert_keyed_stream(stubs: DataFrame, table: KeyedTable, checkpoint: str) -> DataFrame:
    """Fold a stream of stubs into a keyed table of sightings; returns the current view.

    A batch writes its own run and merges touch the folders of their keys only, so neither the
    work of a batch nor the number of files grows with the batches there were.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        table.append(_as_state(batch), batch_id)

    _drain(stubs, work, checkpoint)
    return sightings_view(table.rows(stubs.sparkSession))


def discovery_stream(pages: DataFrame, discover, out: str, checkpoint: str) -> DataFrame:
    """Explode newly landed pages into stub rows, one output folder per batch."""

    def work(batch: DataFrame, batch_id: int) -> None:
        discover(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    spark, schema = pages.sparkSession, discover(pages).schema
    # Readable when no page has landed yet.
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/batch=-1")
    _drain(pages, work, checkpoint)
    return spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch=*").drop("batch")


def run_log_stream(runs: DataFrame, sources: DataFrame, root: str, checkpoint: str) -> DataFrame:
    """Fold a stream of feed runs into the feed table; failure streaks span batches."""

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        begun = any(v < batch_id for v in snapshots.versions(spark, root))
        old = snapshots.read_latest(spark, root, SOURCES, before=batch_id) if begun else sources
        snapshots.write_version(feeds.apply_runs(old, batch), root, batch_id)
        snapshots.purge(spark, root)

    _drain(runs, work, checkpoint)
    return snapshots.read_latest(runs.sparkSession, root, SOURCES)


def delivery_log(spark: SparkSession, root: str) -> DataFrame:
    """The log of deliveries with each key in its last state; confirmed outranks pending."""
    return last_states(snapshots.read_range(spark, root, ACTIVITY, -1))


def last_states(rows: DataFrame) -> DataFrame:
    """One row per event key, in its last state."""
    rank = F.when(F.col("delivery_state") == "confirmed", 1).otherwise(0).alias("rank")
    rest = [f.name for f in ACTIVITY.fields if f.name != "event_key"]
    last = rows.groupBy("event_key").agg(F.max(F.struct(rank, *rest)).alias("last"))
    return last.select("event_key", *(f"last.{c}" for c in rest)).select(*ACTIVITY.names)


def delivery_stream(candidates: DataFrame, root: str, outbox: str, checkpoint: str, now) -> DataFrame:
    """Deliver each batch's entries at least once under stable keys.

    Pending rows are written before the outbox and confirmed ones after it, each as rows
    added to the log. A replay rewrites its own rows and outbox folder; entries that older
    batches confirmed are left out.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entries = batch.groupBy("id").agg(F.min("canonical_url").alias("canonical_url"))
        log = snapshots.read_range(spark, root, ACTIVITY, -1, 2 * batch_id - 1)
        todo = entries.join(digest.confirmed_ids(log), "id", "left_anti")
        snapshots.write_version(state.pending_rows(log, todo, now), root, 2 * batch_id)
        key = state.delivery_key(F.col("id"), now)
        text = F.concat(F.lit("<"), F.col("canonical_url"), F.lit("|View listing>"))
        digest.outbox(todo, "digest", key, text).write.mode("overwrite").parquet(f"{outbox}/batch={batch_id}")
        none = spark.createDataFrame([], ACTIVITY)
        sent = state.pending_rows(none, todo, now).withColumns(
            {"delivery_state": F.lit("confirmed"), "message_ref": F.lit("outbox")}
        )
        snapshots.write_version(sent, root, 2 * batch_id + 1)

    _drain(candidates, work, checkpoint)
    return delivery_log(candidates.sparkSession, root)


def deliveries_table(root: str, **layout) -> KeyedTable:
    """The delivery log by listing, as a keyed table; one row per event key."""
    return KeyedTable(root, ACTIVITY, ("listing_id",), last_states, **layout)


def delivery_keyed_stream(candidates: DataFrame, table: KeyedTable, outbox: str, checkpoint: str, now) -> DataFrame:
    """Deliver each batch's entries at least once under stable keys, as ``delivery_stream`` does.

    A batch asks the log for its own listings only, in the folders that can hold them, so its
    work follows the batch and not the log.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entries = batch.groupBy("id").agg(F.min("canonical_url").alias("canonical_url"))
        log = table.lookup(entries.select(F.col("id").alias("listing_id")), before=2 * batch_id)
        todo = written(entries.join(digest.confirmed_ids(log), "id", "left_anti"), "todo")
        key = state.delivery_key(F.col("id"), now)
        pending = state.pending_rows(log, todo, now)
        table.append(pending, 2 * batch_id)
        text = F.concat(F.lit("<"), F.col("canonical_url"), F.lit("|View listing>"))
        digest.outbox(todo, "digest", key, text).write.mode("overwrite").parquet(f"{outbox}/batch={batch_id}")
        none = spark.createDataFrame([], ACTIVITY)
        sent = state.pending_rows(none, todo, now).withColumns(
            {"delivery_state": F.lit("confirmed"), "message_ref": F.lit("outbox")}
        )
        table.append(sent, 2 * batch_id + 1)

    _drain(candidates, work, checkpoint)
    return table.rows(candidates.sparkSession)
