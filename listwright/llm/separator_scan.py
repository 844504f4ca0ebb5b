"""Token counts of documents in flat token files that have no index.

A flat file is a run of little-endian ids in which an end-of-document id closes each document.
Files are read as blocks of a fixed size that cut documents anywhere. Each block is searched
for the id on its own; what documents have in common with earlier blocks is a prefix sum over
one narrow row per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from listwright.llm.frames import shipped, staged
from listwright.llm.tokens import encoder, slices

END = 49407
BLOCK_IDS = 1 << 17

_PARTS = "file string, block long, n_ids long, ends long, head long, tail long, inner array<struct<start:long,n:long>>"


def flat_file_blocks(spark: SparkSession, path: str, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``(file, block, data)`` from raw token files under a path, on any store that Spark reads.

    A file is one row of the reader and so below 2 GB, as token shards commonly are.
    """
    size = block_ids * width
    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", "length")
    count = F.ceil(F.col("length") / size).cast("long")
    cut = whole.filter("length > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return cut.select("file", "block", F.expr(f"substring(content, int(block * {size} + 1), {size})").alias("data"))


def flat_blocks(docs: DataFrame, block_ids: int = BLOCK_IDS, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tokenised documents as flat streams: ``(file, block, data)`` and ``(file, place, doc_id)``.

    Each task writes one stream of 16-bit ids, cut into blocks without regard to documents.
    The strings of special tokens are plain text here, so the end id stands at ends only.
    The second frame says which document stands where; the stream itself does not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file, rest, block, place = encoder(path, ordinary=True), None, np.zeros(0, "<u2"), 0, 0
        for batch in batches:
            at = 0
            if file is None and batch.num_rows:
                file = f"{batch.column(2)[0].as_py():08d}"
            for run_of in slices(batch.column(1).to_pylist()):
                ids, bounds = enc.encode(run_of)
                stream = np.insert(ids, bounds[1:], END).astype("<u2")
                rest = np.concatenate([rest, stream])
                n = len(rest) // block_ids
                data = [rest[i * block_ids : (i + 1) * block_ids].tobytes() for i in range(n)]
                rest = rest[n * block_ids :]
                yield _rows(file, np.arange(block, block + n), data, None, None)
                m = len(run_of)
                yield _rows(file, None, None, np.arange(place, place + m), batch.column(0).slice(at, m))
                block, place, at = block + n, place + m, at + m
        if file is not None and len(rest):
            yield _rows(file, np.array([block]), [rest.tobytes()], None, None)

    schema = "file string, block long, data binary, place long, doc_id long"
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.spark_partition_id().alias("part"))
    both = staged(rows.transform(shipped).mapInArrow(run, schema), "token-streams")
    return (
        both.filter("block is not null").select("file", "block", "data"),
        both.filter("place is not null").select("file", "place", "doc_id"),
    )


def _rows(file, block, data, place, doc_id) -> pa.RecordBatch:
    n = len(block if block is not None else place)
    none = lambda x, kind: pa.nulls(n, kind) if x is None else pa.array(x, kind) if not isinstance(x, pa.Array) else x
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * n, pa.string()), none(block, pa.int64()), none(data, pa.binary()),
         none(place, pa.int64()), none(doc_id, pa.int64())],
        ["file", "block", "data", "place", "doc_id"])


def block_parts(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """One row per block: ids up to its first end, after its last one, and between its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_ids, n_ends, head, tail, starts, inner = [], [], [], [], [], []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_py() or b"", f"<u{width}")
                at = np.flatnonzero(ids == end)
                n_ids.append(len(ids))
                n_ends.append(len(at))
                head.append(int(at[0]) + 1 if len(at) else 0)
                tail.append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
                starts.append(at[:-1] + 1)
                inner.append(np.diff(at))
            whole = lambda x: pa.array(x, pa.int64())
            bounds = np.cumsum([0, *map(len, inner)]).astype(np.int32)
            flat = pa.StructArray.from_arrays(
                [whole(np.concatenate([*x, np.zeros(0, np.int64)])) for x in (starts, inner)], ["start", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), whole(n_ids), whole(n_ends), whole(head), whole(tail),
                 pa.ListArray.from_arrays(pa.array(bounds), flat)],
                ["file", "block", "n_ids", "ends", "head", "tail", "inner"])

    return blocks.select("file", "block", "data").transform(shipped).mapInArrow(run, _PARTS)


def token_counts(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """``(file, place, start, n_tokens, closed)`` for each document of ``blocks(file, block, data)``.

    ``start`` is the id position in the file and ``n_tokens`` counts the end id. What follows
    a file's last end id is a document that is not closed and counts without one. Empty files
    and blocks have no documents, a null block counts as empty, and equal documents count each.
    """
    parts = staged(block_parts(blocks, end, width), "block-parts")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    seen = (
        parts.withColumn("place", F.coalesce(F.sum("ends").over(before), zero))
        .withColumn("at", F.coalesce(F.sum("n_ids").over(before), zero))
        # A block with an end starts a new group of open ids; its tail is the group's first share.
        .withColumn("group", F.sum((F.col("ends") > 0).cast("int")).over(upto))
    )
    open_ids = F.sum("tail").over(Window.partitionBy("file", "group").orderBy("block"))
    carried = seen.withColumn("open", open_ids)
    carry = F.coalesce(F.lag("open").over(order), zero)
    last = F.lead("block").over(order).isNull()
    carried = carried.withColumn("carry", carry).withColumn("last", last)
    first = F.struct((F.col("at") - F.col("carry")).alias("start"), (F.col("carry") + F.col("head")).alias("n"))
    others = F.transform("inner", lambda x: F.struct((F.col("at") + x["start"]).alias("start"), x["n"].alias("n")))
    closed = carried.filter("ends > 0").select(
        "file", "place", F.posexplode(F.concat(F.array(first), others)).alias("i", "doc"))
    open_end = carried.filter(F.col("last") & (F.col("open") > 0)).select(
        "file", (F.col("place") + F.col("ends")).alias("place"),
        (F.col("at") + F.col("n_ids") - F.col("open")).alias("start"), F.col("open").alias("n_tokens"),
        F.lit(False).alias("closed"))
    return closed.select(
        "file", (F.col("place") + F.col("i")).alias("place"), F.col("doc.start").alias("start"),
        F.col("doc.n").alias("n_tokens"), F.lit(True).alias("closed")
    ).unionByName(open_end)


def separator_counts(docs: DataFrame, block_ids: int = BLOCK_IDS, path: str | None = None) -> DataFrame:
    """Documents to flat streams and back to counts: ``(doc_id, file, start, n_tokens)``.

    Null and empty texts hold the end id only. Rows that repeat a doc_id count each, rows
    without one are counted under null, and other columns are not looked at.
    """
    blocks, places = flat_blocks(docs, block_ids, path)
    counted = token_counts(blocks)
    return places.join(counted, ["file", "place"]).select("doc_id", "file", "start", "n_tokens")
