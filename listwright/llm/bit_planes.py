"""Token ids as files of compressed bit planes, with an index of their chunks.

Ids are cut into chunks of a fixed number, and each chunk is turned from rows of bits into
planes: all lowest bits, all second ones, and so on (or bytes likewise). Each plane is a
zstandard frame of its own, so high planes, which hardly change, almost vanish. A shard is
an ascending run of documents. A chunk row holds its planes, and beside them the index: which
ids it has, how long each plane is, and which documents begin in it. Shards are Parquet part
files of such rows, so any store that Spark writes will hold them, and lost tasks are redone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from listwright.llm.frames import partitions, shipped
from listwright.llm.tokens import encoder, slices

CHUNK_IDS = 1 << 16
END = 1
FILE = (
    "shard int, chunk int, first long, n_ids int, width int, kind string, plane_bytes array<int>, "
    "planes binary, doc_ids array<long>, doc_starts array<long>"
)


def pack(ids: np.ndarray, width: int, kind: str = "bit", level: int = 3) -> tuple[list[int], bytes]:
    """Compressed planes of a chunk: each plane's size, and all of them one after the other.

    ``width`` is 16 or 32 bits. A last bit plane is filled up to whole bytes.
    """
    raw = np.ascontiguousarray(ids, f"<u{width // 8}").view(np.uint8).reshape(len(ids), -1)
    if kind == "bit":
        planes = np.packbits(np.ascontiguousarray(np.unpackbits(raw, axis=1, bitorder="little").T), axis=1)
    else:
        planes = np.ascontiguousarray(raw.T)
    press = zstandard.ZstdCompressor(level=level)
    frames = [press.compress(p.tobytes()) for p in planes]
    return [len(f) for f in frames], b"".join(frames)


def unpack(sizes: list[int], data: bytes, n: int, width: int, kind: str) -> np.ndarray:
    """The ids of a packed chunk."""
    press, at, planes = zstandard.ZstdDecompressor(), 0, []
    for size in sizes:
        planes.append(np.frombuffer(press.decompress(data[at : at + size]), np.uint8))
        at += size
    if kind == "bit":
        # Plane by plane over whole arrays, without turning the bits of each id around.
        ids = np.zeros(n, f"<u{width // 8}")
        for k, bits in enumerate(np.unpackbits(np.stack(planes), axis=1, count=n)):
            ids |= bits.astype(ids.dtype) << k
        return ids
    raw = np.ascontiguousarray(np.stack(planes).T)
    return np.ascontiguousarray(raw).view(f"<u{width // 8}").reshape(n)


def write_ids(
    docs: DataFrame, path: str, tokenizer: str | None = None, kind: str = "bit", width: int = 16,
    chunk_ids: int = CHUNK_IDS, shards: int | None = None,
) -> None:
    """Encode ``docs(doc_id, text)`` and write their ids in ascending doc_id order.

    Each document ends with id 1; a null text is an empty one. Ids must fit ``width`` bits.
    Rows without a doc_id come first; equal ones stand next to each other, by text. Texts, not
    ids, go through the shuffle, and a shard holds what one task encodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, chunk, written = encoder(tokenizer), None, 0, 0
        waiting, waiting_n, begun = [], 0, []

        def cut(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal chunk, written, begun
            sizes, planes = pack(ids, width, kind)
            upto = written + len(ids)
            mine, begun = [b for b in begun if b[1] < upto], [b for b in begun if b[1] >= upto]
            row = {
                "shard": shard, "chunk": chunk, "first": written, "n_ids": len(ids), "width": width, "kind": kind,
                "plane_bytes": sizes, "planes": planes, "doc_ids": [b[0] for b in mine], "doc_starts": [b[1] for b in mine],
            }
            chunk, written = chunk + 1, upto
            return pa.RecordBatch.from_pylist([row], schema=_FILE)

        for batch in batches:
            if shard is None and batch.num_rows:
                shard = batch.column(2)[0].as_py()
            at = 0
            for texts in slices(batch.column(1).to_pylist()):
                ids, bounds = enc.encode(texts)
                if len(ids) and int(ids.max()) >> width:
                    raise ValueError(f"an id needs more than {width} bits")
                stream = np.insert(ids, bounds[1:], END)
                starts = bounds[:-1] + np.arange(len(texts)) + written + waiting_n
                doc_ids = batch.column(0).slice(at, len(texts)).to_pylist()
                begun += zip(doc_ids, starts.tolist(), strict=True)
                at += len(texts)
                waiting.append(stream)
                waiting_n += len(stream)
                if waiting_n >= chunk_ids:
                    flat, k = np.concatenate(waiting), waiting_n // chunk_ids * chunk_ids
                    # What waits is counted from the chunk that is cut next.
                    waiting, waiting_n = [flat[k:]], waiting_n - k
                    for i in range(0, k, chunk_ids):
                        yield cut(flat[i : i + chunk_ids])
        if shard is not None and waiting_n:
            yield cut(np.concatenate(waiting))

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = rows.repartitionByRange(shards or max(8, partitions(spark)), F.col("doc_id").asc_nulls_first())
    placed.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.hash("text")).select(
        "doc_id", "text", F.spark_partition_id().alias("shard")
    ).transform(shipped).mapInArrow(run, FILE).write.parquet(path)


_FILE = pa.schema(
    [("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("width", pa.int32()),
     ("kind", pa.string()), ("plane_bytes", pa.list_(pa.int32())), ("planes", pa.binary()),
     ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64()))]
)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """What a file's chunks hold, without their planes."""
    return spark.read.schema(FILE).parquet(path).drop("planes")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, shard, place, start, n_tokens, ids)`` read back; ids are little-endian 32-bit bytes.

    ``start`` counts the ids of all documents before, over all shards. A shard's chunks are
    read in order, and only a document that is cut by a chunk's end is held over.
    """
    files = spark.read.schema(FILE).parquet(path)
    sizes = chunk_index(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, doc, begun, held = None, None, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                if row["shard"] != shard:
                    if doc is not None:
                        out.append((doc[0], shard, begun, held))
                    shard, doc, held = row["shard"], None, []
                ids = unpack(row["plane_bytes"], row["planes"], row["n_ids"], row["width"], row["kind"]).astype("<u4")
                cuts = [s - row["first"] for s in row["doc_starts"]]
                if doc is not None:
                    held.append(ids[: cuts[0]] if cuts else ids)
                for i, (d, c) in enumerate(zip(row["doc_ids"], cuts, strict=True)):
                    if doc is not None:
                        out.append((doc[0], shard, begun, held))
                    doc, begun = (d,), row["doc_starts"][i]
                    held = [ids[c : cuts[i + 1] if i + 1 < len(cuts) else None]]
                yield _documents(out)
        if doc is not None:
            yield _documents([(doc[0], shard, begun, held)])

    back = (
        files.repartition("shard").sortWithinPartitions("shard", "chunk")
        .transform(shipped).mapInArrow(run, "doc_id long, shard int, place long, ids binary")
    )
    # One number per shard, and the writer's parameter bounds the shards.
    return back.join(F.broadcast(base), "shard").select(
        "doc_id", "shard", "place", (F.col("base") + F.col("place")).alias("start"),
        (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    d, s, p, h = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(d, pa.int64()), pa.array(s, pa.int32()), pa.array(p, pa.int64()),
         pa.array([b"".join(x.tobytes() for x in held) for held in h], pa.binary())],
        ["doc_id", "shard", "place", "ids"])


def digests(documents: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of read-back documents."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


