"""Token ids in files of fixed-width bit-packed blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, col
from .tokens import Encoder, met, vocabulary_size

# The file format. Numbers are unsigned and big-endian unless said.
#   8 bytes  magic
#   u4 bits of an id, u4 ids of a block, u4 shard, u4 number of the file in its shard
#   u8 documents, u8 ids, u8 blocks
#   i8 id of each document (signed), u1 for each: 1 where it has one
#   u8 start of each document among the file's ids, and their end
#   u8 offset of each block from the first one, and their end
#   blocks: each id in its bits, lowest bit first, from a byte boundary on
# A line feed, which ends a record of the writer, follows.
MAGIC = b"BITIDS01"
HEAD = np.dtype([("magic", "S8"), ("width", ">u4"), ("block", ">u4"), ("shard", ">u4"), ("number", ">u4"),
                 ("docs", ">u8"), ("ids", ">u8"), ("blocks", ">u8")])
#: Ids of a block; a file is closed once it holds this many ids.
BLOCK, FILE_IDS = 1 << 14, 1 << 21


def bits_for(size: int) -> int:
    """The fewest bits that tell ``size`` ids apart."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits, lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype("<u4")[:, None] >> np.arange(width, dtype="u4")) & np.uint32(1)
    return np.packbits(bits.astype("u1"), bitorder="little").tobytes()


def unpack(data: np.ndarray, n: int, width: int) -> np.ndarray:
    """The ``n`` ids in ``data`` (bytes), as little-endian unsigned 32-bit integers."""
    if width in (8, 16, 32):
        return data[:n * width // 8].view(f"<u{width // 8}").astype("<u4")
    bits = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype("u4") << np.arange(width, dtype="u4")).sum(axis=1, dtype="u4").astype("<u4")


def build(doc_ids: list[int | None], ids: list[np.ndarray], width: int, shard: int, number: int) -> bytes:
    """One file's bytes."""
    flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    blocks = [pack(flat[k:k + BLOCK], width) for k in range(0, len(flat), BLOCK)]
    head = np.array((MAGIC, width, BLOCK, shard, number, len(ids), len(flat), len(blocks)), HEAD)
    starts = np.cumsum([0, *map(len, ids)]).astype(">u8")
    offsets = np.cumsum([0, *map(len, blocks)]).astype(">u8")
    named = np.array([i is not None for i in doc_ids], "u1")
    return b"".join([head.tobytes(), np.array([i or 0 for i in doc_ids], ">i8").tobytes(), named.tobytes(),
                     starts.tobytes(), offsets.tobytes(), *blocks])


class Reader:
    """Random access to one file's bytes."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, HEAD, 1)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a file of packed ids")
        self.width, self.block, self.shard, self.number, docs, self.n_ids, blocks = (
            int(head[n]) for n in HEAD.names[1:])
        at = HEAD.itemsize
        doc_ids, at = np.frombuffer(data, ">i8", docs, at), at + 8 * docs
        named, at = np.frombuffer(data, "u1", docs, at), at + docs
        self.doc_ids = [int(i) if n else None for i, n in zip(doc_ids, named)]
        self.starts, at = np.frombuffer(data, ">u8", docs + 1, at).astype(np.int64), at + 8 * (docs + 1)
        self.offsets, at = np.frombuffer(data, ">u8", blocks + 1, at).astype(np.int64), at + 8 * (blocks + 1)
        self.payload = np.frombuffer(data, "u1", int(self.offsets[-1]), at)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range of places; only the blocks that hold them are read."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        parts = [unpack(self.payload[self.offsets[k]:self.offsets[k + 1]],
                        min(self.block, self.n_ids - k * self.block), self.width) for k in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block:stop - first * self.block]

    def document(self, n: int) -> np.ndarray:
        return self.ids(int(self.starts[n]), int(self.starts[n + 1]))


def write(df: DataFrame, path: str, vocabulary: str, end: int | None = None,
          doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write the ids in ascending order of ``doc_id``.

    ``vocabulary`` is the path of a byte-level BPE file in JSON, read by the driver; special
    tokens written in a text become their ids. ``end`` is put after each document. An id
    takes the fewest bits that the vocabulary needs.

    Rows are dealt by ranges of (id, hash of the text, row), so rows that share an id, however
    many, are dealt too. A task holds one file's ids, ``FILE_IDS`` or those of one longer
    text. Files go through Spark's own writer and its committer, which takes one attempt of
    each task: the text writer puts a string's bytes as they are, one record a file. Their
    names sort in the order of the documents, which the headers state too.

    Null and empty texts have no ids but ``end``; rows without an id come last; rows
    of one id are ordered by the hash of their texts, equal rows stand side by side. Other columns are
    not read. An empty table gives no ids.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = file.read()
    width = bits_for(max(vocabulary_size(spec), 0 if end is None else end + 1))
    sent = df.sparkSession.sparkContext.broadcast(spec)
    order = ["unnamed", "id", "hash", "row"]
    rows = df.select(col(doc_id).cast("long").alias("id"), F.coalesce(col(text), F.lit("")).alias("text")).select(
        F.col("id").isNull().alias("unnamed"), "id", F.xxhash64("text").alias("hash"),
        F.monotonically_increasing_id().alias("row"), "text")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    last = np.array([] if end is None else [end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder(sent.value, True, met(sent.value, True)), TaskContext.get().partitionId()
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        size, number = 0, 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([build(names, ids, width, shard, number)], pa.binary())],
                                              names=["file"])

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                coded = encoder.encode(batch.column(1).to_pylist())
                for name, one in zip(batch.column(0).to_pylist(), coded):
                    names.append(name)
                    ids.append(np.frombuffer(one + last, "<u4"))
                    size += len(ids[-1])
                    if size >= FILE_IDS:
                        yield file()
                        names, ids, size, number = [], [], 0, number + 1
        if names:
            yield file()

    rows.mapInArrow(run, "file binary").select(F.col("file").cast("string")).write.option(
        "maxRecordsPerFile", 1).text(path)


def number_at(data: Column, place: int, size: int) -> Column:
    """The big-endian number at a byte of a binary column."""
    return F.conv(F.hex(F.substring(data, place + 1, size)), 16, 10).cast("long")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content").where(
        F.octet_length("content") >= HEAD.itemsize)


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, number, before): the ids in all files ahead of each, from the headers alone.

    Summed within each shard, then over the shards, of which there are as many as tasks wrote.
    """
    at = {n: HEAD.fields[n][1] for n in HEAD.names}
    heads = _files(spark, path).select(
        number_at(F.col("content"), at["shard"], 4).alias("shard"),
        number_at(F.col("content"), at["number"], 4).alias("number"),
        number_at(F.col("content"), at["ids"], 8).alias("ids"))

    def ahead(window):
        return F.coalesce(F.sum("ids").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    shards = heads.groupBy("shard").agg(F.sum("ids").alias("ids")).select(
        "shard", ahead(Window.orderBy("shard")).alias("base"))
    own = ahead(Window.partitionBy("shard").orderBy("number"))
    return heads.withColumn("own", own).join(shards, "shard").select(
        "shard", "number", (F.col("base") + F.col("own")).alias("before"))


ROWS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("number", T.LongType()),
    T.StructField("place", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, shard and number of its file, its place among the
    file's ids, ``n_tokens``, and ``ids`` as little-endian unsigned 32-bit integers.

    Files are unpacked block by block; ``Reader`` gives any range of one without the rest. Join
    ``file_starts`` on shard and number for the place among all ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = Reader(content.as_py())
                for at in range(0, len(file.doc_ids), SLICE_ROWS):
                    n = min(SLICE_ROWS, len(file.doc_ids) - at)
                    starts = file.starts[at:at + n + 1]
                    data = file.ids(int(starts[0]), int(starts[-1])).tobytes()
                    cut = 4 * (starts - starts[0])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(file.doc_ids[at:at + n], pa.int64()),
                        pa.array(np.full(n, file.shard), pa.int64()), pa.array(np.full(n, file.number), pa.int64()),
                        pa.array(starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()),
                        pa.array([data[b:e] for b, e in zip(cut[:-1], cut[1:])], pa.binary())], names=ROWS.names)

    return _files(spark, path).mapInArrow(run, ROWS)
