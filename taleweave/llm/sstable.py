"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of identifier.  Layout, all numbers
little-endian:

* data blocks: entries of key prefix length (u8), key suffix length (u8), value
  length (u32), key suffix, value; the first entry of a block has no shared
  prefix.  A block ends with the CRC-32 of its entries (u32) and a newline;
* index: for every block its first key (KEY bytes), offset (u64), length (u32);
* Bloom filter over the keys, ``BLOOM_BITS`` bits a document;
* footer: offset of the index, offset of the filter, documents, token ids (u64
  each), width of an id in bytes (u8), magic, newline.

A key is one byte (0: null id, 1: an id) and the id as big-endian unsigned with
its sign bit flipped, so byte order is id order.  The newlines let Spark's text
writer lay down the bytes: every row is a block, every partition a file, and
the writer's commit protocol makes the shards whole though executors are lost.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taleweave.llm import kernels
from taleweave.llm.scratch import small_batches, written
from taleweave.llm.tokens import default_path, encoder

KEY = 9
BLOCK_BYTES = 1 << 16
SHARD_BYTES = 16 << 20  # of text in a shard
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"TWSST\x01\x00\x01"
FOOTER = "<QQQQB8s"
INDEX = f"<{KEY}sQI"
ENTRY = "<BBI"


def to_key(doc_id: int | None) -> bytes:
    return bytes(KEY) if doc_id is None else b"\x01" + (doc_id + 2**63).to_bytes(8, "big")


def from_key(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - 2**63 if key[0] else None


def _bloom_places(keys: list[bytes], n_bits: int) -> np.ndarray:
    low = np.array([int.from_bytes(k[1:], "big") ^ (k[0] << 7) for k in keys], dtype=np.uint64)
    a, b = kernels.mix(low), kernels.mix(low ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return (a[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(n_bits)


class ShardWriter:
    """Gives the rows of one shard: blocks as they fill, then index, filter and footer as one row."""

    def __init__(self, width: int):
        self.width, self.offset, self.n_tokens = width, 0, 0
        self.keys: list[bytes] = []
        self.index: list[bytes] = []
        self._begin()

    def _begin(self) -> None:
        self.block, self.first, self.last = bytearray(), b"", b""

    def _close(self) -> bytes:
        body = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
        self.index.append(struct.pack(INDEX, self.first, self.offset, len(body)))
        self.offset += len(body) + 1
        self._begin()
        return body

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        key, value = to_key(doc_id), ids.astype(f"<u{self.width}").tobytes()
        shared = 0
        if self.block:
            while shared < KEY and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += struct.pack(ENTRY, shared, KEY - shared, len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n_tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            yield self._close()

    def finish(self) -> Iterator[bytes]:
        if self.block:
            yield self._close()
        if self.keys:
            n_bits = max(64, -(-BLOOM_BITS * len(self.keys) // 8) * 8)
            bits = np.zeros(n_bits, dtype=np.uint8)
            bits[_bloom_places(self.keys, n_bits).ravel().astype(np.int64)] = 1
            index = b"".join(self.index)
            footer = struct.pack(FOOTER, self.offset, self.offset + len(index), len(self.keys), self.n_tokens, self.width, MAGIC)
            yield index + np.packbits(bits).tobytes() + footer


class Shard:
    """A shard's bytes, opened by its footer; blocks are read one at a time."""

    def __init__(self, content: bytes | memoryview):
        self.content = content
        if bytes(content[-1:]) != b"\n" or bytes(content[-9:-1]) != MAGIC:
            raise ValueError("not a whole shard")
        at = len(content) - 1 - struct.calcsize(FOOTER)
        self.index_at, self.bloom_at, self.n_docs, self.n_tokens, self.width, _ = struct.unpack_from(FOOTER, content, at)
        self.bloom_end = at
        self.blocks = [struct.unpack_from(INDEX, content, i) for i in range(self.index_at, self.bloom_at, struct.calcsize(INDEX))]

    def entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, length = self.blocks[block]
        body = self.content[offset : offset + length - 4]
        if zlib.crc32(body) != struct.unpack_from("<I", self.content, offset + length - 4)[0]:
            raise ValueError(f"block {block} is damaged")
        at, key = 0, b""
        while at < len(body):
            shared, rest, size = struct.unpack_from(ENTRY, body, at)
            at += struct.calcsize(ENTRY)
            key = key[:shared] + bytes(body[at : at + rest])
            at += rest
            yield key, np.frombuffer(body, f"<u{self.width}", size // self.width, at)
            at += size

    def may_have(self, key: bytes) -> bool:
        bits = np.unpackbits(np.frombuffer(self.content[self.bloom_at : self.bloom_end], np.uint8))
        return bool(bits[_bloom_places([key], len(bits)).ravel().astype(np.int64)].all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier: filter, then binary search of the index."""
        key, found = to_key(doc_id), []
        if not self.may_have(key):
            return found
        low, high = 0, len(self.blocks)
        while low < high:  # the first block whose first key is not smaller
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.blocks[mid][0] < key else (low, mid)
        for block in range(max(0, low - 1), len(self.blocks)):
            if self.blocks[block][0] > key:
                break
            found += [ids for k, ids in self.entries(block) if k == key]
        return found


def write_shards(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 0, n_shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write shards to ``path``, one a range of ids, each of some SHARD_BYTES of text.

    A null or empty text is its end id alone.  Null ids come first; repeated
    ids are kept side by side, ordered by a hash of the text, and go on in the
    next shard where they fill one.  An empty table gives no documents.
    """
    tokenizer_path = tokenizer_path or default_path()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if n_shards is None:
        total = texts.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
        n_shards = max(1, -(-total // SHARD_BYTES))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_path)
        width = 2 if max(tokens.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        shard = ShardWriter(width)
        row = lambda blocks: pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["block"])
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), tokens.encode(batch["text"]), strict=True):
                for block in shard.add(doc_id, np.append(ids, np.uint32(end_id))):
                    yield row([block])
            del batch
            kernels.give_back()
        yield row(list(shard.finish()))

    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = texts.repartitionByRange(n_shards, *by).sortWithinPartitions(*by)
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(encode, "block binary").select(F.col("block").cast("string")).write.option("compression", "none").option("lineSep", "\n").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


ROWS_SQL = "doc_id long, local long, n_tokens long, ids_crc32 long, ids array<int>, shard string, first binary, total long"


def read_shards(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """ROWS_SQL of every document, from the files alone; ``ids`` is null unless ``with_ids``.

    ``local`` counts the ids before the document in its shard, ``first`` and
    ``total`` are the shard's first key and number of ids.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                shard, local = Shard(memoryview(content.as_buffer())), 0
                first = shard.blocks[0][0]
                for block in range(len(shard.blocks)):
                    rows = []
                    for key, ids in shard.entries(block):
                        rows.append((from_key(key), local, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32) if with_ids else None))
                        local += len(ids)
                    columns = list(zip(*rows, strict=True))
                    n = len(rows)
                    arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
                    arrays += [pa.array(columns[4], pa.list_(pa.int32())), pa.array([name] * n), pa.array([first] * n, pa.binary()), pa.array([shard.n_tokens] * n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "local", "n_tokens", "ids_crc32", "ids", "shard", "first", "total"])
                del shard, content
            del batch
            kernels.give_back()

    return _files(spark, path).mapInArrow(parse, ROWS_SQL)


def with_starts(rows: DataFrame) -> DataFrame:
    """Rows of ``read_shards`` with ``start``, the ids of all documents before.

    Shards are put in order of their first keys in range partitions, and only sums of partitions meet in one window.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("first"), F.col("shard")]
    shards = rows.where("local = 0").groupBy("shard").agg(F.first("first").alias("first"), F.first("total").alias("total"))
    shards = written(shards.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each of ``parts``
    bases = shards.groupBy("part").agg(F.sum("total").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("own", F.coalesce(F.sum("total").over(within), F.lit(0))).join(bases, "part")
    starts = shards.select("shard", (F.col("base") + F.col("own")).alias("base"))
    return rows.join(starts, "shard").withColumn("start", (F.col("base") + F.col("local")).cast("long"))


def encode_and_read(docs: DataFrame, path: str, tokenizer_path: str | None = None) -> DataFrame:
    """Write the shards of ``docs`` to ``path`` and read doc_id, start, n_tokens, ids_crc32 of every document from them."""
    write_shards(docs, path, tokenizer_path)
    rows = written(read_shards(docs.sparkSession, path, with_ids=False).drop("ids"), "shard-rows")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def look_up(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """doc_id and ids of every document with one of ``doc_ids`` (a handed-in list, sent to every task).

    Each shard answers from its Bloom filter, then by binary search of its block index; only blocks that may hold an id are decoded.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                shard = Shard(memoryview(content.as_buffer()))
                found = [(d, ids.astype(np.int32)) for d in dict.fromkeys(doc_ids) for ids in shard.get(d)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _files(spark, path).mapInArrow(find, "doc_id long, ids array<int>")
