"""Sorted-string-table shards of token ids, with prefix-compressed blocks, a sparse index, a Bloom filter and a footer."""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import beside, cut, shared_dir, table

# Fixed values of the file format. A file is a row of parts, each followed by one byte 0x0A:
#   data blocks  zstd of entries (shared key bytes, own key bytes, value bytes: varints; own key; value)
#   index        zstd of, for each block: last key (length varint, bytes), offset, length, entries, ids before it (varints)
#   filter       bits, least significant first; bit (h1 + i * h2) mod the number of bits for i < HASHES
#   footer       FOOTER below
MAGIC = b"FLSST001"
FOOTER = struct.Struct("<QQQQQQQIB3x8s")  # index at, length; filter at, length; entries, ids, block bytes; shard; id width; magic
# Keys: the empty one for null; 8 bytes for a whole number, which its order needs; 0x74 and UTF-8 bytes for a text.
BLOCK_BYTES = 64 << 10
BITS_A_KEY = 10
HASHES = 7
#: UTF-8 bytes of text to a shard.
SHARD_BYTES = 32 << 20


TEXT_KEY = b"t"


def key_of(doc_id: int | str | None) -> bytes:
    """Bytes in whose order the ids ascend; null is the empty key, before all others."""
    if doc_id is None:
        return b""
    return TEXT_KEY + doc_id.encode("utf-8", "surrogatepass") if isinstance(doc_id, str) else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes, text: bool = False) -> int | str | None:
    if not key:
        return None
    return key[1:].decode("utf-8", "surrogatepass") if text else int.from_bytes(key, "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h1, h2 = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(h1 + i * h2) % bits for i in range(HASHES)]


def parts_of_shard(entries: Iterable[tuple[bytes, bytes]], width: int, shard: int, block_bytes: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The parts of one file, from entries (key, ids) in key order; holds one block, the index and 8 bytes a key."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    at = ids = n = raw = 0
    index, keys, block, last = bytearray(), [], bytearray(), b""
    in_block = before = 0

    def close() -> bytes:
        nonlocal at, block, in_block, before
        packed = press.compress(bytes(block))
        index.extend(_varint(len(last)) + last + _varint(at) + _varint(len(packed)) + _varint(in_block) + _varint(before))
        at += len(packed) + 1
        block, in_block, before = bytearray(), 0, ids
        return packed

    for key, value in entries:
        if len(block) >= block_bytes:
            yield close()
        same = 0
        if in_block:
            while same < min(len(key), len(last)) and key[same] == last[same]:
                same += 1
        block += _varint(same) + _varint(len(key) - same) + _varint(len(value)) + key[same:] + value
        raw += len(value)
        last, n, in_block, ids = key, n + 1, in_block + 1, ids + len(value) // width
        if not keys or keys[-1] != key:
            keys.append(key)
    if not n:
        return
    yield close()
    packed_index = press.compress(bytes(index))
    bits = max(64, len(keys) * BITS_A_KEY)
    bloom = bytearray((bits + 7) // 8)
    for key in keys:
        for b in _probes(key, len(bloom) * 8):
            bloom[b >> 3] |= 1 << (b & 7)
    index_at, bloom_at = at, at + len(packed_index) + 1
    yield packed_index
    yield bytes(bloom)
    yield FOOTER.pack(index_at, len(packed_index), bloom_at, len(bloom), n, ids, raw, shard, width, MAGIC)


class Shard:
    """Reads one file, given whole or as a seekable binary file: ``lookup`` by binary search, or all entries in order."""

    def __init__(self, data: bytes | memoryview | object):
        import zstandard

        self._open = zstandard.ZstdDecompressor().decompress
        self._data = data
        end = len(data) if isinstance(data, bytes | memoryview) else data.seek(0, 2)
        foot = FOOTER.unpack(self._read(end - 1 - FOOTER.size, FOOTER.size))
        index_at, index_len, self._bloom_at, self._bloom_len, self.n, self.ids, _, self.shard, self.width, magic = foot
        if magic != MAGIC:
            raise ValueError("not a shard file")
        index, at, self.blocks = self._open(self._read(index_at, index_len)), 0, []
        while at < len(index):
            size, at = _read_varint(index, at)
            key, at = index[at : at + size], at + size
            numbers = []
            for _ in range(4):
                x, at = _read_varint(index, at)
                numbers.append(x)
            self.blocks.append((key, *numbers))

    def _read(self, at: int, size: int) -> bytes:
        if isinstance(self._data, bytes | memoryview):
            return bytes(self._data[at : at + size])
        self._data.seek(at)
        return self._data.read(size)

    def _entries(self, block: tuple) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, ids before it, value) of a block."""
        _, at, size, _, before = block
        data, at, key = self._open(self._read(at, size)), 0, b""
        while at < len(data):
            same, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key, at = key[:same] + data[at : at + own], at + own
            yield key, before, data[at : at + length]
            at += length
            before += length // self.width

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        for block in self.blocks:
            yield from self._entries(block)

    def may_have(self, doc_id: int | None) -> bool:
        """False only if the id isn't there."""
        bloom = self._read(self._bloom_at, self._bloom_len)
        return all(bloom[b >> 3] >> (b & 7) & 1 for b in _probes(key_of(doc_id), len(bloom) * 8))

    def lookup(self, doc_id: int | None) -> list[bytes]:
        """The values under an id (several if it was repeated), reading the filter, and then the blocks that can hold it."""
        if not self.may_have(doc_id):
            return []
        key, out = key_of(doc_id), []
        for block in self.blocks[bisect_left(self.blocks, key, key=lambda b: b[0]) :]:
            before = len(out)
            for k, _, value in self._entries(block):
                if k > key:
                    return out
                if k == key:
                    out.append(value)
            if len(out) == before:
                return out
        return out


def _text_ids(docs: DataFrame, id_col: str) -> bool:
    return docs.schema[id_col].dataType.typeName() == "string"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes every whole text, ``end_id`` after each, and writes shard files below ``path`` in ascending id order.

    Ids are whole numbers or texts, and a table's are all of one kind. Rows are dealt by ranges of the id (and of
    the text's hash and a seeded number, which part the rows of a much repeated id) and sorted where they land; a
    task streams its rows into one file, through Spark's own writer, so any store that Spark writes to will do. A
    null text is the end id alone, a null id comes first, repeated rows stay. Other columns don't matter.
    """
    total = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 32)).first()[0] or 0
    doc_id = F.col(id_col) if _text_ids(docs, id_col) else F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"), F.rand(11).alias("deal"))
    order = [F.col("doc_id").asc_nulls_first(), "hash", "deal"]
    ranged = rows.repartitionByRange(int(-(-total // shard_bytes)) or 1, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def work(batches):
        from pyspark import TaskContext

        from .fast_encode import encoder

        made = encoder(tokenizer)
        end = end_id.to_bytes(made.width, "little")

        def entries():
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    yield key_of(doc_id.as_py()), made.encode(text.as_py()) + end

        for part in parts_of_shard(entries(), made.width, TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], names=["value"])

    # The text writer writes a string's bytes as they are and 0x0A after each.
    ranged.mapInArrow(work, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "none").text(path)


def _offsets(shards: DataFrame, run: int = 1024) -> DataFrame:
    """``(shard, offset)``: the sum of ``all`` over the shards before, within runs of ``run`` shards and over the runs before."""
    runs = shards.groupBy(F.floor(F.col("shard") / run).alias("run")).agg(F.sum("all").alias("of_run"))
    runs = runs.select("run", (F.sum("of_run").over(Window.orderBy("run")) - F.col("of_run")).alias("from"))
    within = shards.select("shard", F.floor(F.col("shard") / run).alias("run"), (F.sum("all").over(Window.partitionBy(F.floor(F.col("shard") / run)).orderBy("shard")) - F.col("all")).alias("before"))
    return within.join(runs, "run").select("shard", (F.col("before") + F.col("from")).alias("offset"))


def read_back(spark: SparkSession, path: str, text_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document in the files below ``path``; ``text_ids``: their ids are texts.

    start counts the ids of all documents before it, in this file and in those of lower keys; the checksum is of
    the ids as 32-bit little-endian integers.
    """

    def work(batches):
        import numpy as np

        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                if not data.size:
                    continue
                shard = Shard(memoryview(data))
                rows: tuple[list, ...] = ([], [], [], [])
                for key, before, value in shard:
                    ids = np.frombuffer(value, f"<u{shard.width}")
                    for column, x in zip(rows, (id_of(key, text_ids), before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        column.append(x)
                shards = pa.array([shard.shard] * len(rows[0]), pa.int32())
                ids = pa.array(rows[0], pa.string() if text_ids else pa.int64())
                yield pa.RecordBatch.from_arrays([shards, ids, *(pa.array(x, pa.int64()) for x in rows[1:])], names=["shard", "doc_id", "before", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select("content")
    kind = "string" if text_ids else "long"
    rows = cut(files.mapInArrow(work, f"shard int, doc_id {kind}, before long, n_tokens long, ids_crc32 long"))
    return beside(rows, cut(_offsets(rows.groupBy("shard").agg(F.sum("n_tokens").alias("all")))).withColumnRenamed("shard", "_shard"), F.col("shard") == F.col("_shard")).select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def packed(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` into a new folder of the shared one and returns what reading it back gives."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    write(docs, path, tokenizer or tokenizer_path(), end_id)
    return read_back(spark, path, _text_ids(docs, "doc_id"))


def op9_sorted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
