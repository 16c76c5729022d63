"""Token ids in sorted-string tables, one file per range of documents.

File: blocks, then the index, the Bloom filter and a footer of fixed size.
Each block is zstandard-compressed and holds entries in key order: varint
length shared with the key before, varint length of the rest, the rest, varint
number of ids, the ids as unsigned 16- or 32-bit integers. A key is the doc_id
as 9 bytes that sort like the number (null first), followed by 4 bytes that
number equal doc_ids. The sparse index has each block's first key, offset and
size; a lookup asks the Bloom filter, bisects the index and reads one block.
"""

from __future__ import annotations

import bisect
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.common import by_text, id_and_text, in_arrow, materialize, new_path
from gustline.llm.tokens import END, Coder

MAGIC = b"GUSTSST1"
_FOOTER = struct.Struct("<QQQQQQIB3x8s")  # index at, index size, Bloom at, Bloom size, entries, ids, hashes, bytes an id, magic


def key_of(doc_id: int | None, nth: int = 0) -> bytes:
    return (b"\0" * 9 if doc_id is None else b"\1" + (doc_id + 2**63).to_bytes(8, "big")) + nth.to_bytes(4, "big")


def doc_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:9], "big") - 2**63 if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bits(h: int, size: int, hashes: int) -> list[int]:
    """Places in a Bloom filter of ``size`` bytes for a key's 128-bit hash."""
    a, b = h >> 64, h & (2**64 - 1) | 1
    return [(a + i * b) % (8 * size) for i in range(hashes)]


class Writer:
    """Writes entries, which must come in key order, to an open binary file; holds one block and 16 bytes a key in memory."""

    def __init__(self, out, block_bytes: int = 256 * 1024, wide: bool = False, bits_per_key: int = 10):
        self.out, self.block_bytes, self.wide, self.bits_per_key = out, block_bytes, wide, bits_per_key
        self.at = self.ids = 0
        self.block, self.index, self.hashed, self.entries, self.last, self.first = bytearray(), [], bytearray(), 0, b"", b""
        self.compressor = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.entries and key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(ids)) + ids.astype("<u4" if self.wide else "<u2").tobytes()
        self.last = key
        self.hashed += xxhash.xxh3_128_digest(key)
        self.entries += 1
        self.ids += len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.compressor.compress(bytes(self.block))
            self.out.write(data)
            self.index.append((self.first, self.at, len(data)))
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        size, hashes = max(1, self.entries * self.bits_per_key // 8), 7
        bloom = bytearray(size)
        for i in range(0, len(self.hashed), 16):
            for x in _bits(int.from_bytes(self.hashed[i : i + 16], "big"), size, hashes):
                bloom[x >> 3] |= 1 << (x & 7)
        self.out.write(index + bytes(bloom))
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), size, self.entries, self.ids, hashes, 4 if self.wide else 2, MAGIC))


class Reader:
    """Reads a file through a seekable binary file object: all entries in order, or those of one doc_id."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - _FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.entries, self.ids, self.hashes, self.bytes_an_id, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table of token ids")
        file.seek(index_at)
        raw, at, self.index = file.read(index_n), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key = raw[at : at + n]
            start, at = _read_varint(raw, at + n)
            length, at = _read_varint(raw, at)
            self.index.append((key, start, length))
        file.seek(bloom_at)
        self.bloom = file.read(bloom_n)

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, start, length = self.index[i]
        self.file.seek(start)
        raw, at, key = zstandard.ZstdDecompressor().decompress(self.file.read(length)), 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + n]
            count, at = _read_varint(raw, at + n)
            end = at + count * self.bytes_an_id
            yield key, np.frombuffer(raw, "<u4" if self.bytes_an_id == 4 else "<u2", count, at)
            at = end

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[x >> 3] >> (x & 7) & 1 for x in _bits(xxhash.xxh3_128_intdigest(key), len(self.bloom), self.hashes))

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first entry with this doc_id, or None."""
        key = key_of(doc_id)
        if not self.may_have(key) or not self.index:
            return None
        i = bisect.bisect_right([k for k, _, _ in self.index], key) - 1
        return next((ids for k, ids in self._block(i) if k == key), None) if i >= 0 else None


_WRITTEN = "shard int, path string, bytes long, docs long, ids long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    cols = list(zip(*rows)) or [()] * len(schema.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(cols, schema.split(", "))], names=[x.split()[0] for x in schema.split(", ")])


def _write_kernel(folder: str, tokenizer: str, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = Coder.of(tokenizer), TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        final = posixpath.join(root, f"shard-{shard:06d}.sst")
        ours = f"{final}.{uuid.uuid4().hex}.tmp"  # a second attempt never writes to the first one's file
        writer, doc, nth = None, object(), 0
        with fs.open_output_stream(ours) as out:
            for docs, texts in by_text(batches):
                writer = writer or Writer(out, wide=wide)
                for i in range(0, len(docs), 512):
                    for d, ids in zip(docs[i : i + 512], coder.encode(texts[i : i + 512])):
                        doc, nth = d, nth + 1 if d == doc else 0
                        writer.add(key_of(d, nth), np.frombuffer(ids + END, "<u4"))
            if writer:
                writer.close()
        if not writer:
            fs.delete_file(ours)
            return
        fs.move(ours, final)  # the same content whichever attempt comes last
        yield _batch([(shard, f"{folder}/{posixpath.basename(final)}", fs.get_file_info(final).size, writer.entries, writer.ids)], _WRITTEN)

    return run


def write_shards(docs: DataFrame, tokenizer: str, shards: int | None = None, wide: bool = False, folder: str | None = None, shard_bytes: int = 128 << 20) -> DataFrame:
    """Encode the documents and write them as sorted-string tables; returns the manifest.

    Shard i has the i-th range of doc_ids (null first); rows with one doc_id
    are cut at hashes of the text if need be, so that no id fills one shard.
    The manifest has a row per shard: shard, path, bytes, docs, ids, base (the
    ids of all shards before it). wide: 32-bit ids, for vocabularies over 65,536.
    folder: where the files go, a folder that all machines share, with its scheme.
    shards: as many as the texts have times ``shard_bytes`` if not given, the shuffle partitions at least.
    Null and empty texts hold the end id alone; an empty table gives no shard.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "sst")
    n = shards
    if not n:
        size = id_and_text(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    rows = id_and_text(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange(n, F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie").select("doc_id", "text")
    written = materialize(rows.transform(in_arrow, _write_kernel(folder, tokenizer, wide), _WRITTEN), "manifest")
    before = F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")  # a row per shard
    return written.withColumn("base", before)


def _read_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri, size, base in zip(*(c.to_pylist() for c in b.columns)):
            fs, path = pafs.FileSystem.from_uri(uri)
            rows = []
            with fs.open_input_file(path) as f:
                for key, ids in Reader(f, size):
                    rows.append((doc_of(key), base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    base += len(ids)
                    if len(rows) == 10_000:
                        yield _batch(rows, _READ)
                        rows = []
            if rows:
                yield _batch(rows, _READ)


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files, with start counted over all shards.

    One task reads one file and holds one block of it.
    """
    rows = manifest.select("path", "bytes", "base")
    return rows.repartition(max(1, manifest.count())).transform(in_arrow, _read_kernel, _READ)
