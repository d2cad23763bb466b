"""Token-id output as sorted-string-table shards.

A shard is one immutable file, sorted by key:

    data block*   entries with prefix-compressed keys, restart points, then
                  a trailer: one byte for the codec, crc32 of the stored bytes
    index block   for each data block its last key, offset and size (sparse index)
    filter block  Bloom filter of all keys
    footer        fixed size: places of index and filter, counts, crc32, magic

A key is a document's identifier and a number that tells rows with the same
identifier apart; its bytes sort as (null first, identifier, number). A value is
the row's ids as little-endian unsigned integers of 2 or 4 bytes.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm.common import Memo, pieces_for, release, sliced, text_buffer, work_dir, written
from tidemill.llm.pieces import encoded

MAGIC = b"TMSST\x00\x00\x01"
FOOTER = struct.Struct("<QQQQQQBI8s")
BLOCK_BYTES, RESTART_EVERY = 64 << 10, 16
BITS_PER_KEY, PROBES = 10, 7
PLAIN, ZSTD = 0, 1
#: What one shard holds of a large input, in MB of the input's estimated size; a small input makes a shard for each shuffle partition.
SHARD_MB = 64
#: Bytes of text that are encoded together.
ENCODED_BYTES = 8 << 20
#: Words that a worker remembers (twice as many at most); they only save time.
MEMO_WORDS = 250_000
#: Bytes that can be white space, alone or in a longer character.
ODD = re.compile(rb"[\x00-\x20\x7f]|\xc2[\x85\xa0]|\xe1[\x9a\xa0]|\xe2[\x80\x81]|\xe3\x80\x80|\xef\xbb\xbf")


# the file format


def key_of(doc_id: int | None, number: int) -> bytes:
    if doc_id is None:
        return b"\x00" + struct.pack(">QI", 0, number)
    return b"\x01" + struct.pack(">QI", (doc_id + (1 << 63)) & ((1 << 64) - 1), number)


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\x00" else struct.unpack_from(">Q", key, 1)[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


class Block:
    """Gathers entries of one block."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.size, self.count, self.last = 0, 0, b""
        self.restarts: list[int] = []

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART_EVERY:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        head = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:]
        self.parts += (head, value)
        self.size += len(head) + len(value)
        self.count, self.last = self.count + 1, key

    def stored(self, codec: int) -> bytes:
        raw = b"".join(self.parts) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        body = zstandard.ZstdCompressor(level=1).compress(raw) if codec == ZSTD else raw
        return body + bytes([codec]) + struct.pack("<I", zlib.crc32(body))


def opened(stored: bytes) -> bytes:
    body, codec = stored[:-5], stored[-5]
    if zlib.crc32(body) != struct.unpack("<I", stored[-4:])[0]:
        raise OSError("a block's checksum differs")
    return zstandard.ZstdDecompressor().decompress(body) if codec == ZSTD else body


def entries(raw: bytes, at: int = 0, stop: int | None = None) -> Iterator[tuple[bytes, bytes]]:
    n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
    end, key = len(raw) - 4 - 4 * n if stop is None else stop, b""
    while at < end:
        shared, at = read_varint(raw, at)
        rest, at = read_varint(raw, at)
        size, at = read_varint(raw, at)
        key = key[:shared] + raw[at : at + rest]
        at += rest
        yield key, raw[at : at + size]
        at += size


def bits_of(key: bytes, n_bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key, 7)
    step = (h >> 33) | 1
    return [(h + i * step) % n_bits for i in range(PROBES)]


class Writer:
    """Writes one shard; keys must ascend strictly."""

    def __init__(self, sink, codec: int = ZSTD):
        self.sink, self.codec, self.at = sink, codec, 0
        self.block, self.index, self.keys = Block(), Block(), []
        self.last, self.n_ids = b"", 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key <= self.last:
            raise ValueError("keys must ascend")
        wide = len(ids) and int(ids.max()) > 0xFFFF
        self.block.add(key, (b"\x04" if wide else b"\x02") + ids.astype("<u4" if wide else "<u2").tobytes())
        self.keys.append(xxhash.xxh64_intdigest(key, 7))
        self.last, self.n_ids = key, self.n_ids + len(ids)
        if self.block.size >= BLOCK_BYTES:
            self.flush()

    def put(self, data: bytes) -> tuple[int, int]:
        self.sink.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def flush(self) -> None:
        if self.block.count:
            offset, size = self.put(self.block.stored(self.codec))
            self.index.add(self.block.last, struct.pack("<QQ", offset, size))
            self.block = Block()

    def close(self) -> dict[str, int]:
        self.flush()
        n_bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = np.zeros((n_bits + 7) // 8, np.uint8)
        hashes = np.array(self.keys, np.uint64)
        step = (hashes >> np.uint64(33)) | np.uint64(1)
        for i in range(PROBES):
            # exact sums of Python integers: h + i * step can pass 2^64, so reduce first
            where = (hashes % np.uint64(n_bits) + (np.uint64(i) * step) % np.uint64(n_bits)) % np.uint64(n_bits)
            np.bitwise_or.at(bloom, (where >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (where & np.uint64(7)).astype(np.uint8)))
        index, bloom_at = self.put(self.index.stored(PLAIN)), self.put(struct.pack("<Q", n_bits) + bloom.tobytes())
        head = struct.pack("<QQQQQQB", *index, *bloom_at, len(self.keys), self.n_ids, RESTART_EVERY)
        self.put(head + struct.pack("<I", zlib.crc32(head)) + MAGIC)
        return {"n_rows": len(self.keys), "n_ids": self.n_ids, "n_bytes": self.at}


class Reader:
    """Reads one shard: all rows in order, or one by a binary search."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        foot = self.part(size - FOOTER.size, FOOTER.size)
        *places, self.n_rows, self.n_ids, _, crc, magic = FOOTER.unpack(foot)
        if magic != MAGIC or crc != zlib.crc32(foot[: FOOTER.size - 12]):
            raise OSError("not a shard, or a damaged one")
        raw = opened(self.part(places[0], places[1]))
        self.index = [(key, *struct.unpack("<QQ", v)) for key, v in entries(raw)]
        self.last_keys = [key for key, _, _ in self.index]
        bloom = self.part(places[2], places[3])
        self.n_bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]

    def part(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    @staticmethod
    def ids(value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u4" if value[0] == 4 else "<u2", offset=1).astype("<u4")

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for _, offset, size in self.index:
            for key, value in entries(opened(self.part(offset, size))):
                yield key, self.ids(value)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in bits_of(key, self.n_bits))

    def get(self, key: bytes) -> np.ndarray | None:
        if not self.n_rows or not self.may_hold(key):
            return None
        k = bisect_left(self.last_keys, key)
        if k == len(self.index):
            return None
        raw = opened(self.part(*self.index[k][1:]))
        n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        restarts = struct.unpack_from(f"<{n}I", raw, len(raw) - 4 - 4 * n)
        lo, hi = 0, n - 1
        while lo < hi:  # the last restart whose key is not beyond ours
            mid = (lo + hi + 1) // 2
            if next(entries(raw, restarts[mid]))[0] <= key:
                lo = mid
            else:
                hi = mid - 1
        for found, value in entries(raw, restarts[lo]):
            if found >= key:
                return self.ids(value) if found == key else None
        return None


# encoding


class LibraryCoder:
    """The tokenizers library's ids, remembered by word; texts that hold a special string are encoded whole."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo(MEMO_WORDS)
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        if len(self.line) != 1:
            raise ValueError("the vocabulary has no token for a line's end")

    def together(self, words: list[bytes]) -> list[bytes]:
        """The ids of words in which white space is at most one leading space: one text of lines, split at its line ends.

        A line's end is a match of its own before a solid character and before a single space, and no word holds its token.
        """
        ids = np.array(self.tokenizer.encode_batch_fast([b"\n".join(words).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(ids == self.line[0])
        if len(ends) != len(words) - 1:
            raise ValueError("lines and words differ")
        raw, at = ids.tobytes(), np.concatenate([[0], ends * 4 + 4]).tolist()
        return [raw[a:b] for a, b in zip(at, [*(ends * 4).tolist(), len(raw)], strict=True)]

    def words(self, words: list[bytes]) -> list[bytes]:
        memo = self.memo
        young, old, lines, others = memo.young.get, memo.old.get, [], []
        out = [young(w) or old(w) for w in words]
        for i, ids in enumerate(out):
            if ids is None:
                w = words[i]
                body = w[1:] if w[:1] == b" " else w
                (others if not body or ODD.search(body) else lines).append(i)
        for lo in range(0, len(lines), 4096):
            part = lines[lo : lo + 4096]
            for i, ids in zip(part, self.together([words[i] for i in part]), strict=True):
                out[i] = ids
        for i in others:
            out[i] = np.array(self.tokenizer.encode(words[i].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32).tobytes()
        memo.keep(words, out)
        return out

    def texts(self, column: pa.Array) -> list[np.ndarray]:
        data, at = text_buffer(column)
        ids, first = encoded(data, at, self.words)
        out = [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        whole = data.tobytes()
        if any(s in whole for s in self.special):
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                if any(s in whole[a:b] for s in self.special):
                    out[i] = np.array(self.tokenizer.encode(whole[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        return out


@lru_cache(maxsize=2)
def library_coder(path: str) -> LibraryCoder:
    return LibraryCoder(path)


# the operators


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs as shards under folder and returns the manifest, ordered by shard: shard, file, n_rows, n_ids, n_bytes.

    Rows go in ascending order of the identifier (a 64-bit integer; null first), equal
    ones by a hash of their text, so that an identifier with very many rows has several shards. Null and empty texts are rows with the end id
    alone. An empty table makes no shard. A task that runs twice writes another file; only the
    file in the manifest counts. One shuffle, of the texts by ranges. Memory: a slice of texts and a block of a shard.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    shards = pieces_for(docs, SHARD_MB, least=int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = library_coder(path)
        store, base = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name, writer, sink, last, number = f"{shard:08d}-{uuid.uuid4().hex}.sst", None, None, None, 0
        for batch in batches:
            for part in sliced([batch], most=ENCODED_BYTES):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), by.texts(part.column("text")), strict=True):
                    if writer is None:
                        store.create_dir(base, recursive=True)
                        sink = store.open_output_stream(f"{base}/{name}")
                        writer = Writer(sink)
                    number = number + 1 if (doc_id,) == last else 0
                    last = (doc_id,)
                    writer.add(key_of(doc_id, number), np.append(ids, np.uint32(end_id)).astype(np.uint32))
        done = []
        if writer:
            done.append({"shard": shard, "file": name} | writer.close())
            sink.close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_rows", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    order = ["doc_id", "h", "place"]
    by_range = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(by_range.mapInArrow(write, "shard long, file string, n_rows long, n_ids long, n_bytes long"), f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str, each: Callable[[np.ndarray], tuple], fields: str) -> DataFrame:
    """doc_id, start (ids of all rows before it) and what `each` makes of the ids (its DDL: fields), read from the shards."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    # (a row for each shard)
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    places = manifest.select("shard", "file", F.coalesce(before, F.lit(0)).alias("start"))
    schema = f"doc_id long, start long, {fields}"
    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if f.endswith(" long") else None) for c, f in zip(zip(*rows, strict=True), schema.split(", "), strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{file}") as f:
                    found = []
                    for key, ids in Reader(f):
                        found.append((id_of(key), start, *each(ids)))
                        start += len(ids)
                        if len(found) == 10_000:
                            yield batch_of(found)
                            found = []
                    if found:
                        yield batch_of(found)

    n = max(1, manifest.count())
    return places.repartition(n, "shard").mapInArrow(read, schema)


def ids_digest(ids: np.ndarray) -> tuple[int, int]:
    return len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def written_and_read(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens (with the end id) and ids_crc32 of each row, from shards that this call writes."""
    spark = docs.sparkSession
    folder = work_dir(spark, "shards")
    write_shards(docs, folder, path, end_id)
    release(spark)
    return read_shards(spark, folder, ids_digest, "n_tokens long, ids_crc32 long")


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


__all__ = ["Reader", "Writer", "byte_bpe", "key_of", "read_shards", "write_shards", "written_and_read"]
