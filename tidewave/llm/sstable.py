"""Token ids in sorted-string tables.

A file holds documents in ascending key order:

    data blocks    entries of (shared, unshared, value length as varints; key suffix; ids), then the restart offsets
    block index    the last key, offset and length of each data block
    Bloom filter   over the document identifiers
    footer         fixed size: where index and filter lie, entry and token counts, id width, magic

A key is a flag for null, the identifier as 8 order-preserving big-endian bytes, and an ordinal among equal identifiers of
the file. Inside a block a key keeps only what it does not share with the one before; every RESTART-th is whole, so that
a reader can search by halves. Files are written to the shared folder by the tasks themselves, under a temporary name
that becomes the final one when the file is whole: a task that is run again replaces its own file and nothing else.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, local_rows, release, slices
from .tokens import encoder

MAGIC = b"TWTOKEN1"
FOOTER = struct.Struct("<QQQQQQQH6x8s")  # index at, length; filter at, length; entries, tokens, blocks; id width; magic
BLOCK_BYTES = 64 << 10
RESTART = 16
BLOOM_BITS = 10
BLOOM_HASHES = 7
END_ID = 2
ENCODED_BYTES = 1 << 20  # of texts at a time; an encoder takes many times their size


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])
    return pafs.LocalFileSystem(), uri


def key_of(doc_id: int | None, ordinal: int = 0) -> bytes:
    if doc_id is None:
        return b"\0" + bytes(8) + struct.pack(">I", ordinal)
    return b"\1" + struct.pack(">QI", doc_id + (1 << 63), ordinal)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    """Bloom positions of a key's identifier part."""
    a, b = zlib.crc32(key[:9]), zlib.crc32(key[:9][::-1], 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one file; add() takes entries in ascending key order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.restarts, self.count, self.last = bytearray(), [], 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.ids: list[bytes] = []
        self.tokens = self.entries = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.count, self.last, self.entries = self.count + 1, key, self.entries + 1
        self.tokens += len(value) // self.width
        self.ids.append(key[:9])
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.count:
            tail = struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            data = bytes(self.block) + tail
            self.index.append((self.last, *self._put(data + struct.pack("<I", zlib.crc32(data)))))
        self.block, self.restarts, self.count = bytearray(), [], 0

    def close(self) -> None:
        self._flush()
        index = self._put(b"".join(k + struct.pack("<QI", at, n) for k, at, n in self.index))
        bits = max(64, len(self.ids) * BLOOM_BITS)
        bloom = np.zeros(bits, bool)
        for key in self.ids:
            bloom[_probes(key, bits)] = True
        kept = self._put(struct.pack("<Q", bits) + np.packbits(bloom).tobytes())
        self._put(FOOTER.pack(*index, *kept, self.entries, self.tokens, len(self.index), self.width, MAGIC))


class Reader:
    """Reads a file by blocks: entries() in order, get(doc_id) by filter, index and search by halves."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        foot = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if foot[-1] != MAGIC:
            raise ValueError(f"{uri} is no token table")
        (index_at, index_len, bloom_at, bloom_len, self.entries_n, self.tokens_n, _, self.width) = foot[:-1]
        index = self._at(index_at, index_len)
        step = 13 + 12
        self.last = [index[i : i + 13] for i in range(0, index_len, step)]
        self.where = [struct.unpack("<QI", index[i + 13 : i + step]) for i in range(0, index_len, step)]
        bloom = self._at(bloom_at, bloom_len)
        self.bits = struct.unpack("<Q", bloom[:8])[0]
        self.bloom = bloom[8:]

    def _at(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        at, n = self.where[i]
        raw = self._at(at, n)
        data, crc = raw[:-4], struct.unpack("<I", raw[-4:])[0]
        if zlib.crc32(data) != crc:
            raise ValueError("a block is damaged")
        restarts = struct.unpack("<I", data[-4:])[0]
        cut = len(data) - 4 - 4 * restarts
        return data[:cut], list(struct.unpack(f"<{restarts}I", data[cut:-4]))

    @staticmethod
    def _walk(data: bytes, at: int, key: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + n]
            at += n

    def entries(self) -> Iterator[tuple[int | None, bytes]]:
        for i in range(len(self.where)):
            for key, value in self._walk(self._block(i)[0], 0):
                yield id_of(key), value

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all documents with this identifier, in order."""
        first = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(first, self.bits)):
            return []
        out = []
        for i in range(bisect_left(self.last, first), len(self.where)):
            data, restarts = self._block(i)
            whole = [next(self._walk(data, r))[0] for r in restarts]
            at = restarts[max(0, bisect_right(whole, first) - 1)]
            for key, value in self._walk(data, at):
                if key[:9] > first[:9]:
                    return out
                if key[:9] == first[:9]:
                    out.append(np.frombuffer(value, f"<u{self.width}").astype(np.uint32))
        return out


def _write_task(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(encoder, collect=True)
        coder = encoder(tokenizer)
        release(encoder, collect=True)  # what reading the tokenizer's file took
        end = np.array([end_id], coder.type).tobytes()
        part = TaskContext.get().partitionId()
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        temporary = posixpath.join(root, f".{part:06d}-{uuid.uuid4().hex}")
        final = posixpath.join(root, f"part-{part:06d}.sst")
        with fs.open_output_stream(temporary) as out:
            writer, last, ordinal = Writer(out, coder.width), b"", 0
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for at, texts in slices(batch.column(1), ENCODED_BYTES):
                    for doc_id, ids in zip(keys[at : at + len(texts)], coder.encode(texts), strict=True):
                        key = key_of(doc_id)
                        ordinal = ordinal + 1 if key[:9] == last else 0
                        last = key[:9]
                        writer.add(key_of(doc_id, ordinal), ids + end)
            writer.close()
        if writer.entries:
            fs.move(temporary, final)
        else:
            fs.delete_file(temporary)
        row = [[part], [posixpath.join(folder, f"part-{part:06d}.sst")], [writer.entries], [writer.tokens]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["part", "file", "entries", "tokens"])

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, *, id_col="doc_id", text_col="text", end_id: int = END_ID) -> list:
    """Write the documents' ids to files in `folder` and return a row for each file, in key order: part, file, entries, tokens.

    Documents are dealt by ranges of (id, text hash), so that one id with very many rows can lie in several files. A null
    id comes first, a null text counts as empty, and further columns stay behind. What comes to the driver is one short
    row a file.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("_order", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(-1)))
    rows = rows.repartitionByRange("doc_id", "_order").sortWithinPartitions("doc_id", "_order").select("doc_id", "text")
    schema = "part long, file string, entries long, tokens long"
    found = rows.mapInArrow(_write_task(folder, tokenizer, end_id), schema).filter("entries > 0").collect()
    return sorted(found, key=lambda r: r["part"])


def _read_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids, starts, counts, crcs = [], [], [], []
            reader = Reader(file)
            for doc_id, value in reader.entries():
                tokens = np.frombuffer(value, f"<u{reader.width}")
                ids.append(doc_id)
                starts.append(start)
                counts.append(len(tokens))
                crcs.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                start += len(tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (ids, starts, counts, crcs)],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read(spark, files: list) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, one task a file."""
    before = [0, *accumulate(f["tokens"] for f in files)]
    rows = [(f["file"], b) for f, b in zip(files, before, strict=False)]
    listed = local_rows(spark, rows, "file string, start long").repartition(max(1, len(rows)))
    return listed.mapInArrow(_read_task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, tokenizer: str, folder: str | None = None, **columns: str) -> DataFrame:
    """Write the documents' ids as sorted-string tables and return what the files hold, per document.

    start counts the ids of all documents before it in key order. Empty and null texts hold the end id alone; repeated
    ids keep a row each; an empty table writes no file and gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "tokens")
    return read(spark, write(docs, folder, tokenizer, **columns))
