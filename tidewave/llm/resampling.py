"""Importance resampling towards a target: documents are drawn by how much their n-grams look like the target's.

All runs of one to three words are hashed into buckets, counted over the whole corpus and over the target. A bucket's gain is the
logarithm of how much more often the target has it; a document weighs the sum over its n-grams, and with Gumbel noise
from its id the greatest scores are a draw without replacement in proportion to the weights' exponentials.

Long texts would make some tasks far longer than others. They are cut into chunks at word boundaries; a chunk owns the n-grams
that start at its own words and carries the next n-1 words, so each n-gram is counted once. Chunks are dealt anew, and
their counts and weights are summed by document. Short texts stay where they are. Ranks come from one sort by ranges and the
number of rows in each range, so no task sees more than its range.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_node

GRAMS = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
CHUNK_WORDS = 8192
#: Longer texts are cut into chunks and dealt anew; results don't depend on it.
LONG_BYTES = 1 << 16
#: Texts hashed at a time, so that all numbers of a step stay in a core's cache.
SLICE_BYTES = 1 << 18
#: Different words whose checksums a task keeps at a time.
WORDS_KEPT = 1 << 18

#: Letters A-Z become small; all bytes but digits, letters and those beyond ASCII become spaces.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text's UTF-8."""
    return (text or b"").translate(_CLEAN).split()


@lru_cache(maxsize=1024)
def _moved(length: int) -> np.ndarray:
    """What a CRC-32 becomes when `length` bytes follow, but for the part that depends on them: a table for each of its bytes."""
    values = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    if length == 1:
        for _ in range(8):
            values = (values >> np.uint32(1)) ^ np.where(values & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
        return values
    half = _moved(length // 2)[None]
    first = np.zeros(values.shape, np.intp)
    values = _move(half, first, _move(half, first, values))
    return _move(_moved(1)[None], first, values) if length % 2 else values


def _move(tables: np.ndarray, which: np.ndarray, crc: np.ndarray) -> np.ndarray:
    flat, at = tables.reshape(-1), which * 1024
    out = flat.take(at + (crc & np.uint32(255)))
    for k in (1, 2, 3):
        out ^= flat.take(at + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255)))
    return out


class _Checksums(dict):
    """A number for each word, under which its CRC-32, that of a space and the word, and the number of their length are kept."""

    def __init__(self):
        super().__init__()
        self.own, self.spaced, self.kind, self.kinds = array("I"), array("I"), array("q"), {}

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.own)
        self.own.append(zlib.crc32(word))
        self.spaced.append(zlib.crc32(b" " + word))
        self.kind.append(self.kinds.setdefault(len(word) + 1, len(self.kinds)))
        return at


class Hasher:
    """The buckets of all n-grams of texts. A longer n-gram's checksum follows from the shorter one's and that of the word added."""

    def __init__(self, buckets: int = BUCKETS, grams: int = GRAMS):
        self.buckets, self.grams, self._sums = buckets, grams, _Checksums()

    def buckets_of(self, texts: list[list[bytes]], owned: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, bucket) of the n-grams that start at the first `owned` words of each text, an array a size of n-grams."""
        if len(self._sums) > WORDS_KEPT:
            self._sums = _Checksums()
        sums = self._sums
        sizes = np.array([len(t) for t in texts], np.int64)
        number = sums.__getitem__
        ids = np.fromiter(map(number, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        if not len(ids):
            return
        tables = np.stack([_moved(k) for k in sums.kinds])
        spaced, kind = (np.array(x).take(ids) for x in (sums.spaced, sums.kind))
        text = np.repeat(np.arange(len(texts)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))  # words from here to the text's end
        starts = np.flatnonzero(np.repeat(sizes, sizes) - left < owned[text])
        crc = np.array(sums.own).take(ids.take(starts))
        for n in range(self.grams):
            if n:
                there = left.take(starts) > n
                starts, crc = starts[there], crc[there]
                crc = _move(tables, kind.take(starts + n), crc) ^ spaced.take(starts + n)
            yield text.take(starts), (crc % np.uint32(self.buckets)).astype(np.int64)


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    for first, part in slices(texts, SLICE_BYTES):
        yield first, [words_of(t.as_py()) for t in part]


def _short(size: Column) -> Column:
    return size <= LONG_BYTES


def _chunks(long_texts: DataFrame) -> DataFrame:
    """Chunks of long texts, dealt over all tasks: _id, _node, _size, _first (of the text's chunks), _own words, _text."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = words_of(batch.column(3)[row].as_py())
                for k, first in enumerate(range(0, max(len(words), 1), CHUNK_WORDS)):
                    own = min(CHUNK_WORDS, len(words) - first)
                    text = b" ".join(words[first : first + CHUNK_WORDS + GRAMS - 1])
                    columns = [*(batch.column(c).slice(row, 1) for c in range(3)), pa.array([k], pa.int32()), pa.array([own], pa.int32()), pa.array([text], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["_id", "_node", "_size", "_chunk", "_own", "_text"])

    found = long_texts.mapInArrow(cut, "_id long, _node long, _size long, _chunk int, _own int, _text binary")
    return found.repartition("_id", "_node", "_chunk")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Short texts (_id, _text) and chunks of the long ones."""
    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.cast("binary").alias("_text"), size.alias("_size"), text_node(text).alias("_node"))
    return rows.filter(_short(F.col("_size"))).select("_id", "_text"), _chunks(rows.filter(~_short(F.col("_size"))).select("_id", "_node", "_size", "_text"))


def bucket_counts(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall into each bucket that has any. A task hands on one row a bucket."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sums = Hasher(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for first, part in _slices(batch.column(1)):
                for _, found in hasher.buckets_of(part, own[first : first + len(part)]):
                    sums += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    whole = texts.select(F.lit((1 << 31) - 1).alias("_own"), "_text").unionByName(chunks.select("_own", "_text"))
    return whole.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, in thousandths, from the counts of the corpus and of the target: BUCKETS rows of each come here."""
    sides = []
    for counted in (corpus, target):
        n = np.zeros(BUCKETS)
        for r in counted.collect():
            n[r["bucket"]] = r["n"]
        sides.append(n)
    s, t = sides
    all_s, all_t = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + BUCKETS) / ((a + 1) * (all_t + BUCKETS)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def _weigh(own: Column, text: Column, gain: np.ndarray) -> Column:
    """(words, n_features, weight) of a text's own n-grams."""

    def found(owned: pa.Array, texts: pa.Array) -> pa.Array:
        hasher, own = Hasher(), owned.to_numpy(zero_copy_only=False)
        out = np.zeros((3, len(texts)), np.int64)
        for first, part in _slices(texts):
            here = out[:, first : first + len(part)]
            here[0] = np.minimum([len(t) for t in part], own[first : first + len(part)])
            for text, bucket in hasher.buckets_of(part, own[first : first + len(part)]):
                here[1] += np.bincount(text, minlength=len(part))
                here[2] += np.bincount(text, gain.take(bucket), len(part)).astype(np.int64)  # exact: far below 2^53
        return pa.StructArray.from_arrays([pa.array(c) for c in out], names=["words", "n_features", "weight"])

    return F.arrow_udf(found, "words long, n_features long, weight long")(own, text)


def weights(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, words, n_features, weight."""
    short, chunks = _texts(docs, id_col, text_col)
    found = ["words", "n_features", "weight"]
    whole = short.select(F.col("_id").alias("doc_id"), _weigh(F.lit((1 << 31) - 1), F.col("_text"), gain).alias("_w")).select("doc_id", "_w.*")
    parts = chunks.select("_id", "_node", "_size", "_chunk", _weigh(F.col("_own"), F.col("_text"), gain).alias("_w")).select("*", "_w.*")
    key = ["_id", "_node", "_size"]
    summed = parts.groupBy(*key).agg(F.count_if(F.col("_chunk") == 0).cast("int").alias("_rows"), *[F.sum(c).alias(c) for c in found])
    # rows that are alike in id and text were summed together; each is given back
    each = summed.select(F.col("_id").alias("doc_id"), F.explode(F.array_repeat(F.lit(0), F.col("_rows"))), "_rows", *found)
    return whole.unionByName(each.select("doc_id", *[F.expr(f"{c} div _rows").alias(c) for c in found]))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from an id alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank (1, 2, 3... of the documents drawn, else null).

    Of the documents with `least_words` words or more, percent / 100 (rounded down) are drawn, by greatest score, ties by the
    smaller id, null ids last. A null, empty or wordless text has no features and weight 0; a null id gets the noise of
    "null"; repeated rows are drawn each by itself; an empty target gives every bucket the corpus' own share; an empty
    table gives no rows; further columns are ignored.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must be from 0 to 100")
    counted = bucket_counts(*_texts(docs, id_col, text_col))
    gain = gains(counted, bucket_counts(*_texts(target.select(F.lit(None).cast("long").alias("_none"), target_col), "_none", target_col)))
    rows = weights(docs, gain, id_col=id_col, text_col=text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = materialize(rows.withColumn("_in", F.col("words") >= least_words).withColumn("_row", F.monotonically_increasing_id()))
    draw = rows.filter("_in").count() * percent // 100
    order = [F.desc("_in"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()))  # the range in the upper bits, the place in it below
    span = F.shiftright("_at", 33)
    before, at = [], 0
    for r in ranged.groupBy(span.alias("span")).count().orderBy("span").collect():  # a row per range
        before.append((r["span"], at))
        at += r["count"]
    offsets = docs.sparkSession.createDataFrame(before, "_span long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    found = ranged.withColumn("_span", span).join(F.broadcast(offsets), "_span")
    return found.select("doc_id", "n_features", "weight", "score", F.when(F.col("_in") & (rank <= draw), rank).alias("rank"))
