"""Helpers shared by the text operators: input tables, lineage cuts and Arrow word arrays."""

from __future__ import annotations

import ctypes
import gc
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Texts are worked on in slices of about this many UTF-8 bytes, so that a batch of long texts stays small in memory.
SLICE_BYTES = 4 << 20
#: Spark passes rows to Python in Arrow batches of about so many bytes at most; they lie outside the heap, several copies at once.
ARROW_BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table. They go over as Arrow: from a list, Spark makes an RDD that each executor reads with a Python
    daemon and workers of its own, beside those of the functions (some 80 MB)."""
    kind = StructType.fromDDL(schema)
    fields = to_arrow_schema(kind)
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields), kind)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of an Arrow batch to ARROW_BATCH_BYTES; a lower one stays. Results don't depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = spark.conf.get(name).removesuffix("b")
    if limit.isdigit() and int(limit) > ARROW_BATCH_BYTES:
        spark.conf.set(name, str(ARROW_BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidewave-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session, dots written as two underscores, for the queries planned in here; they come back afterwards."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    was = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in was.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def dropping_shuffles(spark: SparkSession):
    """Queries planned in here remove their shuffle files when they end, not when the driver happens to collect its garbage.

    For tables that are cut from their lineage and results that are fetched once: jobs of many rounds would else keep the
    files of every round on the executors' disks.
    """
    return setting(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def materialize(df: DataFrame, forget: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    A checkpoint keeps what the planner had found out about its values. In loops this grows with each round until planning takes
    longer than the work, so they `forget` it.
    """
    shared_dir(df.sparkSession)
    with dropping_shuffles(df.sparkSession):
        if not forget:
            return df.select("*").checkpoint(eager=True)
        with setting(df.sparkSession, spark__sql__constraintPropagation__enabled="false"):
            return df.select("*").checkpoint(eager=True)


_KEPT: list = []


def kept(function: Callable) -> Callable:
    """functools.cache for large things that a worker keeps from task to task, until another operator's task calls release()."""
    _KEPT.append(cache(function))
    return _KEPT[-1]


def release(keep: Callable | None = None, collect: bool = False) -> None:
    """Gives the memory that a worker doesn't use back to the machine, and what `kept` functions other than `keep` hold; workers live on
    from stage to stage, and so would all that any of them has needed. Cheap enough for every batch, unless it must `collect`."""
    for f in _KEPT:
        if f is not keep and f.cache_info().currsize:
            f.cache_clear()
            collect = True
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        pass


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A folder of its own below the shared one, for files that are no Spark table."""
    return posixpath.join(shared_dir(spark), f"{kind}-{uuid.uuid4().hex}")


#: A key is hot if it holds over one row in so many; fewer than this many keys can be.
HOT_SHARE = 64


def join_hot(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join where right has a key once at most and left may have one very often.

    Rows of left under a hot key stay where they are: right's rows of these, HOT_SHARE at most, are broadcast. The rest is
    joined by a shuffle. left is read twice, so hand over a table that is cut from its lineage.
    """
    with dropping_shuffles(left.sparkSession):
        counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        top = counts.orderBy(F.desc("_n")).limit(HOT_SHARE).agg(F.collect_list(F.struct("_n", key)).alias("_t")).first()[0]
        n = left.count() if top else 0
    hot = [r[key] for r in top if r["_n"] * HOT_SHARE > n and r["_n"] > 1 and r[key] is not None]
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    return left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key).unionByName(left.filter(~is_hot).join(right, key))


def add_crc32(text):
    """Unsigned CRC-32 of a text's UTF-8 bytes; of a null text that of no bytes."""
    return F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long"))


def text_node(text: Column) -> Column:
    """XXH64 of a text's UTF-8 bytes; of a null text that of no bytes."""
    return F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b"")))


#: Rows of a few numbers that may be broadcast: some ten megabytes.
BROADCAST_ROWS = 200_000


def few(keys: DataFrame) -> DataFrame:
    """A table of a few numbers a row, to be broadcast if it has BROADCAST_ROWS rows at most. It is counted, so cut it first."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def keep_rows(docs: DataFrame, rows: DataFrame, heads: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each of the distinct heads (_id, _hash): id, null or not, and XXH64 of the text. rows has these of all docs.

    What stays is decided on these numbers alone. Whichever are fewer, those that go or those that stay, are broadcast up to
    BROADCAST_ROWS, so texts aren't shuffled; beyond that docs is joined by a shuffle. Only rows that docs repeats
    are brought together.
    """
    keys = ["_no_id", "_head_id", "_head_hash"]

    def keyed(df: DataFrame, i: Column, text_hash: Column) -> DataFrame:
        return df.withColumns(dict(zip(keys, (i.isNull(), F.coalesce(i, F.lit(0).cast("long")), text_hash), strict=True)))

    counted = keyed(rows, F.col("_id"), F.col("_hash")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_times"))
    won = keyed(heads, F.col("_id"), F.col("_hash")).select(*keys, F.lit(True).alias("_won"))
    marked = materialize(counted.join(won, keys, "left").select(*keys, "_times", F.coalesce("_won", F.lit(False)).alias("_won")))
    n = marked.agg(F.count_if("_won").alias("stay"), F.count_if(~F.col("_won")).alias("go"), F.count_if(F.col("_won") & (F.col("_times") > 1)).alias("again")).first()
    left = keyed(docs, F.col(id_col).cast("long"), text_node(F.col(text_col)))
    if n["go"] <= min(n["stay"], BROADCAST_ROWS):
        kept = left.join(F.broadcast(marked.filter(~F.col("_won")).select(*keys)), keys, "left_anti") if n["go"] else left
    else:
        kept = left.join(few(marked.filter("_won").select(*keys)), keys, "left_semi")
    if n["again"]:
        again = few(marked.filter(F.col("_won") & (F.col("_times") > 1)).select(*keys))
        kept = kept.join(again, keys, "left_anti").unionByName(kept.join(again, keys, "left_semi").dropDuplicates(keys))
    return kept.select(*docs.columns)


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) of a string or binary column in order, each of about `size` bytes or one row; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = pc.fill_null(column, b"")
    else:
        column = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield at, column.slice(at, to - at)
        at = to


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts in order, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()) if pa.types.is_string(texts.type) else texts)
    flat = lists.flatten()
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.not_equal(flat, pa.scalar("", flat.type))
    mask = full.to_numpy(zero_copy_only=False)
    if not mask.all():
        flat, owner = flat.filter(full), owner[mask]
    return flat, np.bincount(owner, minlength=len(texts)).astype(np.int64)
