"""WARC archives with revisit resolution.

Only headers are shuffled. Each task first writes its pages as response records, one gzip member each, to a file of its own
and hands on their headers: id, URL, date, payload digest and size, and where the member lies. The headers of a digest elect
the one with the largest id as the response; the others become revisit records, which carry no payload and name the
response they refer to by record id, URL and date. Then each file is gone through in order: members of responses are copied as
they are, and revisits are written anew from their headers. The first files are removed at the end. Reading goes the other
way: headers come from the archives, and revisits are joined to their responses by the record id.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, join_hot, materialize
from .sstable import open_fs

#: Payloads under so many bytes are always written whole.
LEAST_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def record_id(*parts: object) -> str:
    """A record's id follows from the page's id, its payload's digest, and its place in the input: no two records share one,
    and a task that runs again gives the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def digest_of(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def hex_digest(value: str) -> str:
    return base64.b32decode(value.removeprefix("sha1:")).hex()


def _header(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def clean_uri(url: str | None) -> str:
    return "".join(c for c in url or "" if c > " " and c != "\x7f")


def _record(kind: str, page_id: int | None, url: str, date: str, digest: str, name: str, block: bytes, more: list) -> bytes:
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", name),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", digest),
        *more,
        ("X-Page", "" if page_id is None else page_id),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return _header(fields) + block + b"\r\n\r\n"


def _http(size: int) -> bytes:
    return HTTP + f"Content-Length: {size}\r\n\r\n".encode()


def response(page_id: int | None, url: str, date: str, payload: bytes, name: str) -> bytes:
    """A response record's bytes, not compressed."""
    return _record("response", page_id, url, date, digest_of(payload), name, _http(len(payload)) + payload, [])


def revisit(page_id: int | None, url: str, date: str, size: int, digest: str, name: str, refers: dict) -> bytes:
    """A revisit record's bytes, not compressed; refers has the response's id, record, url and date."""
    more = [
        ("WARC-Profile", PROFILE),
        ("WARC-Refers-To", refers["record"]),
        ("WARC-Refers-To-Target-URI", refers["url"]),
        ("WARC-Refers-To-Date", refers["date"]),
        ("X-Refers-To-Page", refers["id"]),
    ]
    return _record("revisit", page_id, url, date, digest, name, _http(size), more)


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


_STAGED = {
    "id": pa.int64(), "url": pa.string(), "date": pa.string(), "digest": pa.string(), "size": pa.int64(), "record": pa.string(),
    "file": pa.string(), "at": pa.int64(), "length": pa.int64(),
}
_NAMES = {pa.int64(): "long", pa.string(): "string"}


def _stage_task(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name = f"{part:06d}-{uuid.uuid4().hex}"  # of this attempt alone, so that headers always fit their file
        at = number = 0
        with fs.open_output_stream(posixpath.join(root, name)) as out:
            for batch in batches:
                rows = []
                for page_id, url, date, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload, url = (html or "").encode(), clean_uri(url)
                    digest = digest_of(payload)
                    key = record_id(page_id, digest, part, number)
                    data = _member(response(page_id, url, date, payload, key))
                    out.write(data)
                    rows.append((page_id, url, date, digest, len(payload), key, name, at, len(data)))
                    at, number = at + len(data), number + 1
                columns = zip(*rows, strict=True) if rows else [()] * len(_STAGED)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _STAGED.values(), strict=True)], names=list(_STAGED))

    return run


def elect(heads: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """heads with refers: null for a response, else the id, record, url and date of the response that the page revisits.

    Of the pages with one digest and `least` bytes or more the largest id is the response, the greatest record id of equals
    being the one referred to; all pages with that id stay responses. Without any id in a digest all its pages stay.
    """
    whole = F.col("size") < least
    first = F.when(F.col("id").isNotNull(), F.struct("id", "record"))
    best = heads.filter(~whole).groupBy("digest").agg(F.max_by(F.struct("id", "record", "url", "date"), first).alias("_best"))
    told = join_hot(heads.filter(~whole), materialize(best), "digest")
    is_revisit = F.col("_best").isNotNull() & ~F.col("id").eqNullSafe(F.col("_best.id"))
    told = told.select(*heads.columns, F.when(is_revisit, F.col("_best")).alias("refers"))
    return told.unionByName(heads.filter(whole).withColumn("refers", F.lit(None).cast(told.schema["refers"].dataType)))


def _write_task(staged: str, folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        temporary = posixpath.join(root, f".{part:06d}-{uuid.uuid4().hex}")
        written, name, source = 0, None, None
        with fs.open_output_stream(temporary) as out:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["refers"] is None:
                        if r["file"] != name:
                            if source:
                                source.close()
                            name, source = r["file"], fs.open_input_file(posixpath.join(open_fs(staged)[1], r["file"]))
                        out.write(source.read_at(r["length"], r["at"]))
                    else:
                        out.write(_member(revisit(r["id"], r["url"], r["date"], r["size"], r["digest"], r["record"], r["refers"])))
                    written += 1
        if source:
            source.close()
        if written:
            fs.move(temporary, posixpath.join(root, f"part-{part:06d}.warc.gz"))
        else:
            fs.delete_file(temporary)
        names = [[posixpath.join(folder, f"part-{part:06d}.warc.gz")], [written]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in names], names=["file", "records"])

    return run


def write(
    pages: DataFrame, folder: str, *, id_col="page_id", url_col="url", text_col="html", date_col: str | None = None, least: int = LEAST_BYTES
) -> list:
    """Write deduplicated archives to `folder`; returns a row (file, records) for each archive.

    Every page gives one record. Dates come from date_col or are all DATE. A null or odd URL is written as far as it has
    visible characters. Only one short row an archive comes to the driver.
    """
    date = F.lit(DATE) if date_col is None else F.coalesce(F.col(date_col).cast("string"), F.lit(DATE))
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), date, F.col(text_col))
    staged = posixpath.join(folder, f"_staged-{uuid.uuid4().hex}")
    heads = materialize(rows.mapInArrow(_stage_task(staged), ", ".join(f"{n} {_NAMES[t]}" for n, t in _STAGED.items())))
    n = heads.select("file").distinct().count()
    told = elect(heads, least).repartition(max(n, 1), "file").sortWithinPartitions("file", "at")
    found = told.mapInArrow(_write_task(staged, folder), "file string, records long").filter("records > 0").collect()
    fs, root = open_fs(staged)
    if fs.get_file_info(root).type != pafs.FileType.NotFound:
        fs.delete_dir(root)
    return found


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, gzip member by member."""
    pending, unpack, done = b"", zlib.decompressobj(31), []
    while True:
        if not pending:
            pending = stream.read(1 << 20)
            if not pending:
                return
        done.append(unpack.decompress(pending))
        pending = unpack.unused_data if unpack.eof else b""
        if unpack.eof:
            raw, done, unpack = b"".join(done), [], zlib.decompressobj(31)
            head, _, rest = raw.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError("no WARC record")
            fields = dict(line.partition(": ")[::2] for line in lines[1:])
            yield fields, rest[: int(fields["Content-Length"])]


SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, payload binary"


def _read_task(payloads: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]
        number = lambda x: int(x) if x else None
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = open_fs(file)
                rows: list[tuple] = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for f, block in records(stream):
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length")).split(b":")[1])
                        whole = f["WARC-Type"] == "response"
                        if whole and digest_of(body) != f["WARC-Payload-Digest"]:
                            raise ValueError("a payload differs from its digest")
                        rows.append(
                            (
                                number(f["X-Page"]), f["WARC-Target-URI"], size, hex_digest(f["WARC-Payload-Digest"]),
                                f["WARC-Type"], number(f.get("X-Refers-To-Page")), f["WARC-Record-ID"],
                                f.get("WARC-Refers-To"), body if whole and payloads else None,
                            )
                        )
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def read(spark, files: list, payloads: bool = True) -> DataFrame:
    """The records of the archives, one task a file. Responses are checked against their digests. No files give no rows;
    null and empty payloads come back as empty ones, null URLs as empty."""
    listed = spark.createDataFrame([(f["file"],) for f in files], "file string").repartition(max(1, len(files)))
    return listed.mapInArrow(_read_task(payloads), SCHEMA)


def resolve(archive: DataFrame) -> DataFrame:
    """page_id, url, payload for every record: revisits get the payload of the response they refer to.

    A revisit whose response isn't there gets null; repeated rows come as often as they are; an empty archive gives no rows.
    """
    own = archive.filter("record_type = 'response'").select(F.col("record_id").alias("_rid"), F.col("payload").alias("_body"))
    revisits = archive.filter("record_type = 'revisit'").join(own, F.col("refers_to_record") == F.col("_rid"), "left")
    kept = archive.filter("record_type = 'response'").select("page_id", "url", "payload")
    return kept.unionByName(revisits.select("page_id", "url", F.col("_body").alias("payload")))


def archive(pages: DataFrame, folder: str | None = None, payloads: bool = False, **columns) -> DataFrame:
    """Write the pages as deduplicated archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of records with equal payloads of 1000 bytes or more the one with the largest page_id is the response. A null payload
    is empty, a null id never beats another (where all are null each is written whole), an empty table writes no file; texts of
    any length are one record; repeated rows of the response's page are responses too; further columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or fresh_dir(spark, "warc")
    found = read(spark, write(pages, folder, **columns), payloads)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
