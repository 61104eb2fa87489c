"""EDF recordings as Spark tables: signals by ranges of data records, and EDF+ annotations.

Signals come from a data source of its own, `tidewave_edf`: a file is split by bytes, and the task that a range falls to reads the
header and only the data records of the epochs that begin in its range. So a recording of any length is read by many tasks, and
none holds more than a block of epochs. Files are listed on the driver and opened by the tasks, so a path must be one that all of them can
reach: local or shared folders, or a URI that Arrow's file systems know.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

ANNOTATIONS = "EDF Annotations"
#: Epochs that a task reads at a time, and the bytes of a file that a task takes.
BLOCK_EPOCHS = 64
SPLIT_BYTES = 32 << 20

#: How many characters each field of a signal's header has, in the order of the format.
_FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("low", 8), ("high", 8), ("digital_low", 8), ("digital_high", 8), ("prefilter", 80), ("samples", 8), ("reserved", 32))
_TAL = re.compile(rb"([+-]\d+(?:\.\d*)?)(?:\x15(\d+(?:\.\d*)?))?\x14((?:[^\x00]*?\x14)?)\x00", re.S)
_SCALE = {"uv": 1.0, "mv": 1e3, "v": 1e6}


@dataclass(frozen=True)
class Header:
    start: str
    size: int
    records: int
    seconds: float
    signals: tuple[dict, ...]

    @property
    def record_bytes(self) -> int:
        return 2 * sum(s["samples"] for s in self.signals)


def header(data: bytes) -> Header:
    """The header of an EDF file's bytes."""
    if len(data) < 256 or not data[:8].decode("ascii", "replace").strip() == "0":
        raise ValueError("no EDF file")
    text = data[:256].decode("latin-1")
    n, at = int(text[252:256]), 256
    columns: dict[str, list[str]] = {}
    for name, width in _FIELDS:
        columns[name] = [data[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(n)]
        at += n * width
    signals = tuple(
        {"label": columns["label"][i], "unit": columns["unit"][i].lower().replace("µ", "u"), "samples": int(columns["samples"][i])}
        | {k: float(columns[k][i] or 0) for k in ("low", "high", "digital_low", "digital_high")}
        for i in range(n)
    )
    return Header(text[168:184], int(text[184:192]), int(text[236:244]), float(text[244:252]), signals)


def samples(records: bytes, head: Header, index: int) -> np.ndarray:
    """A signal's samples in microvolts (or its own unit where that is no voltage) over whole data records, without the header."""
    before = sum(s["samples"] for s in head.signals[:index])
    s = head.signals[index]
    whole = len(records) // head.record_bytes
    raw = np.frombuffer(records[: whole * head.record_bytes], "<i2").reshape(whole, -1)[:, before : before + s["samples"]]
    gain = (s["high"] - s["low"]) / (s["digital_high"] - s["digital_low"])
    return ((raw.ravel() - s["digital_low"]) * gain + s["low"]) * _SCALE.get(s["unit"], 1.0)


def annotations(data: bytes) -> Iterator[tuple[float, float, str]]:
    """(onset, duration, text) of an EDF+ file; entries without a text only keep time."""
    head = header(data)
    body = data[head.size :]
    for i, s in enumerate(head.signals):
        if s["label"] == ANNOTATIONS:
            before = 2 * sum(x["samples"] for x in head.signals[:i])
            for r in range(len(body) // head.record_bytes):
                at = r * head.record_bytes + before
                for m in _TAL.finditer(body[at : at + 2 * s["samples"]]):
                    for text in m[3].split(b"\x14"):
                        if text:
                            yield float(m[1]), float(m[2] or 0), text.decode("utf-8", "replace")


def read_annotations(spark: SparkSession, path: str, glob: str = "*Hypnogram.edf") -> DataFrame:
    """name, onset, duration, description: one row per annotation."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)

    def task(batches):
        for batch in batches:
            rows = [(name, *a) for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a in annotations(data)]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            types = (pa.string(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["name", "onset", "duration", "description"])

    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return named.mapInArrow(task, "name string, onset double, duration double, description string")


@dataclass
class EdfRange(InputPartition):
    """The bytes of a file from `first` up to `stop`: its task gives the epochs that begin there."""

    path: str
    first: int
    stop: int


def open_file(path: str):
    """A file that can be read from any place, and its size."""
    system, inside = fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)
    return system.open_input_file(inside)


def list_files(path: str, glob: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder, or of one file, whose names match; in order."""
    uri = re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path)
    system, inside = fs.FileSystem.from_uri(path) if uri else (fs.LocalFileSystem(), path)
    info = system.get_file_info(inside)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inside, recursive=True))
    prefix = path[: len(path.rstrip("/")) - len(inside.rstrip("/"))] if uri else ""
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and fnmatch.fnmatch(posixpath.basename(f.path), glob))


def read_header(file) -> Header:
    """The header of an open file, of which nothing else is read."""
    start = file.read_at(256, 0)
    if len(start) < 256 or not start[252:256].strip().isdigit():
        raise ValueError("no EDF file")
    return header(file.read_at(256 * (int(start[252:256]) + 1), 0))


def checked(head: Header, name: str, channels: Sequence[str], rate: float) -> list[int]:
    """The places of the channels; a missing one or one of another rate stops."""
    labels = [s["label"] for s in head.signals]
    if missing := [c for c in channels if c not in labels]:
        raise ValueError(f"{name} has no channel {', '.join(missing)}")
    for c in channels:
        own = head.signals[labels.index(c)]["samples"] / head.seconds
        if abs(own - rate) > 1e-9:
            raise ValueError(f"{name}: {c} has {own} Hz, not {rate}")
    return [labels.index(c) for c in channels]


@dataclass
class EdfReader(DataSourceReader):
    path: str
    glob: str
    channels: list[str]
    rate: float
    width: int
    split: int
    kept: list = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Conditions on a recording's name choose the files; all others are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and tuple(f.attribute) == ("name",):
                self.kept.append(f)
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        return all(name.startswith(f.value) if isinstance(f, StringStartsWith) else name in (f.value if isinstance(f, In) else (f.value,)) for f in self.kept)

    def partitions(self) -> list[EdfRange]:
        files = [(p, n) for p, n in list_files(self.path, self.glob) if self._wanted(posixpath.basename(p))]
        return [EdfRange(p, at, min(n, at + self.split)) for p, n in files for at in range(0, n, self.split)]

    def read(self, part: EdfRange) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file: Spark still asks once
            return
        name = posixpath.basename(part.path)
        with open_file(part.path) as file:
            head = read_header(file)
            places = checked(head, name, self.channels, self.rate)
            each = int(round(self.rate * head.seconds))  # samples of a data record
            records = (file.size() - head.size) // head.record_bytes

            def first_from(byte: int) -> int:
                """The first epoch whose first sample lies in a record that begins at this byte or after it."""
                record = max(0, -(-(byte - head.size) // head.record_bytes))
                return -(-record * each // self.width)

            low, high = first_from(part.first), min(first_from(part.stop), records * each // self.width)
            for at in range(low, high, BLOCK_EPOCHS):
                stop = min(high, at + BLOCK_EPOCHS)
                begin, end = at * self.width // each, -(-stop * self.width // each)
                block = file.read_at((end - begin) * head.record_bytes, head.size + begin * head.record_bytes)
                skip = at * self.width - begin * each
                x = np.stack([samples(block, head, i)[skip : skip + (stop - at) * self.width] for i in places]).astype(np.float32)
                epochs = x.reshape(len(places), stop - at, self.width).transpose(1, 0, 2)
                inner = pa.ListArray.from_arrays(pa.array(np.arange(epochs.shape[0] * epochs.shape[1] + 1) * self.width, pa.int32()), pa.array(np.ascontiguousarray(epochs).ravel()))
                signal = pa.ListArray.from_arrays(pa.array(np.arange(len(epochs) + 1) * len(places), pa.int32()), inner)
                columns = [pa.array([name] * len(epochs)), pa.array([head.start] * len(epochs)), pa.array(range(at, stop), pa.int64()), signal]
                yield pa.RecordBatch.from_arrays(columns, names=["name", "start", "epoch_idx", "signal"])


class EdfSource(DataSource):
    """spark.read.format("tidewave_edf"): options path, glob, channels (a line each), rate, epochSeconds, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "tidewave_edf"

    def schema(self) -> str:
        return "name string, start string, epoch_idx long, signal array<array<float>>"

    def reader(self, schema) -> EdfReader:
        o = self.options
        rate = float(o["rate"])
        return EdfReader(o["path"], o.get("glob", "*PSG.edf"), o["channels"].split("\n"), rate, int(round(rate * float(o.get("epochSeconds", 30)))), int(o.get("splitBytes", SPLIT_BYTES)))


def read_epochs(
    spark: SparkSession, path: str, channels: list[str], rate: float, epoch_seconds: float = 30.0, glob: str = "*PSG.edf", split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """name, start, epoch_idx, signal ([channel][sample] in microvolts): whole epochs of each recording, a tail dropped.

    Only the channels that are asked for are kept, and filters on `name` leave out whole files. A missing channel or another rate
    than asked for stops the query; nothing is resampled. A folder without such files has no rows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EdfSource)
    found = spark.read.format("tidewave_edf").option("glob", glob).option("channels", "\n".join(channels)).option("rate", rate)
    return found.option("epochSeconds", epoch_seconds).option("splitBytes", split_bytes).load(path)


def read_headers(spark: SparkSession, path: str, glob: str = "*.edf") -> DataFrame:
    """name, path, start, records, seconds, labels: the header of each file, read where Spark deals the paths to."""
    paths = spark.createDataFrame([(p,) for p, _ in list_files(path, glob)], "path string")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.column(0).to_pylist():
                with open_file(p) as file:
                    head = read_header(file)
                rows.append((posixpath.basename(p), p, head.start, head.records, head.seconds, [s["label"] for s in head.signals]))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.string()))
            names = ["name", "path", "start", "records", "seconds", "labels"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return paths.repartition("path").mapInArrow(task, "name string, path string, start string, records long, seconds double, labels array<string>")


def refuse_other_starts(headers: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (signal_name, label_name) whose two files begin at the same time; one pair that doesn't stops with its names.

    The starts are whole seconds in a file's header, so any difference counts.
    """
    starts = headers.select("name", "start")
    for side in ("signal", "label"):
        pairs = pairs.join(starts.select(F.col("name").alias(f"{side}_name"), F.col("start").alias(f"{side}_start")), f"{side}_name", "left")
    same = F.col("signal_start").eqNullSafe(F.col("label_start")) & F.col("signal_start").isNotNull()
    told = F.concat(F.lit("the files of a recording begin at different times: "), "signal_name", F.lit(" "), F.coalesce("signal_start", F.lit("none")), F.lit(", "), "label_name", F.lit(" "), F.coalesce("label_start", F.lit("none")))
    return pairs.withColumn("signal_start", F.when(same, F.col("signal_start")).otherwise(F.raise_error(told).cast("string")))
