"""Dense row-major tensors as a Spark data source: ranges of records are read and written by tasks, none passes through the driver.

A tensor is one raw file, or a folder with raw parts and a manifest that says at which byte each begins; the parts in
the order of their names, one after the other, are the raw file. A record is one place of the tensor: its index columns, and a
payload of so many bytes or values of one kind.

Reading: a partition is a range of records. Comparisons of index columns with numbers narrow the box that is read, if the session
allows Python sources to take filters (`spark.sql.python.filterPushdown.enabled`); ranges outside of it
are neither planned nor read. Writing: rows come in the order of the tensor, each task writes a part that begins where its
first record does, and the commit takes the parts only if they cover the tensor without gap or overlap. What a
failed job has written is removed; the manifest is put in place last, so an older tensor stays readable until then.

Folders and stores that pyarrow's file systems know can be read and written (local and mounted folders, S3, GCS, HDFS).
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from beamquarry.operators.beamform import payload_matrix

MANIFEST = "manifest.json"
#: Bytes of a partition; records and bytes that become one Arrow batch at most; a gap that is not worth a read of its own.
SPLIT_BYTES, BATCH_RECORDS, BATCH_BYTES, GAP_BYTES = 32 << 20, 1 << 15, 4 << 20, 1 << 18
KINDS = {"f4": ("float", pa.float32()), "i1": ("tinyint", pa.int8())}


@dataclass(frozen=True)
class Layout:
    """Index columns with their Spark types and lengths, slowest first; value columns; and their kind: "f4", "i1" or "bytes"."""

    index: tuple[tuple[str, str, int], ...]
    values: tuple[str, ...]
    kind: str
    #: Bytes of a payload, for kind "bytes".
    payload: int = 0

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(n for _, _, n in self.index)

    @property
    def records(self) -> int:
        return math.prod(self.shape)

    @property
    def width(self) -> int:
        return self.payload if self.kind == "bytes" else np.dtype(self.kind).itemsize * len(self.values)

    @property
    def bytes(self) -> int:
        return self.records * self.width

    @property
    def ddl(self) -> str:
        kind = "binary" if self.kind == "bytes" else KINDS[self.kind][0]
        return ", ".join([*(f"{name} {spark}" for name, spark, _ in self.index), *(f"{v} {kind}" for v in self.values)])

    def option(self) -> str:
        return json.dumps([self.index, self.values, self.kind, self.payload])

    @classmethod
    def parse(cls, text: str) -> Layout:
        index, values, kind, payload = json.loads(text)
        return cls(tuple((a, b, c) for a, b, c in index), tuple(values), kind, payload)

    def batch(self, places: np.ndarray, raw: bytes) -> pa.RecordBatch:
        """Rows of the records at these places."""
        at = np.unravel_index(places, self.shape)
        columns = [pa.array(x.astype(np.int32 if kind == "int" else np.int64)) for x, (_, kind, _) in zip(at, self.index, strict=True)]
        if self.kind == "bytes":
            columns.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(self.payload), len(places), [None, pa.py_buffer(raw)]).cast(pa.binary()))
        else:
            data = np.frombuffer(raw, np.dtype(self.kind).newbyteorder("<")).reshape(-1, len(self.values))
            columns += [pa.array(np.ascontiguousarray(data[:, i]), KINDS[self.kind][1]) for i in range(len(self.values))]
        return pa.RecordBatch.from_arrays(columns, [*(name for name, _, _ in self.index), *self.values])

    def raw(self, batch: pa.RecordBatch) -> bytes:
        """The bytes of a batch of rows; a null or a payload of another length is an error."""
        columns = [batch[v] for v in self.values]
        if any(c.null_count for c in columns):
            raise ValueError("a tensor has no place for nulls")
        if self.kind == "bytes":
            return payload_matrix(columns[0], self.payload).tobytes()
        return np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(np.dtype(self.kind).newbyteorder("<")).tobytes()


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pyarrow.fs.LocalFileSystem(), path) if path.startswith("/") else pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def parts_of(path: str) -> list[tuple[int, int, str]]:
    """(first byte, bytes, file) of a tensor's parts in order; a plain file is its only part."""
    fs, at = place(path)
    info = fs.get_file_info(at)
    if info.type == pyarrow.fs.FileType.File:
        return [(0, info.size, at)]
    with fs.open_input_stream(f"{at}/{MANIFEST}") as source:
        return [(first, size, f"{at}/{name}") for first, size, name in json.loads(source.read())["parts"]]


def close_all(files: dict) -> None:
    for name, file in files.items():
        if name:
            file.close()


class Records(InputPartition):
    """Records from `first` up to `last`."""

    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class TensorReader(DataSourceReader):
    def __init__(self, path: str, layout: Layout, split: int):
        self.path, self.layout, self.split = path, layout, split
        self.box = [(0, n) for n in layout.shape]

    def narrow(self, name: str, low: int, high: int) -> None:
        k = [n for n, _, _ in self.layout.index].index(name)
        a, b = self.box[k]
        self.box[k] = (max(a, low), max(max(a, low), min(b, high)))

    def partitions(self) -> list[Records]:
        held = sum(size for _, size, _ in parts_of(self.path))
        if held != self.layout.bytes:
            raise ValueError(f"{self.path} has {held} bytes; expected {self.layout.bytes}")
        if any(a >= b for a, b in self.box):
            return []
        first = int(np.ravel_multi_index([a for a, _ in self.box], self.layout.shape))
        last = int(np.ravel_multi_index([b - 1 for _, b in self.box], self.layout.shape)) + 1
        step = max(1, self.split // max(1, self.layout.width))
        found = [Records(k, min(last, k + step)) for k in range(first, last, step)]
        return [p for p in found if any(True for _ in self.reads(p))]

    def reads(self, part: Records) -> Iterator[tuple[int, int, np.ndarray | None]]:
        """(first, last, kept) of the stretches of a partition that are read, and which of their records are in the box (None: all)."""
        whole = all((a, b) == (0, n) for (a, b), n in zip(self.box[1:], self.layout.shape[1:], strict=True))
        step = max(1, min(BATCH_RECORDS, BATCH_BYTES // max(1, self.layout.width)))
        for low in range(part.first, part.last, step):
            high = min(part.last, low + step)
            if whole:
                yield low, high, None
                continue
            at = np.unravel_index(np.arange(low, high), self.layout.shape)
            inside = np.flatnonzero(np.logical_and.reduce([(x >= a) & (x < b) for x, (a, b) in zip(at, self.box, strict=True)]))
            breaks = np.flatnonzero(np.diff(inside) * self.layout.width > GAP_BYTES) + 1
            for run in np.split(inside, breaks):
                if len(run):
                    yield low + int(run[0]), low + int(run[-1]) + 1, run - run[0]

    def bytes_of(self, first: int, last: int, files: dict | None = None) -> bytes:
        """The records from `first` up to `last` as they are; files that are opened stay in `files`, if given."""
        fs, _ = place(self.path)
        width, held, pieces = self.layout.width, {} if files is None else files, []
        if "" not in held:
            held[""] = parts_of(self.path)
        try:
            for start, size, name in held[""]:
                a, b = max(start, first * width), min(start + size, last * width)
                if a < b:
                    if name not in held:
                        held[name] = fs.open_input_file(name)
                    pieces.append(held[name].read_at(b - a, a - start))
        finally:
            if files is None:
                close_all(held)
        return pieces[0] if len(pieces) == 1 else b"".join(pieces)

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        try:
            for first, last, kept in self.reads(part):
                raw, places = self.bytes_of(first, last, files), np.arange(first, last)
                if kept is not None and len(kept) < len(places):
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, self.layout.width)[kept].tobytes()
                    places = places[kept]
                yield self.layout.batch(places, raw)
        finally:
            close_all(files)


class FilteredReader(TensorReader):
    """A reader that takes comparisons of an index column with a number; what it takes is not evaluated again."""

    def pushFilters(self, filters):  # noqa: N802  the interface's name
        names = {n for n, _, _ in self.layout.index}
        for f in filters:
            column, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if len(column) != 1 or column[0] not in names or not isinstance(value, int):
                yield f
            elif isinstance(f, EqualTo):
                self.narrow(column[0], value, value + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.narrow(column[0], value + isinstance(f, GreaterThan), 1 << 62)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.narrow(column[0], 0, value + isinstance(f, LessThanOrEqual))
            else:
                yield f


@dataclass
class Part(WriterCommitMessage):
    first: int
    size: int
    name: str


class TensorWriter(DataSourceArrowWriter):
    """Parts go to a folder of the job's own, which is there before the tasks are and goes with the job if that fails."""

    def __init__(self, path: str, layout: Layout):
        self.path, self.layout, self.job = path, layout, f"job-{uuid.uuid4().hex}"
        fs, at = place(path)
        fs.create_dir(f"{at}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, at = place(self.path)
        out, name, first, following = None, "", 0, 0
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                places = batch["_at"].to_numpy()
                if out is None:
                    first = following = int(places[0])
                    name = f"{self.job}/part-{first * self.layout.width:020d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{at}/{name}")
                if places[0] != following or (np.diff(places) != 1).any():
                    raise ValueError(f"{self.path}: places from {following} on are not there once each")
                out.write(self.layout.raw(batch))
                following = int(places[-1]) + 1
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(f"{at}/{name}")
            raise
        if out is not None:
            out.close()
        return Part(first * self.layout.width, (following - first) * self.layout.width, name)

    def commit(self, messages: list[Part | None]) -> None:
        parts, reached = sorted((m.first, m.size, m.name) for m in messages if m is not None and m.size), 0
        for first, size, _ in parts:
            if first != reached:
                raise ValueError(f"{self.path} would have a gap or an overlap at byte {reached}; expected {self.layout.bytes} bytes")
            reached += size
        if reached != self.layout.bytes:
            raise ValueError(f"{self.path} would have {reached} bytes; expected {self.layout.bytes}")
        fs, at = place(self.path)
        with fs.open_output_stream(f"{at}/{self.job}/{MANIFEST}") as out:
            out.write(json.dumps({"bytes": reached, "parts": parts}).encode())
        fs.move(f"{at}/{self.job}/{MANIFEST}", f"{at}/{MANIFEST}")
        kept = {f"{at}/{name}" for _, _, name in parts}
        for info in fs.get_file_info(pyarrow.fs.FileSelector(f"{at}/{self.job}")):  # of attempts that were lost
            if info.path not in kept:
                fs.delete_file(info.path)
        for info in fs.get_file_info(pyarrow.fs.FileSelector(at)):  # an older tensor
            if info.type == pyarrow.fs.FileType.Directory and info.base_name != self.job:
                fs.delete_dir(info.path)

    def abort(self, messages: list[Part | None]) -> None:
        fs, at = place(self.path)
        if fs.get_file_info(f"{at}/{self.job}").type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(f"{at}/{self.job}")
        if fs.get_file_info(at).type == pyarrow.fs.FileType.Directory and not fs.get_file_info(pyarrow.fs.FileSelector(at)):
            fs.delete_dir(at)


class TensorSource(DataSource):
    """Options: path, layout (of Layout.option), split (bytes of a partition), filters (whether the reader takes them)."""

    @classmethod
    def name(cls) -> str:
        return "beamquarry_tensor"

    def layout(self) -> Layout:
        return Layout.parse(self.options["layout"])

    def schema(self) -> str:
        return self.layout().ddl

    def reader(self, schema) -> TensorReader:
        kind = FilteredReader if self.options.get("filters") == "true" else TensorReader
        return kind(self.options["path"], self.layout(), int(self.options.get("split", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> TensorWriter:
        return TensorWriter(self.options["path"], self.layout())


def read(spark: SparkSession, path: str, layout: Layout, split: int = SPLIT_BYTES) -> DataFrame:
    """A row for each record, with the index columns and the values."""
    spark.dataSource.register(TensorSource)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(TensorSource.name()).options(path=path, layout=layout.option(), split=split, filters=filters).load()


def write(rows: DataFrame, path: str, layout: Layout, split: int = SPLIT_BYTES) -> None:
    """Rows with the index columns and the values, one for each place, as a folder of raw parts.

    Rows are dealt by range of their place, so each part holds places in a row; the parts that the sort needs beside
    are bounded by `split` bytes, and their number by the tensor's size.
    """
    rows.sparkSession.dataSource.register(TensorSource)
    at = F.lit(0).cast("long")
    for name, _, n in layout.index:
        at = at * n + F.when((F.col(name) >= 0) & (F.col(name) < n), F.col(name)).otherwise(F.raise_error(F.lit(f"{name} lies outside of the tensor")).cast("long"))
    parts = max(1, -(-layout.bytes // split))
    placed = rows.select(at.alias("_at"), *layout.values)
    dealt = placed.repartition(1) if parts == 1 else placed.repartitionByRange(parts, "_at")
    job = dealt.sortWithinPartitions("_at").write.format(TensorSource.name()).mode("overwrite").options(path=path, layout=layout.option())
    try:
        job.save()
    except PySparkException as e:  # a Python source's own errors arrive as text
        if "ValueError" in str(e):
            raise ValueError(str(e)) from e
        raise
