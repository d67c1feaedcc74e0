"""Files of units of one length, such as records or frames, as a splittable source for tables and streams.

The source gives ``path``, ``offset`` and ``value`` (the bytes of a unit); what a unit means is left to the decoders. A file is cut into
ranges of whole units that tasks read on their own. A table also gives what is left at the end of a file, shorter than
a unit, so that decoders can reject it with a reason; a stream waits for the rest of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "fixed_units"
SCHEMA = "path STRING, offset BIGINT, value BINARY"
SPLIT_BYTES, BATCH_BYTES = 32 << 20, 4 << 20


class Span(InputPartition):
    """Bytes ``start`` to ``end`` of a file; picklable, as Spark sends it to a task."""

    def __init__(self, path: str, start: int, end: int) -> None:
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def _files(path: str) -> dict[str, int]:
    """Sizes of a file or of the files below a folder; names that begin with an underscore or a dot are left out."""
    system, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    (info,) = system.get_file_info([place])
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
    root = path[: len(path) - len(place)] if path.endswith(place) else path.partition(place)[0]
    shown = [i for i in found if i.type == fs.FileType.File and not any(p[:1] in "_." for p in i.path[len(place) :].split("/") if p)]
    return {f"{root}{i.path}": i.size for i in sorted(shown, key=lambda i: i.path)}


def _spans(path: str, start: int, end: int, unit: int, split: int) -> list[Span]:
    step = max(split // unit, 1) * unit
    return [Span(path, at, min(at + step, end)) for at in range(start, end, step)]


def _read(span: Span, unit: int) -> Iterator[pa.RecordBatch]:
    system, place = fs.FileSystem.from_uri(span.path if ":" in span.path else f"file://{span.path}")
    step = max(BATCH_BYTES // unit, 1) * unit
    with system.open_input_file(place) as file:
        for at in range(span.start, span.end, step):
            file.seek(at)
            raw = file.read(min(step, span.end - at))
            count = len(raw) // unit
            parts = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(unit), count, [None, pa.py_buffer(raw)]).cast(pa.binary())]
            if len(raw) > count * unit:
                parts.append(pa.array([raw[count * unit :]], pa.binary()))
            value = pa.concat_arrays(parts)
            offset = pa.array(range(at, at + len(value) * unit, unit), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.repeat(span.path, len(value)), offset, value], names=["path", "offset", "value"])


class FixedUnits(DataSource):
    """Options: ``path``, ``unit`` (bytes) and ``splitbytes`` (of a task)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TableReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return StreamReader(self.options)


class _Options:
    def __init__(self, options) -> None:
        self.path, self.unit = options["path"], int(options["unit"])
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        if self.unit <= 0:
            raise ValueError("a unit has at least one byte")


class TableReader(_Options, DataSourceReader):
    def partitions(self) -> list[Span]:
        return [s for path, size in _files(self.path).items() for s in _spans(path, 0, size, self.unit, self.split)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.unit)


class StreamReader(_Options, DataSourceStreamReader):
    """Offsets are the bytes taken of every file; files may grow and new ones may come, but not shrink or go."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {path: size // self.unit * self.unit for path, size in _files(self.path).items() if size >= self.unit}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [s for path, size in end.items() for s in _spans(path, start.get(path, 0), size, self.unit, self.split)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.unit)


def read_units(spark: SparkSession, path: str, unit: int, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The units of a file or folder, a shorter rest of a file included."""
    spark.dataSource.register(FixedUnits)
    return spark.read.format(NAME).options(path=path, unit=unit, splitbytes=split_bytes).load()


def stream_units(spark: SparkSession, path: str, unit: int, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The whole units of a folder's files as they come, each once, also over a restart from the checkpoint."""
    spark.dataSource.register(FixedUnits)
    return spark.readStream.format(NAME).options(path=path, unit=unit, splitbytes=split_bytes).load()


def write_units(rows: DataFrame, path: str, value: str = "value") -> int:
    """Write a column of bytes one after the other, a file per task; returns the number of values.

    A file gets its name when it is complete, so a task that fails leaves nothing that is read, and one that
    runs again replaces its file. Null values are left out.
    """
    run_id = uuid.uuid4().hex[:8]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        task, count = TaskContext.get(), 0
        hidden, name = f"{place}/_{uuid.uuid4().hex}", f"{place}/{run_id}-{task.partitionId():06d}.bin"
        system.create_dir(place, recursive=True)
        with system.open_output_stream(hidden, compression=None) as file:
            for batch in batches:
                for unit in batch.column(0).drop_null():
                    file.write(unit.as_buffer())
                    count += 1
        if count:
            system.move(hidden, name)
        else:
            system.delete_file(hidden)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["n"])

    return rows.select(value).mapInArrow(write, "n long").agg({"n": "sum"}).first()[0] or 0
