"""Binary matrices and image containers as Spark data sources, ``matrix`` and ``images``.

A matrix file is two 32-bit integers, the number of columns and their length, and then the columns, 32-bit floats one after another. A
container is a 32-bit number of images, a table of 64-bit offsets, and at each offset two 32-bit integers, width and height, and the
pixels, a column after another. All little-endian (fixed values).

A path is such a file or a folder of parts, whose columns or images are numbered through in order of their names. A read is split by
number ranges that are sought in the file; comparisons with ``number`` choose what is sought at all, and pixels that the given schema
leaves out are not read. Paths are opened by Arrow's file systems in the tasks; the driver reads only headers.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from marginalia.runtime import ship_package

MATRIX = "number long, v array<float>"
IMAGES = "number long, height int, width int, pixels binary"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def _parts(path: str) -> list[str]:
    """Files of a path in order of name; names that begin with a dot or an underscore are not data."""
    system, where = _open(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [where]
    found = system.get_file_info(fs.FileSelector(where))
    return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


@dataclass
class Range(InputPartition):
    """Numbers first to last (excluded) of the whole; ``before`` stand in earlier files."""

    file: str
    first: int
    last: int
    before: int


@dataclass
class Committed(WriterCommitMessage):
    name: str


class Numbered(DataSourceReader):
    """What both formats share: ranges of numbers over the parts, cut down by the filters on ``number``."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.columns = options["path"], schema.fieldNames()
        self.size = int(options.get("columns_per_task", 100_000))
        self.low, self.high, self.only = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if f.attribute != ("number",) or isinstance(value, bool) or not isinstance(value, (int, tuple, list)):
                yield f
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                end = value + isinstance(f, LessThanOrEqual)
                self.high = end if self.high is None else min(self.high, end)
            elif isinstance(f, (EqualTo, In)):
                wanted = set(value) if isinstance(f, In) else {value}
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f

    def count(self, file) -> int:
        raise NotImplementedError

    def partitions(self) -> list[Range]:
        system, _ = _open(self.path)
        out, before = [], 0
        wanted = None if self.only is None else sorted(self.only)
        for part in _parts(self.path):
            with system.open_input_file(part) as file:
                n = self.count(file)
            lo, hi = max(before, self.low), before + n if self.high is None else min(before + n, self.high)
            for first in range(lo, hi, self.size):
                last = min(hi, first + self.size)
                if wanted is None or bisect_right(wanted, last - 1) > bisect_right(wanted, first - 1):
                    out.append(Range(part, first, last, before))
            before += n
        return out or [Range("", 0, 0, 0)]

    def numbers(self, p: Range) -> Iterator[tuple[int, int]]:
        """Runs of wanted numbers of a range."""
        wanted = range(p.first, p.last) if self.only is None else sorted(n for n in self.only if p.first <= n < p.last)
        if self.only is None:
            if wanted:
                yield p.first, p.last
            return
        for n in wanted:
            yield n, n + 1

    def batch(self, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] for c in self.columns], names=self.columns)


class MatrixReader(Numbered):
    def count(self, file) -> int:
        return struct.unpack("<ii", file.read(8))[0]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.file) as file:
            _, d = struct.unpack("<ii", file.read(8))
            step = max(1, (1 << 22) // max(1, 4 * d))
            for first, last in self.numbers(partition):
                for lo in range(first, last, step):
                    n = min(step, last - lo)
                    columns = {"number": pa.array(np.arange(lo, lo + n))}
                    if "v" in self.columns:
                        file.seek(8 + 4 * d * (lo - partition.before))
                        flat = np.frombuffer(file.read(4 * d * n), dtype="<f4")
                        columns["v"] = pa.ListArray.from_arrays(pa.array(np.arange(0, d * n + 1, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)), pa.array(flat))
                    yield self.batch(columns)


class ImagesReader(Numbered):
    def count(self, file) -> int:
        return struct.unpack("<i", file.read(4))[0]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.file) as file:
            for first, last in self.numbers(partition):
                file.seek(4 + 8 * (first - partition.before))
                places = np.frombuffer(file.read(8 * (last - first)), dtype="<i8")
                for number, place in zip(range(first, last), places.tolist(), strict=True):
                    columns: dict = {"number": pa.array([number])}
                    if len(self.columns) > 1 or self.columns != ["number"]:
                        file.seek(place)
                        width, height = struct.unpack("<ii", file.read(8))
                        columns |= {"height": pa.array([height], pa.int32()), "width": pa.array([width], pa.int32())}
                        if "pixels" in self.columns:
                            columns["pixels"] = pa.array([file.read(width * height)], pa.binary())
                    yield self.batch(columns)


class PartWriter(DataSourceArrowWriter):
    """A task writes one part under a name of its own; the parts of the tasks that Spark takes get their names at the end, so a lost
    or repeated task leaves nothing that is read."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.run = uuid.uuid4().hex[:8]

    def encoded(self, batches: Iterator[pa.RecordBatch], out) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, where = _open(self.path)
        system.create_dir(where, recursive=True)
        name = f"{self.run}-{context.partitionId():06d}-{context.taskAttemptId()}"
        with system.open_output_stream(f"{where}/_{name}") as out:
            self.encoded(iterator, out)
        return Committed(name)

    def commit(self, messages: list[Committed | None]) -> None:
        system, where = _open(self.path)
        for m in messages:
            if m:
                system.move(f"{where}/_{m.name}", f"{where}/part-{m.name}")

    def abort(self, messages: list[Committed | None]) -> None:
        system, where = _open(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{where}/_{m.name}")


class MatrixWriter(PartWriter):
    """Columns of one length; a task spools its part's values before the header, whose count it then knows."""

    def encoded(self, batches: Iterator[pa.RecordBatch], out) -> None:
        import tempfile

        n, d = 0, 0
        with tempfile.TemporaryFile() as spool:
            for batch in batches:
                v = batch.column(batch.schema.get_field_index("v"))
                if v.null_count:
                    raise ValueError("a matrix has no null columns")
                sizes = np.diff(v.offsets.to_numpy())
                if len(sizes):
                    d = d or int(sizes[0])
                    if (sizes != d).any():
                        raise ValueError("a matrix has columns of one length")
                    spool.write(v.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                    n += len(sizes)
            spool.seek(0)
            out.write(struct.pack("<ii", n, d))
            while block := spool.read(1 << 20):
                out.write(block)


class ImagesWriter(PartWriter):
    def encoded(self, batches: Iterator[pa.RecordBatch], out) -> None:
        import tempfile

        sizes: list[int] = []
        with tempfile.TemporaryFile() as spool:
            for batch in batches:
                for r in batch.select(["height", "width", "pixels"]).to_pylist():
                    if len(r["pixels"]) != r["height"] * r["width"]:
                        raise ValueError("pixels are not height times width")
                    spool.write(struct.pack("<ii", r["width"], r["height"]) + r["pixels"])
                    sizes.append(8 + len(r["pixels"]))
            first = 4 + 8 * len(sizes)
            places = first + np.cumsum([0, *sizes[:-1]]) if sizes else np.zeros(0)
            spool.seek(0)
            out.write(struct.pack("<i", len(sizes)) + places.astype("<i8").tobytes())
            while block := spool.read(1 << 20):
                out.write(block)


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return MATRIX

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options)


class ImagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "images"

    def schema(self) -> str:
        return IMAGES

    def reader(self, schema: StructType) -> ImagesReader:
        return ImagesReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ImagesWriter:
        return ImagesWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known, and lets filters reach them."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MatrixSource)
    spark.dataSource.register(ImagesSource)
