"""Tensors in .npy files as a data source: tasks read ranges of rows, and write parts that are committed together.

    spark.dataSource.register(NumpySource)
    spark.read.format("npy").option("path", folder).load()
    df.select("x").write.format("npy").option("path", folder).mode("append").save()

A folder holds parts in the order of their names; a row's number is its place over all of them. Paths are local ones that
all nodes share, or URIs of a file system that PyArrow has.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of rows that a task reads, or has in memory before it writes a part; and of a batch.
RANGE, BATCH = 32_000_000, 1_000_000


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _header(store: fs.FileSystem, path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, where the rows begin) of a file, of which no more than its head is read."""
    with store.open_input_file(path) as f:
        raw = io.BytesIO(f.read_at(min(f.size(), 65_536), 0))
    version = np.lib.format.read_magic(raw)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(raw)
    if by_column and len(shape) > 1:
        raise ValueError(f"{path} is stored by columns")
    if not shape or kind.kind not in "fiub":
        raise ValueError(f"{path} must hold rows of numbers")
    return shape, kind, raw.tell()


@dataclass
class Rows(InputPartition):
    """So many rows of a file, from an offset; first is the number of the first one over all files."""

    path: str
    offset: int
    first: int
    count: int
    width: int
    kind: str


class NumpyReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Rows]:
        store, folder = _at(self.path)
        info = store.get_file_info(folder)
        found = [folder] if info.type == fs.FileType.File else sorted(i.path for i in store.get_file_info(fs.FileSelector(folder)) if i.path.endswith(".npy") and not i.base_name.startswith((".", "_")))
        out, first = [], 0
        for path in found:
            shape, kind, offset = _header(store, path)
            width = prod(shape[1:])
            step = max(1, self.size // max(1, width * kind.itemsize))
            for a in range(0, shape[0], step):
                out.append(Rows(path, offset + a * width * kind.itemsize, first + a, min(step, shape[0] - a), width, kind.str))
            first += shape[0]
        return out or [Rows("", 0, 0, 0, 1, "<f4")]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        kind = np.dtype(partition.kind)
        store, path = _at(self.path)[0], partition.path
        step = max(1, BATCH // max(1, partition.width * kind.itemsize))
        with store.open_input_file(path) as f:
            for a in range(0, partition.count, step):
                n = min(step, partition.count - a)
                raw = f.read_at(n * partition.width * kind.itemsize, partition.offset + a * partition.width * kind.itemsize)
                flat = pa.array(np.frombuffer(raw, kind).astype(np.float64))
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * partition.width)
                number = pa.array(np.arange(n, dtype=np.int64) + partition.first + a)
                yield pa.RecordBatch.from_arrays([number, pa.ListArray.from_arrays(ends, flat)], names=["row", "x"])


@dataclass
class Part(WriterCommitMessage):
    partition: int
    paths: list[str]
    rows: int


class NumpyWriter(DataSourceArrowWriter):
    def __init__(self, path: str, shape: tuple[int, ...], kind: str, size: int):
        self.path, self.shape, self.kind, self.size = path, shape, kind, size

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        partition, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, folder = _at(self.path)
        width, held, paths, total = prod(self.shape), [], [], 0
        most = max(1, self.size // max(1, width * np.dtype(self.kind).itemsize))

        def give(rows: np.ndarray) -> None:
            paths.append(f"{folder}/_{attempt}-{len(paths):06d}")
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(paths[-1]) as f:
                np.lib.format.write_array(f, rows.reshape(len(rows), *self.shape), allow_pickle=False)

        for batch in iterator:
            x = batch.column("x")
            if x.null_count or x.flatten().null_count or (np.diff(x.offsets.to_numpy()) != width).any():
                raise ValueError(f"every row must have {width} numbers")
            held.append(x.flatten().to_numpy().reshape(-1, width).astype(self.kind))
            total += len(x)
            while sum(map(len, held)) >= most:
                rows = np.concatenate(held)
                give(rows[:most])
                held = [rows[most:]]
        if held and sum(map(len, held)):
            give(np.concatenate(held))
        return Part(partition, paths, total)

    def commit(self, messages: list[Part]) -> None:
        """Parts get their names, by partition, when all are there."""
        store, folder = _at(self.path)
        store.create_dir(folder, recursive=True)
        for m in messages:
            for i, path in enumerate(m.paths):
                store.move(path, f"{folder}/part-{m.partition:06d}-{i:06d}.npy")

    def abort(self, messages: list[Part | None]) -> None:
        store, _ = _at(self.path)
        for m in messages:
            for path in m.paths if m else ():
                store.delete_file(path)


class NumpySource(DataSource):
    """Options: path; size (bytes of a range or part); to write, shape (of a row, by commas) and dtype (f4)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row long, x array<double>"

    def reader(self, schema) -> NumpyReader:
        return NumpyReader(self.options["path"], int(self.options.get("size", RANGE)))

    def writer(self, schema, overwrite: bool) -> NumpyWriter:
        if overwrite:
            raise ValueError("a folder is written once")
        shape = tuple(int(n) for n in self.options["shape"].split(","))
        return NumpyWriter(self.options["path"], shape, self.options.get("dtype", "f4"), int(self.options.get("size", RANGE)))


def write_tensor(df: DataFrame, column: str, path: str, shape: tuple[int, ...], dtype: str = "f4", size: int = RANGE) -> None:
    """A column of arrays, each of as many numbers as shape has, as parts in the order of df's partitions and rows."""
    df.sparkSession.dataSource.register(NumpySource)
    rows = df.select(df[column].cast("array<double>").alias("x"))
    rows.write.format("npy").option("path", path).option("shape", ",".join(map(str, shape))).option("dtype", dtype).option("size", size).mode("append").save()


def read_tensor(spark, path: str, size: int = RANGE) -> DataFrame:
    """row, x (flat): a file, or all parts of a folder."""
    spark.dataSource.register(NumpySource)
    return spark.read.format("npy").option("path", path).option("size", size).load()
