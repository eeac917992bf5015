"""A data source for .npy matrices with a file of ids beside: tasks read ranges of rows, none the whole file."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows that a task reads, and that it holds at a time.
ROWS, ROWS_AT_ONCE = 100_000, 4096


def _open(path: str):
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file(path)
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and offset of the data of a .npy file, from its first bytes."""
    with _open(path) as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, kind = read(f)
        if fortran and len(shape) > 1:
            raise ValueError(f"{path} is stored by columns")
        if kind.hasobject:
            raise ValueError(f"{path} holds objects")
        return shape, kind, f.tell()


class _Rows(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.ids = options["path"], options["ids"]
        self.dimension, self.rows = int(options["dimension"]), int(options.get("rows", ROWS))

    def partitions(self):
        shape, kind, _ = header(self.path)
        ids, id_kind, _ = header(self.ids)
        if len(shape) != 2 or shape[1] != self.dimension or kind.kind != "f":
            raise ValueError(f"{self.path} is {shape} of {kind}, not numbers (n, {self.dimension})")
        if len(ids) != 1 or ids[0] != shape[0] or id_kind.kind not in "iu":
            raise ValueError(f"{self.ids} is {ids} of {id_kind}, not {shape[0]} whole numbers")
        return [_Rows(i, min(i + self.rows, shape[0])) for i in range(0, shape[0], self.rows)] or [_Rows(0, 0)]

    def read(self, partition):
        _, kind, at = header(self.path)
        _, id_kind, id_at = header(self.ids)
        width = kind.itemsize * self.dimension
        with _open(self.path) as f, _open(self.ids) as g:
            for i in range(partition.first, partition.end, ROWS_AT_ONCE):
                n = min(ROWS_AT_ONCE, partition.end - i)
                f.seek(at + i * width)
                g.seek(id_at + i * id_kind.itemsize)
                raw, raw_ids = f.read(n * width), g.read(n * id_kind.itemsize)
                if len(raw) != n * width or len(raw_ids) != n * id_kind.itemsize:
                    raise ValueError(f"{self.path} or {self.ids} is shorter than its header says")
                x = np.frombuffer(raw, kind).astype(np.float32)
                v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.dimension), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw_ids, id_kind).astype(np.int64)), v], ["id", "v"])


class NpyMatrix(DataSource):
    @classmethod
    def name(cls):
        return "npy_matrix"

    def schema(self):
        return "id long, v array<float>"

    def reader(self, schema):
        return _Reader(self.options)


def npy_matrix(spark: SparkSession, path: str, ids: str, dimension: int, rows: int = ROWS) -> DataFrame:
    """id, v: the rows of a .npy matrix (n, dimension) with the ids of a .npy file of n whole numbers.

    Both headers are checked before a task starts: another width, length, order or type is an error. Files of any file system that
    Arrow opens by its URI, or that all executors see under the path. Repeated ids are rows each; an empty matrix gives none.
    """
    spark.dataSource.register(NpyMatrix)
    return spark.read.format("npy_matrix").option("ids", ids).option("dimension", dimension).option("rows", rows).load(path)
