"""Feather (Arrow IPC) files as a Spark data source; each file is split by its record batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


def _open(path: str):
    import pyarrow.fs as pafs
    import pyarrow.ipc as ipc

    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return ipc.open_file(fs.open_input_file(inner))


class FeatherSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self) -> StructType:
        return from_arrow_schema(_open(self.options["path"]).schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FeatherReader(self.options["path"])


class _Batch(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _FeatherReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_Batch(k) for k in range(_open(self.path).num_record_batches)] or [_Batch(-1)]

    def read(self, partition: _Batch) -> Iterator:
        if partition.number >= 0:
            yield _open(self.path).get_batch(partition.number)
