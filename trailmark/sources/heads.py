"""Heads of photo files: a data source that lists files and reads no more than their first bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trailmark.sources.photos import HEAD_BYTES

SCHEMA = "path string, name string, size long, modified long, content binary"


class Heads(DataSource):
    """Options: ``path`` (a folder, or a URI that Arrow's file systems know), ``bytes`` a head, ``files`` a task, ``suffix``."""

    @classmethod
    def name(cls) -> str:
        return "photo_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HeadsReader(self.options)


class HeadsReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most, self.files = options["path"], int(options.get("bytes", HEAD_BYTES)), int(options.get("files", 256))
        self.suffixes = tuple(x.lower() for x in options.get("suffix", "").split(",") if x)

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = self._system()
        found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        found = sorted((f.path, f.base_name, f.size, f.mtime_ns // 1_000_000 if f.mtime_ns else 0) for f in found if not self.suffixes or f.base_name.lower().endswith(self.suffixes))
        return [InputPartition(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [InputPartition([])]

    def read(self, partition: InputPartition):
        system, _ = self._system()
        for path, name, size, modified in partition.value:
            with system.open_input_file(path) as f:  # read_at asks the store for this range only
                yield path, name, size, modified, f.read_at(min(self.most, size), 0)


def read_heads(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, name, size, modified (ms) and the first bytes (128 KiB) of each file under a folder."""
    spark.dataSource.register(Heads)
    return spark.read.format("photo_heads").options(path=path, **options).load()
