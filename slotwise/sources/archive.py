"""tar.gz archives of `time id size` lines as a Spark data source."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, LessThan, LessThanOrEqual

NAMES = ["archive", "seq", "object_id", "timestamp", "size"]


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI (file, hdfs, s3, gs, ...) or of a plain path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ArchiveSource(DataSource):
    """Rows of the first member ending in .tr of each archive: archive, seq (from 0 in each), object_id, timestamp, size.

    Options: path, of an archive or of a folder with archives; maxRows, that no archive is read beyond (-1: none). An archive can't be
    split, so it is a partition of its own; it is streamed, neither it nor the member is ever held whole. Lines that can't be parsed are skipped and take no
    number. An upper bound of seq that Spark pushes down ends the reading of an archive there.
    """

    @classmethod
    def name(cls) -> str:
        return "sized_archive"

    def schema(self) -> str:
        return "archive string, seq long, object_id string, timestamp double, size long"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("maxRows", -1)))


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, None if most < 0 else most

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """An upper bound of seq is kept, since rows are numbered as they are read; Spark applies all other filters itself."""
        for f in filters:
            if isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("seq",):
                bound = int(f.value) + isinstance(f, LessThanOrEqual)
                self.most = bound if self.most is None else min(self.most, bound)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files, path = located(self.path)
        if files.get_file_info(path).type == fs.FileType.Directory:
            names = sorted(i.path for i in files.get_file_info(fs.FileSelector(path)) if i.path.endswith(".tar.gz"))
        else:
            names = [path]
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        host = self.path.split("://")[1].split("/")[0] if scheme and files.type_name == "hdfs" else ""
        return [InputPartition(f"{scheme}{host}{n}") for n in names]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, path = located(partition.value)
        held: list[tuple] = []
        seq = 0
        with files.open_input_stream(path, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|gz") as archive:
            member = next((m for m in archive if m.name.endswith(".tr")), None)
            for line in archive.extractfile(member) if member else ():
                if self.most is not None and seq >= self.most:
                    break
                t = line.decode(errors="replace").split()
                try:
                    held.append((partition.value, seq, t[1], float(int(t[0])), int(t[2])))
                except (IndexError, ValueError):
                    continue
                seq += 1
                if len(held) == 10_000:
                    yield batch_of(held)
                    held = []
        if held:
            yield batch_of(held)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=NAMES)


def register_archives(spark: SparkSession) -> None:
    """Make the format known, and turn on what pushes filters down to Python sources, without which Spark refuses a source that takes them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
