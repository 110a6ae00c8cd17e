"""spark.read.format("cairn_tar"): a plain TAR of any size, read in ranges of its members.

The planner walks the 512-byte headers; a task reads only the headers of its range, so neither an
archive nor a list of its members has to fit a cell.
"""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..schema import FILES
from . import parsers

#: Bytes of archive for one task.
RANGE_BYTES = 256 << 20


def _open(path: str):
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system.open_input_file(at)


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class TarDataSource(DataSource):
    """Options: path, ignoreZeros, encoding, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "cairn_tar"

    def schema(self) -> StructType:
        return FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return TarReader(self.options)


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.zeros = options.get("ignoreZeros", "false").lower() == "true"
        self.encoding = options.get("encoding", "utf-8")
        self.range = int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        starts = [0]
        with _open(self.path) as f:
            last = 0
            for at, _ in parsers.tar_offsets(f, self.zeros):
                last = at
                if at - starts[-1] >= self.range:
                    starts.append(at)
        return [Range(a, b) for a, b in zip(starts, [*starts[1:], last + 1], strict=True)]

    def read(self, partition: Range) -> Iterator[tuple]:
        names = [f.name for f in FILES]
        with _open(self.path) as f:
            f.seek(partition.start)
            archive = tarfile.TarFile(fileobj=f, mode="r", ignore_zeros=self.zeros, encoding=self.encoding)
            while (m := archive.next()) is not None and m.offset < partition.end:
                kind = m.type.decode("latin-1")
                r = parsers.row(
                    m.name, offsetheader=m.offset, offset=m.offset_data, size=m.size, mtime=float(m.mtime), mode=m.mode & 0o7777 | parsers._TYPES.get(m.type, 0x8000), type=kind if kind != "\x00" else "0",
                    linkname=m.linkname, uid=m.uid, gid=m.gid, issparse=m.sparse is not None,
                )
                archive.members = []
                yield tuple(r[n] for n in names)


def register(spark) -> None:
    spark.dataSource.register(TarDataSource)
