"""A data source over a local mirror of structure files: ``spark.read.format("structures").load(folder)``.

The driver lists the mirror, drops the files that pushed-down filters on structure_id and format rule out, and plans partitions
of like size from the rest; tasks open the files of their partition only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringStartsWith

from atomloom.functions.vocab import STRUCTURE_SUFFIXES

SCHEMA = "structure_id string, path string, format string, bytes long, content string"
#: Bytes of files after which a partition is full; a larger file has one of its own.
PARTITION_BYTES = 64 << 20


@dataclass(frozen=True)
class MirrorFile:
    structure_id: str
    path: str
    format: str
    size: int


@dataclass
class FilesPartition(InputPartition):
    files: tuple[MirrorFile, ...]


def planned(files: list[MirrorFile], partition_bytes: int) -> list[FilesPartition]:
    """Runs of files, in the order of their paths, of about ``partition_bytes`` each."""
    out: list[FilesPartition] = []
    held: list[MirrorFile] = []
    size = 0
    for f in sorted(files, key=lambda f: f.path):
        if held and size + f.size > partition_bytes:
            out.append(FilesPartition(tuple(held)))
            held, size = [], 0
        held.append(f)
        size += f.size
    return [*out, FilesPartition(tuple(held))] if held else out


class MirrorReader(DataSourceReader):
    def __init__(self, path: str, recursive: bool, partition_bytes: int):
        self.path, self.recursive, self.partition_bytes = path, recursive, partition_bytes
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Take the filters that names of files answer; Spark applies the rest."""
        for f in filters:
            attribute = getattr(f, "attribute", ())
            column = attribute[0] if len(attribute) == 1 else None
            if column in ("structure_id", "format") and isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((column, "in", (f.value,)))
            elif column in ("structure_id", "format") and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in ("structure_id", "format") and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", (f.value,)))
            else:
                yield f

    def fits(self, file: MirrorFile) -> bool:
        own = {"structure_id": file.structure_id, "format": file.format}
        return all(own[c] in values if kind == "in" else own[c].startswith(values[0]) for c, kind, values in self.tests)

    def listed(self) -> list[MirrorFile]:
        """All structure files of the mirror, without opening one. A missing folder is an error."""
        system, base = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(base, recursive=self.recursive)):
            suffix = PurePosixPath(info.path).suffix.lower().removeprefix(".")
            if info.type == fs.FileType.File and suffix in STRUCTURE_SUFFIXES:
                found.append(MirrorFile(PurePosixPath(info.path).stem, info.path, "cif" if suffix.endswith("cif") else "pdb", info.size))
        return found

    def partitions(self) -> list[FilesPartition]:
        return planned([f for f in self.listed() if self.fits(f)], self.partition_bytes) or [FilesPartition(())]

    def read(self, partition: FilesPartition) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        for f in partition.files:
            with system.open_input_stream(f.path) as stream:
                content = stream.read().decode("utf-8")
            yield pa.RecordBatch.from_pylist([{"structure_id": f.structure_id, "path": f.path, "format": f.format, "bytes": f.size, "content": content}])


class StructureSource(DataSource):
    """Options: ``path``, ``recursive`` (false), ``partitionBytes``. A file's id is its name without the suffix."""

    @classmethod
    def name(cls) -> str:
        return "structures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MirrorReader:
        if "path" not in self.options:
            raise ValueError("the folder of the mirror must be given")
        return MirrorReader(self.options["path"], self.options.get("recursive", "false").lower() == "true", int(self.options.get("partitionBytes", PARTITION_BYTES)))


def read_mirror(spark: SparkSession, folder: str, recursive: bool = False, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(structure_id, path, format, bytes, content) of the structure files of a mirror; filters on id and format prune files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StructureSource)
    return spark.read.format("structures").option("recursive", str(recursive).lower()).option("partitionBytes", partition_bytes).load(folder)
