"""Padded batches as dense tensors: a data source that writes and reads Arrow files of fixed-shape tensors.

A batch is one Arrow file with a record batch for each of its structures, whose columns are tensors over the longest structure of the
batch, compressed by Zstandard; stacked they are the batch. Files lie in a folder of their job and count once the job's manifest lists them, so a
task that fails or a job that is given up shows nothing. A job that overwrites names the jobs that it replaces, and the same
manifest puts it in place of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

KEYS = ("batch_id", "structure_id", "atom_idx")
RELATIVE = "relative_position"
#: Atoms, padding included, after which a partition of files that are read is full.
PARTITION_ATOMS = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path on it) of a URI or a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def manifests(system: fs.FileSystem, base: str) -> dict[str, dict]:
    """Manifests of the jobs at a folder that count, by job; none if there is no such folder."""
    found = {}
    for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if info.base_name.startswith("job-") and info.base_name.endswith(".json"):
            with system.open_input_stream(info.path) as stream:
                found[info.base_name[4:-5]] = json.loads(stream.read())
    replaced = {job for m in found.values() for job in m["replaces"]}
    return {job: m for job, m in sorted(found.items()) if job not in replaced}


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (name, batch_id, structures, atoms of each)."""

    files: list[tuple[str, int, int, int]]


@dataclass(frozen=True)
class Layout:
    """Which columns become tensors: ``vectors`` of several columns and, from residue numbers, positions within ``window``."""

    vectors: Mapping[str, Sequence[str]]
    window: int | None

    def tensors(self, rows: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The tensors of one structure from its columns."""
        inside = {c for columns in self.vectors.values() for c in columns}
        out = {c: v.astype(np.uint8) if v.dtype == bool else v for c, v in rows.items() if c not in inside}
        out |= {name: np.stack([rows[c].astype(np.float32) for c in columns], axis=1) for name, columns in self.vectors.items()}
        if self.window is not None:
            out[RELATIVE] = relative_position_matrix(rows["chain_idx"], rows["res_index"], rows["pad_mask"], self.window)
        return out


def relative_position_matrix(chain: np.ndarray, residue: np.ndarray, real: np.ndarray, window: int) -> np.ndarray:
    """Buckets of all ordered pairs of one structure's atoms as ``tokens.relative_positions`` has them; 1 where a side is padding."""
    offset = np.clip(residue[:, None].astype(np.int64) - residue[None], -window, window) + window + 1
    bucket = np.where(chain[:, None] == chain[None], offset, 2 * window + 2)
    return np.where(real[:, None] & real[None], bucket, 1).astype(np.int16)


def one_tensor(values: np.ndarray) -> pa.Array:
    """A column of one row that is a tensor."""
    flat = pa.array(values.reshape(-1))
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(flat.type, values.shape), pa.FixedSizeListArray.from_arrays(flat, values.size))


def structures_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, dict[str, np.ndarray]]]:
    """(batch_id, structure_id, columns) of rows that come sorted by their keys; one structure is held at a time."""

    def runs() -> Iterator[tuple[tuple[int, object], pa.RecordBatch]]:
        for batch in batches:
            keys = [batch.column(c) for c in ("batch_id", "structure_id")]
            changed = np.logical_or(*(pc.not_equal(k[1:], k[:-1]).fill_null(True).to_numpy(zero_copy_only=False) for k in keys))
            ends = [*(np.flatnonzero(changed) + 1).tolist(), len(batch)] if len(batch) else []
            for at, end in zip([0, *ends], ends, strict=False):
                yield tuple(k[at].as_py() for k in keys), batch.slice(at, end - at)

    def put_together(key: tuple[int, object], parts: list[pa.RecordBatch]) -> tuple[int, object, dict[str, np.ndarray]]:
        table = pa.Table.from_batches(parts)
        place = table.column("atom_idx").to_numpy()
        if key[0] is None or key[1] is None or any(table.column(c).null_count for c in table.column_names):
            raise ValueError(f"structure {key[1]} of batch {key[0]} has nulls")
        if not np.array_equal(place, np.arange(1, len(place) + 1)):
            raise ValueError(f"structure {key[1]} of batch {key[0]} has atoms missing or twice")
        return *key, {c: table.column(c).to_numpy() for c in table.column_names if c not in KEYS}

    now, parts = None, []
    for key, part in runs():
        if parts and key != now:
            yield put_together(now, parts)
            parts = []
        now = key
        parts.append(part)
    if parts:
        yield put_together(now, parts)


class TensorWriter(DataSourceArrowWriter):
    def __init__(self, path: str, layout: Layout, schema: StructType, replace: bool):
        self.path, self.layout, self.schema, self.job = path, layout, schema.json(), uuid.uuid4().hex
        self.replaces = sorted(manifests(*opened(path))) if replace else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A file for each batch; what a failing task has written goes."""
        system, base = opened(self.path)
        system.create_dir(f"{base}/{self.job}", recursive=True)
        files: list[tuple[str, int, int, int]] = []
        sink = stream = None
        try:
            for batch_id, structure_id, rows in structures_of(iterator):
                tensors = self.layout.tensors(rows)
                n = len(next(iter(rows.values())))
                columns = {c: one_tensor(v) for c, v in tensors.items()}
                record = pa.record_batch([pa.array([structure_id]), *columns.values()], names=["structure_id", *columns])
                if not files or files[-1][1] != batch_id:
                    if sink is not None:
                        sink.close()
                        stream.close()
                        sink = None
                    files.append((f"{self.job}/{uuid.uuid4().hex}.arrow", batch_id, 0, n))
                    stream = system.open_output_stream(f"{base}/{files[-1][0]}")
                    sink = pa.ipc.new_file(stream, record.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                if files[-1][3] != n:
                    raise ValueError(f"batch {batch_id} has structures of {files[-1][3]} and of {n} atoms: pad it first")
                sink.write_batch(record)
                files[-1] = (*files[-1][:2], files[-1][2] + 1, n)
            if sink is not None:
                sink.close()
                stream.close()
        except BaseException:
            if stream is not None:
                stream.close()
            for name, *_ in files:
                system.delete_file(f"{base}/{name}")
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Put the job's manifest in place; files of attempts that did not count go, and so do replaced jobs."""
        system, base = opened(self.path)
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f[1])
        twice = {a[1] for a, b in zip(files, files[1:], strict=False) if a[1] == b[1]}
        if twice:
            raise ValueError(f"batches {sorted(twice)[:5]} come from several tasks")
        system.create_dir(base, recursive=True)
        layout = {"vectors": {k: list(v) for k, v in self.layout.vectors.items()}, "window": self.layout.window}
        text = json.dumps({"replaces": self.replaces, "schema": self.schema, "layout": layout, "files": files})
        with system.open_output_stream(f"{base}/{self.job}.tmp") as out:
            out.write(text.encode())
        system.move(f"{base}/{self.job}.tmp", f"{base}/job-{self.job}.json")
        known = {name for name, *_ in files}
        for info in system.get_file_info(fs.FileSelector(f"{base}/{self.job}", allow_not_found=True)):
            if f"{self.job}/{info.base_name}" not in known:
                system.delete_file(info.path)
        for job in self.replaces:
            if system.get_file_info(f"{base}/{job}").type == fs.FileType.Directory:
                system.delete_dir(f"{base}/{job}")

    def abort(self, messages: list[Written | None]) -> None:
        system, base = opened(self.path)
        if system.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.job}")


@dataclass
class TensorFiles(InputPartition):
    files: list[tuple[str, int, dict[str, list[str]]]]


class TensorReader(DataSourceReader):
    """Rows of the batches: each tensor's entries by atom again, in the columns and types that were written."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.columns = path, schema

    def partitions(self) -> list[TensorFiles]:
        """Runs of files of about PARTITION_ATOMS each."""
        out, size = [TensorFiles([])], 0
        for m in manifests(*opened(self.path)).values():
            for name, batch_id, structures, atoms in m["files"]:
                if out[-1].files and size + structures * atoms > PARTITION_ATOMS:
                    out.append(TensorFiles([]))
                    size = 0
                out[-1].files.append((name, batch_id, m["layout"]["vectors"]))
                size += structures * atoms
        return out

    def read(self, partition: TensorFiles) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.columns)
        for name, batch_id, vectors in partition.files:
            place = {c: (vector, k) for vector, columns in vectors.items() for k, c in enumerate(columns)}
            for structure_id, tensors in read_batch(self.path, name):
                n = len(next(iter(tensors.values())))
                values = {"batch_id": np.full(n, batch_id), "atom_idx": np.arange(1, n + 1)}
                arrays = []
                for field in wanted:
                    if field.name == "structure_id":
                        arrays.append(pa.array([structure_id] * n, field.type))
                        continue
                    tensor, k = place.get(field.name, (field.name, None))
                    v = values[tensor] if tensor in values else tensors[tensor] if k is None else tensors[tensor][:, k]
                    arrays.append(pa.array(v.astype(bool) if pa.types.is_boolean(field.type) else v).cast(field.type))
                yield pa.RecordBatch.from_arrays(arrays, schema=wanted)


def read_batch(path: str, name: str) -> Iterator[tuple[object, dict[str, np.ndarray]]]:
    """(structure_id, tensors by name) of each structure of one file, one at a time."""
    system, base = opened(path)
    with system.open_input_file(f"{base}/{name}") as stream:
        file = pa.ipc.open_file(stream)
        for k in range(file.num_record_batches):
            record = file.get_batch(k)
            yield record.column("structure_id")[0].as_py(), {c: record.column(c).to_numpy_ndarray()[0] for c in record.schema.names if c != "structure_id"}


def stacked(path: str) -> Iterator[tuple[int, list[object], dict[str, np.ndarray]]]:
    """(batch_id, structure ids, tensors [structure, ...]) of every batch that counts, one at a time."""
    for m in manifests(*opened(path)).values():
        for name, batch_id, *_ in m["files"]:
            ids, each = zip(*read_batch(path, name), strict=True)
            yield batch_id, list(ids), {c: np.stack([t[c] for t in each]) for c in each[0]}


class TensorSource(DataSource):
    """Options: ``path``; for writing ``vectors`` (JSON: name to columns) and ``window`` of relative positions (none: not written)."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> StructType:
        found = list(manifests(*opened(self.options["path"])).values())
        if not found:
            raise ValueError(f"{self.options['path']} holds no tensors")
        return StructType.fromJson(json.loads(found[0]["schema"]))

    def reader(self, schema: StructType) -> TensorReader:
        return TensorReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> TensorWriter:
        window = self.options.get("window")
        layout = Layout(json.loads(self.options.get("vectors", "{}")), None if window is None else int(window))
        return TensorWriter(self.options["path"], layout, schema, overwrite)


def write_tensors(padded: DataFrame, path: str, vectors: Mapping[str, Sequence[str]] | None = None, window: int | None = None, mode: str = "append") -> None:
    """Write padded batches (batch_id, structure_id, atom_idx and columns of numbers or truth values) as tensors.

    A batch goes to one task, which holds one structure of it at a time. With a ``window`` the matrix of relative positions of
    each structure (columns chain_idx, res_index and pad_mask) is made there, so that no pair is a row. Nulls, batches that
    are not padded, and atoms that are missing or doubled are errors; then nothing of the job shows.
    """
    spark = padded.sparkSession
    spark.dataSource.register(TensorSource)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = padded.repartition(n, "batch_id").sortWithinPartitions(*KEYS)
    writer = rows.write.format("tensors").mode(mode).option("vectors", json.dumps({k: list(v) for k, v in (vectors or {}).items()}))
    (writer if window is None else writer.option("window", window)).save(path)


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``write_tensors`` wrote; vectors come back as float32, truth values and numbers as they were."""
    spark.dataSource.register(TensorSource)
    return spark.read.format("tensors").load(path)
