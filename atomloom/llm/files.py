"""Files that tasks write to shared storage and Spark reads back."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def put(folder: str, name: str, content: bytes) -> str:
    """Write ``content`` to ``folder/name`` (a URI or path on shared storage) by a rename, so that a repeated or
    speculative task leaves the same whole file and a lost one leaves none under that name."""
    system, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(content)
    system.move(draft, f"{path}/{name}")
    return f"{folder}/{name}"


def read_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, content) of the files of a folder, one row a file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "content")
