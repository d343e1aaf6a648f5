"""Shared folders and small files on whatever file system Spark reads."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI under ``spark.checkpoint.dir``; only a local session without that setting uses a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "atomloom-shared")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder once and read back, so that what reads them twice makes them once."""
    path, schema = shared_dir(rows.sparkSession, name), rows.schema
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


#: Writes rows under a name and reads them back.
Put = Callable[[DataFrame, str], DataFrame]


@contextmanager
def dealt_once(spark: SparkSession, key: str, *order: str) -> Iterator[Put]:
    """Gives a ``put`` that writes rows in buckets of ``key``, one a shuffle partition, as a table in the shared folder.

    What is put is dealt by ``key`` from then on: inside the block, windows, groups and joins on ``key`` and further columns take
    it as it lies, without a shuffle; those on ``key`` and ``order`` do not sort it either. All rows of a key go through one task,
    in order and with spills, but are not held there. The tables leave the catalog at the end of the block, so results must be
    written before.
    """
    settings, tables = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}, []
    before = {setting: spark.conf.get(setting) for setting in settings}

    def put(rows: DataFrame, name: str) -> DataFrame:
        n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"atomloom_{name}_{uuid.uuid4().hex}"
        rows.repartition(n, key).write.bucketBy(n, key).sortBy(key, *order).option("path", shared_dir(spark, name)).saveAsTable(table)
        tables.append(table)
        return spark.table(table)

    for setting, value in settings.items():
        spark.conf.set(setting, value)
    try:
        yield put
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)
        for table in tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def _opened(spark: SparkSession, path: str):
    """(Hadoop's path, its file system)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of a folder; none if there is no such folder."""
    where, fs = _opened(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def read_small(spark: SparkSession, path: str) -> str:
    where, fs = _opened(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that appears whole or not at all; False if there is one of that name already, which then stays."""
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    where, fs = _opened(spark, aside)
    stream = fs.create(where, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark._jvm
    choices = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(choices, 1)
    options[0] = choices.valueOf("NONE")
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(where, jvm.org.apache.hadoop.fs.Path(path), options)
    except Exception as e:
        fs.delete(where, False)
        if "FileAlreadyExists" not in str(e):
            raise
        return False
    return True


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _opened(spark, path)
    fs.delete(where, True)
