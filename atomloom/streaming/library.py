"""A library of tokenised structures that follows a folder of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from atomloom.operators.library import add_batch
from atomloom.sources.structures import is_structure_file

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def library_stream(spark: SparkSession, source: str, path: str, checkpoint: str, recursive: bool = False) -> StreamingQuery:
    """Keep the library at ``path`` up to date with the structure files of a folder: each new file is parsed once.

    The trigger takes what is there and ends. Each batch of the stream is a batch of the library, so one that is run again after a
    failure writes nothing twice; its counts of written, present and failed structures stay in the library's manifest.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", recursive).load(source).filter(is_structure_file(F.col("path")))
    cif = F.lower("path").rlike(r"\.(cif|mmcif)$")
    texts = files.select(F.col("path").alias("structure_id"), F.when(cif, "cif").otherwise("pdb").alias("format"), F.decode("content", "UTF-8").alias("content"))

    def add(batch: DataFrame, number: int) -> None:
        add_batch(spark, path, batch.persist(), f"{checkpoint}#{number}")
        batch.unpersist()

    return texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
