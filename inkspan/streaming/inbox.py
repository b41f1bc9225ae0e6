"""An inbox folder as a stream of pictures (an extension: the page operators are batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, *, files_at_once: int = 64) -> DataFrame:
    """New files of ``folder`` in bounded micro-batches."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True).load(folder)
