"""Row-local operators on a stream of evidence files; state, windows and watermarks are not needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fragloom.functions.tokens import profile_blocks
from fragloom.operators.fragments import carve_blocks, identify

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def fragment_stream(spark: SparkSession, folder: str, block_size: int = 256) -> DataFrame:
    """Profiled fragments of files as they arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(folder)
    media = files.select(F.col("path").alias("media_id"), F.lit(0).cast("long").alias("base_offset"), "content")
    return profile_blocks(identify(carve_blocks(media, block_size)))
