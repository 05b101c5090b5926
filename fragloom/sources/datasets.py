"""Sample packages, indexes and manifests on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fragloom.operators.damage import OPERATIONS
from fragloom.operators.datasets import leakage

MANIFEST = (
    "dataset_version string, sample_id string, source_sha256 string, corrupted_sha256 string, source_length bigint, corrupted_length bigint, "
    f"seed bigint, severity_level int, operations {OPERATIONS}, _corrupt_record string"
)


def index_write(samples: DataFrame, path: str) -> None:
    """Dataset index as JSON lines, without the bytes."""
    samples.drop("original", "damaged", "content").write.mode("error").json(path)


def index_read(spark: SparkSession, path: str, schema: str = "sample_id string, split string, severity_level int, seed bigint") -> DataFrame:
    return spark.read.schema(schema).json(path)


def manifest_read(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(manifests, issues): a manifest that does not parse becomes an issue row, not a failed job."""
    raw = (
        spark.read.schema(MANIFEST).option("multiLine", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "manifest*.json").option("columnNameOfCorruptRecord", "_corrupt_record").json(root)
        .withColumn("file", F.input_file_name())
    )
    bad = F.col("_corrupt_record").isNotNull() | F.col("sample_id").isNull()
    return raw.where(~bad).drop("_corrupt_record"), raw.where(bad).select("file", F.lit("manifest_schema").alias("issue"))


def dataset_save(samples: DataFrame, path: str) -> None:
    samples.write.mode("error").partitionBy("split").parquet(path)


def dataset_load(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Samples by split; a document in two splits is an error, found by an aggregate."""
    samples = spark.read.parquet(path)
    if leakage(samples, key).limit(1).count():
        raise ValueError(f"{key} occurs in more than one split")
    return samples


def dataset_export(samples: DataFrame, path: str) -> None:
    """Original and damaged bytes with manifest columns, by split, plus the index next to them."""
    samples.write.mode("error").partitionBy("split").parquet(f"{path}/samples")
    index_write(samples, f"{path}/index")


def artifact_export(segments: DataFrame, states: DataFrame, path: str) -> None:
    """Reassembled segments (binary) and one verdict row per medium."""
    segments.write.mode("error").parquet(f"{path}/segments")
    states.write.mode("error").parquet(f"{path}/verdicts")
