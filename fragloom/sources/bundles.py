"""Bundle JSON in and out, reports and graph elements as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_RANGE = "struct<media_id:string,start:bigint,end:bigint,size_bytes:bigint>"
SCHEMA = (
    "schema_version string, bundle_id string, generated_utc string, case struct<case_id:string,title:string>, "
    "acquisition struct<media:array<struct<media_id:string,size_bytes:bigint>>>, "
    f"artifacts array<struct<artifact_id:string,media_id:string,parent_artifact_id:string,linked_fragment_ids:array<string>,byte_range:{_RANGE},"
    "recovery:struct<completeness:string,confidence:double,method:string>>>, "
    f"fragments array<struct<fragment_id:string,media_id:string,bytes_sha256:string,byte_range:{_RANGE}>>, "
    "reconstruction_groups array<struct<group_id:string,artifact_id:string,member_fragment_ids:array<string>,ordering:array<string>,gaps_bytes:bigint>>, "
    "timeline_events array<struct<event_id:string,ts_utc:string,ts_precision:string,basis_path:string,source:string,confidence:double,status:string>>, "
    "known_file_matches array<struct<artifact_id:string,hashset:string,result:string,basis:string>>, warnings array<struct<code:string,message:string>>"
)
COLLECTIONS = ["artifacts", "fragments", "reconstruction_groups", "timeline_events", "known_file_matches"]


def bundle_read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The bundles of a folder as ``bundles`` and one table per collection; bad JSON goes to ``rejected``."""
    raw = (
        spark.read.schema(SCHEMA + ", _corrupt_record string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path).withColumn("file", F.input_file_name())
    )
    return bundle_tables(raw)


def bundle_parse(texts: DataFrame, body: str, key: str) -> dict[str, DataFrame]:
    """The same tables from a column of bundle JSON texts."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = texts.select(F.col(key).alias("file"), F.from_json(body, SCHEMA + ", _corrupt_record string", options).alias("_b"))
    return bundle_tables(parsed.select("file", "_b.*"))


def bundle_tables(raw: DataFrame) -> dict[str, DataFrame]:
    good = raw.where(F.col("_corrupt_record").isNull() & F.col("bundle_id").isNotNull())
    out = {"bundles": good.drop("_corrupt_record"), "rejected": raw.where(F.col("_corrupt_record").isNotNull() | F.col("bundle_id").isNull()).select("file", "_corrupt_record")}
    for name in COLLECTIONS:
        out[name] = good.select("file", "bundle_id", F.inline(name))
    return out


def bundle_rows(fragments: DataFrame, media: DataFrame, states: DataFrame, schema_version: str, per_bundle: int = 4096) -> DataFrame:
    """Bundle JSON per medium from its fragments and verdict.

    A medium with more fragments than ``per_bundle`` gives several part bundles, so no row has to hold
    an unbounded record list.
    """
    part = F.floor(F.col("start") / (256 * per_bundle))
    record = F.struct(
        "fragment_id", "media_id", F.col("sha256").alias("bytes_sha256"),
        F.struct("media_id", "start", "end", "size_bytes").alias("byte_range"),
    )
    lists = (
        fragments.withColumn("part", part).groupBy("media_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("start", record.alias("r")))).alias("_l"))
        .withColumn("fragments", F.transform("_l", lambda x: x["r"])).drop("_l")
    )
    d = lists.join(media, "media_id").join(states, "media_id")
    body = F.to_json(
        F.struct(
            F.lit(schema_version).alias("schema_version"),
            F.concat_ws("-", F.lit("BND"), "media_id", F.col("part").cast("string")).alias("bundle_id"),
            F.struct(F.lit("CASE-01").alias("case_id")).alias("case"),
            F.struct(F.array(F.struct("media_id", F.col("media_size").alias("size_bytes"))).alias("media")).alias("acquisition"),
            F.struct(F.lit(True).alias("byte_provenance")).alias("capabilities"),
            F.array(F.struct(F.concat(F.lit("ART-"), "media_id").alias("artifact_id"), "media_id", F.struct(F.col("recovery_state").alias("completeness")).alias("recovery"))).alias("artifacts"),
            "fragments",
            F.struct(F.lit("fragloom").alias("name")).alias("engine"),
        )
    )
    return d.select("media_id", "part", body.alias("body"))


def write_text(df: DataFrame, column: Column | str, path: str) -> None:
    """JSON lines sink for bundles, reports and graph elements."""
    df.select(F.col(column) if isinstance(column, str) else column).toDF("value").write.mode("error").text(path)


def report_rows(cases: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Case report JSON from the counts of ``category_summary``; artifacts stay a table of their own."""
    counts = [c for c in summary.columns if c not in keys]
    body = F.struct(*keys, F.struct(*counts).alias("summary"), F.struct(F.lit(True).alias("read_only_enforced")).alias("declarations"))
    return cases.join(summary, keys).select(*keys, F.to_json(body).alias("report"))
