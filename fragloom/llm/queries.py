"""Registered queries of the training-data operators over whole tables, with DuckDB texts where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fragloom.llm import bpe, decontaminate, hardneg, jaccard, language, licenses, lines, minhash, quality, rules, runs, substrings, tokens_io
from fragloom.llm.common import crc32_fold, scratch, tokenizer_path

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_decode(table(spark, folder, "documents"), tokenizer_path(), digest=True)


@query
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokens_io.write_tokens(table(spark, folder, "documents"), path, tokenizer_path())
    return tokens_io.checksums(tokens_io.read_tokens(spark, path)).withColumnRenamed("id", "doc_id")


@query
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs.where(crc32_fold("doc_id", 4) != 2))
    return language.identify(docs, model).withColumn("held_out", crc32_fold("doc_id", 4) == 2)


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs.where(crc32_fold("doc_id", 5) != 0), table(spark, folder, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (crc32_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = rules.quality_rules(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, folder, "documents"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLES["op1_line_dedup"] = lines.ORACLE_SQL


@query
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")).drop("text")


@query
def op6_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, folder, "documents")).drop("class_id")


@query
def op9_substrings(spark: SparkSession, folder: str) -> DataFrame:
    out = substrings.cut_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    planted = docs.select("doc_id", runs.planted(F.col("text"), F.col("doc_id")).alias("text"))
    return runs.summary(runs.periodic_runs(planted))


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(table(spark, folder, "embeddings"), label=label)


ORACLES["op12_hard_negatives"] = hardneg.ORACLE_SQL


@query
def op13_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_copies(table(spark, folder, "documents"))
