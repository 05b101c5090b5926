"""From raw documents to token ids: quality, line dedup, near copies, benchmark passages, coding.

Each stage gets what its predecessor wrote, works on all of it, and (but for the last) returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fragloom.llm import bpe, decontaminate, jaccard, lines, quality
from fragloom.llm.common import crc32_fold, scratch, tokenizer_path

KEEP_FROM = 0.3  # quality score from which a document stays


def hidden(docs: DataFrame) -> DataFrame:
    """doc_id and text under their names, every other column under its place, so that no operator's column can meet it."""
    own = ("doc_id", "text")
    return docs.select(*(F.col(f"`{c}`").alias(c if c in own else f"_column{i}") for i, c in enumerate(docs.columns)))


def shown(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, without what an operator added."""
    own = ("doc_id", "text")
    return out.select(*(F.col(c if c in own else f"_column{i}").alias(c) for i, c in enumerate(docs.columns)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of KEEP_FROM or more; learnt from the labels of four in five ids.

    Null and empty texts are scored like texts without words; repeated rows and null ids are judged each; an empty table
    gives no rows. All columns stay, whatever their names.
    """
    model = quality.fit(docs.where(crc32_fold("doc_id", 5) != 0), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in docs.columns))), model, "_row")
    return scored.where(F.col("score") >= KEEP_FROM).select("_row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the line chunks that an earlier document has; n_chars follows the text.

    Null texts stay null, a text may become empty and its row stays; rows equal in id and text are one document, null ids
    come first. An empty table gives no rows. All columns stay, whatever their names.
    """
    out = shown(lines.dedup_lines(hidden(docs)), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one with the smallest id.

    Rows without words stay; a null id counts as the largest; of rows equal in id and text one stays. An empty table gives
    no rows. All columns stay, whatever their names.
    """
    return jaccard.keep_one(docs, size=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts stay; repeated rows and null ids are judged by their text; an empty benchmark keeps all. An empty
    table gives no rows. All columns stay, whatever their names.
    """
    found = decontaminate.contamination(hidden(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return shown(found.where("not contaminated"), docs)


def coding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids decode to.

    Null and empty texts have no ids and an empty text; repeated rows and null ids stay; an empty table gives no rows. Other
    columns are not read.
    """
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_copies", near_stage),
    ("decontamination", benchmark_stage),
    ("bpe", coding_stage),
]

# The first stage's classifier can't be said in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
