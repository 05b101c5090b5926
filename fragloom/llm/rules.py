"""Quality rules with thresholds that follow the data: bucket-count quantile sketches per language and source.

Only DataFrame functions. A sketch is the table of counts per bucket of 1/10,000 of a ratio: sketches of two parts
add up to the sketch of the whole, a quantile read from it is at most one bucket off, and its size is bounded by
10,001 buckets whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fragloom.llm.common import staged, words

SYMBOLS = "#*$%&|<>"
SCALE = 10_000
RATIOS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio")
# A group with fewer documents borrows its language's sketch, then that of all documents.
MIN_GROUP = 200
# Fence: upper quartile + FENCE quartile ranges, at least the slack above the upper quartile (in 1/10,000): a clean
# text may hold some signs, repeat its header lines and set phrases.
FENCE = 3
SLACK = {"symbol_ratio": 500, "dup_line_ratio": 5_000, "repeat_ratio": 3_000}


def sorted_windows(w: str) -> Column:
    """(hash, start) of each 3-word window of the array column ``w``, sorted, so that equal windows are neighbours.

    Starts of repeated windows, in order, then cover 3 words each or as many as lie before the next start: linear
    memory, n log n time, no shuffle.
    """
    w = F.col(w)
    starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))))


def base_metrics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each whole text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cols = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    kept = [f"_k{i}" for i in range(len(keep))]
    out = docs.select(
        *cols,
        words(text).alias("_w"),
        lines.alias("_l"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    out = out.select(
        *kept,
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    out = out.withColumn("_s", sorted_windows("_w")).drop("_w")
    s = F.col("_s")
    again = F.filter(s, lambda x, i: ((i > 0) & (x.h == F.get(s, i - 1).h)) | F.coalesce(x.h == F.get(s, i + 1).h, F.lit(False)))
    out = out.withColumn("_p", F.sort_array(F.transform(again, lambda x: x.p))).drop("_s")
    p = F.col("_p")
    cover = F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)))
    out = out.withColumn("n_repeat_words", F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_p")
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def with_ratios(metrics: DataFrame) -> DataFrame:
    part = lambda a, b: F.floor(F.lit(SCALE) * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("int")
    return metrics.withColumns({"symbol_ratio": part("n_symbols", "word_chars"), "dup_line_ratio": part("n_dup_lines", "n_lines"), "repeat_ratio": part("n_repeat_words", "n_words")})


def sketches(metrics: DataFrame, groups: list[str]) -> DataFrame:
    """Mergeable sketch rows (groups, metric, bucket, n); counting is combined before the shuffle."""
    long = F.explode(F.array(*(F.struct(F.lit(r).alias("metric"), F.col(r).alias("bucket")) for r in RATIOS))).alias("_m")
    return metrics.select(*groups, long).select(*groups, "_m.metric", "_m.bucket").groupBy(*groups, "metric", "bucket").agg(F.count("*").alias("n"))


def merge(parts: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of coarser groups: counts of equal buckets add up."""
    return parts.groupBy(*groups, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """One row per group: its rows and an upper fence for each ratio. At most 10,001 rows per group and metric."""
    by = Window.partitionBy(*groups, "metric")
    run = sketch.withColumns({"_run": F.sum("n").over(by.orderBy("bucket")), "_all": F.sum("n").over(by)})
    at = lambda num: F.min(F.when(F.col("_run") * 4 >= F.col("_all") * num, F.col("bucket")))
    q = run.groupBy(*groups, "metric").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("_all").alias("rows"))
    fence = lambda r: F.col("q3") + F.greatest((F.col("q3") - F.col("q1")) * FENCE, F.lit(SLACK[r]))
    return q.groupBy(*groups).agg(F.max("rows").alias("rows"), *(F.max(F.when(F.col("metric") == r, fence(r))).alias(f"max_{r}") for r in RATIOS))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """Every row with its measures, its group's fences and the verdict.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated windows. ``kept``: not base_failed and
    no ratio above its fence. The fences come from the rows that pass the base rules, so that junk doesn't widen them.
    Null language or source is a group of its own; null and empty texts fail the base rule; rows with equal or null
    ids are judged each; an empty table gives no rows. Columns besides the four named ones are not read.
    """
    m = base_metrics(docs, [id_col, lang_col, source_col], text_col).toDF("_id", "_lang", "_source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    m = m.withColumns({c: F.col(c).cast("string") for c in ("_lang", "_source")})
    m = staged(with_ratios(m).withColumn("base_failed", failed), "rule_metrics")
    fine = sketches(m.where("not base_failed"), ["_lang", "_source"])
    lang = merge(fine, ["_lang"])
    nothing = F.lit(None).cast("string")
    level = lambda df, groups, n: fences(df, groups).select(F.lit(n).alias("level"), *((F.col(c) if c in groups else nothing).alias(f"f{c}") for c in ("_lang", "_source")), "rows", *(f"max_{r}" for r in RATIOS))
    levels = level(fine, ["_lang", "_source"], 0).unionByName(level(lang, ["_lang"], 1)).unionByName(level(merge(lang, []).withColumn("_one", F.lit(1)), ["_one"], 2))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # one row per group, with the finest sketch that has enough rows: rows then meet one small table
    choices = F.array(*(F.struct(F.lit(n).alias("n"), (F.col("_lang") if n < 2 else nothing).alias("cl"), (F.col("_source") if n < 1 else nothing).alias("cs")) for n in range(3)))
    asked = m.select("_lang", "_source").distinct().withColumn("c", F.explode(choices))
    groups = (
        asked.join(levels, (F.col("c.n") == F.col("level")) & F.col("c.cl").eqNullSafe(F.col("f_lang")) & F.col("c.cs").eqNullSafe(F.col("f_source")))
        .where((F.col("rows") >= min_group) | (F.col("level") == 2))
        .groupBy(F.col("_lang").alias("_gl"), F.col("_source").alias("_gs"))
        .agg(F.min_by(F.struct(*(f"max_{r}" for r in RATIOS)), "level").alias("_f"))
        .select("_gl", "_gs", "_f.*")
    )
    out = m.join(groups, same("_lang", "_gl") & same("_source", "_gs"), "left")
    inside = F.lit(True)
    for r in RATIOS:
        inside = inside & F.coalesce(F.col(r) <= F.col(f"max_{r}"), F.lit(True))
    return out.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", *RATIOS,
        *(f"max_{r}" for r in RATIOS), "base_failed", (~F.col("base_failed") & inside).alias("kept"),
    )
