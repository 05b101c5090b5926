"""Classification and recovery metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def abstain(probabilities: Column, threshold: float = 0.50, order: list[str] | None = None) -> Column:
    """struct(label, confidence, abstained, reason) from a label -> probability map.

    The first entry wins ties; below the threshold the label becomes UNKNOWN.
    """
    entries = F.map_entries(probabilities)
    indexed = F.transform(entries, lambda e, i: F.struct(e["value"].alias("p"), (-i).alias("i"), e["key"].alias("k")))
    best = F.array_max(indexed)
    low = best["p"] < threshold
    reason = F.format_string(f"Confidence %.3f below abstention threshold {threshold:.3f}", best["p"])
    return F.struct(
        F.when(low, "UNKNOWN").otherwise(best["k"]).alias("label"),
        best["p"].alias("confidence"),
        low.alias("abstained"),
        F.when(low, reason).alias("reason"),
    )


def majority_label(df: DataFrame, label: str, seq: str) -> DataFrame:
    """Most frequent label; the one seen first wins ties."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return counts.agg(F.max(F.struct("n", (-F.col("first")).alias("f"), label)).alias("_b")).select(
        F.col(f"_b.{label}").alias("label"), F.col("_b.n").alias("samples")
    )


def label_universe(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.select(F.explode(F.array(true, pred)).alias("label")).distinct()


def confusion_matrix(df: DataFrame, true: str, pred: str, labels: list) -> DataFrame:
    """Rows true, one column per predicted label of the list and one for all others, zero filled.

    The others' column is ``pred_other``, with underscores behind it as long as a label of the list has that name.
    """
    rest = "other"
    while rest in labels:
        rest += "_"
    named = F.when(F.col(pred).isin(labels), F.col(pred)).otherwise(F.lit(rest)).alias("_pred")
    wide = df.select(true, named).groupBy(true).pivot("_pred", [*labels, rest]).agg(F.count(F.lit(1)))
    universe = label_universe(df, true, pred).withColumnRenamed("label", true)
    return universe.join(wide, true, "left").select(
        F.col(true).alias("true_label"), *[F.coalesce(F.col(f"`{l}`"), F.lit(0)).alias(f"pred_{l}") for l in [*labels, rest]]
    )


def _class_counts(df: DataFrame, keys: list[str], true: str, pred: str) -> DataFrame:
    """tp, support and predicted count per key and class of the label universe."""
    cells = df.groupBy(*keys, true, pred).agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col(true).alias("label"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"),
                 F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0).alias("t")),
        F.struct(F.col(pred).alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("t")),
    )
    return (
        cells.select(*keys, F.explode(sides).alias("x"))
        .groupBy(*keys, F.col("x.label").alias("label"))
        .agg(F.sum("x.t").alias("tp"), F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted"))
    )


def _rates(df: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return df.withColumn("_p", p).withColumn("_r", r).withColumn("_f", ratio(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")))


def class_metrics(df: DataFrame, true: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 (0 on empty) and support per class, 4 decimals."""
    keys = keys or []
    return _rates(_class_counts(df, keys, true, pred)).select(
        *keys, "label", F.round("_p", 4).alias("precision"), F.round("_r", 4).alias("recall"), F.round("_f", 4).alias("f1"), "support"
    )


def overall_metrics(df: DataFrame, true: str, pred: str, abstained: str, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, macro F1 over the label universe, support-weighted F1 and abstention rate."""
    keys = keys or []
    total = _rates(_class_counts(df, keys, true, pred)).groupBy(*keys).agg(
        F.sum("support").alias("samples"),
        F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"),
        F.round(F.avg("_f"), 4).alias("macro_f1"),
        F.round(F.sum(F.col("_f") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"),
    )
    left = df.groupBy(*keys).agg(F.round(F.avg(F.col(abstained).cast("double")), 4).alias("abstention_rate"))
    if keys:
        return total.join(left, keys)
    return total.withColumn("abstention_rate", left.scalar())


def compare_models(overall: DataFrame, model: str, seq: str) -> DataFrame:
    """Best model by macro F1 and by accuracy; the earlier one wins ties. One row per criterion."""
    best = lambda metric: F.max(F.struct(F.col(metric).alias("score"), (-F.col(seq)).alias("s"), F.col(model).alias("m")))
    found = overall.agg(best("macro_f1").alias("macro_f1"), best("accuracy").alias("accuracy"))
    row = lambda name: F.struct(F.lit(name).alias("criterion"), F.col(f"{name}.m").alias("model"), F.col(f"{name}.score").alias("score"))
    return found.select(F.inline(F.array(row("macro_f1"), row("accuracy"))))


def dataset_summary(samples: DataFrame) -> DataFrame:
    """Documents and samples per split and per label of the split."""
    return samples.groupBy("split", "label").agg(
        F.count("*").alias("samples"), F.count_distinct("doc_id").alias("documents")
    )


def percent(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, 2)).otherwise(empty)


def sample_metrics(df: DataFrame) -> DataFrame:
    """Recovery percentages per sample. Empty denominators give 100, for bytes 0.

    Needs sizes, object number arrays and counts of streams, strings and pages before and after.
    """
    kept = F.array_intersect("original_objects", "recovered_objects")
    return df.withColumn("objects_kept", F.size(kept).cast("long")).select(
        "*",
        percent(F.col("authentic_bytes"), F.col("original_size"), 0.0).alias("byte_pct"),
        percent(F.col("objects_kept"), F.size(F.array_distinct("original_objects")), 100.0).alias("object_pct"),
        percent(F.col("recovered_streams"), F.col("original_streams"), 100.0).alias("stream_pct"),
        percent(F.col("recovered_strings"), F.col("original_strings"), 100.0).alias("text_pct"),
        percent(F.col("recovered_pages"), F.col("original_pages"), 100.0).alias("page_pct"),
    )


def split_metrics(samples: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 2).alias(f"avg_{c}")
    return samples.groupBy("split").agg(
        F.count("*").alias("samples"),
        *[mean(c) for c in ("byte_pct", "object_pct", "stream_pct", "text_pct", "page_pct")],
        F.round(F.avg(F.col("parser_valid").cast("double")) * 100, 2).alias("validity_rate"),
    )


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of lower-case whitespace token sets, 3 decimals; both empty 1, one empty 0."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    x, y = tokens(a), tokens(b)
    both = F.size(F.array_union(x, y))
    return (
        F.when(both == 0, 1.0)
        .when((F.size(x) == 0) | (F.size(y) == 0), 0.0)
        .otherwise(F.round(F.size(F.array_intersect(x, y)) / both, 3))
    )


def element_rate(found: Column, expected: Column) -> Column:
    return F.when(expected > 0, F.least(F.lit(1.0), found / expected)).otherwise(1.0)


def combine_confidence(df: DataFrame, keys: list[str], confidence: str) -> DataFrame:
    """Aggregation never raises confidence: minimum of the reported values, null without any."""
    return df.groupBy(*keys).agg(F.min(confidence).alias("confidence"))
