"""Splits, leakage checks, registry and sample validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fragloom.operators.scale import global_rank, hash_bucket, running_rank


def split_by_rank(docs: DataFrame, doc: str, shares: tuple[float, float, float] = (0.5, 0.2, 0.2)):
    """Document-level split in the order of a numeric id: train, validation, test (each at least one), rest hard_test."""
    ids = docs.select(doc).distinct()
    n = ids.agg(F.count("*")).scalar()
    sizes = [F.greatest(F.lit(1), F.floor(n * s)) for s in shares]
    r = F.col("_r")
    ranked = global_rank(ids, doc, "_r")
    return ranked.withColumn(
        "split",
        F.when(r <= sizes[0], "train")
        .when(r <= sizes[0] + sizes[1], "validation")
        .when(r <= sizes[0] + sizes[1] + sizes[2], "test")
        .otherwise("hard_test"),
    ).drop("_r")


def split_shuffled(docs: DataFrame, doc: str, seed: int = 42, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Document-level split in the order of sha256("seed:doc"); at least one train document.

    A keyed digest replaces a sequential random generator, so any task can recompute it.
    """
    ids = docs.select(doc).distinct().withColumn("_k", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc).cast("string")), 256))
    n = ids.agg(F.count("*")).scalar()
    n_train = F.greatest(F.lit(1), F.bround(n * train))
    n_val = F.greatest(F.when(n >= 3, 1).otherwise(0), F.bround(n * validation))
    # without a test document one validation document moves over
    n_val = F.when((n - n_train - n_val <= 0) & (n_val > 1), F.least(n_val, n - n_train) - 1).otherwise(n_val)
    ranked = running_rank(ids, [], [F.col("_k")], hash_bucket(F.col("_k")), "_r")
    split = F.when(F.col("_r") <= n_train, "train").when(F.col("_r") <= n_train + n_val, "validation").otherwise("test")
    return ranked.select(doc, split.alias("split"))


def leakage(samples: DataFrame, key: str) -> DataFrame:
    """Documents (or source digests) that occur in more than one split."""
    return samples.groupBy(key).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def severity_assign(split: Column, index: Column) -> Column:
    return (
        F.when(split == "hard_test", 4)
        .when(split == "test", F.when(index % 2 == 1, 3).otherwise(2))
        .when(split == "validation", F.when(index % 2 == 1, 2).otherwise(1))
        .otherwise((index % 4) + 1)
        .cast("long")
    )


def registry_upsert(registry: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New records replace old ones of the same id."""
    return registry.join(new.select(key), key, "left_anti").unionByName(new)


def registry_filter(registry: DataFrame, license: str | None = None, characteristic: str | None = None, intact: bool | None = None):
    out = registry
    if license is not None:
        out = out.where(F.col("license") == license)
    if characteristic is not None:
        out = out.where(F.array_contains("characteristics", characteristic))
    if intact is not None:
        out = out.where(F.col("is_intact") == intact)
    return out


def model_catalog_filter(models: DataFrame, task: str | None = None, commercial_only: bool = False, cpu_only: bool = False):
    out = models
    if task is not None:
        out = out.where(F.col("task") == task)
    if commercial_only:
        out = out.where("commercial_use_permitted")
    if cpu_only:
        out = out.where("cpu_compatible")
    return out


def model_compliance(models: DataFrame) -> DataFrame:
    case = lambda cond, name: F.when(cond, F.lit(name))
    issues = F.array_compact(
        F.array(
            case(~F.col("commercial_use_permitted"), "license_restricts_commercial_use"),
            case(~F.col("cpu_compatible") & (F.col("execution_mode") == "LOCAL_CPU"), "gpu_model_on_local_cpu"),
            case((F.col("model_size_mb") > 500) & (F.col("execution_mode") != "WORKER_BACKGROUND"), "size_over_500_mb"),
        )
    )
    return models.select("model_id", (F.size(issues) == 0).alias("valid"), issues.alias("issues"))


def index_mismatch(indexed: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Ids that only the index or only the store knows."""
    a = indexed.select(key).distinct().withColumn("_i", F.lit(True))
    b = stored.select(key).distinct().withColumn("_s", F.lit(True))
    return (
        a.join(b, key, "full_outer").where("_i is null or _s is null")
        .select(key, F.when(F.col("_i").isNull(), "not_indexed").otherwise("not_stored").alias("issue"))
    )


def sample_findings(samples: DataFrame) -> DataFrame:
    """Issue rows per stored sample: missing parts, digest mismatches, bad operation bounds."""
    original, damaged = F.sha2("original", 256), F.sha2("damaged", 256)
    bad_op = F.exists("operations", lambda o: (o["offset_start"] < 0) | (o["offset_end"] < o["offset_start"]))
    case = lambda cond, name: F.when(cond, F.lit(name))
    issues = F.array_compact(
        F.array(
            case(F.col("original").isNull(), "missing_original"),
            case(F.col("damaged").isNull(), "missing_damaged"),
            case(F.col("manifest_source_sha256") != original, "manifest_source_mismatch"),
            case(F.col("manifest_damaged_sha256") != damaged, "manifest_damaged_mismatch"),
            case(F.col("truth_source_sha256") != original, "truth_source_mismatch"),
            case(F.col("truth_damaged_sha256") != damaged, "truth_damaged_mismatch"),
            case(bad_op, "bad_operation_bounds"),
        )
    )
    found = samples.select("sample_id", F.explode(issues).alias("issue"))
    twice = samples.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1").select("sample_id", F.lit("duplicate_sample_id").alias("issue"))
    return found.unionByName(twice)


def delta_objects(original: Column, damaged: Column) -> dict[str, Column]:
    return {"removed": F.array_except(original, damaged), "surviving": F.array_intersect(original, damaged)}


def damage_states(original: Column, removed: Column, damaged: Column) -> Column:
    """Array of (object, state) structs; object ids are compared exactly."""
    return F.transform(
        original,
        lambda o: F.struct(
            o.alias("object"),
            F.when(F.array_contains(removed, o), "MISSING")
            .when(F.array_contains(damaged, o), "PARTIALLY_DAMAGED")
            .otherwise("INTACT")
            .alias("state"),
        ),
    )
