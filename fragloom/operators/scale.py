"""Skew-proof building blocks for per-key running sums, ranks and range merging.

A plain window puts all rows of one key into one task. Evidence media are heavily skewed (one disk
image may hold a third of all rows), so these helpers split every key by a coarse bucket of its order
column, work inside buckets, and combine bucket summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WIDTH = 4096


def _bucket_sum(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, out: str, levels: int):
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_local", F.sum(value).over(inner))
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    if levels:
        upper = totals.withColumn("_upper", F.floor(F.col(bucket) / WIDTH))
        summed = _bucket_sum(upper, keys, "_upper", [F.col(bucket)], F.col("_total"), "_sum", levels - 1)
    else:
        top = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
        summed = totals.withColumn("_sum", F.sum("_total").over(top))
    offsets = summed.select(*keys, bucket, (F.col("_sum") - F.col("_total")).alias("_offset"))
    return (
        local.join(offsets, [*keys, bucket])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset")
    )


def running_total(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: Column, out: str,
                  levels: int = 1) -> DataFrame:
    """Inclusive running sum of ``value`` per key.

    ``bucket`` must be a non-negative integer that never decreases along ``order``; with ``levels`` = L
    the last window sees at most buckets / WIDTH**L rows of one key.
    """
    tagged = df.withColumn("_bucket", bucket)
    return _bucket_sum(tagged, keys, "_bucket", order, value, out, levels).drop("_bucket")


def running_rank(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, out: str, levels: int = 1):
    """Row number per key without a whole-key window; ``order`` must be total."""
    return running_total(df, keys, order, bucket, F.lit(1).cast("long"), out, levels)


def with_previous(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str) -> DataFrame:
    """Adds the ``order`` columns of the preceding row of the key as a struct (null for the first).

    A bucket's first row takes the last row of the nearest earlier bucket from one summary row per bucket.
    """
    tagged = df.withColumn("_b", bucket)
    row = F.struct(*order)
    edge = (
        tagged.groupBy(*keys, "_b").agg(F.max(row).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")))
        .select(*keys, "_b", "_carry")
    )
    inner = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (
        tagged.withColumn("_prev", F.lag(row).over(inner)).join(edge, [*keys, "_b"])
        .withColumn(out, F.coalesce("_prev", "_carry")).drop("_b", "_prev", "_carry")
    )


def hash_bucket(sha_hex: Column) -> Column:
    """4096 even buckets that follow the order of a hex digest."""
    return F.conv(F.substring(sha_hex, 1, 3), 16, 10).cast("long")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key through a partial aggregate (no whole-key window)."""
    row = F.struct(*order, F.struct(*df.columns).alias("_row"))
    best = df.groupBy(*keys).agg(F.min(row).alias("_best"))
    return best.select("_best._row.*")


def merge_ranges(df: DataFrame, keys: list[str], start: str, end: str, width: int = 1 << 20) -> DataFrame:
    """Union touching half-open ranges per key, whatever their lengths.

    A range opens a new union if it begins behind the ends of all ranges before it. Inside a ``width``-sized bucket of starts
    a window tells; what a bucket hands on is its farthest end, and the farthest end of all buckets before is a scan
    over one row per bucket. A running sum of the openings then numbers the unions.
    """
    tagged = df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).withColumn("_b", F.floor(F.col("_s") / width))
    last = running_max(tagged.groupBy(*keys, "_b").agg(F.max("_e").alias("_to")), keys, "_b", "_to", "_carry")
    before = Window.partitionBy(*keys, "_b").orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.max("_e").over(before), F.col("_carry"))
    opened = tagged.join(last.select(*keys, "_b", "_carry"), [*keys, "_b"]).withColumn("_new", F.coalesce(seen < F.col("_s"), F.lit(True)).cast("long"))
    numbered = running_total(opened.drop("_carry", "_b"), keys, [F.col("_s"), F.col("_e")], F.floor(F.col("_s") / width), F.col("_new"), "_run")
    merged = numbered.groupBy(*keys, "_run").agg(F.min("_s").alias(start), F.max("_e").alias(end))
    return merged.drop("_run")


def running_max(df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """Largest ``value`` of the rows before each row (null for the first); rows meet ``width`` at a time.

    ``order`` is a non-negative integer. The maximum is associative, so a group of ``width`` numbers hands on one row.
    """
    group = df.withColumn("_g", F.floor(F.col(order) / width))
    tops = group.groupBy(*keys, "_g").agg(F.max(value).alias("_top"))
    ahead = F.max("_top").over(Window.partitionBy(*keys).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))
    inner = F.max(value).over(Window.partitionBy(*keys, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    joined = group.withColumn("_in", inner).join(tops.withColumn("_ahead", ahead).drop("_top"), [*keys, "_g"])
    return joined.withColumn(out, F.greatest("_in", "_ahead")).drop("_g", "_in", "_ahead")


def even_bucket(df: DataFrame, column: str, parts: int, error: float = 0.0) -> Column:
    """A bucket number that never falls along the numeric ``column``, with about as many rows in each of ``parts`` buckets.

    The splitters come from Spark's quantile sketch, so sparse, dense and hashed values spread alike; the driver
    gets ``parts`` numbers. A null goes to bucket 0, as it sorts first.
    """
    error = error or 0.1 / parts
    cuts = sorted(set(df.approxQuantile(column, [k / parts for k in range(1, parts)], error))) if parts > 1 else []
    if not cuts:
        return F.lit(0).cast("long")
    at = F.col(column).cast("double")
    return _search(at, cuts, 0, len(cuts)).cast("long")


def _search(at: Column, cuts: list[float], low: int, high: int) -> Column:
    """Number of ``cuts`` at or below ``at``, by halving."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(at >= cuts[mid], _search(at, cuts, mid + 1, high)).otherwise(_search(at, cuts, low, mid))


def global_rank(df: DataFrame, column: str, out: str, keys: list[str] | None = None, ties: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Row number in the order of a numeric ``column`` (then ``ties``), over all rows or per key, by sample sort.

    Buckets between splitters are ranked on their own and shifted by the counts of the buckets before them.
    """
    parts = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return running_rank(df, keys or [], [F.col(column), *map(F.col, ties)], even_bucket(df, column, parts), out)


# set while an intermediate is written: the shuffle files behind it go as soon as it is there, not when the JVM collects garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate once to the shared checkpoint folder when several joins read it; its shuffle files are dropped."""
    from fragloom.session import ensure_checkpoint_dir

    conf = df.sparkSession.conf
    ensure_checkpoint_dir(df.sparkSession)
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a plan takes the setting when it is made
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def discard(*made: DataFrame) -> None:
    """Delete the files of results of ``materialize`` that no later step reads."""
    for df in made:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
