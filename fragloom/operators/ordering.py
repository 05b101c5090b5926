"""Orders over rows of a key: log fragments, sessions, artifacts, audit numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fragloom.operators.scale import running_rank


def log_order(logs: DataFrame, keys: list[str], stamp: str, offset: str) -> DataFrame:
    """Position of log fragments: by first timestamp text, undated ones last, then by offset.

    Buckets follow that order: the first 13 characters of the stamp (an hour in ISO form), undated
    rows by offset range.
    """
    undated = F.concat(F.lit("~"), F.lpad(F.floor(F.col(offset) / 65536).cast("string"), 14, "0"))
    bucket = F.coalesce(F.substring(stamp, 1, 13), undated)
    order = [F.col(stamp).asc_nulls_last(), F.col(offset)]
    return running_rank(logs, keys, order, bucket, "position", levels=0)
