"""Column helpers for binary data.

Bytes are viewed as ISO-8859-1 text (one char per byte, loss-free), so the JVM regex and string
functions work on them inside code generation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def latin(blob: Column) -> Column:
    return F.decode(blob, "ISO-8859-1")


def has(text: Column, token: str) -> Column:
    return F.contains(text, F.lit(token))


def occurrences(text: Column, token: str) -> Column:
    """Non-overlapping count of a literal token."""
    bare = F.replace(text, F.lit(token), F.lit(""))
    return ((F.length(text) - F.length(bare)) / F.lit(len(token))).cast("long")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def fragment_id(sha: Column, start: Column, end: Column) -> Column:
    return F.concat(
        F.lit("FRG-"), F.substring(sha, 1, 16), F.lit("-"), start.cast("string"), F.lit("-"), end.cast("string")
    )


def content_id(prefix: str, sha: Column, length: int = 16) -> Column:
    if not prefix.replace("_", "").isalnum():
        raise ValueError(f"invalid id prefix: {prefix!r}")
    if not 4 <= length <= 64:
        raise ValueError(f"invalid id length: {length}")
    return F.concat(F.lit(prefix + "_"), F.substring(sha, 1, length))


def excerpt(blob: Column, start: int, size: int) -> Column:
    """Printable preview of a byte window; ``start`` < 0 counts from the end."""
    if start < 0:
        window = F.substring(blob, F.greatest(F.lit(1), F.length(blob) + start + 1), F.lit(size))
    else:
        window = F.substring(blob, F.lit(start + 1), F.lit(size))
    return F.regexp_replace(latin(window), "[^ -~]", ".")


_BYTE = np.arange(256)
_WHITE = np.isin(_BYTE, [9, 10, 13, 32])
_CLASSES = {"printable": ((_BYTE >= 32) & (_BYTE <= 126)) | _WHITE, "white": _WHITE, "zero": _BYTE == 0, "high": _BYTE >= 128, "digit": (_BYTE >= 48) & (_BYTE <= 57)}
_AT_ONCE = 4096  # blobs whose histograms are held together


def _measure(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """Entropy, bytes per class and longest printable run of non-empty blobs."""
    data = np.frombuffer(b"".join(blobs), "u1")
    sizes = np.array([len(b) for b in blobs])
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(blobs)), sizes)
    counts = np.bincount(row * 256 + data, minlength=256 * len(blobs)).reshape(-1, 256)
    p = counts / sizes[:, None]
    out = {"entropy": -np.sum(p * np.log2(p, where=p > 0, out=np.zeros_like(p)), axis=1) + 0.0}
    out |= {name: counts @ inside.astype("i8") for name, inside in _CLASSES.items()}
    place = np.arange(len(data))
    broken = ~_CLASSES["printable"][data]
    last = np.maximum.accumulate(np.where(broken, place, -1))  # the last byte that ends a run
    out["run"] = np.maximum.reduceat(place - np.maximum(last, starts[row] - 1), starts)
    return out


_MEASURES = StructType([StructField("entropy", DoubleType()), *(StructField(n, LongType()) for n in (*_CLASSES, "run"))])


@F.pandas_udf(_MEASURES)
def byte_measures(blobs: pd.Series) -> pd.DataFrame:
    """Shannon entropy in bits per byte, bytes per class and the longest printable run, in one pass; zeros for empty, nulls for null."""
    names = ["entropy", *_CLASSES, "run"]
    out = {n: np.full(len(blobs), None, object) for n in names}
    values = blobs.tolist()
    for at in range(0, len(values), _AT_ONCE):
        part = values[at : at + _AT_ONCE]
        full = [i for i, b in enumerate(part) if b]
        for i, b in enumerate(part):
            if b is not None and not b:
                for n in names:
                    out[n][at + i] = 0.0 if n == "entropy" else 0
        if full:
            got = _measure([part[i] for i in full])
            for n in names:
                out[n][at + np.array(full)] = got[n]
    return pd.DataFrame(out)


def byte_entropy(blob: Column) -> Column:
    """Shannon entropy in bits per byte, 0 for empty input, null for null input."""
    return byte_measures(blob)["entropy"]
