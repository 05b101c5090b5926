"""Row keys, staged tables and tokenizer access shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

MEMO = 1 << 18  # words whose hash a task remembers
FILTER_BITS = 1 << 26
PAGE = 1 << 15  # bits of one bitmap aggregate


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a session without that setting gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/fragloom-llm/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


REMEMBERED: dict[str, object] = {}  # what tasks of one worker share: a vocabulary, pieces it has coded


def remembered(name: str, build: Callable):
    """The object of that name in this worker, built on first use."""
    if name not in REMEMBERED:
        REMEMBERED[name] = build()
    return REMEMBERED[name]


def forget() -> None:
    REMEMBERED.clear()


def give_back() -> None:
    """Return freed memory to the system: Spark uses a worker again, and its peaks would otherwise add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable, keep: bool = False) -> Callable:
    """``run``, a function of Arrow batches, that gives its memory back when its task ends.

    What earlier tasks of another operator remember goes as well, unless ``keep`` says that the next tasks need it.
    """

    @functools.wraps(run)
    def wrapped(batches):
        if not keep:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names that no other column can clash with."""
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))


def words(text: Column) -> Column:
    """Maximal runs of characters other than white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def crc32_of_id(id_value: int | None) -> int:
    """crc32 of the id as decimal text; a null id counts as the empty text."""
    return zlib.crc32(b"" if id_value is None else str(id_value).encode())


def crc32_fold(id_col: str, folds: int) -> Column:
    """Spark's form of ``crc32_of_id(id) mod folds``."""
    text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Default place of a public vocabulary file; operators take the path as a parameter."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ModuleNotFoundError:
        return os.path.join("/opt/tokenizers", name)


def word_hashes(parts: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; frequent words are remembered up to a bound."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    if len(memo) < MEMO:
        for w in set(parts):
            if w not in memo:
                memo[w] = digest(w)
        return np.fromiter(map(memo.__getitem__, parts), "u8", len(parts))
    get = memo.get
    return np.fromiter([get(w) or digest(w) for w in parts], "u8", len(parts))


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """A bitmap with two bits for each value of the long column ``h``: 8 MB however many there are.

    It lets every listed value through and few others; as it fills it only lets more through, so what follows must
    compare exactly. Spark sets the bits, at most 2,048 pages reach the driver.
    """
    spots = F.array(F.col("h").bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned("h", 38))
    at = hashes.select(F.explode(spots).alias("b")).select((F.col("b") / PAGE).cast("long").alias("page"), (F.col("b") % PAGE).alias("bit"))
    filled = np.zeros(FILTER_BITS // 8, "u1")
    for page, bits in at.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        filled[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(bits, "u1")
    return filled


def in_filter(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """True where the unsigned 64-bit hash may be listed."""
    out = np.ones(len(h), bool)
    for at in ((h & np.uint64(FILTER_BITS - 1)).astype("i8"), (h >> np.uint64(38)).astype("i8")):
        out &= ((bitmap[at >> 3] >> (at & 7).astype("u1")) & 1).astype(bool)
    return out
