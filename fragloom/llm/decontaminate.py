"""Benchmark decontamination with spaced seeds.

A seed is the hash of the words under a fixed mask, so words at the mask's gaps may differ. Seeds of the benchmark and
of the documents are joined; around each hit, the words on the hit's diagonal are compared, substitutions included.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fragloom.llm.common import hash_filter, in_filter, released, staged, texts, word_hashes

MASKS = ("1101001011", "10110111")  # 1: the word counts, 0: any word may stand there
SHORTEST = min(map(len, MASKS))  # items with fewer words are found by all their words
MIN_WORDS = 12  # words an overlap must span, or the whole item if that has fewer
MIN_SHARE = 0.8  # of them equal
# Lower-cased bytes: ASCII signs part words; longer characters belong to them.
FOLD = bytes(c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def tokens(text: str | None, memo: dict[bytes, int]) -> np.ndarray:
    return word_hashes((text or "").lower().encode("utf-8", "surrogatepass").translate(FOLD).split(), memo)


def seeds(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and their start words for all masks."""
    out, at = [], []
    for k, mask in enumerate(MASKS):
        n = len(t) - len(mask) + 1
        if n <= 0:
            continue
        h = np.full(n, k + 1, "u8")
        for i, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ t[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        out.append(h)
        at.append(np.arange(n, dtype="i4"))
    if not out:
        return np.zeros(0, "u8"), np.zeros(0, "i4")
    return np.concatenate(out), np.concatenate(at)


def whole_seeds(t: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of each window of the given lengths, each hash once at its first place."""
    out, at = [np.zeros(0, "u8")], [np.zeros(0, "i4")]
    for size in lengths:
        n = len(t) - size + 1
        if size and n > 0:
            h = np.full(n, len(MASKS) + size, "u8")
            for i in range(size):
                h = (h ^ t[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            h, first = np.unique(h, return_index=True)
            out.append(h)
            at.append(first.astype("i4"))
    return np.concatenate(out), np.concatenate(at)


def item_rows(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Benchmark texts, each once under its smallest id, as token bytes with seeds and filter places."""
    rows = texts(items, item_col, text_col).where("_text is not null").groupBy("_text").agg(F.min("_id").alias("item")).withColumn("key", F.xxhash64("_text"))
    kind = rows.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            toks = [tokens(t, memo) for t in batch.column(1).to_pylist()]
            found = [seeds(t) if len(t) >= SHORTEST else whole_seeds(t, [len(t)]) for t in toks]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([t.tobytes() for t in toks], pa.binary()), pa.array([h.view("i8") for h, _ in found], pa.list_(pa.int64())), pa.array([a for _, a in found], pa.list_(pa.int32()))],
                ["item", "key", "item_tokens", "seed", "at"],
            )

    return rows.select("item", "_text", "key").mapInArrow(released(run), f"item {kind}, key long, item_tokens binary, seed array<long>, at array<int>")


def hit_rows(docs: DataFrame, filled: np.ndarray, lengths: list[int]) -> DataFrame:
    """Documents with a seed that passes the filter: their token bytes, and the seeds with their places."""
    shared = docs.sparkSession.sparkContext.broadcast(filled)
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, memo = shared.value, {}
        for batch in batches:
            keep, toks, hit_seeds, hit_places = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                t = tokens(text, memo)
                h, at = (np.concatenate(x) for x in zip(seeds(t), whole_seeds(t, lengths)))
                hit = np.flatnonzero(in_filter(h, bitmap))
                if len(hit):
                    keep.append(i)
                    toks.append(t.tobytes())
                    hit_seeds.append(h[hit].view("i8"))
                    hit_places.append(at[hit])
            slim = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [slim.column(0), slim.column(2), pa.array(toks, pa.binary()), pa.array(hit_seeds, pa.list_(pa.int64())), pa.array(hit_places, pa.list_(pa.int32()))],
                ["_id", "_tie", "tokens", "seed", "at"],
            )

    return docs.select("_id", "_text", "_tie").mapInArrow(released(run), f"_id {kind}, _tie long, tokens binary, seed array<long>, at array<int>")


@lru_cache
def ratio(share: float) -> tuple[int, int]:
    return Fraction(share).limit_denominator(1000).as_integer_ratio()


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> tuple[int, int, int] | None:
    """Start in the document, words and equal words of the best overlap on the diagonal (document place - item place).

    Of all spans of at least ``min_words`` words (or the whole item) with the share of equal words, the one with the most
    equal words, then the fewest words, then the smallest start. Linear: prefix sums of a score that is not below zero
    where the share is reached, and for each end the first start whose sum is no larger.
    """
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    least = min(min_words, len(item))
    if hi - lo < max(least, 1):
        return None
    same = item[lo:hi] == doc[lo + diagonal : hi + diagonal]
    part, whole = ratio(min_share)
    if np.count_nonzero(same) * whole < part * least:
        return None
    score = np.concatenate(([0], np.cumsum(whole * same.astype("i8") - part)))
    before = np.concatenate(([0], np.cumsum(same)))
    ends = np.arange(least, len(score))
    starts = np.searchsorted(-np.minimum.accumulate(score), -score[ends])
    ok = starts <= ends - least
    most = int((before[ends] - before[starts])[ok].max(initial=0))
    if not most:
        return None
    # the shortest of the spans with so many equal words: from one equal word to another, filled up to the minimum
    at = np.flatnonzero(same)
    first, last = at[: len(at) - most + 1], at[most - 1 :]
    size = np.maximum(last - first + 1, least)
    k = int(np.argmin(size))
    return lo + diagonal + max(0, int(last[k] + 1 - size[k])), int(size[k]), most


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Verified overlaps: (_id, _tie, item, start, words, equal), the best of each document and distinct item text.

    Items with fewer words than the shortest mask (8) match word for word; items without words match nothing. A null item
    id is an id like others. Only documents with a hit go on;
    the filter's size is fixed, so a larger benchmark only makes it let more through to the join.
    """
    bench = staged(item_rows(items, item_col, item_text_col), "bench")
    sizes = bench.select((F.length("item_tokens") / 8).cast("int").alias("n")).where(F.col("n").between(1, SHORTEST - 1)).distinct()
    lengths = sorted(x.n for x in sizes.collect())
    rows = texts(docs, id_col, text_col).where("_text is not null").withColumn("_tie", F.xxhash64("_text"))
    hits = staged(hit_rows(rows, hash_filter(bench.select(F.explode("seed").alias("h"))), lengths), "hits")
    a = hits.select("_id", "_tie", F.explode(F.arrays_zip("seed", "at")).alias("x")).select("_id", "_tie", "x.seed", F.col("x.at").alias("doc_at"))
    b = bench.select("key", F.explode(F.arrays_zip("seed", "at")).alias("x")).select("key", "x.seed", F.col("x.at").alias("item_at"))
    pairs = a.join(b, "seed").select("_id", "_tie", "key", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).distinct()
    by_doc = hits.select(F.col("_id").alias("_hid"), F.col("_tie").alias("_htie"), "tokens").dropDuplicates(["_hid", "_htie"])
    full = pairs.join(by_doc, (F.col("_tie") == F.col("_htie")) & F.col("_id").eqNullSafe(F.col("_hid"))).join(bench.select("key", "item", "item_tokens"), "key")
    id_type, item_type = full.schema["_id"].dataType.simpleString(), full.schema["item"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for i in range(batch.num_rows):
                doc = np.frombuffer(batch.column(4)[i].as_buffer(), "u8")
                item = np.frombuffer(batch.column(5)[i].as_buffer(), "u8")
                hit = overlap(doc, item, batch.column(3)[i].as_py())
                if hit:
                    keep.append(i)
                    found.append(hit)
            slim = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([slim.column(0), slim.column(1), slim.column(2), slim.column(6), *(pa.array([f[k] for f in found], pa.int32()) for k in range(3))], ["_id", "_tie", "item", "key", "start", "words", "equal"])

    good = full.select("_id", "_tie", "item", "diagonal", "tokens", "item_tokens", "key").mapInArrow(check, f"_id {id_type}, _tie long, item {item_type}, key long, start int, words int, equal int")
    best = F.max(F.struct("equal", (-F.col("words")).alias("w"), (-F.col("start")).alias("s"))).alias("b")
    return good.groupBy("_id", "_tie", "item", "key").agg(best).select("_id", "_tie", "item", (-F.col("b.s")).alias("start"), (-F.col("b.w")).alias("words"), F.col("b.equal").alias("equal"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``contaminated``, ``n_items``, ``item``, ``start``, ``words`` and ``equal`` of the best overlap
    (most equal words, then the smallest item); such names already in ``docs`` give way.

    Null and empty texts, an empty benchmark and null benchmark texts give no overlap. Rows with equal id and text get
    one verdict; equal ids with other texts and null ids are judged by their own text.
    """
    added = ("contaminated", "n_items", "item", "start", "words", "equal")
    own = [c for c in docs.columns if c not in added]
    found = overlaps(docs, items, id_col, text_col, item_col, item_text_col).groupBy("_id", "_tie").agg(
        F.count("*").alias("n_items"), F.min_by(F.struct("item", "start", "words", "equal"), F.struct(-F.col("equal"), F.col("item"), F.col("words"), F.col("start"))).alias("b")
    ).withColumnsRenamed({"_id": "_oid", "_tie": "_otie"})
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_tie"))
    out = keyed.join(found, (F.col("_tie") == F.col("_otie")) & F.col("_id").eqNullSafe(F.col("_oid")), "left")
    return out.select(
        *(F.col(f"_c{i}").alias(c) for i, c in enumerate(own)),
        F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "b.item", "b.start", "b.words", "b.equal",
    )
