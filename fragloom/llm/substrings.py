"""Removal of byte strings of 200 bytes that also start elsewhere, by hash-compared suffix sorts.

1. Every 200-byte window picks the smallest 32-byte gram in it (leftmost of equal ones), its anchor. Equal windows pick
   it at the same place, so windows need comparing only with those of the same anchor hash and place. Consecutive
   windows with one anchor form a segment.
2. An anchor hash seen once has no equal window. For the others, segments are collected once per distinct content.
3. Suffixes that start at the same place before the same anchor meet by the hash of their first 200 bytes. A class whose
   bytes all agree is done, one whose bytes differ is sorted by merging sorted runs: a comparison finds the common extension
   by binary search over polynomial prefix hashes, so it takes 8 hash look-ups and a byte. Neighbours with 200 bytes in
   common are equal windows once their bytes have been compared.
4. Windows found equal are marked in their documents, and every byte under one of them goes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fragloom.llm.common import hash_filter, in_filter, staged, texts

LENGTH = 200
GRAM = 32
PIECE = 1 << 23  # bytes of a document looked at together
TOGETHER = 1 << 14  # bytes of short documents looked at together
SORT_ROWS = 3_000  # segments sorted together
WINDOWS = 1 << 20  # windows sorted together
PAIRS = 1 << 12  # windows whose bytes are compared together
MAX_GROUP = 50_000  # segments of one anchor hash that a task sorts; windows of larger groups meet in a shuffle
BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, "u8")
    out[:1] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed hash of each GRAM-byte string, by doubling."""
    h, width, factor = data.astype("u8") + np.uint64(1), 1, int(BASE)
    while width < GRAM:
        h = h[: len(h) - width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), width * 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def segments(data: list[np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window, number of windows, anchor's distance from the first window, and anchor hash of each segment.

    Texts are looked at TOGETHER bytes at a time, as most are far too short to be worth a pass each. Strings that reach from
    one text into the next are hashed as well, but no window of a text holds one.
    """
    parts, held, weight = [], [], 0
    for i, text in enumerate(data):
        for at in range(0, len(text) - length + 1, PIECE):
            piece = text[at : at + PIECE + length - 1]
            held.append((i, at, piece))
            weight += len(piece)
            if weight >= TOGETHER:
                parts.append(segments_together(held, length))
                held, weight = [], 0
    if held:
        parts.append(segments_together(held, length))
    if not parts:
        return tuple(np.zeros(0, k) for k in ("i8", "i8", "i8", "i8", "u8"))
    return tuple(np.concatenate(p) for p in zip(*parts))


def segments_together(pieces: list[tuple[int, int, np.ndarray]], length: int) -> tuple[np.ndarray, ...]:
    """``segments`` of pieces (text, offset in it, bytes) of at least ``length`` bytes each."""
    text, offset = (np.array([p[k] for p in pieces]) for k in (0, 1))
    size = np.array([len(p[2]) for p in pieces])
    base = np.cumsum(size) - size
    h = gram_hashes(np.concatenate([p[2] for p in pieces]))
    key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype="u8")
    span, width = length - GRAM + 1, 1
    while width * 2 <= span:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    windows = size - length + 1
    owner = np.repeat(np.arange(len(pieces)), windows)
    place = np.arange(len(owner)) + np.repeat(base - (np.cumsum(windows) - windows), windows)
    anchor = (key[place] & np.uint64((1 << 24) - 1)).astype("i8")  # inside the window, so never the same for two pieces
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    count = np.diff(first, append=len(anchor))
    own, anchor, place = owner[first], anchor[first], place[first]
    return text[own], place - base[own] + offset[own], count, anchor - place, h[anchor]


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), "u1")


def anchor_counts(rows: DataFrame, length: int) -> DataFrame:
    """(h, k): anchor hashes with the number of segments, added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, k = np.unique(segments([as_bytes(t) for t in batch.column(1).to_pylist()], length)[4], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view("i8")), pa.array(k.astype("i8"))], ["h", "k"])

    return rows.select("_id", "_text").mapInArrow(run, "h long, k long").groupBy("h").agg(F.sum("k").alias("k"))


def segment_rows(rows: DataFrame, repeated: DataFrame, length: int) -> DataFrame:
    """(h, d1, d2, seg, before, k, starts, _id, _tie): a document's distinct segments whose anchor hash is repeated.

    d1 and d2 are a 128-bit digest of the segment, k the number of its places in the document.
    """
    shared = rows.sparkSession.sparkContext.broadcast(hash_filter(repeated))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                chunk = batch.slice(at, 64)
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in chunk.column(1).to_pylist()]
                found = segments([np.frombuffer(r, "u1") for r in raw], length)
                hit = np.flatnonzero(in_filter(found[4], shared.value))
                own = {}
                for i, a, n, before, h in zip(*(x[hit].tolist() for x in found[:4]), found[4][hit].view("i8").tolist()):
                    own.setdefault((h, raw[i][a : a + n + length - 1], before, i), []).append(a)
                keys, places = list(own), list(own.values())
                rows_of = [k[3] for k in keys]
                digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k[1]) for k in keys]), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in keys], pa.int64()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array([k[1] for k in keys], pa.binary()),
                        pa.array([k[2] for k in keys], pa.int32()), pa.array([len(v) for v in places], pa.int64()), pa.array([np.array(v, "<i8").tobytes() for v in places], pa.binary()),
                        chunk.column(0).take(pa.array(rows_of, pa.int64())), chunk.column(2).take(pa.array(rows_of, pa.int64())),
                    ],
                    ["h", "d1", "d2", "seg", "before", "k", "starts", "_id", "_tie"],
                )

    return rows.select("_id", "_text", "_tie").mapInArrow(run, f"h long, d1 long, d2 long, seg binary, before int, k long, starts binary, _id {kind}, _tie long")


class Suffixes:
    """Suffixes of one byte array, compared by hashes of their parts up to ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.power = powers(len(data) + 1)
        self.prefix = np.concatenate((np.zeros(1, "u8"), np.cumsum((data.astype("u8") + np.uint64(1)) * self.power[:-1], dtype="u8")))

    def same(self, x: np.ndarray, y: np.ndarray, size) -> np.ndarray:
        return (self.prefix[x + size] - self.prefix[x]) * self.power[y] == (self.prefix[y + size] - self.prefix[y]) * self.power[x]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, at most ``length``."""
        out = np.full(len(x), self.length, "i8")
        open_ = np.flatnonzero(~self.same(x, y, self.length))
        x, y = x[open_], y[open_]
        lo, hi = np.zeros(len(x), "i8"), np.full(len(x), self.length, "i8")  # lo bytes are equal, hi bytes are not
        for _ in range(self.length.bit_length()):
            mid = (lo + hi) // 2
            ok = self.same(x, y, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, np.maximum(mid, lo + 1))
        out[open_] = lo
        return out

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Hashes of the ``length`` bytes at each place, whatever the place."""
        return (self.prefix[x + self.length] - self.prefix[x]) * self.power[len(self.data) - x]

    def equal_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the ``length`` bytes at two places are equal."""
        rows = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        parts = [(rows[x[k : k + PAIRS]] == rows[y[k : k + PAIRS]]).all(axis=1) for k in range(0, len(x), PAIRS)]
        return np.concatenate([np.zeros(0, bool), *parts])

    def less(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether x's suffix comes before y's, and whether they are equal."""
        n = self.common(x, y)
        equal = n == self.length
        at = np.where(equal, 0, n)
        return ~equal & (self.data[x + at] < self.data[y + at]), equal

    def merge_sort(self, start: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Order of ``start`` inside each element's group (which begins at ``begin`` and has ``size`` elements).

        Bottom up: in every round the runs of all groups double. An element's new place is its place in its run plus
        the number of elements of the neighbour run that come before it, found by binary search.
        """
        order = np.arange(len(start))
        local = order - begin
        width = 1
        while len(start) and width < size.max():
            run = local // width
            right = run % 2 == 1
            other = np.where(right, run - 1, run + 1) * width
            n = np.clip(size - other, 0, width)
            lo, hi = np.zeros(len(start), "i8"), n.copy()
            for _ in range(width.bit_length()):
                todo = np.flatnonzero(lo < hi)
                if not len(todo):
                    break
                mid = (lo[todo] + hi[todo]) // 2
                mate = order[begin[todo] + other[todo] + mid]
                before, equal = self.less(start[mate], start[order[todo]])
                go = before | (equal & right[todo])  # stable: equal elements of the left run stay ahead
                lo[todo] = np.where(go, mid + 1, lo[todo])
                hi[todo] = np.where(go, hi[todo], mid)
            place = begin + np.where(right, other, run * width) + local % width + lo
            moved = np.empty_like(order)
            moved[place] = order
            order = moved
            width *= 2
        return order


def equal_windows(h: np.ndarray, before: np.ndarray, segs: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each distinct segment the windows that another segment of the same anchor hash has at the same place."""
    counts = np.array([len(s) - length + 1 for s in segs])
    marks = [np.zeros(c, bool) for c in counts]
    if not segs:
        return marks
    data = np.frombuffer(b"".join(segs), "u1")
    base = np.concatenate(([0], np.cumsum([len(s) for s in segs])[:-1]))
    suffixes = Suffixes(data, length)
    owner = np.repeat(np.arange(len(segs)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = before[owner] - inside
    order = np.lexsort((place, h[owner]))
    owner, inside, place = owner[order], inside[order], place[order]
    group = np.cumsum(np.concatenate(([0], (np.diff(h[owner].view("i8")) != 0) | (np.diff(place) != 0))))
    sizes = np.bincount(group)
    many = sizes[group] > 1
    owner, inside, group = owner[many], inside[many], group[many]
    if not len(owner):
        return marks
    flat = np.zeros(counts.sum(), bool)
    offset = np.cumsum(counts) - counts
    split = lambda: [flat[o : o + c] for o, c in zip(offset, counts)]
    # windows without an equal hash in their group have no equal; where all bytes of a class agree it needs no sort
    start = base[owner] + inside
    key = (suffixes.windows(start) ^ group.astype("u8") * np.uint64(0xD6E8FEB86659FD93)) * BASE
    order = np.argsort(key)
    new = np.flatnonzero(np.concatenate(([True], key[order[1:]] != key[order[:-1]])))
    size = np.diff(new, append=len(order))
    of = np.repeat(np.arange(len(new)), size)
    at = np.flatnonzero(of[1:] == of[:-1])
    x, y = order[at], order[at + 1]
    differ = (group[x] != group[y]) | ~suffixes.equal_bytes(start[x], start[y])
    sort = np.zeros(len(new), bool)
    sort[of[at[differ]]] = True
    sure = order[(size > 1)[of] & ~sort[of]]
    flat[offset[owner[sure]] + inside[sure]] = True
    rest = np.sort(order[sort[of]])
    owner, inside, group = owner[rest], inside[rest], group[rest]
    if not len(owner):
        return split()
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    stops = [0, *(np.searchsorted(cuts, k) for k in range(WINDOWS, len(group), WINDOWS)), len(cuts)]
    for a, b in zip(stops[:-1], stops[1:]):  # whole groups, about WINDOWS elements together
        if a == b:
            continue
        lo, hi = cuts[a], cuts[b] if b < len(cuts) else len(group)
        start = base[owner[lo:hi]] + inside[lo:hi]
        heads = cuts[a:b] - lo
        size = np.diff(heads, append=hi - lo)
        begin, size = np.repeat(heads, size), np.repeat(size, size)
        done = suffixes.merge_sort(start, begin, size)
        x, y = start[done[:-1]], start[done[1:]]
        near = np.flatnonzero((begin[:-1] == begin[1:]) & suffixes.same(x, y, length))
        near = near[suffixes.equal_bytes(x[near], y[near])]  # the bytes decide: equal hashes alone mark nothing
        hit = np.concatenate((done[near], done[near + 1])) + lo
        flat[offset[owner[hit]] + inside[hit]] = True
    return split()


def only_listed(found: DataFrame, hashes: DataFrame) -> DataFrame:
    """Segments whose anchor hash may be listed, without moving any bytes; a few others pass and do no harm."""
    shared = found.sparkSession.sparkContext.broadcast(hash_filter(hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(batch.column(0).to_numpy().view("u8"), shared.value)))

    return found.select("h", "d1", "d2", "seg", "before", "k").mapInArrow(run, "h long, d1 long, d2 long, seg binary, before int, k long")


def equal_marks(found: DataFrame, length: int, max_group: int) -> tuple[DataFrame, DataFrame]:
    """Anchor hashes (h) whose only segment content is repeated, and for the rest (h, d1, d2, mask): packed bits of the
    equal windows of each distinct segment, null for all of them."""
    ends = [f(d).alias(f"{n}{d}") for d in ("d1", "d2") for f, n in ((F.min, "lo_"), (F.max, "hi_"))]
    per_hash = staged(found.groupBy("h").agg(*ends, F.sum("k").alias("n"), F.count("*").alias("rows")), "anchors")
    one = "lo_d1 = hi_d1 and lo_d2 = hi_d2"
    alone = per_hash.where(f"{one} and n > 1").select("h")
    mixed = per_hash.where(f"not ({one})")
    total, most = mixed.agg(F.sum("rows"), F.max("rows")).first()
    buckets = max(16, math.ceil((total or 0) / SORT_ROWS))
    distinct = lambda df: df.groupBy("h", "d1", "d2").agg(F.sum("k").alias("n"), F.first("seg").alias("seg"), F.first("before").alias("before"))

    def sort(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy()
        marks = equal_windows(h.view("u8"), table.column("before").to_numpy().astype("i8"), table.column("seg").to_pylist(), length)
        again = table.column("n").to_numpy() > 1
        masks = [None if r or m.all() else np.packbits(m, bitorder="little").tobytes() for m, r in zip(marks, again)]
        keep = pa.array([bool(r or m.any()) for m, r in zip(marks, again)], pa.bool_())
        out = {c: table.column(c).combine_chunks().filter(keep) for c in ("h", "d1", "d2")}
        return pa.table(out | {"mask": pa.array(masks, pa.binary()).filter(keep)})

    schema = "h long, d1 long, d2 long, mask binary"
    usual = only_listed(found, mixed.where(F.col("rows") <= max_group).select("h"))
    if (most or 0) > max_group:
        usual = usual.join(mixed.where(F.col("rows") > max_group).select("h"), "h", "left_anti")
    marks = distinct(usual).withColumn("bucket", F.pmod("h", F.lit(buckets))).groupBy("bucket").applyInArrow(sort, schema)
    if (most or 0) <= max_group:
        return alone, marks

    # anchors with more segments than a task should sort: their windows meet by their bytes, in partial sums
    wide = distinct(found.join(mixed.where(F.col("rows") > max_group).select("h"), "h"))
    windows = wide.select("h", "d1", "d2", "n", "before", F.explode(F.sequence(F.lit(0), F.length("seg") - length)).alias("w"), "seg")
    windows = windows.select("h", "d1", "d2", "n", "w", (F.col("before") - F.col("w")).alias("a"), F.substring("seg", F.col("w") + 1, F.lit(length)).alias("win"))
    twice = windows.groupBy("h", "a", "win").agg(F.sum("n").alias("n")).where("n > 1").select("h", "a", "win")
    listed = windows.join(twice, ["h", "a", "win"]).groupBy("h", "d1", "d2").agg(F.collect_set("w").alias("w"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for w in batch.column(3).to_pylist():
                m = np.zeros(max(w) + 1, bool)
                m[w] = True
                masks.append(np.packbits(m, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(masks, pa.binary())], ["h", "d1", "d2", "mask"])

    return alone, marks.unionByName(listed.select("h", "d1", "d2", "w").mapInArrow(pack, schema))


def covered(n: int, starts: list[bytes], windows: list[int], masks: list[bytes | None], length: int) -> np.ndarray:
    """Which of n bytes lie under an equal window."""
    whole = [i for i, m in enumerate(masks) if m is None]
    first = [np.frombuffer(b"".join([starts[i] for i in whole]), "<i8")]
    behind = [first[0] + np.repeat(np.array([windows[i] for i in whole], "i8") - 1 + length, [len(starts[i]) // 8 for i in whole])]
    for s, m in zip(starts, masks):
        if m is not None:
            at = (np.frombuffer(s, "<i8")[:, None] + np.flatnonzero(np.unpackbits(np.frombuffer(m, "u1"), bitorder="little"))).ravel()
            first.append(at)
            behind.append(at + length)
    edge = np.bincount(np.concatenate(first), minlength=n + 1) - np.bincount(np.concatenate(behind), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, max_group: int = MAX_GROUP) -> DataFrame:
    """Per row: id, ``n_bytes``, ``spans`` (starts and ends of the removed runs) and ``kept`` (the remaining bytes).

    Null and empty texts have no bytes and lose none; texts under ``length`` bytes lose nothing. Rows are documents of
    their own, so a repeated row makes its text a repeat, also under an equal or null id. An empty table gives no rows.
    """
    rows = texts(docs, id_col, text_col).withColumn("_tie", F.xxhash64("_text"))
    repeated = anchor_counts(rows, length).where("k > 1").select("h")
    found = staged(segment_rows(rows, repeated, length).withColumn("windows", (F.length("seg") - (length - 1)).cast("long")), "segments")
    alone, marks = equal_marks(found, length, max_group)
    slim = found.select("h", "d1", "d2", "starts", "windows", "_id", "_tie")
    hits = slim.join(alone, "h").withColumn("mask", F.lit(None).cast("binary")).unionByName(slim.join(marks, ["h", "d1", "d2"]))
    # rows with equal id and text have equal segments; each finds the same marks, so one list of them serves all
    lists = hits.groupBy("_id", "_tie").agg(F.collect_set(F.struct("starts", "windows", "mask")).alias("found")).withColumnsRenamed({"_id": "_fid", "_tie": "_ftie"})
    full = rows.join(lists, (F.col("_tie") == F.col("_ftie")) & F.col("_id").eqNullSafe(F.col("_fid")), "left").select("_id", "_text", "found")
    kind = full.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                chunk = batch.slice(at, 64)
                sizes, spans, kept = [], [], []
                lists = chunk.column(2)
                ends = lists.offsets.to_pylist()
                entries = lists.values.slice(ends[0], ends[-1] - ends[0])
                marks = [entries.field(c).to_pylist() for c in ("starts", "windows", "mask")]
                for text, a, b, listed in zip(chunk.column(1).to_pylist(), ends, ends[1:], lists.is_valid().to_pylist()):
                    data = as_bytes(text)
                    own = slice(a - ends[0], b - ends[0]) if listed else slice(0)
                    gone = covered(len(data), *(m[own] for m in marks), length)
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype("i1")))
                    sizes.append(len(data))
                    spans.append([{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())])
                    kept.append(data[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], [id_col, "n_bytes", "spans", "kept"])

    return full.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
