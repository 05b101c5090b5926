"""Hard negatives by Four-Russians scoring: subset-sum tables of anchors, bit planes of candidates, shifted sums.

1. Components become integers. Each task packs its rows into blocks: for every bit of the two's complement one plane,
   and of each plane one byte per eight dimensions. Blocks are written once.
2. Anchors, in blocks of their own, get a table per eight dimensions with the 256 sums of any subset of the anchor's
   components there. A candidate's byte picks a sum; adding over the dimension groups gives a plane's product, and
   doubling from the sign plane down gives the whole inner product, exactly.
3. Each anchor block meets each candidate bucket once (an equi-join on the bucket). Tasks keep the best few per anchor
   while they go, and Spark merges what they kept.
4. The first pass looks at rows of the anchor's label only and gives the positives, the second finds the negatives in
   the range of scores that each positive allows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fragloom.llm.common import staged

GROUP = 8  # dimensions per table
CANDIDATES = 4096  # rows of a candidate block
BUCKET = 1 << 18  # candidate rows that an anchor block meets in one go, when there are enough for all tasks
ANCHORS = 512  # rows of an anchor block
TILE = 128  # candidates scored at a time
NOTHING = np.iinfo("i8").max


def plane_bytes(v: np.ndarray) -> tuple[np.ndarray, int]:
    """Bytes (row, plane, dimension group) of an integer matrix, and the number of planes; the last one is the sign's."""
    planes = max(int(v.max(initial=0)), -int(v.min(initial=0)) - 1, 0).bit_length() + 1
    width = -(-v.shape[1] // GROUP) * GROUP
    bits = np.zeros((len(v), planes, width), "u1")
    for b in range(planes):
        bits[:, b, : v.shape[1]] = (v >> b) & 1
    return np.packbits(bits, axis=2, bitorder="little"), planes


def subset_sums(v: np.ndarray, kind: str) -> np.ndarray:
    """Tables (dimension group, subset, anchor): the sum of the components that the subset's bits name."""
    groups = -(-v.shape[1] // GROUP)
    padded = np.zeros((len(v), groups * GROUP), kind)
    padded[:, : v.shape[1]] = v
    out = np.zeros((groups, 1 << GROUP, len(v)), kind)
    for g in range(groups):
        for k in range(GROUP):  # each dimension doubles the subsets that are summed
            out[g, 1 << k : 2 << k] = out[g, : 1 << k] + padded[:, g * GROUP + k]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products (candidate, anchor); groups that either side lacks count as zero."""
    total = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    groups = min(len(tables), planes.shape[2])
    picked = np.empty_like(total)
    for b in range(planes.shape[1] - 1, -1, -1):
        total += total
        for g in range(groups):
            np.take(tables[g], planes[:, b, g], axis=0, out=picked, mode="clip")
            if b == planes.shape[1] - 1:
                total -= picked
            else:
                total += picked
    return total


def table_kind(anchor: np.ndarray, planes: int) -> str:
    """The narrowest integer that holds every score; an error where no long does."""
    most = int(np.abs(anchor).sum(axis=1, dtype="f8").max(initial=0)) + 1 << planes
    if most >= 1 << 56:
        raise ValueError("scores of these components do not fit a long")
    return "i4" if most < 1 << 31 else "i8"


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, "i8")
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < k]


def packed(rows: DataFrame, scale: float) -> DataFrame:
    """Blocks (place, size, dims, planes, bits, ids, labels, numbers, ints) of the rows (id, label, vector).

    A row's number is the task's number and its place there; equal ids stay apart by it. Rows of a block are ordered by
    label, so that the first pass takes slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, block = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATES):
                chunk = batch.slice(at, CANDIDATES)
                sizes = np.diff(chunk.column(2).offsets.to_numpy())
                number = (np.int64(part) << 40) + done + np.arange(chunk.num_rows)
                done += chunk.num_rows
                label, ids = (chunk.column(k).to_numpy() for k in (1, 0))
                flat = np.floor(chunk.column(2).flatten().to_numpy() * scale)
                if np.abs(flat).max(initial=0) >= 1 << 52:
                    raise ValueError("scores of these components do not fit a long")
                starts = np.cumsum(sizes) - sizes
                for dims in np.unique(sizes):  # nearly always one
                    own = np.flatnonzero(sizes == dims)
                    own = own[np.argsort(label[own], kind="stable")]
                    v = flat[starts[own][:, None] + np.arange(dims)].astype("<i8").reshape(len(own), dims)
                    bits, planes = plane_bytes(v)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part * 7919 + block], pa.int64()), *(pa.array([x], pa.int32()) for x in (len(own), int(dims), planes)),
                            *(pa.array([x.tobytes()], pa.binary()) for x in (bits, ids[own].astype("<i8"), label[own].astype("<i8"), number[own].astype("<i8"))),
                        ],
                        ["place", "size", "dims", "planes", "bits", "ids", "labels", "numbers"],
                    )
                    block += 1

    return rows.mapInArrow(run, "place long, size int, dims int, planes int, bits binary, ids binary, labels binary, numbers binary")


def longs(record, column: str) -> np.ndarray:
    return np.frombuffer(record[column].as_buffer(), "<i8")


def unpacked(record) -> np.ndarray:
    """The integer matrix of a block."""
    size, dims, planes = (record[c].as_py() for c in ("size", "dims", "planes"))
    bits = np.frombuffer(record["bits"].as_buffer(), "u1").reshape(size, planes, -1)
    bits = np.unpackbits(bits, axis=2, bitorder="little")[:, :, :dims].astype("i8")
    weight = 1 << np.arange(planes, dtype="i8")
    weight[-1] = -weight[-1]
    return np.einsum("rpd,p->rd", bits, weight)


def anchor_rows(blocks: DataFrame, every: int) -> DataFrame:
    """(number, id, label, vector) of the rows whose id is divisible by ``every``, from the written blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.to_pylist():
                ids = np.frombuffer(record["ids"], "<i8")
                hit = np.flatnonzero(ids % every == 0)
                if not len(hit):
                    continue
                v = unpacked({c: pa.scalar(x) for c, x in record.items()})[hit]
                out = [np.frombuffer(record["numbers"], "<i8")[hit], ids[hit], np.frombuffer(record["labels"], "<i8")[hit]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array([row.tobytes() for row in v], pa.binary())], ["number", "id", "label", "vector"])

    return blocks.mapInArrow(run, "number long, id long, label long, vector binary")


def anchor_blocks(anchors: DataFrame, slots: int) -> DataFrame:
    """(anchors): rows (number, id, label, vector, highs) packed ANCHORS at a time, ordered by label.

    Each bucket gets a copy of every block, so its components take no more bytes than the largest of them needs. ``highs`` has the scores of the anchor's positives in ``slots`` places, NOTHING where there is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHORS):
                chunk = batch.slice(at, ANCHORS)
                number, label = (chunk.column(k).to_numpy() for k in (0, 2))
                highs = np.full((chunk.num_rows, slots), NOTHING, "<i8")
                if slots:
                    for i, h in enumerate(chunk.column(4).to_pylist()):
                        highs[i, : len(h)] = h
                raw = chunk.column(3).to_pylist()
                sizes = np.array([len(r) // 8 for r in raw])
                for dims in np.unique(sizes):
                    own = np.flatnonzero(sizes == dims)
                    own = own[np.argsort(label[own], kind="stable")]
                    v = np.frombuffer(b"".join([raw[i] for i in own]), "<i8")
                    width = next(w for w in (1, 2, 4, 8) if -1 << 8 * w - 1 <= v.min(initial=0) and v.max(initial=0) < 1 << 8 * w - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([len(own)], pa.int32()), pa.array([int(dims)], pa.int32()), pa.array([v.astype(f"<i{width}").tobytes()], pa.binary()), *(pa.array([x[own].astype("<i8").tobytes()], pa.binary()) for x in (number, label, highs))],
                        ["a_size", "a_dims", "vectors", "a_numbers", "a_labels", "highs"],
                    )

    parts = max(1, math.ceil(anchors.count() / ANCHORS))
    return anchors.repartition(parts, "number").mapInArrow(run, "a_size int, a_dims int, vectors binary, a_numbers binary, a_labels binary, highs binary")


class Kept:
    """The first k entries of each group so far; ``floor`` is the score that a group's next entry needs."""

    def __init__(self, groups: int, k: int):
        self.k, self.parts, self.waiting = k, [np.zeros(0, "i8")] * 3, []
        self.size, self.floor = 0, np.full(groups, -NOTHING)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((group, score, ids))
        self.size += len(group)
        if self.size > 1 << 18:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        if self.waiting:
            group, score, ids = (np.concatenate([p, *w]) for p, w in zip(self.parts, zip(*self.waiting)))
            at = first_of(group, score, ids, self.k)
            self.parts = [group[at], score[at], ids[at]]
            full, first = np.unique(self.parts[0], return_counts=True)
            last = np.cumsum(first) - 1
            done = first == self.k
            self.floor[full[done]] = self.parts[1][last[done]]
            self.waiting, self.size = [], 0
        return self.parts


def same_label(kept: Kept, anchor: dict, tables: np.ndarray, c: dict) -> None:
    """First pass: rows of an anchor's label but itself, slice by slice of the two label orders."""
    for label in np.intersect1d(anchor["labels"], c["labels"]):
        a0, a1 = np.searchsorted(anchor["labels"], (label, label + 1))
        c0, c1 = np.searchsorted(c["labels"], (label, label + 1))
        own = np.ascontiguousarray(tables[:, :, a0:a1])
        for at in range(c0, c1, TILE):
            to = min(at + TILE, c1)
            s = scores(own, c["bits"][at:to])
            row, col = np.nonzero((s >= kept.floor[a0:a1]) & (c["numbers"][at:to, None] != anchor["numbers"][a0:a1]))
            kept.add(col + a0, s[row, col].astype("i8"), c["ids"][at + row])


def other_labels(kept: Kept, anchor: dict, tables: np.ndarray, c: dict, low: int, high: int) -> None:
    """Second pass: rows of other labels whose score lies in the range of a positive; a group is an anchor and a slot."""
    highs = anchor["highs"]
    slots = highs.shape[1]
    real = highs != NOTHING
    most = np.where(real, highs, -NOTHING).max(axis=1)
    for at in range(0, len(c["ids"]), TILE):
        s = scores(tables, c["bits"][at : at + TILE])
        floor = np.where(real, np.maximum(kept.floor.reshape(-1, slots), -(-low * np.where(real, highs, 0) // high)), NOTHING).min(axis=1)
        row, col = np.nonzero((s >= floor) & (s <= most) & (c["labels"][at : at + TILE, None] != anchor["labels"]))
        score, ids = s[row, col].astype("i8"), c["ids"][at + row]
        for slot in range(slots):
            top = highs[col, slot]
            hit = np.flatnonzero((top != NOTHING) & (score <= top) & (high * score >= low * np.where(top == NOTHING, 0, top)))
            kept.add(col[hit] * slots + slot, score[hit], ids[hit])


def best_per_anchor(blocks: DataFrame, anchors: DataFrame, buckets: int, k: int, slots: int, low: int, high: int) -> DataFrame:
    """(number, slot, score, id): what each task kept for each anchor; ``slots`` = 0 is the first pass."""
    dealt = blocks.withColumn("bucket", F.pmod("place", F.lit(buckets))).repartition(buckets, "bucket")
    every = anchors.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long")))).repartition(buckets, "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = kept = anchor = tables = None

        def result():
            group, score, ids = kept.settle()
            return pa.RecordBatch.from_arrays([pa.array(anchor["numbers"][group // max(1, slots)]), pa.array((group % max(1, slots)).astype("i4")), pa.array(score), pa.array(ids)], ["number", "slot", "score", "id"])

        for batch in batches:
            for i in range(batch.num_rows):
                record = {name: batch.column(name)[i] for name in batch.schema.names}
                names = record["a_numbers"].as_buffer().to_pybytes()
                planes = record["planes"].as_py()
                if held is None or names != held[0] or planes > held[1]:
                    if held is not None:
                        yield result()
                    size, dims = record["a_size"].as_py(), record["a_dims"].as_py()
                    raw = record["vectors"].as_buffer()
                    v = np.frombuffer(raw, f"<i{max(1, raw.size // max(1, size * dims))}").astype("i8").reshape(size, dims)
                    anchor = {"numbers": longs(record, "a_numbers").copy(), "labels": longs(record, "a_labels").copy(), "highs": longs(record, "highs").reshape(size, -1).copy()}
                    tables = subset_sums(v, table_kind(v, planes))
                    kept = Kept(size * max(1, slots), k)
                    held = names, planes
                n = record["size"].as_py()
                c = {"ids": longs(record, "ids"), "labels": longs(record, "labels"), "numbers": longs(record, "numbers"), "bits": np.frombuffer(record["bits"].as_buffer(), "u1").reshape(n, planes, -(-record["dims"].as_py() // GROUP))}
                if slots:
                    other_labels(kept, anchor, tables, c, low, high)
                else:
                    same_label(kept, anchor, tables, c)
        if held is not None:
            yield result()

    # merged: Spark's estimate does not see the copies of the anchors, and would collect and broadcast all of them. An anchor block
    # also meets the blocks of its bucket one after the other, so its tables are built once there
    pairs = every.hint("merge").join(dealt, "bucket").drop("bucket", "place")
    return pairs.mapInArrow(run, "number long, slot int, score long, id long")


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k per key with their ``rank``; a key has at most k rows of each task that met it."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: str | Column = "label", every: int = 100,
    positives: int = 5, negatives: int = 5, scale: float = 256.0, low: int = 80, high: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors: rows with an id divisible by ``every``.

    Components become floor(scale * x), scores are exact integer inner products; higher ones come first, ties by smaller
    id. An anchor's positives are its first ``positives`` other rows of its label, and each gets the first ``negatives``
    rows of other labels with low * positive <= high * negative <= high * positive score, fewer if there are fewer.
    ``label`` is a column name or expression of an integer type. All rows are candidates of all anchors.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Repeated rows and repeated ids
    stay rows of their own, as anchors, positives and negatives. A shorter vector counts as ended by zeros; an empty one
    scores 0. No anchor or no row gives no rows. Components so large that a score leaves the range of a long raise an
    error. Other columns are not read, whatever their names.
    """
    own = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), own.cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("id is not null and label is not null and vector is not null").where(finite)
    blocks = staged(packed(rows, scale), "blocks")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(math.ceil(total / CANDIDATES), max(2 * spread, math.ceil(total / BUCKET))))
    anchors = staged(anchor_rows(blocks, every), "anchors")

    found = best_per_anchor(blocks, anchor_blocks(anchors, 0), buckets, positives, 0, low, high)
    chosen = staged(ranked(found.drop("slot"), ["number"], positives), "positives")
    lists = chosen.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("l"))  # at most ``positives`` entries
    armed = staged(anchors.join(lists.select("number", F.col("l.score").alias("highs")), "number"), "armed")

    found = best_per_anchor(blocks, anchor_blocks(armed, positives), buckets, negatives, positives, low, high)
    last = ranked(found, ["number", "slot"], negatives)
    pairs = chosen.select("number", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = last.select("number", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["number", "slot"])
    return out.join(anchors.select("number", F.col("id").alias("anchor_id")), "number").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x::double)))
), s as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, p.positive_id, (row_number() over w)::int as rank, s.other_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id)
qualify row_number() over w <= 5
"""
