"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, each pair verified once.

1. Texts with the same shingle set are one class; classes are joined, not documents.
2. Shingles are dealt to blocks by their hash; a block counts the classes of each shingle. Only shingles of two or
   more classes come back: the others are the rarest part of every prefix and match nothing.
3. A class's prefix is its n - ceil(t n) + 1 rarest shingles. Two sets with similarity t or more share a prefix shingle.
4. In each prefix bucket all members are first checked against one leader, the class with the largest part of shared
   shingles. Pairs inside a component need no further look, so a group of near copies costs a pair per member and not
   its square. All other pairs of a bucket, between components, then go through the filters and are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fragloom.llm.common import hash_filter, in_filter, released, staged, texts, word_hashes
from fragloom.operators.graph import connected_components

BLOCK_BYTES = 8 << 20  # text bytes per block of shingles
CHUNK = 1 << 20  # shingles a map task packs at a time
BINS = 64  # of the suffix filter
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(parts: list[np.ndarray], start: int) -> np.ndarray:
    h = np.full(len(parts[0]), start, "u8")
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def shingle_set(text: str | None, size: int, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; fewer words make one shingle, none make none."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split(), memo)
    n = len(w) - size + 1
    if n > 0:
        return np.unique(mix([w[i : i + n] for i in range(size)], size))
    return mix([w[i : i + 1] for i in range(len(w))], len(w)) if len(w) else w


def class_of(s: np.ndarray, seed: int = 0) -> int:
    """Signed 64-bit digest of a set."""
    v = xxhash.xxh3_64_intdigest(s.tobytes(), seed)
    return v - (1 << 64) if v >> 63 else v


def classes(rows: DataFrame, size: int) -> DataFrame:
    """(_id, _tie, n, cls, check) per row; rows without words have a null class."""
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, size, memo)
                out.append((len(s), class_of(s), class_of(s, 1)) if len(s) else (0, None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([o[k] for o in out], pa.int64()) for k in range(3))], ["_id", "_tie", "n", "cls", "check"])

    return rows.select("_id", "_text", "_tie").mapInArrow(released(run), f"_id {kind}, _tie long, n long, cls long, check long")


def shared_shingles(rows: DataFrame, size: int, blocks: int) -> DataFrame:
    """(bucket, block, ids, counts, payload): per block and bucket of classes the shingles that two or more classes have.

    ``payload`` has the shingles with that number, class by class, ``counts`` how many each class of ``ids`` has. Blocks
    and buckets are as many, so the rows stay few however many classes a block meets. A shingle is told by its block and
    32 more bits of its hash. Blocks hold about as many shingles at every size, so few are mistaken for shared; that
    only raises upper bounds, and ``verified`` compares the 64-bit hashes.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        sets: dict[int, np.ndarray] = {}  # a class once per chunk
        held = 0

        def packed():
            h = np.concatenate(list(sets.values()))
            doc = np.repeat(np.arange(len(sets), dtype="u2"), [len(s) for s in sets.values()])
            ids = np.array(list(sets), "i8")
            block = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype("i4")
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1))
            low = h.astype("u4")  # the block stands for the high bits
            names, payloads = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                at = order[a:b]
                own, index = np.unique(doc[at], return_inverse=True)
                names.append(int(block[at[0]]))
                payloads.append([ids[own].tobytes(), index.astype("u2").tobytes(), low[at].tobytes()])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array([p[k] for p in payloads], pa.binary()) for k in range(3))], ["block", "ids", "index", "low"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, size, memo)
                if len(s):
                    c = class_of(s)
                    if c not in sets:
                        sets[c] = s
                        held += len(s)
                if held >= CHUNK or len(sets) == 65_535:
                    yield packed()
                    sets, held = {}, 0
        if sets:
            yield packed()

    def count(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        ids, docs, low, base = [], [], [], 0
        for i in range(table.num_rows):
            own = np.frombuffer(table.column("ids")[i].as_buffer(), "i8")
            ids.append(own)
            docs.append(np.frombuffer(table.column("index")[i].as_buffer(), "u2").astype("i4") + base)
            low.append(np.frombuffer(table.column("low")[i].as_buffer(), "u4"))
            base += len(own)
        ids, docs, h = np.concatenate(ids), np.concatenate(docs), np.concatenate(low)
        _, first = np.unique(ids, return_index=True)  # a class that several chunks sent counts once
        once = np.zeros(len(ids), bool)
        once[first] = True
        keep = once[docs]
        h, docs = h[keep], docs[keep]
        order = np.argsort(h, kind="stable")
        h, docs = h[order], docs[order]
        runs = np.diff(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))) if len(h) else np.zeros(0, "i8")
        freq = np.repeat(runs, runs)
        many = freq > 1
        h, docs, freq = h[many], docs[many], freq[many]
        bucket = ids[docs] % blocks
        order = np.lexsort((docs, bucket))
        h, docs, freq, bucket = h[order], docs[order], freq[order], bucket[order]
        entry = np.zeros(len(h), [("f", "<u4"), ("h", "<u4")])
        entry["f"], entry["h"] = freq, h
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(h) else np.zeros(1, "i8")
        names, payloads = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            starts = np.flatnonzero(np.diff(docs[a:b], prepend=-1, append=-1))
            names.append(int(bucket[a]))
            payloads.append([ids[docs[a:b][starts[:-1]]].tobytes(), np.diff(starts).astype("<i4").tobytes(), entry[a:b].tobytes()])
        return pa.table({"bucket": pa.array(names, pa.int64()), "block": pa.array([block] * len(names), pa.int32())} | {name: pa.array([p[k] for p in payloads], pa.binary()) for k, name in enumerate(("ids", "counts", "payload"))})

    dealt = rows.select("_id", "_text").mapInArrow(released(deal), "block int, ids binary, index binary, low binary")
    return dealt.groupBy("block").applyInArrow(count, "bucket long, block int, ids binary, counts binary, payload binary")


def prefixes(shared: DataFrame, known: DataFrame, percent: int, blocks: int) -> DataFrame:
    """(h, cls, n, pos, k, bins): the shared shingles in each class's prefix; ``known`` has (cls, n).

    ``pos`` is the place in rare-first order, ``k`` the number of all shared shingles (the rest is in no other set, so
    no overlap exceeds it), ``bins`` their counts by hash, for the suffix filter, on the class's first row only.
    """

    def run(sent: pa.Table, sizes: pa.Table) -> pa.Table:
        cls, f, h = [np.zeros(0, "i8")], [np.zeros(0, "i8")], [np.zeros(0, "u8")]
        for i in range(sent.num_rows):
            ids, counts = (np.frombuffer(sent.column(c)[i].as_buffer(), t) for c, t in (("ids", "i8"), ("counts", "<i4")))
            e = np.frombuffer(sent.column("payload")[i].as_buffer(), [("f", "<u4"), ("h", "<u4")])
            cls.append(np.repeat(ids, counts))
            f.append(e["f"].astype("i8"))
            h.append(np.uint64(sent.column("block")[i].as_py()) << np.uint64(32) | e["h"])
        cls, f, h = np.concatenate(cls), np.concatenate(f), np.concatenate(h)
        order = np.lexsort((h, f, cls))
        cls, h = cls[order], h[order]
        first = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1]))) if len(cls) else np.zeros(0, "i8")
        k = np.diff(np.append(first, len(cls)))
        listed, size = (sizes.column(c).to_numpy() for c in ("cls", "n"))
        by_id = np.argsort(listed)
        n = size[by_id][np.searchsorted(listed[by_id], cls[first])]
        at = np.repeat(np.arange(len(first)), k)
        place = np.arange(len(cls)) - first[at]
        bins = np.bincount(at * BINS + (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)).astype("i8"), minlength=len(first) * BINS).astype("<u4").reshape(-1, BINS)
        keep = np.flatnonzero(place <= (k + (-percent * n) // 100)[at])
        at, place = at[keep], place[keep]
        packed = [bins[a].tobytes() if p == 0 else None for a, p in zip(at.tolist(), place.tolist())]
        longs = (h[keep].view("i8"), cls[keep], n[at], (n - k)[at] + place, k[at])
        return pa.table({name: pa.array(v, pa.int64()) for name, v in zip(("h", "cls", "n", "pos", "k"), longs)} | {"bins": pa.array(packed, pa.binary())})

    sizes = known.select(F.pmod("cls", F.lit(blocks).cast("long")).alias("bucket"), "cls", "n")
    return shared.groupBy("bucket").cogroup(sizes.groupBy("bucket")).applyInArrow(run, "h long, cls long, n long, pos long, k long, bins binary")


def may_match(percent: int):
    """Length, overlap and positional filter on columns nx, ny (sizes), kx, ky (shared shingles), px, py (places).

    All sets have the same order, so behind the first shingle that two sets share lie all others; a similar pair passes
    in that shingle's bucket, whatever the buckets of its later ones say.
    """
    smaller, larger = F.least("nx", "ny"), F.greatest("nx", "ny")
    both = F.lit(percent) * (F.col("nx") + F.col("ny"))
    behind = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    return (smaller * 100 >= larger * percent) & (F.least("kx", "ky") * (100 + percent) >= both) & (behind * (100 + percent) >= both)


def filtered(pairs: DataFrame, bins: DataFrame, percent: int) -> DataFrame:
    """Distinct (x, y, bound) of pairs (x, y, nx, ny) that pass the suffix filter; ``bins`` has (cls, bins).

    It bounds the common shingles by the smaller count of each hash bin; ``bound`` is that number. The counts join the
    distinct pairs only, so the prefix rows stay narrow.
    """

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, both = (batch.column(k).to_numpy() for k in range(3))
            counts = [np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(-1, BINS) for k in (3, 4)]
            most = np.minimum(*counts).sum(axis=1, dtype="i8")
            ok = most * (100 + percent) >= percent * both
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]) for a in (x, y, most)], ["x", "y", "bound"])

    once = pairs.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), (F.col("nx") + F.col("ny")).alias("both")).distinct()
    a, b = (bins.select(F.col("cls").alias(v), F.col("bins").alias(f"b{v}")) for v in "xy")
    return once.join(a, "x").join(b, "y").select("x", "y", "both", "bx", "by").mapInArrow(released(bound), "x long, y long, bound long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose whole sets are similar enough. Each set travels once per pair, in binary form.

    The classes that any pair names are written first: while they are few, Spark sees their size and leaves the other
    sets where they are; when they are many, one shuffle of the sets by class serves all three joins.
    """
    named = staged(pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct(), "named")
    sets = sets.join(named, "cls", "left_semi")
    a = sets.select(F.col("cls").alias("x"), F.col("s").alias("sx"))
    b = sets.select(F.col("cls").alias("y"), F.col("s").alias("sy"))
    both = pairs.select("x", "y").join(a, "x").join(b, "y").select("x", "y", "sx", "sy")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for i in range(batch.num_rows):
                s, t = (np.frombuffer(batch.column(k)[i].as_buffer(), "u8") for k in (2, 3))
                merged = np.sort(np.concatenate((s, t)), kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                ok.append(100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["x", "y"])

    return both.mapInArrow(released(check), "x long, y long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, root) for the classes in ``nodes``."""
    edges = links.select(F.lit(0).alias("media_id"), F.col("x").alias("from_id"), F.col("y").alias("to_id"))
    found = connected_components(nodes.select(F.lit(0).alias("media_id"), F.col("cls").alias("id")), edges)
    return found.select(F.col("id").alias("cls"), F.col("component").alias("root"))


def class_links(rows: DataFrame, known: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (x, y) that join every component of similar classes, and (cls, root) of all classes with a prefix bucket.

    ``known`` has every class once, as (cls, n).
    """
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(16, math.ceil(total / BLOCK_BYTES))
    t = staged(prefixes(shared_shingles(rows, size, blocks), known, percent, blocks), "prefixes")
    side = lambda v: [F.col("cls").alias(v), F.col("n").alias(f"n{v}"), F.col("k").alias(f"k{v}"), F.col("pos").alias(f"p{v}")]
    leader = F.max(F.struct((F.col("k") / F.col("n")).alias("part"), "n", "cls", "k", "pos"))
    bins = t.where("bins is not null").select("cls", "bins")
    busy = t.groupBy("h").agg(F.count("*").alias("members"), leader.alias("l")).where("members > 1")
    leaders = busy.select("h", "l.*").select("h", *side("y"))
    stars = t.select("h", *side("x")).join(leaders, "h").where(may_match(percent))
    stars = staged(filtered(stars, bins, percent), "stars")
    nodes = staged(t.join(busy.select("h"), "h").select("cls").distinct(), "nodes")
    sets = staged(class_sets(rows, nodes, size), "sets")
    # each class is tried with its most promising leader only; the other leaders are left to the last step
    sides = stars.select("x", "y", "bound").unionByName(stars.select(F.col("y").alias("x"), F.col("x").alias("y"), "bound"))
    tried = staged(best(sides), "tried")
    links = staged(verified(tried, sets, percent), "star_links")
    roots = staged(components(nodes, links), "star_roots")

    # pairs between components: members outside a bucket's largest component against all of it
    member = staged(t.drop("bins").join(roots, "cls"), "member")
    parts = member.groupBy("h", "root").agg(F.count("*").alias("c"))
    main = parts.groupBy("h").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("c", "root")).alias("main")).where("roots > 1")
    other = member.join(main, "h").where("root <> main").select("h", *side("x"), F.col("root").alias("rx"))
    whole = member.select("h", *side("y"), F.col("root").alias("ry"))
    # the set sizes of a bucket that a class can match at all; only members of those sizes meet it
    sizes = member.groupBy("h", F.col("n").alias("ny")).agg(F.max("k").alias("most"))
    fits = (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent) & (F.least("kx", "most") * (100 + percent) >= F.lit(percent) * (F.col("nx") + F.col("ny")))
    sized = other.join(sizes, "h").where(fits).drop("most")
    rest = filtered(sized.join(whole, ["h", "ny"]).where((F.col("rx") != F.col("ry")) & may_match(percent)), bins, percent)
    rest = staged(rest.join(tried.select("x", "y"), ["x", "y"], "left_anti"), "rest")
    for last in (False, True):
        sides = rest.select("x", "y", "bound").unionByName(rest.select(F.col("y").alias("x"), F.col("x").alias("y"), "bound"))
        chosen = rest.select("x", "y") if last else staged(best(sides), "chosen")
        new = staged(verified(chosen, sets, percent), "links")
        links = links.unionByName(new)
        roots = staged(components(nodes, links), "roots")
        if not last:
            a, b = (roots.select(F.col("cls").alias(v), F.col("root").alias(f"r{v}")) for v in "xy")
            rest = staged(rest.join(a, "x").join(b, "y").where("rx <> ry").select("x", "y", "bound"), "open").join(chosen, ["x", "y"], "left_anti")
    return links, roots


def best(sides: DataFrame) -> DataFrame:
    """For each class the pair with the largest bound, as (x, y) with x < y."""
    top = sides.groupBy("x").agg(F.max(F.struct("bound", "y")).alias("b"))
    return top.select(F.least("x", "b.y").alias("x"), F.greatest("x", "b.y").alias("y")).distinct()


def class_sets(rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(cls, s) with the whole shingle set of every class in ``nodes``, once each."""
    shared = rows.sparkSession.sparkContext.broadcast(hash_filter(nodes.select(F.col("cls").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        seen: set[int] = set()  # classes this task has sent
        for batch in batches:
            ids, out = [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, size, memo)
                c = class_of(s)
                if c not in seen and len(s) and in_filter(np.array([c], "i8").view("u8"), shared.value)[0]:
                    seen.add(c)
                    ids.append(c)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["cls", "s"])

    found = rows.select("_id", "_text").mapInArrow(released(run), "cls long, s binary")
    return found.join(nodes, "cls").groupBy("cls").agg(F.first("s").alias("s"))


def grouped(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Slim rows (_id, _tie, n, cls, check), and (cls, root) of every class."""
    rows = texts(docs, id_col, text_col).withColumn("_tie", F.xxhash64("_text"))
    slim = staged(classes(rows, size), "classes")
    known = slim.where("cls is not null").groupBy("cls").agg(F.min("check").alias("a"), F.max("check").alias("b"), F.min("n").alias("n"))
    if known.where("a <> b").limit(1).count():
        raise RuntimeError("two shingle sets share a digest")
    _, roots = class_links(rows.where("_text is not null"), known, size, percent)
    return slim, known.select("cls").join(roots, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``class_id`` (same for equal sets).

    Two rows link if 100 * common >= percent * union of their shingle sets. Words are parted by ASCII white space, A-Z
    is lower-cased. Rows without words have no class and are their own component, also with a null id; repeated ids keep
    their rows, and a component takes the smallest id that is not null. An empty table gives no rows. Sets are
    compared by 64-bit shingle hashes; two sets with the same 64-bit class digest raise an error.
    """
    slim, rooted = grouped(docs, id_col, text_col, size, percent)
    owner = slim.where("cls is not null").groupBy("cls").agg(F.min("_id").alias("low")).join(rooted, "cls")
    lowest = owner.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("cls", "component_id")
    full = slim.where("cls is not null").join(named, "cls").select("_id", "n", "component_id", "cls")
    empty = slim.where("cls is null").select("_id", "n", F.col("_id").alias("component_id"), "cls")
    return full.unionByName(empty).toDF(id_col, "n_shingles", "component_id", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each component the row with the smallest id stays.

    Rows without words stay; a null id counts as the largest; equal ids are told apart by their text's hash, and of
    rows equal in both one stays.
    """
    slim, rooted = grouped(docs, id_col, text_col, size, percent)
    low = F.struct(F.col("_id").isNull().alias("none"), "_id", "_tie")
    first = slim.where("cls is not null").groupBy("cls").agg(F.min(low).alias("l")).join(rooted, "cls").groupBy("root").agg(F.min("l").alias("l"))
    stay = first.select(F.col("l._id").alias("_sid"), F.col("l._tie").alias("_stie"), F.lit(True).alias("_one"))
    stay = stay.unionByName(slim.where("cls is null").select(F.col("_id").alias("_sid"), F.col("_tie").alias("_stie"), F.lit(False).alias("_one")).distinct())
    names = docs.columns
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_tie"))
    kept = keyed.join(stay, (F.col("_tie") == F.col("_stie")) & F.col("_id").eqNullSafe(F.col("_sid"))).drop("_sid", "_stie")
    one = kept.where("_one").dropDuplicates(["_id", "_tie"]).unionByName(kept.where("not _one"))
    return one.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))
