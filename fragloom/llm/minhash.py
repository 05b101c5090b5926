"""MinHash near-dedup: minima of universal hashes in bands, signature verification, whole sets, star components.

1. A text's shingle set is told by a 128-bit digest; texts with the same set are one class, and each class has one
   signature: the minimum of its set under each of ``bands * ROWS`` multiply-shift hash functions.
2. A band is a hash of ROWS minima. Classes that share a band meet in its bucket. There are so many bands that a pair at
   the threshold meets in none with a chance below MISS.
3. A bucket is not expanded into pairs: its members first meet one leader, the class that meets most others over all
   buckets. What links is one component. Of what is left only members of different components meet again, and only those
   with so few shingles of their own that they can link at all: first with a second leader, the class with most common
   shingles and fewest others, which links with most variants of its text, then with each other. In buckets of CROWD
   members and more (variants of one text) that asks for enough common shingles; variants that share rare ones as well are
   found by those, in rare-first prefixes.
4. A pair that meets must agree in the lowest four bits of enough minima, then its whole sets are compared.
5. Components come from alternating large-star and small-star rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from fragloom.llm.common import hash_filter, in_filter, released, staged, texts, word_hashes

ROWS = 5  # minima per band
MISS = 1e-8  # chance that a pair at the threshold shares no band, and that its signatures agree too little
CROWD = 64  # members from which a bucket is large, and classes from which a shingle is common
NIBBLES = 16  # minima whose lowest four bits make one word of a sketch
SEED = 20_11
TILE = 1 << 15  # shingles hashed together, so that they stay in the processor's cache
SEEN = 1 << 17  # classes that a task remembers to have signed
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def band_count(percent: int) -> int:
    """Bands of ROWS minima after which a pair of similarity ``percent`` meets but for a chance of MISS."""
    return 1 if percent == 100 else math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))


def most_different(percent: int, minima: int) -> int:
    """Differing four-bit parts of the signatures that a pair of similarity ``percent`` exceeds with a chance of at most MISS."""
    p, tail = (1 - percent / 100) * (1 - 1 / 16), 0.0
    ways = lambda k: math.lgamma(minima + 1) - math.lgamma(k + 1) - math.lgamma(minima - k + 1)
    for k in range(minima, 0, -1):
        tail += math.exp(ways(k) + k * math.log(p) + (minima - k) * math.log1p(-p)) if p else 0.0
        if tail > MISS:
            return k
    return 0


def functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of ``count`` multiply-shift functions, the same in every task and run."""
    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 64, count, "u8") | np.uint64(1), r.integers(0, 1 << 64, count, "u8")


def shingles(text: str | None, size: int, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words are one shingle, none give none."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split(), memo)
    if not len(w):
        return w
    size = min(size, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, "u8")
    for i in range(size):
        h *= np.uint64(0xD1342543DE82EF95)
        h += w[i : i + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xAF251AF3B0F025B5)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def minima(sets: list[np.ndarray], factors: np.ndarray, summands: np.ndarray) -> np.ndarray:
    """One row of 32-bit minima per set; sets are hashed in tiles of TILE shingles."""
    out = np.full((len(sets), len(factors)), np.iinfo("u8").max, "u8")
    whole = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])
    for a in range(0, len(whole), TILE):
        tile = whole[a : a + TILE]
        low = int(np.searchsorted(starts, a, "right")) - 1
        high = int(np.searchsorted(starts, a + len(tile), "left"))
        cuts = np.maximum(starts[low:high] - a, 0)
        buffer = np.empty(len(tile), "u8")
        for k, (f, s) in enumerate(zip(factors, summands)):
            np.multiply(tile, f, out=buffer)
            buffer += s
            np.minimum(out[low:high, k], np.minimum.reduceat(buffer, cuts), out=out[low:high, k])
    return (out >> np.uint64(32)).astype("<u4")


def signed(rows: DataFrame, size: int, count: int) -> DataFrame:
    """(_id, _tie, n, cls, sig) per row. ``cls`` is null without words; ``sig`` is null where the task has signed the class."""
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        seen: set[bytes] = set()
        factors, summands = functions(count)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                chunk = batch.slice(at, 256)
                sizes, names, new, sets = [], [], [], []
                for i, text in enumerate(chunk.column(1).to_pylist()):
                    s = shingles(text, size, memo)
                    name = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                    sizes.append(len(s))
                    names.append(name)
                    if name is not None and name not in seen:
                        if len(seen) < SEEN:
                            seen.add(name)
                        new.append(i)
                        sets.append(s)
                sigs: list[bytes | None] = [None] * chunk.num_rows
                if sets:
                    for i, m in zip(new, minima(sets, factors, summands)):
                        sigs[i] = m.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(0), chunk.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(sigs, pa.binary())],
                    ["_id", "_tie", "n", "cls", "sig"],
                )

    return rows.select("_id", "_text", "_tie").mapInArrow(released(run), f"_id {kind}, _tie long, n long, cls binary, sig binary")


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """(row, band): the hash of each band of a signature matrix."""
    parts = sig.reshape(len(sig), -1, ROWS).astype("u8")
    h = np.zeros(parts.shape[:2], "u8") + np.arange(1, parts.shape[1] + 1, dtype="u8")
    for k in range(ROWS):
        h = (h ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def sketches(sig: np.ndarray) -> np.ndarray:
    """(row, word): the lowest four bits of each minimum, sixteen to a 64-bit word."""
    low = np.zeros((len(sig), -(-sig.shape[1] // NIBBLES) * NIBBLES), "u8")
    low[:, : sig.shape[1]] = sig & 15
    return np.bitwise_or.reduce(low.reshape(len(sig), -1, NIBBLES) << (np.arange(NIBBLES, dtype="u8") * np.uint64(4)), axis=2)


def signatures(column: pa.Array, count: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, count)


def band_counts(classes: DataFrame, count: int) -> DataFrame:
    """(h): the band hashes that two or more classes have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(band_hashes(signatures(batch.column(0), count)).ravel().view("i8"))], ["h"])

    return classes.select("sig").mapInArrow(released(run), "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")


def members(classes: DataFrame, count: int, busy: DataFrame) -> DataFrame:
    """(h, cid, n, s0, s1, ..): the classes of the bands ``busy``, with the words of their sketches; a bitmap of those bands goes to the tasks."""
    listed = classes.sparkSession.sparkContext.broadcast(hash_filter(busy))
    words = word_names(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = signatures(batch.column(2), count)
            h = band_hashes(sig)
            row, band = np.nonzero(in_filter(h.ravel(), listed.value).reshape(h.shape))
            cid, n = (batch.column(k).to_numpy()[row] for k in (0, 1))
            parts = sketches(sig).view("i8")[row]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[row, band].view("i8"), cid, n, *parts.T)], ["h", "cid", "n", *words])

    found = classes.select("cid", "n", "sig").mapInArrow(released(run), ", ".join(f"{c} long" for c in ("h", "cid", "n", *words)))
    return found.join(busy, "h", "left_semi")


def word_names(count: int) -> list[str]:
    return [f"s{i}" for i in range(-(-count // NIBBLES))]


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) with 100 * common >= percent * union on their whole sets."""
    a, b = (sets.select(F.col("cid").alias(v), F.col("s").alias(f"s{v}")) for v in "xy")
    both = pairs.select("x", "y").join(a, "x").join(b, "y")
    common = F.size(F.array_intersect("sx", "sy"))
    union = F.size("sx") + F.size("sy") - common
    return both.where(common * 100 >= union * percent).select("x", "y")


def whole_sets(rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(cid, s): the whole set of each class of ``nodes`` as an array, made from the text of its first row.

    A bitmap of the first rows' text hashes is all that goes to the tasks; other rows are not shingled.
    """
    wanted = rows.sparkSession.sparkContext.broadcast(hash_filter(nodes.select(F.col("tie").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        seen: set[bytes] = set()  # only classes of listed texts get here
        for batch in batches:
            hit = np.flatnonzero(in_filter(batch.column(1).to_numpy().view("u8"), wanted.value))
            for at in range(0, len(hit), 256):
                names, out = [], []
                for text in batch.column(0).take(pa.array(hit[at : at + 256])).to_pylist():
                    s = shingles(text, size, memo)
                    name = xxhash.xxh3_128_digest(s.tobytes())
                    if name not in seen:
                        seen.add(name)
                        names.append(name)
                        out.append(s.view("i8"))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(out, pa.list_(pa.int64()))], ["cls", "s"])

    found = rows.select("_text", "_tie").mapInArrow(released(run), "cls binary, s array<long>")
    return found.join(nodes.select("cls", "cid"), "cls").groupBy("cid").agg(F.first("s").alias("s"))


def components(links: DataFrame) -> DataFrame:
    """(cid, root): every class that a link (x, y) names, with the smallest class it reaches.

    A large star hangs a node's larger neighbours on its smallest one, a small star its smaller ones and itself, until
    the stars no longer change, about log n rounds. Each round is written and read again; counts reach the driver.
    """
    edge = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = staged(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            return edges.select(F.col("u").alias("cid"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("cid"), F.col("v").alias("root")).distinct())
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct()
        large = staged(large.select(F.col("a").alias("u"), F.col("b").alias("v")), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(edge("u", "m"), edge("v", "m"))).alias("e")).select("e.*")
        edges = staged(small.where("u <> v").distinct(), "small")


def best(pairs: DataFrame) -> DataFrame:
    """For each class its pair with most agreement, as (x, y) with x < y."""
    sides = pairs.select("x", "y", "apart").unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "apart"))
    top = sides.groupBy("x").agg(F.min(F.struct("apart", "y")).alias("b"))
    return top.select(F.least("x", "b.y").alias("x"), F.greatest("x", "b.y").alias("y")).distinct()


def met(left: DataFrame, right: DataFrame, percent: int, count: int) -> DataFrame:
    """Distinct (x, y, apart), x < y, of members (h, cid, n, k, root, s0, ..) of one bucket in different components.

    ``k`` bounds what a class has in common with any other. Sizes and signatures are compared inside the join, so pairs
    that can't be similar are not written: ``apart`` is the number of minima whose lowest four bits differ.
    """
    words = word_names(count)
    a, b = (t.select(*(F.col(c).alias(f"{v}_{c}") for c in ("h", "cid", "n", "k", "root", *words))) for t, v in ((left, "x"), (right, "y")))
    # k common shingles are a similarity of k / (x_n + y_n - k)
    fits = F.least("x_k", "y_k") * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent
    apart = F.lit(0)
    for c in words:
        z = F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        apart = apart + F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    similar = apart <= most_different(percent, count)
    pairs = a.join(b, (F.col("x_h") == F.col("y_h")) & (F.col("x_root") != F.col("y_root")) & fits & similar)
    return pairs.select(F.least("x_cid", "y_cid").alias("x"), F.greatest("x_cid", "y_cid").alias("y"), apart.alias("apart")).distinct()


def shared_counts(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """(cid, k, common): no fewer than a class's shingles with a count of two and of CROWD or more.

    ``counts`` (h, c) go to the tasks as two bitmaps, so both numbers may be too large and never too small.
    """
    spark = sets.sparkSession
    listed = [spark.sparkContext.broadcast(hash_filter(counts.where(F.col("c") >= least))) for least in (2, CROWD)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                chunk = batch.slice(at, 256)
                h = chunk.column(1).flatten().to_numpy().view("u8")
                ends = np.concatenate(([0], np.cumsum(chunk.column(1).value_lengths().to_numpy())))
                totals = [np.concatenate(([0], np.cumsum(in_filter(h, x.value))))[ends] for x in listed]
                yield pa.RecordBatch.from_arrays([chunk.column(0), *(pa.array(np.diff(t)) for t in totals)], ["cid", "k", "common"])

    return sets.select("cid", "s").mapInArrow(released(run), "cid long, k long, common long")


def rare_members(sets: DataFrame, counts: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Rows like members, with shingles for bands: each class's shingles with a count under CROWD in its rare-first prefix.

    Of n shingles, the rarest n - ceil(t n) + 1 hold the rarest one that it shares with a class of similarity t. Those that
    no other class has come first and are only counted.
    """
    rare = sets.select("cid", F.explode("s").alias("h")).join(counts.where(F.col("c") < CROWD), "h")
    order = Window.partitionBy("cid").orderBy("c", "h")  # one class: no more rows than its text has words
    placed = rare.withColumn("place", F.row_number().over(order)).join(facts, "cid")
    whole = F.ceil(F.col("n") * percent / 100)
    return placed.where(F.col("n") - F.col("k") + F.col("place") <= F.col("n") - whole + 1).drop("c", "place")


def main_roots(member: DataFrame) -> DataFrame:
    """(h, size, main) of the buckets with several components: number of members and the component that has most of them."""
    parts = member.groupBy("h", "root").agg(F.count("*").alias("c"))
    main = parts.groupBy("h").agg(F.count("*").alias("roots"), F.sum("c").alias("size"), F.max(F.struct("c", "root")).alias("m")).where("roots > 1")
    return main.select("h", "size", F.col("m.root").alias("main"))


def class_roots(rows: DataFrame, classes: DataFrame, size: int, percent: int, count: int) -> DataFrame:
    """(cid, root) of the classes that are linked with another one."""
    busy = staged(band_counts(classes, count), "busy")
    t = staged(members(classes, count, busy), "members")
    nodes = classes.join(t.select("cid").distinct(), "cid", "left_semi").select("cls", "cid", "tie")
    sets = staged(whole_sets(rows, staged(nodes, "nodes"), size), "sets")

    # a bucket's leader: the class that meets most others
    crowd = t.groupBy("h").agg(F.count("*").alias("c"))
    fame = t.join(crowd, "h").groupBy("cid").agg(F.sum("c").alias("f"))
    first = t.select("h", "cid", "n").join(fame, "cid").groupBy("h").agg(F.max(F.struct("f", "n", "cid")).alias("l")).select("h", "l.cid")
    alone = lambda df: df.withColumns({"root": F.col("cid"), "k": F.col("n")})
    stars = staged(met(alone(t), alone(t.join(first, ["h", "cid"], "left_semi")), percent, count), "stars")
    tried = staged(best(stars), "tried")
    links = staged(confirmed(tried, sets, percent), "links")

    # whatever components share a bucket: their other members
    roots = staged(components(links), "roots")
    member = staged(t.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "rooted")
    main = staged(main_roots(member), "main")
    crowded = member.join(main, "h")
    own = staged(sets.join(crowded.select("cid").distinct(), "cid", "left_semi"), "crowded")
    counts = staged(own.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    # a class whose own shingles, which no other has, are too many links with none
    left = crowded.join(shared_counts(own, counts), "cid").where(F.col("k") * 100 >= F.col("n") * percent)
    left = staged(left, "left")

    # of many variants of one text the least changed one links with most: each bucket's next leader
    plain = F.struct((F.col("common") * 2 - F.col("n")).alias("plain"), "n", "cid")  # common shingles less its own
    second = left.groupBy("h").agg(F.max(plain).alias("l")).select("h", "l.cid")
    near = staged(met(left, left.join(second, ["h", "cid"], "left_semi"), percent, count).join(tried, ["x", "y"], "left_anti"), "near")
    tried = tried.unionByName(near.select("x", "y"))
    links = links.unionByName(staged(confirmed(near, sets, percent), "found"))
    roots = staged(components(links), "roots")
    left = staged(left.drop("root", "main").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "again")
    left = staged(left.join(main_roots(left).drop("size"), "h"), "open")
    # in a large bucket a pair either shares a rare shingle, by which it is found below, or has common ones alone
    bound = F.when(F.col("size") < CROWD, F.col("k")).otherwise(F.col("common"))
    bounded = left.withColumn("k", bound).where(F.col("k") * 100 >= F.col("n") * percent)
    rest = met(bounded.where("root <> main"), bounded, percent, count)
    facts = left.where(F.col("size") >= CROWD).drop("h", "size", "main", "common").dropDuplicates(["cid"])
    rare = staged(rare_members(own.join(facts.select("cid"), "cid", "left_semi"), counts, facts, percent), "rare")
    rest = rest.unionByName(met(rare, rare, percent, count)).distinct()
    rest = staged(rest.join(tried, ["x", "y"], "left_anti"), "rest")
    return components(links.unionByName(staged(confirmed(rest, sets, percent), "last")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 85) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept`` (id = component_id).

    Two rows link if 100 * common >= percent * union of their sets of ``size``-word shingles; whole sets decide, as
    64-bit hashes. Words are parted by ASCII white space, A-Z is lower-cased. Null, empty and blank texts have no
    shingles and are their own component, also with a null id; repeated ids keep their rows and share their fate, and a
    component takes its smallest id that is not null. Very long texts are hashed in tiles. An empty table gives no
    rows; other columns are not read, whatever their names.
    """
    rows = texts(docs, id_col, text_col).withColumn("_tie", F.xxhash64("_text"))
    count = band_count(percent) * ROWS
    slim = staged(signed(rows, size, count), "signed")
    first = F.min(F.struct("_id", "_tie"))
    classes = slim.where("cls is not null").groupBy("cls").agg(F.first("sig", ignorenulls=True).alias("sig"), F.first("n").alias("n"), first.alias("one"), F.min("_id").alias("low"))
    # the number is only read from the written table, so it is the same for all that follows
    classes = staged(classes.select("cls", "sig", "n", F.col("one._tie").alias("tie"), "low", F.monotonically_increasing_id().alias("cid")), "classes")
    roots = class_roots(rows, classes, size, percent, count)
    owned = classes.select("cls", "cid", "low").join(roots, "cid", "left").select("cls", "low", F.coalesce("root", "cid").alias("root"))
    lowest = owned.groupBy("root").agg(F.min("low").alias("component_id"))
    named = owned.join(lowest, "root").select("cls", "component_id")
    full = slim.where("cls is not null").select("_id", "n", "cls").join(named, "cls").select("_id", "n", "component_id")
    empty = slim.where("cls is null").select("_id", "n", F.col("_id").alias("component_id"))
    out = full.unionByName(empty).withColumn("kept", F.col("_id").eqNullSafe(F.col("component_id")))
    return out.toDF(id_col, "n_shingles", "component_id", "kept")
