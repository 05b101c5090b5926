"""Cutting media into content-addressed fragments, checking and reassembling them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fragloom.functions import blob
from fragloom.operators.scale import hash_bucket, merge_ranges, running_rank, running_total, with_previous

ID_PATTERN = r"^FRG-([0-9a-f]{16})-(0|[1-9][0-9]*)-(0|[1-9][0-9]*)$"
SEGMENT = 1 << 20


def carve_blocks(media: DataFrame, block_size: int = 256, keep: tuple[str, ...] = ()) -> DataFrame:
    """Contiguous [start, end) blocks of every media row; the last one may be short.

    Chunked media rows carry their ``base_offset``, which must be a multiple of ``block_size``.
    """
    if block_size <= 0:
        raise ValueError("block_size must be positive")
    size = F.length("content")
    base = F.col("base_offset") if "base_offset" in media.columns else F.lit(0).cast("long")
    at = F.sequence(F.lit(0), size - 1, F.lit(block_size))
    # the pieces are cut before the explode, so that no row behind it (nor a queue to Python) carries the whole content
    pieces = F.transform(
        at,
        lambda s: F.struct(
            (base + s).alias("start"),
            (base + F.least(s + block_size, size)).alias("end"),
            F.substring("content", s + 1, F.lit(block_size)).alias("block"),
        ),
    )
    # outer explode: Spark would copy an emptiness filter below and build derived content a second time
    return (
        media.select("media_id", *keep, F.explode_outer(F.when(size > 0, pieces)).alias("_piece"))
        .where("_piece is not null")
        .select("media_id", *keep, "_piece.*")
    )


def carve_multi(media: DataFrame, sizes: tuple[int, ...] = (256, 512), stride: int | None = None) -> DataFrame:
    """One pass per block size; step is the stride, or the block size without one."""
    specs = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(stride or s).alias("step")) for s in sizes])
    offset_text = F.when(F.length(F.col("_s").cast("string")) < 6, F.lpad(F.col("_s").cast("string"), 6, "0")).otherwise(
        F.col("_s").cast("string")
    )
    return (
        media.where(F.length("content") > 0)
        .select("media_id", "content", F.inline(specs))
        .select("media_id", "content", "size", F.explode(F.sequence(F.lit(0), F.length("content") - 1, F.col("step"))).alias("_s"))
        .select(
            "media_id",
            F.concat_ws("", F.col("media_id"), F.lit("_sz"), F.col("size").cast("string"), F.lit("_off"), offset_text).alias(
                "sample_id"
            ),
            F.col("size").cast("long").alias("block_size"),
            F.col("_s").cast("long").alias("start"),
            F.least(F.col("_s") + F.col("size"), F.length("content")).cast("long").alias("end"),
            F.substring("content", F.col("_s") + 1, F.col("size")).alias("block"),
        )
    )


def is_erased(block: Column) -> Column:
    """True when every byte is zero."""
    return ~blob.latin(block).rlike("[^\\x00]")


def identify(blocks: DataFrame) -> DataFrame:
    """Digest, size, fragment id and short-tail warning; erased blocks are no fragments."""
    return (
        blocks.where(~is_erased(F.col("block")))
        .withColumn("size_bytes", F.length("block").cast("long"))
        .withColumn("sha256", F.sha2("block", 256))
        .withColumn("fragment_id", blob.fragment_id(F.col("sha256"), F.col("start"), F.col("end")))
    )


def partial_tail(blocks: DataFrame, block_size: int = 256) -> DataFrame:
    size = F.length("block")
    return blocks.where(size < block_size).select(
        "media_id",
        "start",
        "end",
        F.format_string(
            f"partial trailing block at byte_range [%d, %d): %d of {block_size} bytes", F.col("start"), F.col("end"), size
        ).alias("warning"),
    )


def erased_regions(blocks: DataFrame) -> DataFrame:
    """All-zero blocks, touching ones merged into one region."""
    zero = blocks.where(is_erased(F.col("block"))).select("media_id", "start", "end")
    return merge_ranges(zero, ["media_id"], "start", "end")


def parse_fragment_id(df: DataFrame, column: str = "fragment_id") -> DataFrame:
    c = F.col(column)
    number = lambda i: F.expr(f"try_cast(nullif(regexp_extract({column}, r'{ID_PATTERN}', {i}), '') as bigint)")
    valid = F.coalesce(c.rlike(ID_PATTERN) & (number(3) > number(2)), F.lit(False))
    return df.select(
        "*",
        valid.alias("is_valid"),
        F.when(valid, F.regexp_extract(c, ID_PATTERN, 1)).alias("digest_prefix"),
        F.when(valid, number(2)).alias("range_start"),
        F.when(valid, number(3)).alias("range_end"),
    )


def content_dedup(fragments: DataFrame, order: list[str], id_col: str = "fragment_id") -> DataFrame:
    """Every fragment with the id retained for its content (first in ``order``).

    The winner per digest comes from a partial aggregate, and the join back may be split by AQE, so a
    digest shared by a third of all rows does not land in one task.
    """
    first = fragments.groupBy("sha256").agg(F.min(F.struct(*order, F.col(id_col).alias("_id"))).alias("_first"))
    slim = fragments.select("sha256", id_col, *[c for c in order if c != id_col])
    joined = slim.join(first, "sha256")
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_first.{c}"))
    return joined.withColumn("retained_id", F.col("_first._id")).withColumn("is_duplicate", ~same).drop("_first")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("seen")).where("seen > 1")


def overlap_check(ranges: DataFrame, keys: list[str], start: str, end: str, id_col: str, bucket: Column) -> DataFrame:
    """Ranges that begin before their predecessor in (start, end, id) order has ended."""
    slim = ranges.select(*keys, start, end, id_col)
    return (
        with_previous(slim, keys, [start, end, id_col], bucket, "_p")
        .where(F.col(f"_p.{end}") > F.col(start))
        .select(
            *keys,
            F.col(f"_p.{id_col}").alias("previous_id"),
            F.col(id_col).alias("current_id"),
            F.col(f"_p.{end}").alias("previous_end"),
            F.col(start).alias("current_start"),
        )
    )


def collection_anomalies(media: DataFrame, fragments: DataFrame, bucket: Column) -> DataFrame:
    """Empty collection, duplicate id, non-positive size and overlap as (media_id, anomaly, subject) rows."""
    empty = (
        media.join(fragments.select("media_id").distinct(), "media_id", "left_anti")
        .select("media_id", F.lit("empty").alias("anomaly"), F.lit(None).cast("string").alias("subject"))
    )
    dup = (
        fragments.groupBy("media_id", "fragment_id").agg(F.count("*").alias("n")).where("n > 1")
        .select("media_id", F.lit("duplicate_id").alias("anomaly"), F.col("fragment_id").alias("subject"))
    )
    size = fragments.where(F.col("end") <= F.col("start")).select(
        "media_id", F.lit("non_positive_size").alias("anomaly"), F.col("fragment_id").alias("subject")
    )
    over = overlap_check(fragments, ["media_id"], "start", "end", "fragment_id", bucket).select(
        "media_id", F.lit("overlap").alias("anomaly"), F.col("current_id").alias("subject")
    )
    return empty.unionByName(dup).unionByName(size).unionByName(over)


def keyed_shuffle(blocks: DataFrame, seed: int, index: str = "block_index") -> DataFrame:
    """Position of every block in the order of sha256("seed:index"); an identity result is rotated once."""
    keyed = blocks.withColumn("_key", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(index).cast("string")), 256))
    ranked = running_rank(keyed, ["media_id"], [F.col("_key")], hash_bucket(F.col("_key")), "_rank").drop("_key")
    state = ranked.groupBy("media_id").agg(
        F.count("*").alias("_n"), F.bool_and(F.col("_rank") == F.col(index) + 1).alias("_identity")
    )
    position = F.when(
        F.col("_identity") & (F.col("_n") > 1), F.pmod(F.col("_rank") - 2, F.col("_n"))
    ).otherwise(F.col("_rank") - 1)
    return ranked.join(state, "media_id").withColumn("position", position).drop("_rank", "_n", "_identity")


def output_ranges(chain: DataFrame, keys: list[str], position: str = "position", size: str = "size_bytes") -> DataFrame:
    """Half-open output range of every chain member: running sum of sizes in chain order."""
    total = running_total(
        chain, keys, [F.col(position)], F.floor(F.col(position) / 4096), F.col(size), "output_end"
    )
    return total.withColumn("output_start", F.col("output_end") - F.col(size))


def reassemble(ranges: DataFrame, keys: list[str], segment: int = SEGMENT) -> DataFrame:
    """Join blocks in output order into segment rows of about ``segment`` bytes.

    The result of a huge medium is a run of segments, never one row, so no task holds a whole medium.
    Bytes are only concatenated; nothing is padded or invented.
    """
    return (
        ranges.withColumn("segment_no", F.floor(F.col("output_start") / segment))
        .groupBy(*keys, "segment_no")
        .agg(
            F.min("output_start").alias("segment_start"),
            F.max("output_end").alias("segment_end"),
            F.expr("listagg(block, X'') within group (order by output_start)").alias("content"),
        )
    )


def provenance_check(chain: DataFrame, fragments: DataFrame, expected: DataFrame) -> DataFrame:
    """Findings on a chain's output ranges: duplicate or unknown members, gaps, wrong totals."""
    dup = (
        chain.groupBy("media_id", "fragment_id").agg(F.count("*").alias("n")).where("n > 1")
        .select("media_id", F.lit("duplicate_member").alias("finding"), F.col("fragment_id").alias("subject"))
    )
    unknown = chain.join(fragments.select("media_id", "fragment_id"), ["media_id", "fragment_id"], "left_anti").select(
        "media_id", F.lit("unknown_member").alias("finding"), F.col("fragment_id").alias("subject")
    )
    starts = chain.where("output_start > 0").select("media_id", "fragment_id", F.col("output_start").alias("edge"))
    ends = chain.select("media_id", F.col("output_end").alias("edge")).distinct()
    gaps = starts.join(ends, ["media_id", "edge"], "left_anti").select(
        "media_id", F.lit("gap").alias("finding"), F.col("fragment_id").alias("subject")
    )
    total = (
        chain.groupBy("media_id").agg(F.sum("size_bytes").alias("got")).join(expected, "media_id")
        .where("got <> size_bytes")
        .select("media_id", F.lit("total_mismatch").alias("finding"), F.col("got").cast("string").alias("subject"))
    )
    return dup.unionByName(unknown).unionByName(gaps).unionByName(total)


def profile_checked(fragments: DataFrame, blocks: DataFrame) -> DataFrame:
    """Recompute digest and size of every declared fragment from its bytes."""
    joined = fragments.join(blocks, ["media_id", "start"])
    return joined.select(
        "media_id",
        "fragment_id",
        (F.sha2("block", 256) != F.col("sha256")).alias("digest_mismatch"),
        (F.length("block") != F.col("size_bytes")).alias("size_mismatch"),
    )


def recut(blocks: DataFrame, size: int) -> DataFrame:
    """(media_id, cell, start, held, block): bytes of any cut, put together again at multiples of ``size``.

    A block holds the bytes up to the first hole in its cell, ``held`` counts all of them; no row exceeds ``size`` bytes.
    """
    last = F.col("start") + F.length("block") - 1
    pieces = blocks.where(F.length("block") > 0).select(
        "media_id", "start", "block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(last / size))).alias("cell")
    )
    lo = F.greatest("start", F.col("cell") * size)
    piece = F.substring("block", (lo - F.col("start") + 1).cast("int"), F.lit(size) - (lo % size).cast("int"))
    cells = pieces.select("media_id", "cell", F.struct(lo.alias("s"), piece.alias("b")).alias("p")).groupBy("media_id", "cell").agg(F.sort_array(F.collect_list("p")).alias("p"), F.sum(F.length("p.b")).alias("held"))
    first = F.get("p", F.lit(0)).s
    zero = F.struct(first.alias("e"), F.lit(b"").alias("b"))
    whole = F.aggregate("p", zero, lambda a, x: F.when(x.s == a.e, F.struct((a.e + F.length(x.b)).alias("e"), F.concat(a.b, x.b).alias("b"))).otherwise(a))
    return cells.select("media_id", "cell", first.alias("start"), "held", whole.b.alias("block"))


def first_diff(a: DataFrame, b: DataFrame, size: int = 1 << 16) -> DataFrame:
    """Byte comparison of two media tables: equality, prefix match, length delta, first bad offset.

    ``a`` and ``b`` are block tables (media_id, start, block), cut anywhere. Both are cut anew at equal offsets, so a
    huge medium is compared by many tasks; bytes that only one side has inside both lengths count as different. Only
    the first bad cell of each medium is opened.
    """
    left = recut(a, size).select("media_id", "cell", F.col("start").alias("sa"), F.col("held").alias("ha"), F.col("block").alias("a"))
    right = recut(b, size).select("media_id", "cell", F.col("start").alias("sb"), F.col("held").alias("hb"), F.col("block").alias("b"))
    joined = left.join(right, ["media_id", "cell"], "full_outer")
    overlap = F.least(F.length("a"), F.length("b"))
    aligned = F.col("sa") == F.col("sb")
    differs = aligned & (F.substring("a", F.lit(1), overlap) != F.substring("b", F.lit(1), overlap))
    # where the common bytes of a cell end, or its first byte if one side begins later or lacks it
    edge = F.when(aligned, F.when(F.length("a") != F.length("b"), F.col("sa") + overlap)).otherwise(F.least("sa", "sb"))
    facts = joined.groupBy("media_id").agg(
        F.coalesce(F.sum("ha"), F.lit(0)).alias("size_a"),
        F.coalesce(F.sum("hb"), F.lit(0)).alias("size_b"),
        F.min(F.when(differs, F.struct(F.col("sa").alias("start"), "a", "b"))).alias("_bad"),
        F.min(F.when(~F.coalesce(differs, F.lit(False)), edge)).alias("_edge"),
    )
    # halving: every look at a cell copies it, so few looks; one byte that differs is known to lie from ``lo`` to before ``hi``
    def halve(x: Column, _: Column) -> Column:
        half = F.floor((x.hi - x.lo) / 2).cast("int")
        same = F.substring(F.col("_bad.a"), x.lo + 1, half) == F.substring(F.col("_bad.b"), x.lo + 1, half)
        return F.struct(F.when(same, x.lo + half).otherwise(x.lo).alias("lo"), F.when(same, x.hi).otherwise(x.lo + half).alias("hi"))

    ends = F.struct(F.lit(0).alias("lo"), F.least(F.length("_bad.a"), F.length("_bad.b")).alias("hi"))
    offset = F.aggregate(F.sequence(F.lit(1), F.lit(size.bit_length())), ends, halve, lambda x: x.lo)
    inside = F.when(F.col("_bad").isNotNull(), F.col("_bad.start") + offset)
    shorter = F.least("size_a", "size_b")
    facts = facts.withColumn("_first", F.least(inside, F.when(F.col("_edge") < shorter, F.col("_edge"))))
    equal = F.col("_first").isNull() & (F.col("size_a") == F.col("size_b"))
    return facts.select(
        "media_id",
        equal.alias("byte_match"),
        (F.col("_first").isNull() & (F.col("size_a") < F.col("size_b"))).alias("is_prefix"),
        (F.col("size_a") - F.col("size_b")).alias("length_delta"),
        F.when(~equal, F.coalesce("_first", shorter)).cast("long").alias("first_diff"),
    )
