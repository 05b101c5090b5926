"""Marker hits, as-of carving, object harvest, labelled regions and artifact ranking."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fragloom.functions import formats as fm, tokens as tk
from fragloom.functions.blob import latin
from fragloom.operators.chunks import HITS, byte_ranges, chunk_hits, compiled, sizes_of, with_sizes
from fragloom.operators.scale import keep_first


def marker_hits(media: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """Absolute positions of byte markers in whole media, one row per hit; ``chunks.chunk_hits`` takes media in chunks."""
    names = tuple(markers)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = compiled(names)
        for batch in batches:
            out = [
                (media_id, *hit)
                for media_id, base, content in zip(*(batch.column(i).to_pylist() for i in range(3)))
                for hit in search.hits(content, base, base, base + len(content))
            ]
            columns = list(zip(*out)) if out else [[]] * 6
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["media_id", "marker", "pos", "end", "number", "generation"]
            )

    return media.where(F.col("content").isNotNull()).select("media_id", "base_offset", "content").mapInArrow(scan, HITS)


def asof_next(left: DataFrame, right: DataFrame, keys: list[str], lpos: str, rpos: str, out: str, width: int = 1 << 24) -> DataFrame:
    """First ``rpos`` at or after every ``lpos`` per key (null without one).

    Rows meet inside offset buckets; the answer for the rest of a bucket is the smallest position of the
    next non-empty bucket, taken from one row per bucket.
    """
    a = left.withColumn("_p", F.col(lpos)).withColumn("_hit", F.lit(None).cast("long")).withColumn("_row", F.struct(*left.columns))
    a = a.select(*keys, "_p", "_hit", "_row")
    b = right.select(*keys, F.col(rpos).alias("_p"), F.col(rpos).alias("_hit"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_p") / width))
    # from the last row to the first: a frame that ends at its row grows by one, one that begins there is read again for each row
    ahead = Window.partitionBy(*keys, "_b").orderBy(F.desc("_p"), F.col("_hit").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    heads = b.withColumn("_b", F.floor(F.col("_p") / width)).groupBy(*keys, "_b").agg(F.min("_hit").alias("_next"))
    later = both.select(*keys, "_b").distinct().join(heads, [*keys, "_b"], "left").withColumn(
        "_carry", F.min("_next").over(Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1))
    ).select(*keys, "_b", "_carry")
    return (
        both.withColumn("_n", F.min("_hit").over(ahead)).where("_row is not null")
        .join(later, [*keys, "_b"]).withColumn(out, F.coalesce("_n", "_carry")).select("_row.*", out)
    )


def first_after(rows: DataFrame, keys: list[str], at: str, values: dict[str, Column], width: int = 1 << 24) -> DataFrame:
    """Adds the smallest of each of ``values`` over the rows of the key at or after each row's ``at``, nulls aside.

    All values come from one sort of the rows inside offset buckets; later buckets add one row each.
    """
    d = rows.withColumn("_bucket", F.floor(F.col(at) / width))
    tops = d.groupBy(*keys, "_bucket").agg(*[F.min(v).alias(n) for n, v in values.items()])
    later = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*keys, "_bucket", *[F.min(n).over(later).alias(f"_later{n}") for n in values])
    ahead = Window.partitionBy(*keys, "_bucket").orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.select("*", *[F.min(v).over(ahead).alias(f"_here{n}") for n, v in values.items()]).join(carry, [*keys, "_bucket"])
    return d.select(*rows.columns, *[F.least(f"_here{n}", f"_later{n}").alias(n) for n in values])


def object_rows(media: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per object number: range, termination and confidence; the first occurrence wins."""
    of = lambda *names: hits.where(F.col("marker").isin(*names))
    starts = of("obj").select("media_id", F.col("pos").alias("start"), "number", "generation", (F.col("pos") + 1).alias("_after"))
    sizes = sizes_of(media).withColumnRenamed("size_bytes", "_size")
    d = asof_next(starts, of("obj").select("media_id", "pos"), ["media_id"], "_after", "pos", "_next_start")
    d = asof_next(d, of("endobj").select("media_id", "pos"), ["media_id"], "start", "pos", "_endobj")
    d = asof_next(d, of("xref", "trailer", "startxref", "eof").select("media_id", "pos"), ["media_id"], "start", "pos", "_section")
    d = d.join(sizes, "media_id").withColumn("_limit", F.coalesce("_next_start", "_size"))
    closed = F.coalesce(F.col("_endobj") < F.col("_limit"), F.lit(False))
    rows = d.select(
        "media_id", F.col("number").alias("object_number"), "generation", "start",
        F.when(closed, F.col("_endobj") + 6).otherwise(F.least("_limit", F.coalesce("_section", "_limit"))).alias("end"),
        (~closed).alias("unterminated"),
        F.when(closed, 1.0).otherwise(0.85).alias("confidence"),
    )
    return keep_first(rows, ["media_id", "object_number"], [F.col("start")])


def object_bodies(objects: DataFrame, media: DataFrame) -> DataFrame:
    """Type, stream flag and text literals of harvested objects; ``media`` may come in chunks, each byte moves once."""
    t = F.col("t")
    bodies = byte_ranges(media, objects, ["object_number"]).select("media_id", "object_number", latin(F.col("bytes")).alias("t"))
    return (
        objects.join(bodies, ["media_id", "object_number"])
        .withColumn("object_type", tk.object_type(t))
        .withColumn("has_stream", F.contains(t, F.lit("stream")))
        .withColumn("texts", text_literals(t))
        .drop("t")
    )


def _clean(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(s), "[^ -~]", " "))


def _hex_text(s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9A-Fa-f]", "")
    even = F.concat(digits, F.when(F.length(digits) % 2 == 1, "0").otherwise(""))
    return _clean(F.decode(F.unhex(even), "ISO-8859-1"))


def text_literals(t: Column) -> Column:
    """Distinct text strings in order: (..) Tj, <hex> Tj, [..] TJ, else bare literals."""
    ws = tk.SPACE
    shown_paren, paren, hexa = r"\(([^)\r\n]{1,250})\)", r"\(([^)\r\n]+)\)", "<([0-9A-Fa-f \t\r\n\f]{2,})>"
    long_enough = lambda arr: F.filter(arr, lambda s: F.length(s) >= 2)
    plain = F.transform(F.regexp_extract_all(t, F.lit(shown_paren + ws + "*Tj"), F.lit(1)), _clean)
    coded = F.filter(F.transform(F.regexp_extract_all(t, F.lit(hexa + ws + "*Tj"), F.lit(1)), _hex_text), lambda s: s != "")
    pieces = lambda a: F.filter(
        F.transform(
            F.regexp_extract_all(a, F.lit(paren + "|" + hexa), F.lit(0)),
            lambda p: F.when(F.startswith(p, F.lit("<")), _hex_text(p)).otherwise(_clean(F.substring(p, F.lit(2), F.length(p) - 2))),
        ),
        lambda s: s != "",
    )
    arrays = F.transform(F.regexp_extract_all(t, F.lit(r"\[([^\]]+)\]" + ws + "*TJ"), F.lit(1)), lambda a: F.trim(F.array_join(pieces(a), " ")))
    shown = F.array_distinct(F.concat(long_enough(plain), coded, long_enough(arrays)))
    bare = F.transform(F.regexp_extract_all(t, F.lit(r"\(([^)\r\n]{4,120})\)"), F.lit(1)), lambda s: F.trim(F.regexp_replace(s, r"[\x80-\xff]", "")))
    usable = F.filter(
        bare,
        lambda s: (F.length(s) >= 4) & ~s.rlike("obj|stream|xref") & (F.length(F.regexp_replace(s, "[^ -~]", "")) / F.length(s) >= 0.85),
    )
    return F.when(F.size(shown) > 0, shown).otherwise(F.array_distinct(usable))


REFERENCE_MARKERS = ("contents_ref", "kids_open", "list_close", "object_ref")


def missing_references(hits: DataFrame, objects: DataFrame) -> DataFrame:
    """Object numbers named by /Contents or inside /Kids [..] that were not harvested, from REFERENCE_MARKERS.

    A reference stands inside a list if the next closing bracket is the same for both.
    """
    of = lambda name: hits.where(F.col("marker") == name)
    closes = of("list_close").select("media_id", "pos")
    lists = asof_next(of("kids_open").select("media_id", "end"), closes, ["media_id"], "end", "pos", "close").select("media_id", "close", F.col("end").alias("opened"))
    refs = asof_next(of("object_ref").select("media_id", "pos", "number"), closes, ["media_id"], "pos", "pos", "close")
    inside = refs.join(lists.where("close is not null"), ["media_id", "close"]).where(F.col("pos") >= F.col("opened"))
    named = of("contents_ref").select("media_id", "number").unionByName(inside.select("media_id", "number")).where("number is not null")
    return named.select("media_id", F.col("number").alias("object_number")).distinct().join(objects, ["media_id", "object_number"], "left_anti")


def recovery_telemetry(bodies: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per medium: objects, streams, pages, text strings, authentic bytes and share, unplaced bytes."""
    texts = bodies.select("media_id", F.explode("texts").alias("s")).groupBy("media_id", "s").agg(F.count("*")).groupBy("media_id").agg(F.count("*").alias("texts"))
    d = bodies.groupBy("media_id").agg(
        F.count("*").alias("objects"),
        F.count(F.when(F.col("has_stream"), 1)).alias("streams"),
        F.count(F.when(F.col("object_type") == "Page", 1)).alias("pages"),
        F.count(F.when(F.col("object_type") == "Font", 1)).alias("fonts"),
        F.sum(F.col("end") - F.col("start")).alias("authentic_bytes"),
    )
    return d.join(texts, "media_id", "left").join(sizes, "media_id").select(
        "media_id", "objects", "streams", "pages", "fonts", F.coalesce("texts", F.lit(0)).alias("texts"), "authentic_bytes",
        F.round(F.col("authentic_bytes") / F.col("size_bytes") * 100, 2).alias("coverage_pct"),
        F.greatest(F.lit(0), F.col("size_bytes") - F.col("authentic_bytes")).alias("unplaced_bytes"),
    )


# ---- labelled regions ---------------------------------------------------------------------------------


REGION_MARKERS = ("obj", "endobj", "xref", "trailer", "startxref", "eof", "stream", "endstream", "pdf_start")
# Fixed vocabulary: what a region's bytes hold -> its spellings.
REGION_WORDS = {
    "image": ("/Subtype /Image", "/Subtype/Image", "/DCTDecode", "/JPXDecode"),
    "page": ("/Type /Page",),
    "tight_page": ("/Type/Page",),
    "contents": ("/Contents",),
    "font_file": ("/FontFile",),
    "metadata": ("/Type /Metadata", "/Type/Metadata"),
    "font": ("/Type /Font", "/Type/Font"),
    "bt": ("BT",),
    "et": ("ET",),
}
WORD_MARKERS = tuple(w for words in REGION_WORDS.values() for w in words)


def region_rows(media: DataFrame, hits: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Labelled intervals of PDF media: header, xref, trailer, startxref, object parts and streams.

    ``media`` may come in chunks: rules look at hits and sizes alone. ``words`` has the hits of WORD_MARKERS, which are
    searched here without it; it may be ``hits``.
    """
    if words is None:
        words = chunk_hits(with_sizes(media), WORD_MARKERS)
    kinds = F.col("marker")
    if words is not hits:
        hits = hits.where(kinds.isin(*REGION_MARKERS)).unionByName(words.where(kinds.isin(*WORD_MARKERS)))
    newline = F.instr(latin(F.col("content")), "\n")
    base = media.groupBy("media_id").agg(
        F.max(F.col("base_offset") + F.length("content")).cast("long").alias("_size"), F.min(F.when(newline > 0, F.col("base_offset") + newline)).alias("_line")
    )
    sizes = base.select("media_id", "_size")
    header = base.join(hits.where((kinds == "pdf_start") & (F.col("pos") == 0)).select("media_id"), "media_id").select(
        "media_id", F.lit(0).cast("long").alias("start"), F.coalesce("_line", F.least(F.lit(32), F.col("_size"))).cast("long").alias("end"),
        F.lit("PDF_HEADER").alias("label"), F.lit("header_0").alias("entity_id"),
    )
    # the next hit of a kind, and the end of the next word of a kind: a range that begins here holds the word if it ends behind that
    values = {f"_{n}": F.when(kinds == n, F.col("pos")) for n in ("trailer", "eof", "endobj", "endstream")}
    values |= {f"_{n}": F.when(kinds.isin(*spelt), F.col("end")) for n, spelt in REGION_WORDS.items()}
    h = first_after(hits, ["media_id"], "pos", values).where(kinds.isin("obj", "stream", "xref", "trailer", "startxref"))
    in_stream = F.struct("pos", "end", "_endstream", "_bt", "_et")  # no marker begins inside one of ``stream`` or ``obj`` but itself
    h = first_after(h, ["media_id"], "pos", {"_stream": F.when(kinds == "stream", in_stream)}).where(kinds != "stream").join(sizes, "media_id")
    h = h.withColumnRenamed("pos", "start")
    near = lambda c, n: F.coalesce(F.col(c) - F.col("start") < n, F.lit(False))
    section = lambda name, end, label: F.array(
        F.struct("start", end.alias("end"), F.lit(label).alias("label"), F.concat(F.lit(f"{name}_"), F.col("start").cast("string")).alias("entity_id"))
    )
    xref = section("xref", F.when(near("_trailer", 1024), F.col("_trailer")).otherwise(F.least("_size", F.col("start") + 256)), "XREF")
    trailer = section("trailer", F.when(near("_eof", 512), F.col("_eof") + 5).otherwise(F.least("_size", F.col("start") + 256)), "TRAILER")
    startxref = section("startxref", F.coalesce(F.col("_eof") + 5, F.least("_size", F.col("start") + 64)), "TRAILER")
    o = h.withColumn("_obj_end", F.coalesce(F.col("_endobj") + 6, F.least("_size", F.col("start") + 4096)))
    o = o.withColumn("_body", F.when(F.col("_stream.pos") < F.col("_obj_end"), F.col("_stream.end")))
    o = o.withColumn("_body_end", F.when(F.col("_body").isNotNull(), F.coalesce("_stream._endstream", "_obj_end")))
    again = F.row_number().over(Window.partitionBy("media_id", "start", "marker").orderBy("start"))
    o = o.withColumn("_again", again).where((kinds != "obj") | (F.col("_again") == 1))
    any_c = lambda name: F.coalesce(F.col(f"_{name}") <= F.col("_obj_end"), F.lit(False))
    in_s = lambda name: F.coalesce(F.col(f"_stream._{name}") <= F.col("_body_end"), F.lit(False))
    stream_label = (
        F.when(any_c("image"), "IMAGE_STREAM")
        .when((in_s("bt") & in_s("et")) | (any_c("page") & any_c("contents")), "TEXT_STREAM")
        .when(any_c("font_file"), "FONT_OBJECT").otherwise("PDF_STREAM")
    )
    label = (
        F.when(any_c("metadata"), "METADATA").when(any_c("page") | any_c("tight_page"), "PAGE_OBJECT")
        .when(any_c("font"), "FONT_OBJECT").otherwise("PDF_OBJECT")
    )
    entity = F.concat_ws("_", F.lit("obj"), F.col("number").cast("string"), F.col("generation").cast("string"))
    region = lambda cond, a, b, name, suffix: F.when(
        cond, F.struct(a.alias("start"), b.alias("end"), name.alias("label"), F.concat(entity, F.lit(suffix)).alias("entity_id"))
    )
    has = F.col("_body").isNotNull()
    start, end, b0, b1 = F.col("start"), F.col("_obj_end"), F.col("_body"), F.col("_body_end")
    parts = F.array_compact(
        F.array(
            region(~has, start, end, label, ""), region(has & (b0 > start), start, b0, label, "_dict"),
            region(has, b0, b1, stream_label, "_stream"), region(has & (end > b1), b1, end, label, "_footer"),
        )
    )
    rows = F.when(kinds == "xref", xref).when(kinds == "trailer", trailer).when(kinds == "startxref", startxref).otherwise(parts)
    return header.unionByName(o.select("media_id", F.explode(rows).alias("r")).select("media_id", "r.*"))


def dominant_label(ranges: DataFrame, regions: DataFrame, id_col: str, width: int = 1 << 10) -> DataFrame:
    """Label of each [start, end): any header overlap wins, else the largest overlap if it is big enough.

    Interval overlap as an equi-join on ``width``-byte buckets, all pairs of a bucket meet, so they are small; long regions are listed once per bucket
    and overlaps are counted only in the bucket of the range's start or the region's start.
    """
    buckets = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width)))
    a = ranges.select("media_id", id_col, "start", "end", buckets("start", "end").alias("_b"))
    b = regions.select("media_id", F.col("start").alias("_rs"), F.col("end").alias("_re"), "label", "entity_id", buckets("start", "end").alias("_b"))
    overlap = F.least("end", "_re") - F.greatest("start", "_rs")
    pairs = a.join(b, ["media_id", "_b"]).where((overlap > 0) & (F.col("_b") == F.floor(F.greatest("start", "_rs") / width)))
    is_header = F.when(F.col("label") == "PDF_HEADER", 1).otherwise(0)
    best = pairs.groupBy("media_id", id_col).agg(
        F.max(F.struct(is_header.alias("h"), overlap.alias("o"), (-F.col("_rs")).alias("s"), (-F.col("_re")).alias("e"), "label", "entity_id")).alias("_m")
    )
    d = ranges.select("media_id", id_col, "start", "end").join(best, ["media_id", id_col], "left")
    enough = (F.col("_m.h") == 1) | (F.col("_m.o") >= (F.col("end") - F.col("start")) * 0.25) | (F.col("_m.o") >= 32)
    ok = F.coalesce(enough, F.lit(False))
    return d.select(
        "media_id", id_col, F.when(ok, F.col("_m.label")).otherwise("UNKNOWN").alias("label"), ok.alias("is_exact"),
        F.when(ok, F.col("_m.entity_id")).otherwise("no_overlap").alias("entity_id"),
    )


# ---- carving and ranking ------------------------------------------------------------------------------

# Format -> (head marker, end marker, bytes after the end marker's start).
SIGNATURES = {
    "pdf": ("pdf_head", "eof", 5),
    "png": ("png_head", "png_end", 8),
    "jpeg": ("jpeg_head", "jpeg_end", 2),
    "zip": ("zip_head", "zip_end", 22),
}


def footer_asof(hits: DataFrame) -> DataFrame:
    """(format, start, end) of every header with its first footer at or after it.

    Runs of non-PDF formats do not nest: a header inside an already carved run of its format is skipped,
    which for next-footer runs means keeping the first header of each footer.
    """
    out = None
    for name, (head, foot, extra) in SIGNATURES.items():
        starts = hits.where(F.col("marker") == head).select("media_id", F.col("pos").alias("start"))
        ends = hits.where(F.col("marker") == foot).select("media_id", "pos")
        runs = asof_next(starts, ends, ["media_id"], "start", "pos", "_foot").where("_foot is not null")
        if name != "pdf":
            runs = runs.groupBy("media_id", "_foot").agg(F.min("start").alias("start"))
        part = runs.select("media_id", F.lit(name).alias("format"), "start", (F.col("_foot") + extra).alias("end"))
        out = part if out is None else out.unionByName(part)
    return out


def carve_artifacts(runs: DataFrame, media: DataFrame) -> DataFrame:
    """Carved files with digest, structure score and category; PDFs take one trailing line break along.

    ``media`` may come in chunks; a row holds the bytes of one carved file.
    """
    inside = runs.join(sizes_of(media), "media_id").where(F.col("end") <= F.col("size_bytes")).drop("size_bytes")
    more = byte_ranges(media, inside.withColumn("_end", F.col("end")).withColumn("end", F.col("end") + 2), ["format", "_end"])
    d = more.select("media_id", "format", "start", F.col("_end").alias("end"), F.col("bytes").alias("content"))
    size = (F.col("end") - F.col("start")).cast("int")
    after = latin(F.substring("content", size + 1, F.lit(2)))
    extra = F.when(after.isin("\r\n", "\n\r"), 2).when(F.substring(after, 1, 1).isin("\n", "\r"), 1).otherwise(0)
    d = d.withColumn("end", F.when(F.col("format") == "pdf", F.col("end") + extra).otherwise(F.col("end")))
    d = d.withColumn("bytes", F.substring("content", F.lit(1), size)).drop("content")
    checks = fm.structure_checks(latin(F.col("bytes")))
    pdf = F.col("format") == "pdf"
    return d.select(
        "media_id", "format", "start", "end",
        F.concat(F.lit("carved_"), F.lower(F.lpad(F.hex("start"), 8, "0")), F.lit("."), F.when(F.col("format") == "jpeg", "jpg").otherwise(F.col("format"))).alias("filename"),
        F.sha2("bytes", 256).alias("sha256"),
        F.when(pdf, checks["integrity_score"]).otherwise(F.lit(None).cast("double")).alias("integrity_score"),
        F.when(pdf & checks["is_valid"], "RECOVERED").when(pdf, "PARTIAL").otherwise("CANDIDATE").alias("category"),
    )


def cap_artifacts(artifacts: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` artifacts per medium, PDFs first, then by offset (a group limit, no full sort)."""
    rank = F.array_position(F.array(*[F.lit(n) for n in SIGNATURES]), F.col("format"))
    order = Window.partitionBy("media_id").orderBy(rank, "start")
    return artifacts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")


def artifact_score(category: Column, integrity: Column, placed: Column, total: Column, corrupt: Column, matched: Column) -> Column:
    """0..100 confidence of an artifact by category, integrity and placement."""
    ratio = placed / F.greatest(F.lit(1), total)
    base = (
        F.when(category == "RECOVERED", 75.0 + integrity * 20.0 + ratio * 5.0)
        .when(category == "PARTIAL", 30.0 + ratio * 35.0 + integrity * 15.0)
        .when(category == "CANDIDATE", 20.0 + ratio * 20.0)
        .otherwise(F.greatest(F.lit(0.0), ratio * 10.0))
    )
    cut = F.when(corrupt, F.greatest(F.lit(5.0), base - 15.0)).otherwise(base)
    return F.when(matched & (category == "VERIFIED"), 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), cut)))


def rank_artifacts(artifacts: DataFrame) -> DataFrame:
    """Best first: category weight plus confidence, confidence, size (a distributed sort)."""
    c = F.col("category")
    weight = F.when(c == "VERIFIED", 1000.0).when(c == "RECOVERED", 500.0).when(c == "PARTIAL", 200.0).when(c == "CANDIDATE", 100.0).otherwise(0.0)
    return artifacts.withColumn("priority", weight + F.col("confidence")).orderBy(F.desc("priority"), F.desc("confidence"), F.desc("size_bytes"))


def category_summary(artifacts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Totals per category; candidates count only in the total."""
    n = lambda name: F.count(F.when(F.col("category") == name.upper(), 1)).alias(name)
    return artifacts.groupBy(*(keys or [])).agg(F.count("*").alias("total"), *[n(x) for x in ("verified", "recovered", "partial", "unrecoverable")])


# ---- boundaries ---------------------------------------------------------------------------------------


def boundary_continuity(a: Column, b: Column) -> Column:
    """0..1 syntax continuity across the cut between latin texts a and b."""
    tail, head = F.right(a, F.lit(16)), F.substring(b, 1, 16)
    ends = lambda s: F.endswith(tail, F.lit(s))
    starts = lambda s: F.startswith(head, F.lit(s))
    joins = (ends("ob") & starts("j ")) | (ends("stream") & (starts("\r\n") | starts("\n"))) | (ends("end") & starts("obj"))
    score = (
        F.lit(0.5) + F.when(ends("\n"), 0.2).otherwise(0.0) + F.when(joins, 0.4).otherwise(0.0)
        - F.when(ends("\x00\x00") & ~starts("\x00"), 0.2).otherwise(0.0)
    )
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def alnum_boundary(a: Column, b: Column) -> Column:
    return a.rlike(r"[0-9A-Za-z]\z") & b.rlike(r"\A[0-9A-Za-z]")
