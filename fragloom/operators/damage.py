"""Controlled damage on media bytes with a manifest row per operation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

LOST = "UNRECOVERABLE_WITHOUT_EXTERNAL_REDUNDANCY"
SAVED = "RECOVERABLE_FROM_SURVIVING_EVIDENCE"
# Manifest fixed values: kind -> (operation type, recoverability, reversible).
KINDS = {
    "delete": ("DELETE_BYTES", LOST, False),
    "truncate": ("TRUNCATE", LOST, False),
    "zero": ("ZERO_BYTES", LOST, False),
    "noise": ("NOISE_OVERWRITE", LOST, False),
    "duplicate": ("DUPLICATE_BYTES", SAVED, True),
    "insert": ("INSERT_GARBAGE", SAVED, True),
}


def cut(blob: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a binary column."""
    return F.substring(blob, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def keyed_noise(size: Column, key: Column) -> Column:
    """``size`` bytes that depend only on ``key``: digests of key:0, key:1, ... joined and cut."""
    parts = F.transform(
        F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(size, F.lit(1)) - 1) / 32)),
        lambda i: F.sha2(F.concat(key, F.lit(":"), i.cast("string")), 256),
    )
    return cut(F.unhex(F.array_join(parts, "")), F.lit(0), size)


def apply(media: DataFrame, kind: str, offset: Column, length: Column | None = None, *, position: Column | None = None,
          garbage: Column | None = None, seed: Column | None = None) -> DataFrame:
    """Damage every row at its own offset; adds ``operation`` and replaces ``content``.

    ``offset`` is the target length for ``truncate`` and the insert position for ``insert``. Noise comes
    from keyed digests, so a rerun of a lost task gives the same bytes.
    """
    op_type, recoverability, reversible = KINDS[kind]
    content = F.col("content")
    n = F.length(content).cast("long")
    df = media.withColumn("_n", n)
    size = F.col("_n")
    zero = F.lit(0).cast("long")
    clamp = lambda v, lo, hi: F.greatest(lo, F.least(v.cast("long"), hi))
    if kind == "truncate":
        df = df.withColumn("_s", clamp(offset, zero, size)).withColumn("_e", size)
    elif kind == "insert":
        df = df.withColumn("_s", clamp(offset, zero, size)).withColumn("_e", F.col("_s"))
    else:
        df = df.withColumn("_s", clamp(offset, zero, F.greatest(size - 1, zero)))
        df = df.withColumn("_e", F.greatest(F.col("_s"), F.least(F.col("_s") + length.cast("long"), size)))
    s, e = F.col("_s"), F.col("_e")
    span = e - s
    head, tail = cut(content, zero, s), cut(content, e, size)
    at, at_end, before, after = s, e, span, zero
    if kind in ("delete", "truncate"):
        damaged = F.concat(head, tail) if kind == "delete" else head
    elif kind == "zero":
        damaged, after = F.concat(head, F.unhex(F.repeat(F.lit("00"), span.cast("int"))), tail), span
    elif kind == "noise":
        damaged, after = F.concat(head, keyed_noise(span, seed), tail), span
    elif kind == "duplicate":
        df = df.withColumn("_p", clamp(position, zero, size))
        at, at_end, before, after = F.col("_p"), F.col("_p") + span, zero, span
        damaged = F.concat(cut(content, zero, at), cut(content, s, e), cut(content, at, size))
    else:
        extra = F.length(garbage).cast("long")
        at_end, before, after = s + extra, zero, extra
        damaged = F.concat(head, garbage, tail)
    operation = F.struct(
        F.lit(op_type).alias("type"),
        at.alias("offset_start"),
        at_end.alias("offset_end"),
        before.alias("original_length"),
        after.alias("corrupted_length"),
        F.round(F.greatest(before, after) / F.greatest(size, F.lit(1)), 3).alias("severity"),
        F.when(F.greatest(before, after) == 0, "FULL").otherwise(recoverability).alias("recoverability"),
        F.lit(reversible).alias("reversible"),
    )
    return df.withColumn("operation", operation).withColumn("content", damaged).drop("_n", "_s", "_e", "_p")


# ---- damage at a pattern -----------------------------------------------------------------------------

_WS = r"[ \t\r\n\f\x0B]"
_ANY = r"[\s\S]*?"
_OBJ = "[0-9]+" + _WS + "+0" + _WS + "+obj"
_STREAM = "(stream[\\r\\n]+)(" + _ANY + ")(?=[\\r\\n]*endstream)"
# Name -> (pattern with groups (before)(target), action, argument, severity, recoverable).
# The target is replaced by a text, removed, kept to a share, zeroed or overwritten with keyed noise.
PATTERNS = {
    "damage_xref": (r"\A([\s\S]*)(xref)", "replace", "x_ef", 0.60, True),
    "damage_startxref": (r"\A([\s\S]*)(startxref)", "replace", "start_ref", 0.70, True),
    "damage_trailer": (r"\A([\s\S]*)(trailer)", "replace", "tra_ler", 0.70, True),
    "damage_object_offsets": (r"\A([\s\S]*xref" + _ANY + ")([0-9]{10})(?=" + _WS + "+[0-9]{5}" + _WS + "+[fn])", "replace", "9999999999", 0.55, True),
    "damage_length": ("(/Length" + _WS + "+)([0-9]+)", "replace", "99999", 0.45, True),
    "truncate_stream": (_STREAM, "keep", 0.5, 0.50, False),
    "remove_stream_prefix": (_STREAM, "drop_head", 16, 0.55, False),
    "remove_stream_suffix": ("()(endstream)", "remove", None, 0.50, True),
    "corrupt_stream_bytes": (_STREAM, "noise", 0.30, 0.60, False),
    "damage_stream_payload": (_STREAM, "zero", 0.40, 0.55, False),
    "remove_text_operators": (r"()(\([^)\r\n]*\)" + _WS + r"*Tj|\[[^\]\r\n]*\]" + _WS + "*TJ)", "remove", None, 0.50, False),
    "truncate_text_streams": ("(BT(?![A-Za-z0-9_]))(" + _ANY + ")(?=(?<![A-Za-z0-9_])ET)", "keep", 0.5, 0.60, False),
    "remove_image_object": ("((?:\\A|" + _WS + "))(" + _OBJ + _ANY + "/Subtype" + _WS + "*/Image" + _ANY + "endobj)", "remove", None, 0.70, False),
    "truncate_image_stream": ("(/Subtype" + _WS + "*/Image" + _ANY + "stream[\\r\\n]+)(" + _ANY + ")(?=[\\r\\n]*endstream)", "keep", 0.3, 0.70, False),
    "remove_image_references": ("()(/[A-Za-z0-9_-]+" + _WS + "+Do(?![A-Za-z0-9_]))", "remove", None, 0.40, False),
    "remove_font_object": ("((?:\\A|" + _WS + "))(" + _OBJ + _ANY + "/Type" + _WS + "*/Font" + _ANY + "endobj)", "remove", None, 0.60, False),
    "damage_font_references": ("(/BaseFont" + _WS + "*/)([A-Za-z0-9_-]+)", "replace", "DamagedFontMissing", 0.45, True),
    "remove_tounicode": ("()(/ToUnicode" + _WS + "+[0-9]+" + _WS + "+0" + _WS + "+R)", "remove", None, 0.50, False),
    "remove_page_object": ("((?:\\A|" + _WS + "))(" + _OBJ + _ANY + "/Type" + _WS + "*/Page(?![A-Za-z0-9_])" + _ANY + "endobj)", "remove", None, 0.75, False),
    "damage_page_tree": ("(/Kids" + _WS + r"*\[)([^\]]+)(?=\])", "replace", " ", 0.80, True),
    "remove_content_ref": ("()(/Contents" + _WS + "+(?:[0-9]+" + _WS + "+0" + _WS + r"+R|\[[^\]]+\]))", "remove", None, 0.65, True),
}


def object_pattern(action: str, number: Column | int):
    """Pattern row for one numbered object: remove_indirect_object, truncate_indirect_object or damage_object_boundaries."""
    n = str(number)
    body = "((?:\\A|" + _WS + "))(" + n + _WS + "+0" + _WS + "+obj" + _ANY + "endobj)"
    return {
        "remove_indirect_object": (body, "remove", None, 0.65, False),
        "truncate_indirect_object": (body, "keep", 0.5, 0.50, False),
        "damage_object_boundaries": ("(" + n + _WS + "+0" + _WS + "+)(obj)", "replace", "obX", 0.40, True),
    }[action]


# A pattern whose target is the last occurrence of a literal: found from the end of the text, no regex walks the whole of it.
_LAST = r"\\A\(\[\\s\\S\]\*\)\(([A-Za-z]+)\)"
_ENTRY = "[0-9]{10}(?=" + _WS + "+[0-9]{5}" + _WS + "+[fn])"


def last_position(text: Column, token: str) -> Column:
    """Offset of the last occurrence of a literal, null without one."""
    after = F.length(F.substring_index(text, token, -1))
    return F.when(F.contains(text, F.lit(token)), (F.length(text) - after - len(token)).cast("long"))


def _first_entry(text: Column) -> Column:
    """Offset of the first table entry behind the last xref that has one behind it, null without one.

    An entry has no letters of xref in a row, so it lies whole in one of the pieces between them.
    """
    pieces = F.transform(F.split(text, "xref", -1), lambda p, i: F.struct(
        F.length(p).cast("long").alias("size"), F.when(i > 0, F.regexp_instr(p, F.lit(_ENTRY))).otherwise(0).cast("long").alias("at")
    ))
    none = F.lit(None).cast("long")
    walked = F.aggregate(
        pieces, F.struct(F.lit(0).cast("long").alias("base"), none.alias("found")),
        lambda a, p: F.struct((a["base"] + p["size"] + 4).alias("base"), F.when(p["at"] > 0, a["base"] + p["at"] - 1).otherwise(a["found"]).alias("found")),
    )
    return walked["found"]


def damage_pattern(media: DataFrame, name: str, rule: tuple | None = None, seed: Column | None = None) -> DataFrame:
    """Damage the first match of a pattern (patterns anchored at the start of the text take the last one).

    Rows without a match stay as they are, with a null ``operation``.
    """
    pattern, action, arg, severity, recoverable = rule or PATTERNS[name]
    d = media.withColumn("_t", F.decode("content", "ISO-8859-1"))
    # without an image no object start can match, and trying each of them would be quadratic
    possible = F.contains("_t", F.lit("/Image")) if "/Image" in pattern else F.lit(True)
    last = re.fullmatch(_LAST, pattern)
    if last:
        token = last.group(1)
        at, n = last_position(F.col("_t"), token), F.lit(len(token)).cast("long")
        d = d.withColumn("_s", at).withColumn("_n", F.when(F.col("_s").isNotNull(), n).otherwise(0))
    elif pattern == PATTERNS["damage_object_offsets"][0]:
        d = d.withColumn("_s", _first_entry(F.col("_t"))).withColumn("_n", F.when(F.col("_s").isNotNull(), 10).otherwise(0).cast("long"))
    else:
        d = d.withColumn("_at", F.when(possible, F.regexp_instr("_t", F.lit(pattern))).otherwise(0))
        group = lambda i: F.when(F.col("_at") > 0, F.regexp_extract("_t", pattern, i)).otherwise("")
        found = F.when(F.col("_at") > 0, (F.col("_at") - 1 + F.length(group(1))).cast("long"))
        d = d.withColumn("_s", found).withColumn("_n", F.length(group(2)).cast("long"))
    s, n, content = F.col("_s"), F.col("_n"), F.col("content")
    zero = F.lit(0).cast("long")
    if action == "replace":
        from_, to_, new = s, s + n, F.encode(F.lit(arg), "ISO-8859-1")
    elif action == "remove":
        from_, to_, new = s, s + n, F.unhex(F.lit(""))
    elif action == "keep":
        kept = F.least(n, F.greatest(F.lit(2).cast("long"), F.floor(n * arg)))
        from_, to_, new = s + kept, s + n, F.unhex(F.lit(""))
    elif action == "drop_head":
        from_, to_, new = s, s + F.least(n, F.lit(arg).cast("long")), F.unhex(F.lit(""))
    else:
        size = F.least(n, F.greatest(F.lit(2 if action == "noise" else 4).cast("long"), F.floor(n * arg)))
        from_ = s + F.floor((n - size) / 2)
        to_ = from_ + size
        new = keyed_noise(size, seed if seed is not None else F.col("media_id")) if action == "noise" else F.unhex(F.repeat(F.lit("00"), size.cast("int")))
        new = F.when(size > 0, new).otherwise(F.unhex(F.lit("")))
    hit = F.col("_s").isNotNull()
    damaged = F.concat(cut(content, zero, from_), new, cut(content, to_, F.length(content).cast("long")))
    operation = F.when(
        hit,
        F.struct(
            F.lit(name.upper()).alias("type"), from_.alias("offset_start"), to_.alias("offset_end"), (to_ - from_).alias("original_length"),
            F.length(new).cast("long").alias("corrupted_length"), F.lit(severity).alias("severity"),
            F.lit(SAVED if recoverable else LOST).alias("recoverability"), F.lit(recoverable).alias("reversible"),
        ),
    )
    return d.withColumn("operation", operation).withColumn("content", F.when(hit, damaged).otherwise(content)).drop("_t", "_at", "_s", "_n")


# ---- named recipes -----------------------------------------------------------------------------------

# Recipe -> expected minimum share of authentic bytes.
RECIPES = {
    "mangled_header": 0.80, "destroyed_xref_trailer": 0.85, "unterminated_objects": 0.90, "mutated_stream_lengths": 0.95,
    "mutilated_flate_header": 0.75, "null_byte_sectors": 0.70, "arbitrary_truncation": 0.60, "online_scramble": 0.75, "orphan_pages": 0.85,
}
PREAMBLE = "<html><head><title>500 Internal Error</title></head><body>"


def damage_recipe(media: DataFrame, recipe: str) -> DataFrame:
    """One of nine real-world damage recipes on every row; adds the expected authentic share."""
    t = F.col("_t")
    n = F.length(t)
    rstrip = lambda c: F.regexp_replace(c, _WS + r"+\z", "")
    edge = "(?![A-Za-z0-9_])"
    d = media.withColumn("_t", F.decode("content", "ISO-8859-1"))
    if recipe == "mangled_header":
        at = F.regexp_instr(t, F.lit(r"%PDF-[0-9]+\.[0-9]+"))
        size = F.length(F.regexp_extract(t, r"(%PDF-[0-9]+\.[0-9]+)", 1))
        swapped = F.concat(F.substring(t, F.lit(1), at - 1), F.lit("XPDF-CORRUPT"), F.substring(t, at + size, n))
        out = F.concat(F.lit(PREAMBLE), F.when(at > 0, swapped).otherwise(t))
    elif recipe == "destroyed_xref_trailer":
        at = F.regexp_instr(t, F.lit(r"(?:\r?\n|\A)xref" + edge))
        last = F.coalesce(last_position(t, "trailer"), F.lit(0)).cast("int")
        out = (
            F.when(at > 0, rstrip(F.substring(t, F.lit(1), at - 1))).when(F.contains(t, F.lit("trailer")), rstrip(F.substring(t, F.lit(1), last)))
            .otherwise(F.substring(t, F.lit(1), F.floor(n * 0.9).cast("int")))
        )
    elif recipe == "unterminated_objects":
        # every second endobj: a pair of occurrences is rewritten at once
        word = "(?<![A-Za-z0-9_])endobj" + edge
        out = F.regexp_replace(t, "(" + word + "(?:(?!" + word + r")[\s\S])*+)" + word, "$1      ")
    elif recipe == "mutated_stream_lengths":
        out = F.regexp_replace(t, "/Length" + _WS + "+[0-9]+", "/Length 999999")
    elif recipe == "mutilated_flate_header":
        out = F.regexp_replace(t, "(stream[\\r\\n]+)x[\\s\\S](?=[\\s\\S])", "$1\x00\x00")
    elif recipe == "null_byte_sectors":
        at = (F.floor(F.floor(n * 2 / 5) / 512) * 512).cast("int")
        size = F.least(F.lit(512), n - at)
        hole = F.concat(F.substring(t, F.lit(1), at), F.repeat(F.lit("\x00"), size), F.substring(t, at + size + 1, n))
        out = F.when(n < 1024, t).otherwise(hole)
    elif recipe == "arbitrary_truncation":
        out = F.substring(t, F.lit(1), F.greatest(F.lit(64), F.floor(n * 0.65)).cast("int"))
    elif recipe == "online_scramble":
        # about 2 % of the bytes between the first and last 32: a keyed digest picks one byte in every 50
        # the pieces come from one pass over the text, and its length is bound once: both cost the whole text each time
        cut50 = F.regexp_extract_all(t, F.lit(r"[\s\S]{1,50}"), F.lit(0))
        keyed = lambda i: F.sha2(F.concat_ws(":", F.col("media_id"), i.cast("string")), 256)
        bound = F.transform(
            F.array(F.struct(cut50.alias("p"), n.alias("n"))),
            lambda s: F.array_join(F.transform(s.p, lambda p, i: _scrambled(p, keyed(i), i * 50, s.n)), ""),
        )
        out = F.get(bound, F.lit(0))
    elif recipe == "orphan_pages":
        out = F.regexp_replace(F.regexp_replace(t, "/Type" + _WS + "*/Catalog" + edge, "/Type /Cata_og"), "/Type" + _WS + "*/Pages" + edge, "/Type /Pag_s")
    else:
        raise KeyError(recipe)
    return d.withColumn("content", F.encode(out, "ISO-8859-1")).withColumn("recipe", F.lit(recipe)).withColumn("expected_authentic", F.lit(RECIPES[recipe])).drop("_t")


def _scrambled(piece: Column, digest: Column, base: Column, n: Column) -> Column:
    at = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % 50
    byte = F.decode(F.unhex(F.substring(digest, 5, 2)), "ISO-8859-1")
    ok = (at < F.length(piece)) & (base + at > 32) & (base + at < n - 32)
    return F.when(ok, F.concat(F.substring(piece, F.lit(1), at), byte, F.substring(piece, at + 2, F.lit(50)))).otherwise(piece)


# ---- severity levels -----------------------------------------------------------------------------------


OPERATIONS = (
    "array<struct<type:string,offset_start:bigint,offset_end:bigint,original_length:bigint,corrupted_length:bigint,"
    "severity:double,recoverability:string,reversible:boolean>>"
)


def _collect(df: DataFrame) -> DataFrame:
    done = F.when(F.col("operation").isNotNull(), F.array("operation").cast(OPERATIONS)).otherwise(F.array().cast(OPERATIONS))
    return df.withColumn("operations", F.concat("operations", done)).drop("operation")


def damage_by_severity(media: DataFrame, level: int, seed: int) -> DataFrame:
    """Damage of one severity level; adds ``operations``, the manifest of what was done.

    Level 1 picks one of three light operations per medium by sha256("seed:media"), level 2 hits a stream
    payload and a length, 3 xref, trailer, stream and an object, 4 page tree, xref, a stream, two
    objects and the last tenth.
    """
    d = media.withColumn("operations", F.array().cast(OPERATIONS)).withColumn("_seed", F.concat(F.lit(f"{seed}:"), F.col("media_id")))
    pick = F.pmod(F.conv(F.substring(F.sha2("_seed", 256), 1, 6), 16, 10).cast("long"), F.lit(3))
    steps = {2: ["damage_stream_payload", "damage_length"], 3: ["damage_xref", "damage_startxref", "truncate_stream"], 4: ["damage_page_tree", "damage_xref", "corrupt_stream_bytes"]}
    if level == 0:
        pass
    elif level == 1:
        offset = F.pmod(F.conv(F.substring(F.sha2("_seed", 256), 7, 8), 16, 10).cast("long"), F.greatest(F.lit(1), F.length("content") - 32))
        tagged = d.withColumn("_pick", pick)
        zero = _collect(apply(tagged.where("_pick = 0"), "zero", offset, F.lit(16)))
        text = _collect(damage_pattern(tagged.where("_pick = 1"), "remove_text_operators"))
        length = _collect(damage_pattern(tagged.where("_pick = 2"), "damage_length"))
        d = zero.unionByName(text).unionByName(length).drop("_pick")
    else:
        for name in steps[level]:
            if name == "damage_startxref":
                # the pointer token, or the trailer keyword of media that have no pointer left
                has_pointer = F.contains(F.decode("content", "ISO-8859-1"), F.lit("startxref"))
                pointer = _collect(damage_pattern(d.where(has_pointer), name))
                d = pointer.unionByName(_collect(damage_pattern(d.where(~has_pointer), "damage_trailer")))
            else:
                d = _collect(damage_pattern(d, name, seed=F.col("_seed")))
        for number in {3: [4], 4: [2, 3]}.get(level, []):
            d = _collect(damage_pattern(d, "remove_indirect_object", object_pattern("remove_indirect_object", number)))
        if level == 4:
            d = _collect(apply(d, "truncate", F.floor(F.length("content") * 0.9)))
    return d.drop("_seed").withColumn("severity_level", F.lit(level)).withColumn("seed", F.lit(seed))


def controlled_variants(media: DataFrame, splits: DataFrame, base_seed: int = 1000) -> DataFrame:
    """Four severities per document with seed base + 17 i; the split of the document is inherited."""
    out = None
    for i in range(1, 5):
        d = damage_by_severity(media, i, base_seed + 17 * i)
        d = d.withColumn("sample_id", F.format_string(f"%s_c{i:02d}_level_{i}", "media_id"))
        out = d if out is None else out.unionByName(d)
    preserved = (F.col("severity_level") <= 3) & (F.length("content") > 256)
    return out.join(splits, "media_id").withColumn("damaged_sha256", F.sha2("content", 256)).withColumn("preserves_content", preserved)
