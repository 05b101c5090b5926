"""File format confidence from signatures, structure scores and text validity of whole media."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fragloom.functions.blob import has, latin, matches
from fragloom.functions.tokens import BARE_OBJECT, LEFT, RIGHT, SPACE, any_of

PNG = "\x89PNG\r\n\x1a\n"
SOI, EOI, DQT = "\xff\xd8", "\xff\xd9", "\xff\xdb"
SOF0, SOF2 = "\xff\xc0", "\xff\xc2"
PK_LOCAL, PK_CENTRAL, PK_END = "PK\x03\x04", "PK\x01\x02", "PK\x05\x06"
ISO_TIME = r"([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?)"
SYSLOG_TIME = r"([A-Z][a-z]{2}" + SPACE + "+[0-9]+" + SPACE + "+[0-9]{2}:[0-9]{2}:[0-9]{2})"
CLF_TIME = r"\[([0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2})"
ORDER = ["pdf", "png", "jpeg", "docx", "zip", "mp4", "text"]


def head(t: Column, n: int) -> Column:
    return F.substring(t, 1, n)


def tail(t: Column, n: int) -> Column:
    return F.right(t, F.lit(n))


def starts(t: Column, s: str) -> Column:
    return F.startswith(t, F.lit(s))


def _score(*cases) -> Column:
    """Sum of the first matching weight in each alternative list, clamped to [0, 1]."""
    total = F.lit(0.0)
    for alternatives in cases:
        chain = None
        for cond, weight in alternatives:
            chain = F.when(cond, weight) if chain is None else chain.when(cond, weight)
        total = total + chain.otherwise(0.0)
    return F.least(F.lit(1.0), total)


def format_scores(t: Column, filename: Column) -> dict[str, Column]:
    """Confidence per format name; ``t`` is the latin text of non-empty media."""
    name = F.lower(filename)
    ends = lambda *exts: name.rlike("(?:" + "|".join(e.replace(".", "\\.") for e in exts) + ")$")
    printable = matches(t, r"[ -~\t\n\r]") / F.length(t)
    ftyp = F.instr(head(t, 64), "ftyp")
    brands = any_of(head(t, 128), "isom", "mp41", "mp42", "avc1", "qt  ", "M4V ")
    word = any_of(t, "word/document.xml", "[Content_Types].xml")
    return {
        "pdf": _score(
            [(has(head(t, 1024), "%PDF-"), 0.5)],
            [(has(tail(t, 1024), "%%EOF"), 0.3), (has(t, "%%EOF"), 0.15)],
            [(t.rlike(BARE_OBJECT), 0.2)],
            [(t.rlike("trailer" + SPACE + "*<<") | has(t, "startxref"), 0.1)],
            [(ends(".pdf"), 0.1)],
        ),
        "png": _score(
            [(starts(t, PNG), 0.6), (has(head(t, 1024), PNG), 0.4)],
            [(has(head(t, 128), "IHDR"), 0.2)],
            [(has(t, "IDAT"), 0.15)],
            [(has(t, "IEND"), 0.15)],
            [(ends(".png"), 0.1)],
        ),
        "jpeg": _score(
            [(starts(t, SOI), 0.5), (has(head(t, 1024), SOI), 0.3)],
            [(has(tail(t, 128), EOI), 0.3), (has(t, EOI), 0.15)],
            [(any_of(t, SOF0, SOF2), 0.2)],
            [(has(t, DQT), 0.1)],
            [(name.isin(".jpg", ".jpeg"), 0.1)],
        ),
        "docx": _score(
            [(starts(t, PK_LOCAL), 0.3), (has(head(t, 1024), PK_LOCAL), 0.2)],
            [(has(t, "word/document.xml"), 0.4), (has(t, "word/"), 0.25)],
            [(has(t, "[Content_Types].xml"), 0.2)],
            [(ends(".docx"), 0.2)],
        ),
        "zip": _score(
            [(starts(t, PK_LOCAL), 0.5), (has(head(t, 1024), PK_LOCAL), 0.3)],
            [(has(t, PK_END), 0.3)],
            [(has(t, PK_CENTRAL), 0.2)],
            [(word, 0.2)],
            [(ends(".docx", ".zip"), 0.1)],
        ),
        "mp4": _score(
            [(ftyp == 5, 0.6), (ftyp > 0, 0.4)],
            [(has(t, "mdat"), 0.25)],
            [(has(t, "moov"), 0.25)],
            [(brands, 0.1)],
            [(ends(".mp4", ".m4v", ".mov"), 0.1)],
        ),
        "text": _score(
            [(printable > 0.95, 0.5), (printable > 0.80, 0.3)],
            [(t.rlike(ISO_TIME) | t.rlike(SYSLOG_TIME) | t.rlike(CLF_TIME), 0.3)],
            [(ends(".log", ".txt", ".json", ".csv", ".xml"), 0.1)],
        ),
    }


def best_format(scores: dict[str, Column]) -> Column:
    """struct(confidence, format): highest confidence, first handler wins ties, ``binary`` below any."""
    rows = [
        F.struct(scores[n].alias("confidence"), F.lit(-i).alias("rank"), F.lit(n).alias("format"))
        for i, n in enumerate(ORDER)
    ]
    # the fallback outranks every handler that scores 0, and each score is computed once
    rows.append(F.struct(F.lit(0.0).alias("confidence"), F.lit(1).alias("rank"), F.lit("binary").alias("format")))
    return F.array_max(F.array(*rows))


def is_log(t: Column, filename: Column) -> Column:
    return t.rlike(ISO_TIME) | t.rlike(SYSLOG_TIME) | t.rlike(CLF_TIME) | F.lower(filename).endswith(".log")


def first_timestamp(t: Column) -> Column:
    """First ISO, else syslog, else common-log timestamp text, null without one."""
    found = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (ISO_TIME, SYSLOG_TIME, CLF_TIME)]
    return F.coalesce(*found)


def structure_checks(t: Column) -> dict[str, Column]:
    header, eof, objects = has(head(t, 1024), "%PDF-"), has(t, "%%EOF"), t.rlike(BARE_OBJECT)
    score = (
        F.when(header, 0.35).otherwise(0.0)
        + F.when(eof, 0.35).otherwise(0.0)
        + F.when(objects, 0.20).otherwise(0.0)
        + F.when(any_of(t, "xref", "trailer"), 0.10).otherwise(0.0)
    )
    return {"integrity_score": F.round(score, 2), "is_valid": header & eof & objects}


def text_validity(blob: Column) -> dict[str, Column]:
    utf8 = F.is_valid_utf8(blob.cast("string"))
    size = F.length(blob)
    score = 0.5 + F.when(utf8, 0.3).otherwise(0.0) + F.when(size > 0, 0.2).otherwise(0.0)
    return {
        "is_valid": size > 0,
        "utf8_decodable": utf8,
        "integrity_score": F.when(size > 0, F.round(score, 2)).otherwise(0.0),
    }


# Fixed names of the damage classes.
DAMAGE_CLASSES = [
    "EMPTY_INPUT", "MISSING_HEADER", "OFFSET_HEADER_PREAMBLE_NOISE", "TRUNCATED_BITSTREAM_NO_EOF",
    "MISSING_STARTXREF", "MISSING_TRAILER_DICT", "DESTROYED_CROSS_REFERENCE_TABLE", "NO_INDIRECT_OBJECTS",
    "UNTERMINATED_OBJECTS", "ORPHAN_PAGES_NO_PARENT_TREE", "MISSING_DOCUMENT_CATALOG",
    "ERASED_SECTOR_NULL_RUNS", "COMPRESSED_OBJECT_STREAMS",
]


def damage_diagnosis(t: Column) -> dict[str, Column]:
    """Damage classes, header facts and integrity score of a whole medium (latin text)."""
    empty = F.length(t) == 0
    version = F.regexp_extract(t, r"%PDF-([0-9]+\.[0-9]+)", 1)
    has_header = version != ""
    offset = F.regexp_instr(t, F.lit(r"%PDF-[0-9]+\.[0-9]+")).cast("long") - 1
    eof, startxref, trailer = has(t, "%%EOF"), has(t, "startxref"), has(t, "trailer")
    xref = any_of(t, "xref", "/Type /XRef", "/Type/XRef")
    obj = matches(t, LEFT + BARE_OBJECT + RIGHT)
    endobj = matches(t, LEFT + "endobj" + RIGHT)
    typed = lambda name: matches(t, "/Type" + SPACE + "*/" + name + RIGHT)
    page, pages, catalog = typed("Page"), typed("Pages"), typed("Catalog")
    null_run = t.rlike(r"\x00{32,}")
    obj_stm = typed("ObjStm") > 0
    case = lambda cond, name: F.when(cond, F.lit(name))
    classes = F.array_compact(
        F.array(
            case(~has_header, "MISSING_HEADER"),
            case(has_header & (offset > 0), "OFFSET_HEADER_PREAMBLE_NOISE"),
            case(~eof, "TRUNCATED_BITSTREAM_NO_EOF"),
            case(~startxref, "MISSING_STARTXREF"),
            case(~trailer, "MISSING_TRAILER_DICT"),
            case(~xref, "DESTROYED_CROSS_REFERENCE_TABLE"),
            case(obj == 0, "NO_INDIRECT_OBJECTS"),
            case((obj > 0) & (obj != endobj), "UNTERMINATED_OBJECTS"),
            case((page > 0) & (pages == 0), "ORPHAN_PAGES_NO_PARENT_TREE"),
            case((page > 0) & (catalog == 0), "MISSING_DOCUMENT_CATALOG"),
            case(null_run, "ERASED_SECTOR_NULL_RUNS"),
            case(obj_stm, "COMPRESSED_OBJECT_STREAMS"),
        )
    )
    score = (
        F.when(has_header & (offset == 0), 0.25).when(has_header, 0.15).otherwise(0.0)
        + F.when(eof, 0.20).otherwise(0.0)
        + F.when(xref, 0.20).otherwise(0.0)
        + F.when(trailer, 0.15).otherwise(0.0)
        + F.when((obj > 0) & (F.abs(obj - endobj) <= 1), 0.10).otherwise(0.0)
        + F.when((page > 0) & (catalog > 0), 0.10).otherwise(0.0)
    )
    return {
        "corruption_classes": F.when(empty, F.array(F.lit("EMPTY_INPUT"))).otherwise(classes),
        "detected_version": F.when(has_header, version).otherwise("unknown"),
        "header_offset": F.when(has_header, offset).otherwise(-1).cast("long"),
        "objects": obj,
        "pages": page,
        "integrity_score": F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), score)),
    }


def fidelity_estimate(authentic: Column, media_size: Column, strings: Column, objects: Column) -> Column:
    """Uncalibrated 8..75 % estimate from coverage, surviving strings and objects."""
    coverage = F.when(media_size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), authentic / media_size))).otherwise(0.0)
    score = coverage * 0.5 + F.least(F.lit(0.3), strings * 0.05) + F.least(F.lit(0.2), objects * 0.03)
    return F.round(F.least(F.lit(0.75), F.greatest(F.lit(0.08), score)) * 100, 1)


def surviving_features(t: Column) -> dict[str, Column]:
    """Version, fonts, media box and metadata entries still readable in a damaged PDF (latin text)."""
    take = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    fonts = F.array_distinct(F.regexp_extract_all(t, F.lit("/BaseFont" + SPACE + "*/([A-Za-z0-9_-]+)"), F.lit(1)))
    number = "([0-9.]+)"
    box = "/MediaBox" + SPACE + r"*\[" + SPACE + "*" + (SPACE + "+").join([number] * 4) + SPACE + r"*\]"
    side = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(t, box, i), F.lit("")).try_cast("double"), F.lit(default))
    columns = {
        "pdf_version": F.coalesce(F.nullif(F.regexp_extract(t, r"%PDF-([0-9]+\.[0-9]+)", 1), F.lit("")), F.lit("1.4")),
        "fonts": F.when(F.size(fonts) > 0, fonts).otherwise(F.array(F.lit("Helvetica"), F.lit("Helvetica-Bold"))),
        "media_box": F.array(side(1, 0.0), side(2, 0.0), side(3, 612.0), side(4, 792.0)),
    }
    for key in ("Title", "Author", "CreationDate", "ModDate", "Producer", "Creator", "Subject"):
        columns[key.lower()] = F.trim(take("/" + key + SPACE + r"*\(([^)\r\n]+)\)"))
    columns["image_width"] = take("/Width" + SPACE + "+([0-9]+)").try_cast("long")
    columns["image_height"] = take("/Height" + SPACE + "+([0-9]+)").try_cast("long")
    columns["image_colorspace"] = take("/ColorSpace" + SPACE + "+/([A-Za-z0-9_-]+)")
    columns["image_filter"] = take("/Filter" + SPACE + "+/([A-Za-z0-9_-]+)")
    return columns
