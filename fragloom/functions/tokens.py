"""Structural tokens, byte features and rule labels of one fragment, as column expressions.

Patterns avoid word boundaries and multi-line anchors: on bytes above 127 the JVM would read both as
Unicode. A word edge is spelled as a look-around over ASCII word characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fragloom.functions.blob import byte_measures, flag, has, latin, matches, occurrences

W = "[A-Za-z0-9_]"
LEFT, RIGHT = f"(?<!{W})", f"(?!{W})"
SPACE = r"[ \t\n\r\f\x0B]"
LINE = r"(?:\A|\n)"

OBJECT_LINE = LINE + r"([0-9]+)[ \t]+([0-9]+)[ \t]+obj" + RIGHT
OBJECT_DEF = LEFT + "([0-9]+)" + SPACE + "+([0-9]+)" + SPACE + "+obj" + RIGHT
OBJECT_REF = LEFT + "([0-9]+)" + SPACE + "+([0-9]+)" + SPACE + "+R" + RIGHT
BARE_OBJECT = "[0-9]+" + SPACE + "+[0-9]+" + SPACE + "+obj"

# Fixed vocabulary of fragment labels.
LABELS = [
    "PDF_HEADER", "XREF", "TRAILER", "PDF_OBJECT", "PAGE_OBJECT", "FONT_OBJECT", "IMAGE_STREAM",
    "TEXT_STREAM", "METADATA", "PDF_STREAM", "UNKNOWN",
]

# Fixed order of the classifier's features.
FEATURES = [
    "length", "printable_ratio", "whitespace_ratio", "null_byte_ratio", "high_byte_ratio", "digit_ratio",
    "shannon_entropy", "starts_with_pdf_magic", "starts_with_dict_open", "has_dict_open", "has_dict_close",
    "token_count_obj", "token_count_endobj", "token_count_stream", "token_count_endstream", "token_count_xref",
    "token_count_trailer", "token_count_startxref", "token_count_eof", "has_type_page", "has_type_font",
    "has_type_catalog", "has_type_metadata", "has_subtype_image", "has_filter_flate", "has_length_key",
    "has_bt_et_text_ops", "token_count_bt", "token_count_et", "token_count_tj", "slash_name_count",
    "consecutive_printable_max", "is_compressed_candidate",
]


def line_token(t: Column, token: str) -> Column:
    return has(t, token) & t.rlike(LINE + token + RIGHT)  # the plain search spares most blocks the pattern


def object_line(t: Column) -> Column:
    return has(t, "obj") & t.rlike(OBJECT_LINE)


def detect_tokens(t: Column) -> Column:
    """Tokens present in a block (latin text), in fixed order."""
    present = [
        (has(t, "%PDF-"), "%PDF-"),
        (has(t, "%%EOF"), "%%EOF"),
        (line_token(t, "xref"), "xref"),
        (line_token(t, "startxref"), "startxref"),
        (line_token(t, "trailer"), "trailer"),
        (object_line(t), "obj"),
        (has(t, "endobj"), "endobj"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in present]))


def block_kind(t: Column) -> Column:
    return (
        F.when(has(t, "%PDF-"), "header")
        .when(has(t, "%%EOF"), "eof")
        .when(line_token(t, "startxref"), "startxref")
        .when(line_token(t, "trailer"), "trailer")
        .when(line_token(t, "xref"), "xref")
        .when(object_line(t), "object")
        .otherwise("unknown")
    )


def object_number(t: Column) -> Column:
    """Number of the first line-anchored object header; read it only for kind ``object``."""
    return F.regexp_extract(t, OBJECT_LINE, 1).try_cast("long")


def profile_blocks(fragments: DataFrame) -> DataFrame:
    t = latin(F.col("block"))
    return fragments.select(
        "*",
        block_kind(t).alias("kind"),
        F.when(block_kind(t) == "object", object_number(t)).alias("object_number"),
        detect_tokens(t).alias("tokens"),
    )


def any_of(t: Column, *tokens: str) -> Column:
    cond = has(t, tokens[0])
    for token in tokens[1:]:
        cond = cond | has(t, token)
    return cond


def byte_features(df: DataFrame, block: str = "block") -> DataFrame:
    """Adds the 33 feature columns; empty blocks give zeros."""
    d = df.withColumn("_t", latin(F.col(block))).withColumn("_m", byte_measures(F.col(block)))
    t = F.col("_t")
    n = F.length(t)
    ratio = lambda name: F.coalesce(F.col(f"_m.{name}") / F.nullif(n, F.lit(0)), F.lit(0.0))
    count = lambda token: occurrences(t, token).cast("double")
    printable = ratio("printable")
    defs = matches(t, OBJECT_DEF).cast("double")
    tj = matches(t, LEFT + "(?:Tj|TJ)" + RIGHT).cast("double")
    columns = {
        "length": n.cast("double"),
        "printable_ratio": printable,
        "whitespace_ratio": ratio("white"),
        "null_byte_ratio": ratio("zero"),
        "high_byte_ratio": ratio("high"),
        "digit_ratio": ratio("digit"),
        "shannon_entropy": F.col("_m.entropy"),
        "starts_with_pdf_magic": flag(F.startswith(t, F.lit("%PDF")) | has(F.substring(t, 1, 64), "%PDF-")),
        "starts_with_dict_open": flag(t.rlike(r"\A" + SPACE + "*<<")),
        "has_dict_open": flag(has(t, "<<")),
        "has_dict_close": flag(has(t, ">>")),
        "token_count_obj": F.when(defs > 0, defs).otherwise(flag(has(t, " obj"))),
        "token_count_endobj": count("endobj"),
        "token_count_stream": F.greatest(F.lit(0.0), count("stream") - count("endstream")),
        "token_count_endstream": count("endstream"),
        "token_count_xref": count("xref"),
        "token_count_trailer": count("trailer"),
        "token_count_startxref": count("startxref"),
        "token_count_eof": count("%%EOF"),
        "has_type_page": flag(any_of(t, "/Type /Page", "/Type/Page")),
        "has_type_font": flag(any_of(t, "/Type /Font", "/Type/Font", "/Subtype /Type1", "/TrueType")),
        "has_type_catalog": flag(any_of(t, "/Type /Catalog", "/Type/Catalog")),
        "has_type_metadata": flag(any_of(t, "/Type /Metadata", "<x:xmpmeta", "http://ns.adobe.com")),
        "has_subtype_image": flag(any_of(t, "/Subtype /Image", "/Subtype/Image", "/DCTDecode", "/JPXDecode")),
        "has_filter_flate": flag(has(t, "FlateDecode")),
        "has_length_key": flag(any_of(t, "/Length ", "/Length\n")),
        "has_bt_et_text_ops": flag((has(t, "BT") & has(t, "ET")) | (tj > 0)),
        "token_count_bt": count("BT"),
        "token_count_et": count("ET"),
        "token_count_tj": tj,
        "slash_name_count": matches(t, "/[A-Za-z0-9_-]+").cast("double"),
        "consecutive_printable_max": F.coalesce("_m.run", F.lit(0)).cast("double"),
        "is_compressed_candidate": flag(
            any_of(t, "x\x9c", "x\x01", "x\xda") | ((F.col("_m.entropy") > 7.2) & (printable < 0.2))
        ),
    }
    return d.withColumns({k: columns[k] for k in FEATURES}).drop("_t", "_m")


def labelled(cases: list[tuple[Column, str, float]], fallback: tuple[str, float]) -> Column:
    """First matching case as struct(label, confidence)."""
    pair = lambda name, conf: F.struct(F.lit(name).alias("label"), F.lit(conf).alias("confidence"))
    chain = None
    for cond, name, conf in cases:
        chain = F.when(cond, pair(name, conf)) if chain is None else chain.when(cond, pair(name, conf))
    return chain.otherwise(pair(*fallback))


def rule_label(t: Column) -> Column:
    """Rule baseline on bytes. A block with ``startxref`` counts as XREF because ``xref`` is part of it."""
    return labelled(
        [
            (F.startswith(t, F.lit("%PDF")) | has(F.substring(t, 1, 32), "%PDF-"), "PDF_HEADER", 0.95),
            (has(t, "xref"), "XREF", 0.85),
            (has(t, "trailer"), "TRAILER", 0.85),
            (any_of(t, "/Subtype /Image", "/DCTDecode"), "IMAGE_STREAM", 0.80),
            ((has(t, "BT") & has(t, "ET")) | (has(t, "/Type /Page") & has(t, "/Contents")), "TEXT_STREAM", 0.75),
            (has(t, "/Type /Page"), "PAGE_OBJECT", 0.80),
            (has(t, "/Type /Font"), "FONT_OBJECT", 0.80),
            (any_of(t, "/Type /Metadata", "<x:xmpmeta"), "METADATA", 0.80),
            (has(t, "stream") & has(t, "endstream"), "PDF_STREAM", 0.70),
            (has(t, " obj"), "PDF_OBJECT", 0.65),
        ],
        ("UNKNOWN", 0.50),
    )


def rule_probabilities(label: Column, confidence: Column) -> Column:
    """The winner keeps its confidence, the rest of the mass is spread evenly over the other labels."""
    rest = (1 - confidence) / (len(LABELS) - 1)
    names = F.array(*[F.lit(n) for n in LABELS])
    return F.map_from_arrays(names, F.transform(names, lambda n: F.when(n == label, confidence).otherwise(rest)))


def rule_label_features() -> Column:
    """Second rule order, over feature columns; it defines the published rule baseline."""
    on = lambda name: F.col(name) > 0
    return (
        F.when(on("starts_with_pdf_magic"), "PDF_HEADER")
        .when(on("token_count_xref"), "XREF")
        .when(on("token_count_trailer") | on("token_count_startxref"), "TRAILER")
        .when(on("has_type_page"), "PAGE_OBJECT")
        .when(on("has_type_font"), "FONT_OBJECT")
        .when(on("has_subtype_image"), "IMAGE_STREAM")
        .when(on("has_bt_et_text_ops"), "TEXT_STREAM")
        .when(on("token_count_stream") | on("is_compressed_candidate"), "PDF_STREAM")
        .when(on("token_count_obj"), "PDF_OBJECT")
        .otherwise("UNKNOWN")
    )


def damage_block_label(t: Column) -> Column:
    return (
        F.when(F.startswith(t, F.lit("%PDF")), "PDF_HEADER")
        .when(has(t, "xref"), "XREF")
        .when(has(t, "trailer"), "TRAILER")
        .when(has(t, "stream"), "PDF_STREAM")
        .when(has(t, "obj"), "PDF_OBJECT")
        .otherwise("UNKNOWN")
    )


def local_role(t: Column) -> Column:
    """struct(file_type, role, marker, confidence) from signatures."""
    case = lambda kind, role, marker: F.struct(
        F.lit(kind).alias("file_type"), F.lit(role).alias("role"), marker.alias("marker"), F.lit(0.95).alias("confidence")
    )
    mark = lambda s: F.lit(s)
    return (
        F.when(F.startswith(t, F.lit("%PDF")), case("pdf", "header", mark("%PDF")))
        .when(has(t, "%%EOF"), case("pdf", "footer", mark("%%EOF")))
        .when(any_of(t, "xref", "/Root"), case("pdf", "catalog", F.when(has(t, "xref"), "xref").otherwise("/Root")))
        .when(has(t, "stream"), case("pdf", "stream", mark("stream")))
        .when(F.startswith(t, F.lit("\x89PNG\r\n\x1a\n")), case("png", "image", mark("PNG")))
        .when(F.startswith(t, F.lit("\xff\xd8\xff")), case("jpeg", "image", mark("JPEG")))
        .otherwise(
            F.struct(
                F.lit("unknown").alias("file_type"), F.lit("data").alias("role"),
                F.lit(None).cast("string").alias("marker"), F.lit(0.50).alias("confidence"),
            )
        )
    )


def object_type(t: Column) -> Column:
    typed = lambda key, name: t.rlike("/" + key + SPACE + "*/" + name + RIGHT)
    return (
        F.when(typed("Type", "Catalog"), "Catalog")
        .when(typed("Type", "Pages"), "Pages")
        .when(typed("Type", "Page"), "Page")
        .when(typed("Type", "Font") | has(t, "/BaseFont"), "Font")
        .when(typed("Subtype", "Image"), "Image")
        .when(any_of(t, "/Author", "/Creator", "/CreationDate"), "Info")
        .when(has(t, "stream") & any_of(t, "BT", "Tj", "cm"), "ContentStream")
        .when(has(t, "stream"), "Stream")
        .otherwise("Object")
    )


def inventory(t: Column) -> dict[str, Column]:
    """Structural inventory of a document (latin text)."""
    numbers = F.regexp_extract_all(t, F.lit("(?:\\A|" + SPACE + ")([0-9]+)" + SPACE + "+0" + SPACE + "+obj"), F.lit(1))
    sized = F.transform(
        F.regexp_extract_all(t, F.lit(r"\(([^)\r\n]{4,})\)"), F.lit(1)), lambda s: F.length(s).cast("long")
    )
    typed = lambda key, name: matches(t, "/" + key + SPACE + "*/" + name + RIGHT)
    return {
        "object_numbers": F.array_sort(F.array_distinct(F.transform(numbers, lambda s: s.cast("long")))),
        "streams": matches(t, LEFT + "stream" + RIGHT),
        "pages": F.greatest(F.lit(1).cast("long"), typed("Type", "Page")),
        "fonts": typed("Type", "Font"),
        "images": typed("Subtype", "Image"),
        "tables": matches(t, LEFT + "(?:Table|Col" + SPACE + "*1)" + RIGHT),
        "figures": matches(t, LEFT + "(?:Figure" + RIGHT + "|Fig\\.(?=" + W + "))"),
        "equations": matches(t, "(?<=" + W + r")(?:\\int|\\sum)" + RIGHT + "|" + LEFT + "(?:dx/dt|E=mc)" + RIGHT),
        "text_length": F.aggregate(sized, F.lit(0).cast("long"), lambda a, x: a + x),
    }


def safety_flags(t: Column) -> dict[str, Column]:
    js, launch = any_of(t, "/JavaScript", "/JS"), has(t, "/Launch")
    return {
        "safe": ~(js | launch),
        "contains_javascript": js,
        "contains_launch": launch,
        "contains_embedded_files": has(t, "/EmbeddedFiles"),
        "contains_open_action": any_of(t, "/A <</S", "/OpenAction"),
    }


def html_safety_flags(t: Column) -> dict[str, Column]:
    """The same questions asked of a web page."""
    js, launch = any_of(t, "<script", "onload=", "javascript:"), any_of(t, "<iframe", "<object")
    return {
        "safe": ~(js | launch),
        "contains_javascript": js,
        "contains_launch": launch,
        "contains_embedded_files": any_of(t, "<embed", "<svg"),
        "contains_open_action": has(t, 'http-equiv="refresh"'),
    }
