"""Token, feature, label and format queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragloom.functions import formats as fm, tokens as tk
from fragloom.functions.blob import byte_entropy, latin
from fragloom.operators import ordering
from fragloom.plans import views as v
from fragloom.plans.registry import query


def lat(b: str) -> str:
    """DuckDB text of a blob: one char per byte, bytes that are no plain ASCII become ``~``."""
    plain = f"replace(replace(replace({b}::VARCHAR, '\\x0A', chr(10)), '\\x0D', chr(13)), '\\x09', chr(9))"
    return f"regexp_replace({plain}, '\\\\x[0-9A-F]{{2}}', '~', 'g')"


def hits(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def lits(t: str, token: str) -> str:
    return f"((length({t}) - length(replace({t}, '{token}', ''))) // {len(token)})"


BOTH = f"""{v.BLOCKS}, {v.PDF_BLOCKS}, both_blocks AS (
  SELECT media_id, start, block FROM blocks UNION ALL SELECT media_id, start, encode(block) FROM pdf_blocks),
lat AS (SELECT media_id, start, block, block::VARCHAR AS esc, {lat("block")} AS t,
  list_transform(range(1, octet_length(block)::BIGINT + 1), lambda i: hex(block[i:i])) AS hx FROM both_blocks)"""

WHOLE = f"""{v.MEDIA}, {v.PDF}, whole AS (
  SELECT media_id, media_id || '.txt' AS filename, content FROM media UNION ALL SELECT media_id, media_id || '.PDF', encode(doc) FROM pdf
  UNION ALL SELECT 'page-' || page_id, 'page-' || page_id, encode(html) FROM pages),
wlat AS (SELECT media_id, filename, content, {lat("content")} AS t,
  octet_length(content) - len(regexp_extract_all(content::VARCHAR, '\\\\x(?:0[0-8BCEF]|1[0-9A-F]|7F|[89A-F][0-9A-F])')) AS printable FROM whole)"""


def both_blocks(t):
    """256-byte blocks of the documents and of their PDF layout."""
    return v.blocks(t).unionByName(v.fr.carve_blocks(v.pdf_media(t)))


def whole(t):
    """Whole media with file names: documents, PDF layouts and web pages."""
    pages = v.column_media(t.pages, F.concat(F.lit("page-"), F.col("page_id").cast("string")), F.col("html"))
    named = lambda df, ext: df.select("media_id", F.concat("media_id", F.lit(ext)).alias("filename"), "content")
    return named(v.media(t), ".txt").unionByName(named(v.pdf_media(t), ".PDF")).unionByName(named(pages, ""))


@query(
    "detect_tokens",
    f"""WITH {BOTH} SELECT media_id, start, concat_ws(',', CASE WHEN contains(t, '%PDF-') THEN '%PDF-' END, CASE WHEN contains(t, '%%EOF') THEN '%%EOF' END,
  CASE WHEN regexp_matches(t, '(?m)^xref\\b') THEN 'xref' END, CASE WHEN regexp_matches(t, '(?m)^startxref\\b') THEN 'startxref' END,
  CASE WHEN regexp_matches(t, '(?m)^trailer\\b') THEN 'trailer' END, CASE WHEN regexp_matches(t, '(?m)^[0-9]+[ \\t]+[0-9]+[ \\t]+obj\\b') THEN 'obj' END,
  CASE WHEN contains(t, 'endobj') THEN 'endobj' END) AS tokens FROM lat""",
)
def detect_tokens(t):
    return both_blocks(t).select("media_id", "start", F.array_join(tk.detect_tokens(latin(F.col("block"))), ",").alias("tokens"))


@query(
    "classify_block",
    f"""WITH {BOTH}, k AS (SELECT media_id, start, t, CASE WHEN contains(t, '%PDF-') THEN 'header' WHEN contains(t, '%%EOF') THEN 'eof'
  WHEN regexp_matches(t, '(?m)^startxref\\b') THEN 'startxref' WHEN regexp_matches(t, '(?m)^trailer\\b') THEN 'trailer'
  WHEN regexp_matches(t, '(?m)^xref\\b') THEN 'xref' WHEN regexp_matches(t, '(?m)^[0-9]+[ \\t]+[0-9]+[ \\t]+obj\\b') THEN 'object' ELSE 'unknown' END AS kind FROM lat)
SELECT media_id, start, kind, CASE WHEN kind = 'object' THEN regexp_extract(t, '(?m)^([0-9]+)[ \\t]+[0-9]+[ \\t]+obj\\b', 1)::BIGINT END AS object_number FROM k""",
)
def classify_block(t):
    return tk.profile_blocks(both_blocks(t)).select("media_id", "start", "kind", "object_number")


@query("byte_entropy", f"WITH {BOTH} SELECT media_id, start, round(list_entropy(hx), 6) AS entropy FROM lat")
def entropy(t):
    return both_blocks(t).select("media_id", "start", F.round(byte_entropy("block"), 6).alias("entropy"))


_OBJ = "\\b[0-9]+[ \\t\\n\\r\\f]+[0-9]+[ \\t\\n\\r\\f]+obj\\b"
_PRINT = "h BETWEEN '20' AND '7E' OR h IN ('09', '0A', '0D')"


def _ratio(cond: str) -> str:
    return f"len(list_filter(hx, lambda h: {cond})) / len(hx)::DOUBLE"


def _any(*tokens: str) -> str:
    return "(" + " OR ".join(f"contains(t, '{x}')" for x in tokens) + ")::INT::DOUBLE"


FEATURE_SQL = {
    "length": "len(hx)::DOUBLE",
    "printable_ratio": _ratio(_PRINT),
    "whitespace_ratio": _ratio("h IN ('09', '0A', '0D', '20')"),
    "null_byte_ratio": _ratio("h = '00'"),
    "high_byte_ratio": _ratio("h >= '80'"),
    "digit_ratio": _ratio("h BETWEEN '30' AND '39'"),
    "shannon_entropy": "list_entropy(hx)",
    "starts_with_pdf_magic": "(starts_with(t, '%PDF') OR contains(t[1:64], '%PDF-'))::INT::DOUBLE",
    "starts_with_dict_open": "regexp_matches(t, '^[ \\t\\n\\r\\f]*<<')::INT::DOUBLE",
    "has_dict_open": _any("<<"),
    "has_dict_close": _any(">>"),
    "token_count_obj": f"coalesce(nullif({hits('t', _OBJ)}, 0), contains(t, ' obj')::INT)::DOUBLE",
    "token_count_endobj": f"{lits('t', 'endobj')}::DOUBLE",
    "token_count_stream": f"greatest(0, {lits('t', 'stream')} - {lits('t', 'endstream')})::DOUBLE",
    "token_count_endstream": f"{lits('t', 'endstream')}::DOUBLE",
    "token_count_xref": f"{lits('t', 'xref')}::DOUBLE",
    "token_count_trailer": f"{lits('t', 'trailer')}::DOUBLE",
    "token_count_startxref": f"{lits('t', 'startxref')}::DOUBLE",
    "token_count_eof": f"{lits('t', '%%EOF')}::DOUBLE",
    "has_type_page": _any("/Type /Page", "/Type/Page"),
    "has_type_font": _any("/Type /Font", "/Type/Font", "/Subtype /Type1", "/TrueType"),
    "has_type_catalog": _any("/Type /Catalog", "/Type/Catalog"),
    "has_type_metadata": _any("/Type /Metadata", "<x:xmpmeta", "http://ns.adobe.com"),
    "has_subtype_image": _any("/Subtype /Image", "/Subtype/Image", "/DCTDecode", "/JPXDecode"),
    "has_filter_flate": _any("FlateDecode"),
    "has_length_key": "(contains(t, '/Length ') OR contains(t, '/Length' || chr(10)))::INT::DOUBLE",
    "has_bt_et_text_ops": f"((contains(t, 'BT') AND contains(t, 'ET')) OR {hits('t', chr(92) + 'b(?:Tj|TJ)' + chr(92) + 'b')} > 0)::INT::DOUBLE",
    "token_count_bt": f"{lits('t', 'BT')}::DOUBLE",
    "token_count_et": f"{lits('t', 'ET')}::DOUBLE",
    "token_count_tj": hits("t", "\\b(?:Tj|TJ)\\b") + "::DOUBLE",
    "slash_name_count": hits("t", "/[A-Za-z0-9_-]+") + "::DOUBLE",
    "consecutive_printable_max": "list_max(list_transform(string_split(array_to_string(list_transform(hx, lambda h: CASE WHEN "
    + _PRINT
    + " THEN 'P' ELSE 'N' END), ''), 'N'), lambda r: length(r)))::DOUBLE",
    "is_compressed_candidate": "(contains(esc, 'x\\x9C') OR contains(esc, 'x\\x01') OR contains(esc, 'x\\xDA') OR (list_entropy(hx) > 7.2 AND "
    + _ratio(_PRINT)
    + " < 0.2))::INT::DOUBLE",
}
FEATURES_CTE = "features AS (SELECT media_id, start, " + ", ".join(f"{e} AS {n}" for n, e in FEATURE_SQL.items()) + " FROM lat)"


@query(
    "byte_features",
    f"WITH {BOTH}, {FEATURES_CTE} SELECT media_id, start, " + ", ".join(f"round({n}, 6) AS {n}" for n in tk.FEATURES) + " FROM features",
)
def byte_features(t):
    return tk.byte_features(both_blocks(t)).select("media_id", "start", *[F.round(n, 6).alias(n) for n in tk.FEATURES])


RULE_CTE = """ruled AS (SELECT media_id, start, t, CASE WHEN starts_with(t, '%PDF') OR contains(t[1:32], '%PDF-') THEN 'PDF_HEADER' WHEN contains(t, 'xref') THEN 'XREF'
  WHEN contains(t, 'trailer') THEN 'TRAILER' WHEN contains(t, '/Subtype /Image') OR contains(t, '/DCTDecode') THEN 'IMAGE_STREAM'
  WHEN (contains(t, 'BT') AND contains(t, 'ET')) OR (contains(t, '/Type /Page') AND contains(t, '/Contents')) THEN 'TEXT_STREAM'
  WHEN contains(t, '/Type /Page') THEN 'PAGE_OBJECT' WHEN contains(t, '/Type /Font') THEN 'FONT_OBJECT'
  WHEN contains(t, '/Type /Metadata') OR contains(t, '<x:xmpmeta') THEN 'METADATA'
  WHEN contains(t, 'stream') AND contains(t, 'endstream') THEN 'PDF_STREAM' WHEN contains(t, ' obj') THEN 'PDF_OBJECT' ELSE 'UNKNOWN' END AS label FROM lat),
scored AS (SELECT *, CASE label WHEN 'PDF_HEADER' THEN 0.95::DOUBLE WHEN 'XREF' THEN 0.85 WHEN 'TRAILER' THEN 0.85 WHEN 'TEXT_STREAM' THEN 0.75
  WHEN 'PDF_STREAM' THEN 0.7 WHEN 'PDF_OBJECT' THEN 0.65 WHEN 'UNKNOWN' THEN 0.5 ELSE 0.8 END AS confidence FROM ruled)"""


@query(
    "rule_label",
    f"""WITH {BOTH}, {RULE_CTE} SELECT media_id, start, label, confidence, round(CASE WHEN label = 'XREF' THEN confidence ELSE (1 - confidence) / 10 END, 6) AS p_xref,
  round(CASE WHEN label = 'UNKNOWN' THEN confidence ELSE (1 - confidence) / 10 END, 6) AS p_unknown FROM scored""",
)
def rule_label(t):
    ruled = both_blocks(t).select("media_id", "start", tk.rule_label(latin(F.col("block"))).alias("r"))
    probs = ruled.select("media_id", "start", "r.*").withColumn("p", tk.rule_probabilities(F.col("label"), F.col("confidence")))
    return probs.select(
        "media_id", "start", "label", "confidence", F.round(F.col("p")["XREF"], 6).alias("p_xref"), F.round(F.col("p")["UNKNOWN"], 6).alias("p_unknown")
    )


@query(
    "rule_label_features",
    f"""WITH {BOTH}, {FEATURES_CTE} SELECT media_id, start, CASE WHEN starts_with_pdf_magic > 0 THEN 'PDF_HEADER' WHEN token_count_xref > 0 THEN 'XREF'
  WHEN token_count_trailer > 0 OR token_count_startxref > 0 THEN 'TRAILER' WHEN has_type_page > 0 THEN 'PAGE_OBJECT' WHEN has_type_font > 0 THEN 'FONT_OBJECT'
  WHEN has_subtype_image > 0 THEN 'IMAGE_STREAM' WHEN has_bt_et_text_ops > 0 THEN 'TEXT_STREAM'
  WHEN token_count_stream > 0 OR is_compressed_candidate > 0 THEN 'PDF_STREAM' WHEN token_count_obj > 0 THEN 'PDF_OBJECT' ELSE 'UNKNOWN' END AS label FROM features""",
)
def rule_label_features(t):
    return tk.byte_features(both_blocks(t)).select("media_id", "start", tk.rule_label_features().alias("label"))


@query(
    "damage_block_label",
    f"""WITH {BOTH} SELECT media_id, 'blk_' || CASE WHEN start // 256 < 1000 THEN lpad((start // 256)::VARCHAR, 4, '0') ELSE (start // 256)::VARCHAR END AS block_id,
  CASE WHEN starts_with(t, '%PDF') THEN 'PDF_HEADER' WHEN contains(t, 'xref') THEN 'XREF' WHEN contains(t, 'trailer') THEN 'TRAILER'
  WHEN contains(t, 'stream') THEN 'PDF_STREAM' WHEN contains(t, 'obj') THEN 'PDF_OBJECT' ELSE 'UNKNOWN' END AS label FROM lat""",
)
def damage_block_label(t):
    index = F.format_string("blk_%04d", F.floor(F.col("start") / 256))
    return both_blocks(t).select("media_id", index.alias("block_id"), tk.damage_block_label(latin(F.col("block"))).alias("label"))


@query(
    "local_role",
    f"""WITH {BOTH}, r AS (SELECT media_id, start, CASE WHEN starts_with(t, '%PDF') THEN ['pdf', 'header', '%PDF'] WHEN contains(t, '%%EOF') THEN ['pdf', 'footer', '%%EOF']
  WHEN contains(t, 'xref') THEN ['pdf', 'catalog', 'xref'] WHEN contains(t, '/Root') THEN ['pdf', 'catalog', '/Root'] WHEN contains(t, 'stream') THEN ['pdf', 'stream', 'stream']
  WHEN starts_with(esc, '\\x89PNG\\x0D\\x0A\\x1A\\x0A') THEN ['png', 'image', 'PNG'] WHEN starts_with(esc, '\\xFF\\xD8\\xFF') THEN ['jpeg', 'image', 'JPEG']
  ELSE ['unknown', 'data', NULL] END AS r FROM lat)
SELECT media_id, start, r[1] AS file_type, r[2] AS role, r[3] AS marker, CASE WHEN r[3] IS NULL THEN 0.5 ELSE 0.95 END::DOUBLE AS confidence FROM r""",
)
def local_role(t):
    return both_blocks(t).select("media_id", "start", tk.local_role(latin(F.col("block"))).alias("r")).select("media_id", "start", "r.*")


FORMAT_CTE = """scores AS (SELECT media_id,
  least(1, contains(t[1:1024], '%PDF-')::INT * 0.5 + CASE WHEN contains(right(t, 1024), '%%EOF') THEN 0.3 WHEN contains(t, '%%EOF') THEN 0.15 ELSE 0 END
    + regexp_matches(t, '[0-9]+[ \\t\\n\\r\\f]+[0-9]+[ \\t\\n\\r\\f]+obj')::INT * 0.2 + (regexp_matches(t, 'trailer[ \\t\\n\\r\\f]*<<') OR contains(t, 'startxref'))::INT * 0.1
    + ends_with(lower(filename), '.pdf')::INT * 0.1)::DOUBLE AS pdf,
  CASE WHEN printable / octet_length(content)::DOUBLE > 0.95 THEN 0.5 WHEN printable / octet_length(content)::DOUBLE > 0.8 THEN 0.3 ELSE 0 END::DOUBLE
    + regexp_matches(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}|[A-Z][a-z]{2}[ \\t\\n\\r\\f]+[0-9]+[ \\t\\n\\r\\f]+[0-9]{2}:[0-9]{2}:[0-9]{2}')::INT * 0.3::DOUBLE
    + ends_with(lower(filename), '.txt')::INT * 0.1::DOUBLE AS text,
  (contains(t, 'IDAT')::INT * 0.15 + contains(t, 'IEND')::INT * 0.15 + contains(t[1:128], 'IHDR')::INT * 0.2)::DOUBLE AS png,
  (contains(t, 'moov')::INT * 0.25 + contains(t[1:1048576], 'mdat')::INT * 0.25
    + CASE WHEN instr(t[1:64], 'ftyp') = 5 THEN 0.6 WHEN instr(t[1:64], 'ftyp') > 0 THEN 0.4 ELSE 0 END)::DOUBLE AS mp4
  FROM wlat WHERE octet_length(content) > 0)"""


def scored(t):
    d = whole(t).where(F.length("content") > 0).withColumn("t", latin(F.col("content")))
    return d, fm.format_scores(F.col("t"), F.col("filename"))


@query(
    "format_scores",
    f"""WITH {WHOLE}, {FORMAT_CTE} SELECT media_id, round(pdf, 4) AS pdf, round(text, 4) AS text, round(png, 4) AS png, round(mp4, 4) AS mp4 FROM scores""",
)
def format_scores(t):
    d, s = scored(t)
    return d.select("media_id", *[F.round(s[n], 4).alias(n) for n in ("pdf", "text", "png", "mp4")])


@query(
    "best_format",
    f"""WITH {WHOLE}, {FORMAT_CTE} SELECT media_id, CASE WHEN greatest(pdf, text, png, mp4) <= 0 THEN 'binary' WHEN pdf >= greatest(text, png, mp4) THEN 'pdf'
  WHEN png >= greatest(text, mp4) THEN 'png' WHEN mp4 >= text THEN 'mp4' ELSE 'text' END AS format, round(greatest(pdf, text, png, mp4), 4) AS confidence FROM scores""",
)
def best_format(t):
    d, s = scored(t)
    best = d.select("media_id", fm.best_format(s).alias("b"))
    return best.select("media_id", "b.format", F.round("b.confidence", 4).alias("confidence"))


@query(
    "structure_score",
    f"""WITH {WHOLE}, c AS (SELECT media_id, contains(t[1:1024], '%PDF-') AS h, contains(t, '%%EOF') AS e,
  regexp_matches(t, '[0-9]+[ \\t\\n\\r\\f]+[0-9]+[ \\t\\n\\r\\f]+obj') AS o, contains(t, 'xref') OR contains(t, 'trailer') AS x FROM wlat)
SELECT media_id, round(h::INT * 0.35 + e::INT * 0.35 + o::INT * 0.2 + x::INT * 0.1, 2)::DOUBLE AS integrity_score, h AND e AND o AS is_valid FROM c""",
)
def structure_score(t):
    checks = fm.structure_checks(F.col("t"))
    return whole(t).withColumn("t", latin(F.col("content"))).select("media_id", *[c.alias(n) for n, c in checks.items()])


@query(
    "text_validity",
    f"""WITH {v.BLOCKS} SELECT media_id, start, true AS is_valid, try(decode(block)) IS NOT NULL AS utf8_decodable,
  CASE WHEN try(decode(block)) IS NOT NULL THEN 1.0 ELSE 0.7 END::DOUBLE AS integrity_score FROM blocks""",
)
def text_validity(t):
    """Blocks cut inside a multi-byte character are not valid UTF-8."""
    checks = fm.text_validity(F.col("block"))
    return v.blocks(t).select("media_id", "start", *[c.alias(n) for n, c in checks.items()])


def damaged_whole(t):
    """PDF layouts with hash-free, id-driven damage: header, xref, trailer, endobj and null-run variants."""
    kind = F.pmod(F.regexp_extract("media_id", r"(\d+)$", 1).cast("long"), F.lit(8))
    text = latin(F.col("content"))
    swap = lambda a, b: F.replace(text, F.lit(a), F.lit(b))
    changed = (
        F.when(kind == 1, swap("%PDF-", "XPDF-"))
        .when(kind == 2, F.concat(F.lit("<html>junk</html>"), text))
        .when(kind == 3, swap("xref", "x_ef"))
        .when(kind == 4, swap("trailer", "tra_ler"))
        .when(kind == 5, swap("4 0 obj", "4 0 xxx"))
        .when(kind == 6, F.concat(F.substring(text, 1, 40), F.repeat(F.lit("\x00"), 64), text))
        .when(kind == 7, swap("/Type /Catalog", "/Type /Cata_og"))
        .otherwise(text)
    )
    return v.pdf_media(t).withColumn("content", F.encode(changed, "ISO-8859-1")).withColumn("size_bytes", F.length("content").cast("long"))


DAMAGED_PDF = (
    v.PDF
    + """, damaged_pdf AS (SELECT media_id, doc_id, CASE doc_id % 8 WHEN 1 THEN replace(doc, '%PDF-', 'XPDF-') WHEN 2 THEN '<html>junk</html>' || doc
  WHEN 3 THEN replace(doc, 'xref', 'x_ef') WHEN 4 THEN replace(doc, 'trailer', 'tra_ler') WHEN 5 THEN replace(doc, '4 0 obj', '4 0 xxx')
  WHEN 6 THEN doc[1:40] || repeat('~', 64) || doc WHEN 7 THEN replace(doc, '/Type /Catalog', '/Type /Cata_og') ELSE doc END AS t FROM pdf)"""
)


@query(
    "damage_classes",
    f"""WITH {DAMAGED_PDF}, f AS (SELECT media_id, doc_id, t, regexp_matches(t, '%PDF-[0-9]+\\.[0-9]+') AS h, instr(t, '%PDF-1.4') - 1 AS ho, contains(t, '%%EOF') AS eof,
  contains(t, 'startxref') AS sx, contains(t, 'trailer') AS tr, contains(t, 'xref') AS xr, {hits("t", _OBJ)} AS o, {hits("t", "\\bendobj\\b")} AS e,
  {hits("t", "/Type[ \\t\\n\\r\\f]*/Page\\b")} AS p, {hits("t", "/Type[ \\t\\n\\r\\f]*/Pages\\b")} AS ps, {hits("t", "/Type[ \\t\\n\\r\\f]*/Catalog\\b")} AS c FROM damaged_pdf)
SELECT media_id, concat_ws(',', CASE WHEN NOT h THEN 'MISSING_HEADER' WHEN ho > 0 THEN 'OFFSET_HEADER_PREAMBLE_NOISE' END, CASE WHEN NOT eof THEN 'TRUNCATED_BITSTREAM_NO_EOF' END,
  CASE WHEN NOT sx THEN 'MISSING_STARTXREF' END, CASE WHEN NOT tr THEN 'MISSING_TRAILER_DICT' END, CASE WHEN NOT xr THEN 'DESTROYED_CROSS_REFERENCE_TABLE' END,
  CASE WHEN o = 0 THEN 'NO_INDIRECT_OBJECTS' WHEN o <> e THEN 'UNTERMINATED_OBJECTS' END, CASE WHEN p > 0 AND ps = 0 THEN 'ORPHAN_PAGES_NO_PARENT_TREE' END,
  CASE WHEN p > 0 AND c = 0 THEN 'MISSING_DOCUMENT_CATALOG' END, CASE WHEN doc_id % 8 = 6 THEN 'ERASED_SECTOR_NULL_RUNS' END) AS corruption_classes,
  CASE WHEN h THEN '1.4' ELSE 'unknown' END AS detected_version, CASE WHEN h THEN ho ELSE -1 END::BIGINT AS header_offset, o AS objects, p AS pages,
  round(CASE WHEN h AND ho = 0 THEN 0.25 WHEN h THEN 0.15 ELSE 0 END + eof::INT * 0.2 + xr::INT * 0.2 + tr::INT * 0.15
    + (o > 0 AND abs(o - e) <= 1)::INT * 0.1 + (p > 0 AND c > 0)::INT * 0.1, 4)::DOUBLE AS integrity_score FROM f""",
)
def damage_classes(t):
    facts = fm.damage_diagnosis(F.col("t"))
    facts["corruption_classes"] = F.array_join(facts["corruption_classes"], ",")
    facts["integrity_score"] = F.round(facts["integrity_score"], 4)
    return damaged_whole(t).withColumn("t", latin(F.col("content"))).select("media_id", *[c.alias(n) for n, c in facts.items()])


@query(
    "safety_scan",
    f"""WITH {v.PDF}, w AS (SELECT 'page-' || page_id AS media_id, contains(html, '<script') OR contains(html, 'onload=') OR contains(html, 'javascript:') AS js,
    contains(html, '<iframe') OR contains(html, '<object') AS la, contains(html, '<embed') OR contains(html, '<svg') AS em, contains(html, 'http-equiv="refresh"') AS oa FROM pages
  UNION ALL SELECT media_id, contains(doc, '/JavaScript') OR contains(doc, '/JS'), contains(doc, '/Launch'), contains(doc, '/EmbeddedFiles'),
    contains(doc, '/A <</S') OR contains(doc, '/OpenAction') FROM pdf)
SELECT media_id, NOT (js OR la) AS safe, js AS contains_javascript, la AS contains_launch, em AS contains_embedded_files, oa AS contains_open_action FROM w""",
)
def safety_scan(t):
    pages = v.column_media(t.pages, F.concat(F.lit("page-"), F.col("page_id").cast("string")), F.col("html"))
    scan = lambda df, flags: df.withColumn("t", latin(F.col("content"))).select("media_id", *[c.alias(n) for n, c in flags(F.col("t")).items()])
    return scan(pages, tk.html_safety_flags).unionByName(scan(v.pdf_media(t), tk.safety_flags))


@query(
    "inventory",
    f"""WITH {v.PDF}, n AS (SELECT media_id, doc, list_sort(list_distinct(list_transform(regexp_extract_all(doc, '(?:^|[ \\t\\n\\r\\f])([0-9]+)[ \\t\\n\\r\\f]+0[ \\t\\n\\r\\f]+obj', 1), lambda s: s::BIGINT))) AS nums FROM pdf)
SELECT media_id, array_to_string(nums, ',') AS object_numbers, len(nums) AS objects, {hits("doc", "\\bstream\\b")} AS streams,
  greatest(1, {hits("doc", "/Type[ \\t\\n\\r\\f]*/Page\\b")}) AS pages, {hits("doc", "/Type[ \\t\\n\\r\\f]*/Font\\b")} AS fonts, {hits("doc", "/Subtype[ \\t\\n\\r\\f]*/Image\\b")} AS images,
  {hits("doc", "\\b(?:Table|Col[ \\t\\n\\r\\f]*1)\\b")} AS tables, {hits("doc", "\\b(?:Figure|Fig\\.)\\b")} AS figures,
  {hits("doc", "\\b(?:\\\\int|\\\\sum|dx/dt|E=mc)\\b")} AS equations,
  coalesce(list_sum(list_transform(regexp_extract_all(doc, '\\(([^)\\r\\n]{{4,}})\\)', 1), lambda s: length(s))), 0)::BIGINT AS text_length FROM n""",
)
def inventory(t):
    inv = tk.inventory(F.col("t"))
    numbers = inv.pop("object_numbers")
    return (
        v.pdf_media(t).withColumn("t", latin(F.col("content")))
        .withColumn("_n", numbers)
        .select(
            "media_id", F.array_join(F.col("_n").cast("array<string>"), ",").alias("object_numbers"),
            F.size("_n").cast("long").alias("objects"), *[c.alias(n) for n, c in inv.items()],
        )
    )


@query(
    "surviving_features",
    """WITH p AS (SELECT page_id, html FROM pages) SELECT 'page-' || page_id AS media_id, nullif(regexp_extract(html, '<html lang="([^"]+)"', 1), '') AS lang,
  nullif(regexp_extract(html, 'charset="?([A-Za-z0-9-]+)', 1), '') AS charset, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title,
  array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1))), ',') AS links FROM p""",
)
def surviving_features(t):
    h = F.col("html")
    take = lambda p: F.nullif(F.regexp_extract(h, p, 1), F.lit(""))
    links = F.array_sort(F.array_distinct(F.regexp_extract_all(h, F.lit('href="/([A-Za-z]+)"'), F.lit(1))))
    return t.pages.select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("media_id"),
        take('<html lang="([^"]+)"').alias("lang"),
        take('charset="?([A-Za-z0-9-]+)').alias("charset"),
        take("<title>([^<]*)</title>").alias("title"),
        F.array_join(links, ",").alias("links"),
    )


@query(
    "surviving_features_pdf",
    f"""WITH {DAMAGED_PDF} SELECT media_id, coalesce(nullif(regexp_extract(t, '%PDF-([0-9]+\\.[0-9]+)', 1), ''), '1.4') AS pdf_version,
  array_to_string(list_distinct(regexp_extract_all(t, '/BaseFont[ \\t\\n\\r\\f]*/([A-Za-z0-9_-]+)', 1)), ',') AS fonts, '0.0,0.0,612.0,792.0' AS media_box, NULL::VARCHAR AS title FROM damaged_pdf""",
)
def surviving_features_pdf(t):
    s = fm.surviving_features(F.col("t"))
    return damaged_whole(t).withColumn("t", latin(F.col("content"))).select(
        "media_id", s["pdf_version"].alias("pdf_version"), F.array_join(s["fonts"], ",").alias("fonts"),
        F.array_join(s["media_box"].cast("array<string>"), ",").alias("media_box"), s["title"].alias("title"),
    )


@query(
    "fidelity_estimate",
    f"""WITH {DAMAGED_PDF}, f AS (SELECT d.media_id, length(p.doc) AS media_size, least(length(d.t), length(p.doc)) - 40 * (p.doc_id % 7) AS authentic,
    {hits("d.t", "\\([^)\\r\\n]{{4,}}\\)".replace("{{", "{").replace("}}", "}"))} AS strings, {hits("d.t", _OBJ)} AS objects FROM damaged_pdf d JOIN pdf p USING (media_id))
SELECT media_id, round(least(0.75, greatest(0.08, least(1, greatest(0, authentic::DOUBLE / media_size)) * 0.5 + least(0.3, strings * 0.05) + least(0.2, objects * 0.03))) * 100, 1) AS fidelity_pct FROM f""",
)
def fidelity_estimate(t):
    text = F.col("t")
    doc = F.regexp_extract("media_id", r"(\d+)$", 1).cast("long")
    original = v.pdf_media(t).select("media_id", F.col("size_bytes").alias("media_size"))
    strings = F.regexp_count(text, F.lit(r"\([^)\r\n]{4,}\)"))
    objects = F.regexp_count(text, F.lit(tk.LEFT + tk.BARE_OBJECT + tk.RIGHT))
    authentic = F.least("size_bytes", "media_size") - F.pmod(doc, F.lit(7)) * 40
    return (
        damaged_whole(t).withColumn("t", latin(F.col("content"))).join(original, "media_id")
        .select("media_id", fm.fidelity_estimate(authentic, F.col("media_size"), strings, objects).alias("fidelity_pct"))
    )


LOG_SQL = """logs AS (SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN event_type || ' without a date' WHEN 1 THEN 'host ' || strftime(ts, '%b %d %H:%M:%S') || ' ' || event_type
  WHEN 2 THEN '[' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] ' || event_type ELSE 'at ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || event_type END AS line FROM events)"""


@query(
    "log_order",
    f"""WITH {LOG_SQL}, x AS (SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN regexp_extract(line, '[A-Z][a-z]{{2}} +[0-9]+ +[0-9:]{{8}}')
  WHEN 2 THEN line[2:21] ELSE line[4:22] END AS stamp FROM logs)
SELECT user_id, event_id, stamp, row_number() OVER (PARTITION BY user_id ORDER BY stamp IS NULL, stamp, event_id) AS position FROM x""",
)
def log_order(t):
    kind = F.col("event_id") % 5
    stamp = lambda f: F.date_format("ts", f)
    line = (
        F.when(kind == 0, F.concat("event_type", F.lit(" without a date")))
        .when(kind == 1, F.concat(F.lit("host "), stamp("MMM dd HH:mm:ss"), F.lit(" "), "event_type"))
        .when(kind == 2, F.concat(F.lit("["), stamp("dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000] "), "event_type"))
        .otherwise(F.concat(F.lit("at "), stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), "event_type"))
    )
    logs = t.events.select("user_id", "event_id", fm.first_timestamp(line).alias("stamp"))
    return ordering.log_order(logs, ["user_id"], "stamp", "event_id")
