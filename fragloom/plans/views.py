"""Inputs the registered queries derive from the given tables, in Spark and as DuckDB CTE texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fragloom.operators import damage, fragments as fr
from fragloom.plans.registry import Tables
from fragloom.sources.media import column_media

# ---- documents.text as media bytes -------------------------------------------------------------

MEDIA = "media AS (SELECT 'doc-' || doc_id AS media_id, doc_id, encode(text) AS content FROM documents)"
BLOCKS = (
    MEDIA
    + """, blocks AS (
  SELECT media_id, doc_id, s AS start, least(s + 256, octet_length(content))::BIGINT AS "end",
         content[s + 1:s + 256] AS block
  FROM (SELECT *, unnest(generate_series(0, octet_length(content)::BIGINT - 1, 256)) AS s FROM media))"""
)
FRAGMENTS = (
    BLOCKS
    + """, fragments AS (
  SELECT *, octet_length(block)::BIGINT AS size_bytes, sha256(block) AS sha256,
         'FRG-' || sha256(block)[1:16] || '-' || start || '-' || "end" AS fragment_id FROM blocks)"""
)


def media(t: Tables) -> DataFrame:
    return column_media(t.documents, F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.col("text"))


def blocks(t: Tables) -> DataFrame:
    return fr.carve_blocks(media(t))


def fragments(t: Tables) -> DataFrame:
    return fr.identify(blocks(t))


# ---- a damaged copy: one run of 256-byte blocks zeroed per document ------------------------------

DAMAGED_CTE = """damaged AS (
  SELECT media_id, doc_id, o AS zero_start, z AS zero_end,
         content[1:o] || CASE WHEN z > o THEN unhex(repeat('00', z - o)) ELSE ''::BLOB END || content[z + 1:] AS content
  FROM (SELECT *, least(256 * (doc_id % 5), octet_length(content) - 1) AS o,
               least(least(256 * (doc_id % 5), octet_length(content) - 1) + 256 + 200 * (doc_id % 4),
                     octet_length(content)) AS z
        FROM media WHERE octet_length(content) > 0))"""
DAMAGED = MEDIA + ", " + DAMAGED_CTE


def damaged(t: Tables) -> DataFrame:
    doc = F.regexp_extract("media_id", r"doc-(\d+)", 1).cast("long")
    source = media(t).withColumn("_doc", doc)
    return damage.apply(
        source, "zero", F.pmod(F.col("_doc"), F.lit(5)) * 256, F.pmod(F.col("_doc"), F.lit(4)) * 200 + 256
    ).select("media_id", "base_offset", F.length("content").cast("long").alias("size_bytes"), "content")


# ---- the same texts laid out as PDF files, so that the token operators meet real tokens ----------

PDF = r"""pdf_lines AS (
  SELECT doc_id, i - 1 AS i, n, regexp_replace(line, '[^ -~]|[()\\]', '?', 'g') AS line FROM (
    SELECT doc_id, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
pdf_objects AS (
  SELECT DISTINCT doc_id, 1 AS k, '1 0 obj' || chr(10) || '<< /Type /Catalog /Pages 2 0 R >>' || chr(10) || 'endobj' || chr(10) AS obj
  FROM pdf_lines
  UNION ALL SELECT doc_id, 2, '2 0 obj' || chr(10) || '<< /Type /Pages /Kids [' || string_agg((4 + 2 * i) || ' 0 R', ' ' ORDER BY i)
    || '] /Count ' || count(*) || ' >>' || chr(10) || 'endobj' || chr(10) FROM pdf_lines GROUP BY doc_id
  UNION ALL SELECT DISTINCT doc_id, 3, '3 0 obj' || chr(10) || '<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>' || chr(10)
    || 'endobj' || chr(10) FROM pdf_lines
  UNION ALL SELECT doc_id, 4 + 2 * i, (4 + 2 * i) || ' 0 obj' || chr(10) || '<< /Type /Page /Parent 2 0 R /Contents ' || (5 + 2 * i)
    || ' 0 R /Resources << /Font << /F1 3 0 R >> >> >>' || chr(10) || 'endobj' || chr(10) FROM pdf_lines
  UNION ALL SELECT doc_id, 5 + 2 * i, (5 + 2 * i) || ' 0 obj' || chr(10) || '<< /Length ' || (length(line) + 22) || ' >>' || chr(10)
    || 'stream' || chr(10) || 'BT /F1 12 Tf (' || line || ') Tj ET' || chr(10) || 'endstream' || chr(10) || 'endobj' || chr(10) FROM pdf_lines),
pdf_placed AS (
  SELECT *, 9 + coalesce(sum(length(obj)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM pdf_objects),
pdf AS (
  SELECT doc_id, 'pdf-' || doc_id AS media_id,
    '%PDF-1.4' || chr(10) || string_agg(obj, '' ORDER BY k) || 'xref' || chr(10) || '0 ' || (count(*) + 1) || chr(10)
    || '0000000000 65535 f ' || chr(10) || string_agg(lpad(off::VARCHAR, 10, '0') || ' 00000 n ' || chr(10), '' ORDER BY k)
    || 'trailer' || chr(10) || '<< /Size ' || (count(*) + 1) || ' /Root 1 0 R >>' || chr(10) || 'startxref' || chr(10)
    || (9 + sum(length(obj))) || chr(10) || '%%EOF' || chr(10) AS doc
  FROM pdf_placed GROUP BY doc_id)"""
PDF_BLOCKS = (
    PDF
    + """, pdf_blocks AS (
  SELECT media_id, doc_id, s AS start, least(s + 256, length(doc))::BIGINT AS "end", doc[s + 1:s + 256] AS block
  FROM (SELECT *, unnest(generate_series(0, length(doc)::BIGINT - 1, 256)) AS s FROM pdf)),
pdf_fragments AS (
  SELECT *, length(block)::BIGINT AS size_bytes, sha256(block) AS sha256,
         'FRG-' || sha256(block)[1:16] || '-' || start || '-' || "end" AS fragment_id FROM pdf_blocks)"""
)


def pdf_media(t: Tables) -> DataFrame:
    num = lambda c: c.cast("string")
    lines = F.transform(
        F.split("text", "\n", -1), lambda s: F.regexp_replace(s, r"[^ -~]|[()\\]", "?")
    )
    page = lambda i: F.concat(
        num(i * 2 + 4), F.lit(" 0 obj\n<< /Type /Page /Parent 2 0 R /Contents "), num(i * 2 + 5),
        F.lit(" 0 R /Resources << /Font << /F1 3 0 R >> >> >>\nendobj\n"),
    )
    content = lambda s, i: F.concat(
        num(i * 2 + 5), F.lit(" 0 obj\n<< /Length "), num(F.length(s) + 22),
        F.lit(" >>\nstream\nBT /F1 12 Tf ("), s, F.lit(") Tj ET\nendstream\nendobj\n"),
    )
    kids = F.array_join(F.transform("_lines", lambda s, i: F.concat(num(i * 2 + 4), F.lit(" 0 R"))), " ")
    objects = F.concat(
        F.array(
            F.lit("1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"),
            F.concat(F.lit("2 0 obj\n<< /Type /Pages /Kids ["), kids, F.lit("] /Count "), num(F.size("_lines")),
                     F.lit(" >>\nendobj\n")),
            F.lit("3 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>\nendobj\n"),
        ),
        F.flatten(F.transform("_lines", lambda s, i: F.array(page(i), content(s, i)))),
    )
    placed = F.aggregate(
        "_objects",
        F.struct(F.lit(9).alias("off"), F.lit("").alias("tab")),
        lambda a, o: F.struct(
            (a["off"] + F.length(o)).alias("off"),
            F.concat(a["tab"], F.lpad(num(a["off"]), 10, "0"), F.lit(" 00000 n \n")).alias("tab"),
        ),
    )
    total = num(F.size("_objects") + 1)
    text = F.concat(
        F.lit("%PDF-1.4\n"), F.array_join("_objects", ""), F.lit("xref\n0 "), total,
        F.lit("\n0000000000 65535 f \n"), F.col("_placed.tab"), F.lit("trailer\n<< /Size "), total,
        F.lit(" /Root 1 0 R >>\nstartxref\n"), num(F.col("_placed.off")), F.lit("\n%%EOF\n"),
    )
    laid = (
        t.documents.select("doc_id", lines.alias("_lines"))
        .withColumn("_objects", objects)
        .withColumn("_placed", placed)
        .withColumn("_text", text)
    )
    return column_media(laid, F.concat(F.lit("pdf-"), num(F.col("doc_id"))), F.col("_text"))


def pdf_fragments(t: Tables) -> DataFrame:
    return fr.identify(fr.carve_blocks(pdf_media(t)))
