"""Structural assembly, integrity, carving and harvest queries over PDF layouts of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragloom.functions import tokens as tk
from fragloom.functions.blob import latin
from fragloom.operators import assemble as asm, chunks as ck, fragments as fr, recovery as rc
from fragloom.operators.scale import materialize, running_total
from fragloom.plans import views as v
from fragloom.plans.registry import query

CHUNK = 4096  # bytes of the pieces in which the queries read media

# ---- fragments cut at structural borders, some of them lost, doubled or changed ------------------------

PARTS = f"""{v.PDF}, pieces AS (SELECT media_id, doc_id, unnest(string_split(regexp_replace(regexp_replace(doc, '(endobj\\n|%PDF-1.4\\n)', '\\1' || chr(1), 'g'), '\\n(trailer|startxref|%%EOF)', chr(10) || chr(1) || '\\1', 'g'), chr(1))) AS piece,
    generate_subscripts(string_split(regexp_replace(regexp_replace(doc, '(endobj\\n|%PDF-1.4\\n)', '\\1' || chr(1), 'g'), '\\n(trailer|startxref|%%EOF)', chr(10) || chr(1) || '\\1', 'g'), chr(1)), 1)::BIGINT - 1 AS seq FROM pdf),
kept AS (SELECT media_id, doc_id, seq, CASE WHEN doc_id % 6 = 5 THEN replace(piece, 'Helvetica', 'Helvetixx') ELSE piece END AS piece FROM pieces
    WHERE NOT (doc_id % 6 = 1 AND starts_with(piece, '4 0 obj')) AND NOT (doc_id % 6 = 3 AND seq = 0) AND NOT (doc_id % 6 = 4 AND starts_with(piece, 'xref'))
  UNION ALL SELECT media_id, doc_id, seq + 100000, piece || ' ' FROM pieces WHERE doc_id % 6 = 2 AND starts_with(piece, '3 0 obj')
  UNION ALL SELECT media_id, doc_id, seq + 200000, 'plain words' FROM pieces WHERE doc_id % 12 = 6 AND seq = 0),
prof AS (SELECT media_id, doc_id, seq, piece, 'FRG-' || sha256(piece)[1:16] || '-' || seq || '-' || (seq + 1) AS fragment_id,
  CASE WHEN contains(piece, '%PDF-') THEN 'header' WHEN contains(piece, '%%EOF') THEN 'eof' WHEN starts_with(piece, 'startxref') THEN 'startxref' WHEN starts_with(piece, 'trailer') THEN 'trailer'
    WHEN starts_with(piece, 'xref') THEN 'xref' WHEN regexp_matches(piece, '^[0-9]+ 0 obj') THEN 'object' ELSE 'unknown' END AS kind,
  CASE WHEN regexp_matches(piece, '^[0-9]+ 0 obj') THEN regexp_extract(piece, '^([0-9]+)', 1)::BIGINT END AS num FROM kept),
facts AS (SELECT media_id, count(*) AS fragments, count(*) FILTER (kind = 'header') AS header_n, count(*) FILTER (kind = 'xref') AS xref_n, count(*) FILTER (kind = 'trailer') AS trailer_n,
  count(*) FILTER (kind = 'startxref') AS startxref_n, count(*) FILTER (kind = 'eof') AS eof_n, count(num) AS objects, count(DISTINCT num) AS distinct_objects, min(num) AS lo, max(num) AS hi,
  count(DISTINCT num) = count(num) AND max(num) - min(num) + 1 = count(num) AS clean FROM prof GROUP BY media_id),
one AS (SELECT f.media_id, h.fragment_id AS header, x.fragment_id AS xref, t.fragment_id AS trailer, s.fragment_id AS startxref, e.fragment_id AS eof,
  CASE WHEN objects = distinct_objects THEN a.fragment_id END AS first_object, CASE WHEN objects = distinct_objects THEN z.fragment_id END AS last_object
  FROM facts f LEFT JOIN prof h ON h.media_id = f.media_id AND h.kind = 'header' AND header_n = 1 LEFT JOIN prof x ON x.media_id = f.media_id AND x.kind = 'xref' AND xref_n = 1
  LEFT JOIN prof t ON t.media_id = f.media_id AND t.kind = 'trailer' LEFT JOIN prof s ON s.media_id = f.media_id AND s.kind = 'startxref' LEFT JOIN prof e ON e.media_id = f.media_id AND e.kind = 'eof'
  LEFT JOIN prof a ON a.media_id = f.media_id AND a.num = f.lo AND objects = distinct_objects LEFT JOIN prof z ON z.media_id = f.media_id AND z.num = f.hi AND objects = distinct_objects),
edges AS (SELECT media_id, 'header_to_first_object' AS rule, header AS from_id, first_object AS to_id FROM one WHERE header IS NOT NULL AND first_object IS NOT NULL
  UNION ALL SELECT media_id, 'last_object_to_xref', last_object, xref FROM one WHERE xref IS NOT NULL AND last_object IS NOT NULL
  UNION ALL SELECT media_id, 'xref_to_trailer', xref, trailer FROM one WHERE xref IS NOT NULL UNION ALL SELECT media_id, 'trailer_to_startxref', trailer, startxref FROM one
  UNION ALL SELECT media_id, 'startxref_to_eof', startxref, eof FROM one
  UNION ALL SELECT a.media_id, 'object_ascending_chain', a.fragment_id, b.fragment_id FROM prof a JOIN prof b ON a.media_id = b.media_id AND b.num = a.num + 1 JOIN facts f ON f.media_id = a.media_id AND f.clean),
walked AS (SELECT p.media_id, p.fragment_id, p.piece, p.kind, row_number() OVER (PARTITION BY p.media_id ORDER BY seq) - 1 AS position FROM prof p JOIN facts f USING (media_id)
  WHERE p.kind <> 'unknown' AND header_n = 1 AND CASE WHEN NOT coalesce(clean, false) THEN p.kind = 'header' OR (objects = distinct_objects AND num = lo) ELSE xref_n = 1 OR p.kind IN ('header', 'object') END)"""


def pieces(t):
    """PDF layout cut after header and objects and before trailer, startxref and EOF."""
    text = latin(F.col("content"))
    marked = text
    for mark in ("endobj\n", "%PDF-1.4\n"):
        marked = F.replace(marked, F.lit(mark), F.lit(mark + "\x01"))
    for mark in ("trailer", "startxref", "%%EOF"):
        marked = F.replace(marked, F.lit("\n" + mark), F.lit("\n\x01" + mark))
    d = v.pdf_media(t).select("media_id", F.regexp_extract("media_id", r"(\d+)$", 1).cast("long").alias("doc_id"), F.posexplode_outer(F.split(marked, "\x01")).alias("seq", "piece"))
    return d.where("piece is not null").withColumn("seq", F.col("seq").cast("long"))


def parts(t):
    p = pieces(t)
    k = F.pmod(F.col("doc_id"), F.lit(6))
    starts = lambda s: F.startswith("piece", F.lit(s))
    kept = p.where(~((k == 1) & starts("4 0 obj")) & ~((k == 3) & (F.col("seq") == 0)) & ~((k == 4) & starts("xref")))
    kept = kept.withColumn("declared", F.col("piece")).withColumn("piece", F.when(k == 5, F.replace("piece", F.lit("Helvetica"), F.lit("Helvetixx"))).otherwise(F.col("piece")))
    twin = p.where((k == 2) & starts("3 0 obj")).select("media_id", "doc_id", (F.col("seq") + 100000).alias("seq"), F.concat("piece", F.lit(" ")).alias("declared"), F.concat("piece", F.lit(" ")).alias("piece"))
    noise = p.where((F.pmod(F.col("doc_id"), F.lit(12)) == 6) & (F.col("seq") == 0)).select("media_id", "doc_id", (F.col("seq") + 200000).alias("seq"), F.lit("plain words").alias("declared"), F.lit("plain words").alias("piece"))
    d = kept.unionByName(twin).unionByName(noise).withColumn("block", F.encode("piece", "ISO-8859-1")).withColumn("declared", F.encode("declared", "ISO-8859-1"))
    fid = F.format_string("FRG-%s-%d-%d", F.substring(F.sha2("block", 256), 1, 16), F.col("seq"), F.col("seq") + 1)
    return tk.profile_blocks(d.withColumn("fragment_id", fid).drop("piece"))


def profiles(t):
    return t.once("part_profiles", lambda: materialize(parts(t).drop("block", "declared")))


def with_facts(t):
    p = profiles(t)
    return p, t.once("part_facts", lambda: materialize(asm.media_facts(p)))


@query("structural_edges", f"WITH {PARTS} SELECT media_id, rule, from_id, to_id FROM edges")
def structural_edges(t):
    p, f = with_facts(t)
    return asm.structural_edges(p, f)


@query("object_chain", f"WITH {PARTS} SELECT media_id, rule, from_id, to_id FROM edges WHERE rule = 'object_ascending_chain'")
def object_chain(t):
    p, f = with_facts(t)
    return asm.object_chain(p, f)


GAPS = "gaps AS (SELECT media_id, before + 1 AS first_number, num - 1 AS last_number FROM (SELECT media_id, num, lag(num) OVER (PARTITION BY media_id ORDER BY num) AS before FROM (SELECT DISTINCT media_id, num FROM prof WHERE num IS NOT NULL)) WHERE num > before + 1)"


@query("numbers_missing", f"WITH {PARTS}, {GAPS} SELECT media_id, first_number, last_number FROM gaps")
def numbers_missing(t):
    return asm.numbers_missing(profiles(t))


@query("numbers_duplicated", f"WITH {PARTS} SELECT media_id, num AS object_number FROM prof WHERE num IS NOT NULL GROUP BY media_id, num HAVING count(*) > 1")
def numbers_duplicated(t):
    return asm.numbers_duplicated(parts(t))


@query("first_last_object", f"WITH {PARTS} SELECT media_id, first_object, last_object FROM one")
def first_last_object(t):
    return asm.first_last_object(asm.media_facts(parts(t)))


@query("unresolved_joins", f"""WITH {PARTS} SELECT media_id, 'header_to_first_object' AS rule, header_n AS candidates FROM facts WHERE header_n <> 1
UNION ALL SELECT media_id, r, xref_n FROM facts, (VALUES ('xref_to_trailer'), ('last_object_to_xref')) x(r) WHERE xref_n <> 1
UNION ALL SELECT media_id, r, objects FROM facts, (VALUES ('header_to_first_object', 1), ('last_object_to_xref', 2)) x(r, k) WHERE objects <> distinct_objects AND CASE k WHEN 1 THEN header_n = 1 ELSE xref_n = 1 END
UNION ALL SELECT media_id, 'object_ascending_chain', objects FROM facts WHERE NOT clean""")
def unresolved_joins(t):
    return asm.unresolved_joins(asm.media_facts(parts(t))).select("media_id", "rule", "candidates")


@query("missing_elements", f"""WITH {PARTS}, {GAPS} SELECT media_id, 'missing structural fragment: header (%PDF-)' AS element FROM facts WHERE header_n = 0
UNION ALL SELECT media_id, 'missing structural fragment: cross-reference table (xref)' FROM facts WHERE xref_n = 0
UNION ALL SELECT media_id, CASE WHEN first_number = last_number THEN 'missing object: ' || first_number ELSE 'missing objects: ' || first_number || ' to ' || last_number END FROM gaps""")
def missing_elements(t):
    p, f = with_facts(t)
    return asm.missing_elements(p, f)


@query("conflicting_fragments", f"WITH {PARTS} SELECT media_id, fragment_id FROM prof WHERE num IS NOT NULL AND (media_id, num) IN (SELECT media_id, num FROM prof WHERE num IS NOT NULL GROUP BY media_id, num HAVING count(*) > 1)")
def conflicting_fragments(t):
    p, f = with_facts(t)
    return asm.conflicting_fragments(p, f)


def chained(t):
    p, f = with_facts(t)
    e = t.once("part_edges", lambda: materialize(asm.structural_edges(p, f)))
    return p, f, e, t.once("part_chain", lambda: asm.chain_walk(e, f))


@query("chain_walk", f"WITH {PARTS} SELECT media_id, position, fragment_id FROM walked")
def chain_walk(t):
    return chained(t)[3]


STATES = f"""{PARTS}, placed AS (SELECT media_id, count(*) AS placed, bool_or(kind = 'eof') AS at_end FROM walked GROUP BY media_id),
whole AS (SELECT f.media_id, fragments, coalesce(placed, 0) AS placed, CASE WHEN coalesce(placed, 0) = 0 THEN 'UNRECOVERABLE'
  WHEN doc_id % 6 = 5 THEN 'CORRUPTED' WHEN placed < fragments OR NOT clean OR header_n <> 1 OR xref_n <> 1 THEN 'PARTIAL' ELSE 'COMPLETE AND VERIFIED' END AS recovery_state FROM (SELECT *, split_part(media_id, '-', 2)::BIGINT AS doc_id FROM facts) f LEFT JOIN placed USING (media_id))"""


def recovered(t):
    """State per medium plus the reassembled segments."""
    source = parts(t)
    blocks = source.select("media_id", "fragment_id", F.length("block").cast("long").alias("size_bytes"), "block")
    declared = source.select("media_id", "fragment_id", F.sha2("declared", 256).alias("sha256"), F.length("declared").cast("long").alias("size_bytes"))
    p, f, e, chain = chained(t)
    ranges = fr.output_ranges(chain.join(blocks, ["media_id", "fragment_id"]), ["media_id"])
    segments = t.once("part_segments", lambda: materialize(fr.reassemble(ranges, ["media_id"])))
    chunks = ck.with_sizes(segments.select("media_id", F.col("segment_start").alias("base_offset"), "content"))
    structure = asm.xref_check(chunks, ck.chunk_hits(chunks, asm.STRUCTURE_MARKERS))
    states = asm.recovery_state(f, chain, p, asm.unresolved_joins(f), structure, asm.digest_mismatches(chain, blocks, declared))
    return states, segments


@query("recovery_state", f"WITH {STATES} SELECT media_id, fragments, placed, recovery_state, CASE recovery_state WHEN 'COMPLETE AND VERIFIED' THEN 'structurally_valid' WHEN 'CORRUPTED' THEN 'failed' ELSE 'incomplete' END AS status FROM whole")
def recovery_state(t):
    return recovered(t)[0]


@query("integrity_verdict", f"""WITH {STATES}, got AS (SELECT media_id, string_agg(piece, '' ORDER BY position) AS out FROM walked GROUP BY media_id),
j AS (SELECT w.media_id, recovery_state, placed, out, doc, coalesce(out = doc, false) AS same, coalesce(length(out) < length(doc) AND starts_with(doc, out), false) AS prefix FROM whole w JOIN pdf USING (media_id) LEFT JOIN got USING (media_id)),
k AS (SELECT *, recovery_state = 'PARTIAL' AND prefix AS partial FROM j)
SELECT media_id, CASE WHEN same AND recovery_state LIKE 'COMPLETE%' THEN 'verified' WHEN same OR partial THEN 'incomplete' ELSE 'failed' END AS status,
  CASE WHEN same THEN recovery_state WHEN partial THEN 'PARTIAL' ELSE 'CORRUPTED' END AS recovery_state, same AS byte_match,
  CASE WHEN NOT same AND NOT partial THEN CASE WHEN out IS NULL THEN 0 WHEN contains(out, 'Helvetixx') THEN instr(out, 'Helvetixx') + 6 ELSE least(length(out), length(doc)) END END::BIGINT AS first_mismatch FROM k""")
def integrity_verdict(t):
    states, segments = recovered(t)
    got = segments.select("media_id", F.col("segment_start").alias("start"), F.col("content").alias("block"))
    want = fr.carve_blocks(v.pdf_media(t), fr.SEGMENT)
    return asm.integrity_verdict(states, fr.first_diff(got, want))


@query("xref_check", f"""WITH {v.PDF}, x AS (SELECT media_id, doc_id, CASE doc_id % 5 WHEN 1 THEN replace(doc, 'startxref', 'start_ref') WHEN 2 THEN replace(doc, '3 0 obj', '33 0 obj') WHEN 3 THEN doc[2:] WHEN 4 THEN replace(doc, '%%EOF', '') ELSE doc END AS t FROM pdf)
SELECT media_id, CASE WHEN doc_id % 5 <> 1 THEN regexp_extract(t, 'startxref\\n([0-9]+)', 1)::BIGINT END AS startxref,
  CASE doc_id % 5 WHEN 1 THEN 'startxref_missing' WHEN 2 THEN CASE WHEN regexp_matches(t, '\\n1?33 0 obj|[0-9]33 0 obj') AND NOT contains(t, chr(10) || '33 0 obj') THEN '' ELSE CASE WHEN substr(t, regexp_extract(t, 'startxref\\n([0-9]+)', 1)::BIGINT + 1, 4) = 'xref' THEN 'object_not_at_offset' ELSE 'no_xref_at_offset' END END
    WHEN 3 THEN 'header_missing,no_xref_at_offset' WHEN 4 THEN 'eof_missing' ELSE '' END AS errors FROM x""")
def xref_check(t):
    k = F.pmod(F.regexp_extract("media_id", r"(\d+)$", 1).cast("long"), F.lit(5))
    x = latin(F.col("content"))
    swap = lambda a, b: F.replace(x, F.lit(a), F.lit(b))
    broken = (
        F.when(k == 1, swap("startxref", "start_ref")).when(k == 2, swap("3 0 obj", "33 0 obj")).when(k == 3, F.substring(x, F.lit(2), F.length(x)))
        .when(k == 4, swap("%%EOF", "")).otherwise(x)
    )
    whole = v.pdf_media(t).select("media_id", "base_offset", F.encode(broken, "ISO-8859-1").alias("content"))
    chunks = materialize(ck.cut_media(whole, CHUNK))
    return asm.xref_check(chunks, ck.chunk_hits(chunks, asm.STRUCTURE_MARKERS)).select("media_id", "startxref", F.array_join("errors", ",").alias("errors"))


# ---- harvest -----------------------------------------------------------------------------------------

ALL = ("obj", "endobj", "xref", "trailer", "startxref", "eof", "stream", "endstream", "pdf_start", *rc.REFERENCE_MARKERS)


def pdf_chunks(t):
    return t.once("pdf_chunks", lambda: materialize(ck.cut_media(v.pdf_media(t), CHUNK)))


def pdf_hits(t):
    """The PDF layouts in chunks, and all marker hits."""
    chunks = pdf_chunks(t)
    return chunks, t.once("pdf_hits", lambda: materialize(ck.chunk_hits(chunks, ALL)))


@query("object_rows", f"""WITH {v.PDF} SELECT 'pdf-' || doc_id AS media_id, k::BIGINT AS object_number, 0::BIGINT AS generation, off AS start, (off + length(obj) - 1)::BIGINT AS "end", false AS unterminated, 1.0::DOUBLE AS confidence FROM pdf_placed""")
def object_rows(t):
    media, hits = pdf_hits(t)
    return rc.object_rows(media, hits)


def bodies(t):
    media, hits = pdf_hits(t)
    return media, rc.object_bodies(rc.object_rows(media, hits), media)


@query("object_type", f"""WITH {v.PDF} SELECT 'pdf-' || doc_id AS media_id, k::BIGINT AS object_number, CASE WHEN k = 1 THEN 'Catalog' WHEN k = 2 THEN 'Pages' WHEN k = 3 THEN 'Font' WHEN k % 2 = 0 THEN 'Page' ELSE 'ContentStream' END AS object_type, k > 3 AND k % 2 = 1 AS has_stream FROM pdf_placed""")
def object_type(t):
    return bodies(t)[1].select("media_id", "object_number", "object_type", "has_stream")


@query("text_literals", f"""WITH {v.PDF}, s AS (SELECT 'pdf-' || doc_id AS media_id, k::BIGINT AS object_number, CASE WHEN k > 3 AND k % 2 = 1 AND length(regexp_extract(obj, '\\((.*)\\) Tj', 1)) BETWEEN 1 AND 250 AND length(trim(regexp_extract(obj, '\\((.*)\\) Tj', 1))) >= 2
  THEN trim(regexp_extract(obj, '\\((.*)\\) Tj', 1)) END AS shown, regexp_extract(obj, '\\((.*)\\) Tj', 1) AS raw FROM pdf_placed)
SELECT media_id, object_number, CASE WHEN shown IS NOT NULL THEN shown WHEN length(raw) BETWEEN 4 AND 120 AND length(trim(raw)) >= 4 AND NOT regexp_matches(raw, 'obj|stream|xref') THEN trim(raw) ELSE '' END AS texts FROM s""")
def text_literals(t):
    return bodies(t)[1].select("media_id", "object_number", F.array_join("texts", "\n").alias("texts"))


@query("missing_references", f"""WITH {v.PDF}, n AS (SELECT 'pdf-' || doc_id AS media_id, doc_id, unnest([4 + 2 * i, 5 + 2 * i])::BIGINT AS object_number FROM pdf_lines) SELECT media_id, object_number FROM n WHERE (object_number + doc_id) % 5 = 0""")
def missing_references(t):
    media, hits = pdf_hits(t)
    doc = F.regexp_extract("media_id", r"(\d+)$", 1).cast("long")
    harvested = rc.object_rows(media, hits).where((F.col("object_number") + doc) % 5 != 0)
    return rc.missing_references(hits, harvested.select("media_id", "object_number"))


@query("recovery_telemetry", f"""WITH {v.PDF}, m AS (SELECT doc_id, count(*) AS objects, count(*) FILTER (k > 3 AND k % 2 = 1) AS streams, count(*) FILTER (k > 3 AND k % 2 = 0) AS pages, (sum(length(obj)) - count(*))::BIGINT AS authentic_bytes FROM pdf_placed GROUP BY doc_id)
SELECT 'pdf-' || doc_id AS media_id, objects, streams, pages, 1::BIGINT AS fonts, authentic_bytes, round(authentic_bytes / length(doc)::DOUBLE * 100, 2) AS coverage_pct, (length(doc) - authentic_bytes)::BIGINT AS unplaced_bytes FROM m JOIN pdf USING (doc_id)""")
def recovery_telemetry(t):
    media, b = bodies(t)
    return rc.recovery_telemetry(b, ck.sizes_of(media)).drop("texts")


REGIONS = f"""{v.PDF}, lens AS (SELECT doc_id, 'pdf-' || doc_id AS media_id, doc, instr(doc, chr(10) || 'xref' || chr(10)) AS x, instr(doc, chr(10) || 'trailer' || chr(10)) AS tr, instr(doc, chr(10) || 'startxref' || chr(10)) AS sx, length(doc) AS n FROM pdf),
raw AS (SELECT media_id, 0::BIGINT AS s, 9::BIGINT AS e, 'PDF_HEADER' AS label, 'header_0' AS entity FROM lens
  UNION ALL SELECT media_id, x, CASE WHEN tr - x < 1024 THEN tr ELSE x + 256 END, 'XREF', 'xref_' || x FROM lens UNION ALL SELECT media_id, tr, n - 1, 'TRAILER', 'trailer_' || tr FROM lens UNION ALL SELECT media_id, sx, n - 1, 'TRAILER', 'startxref_' || sx FROM lens
  UNION ALL SELECT 'pdf-' || doc_id, off, off + length(obj) - 1, CASE WHEN k IN (1) THEN 'PDF_OBJECT' WHEN k = 2 THEN 'PAGE_OBJECT' WHEN k = 3 THEN 'FONT_OBJECT' ELSE 'PAGE_OBJECT' END, 'obj_' || k || '_0' FROM pdf_placed WHERE k <= 3 OR k % 2 = 0
  UNION ALL SELECT 'pdf-' || doc_id, off, off + instr(obj, 'stream' || chr(10)) + 6, 'PDF_OBJECT', 'obj_' || k || '_0_dict' FROM pdf_placed WHERE k > 3 AND k % 2 = 1
  UNION ALL SELECT 'pdf-' || doc_id, off + instr(obj, 'stream' || chr(10)) + 6, off + length(obj) - 17, 'TEXT_STREAM', 'obj_' || k || '_0_stream' FROM pdf_placed WHERE k > 3 AND k % 2 = 1
  UNION ALL SELECT 'pdf-' || doc_id, off + length(obj) - 17, off + length(obj) - 1, 'PDF_OBJECT', 'obj_' || k || '_0_footer' FROM pdf_placed WHERE k > 3 AND k % 2 = 1),
regions AS (SELECT media_id, s::BIGINT AS start, e::BIGINT AS "end", label, entity AS entity_id FROM raw)"""


def regions(t):
    media = pdf_chunks(t)
    hits = t.once("region_hits", lambda: materialize(ck.chunk_hits(media, (*rc.REGION_MARKERS, *rc.WORD_MARKERS))))
    return rc.region_rows(media, hits, hits)


def pdf_blocks(t):
    """The blocks of the PDF layouts, cut from their chunks."""
    return fr.carve_blocks(pdf_chunks(t))


@query("region_rows", f"WITH {REGIONS} SELECT * FROM regions")
def region_rows(t):
    return regions(t)


@query("dominant_label", f"""WITH {REGIONS}, b AS (SELECT media_id, s AS start, least(s + 256, length(doc))::BIGINT AS "end" FROM (SELECT *, unnest(generate_series(0, length(doc)::BIGINT - 1, 256)) AS s FROM pdf)),
o AS (SELECT b.media_id, b.start, b."end", r.label, r.entity_id, least(b."end", r."end") - greatest(b.start, r.start) AS ov, row_number() OVER (PARTITION BY b.media_id, b.start ORDER BY (r.label = 'PDF_HEADER') DESC, least(b."end", r."end") - greatest(b.start, r.start) DESC, r.start, r."end") AS n
  FROM b LEFT JOIN regions r ON r.media_id = b.media_id AND r.start < b."end" AND r."end" > b.start)
SELECT media_id, start, CASE WHEN ok THEN label ELSE 'UNKNOWN' END AS label, ok AS is_exact, CASE WHEN ok THEN entity_id ELSE 'no_overlap' END AS entity_id
FROM (SELECT *, label IS NOT NULL AND (label = 'PDF_HEADER' OR ov >= ("end" - start) * 0.25 OR ov >= 32) AS ok FROM o WHERE n = 1)""")
def dominant_label(t):
    blocks = pdf_blocks(t).select("media_id", "start", "end", F.col("start").alias("block_start"))
    return rc.dominant_label(blocks, t.once("pdf_regions", lambda: materialize(regions(t))), "block_start").withColumnRenamed("block_start", "start")


# ---- carving from raw streams that hold several files -------------------------------------------------

_PLANTED = """CASE doc_id % 4 WHEN 0 THEN chr(137) || 'PNG' || chr(13) || chr(10) || chr(26) || chr(10) || 'IHDR' || doc_id || 'IENDcrc!' WHEN 1 THEN chr(255) || chr(216) || chr(255) || chr(224) || 'data' || doc_id || chr(255) || chr(217)
  WHEN 2 THEN 'PK' || chr(3) || chr(4) || 'name' || doc_id || 'PK' || chr(5) || chr(6) || repeat('x', 18) ELSE '' END"""
RAW = f"""{v.PDF}, parts AS (SELECT 'disk-' || doc_id // 4 AS media_id, doc_id, 'junk between files' || chr(10) AS junk, {_PLANTED} AS x, CASE WHEN doc_id % 4 = 3 THEN replace(doc, '1 0 obj', '1 0 xxx') ELSE doc END AS doc FROM pdf),
stream AS (SELECT media_id, string_agg(junk || x || doc, '' ORDER BY doc_id) AS s FROM parts GROUP BY media_id),
placed AS (SELECT *, (length(junk) + coalesce(sum(length(junk) + length(x) + length(doc)) OVER (PARTITION BY media_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS head FROM parts),
heads AS (SELECT media_id, s, p FROM (SELECT media_id, s, unnest(range(0, length(s))) AS p FROM stream WHERE false) UNION ALL
  SELECT media_id, s, (sum(length(seg) + 5) OVER (PARTITION BY media_id ORDER BY i) - 5)::BIGINT FROM (SELECT media_id, s, unnest(string_split(s, '%PDF-')) AS seg, generate_subscripts(string_split(s, '%PDF-'), 1) AS i, len(string_split(s, '%PDF-')) AS n FROM stream) WHERE i < n),
carved AS (SELECT media_id, p AS start, (p + instr(s[p + 1:], '%%EOF') + 4)::BIGINT AS "end", s[p + 1:p + instr(s[p + 1:], '%%EOF') + 5] AS bytes FROM heads),
found AS (SELECT media_id, 'pdf' AS format, start, "end", sha256(bytes) AS sha256, bytes FROM carved
  UNION ALL SELECT media_id, CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' ELSE 'zip' END, head, head + length(x), sha256(CASE doc_id % 4 WHEN 0 THEN unhex('89504E470D0A1A0A') || encode('IHDR' || doc_id || 'IENDcrc!')
    WHEN 1 THEN unhex('FFD8FFE0') || encode('data' || doc_id) || unhex('FFD9') ELSE encode(x) END), NULL FROM placed WHERE x <> '')"""


def disks(t):
    """Streams of four PDF layouts with junk, a PNG, a JPEG and a ZIP run between them, one of the four without readable objects."""
    doc = F.regexp_extract("media_id", r"(\d+)$", 1).cast("long")
    text = latin(F.col("content"))
    body = F.when(F.pmod(doc, F.lit(4)) == 3, F.replace(text, F.lit("1 0 obj"), F.lit("1 0 xxx"))).otherwise(text)
    number = doc.cast("string")
    planted = (
        F.when(F.pmod(doc, F.lit(4)) == 0, F.concat(F.lit("\x89PNG\r\n\x1a\nIHDR"), number, F.lit("IENDcrc!")))
        .when(F.pmod(doc, F.lit(4)) == 1, F.concat(F.lit("\xff\xd8\xff\xe0data"), number, F.lit("\xff\xd9")))
        .when(F.pmod(doc, F.lit(4)) == 2, F.concat(F.lit("PK\x03\x04name"), number, F.lit("PK\x05\x06" + "x" * 18))).otherwise("")
    )
    d = v.pdf_media(t).select(doc.alias("d"), F.encode(F.concat(F.lit("junk between files\n"), planted, body), "ISO-8859-1").alias("b"))
    return (
        d.groupBy(F.floor(F.col("d") / 4).alias("disk")).agg(F.expr("listagg(b, X'') within group (order by d)").alias("content"))
        .select(F.concat(F.lit("disk-"), F.col("disk").cast("string")).alias("media_id"), F.lit(0).cast("long").alias("base_offset"), "content")
    )


def carved(t):
    media = t.once("disk_chunks", lambda: materialize(ck.cut_media(disks(t), CHUNK)))
    marks = tuple(m for pair in rc.SIGNATURES.values() for m in pair[:2])
    hits = t.once("disk_hits", lambda: materialize(ck.chunk_hits(media, marks)))
    return media, rc.footer_asof(hits)


@query("footer_asof", f"""WITH {RAW} SELECT media_id, format, start, "end" FROM found""")
def footer_asof(t):
    return carved(t)[1]


@query("carve_artifacts", f"""WITH {RAW} SELECT media_id, 'carved_' || lpad(lower(to_hex(start)), 8, '0') || '.' || CASE format WHEN 'jpeg' THEN 'jpg' ELSE format END AS filename, start, (CASE WHEN format = 'pdf' THEN "end" + 1 ELSE "end" END)::BIGINT AS "end", sha256,
  CASE WHEN format <> 'pdf' THEN NULL WHEN regexp_matches(bytes, '[0-9]+\\s+[0-9]+\\s+obj') THEN 1.0 ELSE 0.8 END::DOUBLE AS integrity_score, CASE WHEN format <> 'pdf' THEN 'CANDIDATE' WHEN regexp_matches(bytes, '[0-9]+\\s+[0-9]+\\s+obj') THEN 'RECOVERED' ELSE 'PARTIAL' END AS category FROM found""")
def carve_artifacts(t):
    media, runs = carved(t)
    return rc.carve_artifacts(runs, media).drop("format")


@query("cap_artifacts", f"""WITH {RAW} SELECT media_id, start FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY list_position(['pdf', 'png', 'jpeg', 'zip'], format), start) AS n FROM found) WHERE n <= 5""")
def cap_artifacts(t):
    return rc.cap_artifacts(carved(t)[1], 5).select("media_id", "start")


ART = """art AS (SELECT o_orderkey AS artifact_id, o_custkey AS case_id, CASE o_orderstatus WHEN 'F' THEN 'RECOVERED' WHEN 'O' THEN 'PARTIAL' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'CANDIDATE' WHEN 1 THEN 'VERIFIED' ELSE 'UNRECOVERABLE' END END AS category,
  (o_orderkey % 11) / 10.0::DOUBLE AS integrity, o_orderkey % 8 AS placed, 8::BIGINT AS total, o_orderkey % 5 = 0 AS corrupt, o_orderkey % 2 = 1 AS matched, floor(o_totalprice)::BIGINT AS size_bytes FROM orders),
scored AS (SELECT *, CASE WHEN matched AND category = 'VERIFIED' THEN 100 ELSE least(100, greatest(0, CASE WHEN corrupt THEN greatest(5, base - 15) ELSE base END)) END::DOUBLE AS confidence
  FROM (SELECT *, CASE category WHEN 'RECOVERED' THEN 75 + integrity * 20 + placed / 8.0::DOUBLE * 5 WHEN 'PARTIAL' THEN 30 + placed / 8.0::DOUBLE * 35 + integrity * 15 WHEN 'CANDIDATE' THEN 20 + placed / 8.0::DOUBLE * 20 ELSE placed / 8.0::DOUBLE * 10 END AS base FROM art))"""


def artifacts(t):
    k = F.col("o_orderkey")
    rest = F.when(k % 4 == 0, "CANDIDATE").when(k % 4 == 1, "VERIFIED").otherwise("UNRECOVERABLE")
    category = F.when(F.col("o_orderstatus") == "F", "RECOVERED").when(F.col("o_orderstatus") == "O", "PARTIAL").otherwise(rest)
    return t.orders.select(
        k.alias("artifact_id"), F.col("o_custkey").alias("case_id"), category.alias("category"), F.floor("o_totalprice").alias("size_bytes"),
        rc.artifact_score(category, (k % 11) / 10, k % 8, F.lit(8), k % 5 == 0, k % 2 == 1).alias("confidence"),
    )


@query("artifact_score", f"WITH {ART} SELECT artifact_id, category, round(confidence, 4) AS confidence FROM scored")
def artifact_score(t):
    return artifacts(t).select("artifact_id", "category", F.round("confidence", 4).alias("confidence"))


@query("rank_artifacts", f"""WITH {ART} SELECT artifact_id, round(CASE category WHEN 'VERIFIED' THEN 1000 WHEN 'RECOVERED' THEN 500 WHEN 'PARTIAL' THEN 200 WHEN 'CANDIDATE' THEN 100 ELSE 0 END + confidence, 4)::DOUBLE AS priority FROM scored""")
def rank_artifacts(t):
    return rc.rank_artifacts(artifacts(t)).select("artifact_id", F.round("priority", 4).alias("priority"))


@query("category_summary", f"""WITH {ART} SELECT case_id, count(*) AS total, count(*) FILTER (category = 'VERIFIED') AS verified, count(*) FILTER (category = 'RECOVERED') AS recovered,
  count(*) FILTER (category = 'PARTIAL') AS partial, count(*) FILTER (category = 'UNRECOVERABLE') AS unrecoverable FROM art GROUP BY case_id""")
def category_summary(t):
    return rc.category_summary(artifacts(t), ["case_id"])


_NEXT = f"{v.PDF_BLOCKS}, nb AS (SELECT a.media_id, a.start, a.block AS a, b.block AS b FROM pdf_fragments a JOIN pdf_fragments b ON b.media_id = a.media_id AND b.start = a.\"end\")"


def neighbours(t):
    d = fr.carve_blocks(v.pdf_media(t)).withColumn("block", latin(F.col("block")))
    b = d.select("media_id", F.col("start").alias("end"), F.col("block").alias("b"))
    return d.select("media_id", "start", "end", F.col("block").alias("a")).join(b, ["media_id", "end"])


@query("boundary_continuity", f"""WITH {_NEXT} SELECT media_id, start, round(least(1, 0.5 + CASE WHEN ends_with(a, chr(10)) THEN 0.2 ELSE 0 END
  + CASE WHEN (ends_with(a, 'ob') AND starts_with(b, 'j ')) OR (ends_with(a, 'stream') AND starts_with(b, chr(10))) OR (ends_with(a, 'end') AND starts_with(b, 'obj')) THEN 0.4 ELSE 0 END), 2)::DOUBLE AS continuity FROM nb""")
def boundary_continuity(t):
    return neighbours(t).select("media_id", "start", F.round(rc.boundary_continuity(F.col("a"), F.col("b")), 2).alias("continuity"))


@query("alnum_boundary", f"WITH {_NEXT} SELECT media_id, start, regexp_matches(right(a, 1), '[0-9A-Za-z]') AND regexp_matches(b[1:1], '[0-9A-Za-z]') AS continues FROM nb")
def alnum_boundary(t):
    return neighbours(t).select("media_id", "start", rc.alnum_boundary(F.col("a"), F.col("b")).alias("continues"))
