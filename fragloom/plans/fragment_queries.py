"""Fragmentation, identity, ordering and reassembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragloom.functions import blob
from fragloom.operators import fragments as fr
from fragloom.plans import views as v
from fragloom.plans.registry import query

def coarse():
    """16 MiB buckets of the start offset."""
    return F.floor(F.col("start") / (1 << 24))


@query(
    "fragment_census",
    f"""WITH {v.FRAGMENTS}, f AS (SELECT d.source, x.sha256, x.size_bytes FROM fragments x JOIN documents d USING (doc_id))
SELECT source, sum(n)::BIGINT AS fragments, count(*) AS unique_fragments, sum(b)::BIGINT AS bytes,
  round(1 - count(*) / sum(n), 6) AS duplicate_share
FROM (SELECT source, sha256, count(*) AS n, sum(size_bytes) AS b FROM f GROUP BY source, sha256) GROUP BY source""",
)
def fragment_census(t):
    # source rides along through the carve, so no join brings it back
    tagged = t.documents.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("media_id"),
        F.lit(0).cast("long").alias("base_offset"),
        F.encode("text", "UTF-8").alias("content"),
        "source",
    )
    per_content = (
        fr.identify(fr.carve_blocks(tagged, keep=("source",)))
        .groupBy("source", "sha256")
        .agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    )
    return per_content.groupBy("source").agg(
        F.sum("n").alias("fragments"),
        F.count("*").alias("unique_fragments"),
        F.sum("b").alias("bytes"),
        F.round(1 - F.count("*") / F.sum("n"), 6).alias("duplicate_share"),
    )


@query("column_media", f"WITH {v.MEDIA} SELECT media_id, octet_length(content)::BIGINT AS size_bytes, sha256(content) AS sha256 FROM media")
def column_media(t):
    return v.media(t).select("media_id", "size_bytes", F.sha2("content", 256).alias("sha256"))


@query("carve_blocks", f"""WITH {v.BLOCKS} SELECT media_id, start, "end", sha256(block) AS sha256 FROM blocks""")
def carve_blocks(t):
    return v.blocks(t).select("media_id", "start", "end", F.sha2("block", 256).alias("sha256"))


@query(
    "carve_multi",
    f"""WITH {v.MEDIA}, s AS (SELECT media_id, content, size,
  unnest(generate_series(0, octet_length(content)::BIGINT - 1, size)) AS start FROM media, (VALUES (256::BIGINT), (512::BIGINT)) b(size))
SELECT media_id, media_id || '_sz' || size || '_off' || CASE WHEN start < 100000 THEN lpad(start::VARCHAR, 6, '0') ELSE start::VARCHAR END AS sample_id,
  size AS block_size, start, least(start + size, octet_length(content))::BIGINT AS "end", sha256(content[start + 1:start + size]) AS sha256 FROM s""",
)
def carve_multi(t):
    return fr.carve_multi(v.media(t)).withColumn("sha256", F.sha2("block", 256)).drop("block")


@query(
    "erased_regions",
    f"""WITH {v.DAMAGED}, z AS (
  SELECT media_id, s AS start, least(s + 256, octet_length(content))::BIGINT AS "end", content[s + 1:s + 256] AS block
  FROM (SELECT *, unnest(generate_series(0, octet_length(content)::BIGINT - 1, 256)) AS s FROM damaged)),
e AS (SELECT media_id, start, "end", start - 256 * row_number() OVER (PARTITION BY media_id ORDER BY start) AS g
  FROM z WHERE hex(block) = repeat('00', octet_length(block)))
SELECT media_id, min(start) AS start, max("end") AS "end" FROM e GROUP BY media_id, g""",
)
def erased_regions(t):
    return fr.erased_regions(fr.carve_blocks(v.damaged(t)))


@query(
    "partial_tail",
    f"""WITH {v.BLOCKS} SELECT media_id, start, "end", 'partial trailing block at byte_range [' || start || ', ' || "end" || '): '
  || octet_length(block) || ' of 256 bytes' AS warning FROM blocks WHERE octet_length(block) < 256""",
)
def partial_tail(t):
    return fr.partial_tail(v.blocks(t))


@query("fragment_id", f"""WITH {v.FRAGMENTS} SELECT media_id, start, fragment_id FROM fragments""")
def fragment_id(t):
    return v.fragments(t).select("media_id", "start", "fragment_id")


@query(
    "parse_fragment_id",
    f"""WITH {v.FRAGMENTS}, ids AS (
  SELECT media_id, start, CASE start // 256 % 4 WHEN 1 THEN replace(fragment_id, 'FRG-', 'frg-') WHEN 2 THEN fragment_id || '0x'
    WHEN 3 THEN regexp_replace(fragment_id, '-([0-9]+)-', '-0\\1-') ELSE fragment_id END AS fragment_id FROM fragments),
p AS (SELECT *, regexp_extract(fragment_id, '^FRG-([0-9a-f]{{16}})-(0|[1-9][0-9]*)-(0|[1-9][0-9]*)$', ['d', 's', 'e']) AS m FROM ids),
q AS (SELECT *, m.d <> '' AND try_cast(m.e AS BIGINT) > try_cast(m.s AS BIGINT) AS ok FROM p)
SELECT media_id, start, fragment_id, coalesce(ok, false) AS is_valid, CASE WHEN ok THEN m.d END AS digest_prefix,
  CASE WHEN ok THEN try_cast(m.s AS BIGINT) END AS range_start, CASE WHEN ok THEN try_cast(m.e AS BIGINT) END AS range_end FROM q""",
)
def parse_fragment_id(t):
    kind = F.pmod(F.floor(F.col("start") / 256), F.lit(4))
    bad = (
        F.when(kind == 1, F.replace("fragment_id", F.lit("FRG-"), F.lit("frg-")))
        .when(kind == 2, F.concat("fragment_id", F.lit("0x")))
        .when(kind == 3, F.regexp_replace("fragment_id", "-([0-9]+)-", "-0$1-"))
        .otherwise(F.col("fragment_id"))
    )
    return fr.parse_fragment_id(v.fragments(t).select("media_id", "start", bad.alias("fragment_id")))


@query(
    "content_id",
    f"""WITH {v.MEDIA} SELECT media_id, 'doc_' || sha256(content)[1:16] AS short_id, 'text_item_' || sha256(content)[1:40] AS long_id FROM media""",
)
def content_id(t):
    sha = F.sha2("content", 256)
    return v.media(t).select(
        "media_id", blob.content_id("doc", sha).alias("short_id"), blob.content_id("text_item", sha, 40).alias("long_id")
    )


SHUFFLE = (
    v.BLOCKS
    + """, keyed AS (SELECT media_id, start, "end", block, start // 256 AS block_index, sha256('2024:' || (start // 256)) AS k FROM blocks),
ranked AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY k) AS r, count(*) OVER (PARTITION BY media_id) AS n FROM keyed),
ident AS (SELECT media_id, bool_and(r = block_index + 1) AS same FROM ranked GROUP BY media_id),
shuffled AS (SELECT ranked.*, CASE WHEN same AND n > 1 THEN (r - 2 + n) % n ELSE r - 1 END AS position FROM ranked JOIN ident USING (media_id))"""
)


def shuffled(t):
    blocks = v.blocks(t).withColumn("block_index", F.floor(F.col("start") / 256))
    return fr.keyed_shuffle(blocks, 2024)


@query("keyed_shuffle", f"WITH {SHUFFLE} SELECT media_id, block_index, position FROM shuffled")
def keyed_shuffle(t):
    return shuffled(t).select("media_id", "block_index", "position")


@query(
    "shuffle_media",
    f"""WITH {SHUFFLE}, whole AS (SELECT media_id, list_reduce(list(block ORDER BY position), lambda x, y: x || y) AS content FROM shuffled GROUP BY media_id)
SELECT media_id, seg AS segment_no, sha256(content[seg * 1048576 + 1:(seg + 1) * 1048576]) AS sha256
FROM (SELECT *, unnest(generate_series(0, (octet_length(content)::BIGINT - 1) // 1048576)) AS seg FROM whole)""",
)
def shuffle_media(t):
    sized = shuffled(t).withColumn("size_bytes", F.col("end") - F.col("start"))
    joined = fr.reassemble(fr.output_ranges(sized, ["media_id"]), ["media_id"])
    return joined.select("media_id", "segment_no", F.sha2("content", 256).alias("sha256"))


@query(
    "excerpt",
    f"""WITH {v.MEDIA}, t AS (SELECT media_id, content[1:128] AS a, content[1:256] AS b,
  content[greatest(1, octet_length(content) - 127):] AS c FROM media)
SELECT media_id, {", ".join(f"array_to_string(list_transform(range(1, octet_length({x})::BIGINT + 1), lambda i: CASE WHEN hex({x}[i:i]) BETWEEN '20' AND '7E' THEN decode({x}[i:i]) ELSE '.' END), '') AS {n}" for x, n in (("a", "head_128"), ("b", "head_256"), ("c", "tail_128")))}
FROM t""",
)
def excerpt(t):
    c = F.col("content")
    return v.media(t).select(
        "media_id",
        blob.excerpt(c, 0, 128).alias("head_128"),
        blob.excerpt(c, 0, 256).alias("head_256"),
        blob.excerpt(c, -128, 128).alias("tail_128"),
    )


@query(
    "content_dedup",
    f"""WITH {v.FRAGMENTS}, k AS (SELECT media_id, doc_id, start, fragment_id, sha256,
  first_value(media_id || '/' || fragment_id) OVER (PARTITION BY sha256 ORDER BY doc_id, start) AS retained_id FROM fragments)
SELECT media_id, start, retained_id, retained_id <> media_id || '/' || fragment_id AS is_duplicate FROM k""",
)
def content_dedup(t):
    frags = v.fragments(t).select(
        F.regexp_extract("media_id", r"doc-(\d+)", 1).cast("long").alias("doc_id"),
        "start",
        "sha256",
        F.concat_ws("/", "media_id", "fragment_id").alias("global_id"),
    )
    out = fr.content_dedup(frags, ["doc_id", "start"], "global_id")
    return out.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("media_id"), "start", "retained_id", "is_duplicate"
    )


@query("duplicate_ids", f"""WITH {v.FRAGMENTS} SELECT fragment_id, count(*) AS seen FROM fragments GROUP BY fragment_id HAVING count(*) > 1""")
def duplicate_ids(t):
    return fr.duplicate_ids(v.fragments(t), "fragment_id")


OVERLAPPING = (
    v.MEDIA
    + """, spans AS (SELECT media_id, doc_id, s AS start, least(s + 256 + 64 * (s // 192 % 2), octet_length(content))::BIGINT AS "end"
  FROM (SELECT *, unnest(generate_series(0, octet_length(content)::BIGINT - 1, 192 + 128 * (doc_id % 3))) AS s FROM media)),
named AS (SELECT *, media_id || ':' || start || '-' || "end" AS fragment_id FROM spans)"""
)


def overlapping(t):
    """Spans of mixed stride and length, some of them overlapping."""
    doc = F.regexp_extract("media_id", r"doc-(\d+)", 1).cast("long")
    step = F.pmod(doc, F.lit(3)) * 128 + 192
    return (
        v.media(t)
        .where("size_bytes > 0")
        .select("media_id", "size_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size_bytes") - 1, step)).alias("start"))
        .withColumn("end", F.least(F.col("start") + 256 + F.pmod(F.floor(F.col("start") / 192), F.lit(2)) * 64, F.col("size_bytes")))
        .withColumn("fragment_id", F.format_string("%s:%d-%d", "media_id", "start", "end"))
    )


@query(
    "overlap_check",
    f"""WITH {OVERLAPPING}, p AS (SELECT *, lag(fragment_id) OVER w AS previous_id, lag("end") OVER w AS previous_end FROM named
  WINDOW w AS (PARTITION BY media_id ORDER BY start, "end", fragment_id))
SELECT media_id, previous_id, fragment_id AS current_id, previous_end, start AS current_start FROM p WHERE previous_end > start""",
)
def overlap_check(t):
    return fr.overlap_check(overlapping(t), ["media_id"], "start", "end", "fragment_id", coarse())


@query(
    "collection_anomalies",
    f"""WITH {OVERLAPPING}, twice AS (SELECT media_id, start, CASE WHEN start % 5 = 4 THEN start ELSE "end" END AS "end", fragment_id FROM named WHERE start > 0
  UNION ALL SELECT media_id, start, "end", fragment_id FROM named WHERE start > 0 AND start % 7 = 3),
p AS (SELECT *, lag("end") OVER (PARTITION BY media_id ORDER BY start, "end", fragment_id) AS previous_end FROM twice)
SELECT media_id, 'empty' AS anomaly, NULL::VARCHAR AS subject FROM media WHERE media_id NOT IN (SELECT media_id FROM twice)
UNION ALL SELECT media_id, 'duplicate_id', fragment_id FROM twice GROUP BY media_id, fragment_id HAVING count(*) > 1
UNION ALL SELECT media_id, 'non_positive_size', fragment_id FROM twice WHERE "end" <= start
UNION ALL SELECT media_id, 'overlap', fragment_id FROM p WHERE previous_end > start""",
)
def collection_anomalies(t):
    spans = overlapping(t).where("start > 0").select("media_id", "start", "end", "fragment_id")
    shrunk = spans.withColumn("end", F.when(F.col("start") % 5 == 4, F.col("start")).otherwise(F.col("end")))
    twice = shrunk.unionByName(spans.where("start % 7 = 3"))
    return fr.collection_anomalies(v.media(t), twice, coarse())


def chain(t):
    return fr.output_ranges(shuffled(t).withColumn("size_bytes", F.col("end") - F.col("start")), ["media_id"])


CHAIN = (
    SHUFFLE
    + """, chain AS (SELECT *, "end" - start AS size_bytes, sum("end" - start) OVER (PARTITION BY media_id ORDER BY position)::BIGINT AS output_end FROM shuffled)"""
)


@query(
    "output_ranges",
    f"""WITH {CHAIN} SELECT media_id, position, start AS source_start, "end" AS source_end, output_end - size_bytes AS output_start, output_end FROM chain""",
)
def output_ranges(t):
    return chain(t).select(
        "media_id", "position", F.col("start").alias("source_start"), F.col("end").alias("source_end"), "output_start", "output_end"
    )


@query(
    "reassemble",
    f"""WITH {v.MEDIA} SELECT media_id, seg AS segment_no, seg * 1048576 AS segment_start,
  least((seg + 1) * 1048576, octet_length(content))::BIGINT AS segment_end, sha256(content[seg * 1048576 + 1:(seg + 1) * 1048576]) AS sha256
FROM (SELECT *, unnest(generate_series(0, (octet_length(content)::BIGINT - 1) // 1048576)) AS seg FROM media WHERE octet_length(content) > 0)""",
)
def reassemble(t):
    """Shuffled blocks put back by their true index give the original bytes."""
    truth = shuffled(t).select("media_id", F.col("block_index").alias("position"), (F.col("end") - F.col("start")).alias("size_bytes"), "block")
    joined = fr.reassemble(fr.output_ranges(truth, ["media_id"]), ["media_id"])
    return joined.select("media_id", "segment_no", "segment_start", "segment_end", F.sha2("content", 256).alias("sha256"))


@query(
    "provenance_check",
    f"""WITH {v.FRAGMENTS}, c AS (SELECT media_id, doc_id, start, size_bytes, start // 256 AS position,
    CASE WHEN start // 256 % 11 = 3 THEN 'FRG-missing-' || start ELSE fragment_id END AS fragment_id FROM fragments WHERE start // 256 % 13 <> 5 OR doc_id % 2 = 0
  UNION ALL SELECT media_id, doc_id, start, size_bytes, 1000000 + start // 256, fragment_id FROM fragments WHERE start // 256 % 17 = 9),
r AS (SELECT *, sum(size_bytes) OVER (PARTITION BY media_id ORDER BY position)::BIGINT
    + CASE WHEN position % 19 = 7 THEN 1 ELSE 0 END AS output_end FROM c),
s AS (SELECT *, output_end - size_bytes AS output_start FROM r)
SELECT media_id, 'duplicate_member' AS finding, fragment_id AS subject FROM s GROUP BY media_id, fragment_id HAVING count(*) > 1
UNION ALL SELECT media_id, 'unknown_member', fragment_id FROM s WHERE (media_id, fragment_id) NOT IN (SELECT media_id, fragment_id FROM fragments)
UNION ALL SELECT media_id, 'gap', fragment_id FROM s a WHERE output_start > 0
  AND NOT EXISTS (SELECT 1 FROM s b WHERE b.media_id = a.media_id AND b.output_end = a.output_start)
UNION ALL SELECT media_id, 'total_mismatch', got::VARCHAR FROM (SELECT media_id, sum(size_bytes)::BIGINT AS got FROM s GROUP BY media_id)
  JOIN media USING (media_id) WHERE got <> octet_length(content)""",
)
def provenance_check(t):
    frags = v.fragments(t)
    doc = F.regexp_extract("media_id", r"doc-(\d+)", 1).cast("long")
    index = F.floor(F.col("start") / 256)
    base = frags.select("media_id", "start", "size_bytes", index.alias("position"), "fragment_id")
    broken = base.where((F.col("position") % 13 != 5) | (doc % 2 == 0)).withColumn(
        "fragment_id",
        F.when(F.col("position") % 11 == 3, F.concat(F.lit("FRG-missing-"), F.col("start").cast("string"))).otherwise(F.col("fragment_id")),
    )
    again = base.where("position % 17 = 9").withColumn("position", F.col("position") + 1000000)
    ranges = fr.output_ranges(broken.unionByName(again), ["media_id"])
    off = F.when(F.col("position") % 19 == 7, 1).otherwise(0)
    shifted = ranges.withColumn("output_start", F.col("output_start") + off).withColumn("output_end", F.col("output_end") + off)
    return fr.provenance_check(shifted, frags, v.media(t).select("media_id", "size_bytes"))


@query(
    "profile_checked",
    f"""WITH {v.FRAGMENTS}, {v.DAMAGED_CTE}, now AS (
  SELECT media_id, s AS start, content[s + 1:s + 256] AS block FROM (SELECT *, unnest(generate_series(0, octet_length(content)::BIGINT - 1, 256)) AS s FROM damaged))
SELECT f.media_id, f.fragment_id, sha256(n.block) <> f.sha256 AS digest_mismatch, octet_length(n.block) <> f.size_bytes AS size_mismatch
FROM fragments f JOIN now n USING (media_id, start)""",
)
def profile_checked(t):
    declared = v.fragments(t).select("media_id", "start", "fragment_id", "sha256", "size_bytes")
    return fr.profile_checked(declared, fr.carve_blocks(v.damaged(t)).select("media_id", "start", "block"))


@query(
    "unplaced_fragments",
    f"""WITH {v.FRAGMENTS} SELECT media_id, fragment_id FROM fragments WHERE doc_id % 3 = 0 AND start // 256 % 4 = 2""",
)
def unplaced_fragments(t):
    """Fragments that no chain member names."""
    frags = v.fragments(t).select("media_id", "start", "fragment_id")
    doc = F.regexp_extract("media_id", r"doc-(\d+)", 1).cast("long")
    placed = frags.where((doc % 3 != 0) | (F.floor(F.col("start") / 256) % 4 != 2))
    return frags.join(placed, ["media_id", "fragment_id"], "left_anti").select("media_id", "fragment_id")


VERIFY = (
    v.DAMAGED
    + """, pair AS (SELECT m.media_id, m.doc_id, m.content AS a, CASE m.doc_id % 4 WHEN 3 THEN m.content[1:octet_length(m.content) // 2] ELSE d.content END AS b
  FROM media m JOIN damaged d USING (media_id)),
bad AS (SELECT media_id, min(i) AS i FROM (SELECT media_id, a, b, unnest(range(0, least(octet_length(a), octet_length(b))::BIGINT)) AS i FROM pair)
  WHERE a[i + 1:i + 1] <> b[i + 1:i + 1] GROUP BY media_id),
verified AS (SELECT pair.media_id, a = b AS byte_match, bad.i IS NULL AND octet_length(a) < octet_length(b) AS is_prefix,
  (octet_length(a) - octet_length(b))::BIGINT AS length_delta,
  CASE WHEN a <> b THEN coalesce(bad.i, least(octet_length(a), octet_length(b)))::BIGINT END AS first_diff
  FROM pair LEFT JOIN bad USING (media_id))"""
)


def verified(t):
    """Original against a copy that is zeroed in part, or cut to its first half."""
    doc = F.regexp_extract("media_id", r"doc-(\d+)", 1).cast("long")
    half = F.substring("content", F.lit(1), F.floor(F.length("content") / 2).cast("int"))
    cut = v.media(t).where((doc % 4 == 3) & (F.col("size_bytes") > 0)).withColumn("content", half)
    copy = v.damaged(t).where(doc % 4 != 3).select("media_id", "base_offset", "content").unionByName(
        cut.select("media_id", "base_offset", "content")
    )
    return fr.first_diff(fr.carve_blocks(v.media(t)), fr.carve_blocks(copy))


@query("first_diff", f"WITH {VERIFY} SELECT media_id, first_diff FROM verified")
def first_diff(t):
    return verified(t).select("media_id", "first_diff")


@query("verify_bytes", f"WITH {VERIFY} SELECT media_id, byte_match, is_prefix, length_delta FROM verified")
def verify_bytes(t):
    return verified(t).select("media_id", "byte_match", "is_prefix", "length_delta")


@query(
    "byte_coverage",
    f"""WITH {v.BLOCKS} SELECT media_id, sum("end" - start)::BIGINT AS original_bytes,
  coalesce(sum("end" - start) FILTER (start // 256 % 5 <> 4), 0)::BIGINT AS placed_bytes,
  round(100.0::DOUBLE * coalesce(sum("end" - start) FILTER (start // 256 % 5 <> 4), 0) / sum("end" - start), 1) AS coverage_pct
FROM blocks GROUP BY media_id""",
)
def byte_coverage(t):
    """Share of each original's bytes that a chain missing every fifth block brings back."""
    size = F.col("end") - F.col("start")
    placed = F.sum(F.when(F.floor(F.col("start") / 256) % 5 != 4, size).otherwise(0))
    return (
        v.blocks(t).groupBy("media_id")
        .agg(F.sum(size).alias("original_bytes"), placed.alias("placed_bytes"))
        .withColumn("coverage_pct", F.round(F.col("placed_bytes") * 100.0 / F.col("original_bytes"), 1))
    )
