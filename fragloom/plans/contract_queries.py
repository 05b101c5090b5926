"""Findings, grounding, hashing, session and audit queries over the order and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragloom.operators import contract as ct
from fragloom.operators.scale import materialize
from fragloom.plans import views as v
from fragloom.plans.registry import query

DOMAIN = "intelligence_report/1.0"
VERSION = "evidence_bundle/1.0"

# ---- lineitem rows as spans of their order ------------------------------------------------------------

SPANS = """spans AS (SELECT l_orderkey AS group_id, l_linenumber AS line, l_partkey, l_suppkey, (l_linenumber * 60 + (l_quantity)::BIGINT % 7)::BIGINT AS start,
  (l_linenumber * 60 + (l_quantity)::BIGINT % 7 + l_quantity::BIGINT)::BIGINT AS "end", l_quantity::BIGINT + CASE WHEN l_partkey % 9 = 4 THEN 1 ELSE 0 END AS size_bytes FROM lineitem)"""


def spans(t):
    start = (F.col("l_linenumber") * 60 + F.col("l_quantity").cast("long") % 7).cast("long")
    quantity = F.col("l_quantity").cast("long")
    return t.lineitem.select(
        F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey", start.alias("start"),
        (start + quantity).alias("end"), (quantity + F.when(F.col("l_partkey") % 9 == 4, 1).otherwise(0)).alias("size_bytes"),
    )


@query("dangling_refs", """SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 3)""")
def dangling_refs(t):
    d = ct.dangling_refs(t.lineitem, t.part.where("p_partkey % 10 <> 3"), "l_partkey", "p_partkey")
    return d.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_partkey")


@query("media_not_declared", """SELECT l_orderkey, l_linenumber::BIGINT AS line, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey <> 3)""")
def media_not_declared(t):
    d = ct.dangling_refs(t.lineitem, t.supplier.where("s_nationkey <> 3"), "l_suppkey", "s_suppkey")
    return d.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_suppkey")


@query("range_beyond_media", f"""WITH {SPANS} SELECT group_id, line::BIGINT AS line, start, "end" FROM spans JOIN orders ON o_orderkey = group_id WHERE "end" > (o_totalprice / 1000)::INT""")
def range_beyond_media(t):
    media = t.orders.select(F.col("o_orderkey").alias("media_id"), F.round(F.col("o_totalprice") / 1000).cast("long").alias("size_bytes"))
    d = ct.range_beyond_media(spans(t).withColumn("media_id", F.col("group_id")), media)
    return d.select("group_id", F.col("line").cast("long").alias("line"), "start", "end")


@query("range_findings", f"""WITH {SPANS}, x AS (SELECT group_id, line, start, CASE WHEN group_id % 8 = 5 THEN start ELSE "end" END AS "end", size_bytes FROM spans)
SELECT group_id, line::BIGINT AS line, 'RANGE_INVALID' AS code FROM x WHERE "end" <= start UNION ALL SELECT group_id, line, 'SIZE_MISMATCH' FROM x WHERE size_bytes <> "end" - start""")
def range_findings(t):
    d = spans(t).withColumn("end", F.when(F.col("group_id") % 8 == 5, F.col("start")).otherwise(F.col("end"))).withColumn("line", F.col("line").cast("long"))
    return ct.range_findings(d, ["group_id", "line"])


@query("group_gaps", f"""WITH {SPANS}, g AS (SELECT group_id, start, "end", lag("end") OVER (PARTITION BY group_id ORDER BY start, "end") AS p FROM spans),
c AS (SELECT group_id, sum(coalesce(greatest(0, start - p), 0))::BIGINT AS computed, count(*) AS n FROM g GROUP BY group_id)
SELECT group_id, (n * 30)::BIGINT AS gaps_bytes, computed FROM c WHERE computed <> n * 30""")
def group_gaps(t):
    s = spans(t)
    declared = s.groupBy("group_id").agg((F.count("*") * 30).alias("gaps_bytes"))
    return ct.group_gaps(s, declared, F.floor(F.col("start") / (1 << 24)))


@query("id_findings", f"""WITH {v.FRAGMENTS}, x AS (SELECT media_id, start, "end", CASE start // 256 % 6 WHEN 2 THEN lower(fragment_id) WHEN 4 THEN regexp_replace(fragment_id, '[0-9]+$', '7') ELSE fragment_id END AS id FROM fragments)
SELECT media_id, start, CASE WHEN NOT regexp_matches(id, '^FRG-[0-9a-f]{{16}}-[0-9]{{1,10}}-[0-9]{{1,10}}$') THEN 'FRAGMENT_ID_UNPARSEABLE' ELSE 'FRAGMENT_ID_RANGE_MISMATCH' END AS code FROM x
WHERE NOT regexp_matches(id, '^FRG-[0-9a-f]{{16}}-[0-9]{{1,10}}-[0-9]{{1,10}}$') OR split_part(id, '-', 3)::BIGINT <> start OR split_part(id, '-', 4)::BIGINT <> "end\"""")
def id_findings(t):
    k = F.floor(F.col("start") / 256) % 6
    bad = F.when(k == 2, F.lower("fragment_id")).when(k == 4, F.regexp_replace("fragment_id", "[0-9]+$", "7")).otherwise(F.col("fragment_id"))
    return ct.id_findings(v.fragments(t).select("media_id", "start", "end", bad.alias("id")), ["media_id", "start"], "id")


REC = """rec AS (SELECT o_orderkey AS id, ['complete', 'truncated', 'fragmented', 'partial_overlap', 'unknown'][o_orderkey % 5 + 1] AS completeness, (o_custkey % 101) / 100.0::DOUBLE AS confidence,
  CASE WHEN o_orderkey % 13 = 0 THEN 'none' ELSE 'carve' END AS method FROM orders)"""


@query("confidence_findings", f"""WITH {REC}, c AS (SELECT *, least(CASE completeness WHEN 'complete' THEN 1 WHEN 'truncated' THEN 0.85 WHEN 'fragmented' THEN 0.8 WHEN 'partial_overlap' THEN 0.7 ELSE 0.3 END, CASE WHEN method = 'none' THEN 0.3 ELSE 1 END)::DOUBLE AS ceiling FROM rec)
SELECT id, 'CONFIDENCE_ABOVE_CEILING' AS code FROM c WHERE confidence > ceiling UNION ALL SELECT id, 'CONFIDENCE_BELOW_FLOOR' FROM c WHERE completeness = 'complete' AND confidence < 0.6""")
def confidence_findings(t):
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(n) for n in ct.CEILINGS])
    rec = t.orders.select(
        k.alias("id"), F.get(names, (k % 5).cast("int")).alias("completeness"), ((F.col("o_custkey") % 101) / 100).alias("confidence"),
        F.when(k % 13 == 0, "none").otherwise("carve").alias("method"),
    )
    return ct.confidence_findings(rec, ["id"])


@query("origin_confidence", """WITH o AS (SELECT o_orderkey AS id, ['OBSERVED', 'COMPUTED', 'AI_ASSISTED', 'UNAVAILABLE', 'GUESSED'][o_orderkey % 5 + 1] AS origin, CASE WHEN o_custkey % 4 <> 0 THEN (o_custkey % 120) / 100.0::DOUBLE END AS c,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN '  short ' END AS b FROM orders), k AS (SELECT *, CASE origin WHEN 'AI_ASSISTED' THEN 0.7 WHEN 'GUESSED' THEN NULL ELSE 1.0 END::DOUBLE AS ceiling FROM o)
SELECT id, 'UNKNOWN_ORIGIN' AS code FROM k WHERE origin = 'GUESSED' UNION ALL SELECT id, 'UNAVAILABLE_WITH_CONFIDENCE' FROM k WHERE origin = 'UNAVAILABLE' AND (c IS NOT NULL OR b IS NOT NULL)
UNION ALL SELECT id, 'BASIS_WITHOUT_CONFIDENCE' FROM k WHERE origin <> 'UNAVAILABLE' AND c IS NULL AND b IS NOT NULL UNION ALL SELECT id, 'CONFIDENCE_OUT_OF_RANGE' FROM k WHERE origin <> 'UNAVAILABLE' AND NOT c BETWEEN 0 AND 1
UNION ALL SELECT id, 'CONFIDENCE_ABOVE_CEILING' FROM k WHERE origin <> 'UNAVAILABLE' AND c BETWEEN 0 AND 1 AND c > ceiling UNION ALL SELECT id, 'BASIS_TOO_SHORT' FROM k WHERE origin <> 'UNAVAILABLE' AND c IS NOT NULL AND length(trim(coalesce(b, ''))) < 8""")
def origin_confidence(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    names = F.array(*[F.lit(n) for n in ("OBSERVED", "COMPUTED", "AI_ASSISTED", "UNAVAILABLE", "GUESSED")])
    d = t.orders.select(
        k.alias("id"), F.get(names, (k % 5).cast("int")).alias("origin"), F.when(c % 4 != 0, (c % 120) / 100).alias("confidence"),
        F.when(k % 3 == 0, F.col("o_orderpriority")).when(k % 3 == 1, F.lit("  short ")).alias("confidence_basis"),
    )
    return ct.origin_confidence(d, ["id"])


@query("definitive_join", "SELECT l_orderkey, l_linenumber::BIGINT AS line FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'O'")
def definitive_join(t):
    d = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), (F.col("l_returnflag") == "R").alias("definitive"), (F.col("l_linestatus") == "O").alias("byte_contiguity"))
    return ct.definitive_join(d).select("l_orderkey", "line")


@query("timestamp_findings", """WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' WHEN 1 THEN strftime(ts, '%Y-13-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS v,
  CASE WHEN event_id % 7 = 3 THEN ' ' ELSE event_type END AS source, CASE WHEN event_id % 11 = 4 THEN NULL ELSE 'second' END AS precision FROM events)
SELECT event_id, 'TIMESTAMP_NOT_UTC' AS code FROM s WHERE event_id % 5 = 0 UNION ALL SELECT event_id, 'TIMESTAMP_INVALID' FROM s WHERE event_id % 5 = 1
UNION ALL SELECT event_id, 'SOURCE_MISSING' FROM s WHERE trim(source) = '' UNION ALL SELECT event_id, 'PRECISION_MISSING' FROM s WHERE precision IS NULL""")
def timestamp_findings(t):
    e = F.col("event_id")
    stamp = lambda f: F.date_format("ts", f)
    value = (
        F.when(e % 5 == 0, F.concat(stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).when(e % 5 == 1, stamp("yyyy-'13'-dd'T'HH:mm:ss'Z'")).otherwise(stamp("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    d = t.events.select("event_id", value.alias("value_utc"), F.when(e % 7 == 3, " ").otherwise(F.col("event_type")).alias("source"), F.when(e % 11 != 4, "second").alias("precision"))
    return ct.timestamp_findings(d, ["event_id"])


# ---- references --------------------------------------------------------------------------------------

REFS = f"""{v.FRAGMENTS}, refs AS (SELECT media_id, start, CASE start // 256 % 8 WHEN 1 THEN 'fragments[' || fragment_id || '].byte_range.start' WHEN 2 THEN 'fragments[' || upper(fragment_id) || 'x]' WHEN 3 THEN 'artifacts[ART-0' || start || ']'
  WHEN 4 THEN 'fragments[' || replace(fragment_id, 'FRG-', 'FRG-0')[1:20] || fragment_id[21:] || ']' WHEN 5 THEN 'case.title' WHEN 6 THEN 'bundle' ELSE 'fragments[' || fragment_id || ']' END AS ref, fragment_id FROM fragments),
parsed AS (SELECT *, regexp_extract(ref, '^(bundle|case|artifacts|fragments)', 1) AS root, regexp_extract(ref, '\\[([^\\]]+)\\]', 1) AS rid, NOT (start // 256 % 8 = 2) AND regexp_full_match(ref, '(?:bundle|case|artifacts\\[[A-Z]{{2,6}}(?:-[A-Z0-9]{{1,12}})*-[0-9]{{2,10}}\\]|fragments\\[FRG-[0-9a-f]{{16}}-[0-9]{{1,10}}-[0-9]{{1,10}}\\])(?:\\.[a-z][a-z0-9_]*){{0,2}}') AS ok FROM refs)"""


def refs(t):
    k = F.floor(F.col("start") / 256) % 8
    f = F.col("fragment_id")
    wrap = lambda x, tail="]": F.concat(F.lit("fragments["), x, F.lit(tail))
    other = F.concat(F.substring(F.replace(f, F.lit("FRG-"), F.lit("FRG-0")), 1, 20), F.substring(f, F.lit(21), F.length(f)))
    ref = (
        F.when(k == 1, wrap(f, "].byte_range.start")).when(k == 2, wrap(F.upper(f), "x]")).when(k == 3, F.concat(F.lit("artifacts[ART-0"), F.col("start").cast("string"), F.lit("]")))
        .when(k == 4, wrap(other)).when(k == 5, F.lit("case.title")).when(k == 6, F.lit("bundle")).otherwise(wrap(f))
    )
    return v.fragments(t).select("media_id", "start", "fragment_id", ref.alias("ref"))


@query("evidence_ref_parse", f"""WITH {REFS} SELECT media_id, start, CASE WHEN ok THEN root END AS ref_root, CASE WHEN ok THEN nullif(rid, '') END AS ref_id,
  CASE WHEN ok THEN CASE start // 256 % 8 WHEN 1 THEN 'byte_range.start' WHEN 5 THEN 'title' ELSE '' END ELSE '' END AS fields FROM parsed""")
def evidence_ref_parse(t):
    return ct.evidence_ref_parse(refs(t), "ref").select("media_id", "start", "ref_root", "ref_id", F.array_join("ref_fields", ".").alias("fields"))


@query("ground_refs", f"""WITH {REFS}, n AS (SELECT fragment_id AS rid, count(*) AS n FROM fragments GROUP BY fragment_id)
SELECT media_id, start, CASE WHEN NOT ok THEN 'unresolved' WHEN start // 256 % 8 IN (1, 3, 5) THEN 'unverifiable' WHEN root = 'bundle' OR n = 1 THEN 'resolved' ELSE 'unresolved' END AS status,
  CASE WHEN NOT ok THEN 'syntax_invalid' WHEN start // 256 % 8 IN (1, 5) THEN 'field_namespace_not_frozen' WHEN start // 256 % 8 = 3 THEN 'instance_id_namespace_not_frozen' WHEN root = 'bundle' OR n = 1 THEN NULL
    WHEN n IS NULL THEN 'instance_id_not_found' ELSE 'multiple_matches' END AS reason FROM parsed LEFT JOIN n USING (rid)""")
def ground_refs(t):
    records = v.fragments(t).select(F.lit("fragments").alias("collection"), F.col("fragment_id").alias("record_id"))
    return ct.ground_refs(refs(t).select("media_id", "start", "ref"), "ref", records).drop("ref")


@query("field_walk", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, NULL::VARCHAR AS missing FROM events")
def field_walk(t):
    return t.events.select("event_id", ct.field_walk(F.col("props"), "$.k", "bigint").alias("k"), ct.field_walk(F.col("props"), "$.a[0].b").alias("missing"))


# ---- bundles built from orders -----------------------------------------------------------------------


def bundles(t):
    """One bundle JSON per order, with defects driven by the order key."""
    k = F.col("o_orderkey")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    artifact = lambda i: F.concat(F.lit('{"artifact_id":"ART-'), F.lpad(i.cast("string"), 4, "0"), F.lit('","confidence":'), (i / 10).cast("string"), F.lit("}"))
    items = F.array_join(F.transform(F.sequence(F.lit(1), F.coalesce(F.col("n"), F.lit(1))), artifact), ",")
    parts = F.array_compact(
        F.array(
            F.when(k % 10 != 1, field("schema_version", quote(F.when(k % 10 == 2, "evidence_bundle/9.9").otherwise(VERSION)))),
            field("bundle_id", quote(F.concat(F.lit("BND-"), F.lpad(k.cast("string"), 8, "0")))),
            field("generated_utc", quote(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))),
            field("case", F.concat(F.lit('{"case_id":"CASE-'), F.col("o_custkey").cast("string"), F.lit('","total":'), F.col("o_totalprice").cast("string"), F.lit("}"))),
            field("acquisition", F.when(k % 10 == 3, F.lit("[]")).otherwise(F.lit("{}"))),
            F.when(k % 10 != 4, field("capabilities", F.lit("{}"))),
            field("artifacts", F.concat(F.lit("["), items, F.lit("]"))),
            field("engine", F.lit('{"name":"x"}')),
            F.when(k % 10 == 5, field("surprise", F.lit("1"))),
            F.when(k % 10 == 6, field("_note", F.lit("1"))),
            F.when(k % 10 == 7, field("fragments", F.lit("[]"))),
        )
    )
    d = t.orders.join(lines, "o_orderkey", "left")
    return d.select(F.col("o_orderkey").alias("bundle"), "o_custkey", F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("body"))


@query("root_contract", """SELECT o_orderkey AS bundle, ['schema_version', 'schema_version', 'acquisition', 'capabilities', 'surprise'][o_orderkey % 10] AS field, ['missing', 'version', 'type', 'missing', 'unauthorized'][o_orderkey % 10] AS problem
FROM orders WHERE o_orderkey % 10 BETWEEN 1 AND 5""")
def root_contract(t):
    return ct.root_contract(bundles(t), "bundle", "body", VERSION)


@query("schema_findings", """SELECT o_orderkey AS bundle, '$.schema_version' AS path, 'required' AS rule FROM orders WHERE o_orderkey % 10 = 1 UNION ALL SELECT o_orderkey, '$.schema_version', 'enum' FROM orders WHERE o_orderkey % 10 = 2
UNION ALL SELECT o_orderkey, '$.acquisition', 'type' FROM orders WHERE o_orderkey % 10 = 3 UNION ALL SELECT o_orderkey, '$.case.total', 'max' FROM orders WHERE o_totalprice > 300000""")
def schema_findings(t):
    rules = [
        ("$.schema_version", "required", None), ("$.schema_version", "enum", [VERSION]), ("$.acquisition", "type", "object"), ("$.case.total", "max", 300000),
        ("$.bundle_id", "pattern", "^" + ct.INSTANCE + "$"), ("$.case.total", "min", 0),
    ]
    return ct.schema_findings(bundles(t), "bundle", "body", rules)


@query("file_listing", """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS bundle, coalesce(n, 1)::BIGINT AS artifacts, CASE WHEN o_orderkey % 10 = 7 THEN 0 END::BIGINT AS fragments,
  NULL::BIGINT AS reconstruction_groups, NULL::BIGINT AS timeline_events, NULL::BIGINT AS known_file_matches FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""")
def file_listing(t):
    return ct.file_listing(bundles(t), "bundle", "body")


@query("validation_report", """SELECT ['missing', 'version', 'type', 'missing', 'unauthorized'][o_orderkey % 10] AS code, count(*) AS findings, count(*) AS records FROM orders WHERE o_orderkey % 10 BETWEEN 1 AND 5 GROUP BY 1""")
def validation_report(t):
    found = ct.root_contract(bundles(t), "bundle", "body", VERSION).withColumnRenamed("problem", "code")
    return ct.validation_report(found, "bundle")


_PRICE = "regexp_replace(printf('%.6f', o_totalprice), '\\.?0+$', '')"
CANON = f"""n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), items AS (SELECT o_orderkey, string_agg('{{"artifact_id":"ART-' || lpad(i::VARCHAR, 4, '0') || '","confidence":' || CASE WHEN i % 10 = 0 THEN (i // 10)::VARCHAR ELSE (i // 10) || '.' || i % 10 END || '}}', ',' ORDER BY i) AS items
  FROM (SELECT o_orderkey, unnest(generate_series(1, coalesce(n, 1))) AS i FROM orders LEFT JOIN n ON l_orderkey = o_orderkey) GROUP BY o_orderkey),
canon AS (SELECT o_orderkey, o_custkey, o_orderkey % 10 AS k, '{{"acquisition":' || CASE WHEN o_orderkey % 10 = 3 THEN '[]' ELSE '{{}}' END || ',"artifacts":[' || items || '],"bundle_id":"BND-' || lpad(o_orderkey::VARCHAR, 8, '0') || '"' || CASE WHEN o_orderkey % 10 = 4 THEN '' ELSE ',"capabilities":{{}}' END
  || ',"case":{{"case_id":"CASE-' || o_custkey || '","total":' || {_PRICE} || '}},"engine":{{"name":"x"}}' || CASE WHEN o_orderkey % 10 = 7 THEN ',"fragments":[]' ELSE '' END AS head,
  ',"generated_utc":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '"' AS stamp,
  CASE o_orderkey % 10 WHEN 1 THEN '' WHEN 2 THEN ',"schema_version":"evidence_bundle/9.9"' ELSE ',"schema_version":"evidence_bundle/1.0"' END || CASE WHEN o_orderkey % 10 = 5 THEN ',"surprise":1' ELSE '' END || '}}' AS tail FROM orders JOIN items USING (o_orderkey))"""


def canonical(t):
    """The canonical form of every bundle, written once for all that hash it."""
    return t.once("canonical", lambda: materialize(bundles(t).select("bundle", "o_custkey", ct.canonical_json("body").alias("canonical"))))


@query("canonical_json", f"WITH {CANON} SELECT o_orderkey AS bundle, head || stamp || tail AS canonical FROM canon")
def canonical_json(t):
    return bundles(t).select("bundle", ct.canonical_json("body").alias("canonical"))


@query("bundle_sha256", f"WITH {CANON} SELECT o_orderkey AS bundle, sha256(head || stamp || tail) AS bundle_sha256 FROM canon")
def bundle_sha256(t):
    return canonical(t).select("bundle", ct.canonical_sha256(F.col("canonical")).alias("bundle_sha256"))


@query("outputs_hash", f"WITH {CANON} SELECT o_orderkey AS bundle, sha256(head || tail) AS outputs_hash FROM canon")
def outputs_hash(t):
    return bundles(t).select("bundle", ct.canonical_sha256(ct.stable_json("body")).alias("outputs_hash"))


@query("report_id", f"WITH {CANON} SELECT o_orderkey AS bundle, 'RPT-' || sha256('{DOMAIN}' || chr(31) || 'CASE-' || o_custkey || chr(31) || sha256(head || stamp || tail) || chr(31) || '1.0')[1:12] AS report_id FROM canon")
def report_id(t):
    sha = ct.canonical_sha256(F.col("canonical"))
    case = F.concat(F.lit("CASE-"), F.col("o_custkey").cast("string"))
    return canonical(t).select("bundle", ct.report_id(DOMAIN, case, sha, F.lit("1.0")).alias("report_id"))


# ---- declared rules ----------------------------------------------------------------------------------


@query("score_component_check", """WITH c AS (SELECT l_orderkey, l_discount AS w, l_tax AS v, l_discount * l_tax + CASE WHEN l_partkey % 50 = 7 THEN 0.1 ELSE 0 END AS c FROM lineitem)
SELECT l_orderkey AS id, NOT bool_or(abs(c - w * v) > 1e-6) AS contributions_ok, abs(sum(c) - sum(CASE WHEN l_orderkey % 6 = 1 THEN 2 * c ELSE c END)) <= 1e-6 AS sum_ok FROM c GROUP BY l_orderkey""")
def score_component_check(t):
    contribution = F.col("l_discount") * F.col("l_tax") + F.when(F.col("l_partkey") % 50 == 7, 0.1).otherwise(0.0)
    part = F.struct(F.col("l_discount").alias("weight"), F.col("l_tax").alias("value"), contribution.alias("contribution"))
    # a score has a handful of components; the lines of one order are a bounded group
    d = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(part).alias("components"), F.sum(contribution * F.when(F.col("l_orderkey") % 6 == 1, 2).otherwise(1)).alias("score"))
    return ct.score_component_check(d, "id")


@query("priority_band", """WITH p AS (SELECT o_orderkey AS id, (o_custkey % 100) / 100.0::DOUBLE AS s, o_orderkey % 9 = 2 AS c, CASE WHEN o_orderkey % 7 = 3 THEN 12 ELSE 0 END AS g FROM orders)
SELECT id, CASE WHEN s >= 0.75 THEN 'critical' WHEN s >= 0.55 OR c OR g > 0 THEN 'high' WHEN s >= 0.35 THEN 'medium' ELSE 'low' END AS band, c OR g > 0 AS review FROM p""")
def priority_band(t):
    k = F.col("o_orderkey")
    band = ct.priority_band((F.col("o_custkey") % 100) / 100, k % 9 == 2, F.when(k % 7 == 3, 12).otherwise(0))
    return t.orders.select(k.alias("id"), band.alias("b")).select("id", "b.*")


@query("known_file_match", """WITH k AS (SELECT DISTINCT sha256(text) AS s FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, CASE WHEN sha256(text) IN (SELECT s FROM k) THEN 'known' WHEN lang = 'en' THEN 'no_match' ELSE 'unknown' END AS result FROM documents""")
def known_file_match(t):
    files = t.documents.select("doc_id", "lang", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    return ct.known_file_match(files, files.where("doc_id % 3 = 0"), "sha256", F.col("lang") == "en").select("doc_id", "result")


CLAIMS = """claims AS (SELECT event_id, user_id, event_type AS status, CASE WHEN event_id % 6 = 1 THEN NULL ELSE (event_id % 100) / 100.0::DOUBLE END AS confidence FROM events)"""


def claims(t):
    e = F.col("event_id")
    return t.events.select("event_id", "user_id", F.col("event_type").alias("status"), F.when(e % 6 != 1, (e % 100) / 100).alias("confidence"))


@query("uncertainty_summary", f"""WITH {CLAIMS} SELECT user_id, status, count(*) AS claims, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (confidence < 0.5) AS low_confidence, count(*) FILTER (confidence IS NULL) AS abstained FROM claims GROUP BY user_id, status""")
def uncertainty_summary(t):
    return ct.uncertainty_summary(claims(t), ["user_id"])


@query("low_confidence_ids", f"WITH {CLAIMS} SELECT event_id, confidence FROM claims WHERE confidence < 0.2")
def low_confidence_ids(t):
    return ct.low_confidence_ids(claims(t), "event_id", 0.2)


@query("group_summary", """SELECT l_orderkey AS group_id, count(*) AS members, round(min(1 - l_discount), 4) AS confidence, bool_and(l_linestatus = 'O') AS contiguous FROM lineitem GROUP BY l_orderkey""")
def group_summary(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("group_id")).agg(
        F.count("*").alias("members"), F.round(F.min(1 - F.col("l_discount")), 4).alias("confidence"), F.bool_and(F.col("l_linestatus") == "O").alias("contiguous")
    )


@query("in_critical_window", """WITH w AS (SELECT user_id, min(ts) + INTERVAL 2 HOUR AS a, min(ts) + INTERVAL 30 HOUR AS b FROM events GROUP BY user_id) SELECT event_id, user_id FROM events JOIN w USING (user_id) WHERE ts BETWEEN a AND b""")
def in_critical_window(t):
    first = t.events.groupBy("user_id").agg(F.min("ts").alias("m"))
    windows = first.select("user_id", F.expr("m + interval 2 hours").alias("window_from"), F.expr("m + interval 30 hours").alias("window_to"))
    return ct.in_critical_window(t.events, windows, "user_id", "ts").select("event_id", "user_id")


@query("timeline", """WITH l AS (SELECT l_orderkey, l_linenumber, unnest([l_shipdate, l_shipdate + INTERVAL 3 DAY]) AS ts, unnest([0, 1]) AS i FROM lineitem)
SELECT l_orderkey || '/' || l_linenumber AS record_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_utc, 'artifacts[ART-' || l_orderkey || '].timestamps[' || i || ']' AS basis_path, 'COMPUTED' AS status FROM l""")
def timeline(t):
    rec = t.lineitem.select(
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("record_id"),
        F.concat(F.lit("artifacts[ART-"), F.col("l_orderkey").cast("string"), F.lit("]")).alias("basis"),
        F.array("l_shipdate", F.expr("l_shipdate + interval 3 days")).alias("timestamps"),
    )
    return ct.timeline(rec).select("record_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_utc"), "basis_path", "status")


SESSIONS = """stages AS (SELECT user_id, ts::DATE AS day, ts, event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status FROM events),
sessions AS (SELECT user_id || '-' || day AS session_id, min(ts) AS submitted_at, count(*) AS stages, CASE WHEN bool_and(status = 'ok') THEN 'complete' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'partial' END AS session_status FROM stages GROUP BY user_id, day)"""


def stages(t):
    return t.events.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session_id"), "ts", "event_id",
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
    )


@query("session_status", f"WITH {SESSIONS} SELECT session_id, stages, session_status FROM sessions")
def session_status(t):
    return ct.session_status(stages(t), ["session_id"])


@query("list_sessions", f"""WITH {SESSIONS} SELECT session_id, strftime(submitted_at, '%Y-%m-%d %H:%M:%S') AS submitted, (SELECT count(*) FROM sessions) AS total FROM sessions ORDER BY submitted_at DESC, session_id DESC LIMIT 20 OFFSET 10""")
def list_sessions(t):
    s = stages(t).groupBy("session_id").agg(F.min("ts").alias("submitted_at"))
    return ct.list_sessions(s, 20, 10).select("session_id", F.date_format("submitted_at", "yyyy-MM-dd HH:mm:ss").alias("submitted"), "total")


@query("audit_number", """SELECT user_id, event_id, 'EVT-' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') AS audit_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""")
def audit_number(t):
    return ct.audit_number(t.events.select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], F.floor(F.unix_timestamp("ts") / 3600)).select("user_id", "event_id", "audit_id")
