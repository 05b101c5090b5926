"""What the sinks write, as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragloom.operators import recovery as rc
from fragloom.plans import views as v
from fragloom.plans.contract_queries import bundles
from fragloom.plans.recovery_queries import ART, artifacts
from fragloom.plans.registry import query
from fragloom.sources import bundles as bd


@query("bundle_read", """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), i AS (SELECT o_orderkey, unnest(generate_series(1, coalesce(n, 1))) AS i FROM orders LEFT JOIN n ON l_orderkey = o_orderkey WHERE o_orderkey % 10 <> 3)
SELECT 'BND-' || lpad(o_orderkey::VARCHAR, 8, '0') AS bundle_id, 'ART-' || lpad(i::VARCHAR, 4, '0') AS artifact_id FROM i""")
def bundle_read(t):
    """Artifacts table from bundle JSON; bundles whose acquisition has the wrong type are rejected."""
    return bd.bundle_parse(bundles(t), "body", "bundle")["artifacts"].select("bundle_id", "artifact_id")


@query("bundle_write", f"""WITH {v.FRAGMENTS}, p AS (SELECT media_id, start // 1048576 AS part, count(*) AS n FROM fragments GROUP BY media_id, start // 1048576)
SELECT media_id, part, 'BND-' || media_id || '-' || part AS bundle_id, n AS fragments FROM p""")
def bundle_write(t):
    media = v.media(t).select("media_id", F.col("size_bytes").alias("media_size"))
    states = media.select("media_id", F.lit("PARTIAL").alias("recovery_state"))
    rows = bd.bundle_rows(v.fragments(t), media, states, "evidence_bundle/1.0")
    return rows.select("media_id", "part", F.get_json_object("body", "$.bundle_id").alias("bundle_id"), F.json_array_length(F.get_json_object("body", "$.fragments")).cast("long").alias("fragments"))


@query("report_write", f"""WITH {ART}, s AS (SELECT case_id, count(*) AS total, count(*) FILTER (category = 'VERIFIED') AS verified, count(*) FILTER (category = 'RECOVERED') AS recovered, count(*) FILTER (category = 'PARTIAL') AS partial,
  count(*) FILTER (category = 'UNRECOVERABLE') AS unrecoverable FROM art GROUP BY case_id)
SELECT case_id, to_json({{'case_id': case_id, 'summary': {{'total': total, 'verified': verified, 'recovered': recovered, 'partial': partial, 'unrecoverable': unrecoverable}}, 'declarations': {{'read_only_enforced': true}}}})::VARCHAR AS report FROM s""")
def report_write(t):
    summary = rc.category_summary(artifacts(t), ["case_id"])
    cases = t.orders.select(F.col("o_custkey").alias("case_id")).distinct()
    return bd.report_rows(cases, summary, ["case_id"])
