"""Evaluation, split, damage and registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragloom.functions import tokens as tk
from fragloom.functions.blob import latin
from fragloom.operators import damage, datasets as ds, evaluate as ev
from fragloom.operators.scale import global_rank
from fragloom.plans import views as v
from fragloom.plans.registry import query
from fragloom.plans.token_queries import hits

# predictions of document quality by three rules, with the label table as truth
PRED = """pred AS (SELECT d.doc_id, l.quality AS truth, m.model, m.seq, CASE m.model WHEN 'length' THEN (n_chars > 800)::INT WHEN 'lines' THEN (len(string_split(text, chr(10))) > 4)::INT ELSE 1 END AS guess,
  m.model = 'length' AND n_chars BETWEEN 700 AND 900 AS abstained
  FROM documents d JOIN labels l USING (doc_id), (VALUES ('length', 0::BIGINT), ('lines', 1), ('constant', 2)) m(model, seq)),
named AS (SELECT *, CASE truth WHEN 1 THEN 'good' ELSE 'poor' END AS y, CASE WHEN abstained THEN 'UNKNOWN' WHEN guess = 1 THEN 'good' ELSE 'poor' END AS p FROM pred)"""
CELLS = PRED + """, lab AS (SELECT model, seq, y AS label FROM named UNION SELECT model, seq, p FROM named),
cm AS (SELECT lab.model, lab.seq, label, count(*) FILTER (y = label AND p = label) AS tp, count(*) FILTER (y = label) AS support, count(*) FILTER (p = label) AS predicted
  FROM lab JOIN named USING (model) GROUP BY lab.model, lab.seq, label),
r AS (SELECT *, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS rc FROM cm),
f1 AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f FROM r),
overall AS (SELECT model, seq, sum(support)::BIGINT AS samples, round(sum(tp) / sum(support)::DOUBLE, 4) AS accuracy, round(avg(f), 4) AS macro_f1,
  round(sum(f * support) / sum(support), 4) AS weighted_f1 FROM f1 GROUP BY model, seq)"""


def predictions(t):
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).cast("long").alias("seq")) for i, m in enumerate(("length", "lines", "constant"))])
    joined = t.documents.join(t.labels, "doc_id").select(
        "doc_id", "n_chars", F.size(F.split("text", "\n", -1)).alias("lines"), "quality", F.inline(models)
    )
    m = F.col("model")
    guess = F.when(m == "length", F.col("n_chars") > 800).when(m == "lines", F.col("lines") > 4).otherwise(True)
    abstained = (m == "length") & F.col("n_chars").between(700, 900)
    name = lambda c: F.when(c, "good").otherwise("poor")
    return joined.select(
        "doc_id", "model", "seq", name(F.col("quality") == 1).alias("y"), F.when(abstained, "UNKNOWN").otherwise(name(guess)).alias("p"), abstained.alias("abstained")
    )


@query("confusion_matrix", f"""WITH {PRED}, u AS (SELECT y AS l FROM named UNION SELECT p FROM named) SELECT u.l AS true_label,
  {", ".join(f"(SELECT count(*) FROM named WHERE model = 'length' AND y = u.l AND p = '{x}') AS pred_{x}" for x in ("good", "poor", "UNKNOWN"))},
  (SELECT count(*) FROM named WHERE model = 'length' AND y = u.l AND p NOT IN ('good', 'poor', 'UNKNOWN')) AS pred_other FROM u""")
def confusion_matrix(t):
    return ev.confusion_matrix(predictions(t).where("model = 'length'"), "y", "p", ["good", "poor", "UNKNOWN"])


@query("class_metrics", f"WITH {CELLS} SELECT model, label, round(pr, 4) AS precision, round(rc, 4) AS recall, round(f, 4) AS f1, support FROM f1")
def class_metrics(t):
    return ev.class_metrics(predictions(t), "y", "p", ["model"])


@query("overall_metrics", f"""WITH {CELLS}, a AS (SELECT model, round(avg(abstained::INT), 4) AS abstention_rate FROM named GROUP BY model)
SELECT model, samples, accuracy, macro_f1, weighted_f1, abstention_rate FROM overall JOIN a USING (model)""")
def overall_metrics(t):
    return ev.overall_metrics(predictions(t), "y", "p", "abstained", ["model"])


@query("compare_models", f"""WITH {CELLS} (SELECT 'macro_f1' AS criterion, model, macro_f1 AS score FROM overall ORDER BY macro_f1 DESC, seq LIMIT 1)
UNION ALL (SELECT 'accuracy', model, accuracy FROM overall ORDER BY accuracy DESC, seq LIMIT 1)""")
def compare_models(t):
    p = predictions(t)
    overall = ev.overall_metrics(p, "y", "p", "abstained", ["model", "seq"])
    return ev.compare_models(overall, "model", "seq")


@query("label_universe", f"WITH {PRED} SELECT y AS label FROM named UNION SELECT p FROM named")
def label_universe(t):
    return ev.label_universe(predictions(t), "y", "p")


@query("majority_label", """SELECT label::BIGINT AS label, n AS samples FROM (SELECT label, count(*) AS n, min(vec_id) AS s FROM embeddings GROUP BY label) ORDER BY n DESC, s LIMIT 1""")
def majority_label(t):
    return ev.majority_label(t.embeddings, "label", "vec_id").withColumn("label", F.col("label").cast("long"))


@query("abstain", """WITH p AS (SELECT vec_id, [exp(embedding[1]), exp(embedding[2]), exp(embedding[3])] AS e FROM embeddings),
q AS (SELECT vec_id, e[1] / list_sum(e) AS a, e[2] / list_sum(e) AS b, e[3] / list_sum(e) AS c FROM p), m AS (SELECT *, greatest(a, b, c) AS best FROM q)
SELECT vec_id, CASE WHEN best < 0.36 THEN 'UNKNOWN' WHEN a = best THEN 'first' WHEN b = best THEN 'second' ELSE 'third' END AS label, round(best, 6) AS confidence, best < 0.36 AS abstained FROM m""")
def abstain(t):
    e = F.transform(F.slice("embedding", 1, 3), lambda x: F.exp(x.cast("double")))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    probs = F.map_from_arrays(F.array(F.lit("first"), F.lit("second"), F.lit("third")), F.transform("e", lambda x: x / F.col("total")))
    d = t.embeddings.select("vec_id", e.alias("e")).withColumn("total", total)
    return d.select("vec_id", ev.abstain(probs, 0.36).alias("r")).select("vec_id", "r.label", F.round("r.confidence", 6).alias("confidence"), "r.abstained")


SPLITS = """n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, row_number() OVER (ORDER BY sha256('42:' || doc_id)) AS k FROM documents),
by_rank AS (SELECT doc_id, r, CASE WHEN r <= greatest(1, floor(n * 0.5)) THEN 'train' WHEN r <= greatest(1, floor(n * 0.5)) + greatest(1, floor(n * 0.2)) THEN 'validation'
  WHEN r <= greatest(1, floor(n * 0.5)) + 2 * greatest(1, floor(n * 0.2)) THEN 'test' ELSE 'hard_test' END AS split FROM ranked, n),
shuffled AS (SELECT doc_id, CASE WHEN k <= greatest(1, round_even(n * 0.6, 0)) THEN 'train' WHEN k <= greatest(1, round_even(n * 0.6, 0)) + greatest(1, round_even(n * 0.2, 0)) THEN 'validation'
  ELSE 'test' END AS split FROM ranked, n)"""


def by_rank(t):
    return ds.split_by_rank(t.documents.select("doc_id"), "doc_id")


def shuffled_split(t):
    return ds.split_shuffled(t.documents, "doc_id")


@query("split_by_rank", f"WITH {SPLITS} SELECT doc_id, split FROM by_rank")
def split_by_rank(t):
    return by_rank(t)


@query("split_shuffled", f"WITH {SPLITS} SELECT doc_id, split FROM shuffled")
def split_shuffled(t):
    return shuffled_split(t)


@query("severity_assign", f"""WITH {SPLITS}, i AS (SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS i FROM by_rank)
SELECT doc_id, CASE split WHEN 'hard_test' THEN 4 WHEN 'test' THEN 2 + i % 2 WHEN 'validation' THEN 1 + i % 2 ELSE i % 4 + 1 END::BIGINT AS severity FROM i""")
def severity_assign(t):
    ranked = global_rank(by_rank(t), "doc_id", "_r", ["split"])
    return ranked.select("doc_id", ds.severity_assign(F.col("split"), F.col("_r") - 1).alias("severity"))


@query("class_counts", f"""WITH {SPLITS} SELECT split, lang AS label, count(*) AS samples FROM by_rank JOIN documents USING (doc_id) GROUP BY split, lang""")
def class_counts(t):
    joined = t.documents.select("doc_id", F.col("lang").alias("label")).join(by_rank(t), "doc_id")
    return ev.dataset_summary(joined).drop("documents")


@query("dataset_summary", f"""WITH {SPLITS}, {v.BLOCKS} SELECT split, lang AS label, count(*) AS samples, count(DISTINCT doc_id) AS documents
FROM blocks JOIN shuffled USING (doc_id) JOIN documents USING (doc_id) GROUP BY split, lang""")
def dataset_summary(t):
    split = shuffled_split(t)
    docs = t.documents.select("doc_id", "lang", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("media_id")).join(split, "doc_id")
    blocks = v.blocks(t).select("media_id").join(docs, "media_id")
    return ev.dataset_summary(blocks.select("split", F.col("lang").alias("label"), "doc_id"))


@query("doc_leakage", f"""WITH {SPLITS}, s AS (SELECT doc_id, split FROM by_rank UNION ALL SELECT doc_id, split FROM shuffled) SELECT doc_id, count(DISTINCT split) AS splits FROM s GROUP BY doc_id HAVING count(DISTINCT split) > 1""")
def doc_leakage(t):
    return ds.leakage(by_rank(t).unionByName(shuffled_split(t)), "doc_id")


@query("source_hash_leakage", f"""WITH {SPLITS} SELECT sha256(text) AS source_sha256, count(DISTINCT split) AS splits FROM shuffled JOIN documents USING (doc_id) GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def source_hash_leakage(t):
    hashed = t.documents.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("source_sha256"))
    return ds.leakage(hashed.join(shuffled_split(t), "doc_id"), "source_sha256")


@query("combine_confidence", "SELECT user_id, event_type, min(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 1000 END) AS confidence FROM events GROUP BY user_id, event_type")
def combine_confidence(t):
    return ev.combine_confidence(
        t.events.withColumn("confidence", F.when(F.col("event_id") % 3 != 0, F.col("value") / 1000)), ["user_id", "event_type"], "confidence"
    )


@query("token_jaccard", """WITH p AS (SELECT c.conv_id, c.turn, c.text AS a, n.text AS b FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1),
k AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(a), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(b), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS y FROM p)
SELECT conv_id, turn, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 3) END::DOUBLE AS jaccard FROM k""")
def token_jaccard(t):
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("a"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", ev.token_jaccard(F.col("a"), F.col("b")).alias("jaccard"))


# ---- damage ------------------------------------------------------------------------------------------

_N = "octet_length(content)::BIGINT"
_CLAMP = f"least(doc_id % 400, greatest({_N} - 1, 0))"
DAMAGE = f"""{v.MEDIA}, o AS (SELECT *, {_N} AS n, {_CLAMP} AS s, least({_CLAMP} + 100 + doc_id % 50, {_N}) AS e FROM media),
d AS (SELECT media_id, n, 'delete' AS kind, content[1:s] || content[e + 1:] AS out, s AS a, e AS b, e - s AS before, 0::BIGINT AS after FROM o
  UNION ALL SELECT media_id, n, 'truncate', content[1:least(n, 300)], least(n, 300), n, n - least(n, 300), 0 FROM o
  UNION ALL SELECT media_id, n, 'zero', content[1:s] || unhex(repeat('00', (e - s)::BIGINT)) || content[e + 1:], s, e, e - s, e - s FROM o
  UNION ALL SELECT media_id, n, 'noise', content[1:s] || unhex(array_to_string(list_transform(range(0, (greatest(e - s, 1) - 1) // 32 + 1), lambda i: sha256('7/' || media_id || ':' || i)), ''))[1:e - s] || content[e + 1:], s, e, e - s, e - s FROM o
  UNION ALL SELECT media_id, n, 'duplicate', content[1:n // 2] || content[s + 1:e] || content[n // 2 + 1:], n // 2, n // 2 + e - s, 0, e - s FROM o
  UNION ALL SELECT media_id, n, 'insert', content[1:s2] || encode('@@GARBAGE@@') || content[s2 + 1:], s2, s2 + 11, 0, 11 FROM (SELECT *, least(doc_id % 400, n) AS s2 FROM o))"""


def damaged_kinds(t):
    doc = F.regexp_extract("media_id", r"(\d+)$", 1).cast("long")
    media = v.media(t).where("size_bytes > 0")
    at, size = F.pmod(doc, F.lit(400)), F.pmod(doc, F.lit(50)) + 100
    seed = F.concat(F.lit("7/"), F.col("media_id"))
    runs = {
        "delete": damage.apply(media, "delete", at, size),
        "truncate": damage.apply(media, "truncate", F.lit(300)),
        "zero": damage.apply(media, "zero", at, size),
        "noise": damage.apply(media, "noise", at, size, seed=seed),
        "duplicate": damage.apply(media, "duplicate", at, size, position=F.floor(F.col("size_bytes") / 2)),
        "insert": damage.apply(media, "insert", at, garbage=F.encode(F.lit("@@GARBAGE@@"), "UTF-8")),
    }
    out = None
    for kind, df in runs.items():
        part = df.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("damage_bytes", f"""WITH {DAMAGE} SELECT media_id, kind, sha256(out) AS sha256, a AS offset_start, b AS offset_end, before AS original_length, after AS corrupted_length,
  round(greatest(before, after) / greatest(n, 1)::DOUBLE, 3) AS severity FROM d WHERE n > 0""")
def damage_bytes(t):
    o = "operation."
    return damaged_kinds(t).select(
        "media_id", "kind", F.sha2("content", 256).alias("sha256"), o + "offset_start", o + "offset_end", o + "original_length", o + "corrupted_length", o + "severity"
    )


@query("delta_objects", f"""WITH {v.PDF}, o AS (SELECT media_id, list_sort(list_distinct(list_transform(regexp_extract_all(doc, '(?:^|[ \\t\\n\\r\\f])([0-9]+)[ \\t\\n\\r\\f]+0[ \\t\\n\\r\\f]+obj', 1), lambda s: s::BIGINT))) AS a,
  list_sort(list_distinct(list_transform(regexp_extract_all(doc[1:length(doc) // 2], '(?:^|[ \\t\\n\\r\\f])([0-9]+)[ \\t\\n\\r\\f]+0[ \\t\\n\\r\\f]+obj', 1), lambda s: s::BIGINT))) AS b FROM pdf)
SELECT media_id, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS removed, array_to_string(list_filter(a, lambda x: list_contains(b, x)), ',') AS surviving FROM o""")
def delta_objects(t):
    halves = object_sets(t)
    delta = ds.delta_objects(F.col("a"), F.col("b"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return halves.select("media_id", text(delta["removed"]).alias("removed"), text(delta["surviving"]).alias("surviving"))


def object_sets(t):
    """Object numbers of each PDF layout and of its first half."""
    text = v.pdf_media(t).select("media_id", latin(F.col("content")).alias("t"))
    numbers = lambda c: tk.inventory(c)["object_numbers"]
    half = F.substring(F.col("t"), F.lit(1), F.floor(F.length("t") / 2).cast("int"))
    return text.select("media_id", numbers(F.col("t")).alias("a"), numbers(half).alias("b"))


@query("recovered_originals", f"""WITH {v.PDF}, p AS (SELECT media_id, unnest(list_distinct(regexp_extract_all(doc, '(?:^|[ \\t\\n\\r\\f])([0-9]+)[ \\t\\n\\r\\f]+0[ \\t\\n\\r\\f]+obj', 1)))::BIGINT AS o FROM pdf),
q AS (SELECT media_id, unnest(list_distinct(regexp_extract_all(doc[1:length(doc) // 2], '(?:^|[ \\t\\n\\r\\f])([0-9]+)[ \\t\\n\\r\\f]+0[ \\t\\n\\r\\f]+obj', 1)))::BIGINT AS o FROM pdf)
SELECT media_id, o AS object_number FROM p INTERSECT SELECT media_id, o FROM q""")
def recovered_originals(t):
    s = object_sets(t)
    # outer explodes: for an emptiness filter Spark would build and search each text once more, in the tasks of the scan
    side = lambda c: s.select("media_id", F.explode_outer(c).alias("object_number")).where("object_number is not null")
    return side("a").intersect(side("b"))


@query("damage_states", f"""WITH {v.PDF}, p AS (SELECT media_id, doc, unnest(list_distinct(regexp_extract_all(doc, '(?:^|[ \\t\\n\\r\\f])([0-9]+)[ \\t\\n\\r\\f]+0[ \\t\\n\\r\\f]+obj', 1)))::BIGINT AS o FROM pdf)
SELECT media_id, o AS object, CASE WHEN NOT regexp_matches(doc[1:length(doc) // 2], '(?:^|[ \\t\\n\\r\\f])' || o || '[ \\t\\n\\r\\f]+0[ \\t\\n\\r\\f]+obj') THEN 'MISSING' WHEN o IN (1, 4) THEN 'PARTIALLY_DAMAGED' ELSE 'INTACT' END AS state FROM p""")
def damage_states(t):
    states = ds.damage_states(F.col("a"), F.array_except("a", "b"), F.array(F.lit(1).cast("long"), F.lit(4).cast("long")))
    return object_sets(t).select("media_id", F.inline_outer(states)).where("object is not null")


SAMPLES = f"""{v.PDF}, {SPLITS}, cut AS (SELECT doc_id, media_id, doc, doc[1:floor(length(doc) * (0.4 + 0.1 * (doc_id % 6)))::BIGINT] AS dmg FROM pdf),
m AS (SELECT doc_id, split, length(doc) AS original_size, length(dmg) AS authentic_bytes, {hits("doc", "[0-9]+ 0 obj")} AS oo, {hits("dmg", "[0-9]+ 0 obj")} AS ro,
  {hits("doc", "\\bstream\\b")} AS os, {hits("dmg", "\\bstream\\b")} AS rs, {hits("doc", "\\([^)\\r\\n]{4,}\\)")} AS ot, {hits("dmg", "\\([^)\\r\\n]{4,}\\)")} AS rt,
  {hits("doc", "/Type */Page\\b")} AS op, {hits("dmg", "/Type */Page\\b")} AS rp, contains(dmg, '%%EOF') AS ok FROM cut JOIN by_rank USING (doc_id)),
pct AS (SELECT doc_id, split, round(authentic_bytes / original_size::DOUBLE * 100, 2) AS byte_pct, coalesce(round(ro / nullif(oo, 0)::DOUBLE * 100, 2), 100) AS object_pct, coalesce(round(rs / nullif(os, 0)::DOUBLE * 100, 2), 100) AS stream_pct,
  coalesce(round(rt / nullif(ot, 0)::DOUBLE * 100, 2), 100) AS text_pct, coalesce(round(rp / nullif(op, 0)::DOUBLE * 100, 2), 100) AS page_pct, ok FROM m)"""


def samples(t):
    """PDF layouts cut to 40..90 %, measured against the whole."""
    doc = F.regexp_extract("media_id", r"(\d+)$", 1).cast("long")
    keep = F.floor(F.length("t") * (F.pmod(doc, F.lit(6)) * 0.1 + 0.4)).cast("int")
    d = v.pdf_media(t).select("media_id", doc.alias("doc_id"), latin(F.col("content")).alias("t")).withColumn("d", F.substring("t", F.lit(1), keep))
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("long")
    text = r"\([^)\r\n]{4,}\)"
    page = "/Type */Page" + tk.RIGHT
    stream = tk.LEFT + "stream" + tk.RIGHT
    return d.select(
        "doc_id",
        F.length("t").cast("long").alias("original_size"), F.length("d").cast("long").alias("authentic_bytes"),
        tk.inventory(F.col("t"))["object_numbers"].alias("original_objects"), tk.inventory(F.col("d"))["object_numbers"].alias("recovered_objects"),
        count("t", stream).alias("original_streams"), count("d", stream).alias("recovered_streams"),
        count("t", text).alias("original_strings"), count("d", text).alias("recovered_strings"),
        count("t", page).alias("original_pages"), count("d", page).alias("recovered_pages"),
        F.contains("d", F.lit("%%EOF")).alias("parser_valid"),
    ).join(by_rank(t), "doc_id")


@query("sample_metrics", f"WITH {SAMPLES} SELECT doc_id, byte_pct, object_pct::DOUBLE AS object_pct, stream_pct::DOUBLE AS stream_pct, text_pct::DOUBLE AS text_pct, page_pct::DOUBLE AS page_pct FROM pct")
def sample_metrics(t):
    return ev.sample_metrics(samples(t)).select("doc_id", "byte_pct", "object_pct", "stream_pct", "text_pct", "page_pct")


@query("split_metrics", f"""WITH {SAMPLES} SELECT split, count(*) AS samples, {", ".join(f"round(avg({c}), 2) AS avg_{c}" for c in ("byte_pct", "object_pct", "stream_pct", "text_pct", "page_pct"))},
  round(avg(ok::INT) * 100, 2) AS validity_rate FROM pct GROUP BY split""")
def split_metrics(t):
    return ev.split_metrics(ev.sample_metrics(samples(t)))


@query("element_rates", f"""WITH {SAMPLES} SELECT doc_id, CASE WHEN op > 0 THEN least(1, rp / op::DOUBLE) ELSE 1 END::DOUBLE AS page_rate, CASE WHEN os > 0 THEN least(1, rs / os::DOUBLE) ELSE 1 END::DOUBLE AS image_rate,
  1.0::DOUBLE AS equation_rate FROM m""")
def element_rates(t):
    zero = F.lit(0)
    return samples(t).select(
        "doc_id", ev.element_rate(F.col("recovered_pages"), F.col("original_pages")).alias("page_rate"),
        ev.element_rate(F.col("recovered_streams"), F.col("original_streams")).alias("image_rate"), ev.element_rate(zero, zero).alias("equation_rate"),
    )


@query("controlled_summary", f"""WITH {SAMPLES} SELECT count(*) AS samples, round(avg(byte_pct), 2) AS avg_byte_pct, round(avg(CASE WHEN op > 0 THEN least(1, rp / op::DOUBLE) ELSE 1 END), 3) AS avg_page_rate,
  round(avg(pct.ok::INT) * 100, 2) AS validity_rate FROM pct JOIN m USING (doc_id)""")
def controlled_summary(t):
    d = ev.sample_metrics(samples(t))
    return d.agg(
        F.count("*").alias("samples"), F.round(F.avg("byte_pct"), 2).alias("avg_byte_pct"),
        F.round(F.avg(ev.element_rate(F.col("recovered_pages"), F.col("original_pages"))), 3).alias("avg_page_rate"),
        F.round(F.avg(F.col("parser_valid").cast("double")) * 100, 2).alias("validity_rate"),
    )


@query("damaged_summary", """SELECT count(*) AS samples, round(avg((html LIKE '%</html>%')::INT) * 100, 2) AS validity_rate, sum(len(regexp_extract_all(html, '<p>')))::BIGINT AS text_blocks,
  sum(len(regexp_extract_all(html, '<table')))::BIGINT AS tables FROM pages""")
def damaged_summary(t):
    """Damaged pages have no truth: only counts, no recovery percentages."""
    n = lambda p: F.sum(F.regexp_count("html", F.lit(p)).cast("long"))
    return t.pages.agg(
        F.count("*").alias("samples"), F.round(F.avg(F.contains("html", F.lit("</html>")).cast("double")) * 100, 2).alias("validity_rate"),
        n("<p>").alias("text_blocks"), n("<table").alias("tables"),
    )


@query("registry_filter", """SELECT doc_id, source, lang, n_chars >= 500 AS is_intact FROM documents WHERE source = (SELECT min(source) FROM documents) AND lang = 'en' AND n_chars >= 500""")
def registry_filter(t):
    first = t.documents.agg(F.min("source")).scalar()
    reg = t.documents.where(F.col("source") == first).select(
        "doc_id", "source", "lang", (F.col("n_chars") >= 500).alias("is_intact"), F.array("lang").alias("characteristics")
    )
    return ds.registry_filter(reg, characteristic="en", intact=True).drop("characteristics")


@query("registry_upsert", """SELECT doc_id, lang, source FROM documents WHERE doc_id % 5 <> 1 UNION ALL SELECT doc_id, 'xx', source FROM documents WHERE doc_id % 5 = 1
UNION ALL SELECT doc_id + 10000000, 'new', source FROM documents WHERE doc_id % 7 = 2""")
def registry_upsert(t):
    reg = t.documents.select("doc_id", "lang", "source")
    changed = reg.where("doc_id % 5 = 1").withColumn("lang", F.lit("xx"))
    added = reg.where("doc_id % 7 = 2").select((F.col("doc_id") + 10000000).alias("doc_id"), F.lit("new").alias("lang"), "source")
    return ds.registry_upsert(reg, changed.unionByName(added), "doc_id")


@query("index_mismatch", """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'not_indexed' ELSE 'not_stored' END AS issue
FROM (SELECT doc_id FROM documents WHERE doc_id % 10 <> 3) d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def index_mismatch(t):
    return ds.index_mismatch(t.documents.where("doc_id % 10 <> 3"), t.labels, "doc_id")


@query("sample_findings", f"""WITH {v.DAMAGED}, s AS (SELECT m.doc_id AS sample_id, m.doc_id % 6 AS k FROM media m JOIN damaged d USING (media_id))
SELECT sample_id, CASE k WHEN 1 THEN 'manifest_source_mismatch' WHEN 2 THEN 'missing_damaged' WHEN 3 THEN 'truth_damaged_mismatch' WHEN 4 THEN 'bad_operation_bounds' ELSE 'duplicate_sample_id' END AS issue FROM s WHERE k BETWEEN 1 AND 5""")
def sample_findings(t):
    doc = F.regexp_extract("media_id", r"(\d+)$", 1).cast("long")
    k = F.pmod(F.col("sample_id"), F.lit(6))
    original = v.media(t).select(doc.alias("sample_id"), F.col("content").alias("original"))
    copy = v.damaged(t).select(doc.alias("sample_id"), F.col("content").alias("damaged"))
    sha = lambda c: F.sha2(c, 256)
    s = original.join(copy, "sample_id").select(
        "sample_id", "original", F.when(k != 2, F.col("damaged")).alias("damaged"),
        F.when(k == 1, F.lit("00")).otherwise(sha("original")).alias("manifest_source_sha256"), sha("damaged").alias("manifest_damaged_sha256"),
        sha("original").alias("truth_source_sha256"), F.when(k == 3, F.lit("00")).otherwise(sha("damaged")).alias("truth_damaged_sha256"),
        F.array(F.struct(F.lit(5).alias("offset_start"), F.when(k == 4, 1).otherwise(9).alias("offset_end"))).alias("operations"),
    )
    return ds.sample_findings(s.unionByName(s.where(k == 5)))


# ---- damage at patterns and named recipes --------------------------------------------------------------

_W = "[ \\t\\r\\n\\f]"
PATTERN_SQL = {
    "damage_xref": "regexp_replace(doc, '(?s)^(.*)xref', '\\1x_ef')",
    "damage_startxref": "regexp_replace(doc, '(?s)^(.*)startxref', '\\1start_ref')",
    "damage_length": f"regexp_replace(doc, '(/Length{_W}+)[0-9]+', '\\199999')",
    "damage_page_tree": f"regexp_replace(doc, '(/Kids{_W}*\\[)[^\\]]+', '\\1 ')",
    "damage_font_references": f"regexp_replace(doc, '(/BaseFont{_W}*/)[A-Za-z0-9_-]+', '\\1DamagedFontMissing')",
    "remove_content_ref": f"regexp_replace(doc, '/Contents{_W}+[0-9]+{_W}+0{_W}+R', '')",
    "remove_stream_suffix": "regexp_replace(doc, 'endstream', '')",
    "remove_text_operators": f"regexp_replace(doc, '\\([^)\\r\\n]*\\){_W}*Tj', '')",
    "remove_image_object": "doc",
}


@query("damage_pattern", f"WITH {v.PDF} " + " UNION ALL ".join(f"SELECT media_id, '{n}' AS pattern, sha256({e}) AS sha256 FROM pdf" for n, e in PATTERN_SQL.items()))
def damage_pattern(t):
    media = v.pdf_media(t)
    out = None
    for name in PATTERN_SQL:
        d = damage.damage_pattern(media, name).select("media_id", F.lit(name).alias("pattern"), F.sha2("content", 256).alias("sha256"))
        out = d if out is None else out.unionByName(d)
    return out


@query("damage_pattern_all")
def damage_pattern_all(t):
    media = v.pdf_media(t)
    out = None
    for name in damage.PATTERNS:
        d = damage.damage_pattern(media, name).select("media_id", F.lit(name).alias("pattern"), "operation.type", "operation.offset_start", "operation.offset_end", F.length("content").alias("size"))
        out = d if out is None else out.unionByName(d)
    return out


_AT = "(length(doc) * 2 // 5 // 512 * 512)"
RECIPE_SQL = {
    "mangled_header": f"'{damage.PREAMBLE}' || regexp_replace(doc, '%PDF-[0-9]+\\.[0-9]+', 'XPDF-CORRUPT')",
    "destroyed_xref_trailer": "rtrim(doc[1:instr(doc, chr(10) || 'xref') - 1], chr(32) || chr(10) || chr(13) || chr(9))",
    "mutated_stream_lengths": f"regexp_replace(doc, '/Length{_W}+[0-9]+', '/Length 999999', 'g')",
    "null_byte_sectors": f"CASE WHEN length(doc) < 1024 THEN encode(doc) ELSE encode(doc[1:{_AT}]) || unhex(repeat('00', least(512, length(doc) - {_AT})::BIGINT)) || encode(doc[{_AT} + 513:]) END",
    "arbitrary_truncation": "doc[1:greatest(64, floor(length(doc) * 0.65)::BIGINT)]",
    "orphan_pages": f"regexp_replace(regexp_replace(doc, '/Type{_W}*/Catalog\\b', '/Type /Cata_og', 'g'), '/Type{_W}*/Pages\\b', '/Type /Pag_s', 'g')",
}


@query("damage_recipe", f"WITH {v.PDF} " + " UNION ALL ".join(f"SELECT media_id, '{n}' AS recipe, sha256({e}) AS sha256, {damage.RECIPES[n]}::DOUBLE AS expected_authentic FROM pdf" for n, e in RECIPE_SQL.items()))
def damage_recipe(t):
    return recipes(t, list(RECIPE_SQL))


def recipes(t, names):
    media = v.pdf_media(t)
    out = None
    for name in names:
        d = damage.damage_recipe(media, name).select("media_id", "recipe", F.sha2("content", 256).alias("sha256"), "expected_authentic")
        out = d if out is None else out.unionByName(d)
    return out


@query("damage_recipe_keyed")
def damage_recipe_keyed(t):
    """The recipes without a SQL twin: every second endobj, flate headers and keyed scrambling."""
    return recipes(t, [n for n in damage.RECIPES if n not in RECIPE_SQL])


@query("damage_by_severity")
def damage_by_severity(t):
    out = None
    for level in range(5):
        d = damage.damage_by_severity(v.pdf_media(t), level, 42).select(
            "media_id", "severity_level", F.size("operations").alias("operations"), F.length("content").alias("size"), F.sha2("content", 256).alias("sha256")
        )
        out = d if out is None else out.unionByName(d)
    return out


@query("controlled_variants")
def controlled_variants(t):
    split = by_rank(t).select(F.concat(F.lit("pdf-"), F.col("doc_id").cast("string")).alias("media_id"), "split")
    d = damage.controlled_variants(v.pdf_media(t), split)
    return d.select("sample_id", "media_id", "split", "severity_level", "seed", F.size("operations").alias("operations"), "preserves_content", "damaged_sha256")


MODELS = """models AS (SELECT 'M-' || p_partkey AS model_id, p_type AS task, p_size % 3 <> 0 AS commercial_use_permitted, p_partkey % 4 <> 1 AS cpu_compatible,
  CASE p_size % 2 WHEN 0 THEN 'LOCAL_CPU' ELSE 'WORKER_BACKGROUND' END AS execution_mode, p_retailprice AS model_size_mb FROM part)"""


def models(t):
    return t.part.select(
        F.concat(F.lit("M-"), F.col("p_partkey").cast("string")).alias("model_id"), F.col("p_type").alias("task"), (F.col("p_size") % 3 != 0).alias("commercial_use_permitted"),
        (F.col("p_partkey") % 4 != 1).alias("cpu_compatible"), F.when(F.col("p_size") % 2 == 0, "LOCAL_CPU").otherwise("WORKER_BACKGROUND").alias("execution_mode"), F.col("p_retailprice").alias("model_size_mb"),
    )


@query("model_catalog_filter", f"WITH {MODELS} SELECT model_id, task FROM models WHERE task = 'ECONOMY' AND commercial_use_permitted AND cpu_compatible")
def model_catalog_filter(t):
    return ds.model_catalog_filter(models(t), "ECONOMY", True, True).select("model_id", "task")


@query("model_compliance", f"""WITH {MODELS}, i AS (SELECT model_id, concat_ws(',', CASE WHEN NOT commercial_use_permitted THEN 'license_restricts_commercial_use' END, CASE WHEN NOT cpu_compatible AND execution_mode = 'LOCAL_CPU' THEN 'gpu_model_on_local_cpu' END,
  CASE WHEN model_size_mb > 500 AND execution_mode <> 'WORKER_BACKGROUND' THEN 'size_over_500_mb' END) AS issues FROM models) SELECT model_id, issues = '' AS valid, issues FROM i""")
def model_compliance(t):
    return ds.model_compliance(models(t)).withColumn("issues", F.array_join("issues", ","))


@query("corpus_pass_rate", "SELECT count(*) AS items, round(avg((html LIKE '%<p>%' AND html LIKE '<!DOCTYPE%')::INT), 4) AS pass_rate FROM pages")
def corpus_pass_rate(t):
    openable = F.contains("html", F.lit("<p>")) & F.startswith("html", F.lit("<!DOCTYPE"))
    return t.pages.agg(F.count("*").alias("items"), F.round(F.avg(openable.cast("double")), 4).alias("pass_rate"))
