"""Page element queries over the lines of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragloom.functions import text as tx
from fragloom.operators import layout as ly
from fragloom.plans.registry import query

# every line becomes an element; some lines are given table, caption or formula shape around their words
ELEMENTS = """lines AS (SELECT doc_id, i - 1 AS seq, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS i FROM documents)),
el AS (SELECT doc_id, seq, 'el-' || doc_id || '-' || seq AS element_id, seq // 24 AS page, (seq % 24 * 28 + 50)::DOUBLE AS y1, (seq % 24 * 28 + 50 + 22 + 30 * (doc_id % 2))::DOUBLE AS y2,
  CASE (doc_id + seq) % 3 WHEN 2 THEN 320.0 ELSE 54.0 END::DOUBLE AS x1, CASE (doc_id + seq) % 3 WHEN 1 THEN 290.0 ELSE 558.0 END::DOUBLE AS x2,
  CASE seq % 7 WHEN 3 THEN 'Figure ' || seq || ': ' || line[1:30] WHEN 4 THEN 'x = ' || line[1:5] || '^2 + ' || seq || '  (' || seq || ')' WHEN 5 THEN 'Table ' || seq || chr(10) || replace(line[1:40], ' ', ' | ') || chr(10) || 'left | ' || seq || ' |' || chr(10) || 'only'
    WHEN 6 THEN (seq + 1) || ' of ' || (seq + 9) ELSE line END AS content, CASE WHEN seq % 9 = 8 THEN 'image' ELSE 'text_block' END AS type FROM lines)"""
_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(13))"
C = _TRIM.format("content")
ZONES = ELEMENTS + f""", zoned AS (SELECT *, CASE WHEN type = 'image' THEN 'kept' WHEN y1 <= 792 * 0.12 AND y2 <= 792 * 0.18 THEN 'header' WHEN y2 >= 792 * 0.9 THEN 'footer' ELSE 'body' END AS zone FROM el),
cols AS (SELECT *, CASE WHEN zone = 'body' AND (x1 + x2) / 2 >= 306 THEN 1 ELSE 0 END::BIGINT AS column_index, CASE WHEN zone IN ('header', 'footer') THEN zone ELSE type END AS kind FROM zoned)"""


def lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select(
        "doc_id", F.col("p").cast("long").alias("seq"), "line"
    )


def elements(t):
    d, s, line = F.col("doc_id"), F.col("seq"), F.col("line")
    text = lambda c: c.cast("string")
    head = lambda n: F.substring(line, 1, n)
    k = s % 7
    content = (
        F.when(k == 3, F.concat(F.lit("Figure "), text(s), F.lit(": "), head(30)))
        .when(k == 4, F.concat(F.lit("x = "), head(5), F.lit("^2 + "), text(s), F.lit("  ("), text(s), F.lit(")")))
        .when(k == 5, F.concat(F.lit("Table "), text(s), F.lit("\n"), F.replace(head(40), F.lit(" "), F.lit(" | ")), F.lit("\nleft | "), text(s), F.lit(" |\nonly")))
        .when(k == 6, F.concat(text(s + 1), F.lit(" of "), text(s + 9)))
        .otherwise(line)
    )
    place = (d + s) % 3
    return lines(t).select(
        "doc_id", "seq", F.concat_ws("-", F.lit("el"), text(d), text(s)).alias("element_id"), F.floor(s / 24).alias("page"),
        (s % 24 * 28 + 50).cast("double").alias("y1"), (s % 24 * 28 + 72 + d % 2 * 30).cast("double").alias("y2"),
        F.when(place == 2, 320.0).otherwise(54.0).alias("x1"), F.when(place == 1, 290.0).otherwise(558.0).alias("x2"),
        content.alias("content"), F.when(s % 9 == 8, "image").otherwise("text_block").alias("type"),
    )


def zoned(t):
    z = ly.layout_zone(elements(t))
    return z.withColumn("type", F.when(F.col("zone").isin("header", "footer"), F.col("zone")).otherwise(F.col("type")))


@query("layout_zone", f"""WITH {ZONES} SELECT element_id, zone, zone = 'footer' AND regexp_matches({C}, '(?i)^(?:page\\s+)?[0-9]+(?:\\s*(?:of|/)\\s*[0-9]+)?$') AS is_page_number, column_index FROM cols""")
def layout_zone(t):
    return ly.layout_zone(elements(t)).select("element_id", "zone", "is_page_number", "column_index")


_POS = "row_number() OVER (PARTITION BY doc_id, page ORDER BY band, {}, seq) - 1 AS position"


@query("reading_order_bands", f"""WITH {ZONES}, b AS (SELECT *, CASE WHEN kind = 'header' OR y1 <= 792 * 0.12 THEN 0 WHEN kind = 'footer' OR y2 >= 792 * 0.9 THEN 4 WHEN x2 - x1 > 612 * 0.75 THEN 0 WHEN (x1 + x2) / 2 < 306 THEN 1 ELSE 2 END::BIGINT AS band FROM cols)
SELECT element_id, page, band, {_POS.format("y1, x1")} FROM b""")
def reading_order_bands(t):
    return ly.reading_order_bands(zoned(t)).select("element_id", "page", "band", "position")


@query("reading_order_layout", f"""WITH {ZONES}, b AS (SELECT *, CASE WHEN kind = 'header' THEN 0 WHEN x2 - x1 > 612 * 0.6 AND y1 < 250 THEN 1 WHEN column_index = 0 THEN 2 WHEN column_index = 1 THEN 3 ELSE 4 END::BIGINT AS band FROM cols)
SELECT element_id, page, band, {_POS.format("y1, x1")} FROM b""")
def reading_order_layout(t):
    return ly.reading_order_layout(zoned(t)).select("element_id", "page", "band", "position")


SIZE = "(10 + seq % 4 * 2.5)::DOUBLE"
HEADING = f"CASE WHEN {SIZE} >= 16 THEN 1 WHEN {SIZE} >= 13 AND length(content) < 120 THEN 2 WHEN upper(content) = content AND lower(content) <> content AND length(content) < 80 THEN 3 ELSE 0 END::BIGINT"


@query("heading_level", f"WITH {ELEMENTS} SELECT element_id, {HEADING} AS heading_level FROM el")
def heading_level(t):
    return elements(t).select("element_id", tx.heading_level(F.col("content"), F.col("seq") % 4 * 2.5 + 10).alias("heading_level"))


@query("reading_order_text", f"""WITH {ZONES}, b AS (SELECT *, CASE WHEN {HEADING} = 1 OR (x2 - x1 > 306 AND y1 < 250) THEN 0 WHEN column_index = 1 THEN 2 ELSE 1 END::BIGINT AS band FROM cols)
SELECT element_id, page, band, {_POS.format("y1")} FROM b""")
def reading_order_text(t):
    blocks = zoned(t).withColumn("heading_level", tx.heading_level(F.col("content"), F.col("seq") % 4 * 2.5 + 10))
    return ly.reading_order_text(blocks).select("element_id", "page", "band", "position")


@query("page_columns", f"""WITH {ZONES}, c AS (SELECT doc_id, page, CASE WHEN count(*) FILTER (column_index = 1) >= 2 THEN 2 ELSE 1 END::BIGINT AS columns FROM cols GROUP BY doc_id, page)
SELECT doc_id, page, columns, 54.0::DOUBLE AS first_start, CASE columns WHEN 2 THEN 297.0 ELSE 558.0 END::DOUBLE AS first_end, CASE columns WHEN 2 THEN 315.0 END::DOUBLE AS second_start, CASE columns WHEN 2 THEN 558.0 END::DOUBLE AS second_end FROM c""")
def page_columns(t):
    return ly.page_columns(zoned(t))


PAIRS = ELEMENTS + """, p AS (SELECT a.doc_id, a.page, a.element_id AS a_id, b.element_id AS b_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM el a JOIN el b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seq < b.seq
  AND NOT (a.x2 < b.x1 OR a.x1 > b.x2 OR a.y2 < b.y1 OR a.y1 > b.y2))"""


@query("bbox_intersects", f"WITH {PAIRS} SELECT doc_id, page, a_id, b_id FROM p")
def bbox_intersects(t):
    return ly.bbox_pairs(elements(t)).drop("iou")


@query("bbox_iou", f"WITH {PAIRS} SELECT a_id, b_id, round(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END, 6)::DOUBLE AS iou FROM p")
def bbox_iou(t):
    return ly.bbox_pairs(elements(t)).select("a_id", "b_id", F.round("iou", 6).alias("iou"))


@query("figure_caption", f"""WITH {ELEMENTS} SELECT element_id, {C} AS caption FROM el WHERE regexp_matches({C}, '(?i)^(?:Figure|Fig\\.?|Chart|Diagram)\\s+[0-9]+[:.]?.*$')""")
def figure_caption(t):
    return elements(t).select("element_id", tx.figure_caption(F.col("content")).alias("caption")).where("caption is not null")


@query("caption_zip", f"""WITH {ELEMENTS}, i AS (SELECT doc_id, element_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM el WHERE type = 'image'),
c AS (SELECT doc_id, {C} AS caption, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM el WHERE regexp_matches({C}, '(?i)^(?:Figure|Fig\\.?|Diagram|Illustration)\\s*[0-9]+'))
SELECT i.doc_id, element_id, caption FROM i LEFT JOIN c ON c.doc_id = i.doc_id AND c.n = i.n""")
def caption_zip(t):
    e = elements(t)
    captions = e.select("doc_id", "seq", tx.image_caption(F.col("content")).alias("caption")).where("caption is not null")
    return ly.caption_zip(e.where("type = 'image'"), captions, F.floor(F.col("seq") / 4096))


def _cells(s: str) -> str:
    return f"list_filter(list_transform(CASE WHEN contains({s}, '|') THEN string_split({s}, '|') ELSE string_split({s}, chr(9)) END, lambda c: {_TRIM.format('c')}), lambda c: c <> '')"


LINES = f"list_filter(list_transform(string_split(content, chr(10)), lambda s: {_TRIM.format('s')}), lambda s: s <> '')"


@query("detect_table", f"""WITH {ELEMENTS}, l AS (SELECT element_id, {LINES} AS ls FROM el), r AS (SELECT element_id, ls, list_filter(list_transform(ls, lambda s: {_cells("s")}), lambda r: len(r) > 0) AS rows FROM l)
SELECT element_id, len(rows) AS n_rows, array_to_string(list_transform(rows, lambda r: array_to_string(r, '/')), ';') AS cells FROM r
WHERE len(ls) >= 2 AND len(list_filter(ls, lambda s: contains(s, '|') OR contains(s, chr(9)))) > 0 AND len(rows) > 0""")
def detect_table(t):
    rows = F.col("rows")
    return elements(t).select("element_id", tx.detect_table(F.col("content")).alias("rows")).where("rows is not null").select(
        "element_id", F.size(rows).cast("long").alias("n_rows"), F.array_join(F.transform(rows, lambda r: F.array_join(r, "/")), ";").alias("cells")
    )


_PIPES = "list_transform(string_split(regexp_replace(regexp_replace(s, '^\\|', ''), '\\|$', ''), '|'), lambda c: " + _TRIM.format("c") + ")"
_WIDE = "regexp_split_to_array(s, '\\s{2,}')"


@query("rebuild_table", f"""WITH {ELEMENTS}, l AS (SELECT element_id, {LINES} AS ls FROM el), b AS (SELECT element_id, ls, list_filter(ls, lambda s: NOT regexp_matches(s, '(?i)^(?:Table|Tab\\.)\\s*[0-9IVX]+[\\s.:\\-]*')) AS body,
  list_filter(ls, lambda s: regexp_matches(s, '(?i)^(?:Table|Tab\\.)\\s*[0-9IVX]+[\\s.:\\-]*'))[-1] AS caption FROM l),
d AS (SELECT *, CASE WHEN contains(array_to_string(body[1:5], chr(10)), '|') THEN 'pipe' WHEN contains(array_to_string(body[1:5], chr(10)), chr(9)) THEN 'tab' WHEN len(list_filter(body, lambda s: len({_WIDE}) >= 2)) > 0 THEN 'spaces' END AS delimiter FROM b WHERE len(ls) >= 2 AND len(body) >= 2),
r AS (SELECT *, list_filter(list_transform(body, lambda s: CASE delimiter WHEN 'pipe' THEN {_PIPES} WHEN 'tab' THEN list_transform(string_split(s, chr(9)), lambda c: {_TRIM.format("c")}) ELSE list_transform({_WIDE}, lambda c: {_TRIM.format("c")}) END), lambda r: len(r) >= 2) AS rows FROM d WHERE delimiter IS NOT NULL),
w AS (SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS n_cols FROM r WHERE len(rows) >= 2)
SELECT element_id, caption, delimiter, len(rows) AS n_rows, n_cols, (list_sum(list_transform(rows, lambda r: n_cols - len(r) + len(list_filter(r, lambda c: c = '')))))::BIGINT AS empty_cells FROM w""")
def rebuild_table(t):
    d = elements(t).select("element_id", tx.rebuild_table(F.col("content")).alias("r")).where("r is not null")
    return d.select("element_id", "r.caption", "r.delimiter", "r.n_rows", "r.n_cols", "r.empty_cells")


_SYM = " OR ".join(f"contains({C}, '{s}')" for s in tx.DETECTOR_SYMBOLS)
_NUM = f"(regexp_matches({C}, '^.*?\\(\\s*[0-9]+(?:\\.[0-9]+)?\\s*\\)\\s*$') AND regexp_matches({C}, '[=+\\-*/^]'))"


@query("equation_detect", f"WITH {ELEMENTS} SELECT element_id, ({_SYM}) OR {_NUM} AS is_equation, {_NUM} AS is_numbered FROM el")
def equation_detect(t):
    return elements(t).select("element_id", tx.equation_detect(F.col("content")).alias("e")).select("element_id", "e.*")


_ALL = " OR ".join(f"contains({C}, '{s}')" for s in [*tx.LATEX.values(), *tx.LATEX.keys()])


@query("is_equation", f"""WITH {ELEMENTS} SELECT element_id, length({C}) >= 3 AND (({_ALL}) OR regexp_matches({C}, '=\\s*.*?\\(\\s*[0-9]+(?:\\.[0-9]+)?\\s*\\)$')
  OR (regexp_matches({C}, '(?:^|[^\\pL\\pN_])[a-zA-Z]\\s*=\\s*[-+]?[\\pL\\pN_()^/]+') AND regexp_matches({C}, '[\\^_+\\-*/]') AND NOT regexp_matches({C}, '(?i)(?:^|[^\\pL\\pN_])(the|is|are|was|were|we|and|that|this)(?:$|[^\\pL\\pN_])'))) AS is_equation FROM el""")
def is_equation(t):
    return elements(t).select("element_id", tx.is_equation(F.col("content")).alias("is_equation"))


FORMULA = ELEMENTS + """, eq AS (SELECT element_id, CASE seq % 3 WHEN 0 THEN '∑ α_' || seq || ' ≤ ' || left(line, 6) || ' (' || seq || '.1)' WHEN 1 THEN '∇x ≈ β+λ (A.' || seq || ')' ELSE content END AS f FROM el JOIN lines USING (doc_id, seq))"""
_F = _TRIM.format("f")
_LATEX = "trim(regexp_replace(" + _F + ", '\\(\\s*([0-9]+(?:\\.[0-9]+)?|[A-Z]\\.[0-9]+)\\s*\\)$', ''), chr(32) || chr(9) || chr(10) || chr(13))"
for _a, _b in tx.LATEX.items():
    _LATEX = f"replace({_LATEX}, '{_a}', '{_b}')"


def formulas(t):
    s = F.col("seq")
    text = lambda c: c.cast("string")
    e = elements(t).join(lines(t), ["doc_id", "seq"])
    f = (
        F.when(s % 3 == 0, F.concat(F.lit("∑ α_"), text(s), F.lit(" ≤ "), F.substring("line", 1, 6), F.lit(" ("), text(s), F.lit(".1)")))
        .when(s % 3 == 1, F.concat(F.lit("∇x ≈ β+λ (A."), text(s), F.lit(")"))).otherwise(F.col("content"))
    )
    return e.select("element_id", f.alias("f"))


@query("unicode_to_latex", f"WITH {FORMULA} SELECT element_id, {_LATEX} AS latex FROM eq")
def unicode_to_latex(t):
    return formulas(t).select("element_id", tx.equation_parse(F.col("f"))["latex"].alias("latex"))


@query("equation_parse", f"""WITH {FORMULA}, n AS (SELECT element_id, nullif(regexp_extract({_F}, '\\(\\s*([0-9]+(?:\\.[0-9]+)?|[A-Z]\\.[0-9]+)\\s*\\)$', 1), '') AS number, {_LATEX} AS latex FROM eq)
SELECT element_id, number, CASE WHEN number IS NULL THEN 'DISPLAY' ELSE 'NUMBERED' END AS kind, array_to_string(regexp_extract_all(latex, '\\\\[A-Za-z]+|[a-zA-Z0-9]+|[^\\s\\pL\\pN_]'), ' ') AS tokens FROM n""")
def equation_parse(t):
    d = formulas(t).select("element_id", tx.equation_parse(F.col("f")).alias("e"))
    return d.select("element_id", "e.number", "e.kind", F.array_join("e.tokens", " ").alias("tokens"))


_HITS = {n: " + ".join(f"contains(lower(x), '{w}')::INT" for w in words) for n, words in tx.CATEGORIES.items()}
_ORDER = list(tx.CATEGORIES)


@query("doc_category", f"""WITH t AS (SELECT 'doc-' || doc_id AS id, text || CASE doc_id % 6 WHEN 1 THEN ' Abstract and Results' WHEN 2 THEN ' INVOICE: subtotal, tax' WHEN 3 THEN ' protocol payload agreement' ELSE '' END AS x FROM documents),
h AS (SELECT id, {", ".join(f"{e} AS {n}" for n, e in _HITS.items())} FROM t), m AS (SELECT *, greatest({", ".join(_ORDER)}) AS best FROM h)
SELECT id, CASE WHEN best = 0 THEN 'general_document' {" ".join(f"WHEN {n} = best THEN '{n}'" for n in _ORDER)} END AS category, CASE WHEN best = 0 THEN 0.5 ELSE round(least(0.95, 0.6 + best * 0.05), 2) END::DOUBLE AS confidence FROM m""")
def doc_category(t):
    k = F.col("doc_id") % 6
    extra = F.when(k == 1, " Abstract and Results").when(k == 2, " INVOICE: subtotal, tax").when(k == 3, " protocol payload agreement").otherwise("")
    d = t.documents.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), tx.doc_category(F.concat("text", extra)).alias("c"))
    return d.select("id", "c.category", "c.confidence")


PROV = ELEMENTS + """, pr AS (SELECT doc_id, element_id, CASE seq % 5 WHEN 0 THEN 'DETERMINISTIC' WHEN 1 THEN 'ML_DETECTED' WHEN 2 THEN 'AI_INFERRED' ELSE 'AUTHENTIC' END AS provenance, seq % 15 AS k FROM el)"""


def with_provenance(t):
    s = F.col("seq")
    p = F.when(s % 5 == 0, "DETERMINISTIC").when(s % 5 == 1, "ML_DETECTED").when(s % 5 == 2, "AI_INFERRED").otherwise("AUTHENTIC")
    model = F.when(s % 15 == 1, F.lit(None)).otherwise(F.create_map(F.lit("inference"), F.when(s % 15 == 6, "false").otherwise("true")))
    return elements(t).withColumn("provenance", p).withColumn("model_provenance", model)


@query("provenance_breakdown", f"""WITH {PROV} SELECT doc_id, count(*) AS total, {", ".join(f"count(*) FILTER (provenance = '{p}') AS {p.lower()}, round(count(*) FILTER (provenance = '{p}') / count(*)::DOUBLE * 100, 2) AS {p.lower()}_pct" for p in ly.PROVENANCE)} FROM pr GROUP BY doc_id""")
def provenance_breakdown(t):
    return ly.provenance_breakdown(with_provenance(t), ["doc_id"])


@query("provenance_audit", f"WITH {PROV} SELECT doc_id, element_id, CASE k WHEN 1 THEN 'lacks_model_provenance' ELSE 'inference_not_true' END AS issue FROM pr WHERE k IN (1, 6)")
def provenance_audit(t):
    return ly.provenance_audit(with_provenance(t))


@query("page_elements", f"""WITH {ELEMENTS}, base AS (SELECT doc_id, seq, element_id, page, 50.0 + seq % 24 * 28 AS y1, 72.0 + seq % 24 * 28 AS y2, content, {LINES} AS ls FROM el),
k AS (SELECT *, CASE WHEN len(ls) >= 2 AND len(list_filter(ls, lambda s: contains(s, '|') OR contains(s, chr(9)))) > 0 THEN 'table' WHEN regexp_matches({C}, '(?i)^(?:Figure|Fig\\.?|Chart|Diagram)\\s+[0-9]+[:.]?.*$') THEN 'figure'
  WHEN ({_SYM}) OR {_NUM} THEN 'equation' ELSE 'text_block' END AS k FROM base),
z AS (SELECT *, CASE WHEN k <> 'text_block' THEN k WHEN y1 <= 792 * 0.12 AND y2 <= 792 * 0.18 THEN 'header' WHEN y2 >= 792 * 0.9 THEN 'footer' ELSE k END AS type FROM k),
b AS (SELECT *, CASE WHEN type = 'header' OR y1 <= 792 * 0.12 THEN 0 WHEN type = 'footer' OR y2 >= 792 * 0.9 THEN 4 ELSE 0 END::BIGINT AS band FROM z)
SELECT element_id, page, type, band, {_POS.format("y1")} FROM b""")
def page_elements(t):
    e = elements(t).select("doc_id", "seq", "content")
    return ly.page_elements(e).select("element_id", "page", "type", "band", "position")


@query("wrap_text", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda s: s <> '') AS w FROM documents),
l AS (SELECT doc_id, list_reduce(list_transform(w, lambda x: {'s': x, 'n': length(x)}), lambda a, b: CASE WHEN a.n + 1 + b.n <= 80 THEN {'s': a.s || ' ' || b.s, 'n': a.n + 1 + b.n} ELSE {'s': a.s || chr(10) || b.s, 'n': b.n} END).s AS t FROM w WHERE len(w) > 0),
p AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM l) SELECT doc_id, (generate_subscripts(ls, 1) - 1)::INT AS line_no, unnest(ls) AS line FROM p""")
def wrap_text(t):
    d = t.documents.select("doc_id", tx.wrap_text(F.col("text")).alias("w"))
    return d.select("doc_id", F.posexplode("w").alias("line_no", "line"))
