"""Page elements: zones, reading orders, boxes, provenance.

Elements are rows (doc_id, page, element_id, type, x1, y1, x2, y2, content, ...); a null box is four
nulls. Orders are windows per page, whose element count is bounded by what fits a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fragloom.functions import text as tx
from fragloom.operators.scale import running_rank

WIDTH, HEIGHT = 612.0, 792.0
MARGIN, GUTTER = 54.0, 18.0
FIXED_TYPES = ["table", "figure", "image", "equation"]
PROVENANCE = ["AUTHENTIC", "DETERMINISTIC", "ML_DETECTED", "AI_INFERRED"]


def _box() -> Column:
    return F.col("x1").isNotNull()


def layout_zone(elements: DataFrame, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """Adds zone (kept, header, footer, body), page-number flag and column index."""
    kept = F.col("type").isin(*FIXED_TYPES)
    header = _box() & (F.col("y1") <= height * 0.12) & (F.col("y2") <= height * 0.18)
    footer = _box() & (F.col("y2") >= height * 0.90)
    zone = F.when(kept, "kept").when(header, "header").when(footer, "footer").otherwise("body")
    number = tx.strip(F.col("content")).rlike(r"(?i)\A(?:page\s+)?[0-9]+(?:\s*(?:of|/)\s*[0-9]+)?\z")
    column = F.when((F.col("zone") == "body") & _box() & ((F.col("x1") + F.col("x2")) / 2 >= width * 0.5), 1).otherwise(0)
    return (
        elements.withColumn("zone", zone)
        .withColumn("is_page_number", (F.col("zone") == "footer") & number)
        .withColumn("column_index", column.cast("long"))
    )


def _ordered(elements: DataFrame, band: Column, keys: list[Column]) -> DataFrame:
    page = Window.partitionBy("doc_id", "page").orderBy("band", *keys, "seq")
    return elements.withColumn("band", band.cast("long")).withColumn("position", F.row_number().over(page).cast("long") - 1)


def reading_order_bands(elements: DataFrame, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """Headers and full-width blocks, left column, right column, boxless, footers; then y, x."""
    top = (F.col("type") == "header") | (_box() & (F.col("y1") <= height * 0.12))
    bottom = (F.col("type") == "footer") | (_box() & (F.col("y2") >= height * 0.90))
    band = (
        F.when(top, 0).when(bottom, 4).when(~_box(), 3).when(F.col("x2") - F.col("x1") > width * 0.75, 0)
        .when((F.col("x1") + F.col("x2")) / 2 < width * 0.5, 1).otherwise(2)
    )
    far = F.lit(999999.0)
    return _ordered(elements, band, [F.coalesce("y1", far), F.coalesce("x1", far)])


def reading_order_layout(elements: DataFrame, width: float = WIDTH) -> DataFrame:
    """Headers, wide blocks near the top, column 0, column 1, rest, footers; the column test comes first."""
    y = F.coalesce("y1", F.lit(0.0))
    wide = _box() & (F.col("x2") - F.col("x1") > width * 0.6) & (y < 250)
    band = (
        F.when(F.col("type") == "header", 0).when(wide, 1).when(F.col("column_index") == 0, 2).when(F.col("column_index") == 1, 3)
        .when(F.col("type") == "footer", 5).otherwise(4)
    )
    return _ordered(elements, band, [y, F.coalesce("x1", F.lit(0.0))])


def reading_order_text(blocks: DataFrame, width: float = WIDTH) -> DataFrame:
    """Spanning blocks (level-1 heading, or over half the width near the top), left, right; then y."""
    wide = _box() & (F.col("x2") - F.col("x1") > width * 0.5) & (F.col("y1") < 250)
    band = F.when((F.col("heading_level") == 1) | F.coalesce(wide, F.lit(False)), 0).when(F.col("column_index") == 1, 2).otherwise(1)
    return _ordered(blocks, band, [F.coalesce("y1", F.lit(0.0))])


def page_columns(elements: DataFrame, width: float = WIDTH) -> DataFrame:
    """Two columns when at least two elements sit in column 1; boundaries from margins and gutter."""
    col = (width - 2 * MARGIN - GUTTER) / 2
    right = F.round(F.lit(MARGIN + col + GUTTER), 1)
    two = F.col("columns") == 2
    return (
        elements.groupBy("doc_id", "page")
        .agg(F.when(F.count(F.when(F.col("column_index") == 1, 1)) >= 2, 2).otherwise(1).cast("long").alias("columns"))
        .withColumn("first_start", F.lit(MARGIN))
        .withColumn("first_end", F.when(two, F.round(F.lit(MARGIN + col), 1)).otherwise(width - MARGIN))
        .withColumn("second_start", F.when(two, right))
        .withColumn("second_end", F.when(two, F.round(F.lit(MARGIN + col + GUTTER + col), 1)))
    )


def bbox_pairs(elements: DataFrame, cell: float = 64.0) -> DataFrame:
    """Intersecting element pairs of a page (touching counts) with their IoU.

    Boxes meet in grid rows of ``cell`` points, so a page with many elements does not compare all pairs;
    a pair is reported only in the first row both boxes reach.
    """
    boxed = elements.where(_box())
    rows = F.explode(F.sequence(F.floor(F.col("y1") / cell), F.floor(F.col("y2") / cell)))
    side = lambda p: boxed.select("doc_id", "page", rows.alias("_g"), *[F.col(c).alias(p + c) for c in ("element_id", "seq", "x1", "y1", "x2", "y2")])
    d = side("a_").join(side("b_"), ["doc_id", "page", "_g"]).where(F.col("a_seq") < F.col("b_seq"))
    c = F.col
    touch = ~((c("a_x2") < c("b_x1")) | (c("a_x1") > c("b_x2")) | (c("a_y2") < c("b_y1")) | (c("a_y1") > c("b_y2")))
    first = F.floor(F.greatest("a_y1", "b_y1") / cell)
    w = F.greatest(F.lit(0.0), F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1"))
    h = F.greatest(F.lit(0.0), F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1"))
    area = lambda p: (c(p + "x2") - c(p + "x1")) * (c(p + "y2") - c(p + "y1"))
    union = area("a_") + area("b_") - w * h
    return d.where(touch & (c("_g") == first)).select(
        "doc_id", "page", c("a_element_id").alias("a_id"), c("b_element_id").alias("b_id"), F.when(union > 0, w * h / union).otherwise(0.0).alias("iou")
    )


def caption_zip(images: DataFrame, captions: DataFrame, bucket: Column) -> DataFrame:
    """The i-th image of a document takes the i-th caption line, null when captions run out."""
    i = running_rank(images.select("doc_id", "seq", "element_id"), ["doc_id"], [F.col("seq")], bucket, "_n")
    c = running_rank(captions.select("doc_id", "seq", "caption"), ["doc_id"], [F.col("seq")], bucket, "_n")
    return i.join(c.drop("seq"), ["doc_id", "_n"], "left").select("doc_id", "element_id", "caption")


def provenance_breakdown(elements: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda p: F.count(F.when(F.col("provenance") == p, 1))
    cols = []
    for p in PROVENANCE:
        cols += [n(p).alias(p.lower()), F.round(n(p) / F.count("*") * 100, 2).alias(p.lower() + "_pct")]
    return elements.groupBy(*keys).agg(F.count("*").alias("total"), *cols)


def provenance_audit(elements: DataFrame) -> DataFrame:
    """Model-detected elements without model provenance, or whose provenance lacks inference = true."""
    missing = F.col("model_provenance").isNull()
    silent = ~F.coalesce(F.col("model_provenance")["inference"] == "true", F.lit(False))
    return (
        elements.where((F.col("provenance") == "ML_DETECTED") & (missing | silent))
        .select("doc_id", "element_id", F.when(missing, "lacks_model_provenance").otherwise("inference_not_true").alias("issue"))
    )


def page_elements(lines: DataFrame, per_page: int = 24) -> DataFrame:
    """Text lines to page elements: default box, type, zone, column and reading position.

    ``lines`` has doc_id, seq (0-based) and content; pages fill up ``per_page`` lines each, boxes are
    staggered 28 pt down the page.
    """
    slot = F.col("seq") % per_page
    placed = lines.select(
        "doc_id", "seq", F.floor(F.col("seq") / per_page).alias("page"), F.concat_ws("-", F.lit("el"), F.col("doc_id").cast("string"), F.col("seq").cast("string")).alias("element_id"),
        F.lit(MARGIN).alias("x1"), (slot * 28 + 50).cast("double").alias("y1"), F.lit(WIDTH - MARGIN).alias("x2"), (slot * 28 + 72).cast("double").alias("y2"), "content",
    )
    kind = (
        F.when(tx.detect_table(F.col("content")).isNotNull(), "table").when(tx.figure_caption(F.col("content")).isNotNull(), "figure")
        .when(tx.equation_detect(F.col("content"))["is_equation"], "equation").otherwise("text_block")
    )
    zoned = layout_zone(placed.withColumn("type", kind))
    typed = zoned.withColumn("type", F.when(F.col("zone").isin("header", "footer"), F.col("zone")).otherwise(F.col("type")))
    return reading_order_bands(typed)
