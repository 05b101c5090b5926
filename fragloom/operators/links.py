"""Directed links between fragments: signals, affinity score and candidate joins.

Scoring every pair of a source is quadratic. Inside one source with known offsets a forward gap alone
is worth at most 0.35 / (1 + ln 2) < 0.21, so any pair at or above 0.35 must be adjacent, splice a
token, name an object, continue a number sequence within 256 bytes or join xref, trailer and EOF.
Each of these is an equi-join here; the ones that reach over any distance go through ``later_smallest``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fragloom.functions.blob import has, latin, matches, occurrences
from fragloom.functions.tokens import OBJECT_DEF, OBJECT_REF, SPACE, any_of, rule_label
from fragloom.operators.scale import discard, materialize, running_total

# Fixed values: (end of a, start of b, joined token).
SPLIT_TOKENS = [
    ("end", "obj", "endobj"), ("str", "eam", "stream"), ("stre", "am", "stream"), ("ends", "tream", "endstream"),
    ("endst", "ream", "endstream"), ("start", "xref", "startxref"), ("%%E", "OF", "%%EOF"), ("/Len", "gth", "/Length"),
    ("/Ty", "pe", "/Type"), ("/Pa", "ge", "/Page"), ("/Fo", "nt", "/Font"), ("<<", ">>", "<<>>"),
]
# Label -> next label -> compatibility.
TRANSITIONS = [
    ("PDF_HEADER", "PAGE_OBJECT", 0.85), ("PDF_HEADER", "PDF_OBJECT", 0.80), ("PAGE_OBJECT", "TEXT_STREAM", 0.90),
    ("PAGE_OBJECT", "FONT_OBJECT", 0.80), ("PAGE_OBJECT", "IMAGE_STREAM", 0.80), ("PAGE_OBJECT", "PAGE_OBJECT", 0.75),
    ("TEXT_STREAM", "PAGE_OBJECT", 0.75), ("TEXT_STREAM", "FONT_OBJECT", 0.70), ("TEXT_STREAM", "XREF", 0.80),
    ("PDF_OBJECT", "XREF", 0.80), ("XREF", "TRAILER", 0.95), ("TRAILER", "TRAILER", 0.60),
]
OTHER_TRANSITION = 0.30
NEAR_HEAD = 1024
LARGE_GAP = 4096
LEAF = 4096
FAN = 16  # children of a node of the merge tree
FEW = 64  # right rows of a key that are joined without a tree


def _numbers(t: Column, pattern: str) -> Column:
    """(number, generation) pairs of all matches, as array of structs of long."""
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    parts = F.transform(found, lambda s: F.split(s, SPACE + "+"))
    return F.transform(parts, lambda p: F.struct(p[0].try_cast("long").alias("n"), p[1].try_cast("long").alias("g")))


def _position(t: Column, side: str) -> Column:
    """Index of the split token whose first half ends (or second half starts) the text, else null."""
    chain = None
    for i, (left, right, _) in enumerate(SPLIT_TOKENS):
        cond = F.endswith(t, F.lit(left)) if side == "left" else F.startswith(t, F.lit(right))
        chain = F.when(cond, i) if chain is None else chain.when(cond, i)
    return chain


def link_features(fragments: DataFrame, with_rule_labels: bool = False) -> DataFrame:
    """One slim row per fragment with everything a link needs; bytes are dropped.

    Expects fragment_id, block and optionally media_id (source), start, end and label columns.
    """
    have = set(fragments.columns)
    d = fragments.withColumn("_t", latin(F.col("block")))
    t = F.col("_t")
    if with_rule_labels:
        d = d.withColumn("_r", rule_label(t)).withColumns({"label": F.col("_r.label"), "label_confidence": F.col("_r.confidence")})
        have |= {"label", "label_confidence"}
    missing = {"media_id": "string", "start": "long", "label": "string", "label_confidence": "double", "label_abstained": "boolean"}
    for name, kind in missing.items():
        if name not in have:
            d = d.withColumn(name, F.lit(None).cast(kind))
    alnum = "[0-9A-Za-z]"
    d = d.withColumn("_defs", _numbers(t, OBJECT_DEF)).withColumn("_refs", _numbers(t, OBJECT_REF))
    stream, endstream = occurrences(t, "stream"), occurrences(t, "endstream")
    return d.select(
        "media_id",
        "fragment_id",
        "start",
        (F.col("start") + F.length("block")).alias("end"),
        F.array_distinct("_defs").alias("defs"),
        F.array_distinct("_refs").alias("refs"),
        F.array_max(F.transform("_defs", lambda x: x["n"])).alias("max_def"),
        F.array_min(F.transform("_defs", lambda x: x["n"])).alias("min_def"),
        (stream > endstream).alias("opens_stream"),
        (endstream > 0).alias("has_endstream"),
        (stream == 0).alias("no_stream"),
        (occurrences(t, "<<") > occurrences(t, ">>")).alias("opens_dict"),
        has(t, ">>").alias("closes_dict"),
        (occurrences(t, "BT") > occurrences(t, "ET")).alias("opens_text"),
        any_of(t, "ET", "Tj", "TJ").alias("closes_text"),
        _position(t, "left").alias("split_left"),
        _position(t, "right").alias("split_right"),
        t.rlike(alnum + r"\z").alias("ends_alnum"),
        t.rlike(r"\A" + alnum).alias("starts_alnum"),
        (F.startswith(t, F.lit("%PDF")) | has(F.substring(t, 1, 32), "%PDF-")).alias("is_header"),
        has(t, "%%EOF").alias("has_eof"),
        has(t, "xref").alias("has_xref"),
        any_of(t, "trailer", "startxref").alias("has_trailer"),
        (
            (any_of(t, "obj", "<<", "/Type", "/Pages", "/Catalog") | F.coalesce(F.col("label").isin("PAGE_OBJECT", "PDF_OBJECT"), F.lit(False)))
            & t.rlike("[^\\x00]")
        ).alias("has_body"),
        "label",
        F.coalesce("label_confidence", F.lit(0.0)).alias("label_confidence"),
        F.coalesce("label_abstained", F.lit(False)).alias("label_abstained"),
    )


def _transition_weight(a: Column, b: Column) -> Column:
    chain = None
    for left, right, weight in TRANSITIONS:
        cond = (a == left) & (b == right)
        chain = F.when(cond, weight) if chain is None else chain.when(cond, weight)
    return chain.otherwise(OTHER_TRANSITION)


def transition_advice(label_a: Column, label_b: Column, conf_a: Column, conf_b: Column) -> Column:
    return F.round(_transition_weight(label_a, label_b) * F.least(conf_a, conf_b), 3)


def _struct_sides() -> tuple[Callable[[str], Column], Callable[[str], Column]]:
    return lambda n: F.col(f"a.{n}"), lambda n: F.col(f"b.{n}")


def pair_features(pairs: DataFrame, sides: tuple | None = None, marked: bool = False) -> DataFrame:
    """Signals of joined rows; the two feature rows are the struct columns ``a`` and ``b``, or what ``sides`` gives by name.

    ``marked`` rows have the bits of their object numbers: lists without a common bit are not compared.
    """
    a, b = sides or _struct_sides()
    yes = lambda c: F.coalesce(c, F.lit(False))
    same = yes(a("media_id") == b("media_id"))
    d = pairs.withColumn("same_source", same).withColumn("gap", F.when(same, b("start") - a("end")))
    gap = F.col("gap")
    adjacent, forward = yes(gap == 0), yes(gap >= 0)
    no_defs_b = F.size(b("defs")) == 0
    follows = adjacent | forward | a("start").isNull()
    meet = lambda x, y: F.arrays_overlap(x("refs"), y("defs"))
    names = (lambda x, y: (x("ref_bits").bitwiseAND(y("def_bits")) != 0) & meet(x, y)) if marked else meet
    advised = a("label").isNotNull() & b("label").isNotNull() & ~a("label_abstained") & ~b("label_abstained")
    return d.withColumns(
        {
            "is_adjacent": adjacent,
            "is_forward": forward,
            "proximity": F.when(adjacent, 1.0).when(gap > 0, 1.0 / (1.0 + F.log1p(gap.cast("double")))).otherwise(0.0),
            "a_references_b": names(a, b),
            "b_references_a": names(b, a),
            "ascending_object": yes((b("min_def") - a("max_def")).between(1, 2)),
            "stream_continuation": a("opens_stream") & (b("has_endstream") | (b("no_stream") & no_defs_b)),
            "stream_conflict": a("has_endstream") & b("has_endstream") & b("no_stream") & no_defs_b,
            "dict_continuation": a("opens_dict") & b("closes_dict"),
            "text_continuation": a("opens_text") & b("closes_text"),
            "token_splice": yes(a("split_left") == b("split_right")),
            "alnum_boundary": a("ends_alnum") & b("starts_alnum"),
            "header_to_body": a("is_header") & ~b("is_header") & b("has_body") & (yes(b("start") <= NEAR_HEAD) | b("start").isNull() | adjacent),
            "body_to_xref": ~a("has_xref") & b("has_xref") & follows,
            "xref_to_trailer": a("has_xref") & b("has_trailer") & follows,
            "trailer_to_eof": a("has_trailer") & b("has_eof") & follows,
            "double_header": a("is_header") & b("is_header"),
            "eof_precedence": a("has_eof") & ~b("has_eof") & ~b("is_header"),
            "advice": F.when(
                advised, transition_advice(a("label"), b("label"), a("label_confidence"), b("label_confidence"))
            ).otherwise(0.0),
        }
    )


def tier(score: Column) -> Column:
    return F.when(score >= 0.80, "HIGH").when(score >= 0.55, "MEDIUM").when(score >= 0.35, "LOW").otherwise("NEGLIGIBLE")


def pair_score(features: DataFrame, sides: tuple | None = None) -> DataFrame:
    """Affinity, relation type, tier, component scores and evidence from ``pair_features`` rows."""
    c = F.col
    a, b = sides or _struct_sides()
    best = lambda *cases: F.greatest(*[F.when(cond, v).otherwise(0.0) for cond, v in cases])
    physical = F.when(c("is_adjacent"), 1.0).when(c("same_source") & c("is_forward"), c("proximity")).otherwise(0.0)
    syntax = best(
        (c("token_splice"), 1.0), (c("stream_continuation"), 0.85), (c("dict_continuation"), 0.75),
        (c("text_continuation"), 0.70), (c("alnum_boundary"), 0.30),
    )
    objects = best((c("a_references_b"), 0.85), (c("ascending_object"), 0.65), (c("b_references_a"), 0.50))
    structure = (
        F.when(c("xref_to_trailer"), 0.95).when(c("trailer_to_eof"), 0.90).when(c("header_to_body"), 0.80)
        .when(c("body_to_xref"), 0.75).otherwise(0.0)
    )
    cost = lambda cond, v: F.when(cond, v).otherwise(0.0)
    penalty = (
        cost(c("double_header"), 0.90) + cost(c("eof_precedence"), 0.80) + cost(c("stream_conflict"), 0.40)
        + cost(c("same_source") & ~c("is_forward"), 0.70)
    )
    near = (
        F.when((c("syntax") >= 0.5) | (c("objects") >= 0.5) | (c("structure") >= 0.5), 0.95).otherwise(0.85)
    )
    far = (
        F.when(c("token_splice"), 0.90).when(c("a_references_b"), 0.45).when(c("xref_to_trailer"), 0.50)
        .when(c("trailer_to_eof"), 0.50).when(c("ascending_object") & (c("gap") <= 256), 0.40)
        .otherwise(F.least(F.lit(0.35), c("physical") * 0.35))
    )
    loose = (
        F.when(c("token_splice"), 0.90).when(c("stream_continuation"), 0.85).when(c("xref_to_trailer"), 0.85)
        .when(c("trailer_to_eof"), 0.85).when(c("header_to_body"), 0.75).when(c("a_references_b"), 0.75)
        .when(c("dict_continuation"), 0.70).when(c("text_continuation"), 0.65).when(c("ascending_object"), 0.60)
        .when(c("advice") >= 0.60, c("advice")).otherwise(0.05)
    )
    base = F.when(c("gap") == 0, near).when(c("gap") > 0, far).when(c("gap") < 0, 0.0).otherwise(loose)
    itself = F.coalesce(a("fragment_id") == b("fragment_id"), F.lit(False)) & a("media_id").eqNullSafe(b("media_id"))
    score = F.when(itself, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - c("penalty"))), 4))
    kind = (
        F.when(itself, "DISJOINT")
        .when(c("token_splice") | c("is_adjacent"), "ADJACENT")
        .when(c("stream_continuation"), "STREAM_CONTINUATION")
        .when(c("a_references_b") | c("ascending_object"), "OBJECT_REFERENCE")
        .when(c("dict_continuation"), "DICT_CONTINUATION")
        .when(c("header_to_body") | c("xref_to_trailer") | c("trailer_to_eof"), "STRUCTURAL_TRANSITION")
        .otherwise("DISJOINT")
    )
    say = lambda cond, text: F.when(cond, F.lit(text))
    some = lambda *cases: F.array_compact(F.array(*[say(*x) for x in cases]))
    return (
        features.withColumns({"physical": physical, "syntax": syntax, "objects": objects, "structure": structure, "penalty": penalty})
        .withColumn("affinity", score)
        .withColumns(
            {
                "relation": kind,
                "tier": tier(c("affinity")),
                "components": F.create_map(
                    *[x for n in ("physical", "syntax", "objects", "structure", "advice", "penalty") for x in (F.lit(n), F.round(c(n), 4))]
                ),
                "observed": some(
                    (c("is_adjacent"), "exact_physical_adjacency"),
                    (F.coalesce(c("gap") > 0, F.lit(False)), "forward_offset_gap"),
                    (c("a_references_b"), "fragment_a_references_fragment_b_objects"),
                    (c("b_references_a"), "fragment_b_references_fragment_a_objects"),
                    (c("ascending_object"), "ascending_object_id_sequence"),
                    (a("opens_stream"), "unclosed_stream_marker_in_fragment_a"),
                    (a("opens_dict"), "unclosed_dictionary_delimiter_in_fragment_a"),
                    (a("opens_text"), "unclosed_text_object_bt_in_fragment_a"),
                    (c("token_splice"), "boundary_token_join"),
                ),
                "inferred": some(
                    (c("a_references_b"), "parent_child_object_reference"),
                    (c("b_references_a"), "backward_object_reference"),
                    (c("ascending_object"), "sequential_object_order"),
                    (c("stream_continuation"), "stream_payload_or_endstream_continuation"),
                    (c("dict_continuation"), "dictionary_closing_delimiter_continuation"),
                    (c("text_continuation"), "text_operator_or_et_continuation"),
                    (c("token_splice"), "seamless_token_splice"),
                    (c("header_to_body"), "header_to_document_body_transition"),
                    (c("body_to_xref"), "body_to_xref_transition"),
                    (c("xref_to_trailer"), "xref_to_trailer_transition"),
                    (c("trailer_to_eof"), "trailer_to_eof_transition"),
                ),
                "negative": F.when(itself, F.array(F.lit("self_referential_link"))).otherwise(
                    some(
                        (F.coalesce(c("gap") < 0, F.lit(False)), "reverse_offset_ordering"),
                        (F.coalesce(b("min_def") < a("max_def"), F.lit(False)), "descending_object_id_sequence"),
                        (c("stream_conflict"), "redundant_endstream_without_new_stream"),
                        (c("double_header"), "contradictory_double_header"),
                        (c("eof_precedence"), "contradictory_eof_precedence"),
                    )
                ),
                "uncertain": some(
                    (F.coalesce(c("gap") > LARGE_GAP, F.lit(False)), "large_spatial_gap"),
                    (F.coalesce(a("media_id") != b("media_id"), F.lit(False)), "different_evidence_sources"),
                    (c("gap").isNull(), "unknown_or_disparate_evidence_sources"),
                    (~c("same_source"), "fragments_not_verifiably_from_same_source_file"),
                    (c("affinity") < 0.55, "weak_evidence_corroboration"),
                ),
            }
        )
    )


def _flags(features: DataFrame) -> list[str]:
    return [f.name for f in features.schema if f.dataType.typeName() == "boolean"]


def _side(features: DataFrame, prefix: str) -> list[Column]:
    """Columns of a feature row under a prefix, so that unread ones are left behind by joins; all flags are one number.

    With a column per flag the code that scores a pair gets too long for the JVM to compile.
    """
    flags = _flags(features)
    packed = reduce(Column.__add__, [F.when(F.col(c), 1 << i).otherwise(0) for i, c in enumerate(flags)], F.lit(0))
    return [F.col(c).alias(prefix + c) for c in features.columns if c not in ("media_id", "fragment_id", *flags)] + [packed.alias(prefix + "flags")]


def _by_name(features: DataFrame, prefix: str, key: str) -> Callable[[str], Column]:
    """The columns of a side that ``_side`` packed, by their names in a feature row."""
    named = {"media_id": F.col("media_id"), "fragment_id": F.col(key)}
    named |= {c: F.col(prefix + "flags").bitwiseAND(1 << i) != 0 for i, c in enumerate(_flags(features))}
    return lambda n: named.get(n, F.col(prefix + n))


def _row(features: DataFrame, prefix: str, key: str) -> Column:
    named = _by_name(features, prefix, key)
    return F.struct(*[named(c).alias(c) for c in features.columns])


def _joined(ids: DataFrame, features: DataFrame) -> DataFrame:
    """(media_id, from_id, to_id) pairs with the packed columns of both sides.

    The side of the starts is joined last: ranks per start then need no further shuffle.
    """
    side = lambda p, key: features.select("media_id", F.col("fragment_id").alias(key), *_side(features, p))
    return ids.join(side("_b_", "to_id"), ["media_id", "to_id"]).join(side("_a_", "from_id"), ["media_id", "from_id"])


def _scored(joined: DataFrame, features: DataFrame, marked: bool = False) -> DataFrame:
    sides = _by_name(features, "_a_", "from_id"), _by_name(features, "_b_", "to_id")
    return pair_score(pair_features(joined, sides, marked), sides)


def with_features(ids: DataFrame, features: DataFrame) -> DataFrame:
    """Attach both feature rows to (media_id, from_id, to_id) pairs."""
    return _joined(ids, features).select(*ids.columns, _row(features, "_a_", "from_id").alias("a"), _row(features, "_b_", "to_id").alias("b"))


def score_pairs(ids: DataFrame, features: DataFrame) -> DataFrame:
    return _scored(_joined(ids, features), features)


# ---- candidate joins inside a source ---------------------------------------------------------------


def adjacent_pairs(features: DataFrame) -> DataFrame:
    """b starts where a ends: an equi-join on (source, offset), so a huge source spreads over all tasks."""
    a = features.select("media_id", F.col("end").alias("_at"), F.col("fragment_id").alias("from_id"))
    b = features.select("media_id", F.col("start").alias("_at"), F.col("fragment_id").alias("to_id"))
    return a.join(b, ["media_id", "_at"]).select("media_id", "from_id", "to_id")


def _gap(pairs: DataFrame, *more: Column) -> DataFrame:
    gap = F.col("_s") - F.col("_e")
    return pairs.select("media_id", "from_id", "to_id", gap.alias("gap"), (1.0 / (1.0 + F.log1p(gap.cast("double")))).alias("proximity"), *more)


def all_gap_pairs(features: DataFrame, width: int = 1 << 18) -> DataFrame:
    """Every pair of a source whose target starts behind a gap, with gap and proximity.

    The pairs are quadratic in a source, so a start meets the targets ``width`` bytes at a time: no task holds a whole source.
    """
    right = features.select("media_id", F.col("fragment_id").alias("to_id"), F.col("start").alias("_s"), F.floor(F.col("start") / width).alias("_b"))
    last = right.groupBy("media_id").agg(F.max("_b").alias("_last"))
    first = F.floor((F.col("end") + 1) / width)
    left = features.select("media_id", F.col("fragment_id").alias("from_id"), F.col("end").alias("_e"), first.alias("_b0")).join(last, "media_id").where("_b0 <= _last")
    cells = left.select("media_id", "from_id", "_e", F.explode(F.sequence("_b0", "_last")).alias("_b"))
    return _gap(cells.join(right, ["media_id", "_b"]).where(F.col("_s") > F.col("_e")))


def _successors(features: DataFrame, k: int, by_penalty: bool, carried: bool) -> DataFrame:
    """The k nearest successors of each fragment behind a gap (_s, _e), with both feature rows if ``carried``.

    One running count over starts and ends numbers the targets and tells each start how many lie before the first one behind
    its end. The k numbers from there lie in one or two cells of numbers, where both sides meet: pairs are never shuffled.
    """
    every = F.lit("all")
    kinds = owns = F.array(every)
    if by_penalty:
        costly = F.col("is_header") | F.col("has_eof") | F.col("has_endstream")
        accepted = F.transform(_accepted_classes(0.35, 1e-4), lambda c: F.concat(F.lit("c"), c.cast("string")))
        kinds = F.when(costly, accepted).otherwise(kinds)
        owns = F.array(every, F.concat(F.lit("c"), _penalty_class().cast("string")))
    load = [F.col(c) for c in features.columns if c not in ("media_id", "fragment_id", "start", "end")] if carried else []
    point = lambda cs, at, target: features.select(
        "media_id", F.explode(cs).alias("_c"), F.col(at).alias("_p"), F.lit(target).cast("long").alias("_t"), "fragment_id", "start", "end", *load
    )
    points = point(owns, "start", 1).unionByName(point(kinds, "end", 0)).where("_p is not null")
    keys = ["media_id", "_c"]
    order = [F.col("_p"), F.desc("_t"), F.col("fragment_id")]
    counted = running_total(points, keys, order, F.floor(F.col("_p") / (1 << 20)), F.col("_t"), "_r")
    cell = 4 * k
    side = lambda p: _side(features, p) if carried else []
    right = counted.where("_t = 1").select(*keys, F.col("fragment_id").alias("to_id"), F.col("_p").alias("_s"), "_r", F.floor(F.col("_r") / cell).alias("_b"), *side("_b_"))
    at = lambda n: F.floor((F.col("_r") + n) / cell)
    left = counted.where("_t = 0").select(
        *keys, F.col("fragment_id").alias("from_id"), F.col("_p").alias("_e"), F.col("_r").alias("_n"), F.explode(F.sequence(at(1), at(k))).alias("_b"), *side("_a_")
    )
    return left.join(right, [*keys, "_b"]).where((F.col("_r") > F.col("_n")) & (F.col("_r") <= F.col("_n") + k))


def forward_gap_pairs(features: DataFrame, k: int = 5, by_penalty: bool = False) -> DataFrame:
    """Each fragment's k nearest successors behind a gap, however far, with gap and proximity; ties by target id.

    ``by_penalty`` gives the k nearest of those targets that no penalty takes below every proximity, which is what ranks
    of links need.
    """
    return _gap(_successors(features, k, by_penalty, False))


def score_successors(features: DataFrame, k: int = 5, by_penalty: bool = False) -> DataFrame:
    """The pairs of ``forward_gap_pairs``, scored."""
    return _scored(_successors(features, k, by_penalty, True), features)


def score_forward(features: DataFrame, width: int = 1 << 18) -> DataFrame:
    """Every pair of a source whose target starts at or behind the start's end, scored.

    The pairs are quadratic in a source and are never shuffled: starts lie in cells of ``width`` bytes by their end, a target is
    sent to its own cell and those before it, so a task holds the starts of one cell while the targets go by.
    """
    bits = lambda c: F.expr(f"aggregate({c}, 0L, (m, x) -> m | shiftleft(1L, cast(pmod(coalesce(x.n, 0), 64) as int)))")
    d = features.withColumns({"ref_bits": bits("refs"), "def_bits": bits("defs")})
    starts = d.select("media_id", F.col("fragment_id").alias("from_id"), F.floor(F.col("end") / width).alias("_b"), *_side(d, "_a_"))
    cells = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("start") / width)))
    targets = d.where("start is not null").select("media_id", F.col("fragment_id").alias("to_id"), cells.alias("_b"), *_side(d, "_b_"))
    met = targets.join(starts, ["media_id", "_b"]).where(F.col("_b_start") >= F.col("_a_end"))
    return _scored(met, d, marked=True)


def score_adjacent(features: DataFrame) -> DataFrame:
    """The pairs of ``adjacent_pairs`` of two fragments, scored where they meet: only feature rows are shuffled."""
    side = lambda key, at, p: features.select("media_id", F.col("fragment_id").alias(key), F.col(at).alias("_at"), *_side(features, p))
    met = side("from_id", "end", "_a_").join(side("to_id", "start", "_b_"), ["media_id", "_at"])
    return _scored(met.where("from_id <> to_id"), features)


def ascending_object_pairs(features: DataFrame, max_gap: int = 256) -> DataFrame:
    """Lowest object of b is 1 or 2 above the highest of a, and b starts within max_gap bytes."""
    near = F.floor(F.col("end") / max_gap)
    a = features.where("max_def is not null").select(
        "media_id", F.col("fragment_id").alias("from_id"), F.col("end").alias("_e"), F.col("max_def").alias("_n"), F.explode(F.array(near, near + 1)).alias("_b")
    )
    b = features.where("min_def is not null").select(
        "media_id", F.col("fragment_id").alias("to_id"), F.col("start").alias("_s"), F.col("min_def").alias("_m"),
        F.floor(F.col("start") / max_gap).alias("_b"),
    )
    gap, step = F.col("_s") - F.col("_e"), F.col("_m") - F.col("_n")
    return a.join(b, ["media_id", "_b"]).where(gap.between(0, max_gap) & step.between(1, 2)).select("media_id", "from_id", "to_id")


def later_smallest(left: DataFrame, right: DataFrame, k: int, keys: list[str], leaf: int = LEAF, classes: bool = False, few: int = FEW) -> DataFrame:
    """For every left row the k smallest ``to_id`` of right rows with equal keys and _s > _e.

    ``left`` has keys, from_id, _e; ``right`` has keys, to_id, _s. A merge tree is built bottom up: a leaf of ``leaf`` bytes
    keeps its k smallest ids, and each node those of its FAN children, whose lists it holds. A left row reads its own
    leaf and, level by level, the later siblings of its node, so no row is copied up the tree and no key ever
    produces all pairs.

    With ``classes`` right rows have a class _c and left rows the list _cs of classes they take: k ids of each class. A left row
    is not copied per class, it meets those that its keys have. Keys with at most ``few`` right rows are joined as they are,
    the tree is built for the others.
    """
    group = [*keys, "_c"] if classes else keys
    taken = F.array_contains("_cs", F.col("_c")) if classes else F.lit(True)
    own_classes = ["_cs"] if classes else []
    order = Window.partitionBy(*group, "from_id").orderBy("to_id")
    best = lambda found: found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
    many = materialize(right.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > few).select(*keys))
    split = not many.isEmpty()
    short = (lambda d: d.join(many, keys, "left_anti")) if split else lambda d: d
    met = short(left).join(short(right), keys).where((F.col("_s") > F.col("_e")) & taken).select(*group, "from_id", "to_id")
    if not split:
        return best(met)
    left, right = left.join(many, keys, "left_semi"), right.join(many, keys, "left_semi")
    smallest = lambda lists: F.slice(F.array_sort(lists), 1, k)
    p, q = F.floor(F.col("_s") / leaf), F.floor(F.col("_e") / leaf)
    nodes = materialize(right.groupBy(*group, p.alias("_n")).agg(smallest(F.collect_list("to_id")).alias("_ids")))  # a leaf has at most a row per byte
    top = nodes.agg(F.max("_n")).first()[0] or 0
    levels = []
    while top > 0:
        own = F.struct((F.col("_n") % FAN).alias("slot"), F.col("_ids").alias("ids"))
        nodes = nodes.groupBy(*group, F.floor(F.col("_n") / FAN).alias("_n")).agg(F.collect_list(own).alias("_children"))
        nodes = materialize(nodes.withColumn("_ids", smallest(F.flatten(F.transform("_children", lambda c: c["ids"])))))
        levels.append(nodes.select(*group, F.lit(len(levels)).alias("_l"), "_n", "_children"))
        top //= FAN
    near = (
        left.withColumn("_n", q).join(right.withColumn("_n", p), [*keys, "_n"])
        .where((F.col("_s") > F.col("_e")) & taken)
        .select(*group, "from_id", "to_id")
    )
    found = near
    if levels:
        tree = reduce(DataFrame.unionByName, levels)
        steps = F.array(*[F.struct(F.lit(i).alias("_l"), F.floor(F.col("_q") / FAN ** (i + 1)).alias("_n"), (F.floor(F.col("_q") / FAN**i) % FAN).alias("_slot")) for i in range(len(levels))])
        path = left.withColumn("_q", q).select(*keys, "from_id", *own_classes, F.inline(steps))
        later = F.filter("_children", lambda c: c["slot"] > F.col("_slot"))
        ids = smallest(F.flatten(F.transform(later, lambda c: c["ids"])))
        found = near.unionByName(path.join(tree, [*keys, "_l", "_n"]).where(taken).select(*group, "from_id", F.explode(ids).alias("to_id")))
    return best(met.unionByName(found))


def _penalty_class() -> Column:
    """Class of a target for the penalties that depend on both sides."""
    conflict = F.col("has_endstream") & F.col("no_stream") & (F.size("defs") == 0)
    bit = lambda c, v: F.when(c, v).otherwise(0)
    return bit(F.col("is_header"), 1) + bit(F.col("has_eof"), 2) + bit(conflict, 4)


def _accepted_classes(base: float, floor: float) -> Column:
    """Target classes that keep a pair with this base score at or above ``floor``."""
    ok = []
    for cls in range(8):
        header, eof, conflict = bool(cls & 1), bool(cls & 2), bool(cls & 4)
        cost = F.lit(0.0)
        if header:
            cost = cost + F.when(F.col("is_header"), 0.90).otherwise(0.0)
        if not eof and not header:
            cost = cost + F.when(F.col("has_eof"), 0.80).otherwise(0.0)
        if conflict:
            cost = cost + F.when(F.col("has_endstream"), 0.40).otherwise(0.0)
        ok.append(F.when(F.round(F.lit(base) - cost, 4) >= floor, F.lit(cls)))
    return F.array_compact(F.array(*ok))


def _reach(features: DataFrame, left_key: Column, right_key: Column, base: float, floor: float, k: int) -> DataFrame:
    """Forward pairs whose key sets meet; the k smallest targets per key and penalty class."""
    left = features.select(
        "media_id", F.col("fragment_id").alias("from_id"), F.col("end").alias("_e"), _accepted_classes(base, floor).alias("_cs"), F.explode(left_key).alias("_k")
    )
    right = features.select(
        "media_id", F.explode(right_key).alias("_k"), _penalty_class().alias("_c"), F.col("fragment_id").alias("to_id"), F.col("start").alias("_s")
    )
    return later_smallest(left, right, k, ["media_id", "_k"], classes=True).select("media_id", "from_id", "to_id").distinct()


def _name(c: Column) -> Column:
    return F.concat_ws(" ", c["n"].cast("string"), c["g"].cast("string"))


def object_ref_pairs(features: DataFrame, k: int = 3, floor: float = 0.35) -> DataFrame:
    """a names an object that a later b defines."""
    return _reach(features, F.transform("refs", _name), F.transform("defs", _name), 0.45, floor, k)


def split_token_pairs(features: DataFrame, k: int = 3, floor: float = 0.35) -> DataFrame:
    """The end of a and the start of a later b join to a known token."""
    as_set = lambda c: F.array_compact(F.array(F.col(c)))
    return _reach(features, as_set("split_left"), as_set("split_right"), 0.90, floor, k)


def transition_pairs(features: DataFrame, k: int = 3, floor: float = 0.35) -> DataFrame:
    """xref to a later trailer and trailer to a later EOF."""
    kinds = lambda x, y: F.array_compact(F.array(F.when(F.col(x), F.lit("x")), F.when(F.col(y), F.lit("t"))))
    return _reach(features, kinds("has_xref", "has_trailer"), kinds("has_trailer", "has_eof"), 0.50, floor, k)


def _reaching_pairs(features: DataFrame, k: int, floor: float) -> DataFrame:
    parts = [
        ascending_object_pairs(features),
        object_ref_pairs(features, k, floor),
        split_token_pairs(features, k, floor),
        transition_pairs(features, k, floor),
    ]
    return reduce(DataFrame.unionByName, parts)


def _check_floor(floor: float) -> None:
    if floor < 0.35:
        raise ValueError("below 0.35 proximity alone can make a link; take forward_gap_pairs(by_penalty=True) as well")


def _dealt(pairs: DataFrame) -> DataFrame:
    """Distinct pairs, dealt by target, as the join with the targets' features wants it."""
    return pairs.where("from_id <> to_id").repartition("media_id", "to_id").distinct()


def candidate_pairs(features: DataFrame, k: int = 3, floor: float = 0.35) -> DataFrame:
    """All pairs that can be among the k best links of their start at or above ``floor`` (>= 0.35)."""
    _check_floor(floor)
    return _dealt(adjacent_pairs(features).unionByName(_reaching_pairs(features, k, floor)))


def top_edges_per_node(scored: DataFrame, k: int = 3, floor: float = 0.40) -> DataFrame:
    """The k best links of every start: affinity down, then target id.

    The floor is applied after ranking (weaker links rank last anyway): below the window it would be
    pushed into the joins as one huge predicate.
    """
    order = Window.partitionBy("media_id", "from_id").orderBy(F.desc("affinity"), "to_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.where(F.col("affinity") >= floor)


def best_links(features: DataFrame, k: int = 3, floor: float = 0.40) -> DataFrame:
    """``top_edges_per_node`` of the scored ``candidate_pairs``, written in steps that leave only their rows on disk.

    Most candidates are adjacent: those are scored where they meet. The others are scored behind a gap only.
    """
    _check_floor(floor)
    out = ["media_id", "from_id", "to_id", "affinity", "relation", "tier"]
    pairs = materialize(_dealt(_reaching_pairs(features, k, floor)))
    far = materialize(score_pairs(pairs, features).where("not is_adjacent").select(*out))
    discard(pairs)
    near = materialize(score_adjacent(features).select(*out))
    edges = materialize(top_edges_per_node(near.unionByName(far), k, floor).select(*out, "rank"))
    discard(near, far)
    return edges


def top_k_pairs(scored: DataFrame, k: int) -> DataFrame:
    """Globally best k links; sort plus limit runs as a per-task top-k."""
    return scored.orderBy(F.desc("affinity"), "from_id", "to_id", "media_id").limit(k)


def min_affinity(scored: DataFrame, floor: float = 0.35) -> DataFrame:
    return scored.where(F.col("affinity") >= floor)
