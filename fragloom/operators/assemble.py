"""Ordering fragments by structural rules, walking the chain and judging the result.

Profiles are rows (media_id, fragment_id, kind, object_number, tokens). Everything is grouped by
aggregates or equi-joins on (media_id, object_number) or (media_id, fragment_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fragloom.functions.blob import latin
from fragloom.operators.chunks import range_pieces
from fragloom.operators.recovery import asof_next
from fragloom.operators.scale import materialize, running_rank, with_previous

SECTIONS = ["xref", "trailer", "startxref", "eof"]
TOKEN_OF = {"xref": "xref", "trailer": "trailer", "startxref": "startxref", "eof": "%%EOF"}
RULES = {
    "header": "header_to_first_object", "xref": "xref_to_trailer", "trailer": "trailer_to_startxref",
    "startxref": "startxref_to_eof", "eof": "startxref_to_eof",
}
EDGE_TYPE = "media_id string, rule string, from_id string, to_id string"


def plays(role: str) -> Column:
    """A fragment fills a section role by kind, or by carrying its token without being an object."""
    return (F.col("kind") == role) | ((F.col("kind") != "object") & F.array_contains("tokens", TOKEN_OF[role]))


def media_facts(profiles: DataFrame) -> DataFrame:
    """Counts and unique members per medium, from one partial aggregate."""
    aggs = []
    for role in ["header", *SECTIONS]:
        cond = (F.col("kind") == "header") if role == "header" else plays(role)
        aggs.append(F.count(F.when(cond, 1)).alias(f"{role}_n"))
        aggs.append(F.min(F.when(cond, F.col("fragment_id"))).alias(f"{role}_id"))
    number = F.when(F.col("kind") == "object", F.col("object_number"))
    pair = F.when(F.col("kind") == "object", F.struct("object_number", "fragment_id"))
    base = profiles.groupBy("media_id").agg(
        F.count("*").alias("fragments"), *aggs, F.count(number).alias("objects"),
        F.min(pair).alias("_lo"), F.max(pair).alias("_hi"),
    )
    dup = object_counts(profiles).groupBy("media_id").agg(F.count("*").alias("distinct_objects"))
    d = base.join(dup, "media_id", "left").withColumn("distinct_objects", F.coalesce("distinct_objects", F.lit(0)))
    unique = F.col("distinct_objects") == F.col("objects")
    return d.select(
        "*",
        F.col("_lo.object_number").alias("first_number"),
        F.col("_hi.object_number").alias("last_number"),
        F.when((F.col("objects") > 0) & unique, F.col("_lo.fragment_id")).alias("first_object"),
        F.when((F.col("objects") > 0) & unique, F.col("_hi.fragment_id")).alias("last_object"),
        (unique & (F.col("_hi.object_number") - F.col("_lo.object_number") + 1 == F.col("objects"))).alias("clean_chain"),
    ).drop("_lo", "_hi")


def object_counts(profiles: DataFrame) -> DataFrame:
    return profiles.where("kind = 'object'").groupBy("media_id", "object_number").agg(F.count("*").alias("n"))


def numbers_duplicated(profiles: DataFrame) -> DataFrame:
    return object_counts(profiles).where("n > 1").select("media_id", "object_number")


def numbers_missing(profiles: DataFrame) -> DataFrame:
    """(media_id, first_number, last_number): the numbers absent between the lowest and highest one, as ranges.

    A gap lies between two neighbours, so its width costs nothing.
    """
    present = object_counts(profiles).where("object_number is not null").select("media_id", "object_number")
    d = with_previous(present, ["media_id"], ["object_number"], F.floor(F.col("object_number") / 4096), "_p")
    first = F.col("_p.object_number") + 1
    return d.where(first < F.col("object_number")).select("media_id", first.alias("first_number"), (F.col("object_number") - 1).alias("last_number"))


def object_chain(profiles: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges between consecutive object numbers of media whose numbers form a clean sequence."""
    objects = profiles.where("kind = 'object'").select("media_id", "object_number", "fragment_id")
    clean = objects.join(facts.where("clean_chain").select("media_id"), "media_id", "left_semi")
    a = clean.select("media_id", (F.col("object_number") + 1).alias("object_number"), F.col("fragment_id").alias("from_id"))
    b = clean.select("media_id", "object_number", F.col("fragment_id").alias("to_id"))
    return a.join(b, ["media_id", "object_number"]).select(
        "media_id", F.lit("object_ascending_chain").alias("rule"), "from_id", "to_id"
    )


def structural_edges(profiles: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidate edges header, first object, ..., last object, xref, trailer, startxref, eof.

    Every rule needs exactly one candidate on each side; otherwise it gives no edge.
    """
    one = lambda role: F.when(F.col(f"{role}_n") == 1, F.col(f"{role}_id"))
    rule = lambda name, a, b: F.struct(F.lit(name).alias("rule"), a.alias("from_id"), b.alias("to_id"))
    singles = F.array(
        rule("header_to_first_object", one("header"), F.col("first_object")),
        rule("last_object_to_xref", F.col("last_object"), one("xref")),
        rule("xref_to_trailer", one("xref"), one("trailer")),
        rule("trailer_to_startxref", one("trailer"), one("startxref")),
        rule("startxref_to_eof", one("startxref"), one("eof")),
    )
    fixed = facts.select("media_id", F.inline(singles)).where("from_id is not null and to_id is not null and from_id <> to_id")
    return fixed.unionByName(object_chain(profiles, facts))


def unresolved_joins(facts: DataFrame) -> DataFrame:
    """(rule, reason, candidates) rows for every rule that refused to guess."""
    case = lambda cond, name, reason, n: F.when(
        cond, F.struct(F.lit(name).alias("rule"), F.lit(reason).alias("reason"), n.cast("long").alias("candidates"))
    )
    rows = [
        case(F.col(f"{r}_n") != 1, RULES[r], f"expected exactly one {r} fragment", F.col(f"{r}_n")) for r in ["header", *SECTIONS]
    ]
    rows.append(case(F.col("xref_n") != 1, "last_object_to_xref", "expected exactly one xref fragment", F.col("xref_n")))
    no_object = F.col("first_object").isNull()
    rows.append(case((F.col("header_n") == 1) & no_object, RULES["header"], "cannot name a unique first object", F.col("objects")))
    rows.append(case((F.col("xref_n") == 1) & no_object, "last_object_to_xref", "cannot name a unique last object", F.col("objects")))
    rows.append(case((F.col("objects") > 0) & ~F.col("clean_chain"), "object_ascending_chain", "not a clean ascending chain", F.col("objects")))
    return facts.select("media_id", F.inline(F.array_compact(F.array(*rows))))


def unknown_fragments(profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """Fragments of unknown kind that no edge places."""
    placed = edges.select("media_id", F.explode(F.array("from_id", "to_id")).alias("fragment_id"))
    return profiles.where("kind = 'unknown'").join(placed, ["media_id", "fragment_id"], "left_anti").select("media_id", "fragment_id")


def first_last_object(facts: DataFrame) -> DataFrame:
    return facts.select("media_id", "first_object", "last_object")


def missing_elements(profiles: DataFrame, facts: DataFrame) -> DataFrame:
    names = {
        "header": "missing structural fragment: header (%PDF-)",
        "xref": "missing structural fragment: cross-reference table (xref)",
        "trailer": "missing structural fragment: trailer dictionary",
        "startxref": "missing structural fragment: startxref pointer",
        "eof": "missing structural fragment: EOF terminator (%%EOF)",
    }
    rows = [F.when(F.col(f"{r}_n") == 0, F.lit(text)) for r, text in names.items()]
    rows.append(F.when(F.col("objects") == 0, F.lit("missing structural fragments: object definitions (obj)")))
    fixed = facts.select("media_id", F.explode(F.array_compact(F.array(*rows))).alias("element"))
    first, last = F.col("first_number").cast("string"), F.col("last_number").cast("string")
    several = F.concat(F.lit("missing objects: "), first, F.lit(" to "), last)
    gone = numbers_missing(profiles).select("media_id", F.when(first == last, F.concat(F.lit("missing object: "), first)).otherwise(several).alias("element"))
    return fixed.unionByName(gone)


def conflicting_fragments(profiles: DataFrame, facts: DataFrame) -> DataFrame:
    """Rivals for a unique role or for one object number."""
    many = facts.select("media_id", *[(F.col(f"{r}_n") > 1).alias(f"_{r}") for r in ["header", *SECTIONS]])
    cond = F.col("_header") & (F.col("kind") == "header")
    for r in SECTIONS:
        cond = cond | (F.col(f"_{r}") & plays(r))
    roles = profiles.join(many, "media_id").where(cond).select("media_id", "fragment_id")
    twins = profiles.where("kind = 'object'").join(numbers_duplicated(profiles), ["media_id", "object_number"], "left_semi")
    return roles.unionByName(twins.select("media_id", "fragment_id")).distinct()


def chain_walk(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """(media_id, position, fragment_id) from the single header along the edges.

    Media with no or several headers, a branching or a converging edge give no chain. Pointer doubling
    needs log2(longest chain) joins; a revisited fragment keeps its first position, which cuts cycles.
    """
    crowd = lambda side: edges.groupBy("media_id", side).agg(F.count("*").alias("n")).where("n > 1").select("media_id")
    bad = crowd("from_id").unionByName(crowd("to_id")).distinct()
    good = facts.where("header_n = 1").join(bad, "media_id", "left_anti").select("media_id", F.col("header_id").alias("fragment_id"), "fragments")
    good = materialize(good)
    longest = good.agg(F.coalesce(F.max("fragments"), F.lit(1))).first()[0]
    jump = edges.join(good.select("media_id"), "media_id", "left_semi").select("media_id", F.col("from_id").alias("fragment_id"), "to_id")
    jump = materialize(jump)
    rows = good.select("media_id", F.lit(0).cast("long").alias("position"), "fragment_id")
    reach = 1
    while reach < longest:
        ahead = rows.join(jump, ["media_id", "fragment_id"]).select(
            "media_id", (F.col("position") + reach).alias("position"), F.col("to_id").alias("fragment_id")
        )
        rows = materialize(rows.unionByName(ahead).groupBy("media_id", "fragment_id").agg(F.min("position").alias("position"))
                           .select("media_id", "position", "fragment_id"))
        reach *= 2
        if reach < longest:
            far = jump.select("media_id", F.col("fragment_id").alias("to_id"), F.col("to_id").alias("_next"))
            jump = materialize(jump.join(far, ["media_id", "to_id"]).select("media_id", "fragment_id", F.col("_next").alias("to_id")))
    return rows


STRUCTURE_MARKERS = (
    "pdf_mark", "eof", "startxref_at", "table_mark", "table_head", "entry_n", "entry_f", "obj_number", "root_ref", "catalog", "pages_ref",
)


def catalog_pages(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """(media_id, pages): the page tree that the first catalog with one names; no '>' may stand between the two."""
    of = lambda name: hits.where(F.col("marker") == name)
    refs = of("pages_ref").select("media_id", "pos", "number")
    catalogs = asof_next(of("catalog").select("media_id", F.col("pos").alias("catalog_at"), "end"), refs.select("media_id", "pos"), ["media_id"], "end", "pos", "pos")
    catalogs = catalogs.where("pos is not null").join(refs, ["media_id", "pos"])
    between = catalogs.select("media_id", "catalog_at", F.col("end").alias("start"), F.col("pos").alias("end"))
    closed = range_pieces(chunks, between, ["catalog_at"]).where(F.contains(latin(F.col("piece")), F.lit(">"))).select("media_id", "catalog_at").distinct()
    named = catalogs.join(closed, ["media_id", "catalog_at"], "left_anti")
    return named.groupBy("media_id").agg(F.min_by("number", "catalog_at").alias("pages"))


def table_entries(heads: DataFrame, hits: DataFrame) -> DataFrame:
    """(media_id, num, off, used, pos, end): the first ``count`` entries at or after the table's head, numbered from ``first``."""
    rows = hits.where(F.col("marker").isin("entry_n", "entry_f")).select("media_id", "pos", "end", F.col("number").alias("off"), (F.col("marker") == "entry_n").alias("used"))
    rows = rows.join(heads, "media_id").where(F.col("pos") >= F.col("head_end"))
    ranked = running_rank(rows, ["media_id"], [F.col("pos")], F.floor(F.col("pos") / (1 << 20)), "_i")
    return ranked.where(F.col("_i") <= F.col("count")).select("media_id", (F.col("first") + F.col("_i") - 1).alias("num"), "off", "used", "pos", "end")


def xref_check(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """Structure verdict of PDF media in chunks: header, EOF, startxref, table, entries, Root and Pages.

    ``hits`` are the STRUCTURE_MARKERS of the chunks. Offsets that the file names are looked up among the hits by equi-joins,
    and what follows an offset is told by running ranks, so no row holds more of a medium than a chunk.
    """
    of = lambda name: F.col("marker") == name
    filled = F.length(F.regexp_replace(latin(F.col("content")), r"[ \t\r\n]+\z", ""))
    facts = chunks.groupBy("media_id").agg(
        F.max(F.col("base_offset") + F.length("content")).alias("_n"), F.max(F.when(filled > 0, F.col("base_offset") + filled)).alias("_last")
    )
    first = lambda name: F.min(F.when(of(name), F.struct("pos", "number")))["number"]
    seen = hits.groupBy("media_id").agg(
        F.max(of("pdf_mark") & (F.col("pos") == 0)).alias("_head"), F.max(F.when(of("eof"), F.col("end"))).alias("_eof"),
        F.count(F.when(of("startxref_at"), 1)).alias("_starts"), first("startxref_at").alias("startxref"), first("root_ref").alias("_root"),
    )
    d = facts.join(seen, "media_id", "left").join(catalog_pages(chunks, hits), "media_id", "left")
    d = materialize(d)
    inside = F.coalesce((F.col("startxref") >= 0) & (F.col("startxref") < F.col("_n")), F.lit(False))
    pointed = d.where(inside).select("media_id", F.col("startxref").alias("pos"))
    marks = hits.where(of("table_mark")).join(pointed, ["media_id", "pos"]).select("media_id", F.lit(True).alias("_table"))
    heads = hits.where(of("table_head")).join(pointed, ["media_id", "pos"]).where("number is not null and generation is not null")
    heads = materialize(heads.select("media_id", F.col("number").alias("first"), F.col("generation").alias("count"), F.col("end").alias("head_end")))

    entries = materialize(table_entries(heads, hits))
    found = entries.groupBy("media_id").agg(F.count("*").alias("_found"), F.sum(F.col("end") - F.col("pos")).alias("_bytes"), F.max("end").alias("_to"), F.count(F.when(F.col("used"), 1)).alias("_used"))
    # an object stands at its offset if its number ends as many places behind it as the number has digits
    digits = F.length(F.col("num").cast("string"))
    used = entries.where("used").select("media_id", "num", "off", (F.col("off") + digits).alias("number_end"))
    numbers = hits.where(of("obj_number")).select("media_id", F.col("end").alias("number_end"), F.col("number").alias("_number"))
    there = used.join(numbers, ["media_id", "number_end"]).where(F.pmod("_number", F.pow(F.lit(10), digits).cast("long")) == F.col("num"))
    wrong = used.join(there.select("media_id", "num"), ["media_id", "num"], "left_anti").groupBy("media_id").agg(F.count("*").alias("_wrong"))
    wanted = d.select("media_id", F.explode(F.array("_root", "pages")).alias("num")).where("num is not null")
    defined = wanted.distinct().join(used.select("media_id", "num"), ["media_id", "num"], "left_semi").groupBy("media_id").agg(F.collect_set("num").alias("_defined"))  # two at most

    for part in (marks, heads, found, wrong, defined):
        d = d.join(part, "media_id", "left")
    whole = (F.coalesce("_found", F.lit(0)) == F.col("count")) & (F.coalesce("_bytes", F.lit(0)) == F.coalesce(F.col("_to") - F.col("head_end"), F.lit(0)))
    absent = lambda c: F.col(c).isNotNull() & ~F.coalesce(F.array_contains("_defined", F.col(c)), F.lit(False))
    case = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    started = F.col("startxref").isNotNull()
    table = F.coalesce("_table", F.lit(False))
    readable = F.col("count").isNotNull()
    errors = F.array_compact(
        F.array(
            case(~F.coalesce("_head", F.lit(False)), "header_missing"),
            case(~F.coalesce(F.col("_eof") == F.col("_last"), F.lit(False)), "eof_missing"),
            case(~started, "startxref_missing"),
            case(started & ~inside, "startxref_out_of_bounds"),
            case(started & inside & ~table, "no_xref_at_offset"),
            case(table & ~readable, "subsection_malformed"),
            case(readable & ~whole, "entry_malformed"),
            case(readable & (F.col("_wrong") > 0), "object_not_at_offset"),
            case(readable & absent("_root"), "root_undefined"),
            case(readable & absent("pages"), "pages_undefined"),
        )
    )
    return d.select("media_id", "startxref", F.coalesce("_used", F.lit(0)).cast("long").alias("entries"), errors.alias("errors"), (F.size(errors) == 0).alias("is_valid"))


def digest_mismatches(chain: DataFrame, blocks: DataFrame, declared: DataFrame) -> DataFrame:
    """(media_id, fragment_id) of placed fragments whose bytes have another digest or size than ``declared`` (sha256, size_bytes)."""
    placed = chain.select("media_id", "fragment_id").join(blocks.select("media_id", "fragment_id", "block"), ["media_id", "fragment_id"])
    got = placed.select("media_id", "fragment_id", F.sha2("block", 256).alias("_got"), F.length("block").alias("_length"))
    both = got.join(declared.select("media_id", "fragment_id", "sha256", "size_bytes"), ["media_id", "fragment_id"])
    return both.where((F.col("_got") != F.col("sha256")) | (F.col("_length") != F.col("size_bytes"))).select("media_id", "fragment_id")


def recovery_state(facts: DataFrame, chain: DataFrame, profiles: DataFrame, unresolved: DataFrame, structure: DataFrame,
                   corrupted: DataFrame | None = None) -> DataFrame:
    """UNRECOVERABLE, PARTIAL, CORRUPTED or COMPLETE AND VERIFIED per medium, with the status.

    A digest mismatch of a placed fragment makes the medium CORRUPTED.
    """
    kinds = chain.join(profiles.select("media_id", "fragment_id", "kind"), ["media_id", "fragment_id"])
    ends = kinds.groupBy("media_id").agg(
        F.count("*").alias("placed"), F.min(F.struct("position", "kind")).alias("_a"), F.max(F.struct("position", "kind")).alias("_z")
    )
    open_joins = unresolved.groupBy("media_id").agg(F.count("*").alias("open_joins"))
    d = (
        facts.select("media_id", "fragments").join(ends, "media_id", "left").join(open_joins, "media_id", "left")
        .join(structure.select("media_id", "is_valid"), "media_id", "left")
    )
    if corrupted is None:
        d = d.withColumn("_corrupt", F.lit(False))
    else:
        d = d.join(corrupted.select("media_id").distinct().withColumn("_corrupt", F.lit(True)), "media_id", "left")
    placed = F.coalesce("placed", F.lit(0))
    complete = (placed == F.col("fragments")) & F.col("open_joins").isNull() & (F.col("_a.kind") == "header") & (F.col("_z.kind") == "eof")
    valid = F.coalesce("is_valid", F.lit(False))
    state = (
        F.when(F.coalesce("_corrupt", F.lit(False)), "CORRUPTED")
        .when(placed == 0, "UNRECOVERABLE")
        .when(~complete, "PARTIAL")
        .when(valid, "COMPLETE AND VERIFIED")
        .otherwise("CORRUPTED")
    )
    return d.select("media_id", "fragments", placed.alias("placed"), state.alias("recovery_state")).withColumn(
        "status",
        F.when(F.col("recovery_state") == "COMPLETE AND VERIFIED", "structurally_valid")
        .when(F.col("recovery_state") == "CORRUPTED", "failed")
        .otherwise("incomplete"),
    )


def integrity_verdict(states: DataFrame, diff: DataFrame) -> DataFrame:
    """Final status against the original; only equal bytes of a complete, valid chain are verified."""
    d = states.join(diff, "media_id", "left")
    same = F.coalesce("byte_match", F.lit(False))
    valid = F.col("status") == "structurally_valid"
    partial = (F.col("status") == "incomplete") & (F.col("placed") > 0) & F.coalesce("is_prefix", F.lit(False))
    return d.select(
        "media_id",
        F.when(same & valid, "verified").when(same, F.col("status")).when(partial, "incomplete").otherwise("failed").alias("status"),
        F.when(same, F.col("recovery_state")).when(partial, "PARTIAL").otherwise("CORRUPTED").alias("recovery_state"),
        same.alias("byte_match"),
        F.when(~same & ~partial, F.col("first_diff")).alias("first_mismatch"),
    )
