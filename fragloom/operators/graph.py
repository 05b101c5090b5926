"""Components, competing joins and greedy chains over link tables.

Nodes are (media_id, id) rows, edges (media_id, from_id, to_id, affinity) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fragloom.operators.scale import discard, materialize, running_rank

AMBIGUOUS = 0.50


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Weak components labelled by their smallest id, singletons included.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) converge in about log n rounds
    whatever the diameter; label propagation would need one round per step of a long chain. Lineage is
    cut by a checkpoint per round, and only a row count and a digest reach the driver.
    """
    key = "media_id"
    pairs = edges.where("from_id <> to_id").select(
        key, F.greatest("from_id", "to_id").alias("u"), F.least("from_id", "to_id").alias("v")
    ).distinct()
    pairs = materialize(pairs)
    seen = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(key, "u").agg(F.min("v").alias("_m"))
        large = (
            both.join(low, [key, "u"]).where(F.col("v") > F.col("u"))
            .select(key, F.col("v").alias("u"), F.least("_m", F.col("u")).alias("v"))
            .distinct()
        )
        low = large.groupBy(key, "u").agg(F.min("v").alias("_m"))
        small = (
            large.join(low, [key, "u"])
            .select(key, F.explode(F.array(F.struct("u", F.col("_m").alias("v")), F.struct(F.col("v").alias("u"), F.col("_m").alias("v")))).alias("_p"))
            .select(key, "_p.u", "_p.v")
            .where("u <> v")
            .distinct()
        )
        pairs, spent = materialize(small), pairs
        discard(spent)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64(key, "u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = pairs.select(key, F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.select(key, "id").join(root, [key, "id"], "left").withColumn("component", F.coalesce("component", "id"))


def competing_edges(edges: DataFrame, floor: float = AMBIGUOUS) -> DataFrame:
    """Nodes with two or more strong successors or predecessors, with the rivals."""
    strong = edges.where(F.col("affinity") >= floor)
    side = lambda node, other, direction: strong.select(
        "media_id", F.col(node).alias("id"), F.lit(direction).alias("direction"), F.col(other).alias("other"), "affinity"
    )
    both = side("from_id", "to_id", "successor").unionByName(side("to_id", "from_id", "predecessor"))
    # a popular target can have millions of predecessors: rivals stay rows, only counts are grouped
    counted = both.groupBy("media_id", "id", "direction").agg(F.count("*").alias("rivals")).where("rivals > 1")
    return both.join(counted, ["media_id", "id", "direction"])


def best_edges(edges: DataFrame, floor: float) -> DataFrame:
    """Strongest outgoing edge per node, smallest target id on ties."""
    return (
        edges.where(F.col("affinity") >= floor)
        .groupBy("media_id", F.col("from_id").alias("id"))
        .agg(F.min(F.struct((-F.col("affinity")).alias("w"), F.col("to_id").alias("next"))).alias("_e"))
        .select("media_id", "id", F.col("_e.next").alias("next"), (-F.col("_e.w")).alias("weight"))
    )


def walk(starts: DataFrame, step: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Rows (media_id, start_id, position, id, weight) of the path from each start along ``step``, whole unless ``max_nodes`` is given.

    Pointer doubling: round i joins the first 2^i nodes of every path with a table of 2^i-step jumps, so
    a path of 100 nodes takes seven joins. A path visits a node once, so the steps of the medium with most of them
    bound the rounds. ``step`` must have one row per node and no cycles.
    """
    if max_nodes is None:
        most = step.groupBy("media_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        max_nodes = (most or 0) + 1
    jump = materialize(step.select("media_id", "id", F.col("next").alias("to"), F.col("weight").alias("w")))
    rows = starts.select("media_id", F.col("id").alias("start_id"), F.lit(0).cast("long").alias("position"), "id", F.lit(0.0).alias("weight"))
    reach = 1
    while reach < max_nodes:
        ahead = (
            rows.join(jump, ["media_id", "id"])
            .where(F.col("position") + reach < max_nodes)
            .select("media_id", "start_id", (F.col("position") + reach).alias("position"), F.col("to").alias("id"), (F.col("weight") + F.col("w")).alias("weight"))
        )
        rows, spent = materialize(rows.unionByName(ahead)), rows
        if reach > 1:
            discard(spent)
        reach *= 2
        if reach < max_nodes:
            far = jump.select("media_id", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("w").alias("w2"))
            far = jump.join(far, ["media_id", "to"]).select("media_id", "id", F.col("to2").alias("to"), (F.col("w") + F.col("w2")).alias("w"))
            jump, spent = materialize(far), jump
            discard(spent)
    return rows


def candidate_chains(nodes: DataFrame, edges: DataFrame, floor: float = 0.50, max_nodes: int | None = None) -> DataFrame:
    """Greedy chains from nodes without a strong predecessor, or with a header label; length over 1.

    Links inside a source only run forward, so the walk cannot revisit a node.
    """
    step = materialize(best_edges(edges, floor))
    targets = edges.where(F.col("affinity") >= floor).select("media_id", F.col("to_id").alias("id")).distinct()
    starts = nodes.join(targets, ["media_id", "id"], "left_anti").select("media_id", "id")
    if "label" in nodes.columns:
        starts = starts.unionByName(nodes.where("label = 'PDF_HEADER'").select("media_id", "id")).distinct()
    moving = starts.join(step.select("media_id", "id"), ["media_id", "id"], "left_semi")
    return walk(moving, step, max_nodes)


def best_chain(nodes: DataFrame, edges: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """One greedy chain per medium from its header (else the node of lowest in-degree) to a footer.

    ``nodes`` needs id, is_header, is_footer and ``seq`` (the order of entry, for ties).
    """
    degree = edges.groupBy("media_id", F.col("to_id").alias("id")).agg(F.count("*").alias("_in"))
    ranked = nodes.join(degree, ["media_id", "id"], "left").withColumn("_in", F.coalesce("_in", F.lit(0)))
    key = F.struct((~F.col("is_header")).alias("h"), F.when(F.col("is_header"), 0).otherwise(F.col("_in")).alias("d"), "seq", "id")
    starts = ranked.groupBy("media_id").agg(F.min(key).alias("_s")).select("media_id", F.col("_s.id").alias("id"))
    keep = nodes.where(~F.col("is_footer")).select("media_id", "id").unionByName(starts).distinct()
    step = materialize(best_edges(edges, float("-inf")).join(keep, ["media_id", "id"], "left_semi"))
    return walk(starts, step, max_nodes)


def graph_summary(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """Node, edge, component and ambiguous-node counts per medium."""
    n = nodes.groupBy("media_id").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("media_id").agg(F.count("*").alias("edges"))
    # a component is named after its smallest member, so counting those members counts components
    c = components.where("id = component").groupBy("media_id").agg(F.count("*").alias("components"))
    a = competing_edges(edges).groupBy("media_id", "id").agg(F.max("rivals")).groupBy("media_id").agg(F.count("*").alias("ambiguous"))
    fill = lambda col: F.coalesce(col, F.lit(0)).alias(col)
    return (
        n.join(e, "media_id", "left").join(c, "media_id", "left").join(a, "media_id", "left")
        .select("media_id", "nodes", fill("edges"), fill("components"), fill("ambiguous"))
    )


def numbered_edges(edges: DataFrame) -> DataFrame:
    """Edges with their index in (affinity down, from, to) order per medium."""
    hex3 = F.conv(F.substring("from_id", 5, 3), 16, 10).cast("long")
    bucket = F.round((1 - F.col("affinity")) * 10000).cast("long") * 4096 + F.coalesce(hex3, F.lit(0))
    ranked = running_rank(edges, ["media_id"], [F.desc("affinity"), F.col("from_id"), F.col("to_id")], bucket, "_n")
    return ranked.withColumn("edge_index", F.col("_n") - 1).drop("_n")


def graph_export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Graph elements as ``{"data": {...}}`` JSON rows."""
    label = F.coalesce("label", F.lit("UNKNOWN"))
    node = F.to_json(F.struct(F.struct(
        F.col("id"), F.concat("id", F.lit("\n("), label, F.lit(")")).alias("label"), "length", label.alias("predicted_label"),
        F.lit("CARVED_FRAGMENT").alias("provenance"),
    ).alias("data")))
    edge = F.to_json(F.struct(F.struct(
        F.concat_ws("_", F.lit("edge"), F.col("edge_index").cast("string"), "from_id", "to_id").alias("id"),
        F.col("from_id").alias("source"), F.col("to_id").alias("target"), F.col("affinity").alias("weight"),
        F.col("relation").alias("type"), F.col("tier").alias("confidence"), F.lit("HEURISTIC_AFFINITY").alias("provenance"),
    ).alias("data")))
    return nodes.select("media_id", F.lit("node").alias("kind"), node.alias("element")).unionByName(
        numbered_edges(edges).select("media_id", F.lit("edge").alias("kind"), edge.alias("element"))
    )
