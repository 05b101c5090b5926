"""Best links between fragments whose source or offset is unknown.

Without offsets the score of a pair depends on a finite signature of either side, except for object
numbers. So signatures are scored instead of pairs, each signature keeps only its smallest ids, and
object references and number sequences are found by equi-joins on the number. No pair table of a
whole group ever exists; every fragment ends up with a bounded list that is scored in full.

Exact for the k best links while no label advice above 0.75 stands without its structural flag, which
holds for the rule labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fragloom.operators import links as lk
from fragloom.operators.scale import materialize

# what the score without offsets reads of either side, besides object numbers
LEFT_FLAGS = [
    "opens_stream", "has_endstream", "opens_dict", "opens_text", "split_left", "is_header", "has_eof", "has_xref", "has_trailer",
    "label", "label_confidence", "label_abstained",
]
RIGHT_FLAGS = [
    "has_endstream", "no_stream", "has_defs", "closes_dict", "closes_text", "split_right", "is_header", "has_body", "has_xref", "has_trailer", "has_eof",
    "label", "label_confidence", "label_abstained",
]


def _rule_keys(side: str) -> Column:
    """Names of the rules this side can take part in; a rule can fire only for a shared name."""
    on = lambda c, name: F.when(c, F.lit(name))
    f = F.col
    if side == "a":
        keys = [on(f("opens_stream"), "stream"), on(f("has_xref"), "xref"), on(f("has_trailer"), "eof"), on(f("is_header"), "body"), on(f("opens_dict"), "dict"),
                on(f("opens_text"), "text"), F.concat(F.lit("split"), f("split_left").cast("string"))]
        nexts = F.create_map(*[x for left in dict.fromkeys(t[0] for t in lk.TRANSITIONS) for x in (
            F.lit(left), F.array(*[F.lit("label" + t[1]) for t in lk.TRANSITIONS if t[0] == left]))])
        labels = F.coalesce(F.when(f("label").isNotNull() & ~f("label_abstained"), nexts[f("label")]), F.array().cast("array<string>"))
    else:
        stream = f("has_endstream") | (f("no_stream") & ~f("has_defs"))
        keys = [on(stream, "stream"), on(f("has_trailer"), "xref"), on(f("has_eof"), "eof"), on(~f("is_header") & f("has_body"), "body"), on(f("closes_dict"), "dict"),
                on(f("closes_text"), "text"), F.concat(F.lit("split"), f("split_right").cast("string"))]
        labels = F.array(F.when(~f("label_abstained"), F.concat(F.lit("label"), f("label"))))
    return F.array_compact(F.concat(F.array(*keys), labels))


def _keep(df: DataFrame, part: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def unlocated_links(features: DataFrame, k: int = 3, floor: float = 0.40) -> DataFrame:
    """(from_id, to_id, affinity, relation) of the k best links per fragment over one pool of fragments."""
    pool = features.withColumn("media_id", F.lit(None).cast("string")).withColumn("start", F.lit(None).cast("long")).withColumn("end", F.lit(None).cast("long"))
    pool = pool.withColumn("has_defs", F.size("defs") > 0)
    digest = lambda flags: F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in flags]), 256)
    pool = materialize(pool.withColumns({"sig_a": digest(LEFT_FLAGS), "sig_b": digest(RIGHT_FLAGS)}))
    row = F.struct(*features.columns)

    # signatures scored against each other: rule by rule, with a reference, and with an ascending number
    number = F.array(F.struct(F.lit(-1).cast("long").alias("n"), F.lit(-1).cast("long").alias("g")))
    none = F.filter(number, lambda x: x["n"] > 0)
    null = F.lit(None).cast("long")
    has_refs, has_max, has_min = F.size("refs") > 0, F.col("max_def").isNotNull(), F.col("min_def").isNotNull()
    every = dict.fromkeys([*LEFT_FLAGS, *RIGHT_FLAGS, "ends_alnum", "starts_alnum"])

    def side(sig: str, flags: list[str], **more: Column) -> DataFrame:
        names = [c for c in every if c in features.columns and c not in flags]
        sigs = pool.groupBy(sig).agg(*[F.min(c).alias(c) for c in [*flags, *names]], *[F.max(c).alias(n) for n, c in more.items()])
        blank = {"media_id": F.lit(None).cast("string"), "start": null, "end": null, "refs": none, "max_def": null, "min_def": null}
        return sigs.withColumns(blank | {"fragment_id": F.concat(F.lit(sig), sig), "defs": F.when(F.col("has_defs"), number).otherwise(none) if sig == "sig_b" else none})

    left = materialize(side("sig_a", LEFT_FLAGS, _refs=has_refs, _max=has_max))
    right = materialize(side("sig_b", RIGHT_FLAGS, _min=has_min))
    score = lambda pairs: materialize(lk.pair_score(lk.pair_features(pairs)).select("sig_a", "sig_b", "affinity")).where(F.col("affinity") >= floor)
    a, b = left.select("sig_a", row.alias("a")), right.select("sig_b", row.alias("b"))
    ruled = left.select("sig_a", F.explode(_rule_keys("a")).alias("_k")).join(right.select("sig_b", F.explode(_rule_keys("b")).alias("_k")), "_k").select("sig_a", "sig_b").distinct()
    scored = score(ruled.join(a, "sig_a").join(b, "sig_b"))
    naming = left.where("_refs").withColumn("refs", number).select("sig_a", row.alias("a"))
    by_ref = score(naming.crossJoin(right.where("has_defs").select("sig_b", row.alias("b"))))
    rising = left.where("_max").withColumn("max_def", F.lit(-2).cast("long")).select("sig_a", row.alias("a"))
    by_rise = score(rising.crossJoin(right.where("_min").withColumn("min_def", F.lit(-1).cast("long")).select("sig_b", row.alias("b"))))

    # per signature: the smallest ids of the first groups by lowest object number, because an ascending
    # number can only spoil two of these groups for any one start
    group = F.coalesce("min_def", F.lit(-1).cast("long"))
    heads = _keep(pool.select("sig_b", group.alias("_g"), F.col("fragment_id").alias("to_id")), ["sig_b", "_g"], [F.col("to_id")], k + 1)
    order = [F.desc("affinity"), F.col("to_id")]

    def first_groups(df: DataFrame, key: str, rank: list[Column], best: Column) -> DataFrame:
        groups = df.groupBy(key, "_g").agg(F.min(best).alias("_best"))
        return df.join(_keep(groups, [key], [F.col("_best")], k + 3).select(key, "_g"), [key, "_g"])

    ranked = F.struct((-F.col("affinity")).alias("w"), F.col("to_id"))
    heads = materialize(first_groups(heads, "sig_b", [F.col("to_id")], F.struct("to_id")))
    lists = scored.join(heads, "sig_b").select("sig_a", "sig_b", "_g", "to_id", "affinity")
    lists = first_groups(_keep(lists, ["sig_a", "_g"], order, k + 1), "sig_a", order, ranked)
    risen = by_rise.withColumnRenamed("affinity", "_up")
    lists = lists.join(risen, ["sig_a", "sig_b"], "left").groupBy("sig_a").agg(
        F.collect_list(F.struct((-F.col("affinity")).alias("w"), "to_id", "_g", (-F.coalesce("_up", F.lit(0.0))).alias("up"))).alias("_list")
    )
    lists = materialize(lists)
    near = lambda x: F.coalesce((x["_g"] > 0) & (x["_g"] - F.col("max_def")).between(1, 2), F.lit(False))
    others = lambda links: F.slice(F.sort_array(F.filter(links, lambda x: x["to_id"] != F.col("from_id"))), 1, k)
    told = F.transform("_list", lambda x: F.struct(F.when(near(x), x["up"]).otherwise(x["w"]).alias("w"), x["to_id"].alias("to_id")))
    plain = pool.select("sig_a", "max_def", F.col("fragment_id").alias("from_id")).join(lists, "sig_a").select("from_id", others(told).alias("_links"))

    # object references and ascending numbers: the score of such a pair follows from the signatures, so a number and a
    # left signature share one list of their best targets
    named = lambda c: F.explode(F.transform(c, lk._name))
    target = F.col("fragment_id").alias("to_id")

    def by_number(starts: DataFrame, targets: DataFrame, known: DataFrame) -> DataFrame:
        targets = _keep(targets, ["_n", "sig_b"], [F.col("to_id")], k + 1)
        met = starts.select("sig_a", "_n").distinct().join(known, "sig_a").join(targets, ["_n", "sig_b"])
        best = _keep(met, ["sig_a", "_n"], order, k + 1).groupBy("sig_a", "_n").agg(F.collect_list(ranked).alias("_list"))
        return starts.join(best, ["sig_a", "_n"]).select("from_id", others(F.col("_list")).alias("_links"))

    start = [F.col("fragment_id").alias("from_id"), F.col("sig_a")]
    refs = by_number(pool.select(named("refs").alias("_n"), *start), pool.select(named("defs").alias("_n"), "sig_b", target), by_ref)
    ups = pool.where(has_max).select(F.explode(F.array(F.col("max_def") + 1, F.col("max_def") + 2)).alias("_n"), *start)
    ascending = by_number(ups, pool.where(has_min).select(F.col("min_def").alias("_n"), "sig_b", target), by_rise)

    links = plain.unionByName(refs).unionByName(ascending).groupBy("from_id").agg(F.flatten(F.collect_list("_links")).alias("_links"))
    seen = F.transform(F.array_distinct(F.transform("_links", lambda x: x["to_id"])), lambda to: F.struct(
        F.array_min(F.transform(F.filter("_links", lambda x: x["to_id"] == to), lambda x: x["w"])).alias("w"), to.alias("to_id")))
    ids = links.select("from_id", F.explode_outer(F.slice(F.sort_array(seen), 1, k)).alias("_l")).select("from_id", "_l.to_id").where("to_id is not null")
    ids = materialize(ids)
    a = pool.select(F.col("fragment_id").alias("from_id"), row.alias("a"))
    b = pool.select(F.col("fragment_id").alias("to_id"), row.alias("b"))
    full = lk.pair_score(lk.pair_features(ids.join(a, "from_id").join(b, "to_id"))).select("from_id", "to_id", "affinity", "relation")
    best = full.withColumn("rank", F.row_number().over(Window.partitionBy("from_id").orderBy(F.desc("affinity"), "to_id"))).where(F.col("rank") <= k)
    return best.where(F.col("affinity") >= floor)
