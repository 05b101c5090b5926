"""True successors, link quality and recall of ranked links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fragloom.operators import links as lk
from fragloom.operators.scale import global_rank, materialize, running_rank


def true_successors(df: DataFrame, keys: list[str], order: str, id_col: str) -> DataFrame:
    """(keys, from_id, to_id) of each row and the next one of its key, by rank and equi-join."""
    ranked = running_rank(df.select(*keys, order, id_col), keys, [F.col(order), F.col(id_col)], F.floor(F.col(order) / (1 << 20)), "_r")
    a = ranked.select(*keys, F.col(id_col).alias("from_id"), (F.col("_r") + 1).alias("_r"))
    b = ranked.select(*keys, F.col(id_col).alias("to_id"), "_r")
    return a.join(b, [*keys, "_r"]).drop("_r")


def cross_source_negatives(features: DataFrame, doc_number: Column, first: int = 3) -> DataFrame:
    """Pairs of the first fragments of each document with those of the next document in order."""
    order = Window.partitionBy("media_id").orderBy("start")
    heads = features.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= first).drop("_r")
    docs = features.select("media_id", doc_number.alias("_d")).groupBy("media_id").agg(F.min("_d").alias("_d"))
    ranked = global_rank(docs, "_d", "_doc", ties=("media_id",))
    row = F.struct(*features.columns)
    tagged = heads.select("media_id", row.alias("row")).join(ranked.select("media_id", "_doc"), "media_id")
    a = tagged.select("_doc", F.col("row").alias("a"))
    b = tagged.select((F.col("_doc") - 1).alias("_doc"), F.col("row").alias("b"))
    return lk.pair_score(lk.pair_features(a.join(b, "_doc"))).drop("_doc")


def later_count(left: DataFrame, right: DataFrame, keys: list[str], leaf: int = lk.LEAF) -> DataFrame:
    """Number of right rows with equal keys and _s > _e for every left row, from per-leaf counts.

    Counts of later leaves are a running sum over leaves; only the left row's own leaf is compared row by row.
    """
    q, p = F.floor(F.col("_e") / leaf), F.floor(F.col("_s") / leaf)
    leaves = right.groupBy(*keys, p.alias("_p")).agg(F.count("*").alias("_cnt"))
    tree = (
        leaves.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(40)))).withColumn("_n", F.expr("shiftright(_p, _l)"))
        .where("_n % 2 = 1").groupBy(*keys, "_l", "_n").agg(F.sum("_cnt").alias("_cnt"))
    )
    path = (
        left.withColumn("_q", q).withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(40))))
        .withColumn("_n", F.expr("shiftright(_q, _l)")).where("_n % 2 = 0")
        .select(*keys, "from_id", "_l", (F.col("_n") + 1).alias("_n"))
    )
    far = path.join(tree, [*keys, "_l", "_n"]).select(*keys, "from_id", "_cnt")
    near = (
        left.withColumn("_n", q).join(right.withColumn("_n", p), [*keys, "_n"]).where(F.col("_s") > F.col("_e"))
        .select(*keys, "from_id", F.lit(1).cast("long").alias("_cnt"))
    )
    return far.unionByName(near).groupBy(*keys, "from_id").agg(F.sum("_cnt").alias("later"))


def _spliced(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Those of the pairs whose two texts may join to a known token."""
    having = lambda column, key: features.where(F.col(column).isNotNull()).select("media_id", F.col("fragment_id").alias(key))
    return pairs.join(having("split_left", "from_id"), ["media_id", "from_id"], "left_semi").join(having("split_right", "to_id"), ["media_id", "to_id"], "left_semi")


def link_metrics(features: DataFrame, truth: DataFrame, cross: DataFrame, floor: float = 0.55) -> DataFrame:
    """Confusion counts and rates over all ordered pairs without making the pairs.

    ``truth`` has the true (media_id, from_id, to_id) inside the sources, none of them twice. Above 0.50 only adjacency and a token splice can predict a link inside a source. Spliced pairs over a
    gap are counted, not listed; true negatives follow from n(n-1).
    """
    if floor <= 0.50:
        raise ValueError("the counting shortcut needs a threshold above 0.50")
    scored = lk.score_adjacent(features).select("media_id", "from_id", "to_id", "affinity")
    near = materialize(scored).where(F.col("affinity") >= floor)
    hit = near.select("media_id", "from_id", "to_id")
    true = truth.select("media_id", "from_id", "to_id")
    behind = lk.score_pairs(_spliced(true, features), features).where("not is_adjacent").where(F.col("affinity") >= floor)
    right_ones = hit.join(true, hit.columns, "left_semi").unionByName(behind.select(*hit.columns))
    tp = materialize(right_ones.agg(F.count("*").alias("tp")))
    accepted = lk._accepted_classes(0.90, floor)
    left = features.where("split_left is not null").select(
        "media_id", F.col("split_left").alias("_k"), F.explode(accepted).alias("_c"), F.col("fragment_id").alias("from_id"), F.col("end").alias("_e")
    ).withColumn("from_id", F.concat_ws("#", "from_id", F.col("_c").cast("string")))
    right = features.where("split_right is not null").select(
        "media_id", F.col("split_right").alias("_k"), lk._penalty_class().alias("_c"), F.col("start").alias("_s")
    )
    spliced = later_count(left, right, ["media_id", "_k", "_c"]).agg(F.coalesce(F.sum("later"), F.lit(0)).alias("spliced"))
    sizes = features.groupBy("media_id").agg(F.count("*").alias("n")).where("n > 1")
    pairs = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("inner_pairs"))
    outer = cross.agg(F.count("*").alias("outer_pairs"), F.coalesce(F.sum(F.when(F.col("affinity") >= floor, 1).otherwise(0)), F.lit(0)).alias("outer_fp"))
    near_count = hit.agg(F.count("*").alias("near"))
    positives = truth.agg(F.count("*").alias("positives"))
    one = near_count
    for part in (tp, spliced, pairs, outer, positives):  # one row each
        one = one.crossJoin(part)
    fp = F.col("near") + F.col("spliced") - F.col("tp") + F.col("outer_fp")
    negatives = F.col("inner_pairs") + F.col("outer_pairs") - F.col("positives")
    d = one.withColumns({"fp": fp, "fn": F.col("positives") - F.col("tp"), "negatives": negatives}).withColumn("tn", F.col("negatives") - F.col("fp"))
    return d.select("tp", "fp", "fn", "tn", *rates())


def rates() -> list[Column]:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = ratio(2 * precision * recall, precision + recall)
    return [
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
        F.round(ratio(fp, fp + tn), 4).alias("false_link_rate"),
    ]


def recall_at_k(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of true successors among the first k links of their start; ``ranked`` carries ``rank``.

    A true successor that scores exactly 0 counts as a miss.
    """
    joined = truth.join(ranked.select("media_id", "from_id", "to_id", "rank"), ["media_id", "from_id", "to_id"], "left")
    hit = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 4).alias(f"recall_at_{k}")
    return joined.agg(F.count("*").alias("successors"), *[hit(k) for k in ks])
