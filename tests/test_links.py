"""Link rules on hand-made fragments, and the unlocated search against all pairs."""

import random

from pyspark.sql import functions as F

from fragloom.operators import graph as gr, links as lk
from fragloom.operators.unlocated import unlocated_links


def frags(spark, rows):
    data = [(m, i, s, bytearray(b)) for m, i, s, b in rows]
    return lk.link_features(spark.createDataFrame(data, "media_id string, fragment_id string, start long, block binary"))


def score(spark, a, b):
    f = frags(spark, [a, b])
    row = F.struct(*f.columns)
    left = f.where(f.fragment_id == a[1]).select(row.alias("a"))
    right = f.where(f.fragment_id == b[1]).select(row.alias("b"))
    return lk.pair_score(lk.pair_features(left.crossJoin(right))).first()


def test_adjacent_with_and_without_syntax(spark):
    r = score(spark, ("d", "A", 0, b"0123456789"), ("d", "B", 10, b"   plain"))
    assert (r.affinity, r.relation, r.tier) == (0.85, "ADJACENT", "HIGH")
    r = score(spark, ("d", "A", 0, b"1 0 obj << end"), ("d", "B", 14, b"obj 2 0 obj"))
    assert r.affinity == 0.95 and r.token_splice


def test_reverse_and_gap(spark):
    r = score(spark, ("d", "A", 100, b"xx"), ("d", "B", 0, b"yy"))
    assert r.affinity == 0.0 and "reverse_offset_ordering" in r.negative
    r = score(spark, ("d", "A", 0, b"see 7 0 R here"), ("d", "B", 4000, b"7 0 obj\n<<>>"))
    assert r.affinity == 0.45 and r.relation == "OBJECT_REFERENCE"


def test_unlocated_rules(spark):
    r = score(spark, (None, "A", None, b"stream\nBT (x) Tj"), (None, "B", None, b"more ET\nendstream"))
    assert r.affinity == 0.85 and r.relation == "STREAM_CONTINUATION"
    r = score(spark, (None, "A", None, b"%PDF-1.4\n"), (None, "B", None, b"%PDF-1.5\n"))
    assert r.affinity == 0.0 and "contradictory_double_header" in r.negative
    r = score(spark, (None, "A", None, b"xref\n0 1\n"), (None, "B", None, b"trailer\n<< >>"))
    assert r.affinity == 0.85 and r.tier == "HIGH"


def test_self_pair(spark):
    r = score(spark, ("d", "A", 0, b"abc"), ("d", "A", 0, b"abc"))
    assert (r.affinity, r.relation, r.tier) == (0.0, "DISJOINT", "NEGLIGIBLE")


def test_unlocated_links_equal_brute_force(spark):
    rng = random.Random(5)
    atoms = [b"%PDF-1.4\n", b"xref\n", b"trailer\n", b"startxref\n9\n%%EOF", b"stream\n", b"endstream\n", b"BT ", b"ET ", b"<< ", b">> ", b"(a) Tj ", b"plain text "]
    rows = []
    for i in range(60):
        body = b"".join(rng.choice(atoms) for _ in range(rng.randint(1, 3)))
        if rng.random() < 0.5:
            body += b" %d 0 obj " % rng.randint(1, 6)
        if rng.random() < 0.4:
            body += b" %d 0 R " % rng.randint(1, 6)
        body += rng.choice([b"", b"end", b"stre", b"/Ty"])
        rows.append((None, f"F{i:03d}", None, rng.choice([b"", b"", b"obj ", b"am ", b"pe "]) + body))
    f = frags(spark, rows).withColumn("label", F.lit(None).cast("string"))
    got = {(r.from_id, r.to_id, r.affinity) for r in unlocated_links(f, 3, 0.40).collect()}
    row = F.struct(*f.columns)
    pairs = f.select(row.alias("a")).crossJoin(f.select(row.alias("b")))
    full = lk.pair_score(lk.pair_features(pairs)).select(F.col("a.fragment_id").alias("x"), F.col("b.fragment_id").alias("y"), "affinity").collect()
    want = set()
    for i in {r.x for r in full}:
        best = sorted((r for r in full if r.x == i and r.y != i and r.affinity >= 0.40), key=lambda r: (-r.affinity, r.y))[:3]
        want |= {(r.x, r.y, r.affinity) for r in best}
    assert got == want


def test_components_of_a_long_path(spark):
    n = 300
    nodes = spark.createDataFrame([("m", f"n{i:04d}") for i in range(n + 1)], "media_id string, id string")
    edges = spark.createDataFrame([("m", f"n{i:04d}", f"n{i + 1:04d}", 0.9) for i in range(n) if i != 120], "media_id string, from_id string, to_id string, affinity double")
    got = {r.id: r.component for r in gr.connected_components(nodes, edges).collect()}
    assert got == {f"n{i:04d}": "n0000" if i <= 120 else "n0121" for i in range(n + 1)}


def test_chains_follow_the_best_edge(spark):
    nodes = spark.createDataFrame([("m", x) for x in "abcd"], "media_id string, id string")
    edges = spark.createDataFrame(
        [("m", "a", "b", 0.9), ("m", "a", "c", 0.95), ("m", "b", "d", 0.6), ("m", "c", "d", 0.4)], "media_id string, from_id string, to_id string, affinity double"
    )
    got = sorted((r.start_id, r.position, r.id) for r in gr.candidate_chains(nodes, edges).collect())
    assert got == [("a", 0, "a"), ("a", 1, "c")]


def test_gap_pairs_whole_and_nearest(spark):
    rows = [("m", f"f{i:02d}", s, s + 10) for i, s in enumerate([0, 10, 15, 25, 300, 310, 311, 900, 900, 5000])] + [("n", "x", 0, 10)]
    f = spark.createDataFrame(rows, "media_id string, fragment_id string, start long, end long")
    after = lambda r: sorted((b for b in rows if b[0] == r[0] and b[2] > r[3]), key=lambda b: (b[2], b[1]))
    every = {(a[1], b[1], b[2] - a[3]) for a in rows for b in after(a)}
    assert {(r.from_id, r.to_id, r.gap) for r in lk.all_gap_pairs(f, width=64).collect()} == every
    near = {(a[1], b[1], b[2] - a[3]) for a in rows for b in after(a)[:2]}
    got = lk.forward_gap_pairs(f, 2).collect()
    assert len(got) == len(near) and {(r.from_id, r.to_id, r.gap) for r in got} == near


def test_every_forward_pair_is_scored(spark):
    """No start loses successors, however many it has and in whatever cells they lie."""
    rng = random.Random(7)
    atoms = [b"%PDF-1.4\n", b"xref\n", b"trailer\n", b"%%EOF", b"stream\n", b"endstream\n", b"<< ", b">> ", b"BT ", b"ET ", b"3 0 obj ", b"3 0 R ", b"67 0 R ", b"4 0 obj ", b"end", b"obj "]
    rows, at = [], 0
    for i in range(60):
        body = b"".join(rng.choice(atoms) for _ in range(rng.randint(1, 3)))
        rows.append(("m" if i < 50 else "n", f"F{i:03d}", at, body))
        at += len(body) + (0 if i % 3 else 40)
    f = frags(spark, rows)
    row = F.struct(*f.columns)
    pairs = f.select(row.alias("a")).crossJoin(f.select(row.alias("b"))).where("a.media_id = b.media_id and b.start >= a.end")
    columns = ["gap", "affinity", "relation", "tier", "observed", "negative"]
    want = lk.pair_score(lk.pair_features(pairs)).select("a.media_id", F.col("a.fragment_id").alias("from_id"), F.col("b.fragment_id").alias("to_id"), *columns)
    got = lk.score_forward(f, width=64).select("media_id", "from_id", "to_id", *columns)
    assert sorted(got.collect()) == sorted(want.collect()) and got.where("from_id = 'F000'").count() == 49
