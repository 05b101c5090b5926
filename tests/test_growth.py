"""Steps whose work must not grow with the square of a text, nor be done twice."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from fragloom.operators import chunks, damage, fragments as fr, graph, links, ml, recovery as rc, scale
from fragloom.operators.unlocated import unlocated_links
from fragloom.plans import dataset_queries, link_queries, ml_queries, recovery_queries, views
from fragloom.plans.registry import Tables


def test_first_difference_late_in_a_cell(spark):
    """A cell is looked at a few times, not once per byte."""
    same = "concat('m', id) AS media_id", "cast(0 AS long) AS start"
    whole = spark.range(0, 160, 1, 8).selectExpr(*same, "encode(repeat('abcdefgh', 8192), 'utf-8') AS block")
    bad = spark.range(0, 160, 1, 8).selectExpr(*same, "encode(concat(repeat('abcdefgh', 8191), 'abcdefg', if(id % 2 = 0, 'x', 'h')), 'utf-8') AS block")
    began = time.monotonic()
    rows = {r.media_id: r.first_diff for r in fr.first_diff(bad, whole).collect()}
    took = time.monotonic() - began
    assert rows == {f"m{i}": 65_535 if i % 2 == 0 else None for i in range(160)}
    assert took < 60


def test_scrambling_a_long_text(spark):
    """The pieces of a text are cut in one pass."""
    media = spark.range(0, 1, 1, 1).selectExpr("'m' AS media_id", "encode(repeat('0123456789abcdef', 200000), 'ISO-8859-1') AS content")
    began = time.monotonic()
    out = damage.damage_recipe(media, "online_scramble").first().content
    took = time.monotonic() - began
    text = b"0123456789abcdef" * 200_000
    moved = [i for i, (x, y) in enumerate(zip(text, out)) if x != y]
    assert len(out) == len(text) and out[:32] == text[:32] and out[-32:] == text[-32:]
    assert len({i // 50 for i in moved}) == len(moved) and 63_000 < len(moved) <= 64_000
    assert took < 30


def filters(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line and "size(" in line]


def test_texts_are_built_once(spark):
    """No emptiness filter of an explode reaches the scan, where it would build and search each text again."""
    t = Tables(spark, "/root/testdata/sf0.001")
    assert not filters(dataset_queries.recovered_originals(t))  # F35
    assert not filters(recovery_queries.pieces(t))  # F27, F32
    assert not filters(chunks.cut_media(views.pdf_media(t), 4096))  # F22, F23, F38, F39


def test_unlocated_links_score_few_pairs(spark, monkeypatch):
    """Pairs by object number are ranked by signature; only the best of a fragment are scored in full."""
    seen, real = [], links.pair_features
    monkeypatch.setattr(links, "pair_features", lambda pairs: (seen.append(pairs), real(pairs))[1])
    f = link_queries.stored_features(Tables(spark, "/root/testdata/sf0.001")).withColumn("fragment_id", F.concat_ws("/", "media_id", "fragment_id"))
    unlocated_links(f)
    assert seen[-1].count() <= 3 * f.count()


def test_next_row_in_one_large_bucket(spark):
    """The next hit of each of many rows is found in one pass over their bucket."""
    a, b = (spark.range(0, 300_000, 1, 4).selectExpr("'m' AS media_id", f"id * 10 + {k} AS {n}") for k, n in ((0, "l"), (3, "r")))
    began = time.monotonic()
    got = rc.asof_next(a, b, ["media_id"], "l", "r", "hit").where("hit = l + 3").count()
    assert got == 300_000 and time.monotonic() - began < 60
    marks = spark.range(0, 40, 1, 2).selectExpr("if(id < 20, 'm', 'n') AS media_id", "id AS pos")
    values = {"_a": F.when(F.col("pos") % 7 == 0, F.col("pos")), "_b": F.when(F.col("pos") % 5 == 0, F.struct("pos"))}
    for width in (4, 1 << 24):
        rows = rc.first_after(marks, ["media_id"], "pos", values, width).collect()
        ends = {r.pos: 20 if r.media_id == "m" else 40 for r in rows}
        find = lambda p, n: min((x for x in range(p, ends[p]) if x % n == 0), default=None)
        assert {r.pos: (r._a, r._b and r._b.pos) for r in rows} == {p: (find(p, 7), find(p, 5)) for p in range(40)}


def test_hits_of_few_chunks_are_held():
    """A batch of chunks is searched a part at a time."""
    one = lambda i: (f"m{i}", 0, 14, b"1 0 obj endobj")
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*map(one, range(2_000)))], ["media_id", "base_offset", "size_bytes", "content"])
    parts = list(chunks._search_chunks(("obj", "endobj"))(iter([batch])))
    assert sum(p.num_rows for p in parts) == 4_000 and max(p.num_rows for p in parts) <= 2 * chunks.AT_ONCE


def test_forest_sends_few_copies_of_its_statistics(spark, monkeypatch):
    """Tasks of a level are as many as cores, whatever the partitions of the rows."""
    monkeypatch.setattr(ml.Pipeline, "fit", lambda self, rows: rows)
    rows = spark.range(0, 400, 1, 64).selectExpr("cast(id AS double) AS x", "if(id % 2 = 0, 'a', 'b') AS label")
    assert ml.rf_train(rows, features=["x"]).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_labels_of_many_small_regions(spark):
    """Blocks meet only regions near them, and the bytes of regions are not moved."""
    blocks = spark.range(0, 4_000, 1, 4).selectExpr("'m' AS media_id", "id * 256 AS start", "id * 256 + 256 AS end", "id AS k")
    regions = spark.range(0, 16_000, 1, 4).selectExpr("'m' AS media_id", "id * 64 AS start", "id * 64 + 64 AS end", "concat('L', id % 4) AS label", "concat('e', id) AS entity_id")
    d = rc.dominant_label(blocks, regions, "k")
    assert {(r.label, r.is_exact) for r in d.collect()} == {("L0", True)}
    f = Tables(spark, "/root/testdata/sf0.001")
    assert "listagg" not in recovery_queries.regions(f)._jdf.queryExecution().optimizedPlan().toString()


def on_disk(spark):
    """Numbers of shuffles and of checkpoints that have files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    path = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    folders = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return {f.split("_")[-3] for f in files.split("\n") if "shuffle_" in f and f.endswith(".data")}, {str(f.getPath().getName()) for f in folders}


def test_intermediates_leave_only_their_rows(spark):
    """What was shuffled for an intermediate goes when it is written, and a round's result when the next one is there."""
    d = scale.materialize(spark.range(0, 1000).selectExpr("id % 10 AS k").distinct())
    shuffled, kept = on_disk(spark)
    e = scale.materialize(spark.range(0, 1000).selectExpr("id % 10 AS k").join(d, "k").groupBy("k").count())
    nodes = spark.createDataFrame([("m", f"n{i:04d}") for i in range(101)], "media_id string, id string")
    edges = spark.createDataFrame([("m", f"n{i:04d}", f"n{i + 1:04d}", 0.9) for i in range(100)], "media_id string, from_id string, to_id string, affinity double")
    graph.connected_components(nodes, edges)
    for _ in range(50):  # files are removed beside the queries
        more = on_disk(spark)[0] - shuffled
        if len(more) <= 16:
            break
        time.sleep(0.2)
    assert len(more) <= 16  # the last exchange of each round's count and digest, one row a task
    assert len(on_disk(spark)[1] - kept) == 2 and e.count() == 10
    scale.discard(e)
    assert len(on_disk(spark)[1] - kept) == 1


def test_features_are_moved_once(spark):
    """Labels and splits meet before the wide feature rows join them."""
    d = ml_queries.labelled_rows(Tables(spark, "/root/testdata/sf0.001"))
    joins = [line for line in d._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert "start#" in joins[0]
