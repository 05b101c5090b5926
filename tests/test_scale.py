"""The skew-proof helpers against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from fragloom.functions import text as tx
from fragloom.functions.blob import byte_entropy
from fragloom.operators import assemble as asm, fragments as fr, links as lk, scale
from fragloom.operators.recovery import asof_next
from fragloom.operators.truth import later_count


def test_running_total_and_rank(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randint(0, 9)) for k in "ab" for i in rng.sample(range(200000), 300)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = scale.running_total(df, ["k"], [F.col("i")], F.floor(F.col("i") / 16), F.col("v"), "t", levels=1)
    got = scale.running_rank(got, ["k"], [F.col("i")], F.floor(F.col("i") / 16), "r")
    want = {}
    for k in "ab":
        total = 0
        for n, (_, i, v) in enumerate(sorted(r for r in rows if r[0] == k), 1):
            total += v
            want[k, i] = (total, n)
    assert {(r.k, r.i): (r.t, r.r) for r in got.collect()} == want


def test_merge_ranges(spark):
    rng = random.Random(2)
    blocks = sorted({rng.randint(0, 4000) for _ in range(3000)})
    df = spark.createDataFrame([("m", b * 4, b * 4 + 4) for b in blocks], "media_id string, start long, end long")
    got = scale.merge_ranges(df, ["media_id"], "start", "end", width=64)
    want = []
    for b in blocks:
        if want and want[-1][1] == b * 4:
            want[-1][1] = b * 4 + 4
        else:
            want.append([b * 4, b * 4 + 4])
    assert sorted([r.start, r.end] for r in got.collect()) == want


def test_previous_row(spark):
    rows = [("k", i * 7 % 101, i) for i in range(101)]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    got = scale.with_previous(df, ["k"], ["s", "e"], F.floor(F.col("s") / 10), "_p")
    order = sorted((s, e) for _, s, e in rows)
    want = {b: a for a, b in zip(order, order[1:])}
    assert {(r.s, r.e): (tuple(r._p) if r._p else None) for r in got.collect()} == {**want, order[0]: None}


@pytest.mark.parametrize("leaf", [4, 64])
def test_later_smallest_and_count(spark, leaf):
    rng = random.Random(3)
    left = [("m", rng.choice("xy"), f"a{i}", rng.randint(0, 500)) for i in range(80)]
    right = [("m", rng.choice("xy"), f"b{i:03d}", rng.randint(0, 500)) for i in range(120)]
    a = spark.createDataFrame(left, "media_id string, k string, from_id string, _e long")
    b = spark.createDataFrame(right, "media_id string, k string, to_id string, _s long")
    got = {}
    for r in lk.later_smallest(a, b, 3, ["media_id", "k"], leaf).collect():
        got.setdefault(r.from_id, []).append(r.to_id)
    want, counts = {}, {}
    for _, k, f, e in left:
        later = sorted(t for _, k2, t, s in right if k2 == k and s > e)
        if later:
            want[f], counts[f] = later[:3], len(later)
    assert {f: sorted(v) for f, v in got.items()} == want
    assert {r.from_id: r.later for r in later_count(a, b, ["media_id", "k"], leaf).collect()} == counts


def test_asof_next(spark):
    rng = random.Random(4)
    left, right = rng.sample(range(1000), 60), rng.sample(range(1000), 40)
    a = spark.createDataFrame([("m", x) for x in left], "media_id string, l long")
    b = spark.createDataFrame([("m", x) for x in right], "media_id string, r long")
    got = {r.l: r.hit for r in asof_next(a, b, ["media_id"], "l", "r", "hit", width=50).collect()}
    assert got == {x: min((y for y in right if y >= x), default=None) for x in left}


def test_merge_any_ranges(spark):
    """Ranges may overlap, nest, repeat and cross bucket borders."""
    rng = random.Random(12)
    rows = [(k, a, a + rng.choice([1, 3, 40, 900, 30_000])) for k in "ab" for a in rng.sample(range(400_000), 400)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    want = []
    for k, a, b in sorted(rows):
        if want and want[-1][0] == k and want[-1][2] >= a:
            want[-1][2] = max(want[-1][2], b)
        else:
            want.append([k, a, b])
    for width in (16, 1 << 10, 1 << 20):
        assert sorted(list(r) for r in scale.merge_ranges(df, ["k"], "s", "e", width).collect()) == want


def test_erased_regions_of_odd_blocks(spark):
    """3 MiB of zeros in blocks of 1,000 bytes are one region, also beside others."""
    data = b"x" * 1_000 + bytes(3 << 20) + b"y" * 424 + bytes(2_000) + b"z"
    df = spark.createDataFrame([("m", 0, bytearray(data))], "media_id string, base_offset long, content binary")
    got = [(r.start, r.end) for r in fr.erased_regions(fr.carve_blocks(df, 1_000)).orderBy("start").collect()]
    size = 3 << 20
    assert got == [(1_000, (1_000 + size) // 1_000 * 1_000), (-(-(1_424 + size) // 1_000) * 1_000, (3_424 + size) // 1_000 * 1_000)]


@pytest.mark.parametrize("ids", ["dense", "sparse", "hashed"])
def test_global_rank(spark, ids):
    rng = random.Random(13)
    values = {"dense": range(3_000), "sparse": [i * 10**14 for i in range(3_000)], "hashed": [rng.randrange(-(1 << 62), 1 << 62) for _ in range(3_000)]}[ids]
    df = spark.createDataFrame([(v, v % 3) for v in values], "v long, k long")
    want = {v: r for r, v in enumerate(sorted(values), 1)}
    ranked = scale.global_rank(df, "v", "r", parts=8)
    assert {r.v: r.r for r in ranked.collect()} == want
    parts = {}
    for v in sorted(values):
        parts.setdefault(v % 3, []).append(v)
    got = scale.global_rank(df, "v", "r", ["k"], parts=8).collect()
    assert {r.v: r.r for r in got} == {v: r for own in parts.values() for r, v in enumerate(own, 1)}
    counts = [r.n for r in df.groupBy(scale.even_bucket(df, "v", 8)).agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 8 and max(counts) < 600  # no bucket is near all rows


def test_numbers_missing_as_ranges(spark):
    rows = [("m", "object", 1), ("m", "object", 9 * 10**18), ("n", "object", 4), ("n", "object", 5), ("n", "object", 5), ("n", "object", 7), ("n", "xref", None)]
    got = asm.numbers_missing(spark.createDataFrame(rows, "media_id string, kind string, object_number long")).collect()
    assert {tuple(r) for r in got} == {("m", 2, 9 * 10**18 - 1), ("n", 6, 6)}


def test_wrap_text(spark):
    import textwrap

    rng = random.Random(14)
    texts = [" ".join("w" * rng.choice([1, 2, 5, 9, 30]) for _ in range(rng.choice([0, 1, 5, 200]))) for _ in range(60)] + ["\t a\n\nb  ", "é😀 " * 40, "x" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for width in (1, 6, 20, 80):
        got = df.select("i", tx.wrap_text(F.col("t"), width).alias("w")).collect()
        assert {r.i: r.w for r in got} == {i: textwrap.wrap(" ".join(t.split()), width, break_long_words=False, break_on_hyphens=False) for i, t in enumerate(texts)}


def test_blocks_take_no_content_to_python(spark):
    media = spark.createDataFrame([("m", bytearray(b"abc" * 300))], "media_id string, content binary")
    blocks = fr.carve_blocks(media, 256)
    got = blocks.select("media_id", "start", "end", byte_entropy(F.col("block")).alias("e"))
    node = got._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "ArrowEvalPython":
        node = node.children().head()
    names = {node.output().apply(i).name() for i in range(node.output().size())}
    assert "media_id" in names and "content" not in names
    assert [(r.start, r.end, bytes(r.block)) for r in blocks.orderBy("start").collect()] == [
        (s, min(s + 256, 900), (b"abc" * 300)[s : s + 256]) for s in range(0, 900, 256)
    ]


@pytest.mark.parametrize("few", [0, 3, 64])
def test_later_smallest_by_class(spark, few):
    rng = random.Random(7)
    right = [(f"k{rng.randint(0, 5)}", rng.randint(0, 2), f"t{i:04d}", rng.randint(0, 9000)) for i in range(300)] + [("rare", 1, "x", 8000)]
    left = [(rng.choice(["k0", "k1", "k2", "rare", "none"]), f"f{i}", rng.randint(0, 9000), rng.sample([0, 1, 2, 7], 2)) for i in range(60)]
    a = spark.createDataFrame(left, "_k string, from_id string, _e long, _cs array<int>")
    b = spark.createDataFrame(right, "_k string, _c int, to_id string, _s long")
    got = lk.later_smallest(a, b, 3, ["_k"], leaf=32, classes=True, few=few).collect()
    want = set()
    for key, x, e, cs in left:
        for c in cs:
            want |= {(key, c, x, to) for to in sorted(r[2] for r in right if r[0] == key and r[1] == c and r[3] > e)[:3]}
    assert sorted((r._k, r._c, r.from_id, r.to_id) for r in got) == sorted(want)
