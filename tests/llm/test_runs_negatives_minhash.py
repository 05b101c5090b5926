"""Periodic runs, hard negatives and MinHash near copies against brute force, with nulls, repeated rows and clashing names."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import EDGE, SF, docs, table

from fragloom.llm import hardneg, minhash, queries, runs
from fragloom.llm.common import crc32_of_id


def all_runs(t):
    """(start, length, period) by trying every period at every place."""
    n, out, seen = len(t), [], []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and t[j] == t[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and not any(q % p == 0 and a <= s and e <= b for a, b, p in seen):
                seen.append((s, e, q))
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_on_random_sequences():
    r = random.Random(1)
    for _ in range(3_000):
        n = r.choice([5, 8, 20, 60, 150])
        t = [r.randrange(r.choice([1, 2, 3, 5, 20])) for _ in range(n)]
        for _ in range(r.randrange(4)):
            a = r.randrange(n)
            p = 1 + r.randrange(max(1, (n - a) // r.choice([2, 4, 5, 7])))
            for i in range(a, min(n, a + p * r.choice([3, 4, 5, 9]))):
                t[i] = t[a + (i - a) % p]
        assert runs.runs_of(runs.word_ids([b"%d" % x for x in t])) == all_runs(t), t


def test_grammar_gives_the_text():
    r = random.Random(2)
    for _ in range(300):
        t = runs.word_ids([b"%d" % r.randrange(3) for _ in range(r.choice([1, 2, 7, 90]))])
        rules, start, at = runs.re_pair(t)
        expand = lambda s: [s] if s <= max(t) else expand(rules[s - max(t) - 1][0]) + expand(rules[s - max(t) - 1][1])
        whole = [expand(s) for s in start]
        assert sum(whole, []) == t
        assert at == [sum(map(len, whole[:k])) for k in range(len(whole))]
        last = {}
        for k, pair in enumerate(zip(start, start[1:])):  # no pair is left to replace
            assert k - last.setdefault(pair, k) < 2, start


def test_long_periodic_texts():
    assert runs.runs_of([0] * 60_000) == [(0, 60_000, 1)]
    assert runs.runs_of([i % 97 for i in range(60_000)]) == [(0, 60_000, 97)]


def test_runs_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for r in rows:
        w = (r.text or "").encode().split()
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = all_runs(w) if n < 900 else runs.runs_of(runs.word_ids(w))
        top = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        want.add((
            r.doc_id, n, len(found), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4),
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest(),
        ))
    got = queries.QUERIES["op11_runs"](spark, SF)
    assert dict(got.dtypes) | {"doc_id": "bigint"} == dict.fromkeys(("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli"), "bigint") | dict.fromkeys(("runs_sha256", "collapsed_sha256"), "string")
    assert {tuple(r) for r in got.collect()} == want
    assert sum(r[2] > 0 for r in want) > 30


def negatives(rows, every=100, scale=256):
    """Rows (id, label, vector) by the definition; a row is told by its place."""
    ok = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, lab, v) in enumerate(ok):
        if i % every:
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), j, m, at) for at, (j, m, w) in enumerate(ok) if at != k]
        for s, j, m, _ in sorted(x for x in score if x[2] == lab)[:5]:
            hard = sorted(x for x in score if x[2] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out.extend((i, j, rank, x[1], -s, -x[0]) for rank, x in enumerate(hard, 1))
    return sorted(out)


def test_hard_negatives(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), int(r.integers(0, 4)), [float(np.float32(x)) for x in r.normal(size=13) * 3]) for i in range(700)]
    rows += [(100, 1, rows[7][2]), (100, 1, rows[7][2]), (100, 2, rows[7][2]), (5, None, [1.0]), (200, 1, None), (None, 1, [1.0] * 13), (300, 1, [1.0, None]), (400, 1, [float("nan")]), (6, 1, [float("inf")])]
    rows += [(500, 3, []), (800, 2, [1.0, 2.0, 3.0]), (900, 0, [-1e4] * 13), (901, 1, [0.0] * 20)] + [(1000 + i, i % 2, [2.0] * 13) for i in range(60)]
    df = spark.createDataFrame([(*x, 7, 7.0, "x") for x in rows], "vec_id long, label int, embedding array<float>, id long, score double, `a.b` string")
    got = hardneg.hard_negatives(df.repartition(5))
    assert sorted(map(tuple, got.collect())) == negatives(rows)
    assert dict(got.dtypes)["rank"] == "int"
    assert hardneg.hard_negatives(df.limit(0)).count() == 0
    assert hardneg.hard_negatives(df.where("vec_id = 1")).count() == 0


def test_anchor_copies_are_not_broadcast(spark):
    """The copies of the anchors, one for each bucket, never meet in the driver, whatever Spark estimates (F2)."""
    rows = spark.range(0, 400).select("id", (F.col("id") % 3).alias("label"), F.array(*[(F.col("id") % k).cast("double") for k in range(2, 10)]).alias("vector"))
    blocks = hardneg.packed(rows, 256.0)
    anchors = hardneg.anchor_blocks(hardneg.anchor_rows(blocks, 10), 0)
    found = hardneg.best_per_anchor(blocks, anchors, 4, 5, 0, 80, 100)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert anchors.selectExpr("sum(length(vectors)) AS n").first().n == 40 * 8 * 2  # components of up to 2,304 take two bytes


def test_scores_beyond_long(spark):
    df = spark.createDataFrame([(0, 1, [1e12, 1e12]), (1, 1, [1e12, 1e12])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="fit a long"):
        hardneg.hard_negatives(df).collect()


def test_subset_tables():
    r = np.random.default_rng(4)
    for dims in (0, 1, 8, 13, 64):
        a, c = r.integers(-300, 300, (7, dims)), r.integers(-5000, 5000, (9, dims))
        bits, planes = hardneg.plane_bytes(c)
        for kind in ("i4", "i8"):
            assert (hardneg.scores(hardneg.subset_sums(a, kind), bits) == c @ a.T).all()


def sets_of(text, size):
    w = (text or "").encode("utf-8", "surrogatepass").translate(minhash.LOWER).split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def linked(rows, size, percent):
    """(id, set size, component) by all pairs."""
    sets = [sets_of(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[root(i)] = min(k, low.get(root(i), k))
    return sorted(((k, len(s), low.get(root(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("crowd", [3, 64])
def test_minhash(spark, monkeypatch, crowd):
    monkeypatch.setattr(minhash, "CROWD", crowd)  # buckets count as large from here on
    r = random.Random(8)
    rows = []
    for c in range(25):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([6, 12, 40, 150]))]
        for _ in range(r.choice([1, 3, 12])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                own[r.randrange(len(own))] = "x%d" % r.randrange(50)
            rows.append(" ".join(own[r.choice([0, 0, 0, 1, 3]) :]))
    rows += ["  ", "", None, "a", "A", "b c", "one two three four five"]
    r.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)]
    got = minhash.near_copies(docs(spark, [t for _, t in rows])).collect()
    assert sorted((tuple(x)[:3] for x in got), key=str) == linked(rows, 5, 85)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)
    if crowd == 3:
        got = minhash.near_copies(docs(spark, [t for _, t in rows]), size=3, percent=60).collect()
        assert sorted((tuple(x)[:3] for x in got), key=str) == linked(rows, 3, 60)


def test_minhash_variants(spark, monkeypatch):
    """Variants of one text, most of them less similar than the threshold: few pairs are left after the leaders."""
    monkeypatch.setattr(minhash, "CROWD", 16)
    staged, kept = minhash.staged, {}

    def keep(df, name):
        kept[name] = staged(df, name)
        return kept[name]

    monkeypatch.setattr(minhash, "staged", keep)
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        own = list(base)
        for _ in range(r.choice([1, 2, 2, 3])):
            own[r.randrange(len(own))] = "x%d" % r.randrange(2_000)
        rows.append((i, " ".join(own)))
    got = minhash.near_copies(docs(spark, [t for _, t in rows])).collect()
    assert sorted((tuple(x)[:3] for x in got), key=str) == linked(rows, 5, 85)
    assert kept["rest"].count() <= 10 * len(rows)  # 3,251 pairs; 43,501 without second leaders


def test_minhash_chain(spark):
    """A chain of links reaches its far end, whatever their number."""
    words = [f"w{i}" for i in range(1_000)]
    rows = [" ".join(words[10 * i : 10 * i + 200]) for i in range(80)]
    assert {x.component_id for x in minhash.near_copies(docs(spark, rows)).collect()} == {0}


def test_minhash_bounds():
    for percent in (80, 85, 95):
        bands = minhash.band_count(percent)
        assert (1 - (percent / 100) ** minhash.ROWS) ** bands <= minhash.MISS
        n, p = bands * minhash.ROWS, (1 - percent / 100) * 15 / 16
        k = minhash.most_different(percent, n)
        assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1, n + 1)) <= minhash.MISS
    assert minhash.most_different(100, 160) == 0 and minhash.band_count(100) == 1


def test_sketches():
    r = np.random.default_rng(7)
    sig = r.integers(0, 1 << 32, (5, 35), "u4")
    words = minhash.sketches(sig)
    assert words.shape == (5, 3)
    assert all(int(words[i, k // 16]) >> 4 * (k % 16) & 15 == int(sig[i, k]) & 15 for i in range(5) for k in range(35))


def test_minima_by_tiles():
    r = np.random.default_rng(9)
    sets = [r.integers(0, 1 << 64, n, "u8") for n in (1, 70_000, 5, 32_768, 3)]
    f, s = minhash.functions(10)
    want = [[int((x * a + b).min() >> np.uint64(32)) for a, b in zip(f, s)] for x in sets]
    assert minhash.minima(sets, f, s).tolist() == want


@pytest.mark.parametrize("name", ["runs", "minhash"])
def test_edges(spark, name):
    op = {"runs": runs.periodic_runs, "minhash": minhash.near_copies}[name]
    out = op(table(spark, EDGE)).collect()
    assert len(out) == len(EDGE) and op(table(spark, [])).count() == 0
    if name == "runs":
        long = next(r for r in out if r.n_words == 60_000)
        assert [tuple(x) for x in long.runs] == [(0, 60_000, 1)] and long.collapsed == "x"
        assert all(r.collapsed == "" for r in out if not r.n_words)
    else:
        assert sum(r.component_id is None for r in out) == 2  # both rows with a null id stand alone


def test_planted_null_id(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, None), (5, "")], "doc_id long, text string")
    assert [r[0] for r in df.select(runs.planted(F.col("text"), F.col("doc_id"))).collect()][0] == "a b c"
    assert crc32_of_id(4) == zlib.crc32(b"4")
