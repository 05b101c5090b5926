"""Every stage of the pipeline against a plain version, on its own input; the registered queries on the small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from fragloom.llm import quality, queries
from fragloom.llm.common import crc32_fold, scratch, tokenizer_path
from test_operators import bench_overlaps, groups_of, without_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Inputs and outputs of the stages."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = scratch(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for docs, out in stages[:-1]:
        assert out.columns == docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(spark, stages):
    docs, out = stages[0]
    model = quality.fit(docs.where(crc32_fold("doc_id", 5) != 0), spark.read.parquet(f"{SF}/labels.parquet"))
    before = rows(docs)
    scores = quality.vote(np.stack([quality.features(r.text) for r in before.values()]), model)
    assert rows(out) == {i: r for (i, r), s in zip(before.items(), scores) if s >= 0.3}


def test_lines(stages):
    docs, out = map(rows, stages[1])
    want = without_repeats((i, r.text) for i, r in docs.items() if r.text is not None)
    assert {i: r.text for i, r in out.items() if r.text is not None} == want
    assert all(r.n_chars == len(r.text or "") for r in out.values() if r.text is not None)


def test_near(stages):
    docs, out = map(rows, stages[2])
    ids = sorted(docs)
    roots = {ids[root] for _, root in groups_of([docs[i].text for i in ids], 5, 80)}
    assert out == {i: docs[i] for i in roots}


def test_benchmark(spark, stages):
    docs, out = map(rows, stages[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert out == {i: r for i, r in docs.items() if not bench_overlaps(r.text, items)}


def test_coding(stages):
    docs, out = map(rows, stages[4])
    model = Tokenizer.from_file(tokenizer_path())
    assert set(out) == set(docs)
    for i, r in out.items():
        assert r.ids == model.encode(docs[i].text or "", add_special_tokens=False).ids
        assert r.decoded == model.decode(r.ids, skip_special_tokens=False) and r.n_tokens == len(r.ids)


ODD = "doc_id long, text string, lang string, source string, n_chars int, n_removed long, item string, contaminated boolean, score double, n_lines long, _id long, _text string, `a.b` string, `c d` string"


def odd_rows():
    text = "One plain line of words that nobody else has written here before.\nAnother line follows it and says a little more than the first.\n" * 3
    texts = [(1, text), (1, text), (None, text + "with an end of its own"), (2, None), (3, ""), (4, " \n\t"), (None, None), (5, "x " * 9_000)]
    return [(i, t, "en", None, 7, 70 + k, f"item{k}", True, 0.5, 5, 6, "x", f"ab{k}", None) for k, (i, t) in enumerate(texts)]


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stage_on_odd_rows(spark, name, stage):
    """Null and repeated ids, null and empty texts, columns named like the operators' own or with a dot: kept as they are."""
    docs = spark.createDataFrame(odd_rows(), ODD)
    out = stage(spark, docs, SF)
    assert stage(spark, docs.limit(0), SF).count() == 0
    got = out.collect()
    if name == "bpe":
        assert len(got) == 8 and all(r.decoded == "" for r in got if not r.n_tokens)
        return
    assert out.columns == docs.columns
    kept = {(r.n_removed, r.item, r["a.b"], r.contaminated, r.score) for r in got}
    every = {(70 + k, f"item{k}", f"ab{k}", True, 0.5) for k in range(8)}
    assert kept <= every
    if name in ("line_dedup", "decontamination"):
        assert kept == every and len(got) == 8


def test_labelled_rows_are_bounded(spark):
    """An id on many rows does not pass the bound."""
    docs = spark.range(3_000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).unionByName(spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text").alias("text")))
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (7, 0)], "doc_id long, quality int")
    got = quality.labelled_sample(docs, labels, "doc_id", "text", "quality", 40).collect()
    assert len(got) == 80 and len({(r._id, r._text) for r in got}) == 80


def test_every_operator_has_a_query(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_line_dedup_oracle():
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert con.sql(queries.ORACLES["op1_line_dedup"]).fetchall()
