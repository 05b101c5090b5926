"""Input that is wrong, huge or cut in odd places gives rows, not failed jobs or false equality."""

import pytest

from fragloom.operators import contract as ct, evaluate as ev, fragments as fr, recovery as rc


@pytest.mark.parametrize("text,want", [
    ('{"a":1e999}', None), ("[" * 200_000, None), ("[" * 200_000 + "]" * 200_000, None), ('{"a":"\\ud800"}', None), ('{"a":1,"a":2}', None), ('{"a":NaN}', None), ("", None), (None, None),
    ('{"b":0.0000014,"a":-0.0,"_c":1}', '{"a":0,"b":0.000001}'), ('{"a":[0.00004,1e3,2.50,7.9990001]}', '{"a":[0.00004,1000,2.5,7.999]}'), ('{"a":1e22,"b":{"_k":1}}', '{"a":10000000000000000000000,"b":{"_k":1}}'),
    ('{"a":"\\ue0ff1","b":0.0000014,"\ue0ff":["\ue0ff\\ue0ff",0.00002]}', '{"a":"\ue0ff1","b":0.000001,"\ue0ff":["\ue0ff\ue0ff",0.00002]}'), ('{"\\ue0ff":0.5}', '{"":0.5}'), ('"x"', '"x"'), ("0.00001", "0.00001"),
])
def test_canonical_json(spark, text, want):
    df = spark.createDataFrame([(text,)], "body string")
    assert df.select(ct.canonical_json("body"), ct.stable_json("body")).first()[0] == want


def test_volatile_fields_of_odd_shape(spark):
    rows = [('{"audit":{"provider_calls":7,"runtime_ms":1},"b":1}', '{"audit":{"provider_calls":7},"b":1}'), ('{"audit":{"provider_calls":[1,{"latency_ms":2,"c":3}]}}', '{"audit":{"provider_calls":[1,{"c":3}]}}'), ('{"audit":[1]}', '{"audit":[1]}')]
    got = spark.createDataFrame(rows, "body string, want string").select("want", ct.stable_json("body").alias("got")).collect()
    assert all(r.got == r.want for r in got)


def blocks(spark, data, step):
    rows = [("m", k, bytearray(data[k : k + step])) for k in range(0, len(data), step)]
    return spark.createDataFrame(rows, "media_id string, start long, block binary")


def test_differences_beyond_a_segment(spark):
    data = bytes(range(256)) * 6_016
    bad = data[:1_120_000] + b"\0" * (len(data) - 1_120_000)
    first = next(k for k in range(len(data)) if data[k] != bad[k])
    for step in (1 << 20, 300_001, 1_050_000):
        got = fr.first_diff(blocks(spark, bad, step), blocks(spark, data, 1 << 20)).first()
        assert (got.byte_match, got.is_prefix, got.first_diff) == (False, False, first)
        same = fr.first_diff(blocks(spark, data, step), blocks(spark, data, 1 << 20)).first()
        assert same.byte_match and same.first_diff is None
    short = fr.first_diff(blocks(spark, data[:1_300_000], 300_001), blocks(spark, data, 1 << 20)).first()
    assert (short.byte_match, short.is_prefix, short.first_diff, short.length_delta) == (False, True, 1_300_000, 1_300_000 - len(data))
    hole = blocks(spark, data, 1_000).where("start <> 1200000")
    got = fr.first_diff(hole, blocks(spark, data, 1 << 20)).first()
    assert (got.byte_match, got.is_prefix, got.first_diff) == (False, False, 1_200_000)


def test_long_object_numbers(spark):
    media = spark.createDataFrame([("m", 0, bytearray(b"\n12345678901234567890123 0 obj\n7 0 obj\n"))], "media_id string, base_offset long, content binary")
    got = sorted((r.pos, r.number) for r in rc.marker_hits(media, ["obj"]).collect())
    assert [n for _, n in got] == [None, 7]


def test_labels_outside_the_list(spark):
    df = spark.createDataFrame([("a", "zzz"), ("a", "a"), ("b", "a")], "y string, p string")
    got = {r.true_label: (r.pred_a, r.pred_b, r.pred_other) for r in ev.confusion_matrix(df, "y", "p", ["a", "b"]).collect()}
    assert got["a"] == (1, 0, 1) and got["b"] == (1, 0, 0) and got["zzz"] == (0, 0, 0)


def test_label_named_other(spark):
    df = spark.createDataFrame([("a", "other"), ("a", "x"), ("other", "other")], "t string, p string")
    got = {r.true_label: (r.pred_other, r.pred_a, r.pred_other_) for r in ev.confusion_matrix(df, "t", "p", ["a", "other"]).collect()}
    assert got == {"a": (1, 0, 1), "other": (1, 0, 0), "x": (0, 0, 0)}
