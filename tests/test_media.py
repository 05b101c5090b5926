"""Files in, structural recovery scenarios, damage, tables, sinks and the stream."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from fragloom import streaming
from fragloom.functions import formats as fm, text as tx, tokens as tk
from fragloom.functions.blob import byte_entropy, latin
from fragloom.operators import assemble as asm, chunks as ck, damage, fragments as fr, graph as gr, ml, recovery as rc
from fragloom.plans import catalog
from fragloom.sources import bundles as bd, datasets as dsrc
from fragloom.sources.media import media_files, media_scan, media_write, spans_of, unchanged_media

BLOCK = 256


def padded(body: bytes) -> bytes:
    return body.ljust(BLOCK - 1) + b"\n"


def small_pdf(objects: int = 5) -> bytes:
    """A PDF whose sections fill one 256-byte block each."""
    bodies = [b"%d 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj" % 1] + [b"%d 0 obj\n<< /Type /Pages >>\nendobj" % i for i in range(2, objects + 1)]
    blocks = [padded(b"%PDF-1.4")] + [padded(b) for b in bodies]
    offsets = b"".join(b"%010d 00000 n \n" % (BLOCK * (i + 1)) for i in range(objects))
    blocks.append(padded(b"xref\n0 %d\n0000000000 65535 f \n" % (objects + 1) + offsets))
    blocks.append(padded(b"trailer\n<< /Root 1 0 R >>"))
    blocks.append(padded(b"startxref\n%d" % (BLOCK * (objects + 1))))
    blocks.append(padded(b"%%EOF"))
    return b"".join(blocks)


def media(spark, rows):
    return spark.createDataFrame([(m, 0, bytearray(b)) for m, b in rows], "media_id string, base_offset long, content binary")


@pytest.fixture(scope="module")
def verdicts(spark):
    pdf = small_pdf()
    blocks = [pdf[i : i + BLOCK] for i in range(0, len(pdf), BLOCK)]
    order = [7, 2, 9, 0, 4, 1, 8, 3, 6, 5]
    shuffled = b"".join(blocks[i] for i in order)
    lost = b"".join(blocks[i] for i in order if i not in (8, 9))
    changed = b"".join(blocks[i].replace(b"/Pages >>", b"/Pagex >>") for i in order)
    source = media(spark, [("complete", shuffled), ("missing", lost), ("corrupted", changed)])
    f = tk.profile_blocks(fr.identify(fr.carve_blocks(source)))
    facts = asm.media_facts(f)
    edges = asm.structural_edges(f, facts)
    chain = asm.chain_walk(edges, facts)
    ranges = fr.output_ranges(chain.join(f.select("media_id", "fragment_id", "size_bytes", "block"), ["media_id", "fragment_id"]), ["media_id"])
    segments = fr.reassemble(ranges, ["media_id"])
    chunks = ck.with_sizes(segments.select("media_id", F.col("segment_start").alias("base_offset"), "content"))
    structure = asm.xref_check(chunks, ck.chunk_hits(chunks, asm.STRUCTURE_MARKERS))
    states = asm.recovery_state(facts, chain, f, asm.unresolved_joins(facts), structure)
    original = media(spark, [(m, pdf) for m in ("complete", "missing", "corrupted")])
    diff = fr.first_diff(segments.select("media_id", F.col("segment_start").alias("start"), F.col("content").alias("block")), fr.carve_blocks(original, fr.SEGMENT))
    return {r.media_id: r for r in asm.integrity_verdict(states, diff).collect()}, {r.media_id: r for r in states.collect()}


def test_complete_shuffled_media(verdicts):
    v, s = verdicts[0]["complete"], verdicts[1]["complete"]
    assert (v.status, v.recovery_state, v.byte_match, s.placed) == ("verified", "COMPLETE AND VERIFIED", True, 10)


def test_file_of_several_segments(spark, tmp_path):
    """An intact file beyond the first segment has its table and EOF mark in a later one."""
    long = "\n".join(f"{k} " + "words " * 5_000 for k in range(80))
    spark.createDataFrame([(12, long), (24, "short\ntext")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    state, verdict = ({r.media_id: r for r in catalog.QUERIES[q](spark, str(tmp_path)).collect()} for q in ("recovery_state", "integrity_verdict"))
    assert len(long) > 2 * fr.SEGMENT
    assert {(m, r.recovery_state) for m, r in state.items()} == {("pdf-12", "COMPLETE AND VERIFIED"), ("pdf-24", "COMPLETE AND VERIFIED")}
    assert {r.status for r in verdict.values()} == {"verified"}


def test_no_upper_bounds(spark):
    """Long hex strings and arrays are read whole; a mark beyond the first 1 MiB counts."""
    long = "word " * 700
    coded = "<" + (b"hex " * 300).hex() + "> Tj"
    far = "\x01" * (1 << 20) + "%PDF-1.7 mdat"
    t = spark.createDataFrame([(coded, f"[({long}) 20 (end)] TJ", far)], "coded string, shown string, far string")
    checks = fm.damage_diagnosis(F.col("far"))
    r = t.select(
        rc.text_literals(F.col("coded")).alias("coded"), rc.text_literals(F.col("shown")).alias("shown"), checks["detected_version"].alias("v"), checks["header_offset"].alias("at"),
        fm.surviving_features(F.col("far"))["pdf_version"].alias("kept"),
    ).first()
    assert r.coded == [("hex " * 300).strip()] and r.shown == [long.strip() + " end"]
    assert (r.v, r.at, r.kept) == ("1.7", 1 << 20, "1.7")


def test_missing_fragments(verdicts):
    v, s = verdicts[0]["missing"], verdicts[1]["missing"]
    assert (v.status, v.recovery_state, s.placed) == ("incomplete", "PARTIAL", 8)


def test_corrupted_fragment(verdicts):
    v = verdicts[0]["corrupted"]
    assert (v.status, v.recovery_state) == ("failed", "CORRUPTED")
    assert v.first_mismatch == small_pdf().index(b"/Pages >>") + len(b"/Page")


def test_unterminated_object(spark):
    pdf = b"%PDF-1.4\n1 0 obj\n<< >>\n2 0 obj\n<< >>\nendobj\n1 0 obj\nagain\nendobj\nxref\n"
    m = media(spark, [("m", pdf)])
    hits = rc.marker_hits(m, ("obj", "endobj", "xref", "trailer", "startxref", "eof"))
    got = {r.object_number: (r.start, r.end, r.unterminated, r.confidence) for r in rc.object_rows(m, hits).collect()}
    assert got == {1: (9, pdf.index(b"2 0"), True, 0.85), 2: (pdf.index(b"2 0"), pdf.index(b"endobj") + 6, False, 1.0)}


def test_markers_across_a_chunk_border(spark):
    data = b"x" * 509 + b"%%EOF" + b"y" * 100
    whole = media(spark, [("m", data)])
    want = [(r.marker, r.pos) for r in rc.marker_hits(whole, ("eof",)).collect()]
    assert [(r.marker, r.pos) for r in ck.chunk_hits(ck.cut_media(whole, 512), ("eof",)).collect()] == want == [("eof", 509)]


def test_binary_formats_carve(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"IHDR" + b"IDAT" + b"IEND" + b"crc!"
    jpg = b"\xff\xd8\xff\xe0data\xff\xd9"
    m = media(spark, [("disk", b"junk" + png + b"--" + jpg + b"tail")])
    hits = rc.marker_hits(m, tuple(x for s in rc.SIGNATURES.values() for x in s[:2]))
    got = {(r.format, r.start, r.end, r.filename) for r in rc.carve_artifacts(rc.footer_asof(hits), m).collect()}
    assert got == {("png", 4, 4 + len(png), "carved_00000004.png"), ("jpeg", 6 + len(png), 6 + len(png) + len(jpg), f"carved_{6 + len(png):08x}.jpg")}


def test_format_scores_of_binaries(spark):
    rows = [("a.png", b"\x89PNG\r\n\x1a\nIHDR IDAT IEND"), ("b", b"PK\x03\x04 word/document.xml [Content_Types].xml PK\x05\x06"), ("c", b"0000ftypisom mdat moov")]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "name string, content binary")
    best = df.select("name", fm.best_format(fm.format_scores(latin(F.col("content")), F.col("name"))).alias("b"))
    assert {r.name: r.b.format for r in best.collect()} == {"a.png": "png", "b": "zip", "c": "mp4"}


def test_features_of_binary_block(spark):
    body = bytes(range(256))
    df = spark.createDataFrame([(bytearray(body),), (bytearray(b""),)], "block binary")
    full, empty = tk.byte_features(df).collect()
    assert full.shannon_entropy == 8.0 and full.length == 256.0 and full.null_byte_ratio == 1 / 256 and full.high_byte_ratio == 0.5
    assert full.consecutive_printable_max == 95.0
    assert all(empty[n] == 0.0 for n in tk.FEATURES)


def test_entropy_edges(spark):
    df = spark.createDataFrame([(bytearray(b""),), (bytearray(b"aaaa"),), (None,)], "b binary")
    assert [r[0] for r in df.select(byte_entropy("b")).collect()] == [0.0, 0.0, None]


def test_text_literals(spark):
    t = "(Hello) Tj <48692021> Tj [(A) -20 (B)] TJ (Hello) Tj"
    r = spark.createDataFrame([(t,), ("no operators (just words here) (obj 1)",)], "t string").select(rc.text_literals(F.col("t")).alias("x")).collect()
    assert [x.x for x in r] == [["Hello", "Hi !", "A B"], ["just words here"]]


def test_recipes_change_what_they_say(spark):
    pdf = small_pdf()
    m = media(spark, [("m", pdf)])
    run = lambda name: bytes(damage.damage_recipe(m, name).first().content)
    assert run("unterminated_objects").count(b"endobj") == 3
    assert run("online_scramble")[:32] == pdf[:32] and len(run("online_scramble")) == len(pdf) and run("online_scramble") != pdf
    assert run("online_scramble") == run("online_scramble")
    assert run("destroyed_xref_trailer").endswith(b"endobj")
    assert b"Cata_og" in run("orphan_pages")


def test_severity_levels(spark):
    pdf = small_pdf() + b"stream\n" + b"payload" * 20 + b"\nendstream /Length 140 (text) Tj"
    m = media(spark, [(f"m{i}", pdf) for i in range(6)])
    for level, operations in ((0, 0), (1, 1), (2, 2), (3, 4), (4, 5)):
        rows = damage.damage_by_severity(m, level, 42).collect()
        assert len(rows) == 6 and all(len(r.operations) == operations for r in rows)


def test_table_and_wrap(spark):
    text = "Table 1: Prices\nname | price\napple | 3\npear |  | x"
    r = spark.createDataFrame([(text,)], "t string").select(tx.rebuild_table(F.col("t")).alias("x"), tx.wrap_text(F.lit("aa bbb cccc d"), 6).alias("w")).first()
    assert (r.x.caption, r.x.n_rows, r.x.n_cols, r.x.empty_cells) == ("Table 1: Prices", 3, 3, 3)
    assert r.w == ["aa bbb", "cccc d"]


def test_media_scan_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    pdf = small_pdf()
    (folder / "a.bin").write_bytes(pdf)
    (folder / "empty.bin").write_bytes(b"")
    scan = media_files(spark, str(folder))
    rows = {r.media_id.rsplit("/", 1)[1]: r for r in scan.collect()}
    assert rows["a.bin"].sha256 == hashlib.sha256(pdf).hexdigest() and not rows["a.bin"].warnings
    assert unchanged_media(scan, media_files(spark, str(folder))).where("not unchanged").count() == 0
    q = streaming.fragment_stream(spark, str(folder)).writeStream.format("memory").queryName("frags").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("frags").count() == len(pdf) // BLOCK


def test_dataset_sinks(spark, tmp_path):
    s = spark.createDataFrame([("s1", "d1", "train", bytearray(b"a"), bytearray(b"b")), ("s2", "d2", "test", bytearray(b"c"), bytearray(b"d"))], "sample_id string, doc_id string, split string, original binary, damaged binary")
    dsrc.dataset_export(s, str(tmp_path / "export"))
    assert dsrc.dataset_load(spark, str(tmp_path / "export/samples")).count() == 2
    assert {r.sample_id for r in dsrc.index_read(spark, str(tmp_path / "export/index")).collect()} == {"s1", "s2"}
    leaky = s.unionByName(s.where("split = 'train'").withColumn("split", F.lit("test")))
    dsrc.dataset_save(leaky, str(tmp_path / "leaky"))
    with pytest.raises(ValueError):
        dsrc.dataset_load(spark, str(tmp_path / "leaky"))
    root = tmp_path / "manifests"
    (root / "s1").mkdir(parents=True)
    (root / "s1/manifest.json").write_text(json.dumps({"sample_id": "s1", "seed": 7}))
    (root / "manifest_bad.json").write_text("{nope")
    good, bad = dsrc.manifest_read(spark, str(root))
    assert [r.sample_id for r in good.collect()] == ["s1"] and bad.count() == 1
    bd.write_text(good, F.to_json(F.struct("sample_id")), str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).first().value == '{"sample_id":"s1"}'


def test_model_round_trip(spark, tmp_path):
    rows = [(float(i % 2), float(i), "even" if i % 2 == 0 else "odd") for i in range(40)]
    df = spark.createDataFrame(rows, "x double, y double, label string")
    model = ml.rf_train(df, trees=5, depth=3, features=["x", "y"])
    path = str(tmp_path / "package")
    ml.model_save(model, path, ["x", "y"], {"trees": 5})
    again, features, about = ml.model_load(spark, path)
    assert features == ["x", "y"] and about["trees"] == 5 and sorted(about["labels"]) == ["even", "odd"]
    got = ml.rf_predict(again, df).select("label", "prediction.label").toDF("y", "p").where("y = p").count()
    assert got == 40
    assert ml.feature_importance(again, spark, ["x", "y"]).first().feature == "x"
    assert ml.load_or_none(spark, path, ["x", "y"]) is not None
    assert ml.load_or_none(spark, path, ["y", "x"]) is None  # another feature list
    assert ml.load_or_none(spark, str(tmp_path / "none")) is None
    changed = next(p for p in (tmp_path / "package/features").glob("part-*"))
    (changed.parent / f".{changed.name}.crc").unlink(missing_ok=True)
    changed.write_text(changed.read_text().replace('"x"', '"z"'))
    with pytest.raises(ml.ModelPackageError, match="not as the manifest says"):
        ml.model_load(spark, path)
    (tmp_path / "half").mkdir()
    model.write().save(str(tmp_path / "half/model"))
    with pytest.raises(ml.ModelPackageError, match="no whole package"):
        ml.model_load(spark, str(tmp_path / "half"))


def test_long_chain(spark):
    """A chain of 500 nodes is whole; a given bound still holds."""
    nodes = spark.createDataFrame([("m", f"n{i:03d}", i == 0, False, i) for i in range(500)], "media_id string, id string, is_header boolean, is_footer boolean, seq long")
    edges = spark.createDataFrame([("m", f"n{i:03d}", f"n{i + 1:03d}", 0.9) for i in range(499)], "media_id string, from_id string, to_id string, affinity double")
    for chain in (gr.candidate_chains(nodes, edges), gr.best_chain(nodes, edges)):
        assert [r.id for r in chain.orderBy("position").collect()] == [f"n{i:03d}" for i in range(500)]
    assert gr.best_chain(nodes, edges, 100).count() == 100


def test_last_occurrences_without_a_walk(spark):
    import re

    entry = "0000000017 00000 n \n"
    texts = ["", "xref", "a xref b startxref 9", f"xref\n0 1\n{entry}{entry}startxref\n5", f"xref {entry} xref {entry} trailer trailer xref", f"{entry} xref none", "xrefxref" + entry]
    media = spark.createDataFrame([(str(i), bytearray(x.encode())) for i, x in enumerate(texts)], "media_id string, content binary")
    for name in ("damage_xref", "damage_startxref", "damage_trailer", "damage_object_offsets"):
        assert name == "damage_object_offsets" or re.fullmatch(damage._LAST, damage.PATTERNS[name][0])
        got = {int(r.media_id): r.operation and (r.operation.offset_start, r.operation.offset_end) for r in damage.damage_pattern(media, name).collect()}
        want = {i: m and m.span(2) for i, x in enumerate(texts) for m in [re.search(damage.PATTERNS[name][0], x)]}
        assert got == want, name
