"""Media in chunks: the same hits, ranges, regions and verdicts for every cut, and files by byte range."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fragloom.operators import assemble as asm, chunks as ck, fragments as fr, recovery as rc
from fragloom.sources.media import media_files, media_scan, media_write, spans_of

NAMES = tuple(ck.SHAPES)
BITS = [
    b"12", b" ", b"\n", b"0", b"obj", b"endobj", b"xref", b"startxref", b"stream", b"end", b"%%EOF", b"%PDF-1.4", b"x", b"_", b"trailer", b"0000000016 00000 n \n",
    b"0000000016", b"/Root 1 0 R", b"/Type /Catalog", b"/Pages 2 0 R", b"/Kids [4 0 R", b"]", b"R", b"PK\x03\x04", b"\xff", b"\xd8", b"1 0 obj", b"xref\n0 3\n", b"9" * 25, b"\r\n",
]


def table(spark, rows):
    return spark.createDataFrame([(m, 0, bytearray(b)) for m, b in rows], "media_id string, base_offset long, content binary")


def chunked(spark, rows, cuts):
    """Chunk rows of every medium cut at ``cuts``, in no order."""
    out = []
    for m, data in rows:
        edges = sorted({0, len(data), *(c for c in cuts if c < len(data))})
        out.extend((m, a, len(data), bytearray(data[a:b])) for a, b in zip(edges, edges[1:]))
    random.Random(4).shuffle(out)
    return spark.createDataFrame(out, "media_id string, base_offset long, size_bytes long, content binary").repartition(3)


def test_hits_for_any_cut(spark):
    r = random.Random(3)
    rows = [(f"m{i}", b"".join(r.choice(BITS) for _ in range(r.choice([1, 3, 8, 40])))) for i in range(300)]
    want = sorted(map(str, rc.marker_hits(table(spark, rows), NAMES).collect()))
    assert len(want) > 2_000
    for cuts in (range(1, 2_000), range(0, 2_000, 3), range(0, 2_000, 16), [r.randrange(400) for _ in range(9)], []):
        assert sorted(map(str, ck.chunk_hits(chunked(spark, rows, cuts), NAMES).collect())) == want


def test_hits_in_long_runs(spark):
    """Chunks that hold nothing but digits or white space are part of one border."""
    data = b"7" * 900 + b" " * 900 + b"0" + b"\n" * 900 + b"obj stream" + b"\n" * 900 + b"x 5 0 obj"
    got = ck.chunk_hits(chunked(spark, [("m", data)], range(0, len(data), 64)), NAMES).collect()
    assert sorted(map(str, got)) == sorted(map(str, rc.marker_hits(table(spark, [("m", data)]), NAMES).collect()))
    assert {(x.pos, x.end) for x in got if x.marker == "obj"} == {(0, 2_704), (len(data) - 7, len(data))}


def test_byte_ranges(spark):
    r = random.Random(5)
    data = bytes(r.randrange(256) for _ in range(5_000))
    wanted = [(i, *sorted((r.randrange(5_200), r.randrange(5_200)))) for i in range(60)]
    ranges = spark.createDataFrame([("m", *w) for w in wanted], "media_id string, k long, start long, end long")
    for cuts in ([], range(0, 5_000, 7), range(0, 5_000, 512)):
        got = ck.byte_ranges(chunked(spark, [("m", data)], cuts), ranges, ["k"], width=256)
        assert {x.k: bytes(x.bytes) for x in got.collect()} == {k: data[a:b] for k, a, b in wanted if a < min(b, 5_000)}


def pdf(objects, break_last=False):
    """A PDF of some objects; with ``break_last`` the last object does not stand where the table says."""
    out, places = b"%PDF-1.4\n", []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k + (break_last and k == len(objects)), body)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at)


CATALOG = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 9 0 R] >>"]


def test_structure_for_any_cut(spark):
    good = pdf([*CATALOG, b"<< /Type /Page /Contents 7 0 R >>"])
    entry = b"0000000009 00000 n"
    rows = [
        ("good", good), ("moved", pdf([*CATALOG, b"x"], True)), ("headless", good[1:]), ("cut", good[:-7]), ("tail", good + b"  \r\n"), ("more", good + b"x"),
        ("count", good.replace(b"0 4\n", b"0 5\n")), ("entry", good.replace(entry, b"000000009 00000 n")), ("shape", good.replace(b"xref\n0 4", b"xref\n0 x")), ("out", good.replace(b"startxref\n", b"startxref\n99")),
        ("at", good.replace(b"startxref\n1", b"startxref\n2")), ("none", good.replace(b"startxref", b"start")), ("root", good.replace(b"/Root 1", b"/Root 8")), ("pages", good.replace(b"/Pages 2", b"/Pages 8")),
        ("closed", good.replace(b"/Catalog /Pages 8", b"/Catalog > /Pages 8").replace(b"/Catalog /Pages 2", b"/Catalog>/Pages 8")), ("inside", good.replace(entry, b"0000000010 00000 n")),
    ]
    want = {
        "good": "", "moved": "object_not_at_offset", "headless": "header_missing,no_xref_at_offset", "cut": "eof_missing", "tail": "", "more": "eof_missing", "count": "entry_malformed",
        "entry": "entry_malformed,root_undefined", "shape": "subsection_malformed", "out": "startxref_out_of_bounds", "at": "no_xref_at_offset", "none": "startxref_missing", "root": "root_undefined", "pages": "pages_undefined",
        "closed": "object_not_at_offset", "inside": "object_not_at_offset",
    }
    for cuts in (range(0, 900, 5), range(0, 900, 64), []):
        c = chunked(spark, rows, cuts)
        got = {x.media_id: ",".join(x.errors) for x in asm.xref_check(c, ck.chunk_hits(c, asm.STRUCTURE_MARKERS)).collect()}
        moved = {m: got[m] for m in want if m not in ("closed", "entry")}
        assert moved == {m: want[m] for m in moved}
        assert "pages_undefined" not in got["closed"] and "entry_malformed" in got["entry"]


@pytest.fixture(scope="module")
def large(spark):
    """Media beyond 3 MiB; the damage of all but the first is in the last chunks."""
    body = b"<< /Length 5 >>\nstream\n" + b"BT (word) Tj ET " * 4_000 + b"\nendstream"
    objects = [*CATALOG, *[body] * 55]
    whole = pdf(objects)
    assert len(whole) > 3 << 20
    return whole, pdf(objects, True), whole[:-6]


def test_large_structure(spark, large):
    whole, moved, cut = large
    c = ck.cut_media(table(spark, [("whole", whole), ("moved", moved), ("cut", cut)]), 1 << 18)
    got = {x.media_id: (x.entries, list(x.errors)) for x in asm.xref_check(c, ck.chunk_hits(c, asm.STRUCTURE_MARKERS)).collect()}
    assert got == {"whole": (57, []), "moved": (57, ["object_not_at_offset"]), "cut": (57, ["eof_missing"])}


def test_objects_and_regions_for_any_cut(spark, large):
    rows = [("large", large[0]), ("small", pdf([*CATALOG, b"<< /Type /Page /Contents 7 0 R >>", b"<< /FontFile >>\nstream\nx\nendstream"])), ("junk", b"no file\n4 0 obj\n<< >>")]
    names = ("obj", "endobj", "xref", "trailer", "startxref", "eof", "stream", "endstream", "pdf_start", *rc.REFERENCE_MARKERS)
    seen = set()
    for cut in (1 << 14, 1 << 30):
        c = ck.cut_media(table(spark, rows), cut)
        hits = ck.chunk_hits(c, names)
        objects = rc.object_rows(c, hits)
        found = [objects, rc.object_bodies(objects, c), rc.region_rows(c, hits), rc.missing_references(hits, objects.select("media_id", "object_number"))]
        seen.add(tuple(tuple(sorted(map(str, x.collect()))) for x in found))
    assert len(seen) == 1
    regions, missing = list(seen)[0][2:]
    assert len(missing) == 2  # 7 and 9 of the small one; the large one has an object 9
    assert sum("TEXT_STREAM" in x for x in regions) == 55 and any("FONT_OBJECT" in x for x in regions)


def test_states(spark):
    """All four states; a placed fragment with another digest than declared makes its medium corrupted."""
    pieces = pdf([*CATALOG, b"<< >>"]).replace(b"endobj\n", b"endobj\n\x01").replace(b"%PDF-1.4\n", b"%PDF-1.4\n\x01").replace(b"trailer", b"\x01trailer").replace(b"\nstartxref", b"\n\x01startxref").replace(b"%%EOF", b"\x01%%EOF").split(b"\x01")
    from fragloom.functions import tokens as tk

    rows = []
    for m, drop in (("whole", None), ("changed", None), ("lost", 2), ("headless", 0)):
        rows.extend((m, f"{m}-{i}", bytearray(b.replace(b"<< >>", b"<<_>>") if m == "changed" else b), hashlib.sha256(b).hexdigest(), len(b)) for i, b in enumerate(pieces) if i != drop)
    d = spark.createDataFrame(rows, "media_id string, fragment_id string, block binary, sha256 string, size_bytes long")
    p = tk.profile_blocks(d.drop("sha256", "size_bytes")).drop("block")
    facts = asm.media_facts(p)
    chain = asm.chain_walk(asm.structural_edges(p, facts), facts)
    segments = fr.reassemble(fr.output_ranges(chain.join(d, ["media_id", "fragment_id"]), ["media_id"]), ["media_id"], segment=64)
    c = ck.with_sizes(segments.select("media_id", F.col("segment_start").alias("base_offset"), "content"))
    states = asm.recovery_state(facts, chain, p, asm.unresolved_joins(facts), asm.xref_check(c, ck.chunk_hits(c, asm.STRUCTURE_MARKERS)), asm.digest_mismatches(chain, d, d))
    assert {(x.media_id, x.recovery_state, x.status) for x in states.collect()} == {
        ("whole", "COMPLETE AND VERIFIED", "structurally_valid"), ("changed", "CORRUPTED", "failed"), ("lost", "PARTIAL", "incomplete"), ("headless", "UNRECOVERABLE", "incomplete"),
    }


def test_files_by_range(spark, tmp_path):
    r = random.Random(6)
    files = {"a.bin": bytes(r.randrange(256) for _ in range(20_000)), "deep/b.bin": b"short", "empty.bin": b"", "_hidden": b"x"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    seen = {n: d for n, d in files.items() if n != "_hidden"}
    for chunk, task in ((512, 4_096), (4_096, 4_096), (1 << 20, 64 << 20)):
        got = {}
        for x in media_scan(spark, str(tmp_path), chunk_bytes=chunk, task_bytes=task).orderBy("base_offset").collect():
            assert len(x.content) <= chunk and x.size_bytes == len(seen[x.media_id.removeprefix(f"{tmp_path}/")])
            got[x.media_id] = got.get(x.media_id, b"") + x.content
        assert {m.removeprefix(f"{tmp_path}/"): d for m, d in got.items()} == seen
    got = {x.media_id.removeprefix(f"{tmp_path}/"): x for x in media_files(spark, str(tmp_path), "*.bin").collect()}
    assert {n: x.sha256 for n, x in got.items()} == {n: hashlib.sha256(d).hexdigest() for n, d in seen.items()}
    assert [n for n, x in got.items() if x.warnings] == ["empty.bin"]
    hits = ck.chunk_hits(media_scan(spark, str(tmp_path), "a.bin", 512, 4_096), ("jpeg_end",)).count()
    assert hits == files["a.bin"].count(b"\xff\xd9")


def test_spans():
    out = spans_of([("a", 1_000), ("b", 10), ("c", 0)], 300, 100, True)
    spans = [s for part in out for s in part.spans]
    assert [(s.path, s.start, s.end) for s in spans] == [("a", 0, 300), ("a", 300, 600), ("a", 600, 900), ("a", 900, 1_000), ("b", 0, 10), ("c", 0, 0)]
    assert [s.end for part in spans_of([("a", 1_000)], 300, 100, False) for s in part.spans] == [1_000]
    assert len(spans_of([(f"f{i}", 10) for i in range(100)], 1 << 20, 100, True)) == 1  # small files share a task


def test_written_files(spark, tmp_path):
    rows = [("x/one", 3, b"lo"), ("x/one", 0, b"hel"), ("two", 0, b""), ("three", 0, b"abc")]
    df = spark.createDataFrame([(m, o, bytearray(b)) for m, o, b in rows], "media_id string, base_offset long, content binary")
    media_write(df.repartition(4), str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {"one": b"hello", "two": b"", "three": b"abc"}
    with pytest.raises(Exception, match="no file name"):
        media_write(spark.createDataFrame([("../up", 0, bytearray(b"x"))], df.schema), str(tmp_path / "out"))
