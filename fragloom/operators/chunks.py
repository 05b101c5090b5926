"""Marker hits and byte ranges of media that come in chunks of any size.

A chunk finds the markers inside it and hands its unfinished bytes on: its head, up to the first place that no marker
crosses, and its tail, from the first place at which a marker may still be open. The tail of one chunk, the chunks
after it that hold nothing but an unfinished marker, and the head of the next make one border, and borders are searched
on their own. So the bytes are read once and never shuffled, and every hit is found as in the whole medium.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fragloom.operators.scale import materialize, running_total


class Run(NamedTuple):
    """``low`` to ``high`` bytes of a class (no upper end for None); ``taken`` makes it a group."""

    kind: str
    low: int = 1
    high: int | None = None
    taken: bool = False

    def pattern(self, low: int | None = None) -> str:
        low = self.low if low is None else low
        times = {(0, None): "*", (1, None): "+"}.get((low, self.high), "{%d,%s}" % (low, "" if self.high is None else self.high))
        return f"[{self.kind}]{times}"


class Shape(NamedTuple):
    """A marker: what must stand before it, its literals and runs, and what must follow (both without width)."""

    left: str
    parts: tuple
    right: str = ""


DIGIT, WHITE, BLANK, LINE_WHITE = "0-9", " \t\n\r\f\x0b", " \t", " \t\r\n"
number, white = Run(DIGIT, taken=True), Run(WHITE)
EDGE_L, EDGE_R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
word = lambda text: Shape(EDGE_L, (text,), EDGE_R)
plain = lambda text: Shape("", (text,))
entry = lambda state: Shape("", (Run(DIGIT, 10, 10, True), Run(BLANK), Run(DIGIT, 5, 5), Run(BLANK), state, Run(LINE_WHITE)))

# Fixed byte patterns of the markers, as ISO-8859-1 text.
SHAPES = {
    "obj": Shape(f"(?<![^{WHITE}])", (number, white, number, white, "obj"), EDGE_R),
    "endobj": word("endobj"),
    "xref": word("xref"),
    "trailer": word("trailer"),
    "startxref": word("startxref"),
    "eof": plain("%%EOF"),
    "stream": Shape("", ("stream", Run("\r\n"))),
    "endstream": plain("endstream"),
    "pdf_head": Shape("", ("%PDF-", Run(DIGIT), ".", Run(DIGIT))),
    "png_head": plain("\x89PNG\r\n\x1a\n"),
    "png_end": plain("IEND"),
    "jpeg_head": plain("\xff\xd8"),
    "jpeg_end": plain("\xff\xd9"),
    "zip_head": plain("PK\x03\x04"),
    "zip_end": plain("PK\x05\x06"),
    # structure of a PDF file
    "pdf_mark": plain("%PDF-"),
    "startxref_at": Shape(EDGE_L, ("startxref", Run(LINE_WHITE), number), EDGE_R),
    "table_mark": plain("xref"),
    "table_head": Shape("", ("xref", Run(LINE_WHITE), number, Run(BLANK), number, Run(LINE_WHITE))),
    "entry_n": entry("n"),
    "entry_f": entry("f"),
    "obj_number": Shape("", (number, Run(BLANK), Run(DIGIT), Run(BLANK), "obj"), EDGE_R),
    "root_ref": Shape("", ("/Root", white, number, white, "0", white, "R")),
    "catalog": Shape("", ("/Type", Run(WHITE, 0), "/Catalog")),
    "pdf_start": plain("%PDF"),
    "contents_ref": Shape("", ("/Contents", white, number, white, "0", white, "R")),
    "kids_open": Shape("", ("/Kids", Run(WHITE, 0), "[")),
    "list_close": plain("]"),
    "object_ref": Shape("", (number, white, "0", white, "R")),
    "pages_ref": Shape("", ("/Pages", white, number, white, "0", white, "R")),
    # words that label a region
    **{
        text: plain(text)
        for text in (
            "/Subtype /Image", "/Subtype/Image", "/DCTDecode", "/JPXDecode", "/Type /Page", "/Type/Page", "/Contents", "/FontFile",
            "/Type /Metadata", "/Type/Metadata", "/Type /Font", "/Type/Font", "BT", "ET",
        )
    },
}
ENDS_AFTER_NUMBER = {"obj_number"}  # their ``end`` is that of the number
HITS = "media_id string, marker string, pos long, end long, number long, generation long"
PIECES = HITS + ", bytes binary"
RUNS = re.compile(rb"[0-9]+|[ \t\n\r\f\x0b]+|[^0-9 \t\n\r\f\x0b]")
AT_ONCE = 256  # chunks whose hits are held together
HEAD, TAIL, WHOLE = "_head", "_tail", "_whole"


def full(shape: Shape) -> str:
    parts = [f"({p.pattern()})" if p.taken else p.pattern() for p in shape.parts if isinstance(p, Run)]
    runs = iter(parts)
    body = "".join(next(runs) if isinstance(p, Run) else re.escape(p) for p in shape.parts)
    if shape.left and isinstance(shape.parts[0], str):
        # the literal comes first and the look-behind after it, so that the search skips to the literal
        first = re.escape(shape.parts[0])
        return first + shape.left[:-1] + first + ")" + body[len(first) :] + shape.right
    return shape.left + body + shape.right


def _begun(parts: tuple) -> str:
    """What an unfinished rest of ``parts`` may look like, nothing included."""
    out = ""
    for p in reversed(parts):
        if isinstance(p, Run):
            out = f"(?:{p.pattern(max(1, p.low))}{out}|{p.pattern(0)})" if p.low else f"{p.pattern(0)}{out}"
        else:
            for c in reversed(p):
                out = f"(?:{re.escape(c)}{out})?"
    return out


class Markers:
    """Compiled forms of some markers."""

    def __init__(self, names: tuple[str, ...]):
        code = lambda text: re.compile(text.encode("latin-1"))
        self.search = {n: code(full(SHAPES[n])) for n in names}
        openings, rests, self.literals = [], [], []
        for n in names:
            parts = SHAPES[n].parts
            openings.append(_begun(parts))
            for k, p in enumerate(parts):
                if isinstance(p, Run):
                    rests.append(p.pattern(0) + _begun(parts[k + 1 :]))
                else:
                    self.literals.append(p.encode("latin-1"))
                    rests.extend(re.escape(p[i:]) + _begun(parts[k + 1 :]) for i in range(1, len(p)))
        self.opening = code(r"(?!\Z)(?:" + "|".join(dict.fromkeys(openings)) + r")\Z")
        self.rest = code("(?:" + "|".join(dict.fromkeys(rests)) + r")\Z")

    def inner(self, data: bytes) -> bool:
        """Whether a marker that began earlier may still be open after ``data``, or ``data`` all belong to one."""
        return any(data in x for x in self.literals) or self.rest.match(data) is not None

    def open_from(self, data: bytes) -> int:
        """The first place at which a marker may have begun that is not finished; the length if there is none."""
        size = 64
        while True:
            at = max(0, len(data) - size)
            window = data[at:]
            found = self.opening.search(window)
            start = found.start() if found else len(window)
            if at == 0 or (start > 0 and not self.inner(window)):
                return at + start
            size *= 8

    def settled_at(self, data: bytes, end: int) -> int | None:
        """The first place up to ``end`` that no marker crosses, whatever stands before ``data``; None without one."""
        for run in RUNS.finditer(data, 0, end + 1):  # inside a run nothing is settled that was open before
            f = run.end()
            if f <= end and not self.inner(data[: f + 1]) and self.open_from(data[: f + 1]) >= f:
                return f
        return None

    def hits(self, data: bytes, base: int, start: int, end: int) -> Iterator[tuple]:
        """(marker, pos, end, number, generation) of the markers that begin from ``start`` to before ``end`` (absolute places)."""
        for name, pattern in self.search.items():
            for m in pattern.finditer(data, start - base):
                if base + m.start() >= end:
                    break
                if not pattern.groups:
                    yield name, base + m.start(), base + m.end(), None, None
                    continue
                # a digit run beyond 18 places is no number this column can hold
                num, gen = ([int(d) if len(d) < 19 else None for d in m.groups()] + [None, None])[:2]
                yield name, base + m.start(), base + m.end(1 if name in ENDS_AFTER_NUMBER else 0), num, gen


@cache
def compiled(names: tuple[str, ...]) -> Markers:
    return Markers(names)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*rows)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["media_id", "marker", "pos", "end", "number", "generation", "bytes"])


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """AT_ONCE rows at a time: a batch of chunks has many times its rows in hits, and those are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def _search_chunks(names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        markers = compiled(names)
        for batch in parts_of(batches):
            rows: list[tuple] = []
            for media_id, base, size, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                last = base + len(data) >= size
                cut = len(data) if last else markers.open_from(data)
                settled = 0 if base == 0 else markers.settled_at(data, cut)
                if (not last and cut == 0) or settled is None:
                    rows.append((media_id, WHOLE, base, base + len(data), None, None, data))
                    continue
                if base:
                    rows.append((media_id, HEAD, base, base + settled, None, None, data[: settled + 1]))
                rows.extend((media_id, *hit, None) for hit in markers.hits(data, base, base + settled, base + cut))
                if not last:
                    rows.append((media_id, TAIL, base + cut, base + cut, None, None, data[max(0, cut - 1) :]))
            yield _record(rows)

    return run


def _search_borders(names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        markers = compiled(names)
        for batch in parts_of(batches):
            rows: list[tuple] = []
            for media_id, tail, first, end, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                # a tail has the byte before it in front, unless it is the medium's first
                base = first if tail is None else max(0, tail - 1)
                rows.extend((media_id, *hit, None) for hit in markers.hits(data, base, first if tail is None else tail, end))
            yield _record(rows)

    return run


def chunk_hits(chunks: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Absolute positions of markers in media cut anywhere, the same for every cut.

    ``chunks`` has (media_id, base_offset, size_bytes, content): the pieces of each medium without gaps, in any order.
    A run of chunks without any settled place (all digits or all white space) is one border, so it meets in one task.
    """
    names = tuple(names)
    slim = chunks.where(F.length("content") > 0).select("media_id", "base_offset", "size_bytes", "content")
    found = materialize(slim.mapInArrow(_search_chunks(names), PIECES))
    pieces = found.where(F.col("bytes").isNotNull())
    # a tail opens a border, the next head closes it; at one place, the next chunk's first, the tail comes first
    order = F.struct("pos", F.col("marker") != TAIL)
    opened = running_total(pieces, ["media_id"], [F.col("pos"), F.col("marker") != TAIL], F.floor(F.col("pos") / (1 << 24)), (F.col("marker") == TAIL).cast("long"), "_border")
    borders = opened.groupBy("media_id", "_border").agg(
        F.max(F.when(F.col("marker") == TAIL, F.col("pos"))).alias("tail"), F.min("pos").alias("first"), F.max("end").alias("end"),
        F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "bytes"))), lambda x: x["bytes"]).alias("_parts"),
    )
    joined = F.aggregate("_parts", F.lit(b""), lambda a, x: F.concat(a, x))
    crossing = borders.select("media_id", "tail", "first", "end", joined.alias("bytes")).mapInArrow(_search_borders(names), PIECES)
    return found.where(F.col("bytes").isNull()).unionByName(crossing).drop("bytes")


def range_pieces(chunks: DataFrame, ranges: DataFrame, keys: list[str], width: int = 1 << 16) -> DataFrame:
    """(media_id, keys, start, end, at, piece): the bytes of ranges [start, end), cell by cell of ``width`` bytes.

    Chunks are cut into cells and ranges listed once per cell they meet, so one equi-join moves each byte once and no row
    holds more than a cell.
    """
    cell = lambda first, last: F.explode(F.sequence(F.floor(first / width), F.floor(last / width)))
    base = F.col("base_offset")
    cut = chunks.where(F.length("content") > 0).select("media_id", base.alias("_base"), "content", cell(base, base + F.length("content") - 1).alias("_cell"))
    low = F.greatest("_base", F.col("_cell") * width)
    skipped = (low - F.col("_base")).cast("int")
    part = F.substring("content", skipped + 1, (F.lit(width) - (low - F.col("_cell") * width)).cast("int"))
    cut = cut.select("media_id", "_cell", low.alias("_low"), part.alias("_part"))
    wanted = ranges.where(F.col("end") > F.col("start")).select("media_id", *keys, "start", "end", cell(F.col("start"), F.col("end") - 1).alias("_cell"))
    at = F.greatest("start", "_low")
    to = F.least(F.col("end"), F.col("_low") + F.length("_part"))
    piece = F.substring("_part", (at - F.col("_low") + 1).cast("int"), (to - at).cast("int"))
    return wanted.join(cut, ["media_id", "_cell"]).where(at < to).select("media_id", *keys, "start", "end", at.alias("at"), piece.alias("piece"))


def byte_ranges(chunks: DataFrame, ranges: DataFrame, keys: list[str], width: int = 1 << 16) -> DataFrame:
    """(media_id, keys, start, end, bytes): the bytes of each range; ranges beyond the medium give what there is, empty ones no row."""
    pieces = range_pieces(chunks, ranges, keys, width)
    return pieces.groupBy("media_id", *keys, "start", "end").agg(F.expr("listagg(piece, X'') within group (order by at)").alias("bytes"))


def sizes_of(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("media_id").agg(F.max(F.col("base_offset") + F.length("content")).alias("size_bytes"))


def with_sizes(chunks: DataFrame) -> DataFrame:
    """Chunks with the size of their medium, for tables that do not have it; only the sizes are shuffled."""
    return chunks if "size_bytes" in chunks.columns else chunks.join(sizes_of(chunks), "media_id")


def cut_media(media: DataFrame, chunk: int, size: Column | None = None) -> DataFrame:
    """Media rows cut into chunks of ``chunk`` bytes."""
    length, base = F.length("content"), F.col("base_offset")
    total = (size if size is not None else base + length).cast("long")
    # pieces are cut before the explode, and it is an outer one, so that no row behind it carries the whole content and
    # Spark does not build derived content a second time for an emptiness filter
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), length - 1), F.lit(chunk)),
        lambda s: F.struct((base + s).alias("base_offset"), total.alias("size_bytes"), F.substring("content", s + 1, F.lit(chunk)).alias("content")),
    )
    return media.select("media_id", F.explode_outer(pieces).alias("_piece")).where("_piece is not null").select("media_id", "_piece.*")
