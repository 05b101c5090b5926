"""Media rows: (media_id, base_offset, content), one per file or per chunk of a file, and files written from them."""

from __future__ import annotations

import fnmatch
import hashlib
import posixpath
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BUFFER = 1 << 20  # bytes read at a time for digests
BATCH = 8 << 20  # content bytes of one Arrow batch
CHUNKS = "media_id string, base_offset long, size_bytes long, content binary"
FILES = "media_id string, size_bytes long, sha256 string, warnings array<string>"
EMPTY = "source media is empty: zero fragments available"


class Span(NamedTuple):
    path: str
    size: int
    start: int
    end: int


class Spans(InputPartition):
    """The byte ranges one task reads: part of a large file, or several small files."""

    def __init__(self, spans: list[Span]):
        self.spans = spans


def spans_of(files: list[tuple[str, int]], task_bytes: int, chunk: int, split: bool) -> list[Spans]:
    """Tasks of about ``task_bytes``; with ``split`` a file is cut at multiples of ``chunk``, else it stays whole."""
    step = max(chunk, task_bytes // chunk * chunk)
    out: list[Spans] = []
    held: list[Span] = []
    weight = 0
    for path, size in sorted(files):
        cuts = range(0, max(size, 1), step) if split else [0]
        for start in cuts:
            span = Span(path, size, start, min(size, start + step) if split else size)
            cost = span.end - span.start + 4096  # opening a file costs something too
            if held and weight + cost > task_bytes:
                out.append(Spans(held))
                held, weight = [], 0
            held.append(span)
            weight += cost
    return out + [Spans(held)] if held else out


class MediaReader(DataSourceReader):
    """Plans tasks by file and byte range. The driver lists names and sizes, tasks read bytes."""

    def __init__(self, options: dict[str, str]):
        self.root, self.glob = options["path"], options.get("glob", "*")
        self.digests = options.get("digests", "false") == "true"
        self.chunk, self.task_bytes = int(options.get("chunkbytes", BUFFER)), int(options.get("taskbytes", 64 << 20))
        if self.chunk <= 0:
            raise ValueError("chunkBytes must be positive")

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.root)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        hidden = lambda path: any(part.startswith((".", "_")) for part in posixpath.relpath(path, root).split("/") if part != ".")
        files = [(f.path, f.size) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.glob) and not hidden(f.path)]
        return spans_of(files, self.task_bytes, self.chunk, not self.digests) or [Spans([])]

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.root)
        return self._files(fs, partition.spans) if self.digests else self._chunks(fs, partition.spans)

    def _files(self, fs, spans: list[Span]) -> Iterator[pa.RecordBatch]:
        for span in spans:
            digest = hashlib.sha256()
            with fs.open_input_stream(span.path) as f:
                while data := f.read(BUFFER):
                    digest.update(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array([span.path]), pa.array([span.size], pa.int64()), pa.array([digest.hexdigest()]), pa.array([[] if span.size else [EMPTY]], pa.list_(pa.string()))],
                ["media_id", "size_bytes", "sha256", "warnings"],
            )

    def _chunks(self, fs, spans: list[Span]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch():
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["media_id", "base_offset", "size_bytes", "content"])

        for span in spans:
            with fs.open_input_file(span.path) as f:
                f.seek(span.start)
                for at in range(span.start, max(span.end, span.start + 1), self.chunk):
                    data = f.read(min(self.chunk, span.end - at))
                    rows.append((span.path, at, span.size, data))
                    held += len(data)
                    if held >= BATCH or len(rows) >= 4096:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class MediaWriter(DataSourceArrowWriter):
    """One file per medium: the rows of a medium come to one task in order, and the file gets its name when it is whole."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = pafs.FileSystem.from_uri(self.root)
        fs.create_dir(root, recursive=True)
        name = stream = draft = None

        def close():
            if stream is not None:
                stream.close()
                fs.move(draft, posixpath.join(root, name))

        for batch in batches:
            for media_id, content in zip(batch.column("media_id").to_pylist(), batch.column("content").to_pylist()):
                if media_id != name:
                    close()
                    if not media_id or media_id.startswith("/") or ".." in media_id.split("/"):
                        raise ValueError(f"no file name: {media_id!r}")
                    name, draft = media_id, posixpath.join(root, f"_{uuid.uuid4().hex}")
                    fs.create_dir(posixpath.dirname(posixpath.join(root, name)), recursive=True)
                    stream = fs.open_output_stream(draft)
                stream.write(content or b"")
        close()
        return WriterCommitMessage()


class MediaSource(DataSource):
    """``spark.read.format("media")``: chunks of files, or with ``digests`` one row per file; ``write`` makes files."""

    @classmethod
    def name(cls) -> str:
        return "media"

    def schema(self) -> str:
        return FILES if self.options.get("digests", "false") == "true" else CHUNKS

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return MediaWriter(dict(self.options))


def media_scan(spark: SparkSession, path: str, glob: str = "*", chunk_bytes: int = BUFFER, task_bytes: int = 64 << 20) -> DataFrame:
    """(media_id, base_offset, size_bytes, content): the files below ``path`` in chunks of ``chunk_bytes``.

    A task reads a byte range of about ``task_bytes``, so a large file is read by many tasks and no row holds more than a chunk.
    An empty file gives one row without bytes; names that begin with a dot or an underscore are left out.
    """
    spark.dataSource.register(MediaSource)
    return spark.read.format("media").option("glob", glob).option("chunkBytes", chunk_bytes).option("taskBytes", task_bytes).load(path)


def media_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(media_id, size_bytes, sha256, warnings) per file. A digest is one sequential stream, so a file is one task's, a buffer at a time."""
    spark.dataSource.register(MediaSource)
    return spark.read.format("media").option("glob", glob).option("digests", "true").load(path)


def media_write(media: DataFrame, path: str) -> None:
    """Write each medium of (media_id, base_offset, content) as the file ``media_id`` below ``path``; files of that name are replaced.

    A file is one sequential stream, so all rows of a medium meet in one task, sorted by offset and written as they come.
    """
    media.sparkSession.dataSource.register(MediaSource)
    rows = media.select("media_id", F.col("base_offset").cast("long"), F.lit(0).cast("long").alias("size_bytes"), "content")
    rows.repartition("media_id").sortWithinPartitions("media_id", "base_offset").write.format("media").mode("append").save(path)


def unchanged_media(before: DataFrame, after: DataFrame) -> DataFrame:
    """Compare two ``media_files`` tables: a read-only pass must leave every digest as it was."""
    a = before.select("media_id", F.col("sha256").alias("sha256_before"))
    b = after.select("media_id", F.col("sha256").alias("sha256_after"))
    return a.join(b, "media_id", "full_outer").withColumn(
        "unchanged", F.col("sha256_before").eqNullSafe(F.col("sha256_after"))
    )


def column_media(df: DataFrame, media_id: Column, text: Column) -> DataFrame:
    """Use a text column as media bytes."""
    content = F.encode(text, "UTF-8")
    return df.select(
        media_id.alias("media_id"),
        F.lit(0).cast("long").alias("base_offset"),
        F.length(content).cast("long").alias("size_bytes"),
        content.alias("content"),
    )
