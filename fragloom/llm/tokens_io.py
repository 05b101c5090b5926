"""Token ids in directly addressable codes: chunk levels with continuation bitmaps and rank directories.

A record holds one document. Level 0 has the low 8 bits of every id and a bitmap that says which ids go on; level 1
has the next 8 bits of those only, and so on. The rank directory counts the bitmap's ones before each block of 512
bits, so token i is found by one byte read and one rank per level, whatever precedes it. Records are rows of Parquet
files (binary column, uncompressed page content stays addressable inside the row), one file per range of document
ids, rows in ascending id order: Spark writes and reads them on any store.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fragloom.llm.common import released, remembered, texts

MAGIC = b"DAC1"
BLOCK = 512
END_ID = 1
MEMO = 1 << 17  # pieces remembered per worker
PIECES = 1 << 10  # new pieces given to the library at once


def pack(ids: np.ndarray) -> bytes:
    """The record of one id sequence (unsigned 32-bit)."""
    rest = np.ascontiguousarray(ids, dtype="<u4")
    levels = []
    while True:
        more = rest > 255
        go_on = bool(more.any())
        bits = np.packbits(more, bitorder="little") if go_on else np.zeros(0, "u1")
        padded = np.zeros(-(-len(bits) // (BLOCK // 8)) * (BLOCK // 8), "u1")
        padded[: len(bits)] = bits
        ones = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype="<u4")
        ranks = (np.cumsum(ones, dtype="<u4") - ones).astype("<u4")
        levels.append(struct.pack("<II", len(rest), len(ranks)) + ranks.tobytes() + padded.tobytes() + rest.astype("u1").tobytes())
        if not go_on:
            return MAGIC + struct.pack("<B", len(levels)) + b"".join(levels)
        rest = rest[more] >> 8


def _levels(record) -> list[tuple[int, int, int, int]]:
    """Per level: number of ids, and the places of rank directory, bitmap and chunk bytes."""
    view = memoryview(record)
    if bytes(view[:4]) != MAGIC:
        raise ValueError("not a token record")
    at, out = 5, []
    for _ in range(view[4]):
        n, blocks = struct.unpack_from("<II", view, at)
        ranks = at + 8
        bits = ranks + 4 * blocks
        chunks = bits + blocks * (BLOCK // 8)
        out.append((n, ranks, bits, chunks))
        at = chunks + n
    return out


def unpack(record) -> np.ndarray:
    """All ids of a record."""
    parts = []
    for n, ranks, bits, chunks in _levels(record):
        flags = np.frombuffer(record, "u1", chunks - bits, bits)
        more = np.unpackbits(flags, count=n, bitorder="little").astype(bool) if len(flags) else np.zeros(n, bool)
        parts.append((np.frombuffer(record, "u1", n, chunks).astype("<u4"), more))
    ids, _ = parts[-1]
    for low, more in reversed(parts[:-1]):
        whole = low.copy()
        whole[more] |= ids << np.uint32(8)
        ids = whole
    return ids


def token_at(record, i: int) -> int:
    """Token ``i`` without decoding any other: a byte and a rank per level."""
    value, shift = 0, 0
    for n, ranks, bits, chunks in _levels(record):
        if not 0 <= i < n:
            raise IndexError(i)
        value |= record[chunks + i] << shift
        if chunks == bits or not record[bits + (i >> 3)] >> (i & 7) & 1:
            return value
        block = i // BLOCK
        (before,) = struct.unpack_from("<I", record, ranks + 4 * block)
        start = bits + block * (BLOCK // 8)
        inside = int.from_bytes(record[start : bits + (i >> 3) + 1], "little") & ((1 << (i - block * BLOCK)) - 1)
        i = before + inside.bit_count()
        shift += 8
    raise ValueError("record ends inside an id")


def library(tokenizer: str):
    """The library's tokenizer on one thread: a task has one core, and each further thread keeps memory of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    model.no_truncation()
    model.no_padding()
    return model


def encode_texts(model, batch: list[str | None], known: dict[str, bytes]) -> list[np.ndarray]:
    """The library's ids of each text. Pieces between spaces and line feeds, which no word of this kind of vocabulary
    crosses, go to the library once and are remembered up to a bound."""
    split = [(t or "").replace("\n", " ").split(" ") for t in batch]
    new = [p for p in {p for parts in split for p in parts} if p not in known]
    ids: dict[str, bytes] = {}
    for at in range(0, len(new), PIECES):  # what the library returns takes far more room than the ids
        part = new[at : at + PIECES]
        ids.update((p, np.array(e.ids, dtype="<u4").tobytes()) for p, e in zip(part, model.encode_batch_fast(part, add_special_tokens=False)))
    out = [np.frombuffer(b"".join([known[p] if p in known else ids[p] for p in parts]), dtype="<u4") for parts in split]
    room = MEMO - len(known)
    if room > 0:
        known.update((p, b) for p, b in list(ids.items())[:room] if len(p) < 64)
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text, append ``end_id``, and write the records to ``path`` in ascending id order.

    Range partitions keep the order across files; inside one, rows are sorted and the count of ids before each record
    runs along, so no later pass sorts anything. Rows with equal ids are ordered by their text's hash, null ids come
    first; null and empty texts give a record of the end id alone; an empty table gives no records.
    """
    rows = texts(docs, id_col, text_col).withColumn("_tie", F.xxhash64("_text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = rows.schema["_id"].dataType.simpleString()
    ordered = rows.repartitionByRange(n, F.asc_nulls_first("_id"), "_tie").sortWithinPartitions(F.asc_nulls_first("_id"), "_tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = remembered(f"library {tokenizer}", lambda: library(tokenizer))
        known = remembered(f"pieces {tokenizer}", dict)  # tasks of one worker share them
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # a few texts at a time bound the memory of the encodings
                chunk = batch.slice(at, 64)
                records, starts, sizes = [], [], []
                for ids in encode_texts(model, chunk.column(1).to_pylist(), known):
                    ids = np.append(ids, np.uint32(end_id))
                    starts.append(before)
                    sizes.append(len(ids))
                    before += len(ids)
                    records.append(pack(ids))
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(0), pa.array([part] * chunk.num_rows, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(records, pa.binary())],
                    ["id", "part", "start_in_part", "n_tokens", "record"],
                )

    ordered.mapInArrow(released(encode, keep=True), f"id {id_type}, part int, start_in_part long, n_tokens long, record binary").write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Records with ``start``, the ids of all records before: a sum over one row per file and a small join."""
    rows = spark.read.parquet(path)
    ends = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per file, so one task can hold them all
    files_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("part", F.coalesce(F.sum("n").over(files_before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "part").select("id", (F.col("offset") + F.col("start_in_part")).alias("start"), "n_tokens", "record")


def tokens_at(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Random access: for rows (id, i) the i-th token of the record, null beyond its end or without a record.

    A hash join brings each wanted place to its record; the record is not decoded.
    """
    id_type = records.schema["id"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for i, n, record in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                got.append(token_at(record, i) if record is not None and i is not None and 0 <= i < n else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.int64())], ["id", "i", "token"])

    joined = wanted.select(F.col("id"), F.col("i").cast("long").alias("i")).join(records, "id", "left").select("id", "i", "n_tokens", "record")
    return joined.mapInArrow(look, f"id {id_type}, i long, token long")


def checksums(records: DataFrame) -> DataFrame:
    """id, start, n_tokens and the crc32 of the decoded ids as little-endian unsigned 32-bit integers."""
    id_type = records.schema["id"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded = [unpack(r.as_buffer()) for r in batch.column(3)]
            sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in decoded]
            sizes = [len(x) for x in decoded]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return records.select("id", "start", "n_tokens", "record").mapInArrow(check, f"id {id_type}, start long, n_tokens long, ids_crc32 long")
