"""Quality by nearest-neighbour voting: cosine products with all labelled latent-semantic vectors, weighted votes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fragloom.llm.common import released, texts

GRAMS = 1024  # hashed shape trigrams
LEVELS = 16  # grid of each measure
MEASURES = 9
WIDTH = GRAMS + MEASURES * (LEVELS + 1)
TOPICS = 48
NEIGHBOURS = 25
PER_LABEL = 1500  # labelled rows of each label that are learnt from, a documented bound of the model
BLOCK = 256  # documents per matrix product
# Shape of a byte: letters keep their case class, digits and bytes of longer characters theirs, signs stay themselves.
SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c in (9, 11, 12, 13) else c
    for c in range(256)
)
SYMBOLS = b"#*$%&|<>"


class Model(NamedTuple):
    weight: np.ndarray  # inverse document frequencies of the terms
    topics: np.ndarray  # terms x topics
    vectors: np.ndarray  # labelled rows x topics, of length 1
    labels: np.ndarray


def features(text: str | None) -> np.ndarray:
    """Term weights of a whole text: shape trigrams (root of their share) and measures placed on a grid of terms."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    out = np.zeros(WIDTH, "f4")
    shape = np.frombuffer(b" " + data.translate(SHAPE) + b" ", "u1").astype("u4")
    if len(shape) >= 3:
        code = shape[:-2] | shape[1:-1] << 8 | shape[2:] << 16
        n = np.bincount((code * np.uint32(2654435761)) >> np.uint32(22), minlength=GRAMS)
        out[:GRAMS] = np.sqrt(n / n.sum())
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    triples = list(zip(words, words[1:], words[2:]))
    size = max(1, len(data))
    part = lambda a, b: a / b if b else 0.0
    upper = sum(data.count(bytes([c])) for c in range(65, 91))
    values = (
        part(len(set(words)), len(words)),
        1 - part(len(set(triples)), len(triples)) if triples else 0.0,
        min(1.0, 4 * sum(data.count(bytes([c])) for c in SYMBOLS) / size),
        min(1.0, 2 * upper / size),
        min(1.0, 4 * sum(data.count(bytes([c])) for c in range(48, 58)) / size),
        1 - part(len(set(lines)), len(lines)) if lines else 0.0,
        min(1.0, part(len(data), len(words)) / 20),
        min(1.0, np.log2(len(words) + 1) / 16),
        min(1.0, part(len(words), len(lines)) / 100),
    )
    for k, v in enumerate(values):
        low = min(LEVELS - 1, int(v * LEVELS))
        at = GRAMS + k * (LEVELS + 1) + low
        out[at + 1] = (v * LEVELS - low) / 3
        out[at] = 1 / 3 - out[at + 1]
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows of each label, those with the smallest hash of their id.

    Rows are chosen by id and hash of the text on slim rows first, so an id on many rows does not pass the bound; an id with
    several labels takes the more frequent one, 1 on a tie.
    """
    votes = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_y")).where("_id is not null and _y is not null")
    votes = votes.groupBy("_id").agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
    rows = texts(docs, id_col, text_col).withColumn("_h", F.xxhash64("_text"))
    known = rows.select("_id", "_h").join(votes, "_id").distinct()
    pick = lambda y: known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id", "_h").limit(per_label)
    chosen = pick(0).unionByName(pick(1))  # at most 2 * per_label rows of three numbers, so it may be broadcast
    return rows.join(F.broadcast(chosen), ["_id", "_h"]).dropDuplicates(["_id", "_h"]).select("_id", "_text", "_y")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> Model:
    """Learn from at most 2 * per_label labelled rows of ``docs``; terms are counted in the tasks, texts stay there.

    The driver gets one vector of 1,177 terms per sampled row, weighs the terms and finds the topics as leading
    eigenvectors of their products.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["_id", "x", "y"])

    id_type = sample.schema["_id"].dataType.simpleString()
    got = sample.mapInArrow(released(run), f"_id {id_type}, x binary, y int").toPandas().sort_values("_id", kind="stable")
    x = np.frombuffer(b"".join(got["x"]), "f4").reshape(-1, WIDTH).astype("f8")
    y = got["y"].to_numpy().astype("f4")
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    x = x * weight
    values, vectors = np.linalg.eigh(x.T @ x)
    topics = vectors[:, ::-1][:, :TOPICS] / (1 + np.sqrt(np.maximum(values[::-1][:TOPICS], 0) / max(1, len(x)))) ** 0.5
    latent = x @ topics
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return Model(weight.astype("f4"), topics.astype("f4"), latent.astype("f4"), y)


def vote(x: np.ndarray, model: Model) -> np.ndarray:
    """Scores of a block of term vectors: exact products with every labelled vector, the nearest vote by similarity."""
    if not len(model.labels):
        return np.full(len(x), 0.5)
    latent = (x * model.weight) @ model.topics
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    near = latent @ model.vectors.T
    k = min(NEIGHBOURS, near.shape[1])
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    sims = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype("f8") ** 8 + 1e-9
    return np.round((sims * model.labels[at]).sum(axis=1) / sims.sum(axis=1), 6)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``score`` in 0..1, the weighted share of good neighbours. Reads the text alone, no shuffle.

    Null and empty texts are scored as texts without words; without any label the score is 0.5. Repeated rows and null
    ids stay; an empty table gives no rows.
    """
    rows = texts(docs, id_col, text_col).withColumnRenamed("_id", id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * per_label * 48 floats and the topics: under 1 MB
    schema = StructType([rows.schema[id_col], StructField("score", DoubleType())])  # an object, as the id may be a struct with any names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                x = np.stack([features(t) for t in block.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(vote(x, shared.value).astype("f8"))], [id_col, "score"])

    return rows.mapInArrow(released(run), schema)
