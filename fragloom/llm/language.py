"""Language mixtures: expectation-maximisation over n-gram likelihoods, language set by penalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fragloom.llm.common import texts

BITS = 16  # hashed 4-byte grams
BUCKETS = 1 << BITS
SMOOTHING = 0.5
ROUNDS = 25
PENALTY = 6.0  # per further language, times ln of the number of grams
MAX_LANGUAGES = 500  # a bound of the model that is sent to every task; more raise an error
UNKNOWN = "und"
# ASCII signs that are no letters become spaces; bytes of longer characters stay.
FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def grams(text: str) -> np.ndarray:
    """Hash buckets of all 4-byte grams of the lower-cased text, runs of non-letters taken as one space."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(FOLD) + b" ", "u1")
    space = raw == 32
    raw = raw[~(space & np.concatenate(([False], space[:-1])))].astype("u4")
    if len(raw) < 4:
        raw = np.concatenate((raw, np.full(4 - len(raw), 32, "u4")))
    code = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def count_grams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, bucket, n) over all rows with a language and a letter; each task adds up before the shuffle."""
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("_text")).where("lang is not null and _text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush():
            for lang, n in sorted(sums.items()):
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype("i4")), pa.array(n[at])], ["lang", "bucket", "n"])
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(text):
                    if lang not in sums and len(sums) >= 64:  # bounds a task's memory, sums meet in the shuffle
                        yield from flush()
                    sums[lang] = sums.get(lang, 0) + np.bincount(grams(text), minlength=BUCKETS)
        yield from flush()

    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and gram probabilities (buckets x languages), learnt from all given rows.

    What reaches the driver is at most 65,536 sums per language.
    """
    sums = count_grams(docs, lang_col, text_col).toPandas()
    langs = sorted(sums["lang"].unique())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the model is bounded at {MAX_LANGUAGES}")
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    table[sums["bucket"].to_numpy(), np.searchsorted(langs, sums["lang"].to_numpy().astype(str))] += sums["n"].to_numpy()
    return langs, (table / table.sum(axis=0)).astype("f4")


def mixture(n: np.ndarray, p: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Shares of the languages (columns of p) under gram counts n, and the log-likelihood."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    if len(share) > 1:
        total = n.sum()
        for _ in range(rounds):
            old = share
            share = share * (p.T @ (n / (p @ share))) / total
            if np.abs(share - old).max() < 1e-4:
                break
        share = share / share.sum()
    return share, float(n @ np.log(p @ share))


def infer(text: str | None, langs: list[str], table: np.ndarray) -> tuple[str, float, list[str], list[float]]:
    """Best language, its share, and the chosen languages with their shares, largest first."""
    if not langs or not has_letter(text):
        return UNKNOWN, 0.0, [], []
    bucket, n = np.unique(grams(text), return_counts=True)
    n = n.astype("f8")
    p = table[bucket].astype("f8")
    order = np.argsort(-mixture(n, p)[0], kind="stable") if len(langs) > 1 else np.array([0])
    best, best_value = None, -np.inf
    for k in range(1, len(order) + 1):  # nested sets, until another language doesn't pay for itself
        share, value = mixture(n, p[:, order[:k]])
        value -= PENALTY * (k - 1) * np.log(n.sum() + 1)
        if value <= best_value:
            break
        best, best_value = share, value
    chosen = sorted(zip(-best, order[: len(best)]))
    return langs[chosen[0][1]], float(-chosen[0][0]), [langs[i] for _, i in chosen], [float(-s) for s, _ in chosen]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``lang_pred``, ``score`` (its share of the text), ``langs`` and ``shares`` of the chosen set.

    Reads the text alone. Null texts and texts without a letter give ``und``, 0 and empty lists, also every row when the
    model has no language. Equal shares go to the language first in the alphabet; repeated rows and null ids stay.
    """
    rows = texts(docs, id_col, text_col).withColumnRenamed("_id", id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES * 256 KB
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for batch in batches:
            out = [infer(t, langs, table) for t in batch.column(1).to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))], [id_col, "lang_pred", "score", "langs", "shares"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double, langs array<string>, shares array<double>")
