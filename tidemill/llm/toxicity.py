"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate, and the L1 term keeps most weights at
zero, so that the fitted weights are a small sparse vector which every task gets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemill.llm.common import encoded_words, returned, sliced, spans_of_words, text_buffer

#: Hashed features; a weight vector is at most 12 bytes for each.
BITS = 22
#: Labelled rows that are learned from: all, or so many by the least hash of their identifier.
MOST_ROWS = 12_000
#: Distinct features of a text that are learned from (about 10,000 words have so many).
MOST_FEATURES = 1 << 16
#: Rate, and smoothing and penalties of the proximal step; passes over the rows.
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 20.0, 0.1, 6
SEED = 17
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: ASCII punctuation at a word's ends doesn't make another word.
EDGES = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


#: Lengths, in characters, of the stems that stand beside their words.
STEMS = (4, 5, 6, 7)
SLICE = 1 << 20


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts (words, their stems, pairs of neighbours, pairs around one word) and the text of each."""
    begin, end, first = spans_of_words(data, at)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words, codes = encoded_words(LOWER[data], begin, end)
    plain = [w.strip(EDGES) or w for w in words.to_pylist()]
    chars = [w.decode("utf-8", "replace") for w in plain]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    one = _mixed(np.fromiter(map(zlib.crc32, plain), np.uint64, len(plain)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))[codes]
    parts, owners = [one], [text]
    for n in STEMS:
        stem = np.fromiter((zlib.crc32(c[:n].encode()) if len(c) > n else 0 for c in chars), np.uint64, len(chars))
        longer = (stem != 0)[codes]
        parts.append(_mixed(stem * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1000 + n))[codes[longer]])
        owners.append(text[longer])
    for gap in (1, 2):
        if len(one) > gap:
            same = text[gap:] == text[:-gap]
            parts.append(_mixed((one[:-gap] * np.uint64(0xD6E8FEB86659FD93) ^ one[gap:]) + np.uint64(gap))[same])
            owners.append(text[gap:][same])
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners)


class FTRL:
    """Follow the regularised leader with a proximal step for each coordinate; features are present or not."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        g = weight * (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label)
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


#: The coordinate that every text has.
BIAS = 1 << BITS


def fit(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that aren't zero, learned from rows (key, text, label) with keys to order them by.

    At most MOST_ROWS rows are learned from, in the order of their keys, by one task; both classes
    count alike. Texts become their distinct features (at most 2^BITS, by hash the least MOST_FEATURES of a text)
    where they are, so that this task's memory is bounded too. Rows without a label are left out. With no
    rows, or one class alone, only a bias is learned.
    """

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=SLICE):
            found, text = features(*text_buffer(batch.column("text")))
            order = np.argsort(text, kind="stable")
            edges = np.searchsorted(text[order], np.arange(batch.num_rows + 1))
            own = [np.unique(found[order[a:b]])[:MOST_FEATURES].astype("<i4").tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label").cast(pa.int32()), pa.array(own, pa.binary())], names=["key", "label", "own"])

    rows = labelled.where(F.col("label").isNotNull()).select("key", "text", "label").mapInArrow(featured, "key long, label int, own binary")
    rows = rows.orderBy("key", "label", "own").limit(MOST_ROWS)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(np.append(np.frombuffer(own, "<i4"), np.int32(BIAS)), label) for batch in batches for own, label in zip(batch.column("own").to_pylist(), batch.column("label").to_pylist(), strict=True)]
        w = learned(seen)
        del seen
        at = np.flatnonzero(w)
        returned()
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()]), pa.array([w[at].astype("<f8").tobytes()])], names=["at", "w"])

    made = rows.select("label", "own").coalesce(1).mapInArrow(learn, "at binary, w binary").collect()
    if not made:
        return np.zeros(0, np.int32), np.zeros(0)
    return np.frombuffer(made[0]["at"], "<i4"), np.frombuffer(made[0]["w"], "<f8")


def learned(seen: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """The weights of all coordinates after EPOCHS passes over examples (distinct coordinates, label), each in an order of its own."""
    ones = sum(label for _, label in seen)
    weight = {1: len(seen) / (2 * ones), 0: len(seen) / (2 * (len(seen) - ones))} if 0 < ones < len(seen) else {0: 1.0, 1: 1.0}
    model = FTRL(BIAS + 1)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(SEED + epoch).permutation(len(seen)).tolist():
            model.learn(seen[i][0], seen[i][1], weight[seen[i][1]])
    out = np.zeros(BIAS + 1)
    seen_at = np.flatnonzero(model.n)
    out[seen_at] = model.weights(seen_at)
    return out


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """row (a struct of the columns in `keep`) and score (0 to 1, higher: label 1 likelier) of each row; a null or empty text has the bias alone.

    The model is sparse and bounded: it is sent with the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = shared.value
        weight = np.zeros(BIAS + 1)
        weight[at] = w
        for batch in sliced(batches, most=SLICE):
            found, text = features(*text_buffer(batch.column("text")))
            some = weight[found] != 0
            pair = np.unique(text[some] * (BIAS + 1) + found[some])
            total = weight[BIAS] + np.bincount(pair // (BIAS + 1), weights=weight[pair % (BIAS + 1)], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))], names=["row", "score"])

    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("score", DoubleType())]))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def model_for(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Learned from the labelled rows of docs that aren't held out. The labels that are learned from are chosen
    by hash before they meet their texts; a document with several labels takes part once for each."""
    names = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"), F.xxhash64(F.lit(SEED), "doc_id").alias("key"))
    chosen = names.orderBy("key", "label").limit(MOST_ROWS)
    # (at most MOST_ROWS rows of three numbers)
    return fit(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("key", "text", "label"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) of each row.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out and never learned from; a null doc_id is not
    held out and has no label. Scores depend on texts alone: equal texts, equal scores. An empty table gives no rows.
    """
    rows = scored(docs, model_for(docs, labels)).select("row.doc_id", "score").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


__all__ = ["features", "fit", "model_for", "scored", "toxicity"]
