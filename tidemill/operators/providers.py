"""Places for models: embedding texts, scoring pairs, generating replies. A model is a factory, called once in each Python worker.

No model is in this repository. A factory returns a function over lists, so that anything that
encodes batches fits; hashed_words() and shared_words() are small ones without weights.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.retrieval import top

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[tuple[str, str]]], list[float]]
Generator = Callable[[list[list[dict]]], list[str]]


def embedded(text: Column, factory: Callable[[], Encoder], dim: int, batch: int = 256) -> Column:
    """Vectors of texts (null: of the empty one), each scaled to length 1 unless it is zero. Another dimension or a number that isn't finite is an error."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for texts in series:
            out: list[np.ndarray] = []
            for i in range(0, len(texts), batch):
                v = np.asarray(encode(texts.iloc[i : i + batch].fillna("").tolist()), np.float64)
                if v.shape != (len(texts.iloc[i : i + batch]), dim) or not np.isfinite(v).all():
                    raise ValueError(f"{dim} finite numbers are expected for each text")
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                out += list(v / np.where(norm == 0, 1, norm))
            yield pd.Series(out)

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(text)


def scores(query: Column, text: Column, factory: Callable[[], Scorer], batch: int = 256) -> Column:
    """A score of each pair of texts; one that isn't finite is an error."""

    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = factory()
        for q, t in pairs:
            out: list[float] = []
            for i in range(0, len(q), batch):
                chunk = list(zip(q.iloc[i : i + batch].fillna(""), t.iloc[i : i + batch].fillna(""), strict=True))
                out += [float(x) for x in score(chunk)]
            if len(out) != len(q) or not np.isfinite(out).all():
                raise ValueError("a finite score is expected for each pair")
            yield pd.Series(out, dtype="float64")

    run.__annotations__ = {"pairs": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(query, text)


def reranked(candidates: DataFrame, k: int, factory: Callable[[], Scorer] | None = None) -> DataFrame:
    """The k best candidates of each query: by the score they have (query_id, id, score), or by a model's of (query, text). Ties go to the smaller id."""
    if factory is not None:
        candidates = candidates.withColumn("score", F.round(scores(F.col("query"), F.col("text"), factory), 6))
    return top(candidates.drop("rank"), k)


def generated(rows: DataFrame, factory: Callable[[], Generator], messages: str = "messages", into: str = "reply", batch: int = 8) -> DataFrame:
    """rows with a reply to each conversation, a few at a time."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generate = factory()
        for convs in series:
            out: list[str] = []
            for i in range(0, len(convs), batch):
                out += generate([[dict(m) if isinstance(m, dict) else m.asDict() for m in (c if c is not None else [])] for c in convs.iloc[i : i + batch]])
            yield pd.Series(out, dtype="object")

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(into, F.pandas_udf(run, "string")(F.col(messages)))


def words_of(text: str) -> list[str]:
    return re.findall(r"\w+", text.casefold())


def hashed_words(dim: int) -> Callable[[], Encoder]:
    """Each word adds 1 or -1 at a place, both from its SHA-256; no words give the first axis."""

    def factory() -> Encoder:
        @lru_cache(1 << 16)
        def place(w: str) -> int:
            """Twice the place, and 1 for a word that subtracts."""
            h = hashlib.sha256(w.encode()).digest()
            return int.from_bytes(h[:4], "big") % dim * 2 + h[4] % 2

        def encode(texts: list[str]) -> np.ndarray:
            at = [2 * dim * i + place(w) for i, text in enumerate(texts) for w in words_of(text)]
            n = np.bincount(np.array(at, np.int64), minlength=2 * dim * len(texts)).reshape(len(texts), dim, 2)
            out = (n[:, :, 0] - n[:, :, 1]).astype(np.float64)
            for row in out:
                if not row.any():
                    row[0] = 1
            return out

        return encode

    return factory


def shared_words() -> Scorer:
    """The share of a query's distinct words that the text has."""

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, text in pairs:
            asked = set(words_of(query))
            out.append(len(asked & set(words_of(text))) / len(asked) if asked else 0.0)
        return out

    return score
