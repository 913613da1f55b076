"""Sentiment of texts as a batch function: an interface, its application to a table, and a word-list stand-in that needs no model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts that a model is given at once.
BATCH_TEXTS = 64
CLASSES = ("positive", "neutral", "negative")


class SentimentModel(Protocol):
    """What judges texts: ``classify`` gets a list of them and returns one row of three raw scores for each (see CLASSES). It is sent to the workers."""

    name: str

    def classify(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class WordLists:
    """Counts of listed words as scores, against 1 for neutral; words stand between white space, A-Z lower-cased."""

    positive: frozenset[str]
    negative: frozenset[str]
    name: str = "word lists"

    def classify(self, texts: list[str]) -> np.ndarray:
        out = np.ones((len(texts), 3))
        for i, text in enumerate(texts):
            found = [w.decode() for w in text.encode().lower().split()]
            out[i, 0], out[i, 2] = sum(w in self.positive for w in found), sum(w in self.negative for w in found)
        return out


def classify_texts(rows: DataFrame, model: SentimentModel, key: str = "id", text: str = "text") -> DataFrame:
    """``key, positive, neutral, negative``: the softmax of a model's scores, which add up to 1. A null text counts as an empty one; one row per row, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(at, BATCH_TEXTS)
                raw = np.asarray(model.classify([t or "" for t in part.column(1).to_pylist()]), float)
                if raw.shape != (part.num_rows, 3):
                    raise ValueError(f"{model.name} returned {raw.shape}, not {(part.num_rows, 3)}")
                odds = np.exp(raw - raw.max(axis=1, keepdims=True))
                shares = odds / odds.sum(axis=1, keepdims=True)
                yield pa.record_batch([part.column(0), *[pa.array(shares[:, i]) for i in range(3)]], names=[key, *CLASSES])

    return rows.select(key, text).mapInArrow(run, T.StructType([rows.schema[key], *[T.StructField(c, T.DoubleType()) for c in CLASSES]]))
