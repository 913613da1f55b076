"""Text encoders as batch functions: an interface, its application to a table, and a hashing encoder that needs no model."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts that an encoder is given at once.
BATCH_TEXTS = 256


class Encoder(Protocol):
    """What encodes texts: ``encode`` gets a list of them and returns one row of ``dim`` numbers for each. It is sent to the workers."""

    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashingEncoder:
    """Words, lower-cased, are hashed to signed dimensions and weighed by 1 + ln(count); rows have length 1, or 0 for a text without words."""

    dim: int = 256
    name: str = "hashing"

    def encode(self, texts: list[str]) -> np.ndarray:
        counted = [Counter(text.lower().split()) for text in texts]
        sizes = [len(c) for c in counted]
        hashes = np.fromiter((zlib.crc32(w.encode()) for c in counted for w in c), np.int64, sum(sizes))
        times, where = np.unique(np.fromiter((n for c in counted for n in c.values()), np.int64, sum(sizes)), return_inverse=True)
        weights = np.where(hashes >> 31, 1.0, -1.0) * np.array([1 + math.log(n) for n in times.tolist()])[where]
        at = hashes % self.dim + np.repeat(np.arange(len(texts)) * self.dim, sizes)
        # sums in the order of the words, as one by one
        out = np.bincount(at, weights, len(texts) * self.dim).reshape(len(texts), self.dim)
        length = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(length > 0, length, 1)


def encode_texts(rows: DataFrame, encoder: Encoder, key: str = "id", text: str = "text") -> DataFrame:
    """``key, embedding``: every text encoded, in Arrow batches; a null text is an empty one, repeated rows are encoded each for itself.

    The result has one row per input row, and nothing is shuffled. An encoder that returns a wrong shape fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(at, BATCH_TEXTS)
                made = np.asarray(encoder.encode([t or "" for t in part.column(1).to_pylist()]), np.float32)
                if made.shape != (part.num_rows, encoder.dim):
                    raise ValueError(f"{encoder.name} returned {made.shape}, not {(part.num_rows, encoder.dim)}")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, encoder.dim), pa.int32()), pa.array(made.ravel()))
                yield pa.record_batch([part.column(0), lists], names=[key, "embedding"])

    return rows.select(key, text).mapInArrow(run, T.StructType([rows.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def encode_query(encoder: Encoder, text: str) -> list[float]:
    """The vector of one query text."""
    return [float(x) for x in np.asarray(encoder.encode([text]))[0]]


class LexicalEncoder(Protocol):
    """What weighs the words of texts: ``weigh`` gets a list of texts and returns, for each, the words that matter and their weights."""

    name: str

    def weigh(self, texts: list[str]) -> list[dict[str, float]]: ...


@dataclass(frozen=True)
class CountingEncoder:
    """Words between white space, A-Z lower-cased, weigh 1 + ln(count)."""

    name: str = "counting"

    def weigh(self, texts: list[str]) -> list[dict[str, float]]:
        out = []
        for text in texts:
            counts = Counter(text.encode().lower().split())
            out.append({w.decode(): 1 + math.log(n) for w, n in counts.items()})
        return out


def encode_sparse(rows: DataFrame, encoder: LexicalEncoder, key: str = "id", text: str = "text") -> DataFrame:
    """``key, weights``: the weighted words of every text as a map, in Arrow batches; a null text has none. Weights that are not above 0 are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(at, BATCH_TEXTS)
                words, weights, ends = [], [], [0]
                for found in encoder.weigh([t or "" for t in part.column(1).to_pylist()]):
                    if not all(x > 0 for x in found.values()):
                        found = {w: x for w, x in found.items() if x > 0}
                    words.extend(found)
                    weights.extend(found.values())
                    ends.append(len(words))
                made = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string()), pa.array(weights, pa.float32()))
                yield pa.record_batch([part.column(0), made], names=[key, "weights"])

    return rows.select(key, text).mapInArrow(run, T.StructType([rows.schema[key], T.StructField("weights", T.MapType(T.StringType(), T.FloatType()))]))
