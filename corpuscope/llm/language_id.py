"""Language identification, word first.

Per language, known words have a log frequency. A word that no language knows is scored by its character n-grams, longest
first: the first length of which some are known decides. Counts come from labelled documents outside the held-out fold.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import InitVar, dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.llm.common import bounded_sample, fold, slices, written

#: Labelled documents that the fit reads, which bound the model, and the length of the longest n-grams.
FIT_DOCS, LONGEST = 4_000, 5
REMEMBERED = 300_000


def letters_of(word: str) -> str:
    """A word without what is no letter, in lower case."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def grams_of(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter] = defaultdict(Counter)
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[lang].update(text.split())
    rows: list[tuple[str, int, str, int]] = []
    for lang, raw in seen.items():
        words: Counter = Counter()
        for w, c in raw.items():
            words[letters_of(w)] += c
        words.pop("", None)
        rows += [(lang, 0, w, c) for w, c in words.items()]
        for n in range(1, LONGEST + 1):
            grams: Counter = Counter()
            for w, c in words.items():
                for g in grams_of(w, n):
                    grams[g] += c
            rows += [(lang, n, g, c) for g, c in grams.items()]
    yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "kind", "token", "n"])


@dataclass
class LanguageModel:
    """``tables[0]`` maps words, ``tables[n]`` n-grams, to centred log frequencies per language; held as rows of one matrix."""

    languages: list[str]
    tables: InitVar[list[dict[str, np.ndarray]]]

    def __post_init__(self, tables: list[dict[str, np.ndarray]]) -> None:
        place = count(1)
        self.index = [{token: next(place) for token in table} for table in tables]
        self.matrix = np.stack([np.zeros(len(self.languages), np.float32), *(v for table in tables for v in table.values())])
        self.forget()

    def forget(self) -> None:
        """Start the memory of words met anew; its row 0 stands for words without a letter."""
        self.rows: dict[str, int] = {}
        self.scores = self.matrix[:1]

    def parts(self, word: str) -> list[int]:
        """Rows of the matrix whose mean scores a word of letters: its own, or those of its longest n-grams that are known."""
        if known := self.index[0].get(word):
            return [known]
        padded = f"<{word}>"
        for n in range(LONGEST, 0, -1):
            at = self.index[n].get
            if found := [row for i in range(len(padded) - n + 1) if (row := at(padded[i : i + n]))]:
                return found
        return [0]

    def word(self, word: str) -> np.ndarray | None:
        """Scores of one word, None if it has no letter."""
        word = letters_of(word)
        return self.matrix[self.parts(word)].mean(0) if word else None

    def meet(self, words: list[str]) -> None:
        """Remember the scores of words, worked out together."""
        parts: list[int] = []
        starts: list[int] = []
        for w in words:
            if letters := letters_of(w):
                self.rows[w] = len(self.scores) + len(starts)
                starts.append(len(parts))
                parts += self.parts(letters)
            else:
                self.rows[w] = 0
        if starts:
            sums = np.add.reduceat(self.matrix[parts], starts)
            self.scores = np.concatenate([self.scores, sums / np.diff([*starts, len(parts)])[:, None].astype(np.float32)])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.rows) > REMEMBERED:
            self.forget()
        counts = [Counter((text or "").split()) for text in texts]
        rows = self.rows
        self.meet(list({w for words in counts for w in words if w not in rows}))
        out = []
        for words in counts:
            at = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
            n = np.fromiter(words.values(), np.int64, len(words))
            size = int(n[at > 0].sum())
            if not size or not self.languages:
                out.append(("und", 0.0))
                continue
            total = n @ self.scores[at]
            total = total / max(1.0, size / 50)  # repeats and dependence make long texts no surer than this
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            out.append((self.languages[best], float(odds[best] / odds.sum())))
        return out


def fit_language_model(docs: DataFrame, fit_docs: int = FIT_DOCS) -> LanguageModel:
    """Fit on whole texts of about ``fit_docs`` labelled documents at most, none of the held-out fold; every word and n-gram in them is kept."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(fold(F.col("doc_id")) != 0)
    sample = bounded_sample(known.select("doc_id", "lang", "text"), "doc_id", fit_docs, "language")
    counts = written(sample.select("lang", "text").mapInArrow(_count, "lang string, kind int, token string, n long").groupBy("lang", "kind", "token").agg(F.sum("n").alias("n")), "language-counts")
    total = {(r["lang"], r["kind"]): (r["n"], r["k"]) for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
    languages = sorted({lang for lang, _ in total})
    tables: list[dict[str, np.ndarray]] = []
    for kind in range(LONGEST + 1):
        vectors: dict[str, np.ndarray] = {}
        index = {lang: i for i, lang in enumerate(languages)}
        for r in counts.where(F.col("kind") == kind).select("token", "lang", "n").toArrow().to_pylist():  # of the sample
            vectors.setdefault(r["token"], np.zeros(len(languages)))[index[r["lang"]]] = r["n"]
        if vectors:
            size = np.array([total.get((lang, kind), (0, 1))[0] for lang in languages])
            kinds = np.array([total.get((lang, kind), (0, 1))[1] for lang in languages])
            names = list(vectors)
            logs = np.log((np.stack([vectors[t] for t in names]) + 0.5) / (size + 0.5 * kinds + 1))
            logs = (logs - logs.mean(1, keepdims=True)).astype(np.float32)
            vectors = dict(zip(names, logs, strict=True))
        tables.append(vectors)
    return LanguageModel(languages, tables)


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: one row per row of ``docs`` (doc_id, text).

    The prediction sees the text alone. ``und`` with score 0 if the text is null or has no letter, or nothing was learned; equal
    scores go to the language that sorts first. Repeated rows and null ids are scored like any other (held_out is null for
    the latter); very long texts are read whole and are no surer than 50 words would make them; an
    empty table gives an empty one. Other columns are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = shared.value.predict(batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text").mapInArrow(run, schema)
