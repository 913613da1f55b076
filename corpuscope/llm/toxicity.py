"""Toxicity by a weighted finite-state grammar over clauses.

Words are mapped to classes: insult, threat, target, predicate, intent, negation, reported speech, other. Five transducers
read the classes of a clause. The insult transducer marks what is read as name-calling, the target transducer lifts it when
a person is meant or a predicate says it of somebody, the threat transducer accepts an intended or commanded deed and its
target, the negation and reported-speech transducers take most of either back. Composed, they are one deterministic table of
states by classes. A clause ends at punctuation, or where all machines rest, so that no match is cut. It pays what its best match
pays, and a text the sum of its BEST_CLAUSES best clauses: an insult word that aims at nobody pays little, and a longer text
doesn't pay more for being long.

Which words insult, and how much, is learned from labelled documents outside the held-out fold: whole words and word
beginnings (which stand for their inflected forms) that tell toxic documents from others beyond chance.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.llm.common import bounded_sample, fold, slices, written

#: Labelled documents that the fit reads; evidence that a feature needs (log-likelihood ratio) and its log odds.
FIT_DOCS, LEAST_EVIDENCE, LEAST_ODDS = 30_000, 16.0, 3.5
#: Lengths of word beginnings.
BEGINNINGS = (4, 5, 6)
REMEMBERED = 500_000

OTHER, END, INSULT, THREAT, TARGET, PREDICATE, INTENT, NEGATION, REPORT = range(9)
CLASS_COUNT = 9
#: Function words of the grammar, in English, German, French and Spanish.
CLASSES = {
    TARGET: "you your yours yourself he she they them him her his their du dich dir ihr euch sie er dein deine tu toi te vous ton ta il elle ils elles tú ti usted ustedes él ella ellos ellas".split(),
    PREDICATE: "is are am was were be being you're he's she's they're bist ist sind seid war waren es est sont êtes était étaient eres son era eran".split(),
    INTENT: "will would should must shall can gonna going want deserve deserves let's i'll we'll werde werden soll sollen wollen muss vais allons veux dois faut devrait voy vamos quiero debe deben".split(),
    NEGATION: "not never no isn't aren't wasn't don't doesn't won't nobody nicht nie kein keine keinen pas jamais aucun aucune ni nunca jamás ningún ninguna".split(),
    REPORT: "said says say wrote writes called calls quoted reported claims claimed according sagte sagt schrieb nannte laut dit disait écrit appelé selon dijo dice escribió llamó según".split(),
}
#: Beginnings of verbs of violence; a word of at most four letters more is a form of one.
THREAT_STEMS = "kill murder strangle stab shoot shot beat hurt destroy töte umbring erwürg erschieß verprügel tuer tuera étrangl frapp détrui matar mata golpea destru estrangul".split()
#: What a match pays: an insult that is aimed pays its weight, one that is not this share of it; a threat pays so much; either loses by negation or report.
BARE, THREAT_PAYS, NEGATED, REPORTED = 0.35, 6.0, 0.2, 0.4
#: Clauses that a text is scored by.
BEST_CLAUSES = 3


@dataclass(frozen=True)
class Transducer:
    """``step(state, class) -> (state, (factor, lift, extra))``: what a match at this word is multiplied by, whether it lifts
    the insult read now or last, and what it pays by itself. A clause end leads back to ``start``; at ``rest`` nothing that was
    read matters any more."""

    start: Hashable
    rest: Hashable
    step: Callable[[Hashable, int], tuple[Hashable, tuple[float, bool, float]]]


def insults() -> Transducer:
    """Accepts a name that is called; without it no insult pays at all."""
    return Transducer(0, 0, lambda state, cls: (0, (1.0, False, 0.0)))


def targets(reach: int = 4, after: int = 2) -> Transducer:
    """A target or predicate up to ``reach`` words before an insult, or a target up to ``after`` words behind it, lifts it."""

    def step(state, cls):
        aimed, insulted = state
        if cls == TARGET:
            return (reach, 0), (1.0, insulted > 0, 0.0)
        if cls == PREDICATE:
            return (reach, max(0, insulted - 1)), (1.0, False, 0.0)
        if cls == INSULT:
            return (max(0, aimed - 1), after), (1.0, aimed > 0, 0.0)
        return (max(0, aimed - 1), max(0, insulted - 1)), (1.0, False, 0.0)

    return Transducer((0, 0), (0, 0), step)


def threats(reach: int = 4, after: int = 2) -> Transducer:
    """Accepts a deed with its target: commanded (first in its clause) or intended, target behind ("will kill you"), or suffered, target first ("you will be killed")."""

    def step(state, cls):
        first, meant, intended, armed = state
        gone = (False, max(0, meant - 1), max(0, intended - 1), max(0, armed - 1))
        if cls == TARGET:
            return (False, reach, intended, 0), (1.0, False, THREAT_PAYS if armed else 0.0)
        if cls == INTENT:
            return (False, meant, reach, 0), (1.0, False, 0.0)
        if cls == THREAT:
            return (False, gone[1], gone[2], after + 1 if first or intended else 0), (1.0, False, THREAT_PAYS if meant and intended else 0.0)
        if cls in (PREDICATE, NEGATION):
            return (False, meant, intended, gone[3]), (1.0, False, 0.0)
        return gone, (1.0, False, 0.0)

    return Transducer((True, 0, 0, 0), (False, 0, 0, 0), step)


def takes_back(trigger: int, reach: int, factor: float) -> Transducer:
    """Scales what matches within ``reach`` words behind ``trigger``."""
    return Transducer(0, 0, lambda state, cls: (reach if cls == trigger else max(0, state - 1), (factor if state else 1.0, False, 0.0)))


MACHINES: dict[str, Callable[[], Transducer]] = {
    "insult": insults,
    "target": targets,
    "threat": threats,
    "negation": lambda: takes_back(NEGATION, 3, NEGATED),
    "report": lambda: takes_back(REPORT, 5, REPORTED),
}


def compose(machines: list[Transducer]) -> tuple[list[list[int]], list[list[tuple[float, bool, float]]], int]:
    """One table for all, over the states that can be reached: next state and output by state and class, and the state in which all rest; factors multiply, lifts join, extras add."""
    start = tuple(m.start for m in machines)
    number, after, output = {start: 0}, [], []
    for state in (queue := [start]):
        after.append([0] * CLASS_COUNT)
        output.append([(1.0, False, 0.0)] * CLASS_COUNT)
        for cls in range(CLASS_COUNT):
            if cls == END:
                continue
            steps = [m.step(s, cls) for m, s in zip(machines, state, strict=True)]
            to = tuple(s for s, _ in steps)
            if to not in number:
                number[to] = len(queue)
                queue.append(to)
            after[-1][cls] = number[to]
            output[-1][cls] = (math.prod(o[0] for _, o in steps), any(o[1] for _, o in steps), sum(o[2] for _, o in steps))
    return after, output, number[tuple(m.rest for m in machines)]


def plain(word: str) -> str:
    """A word without what is no letter or apostrophe, in lower case."""
    return "".join(c for c in word if c.isalpha() or c == "'").lower()


def features_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) > n]]


@dataclass
class ToxicityModel:
    """Weights of insult features, the logistic curve from a text's clause weight to its score, and the machines of the grammar."""

    weights: dict[str, float]
    middle: float = 4.0
    steep: float = 1.0
    machines: tuple[str, ...] = tuple(MACHINES)
    known: dict[str, tuple[int, float, bool]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.after, self.output, self.rest = compose([MACHINES[m]() for m in self.machines])
        self.classes = {w: c for c, words in CLASSES.items() for w in words}

    def __reduce__(self):
        return ToxicityModel, (self.weights, self.middle, self.steep, self.machines)

    def look(self, raw: str) -> tuple[int, float, bool]:
        """Class and weight of a word, and whether it ends its clause."""
        word = plain(raw)
        ends = raw[-1] in ".,;:!?"
        if word in self.classes:
            return self.classes[word], 0.0, ends
        if "insult" in self.machines and word and (weight := max((self.weights.get(f, 0.0) for f in features_of(word)), default=0.0)):
            return INSULT, weight, ends
        return (THREAT if any(word.startswith(x) and len(word) <= len(x) + 4 for x in THREAT_STEMS) else OTHER), 0.0, ends

    def clauses(self, text: str | None) -> Iterator[tuple[int, list[tuple[int, float]]]]:
        """First state, and the classes and weights, of each clause that holds an insult or threat word.

        A clause ends at a mark, at the end of its line, or where all machines rest: what follows can't change what was read.
        """
        known, after, rest = self.known, self.after, self.rest
        if len(known) > REMEMBERED:
            known.clear()
        for line in (text or "").split("\n"):
            clause: list[tuple[int, float]] = []
            worth, first, state = False, 0, 0
            for w in line.split():
                if (seen := known.get(w)) is None:
                    seen = known[w] = self.look(w)
                cls, weight, ends = seen
                state = after[state][cls]
                clause.append((cls, weight))
                worth = worth or cls == INSULT or cls == THREAT
                if ends or state == rest:
                    if worth:
                        yield first, clause
                    clause, worth, state = [], False, 0 if ends else rest
                    first = state
            if worth:
                yield first, clause

    def pays(self, clause: list[tuple[int, float]], state: int = 0) -> float:
        """What the best match of a clause pays, read from ``state``."""
        held, best = 0.0, 0.0
        for cls, weight in clause:
            factor, lift, extra = self.output[state][cls]
            if cls == INSULT:
                held = weight * factor
                best = max(best, held if lift else BARE * held)
            elif lift:
                best = max(best, held)
            best = max(best, extra * factor)
            state = self.after[state][cls]
        return best

    def weigh(self, text: str | None) -> float:
        """What the best clauses of a text pay together."""
        return sum(sorted((self.pays(c, first) for first, c in self.clauses(text)), reverse=True)[:BEST_CLAUSES])

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.steep * (self.weigh(text) - self.middle)))))


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of either label hold each feature."""
    seen: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for batch in slices(batches):
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            mine = seen[toxic]
            for f in {f for w in {plain(w) for w in text.split()} if w for f in features_of(w)}:
                mine[f] = mine.get(f, 0) + 1
    rows = [(t, f, n) for t in (0, 1) for f, n in seen[t].items()]
    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["toxic", "feature", "n"])


def _middle(toxic: np.ndarray, clean: np.ndarray, start: float) -> float:
    """The weight that best parts toxic from clean texts (each error counts the same); the middle of the best stretch."""
    if not len(toxic) or not len(clean):
        return start
    at = np.unique(np.concatenate([toxic, clean, [0.0]]))
    cuts = np.append((at[1:] + at[:-1]) / 2, at[-1] + 1)
    right = np.searchsorted(np.sort(clean), cuts) - np.searchsorted(np.sort(toxic), cuts)
    best = np.flatnonzero(right == right.max())
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> ToxicityModel:
    """Fit on whole texts of about ``fit_docs`` labelled documents at most, none of the held-out fold.

    A document with several labels is toxic if any of them says so. All features with enough evidence are kept: the rows that
    they are learned from bound the model.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold(F.col("doc_id")) != 0)
    chosen = bounded_sample(known, "doc_id", fit_docs, "toxicity")
    sample = written(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    t, c = sizes.get(1, 0), sizes.get(0, 0)
    counts = sample.mapInArrow(_presence, "toxic int, feature string, n long").groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (t + 1.0)) - F.log((F.col("b") + 0.5) / (c + 1.0))
    rate = (F.col("a") + F.col("b")) / F.lit(float(max(1, t + c)))
    part = lambda k, n: F.when(k > 0, k * F.log(k / (n * rate))).otherwise(0.0)
    evidence = 2 * (part(F.col("a"), float(max(1, t))) + part(F.col("b"), float(max(1, c))))
    told = counts.where(F.col("a") > 1).withColumns({"odds": odds, "evidence": evidence}).where((F.col("odds") >= LEAST_ODDS) & (F.col("evidence") >= LEAST_EVIDENCE))
    weights = {r["feature"]: min(6.0, r["odds"]) for r in told.collect()}  # of the sample
    model = ToxicityModel(weights)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([batch.column(0), pa.array([shared.value.weigh(x) for x in batch.column(1).to_pylist()], pa.float64())], names=["toxic", "weight"])

    found = sample.mapInArrow(weigh, "toxic int, weight double").toArrow()  # bounded by the sample
    toxic, weight = found["toxic"].to_numpy(), found["weight"].to_numpy()
    return ToxicityModel(weights, max(0.5, _middle(weight[toxic == 1], weight[toxic == 0], 4.0)))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs`` (doc_id, text).

    The score sees the text alone. A null or empty text matches no clause and gets the lowest score. Long texts are read
    whole, in batches bounded in bytes, and score by their best clauses like short ones. Repeated rows and null
    ids are scored like any other (held_out is null for the latter); an empty table gives an empty one. Other columns are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = np.array([shared.value.score(x) for x in batch.column(2).to_pylist()], float)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text").mapInArrow(run, schema)
