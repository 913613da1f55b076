r"""Quality rules with weak supervision: rules vote or abstain, expectation-maximisation finds how far to trust each of them.

All in DataFrame functions. Per document, counts come from higher-order functions over its own words (no explode, no
shuffle). Each rule turns counts into a vote: 1 good, -1 bad, 0 abstain. The vote patterns of all documents are counted
(a table of at most 3^rules rows, however large the corpus) and each EM round is one aggregation over that table whose
single row of sums carries the new parameters: how often a rule is right on good documents, and how often on bad ones. The
posterior probability of good quality replaces "must pass all rules": a flag that often contradicts the other rules counts
little against them, one that they confirm decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import SPACES, written

#: A letter-case or symbol rule has no opinion on fewer words than this.
FEW_WORDS = 20
#: Two or more marks in a row, or one that stands alone between blanks.
MARKS = r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]{2,}|(?:^|[\x20\x09-\x0D])[^\p{L}\p{M}\p{N}\x20\x09-\x0D](?:[\x20\x09-\x0D]|\z)"


@dataclass(frozen=True)
class Rule:
    """``vote`` is a column of 1 (good), -1 (bad) or 0 (abstain) over the columns of :func:`text_counts`."""

    name: str
    vote: Column


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are hashed and packed with their position into one long, which sorts as a primitive; equal hashes name
    candidates, which are then compared as strings, so that no collision counts.
    """

    def at(ws: Column) -> Column:
        n = F.size(ws)
        bits = F.ceil(F.log2(n + F.lit(1))).cast("int")
        hashed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(ws[i], ws[i + 1], ws[i + 2]).bitwiseAND(F.lit((1 << 62) - 1)))
        packed = F.transform(hashed, lambda h, i: F.call_function("shiftleft", F.call_function("shiftright", h, bits), bits).bitwiseOR(i.cast("long")))

        def candidates(order: Column) -> Column:
            same = lambda x, y: F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)
            last = F.size(order) - 1
            near = F.filter(order, lambda x, i: ((i > 0) & same(x, F.get(order, i - 1))) | ((i < last) & same(x, F.get(order, i + 1))))
            return F.transform(near, lambda x: x - F.call_function("shiftleft", F.call_function("shiftright", x, bits), bits))

        def exact(order: Column) -> Column:
            last = F.size(order) - 1
            same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
            kept = F.filter(order, lambda x, i: ((i > 0) & same(x, F.get(order, i - 1))) | ((i < last) & same(x, F.get(order, i + 1))))
            return F.size(F.array_distinct(F.flatten(F.transform(kept, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

        windows = lambda places: F.transform(places, lambda p: F.struct(F.get(ws, p.cast("int")).alias("a"), F.get(ws, (p + 1).cast("int")).alias("b"), F.get(ws, (p + 2).cast("int")).alias("c"), p.alias("p")))
        places = _let(F.sort_array(packed), candidates)
        return _let(places, lambda ps: F.when(F.size(ps) == 0, F.lit(0)).otherwise(_let(F.sort_array(windows(ps)), exact)))

    return _let(words, lambda ws: F.when(F.size(ws) < 4, F.lit(0)).otherwise(at(ws)))


def text_counts(docs: DataFrame) -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) and the counts that only rules use.

    Words are runs of characters other than ASCII white space; a null text is an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.octet_length(F.btrim(x, F.lit(SPACES))) > 0)
    kept = docs.withColumns({"__text": text, "__words": words, "__lines": lines})
    joined = F.array_join("__words", "")
    counts = {
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(joined).cast("long"),
        "n_symbols": F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("__words")).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_upper": F.length(F.regexp_replace("__text", r"[^\p{Lu}]+", "")).cast("long"),
        "n_letters": F.length(F.regexp_replace("__text", r"[^\p{L}\p{M}]+", "")).cast("long"),
        "n_marks": F.regexp_count("__text", F.lit(MARKS)).cast("long"),
        "n_distinct": F.size(F.array_distinct("__words")).cast("long"),
    }
    return kept.withColumns(counts).drop("__text", "__words", "__lines")


def default_rules() -> list[Rule]:
    """Nine rules, each with a view of good and of bad; a text between the two, or too short to tell, gets no vote.

    Every kind of junk is seen by more than one of them, so that their agreement tells how far each can be trusted.
    """
    per = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    enough = F.col("n_words") >= FEW_WORDS
    vote = lambda bad, good: F.when(enough & bad, -1).when(enough & good, 1).otherwise(0)
    symbols, upper, repeats, marks = per("n_symbols", "n_words"), per("n_upper", "n_letters"), per("n_repeat_words", "n_words"), per("n_marks", "n_words")
    mean, dups, letters = per("word_chars", "n_words"), per("n_dup_lines", "n_lines"), per("n_letters", "word_chars")
    # distinct words grow with a power of all words: the power says the same of short and of long texts
    variety = F.try_divide(F.ln(F.col("n_distinct").cast("double")), F.ln(F.col("n_words").cast("double")))
    return [
        Rule("length", F.when(F.col("n_words") < 10, -1).when(F.col("n_words") >= 30, 1).otherwise(0)),
        Rule("symbols", vote(symbols >= 0.1, symbols < 0.02)),
        Rule("capitals", vote(upper >= 0.45, upper <= 0.2)),
        Rule("repeats", vote(repeats >= 0.45, repeats <= 0.1)),
        Rule("word_length", vote((mean < 2) | (mean > 15), mean.between(3, 10))),
        Rule("variety", vote(variety < 0.6, variety >= 0.75)),
        Rule("line_repeats", F.when(F.col("n_lines") < 4, 0).when(dups >= 0.5, -1).when(dups <= 0.2, 1).otherwise(0)),
        Rule("letters", vote(letters <= 0.75, letters >= 0.85)),
        Rule("marks", vote(marks >= 0.1, marks < 0.03)),
    ]


@dataclass(frozen=True)
class Belief:
    """Share of good documents, and of each rule's votes: right ones among good documents, right ones among bad ones."""

    prior: float
    on_good: list[float]
    on_bad: list[float]


#: What is believed before any vote is seen, and what that weighs: a share of the votes, so that it counts alike at every size.
PRIOR, ON_GOOD, ON_BAD, WEIGHT, ROUNDS = 0.8, 0.97, 0.4, 0.02, 15


def _log_odds(names: list[str], belief: Belief) -> Column:
    """Of good against bad: each vote counts with how much likelier it is from one than from the other, an abstention not at all."""
    score = F.lit(math.log(belief.prior / (1 - belief.prior)))
    for name, g, b in zip(names, belief.on_good, belief.on_bad, strict=True):
        score = score + F.when(F.col(name) == 1, math.log(g / (1 - b))).when(F.col(name) == -1, math.log((1 - g) / b)).otherwise(0.0)
    return score


def fit_accuracies(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> Belief:
    """EM over ``patterns(*names, n)``, the counts of vote patterns: how often each rule is right on good and on bad documents.

    Each round is one aggregation (the E-step weights each pattern by its posterior, the M-step takes each rule's shares of
    right votes) whose single row gives the next parameters. Nothing is clamped: the belief before any vote weighs WEIGHT of
    a rule's votes, which keeps every share between 0 and 1. An empty table gives the start values.
    """
    belief = Belief(PRIOR, [ON_GOOD] * len(names), [ON_BAD] * len(names))
    for _ in range(rounds):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-_log_odds(names, belief)))
        good = F.col("n") * F.col("__p")
        sums = [F.sum("n"), F.sum(good)]
        for x in names:
            said = F.col(x) != 0
            sums += [F.sum(F.when(said, F.col("n"))), F.sum(F.when(said, good)), F.sum(F.when(F.col(x) == 1, good)), F.sum(F.when(F.col(x) == -1, F.col("n") - good))]
        row = patterns.withColumn("__p", p).agg(*[F.coalesce(s.cast("double"), F.lit(0.0)).alias(f"s{i}") for i, s in enumerate(sums)]).first()
        if not row[0]:
            break
        blend = lambda right, votes, mean, every: (right + WEIGHT * every * mean) / (votes + WEIGHT * every) if every else mean
        each = [row[2 + 4 * i : 6 + 4 * i] for i in range(len(names))]
        new = Belief(blend(row[1], row[0], PRIOR, row[0]), [blend(up, of_good, ON_GOOD, every) for every, of_good, up, _ in each], [blend(down, every - of_good, ON_BAD, every) for every, of_good, _, down in each])
        moved = max(abs(x - y) for x, y in zip([new.prior, *new.on_good, *new.on_bad], [belief.prior, *belief.on_good, *belief.on_bad], strict=True))
        belief = new
        if moved < 1e-9:
            break
    return belief


def score_quality(docs: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (doc_id if unset) with the counts, ``posterior`` (double), ``base_failed`` and ``kept`` (boolean).

    base_failed: fewer than 50 words, or over half of them in repeated windows. kept: false if base_failed, else posterior
    >= threshold. Null and empty texts count no words, fail the base and are not kept. Very long texts are counted whole,
    one row at a time. A document for which every rule abstains gets the prior. Repeated rows vote once each. Columns of the input whose names clash with the counts are
    replaced. An empty table gives an empty table.
    """
    rules = default_rules() if rules is None else rules
    names = [f"__vote_{i}" for i in range(len(rules))]
    carried = ["doc_id"] if columns is None else columns
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_distinct"]
    base = docs.select(*[c for c in carried if c not in made and c != "text"], "text")
    counted = text_counts(base)
    if "text" not in carried:
        counted = counted.drop("text")
    voted = written(counted.withColumns({n: r.vote.cast("int") for n, r in zip(names, rules, strict=True)}), "quality")
    patterns = written(voted.groupBy(*names).agg(F.count("*").alias("n")), "votes")
    posterior = F.lit(1.0) / (F.lit(1.0) + F.exp(-_log_odds(names, fit_accuracies(patterns, names))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumns({"posterior": posterior, "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).drop(*names)
