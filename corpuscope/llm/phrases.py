"""Phrase collocations per language: n-gram counts from suffix arrays of word ids, scored by their weakest cut.

Each task reads its documents into shards of a bounded number of words. A shard numbers its words, sorts the suffixes of all
its pieces by prefix doubling in NumPy, and takes the n-gram counts from the intervals of equal longest common prefixes. The
counts of all shards are merged by key in Spark, in two passes: the first merges 64-bit hashes of the n-grams, whose sums can
only be too large, and yields a bit table of those that may be frequent; the second ships the words of only these, and merges
them exactly. The bit table has a fixed greatest size: where it fills up more n-grams travel, and none is lost.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import join_skewed, slices, written
from corpuscope.llm.hashing import mix

#: Words of a shard: what NumPy sorts at once, in about 150 MB.
SHARD_WORDS = 2_000_000
#: Bytes of a text that are split at once; a longer piece is not cut.
CHUNK = 1 << 20
#: Bits of the table of n-grams that may be frequent: 16 for each, up to 2^27 (16 MB).
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Rows of an Arrow batch that a shard returns.
ROWS_OUT = 200_000
#: Each language's rows are first ranked in so many parts, so that no task ranks them all.
RANK_PARTS = 64
#: What parts the pieces of a text becomes a newline, a tab becomes a space, and A-Z lower case.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
#: Numbers of what is no word: nothing between two spaces, and the end of a piece.
_NOTHING, _END = -1, -2
_STEP = np.uint64(0x9E3779B97F4A7C15)


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by the ``depth`` words that follow, and how many words each shares with the one before (0 for the first).

    ``left`` tells how many words each place has to the end of its piece, itself included; nothing is compared beyond it.
    Prefix doubling: places ranked by k words give the ranks by 2 k words, until ``depth`` is reached.
    """
    n = len(ids)
    ranks, k = [ids], 1
    order = np.argsort(ids).astype(np.int32) if depth == 1 else None
    while k < depth:
        now = ranks[-1]
        pair = now.astype(np.int64) * (n + 1)
        if n > k:
            pair[:-k] += np.where(left[:-k] > k, now[k:] + 1, 0)
        order = np.argsort(pair).astype(np.int32)
        pair = pair[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.concatenate([[False], pair[1:] != pair[:-1]]))
        del pair
        ranks.append(rank)
        k *= 2
    a, b = order[:-1], order[1:]
    same = np.zeros(max(n - 1, 0), np.int32)
    for power in range(len(ranks) - 1, -1, -1):
        k, rank = 1 << power, ranks[power]
        equal = (left[a] - same >= k) & (left[b] - same >= k)
        equal &= rank[np.minimum(a + same, n - 1)] == rank[np.minimum(b + same, n - 1)]
        same += np.int32(k) * equal
    return order, np.minimum(np.concatenate([np.zeros(1, np.int32), same]) if n else same, depth)


def intervals(order: np.ndarray, shared: np.ndarray, left: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A place and the count of every distinct n-gram of ``size`` words: the runs of suffixes that share so many."""
    starts = np.flatnonzero(shared < size)
    counts = np.diff(np.append(starts, len(order)))
    first = order[starts]
    whole = left[first] >= size
    return first[whole], counts[whole]


class Shard:
    """Words of some pieces, numbered by language and word."""

    def __init__(self) -> None:
        counter = itertools.count()
        self.numbers: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(counter.__next__, {b"": _NOTHING, b"\n": _END}))
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, plain: bytes) -> None:
        """Words of some whole pieces; newlines end pieces."""
        found = (plain.replace(b"\n", b" \n ") + b" \n").split(b" ")
        ids = np.fromiter(map(self.numbers[lang].__getitem__, found), np.int32, len(found))
        self.tokens.append(ids[ids != _NOTHING])
        self.size += len(self.tokens[-1])

    def finish(self) -> None:
        """Numbers, words and languages as arrays."""
        tokens = np.concatenate(self.tokens)
        self.tokens = []
        inside = tokens != _END
        self.at = tokens[inside]
        ends = np.cumsum(inside, dtype=np.int32)[~inside]
        self.left = np.repeat(ends, np.diff(ends, prepend=np.int32(0))) - np.arange(len(self.at), dtype=np.int32)
        count = sum(len(known) - 2 for known in self.numbers.values())
        words, self.langs, self.hashes = [b""] * count, [""] * count, np.zeros(count, np.uint64)
        for lang, known in self.numbers.items():
            seed = xxhash.xxh3_64_intdigest(lang.encode())
            for w, i in known.items():
                if i >= 0:
                    words[i], self.langs[i], self.hashes[i] = w, lang, xxhash.xxh3_64_intdigest(w, seed)
        self.words = pa.array(words, pa.binary()).cast(pa.string())

    def keys(self, first: np.ndarray, size: int) -> np.ndarray:
        """64-bit hashes of the n-grams that begin at ``first``, the same in every shard."""
        h = np.full(len(first), size, np.uint64)
        for j in range(size):
            h = mix(h * _STEP + self.hashes[self.at[first + j]])
        return h

    def grams(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        order, shared = suffix_array(self.at, self.left, most)
        for size in range(1, most + 1):
            yield size, *intervals(order, shared, self.left, size)


def _chunks(plain: bytes) -> Iterator[bytes]:
    """Parts of about CHUNK bytes that end where pieces end."""
    at = 0
    while len(plain) - at > CHUNK:
        end = plain.rfind(b"\n", at, at + CHUNK)
        if end < 0 and (end := plain.find(b"\n", at + CHUNK)) < 0:
            break
        yield plain[at:end]
        at = end + 1
    yield plain[at:]


def shards(batches: Iterator[pa.RecordBatch], most_words: int = SHARD_WORDS) -> Iterator[Shard]:
    """Shards of batches (text, lang); a shard ends at the end of a piece once it has ``most_words`` (ends of pieces count, too)."""
    shard = Shard()
    for batch in slices(batches):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            for part in _chunks((text or "").encode().translate(_PLAIN)):
                shard.add(lang, part)
                if shard.size >= most_words:
                    shard.finish()
                    yield shard
                    shard = Shard()
    if shard.size:
        shard.finish()
        yield shard


def _frequent(docs: DataFrame, least: int) -> np.ndarray:
    """A bit table with the hashes of all words and pairs that may occur ``least`` times; its size is a power of two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            for size, first, counts in shard.grams(2):
                for at in range(0, len(first), ROWS_OUT):
                    keys = shard.keys(first[at : at + ROWS_OUT], size).view(np.int64)
                    yield pa.record_batch([pa.array(keys), pa.array(counts[at : at + ROWS_OUT])], names=["key", "n"])

    # a shard has a key once: few meet again before the shuffle, and no key has more rows than there are shards
    counted = docs.mapInArrow(count, "key long, n long").repartition("key")
    keys = written(counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"), "phrase-keys")
    bits = 64
    total = keys.count()
    while bits < min(MOST_BITS, total * BITS_EACH):
        bits *= 2
    slot, bit = F.expr(f"shiftright(key & {bits - 1}L, 6)"), F.expr("shiftleft(1L, cast(key & 63 as int))")
    found = keys.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint64)


def phrase_counts(docs: DataFrame, most: int = 3, least: int = 10) -> DataFrame:
    """``lang, words, phrase, f``: exact counts of the phrases of 1 to ``most`` words that occur ``least`` times or more.

    Each language also has one row of no words, whose ``f`` is the number of all its words.
    """
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    table = texts.sparkSession.sparkContext.broadcast(_frequent(texts, least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        mask = np.uint64(len(known) * 64 - 1)

        def frequent(keys: np.ndarray) -> np.ndarray:
            keys &= mask
            return (known[(keys >> np.uint64(6)).astype(np.int64)] >> (keys & np.uint64(63)) & np.uint64(1)).astype(bool)

        def rows(langs: list[str], phrases: pa.Array, size: int, counts: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(langs, pa.string()), pa.array(np.full(len(counts), size, np.int32)), phrases, pa.array(counts, pa.int64())], names=["lang", "words", "phrase", "f"])

        for shard in shards(batches):
            langs = sorted(shard.numbers)
            code = {lang: i for i, lang in enumerate(langs)}
            spoken = np.array([code[lang] for lang in shard.langs], np.int32)
            totals = np.bincount(spoken[shard.at], minlength=len(langs))
            yield rows(langs, pa.array([""] * len(langs), pa.string()), 0, totals)
            names = pa.array(langs, pa.string())
            for size, first, counts in shard.grams(most):
                kept = np.arange(len(first))
                for j in range(max(1, size - 1)):  # the n-gram itself, or each pair in it
                    kept = kept[frequent(shard.keys(first[kept] + j, min(size, 2)))]
                for at in range(0, len(kept), ROWS_OUT):
                    here = kept[at : at + ROWS_OUT]
                    parts = [shard.words.take(pa.array(shard.at[first[here] + j])) for j in range(size)]
                    phrases = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
                    yield rows(names.take(pa.array(spoken[shard.at[first[here]]])), phrases, size, counts[here])

    merged = texts.mapInArrow(count, "lang string, words int, phrase string, f long").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return merged.where((F.col("f") >= least) | (F.col("words") == 0))


def collocations(docs: DataFrame, *, most: int = 3, least: int = 10, cover_percent: int = 50, first: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``first`` phrases of each language of ``docs(text, lang)``.

    Words are what is left between spaces and tabs of the pieces of a text (parted at ``.,;:!?`` and line ends), A-Z
    lower-cased. Candidates have 2 to ``most`` words and occur a >= ``least`` times, overlaps included. Cut after its first k
    words, a candidate scores floor(10^6 a^2 / (l r)) by the counts of both parts; the lowest-scoring cut counts, the first of
    equals. A candidate goes if a longer one that contains it occurs at least ``cover_percent`` % as often, whether that one goes
    or not. Ranks go by score and a, descending, then by phrase in byte order.

    Null texts and texts without words have no phrases; a null language is ``und``; repeated rows count each; other columns
    are ignored; an empty table gives an empty one. A very long text is worked on in shards like many short ones; only one of
    its pieces must fit in memory.
    """
    counts = written(phrase_counts(docs, most, least), "phrases")
    known = counts.where("words > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), words.alias("ws"))

    # every shorter phrase inside a candidate learns how often the candidate occurs
    inner = candidates.where("words > 2").select("lang", "a", "ws", F.explode(F.expr("filter(flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> struct(i, m)))), x -> x.m < words)")).alias("x"))
    covered = inner.groupBy("lang", F.array_join(F.slice("ws", F.col("x.i"), F.col("x.m")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = candidates.join(covered, ["lang", "phrase"], "left").where(f"coalesce(longer, 0) * 100 < cast({int(cover_percent)} as long) * a")

    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = kept.select("lang", "phrase", "a", "ws", "words", cut)
    cuts = written(cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("ws", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right")), "phrase-cuts")
    for side, name in (("left", "l"), ("right", "r")):
        uses = cuts.groupBy("lang", side).agg(F.count("*").alias("n"))
        table = written(uses.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side]), "phrase-parts")
        cuts = join_skewed(cuts, table, ["lang", side])
    score = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").cast("long")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    some = scored.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).where(F.col("place") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= first)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
