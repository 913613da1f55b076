"""Packing token sequences with little padding.

Every document is tokenised and ended with a separator. Whole windows are cut off long documents; what packing looks at is
the histogram of the rests:

* shallow combinations (two or three lengths that fill a window exactly) are enumerated over the lengths there are,
* how often to use each is a non-negative least squares problem against the histogram, solved by projected gradient,
* rounded down, the combinations take their pieces; what is left is packed greedily, longest first, and what fills no
  window exactly is laid end to end and cut at window ends.

The plan is made over lengths, never over documents: it says which ranks within each length go where. A document knows its
rank from its place in its partition and sums over earlier partitions, so no length, however common, meets in one task.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.llm.common import hint_small, slices, written

#: Chunks of text whose ids a worker remembers.
REMEMBERED = 400_000
#: How byte-level BPE files of this kind split text, a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Punctuation that ends words and is split from them.
ENDINGS = ".,;:!?"
_ENCODERS: dict[str, tuple[Callable[[str], list[int]], dict[str, bytes | None] | None, tuple[str, ...]]] = {}
_LIBRARY: dict[str, Callable[[str], list[int]]] = {}


def _byte_of() -> dict[str, int]:
    """The printable character that such files write for each byte: itself where printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes and ids, if ids follow the order of merges and the file does nothing but byte-level BPE; else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    byte = _byte_of()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merged)):
        return None
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


def _library_of(path: str) -> Callable[[str], list[int]]:
    """The file's own library with its defaults, loaded once per process when it is first needed."""
    if path not in _LIBRARY:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        _LIBRARY[path] = lambda text: tok.encode(text, add_special_tokens=False).ids
    return _LIBRARY[path]


def _encoder_of(path: str) -> tuple[Callable[[str], list[int]], dict[str, bytes | None] | None, tuple[str, ...]]:
    """A function from text to ids, the ids of chunks met, and the strings of added tokens, once per process.

    Where the file allows it, the same tables run in tiktoken, which is several times as fast as tokenizers and gives the same
    ids for texts without an added token's string; otherwise the file's own library does.
    """
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = _ranks(spec)
        if ranks is not None:
            import tiktoken

            encode = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            encode = _library_of(path)
        added = tuple(t["content"] for t in spec.get("added_tokens", []))
        _ENCODERS[path] = encode, {} if ranks is not None else None, added
    return _ENCODERS[path]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Little-endian uint32 ids of each text, as the tokenizer file at ``path`` gives them.

    Byte-level BPE never joins across a space that is followed by a non-space, so texts are split there and each distinct
    chunk is encoded once per worker. A text with other runs of white space is encoded whole. A text that holds the string of
    an added token goes whole to the file's own library, which gives that string its one id.
    """
    encode, known, added = _encoder_of(path)
    as_bytes = lambda ids: np.asarray(ids, "<u4").tobytes()
    out = []
    for text in texts:
        if known is None:
            out.append(as_bytes(encode(text)))
            continue
        if any(a in text for a in added):
            out.append(as_bytes(_library_of(path)(text)))
            continue
        if len(known) > REMEMBERED:
            known.clear()
        first, *rest = text.split(" ")
        chunks = [first, *[" " + p for p in rest]]
        for c in chunks:
            if c not in known:
                word = c[1:] if c[:1] == " " else c
                stem = word.rstrip(ENDINGS)
                if stem != word and stem.isalpha() and max(stem) < "\u0250":  # letters, then punctuation: two pieces of their own
                    for part in (c[: len(c) - len(word) + len(stem)], word[len(stem) :]):
                        if part not in known:
                            known[part] = as_bytes(encode(part))
                    known[c] = known[c[: len(c) - len(word) + len(stem)]] + known[word[len(stem) :]]
                else:
                    known[c] = as_bytes(encode(c)) if word and not word[0].isspace() else None
        parts = [known[c] for c in chunks]
        out.append(as_bytes(encode(text)) if None in parts else b"".join(parts))
    return out


def _encoder(path: str, size: int, separator: int):
    """Ids of each document, and what numbers it within its partition: ``place`` among equal rests, ``own`` whole windows so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.asarray([separator], "<u4").tobytes()
        part, places, own = TaskContext.get().partitionId(), [0] * size, 0
        for batch in slices(batches):
            ids = [i + end for i in encode_texts([t or "" for t in batch.column(1).to_pylist()], path)]
            out: list[list[int]] = [[], [], [], []]
            for n in (len(i) // 4 for i in ids):
                for column, value in zip(out, (n, n % size, places[n % size], own), strict=True):
                    column.append(value)
                places[n % size] += 1
                own += n // size
            yield pa.record_batch([batch.column(0), pa.array([_shrunk(i) for i in ids], pa.binary()), *[pa.array(x, pa.int64()) for x in out], pa.array([part] * len(ids), pa.int64())], names=["doc_id", "ids", "doc_tokens", "rest", "place", "own", "part"])

    return run


def _shrunk(ids: bytes) -> bytes:
    """Two bytes an id where all are small; the first byte tells."""
    wide = np.frombuffer(ids, "<u4")
    return b"2" + wide.astype("<u2").tobytes() if wide.max(initial=0) < 1 << 16 else b"4" + ids


def _grown(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[:1] == b"2" else "<u4", offset=1).astype("<u4")


def combinations(lengths: list[int], size: int) -> list[tuple[int, ...]]:
    """Multisets of two or three of ``lengths`` that fill ``size`` exactly."""
    have = sorted(set(lengths))
    there = set(have)
    found = [(a, size - a) for a in have if 2 * a <= size and size - a in there]
    for i, a in enumerate(have):
        for b in have[i:]:
            if a + 2 * b > size:
                break
            if size - a - b in there:
                found.append((a, b, size - a - b))
    return found


def solve_counts(combos: list[tuple[int, ...]], lengths: list[int], want: list[int], rounds: int = 300) -> np.ndarray:
    """Non-negative least squares: how often to use each combination so that together they use each length ``want`` times."""
    if not combos:
        return np.zeros(0)
    index = {n: i for i, n in enumerate(lengths)}
    cols = np.array([i for i, c in enumerate(combos) for _ in c])
    rows = np.array([index[n] for c in combos for n in c])
    b = np.asarray(want, float)
    x, y, t = np.zeros(len(combos)), np.zeros(len(combos)), 1.0
    per_row, per_col = np.bincount(rows, minlength=len(lengths)), np.bincount(cols, minlength=len(combos))
    step = 1.0 / (per_row.max() * per_col.max())  # at most the largest row sum times the largest column sum bounds the curvature
    for _ in range(rounds):
        left = np.bincount(rows, y[cols], len(lengths)) - b
        new = np.maximum(0, y - step * np.bincount(cols, left[rows], len(combos)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


@dataclass
class Plan:
    """Where the ranks of each length go: ``windows`` of (lengths of its pieces, times), then ``tape`` of (length, number), laid end to end and cut at window ends."""

    windows: list[tuple[tuple[int, ...], int]]
    tape: list[tuple[int, int]]


def make_plan(histogram: dict[int, int], size: int) -> Plan:
    """Cover the histogram exactly. All work is over distinct lengths, of which there are fewer than ``size``: none grows with the documents."""
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    windows: list[tuple[tuple[int, ...], int]] = []
    combos = combinations(lengths, size)
    counts = solve_counts(combos, lengths, [left[n] for n in lengths])
    for i in np.argsort(-counts, kind="stable").tolist():
        times = min([int(counts[i] + 1e-6), *[left[n] // combos[i].count(n) for n in set(combos[i])]])
        if times > 0:
            windows.append((combos[i], times))
            for n in combos[i]:
                left[n] -= times
    # the residual: from the longest piece on, each time the longest that still fits; a window that doesn't fill up leaves its longest to the tape
    tape: list[tuple[int, int]] = []
    remain = [n for n in lengths if left[n] > 0]
    while remain:
        used: dict[int, int] = {}
        room, at = size, len(remain) - 1
        while at >= 0 and room > 0:
            n = remain[at]
            if n <= room and left[n] > used.get(n, 0):
                used[n] = used.get(n, 0) + 1
                room -= n
            else:
                at -= 1
        if room:
            used = {remain[-1]: 1}
            tape.append((remain[-1], left[remain[-1]]))
            times = left[remain[-1]]
        else:
            times = min(left[n] // k for n, k in used.items())
            windows.append((tuple(n for n, k in used.items() for _ in range(k)), times))
        for n, k in used.items():
            left[n] -= k * times
        remain = [n for n in remain if left[n] > 0]
    return Plan(windows, tape)


class Places:
    """Looks up the sequence, offset and cuts of the rank-th document rest of a length."""

    def __init__(self, made: Plan, size: int, first_sequence: int):
        taken: dict[int, int] = {}
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        sequence = first_sequence
        for pieces, times in made.windows:
            at = 0
            for n in pieces:
                by_length.setdefault(n, []).append((taken.get(n, 0), sequence, at))
                taken[n] = taken.get(n, 0) + times
                at += n
            sequence += times
        self.size, self.tape_sequence, self.taped, end = size, sequence, {}, 0
        for n, count in made.tape:
            self.taped[n] = (taken.get(n, 0), end)
            taken[n] = taken.get(n, 0) + count
            end += n * count
        self.full = end // size
        # what is left of the tape is cut into powers of two, which need no padding
        self.tail, at = [self.full * size], end % size
        while at:
            self.tail.append(self.tail[-1] + (1 << (at.bit_length() - 1)))
            at -= 1 << (at.bit_length() - 1)
        self.table = {n: tuple(np.array(c, np.int64) for c in zip(*x, strict=True)) for n, x in by_length.items()}

    def find(self, n: int, rank: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of each piece of the rest, in order."""
        first, start = self.taped.get(n, (rank + 1, 0))
        if rank < first:
            firsts, sequences, offsets = self.table[n]
            g = int(np.searchsorted(firsts, rank, side="right")) - 1
            return [(n, int(sequences[g]) + rank - int(firsts[g]), int(offsets[g]))]
        at, stop, out = start + (rank - first) * n, start + (rank - first + 1) * n, []
        while at < stop:
            if at < self.full * self.size:
                window, begin = at // self.size, at // self.size * self.size
                end = begin + self.size
            else:
                k = bisect.bisect_right(self.tail, at) - 1
                window, begin, end = self.full + k, self.tail[k], self.tail[k + 1]
            out.append((min(stop, end) - at, self.tape_sequence + window, at - begin))
            at = min(stop, end)
        return out


def _pieces(places, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = places.value.find
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], [], [], [], []]
            for doc, packed, tokens, rest, rank, whole in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                ids, start = _grown(packed), 0
                for length, sequence, offset in [(size, whole + i, 0) for i in range(tokens // size)] + (find(rest, rank) if rest else []):
                    raw = ids[start : start + length].tobytes()
                    for column, value in zip(out, (doc, start, length, raw, zlib.crc32(raw), tokens, sequence, offset), strict=True):
                        column.append(value)
                    start += length
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, separator: int = 0) -> DataFrame:
    """Pieces of all documents, packed: ``doc_id, start, length, ids (binary), ids_crc32, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian uint32. A document is its ids and ``separator``; a null or empty text is the separator alone. A
    document's first ``size * k`` ids fill k sequences of their own, the rest is one piece of a shared sequence, or two or
    more if it lies on the tape. Each id lies in one piece; sequences are gapless from offset 0 and hold ``size`` ids, but for
    at most log2(size) last ones that hold powers of two: nothing is padded. Rows that share a doc_id, null ones too, are
    packed each for itself, in no given order. Other columns of ``docs`` are not carried. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    coded_as = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("doc_tokens", "rest", "place", "own", "part")]])
    coded = written(docs.select("doc_id", "text").mapInArrow(_encoder(tokenizer, size, separator), coded_as), "coded")
    counted = written(coded.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / size)).cast("long").alias("wholes")), "counted")
    histogram = {r["rest"]: r["n"] for r in counted.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # fewer rows than size
    wholes = counted.agg(F.coalesce(F.sum("wholes"), F.lit(0)).alias("n")).first()["n"]
    histogram.pop(0, None)
    places = spark.sparkContext.broadcast(Places(make_plan(histogram, size), size, int(wholes)))  # at most so many ranges as combinations
    # ranks and whole windows before each partition: sums over partitions, of which each length has one row
    earlier = counted.selectExpr("part", "rest", "coalesce(sum(n) over (partition by rest order by part rows between unbounded preceding and 1 preceding), 0) as before")
    ahead = counted.groupBy("part").agg(F.sum("wholes").alias("w")).selectExpr("part", "coalesce(sum(w) over (order by part rows between unbounded preceding and 1 preceding), 0) as ahead")
    offsets = written(earlier.join(ahead, "part"), "offsets")
    found = coded.join(hint_small(offsets), ["part", "rest"]).select("doc_id", "ids", "doc_tokens", "rest", (F.col("place") + F.col("before")).alias("rank"), (F.col("own") + F.col("ahead")).alias("whole"))
    names = [("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    return found.mapInArrow(_pieces(places, size), T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, t) for n, t in names]]))
