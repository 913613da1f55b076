"""Context-triggered piecewise hashes of whole texts, and the likeness of two of them.

A hash of the eight bytes up to each byte of a text tells whether a chunk ends there: it does at block size b = 2^k if the lowest
k bits are all ones, so the chunks of twice the block size are joins of those of the block size. Each chunk gives one
character. A fingerprint is ``b:characters at b:characters at 2 b``; two fingerprints are compared where they share a block
size, by the edit distance of the characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import slices, written

#: Most characters at the block size (half as many at twice of it), and the least that a block size should give.
MOST, LEAST = 64, 32
#: Strings of characters must share so many in a row, or all of a shorter one's, to be alike at all.
COMMON = 7
#: Bytes that are hashed at once.
BLOCK = 1 << 20
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _rolling(data: bytes, at: int) -> np.ndarray:
    """32-bit hashes of the eight bytes that end at each of the bytes from ``at`` on, BLOCK of them; zeros stand before the text."""
    head = data[max(0, at - 7) : at]
    part = bytes(7 - len(head)) + head + data[at : at + BLOCK]
    windows = np.ndarray(len(part) - 7, "<u8", part, strides=(1,))
    h = windows * _SPREAD
    h ^= h >> np.uint64(29)
    h *= _SPREAD
    return (h >> np.uint64(32)).astype(np.uint32)


def _ends(data: bytes, power: int, most: int, whole: np.ndarray | None) -> list[int]:
    """The first ``most`` ends of chunks at block size 2^power."""
    mask, found = np.uint32((1 << power) - 1), []
    for at in range(0, len(data), BLOCK):
        h = _rolling(data, at) if whole is None else whole
        found += (np.flatnonzero((h & mask) == mask)[: most - len(found)] + at + 1).tolist()
        if len(found) >= most:
            break
    return found


def _characters(data: bytes, ends: list[int]) -> str:
    """One character per chunk; what follows the last end is a chunk, too."""
    out, start, view = [], 0, memoryview(data)
    for end in ends:
        out.append(_LETTERS[xxhash.xxh3_64_intdigest(view[start:end]) & 63])
        start = end
    if start < len(data):
        out.append(_LETTERS[xxhash.xxh3_64_intdigest(view[start:]) & 63])
    return "".join(out)


def fingerprint(text: str) -> str:
    """The fingerprint of a whole text; equal texts have equal ones. An empty text has ``1::``.

    The block size is the smallest power of two at which 64 chunks of that size hold the text, halved while it gives fewer
    than 32 chunks. At 64 characters (32 at twice the block size) the last chunk takes all that is left.
    """
    data = text.encode()
    power = max(0, (len(data) - 1).bit_length() - 6) if data else 0
    whole = _rolling(data, 0) if len(data) <= BLOCK else None
    while power and len(_ends(data, power, LEAST, whole)) < LEAST:
        power -= 1
    return f"{1 << power}:{_characters(data, _ends(data, power, MOST - 1, whole))}:{_characters(data, _ends(data, power + 1, MOST // 2 - 1, whole))}"


def _runs_cut(s: str) -> str:
    """No character more than three times in a row: long runs say little."""
    out = []
    for i, c in enumerate(s):
        if i < 3 or not c == s[i - 1] == s[i - 2] == s[i - 3]:
            out.append(c)
    return "".join(out)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by whole rows of bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    """1 - distance / lengths, where an insertion or a removal costs 1 and a change 2; 0 without a common run of characters.

    Lengths and distance are of what is left when no character stands more than three times in a row.
    """
    if a == b:
        return 1.0
    run = min(COMMON, len(a), len(b))
    if not run or not {a[i : i + run] for i in range(len(a) - run + 1)} & {b[i : i + run] for i in range(len(b) - run + 1)}:
        return 0.0
    a, b = _runs_cut(a), _runs_cut(b)
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: the best of the likenesses at the block sizes that both fingerprints have; 0 if they share none."""
    if a == b:
        return 1.0
    (size_a, *parts_a), (size_b, *parts_b) = a.split(":"), b.split(":")
    levels_a = {int(size_a): parts_a[0], 2 * int(size_a): parts_a[1]}
    levels_b = {int(size_b): parts_b[0], 2 * int(size_b): parts_b[1]}
    return max((_alike(levels_a[size], levels_b[size]) for size in levels_a.keys() & levels_b.keys()), default=0.0)


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter replaced by the first as many characters of ``after``, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_SIDE = pa.schema([("part", pa.int32()), ("last", pa.bool_()), ("end_id", pa.int64()), ("text", pa.string())])


def _row(doc_id: int | None, text: str, mark: str, after: str, after_mark: str) -> tuple:
    changed = edited(text, after)
    other = fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, other, likeness(mark, other), likeness(mark, after_mark)


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) of a sorted partition: finished rows for all but the last, and the first and last text as they are."""
    part, before = TaskContext.get().partitionId(), None
    nothing = (None,) * len(_FIELDS)
    fields = pa.schema([*_FIELDS, *_SIDE])
    for batch in slices(batches):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            mark = fingerprint(text)
            if before is None:
                rows.append((*nothing, part, False, doc_id, text))
            else:
                rows.append((*_row(*before, text, mark), None, None, None, None))
            before = doc_id, text, mark
        yield _batch(rows, fields)
    if before is not None:
        yield _batch([(*nothing, part, True, before[0], before[1])], fields)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, after): the last of a partition and the first of the next."""
    for batch in slices(batches):
        rows = [_row(doc_id, text, fingerprint(text), after, fingerprint(after)) for doc_id, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield _batch(rows, _FIELDS)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of ``docs(doc_id, text)``.

    Each text is compared with its edited self (see :func:`edited`) and with the next document's text, by ascending doc_id; the
    one after the last is the first. Rows are dealt and sorted by ranges of doc_id, so most meet their successor in the
    same task; the last of each partition meets the first of the next in a second step over two rows a partition.

    Null texts count as empty ones; null doc_ids come before all others; rows of one doc_id are ordered by a hash of their
    text and then the text, so which of them comes next is fixed; a lone document follows itself; other columns are left out;
    an empty table gives an empty one. Whole texts are hashed, in blocks of 1 MB.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    dealt = keyed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    made = written(dealt.mapInArrow(_compared, f"{_ROW}, part int, last boolean, end_id long, text string"), "fingerprints")
    sides = made.where("part is not null")
    # one row a partition: numbers alone
    parts = sides.where("not last").select("part")
    here = Window.orderBy("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(here), F.min("part").over(Window.partitionBy())).alias("next"))
    ends = sides.where("last").select("part", F.col("end_id").alias("doc_id"), "text").join(following, "part")
    met = ends.join(sides.where("not last").select(F.col("part").alias("next"), F.col("text").alias("after")), "next").select("doc_id", "text", "after")
    return made.where("part is null").select(*_FIELDS.names).unionByName(met.mapInArrow(_joined, _ROW))
