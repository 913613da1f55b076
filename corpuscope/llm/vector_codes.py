"""Codes of vectors: product quantisation in integers, with a kd-tree per codebook.

Each round broadcasts one kd-tree per part of the vectors (of at most ``entries`` entries each, whatever the table's size);
tasks find every part's nearest entry by branch and bound, many vectors at a time, and return integer sums per entry that
Spark adds up. All arithmetic is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import join_skewed, slices, written

#: Entries of a leaf, and vectors that are searched at once.
LEAF, ROWS = 4, 4096
#: Scaled components must be below this in size, so that squared distances fit 64 bits.
MOST_SIZE = 1 << 27


@dataclass
class Node:
    """A box that holds some entries: a leaf has their numbers, in order, an inner node two halves."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray
    halves: tuple[Node, Node] | None = None


def kd_tree(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """Entries halved at the median of the widest side of their box, down to LEAF of them."""
    entries = np.arange(len(book)) if entries is None else entries
    here = book[entries]
    node = Node(here.min(axis=0), here.max(axis=0), entries)
    spread = node.high - node.low
    if len(entries) > LEAF and spread.max() > 0:
        axis = int(spread.argmax())
        order = entries[np.lexsort((entries, here[:, axis]))]
        half = len(order) // 2
        node.halves = kd_tree(book, np.sort(order[:half])), kd_tree(book, np.sort(order[half:]))
    return node


def _bound(node: Node, points: np.ndarray) -> np.ndarray:
    """Squared distance of each point to the node's box."""
    out = np.maximum(node.low - points, 0) + np.maximum(points - node.high, 0)
    return (out * out).sum(axis=1)


def nearest_entries(tree: Node, book: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest entry and its squared distance; of equally near ones the lowest number.

    A point visits the half whose box is nearer first, and the other only if that box is not farther than what was found: one
    that is just as far is visited, as it may hold an equally near entry of a lower number.
    """
    n = len(points)
    best = np.full(n, np.iinfo(np.int64).max)
    found = np.full(n, len(book), np.int64)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        here = points[rows]
        if node.halves is None:
            far = here[:, None, :] - book[node.entries][None]
            far = (far * far).sum(axis=2)
            pick = far.argmin(axis=1)
            least, entry = far[np.arange(len(rows)), pick], node.entries[pick]
            better = (least < best[rows]) | ((least == best[rows]) & (entry < found[rows]))
            best[rows[better]], found[rows[better]] = least[better], entry[better]
            return
        one, two = node.halves
        to_one, to_two = _bound(one, here), _bound(two, here)
        one_first = to_one <= to_two
        for first, second, mine, bound in ((one, two, one_first, to_two), (two, one, ~one_first, to_one)):
            visit(first, rows[mine])
            visit(second, rows[mine][bound[mine] <= best[rows[mine]]])

    visit(tree, np.arange(n))
    return found, best


def _points(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, v``: components as floor(scale * x); vectors that are null or hold null or non-finite components go."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return sound.select("vec_id", "label", whole.alias("v"))


def fit_codebooks(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray:
    """Codebooks ``(parts, entries, dims / parts)`` of ``rows(vec_id, v)``; fewer entries where there are fewer rows.

    They start as the parts of the ``entries`` smallest vec_ids (equal ones in order of their components, null ones last); each
    round moves an entry to the floored mean of the parts nearest to it, and leaves one that no part is nearest to.
    """
    start = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    if not start:
        return np.zeros((parts, 0, 0), np.int64)
    dims = len(start[0]["v"])
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, dims // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def _checked(points: np.ndarray) -> np.ndarray:
    if len(points) and (points.max() >= MOST_SIZE or points.min() <= -MOST_SIZE):
        raise OverflowError(f"a scaled component is not below {MOST_SIZE} in size: squared distances would not fit 64 bits")
    return points


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape
    trees = rows.sparkSession.sparkContext.broadcast([kd_tree(b) for b in books])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in slices(batches, ROWS):
            points = _checked(_points(batch, parts * width)).reshape(-1, parts, width)
            for p, tree in enumerate(trees.value):
                near, _ = nearest_entries(tree, books[p], points[:, p])
                np.add.at(sums[p], near, points[:, p])
                counts[p] += np.bincount(near, minlength=entries)
        p, e = np.nonzero(counts)
        totals = sums[p, e]
        yield pa.record_batch([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.ListArray.from_arrays(np.arange(0, totals.size + 1, width, dtype=np.int32), pa.array(totals.ravel()))], names=["part", "entry", "n", "sums"])

    added = rows.select("v").where(F.size("v") == parts * width).mapInArrow(add, "part int, entry int, n long, sums array<long>")
    total = added.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    moved = books.copy()
    for r in total.collect():  # at most parts * entries rows
        moved[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    trees.unpersist()
    return moved


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()


def encode_vectors(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of ``rows(vec_id, label, v)``: a byte per part and the summed squared distances."""
    parts, entries, width = books.shape
    kind = rows.schema["label"].dataType.simpleString()
    if not entries:
        return rows.selectExpr("vec_id", "label", "cast(null as binary) as code", "cast(null as long) as error").where("false")
    trees = rows.sparkSession.sparkContext.broadcast([kd_tree(b) for b in books])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            points = _checked(_points(batch, parts * width)).reshape(-1, parts, width)
            found = [nearest_entries(tree, books[p], points[:, p]) for p, tree in enumerate(trees.value)]
            codes = np.stack([f for f, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0, dtype=np.int64)
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.where(F.size("v") == parts * width).mapInArrow(code, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {kind}, code binary, error long")


def compress_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of ``vectors(vec_id, embedding, label)``.

    Components become floor(scale * x). ``code`` holds the number of each part's nearest entry in two hex digits, ``error`` the
    summed squared distances, ``label_error`` their sum over rows of the same label, nulls together.

    Vectors that are null, empty or hold null or non-finite components go, and so do those of another length than the vector of
    the smallest vec_id; a length that can't be cut into equal parts is an error, and so are components of 2^27 / scale or
    more. Equal vectors have equal codes; repeated vec_ids each have a row; an empty table gives an empty one; other columns
    are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a part's number must fit a byte")
    rows = scaled(vectors, scale)
    books = fit_codebooks(rows, parts, entries, rounds)
    coded = written(encode_vectors(rows, books), "codes")
    keyed = coded.withColumns({"__none": F.col("label").isNull(), "__label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    sums = written(keyed.groupBy("__none", "__label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    joined = join_skewed(keyed, sums, ["__none", "__label"])
    return joined.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
