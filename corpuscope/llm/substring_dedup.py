"""Substring de-duplication: passages of many words that an earlier document has are cut from later ones.

A window is 50 consecutive words. There are about as many windows as words, and nearly all of them occur once, so they
are not grouped outright. A count-min sketch goes first:

1. Every task counts its windows in two rows of cells (saturating at 2) and ships its cells, sorted and packed with the
   chunks of documents that they came from, by block of cells. Partial sketches of a block meet in one task, which merges
   them. The sketch is as wide as the input is long and nowhere held whole: a block has a fixed number of cells, and more
   input means more blocks.
2. Each block answers to the chunks that a cell came from, with the cells counted twice or more. An estimate is never too
   low, so no repeated window is lost.
3. Each chunk looks its windows up and passes on only those estimated repeated; these are grouped exactly, by 96-bit hash.

Exact copies of a whole text are settled by their digest before that: they need no windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.llm.common import hint_small, input_bytes, join_skewed, slices, written
from corpuscope.llm.hashing import MIX_3, mix, window_hashes, word_hashes

#: Cells of one block of one row of the sketch (2^23), windows a task counts before it ships them, and input bytes of a chunk.
BLOCK_BITS, FLUSH_WINDOWS, CHUNK_BYTES = 23, 3_000_000, 20_000_000
#: Cells of a row for each window, at least; with two rows, about one unrepeated window in thirty is passed on.
CELLS_PER_WINDOW = 4


def _cell(h: np.ndarray, bits: int, row: int) -> np.ndarray:
    """The cell of each window in a row of the sketch."""
    return (mix(h * MIX_3) if row else h) >> np.uint64(64 - bits)


def _pack(sorted_offsets: np.ndarray) -> bytes:
    return zlib.compress(np.diff(sorted_offsets, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<u4"), dtype=np.uint32)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.append(np.flatnonzero(new), len(keys[0]))


def _pack_numbers(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)  # equal bytes side by side


def _unpack_numbers(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _by_cell(cell: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by cell, then chunk; as one packed key where both fit."""
    wide = np.uint64(int(chunk.max(initial=0)).bit_length())
    if int(cell.max(initial=0)).bit_length() + int(wide) <= 64:
        key = (cell << wide) | chunk.astype(np.uint64)
        key.sort()
        return key >> wide, (key & np.uint64((1 << int(wide)) - 1)).astype(np.int64)
    order = np.lexsort((chunk, cell))
    return cell[order], chunk[order]


def _first_of_text(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Mask: each distinct window of a text once."""
    order = np.argsort(h, kind="stable")  # texts come in order, so equal windows stay sorted by text
    keep = np.zeros(len(h), bool)
    keep[order[_runs(h[order], text[order])[:-1]]] = True
    return keep


def _pieces(h: np.ndarray, chunk: np.ndarray, bits: int) -> pa.RecordBatch:
    """What is shipped of some windows and their chunks: one piece per row and block."""
    out: list[list] = [[], [], [], []]
    for row in (0, 1):
        c, k = _by_cell(_cell(h, bits, row), chunk)
        third = np.ones(len(c), bool)  # counts saturate at 2: a third equal cell of a chunk adds nothing
        third[2:] = (c[2:] != c[:-2]) | (k[2:] != k[:-2])
        c, k = c[third], k[third]
        block, offset = c >> np.uint64(BLOCK_BITS), (c & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32)
        edges = _runs(block)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            out[0].append(row)
            out[1].append(int(block[a]))
            out[2].append(_pack_numbers(np.diff(offset[a:b], prepend=np.uint32(0))))
            out[3].append(_pack_numbers(k[a:b]))
    return pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["row", "block", "cells", "chunks"])


def _sketch(window: int, bits: int):
    def flush(hashes: list[np.ndarray], chunks: list[np.ndarray]) -> pa.RecordBatch:
        return _pieces(np.concatenate(hashes), np.concatenate(chunks), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, chunks, held = [], [], 0
        for batch in slices(batches):
            words, ends = word_hashes([t.encode() for t in batch.column(1).to_pylist()])
            h, text, _ = window_hashes(words, ends, window)
            keep = _first_of_text(h, text)
            hashes.append(h[keep])
            chunks.append(batch.column(0).to_numpy().astype(np.int32)[text[keep]])
            held += len(hashes[-1])
            if held >= FLUSH_WINDOWS:
                yield flush(hashes, chunks)
                hashes, chunks, held = [], [], 0
        if held:
            yield flush(hashes, chunks)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Of one block: for each chunk, its cells that all chunks together count twice or more."""
    offset = np.concatenate([np.cumsum(_unpack_numbers(p), dtype=np.uint32) for p in table["cells"].to_pylist()])
    chunk = np.concatenate([_unpack_numbers(p) for p in table["chunks"].to_pylist()]).astype(np.int64)
    order = np.argsort(offset, kind="stable")
    sizes = np.diff(_runs(offset[order]))
    repeated = np.zeros(len(offset), bool)
    repeated[order] = np.repeat(sizes > 1, sizes)
    o, k = offset[repeated], chunk[repeated]
    order = np.lexsort((o, k))
    o, k = o[order], k[order]
    edges = _runs(k)[:-1], _runs(k)[1:]
    answers = [(int(k[a]), _pack(np.unique(o[a:b]))) for a, b in zip(*(e.tolist() for e in edges), strict=True)]
    row, block = table["row"][0].as_py(), table["block"][0].as_py()
    return pa.table({"chunk": pa.array([a[0] for a in answers], pa.int64()), "row": pa.array([row] * len(answers), pa.int32()), "block": pa.array([block] * len(answers), pa.int64()), "packed": pa.array([a[1] for a in answers], pa.binary())})


def _lookup(window: int, bits: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        found = []
        for row in (0, 1):
            mine = [(b, p) for r, b, p in zip(*(answers[c].to_pylist() for c in ("row", "block", "packed")), strict=True) if r == row]
            found.append(np.concatenate([np.zeros(0, np.uint64), *[(np.uint64(b) << np.uint64(BLOCK_BITS)) + _unpack(p).astype(np.uint64) for b, p in sorted(mine)]]))
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        if len(found[0]) and len(found[1]):
            for batch in docs.to_batches(max_chunksize=256):
                words, ends = word_hashes([t.encode() for t in batch.column("text").to_pylist()])
                h, text, place = window_hashes(words, ends, window)
                hit = np.ones(len(h), bool)
                for row, known in enumerate(found):
                    cells = _cell(h, bits, row)
                    at = np.searchsorted(known, cells)
                    hit &= known[np.minimum(at, len(known) - 1)] == cells
                if hit.any():
                    second = window_hashes(words, ends, window, 1)[0]
                    out[0].append(h[hit].view(np.int64))
                    out[1].append((second[hit] >> np.uint64(33)).astype(np.int32))
                    out[2].append(batch.column("doc").to_numpy()[text[hit]])
                    out[3].append(batch.column("row").to_numpy()[text[hit]])
                    out[4].append(place[hit].astype(np.int32))
        kinds = (np.int64, np.int32, np.int64, np.int64, np.int32)
        return pa.table([pa.array(np.concatenate([np.zeros(0, t), *x])) for x, t in zip(out, kinds, strict=True)], names=["h1", "h2", "doc", "row", "place"])

    return run


def _cut(text: str | None, starts: list[int] | None, whole: bool | None, window: int) -> tuple[str | None, int, int]:
    words = (text or "").encode().split()
    n = len(words)
    if whole and n >= window:
        return "", n, n
    if not starts:
        return text, n, 0
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.asarray(starts) + window, -1)
    gone = np.cumsum(steps)[:n] > 0
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode(), n, int(gone.sum())


def remove_repeated_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated passages cut from ``text``, plus ``n_words`` (before) and ``n_removed``.

    A word goes if a window of ``window`` words covers it whose word sequence also starts in a document of smaller doc_id.
    Windows are judged on the input, not on what is left. Words are runs of characters other than ASCII white space. A text
    that loses words becomes its kept words joined by one space; others stay as they are, null included. A row whose doc_id
    is null loses nothing and takes nothing from others. Rows that share a doc_id are one document: they don't cut each
    other. An empty table gives an empty table. A very long text is
    hashed whole in its task, at about 30 bytes a word. Columns named n_words or n_removed are replaced; others pass through.
    """
    spark = docs.sparkSession
    n_bytes = input_bytes(docs)
    bits = max(BLOCK_BITS + 3, int(np.ceil(np.log2(max(1, n_bytes / 6 * CELLS_PER_WINDOW)))))
    n_chunks = max(24, -(-n_bytes // CHUNK_BYTES))
    keyed = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("row"), "text")

    digests = written(keyed.where(F.octet_length("text") >= 2 * window - 1).select("doc", "row", F.unhex(F.md5("text")).alias("digest")), "digests")
    alike = digests.groupBy("digest").agg(F.min("doc").alias("keep"), F.max("doc").alias("last"), F.count("*").alias("n")).where("keep < last").drop("last")
    copies = written(join_skewed(digests, written(alike, "alike"), ["digest"]).where("doc > keep").select("doc", "row").distinct(), "copies")
    firsts = keyed.join(hint_small(copies), ["doc", "row"], "left_anti").withColumn("chunk", F.pmod(F.xxhash64("doc", F.lit("chunk")), F.lit(n_chunks)))

    partial = firsts.select("chunk", "text").mapInArrow(_sketch(window, bits), "row int, block long, cells binary, chunks binary")
    answers = written(partial.groupBy("row", "block").applyInArrow(_merge, "chunk long, row int, block long, packed binary"), "cells")
    suspects = written(firsts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_lookup(window, bits), "h1 long, h2 int, doc long, row long, place int"), "windows")

    repeated = suspects.groupBy("h1", "h2").agg(F.min("doc").alias("keep"), F.max("doc").alias("last"), F.count("*").alias("n")).where("keep < last").drop("last")
    starts = join_skewed(suspects, written(repeated, "repeated"), ["h1", "h2"]).where("doc > keep").groupBy("doc", "row").agg(F.collect_set("place").alias("__starts"))
    cuts = written(starts.withColumn("__whole", F.lit(False)).unionByName(copies.select("doc", "row", F.array().cast("array<int>").alias("__starts"), F.lit(True).alias("__whole"))), "cuts")

    plain = docs.drop("n_words", "n_removed", "__starts", "__whole", "__doc", "__row")
    joined = plain.withColumns({"__doc": F.col("doc_id").cast("long"), "__row": F.xxhash64("text")}).join(hint_small(cuts.withColumnsRenamed({"doc": "__doc", "row": "__row"}), weight="10 + size(__starts)"), ["__doc", "__row"], "left")
    names, at = plain.columns, plain.columns.index("text")
    schema = T.StructType([*plain.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [_cut(*x, window) for x in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)]
            cols = [batch.column(i) for i in range(len(names))]
            cols[at] = pa.array([r[0] for r in rows], pa.string())
            cols += [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)]
            yield pa.record_batch(cols, names=[*names, "n_words", "n_removed"])

    return joined.select(*names, "__starts", "__whole").mapInArrow(rebuilt, schema)
