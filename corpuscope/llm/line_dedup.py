r"""Line de-duplication: lines that many documents share stay in one of them.

Every line gets a normalised key; keys are hashed (128 bits) and the distinct documents of each hash counted; lines whose
key reaches the threshold are dropped everywhere but in the smallest doc_id that holds it, and the rest is put together
again by position. To find them, no line text is shuffled: one row per distinct (document, hash) is. To rebuild the texts, one
array of dropped positions per document is joined to them, by broadcast where the checked size of all arrays allows it;
beyond that the join shuffles every text once, unsorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.llm.common import hint_small, join_skewed, slices, written


def normalised(line: bytes) -> bytes:
    """The key of a line: ASCII white space stripped at both ends, A-Z lower-cased, all else as it is."""
    return line.strip().lower()  # bytes methods know ASCII only


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, row, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at: dict[bytes, list[int]] = {}
                for i, line in enumerate(text.encode().split(b"\n")):
                    key = normalised(line)
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        at.setdefault(digest(key), []).append(i)
                for d, places in at.items():
                    out[0].append(int.from_bytes(d[:8], "little", signed=True))
                    out[1].append(int.from_bytes(d[8:], "little", signed=True))
                    out[2].append(doc)
                    out[3].append(row)
                    out[4].append(places)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["h1", "h2", "doc", "row", "places"])

    return run


def _rebuild(texts: list[str | None], drops: list[list[int] | None]) -> Iterator[tuple[str, int, int]]:
    for text, drop in zip(texts, drops, strict=True):
        lines = (text or "").split("\n")
        gone = set(drop or ())
        yield "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text or "", len(lines), len(gone)


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``text`` rebuilt, plus ``n_lines`` (before dropping) and ``n_dropped``.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except those
    in the smallest doc_id that holds the key. Null and empty texts are one empty line; the result's text is never null.
    A row whose doc_id is null neither counts as a document nor loses a line. Rows that share a doc_id are one document
    for counting; each is rebuilt from its own text. Columns named n_lines or n_dropped are replaced; other columns pass
    through. Ties cannot arise: the smallest doc_id is unique. An empty table gives an empty table; a very long text is split whole in its task.
    """
    spark = docs.sparkSession
    keys = written(
        docs.where("doc_id is not null and length(text) > 0").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("row"), "text")
        .mapInArrow(_keys(min_chars), "h1 long, h2 long, doc long, row long, places array<int>"),
        "line-keys",
    )
    if min_docs <= 2:  # the smallest and the largest document differ, which map-side sums can tell
        shared = keys.groupBy("h1", "h2").agg(F.min("doc").alias("keep"), F.max("doc").alias("last"), F.count("*").alias("n")).where("keep < last").drop("last")
    else:
        shared = keys.groupBy("h1", "h2", "doc").agg(F.count("*").alias("n")).groupBy("h1", "h2").agg(F.min("doc").alias("keep"), F.count("*").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= min_docs).drop("docs")
    shared = written(shared, "line-shared")
    lost = join_skewed(keys, shared, ["h1", "h2"]).where("doc > keep").select("doc", "row", "places").distinct()
    # beyond a broadcast, each partition's drops (one row a document) are hashed, so texts stream by and are never held and sorted
    drops = hint_small(written(lost.groupBy("doc", "row").agg(F.flatten(F.collect_list("places")).alias("__drop")), "line-drops").withColumnsRenamed({"doc": "__doc", "row": "__row"}), weight="10 + size(__drop)", beyond="shuffle_hash")
    plain = docs.drop("n_lines", "n_dropped", "__drop", "__doc", "__row")
    keyed = plain.withColumns({"__doc": F.col("doc_id").cast("long"), "__row": F.xxhash64("text")})
    joined = keyed.join(drops, ["__doc", "__row"], "left")
    names = [*plain.columns, "__drop"]
    schema = T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in plain.schema] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at = plain.columns.index("text")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = list(_rebuild(batch.column(at).to_pylist(), batch.column(len(names) - 1).to_pylist()))
            cols = [batch.column(i) for i in range(len(names) - 1)]
            cols[at] = pa.array([r[0] for r in rows], pa.string())
            cols += [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)]
            yield pa.record_batch(cols, names=[*names[:-1], "n_lines", "n_dropped"])

    return joined.select(*names).mapInArrow(rebuilt, schema)
