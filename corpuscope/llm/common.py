"""What the operators of this subpackage share: word rules, folds, and tables written between stages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words, fixed by the operators' contracts: space, tab, newline, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
#: Rows that Python works on at once, so that what it makes of long texts stays small.
BATCH_ROWS = 256


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset (tests on one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = f"file://{tempfile.mkdtemp(prefix='corpuscope-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts the lineage, and a lost executor loses nothing that is needed later."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows; Spark itself bounds a batch in bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB, or one row)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fold(doc_id: Column) -> Column:
    """crc32 of the decimal id, modulo 5; remainder 0 is held out of every fit."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def input_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, one number from a scan of that column."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def bounded_sample(df: DataFrame, key: str, rows: int, seed: str) -> DataFrame:
    """About ``rows`` rows chosen by a hash of ``key`` (all, where there are fewer); the same rows whatever the partitioning."""
    total = df.count()
    if total <= rows:
        return df
    span = 1 << 32
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(span)) < F.lit(span * rows // total))


#: A table of at most so many rows (of a few dozen bytes each) may be broadcast.
BROADCAST_ROWS = 200_000
#: A key with more than one in so many of all rows is heavy; so there are fewer heavy keys than this, whatever the input.
HEAVY_SHARE = BROADCAST_ROWS


def join_skewed(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with ``table``, whose column ``n`` tells how many of ``rows`` each key has (and goes away).

    Heavy keys, of which there are fewer than HEAVY_SHARE by arithmetic, are joined by broadcast and so never meet in one
    task; the rest, where no key is hot, by shuffle.
    """
    heavy = F.col("n") > max(1000, rows.count() // HEAVY_SHARE)
    hot = rows.join(F.broadcast(table.where(heavy).drop("n")), keys)
    return hot.unionByName(rows.join(table.where(~heavy).drop("n"), keys))


def hint_small(table: DataFrame, most: int = BROADCAST_ROWS, weight: str = "1", beyond: str | None = None) -> DataFrame:
    """Broadcast a written table if its rows (or what ``weight`` sums to) allow it; else leave the join to a shuffle, by the hint ``beyond`` if any."""
    if (table.agg(F.sum(F.expr(weight)).alias("n")).first()["n"] or 0) <= most:
        return F.broadcast(table)
    return table.hint(beyond) if beyond else table
