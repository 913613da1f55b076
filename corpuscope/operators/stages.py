"""Tables between the steps of an operator: cut lineages, written tables, and joins on keys that may be hot."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with more than one in so many of all rows is hot; there are fewer hot keys than this, whatever the table.
HOT_SHARE = 200_000
#: Rows of a key are ranked in so many parts before they are ranked together, so that no task ranks those of a hot key alone.
PARTS = 16


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the session names in ``spark.checkpoint.dir``; in a temporary one where that is unset (one machine)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="corpuscope-checkpoints-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; a temporary one where that is unset (one machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='corpuscope-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: what several steps read is computed once."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def join_on_hot(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``table``, which has at most one row per ``key``, where some keys may hold a large part of ``rows``.

    Hot keys, fewer than HOT_SHARE by arithmetic, meet their rows by broadcast and never gather in one task; the others, where
    no key is hot, by shuffle. Both tables should be cut or written, as they are read twice.
    """
    counts = rows.groupBy(key).count()
    hot = cut_lineage(counts.where(F.col("count") > max(1000, rows.count() // HOT_SHARE)).select(key))
    some = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key, how)
    return some.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, how))


def first_of(rows: DataFrame, key: str | list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key, ranked in parts and then the parts' best."""
    keys = [key] if isinstance(key, str) else key
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS))
    for by in ([*keys, part], keys):
        rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__place") <= n).drop("__place")
    return rows
