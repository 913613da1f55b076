"""Structured Streaming ingest: replayable source, hold-back, keyed rate limits, idempotent upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuscope.operators.versioned import VersionedTable

#: Requests an origin gets per window, and the windows' length.
PER_WINDOW, WINDOW = 25, "1 second"
MOST_FAILURES = 8
#: Micro-batches between compactions of an ingested table.
COMPACT_EVERY = 8
#: Errors that are worth a retry.
RAISES = ("connect", "request", "timeout", "429", "5xx")


def settled(items: DataFrame, as_of: str, hours: int = 48, ts: str = "ts") -> DataFrame:
    """Items at least so many hours old at ``as_of``."""
    return items.where(F.col(ts).cast("timestamp") <= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS"))


def admitted(requests: DataFrame, origin: str = "origin", ts: str = "ts", order: str = "id", per_window: int = PER_WINDOW, window: str = WINDOW) -> DataFrame:
    """Batch form of the rate limit: the first ``per_window`` requests of each origin and tumbling window."""
    from pyspark.sql import Window

    w = Window.partitionBy(origin, F.window(F.col(ts).cast("timestamp"), window)).orderBy(ts, order)
    return requests.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= per_window)


def admitted_stream(requests: DataFrame, origin: str = "origin", ts: str = "ts", order: str = "id", per_window: int = PER_WINDOW, window_s: int = 1) -> DataFrame:
    """Streaming form: keyed state holds the window that an origin is in and how many requests it has had."""
    spec = f"{origin} {dict(requests.dtypes)[origin]}, {order} long, {ts} timestamp, turn int"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, count = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(frames)).sort_values([ts, order])
        out = []
        for r in rows.itertuples(index=False):
            at = int(getattr(r, ts).timestamp() // window_s)
            if at > window:
                window, count = at, 0
            count += 1
            if count <= per_window:
                out.append((key[0], getattr(r, order), getattr(r, ts), count))
        state.update((window, count))
        if out:
            yield pd.DataFrame(out, columns=[origin, order, ts, "turn"])

    return requests.select(origin, order, F.col(ts).cast("timestamp").alias(ts)).groupBy(origin).applyInPandasWithState(step, spec, "window long, count long", "append", GroupStateTimeout.NoTimeout)


def failure_level(level: int, outcome: str) -> int:
    """Next failure level of an origin: retriable errors raise it, other errors lower it, a success leaves it."""
    if outcome in RAISES:
        return min(MOST_FAILURES, level + 1)
    return level if outcome == "ok" else max(0, level - 1)


def error_code(status: Column, error: Column) -> Column:
    """Outcome of a request from its HTTP status or error kind."""
    return F.when(error.isNotNull(), error).when(status == 429, "429").when(status >= 500, "5xx").when(status >= 400, status.cast("string")).otherwise("ok")


def failure_levels(outcomes: DataFrame, origin: str = "origin", order: str = "id") -> DataFrame:
    """``origin, level, blocked_s``: each origin's failure level after its outcomes in order; a level f blocks for 2^f seconds.

    A run of outcomes maps a level s to min(high, max(low, s + shift)), and such maps compose. Rows are dealt by ranges of
    (origin, order), so a hot origin spreads over many tasks; each task folds its sorted rows as they stream by into one map per
    origin, and an origin's maps, at most one per task, are applied in order.
    """
    rows = outcomes.select(F.col(origin).alias("origin"), F.col(order).alias("at"), "outcome")
    dealt = rows.repartitionByRange("origin", "at", "outcome").sortWithinPartitions("origin", "at", "outcome")
    folded = dealt.mapInArrow(_folded, T.StructType([rows.schema["origin"], T.StructField("part", T.IntegerType()), *[T.StructField(n, T.IntegerType()) for n in ("shift", "low", "high")]]))
    maps = folded.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("part", "shift", "low", "high"))).alias("maps"))
    level = F.aggregate("maps", F.lit(0), lambda s, m: F.least(m["high"], F.greatest(m["low"], s + m["shift"])))
    return maps.select(F.col("origin").alias(origin), level.alias("level")).withColumn("blocked_s", F.when(F.col("level") > 0, F.pow(F.lit(2.0), F.col("level"))).otherwise(F.lit(0.0)))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per origin of a partition sorted by origin and order; partitions are numbered in the order of their ranges."""
    part, now, shift, low, high = TaskContext.get().partitionId(), None, 0, 0, MOST_FAILURES
    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for origin, outcome in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if now is None or origin != now[0]:
                if now is not None:
                    done.append((now[0], part, shift, low, high))
                now, shift, low, high = (origin,), 0, 0, MOST_FAILURES
            shift += 1 if outcome in RAISES else 0 if outcome == "ok" else -1
            low, high = failure_level(low, outcome), failure_level(high, outcome)
        yield _maps(done, kind)
    if now is not None:
        yield _maps([(now[0], part, shift, low, high)], kind)


def _maps(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.record_batch([pa.array(list(c), kind if i == 0 else pa.int32()) for i, c in enumerate(columns)], names=["origin", "part", "shift", "low", "high"])


def read_events(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1, glob: str = "events.parquet") -> DataFrame:
    """A replayable stream over Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str, order: str, buckets: int = 64) -> DataFrame:
    """Run the stream to its present end and return the table it upserts into, a :class:`VersionedTable` under ``target``.

    A micro-batch rewrites nothing: it adds files to the buckets of its own keys, and one that is replayed is known by its number,
    so delivery is exactly once. Every COMPACT_EVERY batches, buckets with many files are merged and old versions go. A
    restart with nothing new returns the last version.
    """
    spark = stream.sparkSession
    table = VersionedTable(spark, target, stream.schema, key, order, buckets)

    def write(batch: DataFrame, number: int) -> None:
        table.upsert(batch, number)
        if number % COMPACT_EVERY == COMPACT_EVERY - 1:
            table.compact()
            table.vacuum()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()
