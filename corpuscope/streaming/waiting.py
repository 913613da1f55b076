"""Streams that wait: tasks for what they depend on, items for their changes to end. State is bounded by event time and empties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def wait_for(tasks: DataFrame, arrivals: DataFrame, key: str, ts: str = "ts", *, limit: str = "10 days", keep: str = "30 days", late: str = "1 day", salts: int = 8) -> DataFrame:
    """Tasks joined with the arrival of what they wait for, or with nulls once the limit is over.

    ``tasks`` and ``arrivals`` are streams (or tables) that share ``key`` and the event time ``ts``; the other columns of arrivals
    must have names of their own. A task meets the arrivals from ``keep`` before it to ``limit`` behind it, and comes out as soon as
    one is there; if none comes, it leaves when the watermarks, which trail the events by ``late``, have passed its limit. Several
    arrivals of a key in that time give as many rows. Tasks with a null key wait for nothing and come out at the limit.

    Tasks of one key are spread over ``salts`` parts, to each of which its arrivals go, so that a key that many wait for is
    not one task's work. State holds tasks up to ``limit`` and arrivals up to ``keep``, by the watermark of both streams.
    Rows more than ``late`` behind may be missed, as in any stream.
    """
    salt = F.pmod(F.xxhash64(*[c for c in tasks.columns if tasks.schema[c].dataType.typeName() not in ("map", "variant")]), F.lit(salts)).cast("int")
    left = tasks.withColumn("__salt", salt).withWatermark(ts, late)
    rename = {key: "__key", ts: "arrived"}
    named = arrivals.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnsRenamed(rename)
    right = named.withWatermark("arrived", late)
    same = (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__part"))
    timely = (F.col("arrived") >= F.col(ts) - F.expr(f"INTERVAL {keep}")) & (F.col("arrived") <= F.col(ts) + F.expr(f"INTERVAL {limit}"))
    return left.join(right, same & timely, "left_outer").drop("__salt", "__part", "__key")


def settled_stream(items: DataFrame, key: str, version: str, ts: str = "ts", *, hold: str = "48 hours") -> DataFrame:
    """Items once the stream's events are ``hold`` past them, each once, in its greatest ``version``.

    Items arrive in any order within that time, as often as they change; a version that comes later than that is too late and is
    dropped, so a replay gives nothing new. State holds an item until it leaves.
    """
    rest = [c for c in items.columns if c not in (key, ts)]
    held = items.withWatermark(ts, hold).groupBy(key, ts).agg(F.max_by(F.struct(*rest), F.col(version)).alias("__r"))
    return held.select(*[F.col(c) if c in (key, ts) else F.col(f"__r.{c}").alias(c) for c in items.columns])


def distinct_stream(items: DataFrame, key: str, ts: str = "ts", *, within: str = "48 hours") -> DataFrame:
    """The first row of each key; a repeat is dropped if its event time is within ``within`` of the first, whatever else it holds."""
    return items.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def session_for_state(spark: SparkSession) -> SparkSession:
    """A session of its own for a stateful stream, with at most as many state partitions as the cluster has cores (8 at least).

    The number stays for the life of a checkpoint, and unlike a batch's partitions Spark doesn't merge small ones.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(8, spark.sparkContext.defaultParallelism))))
    return own


def drain(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Run a stream in append mode to its present end into Parquet files under ``target``; a restart goes on where it ended.

    The file sink's log names the files of each finished batch, so that readers see every row once, whatever was begun twice.
    """
    query = stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def state_rows(query: StreamingQuery) -> int:
    """Rows that the stateful operators of a query held after its last batch."""
    last = query.lastProgress
    return sum(op.numRowsTotal for op in last.stateOperators) if last else 0


def deal_out(rows: DataFrame, folder: str, files: int, ts: str = "ts", disorder: str = "0 seconds", first: int = 0) -> list[str]:
    """Write ``rows`` as ``files`` source files in order of time, shuffled by up to ``disorder``: a replayable, unordered stream.

    Times are cut into equal ranges; a row goes to the range of its time plus a hash-chosen part of ``disorder``. Returns the
    folders, in order, named from ``first`` on.
    """
    spark: SparkSession = rows.sparkSession
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    ends = rows.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi")).first()
    if ends["lo"] is None:
        return []
    most = _seconds(spark, disorder)
    jitter = F.pmod(F.xxhash64(*rows.columns), F.lit(1000)) / 1000.0 * most * 1e6
    width = (ends["hi"] - ends["lo"] + most * 1e6) / files + 1
    number = F.floor((micros - ends["lo"] + jitter) / width).cast("int")
    out = []
    for i in range(files):
        path = f"{folder}/in={first + i:05d}"
        rows.where(number == i).coalesce(1).write.parquet(path)
        out.append(path)
    return out


def _seconds(spark: SparkSession, interval: str) -> float:
    stamp = F.lit("2000-01-01").cast("timestamp")
    return spark.range(1).select(F.unix_seconds(stamp + F.expr(f"INTERVAL {interval}")) - F.unix_seconds(stamp)).first()[0]
