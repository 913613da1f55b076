"""A source of ids with offsets of its own, and jobs that work through all ids once, whatever stops them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from corpuscope.operators.versioned import VersionedTable


class IdRanges(DataSource):
    """Stream format ``id_ranges``: rows (first, last) that cut the ids ``first`` to ``last`` (options) into ranges.

    Each micro-batch takes the next ``per_batch`` ids in ``ranges`` rows, so the driver makes a bounded number of rows, and the
    ids themselves are made by the tasks. The offset is the next id. The same offsets give the same rows.
    """

    @classmethod
    def name(cls) -> str:
        return "id_ranges"

    def schema(self) -> str:
        return "first long, last long"

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:  # noqa: N802  the interface's name
        return _Ranges({k: int(self.options.get(k, d)) for k, d in (("first", 0), ("last", -1), ("per_batch", 100_000), ("ranges", 64))})


class _Ranges(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, int]) -> None:
        self.first, self.last, self.per_batch, self.ranges = (options[k] for k in ("first", "last", "per_batch", "ranges"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": self.first}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"next": max(start["next"], min(start["next"] + self.per_batch, self.last + 1))}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        lo, hi = start["next"], end["next"]
        step = -(-(hi - lo) // self.ranges) if hi > lo else 1
        return iter([(at, min(at + step, hi) - 1) for at in range(lo, hi, step)])


def id_stream(spark: SparkSession, first: int, last: int, per_batch: int, ranges: int = 64) -> DataFrame:
    """A stream of the ids from ``first`` to ``last``, ``per_batch`` at a time."""
    spark.dataSource.register(IdRanges)
    options = {"first": first, "last": last, "per_batch": per_batch, "ranges": ranges}
    # as many tasks as ranges: each makes the ids of its own
    return spark.readStream.format("id_ranges").options(**{k: str(v) for k, v in options.items()}).load().repartition(ranges).select(F.explode(F.sequence("first", "last")).alias("id"))


def work_through(spark: SparkSession, folder: str, last: int, work: Callable[[DataFrame], DataFrame], schema: T.StructType, *, first: int = 0, per_batch: int = 100_000, buckets: int = 64) -> VersionedTable:
    """Work on the ids up to ``last`` and return the table of the results, which have the key ``id`` and a boolean ``done``.

    ``work`` gets each batch's ids and returns a row of ``schema`` for each, with ``done`` false if it must be asked for again. A
    batch that fails stops the run; the next one begins with the same batch, and results that were written already are
    known by its number. See :func:`committed` for how far all work is done.
    """
    table = VersionedTable(spark, f"{folder}/results", schema, "id", "id", buckets)

    def write(ids: DataFrame, number: int) -> None:
        table.upsert(work(ids), number)

    query = id_stream(spark, first, last, per_batch).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return table


def committed(table: VersionedTable, first: int = 0) -> int:
    """The next id to commit: all before it are done, however many behind it are, too."""
    from corpuscope.operators.features import contiguous_prefix

    return contiguous_prefix(table.read().where("done"), first).first()["committed"] + 1


__all__ = ["IdRanges", "StreamingQueryException", "committed", "id_stream", "work_through"]
