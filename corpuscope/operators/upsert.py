"""Upserts on plain tables: latest version per key, dictionary encoding, rows not seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.operators.stages import cut_lineage


def upsert_latest(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one of greatest ``order``; a change wins a tie with the current row."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    rest = [c for c in current.columns if c != key]
    picked = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, "__new")).alias("r"))
    return picked.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in current.columns])


def dictionary_encode(dictionary: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """``dictionary`` (id, name) with new names added, numbered on from the largest id in order of their names.

    Numbers are given by a range partitioning, counts per partition and places within it, so nothing is sorted in one task. The
    places are written before they are counted, so a lost executor can't change a number.
    """
    fresh = names.select(name).where(F.col(name).isNotNull()).distinct().join(dictionary, name, "left_anti")
    spark = dictionary.sparkSession
    ordered = cut_lineage(fresh.repartitionByRange(name).sortWithinPartitions(name).select(name, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    counts = {r["part"]: (r["first"], r["n"]) for r in ordered.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n")).collect()}
    top, offsets = dictionary.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0], []
    for part in sorted(counts):
        first, n = counts[part]
        offsets.append((part, top + 1 - first))
        top += n
    shift = spark.createDataFrame(offsets or [(0, 0)], "part int, shift long")
    numbered = ordered.join(F.broadcast(shift), "part").select((F.col("at") + F.col("shift")).alias("id"), name)
    return dictionary.select("id", name).unionByName(numbered)


def not_seen(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys that ``known`` lacks."""
    return candidates.select(key).distinct().join(known.select(key), key, "left_anti")
