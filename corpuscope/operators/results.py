"""What is done with finished results: pages of them, unions, samples, and whole datasets written and read."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.scalar import key_hash
from corpuscope.plans.query import Dataset


@dataclass(frozen=True)
class Page:
    """A page of results and the mark that the next one begins behind: the value of the order and the id of its last row; none at the end."""

    rows: DataFrame
    after: tuple[float, int] | None


def page(rows: DataFrame, order: str, size: int = 20, after: tuple[float, int] | None = None, key: str = "id") -> Page:
    """The next ``size`` rows by ``order`` descending, then ``key``, behind ``after``.

    A page is found by its mark and not by counting the rows before it, so rows that come or go on earlier pages move nothing, and
    the filter reaches the scan. Rows with a null or NaN order are on no page.
    """
    found = rows.where(F.col(order).isNotNull() & ~F.isnan(F.col(order).cast("double")))
    if after is not None:
        value, last = after
        found = found.where((F.col(order) < F.lit(value)) | (F.col(order) == F.lit(value)) & (F.col(key) > F.lit(last)))
    best = found.orderBy(F.desc(order), F.asc(key)).limit(size)
    ends = best.select(F.col(order).alias("o"), F.col(key).alias("k")).tail(1)
    return Page(best, (ends[0]["o"], ends[0]["k"]) if ends else None)


def shuffled(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """``n`` rows in an order that looks random and is the same for the same seed."""
    return rows.orderBy(key_hash(F.col(key) + F.lit(seed) * 7919), key).limit(n)


def union_ids(*parts: DataFrame, key: str = "id") -> DataFrame:
    """``key, part``: the ids of all parts, each once, with the number of the first part that has it."""
    numbered = [p.select(key, F.lit(i).alias("part")) for i, p in enumerate(parts)]
    both = numbered[0]
    for p in numbered[1:]:
        both = both.unionByName(p)
    return both.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("part").alias("part"))


def shown(items: DataFrame, *needed: str) -> DataFrame:
    """Rows that have all of ``needed``: not null, and not empty where it is text."""
    texts = {f.name for f in items.schema if f.dataType.simpleString() == "string"}
    sound: Column = F.lit(True)
    for c in needed:
        sound = sound & F.col(c).isNotNull() & ((F.col(c) != "") if c in texts else F.lit(True))
    return items.where(sound)


def write_dataset(dataset: Dataset, folder: str, **about: str | int | float) -> None:
    """A dataset's rows and vectors as Parquet, and one JSON line with its name and what else is known of it, written last."""
    dataset.rows.write.mode("overwrite").parquet(f"{folder}/rows")
    dataset.vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
    spark = dataset.rows.sparkSession
    spark.createDataFrame([(json.dumps({"name": dataset.name} | about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")


def read_dataset(spark: SparkSession, folder: str) -> tuple[Dataset, dict]:
    """A dataset that :func:`write_dataset` wrote, and what is known of it."""
    about = json.loads(spark.read.text(f"{folder}/about").first()[0])
    return Dataset(about["name"], spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/vectors")), about
