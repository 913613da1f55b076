"""Serving tables and key lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_posts(posts: DataFrame, users: DataFrame, urls: DataFrame, titles: DataFrame) -> DataFrame:
    """Posts with author name and title (posts that lack either vanish) and their url, empty if none."""
    named = posts.join(users.select(F.col("id").alias("author"), F.col("username").alias("author_name")), "author")
    linked = named.join(urls.select(F.col("id").alias("url_id"), "url", "proto"), "url_id", "left").fillna("", ["url", "proto"])
    return linked.join(titles.select("id", F.col("text").alias("title")), "id").drop("author", "url_id")


def edge_url_metas(metas: DataFrame, urls: DataFrame) -> DataFrame:
    """Page metadata keyed by url instead of id."""
    return metas.drop("url").join(urls.select("id", "url"), "id").drop("id")


def lookup(table: DataFrame, keys: Sequence[int], key: str = "id", **defaults: Column) -> DataFrame:
    """Rows by key in the order asked for: ``pos``, the key and the other columns, null or the default where there is none."""
    spark = table.sparkSession
    asked = spark.createDataFrame([(i, int(k)) for i, k in enumerate(keys)], f"pos int, `{key}` long")
    found = table.where(F.col(key).isin([int(k) for k in keys]))
    joined = F.broadcast(asked).join(found, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()}).orderBy("pos")


def comment_list(comments: DataFrame, users: DataFrame, *, post: int | None = None, parent: int | None = None, order_by: str = "score", limit: int = 20) -> DataFrame:
    """Comments with their authors' names, of one post or parent if given, best or newest first."""
    if order_by not in ("score", "id"):
        raise ValueError("order_by must be score or id")
    found = comments
    if post is not None:
        found = found.where(F.col("post") == post)
    if parent is not None:
        found = found.where(F.col("parent") == parent)
    named = found.join(users.select(F.col("id").alias("author"), "username"), "author", "left")
    return named.orderBy(F.desc(order_by), F.desc("id")).limit(limit)


def thread_heads(items: DataFrame) -> DataFrame:
    """Of a set of comments (id, parent): those whose parent is not in the set."""
    return items.join(items.select(F.col("id").alias("parent")).distinct(), "parent", "left_anti")
