"""Batch features: query tables, interactions, as-of averages, time features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpuscope.functions import scalar
from corpuscope.operators.stages import cut_lineage


def comment_counts(posts: DataFrame, comment_posts: DataFrame) -> DataFrame:
    """Posts with ``comment_count``, 0 without comments."""
    counts = comment_posts.groupBy(F.col("post").alias("id")).agg(F.count("*").cast("double").alias("comment_count"))
    return posts.join(counts, "id", "left").fillna(0.0, ["comment_count"])


def _normalised(df: DataFrame) -> DataFrame:
    """Rename and normalise: ``votes, votes_norm, ts`` (epoch seconds) and ``ts_day``."""
    ends = df.agg(F.min("score").cast("double").alias("lo"), F.max("score").cast("double").alias("hi"))
    with_ends = df.crossJoin(F.broadcast(ends))  # one row
    return with_ends.withColumns({"votes": F.col("score").cast("double"), "votes_norm": scalar.log_norm(F.col("score").cast("double"), F.col("lo"), F.col("hi")), "ts_day": scalar.epoch_days(F.col("ts")), "ts": scalar.epoch_seconds(F.col("ts"))}).drop("score", "lo", "hi")


def post_table(posts: DataFrame, comment_posts: DataFrame) -> DataFrame:
    return comment_counts(_normalised(posts), comment_posts).select("id", "votes", "votes_norm", "ts", "ts_day", "comment_count")


def comment_table(comments: DataFrame, sentiments: DataFrame) -> DataFrame:
    """``sentiments`` are keyed by ``key`` = id modulo ``keys``."""
    base = _normalised(comments).withColumns({"user_id": F.col("author"), "user": F.concat(F.lit("u"), F.col("author").cast("string"))})
    n = sentiments.select("keys").first()
    keyed = base.withColumn("key", F.col("id") % (n["keys"] if n else 1))
    joined = keyed.join(sentiments.drop("keys"), "key").withColumn("sent", scalar.sentiment_sign(F.col("sent_pos"), F.col("sent_neu"), F.col("sent_neg")))
    return joined.select("id", "user_id", "user", "votes", "votes_norm", "ts", "ts_day", "sent_pos", "sent_neu", "sent_neg", "sent")


def interactions(posts: DataFrame, comments: DataFrame, sentinel: int | None = 0) -> DataFrame:
    """Distinct (user, post): who wrote a post or commented on it; ``sentinel`` stands for "none" and is left out."""
    both = posts.select(F.col("author").alias("user"), F.col("id").alias("post")).union(comments.select(F.col("author").alias("user"), "post"))
    if sentinel is not None:
        both = both.where((F.col("user") != sentinel) & (F.col("post") != sentinel))
    return both.distinct()


def running_average(rows: DataFrame, dims: int, user: str = "user_id", order: str = "id") -> DataFrame:
    """At each post of a user: the mean vectors of the user's earlier comments (``kind`` comment) and earlier posts, null if none.

    ``n_before`` and ``average`` are of comments, ``n_history`` and ``history`` of posts. Posts and comments share one id space; of
    equal ids none is before the other. Rows without a vector of ``dims`` components are left out.

    Rows are dealt by ranges of (user, id), so a user with many spreads over many tasks. A task adds up its rows as they stream by,
    and returns, besides the sums before each post, one row with those of its last user; what these add to the first
    users of later tasks is one more pass over two rows a task.
    """
    sound = rows.where(F.size("embedding") == dims).select(F.col(user).alias("user"), F.col(order).alias("at"), (F.col("kind") == "comment").alias("comment"), F.col("embedding").cast("array<double>").alias("v"))
    dealt = sound.repartitionByRange("user", "at").sortWithinPartitions("user", "at")
    keys = T.StructType([sound.schema["user"], sound.schema["at"]])
    shape = T.StructType([*keys, *T.StructType([T.StructField(n, T.LongType()) for n in ("n_before", "n_history")]), *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("sum_before", "sum_history")], T.StructField("part", T.IntegerType()), T.StructField("role", T.IntegerType())])
    summed = cut_lineage(dealt.mapInArrow(_sums_before(dims, to_arrow_schema(shape)), shape))
    ends = summed.where(F.col("role") != _ROW).coalesce(1).sortWithinPartitions("user", "part", "role")
    carried = ends.mapInArrow(_carried(dims, to_arrow_schema(shape)), shape).select("part", F.col("user").alias("__user"), *[F.col(c).alias(f"c_{c}") for c in ("n_before", "n_history", "sum_before", "sum_history")])
    # one row a task, and only where a user goes on from the task before
    joined = summed.where(F.col("role") == _ROW).join(carried, "part", "left").withColumn("on", F.col("__user").eqNullSafe(F.col("user")) & F.col("c_n_before").isNotNull())
    made = [F.col("user").alias(user), F.col("at").alias(order)]
    for n, total, mean in (("n_before", "sum_before", "average"), ("n_history", "sum_history", "history")):
        # named apart from the results: a name within a lambda may be taken for a result beside it
        joined = joined.withColumns({f"all_{n}": F.col(n) + F.when(F.col("on"), F.col(f"c_{n}")).otherwise(0), f"all_{total}": F.when(F.col("on"), F.zip_with(total, f"c_{total}", lambda x, y: x + y)).otherwise(F.col(total))})
        made += [F.col(f"all_{n}").alias(n), F.when(F.col(f"all_{n}") > 0, F.transform(f"all_{total}", lambda x: x / F.col(f"all_{n}"))).alias(mean)]  # noqa: B023
    return joined.select(*made)


#: What a row of partial sums is: those before a post, those of a task's first user (to be filled in), those of its last user.
_ROW, _FIRST, _LAST = 0, 1, 2


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums_before(dims: int, fields: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (user, at, comment, v) sorted by user and at: what lies before each post within the task."""

    def batch_of(users: pa.Array, at: pa.Array, counts: np.ndarray, sums: np.ndarray, part: int, role: int) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(np.arange(0, len(sums) * dims + 1, dims, dtype=np.int32), pa.array(sums[:, i].ravel())) for i in (0, 1)]
        columns = [users, at, pa.array(counts[:, 0]), pa.array(counts[:, 1]), *lists, pa.array(np.full(len(sums), part, np.int32)), pa.array(np.full(len(sums), role, np.int32))]
        return pa.record_batch([c.cast(f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begun, user = TaskContext.get().partitionId(), False, None
        sums, counts = np.zeros((2, dims)), np.zeros(2, np.int64)  # of the user at hand: comments, posts
        late_sums, late_counts, late_at = np.zeros((2, dims)), np.zeros(2, np.int64), None  # and of its rows with the last id
        for batch in batches:
            if not batch.num_rows:
                continue
            names, ids = batch.column(0), batch.column(1)
            x, comment = _matrix(batch.column(3), dims), batch.column(2).to_numpy(zero_copy_only=False)
            who, when = names.to_pylist(), ids.to_pylist()
            posts, before_n, before = [], [], []
            if not begun:
                begun, user = True, (who[0],)
                yield batch_of(names.slice(0, 1), ids.slice(0, 1), np.zeros((1, 2), np.int64), np.zeros((1, 2, dims)), part, _FIRST)
            for i in range(batch.num_rows):
                if who[i] != user[0]:
                    user, sums, counts = (who[i],), np.zeros((2, dims)), np.zeros(2, np.int64)
                    late_sums, late_counts, late_at = np.zeros((2, dims)), np.zeros(2, np.int64), None
                if when[i] != late_at:
                    sums, counts = sums + late_sums, counts + late_counts
                    late_sums, late_counts, late_at = np.zeros((2, dims)), np.zeros(2, np.int64), when[i]
                side = 0 if comment[i] else 1
                if side:
                    posts.append(i)
                    before_n.append(counts)
                    before.append(sums)
                late_sums[side] += x[i]
                late_counts[side] += 1
            if posts:
                take = pa.array(posts)
                yield batch_of(names.take(take), ids.take(take), np.array(before_n), np.array(before), part, _ROW)
        if begun:
            yield batch_of(pa.array([user[0]], fields.field(0).type), pa.array([None], fields.field(1).type), (counts + late_counts)[None], (sums + late_sums)[None], part, _LAST)

    return run


def _carried(dims: int, fields: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the firsts and lasts of all tasks, sorted by user and task: the firsts with what earlier tasks hold of their user."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, sums, counts = (), np.zeros((2, dims)), np.zeros(2, np.int64)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if user != (r["user"],):
                    user, sums, counts = (r["user"],), np.zeros((2, dims)), np.zeros(2, np.int64)
                if r["role"] == _LAST:
                    sums, counts = sums + np.array([r["sum_before"], r["sum_history"]]), counts + np.array([r["n_before"], r["n_history"]])
                elif counts.any():
                    rows.append(r | {"n_before": int(counts[0]), "n_history": int(counts[1]), "sum_before": sums[0].tolist(), "sum_history": sums[1].tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return run


def interaction_training(interactions: DataFrame, posts: DataFrame, comments: DataFrame, dims: int) -> DataFrame:
    """``user, post, n_before, average, n_history, history``: one row per interaction with an embedded post.

    At each post, for each user that interacts with it: the mean vectors of the user's comments with smaller ids and of the
    posts with smaller ids that the user interacted with. ``interactions(user, post)``, ``posts(id, embedding)``,
    ``comments(id, user, embedding)``; posts and comments share one id space. Interactions with other posts are left out.
    """
    met = interactions.select("user", F.col("post").alias("id")).distinct().join(posts.select("id", "embedding"), "id")
    rows = met.select("user", "id", F.lit("post").alias("kind"), "embedding").unionByName(comments.select("user", "id", F.lit("comment").alias("kind"), "embedding"))
    return running_average(rows, dims, user="user").withColumnRenamed("id", "post")


def time_features(posts: DataFrame) -> DataFrame:
    """Training features of posts: log score, relative time, and cyclic positions in the year, month, week and day."""
    ts = F.col("ts").cast("timestamp")
    year, month, week = (scalar.days_into(ts, u) for u in ("year", "month", "week"))
    month_days = F.dayofmonth(F.last_day(ts)).cast("double")
    out = {"log_score": scalar.log_score(F.col("score")), "ts_rel": scalar.relative_time(ts)}
    for name, value, top in (("year", year, 365.0), ("month", month, month_days), ("week", week, 6.0), ("day", F.hour(ts).cast("double"), 23.0)):
        out[f"{name}_sin"], out[f"{name}_cos"] = scalar.cyclic(value, top)
    return posts.select("id", *[c.alias(n) for n, c in out.items()])


def cumulative(groups: DataFrame, value: str, order: str = "group") -> DataFrame:
    """Running sum over the few rows of a grouped result."""
    return groups.withColumn("cumulative", F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def ranked(groups: DataFrame, value: str, tie: str) -> DataFrame:
    """Rank the few rows of a limited result."""
    return groups.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), tie)))


def contiguous_prefix(done: DataFrame, start: int) -> DataFrame:
    """One row: the largest n such that all ids from ``start`` to n are there; start - 1 if start is missing.

    The first gap is the smallest id whose successor is missing: one anti-join and a minimum, no global window.
    """
    ids = done.where(F.col("id") >= start).select("id").distinct()
    last = ids.join(ids.select((F.col("id") - 1).alias("id")), "id", "left_anti").agg(F.min("id").alias("last"))
    first = ids.agg(F.min("id").alias("first"))
    return last.crossJoin(first).select(F.when(F.col("first") == start, F.col("last")).otherwise(F.lit(start - 1)).cast("long").alias("committed"))


