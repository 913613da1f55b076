"""The registered queries over a star-schema data folder, each beside the SQL that must give the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import encoders, html, scalar, vectors
from corpuscope.operators import contexts, features, ml, serve, spatial, upsert
from corpuscope.operators.stages import stored
from corpuscope.plans import endpoints
from corpuscope.plans.query import Clip, GroupByOutput, ItemsOutput, QueryInput, compile_query
from corpuscope.sources import tables as t
from corpuscope.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = t.NOW_DAYS

# --- logical tables in SQL ----------------------------------------------------------------------------------------------

CTES = {
    "n_emb": "SELECT count(*) AS n FROM embeddings",
    "q0": "SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0",
    "q1": "SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1",
    "sims": "SELECT vec_id, embedding[4]::DOUBLE AS x, embedding[5]::DOUBLE AS y, list_dot_product(embedding::DOUBLE[], (SELECT q FROM q0)) AS s0, list_dot_product(embedding::DOUBLE[], (SELECT q FROM q1)) AS s1 FROM embeddings",
    "p0": "SELECT o_orderkey AS id, o_custkey AS author, round(o_totalprice, 0) AS votes, epoch(o_orderdate)::BIGINT AS ts, epoch(o_orderdate) / 86400.0 AS ts_day, o_orderdate AS at FROM orders",
    "pm": "SELECT min(votes) AS lo, max(votes) AS hi FROM p0",
    "cc": "SELECT l_orderkey AS post, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1",
    "post": "SELECT id, votes, coalesce(ln(greatest(votes - lo, 1)) / nullif(ln(hi - lo + 1), 0), 0) AS votes_norm, ts, ts_day, coalesce(n, 0) AS comment_count FROM p0 LEFT JOIN cc ON post = id, pm",
    "ps": "SELECT post.*, s0 AS sim, s1, x, y FROM post, n_emb JOIN sims ON vec_id = id % n",
    "c0": "SELECT event_id AS id, user_id, 'u' || user_id AS \"user\", round(value, 0) AS votes, floor(epoch(ts))::BIGINT AS ts, epoch_us(ts) / 86400e6 AS ts_day FROM events",
    "cm": "SELECT min(votes) AS lo, max(votes) AS hi FROM c0",
    "s3": "SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings",
    "sent": "SELECT vec_id, round(exp(a - greatest(a, b, c)) / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))), 6) AS sent_pos, round(exp(b - greatest(a, b, c)) / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))), 6) AS sent_neu, round(exp(c - greatest(a, b, c)) / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))), 6) AS sent_neg FROM s3",
    "comment": "SELECT c0.id, user_id, \"user\", votes, coalesce(ln(greatest(votes - lo, 1)) / nullif(ln(hi - lo + 1), 0), 0) AS votes_norm, ts, ts_day, sent_pos, sent_neu, sent_neg, CASE WHEN sent_pos > sent_neu THEN sent_pos WHEN sent_neg > greatest(sent_neu, sent_pos) THEN -sent_neg ELSE 0 END AS sent FROM c0, cm, n_emb JOIN sent ON vec_id = c0.id % n",
    "cs": "SELECT comment.*, s0 AS sim FROM comment, n_emb JOIN sims ON vec_id = id % n",
    "pts": "SELECT id, x, y, votes AS score FROM ps",
    "mm": "SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(score) AS s0, max(score) AS s1, count(*) AS n FROM pts",
}


def _sql(body: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in CTES.items()) + " " + body


def register(oracle: str | None = None, plain: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle if plain else _sql(oracle)
        return f

    return add


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where the session names none (one machine)."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='corpuscope-')}").rstrip("/")


def _points(spark: SparkSession, d: str) -> DataFrame:
    return t.dataset(spark, d, "toppost").rows.select("id", "x", "y", F.col("votes").alias("score"))


def _one(spark: SparkSession, d: str, name: str, q: QueryInput) -> DataFrame:
    return compile_query(t.dataset(spark, d, name), q)[0]


# --- endpoints ------------------------------------------------------------------------------------------------------------


@register('SELECT floor(ts_day / 7)::INTEGER AS "group", round(sum(votes * sim), 4) AS score FROM ps WHERE sim BETWEEN 0.1 AND 1 AND ts_day >= 1 GROUP BY 1')
def analyze_popularity(spark: SparkSession, d: str) -> DataFrame:
    found = endpoints.analyze_popularity(t.dataset(spark, d, "post"), t.query_vector(spark, d), sim_min_hundredths=10, floor=10)
    return _rounded(found.select("group", "score"), "score", digits=4)


@register('SELECT floor(ts_day / 7)::INTEGER AS "group", TIMESTAMP \'1970-01-01\' + INTERVAL 7 DAY * floor(ts_day / 7)::INTEGER AS week, round(sum(votes * sim), 4) AS score FROM ps WHERE sim BETWEEN 0.1 AND 1 AND ts_day >= 1 GROUP BY 1, 2')
def popularity_by_week(spark: SparkSession, d: str) -> DataFrame:
    """As analyze_popularity, with the day on which each week begins."""
    found = endpoints.analyze_popularity(t.dataset(spark, d, "post"), t.query_vector(spark, d), sim_min_hundredths=10, floor=10)
    return _rounded(found.withColumn("week", F.col("week").cast("timestamp_ntz")), "score", digits=4)


@register(f"SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(sim, 6) AS sim, round(0.5 * ((least(greatest(sim, 0.1), 1) - 0.1) / 0.9) + 0.2 * exp(-0.001 * ({NOW} - ts_day)) + 0.3 * votes_norm, 6) AS final_score FROM ps ORDER BY 0.5 * ((least(greatest(sim, 0.1), 1) - 0.1) / 0.9) + 0.2 * exp(-0.001 * ({NOW} - ts_day)) + 0.3 * votes_norm DESC, id LIMIT 50")
def search(spark: SparkSession, d: str) -> DataFrame:
    found = endpoints.search(t.dataset(spark, d, "toppost"), t.query_vector(spark, d), limit=50, w_sim=0.5, w_score=0.3, w_ts=0.2, decay=0.001, now_days=NOW, sim_floor=0.1)
    return _rounded(found, "x", "y", "sim", "final_score")


@register("SELECT id, round(sim, 6) AS sim FROM cs WHERE sim BETWEEN 0.15 AND 1 ORDER BY votes DESC, id LIMIT 100")
def items_by_votes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(endpoints.items(t.dataset(spark, d, "comment"), t.query_vector(spark, d), limit=100, sim_min_hundredths=15, order_by="votes", floor=10), "sim")


@register("SELECT id, round(sim, 6) AS sim FROM ps WHERE sim BETWEEN 0.15 AND 1 ORDER BY ts DESC, id LIMIT 100")
def items_by_ts(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(endpoints.items(t.dataset(spark, d, "post"), t.query_vector(spark, d), limit=100, sim_min_hundredths=15, order_by="ts", floor=10), "sim")


TOP_USERS = 'SELECT "user", sum((least(greatest(sim, 0.1), 1) - 0.1) / 0.9) AS score FROM cs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20'


@register(f'SELECT "user", round(score, 6) AS score FROM ({TOP_USERS})')
def top_users(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(endpoints.top_users(t.dataset(spark, d, "comment"), t.query_vector(spark, d), limit=20, sim_min_hundredths=10, floor=10), "score")


@register(f'SELECT "user", round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, "user")::INTEGER AS rank FROM ({TOP_USERS})')
def ranked_users(spark: SparkSession, d: str) -> DataFrame:
    found = endpoints.top_users(t.dataset(spark, d, "comment"), t.query_vector(spark, d), limit=20, sim_min_hundredths=10, floor=10)
    return _rounded(features.ranked(found, "score", "user"), "score")


@register('SELECT floor(ts_day / 7)::INTEGER AS "group", sum((sent_pos >= 0.5)::INTEGER)::BIGINT AS positive, sum((sent_neg >= 0.5)::INTEGER)::BIGINT AS negative FROM cs WHERE sim >= 0.1 GROUP BY 1')
def analyze_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return endpoints.analyze_sentiment(t.dataset(spark, d, "comment"), t.query_vector(spark, d), sim_min_hundredths=10, floor=10).select("group", "positive", "negative")


CELL = "greatest(0, least(floor(({c} - {c}0) * {d}), floor(({c}1 - {c}0) * {d}) - 1))::INTEGER"


@register(f"SELECT {CELL.format(c='x', d=25)} AS cell_x, {CELL.format(c='y', d=25)} AS cell_y, round(sum((least(greatest(sim, 0.1), 1) - 0.1) / 0.9), 6) AS weight FROM ps, (SELECT x0, x1, y0, y1 FROM mm) WHERE (least(greatest(sim, 0.1), 1) - 0.1) / 0.9 BETWEEN 0.01 AND 1 GROUP BY 1, 2")
def heatmap_grid(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(endpoints.heatmap(t.dataset(spark, d, "toppost"), t.query_vector(spark, d), sim_floor=0.1), "weight")


@register()
def heatmap_png(spark: SparkSession, d: str) -> DataFrame:
    return endpoints.heatmap(t.dataset(spark, d, "toppost"), t.query_vector(spark, d), sim_floor=0.1, color=(30, 90, 200))


# --- parts of the declarative query -------------------------------------------------------------------------------------------


def _similar(how: str) -> Query:
    def f(spark: SparkSession, d: str) -> DataFrame:
        queries = [t.query_vector(spark, d, i) for i in (0, 1)]
        return t.vector_table(spark, d).select("vec_id", F.round(vectors.similarity(F.col("embedding"), queries, how), 6).alias("sim"))

    f.__name__ = f"sim_{how}"
    return f


for _how, _expr in (("mean", "(s0 + s1) / 2"), ("min", "least(s0, s1)"), ("max", "greatest(s0, s1)")):
    register(f"SELECT vec_id, round({_expr}, 6) AS sim FROM sims")(_similar(_how))


@register(f"SELECT id, round(exp(-0.01 * ({NOW} - ts_day)), 9) AS ts_norm FROM post")
def ts_norm(spark: SparkSession, d: str) -> DataFrame:
    q = QueryInput((ItemsOutput(("id", "ts_norm"), "id", True),), ts_decay=0.01, now_days=NOW)
    return _rounded(_one(spark, d, "post", q), "ts_norm", digits=9)


@register("SELECT id, round((least(greatest(votes, 1000), 200000) - 1000) / 199000, 6) AS votes_scaled FROM post")
def scale(spark: SparkSession, d: str) -> DataFrame:
    q = QueryInput((ItemsOutput(("id", "votes_scaled"), "id", True),), scales={"votes": Clip(1000, 200000)})
    return _rounded(_one(spark, d, "post", q), "votes_scaled")


@register("SELECT id, (comment_count >= 5)::INTEGER AS comment_count_thresh FROM post")
def threshold(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "post", QueryInput((ItemsOutput(("id", "comment_count_thresh"), "id", True),), thresholds={"comment_count": 5}))


@register("SELECT id, round(votes_norm * 0.5 + comment_count * votes_norm, 6) AS final_score FROM post")
def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    q = QueryInput((ItemsOutput(("id", "final_score"), "id", True),), weights={"votes_norm": 0.5, "comment_count": "votes_norm"})
    return _rounded(_one(spark, d, "post", q), "final_score")


@register("SELECT id, votes FROM post WHERE votes BETWEEN 50000 AND 90000 AND comment_count BETWEEN 3 AND 6")
def range_filter(spark: SparkSession, d: str) -> DataFrame:
    q = QueryInput((ItemsOutput(("id", "votes"), "id", True),), post_filter_clip={"votes": Clip(50000, 90000), "comment_count": Clip(3, 6)})
    return _one(spark, d, "post", q)


@register('SELECT comment_count AS "group", round(avg(votes), 4) AS votes FROM post GROUP BY 1')
def group_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_one(spark, d, "post", QueryInput((GroupByOutput("comment_count", None, (("votes", "mean"),)),))), "votes", digits=4)


@register('SELECT comment_count AS "group", min(votes) AS votes, max(ts) AS ts FROM post GROUP BY 1')
def group_min_max(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "post", QueryInput((GroupByOutput("comment_count", None, (("votes", "min"), ("ts", "max"))),)))


@register('SELECT floor(ts_day / 30)::INTEGER AS "group", count(votes) AS votes FROM post GROUP BY 1')
def group_count(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "post", QueryInput((GroupByOutput("ts_day", 30.0, (("votes", "count"),)),)))


@register('SELECT "user" AS "group", sum(votes) AS votes FROM comment GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10')
def group_sum(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "comment", QueryInput((GroupByOutput("user", None, (("votes", "sum"),), "votes", False, 10),)))


@register("SELECT c_custkey AS id, floor(c_acctbal / 1000)::INTEGER AS bucket FROM customer", plain=True)
def bucket_floor_negative(spark: SparkSession, d: str) -> DataFrame:
    c = t.read_table(spark, d, "customer", ["c_custkey", "c_acctbal"])
    return c.select(F.col("c_custkey").alias("id"), scalar.bucket(F.col("c_acctbal"), 1000).alias("bucket"))


@register("SELECT id, round(sim, 6) AS sim FROM (SELECT id, (coalesce(a, 0) + coalesce(b, 0)) / 2 AS sim FROM post, n_emb JOIN (SELECT coalesce(u.vec_id, v.vec_id) AS vec_id, u.s0 AS a, v.s1 AS b FROM (SELECT vec_id, s0 FROM sims ORDER BY s0 DESC, vec_id LIMIT 20) u FULL JOIN (SELECT vec_id, s1 FROM sims ORDER BY s1 DESC, vec_id LIMIT 20) v ON u.vec_id = v.vec_id) k ON k.vec_id = id % n)")
def ann_exact_prefilter(spark: SparkSession, d: str) -> DataFrame:
    q = QueryInput((ItemsOutput(("id", "sim"), "id", True),), tuple(tuple(t.query_vector(spark, d, i)) for i in (0, 1)), pre_filter_ann=20)
    return _rounded(_one(spark, d, "post", q), "sim")


@register()
def ann_lsh(spark: SparkSession, d: str) -> DataFrame:
    v = t.vector_table(spark, d)
    return ml.lsh_nearest_many(v, v.where("vec_id % 50 = 0"), 10)


# --- feature builds ----------------------------------------------------------------------------------------------------------


@register("SELECT id, votes, round(votes_norm, 6) AS votes_norm, ts, round(ts_day, 6) AS ts_day, comment_count FROM post")
def post_table(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(t.dataset(spark, d, "post").rows.drop("emb_key"), "votes_norm", "ts_day")


@register("SELECT id, votes, round(votes_norm, 6) AS votes_norm, ts, round(ts_day, 6) AS ts_day, comment_count, round(x, 6) AS x, round(y, 6) AS y FROM ps")
def toppost_table(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(t.dataset(spark, d, "toppost").rows.drop("emb_key"), "votes_norm", "ts_day", "x", "y")


@register('SELECT id, user_id, "user", votes, round(votes_norm, 6) AS votes_norm, ts, round(ts_day, 6) AS ts_day, sent_pos, sent_neu, sent_neg, sent FROM comment')
def comment_table(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(t.dataset(spark, d, "comment").rows.drop("emb_key"), "votes_norm", "ts_day")


@register("SELECT id, comment_count FROM post")
def comment_counts(spark: SparkSession, d: str) -> DataFrame:
    return features.comment_counts(t.posts(spark, d).select("id"), t.comment_posts(spark, d))


@register('SELECT o_custkey AS "user", o_orderkey AS post FROM orders UNION SELECT user_id, event_id % (SELECT count(*) FROM orders) FROM events', plain=True)
def interactions(spark: SparkSession, d: str) -> DataFrame:
    return features.interactions(t.posts(spark, d), t.comments(spark, d), sentinel=None)


@register('SELECT o_custkey AS "user", o_orderkey AS post FROM orders WHERE o_custkey <> 0 AND o_orderkey <> 0 UNION SELECT user_id, event_id % (SELECT count(*) FROM orders) FROM events WHERE user_id <> 0 AND event_id % (SELECT count(*) FROM orders) <> 0', plain=True)
def interactions_known(spark: SparkSession, d: str) -> DataFrame:
    """As interactions, with 0 as the id of what is not known."""
    return features.interactions(t.posts(spark, d), t.comments(spark, d), sentinel=0)


@register("WITH r AS (SELECT event_id AS id, user_id, event_type = 'purchase' AS is_post, embedding::DOUBLE[] AS e FROM events JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings) WHERE event_type IN ('purchase', 'view', 'click')), u AS (SELECT id, user_id, is_post, unnest(e) AS v, unnest(range(len(e)))::INTEGER AS dim FROM r), w AS (SELECT *, avg(CASE WHEN NOT is_post THEN v END) OVER (PARTITION BY user_id, dim ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, count(CASE WHEN NOT is_post THEN 1 END) OVER (PARTITION BY user_id, dim ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM u) SELECT user_id, id, n AS n_before, dim, round(a, 6) AS value FROM w WHERE is_post", plain=True)
def asof_user_average(spark: SparkSession, d: str) -> DataFrame:
    v = t.vector_table(spark, d)
    n = v.count()
    e = t.read_table(spark, d, "events", ["event_id", "user_id", "event_type"]).where(F.col("event_type").isin("purchase", "view", "click"))
    rows = e.select("user_id", F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "post").otherwise("comment").alias("kind"), (F.col("event_id") % n).alias("vec_id")).join(v, "vec_id")
    dims = len(t.query_vector(spark, d))
    found = features.running_average(rows, dims)
    return found.withColumn("average", F.coalesce("average", F.array_repeat(F.lit(None).cast("double"), dims))).select("user_id", "id", "n_before", F.posexplode("average").alias("dim", "value")).withColumn("value", F.round("value", 6))


EVENTS = "e AS (SELECT event_id AS id, user_id, event_type = 'purchase' AS is_post, (event_id * 7919) % (SELECT count(*) FROM events) AS target, embedding::DOUBLE[] AS v FROM events JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings) WHERE event_type IN ('purchase', 'view', 'click'))"


@register(f"WITH {EVENTS}, met AS (SELECT user_id, id AS post FROM e WHERE is_post UNION SELECT c.user_id, p.id FROM e c JOIN e p ON p.id = c.target AND p.is_post WHERE NOT c.is_post), r AS (SELECT met.user_id, post AS id, true AS is_post, v FROM met JOIN e ON e.id = post UNION ALL SELECT user_id, id, false, v FROM e WHERE NOT is_post), u AS (SELECT user_id, id, is_post, unnest(v) AS v, unnest(range(len(v)))::INTEGER AS dim FROM r), w AS (SELECT *, avg(CASE WHEN NOT is_post THEN v END) OVER b AS a, avg(CASE WHEN is_post THEN v END) OVER b AS h, count(CASE WHEN NOT is_post THEN 1 END) OVER b AS n, count(CASE WHEN is_post THEN 1 END) OVER b AS m FROM u WINDOW b AS (PARTITION BY user_id, dim ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT user_id AS \"user\", id AS post, n AS n_before, m AS n_history, dim, CASE WHEN round(a, 6) = 0 THEN 0 ELSE round(a, 6) END AS average, CASE WHEN round(h, 6) = 0 THEN 0 ELSE round(h, 6) END AS history FROM w WHERE is_post", plain=True)
def interaction_training(spark: SparkSession, d: str) -> DataFrame:
    v = t.vector_table(spark, d)
    events = t.read_table(spark, d, "events", ["event_id", "user_id", "event_type"])
    n, all_events, dims = v.count(), events.count(), len(t.query_vector(spark, d))
    e = events.where(F.col("event_type").isin("purchase", "view", "click")).select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("is_post"), (F.col("event_id") * 7919 % all_events).alias("post"), (F.col("event_id") % n).alias("vec_id"))
    e = e.join(v, "vec_id").drop("vec_id")
    met = e.where("is_post").select("user", F.col("id").alias("post")).union(e.where("not is_post").select("user", "post"))
    found = features.interaction_training(met, e.where("is_post").select("id", "embedding"), e.where("not is_post").select("id", "user", "embedding"), dims)
    empty = F.array_repeat(F.lit(None).cast("double"), dims)
    each = F.posexplode(F.arrays_zip(F.coalesce("average", empty).alias("average"), F.coalesce("history", empty).alias("history")))
    return found.select("user", "post", "n_before", "n_history", each.alias("dim", "x")).select("user", "post", "n_before", "n_history", "dim", *[F.when(F.round(f"x.{c}", 6) == 0, 0.0).otherwise(F.round(f"x.{c}", 6)).alias(c) for c in ("average", "history")])


@register("SELECT o_orderkey AS id, round(ln(greatest(round(o_totalprice, 0), 1)), 6) AS log_score, round((epoch(o_orderdate) - epoch(TIMESTAMP '2005-01-01')) / (epoch(TIMESTAMP '2035-01-01') - epoch(TIMESTAMP '2005-01-01')), 6) AS ts_rel, " + ", ".join(f"round({f}(2 * pi() * ({v}) / ({top} + 1)), 6) AS {n}_{f}" for n, v, top in (("year", "(epoch(o_orderdate) - epoch(date_trunc('year', o_orderdate)::TIMESTAMP)) / 86400.0", "365"), ("month", "(epoch(o_orderdate) - epoch(date_trunc('month', o_orderdate)::TIMESTAMP)) / 86400.0", "day(last_day(o_orderdate))"), ("week", "(epoch(o_orderdate) - epoch(date_trunc('day', o_orderdate)::TIMESTAMP)) / 86400.0 + dayofweek(o_orderdate)", "6"), ("day", "hour(o_orderdate)", "23")) for f in ("sin", "cos")) + " FROM orders", plain=True)
def nn_posts_features(spark: SparkSession, d: str) -> DataFrame:
    found = features.time_features(t.posts(spark, d))
    return _rounded(found, *[c for c in found.columns if c != "id"])


@register('SELECT "group", round(score, 4) AS score, round(sum(score) OVER (ORDER BY "group"), 4) AS cumulative FROM (SELECT floor(ts_day / 7)::INTEGER AS "group", sum(votes * sim) AS score FROM ps WHERE sim BETWEEN 0.1 AND 1 AND ts_day >= 1 GROUP BY 1)')
def cumulative_popularity(spark: SparkSession, d: str) -> DataFrame:
    found = endpoints.analyze_popularity(t.dataset(spark, d, "post"), t.query_vector(spark, d), sim_min_hundredths=10, floor=10)
    return _rounded(features.cumulative(found.select("group", "score"), "score"), "score", "cumulative", digits=4)


@register("SELECT coalesce(max(id), -1) AS committed FROM (SELECT event_id AS id, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events) WHERE id = rn", plain=True)
def contiguous_commit(spark: SparkSession, d: str) -> DataFrame:
    done = t.read_table(spark, d, "events", ["event_id"]).select(F.col("event_id").alias("id"))
    return features.contiguous_prefix(done, 0)


@register("SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY embedding", plain=True)
def dedup_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors.distinct_vectors(t.vector_table(spark, d)).select("vec_id")


# --- serving ------------------------------------------------------------------------------------------------------------------

URLS = "SELECT page_id AS id, regexp_replace(url, '^https?://', '') AS url, regexp_extract(url, '^(https?):', 1) AS proto FROM pages"


@register(f"SELECT o_orderkey AS id, round(o_totalprice, 0) AS score, c_name AS author_name, coalesce(url, '') AS url, coalesce(proto, '') AS proto, text AS title FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN ({URLS}) u ON u.id = o_orderkey % (2 * (SELECT count(*) FROM pages)) JOIN documents ON doc_id = o_orderkey", plain=True)
def edge_posts(spark: SparkSession, d: str) -> DataFrame:
    urls = t.urls(spark, d)
    posts = t.posts(spark, d).withColumn("url_id", F.col("id") % (2 * urls.count())).drop("ts")
    return serve.edge_posts(posts, t.users(spark, d), urls, t.titles(spark, d))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return html.parse_pages(t.read_table(spark, d, "pages").withColumnRenamed("page_id", "id"))


@register()
def edge_url_metas(spark: SparkSession, d: str) -> DataFrame:
    return serve.edge_url_metas(_parsed(spark, d).drop("text"), t.urls(spark, d))


@register()
def parse_html(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d)


KEYS = [7, 3, 999999999, 12, 3, 0]
ASKED = f"(SELECT unnest(range({len(KEYS)}))::INTEGER AS pos, unnest({KEYS})::BIGINT AS id) a"


@register(f"SELECT pos, a.id, coalesce(text, '') AS text FROM {ASKED} LEFT JOIN documents ON doc_id = a.id", plain=True)
def lookup_titles(spark: SparkSession, d: str) -> DataFrame:
    return serve.lookup(t.titles(spark, d), KEYS, text=F.lit("")).select("pos", "id", "text")


@register(f"SELECT pos, a.id, coalesce(octet_length(encode(text)), 0)::INTEGER AS title_bytes FROM {ASKED} LEFT JOIN documents ON doc_id = a.id", plain=True)
def lookup_title_lengths(spark: SparkSession, d: str) -> DataFrame:
    return serve.lookup(t.titles(spark, d), KEYS).select("pos", "id", scalar.title_bytes(F.col("text")).alias("title_bytes"))


@register(f"SELECT pos, a.id, round(x, 6) AS x, round(y, 6) AS y FROM {ASKED} LEFT JOIN (SELECT vec_id, embedding[4]::DOUBLE AS x, embedding[5]::DOUBLE AS y FROM embeddings) ON vec_id = a.id", plain=True)
def lookup_points(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(serve.lookup(t.layout(spark, d), KEYS).select("pos", "id", "x", "y"), "x", "y")


@register("SELECT event_id AS id, round(value, 0) AS score, c_name AS username FROM events LEFT JOIN customer ON c_custkey = user_id ORDER BY score DESC, id DESC LIMIT 50", plain=True)
def comment_list(spark: SparkSession, d: str) -> DataFrame:
    return serve.comment_list(t.comments(spark, d), t.users(spark, d), limit=50).select("id", "score", "username")


@register("SELECT doc_id AS id, text FROM documents WHERE doc_id % 2 = 0", plain=True)
def kv_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = t.read_table(spark, d, "documents", ["doc_id", "text"])
    kv = docs.select(F.concat(F.lit("post/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "/text").otherwise("/text/raw")).alias("k"), F.encode("text", "UTF-8").alias("v"))
    return t.kv_scan(kv, "post/%/text")


@register("SELECT conv_id * 8 + turn AS id, conv_id * 8 + min(turn) OVER (PARTITION BY conv_id) AS root FROM conversations", plain=True)
def thread_root(spark: SparkSession, d: str) -> DataFrame:
    return contexts.thread_roots(t.thread(spark, d))


@register("SELECT c.conv_id * 8 + c.turn AS id FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 WHERE p.conv_id IS NULL", plain=True)
def thread_roots_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return serve.thread_heads(t.thread(spark, d).select("id", "parent")).select("id")


#: What trimming takes from both ends, and conversations as posts with titles and urls and as comments on them.
ENDS = r"'^[\s\v\p{Z}\x{FEFF}]+|[\s\v\p{Z}\x{FEFF}]+$', '', 'g'"
TALK = f"k AS (SELECT conv_id, turn, conv_id * 8 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 8 + turn - 1 END AS parent, text, (conv_id * 7 + turn * 3) % 11 - 2 AS score, (conv_id + turn) % 9 = 8 AS dead, (conv_id + turn) % 13 = 12 AS deleted FROM conversations), talk AS (SELECT k.id, conv_id, '<' || conv_id || '> ' || regexp_replace(text, {ENDS}) AS title, u.url, text, dead, deleted, conv_id % (2 * (SELECT count(*) FROM pages)) AS url_id FROM k LEFT JOIN ({URLS}) u ON u.id = conv_id % (2 * (SELECT count(*) FROM pages)) WHERE turn = 0)"
NL = "chr(10) || chr(10)"


def _talk(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as posts (their first turns, half of them with a page) and comments."""
    urls = t.urls(spark, d)
    c = t.thread(spark, d).withColumns({"score": (F.col("conv_id") * 7 + F.col("turn") * 3) % 11 - 2, "dead": (F.col("conv_id") + F.col("turn")) % 9 == 8, "deleted": (F.col("conv_id") + F.col("turn")) % 13 == 12})
    heads = c.where("turn = 0").withColumns({"url_id": F.col("conv_id") % (2 * urls.count()), "title": F.concat(F.lit(" Ask HN: &lt;"), F.col("conv_id").cast("string"), F.lit("&gt; "), "text")})
    return heads.join(urls.select(F.col("id").alias("url_id"), "url"), "url_id", "left"), c.where("turn > 0")


@register(f"WITH RECURSIVE {TALK}, up AS (SELECT id, id AS root, '# Post' || {NL} || title || {NL} || coalesce(url, '') AS above FROM talk UNION ALL SELECT k.id, root, above || {NL} || '# Comment' || {NL} || k.text FROM k JOIN up ON up.id = k.parent) SELECT k.id, root, regexp_replace(above || {NL} || '# Reply' || {NL} || regexp_replace(k.text, {ENDS}), {ENDS}) AS text FROM k JOIN up ON up.id = k.parent WHERE regexp_replace(k.text, {ENDS}) <> ''", plain=True)
def reply_context_text(spark: SparkSession, d: str) -> DataFrame:
    posts, comments = _talk(spark, d)
    return contexts.reply_inputs(comments, posts)


CONTEXT = f"said AS (SELECT conv_id, chr(10) || chr(10) || '# Comments:' || chr(10) || '==========' || {NL} || string_agg(text, {NL} || '----------' || {NL} ORDER BY turn) AS body FROM k WHERE turn > 0 AND NOT dead AND NOT deleted AND score >= 0 GROUP BY 1), context AS (SELECT id, url, url_id, regexp_replace(substring(array_to_string(list_filter(CASE WHEN coalesce(url, '') <> '' THEN [title, url, '{contexts.PAGE_TITLE}', '{contexts.PAGE_DESCRIPTION}', '{contexts.PAGE_TEXT}'] ELSE [title, text] END, lambda x: x <> ''), {NL}) || coalesce(body, ''), 1, 65536), {ENDS}) AS text FROM talk LEFT JOIN said USING (conv_id) WHERE NOT dead AND NOT deleted)"


@register(f"WITH {TALK}, {CONTEXT} SELECT id, text FROM context", plain=True)
def post_context_text(spark: SparkSession, d: str) -> DataFrame:
    posts, comments = _talk(spark, d)
    return contexts.post_inputs(posts, comments.withColumns({"post": F.col("conv_id") * 8, "rank": F.col("turn")}))


PAGE_STATE = "state AS (SELECT page_id, page_id % 7 <> 3 AS fetched, page_id % 5 = 0 AS failed, regexp_extract(html, '<title>([^<]*)</title>', 1) AS page_title, CASE WHEN page_id % 2 = 0 THEN 'About ' || url ELSE NULL END AS page_description, CASE WHEN page_id % 4 = 1 THEN '' ELSE regexp_replace(html, '<[^>]*>', ' ', 'g') END AS page_text FROM pages)"


@register(f"WITH {TALK}, {CONTEXT}, {PAGE_STATE} SELECT id, CASE WHEN page_id IS NULL THEN text ELSE replace(replace(replace(text, '{contexts.PAGE_TITLE}', page_title), '{contexts.PAGE_DESCRIPTION}', coalesce(page_description, '')), '{contexts.PAGE_TEXT}', page_text) END AS text, CASE WHEN page_id IS NOT NULL THEN failed OR page_text = '' END AS missing_page FROM context LEFT JOIN state ON page_id = url_id WHERE url IS NULL OR fetched", plain=True)
def filled_post_text(spark: SparkSession, d: str) -> DataFrame:
    """Post texts with what is known of their pages; posts whose page is not fetched yet wait."""
    posts, comments = _talk(spark, d)
    inputs = contexts.post_inputs(posts, comments.withColumns({"post": F.col("conv_id") * 8, "rank": F.col("turn")}))
    p, n = t.read_table(spark, d, "pages"), F.col("page_id")
    text = F.when(n % 4 == 1, "").otherwise(F.regexp_replace("html", "<[^>]*>", " "))
    pages = p.select(n.alias("url_id"), F.when(n % 7 != 3, F.lit("2024-01-01").cast("timestamp")).alias("fetched"), F.when(n % 5 == 0, "timeout").alias("error"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.when(n % 2 == 0, F.concat(F.lit("About "), "url")).alias("description"), text.alias("text"))
    return contexts.fill_pages(inputs, posts.select("id", "url_id"), pages)


@register(f"SELECT doc_id AS id, regexp_replace(regexp_replace(regexp_replace('Show HN: ' || text, {ENDS}), '^(Ask|Show) HN:?', '', 'i'), {ENDS}) AS title FROM documents", plain=True)
def clean_title(spark: SparkSession, d: str) -> DataFrame:
    return t.titles(spark, d).select("id", scalar.clean_title(F.concat(F.lit("Show HN: "), F.col("text"))).alias("title"))


@register("SELECT page_id AS id, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS site FROM pages", plain=True)
def site_of_url(spark: SparkSession, d: str) -> DataFrame:
    return t.urls(spark, d).select("id", scalar.site_of(F.col("url")).alias("site"))


_PARTS = "SELECT page_id AS id, lower(regexp_extract(url, '^(https?):', 1)) AS proto, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query FROM pages"


@register(f"SELECT id, proto, host || '/top' || CASE WHEN path = '' THEN '/' ELSE path END || '%2F?' || array_to_string(list_sort(list_concat(list_filter(string_split(query, '&'), lambda x: x <> ''), ['b=1', 'a=2'])), '&') AS url FROM ({_PARTS})", plain=True)
def normal_urls(spark: SparkSession, d: str) -> DataFrame:
    """Every page's whole url, written so that it needs all rules: case, user, port, dots, escapes, empty and unsorted parts, fragment."""
    p = t.read_table(spark, d, "pages", ["page_id", "url"])
    part = lambda i: F.regexp_extract("url", r"^(https?)://([^/?#]+)([^?#]*)[?]?([^#]*)", i)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    port = F.when(part(1) == "https", ":443").otherwise(":80")
    odd = F.concat(F.lit("  "), F.upper(part(1)), F.lit("://u:p@"), F.upper(part(2)), port, F.lit("/gone/../top/./x/.."), path, F.lit("%2f?b=1&&"), part(4), F.lit("&a=2#end "))
    proto, rest = scalar.url_parts(odd)
    return p.select(F.col("page_id").alias("id"), proto.alias("proto"), rest.alias("url"))


@register()
def encode_titles(spark: SparkSession, d: str) -> DataFrame:
    return encoders.encode_texts(t.titles(spark, d), encoders.HashingEncoder(64))


@register()
def search_by_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the similarity of their texts to a query text, both encoded."""
    encoder = encoders.HashingEncoder(256)
    found = encoders.encode_texts(t.titles(spark, d), encoder).withColumnRenamed("id", "vec_id")
    query = encoders.encode_query(encoder, "all rights reserved under the license")
    return found.select("vec_id", vectors.similarity(F.col("embedding"), [query], "mean").alias("sim")).orderBy(F.desc("sim"), "vec_id").limit(20)


@register(f"SELECT * FROM ({URLS})", plain=True)
def strip_protocol(spark: SparkSession, d: str) -> DataFrame:
    return t.urls(spark, d)


# --- map ------------------------------------------------------------------------------------------------------------------------

LEVELS = "greatest(1, ceil(log2(n / 1024.0) / 2) + 1)::INTEGER"


@register(f"SELECT {LEVELS} AS lod_levels FROM mm")
def lod_levels(spark: SparkSession, d: str) -> DataFrame:
    return spatial.map_meta(_points(spark, d)).select("lod_levels")


@register(f"SELECT round(x0, 6) AS x_min, round(x1, 6) AS x_max, round(y0, 6) AS y_min, round(y1, 6) AS y_max, s0 AS score_min, s1 AS score_max, n AS count, {LEVELS} AS lod_levels FROM mm")
def map_meta(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(spatial.map_meta(_points(spark, d)), "x_min", "x_max", "y_min", "y_max")


GRID = "least(floor(({c} - {c}0) / (({c}1 - {c}0) / {n})), {n} - 1)::INTEGER"


@register(f"SELECT cell_x, cell_y, id, score FROM (SELECT id, score, {GRID.format(c='x', n=64)} AS cell_x, {GRID.format(c='y', n=64)} AS cell_y, row_number() OVER (PARTITION BY {GRID.format(c='x', n=64)}, {GRID.format(c='y', n=64)} ORDER BY score DESC, id) AS rn FROM pts, (SELECT x0, x1, y0, y1 FROM mm)) WHERE rn = 1")
def lod_top_per_cell(spark: SparkSession, d: str) -> DataFrame:
    points = _points(spark, d)
    return spatial.top_per_cell(points, spatial.map_meta(points), 1)


def _level(lod: int, before: str | None) -> str:
    n = 32 << lod
    top = f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY {GRID.format(c='x', n=n)}, {GRID.format(c='y', n=n)} ORDER BY score DESC, id) AS rn FROM pts, (SELECT x0, x1, y0, y1 FROM mm)) WHERE rn = 1"
    second = f"WHEN id IN (SELECT id FROM {before}) THEN 1 " if before else ""
    return f"SELECT id FROM pts ORDER BY CASE WHEN id IN ({top}) THEN 0 {second}ELSE 2 END, (id * 2654435761) % 4294967296, id LIMIT {n * n}"


SAMPLE = f"l0 AS ({_level(0, None)}), l1 AS ({_level(1, 'l0')}), sample AS (SELECT 0 AS lod, id FROM l0 WHERE {LEVELS.replace('n /', '(SELECT n FROM mm) /')} > 1 UNION ALL SELECT 1, id FROM l1 WHERE {LEVELS.replace('n /', '(SELECT n FROM mm) /')} > 2 UNION ALL SELECT {LEVELS.replace('n /', '(SELECT n FROM mm) /')} - 1, id FROM pts)"


def _with_sample(body: str) -> str:
    return _sql("").rstrip() + ", " + SAMPLE + " " + body


@register(_with_sample("SELECT lod::INTEGER AS lod, id FROM sample"), plain=True)
def lod_sample(spark: SparkSession, d: str) -> DataFrame:
    points = stored(_points(spark, d), "points")
    return spatial.lod_sample(points, spatial.map_meta(points))


TILE = "least(floor(({c} - {c}0) * pow(2, lod) / ({c}1 - {c}0)), pow(2, lod) - 1)::INTEGER"


@register(_with_sample(f"SELECT lod::INTEGER AS lod, {TILE.format(c='x')} AS tile_x, {TILE.format(c='y')} AS tile_y, count(*) AS n, min(id) AS first_id, max(score) AS best FROM sample JOIN pts USING (id), (SELECT x0, x1, y0, y1 FROM mm) GROUP BY 1, 2, 3"), plain=True)
def lod_tiles(spark: SparkSession, d: str) -> DataFrame:
    points = stored(_points(spark, d), "points")
    meta = spatial.map_meta(points)
    tiles = spatial.lod_tiles(points, spatial.lod_sample(points, meta), meta)
    best = F.max(F.array_max(F.transform("points", lambda p: p["score"]))).alias("best")
    return tiles.groupBy("lod", "tile_x", "tile_y").agg(F.sum(F.size("points").cast("long")).alias("n"), F.min(F.get("points", F.lit(0))["id"]).alias("first_id"), best)


_AT = "greatest(0, least(1, floor(({v} - {c}0) * 2 / ({c}1 - {c}0))))"


@register(_with_sample(f"SELECT tile_x, tile_y, count(*) AS n, min(id) AS first_id FROM (SELECT {TILE.format(c='x')} AS tile_x, {TILE.format(c='y')} AS tile_y, id FROM sample JOIN pts USING (id), (SELECT x0, x1, y0, y1 FROM mm) WHERE lod = 1), (SELECT x0, x1, y0, y1 FROM mm) WHERE tile_x BETWEEN {_AT.format(v='0.0', c='x')} AND {_AT.format(v='0.1', c='x')} AND tile_y BETWEEN {_AT.format(v='-0.05', c='y')} AND {_AT.format(v='0.05', c='y')} GROUP BY 1, 2"), plain=True)
def tile_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Write the map and read back the tiles of level 1 that a viewport touches."""
    points = stored(_points(spark, d), "points")
    meta = spatial.map_meta(points)
    folder = f"{_shared(spark)}/map-{uuid.uuid4().hex}"
    spatial.write_tiles(spatial.lod_tiles(points, spatial.lod_sample(points, meta), meta), folder)
    found = spatial.viewport_tiles(spark, folder, meta, 1, 0.0, -0.05, 0.1, 0.05)
    return found.groupBy("tile_x", "tile_y").agg(F.sum(F.size("points").cast("long")).alias("n"), F.min(F.get("points", F.lit(0))["id"]).alias("first_id"))


@register("SELECT id, score FROM pts WHERE x BETWEEN 0.0 AND 0.1 AND y BETWEEN -0.05 AND 0.05")
def viewport_points(spark: SparkSession, d: str) -> DataFrame:
    return spatial.viewport(_points(spark, d), 0.0, -0.05, 0.1, 0.05).select("id", "score")


@register("SELECT id, round((x - 0.05) * (x - 0.05) + (y - 0.02) * (y - 0.02), 9) AS dist2 FROM pts ORDER BY (x - 0.05) * (x - 0.05) + (y - 0.02) * (y - 0.02), id LIMIT 10")
def nearest_points(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(spatial.nearest_points(_points(spark, d), 0.05, 0.02, 10).select("id", "dist2"), "dist2", digits=9)


@register(f"SELECT {CELL.format(c='x', d=32)} AS cell_x, {CELL.format(c='y', d=32)} AS cell_y, round(ln(count(*) + 1), 6) AS density FROM pts, (SELECT x0, x1, y0, y1 FROM mm) GROUP BY 1, 2")
def terrain_grid(spark: SparkSession, d: str) -> DataFrame:
    points = _points(spark, d)
    return _rounded(spatial.terrain_cells(points, spatial.map_meta(points)), "density")


@register()
def terrain_paths(spark: SparkSession, d: str) -> DataFrame:
    points = _points(spark, d)
    meta = spatial.map_meta(points)
    return spatial.terrain_paths(spatial.terrain_cells(points, meta), meta)


# --- vector jobs ------------------------------------------------------------------------------------------------------------------


@register()
def kmeans_inertia(spark: SparkSession, d: str) -> DataFrame:
    return ml.kmeans_inertia(t.vector_table(spark, d), [2, 4, 8])


@register()
def pca_layout(spark: SparkSession, d: str) -> DataFrame:
    return ml.pca_layout(t.vector_table(spark, d))


@register("SELECT vec_id, other, round(sim, 6) AS sim FROM (SELECT a.vec_id, b.vec_id AS other, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rn FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rn <= 5", plain=True)
def neighbour_lists(spark: SparkSession, d: str) -> DataFrame:
    found = ml.neighbour_lists(t.vector_table(spark, d), 5)
    return found.select("vec_id", F.explode("neighbours").alias("n")).select("vec_id", F.col("n.id").alias("other"), F.round("n.sim", 6).alias("sim"))


@register("SELECT label AS cluster, count(*) AS n, string_agg(text, '|' ORDER BY text) AS titles FROM (SELECT label, text, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 2654435761) % 4294967296, vec_id) AS rn FROM embeddings JOIN documents ON doc_id = vec_id) WHERE rn <= 5 GROUP BY 1", plain=True)
def cluster_exemplars(spark: SparkSession, d: str) -> DataFrame:
    members = t.read_table(spark, d, "embeddings", ["vec_id", "label"]).select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    found = ml.cluster_exemplars(members, t.titles(spark, d), 5)
    return found.select("cluster", F.size("titles").cast("long").alias("n"), F.array_join("titles", "|").alias("titles"))


# --- upserts and streams -----------------------------------------------------------------------------------------------------------


@register("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1", plain=True)
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    e = t.read_table(spark, d, "events", ["user_id", "event_id", "value"])
    return upsert.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")


@register("SELECT CASE WHEN old IS NOT NULL THEN old ELSE 9 + row_number() OVER (PARTITION BY old IS NULL ORDER BY name) END AS id, name FROM (SELECT name, min(old) AS old FROM (SELECT c_name AS name, CASE WHEN c_custkey < 10 THEN c_custkey END AS old FROM customer) GROUP BY 1)", plain=True)
def dictionary_encode(spark: SparkSession, d: str) -> DataFrame:
    names = t.users(spark, d).withColumnRenamed("username", "name")
    return upsert.dictionary_encode(names.where("id < 10"), names.select("name"))


@register("SELECT DISTINCT url FROM pages WHERE page_id % 3 <> 0 EXCEPT SELECT url FROM pages WHERE page_id % 3 = 0", plain=True)
def new_urls(spark: SparkSession, d: str) -> DataFrame:
    p = t.read_table(spark, d, "pages", ["page_id", "url"])
    return upsert.not_seen(p.where("page_id % 3 <> 0"), p.where("page_id % 3 = 0"), "url")


@register("SELECT event_id AS id FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 48 HOURS", plain=True)
def settled_items_48h(spark: SparkSession, d: str) -> DataFrame:
    e = t.read_table(spark, d, "events", ["event_id", "ts"]).withColumnRenamed("event_id", "id")
    return ingest.settled(e, "2024-01-20 00:00:00").select("id")


@register("SELECT id, turn FROM (SELECT event_id AS id, row_number() OVER (PARTITION BY user_id % 3, date_trunc('hour', ts) ORDER BY ts, event_id)::INTEGER AS turn FROM events) WHERE turn <= 3", plain=True)
def rate_limit_admit(spark: SparkSession, d: str) -> DataFrame:
    e = t.read_table(spark, d, "events", ["event_id", "user_id", "ts"]).select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("origin"), F.col("ts").cast("timestamp").alias("ts"))
    return ingest.admitted(e, per_window=3, window="1 hour").select("id", "turn")


@register("SELECT user_id AS origin, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1", plain=True)
def failure_counts(spark: SparkSession, d: str) -> DataFrame:
    e = t.read_table(spark, d, "events", ["user_id", "event_type"]).where("event_type = 'error'")
    return e.groupBy(F.col("user_id").alias("origin")).agg(F.count("*").alias("n"))


@register("WITH RECURSIVE e AS (SELECT user_id AS origin, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), f AS (SELECT origin, 0::BIGINT AS rn, 0 AS level FROM e GROUP BY 1 UNION ALL SELECT e.origin, e.rn, CASE event_type WHEN 'error' THEN least(8, level + 1) WHEN 'click' THEN greatest(0, level - 1) ELSE level END FROM f JOIN e ON e.origin = f.origin AND e.rn = f.rn + 1) SELECT origin, arg_max(level, rn)::INTEGER AS level, CASE WHEN arg_max(level, rn) > 0 THEN pow(2, arg_max(level, rn)) ELSE 0 END::DOUBLE AS blocked_s FROM f GROUP BY 1", plain=True)
def failure_levels(spark: SparkSession, d: str) -> DataFrame:
    e = t.read_table(spark, d, "events", ["event_id", "user_id", "event_type"])
    outcome = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "click", "404").otherwise("ok")
    return ingest.failure_levels(e.select(F.col("user_id").alias("origin"), F.col("event_id").alias("id"), outcome.alias("outcome")))


@register("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1", plain=True)
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    schema = t.read_table(spark, d, "events", ["user_id", "event_id", "value"]).schema
    folder = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    return ingest.ingest(ingest.read_events(spark, d, schema), f"{folder}/table", f"{folder}/checkpoint", "user_id", "event_id")
