"""More registered queries: streams that wait, stored indexes, versioned tables, labels of the whole map."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import encoders, msgpack, scalar, sentiment, vectors
from corpuscope.operators import clusters, labels, layout, lexical, results, spatial, versioned
from corpuscope.operators import neighbour_index as neighbours
from corpuscope.operators.stages import shared_folder, stored
from corpuscope.plans.query import Clip, ItemsOutput, QueryInput, scored
from corpuscope.queries import _sql as sql
from corpuscope.queries import register
from corpuscope.sources import tables as t
from corpuscope.streaming import ids, ingest, waiting

#: A row of such a time closes a stream: it moves the watermark past all others.
CLOSING = "2100-01-01"


def _closing(df: DataFrame, **values: int) -> DataFrame:
    """One row with the closing time, the given values and nulls, so that a stream of ``df`` lets go of all before it."""
    given = {"ts": F.lit(CLOSING).cast("timestamp"), **{k: F.lit(v) for k, v in values.items()}}
    return df.sparkSession.range(1).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])


def _arrivals(spark: SparkSession, folder: str, schema_of: DataFrame) -> DataFrame:
    return spark.readStream.schema(schema_of.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


# --- streams that wait --------------------------------------------------------------------------------------------------------


@register("WITH n AS (SELECT count(*) AS n FROM pages), a AS (SELECT page_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (page_id * 37 % 960) AS arrived, url FROM pages) SELECT event_id AS id, user_id, ts, event_id % (2 * n) AS page_id, arrived, url FROM events, n LEFT JOIN a ON a.page_id = event_id % (2 * n) AND arrived BETWEEN ts - INTERVAL 30 DAY AND ts + INTERVAL 10 DAY", plain=True)
def dependency_wait(spark: SparkSession, d: str) -> DataFrame:
    """Tasks and the pages they need as two unordered streams, stopped half-way and started again."""
    pages = t.read_table(spark, d, "pages", ["page_id", "url"])
    n = pages.count()
    tasks = t.read_table(spark, d, "events", ["event_id", "user_id", "ts"]).select(F.col("event_id").alias("id"), "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % (2 * n)).alias("page_id"))
    start = F.lit("2024-01-01").cast("timestamp")
    done = pages.select("page_id", F.timestamp_seconds(F.unix_seconds(start) + F.col("page_id") * 37 % 960 * 3600).alias("ts"), "url")
    folder, own = shared_folder(spark, "waiting"), waiting.session_for_state(spark)
    for part, files in enumerate((2, 2)):
        for name, rows in (("tasks", tasks), ("pages", done)):
            half = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
            waiting.deal_out(rows.where(half if part == 0 else ~half), f"{folder}/{name}", files, disorder="12 hours", first=10 * part)
            if part:
                _closing(rows, page_id=-1 if name == "tasks" else -2).write.parquet(f"{folder}/{name}/in=99999")
        joined = waiting.wait_for(_arrivals(own, f"{folder}/tasks", tasks), _arrivals(own, f"{folder}/pages", done), "page_id", limit="10 days", keep="30 days", late="1 day")
        waiting.drain(joined, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(joined.schema).parquet(f"{folder}/out").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "arrived")})


@register("WITH m AS (SELECT max(ts) AS top FROM events) SELECT event_id AS id, ts, user_id, 1::INTEGER AS version FROM events, m WHERE ts <= top - INTERVAL 48 HOUR", plain=True)
def settled_stream(spark: SparkSession, d: str) -> DataFrame:
    """Each event comes twice, in two versions; those that the stream is 48 hours past are let go, once, in the newer one."""
    e = t.read_table(spark, d, "events", ["event_id", "ts", "user_id"]).select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id")
    rows = e.withColumn("version", F.explode(F.array(F.lit(0), F.lit(1))))
    folder = shared_folder(spark, "settled")
    waiting.deal_out(rows, f"{folder}/in", 4, disorder="24 hours")
    held = waiting.settled_stream(_arrivals(waiting.session_for_state(spark), f"{folder}/in", rows), "id", "version")
    waiting.drain(held, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{folder}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# --- versioned tables -----------------------------------------------------------------------------------------------------------


@register("WITH b AS (SELECT user_id, event_id, value, event_id % 4 AS part FROM events), last AS (SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM b GROUP BY 1), first AS (SELECT user_id, max(event_id) AS first_event, arg_max(value, event_id) AS first_value FROM b WHERE part = 0 GROUP BY 1) SELECT last.*, first_event, first_value FROM last LEFT JOIN first USING (user_id)", plain=True)
def versioned_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Four batches of upserts, one of them replayed, and a compaction: the last rows beside those that a reader of the first version sees."""
    e = t.read_table(spark, d, "events", ["user_id", "event_id", "value"])
    table = versioned.VersionedTable(spark, shared_folder(spark, "versioned"), e.schema, "user_id", "event_id", buckets=16)
    for part in (0, 1, 2, 2, 3):
        table.upsert(e.where(F.col("event_id") % 4 == part), part)
    first = table.read(version=1).select("user_id", F.col("event_id").alias("first_event"), F.col("value").alias("first_value"))
    table.compact(most_deltas=2)
    return table.read().join(first, "user_id", "left")


# --- neighbours -----------------------------------------------------------------------------------------------------------------


@register()
def neighbour_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of all distinct vectors, built, written and loaded, and asked for the ten nearest of every fiftieth vector."""
    v = t.vector_table(spark, d)
    index = neighbours.build(vectors.distinct_vectors(v), shared_folder(spark, "neighbours"))
    return index.search(v.where("vec_id % 50 = 0"), 10).select("q", "vec_id", F.round("sim", 6).alias("sim"))


# --- lexical search ---------------------------------------------------------------------------------------------------------------

_WORDS = r"unnest(list_filter(regexp_split_to_array(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS word"
_COUNTED = "SELECT id, word, (1 + ln(count(*)))::FLOAT::DOUBLE AS w FROM ({rows}) GROUP BY ALL"
LEXICAL = f"d AS ({_COUNTED.format(rows='SELECT doc_id AS id, ' + _WORDS.format(c='text') + ' FROM documents')}), i AS (SELECT id, word, round(w * 16)::BIGINT AS impact FROM d), f AS (SELECT word, count(*) AS n FROM i GROUP BY 1), q AS (SELECT q.id AS q, word, round(w * 100 * ln(1 + (SELECT count(*) FROM documents) / n::DOUBLE))::BIGINT AS w FROM ({_COUNTED.format(rows='SELECT item_id AS id, ' + _WORDS.format(c='text') + ' FROM benchmark')}) q JOIN f USING (word)), s AS (SELECT q, id, sum(w * impact)::BIGINT AS score FROM q JOIN i USING (word) GROUP BY ALL)"


@register(f"WITH {LEXICAL} SELECT q, id, score FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= 10", plain=True)
def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents for each benchmark text by sparse weights, through a stored index that leaves out hopeless blocks."""
    encoder = encoders.CountingEncoder()
    index = lexical.build(encoders.encode_sparse(t.titles(spark, d), encoder), shared_folder(spark, "lexical"))
    asked = t.read_table(spark, d, "benchmark", ["item_id", "text"]).withColumnRenamed("item_id", "id")
    return index.search(index.rarity(encoders.encode_sparse(asked, encoder)), 10).select("q", "id", "score")


# --- labels -----------------------------------------------------------------------------------------------------------------------


@register()
def label_pick(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a map of one level, all titles alike long."""
    points = t.dataset(spark, d, "toppost").rows.select("id", "x", "y", F.col("votes").alias("score"), F.lit(12).alias("letters"))
    meta = spatial.map_meta(points).withColumn("lod_levels", F.lit(1))
    return labels.pick_labels(points, points.select(F.lit(0).alias("lod"), "id"), meta).select("zoom", "id")


@register()
def map_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of every zoom of the map, as wide as the first sentences of the points' documents."""
    points = stored(t.dataset(spark, d, "toppost").rows.select("id", "x", "y", F.col("votes").alias("score")), "points")
    n = t.rows_in(spark, d, "documents")
    letters = t.titles(spark, d).select(F.col("id").alias("doc"), scalar.title_bytes(F.regexp_extract("text", r"^[^.\n]*", 0)).alias("letters"))
    titled = points.withColumn("doc", F.col("id") % n).join(letters, "doc").drop("doc")
    meta = spatial.map_meta(points)
    return labels.pick_labels(titled, spatial.lod_sample(points, meta), meta)


# --- key-value tables -------------------------------------------------------------------------------------------------------------

_META = "description string, lang string, title string, visits bigint, share double, seen timestamp, seen_modified timestamp"


@register("SELECT page_id AS id, CASE WHEN page_id % 3 <> 0 THEN url END AS description, regexp_extract(html, 'lang=\"([a-z]*)\"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, page_id * 1000003 - 500 AS visits, page_id / 7.0 AS share, TIMESTAMP '2024-01-01' + INTERVAL 1 MICROSECOND * (page_id * 1234567 % 4000000) AS seen, TIMESTAMP '1969-07-20' + INTERVAL 1 DAY * (page_id * 37 % 300000) AS seen_modified FROM pages WHERE page_id % 10 <> 9 UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pages WHERE page_id % 10 = 9", plain=True)
def kv_url_metas(spark: SparkSession, d: str) -> DataFrame:
    """Page metadata written as binary values of a key-value table, every tenth cut off, and read back."""
    p, n = t.read_table(spark, d, "pages"), F.col("page_id")
    at = lambda day, micros: F.timestamp_micros(F.unix_micros(F.lit(day).cast("timestamp")) + micros)
    rows = p.select("page_id", F.when(n % 3 != 0, F.col("url")).alias("description"), F.regexp_extract("html", 'lang="([a-z]*)"', 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), (n * 1000003 - 500).alias("visits"), (n / F.lit(7.0)).alias("share"), at("2024-01-01", n * 1234567 % 4000000).alias("seen"), at("1969-07-20", n * 37 % 300000 * F.lit(86_400_000_000).cast("long")).alias("seen_modified"))
    value = msgpack.packed(rows, rows.columns[1:])
    kv = rows.select(F.concat(F.lit("url/"), n.cast("string"), F.lit("/meta")).alias("k"), value.alias("v"), "page_id")
    broken = kv.select("k", F.when(F.col("page_id") % 10 == 9, F.expr("substring(v, 1, octet_length(v) - 1)")).otherwise(F.col("v")).alias("v"))
    fields = spark.createDataFrame([], _META).schema
    return t.kv_values(broken, "url/%/meta", fields).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("seen", "seen_modified")})


@register("SELECT vec_id AS id, unnest(range(len(embedding)))::INTEGER AS dim, unnest(embedding) AS value FROM embeddings WHERE vec_id % 7 <> 3", plain=True)
def kv_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as raw bytes of a key-value table, some under other fields, and read back."""
    v = t.vector_table(spark, d)
    field = F.when(F.col("vec_id") % 7 == 3, "/emb_other").otherwise("/emb")
    kv = v.select(F.concat(F.lit("post/"), F.col("vec_id").cast("string"), field).alias("k"), vectors.floats_to_bytes(F.col("embedding")).alias("v"))
    return t.kv_vectors(kv, "post/%/emb", len(t.query_vector(spark, d))).select("id", F.posexplode("emb").alias("dim", "value"))


@register("SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'text' ELSE 'meta' END AS field FROM pages WHERE page_id % 5 <> 4", plain=True)
def kv_keys(spark: SparkSession, d: str) -> DataFrame:
    """Ids and fields of keys; keys of another form are none."""
    n = F.col("page_id")
    key = F.concat(F.when(n % 5 == 4, "xurl/").otherwise("url/"), n.cast("string"), F.when(n % 2 == 0, "/text").otherwise("/meta"))
    number, field = t.kv_id_field(key, "url", ["text", "meta"])
    return t.read_table(spark, d, "pages", ["page_id"]).select(number.alias("id"), field.alias("field")).where("id is not null")


# --- clusters ---------------------------------------------------------------------------------------------------------------------


@register()
def kmeans_many(spark: SparkSession, d: str) -> DataFrame:
    """Inertia and filled clusters for every k from 2 to 16, each round one scan; stopped after three rounds and taken up again."""
    v, folder = t.vector_table(spark, d), shared_folder(spark, "kmeans")
    clusters.ManyKMeans(v, range(2, 17), folder).run(3)
    return clusters.ManyKMeans(v, range(2, 17), folder).run(9).inertia()


@register("SELECT label AS cluster, string_agg(title, ' | ' ORDER BY place, id) AS titles FROM (SELECT label, vec_id AS id, (vec_id * 2654435761) % 4294967296 AS place, text || ' (' || split_part(regexp_replace(url, '^https?://', ''), '/', 1) || ')' AS title, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 2654435761) % 4294967296, vec_id) AS rn FROM embeddings JOIN pages ON page_id = vec_id % (2 * (SELECT count(*) FROM pages)) JOIN documents ON doc_id = vec_id) WHERE rn <= 5 GROUP BY 1", plain=True)
def cluster_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles and sites of five members of each cluster; members whose post has no page are left out."""
    urls = t.urls(spark, d)
    e = t.read_table(spark, d, "embeddings", ["vec_id", "label"]).select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    posts = e.select("id", (F.col("id") % (2 * urls.count())).alias("url_id"))
    return clusters.cluster_titles(e, posts, urls, t.titles(spark, d), 5).select("cluster", F.array_join("titles", " | ").alias("titles"))


@register("SELECT event_id AS id, user_id, value, event_id % 1000 <> 777 AS done, (SELECT min(event_id) FROM events WHERE event_id % 1000 = 777) AS committed FROM events", plain=True)
def id_ranges(spark: SparkSession, d: str) -> DataFrame:
    """All events asked for by ranges of ids; the second batch fails once and is taken up again; the commit stays before the first unfinished id."""
    e = t.read_table(spark, d, "events", ["event_id", "user_id", "value"]).withColumnRenamed("event_id", "id")
    n, failures = e.count(), [True]

    def work(batch: DataFrame) -> DataFrame:
        if failures and batch.where(F.col("id") > n // 2).limit(1).count():
            failures.clear()
            raise ConnectionError("no answer")
        return batch.join(e, "id").withColumn("done", F.col("id") % 1000 != 777)

    folder, schema = shared_folder(spark, "ids"), e.withColumn("done", F.lit(True)).schema
    for _ in range(2):
        try:
            table = ids.work_through(spark, folder, n - 1, work, schema, per_batch=-(-n // 3), buckets=8)
        except ids.StreamingQueryException:
            continue
    return table.read().withColumn("committed", F.lit(ids.committed(table)).cast("long"))


# --- sentiment, results, functions ------------------------------------------------------------------------------------------------

_GOOD, _BAD = ["the", "de", "und", "el"], ["of", "la", "die", "that"]
_SAID = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


@register(f"WITH c AS (SELECT conv_id * 8 + turn AS id, len(list_filter({_SAID}, lambda x: list_contains({_GOOD}, x)))::DOUBLE AS a, 1.0::DOUBLE AS b, len(list_filter({_SAID}, lambda x: list_contains({_BAD}, x)))::DOUBLE AS c FROM conversations), m AS (SELECT *, greatest(a, b, c) AS top FROM c) SELECT id, round(exp(a - top) / (exp(a - top) + exp(b - top) + exp(c - top)), 9) AS positive, round(exp(b - top) / (exp(a - top) + exp(b - top) + exp(c - top)), 9) AS neutral, round(exp(c - top) / (exp(a - top) + exp(b - top) + exp(c - top)), 9) AS negative FROM m", plain=True)
def text_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Every turn's sentiment by word lists, which stand in for a model."""
    model = sentiment.WordLists(frozenset(_GOOD), frozenset(_BAD))
    found = sentiment.classify_texts(t.thread(spark, d), model)
    return found.select("id", *[F.round(c, 9).alias(c) for c in sentiment.CLASSES])


@register("SELECT event_id AS id, coalesce(c_name, '') AS author, round(value, 0) AS votes FROM events LEFT JOIN customer ON c_custkey = user_id WHERE user_id % 3 <> 0", plain=True)
def comment_authors(spark: SparkSession, d: str) -> DataFrame:
    """Comments with their authors' names; an author who is not known has none."""
    users = t.users(spark, d)
    comments = t.comments(spark, d).where("author % 3 <> 0")
    named = comments.join(users.withColumnRenamed("id", "author"), "author", "left")
    return named.select("id", F.coalesce("username", F.lit("")).alias("author"), F.col("score").alias("votes"))


@register("SELECT id, page, score FROM (SELECT event_id AS id, round(value, 0) AS score, ((row_number() OVER (ORDER BY round(value, 0) DESC, event_id) - 1) // 20)::INTEGER AS page FROM events) WHERE page < 3", plain=True)
def result_pages(spark: SparkSession, d: str) -> DataFrame:
    """Three pages of comments by score, each found by the mark of the one before."""
    rows, after, parts = t.comments(spark, d).select("id", "score"), None, []
    for number in range(3):
        found = results.page(rows, "score", 20, after)
        after = found.after
        parts.append(found.rows.withColumn("page", F.lit(number)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("SELECT doc_id AS id FROM documents ORDER BY ((doc_id + 3 * 7919) * 2654435761) % 4294967296, doc_id LIMIT 12", plain=True)
def shuffled_sample(spark: SparkSession, d: str) -> DataFrame:
    return results.shuffled(t.titles(spark, d), 12, 3).select("id")


@register("SELECT id, min(part)::INTEGER AS part FROM (SELECT vec_id AS id, 0 AS part FROM embeddings WHERE label = 1 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT page_id, 2 FROM pages) GROUP BY 1", plain=True)
def union_of_results(spark: SparkSession, d: str) -> DataFrame:
    """Ids of three results, each once, with the first that has it."""
    vecs = t.read_table(spark, d, "embeddings", ["vec_id", "label"]).where("label = 1").select(F.col("vec_id").alias("id"))
    return results.union_ids(vecs, t.titles(spark, d).where("id % 2 = 0"), t.urls(spark, d))


@register("SELECT page_id AS id, page_id % 4 NOT IN (2) AS is_html, CASE page_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN '429' WHEN 2 THEN '5xx' WHEN 3 THEN '404' WHEN 4 THEN 'timeout' ELSE 'ok' END AS outcome, trim(CASE WHEN page_id % 3 = 0 THEN ' ' || url ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END) AS snippet FROM pages", plain=True)
def crawl_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Content types, outcomes and snippets of pages."""
    n = F.col("page_id")
    kind = F.when(n % 4 == 0, None).when(n % 4 == 1, "TEXT/HTML; charset=utf-8").when(n % 4 == 2, "application/pdf").otherwise("application/xhtml+xml")
    status = F.when(n % 6 == 1, 429).when(n % 6 == 2, 503).when(n % 6 == 3, 404).otherwise(200)
    description = F.when(n % 3 == 0, F.concat(F.lit(" "), "url")).when(n % 3 == 1, "")
    p = t.read_table(spark, d, "pages")
    return p.select(n.alias("id"), scalar.is_html_type(kind).alias("is_html"), ingest.error_code(status, F.when(n % 6 == 4, "timeout")).alias("outcome"), scalar.snippet_of(description, F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("snippet"))


@register("SELECT o_orderkey AS id, round(greatest(0, coalesce(CASE WHEN round(o_totalprice, 0) > lo THEN ln(round(o_totalprice, 0) - lo) END / ln(hi - lo + 1), 0)), 9) AS alpha FROM orders, (SELECT min(round(o_totalprice, 0)) AS lo, max(round(o_totalprice, 0)) AS hi FROM orders)", plain=True)
def point_weights(spark: SparkSession, d: str) -> DataFrame:
    """How strongly each point of the map is drawn."""
    posts = t.posts(spark, d)
    ends = posts.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return posts.crossJoin(F.broadcast(ends)).select("id", F.round(scalar.point_alpha(F.col("score"), F.col("lo"), F.col("hi")), 9).alias("alpha"))


@register("SELECT label, dim, CASE WHEN round(avg(v), 6) = 0 THEN 0 ELSE round(avg(v), 6) END AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding)))::INTEGER AS dim FROM embeddings) GROUP BY 1, 2", plain=True)
def mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector of each label."""
    e = t.read_table(spark, d, "embeddings", ["label", "embedding"])
    found = e.groupBy("label").agg(vectors.mean_vector("embedding", len(t.query_vector(spark, d))).alias("m"))
    value = F.round("x", 6)
    return found.select("label", F.posexplode("m").alias("dim", "x")).select("label", "dim", F.when(value == 0, 0.0).otherwise(value).alias("mean"))


@register("SELECT o_orderkey AS id, round(o_totalprice, 0) AS votes, '{\"name\": \"post\", \"rows\": ' || (SELECT count(*) FROM orders) || '}' AS about FROM orders", plain=True)
def dataset_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The post dataset written with what is known of it, and read back."""
    folder, made = shared_folder(spark, "dataset"), t.dataset(spark, d, "post")
    results.write_dataset(made, folder, rows=made.rows.count())
    back, about = results.read_dataset(spark, folder)
    return back.rows.select("id", "votes", F.lit(json.dumps(about)).alias("about"))


# --- layout -----------------------------------------------------------------------------------------------------------------------


@register()
def placed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts placed as labels on a layout of all documents, by their neighbours."""
    encoder = encoders.HashingEncoder(64)
    encoded = lambda df: encoders.encode_texts(df, encoder).withColumnRenamed("id", "vec_id")
    folder = shared_folder(spark, "layout")
    index = neighbours.build(vectors.distinct_vectors(encoded(t.titles(spark, d))), f"{folder}/index")
    made = layout.fit(index, f"{folder}/layout")
    texts = t.read_table(spark, d, "benchmark", ["item_id", "text"]).withColumnRenamed("item_id", "id")
    found = made.place(encoded(texts.withColumn("id", -1 - F.col("id"))))
    return found.select((-1 - F.col("vec_id")).alias("id"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("SELECT vec_id AS id, label AS cluster, round(embedding[4]::DOUBLE, 6) AS x, round(embedding[5]::DOUBLE, 6) AS y FROM embeddings", plain=True)
def cluster_points(spark: SparkSession, d: str) -> DataFrame:
    """The points of each cluster on the map."""
    e = t.read_table(spark, d, "embeddings", ["vec_id", "label"]).select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return e.join(t.layout(spark, d), "id").select("id", "cluster", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register(sql('SELECT floor(ts_day / 7)::INTEGER AS "group", sum((sent_pos >= 0.34)::INTEGER)::BIGINT AS above, -sum((sent_neg >= 0.34)::INTEGER)::BIGINT AS below, ceil(max(sim) * 100)::INTEGER AS nearest FROM cs WHERE sim >= 0.1 GROUP BY 1'), plain=True)
def sentiment_series(spark: SparkSession, d: str) -> DataFrame:
    """Positive comments per week drawn up, negative ones drawn down, and the nearest one's similarity in hundredths."""
    found = scored(t.dataset(spark, d, "comment"), QueryInput((ItemsOutput(("id",)),), (tuple(t.query_vector(spark, d)),), post_filter_clip={"sim": Clip(0.1, 2.0)}, thresholds={"sent_pos": 0.34, "sent_neg": 0.34}))
    week = scalar.bucket(F.col("ts_day"), 7.0).alias("group")
    return found.groupBy(week).agg(F.sum("sent_pos_thresh").alias("above"), (-F.sum("sent_neg_thresh")).alias("below"), scalar.hundredths(F.max("sim")).alias("nearest"))


@register("SELECT o_orderkey AS id, false AS deleted, o_orderstatus = 'F' AS dead, round(o_totalprice / 100)::SMALLINT AS score, CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_custkey END AS author, CASE WHEN o_orderkey % 7 = 0 THEN TIMESTAMP '1970-01-01' ELSE o_orderdate::TIMESTAMP END AS ts, 0::BIGINT AS url, false AS emb_missing_page FROM orders", plain=True)
def exported_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts written by their schema, what is null as the ingest rule has it, and read back."""
    o = t.read_table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("boolean").alias("deleted"), (F.col("o_orderstatus") == "F").alias("dead"), F.round(F.col("o_totalprice") / 100).alias("score"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("author"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("ts"), F.lit(None).cast("long").alias("url"), F.lit(False).alias("emb_missing_page"), "o_orderpriority")
    folder = shared_folder(spark, "export")
    t.export_table(rows, "posts", folder)
    return t.load_table(spark, folder, "posts").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_SPOT = "(s_suppkey * 37 % 101) / 10.0 * 60 AS x0, (s_suppkey * 37 % 101) / 10.0 * 60 + least(length(s_name), 255) * (13 * 0.6::DOUBLE) + 7 AS x1, (s_suppkey * 53 % 89) / 10.0 * 60 - 6.5 AS y0, (s_suppkey * 53 % 89) / 10.0 * 60 + 6.5 AS y1"


@register(f"WITH RECURSIVE b AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rn, {_SPOT} FROM supplier), g AS (SELECT 0::BIGINT AS rn, []::STRUCT(id BIGINT, x0 DOUBLE, x1 DOUBLE, y0 DOUBLE, y1 DOUBLE)[] AS picked UNION ALL SELECT b.rn, CASE WHEN len(list_filter(picked, lambda p: p.x0 <= b.x1 AND b.x0 <= p.x1 AND p.y0 <= b.y1 AND b.y0 <= p.y1)) = 0 THEN list_append(picked, {{'id': b.id, 'x0': b.x0, 'x1': b.x1, 'y0': b.y0, 'y1': b.y1}}) ELSE picked END FROM g JOIN b ON b.rn = g.rn + 1) SELECT unnest(picked).id AS id FROM (SELECT picked FROM g ORDER BY rn DESC LIMIT 1)", plain=True)
def supplier_labels(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' names on a plane, the richest first, none over another."""
    s, key = t.read_table(spark, d, "supplier"), F.col("s_suppkey")
    points = s.select(key.alias("id"), (key * 37 % 101 / F.lit(10.0)).alias("x"), (key * 53 % 89 / F.lit(10.0)).alias("y"), F.col("s_acctbal").alias("score"), F.length("s_name").alias("letters"))
    boxes = labels.with_boxes(points, 60.0, True)
    return labels.greedy(boxes, boxes.limit(0))
