"""Logical tables: schemas, ingest defaults, key-value scans, and the mapping from a star-schema data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.functions import msgpack, scalar, vectors
from corpuscope.plans.query import Dataset

_KINDS = {"l": T.LongType(), "i": T.IntegerType(), "h": T.ShortType(), "b": T.BooleanType(), "s": T.StringType(), "t": T.TimestampType(), "d": T.DoubleType(), "f": T.FloatType(), "v": T.ArrayType(T.FloatType()), "m": T.MapType(T.StringType(), T.FloatType())}


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split(":") for x in spec.split())])


#: Logical tables and their columns.
SCHEMAS = {
    "posts": _schema("id:l deleted:b dead:b score:h author:l ts:t url:l emb_missing_page:b"),
    "comments": _schema("id:l deleted:b dead:b score:h parent:l author:l ts:t post:l"),
    "users": _schema("id:l username:s"),
    "urls": _schema("id:l url:s proto:s fetched:t fetch_err:s fetched_via:s found_in_archive:b"),
    "url_metas": _schema("id:l description:s image_url:s lang:s snippet:s timestamp:t timestamp_modified:t title:s"),
    "comment_sentiments": _schema("id:l positive:f neutral:f negative:f"),
    "texts": _schema("id:l text:s"),
    "interactions": _schema("user:l post:l"),
    "embeddings": _schema("id:l emb:v"),
    "sparse_weights": _schema("id:l weights:m"),
    "layout": _schema("id:l x:f y:f"),
}
#: Recency is measured from this day in the fixed queries: 2024-02-01.
NOW_DAYS = 19754.0


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def without_nulls(df: DataFrame) -> DataFrame:
    """Ingest rule: null numbers are 0, strings empty, flags false, times 1970-01-01."""

    def filled(f: T.StructField):  # noqa: ANN202
        if isinstance(f.dataType, T.StringType):
            return F.coalesce(F.col(f.name), F.lit(""))
        if isinstance(f.dataType, T.BooleanType):
            return F.coalesce(F.col(f.name), F.lit(False))
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.coalesce(F.col(f.name), F.lit("1970-01-01").cast(f.dataType))
        if isinstance(f.dataType, T.NumericType):
            return F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType))
        return F.col(f.name)

    return df.select(*[filled(f).alias(f.name) for f in df.schema])


def typed(df: DataFrame, name: str) -> DataFrame:
    """``df`` as the logical table ``name`` of SCHEMAS: its columns in order, cast, with the ingest rule for nulls; other columns go.

    A column that is missing, or a value that its type can't hold, fails the job.
    """
    if missing := [f.name for f in SCHEMAS[name] if f.name not in df.columns]:
        raise ValueError(f"{name} lacks {missing}")
    return without_nulls(df.select(*[_held(df, f) for f in SCHEMAS[name]]))


def _held(df: DataFrame, f: T.StructField) -> Column:
    c, made = F.col(f.name), F.col(f.name).try_cast(f.dataType)
    if isinstance(f.dataType, (T.ArrayType, T.MapType)):
        return c.cast(f.dataType).alias(f.name)
    return F.when(c.isNotNull() & made.isNull(), F.raise_error(F.concat(F.lit(f"{f.name} can't hold "), c.cast("string"))).cast(f.dataType)).otherwise(made).alias(f.name)


def export_table(df: DataFrame, name: str, folder: str) -> None:
    """Write a logical table as Parquet; a folder that has it already is left as it is."""
    typed(df, name).write.mode("ignore").parquet(f"{folder}/{name}")


def load_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A logical table that :func:`export_table` wrote, by its schema; only ``columns`` are read where they are given."""
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")
    return df.select(*columns) if columns else df


def strict_flag(df: DataFrame, column: str) -> DataFrame:
    """0 and 1 as boolean; any other number fails the job."""
    c = F.col(column)
    return df.withColumn(column, F.when(c.isin(0, 1), c.cast("boolean")).when(c.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit(f"{column} is no flag: "), c.cast("string"))).cast("boolean")))


def kv_scan(kv: DataFrame, pattern: str, value: str = "text") -> DataFrame:
    """``id`` and the UTF-8 value of all keys like ``pattern`` (entity/%/field); keys without a number are dropped."""
    found = kv.where(F.col("k").like(pattern)).select(scalar.kv_id(F.col("k")).alias("id"), F.decode("v", "UTF-8").alias(value))
    return found.where("id is not null")


def kv_id_field(key: Column, entity: str, fields: list[str]) -> tuple[Column, Column]:
    """The id and field of keys of the form entity/id/field with one of ``fields``; both null for any other key."""
    pattern = f"^{entity}/([0-9]+)/({'|'.join(fields)})$"
    field = F.nullif(F.regexp_extract(key, pattern, 2), F.lit(""))
    return F.when(field.isNotNull(), F.regexp_extract(key, pattern, 1).try_cast("long")), field


def kv_values(kv: DataFrame, pattern: str, fields: T.StructType) -> DataFrame:
    """``id`` and ``fields`` of the MessagePack maps of all keys like ``pattern``; malformed values give nulls, keys without a number are dropped."""
    found = kv.where(F.col("k").like(pattern)).select(scalar.kv_id(F.col("k")).alias("id"), msgpack.unpacked(F.col("v"), fields).alias("f"))
    return found.where("id is not null").select("id", "f.*")


def kv_vectors(kv: DataFrame, pattern: str, dims: int) -> DataFrame:
    """``id, emb`` of the raw float32 values of all keys like ``pattern``; values of another length give nulls."""
    found = kv.where(F.col("k").like(pattern)).select(scalar.kv_id(F.col("k")).alias("id"), vectors.bytes_to_floats(F.col("v"), dims).alias("emb"))
    return found.where("id is not null")


def keyset_jdbc(spark: SparkSession, url: str, table: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A relational table in ranges of its key, read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="id", lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions), **options).load()


# --- the mapping from a star-schema folder ------------------------------------------------------------------------------


def rows_in(spark: SparkSession, folder: str, name: str) -> int:
    return read_table(spark, folder, name).count()


def vector_table(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings", ["vec_id", "embedding"])


def query_vector(spark: SparkSession, folder: str, vec_id: int = 0) -> list[float]:
    """One vector, to stand for an encoded query text."""
    return list(vector_table(spark, folder).where(F.col("vec_id") == vec_id).first()["embedding"])


def posts(spark: SparkSession, folder: str) -> DataFrame:
    o = read_table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author"), F.round("o_totalprice", 0).alias("score"), F.col("o_orderdate").alias("ts"))


def comments(spark: SparkSession, folder: str) -> DataFrame:
    n_posts = rows_in(spark, folder, "orders")
    e = read_table(spark, folder, "events", ["event_id", "user_id", "value", "ts"])
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("author"), F.round("value", 0).alias("score"), F.col("ts").alias("ts"), (F.col("event_id") % n_posts).alias("post"))


def users(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "customer", ["c_custkey", "c_name"]).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))


def urls(spark: SparkSession, folder: str) -> DataFrame:
    p = read_table(spark, folder, "pages", ["page_id", "url"])
    return p.select(F.col("page_id").alias("id"), scalar.strip_protocol(F.col("url")).alias("url"), F.regexp_extract("url", "^(https?):", 1).alias("proto"))


def titles(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents", ["doc_id", "text"]).select(F.col("doc_id").alias("id"), "text")


def layout(spark: SparkSession, folder: str) -> DataFrame:
    v = vector_table(spark, folder)
    return v.select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(3)).cast("double").alias("x"), F.get("embedding", F.lit(4)).cast("double").alias("y"))


def thread(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as a comment tree: each turn hangs on the one before."""
    c = read_table(spark, folder, "conversations")
    here = F.col("conv_id") * 8 + F.col("turn")
    return c.select(here.alias("id"), F.when(F.col("turn") > 0, here - 1).alias("parent"), "conv_id", "turn", "text")


def dataset(spark: SparkSession, folder: str, name: str) -> Dataset:
    """The query tables post, toppost and comment."""
    from corpuscope.operators import features

    held = vector_table(spark, folder)
    if name == "comment":
        rows = features.comment_table(comments(spark, folder), sentiments(spark, folder))
    else:
        rows = features.post_table(posts(spark, folder), comment_posts(spark, folder))
    n = held.count()
    rows = rows.withColumn("emb_key", F.col("id") % n)
    if name == "toppost":
        rows = rows.join(layout(spark, folder).withColumnRenamed("id", "emb_key"), "emb_key")
    return Dataset(name, rows, held)


def comment_posts(spark: SparkSession, folder: str) -> DataFrame:
    """The post of each comment, for counts."""
    return read_table(spark, folder, "lineitem", ["l_orderkey"]).select(F.col("l_orderkey").alias("post"))


def sentiments(spark: SparkSession, folder: str) -> DataFrame:
    """Softmax of three components, rounded, to stand for a sentiment model's output; keyed by vector."""
    v = vector_table(spark, folder)
    parts = scalar.softmax(*[F.get("embedding", F.lit(i)).cast("double") for i in range(3)])
    return v.select(F.col("vec_id").alias("key"), *[F.round(p, 6).alias(n) for p, n in zip(parts, ("sent_pos", "sent_neu", "sent_neg"), strict=True)]).withColumn("keys", F.lit(v.count()).cast("long"))
