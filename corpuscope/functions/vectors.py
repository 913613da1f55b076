"""Vector functions: similarity to query vectors, top-k, distinct vectors, running means."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many dimensions a product is spelled out term by term, which compiles to straight code; beyond, it is folded.
UNROLLED = 128


def dot(embedding: Column, vector: list[float]) -> Column:
    """Inner product with a constant vector, in double precision."""
    if len(vector) <= UNROLLED:
        return reduce(add, [F.get(embedding, F.lit(i)).cast("double") * F.lit(float(v)) for i, v in enumerate(vector)])
    constant = F.array(*[F.lit(float(v)) for v in vector])
    return F.aggregate(F.zip_with(embedding, constant, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def similarity(embedding: Column, queries: list[list[float]], how: str = "mean") -> Column:
    """Mean, min or max over the queries of the inner product (the cosine, as all vectors have length 1)."""
    sims = [dot(embedding, q) for q in queries]
    if len(sims) == 1:
        return sims[0]
    if how == "mean":
        return reduce(add, sims) / F.lit(float(len(sims)))
    if how in ("min", "max"):
        return (F.least if how == "min" else F.greatest)(*sims)
    raise ValueError(f"no similarity aggregate {how!r}")


def many_similarities(vectors: DataFrame, queries: np.ndarray) -> DataFrame:
    """``vec_id, sims``: one matrix product per Arrow batch, for many queries at once.

    Vectors that are null or not of the queries' length are left out. The optimiser sees no expression that it could copy
    into filters above, so each product is taken once.
    """
    whole = vectors.where(F.size("embedding") == queries.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                out = x @ queries.T
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), pa.array(out.ravel()))], names=["vec_id", "sims"])

    return whole.select("vec_id", "embedding").mapInArrow(run, "vec_id long, sims array<double>")


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The ``k`` vectors most similar to ``query``: ``vec_id, sim``, ties by id."""
    return vectors.select("vec_id", dot(F.col("embedding"), query).alias("sim")).orderBy(F.desc("sim"), "vec_id").limit(k)


def top_k_union(vectors: DataFrame, queries: list[list[float]], k: int) -> DataFrame:
    """Union of every query's top k: ``vec_id, sim_0, sim_1, ...``, 0 where a vector is not in that query's top k."""
    parts = [nearest(vectors, q, k).select("vec_id", F.lit(i).alias("q"), "sim") for i, q in enumerate(queries)]
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("vec_id").agg(*[F.coalesce(F.max(F.when(F.col("q") == i, F.col("sim"))), F.lit(0.0)).alias(f"sim_{i}") for i in range(len(queries))])


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """The smallest id of each distinct vector."""
    return vectors.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "embedding")


def mean_vector(column: str, dims: int) -> Column:
    """Aggregate: the mean of vectors, dimension by dimension; null for no vectors."""
    return F.array(*[F.avg(F.get(F.col(column), F.lit(i)).cast("double")) for i in range(dims)])


def bytes_to_floats(c: Column, dims: int) -> Column:
    """Little-endian float32 bytes as an array of float (Arrow UDF)."""

    @F.pandas_udf("array<float>")
    def decode(raw):  # noqa: ANN001, ANN202
        return raw.map(lambda b: None if b is None or len(b) != 4 * dims else np.frombuffer(b, "<f4"))

    return decode(c)


def floats_to_bytes(c: Column) -> Column:
    @F.pandas_udf("binary")
    def encode(vector):  # noqa: ANN001, ANN202
        return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return encode(c)
