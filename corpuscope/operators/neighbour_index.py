"""A stored index of nearest neighbours: built, written and loaded, and searched for all queries at once.

Vectors go to coarse lists, those of like direction together; a vector is compared with the members of the lists nearest to it.
How many lists that takes is measured on a sample, against all of the sample. Slices of the queries meet blocks of lists in
groups of bounded bytes, so an index takes the same few Spark jobs whatever its size. Each query meets the block around it
first; from the others only what comes near enough to be among its best returns.
The links of all vectors, each to its nearest others and some that it is near to, are stored beside it as a graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators.stages import first_of, stored

#: Lists at most, and vectors that they are fitted on at most; both are fewer where vectors are long (FIT_BYTES).
LISTS, FIT_ROWS, FIT_BYTES = 4096, 1 << 16, 16 << 20
#: Share of the sample's neighbours that the lists of a search must hold, and vectors of the sample that ask; a search of k asks lists of ENOUGH times k members.
FOUND, ASKING, ENOUGH = 0.96, 512, 4
#: A table is cut in about so many blocks of at least and at most so many vectors, of no more bytes.
BLOCKS, LEAST_BLOCK, MOST_BLOCK, BLOCK_BYTES = 8, 1024, 1 << 17, 32 << 20
#: Groups in which queries meet members are dealt to so many tasks at most.
TASKS = 1000
#: Queries and members of a list that a task compares at once, and how far similarities of
#: the same two vectors may lie apart by rounding.
CHUNK, MEMBERS, ROUNDING = 2048, 2048, 1e-5

NEAR = "array<struct<far:double,id:long>>"


def _floats(column: pa.Array | pa.ChunkedArray, rows: int, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(rows, dims)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def scaled(vectors: DataFrame, dims: int) -> DataFrame:
    """``vec_id, v`` of ``vectors(vec_id, embedding)``: scaled to length 1.

    Vectors that are null, of another length, zero, or hold null or non-finite components are left out.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = vectors.where(F.size("embedding") == dims).where(finite).where(F.exists("embedding", lambda x: x != 0)).select("vec_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dims)
                x /= np.abs(x).max(axis=1, keepdims=True)
                yield pa.record_batch([batch.column(0), _lists((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))], names=["vec_id", "v"])

    return sound.mapInArrow(run, "vec_id long, v array<float>")


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to the centres, up to a number of each row's own."""
    return (centres * centres).sum(axis=1)[None] - 2 * x @ centres.T


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_apart(x[at : at + CHUNK], centres).argmin(axis=1) for at in range(0, len(x), CHUNK)] or [np.zeros(0, np.int64)])


def _fit(sample: np.ndarray, lists: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Centres of the lists by k-means; one that no vector is nearest to stays."""
    centres = sample[np.sort(np.random.default_rng(seed).choice(len(sample), lists, replace=False))].copy()
    for _ in range(rounds if lists > 1 else 0):
        near = _nearest(sample, centres)
        order, count = np.argsort(near, kind="stable"), np.bincount(near, minlength=lists)
        held = np.flatnonzero(count)
        sums = np.add.reduceat(sample[order], (np.cumsum(count) - count)[held], axis=0)
        centres[held] = sums / count[held, None]
    return centres


def _side_by_side(centres: np.ndarray) -> np.ndarray:
    """The centres in an order in which those of like direction lie near each other: halved along their principal axis, over and over."""
    if len(centres) <= 2:
        return centres
    about = centres - centres.mean(axis=0)
    order = np.argsort(about @ np.linalg.eigh(about.T @ about)[1][:, -1], kind="stable")
    return np.concatenate([_side_by_side(centres[half]) for half in np.array_split(order, 2)])


def _probes(sample: np.ndarray, centres: np.ndarray, k: int) -> int:
    """How many of the lists nearest to a vector hold the share FOUND of its ``k`` nearest in the sample."""
    if len(sample) < 2 or len(centres) < 2:
        return 1
    asking = np.unique(np.linspace(0, len(sample) - 1, ASKING).astype(int))
    at, ranks = _nearest(sample, centres), []
    for part in np.array_split(asking, -(-len(asking) // 64)):
        near = sample[part] @ sample.T
        near[np.arange(len(part)), part] = -np.inf
        top = np.argpartition(-near, min(k, len(sample) - 1) - 1, axis=1)[:, : min(k, len(sample) - 1)]
        place = np.argsort(np.argsort(_apart(sample[part], centres), axis=1), axis=1)
        ranks.append(np.take_along_axis(place, at[top], axis=1).ravel())
    return int(np.quantile(np.concatenate(ranks), FOUND, method="higher")) + 1


def _asked(d: np.ndarray, probes: int, sizes: np.ndarray, k: int) -> np.ndarray:
    """Which lists each row of distances asks: the ``probes`` nearest, and more where these hold fewer than ENOUGH times ``k`` members."""
    if probes >= d.shape[1]:
        return np.ones(d.shape, bool)
    asked = d <= np.partition(d, probes - 1, axis=1)[:, probes - 1 : probes]
    few = np.flatnonzero(asked @ sizes < ENOUGH * k)
    order = np.argsort(d[few], axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    more = np.zeros((len(few), d.shape[1]), bool)
    np.put_along_axis(more, order, before < ENOUGH * k, axis=1)
    asked[few] |= more
    return asked


def _best(rows: np.ndarray, ids: np.ndarray, sims: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of pairs in columns, the ``k`` of each row with the greatest sims, ties to smaller ids."""
    place = 4 * rows - sims.astype(np.float64)  # sims of vectors of length 1
    order = np.argsort(place)
    if (tied := np.flatnonzero(np.diff(place[order]) == 0)).size:
        alike = np.unique(np.concatenate([tied, tied + 1]))
        order[alike] = order[alike][np.lexsort((ids[order[alike]], place[order[alike]]))]
    rows = rows[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    kept = order[first]
    return rows[first], ids[kept], sims[kept], at[kept]


def _binary(bits: np.ndarray) -> pa.Array:
    """Rows of bytes as an array of binary values."""
    bits = np.ascontiguousarray(bits)
    return pa.Array.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer(np.arange(0, bits.size + 1, max(1, bits.shape[1]), dtype=np.int32)), pa.py_buffer(bits)])


def _bits(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _meet(dims: int, k: int, skipped: np.ndarray, passed: tuple[str, ...] = ()):
    """A slice of queries and a block of members: of each query the best ``k`` in the lists that it asks, and how many it was compared with.

    ``asks`` has a bit for each list that a query asks, after the first 8 ``skipped`` of its block; pairs less alike than ``least``
    are left out. The columns ``passed`` of the queries return with what was found, and with ``least`` as it is known then.
    """

    def run(asking: pa.Table, members: pa.Table) -> pa.Table:
        held = members["list"].to_numpy()
        order = np.argsort(held, kind="stable")
        names, x = members["vec_id"].to_numpy()[order], _floats(members["v"], len(held), dims)[order]
        there, n = np.unique(held[order], return_counts=True)
        tiles = -(-n // MEMBERS)  # long lists come in several
        starts = np.repeat(np.cumsum(n) - n, tiles) + MEMBERS * (np.arange(tiles.sum()) - np.repeat(np.cumsum(tiles) - tiles, tiles))
        there, ends, found = np.repeat(there, tiles), np.append(starts[1:], len(held)), []
        asking = asking.sort_by("list")  # so that those compared at once ask much the same lists
        for lo in range(0, asking.num_rows if len(held) else 0, CHUNK):
            part = asking.slice(lo, CHUNK)
            q, y = part["q"].to_numpy(), _floats(part["v"], part.num_rows, dims)
            least = part["least"].to_numpy().copy()
            ask = np.unpackbits(_bits(part["asks"]), axis=1).view(bool)[:, there - 8 * skipped[part["block"][0].as_py()]]
            compared = ask @ (ends - starts)
            # one more than k, as the query may be there itself
            bound = lambda near: np.partition(near, near.shape[1] - k - 1, axis=1)[:, near.shape[1] - k - 1] - ROUNDING
            nearest = part["list"].to_numpy()
            for i in np.flatnonzero(np.isin(there, nearest) & (ends - starts > 4 * k)):  # the list nearest to a query bounds its best
                rows = np.flatnonzero(ask[:, i] & (nearest == there[i]) & np.isneginf(least))
                least[rows] = bound(y[rows] @ x[starts[i] : ends[i]].T)
            best, more, waiting = None, [], 0
            for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
                rows = np.flatnonzero(ask[:, i])
                near = y[rows] @ x[s:e].T
                new = np.flatnonzero(np.isneginf(least[rows]))
                if e - s > 4 * k and len(new):
                    least[rows[new]] = bound(near[new])
                at = np.flatnonzero(near >= least[rows][:, None])
                r, c = at // (e - s), at % (e - s)
                more.append((rows[r], names[s + c], near.ravel()[at], s + c))
                waiting += len(at)
                if waiting > 4 * k * len(q) or i + 1 == len(starts):
                    best = [np.concatenate(c) for c in zip(*([best] if best else []), *more, strict=True)]
                    other = best[1] != q[best[0]]
                    best = _best(*[c[other] for c in best], k)
                    n = np.bincount(best[0], minlength=len(q))
                    last = (np.cumsum(n) - 1)[n == k]
                    least[n == k] = np.maximum(least[n == k], best[2][last] - ROUNDING)
                    more, waiting = [], 0
            rows, ids, _, at = best
            exact = np.einsum("ij,ij->i", y[rows].astype(np.float64), x[at].astype(np.float64))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(q)))]).astype(np.int32)
            near = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(-exact), pa.array(ids.astype(np.int64))], ["far", "id"]))
            found.append(pa.table({**{c: part[c] for c in ("q", *passed)}, "least": pa.array(least), "near": near, "compared": pa.array(compared.astype(np.int64))}))
        if found:
            return pa.concat_tables(found)
        near = pa.array([[]] * asking.num_rows, pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())])))
        return pa.table({**{c: asking[c] for c in ("q", *passed)}, "least": asking["least"], "near": near, "compared": pa.array(np.zeros(asking.num_rows, np.int64))})

    return run


@dataclass
class NeighbourIndex:
    """Tables of an index: ``vectors(vec_id, v, list, block)``, ``centres(list, centre, size, first, last)``, ``links(vec_id, neighbours, around)``.

    ``first`` and ``last`` are the blocks that a list's members lie in, -1 where it has none.
    """

    spark: SparkSession
    folder: str
    k: int
    dims: int
    probes: int
    block: int
    compared: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def neighbours(self) -> DataFrame:
        """``vec_id, neighbours``: the (about) k nearest others of each vector as structs (id, sim), nearest first."""
        return self.table("links").select("vec_id", "neighbours")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """``q, vec_id, sim, compared``: about the ``k`` vectors nearest to each of ``queries(vec_id, embedding)``, one of its own id left out.

        ``compared`` is the number of vectors a query was compared with. Queries have ids of their own.
        """
        found = self._near(scaled(queries, self.dims), k)
        return found.select("q", F.explode("near").alias("n"), "compared").select("q", F.col("n.id").alias("vec_id"), (-F.col("n.far")).alias("sim"), "compared")

    def _near(self, asking: DataFrame, k: int) -> DataFrame:
        """``q, near, compared`` of ``asking(vec_id, v)``: structs (far, id), nearest first.

        A query first meets the block that holds the list nearest to it. What it found there bounds what can still be among its
        best, so the groups in which it meets the others return little.
        """
        at = self.table("centres").orderBy("list").toArrow()  # at most LISTS rows
        centres = _floats(at["centre"], at.num_rows, self.dims)
        sizes, first, last = (at[c].to_numpy() for c in ("size", "first", "last"))
        probes, blocks, dims = self.probes, int(last.max(initial=-1)) + 1, self.dims
        schema = "q long, v array<float>, list int, block int, asks binary, least float"
        if not blocks:
            return asking.limit(0).select(F.col("vec_id").alias("q"), F.array().cast(NEAR).alias("near"), F.lit(0).cast("long").alias("compared"))

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(lo, CHUNK) for b in batches for lo in range(0, b.num_rows, CHUNK)):
                apart = _apart(_floats(batch.column(1), batch.num_rows, dims), centres)
                asks = _binary(np.packbits(_asked(apart, probes, sizes, k), axis=1))
                apart[:, sizes == 0] = np.inf
                home = apart.argmin(axis=1)
                least = pa.array(np.full(len(home), -np.inf, np.float32))
                yield pa.record_batch([*batch.columns, pa.array(home, pa.int32()), pa.array(first[home], pa.int32()), asks, least], names=["q", "v", "list", "block", "asks", "least"])

        # bytes of the bits of the lists that lie in a block
        lies = (first[:, None] <= np.arange(blocks)) & (np.arange(blocks) <= last[:, None])
        lo, hi = lies.argmax(axis=0) // 8, (len(first) - 1 - lies[::-1].argmax(axis=0)) // 8 + 1

        def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, CHUNK) for b in batches for at in range(0, b.num_rows, CHUNK)):
                bits = _bits(batch.column(4))
                ask = np.unpackbits(bits, axis=1, count=len(first)).astype(np.float32) @ lies.astype(np.float32) > 0
                ask[np.arange(len(ask)), batch.column(3).to_numpy()] = False
                for block in np.flatnonzero(ask.any(axis=0)):
                    rows = np.flatnonzero(ask[:, block])
                    q, v, near, _, _, least = (c.take(pa.array(rows)) for c in batch.columns)
                    yield pa.record_batch([q, v, near, pa.array(np.full(len(rows), block, np.int32)), _binary(bits[rows, lo[block] : hi[block]]), least], names=batch.schema.names)

        asked = stored(asking.mapInArrow(routed, schema), "asked")
        count = {r["block"]: r["count"] for r in asked.groupBy("block").count().collect()}
        members, piece = self.table("vectors"), F.xxhash64("q")

        def met(left: DataFrame, right: DataFrame, groups: int, skipped: np.ndarray, passed: tuple[str, ...], result: str) -> DataFrame:
            tasks = max(min(groups, TASKS), int(self.spark.conf.get("spark.sql.shuffle.partitions")))  # work goes with pairs, not with bytes
            left, right = (df.repartition(tasks, "slice", "block").groupBy("slice", "block") for df in (left, right))
            return left.cogroup(right).applyInArrow(_meet(dims, k, skipped, passed), f"{result}, near {NEAR}, compared long")

        pieces = [-(-4 * count.get(b, 0) // self.block) for b in range(blocks)]
        slices = F.get(F.lit(pieces), F.col("block")).cast("int")
        left = asked.withColumn("slice", F.pmod(piece, slices).cast("int"))
        right = members.where(slices > 0).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        found = met(left, right, sum(pieces), np.zeros(blocks, int), ("v", "list", "block", "asks"), schema)
        best = F.slice(F.sort_array("near"), 1, k).alias("near")
        if blocks == 1:
            return found.select("q", best, "compared")
        found = stored(found, "found")
        parts = max(1, -(-sum(count.values()) // self.block))
        left = found.select("q", "v", "list", "block", "asks", "least").mapInArrow(elsewhere, schema).withColumn("slice", F.pmod(piece, F.lit(parts)).cast("int"))
        right = members.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        more = met(left, right, parts * blocks, lo, (), "q long, least float")
        # a query has k entries at most for each of the blocks
        both = found.select("q", "near", "compared").union(more.select("q", "near", "compared"))
        return both.groupBy("q").agg(F.flatten(F.collect_list("near")).alias("near"), F.sum("compared").alias("compared")).select("q", best, "compared")



def build(vectors: DataFrame, folder: str, k: int = 15, *, seed: int = 7) -> NeighbourIndex:
    """Build the index of ``vectors(vec_id, embedding)`` under ``folder`` and return it as :func:`load` does.

    Vectors must have ids of their own; equal vectors should be given once (``vectors.distinct_vectors``), as copies would
    fill each other's lists. Lists are fitted, and the number that is asked is chosen, on at most FIT_ROWS vectors; all are
    indexed. Each vector keeps ``k`` neighbours; around it are at most 2 k, its neighbours and, chosen by hash, some of those
    that it is a neighbour of.
    """
    spark = vectors.sparkSession
    vectors = stored(vectors.select("vec_id", "embedding"), "given-vectors")
    head = vectors.where(F.col("embedding").isNotNull()).orderBy("vec_id").select(F.size("embedding")).first()
    dims = head[0] if head else 0
    scaled(vectors, dims).write.parquet(f"{folder}/scaled")
    held = spark.read.parquet(f"{folder}/scaled")
    total, most = held.count(), max(1, min(FIT_ROWS, FIT_BYTES // max(4, 4 * dims)))
    place = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 32))
    some = held.where(place < F.lit((1 << 32) * most // max(1, total))).orderBy("vec_id").select("v").toArrow()["v"]  # about most rows
    sample = _floats(some, len(some), dims)
    lists = max(1, min(LISTS, int(4 * total**0.5), len(sample) // 16))
    centres = _side_by_side(_fit(sample, lists, seed)) if len(sample) else np.zeros((1, dims), np.float32)
    probes = _probes(sample, centres, k)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([*batch.columns, pa.array(_nearest(_floats(batch.column(1), batch.num_rows, dims), centres), pa.int32())], names=["vec_id", "v", "list"])

    block = max(1, min(max(LEAST_BLOCK, -(-total // BLOCKS)), MOST_BLOCK, BLOCK_BYTES // max(4, 4 * dims)))
    dealt = held.mapInArrow(listed, "vec_id long, v array<float>, list int")
    sizes = np.zeros(len(centres), np.int64)
    for r in dealt.groupBy("list").count().collect():  # at most LISTS rows
        sizes[r["list"]] = r["count"]
    starts = np.cumsum(sizes) - sizes
    rows = [(i, c.tolist(), int(n), int(s // block) if n else -1, int((s + n - 1) // block) if n else -1) for i, (c, s, n) in enumerate(zip(centres, starts, sizes, strict=True))]
    spark.createDataFrame(rows, "list int, centre array<float>, size long, first int, last int").coalesce(1).write.parquet(f"{folder}/centres")
    # lists lie side by side, and a block is cut wherever it is full
    start, size = (F.get(F.lit(x.tolist()), F.col("list")) for x in (starts, np.maximum(1, sizes)))
    at = start + F.pmod(F.xxhash64(F.lit(seed), "vec_id"), size)
    dealt.select("vec_id", "v", "list", F.floor(at / block).cast("int").alias("block")).write.parquet(f"{folder}/vectors")

    index = NeighbourIndex(spark, folder, k, dims, probes, block, 0)
    index._near(held, k).write.parquet(f"{folder}/near")
    near = spark.read.parquet(f"{folder}/near")
    compared = near.agg(F.coalesce(F.sum("compared"), F.lit(0))).first()[0]
    nearest = near.select(F.col("q").alias("vec_id"), F.transform("near", lambda n: F.struct(n["id"].alias("id"), (-n["far"]).cast("float").alias("sim"))).alias("neighbours"))
    graph = nearest.select(F.explode("neighbours.id").alias("vec_id"), F.col("vec_id").alias("other"))
    # of those that a vector is near to, 2 k hold enough that are not its own neighbours
    towards = first_of(graph.withColumn("place", F.xxhash64("vec_id", "other")), "vec_id", [F.asc("place"), F.asc("other")], 2 * k)
    towards = towards.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("place", "other")))["other"].alias("towards"))
    none = F.array().cast("array<long>")
    own, others = F.coalesce("neighbours.id", none), F.coalesce("towards", none)
    around = F.slice(F.concat(own, F.array_except(others, own)), 1, 2 * k).alias("around")
    linked = nearest.join(towards, "vec_id", "full").where(F.size(own) + F.size(others) > 0)
    linked.select("vec_id", F.coalesce("neighbours", F.array().cast("array<struct<id:long,sim:float>>")).alias("neighbours"), around).write.parquet(f"{folder}/links")
    about = spark.createDataFrame([(k, dims, probes, block, int(compared))], "k int, dims int, probes int, block int, compared long")
    about.coalesce(1).write.parquet(f"{folder}/about")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> NeighbourIndex:
    """An index that :func:`build` wrote; it was finished if its last table is there."""
    about = spark.read.parquet(f"{folder}/about").first()
    return NeighbourIndex(spark, folder, about["k"], about["dims"], about["probes"], about["block"], about["compared"])
