"""Embedding near-duplicates by product quantisation.

Unit vectors go to coarse inverted lists; what is left of them is coded per subspace. A vector is compared with the lists it
could share a neighbour with (the bisector of two centroids bounds how near a vector of the other list can be), there by
asymmetric table lookups on the codes that its members carry (a code's own error bounds how wrong the estimate is), and what
passes is ranked again by the exact cosine. Both bounds are safe, so quantisation costs time but no link.

Equal vectors are one class from the start. The lists of a label are cut in blocks of bounded size and every vector travels once a
block, however many lists it visits there; each pair of blocks returns link counts and a spanning forest of its links, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import bounded_sample, hint_small, join_skewed, slices, written
from corpuscope.llm.components import components

#: Vectors the index is fitted on, at most; vectors of one block, and bytes of them in double precision.
FIT_ROWS, BLOCK, BLOCK_BYTES = 20_000, 8192, 16 << 20


@dataclass
class Quantiser:
    """Coarse centroids, and for each subspace (a slice of dimensions) the centroids of residuals."""

    coarse: np.ndarray
    books: list[np.ndarray]
    cuts: list[slice]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to all coarse centroids, and the nearest."""
        d = np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse * self.coarse).sum(1)[None])
        return d, d.argmin(1)

    def code(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what the code loses of each."""
        rest = x - self.coarse[lists]
        codes, lost = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, (book, cut) in enumerate(zip(self.books, self.cuts, strict=True)):
            d = (rest[:, cut] ** 2).sum(1)[:, None] - 2 * rest[:, cut] @ book.T + (book * book).sum(1)[None]
            codes[:, m] = d.argmin(1)
            lost += ((rest[:, cut] - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(lost)

    def estimate(self, queries: np.ndarray, codes: np.ndarray, coarse: int) -> np.ndarray:
        """Distances from each query to each coded vector of the list ``coarse``, by adding up table entries."""
        rest = queries - self.coarse[coarse]
        total = np.zeros((len(queries), len(codes)))
        for m, (book, cut) in enumerate(zip(self.books, self.cuts, strict=True)):
            table = (rest[:, cut] ** 2).sum(1)[:, None] - 2 * rest[:, cut] @ book.T + (book * book).sum(1)[None]
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(0, total))


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (-2 * x @ centres.T + (centres * centres).sum(1)[None]).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(1, count)[:, None], centres)
    return centres


def fit_quantiser(sample: np.ndarray, lists: int, subspaces: int = 8, codes: int = 64, seed: int = 7) -> Quantiser:
    """Coarse and residual codebooks by k-means on a sample of unit vectors."""
    coarse = _kmeans(sample, lists, 8, seed)
    near = (-2 * sample @ coarse.T + (coarse * coarse).sum(1)[None]).argmin(1)
    rest, dims = sample - coarse[near], sample.shape[1]
    edges = np.linspace(0, dims, min(subspaces, dims) + 1).astype(int)
    cuts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return Quantiser(coarse, [_kmeans(rest[:, c], codes, 8, seed + 1 + i) for i, c in enumerate(cuts)], cuts)


def _unit(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision; scaled by their largest component first, so that squares neither vanish nor overflow."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(1)[:, None]
    return flat / np.sqrt((flat * flat).sum(1))[:, None]


def _assign(quantiser):
    """Each vector with the list of its nearest centroid, its code, and what the code loses of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = quantiser.value
        for batch in slices(batches, 2048):
            if batch.num_rows:
                x = _unit(batch.column(3))
                near = q.assign(x)[1]
                codes, lost = q.code(x, near)
                yield pa.record_batch([*batch.columns, pa.array(near, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lost)], names=[*batch.schema.names, "list", "codes", "lost"])

    return run


def _could(q: Quantiser, x: np.ndarray, near: np.ndarray, reach: float) -> np.ndarray:
    """Which lists could hold a neighbour of each vector: the bisector of such a centroid and its own is no farther than ``reach``."""
    between = np.sqrt(q.assign(q.coarse)[0])
    d = q.assign(x)[0]
    return (d - d[np.arange(len(x)), near][:, None]) <= 2 * reach * between[near] + 1e-9


def _compare(quantiser, least: float, reach: float):
    """One pair of blocks of a label: for each vector the weighted number of its links, and links that join all it finds."""

    def run(table: pa.Table) -> pa.Table:
        q: Quantiser = quantiser.value
        side, cid, weight, near = (table[c].to_numpy() for c in ("side", "cid", "weight", "list"))
        x, same = _unit(table["embedding"].combine_chunks()), table["same"][0].as_py()
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(-1, len(q.books))
        lost = table["lost"].to_numpy()
        links: dict[int, int] = {}
        parent: dict[int, int] = {}
        forest: list[tuple[int, int]] = []

        def root(v: int) -> int:
            while parent.get(v, v) != v:
                parent[v] = v = parent.get(parent[v], parent[v])
            return v

        def scan(queries: np.ndarray, among: np.ndarray, coarse: int, ordered: bool) -> None:
            for at in range(0, len(queries), 256):
                part = queries[at : at + 256]
                i, j = np.nonzero(q.estimate(x[part], codes[among], coarse) <= reach + lost[among][None] + 1e-9)
                a, b = part[i], among[j]
                ok = cid[a] < cid[b] if ordered else cid[a] != cid[b]
                a, b = a[ok], b[ok]
                exact = (x[a] * x[b]).sum(1) >= least
                a, b = a[exact], b[exact]
                for u, v, wu, wv in zip(cid[a].tolist(), cid[b].tolist(), weight[a].tolist(), weight[b].tolist(), strict=True):
                    links[u], links[v] = links.get(u, 0) + wv, links.get(v, 0) + wu
                    ru, rv = root(u), root(v)
                    if ru != rv:
                        parent[max(ru, rv)] = min(ru, rv)
                        forest.append((u, v))

        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        for at in range(0, len(left), 2048):
            some = left[at : at + 2048]
            could = _could(q, x[some], near[some], reach)
            for coarse in np.unique(near[right]):
                asking, among = some[could[:, coarse]], right[near[right] == coarse]
                if same:  # each pair of lists meets once, in the one of smaller number
                    scan(asking[near[asking] == coarse], among, coarse, True)
                    scan(asking[near[asking] > coarse], among, coarse, False)
                else:
                    scan(asking, among, coarse, False)
        rows = [(k, None, n) for k, n in links.items()] + [(u, v, 0) for u, v in forest]
        return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64()), "n": pa.array([r[2] for r in rows], pa.int64())})

    return run


def embedding_duplicates(vectors: DataFrame, least: float = 0.98, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) -> ``vec_id, n_links, component_id, kept``, one row per input row.

    Rows of equal label link if the cosine of their vectors, in double precision, is ``least`` or more. n_links counts the other
    rows linked directly, component_id is the smallest vec_id that links reach, the row's own included, kept says they are
    equal. Rows whose label or vec_id is null, whose vector is null, empty or zero, or holds null or non-finite components, link
    with nothing; nor do vectors of different length. Equal vectors of a label link with each other. Rows that share a vec_id
    are rows of one vertex. The index is fitted on about ``fit_rows`` rows at most; every row is indexed. An empty table
    gives an empty table; other columns are not carried.
    """
    spark = vectors.sparkSession
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    good = rows.where("vec_id is not null and label is not null and size(embedding) > 0").where(F.coalesce(sound, F.lit(False)))
    print_of = F.unhex(F.sha2(F.array_join(F.transform("embedding", lambda v: v + F.lit(0.0)), ","), 256))  # adding 0.0 makes one zero of two
    keyed = good.select("vec_id", "label", F.size("embedding").alias("dims"), print_of.alias("print"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    classes = written(keyed.groupBy("label", "dims", "print").agg(F.min("vec_id").alias("cid"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")), "vector-classes")
    prints = written(keyed.drop("embedding"), "vector-prints")
    member = join_skewed(prints, classes.select("label", "dims", "print", "cid", "weight", F.col("weight").alias("n")), ["label", "dims", "print"]).select("vec_id", "cid", "weight")
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-7

    found = None
    for dims, size in sorted((r["dims"], r["count"]) for r in classes.groupBy("dims").count().collect()):  # vectors of a table have one length, or few
        part = classes.where(F.col("dims") == dims)
        sample = bounded_sample(part, "cid", fit_rows, "fit").orderBy("cid", "label").select("embedding").toArrow()["embedding"]  # bounded by fit_rows
        lists = max(1, min(1024, int(np.sqrt(size))))
        quantiser = spark.sparkContext.broadcast(fit_quantiser(_unit(sample.combine_chunks()), lists))
        base = part.select("label", "cid", "weight", "embedding")
        kinds = ", ".join(f"{n} {t}" for n, t in base.dtypes)
        routed = written(base.mapInArrow(_assign(quantiser), f"{kinds}, list int, codes binary, lost double"), "routed")
        # lists of a label lie side by side and are cut in blocks of bounded size; every pair of a label's blocks meets in a group of its own
        most = max(1, min(BLOCK, BLOCK_BYTES // (8 * dims)))
        of_list = written(routed.groupBy("label", "list").agg(F.count("*").alias("n")), "list-sizes")
        by_list = Window.partitionBy("label").orderBy("list")
        starts = of_list.select("label", "list", (F.sum("n").over(by_list) - F.col("n")).alias("start"), F.col("n").alias("size"), F.ceil(F.sum("n").over(Window.partitionBy("label")) / most).cast("int").alias("blocks"))
        place = F.col("start") + F.pmod(F.xxhash64("cid", F.lit("block")), F.col("size"))
        dealt = routed.join(hint_small(written(starts, "list-starts")), ["label", "list"]).withColumn("block", F.floor(place / most).cast("int"))
        pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("same"), "list", "codes", "lost", "cid", "weight", "embedding"
        )
        new = written(pairs.groupBy("label", "i", "j").applyInArrow(_compare(quantiser, least, reach), "a long, b long, n long"), "vector-links")
        found = new if found is None else found.union(new)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    reached = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "cid")
    named = member.join(links, "cid", "left").join(reached, "cid", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    named = written(named.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "vector-named")
    out = rows.select("vec_id").join(hint_small(named), "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
